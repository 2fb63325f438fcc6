"""Licence recognition by sentence rules, with DataFrame functions alone.

A text is cut into pieces at line ends and sentence marks, and these are normalised, so that
comment leaders, case and marks don't count. Known licence sentences, which have identifiers, are
found from the start of one piece to the end of the same or a later one, as wrapped lines and
marks inside a sentence need it; the longest known one counts and uses its pieces up. The
identifiers of a text, in order, are then matched against licence rules (identifier sequences),
longest first in the order listed; what a rule has matched is used up, so a long licence is not
also reported as the short ones it contains. An identifier that no rule uses is reported as
``partial``.

Defined results: a null text has no sentences; a text without licence sentences has an empty
list; a text of any length is read whole; null keys and repeated rows come back as often as they
occur; licences are listed once each, sorted; an empty table gives an empty table; only the key
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.common import table

#: Known licence sentences, normalised (lower case, marks to single blanks), by identifier.
SENTENCES = {
    "mit-ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mit-name": ("mit license", "the mit license", "the mit license mit"),
    "apache-ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0"),
    "apache-name": ("apache license", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004 https www apache org licenses"),
    "apache-terms": ("terms and conditions for use reproduction and distribution",),
    "gpl2-ref": ("this work is licensed under the gnu general public license version 2",),
    "gpl3-ref": ("this work is licensed under the gnu general public license version 3",),
    "gpl2-only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    "gpl3-only": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    "gpl2-later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl-see": ("see the gnu general public license for more details",),
    "gpl-copy": ("you should have received a copy of the gnu general public license along with this program",),
    "lgpl-ref": ("this work is licensed under the gnu lesser general public license version 3",),
    "lgpl21-later": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "lgpl3-later": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "lgpl-hope": ("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "lgpl-see": ("see the gnu lesser general public license for more details",),
    "lgpl-copy": ("you should have received a copy of the gnu lesser general public license along with this library",),
    "agpl-later": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "agpl-see": ("see the gnu affero general public license for more details",),
    "agpl-copy": ("you should have received a copy of the gnu affero general public license along with this program",),
    "mpl-ref": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "epl-ref": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    "cc-by-ref": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa-ref": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc-ref": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0-ref": ("licensed under cc0 1 0",),
    "grant-mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "notice-mit": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "grant-isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "grant-bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-name": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "boost-ref": ("distributed under the boost software license version 1 0", "boost software license version 1 0", "boost software license version 1 0 august 17th 2003"),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "unlicense-domain": ("this is free and unencumbered software released into the public domain",),
    "unlicense-grant": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "apache-except": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
}
#: Licences that a line "SPDX-License-Identifier: name" may name, besides GPL-2.0 and the like, which stand for the -only ones.
SPDX = ("MIT", "ISC", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", *(f"{name}-{which}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("only", "or-later")))
SENTENCES |= {f"spdx-{x.lower()}": tuple("spdx license identifier " + re.sub("[^a-z0-9]+", " ", y.lower()) for y in ((x, x.removesuffix("-only")) if x.endswith("-only") else (x,))) for x in SPDX}

#: (head, sentences that may follow it) of the notices of one family.
NOTICES = (
    ("GPL-2.0-only", "gpl2-only", ("gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0-only", "gpl3-only", ("gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", "gpl2-later", ("gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", "gpl-later", ("gpl-hope", "gpl-see", "gpl-copy")),
    ("LGPL-2.1-or-later", "lgpl21-later", ("lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("LGPL-3.0-or-later", "lgpl3-later", ("lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("AGPL-3.0-or-later", "agpl-later", ("gpl-hope", "agpl-see", "agpl-copy")),
)
#: (licence, sequence of identifiers), in the order of matching.
RULES = (
    ("MIT", ("mit-name", "grant-mit", "notice-mit")),
    ("MIT", ("grant-mit", "notice-mit")),
    ("BSD-3-Clause", ("grant-bsd", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("grant-bsd", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-ref", "apache-except", "apache-copy")),
    ("Apache-2.0", ("apache-ref", "apache-except")),
    ("Apache-2.0", ("apache-name", "apache-terms")),
    ("Unlicense", ("unlicense-domain", "unlicense-grant")),
    *((name, (head, *tail[:n])) for n in (3, 2, 1, 0) for name, head, tail in NOTICES),
    ("ISC", ("grant-isc",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-name",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("LGPL-3.0-only", ("lgpl-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("EPL-2.0", ("epl-ref",)),
    ("BSL-1.0", ("boost-ref",)),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-domain",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    *((x, (f"spdx-{x.lower()}",)) for x in SPDX),
)
#: Each known sentence holds one of these words, so a text with none of them needs no cutting up.
MARKERS = ("licen", "permission", "redistribution", "copyright", "warranty", "endorse", "reproduction", "unencumbered", "compile")

#: Sentences end at line ends and at .;:!? before white space.
SENTENCE_END = r"\n+|(?<=[.;:!?])[\x20\t\r]+"

#: Known sentences, longest first, and what finds them between the bars that stand between pieces.
KNOWN = sorted(((s, i) for i, ss in SENTENCES.items() for s in ss), key=lambda x: (-len(x[0]), x[0]))
FIND = r"\|(" + "|".join(s.replace(" ", "[ |]") for s, _ in KNOWN) + r")(?=\|)"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN for x in pair])
    body = F.coalesce(text, F.lit(""))
    # marks first, so that every piece is normalised at once; bars stand at both ends of each
    barred = F.regexp_replace(F.lower(F.regexp_replace(F.translate(body, "|", "*"), SENTENCE_END, "|")), "[^a-z0-9|]+", " ")
    barred = F.regexp_replace(F.concat(F.lit("|"), barred, F.lit("|")), r" ?\|[ |]*", "|")
    ids = F.transform(F.regexp_extract_all(barred, F.lit(FIND), F.lit(1)), lambda s: F.try_element_at(known, F.replace(s, F.lit("|"), F.lit(" "))))
    return F.when(F.lower(body).rlike("|".join(MARKERS)), ids).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """Sorted licences of a sequence of identifiers."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f",{','.join(seq)},").alias("seq")) for name, seq in RULES])
    # every identifier stands between commas of its own, so that neighbours can both be used
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.struct(F.when(acc["left"].contains(r["seq"]), F.replace(F.replace(acc["left"], r["seq"], F.lit(",,")), r["seq"], F.lit(",,"))).otherwise(acc["left"]).alias("left"), F.when(acc["left"].contains(r["seq"]), F.array_append(acc["found"], r["name"])).otherwise(acc["found"]).alias("found"))
    done = F.aggregate(rules, start, step, lambda acc: F.when(F.length(F.replace(acc["left"], F.lit(","), F.lit(""))) > 0, F.array_append(acc["found"], F.lit("partial"))).otherwise(acc["found"]))
    return F.when(F.size(ids) > 0, F.array_sort(F.array_distinct(done))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_ids (array) and licenses (array), one row per input row."""
    own = docs.select(F.col(key).alias(key), sentence_ids(F.col(text)).alias("sentence_ids"))
    return own.withColumn("licenses", matched(F.col("sentence_ids")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_PIECES = r"string_split(regexp_replace(coalesce(text, ''), '\n+|([.;:!?])[\x20\t\r]+', '\1' || chr(10), 'g'), chr(10))"
_FIRST = "|".join(sorted({s.split()[0] for s, _ in KNOWN}))

#: Joins of pieces are spelled out and looked up in a table, and the earliest, longest ones chosen one after the other; so is the fold over rules.
OP9_SQL = f"""
WITH RECURSIVE known(s, id) AS (VALUES {_values(KNOWN)}),
d AS (SELECT doc_id, list_filter(list_transform({_PIECES}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS ps FROM documents),
a AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM d),
c AS (SELECT doc_id, ps, i, unnest(range(i, least(len(ps), i + {max(len(s.split()) for s, _ in KNOWN)}) + 1)) AS j FROM a WHERE regexp_matches(ps[i], '^({_FIRST})( |$)')),
h AS (SELECT doc_id, i, j, id FROM c JOIN known ON array_to_string(ps[i:j], ' ') = known.s),
b AS (SELECT doc_id, i, max(j) AS j, max_by(id, j) AS id FROM h GROUP BY doc_id, i),
g AS (
  SELECT doc_id, i, j, id FROM b WHERE i = (SELECT min(o.i) FROM b o WHERE o.doc_id = b.doc_id)
  UNION ALL
  SELECT b.doc_id, b.i, b.j, b.id FROM g JOIN b ON b.doc_id = g.doc_id AND b.i = (SELECT min(o.i) FROM b o WHERE o.doc_id = g.doc_id AND o.i > g.j)),
k AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids, count(*) AS n FROM g GROUP BY doc_id),
x0 AS (SELECT doc_id, n, ids, ',' || ids || ',' AS l, CAST([] AS VARCHAR[]) AS f FROM k),
{"".join(f"x{k + 1} AS (SELECT doc_id, n, ids, replace(replace(l, ',{','.join(seq)},', ',,'), ',{','.join(seq)},', ',,') AS l, CASE WHEN contains(l, ',{','.join(seq)},') THEN list_append(f, '{name}') ELSE f END AS f FROM x{k})," + chr(10) for k, (name, seq) in enumerate(RULES))}
z AS (SELECT doc_id, n, ids, list_sort(list_distinct(CASE WHEN replace(l, ',', '') <> '' THEN list_append(f, 'partial') ELSE f END)) AS f FROM x{len(RULES)})
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(f, ','), '') AS licenses
FROM documents d LEFT JOIN z USING (doc_id)
"""
