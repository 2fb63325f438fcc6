"""Quality rules on documents and their hosts, with DataFrame functions alone.

A document fails by its own text when it has too few words or too many words in repeated
windows. Failures are then counted by host (a column such as ``source``), each host's rate
is shrunk towards the corpus by a beta prior that is fitted to all hosts by its moments, and
a host whose shrunk rate is above a limit is rejected with all its documents.

A host's rate has to be above four fifths: fewer than one in five of its documents would be
clean, so that rejecting it costs few of these. The shrinking decides for small hosts, whose few
failures say little: with the prior of a corpus where a tenth of the documents fail, a host goes
when some tens of documents agree, not when its only three do.

Defined results: a null or blank text has no words and fails; a text of any length is counted
whole; null keys are rows as any; a null host is a host of its own; repeated rows count as often
as they occur and come back as often; only the key, text and
host columns are read, so other columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.common import BLANKS, BROADCAST_BYTES, Scratch, free_name, table

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is rejected when its shrunk failure rate is above this.
HOST_RATE = 0.8


def with_text_counts(df: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a string column."""
    blank = f"[{BLANKS}]+"
    body = F.coalesce(F.col(text), F.lit(""))
    stripped = body
    for c in SYMBOLS:
        stripped = F.replace(stripped, F.lit(c), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.withColumns({
        "_words": F.filter(F.split(body, blank), lambda w: w != ""),
        "_lines": lines,
        "n_symbols": F.octet_length(body).cast("long") - F.octet_length(stripped),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    windows = F.when(F.col("n_words") >= window, F.transform(F.sequence(F.lit(1), (F.col("n_words") - window + 1).cast("int")), lambda i: F.xxhash64(F.slice("_hashes", i, window)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", windows)
    return df.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_covered(F.col("_windows"), window)).cast("long")).drop("_words", "_lines", "_hashes", "_windows")


def _covered(windows: Column, window: int) -> Column:
    """Words that lie in windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    bound = F.array(ordered)  # a lambda over it names the sorted array once

    def repeated(s: Column) -> Column:
        same = lambda k, j: s[k]["x"] == F.try_element_at(s, j)["x"]
        return F.array_sort(F.filter(F.transform(s, lambda v, k: F.when(F.coalesce(same(k, k + 2), F.lit(False)) | F.when(k > 0, same(k, k)).otherwise(False), v["i"])), lambda i: i.isNotNull()))

    places = F.transform(bound, repeated)
    total = F.transform(places, lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.try_element_at(p, k + 2) - at, F.lit(window)))), F.lit(0), lambda a, b: a + b))
    return total[0]


def host_rates(docs: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host: n_docs, n_failed and rate, the failure rate shrunk by an empirical beta prior.

    The prior's mean is the corpus's failure rate and its strength is fitted by moments over all
    hosts: with m hosts, sizes n and rates p, the spread of p beyond binomial noise gives
    ``strength = mean * (1 - mean) / spread - 1``, held between 1 and 10,000 pseudo-documents.
    """
    hosts = docs.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    square = F.col("n_failed") * F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("m"), F.sum(square).alias("ss")).first()
    mean, strength = 0.0, 10000.0
    if total.n:
        mean = total.f / total.n
        noise = mean * (1 - mean)
        # size-weighted variance of the hosts' rates; its binomial part is noise * m / n
        spread = total.ss / total.n - mean * mean - noise * total.m / total.n
        strength = min(10000.0, max(1.0, noise / spread - 1)) if spread > 0 else 10000.0
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, host_rate: float = HOST_RATE) -> DataFrame:
    """One row per input row: key, the counts, base_failed, host_rate and kept."""
    return _judged(docs, key, text, host, min_words, repeat_percent, host_rate).drop("_uid")


def _judged(docs: DataFrame, key: str, text: str, host: str, min_words: int, repeat_percent: int, host_rate: float) -> DataFrame:
    """The same with _uid, a hash of key and text."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("_host"), F.xxhash64(key, text).alias("_uid"))
    counted = with_text_counts(own, "_text").drop("_text")
    counted = counted.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    counted = scratch.save(counted, "counted")
    hosts = scratch.save(host_rates(counted, "_host", "base_failed").select("_host", F.col("rate").alias("host_rate")), "hosts")
    small = 128 * hosts.count() <= BROADCAST_BYTES  # else dealt out by host, where adaptive execution splits a large one
    return counted.join(F.broadcast(hosts) if small else hosts, "_host", "left").withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_rate)).drop("_host")


def drop_rejected(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The input's rows that the rules keep, with all columns."""
    name = free_name(docs, "_quality_uid")
    judged = _judged(docs, key, text, host, MIN_WORDS, REPEAT_PERCENT, HOST_RATE)
    gone = Scratch(docs.sparkSession, "quality-gone").save(judged.where("not kept").select(F.col("_uid").alias(name)).distinct(), "gone")
    small = 40 * gone.count() <= BROADCAST_BYTES
    return docs.withColumn(name, F.xxhash64(key, text)).join(F.broadcast(gone) if small else gone, name, "left_anti").drop(name)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all documents; hosts are the values of ``source``."""
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
c AS (
  SELECT doc_id, source, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
  FROM d),
w AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS p, words FROM c WHERE n_words >= 8),
h AS (SELECT doc_id, p, array_to_string(words[p:p + 7], ' ') AS s FROM w),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS k FROM h),
g AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r WHERE k > 1),
n AS (SELECT doc_id, CAST(sum(least(8, coalesce(q - p, 8))) AS BIGINT) AS n_repeat_words FROM g GROUP BY doc_id),
b AS (
  SELECT c.doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM c LEFT JOIN n USING (doc_id)),
hosts AS (SELECT source, count(*) AS nd, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS nf FROM b GROUP BY source),
t AS (SELECT sum(nd) AS n, sum(nf) AS f, count(*) AS m, sum(nf * nf / nd) AS ss FROM hosts),
v AS (SELECT f / n AS mean, f / n * (1 - f / n) AS noise, ss / n - (f / n) * (f / n) - f / n * (1 - f / n) * m / n AS spread FROM t),
pr AS (SELECT mean, CASE WHEN spread > 0 THEN least(10000.0, greatest(1.0, noise / spread - 1)) ELSE 10000.0 END AS strength FROM v),
hr AS (SELECT source, (nf + mean * strength) / (nd + strength) AS rate FROM hosts, pr)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.8 AS kept
FROM b JOIN hr ON b.source IS NOT DISTINCT FROM hr.source
"""
