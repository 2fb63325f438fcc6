"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. The
suffixes to be sorted are those at anchors: of every window of ``length`` bytes the q-gram with
the least hash is its anchor, so two equal windows have the same anchor at the same offset, and
only about 2 in ``length - q`` suffixes are kept. Buckets are then refined as the bucket-pointer
scheme does, on the identifiers of buckets at later offsets, each round reusing the last one's:

1.  Identifiers double: a 2k-gram's is made from those of the k-grams at offsets 0 and k. The
    64-grams at anchors are the first buckets; a bucket with a single suffix is finished.
2.  In buckets with more, the identifiers at later offsets (the 128-grams that cover all the
    windows of the anchor) split each bucket. Suffixes that still share one are repeated over
    all their windows and finished.
3.  The rest, at the ends of repeats and around edits, is split, together with one suffix of
    each finished bucket beside it, by blocks of 8 neighbouring
    windows on the identifiers of the 128-grams under what these have in common, and where
    that is shared, window by window on that identifier and the 7 bytes that are left.

Spark counts each round's buckets and joins the counts back, so a bucket of any size is spread
over tasks. Identifiers are 64-bit hashes and a decision always rests on two of them, or on one
and 7 literal bytes.

Defined results: a null text is empty; a text of any length is judged whole, in stretches; rows are told apart by a hash of id and text, so null ids
and rows that share an id are documents of their own, and rows that repeat both count as
occurrences of their own; an empty table gives an empty table; only the key and text columns are read, and other columns that ``carry`` names come along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.bytesets import BYTE, STEP, U, as_strings, mix
from dagframe.llm.common import Scratch, attach, table

LENGTH = 200
GRAM = 64
#: Windows of a block; 7 bytes on each side of what they share decide between them.
BLOCK = 8
#: Window starts worked on at once, so that memory does not follow the longest text.
STARTS = 1 << 20


def _identifiers(data: np.ndarray) -> dict[int, np.ndarray]:
    """Bucket identifiers of all GRAM- and 128-grams, by doubling."""
    held, ids, size = {}, BYTE[data], 1
    while size < 128 and len(ids) > size:
        ids = mix(ids[:-size] * STEP + ids[size:])
        size *= 2
        held[size] = ids
    return held


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value of every window of so many values."""
    at, span = np.arange(len(values)), 1
    pick = lambda a, b: np.where(values[b] < values[a], b, a)
    while span * 2 <= width:
        at = pick(at[:-span], at[span:])
        span *= 2
    n = len(values) - width + 1
    return pick(at[:n], at[width - span : width - span + n])


def _runs(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """(origin, first start, last start, anchor, identifiers) for the windows of a text, by anchor; all relative to origin."""
    for origin in range(0, max(len(data) - length + 1, 0), STARTS):
        part = data[origin : origin + STARTS + length - 1]
        held = _identifiers(part)
        anchor = _least(held[GRAM], length - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        yield origin, first, last, anchor[first], held


def _whole(held: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """Identifier of all the text under a run's windows and of the anchor's place in it; 128-grams at three offsets cover it."""
    size = last - first + length
    ids = mix(held[first] * STEP + held[first + (size - 128) // 2])
    return mix((ids * STEP + held[first + size - 128]) ^ ((anchor - first) * 1024 + size).astype(np.uint64))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    strings = as_strings(batch.column(column))
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    for i in range(len(strings)):
        yield i, data[offsets[i] : offsets[i + 1]]


ROWS = 1 << 18


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of about ROWS rows from many small column tuples."""
    kept: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        kept.append(part)
        n += len(part[0])
        if n >= ROWS:
            yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*kept, strict=True)], names)
            kept, n = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([_long(np.concatenate(c)) for c in zip(*kept, strict=True)], names)


def _anchors(length: int):
    def run(batches):
        def parts():
            for batch in batches:
                docs = np.asarray(batch.column("doc"))
                for i, data in _texts(batch, "text"):
                    for origin, first, last, anchor, held in _runs(data, length):
                        place = (first + origin) * 65536 + (last - first) * 256 + (anchor - first)
                        yield held[GRAM][anchor], _whole(held[128], first, last, anchor, length), np.full(len(first), docs[i], np.int64), place

        return _gathered(parts(), ["gram", "whole", "doc", "place"])

    return run


def _blocks(length: int):
    """Blocks of the runs in question: the identifier of what a block's windows share, and the 7 bytes on each side of it."""
    shared, side = length - BLOCK + 1, BLOCK - 1

    def run(batches):
        def parts():
            for batch in batches:
                docs, places = np.asarray(batch.column("doc")), batch.column("places")
                for i, data in _texts(batch, "text"):
                    place = np.sort(np.asarray(places[i].values))
                    place = place[(place >> 16) + ((place >> 8) & 255) + length <= len(data)]  # else of another text whose hash is the same
                    first, more, off = place >> 16, (place >> 8) & 255, place & 255
                    while len(place):  # a stretch of the text at a time
                        origin = int(first[0])
                        now = first < origin + STARTS
                        yield from stretch(docs[i], data, origin, first[now] - origin, more[now], off[now])
                        place, first, more, off = place[~now], first[~now], more[~now], off[~now]

        def stretch(doc, data, origin, first, more, off):
            lead = min(origin, side)  # bytes before the stretch that its blocks may name
            part = data[origin - lead : origin + STARTS + 2 * length]
            held = _identifiers(part)
            first = first + lead
            anchor = first + off
            low, high = (off - more) // BLOCK, off // BLOCK  # blocks of the offsets off - more ... off
            count = high - low + 1
            run_of = np.repeat(np.arange(len(first)), count)
            block = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            core = anchor[run_of] - BLOCK * block
            core_id = mix(held[128][core] * STEP + held[128][core + shared - 128])
            core_id = mix(core_id * STEP + held[GRAM][anchor[run_of]] + block.astype(np.uint64))
            start = core - side
            j = np.arange(BLOCK)
            inside = (start[:, None] + j >= first[run_of][:, None]) & (start[:, None] + j <= (first + more)[run_of][:, None])
            mask = (inside * (1 << j)).sum(1)
            padded = np.concatenate([np.zeros(side, np.uint8), part, np.zeros(side, np.uint8)]).astype(np.int64)
            weight = 256 ** np.arange(side - 1, -1, -1, dtype=np.int64)
            left = (padded[(core[:, None] - side + np.arange(side)) + side] * weight).sum(1)
            right = (padded[core[:, None] + shared + np.arange(side) + side] * weight).sum(1)
            yield core_id, np.full(len(core), doc, np.int64), start - lead + origin, mask, left, right

        return _gathered(parts(), ["core", "doc", "start", "mask", "before", "behind"])

    return run


def _merged(length: int):
    """Per document, flat start and end pairs of the bytes under its windows."""

    def run(batches):
        for batch in batches:
            lists = batch.column("places")
            out = []
            for i in range(batch.num_rows):
                place = np.asarray(lists[i].values)
                start, end = place >> 16, (place >> 16) + (place & 65535) + length
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], start[1:] > end[:-1]])
                out.append(np.column_stack([start[new], np.append(end[:-1][new[1:]], end[-1])]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.list_(pa.int64()))], ["doc", "spans"])

    return run


def _size(df: DataFrame, column: str) -> int:
    """Counted bytes of rows of a long and an array of longs, as Spark holds them."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("k")).first()
    return 64 * row.n + 8 * row.k


def repeated_spans(docs: DataFrame, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """docs has doc (a long that tells documents apart) and text; (doc, spans): flat start and end pairs of repeated bytes, for documents that have some."""
    if not 136 <= length <= 216:
        raise ValueError("length is 136 to 216 bytes")
    scratch = scratch or Scratch(docs.sparkSession, "repeats")

    def shared(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        """The keys of buckets with several members; counted beforehand, so that the join back can split a large bucket."""
        return scratch.save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), name)

    long_enough = docs.where(F.octet_length("text") >= length)
    suffixes = scratch.save(long_enough.mapInArrow(_anchors(length), "gram long, whole long, doc long, place long"), "suffixes")
    several = scratch.save(suffixes.join(shared(suffixes, ["gram"], "grams"), "gram", "left_semi"), "several")
    scratch.drop("suffixes")
    classes = several.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("one"))
    classes = scratch.save(classes.where("n > 1").select("gram", "whole", "one.doc", "one.place"), "classes")
    judged = several.join(classes.select("gram", "whole", F.lit(True).alias("done")), ["gram", "whole"], "left")
    judged = scratch.save(judged.select("gram", "doc", "place", F.coalesce("done", F.lit(False)).alias("done")), "judged")
    scratch.drop("several")

    # windows of the open suffixes may also start in finished ones, of which one each is enough
    left_over = judged.where("not done").select("gram", "doc", "place")
    finished = classes.join(scratch.save(left_over.select("gram").distinct(), "open_grams"), "gram", "left_semi")
    rest = left_over.select("doc", "place").unionByName(finished.select("doc", "place"))
    rest = scratch.save(rest.groupBy("doc").agg(F.collect_set("place").alias("places")), "rest")
    with_text = attach(long_enough, rest, ["doc"], _size(rest, "places"), "inner")
    blocks = scratch.save(with_text.mapInArrow(_blocks(length), "core long, doc long, start long, mask long, before long, behind long"), "blocks")
    blocks = scratch.save(blocks.join(shared(blocks, ["core"], "cores"), "core", "left_semi"), "open")
    side = BLOCK - 1
    windows = blocks.select("core", "doc", "start", "mask", "before", "behind", F.explode(F.sequence(F.lit(0), F.lit(side))).alias("j")).where(F.expr("(mask & shiftleft(1L, j)) != 0"))
    windows = windows.select("core", "j", F.expr(f"shiftleft(before & (shiftleft(1L, 8 * ({side} - j)) - 1), 8 * j) | shiftright(behind, 8 * ({side} - j))").alias("rest"), "doc", (F.col("start") + F.col("j")).alias("at"))
    windows = scratch.save(windows, "windows")
    twice = windows.join(shared(windows, ["core", "j", "rest"], "twice"), ["core", "j", "rest"], "left_semi")

    runs = judged.where("done").select("doc", F.expr("shiftleft(shiftright(place, 16), 16) | (shiftright(place, 8) & 255)").alias("place"))
    runs = runs.unionByName(twice.select("doc", F.expr("shiftleft(at, 16)").alias("place")))
    merged = runs.groupBy("doc").agg(F.collect_set("place").alias("places")).mapInArrow(_merged(length), "doc long, spans array<long>")
    spans = scratch.save(merged, "spans")
    scratch.only("spans")
    return spans


def _kept(fields: list[str], as_text: bool):
    def run(batches):
        for batch in batches:
            lists, out = batch.column("_rep_spans"), []
            for i, data in _texts(batch, "_rep_text"):
                spans = lists[i].values
                pairs = np.asarray(spans).reshape(-1, 2).clip(0, len(data)) if spans is not None else np.zeros((0, 2), np.int64)
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                edges = np.concatenate([[0], pairs.ravel(), [len(data)]]).reshape(-1, 2)
                kept = b"".join(data[a:b].tobytes() for a, b in edges)
                digest = hashlib.sha256(kept).hexdigest()
                out.append((len(data), len(data) - len(kept), len(pairs), kept.decode("utf-8", "ignore") if as_text else kept, digest))
            made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in fields] + [made[k] for k in range(5)], [*fields, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The columns of carry (by default key), n_bytes, n_removed, n_spans, kept and kept_sha256, one row per input row.

    kept is binary, the remaining bytes, or as text what they decode to; a cut that splits a
    character takes its rest along.
    """
    carry = carry or [key]
    own = docs.select(*carry, F.col(text).alias("_rep_text"), F.xxhash64(key, text).alias("_rep_doc"))
    spans = repeated_spans(own.select(F.col("_rep_doc").alias("doc"), F.col("_rep_text").alias("text")), length)
    spans = spans.select(F.col("doc").alias("_rep_doc"), F.col("spans").alias("_rep_spans"))
    joined = attach(own, spans, ["_rep_doc"], _size(spans, "_rep_spans")).select(*carry, "_rep_text", "_rep_spans")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(_kept(carry, as_text), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every window's start is listed, so this is for small tables; it takes doc_id to be unique.
OP2_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS MATERIALIZED (SELECT rid, doc_id, h, len(h) // 2 AS n_bytes FROM d),
w AS MATERIALIZED (SELECT rid, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, n_bytes - 199)) AS p FROM n WHERE n_bytes >= 200)),
c AS MATERIALIZED (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS MATERIALIZED (SELECT rid, p FROM w SEMI JOIN c USING (k)),
i AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS span FROM i),
s AS (SELECT rid, span, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY rid, span),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
t AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last FROM s GROUP BY rid),
e AS (SELECT k.rid, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN n USING (rid) GROUP BY k.rid)
SELECT n.doc_id, n.n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.rid IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN t USING (rid) LEFT JOIN e USING (rid)
"""
