"""Language-model scores by deleted interpolation.

A word's probability after another mixes three estimates: how often the pair was among those
that begin with the first word, how often the word was among all, and one over the vocabulary.
The weights depend on how often the first word was seen (buckets by powers of two) and are
learned by expectation-maximisation on held-out counts: every training token in turn is deleted
from the counts and predicted from the others, so that all training documents serve both ends.

Counts never meet on the driver. Documents are dealt to parts of bounded size by hash. A part
sends each of its distinct words and pairs, as sorted 64-bit hashes packed by hash range, to the
range's task. That task adds up what a team of parts has sent and, where there are several
teams, sends the sums on in finer ranges as a team's own, so that counts meet in a tree whose
units stay of one size and whose rows grow with the tokens. The totals come back the same way,
to each part in the order in which it asked; a part that is grouped again thus has the corpus's
count beside every token. Rows that repeat an id and a text are counted first, go through this
once and count as often as they occur. What the driver gets are N, V and a histogram of bounded
size for the weights.

Defined results: a null text is empty and has one token, its end; a null id counts as training;
a text of any length is read whole, by the one task that has its row; repeated rows count and come back as often; an empty table gives an empty table; only the key
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.bytesets import STEP, U, as_strings, mix, slices, word_hashes, words
from dagframe.llm.common import Scratch, attach, table

END, START = U(0x5DEECE66D1A2B3C4), U(0x2545F4914F6CDD1D)
FOLDS, HELD_OUT = 7, 2
#: Bytes of text of a part: grows with the root of the corpus between these.
LEAST_PART, MOST_PART = 1 << 20, 8 << 20
#: A team has 2**FAN parts, and each step towards finer ranges splits a range so many times.
FAN = 7
#: Context-frequency buckets: 0 for none, then one for each power of two.
BUCKETS = 40
#: Steps in an octave of the grid on which held-out probabilities are tallied.
GRID = 4
ROUNDS = 60


def part_bytes(total: int) -> int:
    return int(min(MOST_PART, max(LEAST_PART, math.sqrt(total * 1e5))))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by END, and the number of tokens of each text."""
    out, sizes = [], []
    for first, end, data, offsets in slices(texts):
        starts, ends, row = words(data, offsets)
        count = np.bincount(row, minlength=end - first)
        tokens = np.empty(len(starts) + end - first, np.uint64)
        tokens[np.arange(len(starts)) + row] = word_hashes(data, starts, ends)
        tokens[np.cumsum(count + 1) - 1] = END
        out.append(tokens)
        sizes.append(count + 1)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(sizes)


def pairs_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return mix(before * STEP + tokens)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as steps of as few bytes each as the largest needs; the first byte says how many."""
    steps = np.diff(keys, prepend=U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(keys) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def counts_packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs: 1, 2, 4 or 8; the first byte says how many."""
    most = int(counts.max()) if len(counts) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def counts_unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def range_of(keys: np.ndarray, level: int, fan: int) -> np.ndarray:
    """Which hash range of a level a key is in; follows the order of keys."""
    return (keys >> U(64 - fan * (level + 1))).astype(np.int64)


BLOCKS = "node long, range long, words binary, n_words binary, pairs binary, n_pairs binary"
TOTALS = "node long, range long, words binary, pairs binary, v long, n long"


def _packed(node: int, level: int, fan: int, columns: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Sorted keys of a node and their counts, of words and of pairs, as a row for each range."""
    where = [range_of(keys, level, fan) for keys, _ in columns]
    used = np.union1d(*where)
    packed: list[list[bytes]] = [[], [], [], []]
    for k, (keys, counts) in enumerate(columns):
        low, high = np.searchsorted(where[k], used, "left"), np.searchsorted(where[k], used, "right")
        for a, b in zip(low, high, strict=True):
            packed[2 * k].append(squeezed(keys[a:b]))
            packed[2 * k + 1].append(counts_packed(counts[a:b]))
    return pa.table([pa.array(np.full(len(used), node, np.int64)), pa.array(used, pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["node", "range", "words", "n_words", "pairs", "n_pairs"])


def _asked(fan: int):
    """A part's distinct words and pairs with their training counts, packed by range."""

    def run(part: pa.Table) -> pa.Table:
        tokens, sizes = tokens_of(as_strings(part.column("text")))
        training = np.repeat(np.asarray(part.column("training").combine_chunks()).astype(np.int64) * np.asarray(part.column("times").combine_chunks()), sizes)
        columns = []
        for keys in (tokens, pairs_of(tokens, sizes)):
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            columns.append((keys[new], np.add.reduceat(training[order], new)))
        return _packed(part.column("part")[0].as_py(), 0, fan, columns)

    return run


def _summed(unit: pa.Table, keys_of: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(number of keys of each row, distinct keys, which of these each row's are, their sums); sums are exact below 2**53."""
    lists = [unsqueezed(x) for x in unit.column(keys_of).to_pylist()]
    counts = np.concatenate([counts_unpacked(x) for x in unit.column(f"n_{keys_of}").to_pylist()])
    distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
    return [len(x) for x in lists], distinct, place, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)


def _each(lengths: list[int], place: np.ndarray, totals: np.ndarray) -> pa.Array:
    """For each row the totals of its keys, in their order."""
    bounds, each = np.concatenate([[0], np.cumsum(lengths)]), totals[place]
    return pa.array([counts_packed(each[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def _merged(level: int, fan: int):
    """What a team's parts have sent for one range, added up, as the team's own in the finer ranges of the next level."""

    def run(unit: pa.Table) -> pa.Table:
        return _packed(unit.column("node")[0].as_py() >> fan, level + 1, fan, [_summed(unit, c)[1::2] for c in ("words", "pairs")])

    return run


def _answered(unit: pa.Table) -> pa.Table:
    """A range's totals for each of its rows; v and n of the range's words stand with the first."""
    unit, out = unit.combine_chunks(), []
    for keys_of in ("words", "pairs"):
        lengths, _, place, totals = _summed(unit, keys_of)
        if keys_of == "words":
            v, n = int((totals > 0).sum()), int(totals.sum())
        out.append(_each(lengths, place, totals))
    first = np.arange(unit.num_rows) == 0
    return pa.table([unit.column("node"), unit.column("range"), *out, pa.array(first * v, pa.int64()), pa.array(first * n, pa.int64())], ["node", "range", "words", "pairs", "v", "n"])


def _passed(unit: pa.Table, above: pa.Table) -> pa.Table:
    """The totals that a team got for the finer ranges of a range, for each of its parts."""
    unit, above = unit.combine_chunks(), above.sort_by("range")
    out = []
    for keys_of in ("words", "pairs"):
        lengths, _, place, _ = _summed(unit, keys_of)
        out.append(_each(lengths, place, np.concatenate([counts_unpacked(x) for x in above.column(keys_of).to_pylist()])))
    none = pa.array(np.zeros(unit.num_rows, np.int64))
    return pa.table([unit.column("node"), unit.column("range"), *out, none, none], ["node", "range", "words", "pairs", "v", "n"])


def _totals(blocks: DataFrame, nodes: int, scratch: Scratch, fan: int, level: int = 0) -> tuple[DataFrame, int, int]:
    """The totals of each node's keys by range, N and V."""
    if nodes <= 1 << fan:
        totals = scratch.save(blocks.groupBy("range").applyInArrow(_answered, TOTALS), f"totals-{level}")
        sums = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        return totals, sums.n, sums.v
    blocks = scratch.save(blocks, f"blocks-{level}")
    team = F.shiftright("node", fan).alias("team")
    merged = blocks.groupBy(team, "range").applyInArrow(_merged(level, fan), BLOCKS)
    above, n, v = _totals(merged, -(-nodes >> fan), scratch, fan, level + 1)
    from_above = above.groupBy(F.col("node").alias("team"), F.shiftright("range", fan).alias("range"))
    totals = scratch.save(blocks.groupBy(team, "range").cogroup(from_above).applyInArrow(_passed, TOTALS), f"totals-{level}")
    scratch.drop(f"blocks-{level}")
    scratch.drop(f"totals-{level + 1}")
    return totals, n, v


def _counted(kind: pa.DataType):
    """Each document of a part with the training counts of its tokens and pairs."""

    def run(part: pa.Table, totals: pa.Table) -> pa.Table:
        tokens, sizes = tokens_of(as_strings(part.column("text")))
        totals = totals.sort_by("range")
        bounds, held = np.concatenate([[0], np.cumsum(sizes)]), []
        for keys, column in ((tokens, "words"), (pairs_of(tokens, sizes), "pairs")):
            each = np.concatenate([counts_unpacked(x) for x in totals.column(column).to_pylist()])
            each = each[np.unique(keys, return_inverse=True)[1]]
            held.append(pa.array([counts_packed(each[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
        return pa.table([part.column("id"), part.column("training"), part.column("times"), *held], pa.schema([("id", kind), ("training", pa.bool_()), ("times", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())]))

    return run


def _batch_counts(batch: pa.RecordBatch, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word counts, pair counts, counts of the word before, tokens of each row); a text's first word follows as many starts as there are ends."""
    word_lists = [counts_unpacked(x) for x in batch.column("words").to_pylist()]
    sizes = np.array([len(x) for x in word_lists], np.int64)
    word = np.concatenate(word_lists)
    pair = np.concatenate([counts_unpacked(x) for x in batch.column("pairs").to_pylist()])
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = start
    return word, pair, before, sizes


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).clip(0, BUCKETS - 1).astype(np.int64)


def _tallied(n: int, start: int):
    """Histogram of (bucket, pair estimate, word estimate) of training tokens, each deleted from the counts first; 1 stands for an estimate of 0."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                word, pair, before, sizes = _batch_counts(batch, start)
                times = np.repeat(np.asarray(batch.column("times")), sizes)
                p2 = np.where(before > 1, (pair - 1) / np.maximum(before - 1, 1), 0.0)
                p1 = (word - 1) / max(n - 1, 1)
                grid = lambda p: np.where(p > 0, np.round(GRID * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)
                code = (bucket_of(before - 1) * 2048 + grid(p2) + 1024) * 2048 + grid(p1) + 1024
                codes, place = np.unique(code, return_inverse=True)
                counts = np.bincount(place, weights=times, minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return run


def learn_weights(tally: list[tuple[int, int]], v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rows of (pair, word, uniform) weights by bucket, by expectation-maximisation."""
    code = np.array([c for c, _ in tally], np.int64)
    count = np.array([k for _, k in tally], float)
    back = lambda g: np.where(g == 1, 0.0, 2.0 ** (g / GRID))
    p = np.stack([back((code // 2048) % 2048 - 1024), back(code % 2048 - 1024), np.full(len(code), 1 / (v + 1))], 1)
    bucket = code // 2048 // 2048
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (count / share.sum(1))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        weights = np.where(sums.sum(1, keepdims=True) > 0, sums / np.maximum(sums.sum(1, keepdims=True), 1e-300), weights)
    # every estimate can be 0 but the last: it keeps a little, and where no pair is known the others share
    weights = np.maximum(weights, 1e-6)
    weights[0, 0] = 0
    return weights / weights.sum(1, keepdims=True)


def _scored(n: int, v: int, start: int, weights: np.ndarray):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                word, pair, before, sizes = _batch_counts(batch, start)
                w = weights[bucket_of(before)]
                p = w[:, 0] * np.where(before > 0, pair / np.maximum(before, 1), 0) + w[:, 1] * (word / max(n, 1)) + w[:, 2] / (v + 1)
                first = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10((word + 1) / (n + 1 * (v + 1))), first)
                score = np.add.reduceat(np.log10(p), first)
                known = np.add.reduceat((word > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(~np.asarray(batch.column("training").to_numpy(zero_copy_only=False)).astype(bool)), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(score), batch.column("times")], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "times"])

    return run


def _once(own: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each id and text, with the times that it occurs."""
    marks = ["_a", "_b"]
    marked = own.withColumns({"_a": F.xxhash64("id", "text"), "_b": F.xxhash64("text", "id")})
    again = scratch.save(marked.groupBy(*marks).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "again")
    n = again.count()
    if not n:
        return own.withColumn("times", F.lit(1).cast("long"))
    marked = attach(marked, again, marks, 64 * n)
    names = [*own.columns, "times"]
    repeated = marked.where("times is not null").groupBy(*marks).agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return marked.where("times is null").select(*own.columns, F.lit(1).cast("long").alias("times")).unionByName(repeated)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", fan: int = FAN, part: int | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row; part is a part's bytes of text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    kind = docs.schema[key].dataType
    out = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(fold != HELD_OUT, F.lit(True)).alias("training"))
    size = own.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("bytes"), F.count_if("training").alias("training")).first()
    if size.bytes is None:
        return spark.createDataFrame([], out).withColumnRenamed("id", key)
    parts = -(-size.bytes // (part or part_bytes(size.bytes)))
    parted = _once(own, scratch).withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    asked = parted.groupBy("part").applyInArrow(_asked(fan), BLOCKS)
    totals, n, v = _totals(asked, parts, scratch, fan)
    from pyspark.sql.pandas.types import to_arrow_type

    counted = parted.groupBy("part").cogroup(totals.groupBy("node")).applyInArrow(_counted(to_arrow_type(kind)), f"id {kind.simpleString()}, training boolean, times long, words binary, pairs binary")
    counted = scratch.save(counted, "counted")
    scratch.only("counted")
    start = size.training
    tally = counted.where("training").select("words", "pairs", "times").mapInArrow(_tallied(n, start), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    weights = learn_weights([(r.code, r.n) for r in tally.collect()], v)  # as many rows as the grid has cells, at most
    scored = counted.mapInArrow(_scored(n, v, start, weights), f"{out}, times long")
    return scored.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times").withColumnRenamed("id", key)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose fold is not held out."""
    return lm_scores(table(spark, sf_dir, "documents"))
