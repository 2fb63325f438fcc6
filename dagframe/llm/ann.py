"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``curves`` orderings projects the vectors on a few random directions within the leading
principal directions of a bounded sample, lays a grid over the sample's quantiles there, shifts it
by a random offset and sorts by the Hilbert key. The key ranges of an ordering's blocks are fitted
on the sample as well, as a range partitioner's are; every row is indexed. A query looks at its own
block and the two beside it in every ordering.

How wide the blocks are is tried on the sample: some of the queries look for their nearest sampled
vectors, and where the given windows hold less than ``RECALL`` of these, blocks are widened (and
orderings left out, if that is less work) until they do. Vectors of hundreds of components without
structure need nearly the whole table.

Vectors are stored once. What travels to the blocks are ids and codes: the nearest of ``CENTRES``
sampled vectors, what is left after it in levels of its own size, and how far that is off. A code
gives a row's distance within ``DEVIATIONS`` standard errors, likely rather than certain bounds; a
block keeps every row that these leave possible, however many there are, the windows of all orderings merge to distinct candidates, and those still possible are
reranked by the distance of the original vectors in double precision. So groups closer together
than the codes can tell cost more candidates, not results.

The window is a share of the table, because vectors without low-dimensional structure need one:
on nearly uniform directions in 64 dimensions, where the tenth neighbour is at three quarters of
the median distance, about half of the table has to be seen for a recall of 0.95. Structured
vectors do with far less; then give ``window``, a number of rows that doesn't grow; it is taken as
it is, untried. A block of many rows is split by a hash of the id, and many queries of a block by
one of theirs.

Copies of a vector form a class with one row in the orderings that names its ``k + 1`` least ids,
so that a vector which holds a third of all rows costs one row, and its ties still go to the
least ids.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have
a null id take no part; a vector's candidates are those of its own length; rows that repeat
an id and a vector are one; ties go to the smaller id; an empty table gives an empty table; only
the id and vector columns are read, so other columns cannot clash. Texts aren't read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagframe.llm.common import Scratch, attach, table

NEIGHBOURS = 10
CURVES = 48
#: A block holds this share of the rows, LEAST rows at least; a query's window is its block and those beside it.
SHARE, LEAST = 1 / 195, 48
#: Rows and queries of a task's unit, about.
MOST_ROWS, MOST_QUERIES = 65536, 8192
#: Units of fewer rows are handed to a task's Python together, up to about so many.
UNITE_ROWS = 16384
DIMS, GRID_BITS = 8, 6
#: Share of the variance that the leading directions hold.
VARIANCE = 0.95
#: Vectors that directions, grids, codes and blocks are fitted on, about.
SAMPLE = 10_000
#: Queries that are tried on the sample, about, and the share of their nearest that windows have to hold there.
TRIED, RECALL = 256, 0.95
#: Centres of the codes, components up to which a code has eight bits each, and numbers of the sample and of a decoded unit, at most.
CENTRES, FINE, MOST_NUMBERS = 256, 32, 1 << 22
#: Standard errors of a code's distance within which a row is still a candidate; RERANK * (k + 1) are taken in any case.
DEVIATIONS, RERANK = 2, 4
SEED = 20
EMPTY = "query_id long, rank int, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer cells (rows of ``dims`` numbers of so many bits) along the Hilbert curve."""
    x = cells.astype(np.uint64).copy()
    dims, one = x.shape[1], np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(dims):
            set_ = (x[:, i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> np.uint64(b)) & one != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


def _vectors(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _as_binary(element: str):
    """Vectors as bytes, which group, sort and travel better than arrays."""

    def run(batches):
        kind = "<f4" if element == "float" else "<f8"
        for batch in batches:
            column = batch.column("vec")
            flat = np.asarray(column.flatten()).astype(kind) + np.zeros(1, kind)  # -0.0 and 0.0 are equal
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            out = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    return run


def _few_ids(k: int):
    """Of each batch, the k least ids of every vector: what a class can need, before anything is shuffled."""

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by("id")
            seen: dict[bytes, int] = {}
            keep = []
            for v in rows.column("vec").to_pylist():
                seen[v] = seen.get(v, 0) + 1
                keep.append(seen[v] <= k)
            yield from rows.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches()

    return run


def rows_of(numbers: int, dim: int) -> int:
    """Vectors of dim components that hold about so many numbers: wide ones go in smaller parts, of 1,000 at least."""
    return max(1000, numbers // dim)


def _centres(x: np.ndarray, rng: np.random.Generator, many: int) -> np.ndarray:
    """Rows that codes are written against: half of them any, half far from those before, so that tight groups have one of their own."""
    picked = x[rng.permutation(len(x))[: many // 2]]
    norms = np.einsum("ij,ij->i", x, x)
    away = np.full(len(x), np.inf)
    for centre in picked:
        away = np.minimum(away, norms - 2 * (x @ centre) + centre @ centre)
    far = []
    for _ in range(many - len(picked)):
        weight = np.where(away > 1e-12 * norms, away, 0)
        if not weight.any():
            break
        far.append(x[rng.choice(len(x), p=weight / weight.sum())])
        away = np.minimum(away, norms - 2 * (x @ far[-1]) + far[-1] @ far[-1])
    return np.concatenate([picked, np.array(far).reshape(-1, x.shape[1])])


def _nearest_in_sample(sample: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest rows of the sample, other than the vector itself, of each asked vector."""
    norms = np.einsum("ij,ij->i", sample, sample)
    out = []
    for at in range(0, len(asked), 32):
        for one, far in zip(asked[at : at + 32], norms - 2 * (asked[at : at + 32] @ sample.T), strict=True):
            some = np.argpartition(far, 4 * k)[: 4 * k] if len(far) > 4 * k else np.arange(len(far))
            away = ((sample[some] - one) ** 2).sum(1)
            away[away == 0] = np.inf
            out.append(some[np.argsort(away, kind="stable")[:k]])
    return np.array(out)


class Index:
    """What is fitted on the sample: projections, grids and shifts of the orderings, the key ranges of their blocks, how often a block is split, and the codes' centres."""

    def __init__(self, sample: np.ndarray, n: int, curves: int, blocks: int, seed: int):
        rng = np.random.default_rng(seed)
        self.middle, self.unit = sample.mean(0), 1.0
        edge = np.quantile(sample, [0.002, 0.998], axis=0)
        self.unit = float(np.abs(np.clip(sample, *edge) - self.middle).max()) or 1.0
        x = self.scaled(sample)
        values, vectors = np.linalg.eigh(np.cov(np.clip(x, *self.scaled(edge)).T).reshape(x.shape[1], -1))
        order = np.argsort(values)[::-1]
        held = np.cumsum(values[order].clip(0)) / max(values.clip(0).sum(), 1e-300)
        leading = vectors[:, order[: max(min(DIMS, len(order)), int(np.searchsorted(held, VARIANCE)) + 1)]]
        dims = min(DIMS, leading.shape[1])
        self.bits = min(20, DIMS * GRID_BITS // dims)
        self.axes = [leading @ np.linalg.qr(rng.normal(size=(leading.shape[1], dims)))[0] for _ in range(curves)]
        self.shift = rng.uniform(0, 0.5, (curves, dims))
        self.knots = [[self._knots(column) for column in (x @ a).T] for a in self.axes]
        self.ordered = [np.sort(self.keys(sample, c)) for c in range(curves)]
        self.cut(n, curves, blocks)
        self.centres = _centres(x, rng, CENTRES)
        nibbles = x.shape[1] > FINE
        self.top = 7 if nibbles else 127
        self.code = np.dtype([("centre", "u1"), ("size", "<f4"), ("error", "<f4"), ("levels", "u1", (-(-x.shape[1] // 2) if nibbles else x.shape[1],))])

    def __getstate__(self) -> dict:
        return {**self.__dict__, "ordered": None}  # tasks don't cut

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.middle) / self.unit, -1e37, 1e37)

    @staticmethod
    def _knots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantiles of an axis, where the sample's rows lie even."""
        share = np.linspace(0, 1, 129)
        at, first = np.unique(np.quantile(values, share), return_index=True)
        return at, share[first]

    def bounds_of(self, curve: int, blocks: int) -> np.ndarray:
        keys = self.ordered[curve]
        return np.unique(keys[np.linspace(0, len(keys), blocks, endpoint=False).astype(int)[1:]])

    def cut(self, n: int, curves: int, blocks: int) -> None:
        """Use so many orderings, cut into so many blocks of about the same number of rows."""
        self.axes, self.bounds, self.splits, self.first, units = self.axes[:curves], [], [], [], 0
        most = min(MOST_ROWS, rows_of(MOST_NUMBERS, len(self.middle)))
        for c in range(curves):
            keys, bounds = self.ordered[c], self.bounds_of(c, blocks)
            held = np.bincount(np.searchsorted(bounds, keys, "right"), minlength=len(bounds) + 1) * (n / len(keys))
            self.bounds.append(bounds)
            self.splits.append(np.maximum(1, np.ceil(held / most)).astype(np.int64))
            self.first.append(units + np.cumsum(self.splits[-1]) - self.splits[-1])
            units += int(self.splits[-1].sum())

    def widened(self, sample: np.ndarray, asked: np.ndarray, blocks: int, k: int) -> tuple[int, int]:
        """Orderings and blocks whose windows hold RECALL of the k nearest that the asked vectors have in the sample.

        These are the given ones if that is enough; else the least work that is. Rows outside the
        sample make the nearest nearer, and windows are shares of the table, so the table's recall
        is no lower.
        """
        near = _nearest_in_sample(self.scaled(sample), self.scaled(asked), k)
        curves = len(self.axes)
        own = [self.keys(asked, c)[:, None] for c in range(curves)]
        theirs = [self.keys(sample[near.ravel()], c).reshape(near.shape) for c in range(curves)]
        fit = []
        for wide in 1.2 ** np.arange(40):
            many = max(1, int(blocks / wide))
            seen = np.zeros(near.shape, bool)
            for c in range(curves):
                bounds = self.bounds_of(c, many)
                seen |= np.abs(np.searchsorted(bounds, own[c], "right") - np.searchsorted(bounds, theirs[c], "right")) <= 1
                if c + 1 in (curves, curves // 2, curves // 4, curves // 6) and seen.mean() >= RECALL:
                    fit.append(((c + 1) / many, c + 1, many))
            if wide == 1 and seen.mean() >= RECALL:
                return curves, blocks
            if many <= 2:
                break
        return min(fit)[1:]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        along = self.scaled(vectors) @ self.axes[curve]
        place = np.stack([np.interp(x, *knots) for x, knots in zip(along.T, self.knots[curve], strict=True)], 1) * 0.5 + self.shift[curve]
        return hilbert_keys((place * (1 << self.bits)).clip(0, (1 << self.bits) - 1), self.bits)

    def blocks(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.keys(vectors, curve), "right")

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """What is left after the nearest centre, in levels of its own largest component: four bits a component, eight where there are few; and how far the code is from the vector."""
        x = self.scaled(vectors)
        out = np.zeros(len(x), self.code)
        out["centre"] = np.argmin(np.einsum("ij,ij->i", self.centres, self.centres) - 2 * (x @ self.centres.T), axis=1)
        rest = x - self.centres[out["centre"]]
        out["size"] = np.abs(rest).max(1)
        size = out["size"].astype(np.float64)[:, None]
        levels = np.divide(rest, size, out=np.zeros_like(rest), where=size > 0) * self.top
        levels = (np.round(levels).clip(-self.top, self.top) + self.top).astype(np.uint8)
        if self.top == 7:
            levels = np.pad(levels, ((0, 0), (0, levels.shape[1] % 2)))
            levels = levels[:, ::2] | levels[:, 1::2] << 4
        out["levels"] = levels
        out["error"] = np.sqrt(((x - self.decoded(out)) ** 2).sum(1))
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        levels = codes["levels"]
        if self.top == 7:
            levels = np.stack([levels & 15, levels >> 4], 2).reshape(len(codes), -1)[:, : len(self.middle)]
        out = levels.astype(np.float64)
        out -= self.top
        out *= (codes["size"].astype(np.float64) / self.top)[:, None]
        out += self.centres[codes["centre"]]
        return out


def _gathered(batches, most: int):
    """Consecutive batches joined to tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_unit(unit: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row for each unit, with its ids and what belongs to them side by side."""
    order = np.argsort(unit, kind="stable")
    unit, ids, rows = unit[order], ids[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    ends = np.append(cuts[1:], len(unit))
    packed = [[x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for x in (ids, rows)]
    return pa.RecordBatch.from_arrays([pa.array(unit[cuts]), *(pa.array(p, pa.binary()) for p in packed)], ["unit", "ids", "held"])


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("id").combine_chunks()).astype(np.int64)


def _indexed(index: Index, dim: int, kind: str, shares: int):
    def run(batches):
        for rows in _gathered(batches, min(16384, rows_of(MOST_NUMBERS // 4, dim))):
            vectors, ids = _vectors(rows.column("vec").combine_chunks(), dim, kind), _ids(rows)
            codes, salt = index.codes(vectors), ids % 1000003
            for c in range(len(index.axes)):
                block = index.blocks(vectors, c)
                unit = index.first[c][block] + salt % index.splits[c][block]
                for k in range(shares):
                    yield _by_unit(unit * shares + k, ids, codes)

    return run


def _asking(index: Index, dim: int, kind: str, shares: int):
    def run(batches):
        for rows in _gathered(batches, 1024):
            vectors, ids = _vectors(rows.column("vec").combine_chunks(), dim, kind), _ids(rows)
            raw = vectors.astype(kind)
            for c in range(len(index.axes)):
                block, last = index.blocks(vectors, c), len(index.splits[c]) - 1
                for beside in (-1, 0, 1):
                    at = np.flatnonzero((block + beside >= 0) & (block + beside <= last))
                    many = index.splits[c][block[at] + beside]
                    at, nth = np.repeat(at, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    if len(at):
                        unit = index.first[c][block[at] + beside] + nth
                        yield _by_unit(unit * shares + ids[at] % 1000003 % shares, ids[at], raw[at])

    return run


def _possible(who: np.ndarray, what: np.ndarray, low: np.ndarray, high: np.ndarray, most: int):
    """Of each query's rows, each once, those whose low is within the most-th least high."""
    order = np.lexsort((what, who))
    who, what, low, high = who[order], what[order], low[order], high[order]
    once = np.concatenate([[True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])])[: len(who)]
    who, what, low, high = who[once], what[once], low[once], high[once]
    order = np.lexsort((high, who))
    ends, first, many = np.unique(who[order], return_index=True, return_counts=True)
    limit = np.where(many >= most, high[order][first + np.minimum(most, many) - 1], np.inf) if len(ends) else np.zeros(0)
    keep = low <= limit[np.searchsorted(ends, who)]
    return who[keep], what[keep], low[keep], high[keep]


def _ranked(index: Index, dim: int, kind: str, most: int):
    """The rows of a unit that can be among the nearest of a query that looks at it, by their codes; a task's group holds a few small units.

    A code's error has no direction of its own, so that it moves a distance by about its length over
    the root of dim; low and high are DEVIATIONS such moves away.
    """

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        by_unit: dict[int, tuple[list, list]] = {}
        for side, rows in enumerate((held, asked)):
            for unit, *packed in zip(*(rows.column(c).to_pylist() for c in ("unit", "ids", "held")), strict=True):
                by_unit.setdefault(unit, ([], []))[side].append(packed)
        for mine, looks in by_unit.values():
            if not mine or not looks:
                continue
            ids = np.frombuffer(b"".join(x for x, _ in mine), np.int64)
            codes = np.frombuffer(b"".join(x for _, x in mine), index.code)
            vectors, error = index.decoded(codes), codes["error"].astype(np.float64)
            norms, moved = np.einsum("ij,ij->i", vectors, vectors), min(1, DEVIATIONS / dim**0.5) * error
            query = np.frombuffer(b"".join(x for x, _ in looks), np.int64)
            against = index.scaled(np.frombuffer(b"".join(x for _, x in looks), kind).reshape(-1, dim).astype(np.float64))
            some_rows = max(1, min(128, (1 << 20) // len(ids)))
            for at in range(0, len(query), some_rows):
                some = against[at : at + some_rows]
                sizes = norms + np.einsum("ij,ij->i", some, some)[:, None]
                square, rounding = sizes - 2 * (some @ vectors.T) - error**2, 4e-15 * sizes
                high = np.sqrt((square + rounding).clip(0) + moved**2) + moved
                low = np.sqrt((square - rounding).clip(0) + moved**2) - moved
                limit = np.partition(high, most - 1, axis=1)[:, most - 1 : most] if len(ids) > most else np.inf
                who, what = np.nonzero(low <= limit)
                found.append((query[at + who], ids[what], low[who, what], high[who, what]))
        return pa.table(list(_possible(*(np.concatenate(x) for x in zip(*found, strict=True)), most)), ["query_id", "id", "low", "high"])

    return run


def _distances(dim: int, kind: str):
    def run(batches):
        for batch in batches:
            away = _vectors(batch.column("vec"), dim, kind) - _vectors(batch.column("asked"), dim, kind)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(np.sqrt(np.einsum("ij,ij->i", away, away))), batch.column("ids")], ["query_id", "score", "ids"])

    return run


def clean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, vec as an array of its own element type."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where("id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(finite & F.exists("vec", lambda x: x != 0))


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, curves: int = CURVES, share: float = SHARE, window: int | None = None, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each row of queries among the rows with another id.

    A query's window in each ordering is three blocks of so large a share of the rows, or of a larger
    one where the sample asks for it; or ``window`` rows in all.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "nearest")
    element = rows.schema[vector].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    flat = clean_vectors(rows, key, vector).mapInArrow(_as_binary(element), "id long, vec binary")
    few = flat.mapInArrow(_few_ids(k + 1), "id long, vec binary")
    classes = few.groupBy("vec").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    classes = scratch.save(classes.select(F.col("ids")[0].alias("id"), "vec", "ids"), "classes")
    asked = clean_vectors(queries, key, vector).mapInArrow(_as_binary(element), "id long, vec binary")
    asked = scratch.save(asked.dropDuplicates(["id", "vec"]), "asked")
    sizes = classes.groupBy(F.octet_length("vec").alias("size")).count().collect()  # one for each length of vectors
    width = int(kind[-1])
    found = [_of_length(classes.where(F.octet_length("vec") == r["size"]), asked.where(F.octet_length("vec") == r["size"]), r["size"] // width, r["count"], kind, k, curves, share, window, seed, scratch) for r in sizes]
    if not found:
        return spark.createDataFrame([], EMPTY)
    pairs = reduce(DataFrame.unionByName, found).select("query_id", "score", F.explode("ids").alias("vec_id"))
    pairs = pairs.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_length(classes: DataFrame, asked: DataFrame, dim: int, n: int, kind: str, k: int, curves: int, share: float, window: int | None, seed: int, scratch: Scratch) -> DataFrame:
    """query_id, score and ids of the candidates that are reranked, among vectors of dim components."""
    fitted = min(SAMPLE, rows_of(MOST_NUMBERS, dim))
    some = classes.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, n // fitted))) == 0).select("vec").limit(2 * fitted).collect()
    some = some or classes.select("vec").limit(fitted).collect()
    sample = np.stack([np.frombuffer(r.vec, kind) for r in some]).astype(np.float64)
    rows = max(LEAST, k + 1, n * share if window is None else window / 3)
    sample = sample if len(sample) > 1 else np.repeat(sample, 2, 0)
    blocks, n_asked = max(1, int(n // rows)), asked.count()
    index = Index(sample, n, curves, blocks, seed)
    if window is None and n_asked:
        some = asked.where(F.pmod(F.xxhash64("vec"), F.lit(max(1, n_asked // TRIED))) == 0).select("vec").limit(2 * TRIED).collect()
        some = some or asked.select("vec").limit(TRIED).collect()
        curves, blocks = index.widened(sample, np.stack([np.frombuffer(r.vec, kind) for r in some]).astype(np.float64), blocks, k)
        index.cut(n, curves, blocks)
    shares = max(1, -(-3 * n_asked // (blocks * MOST_QUERIES)))
    unit = "unit long, ids binary, held binary"
    held = classes.select("id", "vec").mapInArrow(_indexed(index, dim, kind, shares), unit)
    looks = asked.mapInArrow(_asking(index, dim, kind, shares), unit)
    together = F.expr(f"unit div {max(1, int(UNITE_ROWS * blocks // n))}").alias("task")
    near = held.groupBy(together).cogroup(looks.groupBy(together)).applyInArrow(_ranked(index, dim, kind, k + 1), "query_id long, id long, low double, high double")
    near = near.groupBy("query_id", "id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    one = Window.partitionBy("query_id")
    near = near.withColumn("place", F.row_number().over(one.orderBy("high", "id")))
    limit = F.min(F.when(F.col("place") == k + 1, F.col("high"))).over(one)
    best = near.withColumn("limit", limit).where((F.col("place") <= RERANK * (k + 1)) | (F.col("low") <= F.col("limit"))).select("query_id", "id")
    best = scratch.save(best, f"best-{dim}")
    both = attach(classes, best, ["id"], 32 * best.count(), "inner")
    both = attach(both, asked.select(F.col("id").alias("query_id"), F.col("vec").alias("asked")), ["query_id"], n_asked * (64 + dim * int(kind[-1])), "inner")
    return both.select("query_id", "vec", "asked", "ids").mapInArrow(_distances(dim, kind), "query_id long, score double, ids array<long>")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100, among all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
