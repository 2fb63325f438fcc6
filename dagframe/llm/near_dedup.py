"""Near-duplicate groups by b-bit MinHash.

1.  Each text's set of word shingles is hashed; texts with equal sets form a class, and one
    text stands for its class from here on, so that copies cost one row each.
2.  A class gets ``rows * bands`` MinHash minima. Bands of the full minima name its buckets; of
    each minimum only the low ``BITS`` bits are kept, packed into a signature.
3.  Each class is compared with its buckets' least classes by signatures alone: with a share m of
    equal b-bit values, the collision-corrected similarity is ``(m - 2**-b) / (1 - 2**-b)``, and
    pairs more than SLACK standard errors below the threshold are left out. The likeliest
    partner of each class is confirmed on the full shingle sets: a text goes to one task, a
    partner's to as many as its followers fill. Links found join classes to components.
4.  Buckets whose classes are not all in one component by then have their classes of different
    components compared by signatures, in blocks of them; a class that is like others names one
    of its group there and its likeliest partner. Groups that come of it go to tasks with their
    texts, large ones as pairs of blocks of bounded size, where what is not connected yet is
    confirmed. Where blocks would repeat the texts of large groups, the likeliest partners are
    confirmed first, as in step 3, and only what is still apart goes on.

``rows`` and ``bands`` follow from the threshold: the chance that a pair just at the threshold
meets in no bucket is below MISS. No bucket, group or number of partners is capped.

Defined results: a null text or one without words has the empty set and links with nothing; a
text of any length gives its whole set, which one task holds; a
null id takes part, and counts as its component's least id only if there is no other; rows
that repeat an id are rows of their own (each is kept if its id is the component's least); an
empty table gives an empty table; only the key and text columns are read, so other columns
cannot clash, and ``drop_near_duplicates`` passes them all through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.bytesets import STEP, U, as_strings, mix, shingle_sets
from dagframe.llm.common import BROADCAST_BYTES, Scratch, attach, free_name, table
from dagframe.llm.components import components

SHINGLE = 5
#: Percent of the union that two sets share at least.
PERCENT = 80
#: Chance that a pair at the threshold meets in no bucket, and the most minima spent on it.
MISS, MOST_MINIMA = 1e-6, 288
BITS = 2
#: Standard errors below the threshold at which a signature rules a pair out.
SLACK = 6
#: Rows and text bytes of a task's unit, and signatures of one.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_SIGNS = 2048, 6 << 20, 4096
#: Groups go to blocks at once while these hold their texts at most so many times.
REPEATED = 2


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): the most selective bands whose miss chance is below MISS with at most MOST_MINIMA minima."""
    best = (1, MOST_MINIMA)
    for rows in range(1, 33):
        hit = (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-hit)) if hit < 1 else 1
        if rows * bands <= MOST_MINIMA:
            best = (rows, bands)
    return best


def _factors(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64) * STEP) >> U(32)).astype(np.uint32) | np.uint32(1)


def _minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions factor * x (32 bits) over the set."""
    short = (hashes >> U(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        out = np.minimum(out, (factors[:, None] * short[None, at : at + 512]).min(1))
    return out


def pack(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of minima to rows of whole 64-bit words that hold their low bits."""
    low = ((minima[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(minima), -1)
    packed = np.packbits(low, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def similarity(one: np.ndarray, others: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """Collision-corrected estimates from packed signatures of n minima."""
    field = U(sum(1 << k for k in range(0, 64, bits)))
    differ = one ^ others
    for k in range(1, bits):
        differ = differ | ((one ^ others) >> U(k))
    share = 1 - np.bitwise_count(differ & field).sum(-1) / n
    return (share - 2.0**-bits) / (1 - 2.0**-bits)


def _signed(shingle: int, rows: int, bands: int):
    factors = _factors(rows * bands)

    def run(batches):
        for batch in batches:
            size, cls, texts = [], [], as_strings(batch.column("text"))
            minima = np.zeros((batch.num_rows, rows * bands), np.uint32)
            for i, hashes in enumerate(shingle_sets(texts, shingle)):
                size.append(len(hashes))
                cls.append(class_id(hashes))
                if len(hashes):
                    minima[i] = _minima(hashes, factors)
            grid = minima.reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * STEP), grid.shape[:2]).copy()
            for r in range(rows):
                key = mix(key * STEP + grid[:, :, r])
            signs = pack(minima) if batch.num_rows else np.zeros((0, 1), np.uint64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * bands + 1, bands, dtype=np.int32)), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("uid"), pc.binary_length(texts).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), keys, pa.array([s.tobytes() for s in signs], pa.binary())], ["id", "uid", "n_bytes", "n_shingles", "cls", "bands", "sign"])

    return run


def class_id(hashes: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty set."""
    if not len(hashes):
        return None
    with np.errstate(over="ignore"):
        a, b = mix(hashes).sum(dtype=np.uint64), mix(hashes * STEP + U(len(hashes))).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def least_estimate(percent: int, minima: int) -> float:
    """The estimate below which a pair is ruled out."""
    t = percent / 100
    return t - SLACK * math.sqrt(t * (1 - t) / minima + 2.0**-BITS / minima)


class _Groups:
    """Labels of rows, least index first."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        labels = np.unique(self.of[members])
        if len(labels) > 1:
            self.of[np.isin(self.of, labels)] = labels[0]


def linked(sets: list[np.ndarray], signs: np.ndarray, side: np.ndarray, minima: int, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Component label of each set of one group; with two sides, only pairs across them are looked at. Sets that have the same number in known are connected."""
    m, groups, across = len(sets), _Groups(len(sets)), len(np.unique(side)) > 1
    if known is not None:
        _, first, place = np.unique(known, return_index=True, return_inverse=True)
        groups.of = first[place]
    cut = least_estimate(percent, minima)
    sizes = np.array([len(s) for s in sets])
    shared = None
    for x in range(m - 1):
        open_ = np.flatnonzero(groups.of[x + 1 :] != groups.of[x]) + x + 1
        if across:
            open_ = open_[side[open_] != side[x]]
        if len(open_):
            open_ = open_[similarity(signs[x], signs[open_], minima) >= cut]
        if not len(open_):
            continue
        if m <= 8 or len(open_) <= 4:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in open_])
        else:
            shared = shared or _Postings(sets)
            both = shared.counts(x)[open_]
        hit = open_[100 * both >= percent * (sizes[x] + sizes[open_] - both)]
        if len(hit):
            groups.join(np.append(hit, x))
    return groups.of


class _Postings:
    """Shared-element counts of one set with all others, through lists of the sets that hold an element."""

    def __init__(self, sets: list[np.ndarray]):
        _, self.element = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.owners = owner[np.argsort(self.element, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.element))])
        self.n = len(sets)

    def counts(self, x: int) -> np.ndarray:
        mine = self.element[self.start[x] : self.start[x + 1]]
        low, many = self.bounds[mine], self.bounds[mine + 1] - self.bounds[mine]
        at = np.arange(many.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        return np.bincount(self.owners[at], minlength=self.n)


def _confirmed(shingle: int, minima: int, percent: int):
    """One task's groups: each class of a group with the least class it is joined to there."""

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        group, cls = unit.column("part").to_pylist(), unit.column("cls").to_pylist()
        sets = list(shingle_sets(as_strings(unit.column("text")), shingle))
        rows: dict[str, dict[bytes, int]] = {}
        for i, s in enumerate(sets):
            if class_id(s) == cls[i]:  # else a row of another text whose hash is the same
                rows.setdefault(group[i], {}).setdefault(cls[i], i)
        side, signs = np.asarray(unit.column("side").combine_chunks()), unit.column("sign").to_pylist()
        known = np.unique(unit.column("label").to_pylist(), return_inverse=True)[1]
        out_a, out_b = [], []
        for members in rows.values():
            at = [members[c] for c in sorted(members)]
            labels = linked([sets[i] for i in at], np.stack([np.frombuffer(signs[i], np.uint64) for i in at]), side[at], minima, percent, known[at])
            out_a += [cls[i] for i in at]
            out_b += [cls[at[k]] for k in labels]
        return pa.table([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return run


def _likely(minima: int, percent: int):
    """Of pairs (a, b) with both signatures and sizes, those not ruled out, and their estimates."""
    cut = least_estimate(percent, minima)

    def run(batches):
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sign_a", "sign_b"))
            about = similarity(one, other, minima)
            small, large = (np.asarray(f(batch.column("size_a"), batch.column("size_b"))) for f in (pc.min_element_wise, pc.max_element_wise))
            keep = pa.array((about >= cut) & (100 * small >= percent * large))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(about)], ["a", "b", "about"]).filter(keep)

    return run


ALIKE = "cls binary, label binary, partner binary, about double, root binary"


def _alike(minima: int, percent: int):
    """For each class of a bucket's block, or across two of its blocks, that signatures and sizes hold like one of another component: the likeliest such class, and one of all that are connected so."""
    cut = least_estimate(percent, minima)

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        _, part = np.unique(unit.column("part").to_pylist(), return_inverse=True)
        order = np.argsort(part, kind="stable")
        names = unit.column("label").to_pylist()
        _, label = np.unique(names, return_inverse=True)
        cls = unit.column("cls").to_pylist()
        signs = np.frombuffer(b"".join(unit.column("sign").to_pylist()), np.uint64).reshape(len(cls), -1)
        side, size = (np.asarray(unit.column(c).combine_chunks()) for c in ("side", "size"))
        bounds = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        out: list[list] = [[] for _ in range(5)]
        for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = order[at:end]
            groups, best, partner = _Groups(len(rows)), np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)
            across = len(np.unique(side[rows])) > 1
            for k in range(len(rows) - 1):
                x, rest = rows[k], rows[k + 1 :]
                open_ = label[rest] != label[x]
                if across:
                    open_ &= side[rest] != side[x]
                open_ &= 100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])
                y = np.flatnonzero(open_) + k + 1
                if not len(y):
                    continue
                near = similarity(signs[x], signs[rows[y]], minima)
                y, near = y[near >= cut], near[near >= cut]
                if len(y):
                    groups.join(np.append(y, k))
                    better = near > best[y]
                    best[y[better]], partner[y[better]] = near[better], k
                    if near.max() > best[k]:
                        best[k], partner[k] = near.max(), y[near.argmax()]
            for k in np.flatnonzero(best > -np.inf).tolist():
                for held, value in zip(out, (cls[rows[k]], names[rows[k]], cls[rows[partner[k]]], best[k], cls[rows[groups.of[k]]]), strict=True):
                    held.append(value)
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["cls", "label", "partner", "about", "root"])

    return run


class _Search:
    """One run's tables, and the confirmation of pairs of classes on their texts."""

    def __init__(self, own: DataFrame, signed: DataFrame, scratch: Scratch, shingle: int, percent: int, minima: int):
        self.scratch, self.shingle, self.percent, self.minima, self.runs = scratch, shingle, percent, minima, 0
        # one row for each class: the signature and bands do not depend on which
        rows = signed.where("cls is not null").groupBy("cls").agg(F.min(F.struct("uid", "n_bytes")).alias("one"), F.first("n_shingles").alias("size"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
        self.classes = scratch.save(rows.select("cls", "one.uid", "one.n_bytes", "size", "sign", "bands"), "classes")
        self.texts = own.where("text is not null").select("uid", "text")
        # rows that repeat id and text share a uid; only one of them goes to a task
        self.repeats = not signed.groupBy("uid").count().where("count > 1").isEmpty()

    def signatures(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that signatures don't rule out, with their estimates."""
        of = lambda x: self.classes.select(F.col("cls").alias(x), F.col("sign").alias(f"sign_{x}"), F.col("size").alias(f"size_{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_likely(self.minima, self.percent), "a binary, b binary, about double")

    def _links(self, parts: DataFrame, n: int) -> DataFrame:
        """parts: cls, part, side, unit and label, by which classes are known to be connected; the links that hold in them."""
        member = parts.join(self.classes.select("cls", "uid", "sign"), "cls")
        held = attach(self.texts, member, ["uid"], 256 * n, "inner")
        if self.repeats:
            held = held.groupBy("unit", "part", "cls", "side", "label").agg(F.first("sign").alias("sign"), F.first("text").alias("text"))
        self.runs += 1
        found = held.select("cls", "text", "sign", "part", "side", "unit", "label").groupBy("unit").applyInArrow(_confirmed(self.shingle, self.minima, self.percent), "a binary, b binary")
        return self.scratch.save(found.where("a <> b"), f"links-{self.runs}")

    def followers(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), of which every a has one: its text goes to b's task."""
        sized = pairs.join(self.classes.select(F.col("cls").alias("a"), "n_bytes"), "a")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
        leaders = self.scratch.save(sized.groupBy("b").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")), f"leaders-{self.runs}")
        total = leaders.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("leaders")).first()
        units = 1 + max(2 * total.n // BLOCK_ROWS, 2 * total.bytes // BLOCK_BYTES)
        mine = pairs.join(leaders.select("b", "blocks"), "b").select(F.col("a").alias("cls"), "b", "blocks", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block"), F.lit(1).alias("side"))
        theirs = leaders.select(F.col("b").alias("cls"), "b", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"))
        part = F.concat_ws("-", F.hex("b"), "block")
        unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("b"), F.lit(units)).cast("string")).otherwise(part)
        return self._links(mine.unionByName(theirs).select("cls", "side", part.alias("part"), unit.alias("unit"), F.col("cls").alias("label")), total.n + total.leaders)

    def alike(self, shared: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Rows of ALIKE for the classes of buckets (shared: bucket, cls) that are not all in one component."""
        labels = roots.select(F.col("node").alias("cls"), F.col("root").alias("label"))
        labelled = shared.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        labelled = self.scratch.save(labelled.select("bucket", "cls", "label"), f"labelled-{name}")
        blocks = F.ceil(F.count(F.lit(1)) / BLOCK_SIGNS).cast("int")
        apart = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), blocks.alias("blocks"))
        apart = self.scratch.save(apart.where("low <> high").select("bucket", "n", "blocks"), f"apart-{name}")
        total = apart.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]  # rows of all blocks' pairs
        member = labelled.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("pair", F.explode(_block_pairs()))
        part = F.concat_ws("-", "bucket", F.col("pair.i"), F.col("pair.j"))
        unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(1 + total // 512)).cast("string")).otherwise(part)
        member = member.select("cls", "label", (F.col("block") == F.col("pair.j")).cast("int").alias("side"), part.alias("part"), unit.alias("unit"))
        member = member.join(self.classes.select("cls", "size", "sign"), "cls")
        return self.scratch.save(member.groupBy("unit").applyInArrow(_alike(self.minima, self.percent), ALIKE), f"alike-{name}")

    def groups(self, alike: DataFrame, name: str, repeated: float | None = None) -> DataFrame | None:
        """The links among the classes that alike connects, compared in pairs of blocks where they are many; none are looked for if blocks hold the texts more than so many times."""
        coarse = components(alike.select(F.col("cls").alias("a"), F.col("root").alias("b")), self.scratch, f"coarse-{name}").withColumnRenamed("node", "cls")
        label = alike.groupBy("cls").agg(F.first("label").alias("label"))
        member = self.scratch.save(coarse.join(label, "cls").join(self.classes.select("cls", "n_bytes"), "cls"), f"member-{name}")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
        sizes = self.scratch.save(member.groupBy("root").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")), f"sizes-{name}")
        total = sizes.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in ((F.col("bytes"), "once"), (F.col("bytes") * F.col("blocks"), "bytes"), (F.col("n") * F.col("blocks"), "rows"))]).first()
        if repeated is not None and total.bytes > repeated * total.once:
            return None
        member = member.join(sizes.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        units = 1 + max(2 * total.rows // BLOCK_ROWS, total.bytes // BLOCK_BYTES)
        member = member.withColumn("pair", F.explode(_block_pairs()))
        # a block beside itself is one part; a pair of different blocks looks across only
        part = F.concat_ws("-", F.hex("root"), F.col("pair.i"), F.col("pair.j"))
        unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(units)).cast("string")).otherwise(part)
        return self._links(member.select("cls", (F.col("block") == F.col("pair.j")).cast("int").alias("side"), part.alias("part"), unit.alias("unit"), "label"), total.rows)


def _block_pairs() -> Column:
    """For a row's block of so many blocks, its pairs (i, j) with all of them, i <= j."""
    return F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (least key of the component) and kept."""
    return _judged(docs, key, text, shingle, percent).drop("uid").withColumnRenamed("id", key)


def _roots(search: _Search, scratch: Scratch) -> DataFrame:
    """(node, root) of all classes that are linked."""
    classes = search.classes
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    centres = scratch.save(buckets.groupBy("bucket").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centres")
    shared = scratch.save(buckets.join(centres, "bucket").select("bucket", "cls", "centre"), "shared")

    stars = shared.where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b")).distinct()
    first = search.signatures(stars).groupBy("a").agg(F.max_by("b", "about").alias("b"))
    links = search.followers(scratch.save(first, "first"))
    roots = components(links, scratch, "near-1")

    alike = search.alike(shared, roots, "1")
    if alike.isEmpty():
        return roots
    found = search.groups(alike, "1", REPEATED)
    if found is not None:
        return components(links.unionByName(found), scratch, "near-2")
    likeliest = scratch.save(alike.groupBy(F.col("cls").alias("a")).agg(F.max_by("partner", "about").alias("b")), "likeliest")
    links = links.unionByName(search.followers(likeliest))
    roots = components(links, scratch, "near-2")
    alike = search.alike(shared, roots, "2")
    if alike.isEmpty():
        return roots
    return components(links.unionByName(search.groups(alike, "2")), scratch, "near-3")


def _judged(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """id, uid (a hash of id and text), n_shingles, component_id and kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows, bands = banding(percent)
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    signed = scratch.save(own.mapInArrow(_signed(shingle, rows, bands), f"id {kind}, uid long, n_bytes long, n_shingles long, cls binary, bands array<long>, sign binary"), "signed")
    roots = _roots(_Search(own, signed, scratch, shingle, percent, rows * bands), scratch)

    joined = signed.select("id", "uid", "n_shingles", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = scratch.save(joined.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), "least")
    scratch.only("signed", "least", *(f"near-{k}-roots" for k in (1, 2, 3)))
    out = joined.join(least, "root", "left").select("id", "uid", "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The input's rows, all columns, of which one document of each group of near duplicates stays; of rows that repeat an id and a text, one."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    judged = scratch.save(_judged(docs, key, text, shingle, percent).select("uid", "kept"), "judged")
    gone = scratch.save(judged.where("not kept").select("uid").distinct(), "gone")
    again = scratch.save(judged.where("kept").groupBy("uid").count().where("count > 1").select("uid"), "again")
    name = free_name(docs, "_near_uid")
    marked = docs.withColumn(name, F.xxhash64(key, text))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if 40 * df.count() <= BROADCAST_BYTES else df

    kept = marked.join(small(gone.select(F.col("uid").alias(name))), name, "left_anti")
    if not again.isEmpty():
        again = small(again.select(F.col("uid").alias(name)))
        kept = kept.join(again, name, "left_anti").unionByName(kept.join(again, name, "left_semi").dropDuplicates([name]))
    return kept.drop(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles share 85 percent or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, list_sort(sh) AS sh FROM s),
c AS (SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sh) END AS class FROM n),
e AS (SELECT n.doc_id, n_shingles, unnest(sh) AS x FROM n WHERE doc_id IN (SELECT class FROM c)),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles
  HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, least) AS (
  SELECT class, class FROM c
  UNION
  SELECT l.b, r.least FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT c.doc_id, c.n_shingles, m.component_id, c.doc_id = m.component_id AS kept
FROM c JOIN m ON m.node = c.class
"""
