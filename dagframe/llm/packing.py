"""Mixture-controlled packing: source queues fill windows of sequences by deficit round-robin.

Documents of a source form a queue of tokens. In every window of ``window`` sequences each queue
is served in turn; its quantum is its share of the window, and what rounding leaves it short of
or ahead is its deficit, carried to the next window. With integer weights w the tokens that
queues 1..q have got after u windows are ``floor(u * window tokens * (w1 + .. + wq) / sum w)``,
so a queue is never a whole token off its target (sources whose share is under one token a
window, and no others, go together in one queue, as rounding could else take a token back), and the deficit that any partition starts from
follows from counts alone: no state runs through the partitions. When a queue runs dry the round
robin goes on among the others. Documents are cut where a quantum or a sequence ends; only the
last sequence may be short.

Defined results: a null text is empty and packs as its end token; a null source is a queue of its
own; with weights, sources that have none follow those that do, by what they hold; rows that
repeat are packed as often; a null key stays null; a text of any length is encoded whole, by the
task that has its row, and cut into as many pieces as it needs; an empty table gives an empty table; only the key, text and source
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagframe.llm.common import Scratch, attach, table

LENGTH = 1024
#: Sequences of a window.
WINDOW = 64
END = 0
#: The queue of the sources of less than a token a window; those of others are ``none`` or begin with ``s:``.
SMALL = "small"


@cache
def _encoder(json_path: str | None, ranks_path: str | None):
    """A function from texts to id lists: the ids of the tokenizers file, by the same vocabulary's faster form if that is given. Without paths the public vocabulary of 50,257, found where the task runs."""
    import public_tokenizers
    from tokenizers import Tokenizer

    if json_path is None:
        json_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    if ranks_path is None:
        whole = Tokenizer.from_file(json_path)
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)], whole.get_vocab_size()
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        return _encoder(json_path, None)  # such tokens take what is around them along
    special = {t["content"]: t["id"] for t in added}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode(t, allowed_special="all") if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode, max(len(ranks), *(i + 1 for i in special.values()))


class Schedule:
    """How many tokens each queue has given after any number of windows; spare are the weights once no queue with a weight is left, by default equal."""

    def __init__(self, totals: list[int], weights: list[int], tokens: int, spare: list[int] | None = None):
        spare = spare or [1] * len(totals)
        self.tokens, self.starts, self.phases = tokens, [], []
        done, t = [0] * len(totals), 0
        while (left := sum(totals) - sum(done)) > 0:
            rest = [n - d for n, d in zip(totals, done, strict=True)]
            weight = [w if r else 0 for w, r in zip(weights, rest, strict=True)]
            if not any(weight):
                weight = [w if r else 0 for w, r in zip(spare, rest, strict=True)]
            whole = sum(weight)
            if any(w and tokens * w < whole for w in weight):
                raise ValueError("a queue's share is one token a window at least")  # else rounding could take a token back
            windows = min(r * whole // (tokens * w) for r, w in zip(rest, weight, strict=True) if w)
            ahead = np.concatenate([[0], np.cumsum(np.array(weight, object))]).tolist()
            if windows:
                self._add(t, done, ahead, whole, None)
                done = [d + windows * tokens * b // whole - windows * tokens * a // whole for d, a, b in zip(done, ahead, ahead[1:], strict=False)]
                t += windows
                continue
            # some queue runs dry in this window, or it is the last: what it can't give goes to the others
            given, room = [0] * len(totals), min(tokens, left)
            while room:
                live = [w if r > g else 0 for w, r, g in zip(weights, rest, given, strict=True)]
                if not any(live):
                    live = [w if r > g else 0 for w, r, g in zip(spare, rest, given, strict=True)]
                acc, total, more = 0, sum(live), []
                for w in live:
                    more.append(room * (acc + w) // total - room * acc // total)
                    acc += w
                given = [min(r, g + m) for r, g, m in zip(rest, given, more, strict=True)]
                room = min(tokens, left) - sum(given)
            self._add(t, done, None, 0, given)
            done = [d + g for d, g in zip(done, given, strict=True)]
            t += 1
        self.windows = t

    def _add(self, t, done, ahead, whole, given):
        self.starts.append(t)
        offsets = None if given is None else np.concatenate([[0], np.cumsum(given)]).astype(int).tolist()
        self.phases.append((list(done), ahead, whole, given, offsets))

    def before(self, q: int, t: int) -> int:
        """Tokens of queue q given in the first t windows."""
        if not self.phases:
            return 0
        k = bisect_right(self.starts, t) - 1
        done, ahead, whole, given, _ = self.phases[k]
        u = t - self.starts[k]
        if given is not None:
            return done[q] + (given[q] if u else 0)
        return done[q] + u * self.tokens * ahead[q + 1] // whole - u * self.tokens * ahead[q] // whole

    def offset(self, q: int, t: int) -> int:
        """Where queue q begins in window t."""
        k = bisect_right(self.starts, t) - 1
        _, ahead, whole, _, offsets = self.phases[k]
        if offsets is not None:
            return offsets[q]
        u = (t - self.starts[k]) * self.tokens
        return (u + self.tokens) * ahead[q] // whole - u * ahead[q] // whole

    def window_of(self, q: int, x: int) -> int:
        """The window that holds token x of queue q."""
        low, high = 0, self.windows
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.before(q, mid) <= x else (low, mid)
        return low


def lanes(totals: Mapping[str, int], tokens: int) -> dict[str, str]:
    """For each queue the one it shares a stream with: the smallest ones go together until they have a token in every window."""
    whole, left = sum(totals.values()), sorted(totals, key=lambda q: (totals[q], q))
    together, n = [], 0
    while left and (tokens * totals[left[0]] < whole or 0 < tokens * n < whole):
        together.append(left.pop(0))
        n += totals[together[-1]]
    return {q: q for q in left} | {q: together[-1] for q in together}


def _tokenized(json_path: str, ranks_path: str | None):
    def run(batches):
        from pyspark import TaskContext

        encode, vocabulary = _encoder(json_path, ranks_path)
        kind = "<u2" if vocabulary <= 65536 else "<u4"
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [np.array([*x, END], kind) for x in encode(pc.fill_null(rows.column("text"), "").to_pylist())]
                queue, start = rows.column("queue").to_pylist(), []
                for q, x in zip(queue, ids, strict=True):
                    start.append(given.get(q, 0))
                    given[q] = start[-1] + len(x)
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("queue"), pa.array([part] * len(ids), pa.int32()), pa.array(start, pa.int64()), n, pa.array([x.tobytes() for x in ids], pa.binary())], ["id", "queue", "part", "start", "n", "ids"])

    return run


def _cut(schedule: Schedule, order: dict[str, int], length: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            at, held = [], []
            for i, (lane, x, n, ids) in enumerate(zip(batch.column("lane").to_pylist(), batch.column("x").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                q, done = order[lane], 0
                raw = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                t = schedule.window_of(q, x)
                while done < n:
                    while schedule.before(q, t + 1) <= x + done:
                        t += 1
                    place = schedule.offset(q, t) + x + done - schedule.before(q, t)
                    size = min(n - done, schedule.before(q, t + 1) - x - done, length - place % length)
                    rows.append((done, size, zlib.crc32(raw[done : done + size].tobytes()), n, t * (schedule.tokens // length) + place // length, place % length))
                    at.append(i)
                    if with_ids:
                        held.append(raw[done : done + size].astype(np.int32))
                    done += size
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
            columns = [batch.column("id").take(pa.array(at, pa.int64())), *made, batch.column("queue").take(pa.array(at, pa.int64()))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, window: int = WINDOW, weights: Mapping[str, int] | None = None, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and queue, and on request the ids.

    weights maps sources to integer shares of the tokens; by default a source's share is what it has.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema[key].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("s:"), F.col(source)), F.lit("none"))
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), named.alias("queue"))
    tokens = scratch.save(own.mapInArrow(_tokenized(json_path, ranks_path), f"id {kind}, queue string, part int, start long, n long, ids binary"), "tokens")

    sums = scratch.save(tokens.groupBy("part", "queue").agg(F.sum("n").alias("sum")), "sums")
    per_queue = scratch.save(sums.groupBy("queue").agg(F.sum("sum").alias("n")), "totals")
    window_tokens = length * window
    share = {f"s:{name}": w for name, w in weights.items() if w > 0} if weights else {}
    given = F.col("queue").isin(list(share)) if share else F.lit(False)
    totals = {r.queue: r.n for r in per_queue.where(given).collect()}  # no more than weights
    share = {q: w for q, w in share.items() if q in totals}
    rest = per_queue.where(~given).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = {r.queue: r.n for r in per_queue.where(~given & (F.col("n") >= -(-rest // window_tokens))).collect()}  # no more than a window's tokens
    if left := rest - sum(large.values()):
        large[SMALL] = left
    totals |= large
    lane = lanes(share, window_tokens) | lanes(large, window_tokens)
    streams = sorted(set(lane.values()))
    sizes, shares = Counter(), Counter()
    for q, x in lane.items():
        sizes[x] += totals[q]
        shares[x] += share.get(q, 0)
    schedule = Schedule([sizes[x] for x in streams], [shares[x] for x in streams], window_tokens, [sizes[x] for x in streams])
    own_lanes = docs.sparkSession.createDataFrame([(q, x) for q, x in lane.items() if q != SMALL], "queue string, lane string")
    laned = attach(sums, own_lanes, ["queue"], sum(64 + 8 * len(q + x) for q, x in lane.items())).withColumn("lane", F.coalesce("lane", F.lit(lane.get(SMALL))))
    laned = scratch.save(laned.select("part", "queue", "lane", "sum"), "laned")
    # parts before this one, then queues before this one in the part: no window holds all rows of a lane of many sources
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = laned.groupBy("part", "lane").agg(F.sum("sum").alias("held")).select("part", "lane", F.coalesce(F.sum("held").over(before("lane").orderBy("part")), F.lit(0)).alias("ahead"))
    inside = laned.select("part", "queue", "lane", F.coalesce(F.sum("sum").over(before("part", "lane").orderBy("queue")), F.lit(0)).alias("inner"))
    bases = inside.join(parts, ["part", "lane"]).select("part", "queue", "lane", (F.col("ahead") + F.col("inner")).alias("base"))
    placed = attach(tokens, bases, ["part", "queue"], 128 * laned.count(), "inner").select("id", "queue", "lane", (F.col("base") + F.col("start")).alias("x"), "n", "ids")
    order = {x: k for k, x in enumerate(streams)}
    pieces = placed.mapInArrow(_cut(schedule, order, length, with_ids), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string" + ", ids array<int>" * with_ids)
    return pieces.withColumnRenamed("id", key)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """sequence_id, n_tokens and ids (array of length ids, padded at the end) of pieces that were packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    return whole.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad), F.lit(length) - n)).alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, by source."""
    return pack(table(spark, sf_dir, "documents")).drop("queue")
