"""Secret spans in texts: patterns, and strings that a tokenizer's vocabulary can't shorten.

Base kinds are patterns: ``assign``, ``access`` and ``hex``. The kind ``random`` is the
token-efficiency test: in runs of letters, digits and ``+/_=-`` of at least MIN_RANDOM
characters that mix letters and digits, text or code averages well over MAX_RATIO characters a
token under a byte-pair vocabulary, and random strings don't. Where a whole run averages more, names
may dilute a random string in it, so what stands between its words and separators is tested too, as are
the parts of a run beside base spans. Known digests (32, 40, 56, 64, 96
or 128 hexadecimal digits), UUIDs, runs without a letter or without a digit and dotted or dashed
identifiers made of plain words and numbers are left out before, as is what overlaps a base span itself.

Defined results: a null text is empty and has no spans; a text of any length is scanned whole, in
time that grows with it; null keys and rows that repeat come back as often as they occur;
ties in start are ordered by kind as listed; an empty table gives an empty table; only the key
and text columns are read, so other columns cannot clash, and ``redact`` passes them through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.common import small_batches, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

MIN_RANDOM = 20
MAX_RATIO = 1.8
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words and numbers joined by separators, as in paths and names.
IDENTIFIER = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|\d+)(?:[+/_=-]+(?:[A-Za-z]?[a-z]+|[A-Z]+|\d+))*[+/_=-]*")
PIECE = re.compile(r"[A-Za-z0-9]+")
#: A piece that is a word, a camel-case name or a number.
WORD = re.compile(r"[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+|\d+")
#: Words this long cut a run; shorter ones are also found inside base64 strings.
LEAST_WORD = 4

#: For whole batches, in linear time: which texts can hold a span of a kind at all.
MAY_HOLD = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]""",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "random": "[A-Za-z0-9+/_=-]{%d}" % MIN_RANDOM,
}


@cache
def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def looks_random(run: str, vocabulary: str) -> bool:
    """Whether a run of characters has few characters a token and is no known digest or identifier."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return False
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    return len(run) < MAX_RATIO * len(_vocabulary(vocabulary).encode_ordinary(run))


def random_parts(text: str, start: int, end: int, vocabulary: str) -> list[tuple[int, int]]:
    """The random strings of text[start:end], a run or what base spans leave of one: all of it, or stretches between its words, or pieces of these."""
    if end - start < MIN_RANDOM:
        return []
    if looks_random(text[start:end], vocabulary):
        return [(start, end)]
    stretches: list[list[tuple[int, int]]] = [[]]
    for m in PIECE.finditer(text, start, end):
        word = WORD.fullmatch(m[0])
        if word and len(m[0]) >= LEAST_WORD:
            stretches.append([])
        elif not word or stretches[-1]:
            stretches[-1].append((m.start(), m.end()))
    found = []
    for pieces in stretches:
        while pieces and WORD.fullmatch(text, *pieces[-1]):
            pieces.pop()
        whole = text[pieces[0][0] : pieces[-1][1]] if pieces else ""
        # numbers and codes joined by separators have few characters a token too, but rarely letters of both cases
        mixed = any(c.islower() for c in whole) and sum(c.isupper() for c in whole) > 2
        if len(pieces) > 1 and mixed and len(whole) >= MIN_RANDOM and looks_random(whole, vocabulary):
            found.append((pieces[0][0], pieces[-1][1]))
        else:
            found += [(a, b) for a, b in pieces if b - a >= MIN_RANDOM and looks_random(text[a:b], vocabulary)]
    return found


def spans(text: str, kinds: tuple[str, ...], vocabulary: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) in code points, in order; kinds are those that the text may hold."""
    found = []
    if "assign" in kinds:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "access" in kinds:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if "hex" in kinds:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "random" in kinds:
        base, first = sorted((a, b) for a, _, b in found), 0
        for m in RUN.finditer(text):
            at = m.start()
            while first < len(base) and base[first][1] <= at:
                first += 1
            k = first
            while k < len(base) and base[k][0] < m.end():
                found += [(x, 3, y) for x, y in random_parts(text, at, base[k][0], vocabulary)]
                at, k = max(at, base[k][1]), k + 1
            found += [(x, 3, y) for x, y in random_parts(text, at, m.end(), vocabulary)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _batch_spans(texts: pa.Array, vocabulary: str) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    may = {k: pc.match_substring_regex(texts, p) for k, p in MAY_HOLD.items()}
    rows = pc.indices_nonzero(pc.or_(pc.or_(may["assign"], may["access"]), pc.or_(may["hex"], may["random"]))).to_pylist()
    for i in rows:
        out[i] = spans(texts[i].as_py(), tuple(k for k in KINDS if may[k][i].as_py()), vocabulary)
    return out


def _scan(vocabulary: str | None):
    def run(batches):
        for batch in batches:
            found = _batch_spans(pc.fill_null(batch.column("text"), ""), vocabulary or default_vocabulary())
            base = [[s for s in f if s[1] < 3] for f in found]
            count = lambda k: pa.array([sum(s[1] == k for s in f) for f in base], pa.int64())
            digest = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base])
            yield pa.RecordBatch.from_arrays([batch.column("id"), count(0), count(1), count(2), digest, pa.array([joined(f) for f in found], pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined), one row per input row."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(_scan(vocabulary), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", key)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """The input with every secret span of the text replaced by mask; all columns and rows stay."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            found = _batch_spans(pc.fill_null(texts, ""), vocabulary or default_vocabulary())
            if any(found):
                new = texts.to_pylist()
                for i, f in enumerate(found):
                    if f:
                        out, done = [], 0
                        for a, _, b in f:
                            if a >= done:
                                out += [new[i][done:a], mask]
                            done = max(done, b)
                        new[i] = "".join(out) + new[i][done:]
                texts = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secret_spans(table(spark, sf_dir, "documents"))
