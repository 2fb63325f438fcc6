"""SentencePiece encoding and decoding through the tokenizers library.

The model file's protobuf is parsed here and rebuilt as a tokenizers pipeline: the normaliser
(precompiled character map, extra white space, dummy prefix), the metaspace marker, the model
(unigram scores, or the merges that a BPE model's scores imply) and byte fallback. Where no
piece goes on after a word's end, texts are first cut before each run of markers, which changes
no id and lets the library reuse words. Batches are encoded with the library's own threads.
``verify`` holds a rebuilt tokenizer against another encoder, such as the sentencepiece library.

Defined results: a null text encodes as an empty one, to no ids; a text of any length is encoded
whole, by the task that has its row; null keys and repeated rows come back as often as they occur; an empty table gives an empty table; only the key and text columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from dagframe.llm.common import small_batches, table

MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    """What a model file says; pieces are (text, score, type)."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        head = varint()
        if (wire := head & 7) == 0:
            yield head >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield head >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap, model.dummy_prefix, model.squeeze, model.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return model


def _merges(model: PieceModel, vocab: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to make a piece from two others, best score first."""
    usable = {p for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED)}
    found = [(-score, vocab[p], k, p[:k], p[k:]) for p, score, t in model.pieces if t == NORMAL for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    return [(a, b) for _, _, _, a, b in sorted(found)]


def build_tokenizer(model: PieceModel) -> Tokenizer:
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((p for p, _, t in model.pieces if t == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], vocab.get(unknown), model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(vocab, _merges(model, vocab), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(core)
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps += [normalizers.Replace(" ", MARK)]
    if model.dummy_prefix:
        steps += [normalizers.Prepend(MARK if model.escape else " ")]
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    own = [AddedToken(p, normalized=False) for p, _, t in model.pieces if t == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    decode: list = ([decoders.Replace(MARK, " ")] if model.escape else []) + [decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(decode + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


@cache
def load(path: str) -> tuple[PieceModel, Tokenizer]:
    with open(path, "rb") as f:
        model = parse_model(f.read())
    return model, build_tokenizer(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in load(path)[1].encode_batch_fast(texts, add_special_tokens=False)]


@cache
def _bytes_of(path: str) -> list[bytes]:
    model = load(path)[0]
    return [bytes([int(p[3:5], 16)]) if t == BYTE else (p.replace(MARK, " ") if model.escape else p).encode() for p, _, t in model.pieces]


def decode(path: str, ids: list[list[int]]) -> list[str]:
    """Texts of id lists; the library's decoder has its way with those whose bytes are no UTF-8."""
    (model, tokenizer), parts, out = load(path), _bytes_of(path), []
    for row in ids:
        data = b"".join([parts[i] for i in row])
        try:
            out.append((data[1:] if model.dummy_prefix and data.startswith(b" ") else data).decode())
        except UnicodeDecodeError:
            out.append(tokenizer.decode(row, skip_special_tokens=False))
    return out


def verify(path: str, texts: list[str], other: Callable[[list[str]], list[list[int]]]) -> list[int]:
    """Indexes of the texts whose ids differ from those of another encoder."""
    return [i for i, (a, b) in enumerate(zip(encode(path, texts), other(texts), strict=True)) if list(a) != list(b)]


def _normal(model: PieceModel, tokenizer: Tokenizer, text: str) -> str:
    """What decoding should give back: the normalised text without marker and prefix."""
    if not model.charsmap and not model.squeeze:
        return text.replace(MARK, " ") if model.escape else text
    out = tokenizer.normalizer.normalize_str(text)
    out = out.replace(MARK, " ") if model.escape else out
    return out[1:] if model.dummy_prefix and out.startswith(" ") else out


ROWS = 256


def _encoded(given: str | None):
    def run(batches):
        path = given or default_model()
        model, tokenizer = load(path)
        is_byte = np.array([t == BYTE for _, _, t in model.pieces])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                texts = pc.fill_null(rows.column("text"), "").to_pylist()
                ids = encode(path, texts)
                back = decode(path, ids)
                same = [b == _normal(model, tokenizer, t) for t, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array([int(is_byte[np.array(x, int)].sum()) for x in ids], pa.int64()), pa.array(same)], ["id", "ids", "n_byte_tokens", "round_trip"])

    return run


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids (array of int), n_byte_tokens and round_trip (decoding gives back the normalised text), one row per input row."""
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(_encoded(path), f"id {kind}, ids array<int>, n_byte_tokens long, round_trip boolean").withColumnRenamed("id", key)


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key and text of a table of ids; null ids decode to an empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = decode(path or default_model(), [x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    small_batches(encoded.sparkSession)
    own = encoded.select(F.col(key).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return own.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", key)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, with a digest of the ids, and decoded again."""
    done = encode_documents(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_byte_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")
