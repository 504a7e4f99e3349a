"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

The vocabulary's ranks are written straight into a sentencepiece BPE model: each token's bytes
are mapped to printable characters (one for each byte), a piece's score is its negative rank,
so the piece merged first is the one of lowest rank, and normalisation is the identity. Texts
are cut into pre-tokens by the vocabulary's pattern; each distinct pre-token of a batch is
encoded once. Decoding maps ids back to pieces, characters and bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import env_path

#: Pre-tokens of the byte_bpe_50k vocabulary (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens that a worker keeps; beyond it the table starts anew, results don't change.
CACHE = 1 << 17


def vocabulary_dir(spark: SparkSession | None = None) -> str:
    """Folder of the vocabulary files: ``spark.trawl.tokenizers``, else ``TRAWL_TOKENIZERS``, else /opt/tokenizers."""
    given = spark.conf.get("spark.trawl.tokenizers", None) if spark else None
    return given or env_path("TRAWL_TOKENIZERS", "/opt/tokenizers")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where Latin-1 shows it, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of the ranks: piece ids are ranks, the unknown piece comes after them."""
    alphabet, normal, unknown = byte_alphabet(), 1, 2
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = "".join(alphabet[b] for b in token).encode()
    out = []
    for rank, piece in enumerate(pieces):
        if not piece:  # a gap among the ranks
            piece = f"{rank}".encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal)))
    out.append(_field(1, _field(1, b"\xef\xa3\xbfunk") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    trainer += _field(45, b"\xef\xa3\xbfunk")
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with a serialised model; one for each worker process."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(model)
        self.find = regex.compile(pattern).findall
        alphabet = byte_alphabet()
        self.back = {c: b for b, c in enumerate(alphabet)}
        self.alphabet = alphabet
        self.ids: dict[str, list[int]] = {}
        n = self.sp.get_piece_size() - 1
        self.bytes = [bytes(self.back.get(c, 0x3F) for c in self.sp.id_to_piece(i)) for i in range(n)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        texts = list(texts)
        cut = [self.find(t) if t else [] for t in texts]
        new = list({p for c in cut for p in c if p not in self.ids})
        if new:
            if len(self.ids) + len(new) > CACHE:
                self.ids.clear()
                new = list({p for c in cut for p in c})
            a = self.alphabet
            mapped = ["".join([a[b] for b in p.encode()]) for p in new]
            self.ids.update(zip(new, self.sp.encode(mapped, num_threads=1)))
        get = self.ids.__getitem__
        return (list(chain.from_iterable(map(get, c))) for c in cut)

    def decode(self, ids: Iterable[int]) -> str:
        b = self.bytes
        return b"".join([b[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    key = (len(model), hash(model), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


#: Documents encoded at once: the distinct pre-tokens of so many are held together.
BATCH = 256


def _model(spark: SparkSession, path: str | None):
    # about one megabyte, whatever the size of the corpus
    return spark.sparkContext.broadcast(serialize_model(read_ranks(path or f"{vocabulary_dir(spark)}/{VOCABULARY}")))


def token_ids(spark: SparkSession, text: Column, path: str | None = None, pattern: str = PATTERN) -> Column:
    """``array<int>`` of token ids without special tokens; empty for null and empty texts.

    Text that looks like a special token is ordinary text. Whole texts of any length are encoded.
    """
    model = _model(spark, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            texts = batch.to_pylist()
            offsets, values = [0], []
            for at in range(0, len(texts), BATCH):
                for ids in codec.encode(texts[at : at + BATCH]):
                    values.extend(ids)
                    offsets.append(len(values))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return encode(text)


def token_counts(spark: SparkSession, text: Column, path: str | None = None, pattern: str = PATTERN) -> Column:
    """Number of token ids as ``bigint``; 0 for null and empty texts."""
    model = _model(spark, path)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array([len(ids) for at in range(0, len(texts), BATCH) for ids in codec.encode(texts[at : at + BATCH])], pa.int64())

    return count(text)


def decoded_text(spark: SparkSession, ids: Column, path: str | None = None, pattern: str = PATTERN) -> Column:
    """The text of an array of ids; null for a null array, empty for an empty one."""
    model = _model(spark, path)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            yield pa.array([None if x is None else codec.decode(x) for x in batch.to_pylist()], pa.string())

    return decode(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``ids`` of every row, copies and all; other columns are passed over. No shuffle: one pass over the scan."""
    return documents.select(F.col(key), token_ids(documents.sparkSession, F.col(text), path).alias("ids"))


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    return encoded.select(F.col(key), decoded_text(encoded.sparkSession, F.col(ids), path).alias("text"))
