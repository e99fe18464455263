"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Each rank becomes a piece whose bytes are mapped to printable characters, scored by its negative rank, with identity
normalisation; sentencepiece then merges the pair of the lowest rank first, as the rank file's own library does. Every
match of the split pattern is encoded by itself; decoding maps the ids' pieces back to bytes.

Defined results: null text is empty, with no ids and the digest of no bytes; repeated rows repeat their result; a null
doc_id stays null; an empty table gives an empty result. Other columns are ignored. No text is cut.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: What \\s means to the rank files' library (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A worker forgets its cached pre-tokens beyond so many, and never caches longer ones than LONG characters.
CACHED, LONG = 200_000, 48


@functools.cache
def byte_chars() -> list[str]:
    """A printable character for each byte: its own where that is printable in Latin-1, else one from U+0100 on."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which are 0, 1, 2 and so on."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece i is tokens[i]; an unknown piece, which no byte string needs, comes last."""
    chars = byte_chars()
    pieces = [_field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, plain)


def split_pattern(pattern: str):
    """The pattern compiled so that \\s and \\S mean the same as in the rank files' library."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers. Remembers short pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = split_pattern(pattern).findall
        self.chars = str.maketrans({i: c for i, c in enumerate(byte_chars())})
        back = {c: b for b, c in enumerate(byte_chars())}
        self.tokens = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(self.processor.get_piece_size() - 1)]

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.chars)
        ids = np.array(self.processor.encode(mapped, num_threads=1), "<u4").tobytes()
        if len(piece) <= LONG:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(1)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs; with_ids adds ids, an array of int."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, before, after, ids = [], [], [], []
            for text in batch.column(1):
                code = own.encode(text.as_py() or "")
                counts.append(len(code) // 4)
                before.append(sha(code))
                after.append(sha(own.decode(code)))
                if with_ids:
                    ids.append(np.frombuffer(code, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        own.clear()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text")).mapInArrow(lean(run), schema)
