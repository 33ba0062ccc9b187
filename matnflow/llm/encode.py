"""Problem 6: encoding a corpus with a public byte-level BPE.

Forced boundaries: two bytes that stand side by side inside no vocabulary token can
never be merged, so a cut between them is certain. Where such a pair also parts a
character that is no white space from white space, the pre-tokenizer cuts there too,
whatever surrounds it. Texts are split at these cuts, each fragment is encoded by
itself (once, as fragments recur), and the ids are concatenated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The pre-tokenizer's pattern and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BLANKS = "\t\n\x0b\x0c\r "
OTHER_BLANKS = "\x85\xa0  -     　"

MEMO_ENTRIES = 400_000  # fragments kept by one worker; all are dropped when it is full
MEMO_LENGTH = 64  # longer fragments are encoded anew
LONG_PIECE = 256  # characters from which a fragment is cut further, inside the pre-tokenizer's pieces


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def forced_boundaries(tokens) -> np.ndarray:
    """256 x 256 table: True where two bytes are neighbours inside no token, so that a cut between them is certain."""
    certain = np.ones((256, 256), dtype=bool)
    for token in tokens:
        for a, b in zip(token, token[1:]):
            certain[a, b] = False
    return certain


def fragment_pattern(certain: np.ndarray) -> re.Pattern:
    """The fragments of a text: cut before white space, after what is none, where the byte pair makes it certain."""
    dark = [b for b in range(256) if chr(b) not in PLAIN_BLANKS]
    unsure = {c: [b for b in dark if not certain[b, ord(c)]] for c in PLAIN_BLANKS}
    cutting = [c for c in PLAIN_BLANKS if len(unsure[c]) <= 8]
    if not cutting:
        return re.compile(r"(?s).+")
    w = "".join(f"\\x{ord(c):02x}" for c in cutting)
    # no cut after white space, nor after a character whose last byte some token has before a blank;
    # characters beyond the first plane are left out of the search for such bytes and never cut after
    last = {b for c in cutting for b in unsure[c]}
    kept = [c for c in PLAIN_BLANKS if c not in cutting] + list(OTHER_BLANKS)
    kept += [chr(b) for b in last if b < 0x80]
    kept += [chr(cp) for cp in range(0x80, 0xD800) if 0x80 | cp & 0x3F in last]
    kept += [chr(cp) for cp in range(0xE000, 0x10000) if 0x80 | cp & 0x3F in last]
    k = "".join(map(re.escape, kept)) + "\U00010000-\U0010ffff"
    return re.compile(f"[{w}]*[^{w}]+(?:(?<=[{k}])[{w}]+[^{w}]*)*|[{w}]+")


class Encoder(dict):
    """Maps a fragment to its ids, four little-endian bytes each; remembers short fragments."""

    def __init__(self, content: bytes):
        import tiktoken

        ranks = read_ranks(content)
        self.certain = forced_boundaries(ranks)
        self.find = fragment_pattern(self.certain).findall
        self.coder = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def long(self, fragment: str) -> list[int]:
        """Ids of a long fragment, cut inside the pre-tokenizer's pieces: no piece makes the merge loop long."""
        import regex

        ids: list[int] = []
        for piece in regex.findall(PATTERN, fragment):
            raw = piece.encode()
            if len(raw) <= LONG_PIECE:
                ids += self.coder._encode_single_piece(raw)
                continue
            b = np.frombuffer(raw, dtype=np.uint8)
            ends = [*(np.flatnonzero(self.certain[b[:-1], b[1:]]) + 1), len(raw)]
            start = 0
            for end in ends:
                ids += self.coder._encode_single_piece(raw[start:end])
                start = end
        return ids

    def __missing__(self, fragment: str) -> bytes:
        ids = self.coder.encode_ordinary(fragment) if len(fragment) <= LONG_PIECE else self.long(fragment)
        packed = np.array(ids, dtype="<i4").tobytes()
        if len(fragment) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[fragment] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""


_encoders: dict[int, Encoder] = {}


def worker_encoder(vocabulary: Broadcast) -> Encoder:
    """This worker's encoder for a vocabulary; it stays for the worker's next tasks."""
    key = hash(vocabulary.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def share_vocabulary(spark: SparkSession, path: str | None = None, most_mb: int = 64) -> Broadcast:
    """The vocabulary file's bytes for all workers; its size is checked."""
    with open(path or default_vocabulary(), "rb") as f:
        content = f.read(most_mb * 2**20 + 1)
    if len(content) > most_mb * 2**20:
        raise ValueError(f"the vocabulary file is larger than {most_mb} MB")
    return spark.sparkContext.broadcast(content)


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """The batch's texts; bytes that are no UTF-8 become U+FFFD."""
    for x in batch.column(name).cast(pa.binary()):
        raw = x.as_py()
        yield None if raw is None else raw.decode("utf-8", "replace")


def encode_corpus(
    df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, flush_mb: int = 16
) -> DataFrame:
    """``df`` with the column ``ids`` (array of int) in place of ``text``, without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are
    ordinary text. Texts of any length are encoded whole; output batches are flushed by
    size, so long texts don't gather in memory. A column already called ``ids`` is replaced.
    One pass, no shuffle.
    """
    vocabulary = share_vocabulary(df.sparkSession, path)
    fields = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for b in batches:
            start, parts, total = 0, [], 0
            for i, t in enumerate(texts(b, text)):
                parts.append(encoder.encode(t))
                total += len(parts[-1])
                if total >= flush_mb * 2**20 or i + 1 == b.num_rows:
                    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
                    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                    flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                    cols = [b.column(f.name).slice(start, len(parts)) for f in fields]
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                    yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                    start, parts, total = i + 1, [], 0

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", n: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens in place of ``text``; 0 for null and empty texts."""
    vocabulary = share_vocabulary(df.sparkSession, path)
    fields = [f for f in df.schema.fields if f.name not in (text, n)]
    schema = T.StructType([*fields, T.StructField(n, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for b in batches:
            counts = [len(encoder.encode(t)) // 4 for t in texts(b, text)]
            cols = [b.column(f.name) for f in fields] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)
