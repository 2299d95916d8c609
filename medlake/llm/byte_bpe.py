"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is split by the vocabulary's pattern; every match is encoded on its
own, so joining matches is plain concatenation.  Inside a match:

* ``encode_bytes`` halves the bytes down to leaves of ``LEAF`` bytes, merges
  each leaf directly by rank, and joins neighbours on the way up;
* ``join`` re-encodes a window of tokens around the boundary and doubles it
  until the tokens outside provably stay.  A sequence of tokens is the encoding
  of its bytes if and only if each token and each adjacent pair encodes to
  itself: the first merge across a token boundary in the whole text would also
  be the first one in that pair alone, since until then both sides merge as
  they do by themselves.  So only the two pairs at the window's edges need a
  check; a window that has swallowed a side has no pair there.

Decoding concatenates the tokens' bytes up the same kind of tree.

A match that is itself in the vocabulary is that one token, as in the public
encoder.  No special tokens are known.  Results for odd input: null and empty
texts have no tokens and decode to nothing; long texts are encoded whole.
Extra columns are ignored by ``encode`` and kept by ``with_tokens``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlake.llm.common import SLICE_BYTES, bounded_batches, filled, text_slices

LEAF = 8
#: Merges of so many bytes are remembered, longer ones use a heap.
SHORT, LONG = 16, 64
#: Leaves of matches longer than ``LONG``.
LONG_LEAF = 1024
#: Entries a Python worker keeps: matches, short merges, token pairs (about 130 MB).
CACHE = 400_000
LEAVES = 100_000
PAIRS = 100_000


class Recent(dict):
    """Remembers at least the ``size / 2`` keys used last and at most ``size``:
    the older half goes when the younger one is full."""

    def __init__(self, size: int):
        super().__init__()
        self.half = max(1, size // 2)
        self.old: dict = {}

    def find(self, key: Any) -> Any:
        got = self.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key: Any, value: Any) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe(Recent):
    """Maps a match of the pattern to its packed ids (little-endian 32 bit).

    The mapping remembers up to ``CACHE`` matches; a miss encodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(CACHE)
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.find_all = regex.compile(pattern).findall
        self.stable_pairs = Recent(PAIRS)
        self.merged = Recent(LEAVES)
        self.top = max(ranks.values(), default=0) + 1
        self.bytes_of = np.empty(self.top, dtype=object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is not None:
            self.put(piece, packed)
            return packed
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = self.encode_bytes(raw)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(raw) <= 64:
            self.put(piece, packed)
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """Direct merging by rank, lowest first, leftmost on ties."""
        if len(raw) > LONG:
            return self._merge_long(raw)
        short = len(raw) <= SHORT
        if short:
            got = self.merged.get(raw) or self.merged.find(raw)
            if got is not None:
                return got
        ranks, none = self.ranks, self.top
        rank = ranks.get
        cuts = list(range(len(raw) + 1))
        pair = [rank(raw[i:i + 2], none) for i in range(len(raw) - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            del cuts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(raw[cuts[i]:cuts[i + 2]], none)
            if i:
                pair[i - 1] = rank(raw[cuts[i - 1]:cuts[i + 1]], none)
        ids = [ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        if short:
            self.merged.put(raw, ids)
        return ids

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap of pairs over linked parts: n log n steps."""
        n, rank = len(raw), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue        # one of the two parts has changed since
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(raw[i:end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := rank(raw[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = after[i]
        return out

    def encode_bytes(self, raw: bytes) -> list[int]:
        n = len(raw)
        if n <= LEAF or LONG < n <= LONG_LEAF:
            return self.merge(raw)
        # long ones are cut at a power of two: runs of one character then meet on token boundaries
        half = n // 2 if n <= LONG else 1 << ((n - 1).bit_length() - 1)
        return self.join(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens encode to themselves side by side."""
        got = self.stable_pairs.get((a, b))
        if got is None:
            got = self.stable_pairs.find((a, b))
        if got is None:
            got = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            self.stable_pairs.put((a, b), got)
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            raw = b"".join(self.tokens[t] for t in left[-k:] + right[:k])
            mid = self.merge(raw)
            if ((k >= len(left) or self.stable(left[-k - 1], mid[0]))
                    and (k >= len(right) or self.stable(mid[-1], right[k]))):
                return left[:-k] + mid + right[k:]
            k *= 2

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return b"".join(map(self.__getitem__, self.find_all(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, leaves of the tree joined from the left."""
        return b"".join(b"".join(self.bytes_of[ids[i:i + 4096]].tolist()) for i in range(0, len(ids), 4096))


def _vocabulary(df: DataFrame, path: str | None, pattern: str | None) -> Any:
    """Broadcast (ranks, pattern): the fixed vocabulary file, read once."""
    bounded_batches(df.sparkSession)
    if path is None or pattern is None:
        import public_tokenizers
        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return df.sparkSession.sparkContext.broadcast((load_ranks(path), pattern))


_LOADED: dict[tuple, ByteBpe] = {}


def _shared(vocabulary: Any) -> ByteBpe:
    """One encoder per Python worker and vocabulary: tasks that run in the
    same worker go on with its cache (bounded by ``CACHE`` entries)."""
    ranks, pattern = vocabulary.value
    key = (pattern, len(ranks), hash(frozenset(ranks.items())))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(ranks, pattern)
    return _LOADED[key]


def _encoded(arr: pa.Array, bpe: ByteBpe) -> Iterator[tuple[int, int, list[bytes]]]:
    arr = filled(arr)
    for lo, hi, _, _ in text_slices(arr, SLICE_BYTES):
        yield lo, hi, [bpe.encode(t) for t in arr.slice(lo, hi - lo).to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Per row: the id column and ``ids`` (packed 32-bit little-endian)."""
    vocabulary = _vocabulary(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(vocabulary)
        for batch in batches:
            for lo, hi, ids in _encoded(batch.column(1), bpe):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())],
                                                 names=[id_col, "ids"])
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` long, ids binary")


def _decoder(vocabulary: Any, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [bpe.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=names)
    return run


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded`` (the bytes) to a table with packed ``ids``."""
    names = [*encoded.columns, "decoded"]
    run = _decoder(_vocabulary(encoded, path, pattern), encoded.columns.index("ids"), names)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(run, schema)


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                pattern: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts: the id column, ``ids``
    and ``decoded``."""
    vocabulary = _vocabulary(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(vocabulary)
        for batch in batches:
            for lo, hi, ids in _encoded(batch.column(1), bpe):
                raw = [bpe.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()),
                                                  pa.array(raw, pa.binary())], names=[id_col, "ids", "decoded"])
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` long, ids binary, decoded binary")


def token_report(docs: DataFrame) -> DataFrame:
    """Per document: number and digest of the ids, digest of what they decode to."""
    return round_trips(docs).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens``, ``ids`` (packed), and
    ``round_trip`` (the ids decode to the text's bytes); a column of ``docs``
    with one of these names is replaced."""
    own = ("n_tokens", "ids", "round_trip")
    docs = docs.drop(*own)
    vocabulary = _vocabulary(docs, path, pattern)
    at, names = docs.columns.index(text_col), [*docs.columns, "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(vocabulary)
        for batch in batches:
            texts = filled(batch.column(at).cast(pa.string()))
            for lo, hi, ids in _encoded(texts, bpe):
                same = [bpe.decode(np.frombuffer(x, dtype="<u4")) == t.encode("utf-8")
                        for x, t in zip(ids, texts.slice(lo, hi - lo).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=names)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(run, schema).withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as long)"))
