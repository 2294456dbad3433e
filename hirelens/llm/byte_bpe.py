"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Boundaries of pre-tokens come from :mod:`pretokens`; each distinct pre-token is merged
once and then served from a bounded cache. Ids are kept as packed little-endian unsigned
32-bit integers, the form in which training shards hold them, and the byte offset of every
token is kept with them, so that any run of tokens can be decoded or located in its text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, pieces_of
from .pretokens import pieces

#: Bytes of text whose results leave a task together, codepoints split at a time, and pre-tokens
#: remembered by a worker.
PIECE, CHUNK, CACHED = 1_000_000, 100_000, 150_000
SHORT, NEVER = 64, 1 << 60


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def pairs_of(path: str) -> tuple[dict[int, int], list[int]]:
    """The id that each pair of ids joins to (its rank too), and the id of each single byte."""
    ranks = ranks_of(path)
    joined = {}
    for token, i in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                joined[left << 32 | right] = i
    return joined, [ranks[bytes([b])] for b in range(256)]


def merge(piece: bytes, path: str) -> list[int]:
    """Ids of one pre-token: of neighbours that can join, those of the lowest rank join
    first, the leftmost of equals first."""
    whole = ranks_of(path).get(piece)
    if whole is not None:
        return [whole]
    joined, single = pairs_of(path)
    ids = [single[b] for b in piece]
    if len(ids) > SHORT:
        return _merge_long(ids, joined)
    find = joined.get
    joins = [find(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
    while joins:
        rank = min(joins)
        if rank == NEVER:
            break
        i = joins.index(rank)
        ids[i] = rank
        del ids[i + 1], joins[i]
        if i < len(joins):
            joins[i] = find(rank << 32 | ids[i + 1], NEVER)
        if i:
            joins[i - 1] = find(ids[i - 1] << 32 | rank, NEVER)
    return ids


def _merge_long(ids: list[int], joined: dict[int, int]) -> list[int]:
    """The same by a heap over a linked list, for pieces in which a rescan costs too much."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := joined.get(ids[i] << 32 | ids[j])) is not None:
            heapq.heappush(heap, (rank, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [i for i in ids if i >= 0]


class _Packed(dict):
    """Packed ids by pre-token."""

    def __init__(self, path: str):
        self.path = path

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.path)
        packed = self[piece] = pack(f"<{len(ids)}I", *ids)
        return packed


@cache
def _packer(path: str) -> _Packed:
    return _Packed(path)


@cache
def _vocabulary(path: str) -> tuple[list[bytes | None], np.ndarray]:
    """Bytes by id (null where no token has the id) and their lengths."""
    ranks = ranks_of(path)
    by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return by_id, np.array([len(t or b"") for t in by_id], np.int64)


def encode_batch(texts: list[str], path: str) -> Iterator[bytes]:
    """Packed ids of each text."""
    packer = _packer(path)
    for lo, hi in chunks(list(map(len, texts)), CHUNK):
        cut, before = pieces(texts[lo:hi])
        packed = list(map(packer.__getitem__, cut))
        for a, b in zip(before[:-1], before[1:], strict=True):
            yield b"".join(packed[a:b])
        if len(packer) > CACHED:
            packer.clear()


def offsets_of(ids: bytes, path: str) -> bytes:
    """Byte offset at which each token starts in its text, packed like the ids."""
    lengths = _vocabulary(path)[1][np.frombuffer(ids, "<u4")]
    return (np.cumsum(lengths) - lengths).astype("<u4").tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    by_id = _vocabulary(path)[0]
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: tuple[str, ...] = ("ids", "offsets"),
) -> DataFrame:
    """(id_col, ids, offsets), one row per row of ``docs``: token ids and the byte offset at which
    each token starts, as packed unsigned 32-bit integers, and, if ``parts`` asks for it,
    ``decoded``, the bytes that the ids decode to.

    Special tokens are not recognised: their strings are ordinary text. A null or empty
    text has empty ids, offsets and bytes. Repeated rows are encoded each, and no rows give none.
    ``path`` names a rank file that every executor can read.
    """
    make = {"ids": lambda ids, _: ids, "offsets": offsets_of, "decoded": decode_ids}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in pieces_of(batch.column(1), PIECE):
                ids = list(encode_batch(texts, path))
                columns = [pa.array([make[p](i, path) for i in ids], pa.binary()) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *columns], [id_col, *parts]
                )

    rows = docs.select(F.col(id_col), F.col(text_col))
    kinds = [T.StructField(id_col, rows.schema[0].dataType), *[T.StructField(p, T.BinaryType()) for p in parts]]
    return rows.mapInArrow(run, T.StructType(kinds))


def decode(ids: Column | str, path: str) -> Column:
    """The bytes that packed ids stand for; null for null ids. Ids outside the vocabulary fail."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(
                [None if i is None else decode_ids(i, path) for i in batch.to_pylist()], pa.binary()
            )

    return _arrow(run, "binary")(ids)


def _arrow(run: Callable, returns: str):
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def token_count(ids: Column) -> Column:
    """Tokens in packed ids."""
    return (F.octet_length(ids) / 4).cast("long")
