"""Token counts by rank-synchronous merging of ragged arrays.

A batch's pre-tokens (boundaries from :mod:`pretokens`) that have not been counted yet lie
behind each other in one array of symbols. In every round each sequence finds its pair of
lowest rank and joins all its occurrences from the left, all sequences at once; a sequence
without a pair that can join is finished. Its surviving symbols are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import chunks, pieces_of
from .pretokens import pieces

#: Bytes of text taken over at a time, codepoints handled at a time, pre-tokens remembered by a
#: worker, symbols merged at a time.
PIECE, CHUNK, CACHED, SYMBOLS = 4_000_000, 1_000_000, 500_000, 2_000_000
NEVER = np.iinfo(np.int32).max


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """The merges of a byte-level vocabulary file, as arrays that a batch can search."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or split["type"] != "ByteLevel":
            raise ValueError(f"{path} is no byte-level BPE vocabulary with plain merges")
        if spec.get("normalizer") or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} changes texts before it splits them")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        #: Strings that are one token wherever they stand in a text.
        self.special = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        ids = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.size = max(ids.values()) + 1
        self.first = np.array([ids[s] for _, s in sorted(_byte_signs().items())], np.int32)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of each byte sequence; none may be empty."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        counts = np.zeros(len(sequences), np.int64)
        while len(symbols):
            rank = np.full(len(symbols), NEVER, np.int32)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NEVER
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(symbols))
            done = best == NEVER
            counts[owner[starts[done]]] = sizes[done]
            joins = (rank == np.repeat(best, sizes)) & (rank != NEVER)
            joins = _leftmost(joins)
            at = np.flatnonzero(joins)
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts


def _leftmost(joins: np.ndarray) -> np.ndarray:
    """Of joins that overlap (the same symbol several times in a row) every second, from the left."""
    at = np.flatnonzero(joins)
    if not len(at):
        return joins
    run = np.cumsum(np.diff(at, prepend=at[0] - 2) != 1) - 1
    first = at[np.flatnonzero(np.diff(run, prepend=-1))]
    out = np.zeros_like(joins)
    out[at[(at - first[run]) % 2 == 0]] = True
    return out


@cache
def _merges(path: str) -> tuple[Merges, dict[str, int]]:
    return Merges(path), {}


def _split_special(texts: list[str], special: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Stretches between special strings, the number in front of each text, and the special
    strings of each text (each is one token)."""
    stretches, before, tokens = [], [0], []
    for text in texts:
        parts, hits = [text], 0
        for s in special:
            if s in text:
                split = [p.split(s) for p in parts]
                hits += sum(len(p) - 1 for p in split)
                parts = [x for p in split for x in p]
        stretches += [p for p in parts if p] or [""]
        before.append(len(stretches))
        tokens.append(hits)
    return stretches, before, tokens


def count_batch(texts: list[str], path: str) -> Iterator[int]:
    merges, known = _merges(path)
    for lo, hi in chunks(list(map(len, texts)), CHUNK):
        stretches, of_text, hits = _split_special(texts[lo:hi], merges.special)
        cut, before = pieces(stretches)
        fresh = [p for p in set(cut) if p not in known]
        raw = [p.encode() for p in fresh]
        for a, b in chunks(list(map(len, raw)), SYMBOLS):
            known.update(zip(fresh[a:b], merges.count(raw[a:b]).tolist(), strict=True))
        totals = np.concatenate(([0], np.cumsum(np.fromiter(map(known.__getitem__, cut), np.int64, len(cut)))))
        edges = totals[np.array(before)[of_text]]
        yield from (np.diff(edges) + hits).tolist()
        if len(known) > CACHED:
            known.clear()


def token_count(text: Column | str, path: str) -> Column:
    """Tokens of a text column under a byte-level BPE vocabulary file, whole texts, as long.

    Added tokens are recognised inside texts, as the library does by default; no begin or
    end token is added. A null or empty text has none. Every executor must read ``path``.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = [n for _, _, texts in pieces_of(batch, PIECE) for n in count_batch(texts, path)]
            yield pa.array(counts, pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)
