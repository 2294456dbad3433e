"""Groups spelling variants: words one edit apart, and the frequent word that each stands for.

The vocabulary is sorted and cut into slices by a range partitioning. A word visits the slices
that can hold a word near it, and meets their words in a scan of the sorted slice: the rows of
its edit matrix, three cells wide, are kept on a stack, and from one word of the slice to the next
those of the prefix that both share (their longest common prefix) are used again. All visiting
words are scanned at once; those whose row exceeds one edit leave, and where none is left, the
whole range of words with that prefix is skipped.

Two words one edit apart agree in their first or in their last half. So the vocabulary is
scanned twice, once as it is and once spelled backwards, and each time only words that begin with
the same half are compared; this also tells which slices a word must visit. Of a crowded beginning,
cut over several slices, only those are visited whose shared prefix is still within one edit.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words of a slice, slices at most (their first and last words, cut to so many code points, go to
#: every task), words that are scanned together, and so few that they are compared one by one.
SLICE, SLICES, BOUND, BATCH, FEW = 20_000, 4096, 64, 100_000, 3
#: A form occurs at least so many times as often as the word that it stands for.
TIMES = 10
TOP = chr(0x10FFFF)
VISITS, FOUND = "slice int, role int, key string, n long", "word string, n_near long, best_n long, best string"


def misspelled_runs(docs: DataFrame, one_in: int = 31, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every run of letters of at least ``least`` code points (column ``word``), A-Z in lower case. Of
    about one run in ``one_in``, told by the crc32 of ``id:run``, one code point is deleted."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("id", low.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = len(commonprefix((a, b)))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def prefix_within(prefix: str, word: str) -> bool:
    """Whether some word that begins with ``prefix`` can be within one edit of ``word``."""
    i = len(commonprefix((prefix, word)))
    if i == len(prefix) or i == len(word):
        return len(prefix) <= len(word) + 1
    rest = prefix[i:]
    return (
        word.startswith(rest[1:], i + 1) or word.startswith(rest[1:], i) or word.startswith(rest, i + 1)
        or rest[1:].startswith(word[i + 1 :]) and len(rest) <= len(word) - i + 1
        or rest[1:].startswith(word[i:]) and len(rest) <= len(word) - i + 1
    )


class Words:
    """Sorted words as one run of code points; behind each word stands no code point (-1)."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size + 3) - self.size - 2
        flat = np.full(int((self.size + 3).sum()) + 1, -1, np.int32)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat[np.repeat(self.start - np.cumsum(self.size) + self.size, self.size) + np.arange(len(codes))] = codes
        self.flat = flat


def scan(entries: list[str], asked: list[str], agree: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place in ``asked``, place in ``entries``) of all pairs one edit apart whose entry begins with the
    first ``agree`` code points of the word asked for. ``entries`` are sorted and distinct; both are not empty."""
    q = Words(asked)
    n, agree = len(asked), np.minimum(agree, q.size)
    first = (np.arange(n), np.full(n, 2, np.int8), np.zeros(n, np.int8), np.ones(n, np.int8))
    stack = [first]  # by depth: who is left, and the cells left of, on and right of the diagonal
    few: list[int] = []
    closed = -1  # depth at which few or none are left
    before = ""
    for place, word in enumerate(entries):
        shared = len(commonprefix((before, word)))
        before = word
        if 0 <= closed <= shared:
            for i in few:
                if one_edit(asked[i], word) and word.startswith(asked[i][: agree[i]]):
                    yield i, place
            continue
        closed = -1
        del stack[shared + 1 :]
        for depth in range(len(stack), len(word) + 1):
            who, left, on, right = stack[-1]
            if len(who) <= FEW:
                break
            code, at = ord(word[depth - 1]), q.start[who] + depth
            c0 = left + (q.flat[at - 2] != code)
            if depth == 1:
                c0 = np.ones_like(left)
            c0 = np.minimum(c0, on + 1)
            c1 = np.minimum(np.minimum(on + (q.flat[at - 1] != code), right + 1), c0 + 1)
            c2 = np.minimum(right + (q.flat[at] != code), c1 + 1)
            over = depth - q.size[who]  # cells beyond the word don't count
            c0[over > 1], c1[over > 0], c2[over > -1] = 2, 2, 2
            keep = (np.minimum(np.minimum(c0, c1), c2) <= 1) & ((agree[who] < depth) | (c1 == 0))
            stack.append((who[keep], c0[keep], c1[keep], c2[keep]))
        who, left, on, right = stack[-1]
        if len(who) <= FEW:
            closed, few = len(stack) - 1, who.tolist()
            for i in few:
                if one_edit(asked[i], word) and word.startswith(asked[i][: agree[i]]):
                    yield i, place
            continue
        gap = q.size[who] - len(word)
        hit = ((gap == -1) & (left == 1)) | ((gap == 0) & (on == 1)) | ((gap == 1) & (right == 1))
        for i in who[hit & (agree[who] <= len(word))].tolist():
            yield i, place


def half(length: int, backwards: bool) -> int:
    """Code points at the beginning that a word shares with a near one found in this direction."""
    return length // 2 if backwards else (length - 1) // 2


def _found_here(word: str, near: str, backwards: bool) -> bool:
    """Forwards are found the pairs whose shorter word agrees in its first half, backwards all others."""
    if backwards:
        word, near = word[::-1], near[::-1]
    return (len(commonprefix((word, near))) >= min(len(word), len(near)) // 2) != backwards


def _visits(bounds: list[tuple[str, str]], backwards: bool):
    """Every word as an entry of its slice, and as a visitor of all slices that may have words near it."""
    lows = [low for low, _ in bounds]
    shared = [commonprefix((low, high)) for low, high in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for own, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((own, 0, key, n))
                start = key[: half(len(key), backwards)]
                low = max(0, bisect_left(lows, start[:BOUND]) - 1)
                high = bisect_right(lows, (start + TOP)[:BOUND])
                for at in range(low, high):
                    if at == own or prefix_within(shared[at], key):
                        rows.append((at, 1, key, 0))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "role", "key", "n"]
            )

    return run


def _scans(backwards: bool):
    """Scans slices: rows sorted by slice, its entries in order before its visitors."""

    def scanned(entries: list[str], counts: list[int], asked: list[str]) -> pa.RecordBatch:
        agree = np.array([half(len(w), backwards) for w in asked])
        near: dict[int, list] = {}
        for i, at in scan(entries, asked, agree) if entries and asked else ():
            if _found_here(asked[i], entries[at], backwards):
                best = near.setdefault(i, [0, 0, ""])
                best[0] += 1
                word = entries[at][::-1] if backwards else entries[at]
                if (-counts[at], word) < (-best[1], best[2]):
                    best[1:] = counts[at], word
        words = [asked[i][::-1] if backwards else asked[i] for i in near]
        columns = [words, *([b[k] for b in near.values()] for k in range(3))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, entries, counts, asked = None, [], [], []
        for batch in batches:
            for at, role, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != here or len(asked) >= BATCH:
                    if asked:
                        yield scanned(entries, counts, asked)
                    asked = []
                if at != here:
                    here, entries, counts = at, [], []
                if role:
                    asked.append(key)
                else:
                    entries.append(key)
                    counts.append(n)
        if asked:
            yield scanned(entries, counts, asked)

    return run


def _near(words: DataFrame, size: int, backwards: bool) -> DataFrame:
    """(word, n_near, best_n, best): for words with near ones found in this direction their number in
    a slice and the best of them."""
    slices = max(1, min(SLICES, -(-size // SLICE)))
    keyed = words.select((F.reverse("word") if backwards else F.col("word")).alias("key"), "n")
    placed = keyed.repartitionByRange(slices, "key").select(F.spark_partition_id().alias("slice"), "key", "n")
    placed = checkpointed(placed)
    ends = [F.substring(f("key"), 1, BOUND) for f in (F.min, F.max)]
    ranges = sorted(tuple(r) for r in placed.groupBy("slice").agg(*ends).collect())  # SLICES at most
    bounds = [("", "")] * (ranges[-1][0] + 1 if ranges else 0)
    for at, low, high in ranges:
        bounds[at] = low, high
    for at in range(len(bounds)):  # an empty slice holds nothing, and begins where the one before it does
        if at not in {r[0] for r in ranges}:
            bounds[at] = (bounds[at - 1][0], bounds[at - 1][0]) if at else ("", "")
    visits = placed.mapInArrow(_visits(bounds, backwards), VISITS)
    visits = visits.repartition(slices, "slice").sortWithinPartitions("slice", "role", "key")
    return visits.mapInArrow(_scans(backwards), FOUND)


def variants(words: DataFrame) -> DataFrame:
    """``words``: distinct words and how often each occurs (word, n). Returns for each word its form, root, n,
    n_near and form_n.

    Words are near that differ by exactly one inserted, deleted or replaced code point; n_near is the number of
    near words. The form is the near word of the largest n (of equal ones the first in the order of
    code points), if that is at least ``TIMES`` the word's own n; else it is null, as is form_n. The root
    is reached by following forms from the word; it is the word itself where it has no form.

    Null words are left out. The empty word is near to all words of one code point. No rows give none.
    """
    words = checkpointed(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")))
    size = words.count()
    near = _near(words, size, False).unionByName(_near(words, size, True))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    formed = (-F.col("best.less")) >= F.col("n") * TIMES
    joined = checkpointed(joined.select(
        "word", F.when(formed, F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n"),
    ))
    roots = _roots(joined.filter("form is not null").select("word", F.col("form").alias("root")))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Where the links (word, root) lead in the end. Every round doubles the steps that a link stands for;
    as each step multiplies n, there are few."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpointed(links.join(ahead, "root", "left").select("word", "root", "next"))
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            return links


def grouped(docs: DataFrame, least: int = 7, often: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words that :func:`misspelled_runs` takes from documents at least ``often``
    times in all. A null text has no words, a null id counts as empty, repeated rows count each."""
    words = misspelled_runs(docs, least=least, id_col=id_col, text_col=text_col)
    return variants(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often))
