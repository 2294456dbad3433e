"""Language-model scores by prediction by partial matching, pretrained on the corpus.

The model is a byte-context trie: how often each byte follows each context of up to ``ORDER``
bytes in the training texts. A byte's probability comes from the longest context that has been
seen with it; on the way down each context adds its escape probability (method D: half a
count for every distinct byte goes to the escape), and bytes that the longer context has seen
are excluded from the counts of the shorter one. A text's score sums over its bytes and end.

Every position has a whole context (texts start after line ends), so all counts follow from
those of the longest grams. Neither these nor the word counts of the base model are ever in
one place. Each task cuts its texts into blocks and writes them, compressed, beside the
distinct grams and words that they hold; these are counted over all blocks, the answers return
to the blocks that asked, and score their texts there. Trie nodes that share the last two bytes
of context meet in one group; those of shorter contexts are at most 65,536.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, chunks, pieces_of

ORDER, SYMBOLS = 4, 256
#: Bytes of text in a block and handled at a time, distinct grams that end a block, and distinct grams that a
#: group should hold.
BLOCK, CHUNK, KEYS, GROUP = 32_000_000, 1_000_000, 600_000, 500_000
#: Keys of words have this bit; those of grams are below it.
WORD_BIT = 1 << 62
END = b"\n"


def normalised(text: str) -> bytes:
    """A-Z in lower case, words apart by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the normalised texts and the line end behind each: the byte with the
    ``ORDER`` bytes in front of it, as a number; and the number of grams of each text."""
    pad = b"\n" * ORDER
    data = np.frombuffer(pad + (b"\n" + pad).join(texts) + b"\n", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    out = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        out = out << np.uint64(8) | data[j : len(data) - ORDER + j]
    inside = np.ones(len(out), bool)
    gaps = np.cumsum(sizes + ORDER) - ORDER
    inside[(gaps[:-1, None] + np.arange(ORDER)).ravel()] = False
    return out[inside], sizes


@dataclass
class Level:
    """Contexts of one length: grams (context and byte) with counts, and for each context the sum
    and number of its counts, and the sum of the counts that its bytes have one level below."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    excluded: np.ndarray | None = None


def levels(
    keys: np.ndarray, counts: np.ndarray, highest: int, lowest: int, below: Level | None = None
) -> dict[int, Level]:
    """The trie's levels from ``highest`` down to ``lowest``, from the grams of the highest. ``below``
    is the level under the lowest, if there is one."""
    out: dict[int, Level] = {}
    for k in range(highest, lowest - 1, -1):
        short = keys & np.uint64((1 << 8 * (k + 1)) - 1)
        found, place = np.unique(short, return_inverse=True)
        sums = np.bincount(place, counts, minlength=len(found))
        contexts, of = np.unique(found >> np.uint64(8), return_inverse=True)
        out[k] = Level(found, sums, contexts, np.bincount(of, sums), np.bincount(of).astype(float))
    for k, level in out.items():
        under = out.get(k - 1, below)
        if k and under is not None:
            at = np.searchsorted(under.grams, level.grams & np.uint64((1 << 8 * k) - 1))
            of = np.searchsorted(level.contexts, level.grams >> np.uint64(8))
            level.excluded = np.bincount(of, under.counts[at], minlength=len(level.contexts))
    return out


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def log_probabilities(wanted: np.ndarray, trie: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    out = np.zeros(len(wanted))
    open_ = np.arange(len(wanted))
    less, fewer = np.zeros(len(wanted)), np.zeros(len(wanted))
    for k in range(ORDER, -1, -1):
        level = trie[k]
        short = wanted[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
        of, known = _find(level.contexts, short >> np.uint64(8))
        at, seen = _find(level.grams, short)
        if not len(level.contexts):
            continue
        total = np.where(known, level.total[of] - less[open_], 0)
        distinct = np.where(known, level.distinct[of] - fewer[open_], 0)
        useful = known & (distinct > 0)
        hit = useful & seen
        gain = np.zeros(len(open_))
        gain[hit] = np.log10((level.counts[at[hit]] - 0.5) / total[hit])
        escape = useful & ~seen
        gain[escape] = np.log10(0.5 * distinct[escape] / total[escape])
        out[open_] += gain
        if k:
            less[open_] = np.where(known, level.excluded[of], 0)
        fewer[open_] = np.where(known, level.distinct[of], 0)
        open_ = open_[~hit]
    out[open_] -= np.log10(np.maximum(1, SYMBOLS - fewer[open_]))
    return out


def word_key(word: bytes) -> int:
    """Stands for a word in joins: 62 bits of its hash, which two words of a corpus hardly share."""
    return xxhash.xxh3_64_intdigest(word) >> 2 | WORD_BIT


ROWS = "block long, key long, n long, ids array<long>, texts binary"
SCORES = (
    "id long, n_tokens long, n_known long, base_score double, score double"
)


def added(
    keys: np.ndarray, counts: np.ndarray, more: np.ndarray, times: int | np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts, and some more keys, each counted ``times``."""
    found, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
    weights = np.concatenate([counts, np.broadcast_to(times, len(more))]).astype(float)
    return found, np.bincount(place, weights, minlength=len(found)).astype(np.int64)


class _Block:
    """Texts of one block, compressed as they come, and what they ask for: sorted arrays of keys and counts."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids: list[int | None] = []
        self.blob, self.packer = [], zstandard.ZstdCompressor(level=3).compressobj()
        none = np.zeros(0, np.int64)
        self.grams, self.words = (none.astype(np.uint64), none), (none, none)

    def take(self, ids: list[int | None], texts: list[bytes], train: list[bool]) -> None:
        """Texts of ``CHUNK`` bytes at most, or one longer text."""
        made, sizes = grams(texts)
        learned = np.repeat(np.array(train), sizes)
        for part, times in ((made[learned], 1), (made[~learned], 0)):
            found, n = np.unique(part, return_counts=True)
            self.grams = added(*self.grams, found, n * times)
        del made, learned
        words: Counter[bytes] = Counter()
        for text, learn in zip(texts, train, strict=True):
            if learn:
                words.update(text.split())
            else:
                words.update(dict.fromkeys(text.split(), 0))
        words[END] += sum(train)
        named = np.fromiter(map(word_key, words), np.int64, len(words))
        self.words = added(*self.words, named, np.fromiter(words.values(), np.int64, len(words)))
        front = END if self.ids else b""
        self.blob.append(self.packer.compress(front + END.join(texts)))
        self.ids += ids
        self.size += sum(map(len, texts)) + len(texts)

    def full(self) -> bool:
        return self.size > BLOCK or len(self.grams[0]) > KEYS

    def rows(self) -> Iterator[pa.RecordBatch]:
        blob = b"".join([*self.blob, self.packer.flush()])
        yield self._asked(self.grams[0].astype(np.int64), self.grams[1])
        yield self._asked(*self.words)
        yield _record([[self.number], [None], [None], [self.ids], [blob]])

    def _asked(self, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(keys))
        return _record([np.full(len(keys), self.number), keys, n, none, none])


def _record(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    arrays = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["block", "key", "n", "ids", "texts"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, train, text) to blocks with their questions. A block is one task's texts, as many
    as fit its size; its number is the task's partition and its place there."""
    block = _Block(TaskContext.get().partitionId() << 24)
    for batch in batches:
        ids, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, texts in pieces_of(batch.column(2), CHUNK):
            block.take(ids[lo:hi], list(map(normalised, texts)), train[lo:hi])
            if block.full():
                yield from block.rows()
                block = _Block(block.number + 1)
    if block.ids:
        yield from block.rows()


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Texts are taken in lower case (A-Z) as words apart by one space, with an end behind them.
    ``score`` is log10 of the probability that the trie learned from rows with ``train`` gives
    to these bytes. base_score is that of a word model with one added count: the sum over words
    and the end (a token too) of log10((c + 1) / (N + V + 1)), where N is ``train_tokens``, V their
    distinct number, and c the token's count among them; n_known tokens have one.

    A null text counts as empty, which is an end alone; a null ``train`` as false. Rows that repeat
    are learned and scored each. Nothing to learn from leaves every byte equally likely. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
        F.col(text_col).alias("text"),
    )
    folder = posixpath.join(checkpoint_folder(spark), f"ppm-{uuid.uuid4().hex}")
    rows.mapInArrow(_ask, ROWS).write.parquet(posixpath.join(folder, "blocks"))
    blocks = spark.read.schema(ROWS).parquet(posixpath.join(folder, "blocks"))
    asked = blocks.filter("key is not null").select("block", "key", "n")
    asked.groupBy("key").agg(F.sum("n").alias("n")).write.parquet(posixpath.join(folder, "totals"))
    totals = spark.read.schema("key long, n long").parquet(posixpath.join(folder, "totals"))

    words, trie = totals.filter(F.col("key") >= WORD_BIT), totals.filter(F.col("key") < WORD_BIT)
    n, v = words.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    short = trie.filter("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n"))
    short = sorted((r.key, r.n) for r in short.collect())  # 65,536 rows at most
    groups = max(16, -(-trie.count() // GROUP))
    answers = _answers(trie, short, groups).unionByName(words.filter("n > 0").select("key", F.col("n").cast("double").alias("value")))
    replies = asked.select(F.col("block").alias("to"), "key").join(answers, "key").select("to", "key", "value")
    texts = blocks.filter("texts is not null").select("block", "ids", "texts")
    scored = texts.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(_scorer(n, v), SCORES)
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _answers(trie: DataFrame, short: list[tuple[int, int]], groups: int) -> DataFrame:
    """(key, value): log10 of the probability of every gram asked for. Grams with the same last two
    bytes of context are in one group, and so are all their contexts of two bytes and more."""
    low = levels(np.array([k for k, _ in short], np.uint64), np.array([n for _, n in short], float), 1, 0)

    def run(table: pa.Table) -> pa.Table:
        keys, n = table["key"].to_numpy().astype(np.uint64), table["n"].to_numpy()
        known = n > 0
        full = levels(keys[known], n[known].astype(float), ORDER, 2, low[1]) | low
        return pa.table({"key": table["key"], "value": pa.array(log_probabilities(keys, full))})

    group = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(groups))
    return trie.groupBy(group.alias("group")).applyInArrow(run, "key long, value double")


def _scorer(n: int, v: int):
    """Scores the texts of a block from the answers to its questions."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        key, value = replies["key"].to_numpy(), replies["value"].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        split = int(np.searchsorted(key, WORD_BIT))
        gram, chance, word, count = key[:split].view(np.uint64), value[:split], key[split:], value[split:]
        parts = []
        for ids, blob in zip(texts["ids"].to_pylist(), texts["texts"].to_pylist(), strict=True):
            at = 0
            for every in _unpacked(blob):
                columns: list = [ids[at : at + len(every)], [], [], [], []]
                made, sizes = grams(every)
                logs = chance[np.searchsorted(gram, made)]
                columns[4] = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
                del made, logs
                number: dict[bytes, int] = {}
                places = [[number.setdefault(w, len(number)) for w in (*text.split(), END)] for text in every]
                asked = np.fromiter(map(word_key, number), np.int64, len(number))
                where, known = _find(word, asked)
                c = np.where(known, count[where], 0.0) if len(count) else np.zeros(len(asked))
                chances = np.log10((c + 1) / (n + v + 1))
                for mine in places:
                    columns[1].append(len(mine))
                    columns[2].append(int((c[mine] > 0).sum()))
                    columns[3].append(float(chances[mine].sum()))
                parts.append(columns)
                at += len(every)
        names = ("id", "n_tokens", "n_known", "base_score", "score")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        arrays = [pa.chunked_array([pa.array(c, k) for c in of], k) for of, k in zip(zip(*parts), kinds, strict=True)]
        return pa.Table.from_arrays(arrays, names)

    return run


def _unpacked(blob: bytes) -> Iterator[list[bytes]]:
    """The texts of a block, some at a time; the last of what has been read may not be whole yet."""
    reader, open_ = zstandard.ZstdDecompressor().stream_reader(blob), []
    while piece := reader.read(CHUNK):
        first, *others = piece.split(END)
        open_.append(first)
        if others:
            yield [b"".join(open_), *others[:-1]]
            open_ = others[-1:]
    yield [b"".join(open_)]
