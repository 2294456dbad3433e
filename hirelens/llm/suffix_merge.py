"""Removes passages that stand earlier in the corpus, by merging the Burrows-Wheeler transforms of shards.

Every window of ``length`` bytes falls to the least hash of the grams in it; windows next to each
other that share it form a passage. Equal windows share the hash wherever they stand, so only
passages with equal hashes have to be compared. Three steps over blocks of whole texts do this:

1. Blocks ask, with packed arrays cut by ranges of the hash, which of their passages occur elsewhere.
   Passages equal as a whole are settled there: all but the first go. Those whose hash occurs
   with other bytes around it are still open; all others are unique.
2. The bytes of open passages go to buckets, by their hash. A bucket's passages, in the order of the documents,
   are cut into shards. Each shard sorts its own suffixes, which gives its transform. The
   transforms are merged by refining how they interleave: the order by the first h bytes gives that
   by h + t bytes if its entries are dealt, in order, by the letter of t bytes in front of them. Which neighbours
   share a prefix so long is carried along, so after ``length`` bytes the intervals of equal windows are
   there, though the suffixes of different shards have not been sorted together. All but the first go.
3. Blocks get the spans that go, and put their texts together without them.

A hash with more than ``CROWDED`` different passages (a line in very many documents) sends its open windows one
by one, each to the bucket of its own hash, so it doesn't meet in one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, pieces_of

#: Bytes of a block and of a piece hashed at a time, windows of a passage at most.
BLOCK, CHUNK, RUN = 8_000_000, 1_000_000, 256
#: Passages that a range or a bucket should hold, bytes of a shard, passages of one hash that are many.
RANGE, BUCKET, SHARD, CROWDED = 500_000, 10_000, 50_000, 2000
#: Different windows that a crowded passage is taken to have, in passages of a bucket.
WINDOWS = 20
#: Bytes of a letter, and bytes that are packed into one number at first (nine bits each, for the end of a
#: passage is one more).
LETTER, PACK = 20, 4
UNIQUE, GONE, OPEN, SINGLE = range(4)
BASE = 0xD6E8FEB86659FD93

ASKED = "range int, block long, keys binary, prints binary, ids binary, loops binary"
ANSWERS = "block long, range int, note binary, n_open long"
SHIPPED = "bucket int, id long, block long, start long, bytes binary"
TEXTS = "block long, ids array<long>, sizes array<long>, texts binary"
CUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def share(x: np.ndarray, parts: int) -> np.ndarray:
    """Evenly spread numbers to one of so many parts, in their order."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64)), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


NOTHING = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)


class Passages:
    """The passages of some texts, by their places in the joined texts: first byte, byte behind the last,
    the hash that their windows share, a hash of the bytes, and whether a window may occur twice in it. It can only
    if a gram with the shared hash begins before the last window: were it the same gram in both windows, the later
    window, which is equal, would begin with a later one."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        parts = [NOTHING]
        pieces = [
            (lo, min(len(t), lo + CHUNK + self.length - 1), base, t)
            for t, base in zip(texts, np.cumsum([0, *map(len, texts)]).tolist())
            for lo in range(0, max(1, len(t) - self.length + 1), CHUNK)
        ]
        for lo, hi in chunks([b - a for a, b, _, _ in pieces], CHUNK):
            some = [(base + a, t[a:b]) for a, b, base, t in pieces[lo:hi]]
            begin, end, *rest = self._piece([t for _, t in some])
            sizes = np.array([len(t) for _, t in some], np.int64)
            offset = np.cumsum(sizes) - sizes
            of = np.searchsorted(offset + sizes, begin, "right")
            shift = np.array([place for place, _ in some], np.int64)[of] - offset[of] if len(begin) else 0
            parts.append((begin + shift, end + shift, *rest))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _piece(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        length, gram = self.length, self.gram
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        if n < length:
            return NOTHING
        room = CHUNK + length if n <= CHUNK + length else n
        up, down, table = _powers(room)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=total[1:])
        grams = least = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        width, have = length - gram + 1, 1
        while 2 * have <= width:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        sizes = np.array(list(map(len, texts)), np.int64)
        long_enough = sizes >= length
        begins = (np.cumsum(sizes) - sizes)[long_enough]
        inside = np.zeros(n - length + 2, np.int8)
        inside[begins] += 1
        inside[begins + sizes[long_enough] - length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[:-1])
        shared = least[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (np.diff(starts) != 1) | (shared[1:] != shared[:-1])
        first = np.flatnonzero(fresh)
        run = np.diff(np.append(first, len(starts)))
        cuts = -(-run // RUN)
        if len(first) and cuts.max() > 1:
            within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = np.repeat(first, cuts) + within * RUN
            run = np.minimum(RUN, np.repeat(run, cuts) - within * RUN)
        begin = starts[first]
        last = begin + run - 1
        early = np.minimum.reduceat(grams, np.column_stack([begin, last]).ravel())[::2] if len(begin) else shared[first]
        end = last + length
        print_ = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        return begin, end, mixed(shared[first] + np.uint64(1)), print_, (early == shared[first]) & (last > begin)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Marks in sorted arrays the first of each run of equal entries."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if len(new) > 1 else True
    return new


class Block:
    """Texts of one block in the order of their ids, and its passages in the order of their hashes."""

    def __init__(self, ids: list[int | None], texts: list[bytes], passages: Passages):
        self.texts, self.passages = texts, passages
        found = passages.of(texts)
        order = np.lexsort((found[0], found[3], found[2]))
        self.begin, self.end, self.key, self.print, self.loops = (column[order] for column in found)
        self.asked = firsts(self.key, self.print)
        least = np.iinfo(np.int64).min
        numbers = np.array([least if i is None else i for i in ids], np.int64)
        behind = np.cumsum(np.array([len(t) for t in texts], np.int64))
        self.ids = numbers[np.searchsorted(behind, self.begin, "right")] if len(self.begin) else np.zeros(0, np.int64)

    def settled(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the answers say: spans that go (first byte, byte behind the last), and places in this
        block's arrays of passages that are open as a whole or window by window."""
        if len(states) != self.asked.sum():
            raise ValueError("the documents changed between two reads; write them to a table first")
        go = ~self.asked
        go[self.asked] = states == GONE
        places = np.flatnonzero(self.asked)
        return self.begin[go], self.end[go], places[states == OPEN], places[states == SINGLE]

    def open_windows(self, places: np.ndarray) -> tuple[list[tuple[int, int, bytes]], list[int]]:
        """Of the windows in crowded passages the different ones, each with its id and first place, and the
        places of those that repeat one of this block."""
        joined, length = b"".join(self.texts), self.passages.length
        seen: set[bytes] = set()
        different, again = [], []
        for i in places[np.argsort(self.begin[places])].tolist():
            for at in range(self.begin[i], self.end[i] - length + 1):
                window = joined[at : at + length]
                if window in seen:
                    again.append(at)
                else:
                    seen.add(window)
                    different.append((int(self.ids[i]), at, window))
        return different, again


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], list[bytes]]]:
    """Rows (id, text) of a task to blocks of whole texts. A block's number is the task's partition and its place there."""
    number, size = TaskContext.get().partitionId() << 24, 0
    rows: list[tuple[int | None, bytes]] = []

    def block():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        return number, [i for i, _ in rows], [t for _, t in rows]

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, hi, texts in pieces_of(batch.column(1), CHUNK):
            for ident, text in zip(ids[lo:hi], texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if rows and size + len(data) > BLOCK:
                    yield block()
                    number, size = number + 1, 0
                    rows = []
                rows.append((ident, data))
                size += len(data)
    if rows:
        yield block()


def _asker(passages: Passages, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _blocks(batches):
            block = Block(ids, texts, passages)
            columns = [c[block.asked] for c in (block.key, block.print, block.ids, block.loops)]
            part = share(columns[0], ranges)
            cuts = np.append(np.flatnonzero(firsts(part)), len(part)) if len(part) else np.zeros(0, np.int64)
            rows = [(int(part[a]), number, *(c[a:b].tobytes() for c in columns)) for a, b in pairwise(cuts.tolist())]
            yield _batch(rows, (pa.int32(), pa.int64(), *[pa.binary()] * 4), ASKED)

    return run


def _batch(rows: list[tuple], kinds: tuple, ddl: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    names = [f.split()[0] for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _answer(table: pa.Table) -> pa.Table:
    """States of the passages that blocks ask for in one range: the first of those equal as a whole stays,
    and is open where the hash occurs with other bytes, or a window may occur twice in it."""
    key, print_, ids, loops = (
        np.concatenate([np.frombuffer(b, kind) for b in table[c].to_pylist()])
        for c, kind in (("keys", np.uint64), ("prints", np.uint64), ("ids", np.int64), ("loops", bool))
    )
    blocks = table["block"].to_pylist()
    sizes = [len(b) // 8 for b in table["keys"].to_pylist()]
    block = np.repeat(np.array(blocks, np.int64), sizes)
    order = np.lexsort((block, ids, print_, key))
    first = firsts(key[order], print_[order])
    of = np.cumsum(firsts(key[order])) - 1
    different = np.bincount(of, first)[of]
    open_ = np.where(different > CROWDED, SINGLE, np.where((different > 1) | loops[order], OPEN, UNIQUE))
    state = np.where(first, open_, GONE)
    states = np.empty(len(order), np.uint8)
    states[order] = state
    cuts = np.cumsum([0, *sizes]).tolist()
    notes = [states[a:b] for a, b in pairwise(cuts)]
    n_open = [int((n == OPEN).sum() + WINDOWS * (n == SINGLE).sum()) for n in notes]
    return pa.table({
        "block": table["block"], "range": table["range"], "note": pa.array([n.tobytes() for n in notes], pa.binary()),
        "n_open": pa.array(n_open, pa.int64()),
    })


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, ids, texts in _blocks(batches):
        blob = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        yield _batch([(number, ids, list(map(len, texts)), blob)], kinds, TEXTS)


def _unpacked(table: pa.Table) -> Iterator[tuple[int, list[int | None], list[bytes]]]:
    for number, ids, sizes, blob in zip(*(table[c].to_pylist() for c in ("block", "ids", "sizes", "texts")), strict=True):
        joined = zstandard.ZstdDecompressor().decompress(blob) if sum(sizes) else b""
        yield number, ids, [joined[a:b] for a, b in pairwise(np.cumsum([0, *sizes]).tolist())]


def _states(notes: pa.Table) -> np.ndarray:
    """The answers of all ranges behind each other; spans have no range."""
    found = sorted((r, n) for r, n in zip(notes["range"].to_pylist(), notes["note"].to_pylist(), strict=True) if r >= 0)
    return np.frombuffer(b"".join(n for _, n in found), np.uint8)


def _shipper(passages: Passages, buckets: int):
    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        for number, ids, data in _unpacked(texts):
            block, joined = Block(ids, data, passages), b"".join(data)
            _, _, whole, crowded = block.settled(_states(notes))
            into = share(mixed(block.key[whole]), buckets)
            for part, who, a, b in zip(
                into.tolist(), block.ids[whole].tolist(), block.begin[whole].tolist(), block.end[whole].tolist(), strict=True
            ):
                rows.append((part, who, number, a, joined[a:b]))
            if len(crowded):
                for who, a, window in block.open_windows(crowded)[0]:
                    hashed = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest())
                    rows.append((hashed * buckets >> 64, who, number, a, window))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_batches([_batch(rows, kinds, SHIPPED)])

    return run


def numbered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The pairs of two arrays numbered from 0, in order; equal pairs have one number."""
    n = len(high)
    bits, width = n.bit_length(), int(low.max()).bit_length()
    if int(high.max()).bit_length() + width + bits > 64:
        return np.unique(np.column_stack([high, low]), axis=0, return_inverse=True)[1].ravel()
    pairs = (high.astype(np.uint64) << np.uint64(width) | low.astype(np.uint64)) << np.uint64(bits)
    pairs |= np.arange(n, dtype=np.uint64)
    pairs.sort()
    place = (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)
    out = np.empty(n, np.int64)
    out[place] = np.cumsum(firsts(pairs >> np.uint64(bits))) - 1
    return out


class Transforms:
    """The Burrows-Wheeler transforms of shards of texts: of each shard the places of its suffixes, sorted, and
    before each the letter. A letter is a run of ``LETTER`` bytes, numbered in order."""

    def __init__(self, texts: list[bytes], shard: np.ndarray, length: int):
        """``shard`` numbers the shard of each text, ascending. Suffixes are sorted by ``length`` bytes, those equal
        so far by their places; behind a text's end nothing comes."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.last = np.repeat(np.cumsum(sizes) - 1, sizes)
        self.shard = np.repeat(shard, sizes)
        self.place = np.arange(len(self.last))
        self.length, self.step = length, min(LETTER, length)
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        data[np.cumsum(sizes) - 1] = 0
        have, letter = min(PACK, self.step), data
        for k in range(1, have):
            letter = letter << 9 | data[self.ahead(k)]
        letter = numbered(letter, np.zeros(1, np.int64))
        while have < self.step:
            more = min(have, self.step - have)
            letter, have = numbered(letter, letter[self.ahead(more)]), have + more
        # From here on the shard comes first, so the suffixes of two shards are never compared.
        rank = numbered(self.shard, letter)
        while have < length:
            more = min(have, length - have)
            rank, have = numbered(rank, rank[self.ahead(more)]), have + more
        self.letter, self.order = letter, np.argsort(rank, kind="stable")
        self.at = np.empty_like(self.order)
        self.at[self.order] = self.place

    def ahead(self, steps: int) -> np.ndarray:
        return np.minimum(self.place + steps, self.last)

    def suffixes(self, places: np.ndarray) -> np.ndarray:
        """Some places in the order of the shards and of the suffixes of each."""
        return self.order[np.sort(self.at[places])]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of all windows of ``length`` bytes, sorted over all shards, and the number of the interval of
        equal windows that each is in.

        It begins with the places behind the windows, one shard's after the other's, and goes back letter by letter
        to where the windows begin. The interleave only tells whose turn it is: its k-th entry of a shard is the k-th
        of that shard's suffixes."""
        windows = np.flatnonzero(self.place + self.length <= self.last)
        n, done = len(windows), 0
        here = self.suffixes(windows + self.length)
        source, interval = self.shard[here].astype(np.int32), np.zeros(n, np.int32)
        source = source.astype(np.uint16) if n and source[-1] < 1 << 16 else source
        count, bits = np.arange(n), n.bit_length()
        which = count
        while done < self.length:
            step = min(self.step, self.length - done)
            dealt = self.letter[here - step][which] << bits | count
            dealt.sort()
            came = dealt & ((1 << bits) - 1)
            source, interval = source[came], np.cumsum(firsts(dealt >> bits, interval[came])) - 1
            done += step
            here = self.suffixes(windows + self.length - done)
            which = np.empty(n, np.int64)
            which[np.argsort(source, kind="stable")] = count
        return here[which], interval


def repeated(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(number of the text, first byte, byte behind the last) of spans in which every window of ``length``
    bytes stands earlier in these texts, in the order of texts and places."""
    if not any(len(t) >= length for t in texts):
        return
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    shard = (np.cumsum(sizes) - sizes) // SHARD
    places, interval = Transforms(texts, np.cumsum(firsts(shard)) - 1, length).merged()
    least = np.full(interval[-1] + 1, sizes.sum())
    np.minimum.at(least, interval, places)
    again = np.sort(places[places != least[interval]])
    if not len(again):
        return
    number = np.searchsorted(np.cumsum(sizes), again, "right")
    start = again - (np.cumsum(sizes) - sizes)[number]
    new = firsts(number, start - np.arange(len(start)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    yield from zip(number[first].tolist(), start[first].tolist(), (start[last] + length).tolist(), strict=True)


def _merger(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids, blocks, starts = (table[c].to_numpy() for c in ("id", "block", "start"))
        order = np.lexsort((starts, blocks, ids))
        data = table["bytes"].to_pylist()
        spans: dict[int, list[int]] = {}
        for number, a, b in repeated([data[i] for i in order.tolist()], length):
            row = order[number]
            spans.setdefault(int(blocks[row]), []).extend((int(starts[row]) + a, int(starts[row]) + b))
        notes = [(block, -1, np.array(s, np.int64).tobytes(), 0) for block, s in spans.items()]
        return pa.Table.from_batches([_batch(notes, (pa.int64(), pa.int32(), pa.binary(), pa.int64()), ANSWERS)])

    return run


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as runs that don't touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(begin) else end


def _cutter(passages: Passages):
    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        for _, ids, data in _unpacked(texts):
            block = Block(ids, data, passages)
            begin, end, _, crowded = block.settled(_states(notes))
            told = [n for r, n in zip(notes["range"].to_pylist(), notes["note"].to_pylist(), strict=True) if r < 0]
            spans = np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)
            begin, end = [begin, spans[:, 0]], [end, spans[:, 1]]
            if len(crowded):
                again = np.array(block.open_windows(crowded)[1], np.int64)
                begin, end = [*begin, again], [*end, again + passages.length]
            begin, end = np.concatenate(begin), np.concatenate(end)
            offset = np.cumsum([0, *map(len, data)])
            of = np.searchsorted(offset[1:], begin, "right")
            by_text = np.split(np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(1, len(data))))
            for ident, text, base, mine in zip(ids, data, offset.tolist(), by_text, strict=False):
                lows, highs = _runs(begin[mine] - base, end[mine] - base)
                kept, at = hashlib.sha256(), 0
                for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                    kept.update(text[at:low])
                    at = high
                kept.update(text[at:])
                rows.append((ident, len(text), int((highs - lows).sum()), len(lows), kept.hexdigest()))
        kinds = (*[pa.int64()] * 4, pa.string())
        return pa.Table.from_batches([_batch(rows, kinds, CUT)])

    return run


def remove_repeats(
    docs: DataFrame, length: int = 100, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``.

    From the UTF-8 bytes of every text goes each byte that is covered by ``length`` bytes that also stand
    earlier: in a row of a smaller id, or earlier in the same text, overlaps too. n_spans counts the runs
    that go, and kept_sha256 is the digest of what is left.

    A null text is empty, a row without an id comes before all others. Rows that share an id come in the
    order in which the table is read, and each has a result of its own; so of rows that repeat, the
    first keeps what the others lose. Texts shorter than ``length`` lose nothing. An empty table gives an empty
    result. ``docs`` is read three times and must give the same rows in the same order, as files
    do; otherwise an error is raised.
    """
    spark = docs.sparkSession
    passages = Passages(length, gram or max(1, length * 2 // 5))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, total // 30 // RANGE + 1)
    asked = rows.mapInArrow(_asker(passages, ranges), ASKED)
    answers = checkpointed(asked.groupBy("range").applyInArrow(_answer, ANSWERS))

    shipped = answers.agg(F.coalesce(F.sum("n_open"), F.lit(0))).first()[0]
    texts = rows.mapInArrow(_texts, TEXTS)
    open_ = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _shipper(passages, max(1, -(-shipped // BUCKET))), SHIPPED
    )
    spans = open_.groupBy("bucket").applyInArrow(_merger(length), ANSWERS)
    notes = answers.unionByName(spans)
    cut = texts.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_cutter(passages), CUT)
    return cut.withColumnRenamed("id", id_col)
