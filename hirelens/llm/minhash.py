"""Near duplicates by MinHash with sequential Bayesian verification.

Texts with the same set of word shingles form a class with a number of its own, which one
document represents. All below goes by classes, not by ids, as rows that share an id may
differ in their texts.
Signatures of the representatives are cut into bands; classes that agree in a band are
candidates. A candidate's signatures are compared in batches; after each batch it is
dropped when the posterior probability that its similarity reaches the threshold is below
the chosen miss probability. What survives is verified on the full sets.

Classes of one band are first compared with one of them (a star, linear in the group).
Only where a group then still holds several components are other pairs compared, inside
tasks over blocks of the group, and only those across components: links between classes
of one component cannot change the result.

Only what is dear and read more than once, or numbered, is written to the checkpoint folder: every
file there costs its executor, on a local file system, the start of several processes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among, checkpointed, chunks, pieces_of
from .components import EDGE, components, contract

HASHES, ROWS, BATCH = 128, 5, 32
#: Probability with which a pair at the threshold may be dropped by its signatures.
MISS = 1e-6
#: Bytes of text handled at a time; members of a group compared in one task.
CHUNK, BLOCK = 200_000, 512
#: Pairs of signatures compared at a time.
PAIRS = 1 << 16
MASK = (1 << 64) - 1


@cache
def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base = int(_random(1, 1)[0]) | 1
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, x & MASK, np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``words`` words. A-Z are
    lower-cased; words lie between white space (9 to 13 and 32). A text with fewer words
    is one shingle; one without words has none."""
    for lo, hi in chunks(list(map(len, texts)), CHUNK):
        yield from _hashed([t.encode("utf-8", "surrogatepass").lower().split() for t in texts[lo:hi]], words)


def _hashed(split: list[list[bytes]], words: int) -> Iterator[np.ndarray]:
    lengths = np.fromiter((len(w) for ws in split for w in ws), np.int64)
    joined = np.frombuffer(b" ".join(w for ws in split for w in ws) + b" ", np.uint8)
    up, down = _powers(1 << max(18, len(joined).bit_length()))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_random(2, 256)[joined] * up[: len(joined)], out=sums[1:])
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    at = 0
    for ws in split:
        n = len(ws)
        if n:
            k = min(words, n)
            a, b = starts[at : at + n - k + 1], ends[at + k - 1 : at + n]
            yield np.unique(_mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        else:
            yield np.empty(0, np.uint64)
        at += n


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of the hash functions over each set, which must not be empty."""
    factors, offsets = _random(3, HASHES) | np.uint64(1), _random(4, HASHES)
    out = np.empty((len(sets), HASHES), np.uint32)
    for lo, hi in chunks(list(map(len, sets)), 1 << 15):
        values = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        hashed = np.empty_like(values)
        for j in range(HASHES):
            np.multiply(values, factors[j], out=hashed)
            hashed += offsets[j]
            out[lo:hi, j] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    count = HASHES // ROWS
    parts = signature[:, : count * ROWS].reshape(len(signature), count, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(signature), count))
    for j in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


@cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For each number of compared hashes, a multiple of the batch, the fewest that must agree.

    With a uniform prior, m agreements among n leave a similarity of t or more with the
    probability that of n + 1 trials of chance t at most m succeed."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def may_match(
    left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int, miss: float
) -> np.ndarray:
    """Positions of the pairs (row x of left, row y of right) that no batch drops."""
    out = []
    for lo in range(0, len(x), PAIRS):
        alive = np.arange(lo, min(lo + PAIRS, len(x)))
        agreed = np.zeros(len(alive), np.int64)
        for i, least in enumerate(least_matches(percent, miss)):
            part = slice(i * BATCH, (i + 1) * BATCH)
            agreed += (left[:, part][x[alive]] == right[:, part][y[alive]]).sum(1)
            keep = agreed >= least
            alive, agreed = alive[keep], agreed[keep]
        out.append(alive)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _annotated(run, inputs: int = 1):
    if inputs == 1:
        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    else:
        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return run


def _key(shingles: np.ndarray) -> bytes:
    """The hash that tells a shingle set from others."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(id, mark, n, key, signature) of rows (id, text, mark): the size of the shingle set, a hash of
    the set, and its signature, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in pieces_of(batch.column(1), CHUNK):
                sets = list(shingle_sets(part, words))
                full = [s for s in sets if len(s)]
                made = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array(map(_key, sets), pa.binary()),
                        pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "mark", "n", "key", "signature"],
                )

    return texts.mapInArrow(run, "id long, mark long, n long, key binary, signature binary")


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_keys(signature: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys = _bands(_signature_matrix(batch)) if len(batch) else np.empty((0, HASHES // ROWS), np.int64)
            edges = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.ravel()))

    return F.arrow_udf(_annotated(run), "array<long>")(signature)


def survives(left: Column, right: Column, percent: int, miss: float) -> Column:
    """Whether two signatures stay candidates after every batch."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b in batches:
            found, every = np.zeros(len(a), bool), np.arange(len(a))
            found[may_match(_signature_matrix(a), _signature_matrix(b), every, every, percent, miss)] = True
            yield pa.array(found)

    return F.arrow_udf(_annotated(run, 2), "boolean")(left, right)


def packed_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, key, x) of rows (id, text) with words: the hash of the shingle set, and the set as packed
    numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in pieces_of(batch.column(1), CHUNK):
                sets = list(shingle_sets(part, words))
                columns = [pa.array(map(_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["id", "key", "x"])

    return texts.mapInArrow(run, "id long, key binary, x binary").filter(F.octet_length("x") > 0)


def _sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, x): the packed sets of the given classes. A representative's texts of another class are
    left out by their keys."""
    wanted = among(classes, "node", nodes).select(F.col("rep").alias("id"), "key", "node")
    sets = packed_sets(among(texts, "id", wanted.select("id").distinct()).select("id", "text"), words)
    return sets.dropDuplicates(["id", "key"]).join(wanted, ["id", "key"]).select("node", "x")


def similar_pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Of pairs with their packed sets (a, b, x_a, x_b) those (a, b) with 100 * intersection >= percent *
    union, each partition's as a forest: the same nodes hang together, by as few links as that takes."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in batches:
            out = []
            for x, y in zip(pairs.column(2), pairs.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pairs.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return contract(similar(batches))

    return joined.select("a", "b", "x_a", "x_b").mapInArrow(run, EDGE)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    miss: float = MISS,
    detail: bool = False,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per row of ``docs``.

    Documents with 100 * shingles in common >= percent * shingles of both link; component_id
    is the smallest id that links lead to, the document's own included, and kept says that
    it is the document's own. Null and empty texts, and texts of white space, have no
    shingles and link with nothing. Rows that share an id are documents of their own, each
    linked by its own text; the shared id alone links nothing. Rows without an id link with nothing,
    have a null component and are kept. An empty table gives an empty result.

    With ``detail`` two columns follow: group, a number that rows have in common if and only if
    links lead from one to the other (null without shingles or id; not the same in another run),
    and mark, the xxhash64 of the text (null as empty), which tells rows of one id apart.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "mark", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    sketched = checkpointed(sketches(texts, words))
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    signed = sketched.filter("id is not null and n > 0").withColumn("place", first).filter("place = 1")
    signed = signed.select(F.col("id").alias("rep"), "key", "signature")
    signed = checkpointed(signed.withColumn("node", F.monotonically_increasing_id()))
    classes, signed = signed.select("key", "rep", "node"), signed.select("node", "rep", "signature")
    banded = signed.select("node", "rep", F.explode(band_keys(F.col("signature"))).alias("band"))
    groups = banded.groupBy("band").agg(F.min_by("node", "rep").alias("centre"), F.count("*").alias("n"))
    grouped = checkpointed(banded.drop("rep").join(groups.filter("n > 1"), "band"))

    stars = grouped.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars, signed = checkpointed(stars), signed.drop("rep")
    needed = among(signed, "node", _ends(stars)).select("node", "signature")
    a, b = (needed.toDF(x, f"s_{x}") for x in "ab")
    likely = stars.join(a, "a").join(b, "b").filter(survives(F.col("s_a"), F.col("s_b"), percent, miss))
    links = _verified(likely.select("a", "b"), classes, texts, words, percent)
    first = checkpointed(components(links, contracted=True))

    more = checkpointed(_across(grouped, first, signed, classes, texts, words, percent, miss))
    if not more.isEmpty():
        first = checkpointed(components(first.select("id", "component").union(more)))
    found = _result(sketched, classes, first, id_col)
    return found if detail else found.drop("group", "mark")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links, a forest for each partition, between classes whose full sets are similar enough."""
    pairs = checkpointed(pairs)
    sets = checkpointed(_sets_of(_ends(pairs), classes, texts, words))
    a, b = sets.toDF("a", "x_a"), sets.toDF("b", "x_b")
    return similar_pairs(pairs.join(a, "a").join(b, "b"), percent)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).distinct().toDF("id")


def _across(
    grouped: DataFrame,
    found: DataFrame,
    signed: DataFrame,
    classes: DataFrame,
    texts: DataFrame,
    words: int,
    percent: int,
    miss: float,
) -> DataFrame:
    """Links (a, b) between classes of one band group but of different components.

    A group is cut into blocks, and every two blocks are a task. The tasks first say by the
    signatures alone which classes have a candidate there; only the full sets of these are
    sent to the same task again, which compares the candidates' sets. Neither time does a pair
    leave a task that is no link."""
    placed = grouped.join(found, grouped["node"] == found["id"], "left").select(
        "band", "node", "n", F.coalesce("component", "node").alias("component")
    )
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = checkpointed(placed.join(mixed.filter("low != high").select("band"), "band", "left_semi"))
    signed = among(signed, "node", placed.select("node").distinct()).select("node", "signature")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # Signatures meet a class once a group, before it is dealt to the tasks of the group.
    placed = placed.join(signed, "node").select(
        "band", "node", "component", "signature", blocks.alias("blocks"), own.alias("own")
    )
    tasks = placed.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "own", "signature"
    )

    def candidates(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x, y = _compared(rows, starts, percent, miss)
        kept = rows.select(GROUPED).take(np.unique(np.concatenate((x, y)))).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], GROUPED)

    def links(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        return _linked(rows, *_compared(rows, starts, percent, miss), percent)

    kinds = "band long, i int, j int, node long, component long, own int"
    needed = checkpointed(_by_group(tasks, candidates, kinds))
    sets = _sets_of(needed.select("node").distinct(), classes, texts, words)
    full = needed.join(sets.join(signed, "node"), "node")
    return _by_group(full, links, "a long, b long").distinct()


#: Columns of a class in a task.
GROUPED = ["band", "i", "j", "node", "component", "own"]


def _by_group(rows: DataFrame, work, kinds: str) -> DataFrame:
    """Apply ``work`` to the rows of whole (band, i, j) groups, as many as an Arrow batch ends."""
    rows = rows.select(*GROUPED, *[c for c in ("signature", "x") if c in rows.columns])
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = _group_starts(table)
            if len(starts) > 1:
                yield work(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])
        if rest is not None:
            yield work(rest, np.zeros(1, np.int64))

    return rows.mapInArrow(run, kinds)


def _group_starts(rows: pa.Table) -> np.ndarray:
    """Where a new (band, i, j) begins."""
    new = np.ones(rows.num_rows, bool)
    columns = [rows[c].to_numpy() for c in ("band", "i", "j")]
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _compared(rows: pa.Table, starts: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each group's pairs across components those that no batch drops, as row numbers. A pair
    that meets in several bands belongs to the first of them."""
    node, comp, own, i, j, band = (rows[c].to_numpy() for c in ("node", "component", "own", "i", "j", "band"))
    marks = _signature_matrix(rows["signature"])
    keys = _bands(marks)
    kept, waiting, size = [np.zeros((2, 0), np.int64)], [], 0

    def flush() -> None:
        if waiting:
            x, y = np.concatenate(waiting, axis=1)
            for lo in range(0, len(x), PAIRS):
                at, to = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
                first = (keys[at] == keys[to]).argmax(axis=1)
                here = keys[at, first] == band[at]
                at, to = at[here], to[here]
                found = may_match(marks, marks, at, to, percent, miss)
                kept.append(np.stack((at[found], to[found])))
            waiting.clear()

    for a, b in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
        left = np.flatnonzero(own[a:b] == i[a]) + a
        right = left if i[a] == j[a] else np.flatnonzero(own[a:b] == j[a]) + a
        for part in np.array_split(left, max(1, len(left) * len(right) // PAIRS)):
            differ = comp[part][:, None] != comp[right]
            x, y = np.nonzero(differ & (node[part][:, None] < node[right]) if i[a] == j[a] else differ)
            waiting.append(np.stack((part[x], right[y])))
            size += len(x)
            if size > PAIRS:
                flush()
                size = 0
    flush()
    x, y = np.concatenate(kept, axis=1)
    return x, y


def _linked(rows: pa.Table, x: np.ndarray, y: np.ndarray, percent: int) -> pa.RecordBatch:
    """Of candidate pairs (row numbers) those whose sets, column x, are similar enough."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    node, packed = rows["node"].to_numpy(), rows["x"].to_pylist()
    firsts = np.flatnonzero(np.diff(x, prepend=-1))
    out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    for a, b in zip(firsts, np.append(firsts[1:], len(x)), strict=True):
        mine = np.frombuffer(packed[x[a]], np.uint64)
        for lo, hi in chunks([len(packed[k]) for k in y[a:b]], CHUNK):
            others = y[a + lo : a + hi]
            sizes = np.array([len(packed[k]) for k in others]) // 8
            values = np.frombuffer(b"".join(packed[k] for k in others), np.uint64)
            at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
            both = np.add.reduceat(mine[at] == values, np.cumsum(sizes) - sizes, dtype=np.int64)
            near = 100 * both >= percent * (len(mine) + sizes - both)
            out.append(np.stack((np.full(near.sum(), node[x[a]]), node[others[near]])))
    pairs = np.concatenate(out, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], ["a", "b"])


def _result(sketched: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows with the components of their classes; a component is named by its smallest id, once
    for all its classes."""
    linked = checkpointed(classes.join(found, classes["node"] == found["id"]).select("key", "rep", "component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.select("key", "component").join(least, "component")
    final = classes.join(linked, "key", "left").select(
        "key", F.coalesce("component", "node").alias("group"), F.coalesce("least", "rep").alias("component_id")
    )
    alone = sketched["id"].isNull() | (sketched["n"] == 0)
    rows = sketched.select("id", "mark", "n", F.when(~alone, F.col("key")).alias("key"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.join(final, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        "group",
        "mark",
    )
