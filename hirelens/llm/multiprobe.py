"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by several random projections (Gaussian, hence 2-stable) cut into
cells. A query visits its own bucket and perturbed ones, in the order of the estimated chance
that a near vector lies there, until that chance reaches the chosen success. Candidates of all
tables merge, and exact inner products rank them.

Largest inner product is nearness on a sphere: vectors get one more component that makes all
norms equal. How far a near vector's projection lies from the query's is estimated for each query
by its neighbours in a bounded sample of vectors; with a small chance a near vector lies as any
other does, so every bucket can be reached. Equal vectors are one candidate with the smallest
ids that a result can hold, so a vector with a third of all rows costs no more than any other.

Buckets are dealt to shards, those with many entries in several parts, and every query travels
once to each shard that holds a part of what it probes. The queries of a shard are cut into
blocks, each compared by a task of its own, so neither a crowded bucket nor many queries make a
task grow with the input. A query
that finds fewer than the number asked for, or would have to visit very many buckets, is compared
with all vectors, shard by shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Tables, the width of a cell in standard deviations of a projection, vectors a bucket should
#: hold, and the share of near pairs of the sample that the probes must meet.
TABLES, WIDTH, BUCKET, SUCCESS, SEED = 2, 1.2, 24, 0.97, 11
#: Vectors that the index is fitted on, those of the smallest hash of their id; of these, the
#: queries that the length of probing is fitted on at each level, and their nearest; entries of
#: a shard.
SAMPLE, TRIED, NEAR, SHARD = 2048, 128, 4, 65_536
#: Cosines of a query with its near vectors between which the length of probing is fitted by itself;
#: the chance that a near vector's projection lies as any vector's does.
LEVELS, STRAY = (0.3, 0.6, 0.9), 0.01
#: Buckets of a table, and vectors for one more, beyond which a query is compared with all vectors.
MOST, PER_BUCKET = 1 << 16, 256
#: Entries of a bucket that stay together; queries of a task; queries by which the number of visits
#: to a shard is estimated.
PART, BLOCK, SEEN = 16_384, 4_096, 512
#: Queries whose scores a shard holds at a time.
ASKED = 128


def valid(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _on_sphere(x: np.ndarray, norm: float, asked: bool) -> np.ndarray:
    """Vectors of unit length with one more component: what a vector lacks to the largest norm, but
    none for a query, whose length does not matter. Inner products then rank as cosines do."""
    if asked:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.pad(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), ((0, 0), (0, 1)))
    x = x / norm
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))), axis=1)


@dataclass
class Index:
    """Projections of all tables, in the scaled space in which every norm is 1."""

    norm: float
    projections: np.ndarray
    shifts: np.ndarray
    reach: int
    sample: np.ndarray
    place: int
    most: int
    targets: tuple[float, ...] = (1.0,) * (len(LEVELS) + 1)

    @property
    def hashes(self) -> int:
        return self.projections.shape[1]

    def project(self, x: np.ndarray, asked: bool) -> np.ndarray:
        """(rows, tables, hashes): projections of vectors on the sphere."""
        return np.einsum("nd,thd->nth", _on_sphere(x, self.norm, asked), self.projections)

    def cells(self, projected: np.ndarray) -> np.ndarray:
        cut = np.floor((projected + self.shifts) / WIDTH).astype(np.int64)
        return np.clip(cut, -self.reach, self.reach - 1) + self.reach

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table."""
        base = 2 * self.reach
        return self.cells(self.project(x, False)) @ (base ** np.arange(self.hashes)) * TABLES + np.arange(TABLES)

    def probes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the buckets to visit, until each table's chance is reached; none if these
        are so many that it is better compared with all vectors."""
        for lo in range(0, len(x), ASKED):
            pulls = self.pulls(x[lo : lo + ASKED])
            for tables, pull in zip(self.chances(x[lo : lo + ASKED], pulls), pulls, strict=True):
                target, found = self.targets[_level(pull)], []
                for t, c in enumerate(tables):
                    some = [b * TABLES + t for b, _ in islice(_by_chance(c, target, 2 * self.reach), self.most + 1)]
                    found = found + some if len(some) <= self.most else None
                    if found is None:
                        break
                yield np.array(found or (), np.int64)

    @cached_property
    def _sampled(self) -> tuple[np.ndarray, dict[bytes, int]]:
        return _on_sphere(self.sample, self.norm, False), {(v + 0.0).tobytes(): i for i, v in enumerate(self.sample)}

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """With each vector of the sample, but none with the query's own."""
        points, names = self._sampled
        out = _on_sphere(x, self.norm, True) @ points.T
        for row, v in zip(out, x, strict=True):
            own = names.get((v + 0.0).tobytes())
            if own is not None:
                row[own] = -np.inf
        return out

    def pulls(self, x: np.ndarray) -> np.ndarray:
        """The cosine of each query with the last of its near vectors in the sample."""
        if not self.place:
            return np.zeros(len(x))
        return np.clip(np.partition(self.cosines(x), -self.place, axis=1)[:, -self.place], 0.0, 0.999)

    def chances(self, x: np.ndarray, pulls: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each query and table, the chance of each cell of each projection to hold a near one."""
        for row, pull in zip(self.project(x, True), pulls, strict=True):
            spread = sqrt(1 - pull * pull)
            yield [
                (1 - STRAY) * self._cell_chance(row[t] * pull + self.shifts[t], spread) + STRAY * self._any[t]
                for t in range(TABLES)
            ]

    @cached_property
    def _any(self) -> list[np.ndarray]:
        """The chance of each cell to hold any vector; none is 0."""
        return [self._cell_chance(shifts, 1.0) for shifts in self.shifts]

    def _cell_chance(self, centre: np.ndarray, spread: float) -> np.ndarray:
        edges = np.arange(-self.reach, self.reach + 1) * WIDTH
        z = (edges - centre[:, None]) / (spread * sqrt(2))
        z[:, 0], z[:, -1] = -np.inf, np.inf
        return np.diff(np.vectorize(erf)(z), axis=1) / 2


def _level(pull: float) -> int:
    return int(np.searchsorted(LEVELS, pull, side="right"))


def _by_chance(chance: np.ndarray, target: float, base: int) -> Iterator[tuple[int, float]]:
    """Buckets in descending order of the product of their cells' chances, until their sum reaches
    the target, and the sum before each: a heap of perturbations, each made from another by
    moving on in one projection. A target of 1 is reached by all buckets only."""
    hashes, cells = chance.shape
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.take_along_axis(chance, order, axis=1).tolist()
    factor = [base**h for h in range(hashes)]
    steps = (order * np.array(factor)[:, None]).tolist()
    start = 1.0
    for h in range(hashes):
        start *= ranked[h][0]
    heap = [(-start, sum(s[0] for s in steps), (0,) * hashes, 0)]
    total = 0.0
    while heap and (total < target or target >= 1):
        negative, bucket, at, last = heapq.heappop(heap)
        yield bucket, total
        total -= negative
        for h in range(last, hashes):
            i = at[h]
            if i + 1 < cells and ranked[h][i + 1] > 0:
                value = negative / ranked[h][i] * ranked[h][i + 1]
                heapq.heappush(heap, (value, bucket - steps[h][i] + steps[h][i + 1], (*at[:h], i + 1, *at[h + 1 :]), h))


def fit(vectors: DataFrame, count: int, near: int) -> Index:
    """Choose projections for ``count`` distinct vectors; ``near`` is how many neighbours count."""
    norm = vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    picked = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("x").collect()
    sample = np.array([r.x for r in picked], np.float64)
    norm = sqrt(norm) * (1 + 1e-9)
    hashes = max(1, round(np.log2(max(2, count / BUCKET)) / 1.9))
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1] + 1
    projections = rng.normal(size=(TABLES, hashes, dim))
    # The near-th best of all vectors stands in the sample at its share of the rank.
    rank = max(1, round(near * len(sample) / max(1, count)))
    place = min(len(sample) - 1, max(rank, NEAR))
    index = Index(norm, projections, rng.uniform(0, WIDTH, (TABLES, hashes)), 4, sample, place, max(MOST, count // PER_BUCKET))
    if place:
        index.targets = _targets(index)
    return index


def _targets(index: Index) -> tuple[float, ...]:
    """For each level the estimated chance up to which its queries must probe so that, in the sample,
    the share SUCCESS of near pairs meets in a table; for a level without queries the largest."""
    pulls, buckets = index.pulls(index.sample), index.buckets(index.sample)
    levels = np.array([_level(p) for p in pulls])
    found = {}
    for level in np.unique(levels):
        tried = np.flatnonzero(levels == level)[:TRIED]
        found[level] = _target(index, tried, pulls[tried], buckets)
    return tuple(found.get(level, max(found.values())) for level in range(len(LEVELS) + 1))


def _target(index: Index, tried: np.ndarray, pulls: np.ndarray, buckets: np.ndarray) -> float:
    x, needed = index.sample[tried], []
    order = np.argsort(-index.cosines(x), axis=1)[:, : index.place]
    for tables, near in zip(index.chances(x, pulls), order, strict=True):
        least = np.ones(len(near))
        for t, chance in enumerate(tables):
            missing = {}
            for i, bucket in enumerate(buckets[near, t]):
                missing.setdefault(int(bucket) // TABLES, []).append(i)
            for bucket, before in islice(_by_chance(chance, 1.0, 2 * index.reach), index.most):
                for i in missing.pop(bucket, ()):
                    least[i] = min(least[i], before)
                if not missing:
                    break
        needed += least.tolist()
    return min(1.0, float(np.quantile(needed, SUCCESS)) + 1e-9)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``queries`` selects, the ``k`` nearest found
    among all rows but the query's own, by the largest inner product, in double precision.

    Rows whose id is null, or whose vector is null, zero, or holds null or non-finite components,
    take no part; vectors are compared with those of the same length only. Equal scores go by
    the smaller id. Rows that repeat an id are one candidate each time their vector differs;
    as queries the one with the smallest vector counts. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & valid(F.col("x")))
    parts = [r.n for r in rows.select(F.size("x").alias("n")).distinct().collect()]
    found = [_nearest(rows.filter(F.size("x") == n), k) for n in sorted(parts)]
    if not found:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    # Only the k + 1 smallest ids of equal vectors can be in a result.
    first = _first(rows.select("x", "id").distinct(), ["x"], ["id"], k + 1)
    classes = first.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = checkpointed(classes.withColumn("rep", F.col("ids")[0]))
    asked = checkpointed(rows.filter("asked").groupBy("id").agg(F.min("x").alias("x")))
    count = classes.count()
    index = fit(classes, count, k)
    shards = max(1, -(-count * TABLES // SHARD))
    parts = _parts(classes, index, count)
    entries = classes.select("rep", "x", F.explode(_buckets(index, shards, parts)(F.col("x"), F.col("rep"))).alias("b"))
    entries = entries.select("b.shard", "rep", "b.bucket", "x")
    probes = _probes(index, shards, parts)
    entries, visits = _blocks(entries, lambda some: _visits(some, probes), asked, shards)
    hits = entries.groupBy("shard", "block").cogroup(visits.groupBy("shard", "block")).applyInArrow(_searcher(k), "id long, rep long, score double")
    hits = checkpointed(_best(hits.groupBy("id", "rep").agg(F.max("score").alias("score")), k))
    answers = _answers(hits, classes, k)

    # Queries that found fewer than asked for, though there are more, see every vector.
    total = classes.agg(F.sum(F.size("ids"))).first()[0]
    wanted = min(k, total - 1)
    answers = checkpointed(answers)
    short = answers.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted)
    short = checkpointed(asked.join(short, asked["id"] == short["query_id"], "left_anti"))
    missing = short.count() if wanted > 0 else 0
    if not missing:
        return answers
    shards, blocks = max(1, -(-count // SHARD)), F.lit(-(-missing // BLOCK))
    everything = classes.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"), "rep", F.lit(0).cast("long").alias("bucket"), "x")
    every = short.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), "id", F.array(F.lit(0).cast("long")).alias("buckets"), "x")
    everything, every = _cut(everything, blocks), _dealt(every, blocks)
    hits = everything.groupBy("shard", "block").cogroup(every.groupBy("shard", "block")).applyInArrow(_searcher(k), "id long, rep long, score double")
    return answers.join(short, answers["query_id"] == short["id"], "left_anti").union(_answers(_best(hits, k), classes, k))


def _first(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; tasks cut their own rows before anything is moved."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k + 1 best candidates of each query: its own vector may be one of them."""
    return _first(hits, ["id"], [F.desc("score"), "rep"], k + 1)


def _answers(hits: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Candidates with all ids of their vectors, ranked."""
    ids = classes.select("rep", "ids")
    each = hits.join(ids, "rep").select("id", "score", F.explode("ids").alias("vec_id")).filter("id != vec_id")
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = each.groupBy("id").agg(ordered.alias("best")).select("id", F.posexplode("best").alias("rank", "b"))
    return ranked.select(
        F.col("id").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score")
    )


def _parts(classes: DataFrame, index: Index, count: int) -> dict[int, int]:
    """The number of parts of each bucket that is cut into several; their number is at most that of
    all entries divided by PART."""
    if count <= PART:
        return {}
    found = classes.select(F.explode(_buckets(index, 1, {})(F.col("x"), F.col("rep"))).alias("b"))
    sizes = found.groupBy("b.bucket").agg(F.count("*").alias("n")).filter(F.col("n") > PART)
    return {r.bucket: -(-r.n // PART) for r in sizes.collect()}


def _visits(asked: DataFrame, probes) -> DataFrame:
    visits = asked.select("id", "x", F.explode(probes(F.col("x"))).alias("p"))
    return visits.select("p.shard", "id", "p.buckets", "x")


def _blocks(entries: DataFrame, visits_of, asked: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Entries and visits with the block in which they meet. Only where there are many queries, the
    visits to each shard are estimated by some of them; the entries go to each block."""
    total = asked.count()
    if total <= BLOCK:
        return entries.withColumn("block", F.lit(0)), visits_of(asked).withColumn("block", F.lit(0))
    seen = visits_of(asked.orderBy(F.xxhash64("id"), "id").limit(SEEN)).groupBy("shard").agg(F.count("*").alias("n"))
    known = {r.shard: r.n for r in seen.collect()}
    share = total / min(SEEN, total) / BLOCK
    rows = [(s, int(np.ceil(min(known.get(s, 0) + 3, SEEN) * share))) for s in range(shards)]
    blocks = F.broadcast(asked.sparkSession.createDataFrame(rows, "shard long, blocks int"))
    entries = _cut(entries.join(blocks, "shard"), F.col("blocks")).drop("blocks")
    return entries, _dealt(visits_of(asked).join(blocks, "shard"), F.col("blocks")).drop("blocks")


def _cut(entries: DataFrame, blocks: Column) -> DataFrame:
    return entries.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))


def _dealt(visits: DataFrame, blocks: Column) -> DataFrame:
    return visits.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _shard(bucket: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return ((_mixed(bucket) + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _counted(bucket: np.ndarray, parts: dict[int, int]) -> np.ndarray:
    """The number of parts of each bucket."""
    out = np.ones(len(bucket), np.int64)
    if parts:
        names = np.array(sorted(parts), np.int64)
        at = np.minimum(np.searchsorted(names, bucket), len(names) - 1)
        cut = names[at] == bucket
        out[cut] = np.array([parts[b] for b in names.tolist()], np.int64)[at[cut]]
    return out


def _buckets(index: Index, shards: int, parts: dict[int, int]):
    """The bucket of a vector in each table, and the shard that holds the vector's part of it."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for x, rep in batches:
            found = index.buckets(matrix(x)).ravel() if len(x) else np.zeros(0, np.int64)
            part = _mixed(np.repeat(rep.to_numpy(zero_copy_only=False), TABLES)) % _counted(found, parts).astype(np.uint64)
            both = pa.StructArray.from_arrays([pa.array(_shard(found, part, shards)), pa.array(found)], ["shard", "bucket"])
            yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * TABLES, both)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<shard: long, bucket: long>>")


def _probes(index: Index, shards: int, parts: dict[int, int]):
    """The shards that a query visits, each with the buckets to probe there: all parts of each."""
    kind = pa.list_(pa.struct([("shard", pa.int64()), ("buckets", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            out = []
            for probed in index.probes(matrix(x)) if len(x) else ():
                times = _counted(probed, parts)
                each = np.repeat(probed, times)
                part = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                where = _shard(each, part, shards)
                out.append([{"shard": s, "buckets": np.unique(each[where == s])} for s in np.unique(where)])
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<shard: long, buckets: array<long>>>")


def _searcher(k: int):
    """Of a shard's buckets, the k + 1 best vectors of each query that visits them."""

    def run(entries: pa.Table, visits: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not entries.num_rows or not visits.num_rows:
            return none
        entries = entries.sort_by("bucket")
        bucket, rep = entries["bucket"].to_numpy(), entries["rep"].to_numpy()
        x, q = matrix(entries["x"]), matrix(visits["x"])
        names, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(bucket))
        lists = visits["buckets"].combine_chunks()
        probed, many = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        upto = np.concatenate(([0], np.cumsum(many)))
        ids, out = visits["id"].to_numpy(), []
        for lo in range(0, len(ids), ASKED):
            some = many[lo : lo + ASKED]
            score = np.full((len(some), len(rep)), -np.inf)
            who = np.repeat(np.arange(len(some)), some)
            what = probed[upto[lo] : upto[lo + len(some)]]
            at = np.minimum(np.searchsorted(names, what), len(names) - 1)
            there = names[at] == what
            at, who = at[there], who[there]
            order = np.argsort(at, kind="stable")
            at, who = at[order], who[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            for a, b in zip(first, np.append(first, len(at))[1:], strict=True):
                members = slice(starts[at[a]], ends[at[a]])
                score[who[a:b], members] = q[lo + who[a:b]] @ x[members].T
            for i, row in enumerate(score):
                out.append(_top(ids[lo + i], q[lo + i], x, rep, row, k))
        if not out:
            return none
        a, b, c = (np.concatenate(part) for part in zip(*out, strict=True))
        return pa.table({"id": pa.array(a, pa.int64()), "rep": pa.array(b, pa.int64()), "score": pa.array(c)})

    return run


def _top(ident: int, query: np.ndarray, x: np.ndarray, rep: np.ndarray, row: np.ndarray, k: int):
    """The k + 1 best of the scored vectors, each once, scored anew in a fixed order of summing."""
    most = TABLES * (k + 1)
    chosen = np.argpartition(-row, most)[:most] if len(row) > most else np.arange(len(row))
    if len(row) > most:
        chosen = np.flatnonzero(row >= row[chosen].min() - 1e-9 * np.abs(query).max())
    chosen = chosen[row[chosen] > -np.inf]
    _, once = np.unique(rep[chosen], return_index=True)
    chosen = chosen[once]
    score = (x[chosen] * query).sum(axis=1)
    order = np.lexsort((rep[chosen], -score))[: k + 1]
    return np.full(len(order), ident), rep[chosen[order]], score[order]
