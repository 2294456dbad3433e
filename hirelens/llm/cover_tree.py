"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

On unit vectors a cosine of c or more is a distance of sqrt(2 - 2c) or less. Vectors are dealt to
cells around centres that are nested by farthest-point order, so that the first centres cover
at one radius and the next at half of it. Cells are gathered in sections of bounded size, and
a section pair is a task if any two of its cells can hold a pair, by their exact covering radii.

In a task each section gets a cover tree: nested levels of centres with halving radii, and for
each node the radius that really covers what is below it. Two nodes whose balls are further apart
than the threshold are dropped; two whose balls are so close that every pair must link are
counted without a look inside; otherwise the larger one is opened, until leaves are compared.

Equal vectors are one vector with a count. A task returns for each vector the number of links
and for the links only a forest, so a group that holds a third of all rows gives linear output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components, forest
from .multiprobe import matrix, valid

#: Vectors of the smallest hash that centres are chosen from, centres at most, vectors a cell
#: should hold, vectors of a section at most (in the mean), and vectors of a leaf.
SAMPLE, CENTRES, CELL, SECTION, LEAF = 4096, 256, 512, 8192, 512
#: Rounding that a bound allows for; within it of the threshold the cosine itself decides.
SLACK = 1e-7


def farthest_first(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of points, each the farthest from those before it, and its distance to them: the
    first points down to a distance r are centres, more than r apart, of balls of r for all."""
    chosen, reach = [0], [np.inf]
    apart = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(count, len(x)):
        nxt = int(apart.argmax())
        if apart[nxt] <= 0:
            break
        chosen.append(nxt)
        reach.append(float(apart[nxt]))
        apart = np.minimum(apart, _distances(x, x[nxt : nxt + 1])[:, 0])
    return np.array(chosen), np.array(reach)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


@dataclass
class Node:
    """A ball: centre, covering radius of the rows below, those rows, and the nodes of the next
    level (none in a leaf)."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    below: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray) -> Node:
    """A cover tree over unit vectors: each level covers at half of the radius above it."""
    root = _node(x, np.arange(len(x)), x[0])
    waiting = [(root, 2.0)]
    while waiting:
        node, radius = waiting.pop()
        while len(node.rows) > LEAF and radius > SLACK:
            radius /= 2
            if node.radius <= radius:
                continue
            node.below = _level(x, node, radius)
            if len(node.below) > 1:
                waiting += [(child, radius) for child in node.below]
                break
            node.below = []
    return root


def _level(x: np.ndarray, node: Node, radius: float) -> list[Node]:
    """Children that cover a node at the radius. The parent's centre stays a centre (nesting); a
    level that would need very many centres stops at some, whose radii then are what they cover."""
    rows = node.rows
    part = x[rows]
    most = max(2, min(64, len(rows) // (LEAF // 4)))
    centres = [node.centre]
    apart = _distances(part, node.centre[None])[:, 0]
    owner = np.zeros(len(rows), np.int64)
    while len(centres) < most and apart.max() > radius:
        centre = part[int(apart.argmax())]
        d = _distances(part, centre[None])[:, 0]
        nearer = d < apart
        owner[nearer], apart = len(centres), np.minimum(apart, d)
        centres.append(centre)
    return [_node(x, rows[owner == i], c) for i, c in enumerate(centres) if (owner == i).any()]


def _node(x: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> Node:
    return Node(centre, float(_distances(x[rows], centre[None]).max()), rows)


class Links:
    """What a traversal finds: links of each row (by the counts of their partners), and rows that
    links join."""

    def __init__(self, x: np.ndarray, y: np.ndarray, copies_x: np.ndarray, copies_y: np.ndarray, cosine: float):
        self.x, self.y, self.copies_x, self.copies_y = x, y, copies_x, copies_y
        self.x32, self.y32 = x.astype(np.float32), y.astype(np.float32)
        self.cosine, self.reach = cosine, sqrt(max(0.0, 2 - 2 * cosine))
        self.links_x, self.links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.joined: list[tuple[np.ndarray, np.ndarray]] = []

    def traverse(self, a: Node, b: Node, same: bool) -> None:
        """All links between rows of two nodes. ``same``: of a tree with itself, in which a pair of
        nodes comes up once, and a node with itself."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            own = same and a is b
            d = float(_distances(a.centre[None], b.centre[None])[0, 0])
            if d - a.radius - b.radius > self.reach + SLACK:
                continue
            if d + a.radius + b.radius < self.reach - SLACK:
                self._all(a.rows, b.rows, own)
            elif own and a.below:
                waiting += [(c, e) for k, c in enumerate(a.below) for e in a.below[k:]]
            elif a.below and (a.radius >= b.radius or not b.below):
                waiting += [(c, b) for c in a.below]
            elif b.below:
                waiting += [(a, c) for c in b.below]
            else:
                self._compare(a.rows, b.rows, own)
        if same:
            self.links_x += self.links_y - self.copies_x

    def _all(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        self.links_x[i] += self.copies_y[j].sum()
        if not own:
            self.links_y[j] += self.copies_x[i].sum()
        self.joined.append((i, np.full(len(i), j[0])))
        self.joined.append((np.full(len(j), i[0]), j))

    def _compare(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        rough = self.x32[i] @ self.y32[j].T
        near = rough >= self.cosine - 1e-4
        if not near.any():
            return
        at, to = np.nonzero(near & (rough < self.cosine + 1e-4))
        near[at, to] = (self.x[i[at]] * self.y[j[to]]).sum(axis=1) >= self.cosine
        some_i, some_j = near.any(axis=1), near.any(axis=0)
        i, j, near = i[some_i], j[some_j], near[some_i][:, some_j]
        if not len(i):
            return
        self.links_x[i] += near @ self.copies_y[j]
        if not own:
            self.links_y[j] += self.copies_x[i] @ near
        # Every row and column goes to the smallest row that links lead to, and with it to one
        # column: a forest instead of all pairs.
        low, none = np.arange(len(i)), len(i)
        while True:
            low_j = np.where(near, low[:, None], none).min(axis=0)
            lower = np.where(near, low_j, none).min(axis=1)
            if (lower == low).all():
                break
            low = lower
        one = near.argmax(axis=1)
        self.joined += [(i, j[one[low]]), (i[low_j], j)]


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``.

    Rows link whose vectors have a cosine of at least ``cosine`` (over 0), in double precision;
    vectors of different lengths do not. component_id is the smallest id that links lead to, the
    row's own included, and kept says that it is the own. Vectors that are null, zero, or hold
    null or non-finite components link with nothing. Rows that repeat an id are rows of their
    own, linked like any others. A row without an id links with nothing and is kept, with a null
    component. An empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")
    )
    usable = F.col("id").isNotNull() & valid(F.col("x"))
    rows = rows.select("id", F.when(usable, F.col("x")).alias("x"))
    classes = rows.filter("x is not null").groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # An id can repeat with another vector, so classes get numbers of their own kind: the hash of
    # the vector stands beside the id.
    classes = checkpointed(classes.withColumn("mark", F.xxhash64("x")))
    found = [_links(classes.filter(F.size("x") == n), cosine) for n in _lengths(classes)]
    none = classes.select("rep", "mark", F.lit(0).cast("long").alias("links")).limit(0)
    links, edges = none, classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    for more, joined in found:
        links, edges = links.unionByName(more), edges.union(joined)
    counted = links.groupBy("rep", "mark").agg(F.sum("links").alias("links"))
    # Rows of one class are linked with each other through their smallest id.
    own = rows.filter("x is not null").join(classes.filter("copies > 1").select("x", "rep"), "x").select("id", "rep")
    placed = components(edges.union(own))
    known = classes.join(counted, ["rep", "mark"], "left").select(
        "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    )
    out = rows.join(known, "x", "left").join(placed.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _lengths(classes: DataFrame) -> list[int]:
    return sorted(r.n for r in classes.select(F.size("x").alias("n")).distinct().collect())


def _links(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(rep, mark, links to other classes' rows) and edges (a, b) between classes of one length."""
    picked = classes.orderBy(F.xxhash64("rep", "mark"), "rep", "mark").limit(SAMPLE).select("x").collect()
    sample = _unit(np.array([r.x for r in picked]))
    count = classes.count()
    centres = sample[farthest_first(sample, int(min(CENTRES, max(1, count // CELL))))[0]]
    placed = checkpointed(classes.select("rep", "mark", "copies", "x", _nearest(centres)(F.col("x")).alias("c")).select("rep", "mark", "copies", "x", "c.*"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    dealt = _dealt(placed, *_sections(cells, centres, cosine))

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.sort_by([("rep", "ascending"), ("mark", "ascending")])
        section, rep, mark, copies = (table[c].to_numpy() for c in ("section", "rep", "mark", "copies"))
        x = _unit(matrix(table["x"]))
        left, right = np.flatnonzero(section == i), np.flatnonzero(section == j)
        if not len(left) or not len(right):
            return _found([], [], [], [])
        links = Links(x[left], x[right], copies[left], copies[right], cosine)
        tree = cover_tree(x[left])
        links.traverse(tree, tree if i == j else cover_tree(x[right]), i == j)
        counted = {}
        for at, n in ((left, links.links_x), *(() if i == j else ((right, links.links_y),))):
            some = n > 0
            for r, m, k in zip(rep[at[some]].tolist(), mark[at[some]].tolist(), n[some].tolist(), strict=True):
                counted[r, m] = counted.get((r, m), 0) + k
        joined = forest(
            p for a, b in links.joined for p in {*zip(rep[left[a]].tolist(), rep[right[b]].tolist(), strict=True)}
        )
        edges = [(a, b) for a, b in joined.items() if a != b]
        return _found([k[0] for k in counted], [k[1] for k in counted], list(counted.values()), edges)

    result = checkpointed(dealt.groupBy("i", "j").applyInArrow(run, "rep long, mark long, links long, other long"))
    return result.filter("links is not null").select("rep", "mark", "links"), result.filter("other is not null").select("rep", "other")


def _found(rep: list, mark: list, links: list, edges: list) -> pa.Table:
    none = [None] * len(edges)
    columns = (rep + [a for a, _ in edges], mark + none, links + none, [None] * len(rep) + [b for _, b in edges])
    names = ("rep", "mark", "links", "other")
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(centres: np.ndarray):
    """The nearest centre of a vector, and the distance to it."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = _unit(matrix(batch)) if len(batch) else np.zeros((0, centres.shape[1]))
            cos = x @ centres.T
            cell = cos.argmax(axis=1) if len(x) else np.zeros(0, int)
            apart = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(x)), cell]))
            yield pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(apart)], ["cell", "apart"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<cell: int, apart: double>")


def _dealt(placed: DataFrame, runs: list, of_cell: dict, meeting: list) -> DataFrame:
    """Each vector once for every pair (i, j) of sections that its own section takes part in."""
    spark = placed.sparkSession
    spot = spark.createDataFrame([(c, k, *runs[k]) for c, k in of_cell.items()], "cell int, run int, first int, parts int")
    others = spark.createDataFrame([(k, *runs[m]) for k, m in meeting], "run int, start int, many int")
    own = (F.col("first") + F.pmod(F.xxhash64("rep", "mark"), F.col("parts"))).cast("int")
    other = F.explode(F.sequence("start", F.col("start") + F.col("many") - 1)).alias("other")
    dealt = placed.join(F.broadcast(spot), "cell").withColumn("section", own).join(F.broadcast(others), "run")
    dealt = dealt.select("section", "rep", "mark", "copies", "x", other)
    i, j = F.least("section", "other").alias("i"), F.greatest("section", "other").alias("j")
    return dealt.select(i, j, "section", "rep", "mark", "copies", "x")


def _sections(cells: list, centres: np.ndarray, cosine: float) -> tuple[list, dict, list]:
    """Runs of sections as (first section, how many), the run of each cell, and which runs meet, both
    ways and each with itself. A cell of more than a section's vectors is a run of several sections,
    dealt by a hash; smaller cells share a run of one. There are at most CENTRES cells, so no more
    runs: what comes here does not grow with the vectors, whose sections Spark pairs."""
    runs: list[tuple[int, int]] = []
    members: list[list[int]] = []
    filled, number = SECTION, 0
    for cell in sorted(cells, key=lambda r: r.cell):
        if filled + cell.n > SECTION:
            parts, filled = -(-cell.n // SECTION), 0
            runs.append((number, parts))
            members.append([])
            number += parts
        members[-1].append(cell.cell)
        filled += cell.n
    radius = {r.cell: r.radius for r in cells}
    apart = _distances(centres, centres)
    reach = sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    meeting = [
        (k, m)
        for k, a in enumerate(members)
        for m, b in enumerate(members)
        if any(apart[p, q] - radius[p] - radius[q] <= reach for p in a for q in b)
    ]
    return runs, {c: k for k, some in enumerate(members) for c in some}, meeting
