"""A Merkle manifest of a dataset by nested-interval labels.

Leaves are ranked by a range-partitioned sort, so no task and no window ever holds one
group. Every node carries the interval of leaf ranks that it covers. Up the tree, runs of
``FAN`` neighbours become their parent, level by level. Down the tree, nodes of one level join
the nodes of the next by the bucket that the interval falls into there, if that interval
contains theirs: each node learns its parent. What the parent's interval has before
and after the node's own are its siblings; their digests, joined to those of the
ancestors, are the node's proof. A parent has ``FAN`` children at most, so no join
key is crowded, whatever the size of a group.

The trees of the groups hang under one more tree, over the groups' roots in order.
"""

from __future__ import annotations

import posixpath
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpoint_folder

#: Children of a node.
FAN = 8
STEPS = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """The rows with their place in the order (nulls first), from 0, as ``rank``. Rows of one value are
    cut over several partitions. The sorted rows are written, so that places stay as they are."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = salted.repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    place = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place"))
    placed.write.parquet(folder)
    out = spark.read.schema(placed.schema).parquet(folder)
    sizes = sorted((r["part"], r["n"]) for r in out.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0  # a row for each partition of the sort
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    return out.join(starts, "part").withColumn("rank", F.col("start") + F.col("place")).drop("part", "place", "start")


def grow(nodes: DataFrame, most: int, folder: str) -> list[DataFrame]:
    """The levels of trees over ``nodes`` (tree, idx, size of the tree, lo, hi, digest), each
    with the children of its nodes as ``parts``, until every tree has one node; ``most`` is the
    largest size. Only trees of several nodes at one level go on to the next."""
    spark, levels, width = nodes.sparkSession, [nodes], 1
    while width < most:
        part = F.struct("lo", "hi", "digest")
        up = levels[-1].filter(F.col("size") > width).groupBy("tree", "size", F.expr(f"idx div {FAN}").alias("idx"))
        up = up.agg(F.sort_array(F.collect_list(part)).alias("parts"))  # FAN at most
        up = up.select(
            "tree", "size", "idx", F.col("parts")[0]["lo"].alias("lo"), F.element_at("parts", -1)["hi"].alias("hi"),
            F.sha2(F.array_join("parts.digest", ""), 256).alias("digest"), "parts",
        )
        path = posixpath.join(folder, f"level-{len(levels)}")
        up.write.parquet(path)
        levels.append(spark.read.schema(up.schema).parquet(path))
        width *= FAN
    return levels


def tops(levels: list[DataFrame]) -> list[DataFrame]:
    """Of each level, the nodes that are the root of their tree."""
    return [
        level.filter((F.col("size") <= FAN**k) & (F.col("size") > (FAN ** (k - 1) if k else 0)))
        for k, level in enumerate(levels)
    ]


def descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The nodes of the lowest level with ``steps``: for every level from their own to the last, the
    digests of the siblings before and after, joined. ``roots`` has for each tree the steps above its
    root, and what else all its nodes are to carry."""
    above = None
    for k, (level, top) in reversed(list(enumerate(zip(levels, tops(levels), strict=True)))):
        here = top.join(roots, "tree")
        if above is not None:
            here = _inherit(level.filter(F.col("size") > FAN**k), above, roots.columns).unionByName(here)
        above = here
    return above


def _inherit(nodes: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes with what the parent carries whose interval contains theirs, their own step in front."""
    wanted = ["tree", "idx", "lo", "hi", "parts", *[c for c in carried if c != "tree"]]
    parents = above.select([F.col(c).alias(f"p_{c}") for c in wanted])
    contained = (
        (F.col("tree") == F.col("p_tree")) & (F.expr(f"idx div {FAN}") == F.col("p_idx"))
        & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    )
    joined = nodes.join(parents, contained)
    before = F.filter("p_parts", lambda p: p["hi"] <= F.col("lo"))
    after = F.filter("p_parts", lambda p: p["lo"] >= F.col("hi"))
    step = F.struct(
        F.array_join(before["digest"], "").alias("before"), F.array_join(after["digest"], "").alias("after")
    )
    rest = [F.col(f"p_{c}").alias(c) for c in carried if c not in ("tree", "steps")]
    return joined.select(*nodes.columns, F.concat(F.array(step), "p_steps").alias("steps"), *rest)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id_col, leaf (digest of ``fields``), subroot of its group, root, steps
    (the proof), proof_sha256, folded_root and verified.

    ``changed`` gives other values of some fields, those of a copy to be checked against the manifest:
    folded_root is what the leaf of that copy and the original proof lead to, and verified says
    whether it is the root. Without it every row verifies.

    A null field has a digest of its own, apart from the empty text. Null groups are a group, the first;
    null ids come first in their group, and rows that share an id follow each other by their
    leaves. Rows that repeat in all fields are leaves of their own. A text of any length is digested
    whole. A group of one row has its leaf as subroot, one group its subroot as root. No rows give none.
    """
    spark = docs.sparkSession
    folder = posixpath.join(checkpoint_folder(spark), f"merkle-{uuid.uuid4().hex}")
    changed = changed or {}
    rows = docs.select(
        F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        leaf_digest([changed.get(f, F.col(f)) for f in fields]).alias("other"),
    )
    leaves = ranked(rows, ["grp", "id", "leaf"], posixpath.join(folder, "leaves"))

    groups = leaves.groupBy("grp").agg(F.min("rank").alias("tree"), F.count("*").alias("size"))
    groups.write.parquet(posixpath.join(folder, "groups"))
    groups = spark.read.schema(groups.schema).parquet(posixpath.join(folder, "groups"))
    most, count = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    groups = groups.withColumnRenamed("grp", "of")
    groups = F.broadcast(groups) if count <= BROADCAST_IDS else groups
    nodes = leaves.join(groups, F.col("grp").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("rank") - F.col("tree")).alias("idx"), "size", F.col("rank").alias("lo"),
        (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), "id", "other",
    )
    levels = grow(nodes, most, posixpath.join(folder, "trees"))

    subroots = reduce(DataFrame.unionAll, [top.select("tree", "lo", "hi", "digest") for top in tops(levels)])
    subroots = ranked(subroots.withColumnRenamed("tree", "of"), ["of"], posixpath.join(folder, "subroots"))
    subroots = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("rank").alias("idx"), F.lit(count).cast("long").alias("size"),
        "lo", "hi", "digest", "of",
    )
    crown = grow(subroots, count, posixpath.join(folder, "crown"))
    root = crown[-1].select("digest").first()  # one node
    start = spark.range(1).select(F.col("id").alias("tree"), F.array().cast(STEPS).alias("steps"))
    roots = descend(crown, start).select(F.col("of").alias("tree"), "steps", F.col("digest").alias("subroot"))

    found = descend(levels, roots)
    out = found.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), "steps",
        proof(F.col("steps")).alias("proof_sha256"), fold(F.col("other"), F.col("steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
