"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget flows down a tree of labels (domain, language, source). Siblings share their
parent's budget by weight; what a sibling cannot supply goes to the siblings that can, and
because a parent's budget never exceeds what its subtree holds, only what no sibling can
supply reaches the ancestors' other branches. Each leaf then takes its budget as a prefix of
seeded epochs: in every epoch its documents have another order, given by a hash.

The prefix is found by histograms: tokens per leaf and slice of the hash order are summed
first, and only the slice in which a leaf's budget ends is ordered row by row, so a leaf with
a third of all documents is no burden to one task. What results is one cut per leaf and
epoch, against which every document is compared in place, without moving its text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Slices of the hash order (hex digits), and cuts that are sent to every executor at most.
SLICE_DIGITS, BROADCAST_CUTS = 3, 100_000
WORD = r"[^\x20\x09-\x0D]+"
NO_LABEL = "(none)"


def word_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, ident: Column) -> Column:
    """Hash that orders a document within an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(ident.cast("string"), F.lit(""))))


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    share: float,
    epochs: int,
) -> DataFrame:
    """Adds ``budget`` to leaves (levels, available): what flows down to each of them of
    ``share`` times all available tokens, a leaf giving ``epochs`` times its own at most."""
    nodes = leaves.withColumn("supply", F.col("available") * epochs)
    root = nodes.agg(F.least(F.floor(F.sum("available") * F.lit(share)).cast("long"), F.sum("supply"))).first()[0]
    given = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        children = nodes.groupBy(*path).agg(F.sum("supply").alias("supply"))
        weight = _weight(F.col(path[-1]), weights.get(path[-1], {}))
        children = children.withColumn("weight", weight).filter("weight > 0 and supply > 0")
        children = children.join(given, parent) if parent else children.withColumn("given", F.lit(root or 0))
        given = _shared(children, path, parent)
    return leaves.join(given.withColumnRenamed("given", "budget"), list(levels))


def _weight(label: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(label == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _shared(children: DataFrame, path: list[str], parent: list[str]) -> DataFrame:
    """Siblings' parts of ``given``. In the order of supply by weight those that the fair share of
    what is left would exhaust give all; the others share the rest by weight, to the token."""
    siblings = Window.partitionBy(*(parent or [F.lit(0)]))
    poorest = siblings.orderBy(F.col("supply") / F.col("weight"), path[-1])
    upward = poorest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("given") - (F.sum("supply").over(upward) - F.col("supply"))
    heavy = F.sum("weight").over(siblings) - (F.sum("weight").over(upward) - F.col("weight"))
    told = children.select("*", left.alias("left"), heavy.alias("heavy"))
    told = told.withColumn("all", F.expr("left > 0 and supply * heavy <= left * weight"))
    gone = F.sum(F.when(F.col("all"), F.col("supply")).otherwise(0)).over(siblings)
    open_weight = F.when(F.col("all"), 0).otherwise(F.col("weight"))
    ordered = siblings.orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.select(
        "*", (F.col("given") - gone).alias("rest"), F.sum(open_weight).over(siblings).alias("of"),
        F.sum(open_weight).over(ordered).alias("upto"),
    )
    part = F.expr("(rest * upto) div of - (rest * (upto - weight)) div of")
    return told.select(*path, F.when(F.col("all"), F.col("supply")).otherwise(part).alias("given"))


def epoch_cuts(base: DataFrame, levels: Sequence[str], budgets: DataFrame, epochs: int, seed: int) -> DataFrame:
    """(levels, epoch, whole, last): how far each epoch of each leaf is taken: as a whole, or up to
    the document whose (hash, id) is ``last``."""
    wanted = budgets.filter("budget > 0").select(
        *levels, "available", "budget", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    )
    quota = F.least(F.col("budget") - F.col("epoch") * F.col("available"), "available")
    wanted = checkpointed(wanted.withColumn("quota", quota).filter("quota > 0").select(*levels, "epoch", "available", "quota"))
    partial = wanted.filter("quota < available").select(*levels, "epoch", "quota")
    keyed = base.join(_small(partial), list(levels)).withColumn("hash", place(seed, F.col("epoch"), F.col("id")))
    keyed = keyed.withColumn("slice", F.substring("hash", 1, SLICE_DIGITS))
    slices = keyed.groupBy(*levels, "epoch", "quota", "slice").agg(F.sum("tokens").alias("tokens"))
    leaf = Window.partitionBy(*levels, "epoch")
    upto = F.sum("tokens").over(leaf.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = slices.withColumn("before", upto - F.col("tokens"))
    last = slices.filter("before < quota and before + tokens >= quota")
    last = checkpointed(last.select(*levels, "epoch", "slice", "before"))
    rows = keyed.join(_small(last), [*levels, "epoch", "slice"])
    rows = rows.groupBy(*levels, "epoch", "quota", "before", "hash", "id").agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(leaf.orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("at", F.col("before") + run - F.col("tokens")).filter("at < quota")
    cuts = rows.groupBy(*levels, "epoch").agg(F.max(F.struct("hash", "id")).alias("last"))
    whole = wanted.filter("quota = available").select(*levels, "epoch", F.lit(True).alias("whole"))
    return checkpointed(
        whole.withColumn("last", F.lit(None).cast(cuts.schema["last"].dataType)).unionByName(
            cuts.withColumn("whole", F.lit(False))
        )
    )


def _small(frame: DataFrame) -> DataFrame:
    """A checkpointed frame, marked for broadcast after its rows have been counted."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_CUTS else frame


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    share: float,
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Documents chosen to the target weights, once for every epoch that takes them.

    ``levels`` names the tree's levels from the top and says how to read them off a document;
    ``weights`` has integer weights by level and label, 1 where none is given, and 0 leaves a
    branch out. A leaf takes documents in the epoch's order until its budget is reached, so it
    goes over by less than a document; documents without words ride along. Returns the level
    columns, tokens, epoch and id_col, or with ``keep`` these columns of ``docs`` alone.

    A null label counts as ``(none)``; a null text has no tokens; rows without an id, and rows
    that repeat one, are taken together. A budget that all leaves cannot meet takes everything
    ``epochs`` times. An empty table, or one without words, gives an empty result.
    """
    names = list(levels)
    labels = [F.coalesce(c.cast("string"), F.lit(NO_LABEL)).alias(n) for n, c in levels.items()]
    tokens = word_tokens(F.col(text_col)).alias("tokens")
    base = checkpointed(docs.select(F.col(id_col).alias("id"), *labels, tokens))
    leaves = checkpointed(base.groupBy(*names).agg(F.sum("tokens").alias("available")))
    budgets = checkpointed(leaf_budgets(leaves, names, weights, share, epochs))
    cuts = epoch_cuts(base, names, budgets, epochs, seed)
    cuts = cuts.select(*(F.col(n).alias(f"cut_{n}") for n in names), F.col("epoch").alias("cut_epoch"), "whole", "last")
    if keep is None:
        rows = base.select(F.struct(*base.columns).alias("row"), *names, "id")
    else:
        rows = docs.select(F.struct(*keep).alias("row"), *labels, F.col(id_col).alias("id"))
    found = rows.join(_small(cuts), [rows[n] == F.col(f"cut_{n}") for n in names])
    own = F.struct(place(seed, F.col("cut_epoch"), F.col("id")).alias("hash"), F.col("id"))
    found = found.filter(F.col("whole") | (own <= F.col("last")))
    if keep is not None:
        return found.select("row.*")
    return found.select(F.col("row.id").alias(id_col), *(f"row.{n}" for n in names), "row.tokens", F.col("cut_epoch").alias("epoch"))
