"""Mixing against a walk down the tree in plain Python, and against SQL."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hirelens.llm import mixing, queries
from testing.compare import duck, duck_bag, spark_bag

SCHEMA = "doc_id long, text string, a string, b string"
def levels():
    return {"top": F.col("a"), "leaf": F.col("b")}


def shared(given, supply, weights):
    """Fair shares of ``given`` among siblings in rounds, to the token as the operator gives them."""
    out, open_ = {}, {k for k in supply if weights.get(k, 1) and supply[k]}
    left = given
    while open_ and left > 0:
        total = sum(weights.get(k, 1) for k in open_)
        full = {k for k in open_ if supply[k] * total <= left * weights.get(k, 1)}
        if not full:
            upto = 0
            for k in sorted(open_):
                w = weights.get(k, 1)
                out[k] = left * (upto + w) // total - left * upto // total
                upto += w
            return out
        # One at a time: the poorest for its weight gives all.
        k = min(full, key=lambda k: (supply[k] / weights.get(k, 1), k))
        out[k] = supply[k]
        left -= supply[k]
        open_.remove(k)
    return out


def plain(rows, weights, share, epochs, seed):
    words = lambda t: len((t or "").encode().split())
    docs = defaultdict(list)
    for i, t, a, b in rows:
        docs[a or "(none)", b or "(none)"].append((i, words(t)))
    available = {leaf: sum(n for _, n in d) for leaf, d in docs.items()}
    supply = defaultdict(int)
    for (a, _), n in available.items():
        supply[a] += n * epochs
    given = min(int(sum(available.values()) * share), sum(supply.values()))
    out = []
    for a, part in shared(given, supply, weights.get("top", {})).items():
        leaves = {b: n * epochs for (x, b), n in available.items() if x == a}
        for b, budget in shared(part, leaves, weights.get("leaf", {})).items():
            for e in range(epochs):
                quota = min(budget - e * available[a, b], available[a, b])
                if quota <= 0:
                    continue
                order = sorted((hashlib.md5(f"{seed}:{e}:{'' if i is None else i}".encode()).hexdigest(), str(i), i, n) for i, n in docs[a, b])
                before = 0
                for _, _, i, n in order:
                    if quota == available[a, b] or before < quota:
                        out.append((i, a, b, n, e))
                    before += n
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        a = rng.choice(["x", "x", "x", "y", "z", None])
        rows.append((i, rng.choice(["", None, "w " * rng.randrange(60), "a b c"]), a, rng.choice("pqr")))
    return [*rows, (1000, "long " * 20_000, "y", "p")]


@pytest.mark.parametrize(("share", "epochs", "digits"), [(0.3, 1, 1), (0.9, 2, 3), (5.0, 3, 1), (0.0, 1, 3), (1.0, 1, 2)])
def test_equals_a_walk_down_the_tree(spark, monkeypatch, share, epochs, digits):
    monkeypatch.setattr(mixing, "SLICE_DIGITS", digits)
    weights = {"top": {"x": 1, "y": 5, "z": 0}, "leaf": {"p": 3}}
    rows = corpus(epochs)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("tokens"), F.lit(2).alias("epoch"), F.lit(3).alias("hash"))
    got = mixing.mix(df, levels(), weights, share, epochs, 5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, weights, share, epochs, 5)


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000), ("c", "x", 5), ("c", "y", 5)],
        "top string, leaf string, available long",
    )
    got = mixing.leaf_budgets(leaves, ["top", "leaf"], {}, 900 / 3020, 1)
    budgets = {(r.top, r.leaf): r.budget for r in got.collect()}
    assert sum(budgets.values()) == 900
    # c has 10 of its third; a and b share the rest alike, and a's y makes up for its x.
    assert budgets == {("c", "x"): 5, ("c", "y"): 5, ("a", "x"): 10, ("a", "y"): 435, ("b", "x"): 222, ("b", "y"): 223}


def test_edge_rows(spark):
    rows = [(None, "no id here", "x", "p"), (7, "twice", "x", "p"), (7, "twice", "x", "p"), (8, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, levels(), {}, 1.0).collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in got) == [(0, 3), (7, 1), (7, 1)]
    kept = mixing.mix(df, levels(), {}, 1.0, keep=["doc_id", "text"])
    assert kept.columns == ["doc_id", "text"] and kept.count() == 3
    assert mixing.mix(df.limit(0), levels(), {}, 1.0).collect() == []
    assert mixing.mix(df.filter("doc_id = 8"), levels(), {}, 1.0).collect() == []


def test_only_built_in_functions(spark):
    plan = queries.op7_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = spark_bag(queries.op7_mixing(spark, sf_dir))
    assert got == duck_bag(duck(sf_dir), queries.SQL["op7_mixing"])
