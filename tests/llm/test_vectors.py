"""Cover-tree near-duplicates and multiprobe search against all pairs."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hirelens.llm import cover_tree, multiprobe, queries
from hirelens.llm.components import forest


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clashing = ("id", "x", "rep", "links", "component", "score", "rank", "shard", "cell")
    return df.select("*", *[F.lit("clash").alias(c) for c in clashing]).repartition(5)


def clouds(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.6], (n, 1))
    x[rng.integers(0, n, n // 6)] = x[0]
    x[rng.integers(0, n, 20)] *= rng.uniform(0.1, 5, (20, 1))
    return x.astype(np.float32)


ODD = [
    (9001, None), (9002, [0.0] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [math.nan] + [1.0] * 7),
    (9005, [math.inf] + [1.0] * 7), (9006, []), (None, [1.0] * 8),
]


@pytest.mark.parametrize("sizes", [None, (64, 8, 16)])
def test_links_equal_all_pairs(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("SECTION", "LEAF", "CELL"), sizes, strict=True):
            monkeypatch.setattr(cover_tree, name, value)
    x = clouds(1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x, 10)] + ODD + [(8000, [3.0, 4.0]), (8001, [6.0, 8.0]), (8002, [4.0, -3.0])]
    got = cover_tree.near_duplicates(table(spark, rows), 0.95).collect()
    assert len(got) == len(rows)
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    component = forest(zip(*(a.tolist() for a in np.nonzero(close)), strict=True))
    want = {i + 10: (int(close[i].sum()), component.get(i, i) + 10) for i in range(len(x))}
    want |= {i: (0, i) for i, _ in ODD} | {8000: (1, 8000), 8001: (1, 8000), 8002: (0, 8002)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_pairs_of_sections_do_not_come_to_the_driver():
    angle = np.linspace(0, np.pi, 200)
    centres = np.stack((np.cos(angle), np.sin(angle)), axis=1)
    cells = [Row(cell=i, n=10**9, radius=0.001) for i in range(200)]
    runs, of_cell, meeting = cover_tree._sections(cells, centres, 0.9999)
    assert len(runs) == len(of_cell) == 200 and len(meeting) <= 200 * 5
    assert sum(parts for _, parts in runs) >= 200 * 10**9 // cover_tree.SECTION
    assert all(a[0] + a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_vectors_of_far_cells_are_not_copied_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SECTION", 10)
    centres = np.eye(6)
    rows = [(i, i * 7, 1, [1.0] * 6, i % 6) for i in range(240)]
    placed = spark.createDataFrame(rows, "rep long, mark long, copies long, x array<double>, cell int")
    cells = [Row(cell=c, n=40, radius=0.1) for c in range(6)]
    dealt = cover_tree._dealt(placed, *cover_tree._sections(cells, centres, 0.95)).collect()
    # Four sections a cell, each of which meets itself and the other three.
    assert len(dealt) == 240 * 4 == len({(r.rep, r.i, r.j) for r in dealt})
    assert all(r.i <= r.j and r.section in (r.i, r.j) and r.i // 4 == r.j // 4 for r in dealt)
    assert {(r.i, r.j) for r in dealt} == {(4 * c + a, 4 * c + b) for c in range(6) for a in range(4) for b in range(a, 4)}


def test_rows_that_repeat_an_id(spark):
    got = cover_tree.near_duplicates(table(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])]))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert cover_tree.near_duplicates(table(spark, [(1, [1.0])]).limit(0)).collect() == []


def test_tree_levels_halve_and_cover(monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    x = cover_tree._unit(clouds(3).astype(float))
    root = cover_tree.cover_tree(x)
    waiting, seen = [root], []
    while waiting:
        node = waiting.pop()
        assert np.linalg.norm(x[node.rows] - node.centre, axis=1).max() <= node.radius + 1e-7
        if node.below:
            assert sorted(r for c in node.below for r in c.rows) == sorted(node.rows)
            waiting += node.below
        else:
            seen += node.rows.tolist()
    assert sorted(seen) == list(range(len(x)))


def best(rows, query, k):
    scored = [(-float(np.dot(np.float64(v), np.float64(query[1]))), i) for i, v in rows if i != query[0]]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_search_finds_the_nearest(spark):
    x = clouds(4, 600)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got = multiprobe.nearest(table(spark, rows + ODD), F.col("vec_id") % 20 == 0, 10).collect()
    plain = [(i, np.array(v, np.float32)) for i, v in rows]
    hits = 0
    for q in (r for r in plain if r[0] % 20 == 0):
        found = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q[0])
        assert [r for r, *_ in found] == list(range(1, 11))
        scores = [s for *_, s in found]
        assert scores == sorted(scores, reverse=True)
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(np.float64(x[i]), np.float64(q[1]))), rel=1e-12)
        hits += len({i for _, i, _ in found} & {i for i, _ in best(plain, q, 10)})
    assert hits / (10 * sum(i % 20 == 0 for i, _ in rows)) >= 0.9
    assert {r.query_id for r in got} == {i for i, _ in rows if i % 20 == 0}


def test_search_finds_the_nearest_of_vectors_outside_tight_clouds(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 24))
    tight = centres[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 24)) * 0.01
    x = np.concatenate((tight, rng.normal(size=(900, 24))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = multiprobe.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, 10).collect()
    plain = [(i, np.array(v, np.float32)) for i, v in rows]
    for some in (range(0, 1500, 10), range(1500, 2400, 10)):
        hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in best(plain, plain[q], 10)}) for q in some)
        assert hits / (10 * len(some)) >= 0.9


def test_no_task_holds_a_crowded_bucket_or_all_queries(spark, monkeypatch, tmp_path):
    plain, folder = multiprobe._searcher, str(tmp_path)

    def watched(k):
        run = plain(k)

        def watch(entries, visits):
            if entries.num_rows and visits.num_rows:
                with open(f"{folder}/{uuid.uuid4()}", "w") as file:
                    file.write(f"{entries.num_rows} {visits.num_rows}")
            return run(entries, visits)

        return watch

    for name, value in (("_searcher", watched), ("SHARD", 512), ("PART", 64), ("BLOCK", 32)):
        monkeypatch.setattr(multiprobe, name, value, raising=False)
    x = np.random.default_rng(9).normal(size=(1500, 8))
    x[1] *= 1e6  # all others share a bucket
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = multiprobe.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, 10).collect()
    asked = [(i, np.array(v, np.float32)) for i, v in rows]
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in best(asked, asked[q], 10)}) for q in range(0, 1500, 10))
    assert hits / 1500 >= 0.9
    sizes = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert max(n for n, _ in sizes) <= 1024 and max(n for _, n in sizes) <= 64


def test_queries_may_find_none_of_their_buckets_in_a_task():
    entries = pa.table({"rep": [1, 2], "bucket": [4, 6], "x": [[1.0, 0.0], [0.0, 1.0]]})
    visits = pa.table({"id": [7, 8], "buckets": [[3], [5, 9]], "x": [[1.0, 1.0], [2.0, 0.0]]})
    assert multiprobe._searcher(3)(entries, visits).num_rows == 0
    visits = pa.table({"id": [7, 8], "buckets": [[3], [4, 9]], "x": [[1.0, 1.0], [2.0, 0.0]]})
    assert multiprobe._searcher(3)(entries, visits).to_pylist() == [{"id": 8, "rep": 1, "score": 2.0}]


def test_every_bucket_can_be_reached():
    rng = np.random.default_rng(8)
    sample = np.repeat(rng.normal(size=(4, 8)), 10, axis=0) + rng.normal(size=(40, 8)) * 1e-4
    norm = float(np.linalg.norm(sample, axis=1).max()) * 1.001
    index = multiprobe.Index(norm, rng.normal(size=(2, 2, 9)), np.zeros((2, 2)), 4, sample, 4, 1 << 16)
    pulls = index.pulls(sample[:1])
    assert pulls[0] > 0.9
    for chance in next(index.chances(sample[:1], pulls)):
        assert sorted(b for b, _ in multiprobe._by_chance(chance, 1.0, 8)) == list(range(64))


def test_few_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [-1.0, 0.0])]
    got = multiprobe.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()
    want = {0: [3, 5, 20, 7], 20: [0, 3, 5, 7]}
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want
    copies = [(i, [1.0, 2.0]) for i in range(100)]
    got = multiprobe.nearest(table(spark, copies), F.col("vec_id") == 40, 5).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]
    assert multiprobe.nearest(table(spark, rows).limit(0), F.col("vec_id") == 0).collect() == []
    assert multiprobe.nearest(table(spark, rows[:1]), F.col("vec_id") == 0).collect() == []


def test_probes_come_in_the_order_of_their_chance():
    rng = np.random.default_rng(0)
    chance = rng.dirichlet(np.ones(6), 3)
    order, before = zip(*multiprobe._by_chance(chance, 0.9, 6), strict=True)
    order = list(order)
    product = {
        a + 6 * b + 36 * c: chance[0, a] * chance[1, b] * chance[2, c] for a in range(6) for b in range(6) for c in range(6)
    }
    want = sorted(product, key=product.get, reverse=True)[: len(order)]
    assert order == want
    assert sum(product[b] for b in order) >= 0.9 > before[-1] == pytest.approx(sum(product[b] for b in order[:-1]))


def test_registered_queries(spark):
    sf_dir = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in vectors], float)
    ids = np.array([r.vec_id for r in vectors])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    component = forest(zip(*(ids[a].tolist() for a in np.nonzero(close)), strict=True))
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op6_cover_tree(spark, sf_dir).collect()}
    assert got == {int(i): (int(n), component.get(int(i), int(i))) for i, n in zip(ids, close.sum(1), strict=True)}

    found = {}
    for r in queries.op8_multiprobe(spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        top = ids[np.lexsort((ids, -score))[: min(20, len(ids) - 1)]]
        assert len(found[ids[at]]) == len(top)
        hits, total = hits + len(set(top) & set(found[ids[at]])), total + len(top)
    assert hits / total >= 0.9
