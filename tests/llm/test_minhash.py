"""Near-duplicates by MinHash against a comparison of all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from hirelens.llm import minhash
from hirelens.llm.common import checkpointed
from hirelens.llm.components import components, forest


def brute(rows, words, percent):
    """Component by id, from exact sets of word tuples."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = forest(links)
    return {i: (len(s), found.get(i, i)) for i, s in sets.items()}


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(3, 150))
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_equals_all_pairs(docs, monkeypatch, words, percent, seed):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = corpus(seed)
    got = minhash.near_duplicates(docs(rows), words=words, percent=percent).collect()
    want = brute(rows, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_larger_than_a_batch(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "2")
    try:
        rows = corpus(3)
        got = minhash.near_duplicates(docs(rows), words=3, percent=85).collect()
    finally:
        spark.conf.unset(key)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_edge_rows(docs):
    long = " ".join(str(i) for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one"), (None, "one two"),
        (7, long), (8, long + " end"), (9, "same text here now"), (9, "same text here now"),
    ]
    got = minhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True),
        None: (1, None, True), 7: (29_996, 7, True), 8: (29_997, 7, False), 9: (1, 9, True),
    }
    assert minhash.near_duplicates(docs([])).collect() == []


def test_rows_of_one_id_with_different_texts(docs):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(3, a), (9, a), (9, b), (9, b + " end"), (12, b + " end"), (12, None), (None, b), (20, a + " c"), (20, "c")]
    for order in (rows, rows[::-1]):
        got = minhash.near_duplicates(docs(order), detail=True)
        found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr)
        assert found == sorted([
            (3, 76, 3, True), (9, 76, 3, False), (9, 76, 9, True), (9, 77, 9, True), (12, 77, 9, False),
            (12, 0, 12, True), (0, 76, None, True), (20, 77, 3, False), (20, 1, 20, True),
        ], key=repr)
        groups = {(r.doc_id, r.n_shingles, r.component_id): r.group for r in got.collect()}
        assert groups[3, 76, 3] == groups[9, 76, 3] == groups[20, 77, 3] != groups[9, 76, 9] == groups[12, 77, 9]
        assert groups[12, 0, 12] is None and groups[None, 76, None] is None


def test_two_texts_of_one_id_represent_both(docs, monkeypatch):
    """Every id has two texts of different groups, so no class is told by its id."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    first, second = ([t for _, t in corpus(seed)] for seed in (4, 5))
    n = min(len(first), len(second))
    rows = [(i, t) for part in (first[:n], second[:n]) for i, t in enumerate(part)]
    want = brute(list(enumerate(t for _, t in rows)), 3, 85)
    got = minhash.near_duplicates(docs(rows), words=3, percent=85, detail=True).collect()
    texts: dict = {}
    for r in got:
        texts.setdefault((r.doc_id, r.mark), []).append((r.n_shingles, r.component_id, r.group))
    marks = {t: docs([(0, t)]).selectExpr("xxhash64(text)").first()[0] for t in {t for _, t in rows}}
    least: dict = {}
    for at, (_, c) in want.items():
        least[c] = min(least.get(c, n), rows[at][0])
    names: dict = {}
    for at, (i, t) in enumerate(rows):
        size, component = want[at]
        for found in texts[i, marks[t]]:
            assert found[:2] == (size, least[component])
            assert names.setdefault(component, found[2]) == found[2]
    assert len(set(names.values())) == len(names)


def test_links_across_a_group_are_not_lost(docs):
    """A chain in which the first document is near none but its neighbour."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(["x%d" % (j if j >= 4 * i else j + 1000 * (j // 4 + 1)) for j in range(60)])) for i in range(6)]
    rows.append((50, " ".join(words)))
    want = brute(rows, 3, 60)
    got = minhash.near_duplicates(docs(rows), words=3, percent=60).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_no_frame_is_written_that_is_read_once_or_cheap(docs, monkeypatch):
    """Every file in the checkpoint folder costs its executor the start of several processes. Across
    groups (blocks of 3) no step may write more than the twelve frames that need it."""
    written = []
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    rows = corpus(1)
    got = minhash.near_duplicates(docs(rows), words=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)
    assert ["band", "i", "j", "node", "component", "own"] in written
    assert len(written) <= 12 and ["node", "signature"] not in written


def test_least_matches_follow_the_posterior():
    least = minhash.least_matches(85, 1e-6)
    assert len(least) == minhash.HASHES // minhash.BATCH
    assert all(b > a for a, b in zip(least, least[1:], strict=False))
    # Numerical integral of the posterior of the similarity.
    s = np.linspace(0, 1, 200_001)[1:-1]
    for i, m in enumerate(least):
        n = (i + 1) * minhash.BATCH
        for agreed, enough in ((m, True), (m - 1, False)):
            density = agreed * np.log(s) + (n - agreed) * np.log1p(-s)
            density = np.exp(density - density.max())
            assert (density[s >= 0.85].sum() / density.sum() >= 1e-6) == enough


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = minhash.signatures([np.sort(x[:1000]), np.sort(x[500:])])
    assert abs((a == b).mean() - 500 / 1500) < 0.15


def test_components_on_random_graphs(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 400)]
    links += [(None, 5), (6, None), (9, 9)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(links + chain, "a long, b long").repartition(7)
    got = {r.id: r.component for r in components(df).collect()}
    want = forest((a, b) for a, b in links + chain if a is not None and b is not None and a != b)
    assert got == want
    assert components(df.limit(0)).collect() == []
