"""The passage classifier: encoding, gradient, held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from hirelens.llm import passage_quality as Q


def test_passages_hold_every_word():
    texts = ["", " \n", "one", "a b " * 100, "x" * 5000, "Up LOW 12, 34!"]
    rows, owner = Q.passages(texts)
    counts = [max(1, -(-len(t.split()) // Q.WORDS)) for t in texts]
    assert np.bincount(owner).tolist() == counts
    at = Q.KINDS + Q.PAIRS
    for i, t in enumerate(texts):
        assert abs(rows[owner == i][:, at].sum() * Q.WORDS - len(t.split())) < 1e-3
    assert not rows[owner == 0].any()
    assert rows.shape[1] == Q.FEATURES
    assert Q.passages([])[0].shape == (0, Q.FEATURES)


def test_passages_do_not_depend_on_the_batch(monkeypatch):
    texts = ["alpha Beta; gamma " * 60, "", "tail\n" * 3]
    whole, owner = Q.passages(texts)
    monkeypatch.setattr(Q, "CHUNK", 10)
    alone, again = Q.passages(texts)
    assert np.allclose(whole, alone) and (owner == again).all()


def test_gradient():
    rng = np.random.default_rng(0)
    x, owner = rng.normal(size=(7, Q.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2])
    w = {
        "W": rng.normal(size=(Q.FEATURES, Q.HIDDEN)) / 10, "b": rng.normal(size=Q.HIDDEN),
        "V": rng.normal(size=(Q.HIDDEN, Q.ATTENTION)), "U": rng.normal(size=(Q.HIDDEN, Q.ATTENTION)),
        "a": rng.normal(size=Q.ATTENTION), "c": rng.normal(size=Q.HIDDEN), "d": np.array(0.3),
    }
    y, importance = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        logit, _ = Q.forward(w, x, owner, 3)
        p = 1 / (1 + np.exp(-logit))
        return -(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / importance.sum()

    logit, kept = Q.forward(w, x, owner, 3)
    exact = Q.gradient(w, x, owner, 3, logit, kept, y, importance)
    for name in w:
        flat = w[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            before = flat[i]
            flat[i] = before + 1e-5
            up = loss()
            flat[i] = before - 1e-5
            down = loss()
            flat[i] = before
            assert abs((up - down) / 2e-5 - exact[name].reshape(-1)[i]) < 1e-5


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op2_passage_quality"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[x.doc_id].predicted, x.quality) for x in labels if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    again = entry.queries()["op2_passage_quality"](spark, sf_dir).collect()
    assert all(got[r.doc_id].score == r.score for r in again)


def test_edge_rows(spark, docs):
    good, bad = "plain words in a calm row", "BAD!! BAD!! ###"
    rows = [(i, (good if i % 2 else bad) * 8) for i in range(1, 60)]
    rows += [(100, None), (101, ""), (None, good), (102, bad * 20_000), (3, good), (3, good)]
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 60)] + [(3, 0), (None, 1), (4, None), (5, 7), (100, 1)], "doc_id long, quality int"
    )
    df = docs(rows)
    model = Q.train(df, labels)
    got = df.select("doc_id", "text", Q.score("text", model).alias("p")).collect()
    assert len(got) == len(rows) and all(0 <= r.p <= 1 for r in got)
    assert {r.p for r in got if r.doc_id in (100, 101)} == {next(r.p for r in got if r.doc_id == 101)}
    assert next(r.p for r in got if r.doc_id == 102) < 0.5 < next(r.p for r in got if r.doc_id == 7)

    one_class = Q.train(df, labels.filter("quality = 1"))
    none = Q.train(docs([]), labels.limit(0))
    scores = df.select(Q.score("text", one_class).alias("a"), Q.score("text", none).alias("b")).collect()
    assert all(r.a > 0.99 and abs(r.b - 0.5) < 1e-9 for r in scores)
    assert docs([]).select(Q.score(F.col("text"), model)).collect() == []


def plain_features(words):
    """Features of one passage (words with the white space before them), by counting."""
    kinds, pairs = np.zeros(Q.KINDS), np.zeros(Q.PAIRS)
    table = Q._byte_classes()
    for space, word in words:
        for c in space + word:
            kinds[table[c]] += 1
        low = bytes(c | 32 if 65 <= c <= 90 else c for c in word)
        for a, b in zip(low, low[1:]):
            pairs[((a << 8 | b) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % Q.PAIRS] += 1
    texts = [bytes(c | 32 if 65 <= c <= 90 else c for c in w) for _, w in words]
    size = np.array([len(w) for w in texts])
    last = [w[-1] for _, w in words]
    share = lambda marks: sum(marks) / len(words)
    rest = [
        len(words) / Q.WORDS, size.mean() / 10, size.std() / 10, share(a == b for a, b in zip(texts, texts[1:])),
        len(set(texts)) / len(words), share(chr(c) in Q.SIGNS for c in last), share(size <= 2), share(size >= 20),
    ]
    return np.concatenate([np.sqrt(kinds / max(1, kinds.sum())), np.sqrt(pairs / max(1, pairs.sum())), rest])


def test_score_equals_a_plain_document_by_document_computation():
    import re

    rng = np.random.default_rng(3)
    vocabulary = ["Word", "the", "THE", "rain!", "x", "é\u00fc", "12%", "aaaaaaaaaaaaaaaaaaaaaaaa", "end."]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 48, 49, 130, 400)]
    m = {k: rng.normal(size=s) for k, s in {
        "W": (Q.FEATURES, Q.HIDDEN), "b": (Q.HIDDEN,), "V": (Q.HIDDEN, Q.ATTENTION), "U": (Q.HIDDEN, Q.ATTENTION),
        "a": (Q.ATTENTION,), "c": (Q.HIDDEN,)}.items()} | {"d": np.array(0.3)}
    model = Q.Model(np.zeros(Q.FEATURES), np.ones(Q.FEATURES), m, 0.2)
    rows, owner = Q.passages(texts)
    got = model.score(rows, owner, len(texts))
    for i, text in enumerate(texts):
        words = re.findall(rb"([ \n]*)([^ \n]+)", text.encode() + b"\n")
        parts = [words[j : j + Q.WORDS] for j in range(0, len(words), Q.WORDS)]
        x = []
        for j, part in enumerate(parts):  # the space behind a passage's last word is its own
            part = [(b"" if k == 0 else s, w) for k, (s, w) in enumerate(part)]
            x.append(plain_features(part))
        kinds = slice(Q.KINDS, None)
        assert np.allclose(rows[owner == i][:, kinds], np.array(x)[:, kinds], atol=1e-5)
        h = [np.tanh(f @ m["W"] + m["b"]) for f in rows[owner == i].astype(float)]
        gate = [np.exp((np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"])))) @ m["a"]) for v in h]
        pooled = sum(g * v for g, v in zip(gate, h)) / sum(gate)
        assert abs(got[i] - 1 / (1 + np.exp(-(pooled @ m["c"] + 0.3 + 0.2)))) < 1e-4


def test_room_for_passages():
    assert Q._fitting([(1, 5), (2, 90), (3, 4), (4, 2)], 10) == [1, 3]
