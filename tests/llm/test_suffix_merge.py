"""Removed repeats against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from hirelens.llm import queries
from hirelens.llm import suffix_merge as sm


def plain(rows, length):
    """Rows (id, text) in order of their ids."""
    seen, out = set(), []
    for ident, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((ident, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, rows, length, **options):
    return sorted((tuple(r) for r in sm.remove_repeats(docs(rows), length, **options).collect()), key=repr)


def some_texts(seed, n=60, letters="ab", low=0, high=60):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)]
    for _ in range(n // 3):
        source = rng.choice(texts)
        at = rng.randint(0, len(source))
        texts.append(rng.choice(texts)[: rng.randint(0, 9)] + source[at : at + 40] + rng.choice(["", "x", "é"]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("length", [8, 15])
def test_merged_transforms(seed, length, monkeypatch):
    monkeypatch.setattr(sm, "SHARD", 50)
    monkeypatch.setattr(sm, "LETTER", 6)
    texts = [t.encode() for t in some_texts(seed, 40, "abc") if len(t) >= length]
    got = set()
    for number, a, b in sm.repeated(texts, length):
        got |= {(number, i) for i in range(a, b - length + 1)}
    seen, want = set(), set()
    for number, text in enumerate(texts):
        for i in range(len(text) - length + 1):
            want |= {(number, i)} if text[i : i + length] in seen else set()
            seen.add(text[i : i + length])
    assert got == want


@pytest.mark.parametrize("letter", [1, 3, 5, 12, 20])
def test_interleave_is_the_sorted_order(letter, monkeypatch):
    monkeypatch.setattr(sm, "LETTER", letter)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=rng.randint(5, 30))).encode() for _ in range(30)]
    t = sm.Transforms(texts, np.repeat(np.arange(6), 5), 12)
    places, interval = t.merged()
    joined = b"\0".join(texts) + b"\0"
    heads = [joined[p : p + 12] for p in places.tolist()]
    assert heads == sorted(heads) and len(set(places.tolist())) == sum(max(0, len(x) - 11) for x in texts)
    assert [a != b for a, b in zip(heads, heads[1:])] == (np.diff(interval) > 0).tolist()


def test_numbered_beyond_64_bits():
    high, low = np.array([5, 1 << 40, 5, 1]), np.array([1 << 40, 0, 1 << 40, 9])
    assert sm.numbered(high, low).tolist() == [1, 2, 1, 0]
    assert sm.numbered(np.array([5, 4, 5]), np.array([1, 0, 1])).tolist() == [1, 0, 1]


def test_passages_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(sm, "CHUNK", 64)
    monkeypatch.setattr(sm, "RUN", 7)
    texts = [t.encode() for t in some_texts(7, 30, "abc", 0, 400)] + [b"a" * 300, b""]
    begin, end, key, print_, loops = sm.Passages(12, 5).of(texts)
    joined, offset = b"".join(texts), np.cumsum([0, *map(len, texts)]).tolist()
    starts = [i for a, b in zip(begin.tolist(), end.tolist()) for i in range(a, b - 11)]
    assert sorted(starts) == [i for o, t in zip(offset, texts) for i in range(o, o + len(t) - 11)]
    for a, b, twice in zip(begin.tolist(), end.tolist(), loops.tolist()):
        inside = [joined[i : i + 12] for i in range(a, b - 11)]
        assert twice or len(set(inside)) == len(inside)
    whose, hashes = {}, {}
    for a, b, k, p in zip(begin.tolist(), end.tolist(), key.tolist(), print_.tolist()):
        assert whose.setdefault((k, p), joined[a:b]) == joined[a:b]
        for i in range(a, b - 11):
            assert hashes.setdefault(joined[i : i + 12], k) == k


@pytest.mark.parametrize("crowded", [2000, 1])
@pytest.mark.parametrize("seed", range(2))
def test_equals_dictionary(docs, seed, crowded, monkeypatch):
    for name, value in (("BLOCK", 400), ("CHUNK", 100), ("RUN", 5), ("RANGE", 40), ("BUCKET", 30), ("SHARD", 60), ("CROWDED", crowded)):
        monkeypatch.setattr(sm, name, value)
    rng = random.Random(seed)
    rows = list(zip(rng.sample(range(-50, 1000), k=80), some_texts(seed + 10)))
    assert found(docs, rows, 12, gram=5) == plain(rows, 12)


def test_edges(docs):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=2_500_000))
    passage = "".join(rng.choices("abcdé ", k=130))
    rows = [
        (None, "n" * 150 + passage), (5, None), (6, ""), (7, "short"), (8, long), (9, "x" + long[1_000_000:1_400_000] + "y"),
        (10, "a" * 5000), (11, passage), (12, passage[:98] + "?" + passage[98:]), (13, "ab" * 400), (14, long[:99]),
    ]
    assert found(docs, rows, 100) == plain(rows, 100)
    same = "".join(rng.choices("abc", k=300))
    twice = found(docs, [(3, same), (3, same), (4, same)], 100)
    assert sorted(r[2] for r in twice) == [0, 300, 300]
    assert found(docs, [], 100) == []
    assert found(docs, [(1, None), (1, None)], 100) == plain([(1, None), (1, None)], 100)


def test_changed_documents_raise():
    block = sm.Block([1], [b"a" * 200], sm.Passages(100, 40))
    with pytest.raises(ValueError):
        block.settled(np.zeros(7, np.uint8))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = queries.op13_suffix_merge(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows, 100)
