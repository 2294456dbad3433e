"""What Python workers keep: several live in every executor, beside a JVM that takes most of its memory."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers as P
import pytest

from hirelens.llm import byte_bpe, components, minhash, passage_quality, pretokens, queries

RANKS = P.path(queries.BPE_RANKS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randrange(2, 9))) for _ in range(3000)]
    return [" ".join(rng.choices(words, k=800)) for _ in range(500)]


def peak(work) -> float:
    """MB that are allocated at once, beyond what was there."""
    work()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def through(items) -> None:
    for _ in items:
        pass


def test_a_batch_of_texts_is_worked_off_in_small_pieces(texts):
    assert sum(map(len, texts)) > 2_000_000
    assert peak(lambda: through(byte_bpe.encode_batch(texts, RANKS))) < 10
    assert peak(lambda: through(minhash.shingle_sets(texts, 5))) < 20
    assert peak(lambda: passage_quality.passages(texts)) < 25


def test_tables_are_made_in_small_pieces():
    assert peak(pretokens.codepoint_classes.__wrapped__) < 10
    minhash._powers.cache_clear()
    assert peak(lambda: through(minhash.shingle_sets(["a few words " * 3], 3))) < 10
    assert minhash._powers.cache_info().currsize <= 1


def test_results_do_not_depend_on_the_pieces(texts, monkeypatch):
    some = [*texts[:40], "", "x" * 3000, texts[0] * 20]
    work = (
        lambda: list(byte_bpe.encode_batch(some, RANKS)),
        lambda: [s.tobytes() for s in minhash.shingle_sets(some, 5)],
        lambda: [x.tobytes() for x in passage_quality.passages(some)],
    )
    want = [f() for f in work]
    for size in (1000, 10_000_000):
        for module in (byte_bpe, minhash, passage_quality):
            monkeypatch.setattr(module, "CHUNK", size)
        assert [f() for f in work] == want


def chained(plan: str) -> list[str]:
    """Python operators that feed another one within a stage."""
    found, above = [], []
    for line in plan.splitlines():
        name = line.lstrip(" :+-")
        depth = len(line) - len(name)
        name = name.split(") ", 1)[-1] if name.startswith("*(") else name
        above = [x for x in above if x[0] < depth]
        kind = "python" if name.startswith(("MapInArrow", "ArrowEvalPython")) else name.split(" ")[0]
        if kind == "python":
            stage = [k for _, k in above]
            last = max((i for i, k in enumerate(stage) if "Exchange" in k), default=-1)
            found += [name] * ("python" in stage[last + 1 :])
        above.append((depth, kind))
    return found


def test_near_duplicates_run_one_python_operator_in_a_stage(spark, docs, texts, monkeypatch):
    plans = []

    def recorded(frame, real=minhash.checkpointed):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame)

    for module in (components, minhash):
        monkeypatch.setattr(module, "checkpointed", recorded)
    rows = [(i, t + f" end{i}") for i, t in enumerate([*texts[:5], *texts[:3], texts[0]])]
    kept = minhash.near_duplicates(docs(rows)).filter("kept").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3, 4]
    assert sum("MapInArrow" in p or "ArrowEvalPython" in p for p in plans) >= 4
    assert [c for p in plans for c in chained(p)] == []
