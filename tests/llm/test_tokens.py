"""Byte-level BPE and token counts against the libraries that define them."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from hirelens.llm import byte_bpe, pretokens, token_counts

RANKS, FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SIGNS = [
    " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'", "''", "'s", "'re", "'r", "'ll", "'l", "'ve", "'v", "'S",
    "l", "e", "s", "t", "a", "B", "é", "中", "1", "²", "Ⅷ", "!", "...", "😀", "\u0301", "\x1c", "\x85",
    "<|endoftext|>", "\r\n", " a", " 1", " !", "ab" * 70, "a" * 21, "\u0558", "\ud7ff",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(SIGNS, k=rng.randrange(40))) for _ in range(3000)]
    return [*made, "", "x" * 30_000, " " * 5_000, "ab'c " * 20_000, *made[:5]]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(RANKS), special_tokens={})


def test_boundaries_are_those_of_the_pattern(texts):
    pieces, before = pretokens.pieces(texts)
    singles = {bytes([i]): i for i in range(256)}
    whole = tiktoken.Encoding("bytes", pat_str=P.PATTERN, mergeable_ranks=singles, special_tokens={})
    split = pre_tokenizers.Split(Regex(P.PATTERN), "isolated")
    for i, text in enumerate(texts):
        mine = pieces[before[i] : before[i + 1]]
        assert "".join(mine) == text
        assert mine == [p for p, _ in split.pre_tokenize_str(text)]
        assert bytes(whole.encode_ordinary(text)) == text.encode()


def test_scan_equals_a_walk_through_the_states(texts):
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        kinds = rng.integers(0, pretokens.CLASSES, n).astype(np.uint8)
        state, walked = pretokens.START, []
        for kind in kinds:
            walked.append(state)
            state = pretokens._next_state(state, int(kind))
        assert pretokens._states(kinds).tolist() == walked


def test_encoding_equals_the_library(texts, library):
    for text, packed in zip(texts, byte_bpe.encode_batch(texts, RANKS), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert byte_bpe.decode_ids(packed, RANKS) == text.encode()
        starts = np.frombuffer(byte_bpe.offsets_of(packed, RANKS), "<u4").tolist()
        raw = text.encode()
        ends = [*starts[1:], len(raw)][: len(starts)]
        assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [
            library.decode_single_token_bytes(i) for i in ids
        ]


def test_long_pieces_merge_as_short_ones_do(library):
    rng = random.Random(4)
    for _ in range(20):
        word = "".join(rng.choices("abcdefghin", k=rng.randrange(65, 400)))
        assert byte_bpe.merge(word.encode(), RANKS) == library.encode_ordinary(word)


def test_cache_that_is_emptied_changes_nothing(texts, monkeypatch):
    want = list(byte_bpe.encode_batch(texts[:500], RANKS))
    monkeypatch.setattr(byte_bpe, "CACHED", 0)
    monkeypatch.setattr(byte_bpe, "CHUNK", 50)
    assert list(byte_bpe.encode_batch(texts[:500], RANKS)) == want


def test_counts_equal_the_library(texts, monkeypatch):
    want = [len(e.ids) for e in Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)]
    assert list(token_counts.count_batch(texts, FILE)) == want
    monkeypatch.setattr(token_counts, "CACHED", 0)
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    monkeypatch.setattr(token_counts, "SYMBOLS", 100)
    assert list(token_counts.count_batch(texts, FILE)) == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Merges(P.path("word_bpe_49k.json"))


def test_columns(docs, library):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "w" * 100_000)]
    df = docs(rows)
    texts = dict(rows)
    encoded = byte_bpe.encode(df, RANKS, parts=("ids", "offsets", "decoded"))
    got = encoded.withColumn("back", byte_bpe.decode(F.col("ids"), RANKS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        text = texts[r.doc_id] or ""
        want = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.ids) == want and bytes(r.decoded) == bytes(r.back) == text.encode()
        assert len(r.offsets) == len(r.ids)
    counted = df.select("doc_id", token_counts.token_count("text", FILE).alias("count")).collect()
    assert len(counted) == len(rows)
    for r in counted:
        text = texts[r.doc_id] or ""
        assert r["count"] == len(Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids)
    none = df.limit(0)
    assert byte_bpe.encode(none, RANKS).collect() == none.select(token_counts.token_count("text", FILE)).collect() == []


def test_registered_queries(spark, library):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counter = Tokenizer.from_file(FILE)
    rows = entry.queries()["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in entry.queries()["op9_token_counts"](spark, sf_dir).collect():
        n = len(counter.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
