"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``WORDS`` words. Every passage is encoded: rates of
character classes, of hashed letter pairs and of repeated, short and long words, then one
dense layer. Labels are known for documents only, so gated attention learns how much each
passage counts; the score is that of the weighted sum of the encoded passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, crc_remainder, pieces_of, texts_of

WORDS, PAIRS, HIDDEN, ATTENTION = 48, 96, 24, 12
#: Labelled documents per class that the classifier is fitted on (those of the smallest hash
#: of their id), and passages of all of them, half for each class.
SAMPLE, PASSAGES = 800, 100_000
STEPS, RATE, DECAY, SEED = 200, 0.01, 1e-4, 7
#: Bytes of text that are scored, and those that features are taken of, at a time.
PIECE, CHUNK = 1_000_000, 100_000

SIGNS = '.,;:!?"\'-_#%&*$@|/\\<>()[]{}=+~^`'


@cache
def _byte_classes() -> np.ndarray:
    """0 white space, 1 line end, 2 lower, 3 upper, 4 digit, 5 above ASCII, then each sign."""
    table = np.zeros(256, np.int64)
    table[10] = 1
    table[97:123], table[65:91], table[48:58], table[128:] = 2, 3, 4, 5
    for i, sign in enumerate(SIGNS):
        table[ord(sign)] = 6 + i
    return table


KINDS = 6 + len(SIGNS)
FEATURES = KINDS + PAIRS + 8


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a batch of texts, and the text that each belongs to. A text
    without words is one passage without features."""
    out, owners = [], []
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for lo, hi in chunks(list(map(len, encoded)), CHUNK):
        rows, owner = _chunk(encoded[lo:hi])
        out.append(rows)
        owners.append(owner + lo)
    if not out:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


def _chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    ends = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))
    word_text = np.repeat(np.arange(len(texts)), lengths)[starts]
    words_in = np.bincount(word_text, minlength=len(texts))
    first_word = np.cumsum(words_in) - words_in
    count = np.maximum(1, -(-words_in // WORDS))
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts)), count)
    n = int(count.sum())
    word_passage = first[word_text] + (np.arange(len(starts)) - first_word[word_text]) // WORDS
    # A byte belongs to the passage of the last word that began, at first to the text's first.
    marks = np.concatenate((np.cumsum(lengths) - lengths, starts))
    order = np.argsort(marks, kind="stable")
    place = np.repeat(np.concatenate((first, word_passage))[order], np.diff(marks[order], append=len(data)))

    kinds = _byte_classes()[data]
    by_kind = np.bincount(place * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    low = np.where(kinds == 3, data | 32, data).astype(np.uint64)
    pair = ((low[:-1] << np.uint64(8) | low[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    letters = ~white[:-1] & ~white[1:]
    at = place[:-1][letters] * PAIRS + (pair[letters] % np.uint64(PAIRS)).astype(np.int64)
    by_pair = np.bincount(at, minlength=n * PAIRS).reshape(n, PAIRS)

    size = (ends - starts).astype(np.float64)
    before = np.concatenate((np.full(1, 32, np.uint64), np.where(white, np.uint64(32), low)[:-1]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(before << np.uint64(8) | low), dtype=np.uint64)))
    word_hash = sums[ends] - sums[starts]
    again = np.zeros(len(starts), bool)
    again[1:] = (word_hash[1:] == word_hash[:-1]) & (word_passage[1:] == word_passage[:-1])
    key = _mix(word_hash + word_passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    distinct = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    per = np.bincount(word_passage, minlength=n).astype(np.float64)
    some = np.maximum(per, 1)
    mean = lambda x: np.bincount(word_passage, x, minlength=n) / some
    average = mean(size)
    last = kinds[ends - 1]
    words = np.stack(
        [
            per / WORDS,
            average / 10,
            np.sqrt(np.maximum(0, mean(size**2) - average**2)) / 10,
            mean(again.astype(float)),
            np.bincount(word_passage[order], distinct.astype(float), minlength=n) / some,
            mean((last >= 6).astype(float)),
            mean((size <= 2).astype(float)),
            mean((size >= 20).astype(float)),
        ],
        axis=1,
    )
    total = np.maximum(by_kind.sum(1, keepdims=True), 1)
    features = np.concatenate(
        (np.sqrt(by_kind / total), np.sqrt(by_pair / np.maximum(by_pair.sum(1, keepdims=True), 1)), words), axis=1
    )
    features[per == 0] = 0
    return features.astype(np.float32), owner


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass
class Model:
    """Weights: scaling, encoder, the two halves of the gate, attention, and the classifier."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float

    def score(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for each of n documents, all of which have a passage."""
        logit, _ = forward(self.weights, (rows - self.centre) * self.scale, owner, n)
        return 1 / (1 + np.exp(-np.clip(logit + self.shift, -40, 40)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, n: int):
    """Logits of the documents, and what the gradient needs; owner is sorted."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    a = (t * g) @ w["a"]
    starts = np.searchsorted(owner, np.arange(n))
    a = np.exp(a - np.maximum.reduceat(a, starts)[owner])
    a = a / np.add.reduceat(a, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return z @ w["c"] + w["d"], (h, t, g, a, z)


def gradient(w, x, owner, n, logit, kept, target, importance) -> dict[str, np.ndarray]:
    """Gradient of the weighted mean cross entropy."""
    h, t, g, a, z = kept
    error = ((1 / (1 + np.exp(-logit)) - target) * importance / importance.sum()).astype(np.float32)
    dz = error[:, None] * w["c"]
    dzo = dz[owner]
    da = (dzo * (h - z[owner])).sum(1) * a
    dt, dg = da[:, None] * w["a"] * g * (1 - t * t), da[:, None] * w["a"] * t * g * (1 - g)
    dh = (a[:, None] * dzo + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return {
        "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ da,
        "c": z.T @ error, "d": np.array(error.sum()),
    }


def fit(rows: np.ndarray, owner: np.ndarray, target: np.ndarray, odds: float) -> Model:
    """Fit to passages (owner sorted) and document labels. Classes weigh the same while the
    weights are learned; ``odds`` of label 1 in all training labels then shift the logit."""
    rng = np.random.default_rng(SEED)
    centre = rows.mean(0)
    scale = 1 / np.maximum(rows.std(0), 0.01)
    x, n = ((rows - centre) * scale).astype(np.float32), len(target)
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION)}
    w = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    w |= {"b": np.zeros(HIDDEN, np.float32), "d": np.array(0.0, np.float32)}
    w |= {k: (rng.normal(size=m) / np.sqrt(m)).astype(np.float32) for k, m in (("a", ATTENTION), ("c", HIDDEN))}
    ones = max(1, target.sum())
    importance = np.where(target == 1, n / (2 * ones), n / (2 * max(1, n - ones)))
    target = target.astype(np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        logit, kept = forward(w, x, owner, n)
        for k, d in gradient(w, x, owner, n, logit, kept, target, importance).items():
            d = (d + DECAY * w[k]).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            w[k] = (w[k] - RATE * move).astype(np.float32)
    return Model(centre, scale, w, float(np.log(odds)))


def _passage_rows(text: Column) -> Column:
    """Features of all passages of a text, as packed floats."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = texts_of(batch)
            rows, owner = passages(texts)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.array([rows[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def _fitting(sizes: list[tuple[int, int]], room: int) -> list[int]:
    """Of (id, passages) the ids that fit into the room, each taken in turn if it still does."""
    out = []
    for ident, n in sizes:
        if n <= room:
            out.append(ident)
            room -= n
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    sample: int = SAMPLE,
) -> Model:
    """Fit the classifier to labelled documents outside the held-out fold (crc32 of the id as
    text, modulo ``folds``, is 0). At most ``sample`` documents of each class are used, those
    with the smallest hash of their id, each with all its passages; one that doesn't fit any more into
    the class's half of ``PASSAGES`` is passed over. Null labels and ids are left out; of several labels
    of an id the largest counts, of several texts the last in order. Without labels of both classes
    every score is the share of label 1 among the labels, 0.5 without any."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter(crc_remainder("id", folds) != 0)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # 2 * sample rows at most
    found = texts.join(chosen, "id").groupBy("id", "y").agg(F.max("text").alias("text"))
    bags = checkpointed(found.select("id", "y", _passage_rows(F.col("text")).alias("x")))
    sizes = bags.select("id", "y", F.xxhash64("id").alias("h"), F.expr(f"octet_length(x) div {4 * FEATURES}").alias("n"))
    sizes = sorted(sizes.collect(), key=lambda r: (r.h, r.id))  # 2 * sample rows at most
    taken = {i for y in (0, 1) for i in _fitting([(r.id, r.n) for r in sizes if r.y == y], PASSAGES // 2)}
    bags = bags if len(taken) == len(sizes) else bags.filter(F.col("id").isin(list(taken)))
    bags = sorted(bags.collect(), key=lambda r: r.id)
    target = np.array([r.y for r in bags])
    one, all_ = counts.get(1, 0), max(1, sum(counts.values()))
    if len(set(target)) < 2:
        share = one / all_ if counts else 0.5
        return _constant(min(max(share, 1e-6), 1 - 1e-6))
    rows = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in bags]
    owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    return fit(np.concatenate(rows), owner, target, one / max(1, counts.get(0, 0)))


def _constant(share: float) -> Model:
    zeros = {
        "W": np.zeros((FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, ATTENTION)),
        "U": np.zeros((HIDDEN, ATTENTION)), "a": np.zeros(ATTENTION), "c": np.zeros(HIDDEN), "d": np.array(0.0),
    }
    return Model(np.zeros(FEATURES), np.ones(FEATURES), zeros, float(np.log(share / (1 - share))))


def score(text: Column | str, model: Model) -> Column:
    """Probability that a text has label 1, from its words alone; null counts as empty, and an
    empty text has the score of a passage without features. Whole texts are read."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for lo, hi, texts in pieces_of(batch, PIECE):
                rows, owner = passages(texts)
                out.append(model.score(rows, owner, hi - lo))
            yield pa.array(np.concatenate(out).astype(np.float64) if out else [], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)
