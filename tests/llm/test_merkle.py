"""The Merkle manifest against a plain tree on the driver."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hirelens.llm import merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, **other):
    row = {**row, **other}
    return h("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS)


def tree(nodes):
    """Root and, for each node, the lists (before, after) of its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append((nodes[run:p], nodes[p + 1 : run + 8]))
        nodes = [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def plain(rows, tampered):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of, out = {}, []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (first(r["doc_id"]), leaf(r)))
        of[lang] = (mine, *tree([leaf(r) for r in mine]))
    root, upper = tree([of[lang][1] for lang in langs])
    for lang, above in zip(langs, upper, strict=True):
        mine, subroot, paths = of[lang]
        for row, path in zip(mine, paths, strict=True):
            steps = path + above
            cur = leaf(row, text=tampered(row))
            for before, after in steps:
                cur = h([*before, cur, *after])
            proof = h(d for before, after in steps for d in [*before, *after])
            out.append((row["doc_id"], leaf(row), subroot, root, proof, cur, cur == root))
    return sorted(out, key=repr)


def lowered(row):
    hit = zlib.crc32(("" if row["doc_id"] is None else str(row["doc_id"])).encode()) % 3 == 0
    text = row["text"]
    return text if text is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def found(df):
    lower = F.translate("text", queries.ascii_uppercase, queries.ascii_lowercase)
    tampered = F.when(queries.crc_remainder("doc_id", 3) == 0, lower).otherwise(F.col("text"))
    out = merkle.manifest(df, changed={"text": tampered}).drop("steps")
    return sorted((tuple(r) for r in out.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    if extra:
        for c in ("id", "grp", "tree", "idx", "lo", "hi", "digest", "parts", "rank", "steps", "part", "place", "salt", "of"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def row(i, text="Some Text", lang="en", source="s", n=3):
    return dict(doc_id=i, text=text, lang=lang, source=source, n_chars=n)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {"en": 65, "fr": 64, None: 8, "é": 2, "z": 1}])
def test_trees_of_many_shapes(spark, sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 7
            rows.append(row(i % 101 + 1000 * i, f"Text {i} Ünd É", lang))
    assert found(frame(spark, rows, True)) == plain(rows, lowered)


def test_many_groups(spark):
    rows = [row(i, f"T{i}", f"lang{i % 75}") for i in range(200)]
    assert found(frame(spark, rows)) == plain(rows, lowered)


def test_nulls_repeats_and_long_texts(spark):
    rows = [row(None, None, None, None, None), row(None, "X", None), row(5, "A" * 2_000_000), row(5, ""), row(5, ""), row(6, None)]
    rows += [row(7, "Same")] * 20 + [row(8, "no capitals")] * 3
    got = found(frame(spark, rows))
    assert got == plain(rows, lowered)
    assert all(r[-1] for r in got if r[0] in (8, 6))


def test_empty(spark):
    df = merkle.manifest(frame(spark, []))
    assert df.collect() == [] and "verified" in df.columns


def test_one_group_is_cut_over_partitions(spark, tmp_path):
    df = spark.range(4000).select(F.lit("one").alias("grp"), F.lit(1).alias("id"))
    out = merkle.ranked(df, ["grp", "id"], str(tmp_path / "r"))
    assert sorted(r["rank"] for r in out.collect()) == list(range(4000))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    out = queries.op12_merkle(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain(rows, lowered)
