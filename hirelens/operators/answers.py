"""Questionnaire answers as columns."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .copies import spread, with_copies

KEYS = ["submission_id", "person_id"]
#: Answers of a crowded application to one question that are counted together, about.
RANGE_ROWS = 4096


def scoped_answers(responses: DataFrame, codes: dict[str, str], scope=None) -> DataFrame:
    """Answers to the given questions: submission_id, person_id, question_code, long_text."""
    for column, value in (scope or C.ANSWER_SCOPE).items():
        responses = responses.where(F.col(column) == value)
    return responses.where(F.col("question_code").isin(list(codes.values()))).select(
        F.col("subject_id").alias("submission_id"),
        F.col("participant_id").alias("person_id"),
        "question_code",
        "long_text",
    )


def answers_wide(
    subs: DataFrame,
    responses: DataFrame,
    codes: dict[str, str],
    scope: dict | None = None,
    mode: str = "all",
) -> DataFrame:
    """Left join each application with its answers, one column per question.

    ``mode='all'`` keeps every combination: two answers to one question and three
    to another give six rows. ``mode='one'`` gives one row per application with
    the greatest answer to each question.

    In mode 'all' applications take one of two lanes. Those with few answers to each question, nearly
    always all of them, are grouped and joined in one pass, and their combinations are written in place.
    One job looks for the others, by counts that are combined before they are shuffled; without
    any, there is no second lane. In it the answers to a question are cut into blocks of a few,
    numbered from counts over ranges of their hashes, and the combinations of blocks are dealt to the tasks. Neither
    a list, a window nor a task grows with the answers of one application.
    """
    answers = scoped_answers(responses, codes, scope)
    columns = [*subs.columns, *codes]
    if mode == "one":
        best = answers.groupBy(*KEYS).agg(
            *[F.max(F.when(F.col("question_code") == c, F.col("long_text"))).alias(name)
              for name, c in codes.items()]
        )
        return subs.join(best, KEYS, "left").select(*columns)
    if mode != "all":
        raise ValueError(f"unknown mode: {mode!r}")

    answers = answers.where(" and ".join(f"{key} is not null" for key in KEYS))
    crowded = _crowded(answers, max(1, int(C.COPIES_PER_ROW ** (1 / len(codes)))))
    if crowded is None:
        return _in_place(subs, answers, codes).select(*columns)

    def those(df: DataFrame, how: str) -> DataFrame:
        return df.join(crowded, KEYS, how)

    few = _in_place(those(subs, "left_anti"), those(answers, "left_anti"), codes)
    many = _dealt(those(subs, "left_semi"), those(answers, "left_semi"), codes)
    return few.select(*columns).unionByName(many.select(*columns))


def _crowded(answers: DataFrame, most: int) -> DataFrame | None:
    """Keys with more than ``most`` answers to a question, for broadcast if they are few; None without any."""
    counts = answers.groupBy(*KEYS, "question_code").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.where(F.col("n") > most).select(*KEYS).distinct()
    found = keys.limit(C.BROADCAST_ROWS + 1).collect()
    if not found:
        return None
    if len(found) > C.BROADCAST_ROWS:
        return keys
    return F.broadcast(answers.sparkSession.createDataFrame(found, keys.schema))


def _in_place(subs: DataFrame, answers: DataFrame, codes: dict[str, str]) -> DataFrame:
    """All combinations of answers, from short lists."""
    text = F.struct("long_text")
    lists = answers.groupBy(*KEYS).agg(
        *[F.collect_list(F.when(F.col("question_code") == code, text)).alias(name) for name, code in codes.items()]
    )
    out = subs.join(lists, KEYS, "left")
    for name in codes:
        out = out.withColumn(name, F.explode_outer(name))
    return out.withColumns({name: F.col(f"{name}.long_text") for name in codes})


def _dealt(subs: DataFrame, answers: DataFrame, codes: dict[str, str]) -> DataFrame:
    """All combinations of answers, the combinations of blocks dealt to the tasks."""
    out = subs.join(_cells(answers, codes), KEYS).repartition(spread(subs), *KEYS, "_cell")
    for name in codes:
        out = out.withColumn(name, F.explode_outer(name))
    copies = reduce(mul, [F.coalesce(F.col(f"{name}.copies"), F.lit(1)) for name in codes])
    out = out.withColumn("_copies", copies)
    out = out.withColumns({name: F.col(f"{name}.long_text") for name in codes})
    times = F.array_repeat(F.lit(True), F.col("_copies").cast("int"))
    return out.withColumn("_copy", F.explode(times))


def _cells(answers: DataFrame, codes: dict[str, str]) -> DataFrame:
    """submission_id, person_id, _cell and for each question a short list of (text, copies).

    A cell is a combination of blocks, one of each question that has answers; blocks
    are numbered, and the cell's number has the block numbers as its digits.
    """
    size = max(2, int(C.COPIES_PER_ROW ** (1 / len(codes)) / 2))
    totals = answers.groupBy(*KEYS).agg(
        *[F.count(F.when(F.col("question_code") == code, 1)).alias(f"_n{i}") for i, code in enumerate(codes.values())]
    )
    texts = _blocks(with_copies(answers), size).join(totals, KEYS)
    counts = [F.greatest(F.lit(1), F.expr(f"cast(ceil(_n{i} / {size}) as long)")) for i in range(len(codes))]
    own, stride = F.lit(1), F.lit(1)
    for i, code in enumerate(codes.values()):
        mine = F.col("question_code") == code
        own = F.when(mine, counts[i]).otherwise(own)
        stride = F.when(mine, reduce(mul, counts[:i], F.lit(1))).otherwise(stride)
    total = reduce(mul, counts)
    texts = texts.withColumns({"_own": own.cast("long"), "_stride": stride.cast("long"), "_total": total.cast("long")})
    # All numbers that have this block as their digit for this question.
    cells = F.expr(
        "transform(sequence(0L, _total div _own - 1), i -> "
        "(i div _stride) * _stride * _own + _block * _stride + i % _stride)"
    )
    texts = texts.withColumn("_cell", F.explode(cells))
    entry = F.struct("long_text", "copies")
    return texts.groupBy(*KEYS, "_cell").agg(
        *[F.collect_list(F.when(F.col("question_code") == code, entry)).alias(name)
          for name, code in codes.items()]
    )


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """Texts with copies cut into entries of ``size`` copies at most, and the block of each: of the copies of a
    question, counted through, the block of an entry is that of its last copy, so no block is empty.

    Entries fall into ranges by a hash. The count before an entry is that of the ranges before its own, from
    one row for each range, and that of the entries before it in its range."""
    last = F.expr(f"cast((copies - 1) div {size} as int)")
    entries = texts.withColumn("_part", F.explode(F.sequence(F.lit(0), last)))
    rest = F.col("copies") - F.col("_part").cast("long") * F.lit(size)
    question, in_range = [*KEYS, "question_code"], [*KEYS, "question_code", "_range"]
    ranges = texts.groupBy(*question).agg(F.expr(f"cast(ceil(count(1) / {RANGE_ROWS}) as long)").alias("_ranges"))
    entries = entries.withColumn("copies", F.least(rest, F.lit(size))).join(ranges, question)
    entries = entries.withColumn("_range", F.expr("pmod(xxhash64(long_text, _part), _ranges)")).drop("_ranges")

    up_to = Window.partitionBy(*question).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = entries.groupBy(*in_range).agg(F.sum("copies").alias("_before"))
    counted = counted.withColumn("_before", F.coalesce(F.sum("_before").over(up_to), F.lit(0)))
    running = F.sum("copies").over(Window.partitionBy(*in_range).orderBy("long_text", "_part"))
    placed = entries.withColumn("_running", running).join(counted, in_range)
    return placed.withColumn("_block", F.expr(f"(_before + _running - 1) div {size}")).drop("_before", "_running", "_range")
