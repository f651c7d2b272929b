"""One ranking from several differently scaled scores by weighted Borda points (problem 7).

Every score ranks the items of its group; an item's points for a score are its place, the share of the group's items
with a lower one, so no scale or shape matters, and the weighted points add up. Ties share their place: ``ties="below"``
counts strictly lower scores, ``"average"`` gives tied items the mean of the places they fill. Missing scores, null and NaN
alike, are lower than all others with place 0 (``missing="last"``), or get the mean place of the items that have the score
(``"middle"``), which then is a share of those.

Groups of at most ``RANGE`` items, which is measured, are ranked by windows of one shuffle. In larger ones, ranks are computed
over value ranges of about ``RANGE`` items: offsets between ranges come from counts, so a group that holds a third of all
rows is spread over many tasks and sorted nowhere as a whole.

Defined results: an item in several rows has the row that ``latest`` orders last, ties between those by the
larger scores; rows without a group or item are left out; a null weight counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import broadcast_if_small, materialize, small

RANGE = 50_000


def latest_rows(scores: DataFrame, group: str, item: str, columns: list[str], latest: str) -> DataFrame:
    """One row for each group and item: the one ordered last by ``latest``; combined before the shuffle."""
    clean = [F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) for c in columns]
    best = scores.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(F.max(F.struct(F.col(latest), *clean)).alias("_best"))
    return best.select(group, item, *(F.col(f"_best.{c}").alias(c) for c in columns))


def _place(n: Column, m: Column, below: Column, score: Column, missing: str) -> Column:
    """The place of a score with ``below`` lower ones, in a group of ``n`` items of which ``m`` have the score."""
    if missing == "last":
        return F.when(score.isNotNull(), (n - m + below) / n).otherwise(F.lit(0.0))
    return F.when(score.isNotNull(), below / m).when(m > 0, (m - 1) / (m * 2)).otherwise(F.lit(0.0))


def places(df: DataFrame, group: str, scores: list[str], out: list[str], ties: str = "below", missing: str = "last") -> DataFrame:
    """``df`` with the places by each of ``scores`` in the columns ``out``; for groups that one task can hold."""
    whole = Window.partitionBy(group)
    df = df.withColumn("_n", F.count("*").over(whole))
    for c, o in zip(scores, out):
        by = whole.orderBy(F.asc_nulls_last(c))
        df = df.withColumn(f"_m{o}", F.count(c).over(whole)).withColumn(f"_b{o}", F.rank().over(by) - F.lit(1))
        if ties == "average":
            df = df.withColumn(f"_b{o}", F.col(f"_b{o}") + (F.count("*").over(by.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2)
    df = df.select("*", *(_place(F.col("_n"), F.col(f"_m{o}"), F.col(f"_b{o}"), F.col(c), missing).alias(o) for c, o in zip(scores, out)))
    return df.drop("_n", *(f"_{x}{o}" for o in out for x in "mb"))


def range_places(df: DataFrame, group: str, score: str, out: str, ties: str = "below", missing: str = "last", range_rows: int = RANGE) -> DataFrame:
    """``places`` by one score, for groups that no task can hold.

    Counts of equal scores are combined first, so neither ties nor missing scores gather rows; the different scores of a
    group are cut at bounds of a mergeable quantile sketch, whose error moves only the cuts. Missing scores do not join.
    """
    sizes = materialize(df.groupBy(group).agg(F.count("*").alias("_n"), F.count(score).alias("_m")))
    known = broadcast_if_small(sizes, 200_000)
    values = materialize(df.filter(F.col(score).isNotNull()).groupBy(group, F.col(score).alias("_v")).agg(F.count("*").alias("_c")))
    share = F.array(*(F.lit(k / 256) for k in range(1, 256)))
    bounds = values.groupBy(group).agg(F.when(F.count("*") > range_rows, F.array_distinct(F.percentile_approx("_v", share, 2_000))).alias("_bounds"))
    range_of = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_v"))), F.lit(0))
    values = values.join(broadcast_if_small(bounds, 1_000), group, "left").withColumn("_range", F.when(F.col("_bounds").isNull(), 0).otherwise(range_of)).drop("_bounds")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy(group, "_range").agg(F.sum("_c").alias("_c")).select(group, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = values.withColumn("_inner", F.coalesce(F.sum("_c").over(inner), F.lit(0))).join(offsets, [group, "_range"])
    lower = F.col("_offset") + F.col("_inner") + ((F.col("_c") - 1) / 2 if ties == "average" else F.lit(0))
    have = df.filter(F.col(score).isNotNull()).join(below.select(group, F.col("_v").alias(score), lower.alias("_below")), [group, score])
    rest = df.filter(F.col(score).isNull()).withColumn("_below", F.lit(None).cast("double"))
    joined = have.select(*df.columns, F.col("_below").cast("double").alias("_below")).unionByName(rest).join(known, group)
    return joined.withColumn(out, _place(F.col("_n"), F.col("_m"), F.col("_below"), F.col(score), missing)).drop("_below", "_n", "_m")


def fused(
    scores: DataFrame, weights: DataFrame, group: str, item: str, columns: list[str], weight_of: dict[str, str],
    ties: str = "below", missing: str = "last", range_rows: int = RANGE,
) -> DataFrame:
    """``(group, item, points)``; ``weights`` has a row for each group, ``weight_of`` names its column for a score.
    ``scores`` is read more than once, so it should be a written table."""
    names = [f"_place_{k}" for k in range(len(columns))]
    large = materialize(scores.groupBy(group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > range_rows).select(group))
    if small(large, 0):
        df = places(scores, group, columns, names, ties, missing)
    else:
        large = broadcast_if_small(large, 200_000)
        df = scores.join(large, group, "left_semi")
        for c, n in zip(columns, names):
            df = range_places(df, group, c, n, ties, missing, range_rows)
        df = places(scores.join(large, group, "left_anti"), group, columns, names, ties, missing).unionByName(df)
    df = df.join(broadcast_if_small(weights, 200_000), group)
    points = sum((F.col(n) * (F.coalesce(F.col(weight_of[c]).cast("double"), F.lit(1.0)) if c in weight_of else F.lit(1.0)) for c, n in zip(columns, names)), F.lit(0.0))
    return df.withColumn("points", points)


def top(ranked: DataFrame, limits: DataFrame, group: str, item: str, limit: str, default: int) -> DataFrame:
    """The first ``limit`` items of each group by points, then by item; null limits are ``default``.

    The largest limit, looked up in ``limits``, the table of groups, bounds every group before its rows meet in one task.
    """
    most = limits.agg(F.max(F.coalesce(limit, F.lit(default)))).first()[0] or 0
    w = Window.partitionBy(group).orderBy(F.desc("points"), item)
    first = ranked.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= int(most))
    return first.filter(F.col("_place") <= F.coalesce(limit, F.lit(default))).drop("_place")


def query_ranking(page_scores: DataFrame, search_queries: DataFrame, ties: str = "below", missing: str = "last", range_rows: int = RANGE) -> DataFrame:
    """All documents of every query with their points: tf-idf places plus weighted PageRank places."""
    scores = materialize(latest_rows(page_scores.select("query_id", "doc_id", "tf_idf_score", "current_pr", "scored_at"), "query_id", "doc_id", ["tf_idf_score", "current_pr"], "scored_at"))
    weights = search_queries.select("query_id", "top_k", "page_rank_weight").dropDuplicates(["query_id"])
    return fused(scores, weights, "query_id", "doc_id", ["tf_idf_score", "current_pr"], {"current_pr": "page_rank_weight"}, ties, missing, range_rows)
