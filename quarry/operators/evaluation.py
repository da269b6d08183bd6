"""Retrieval evaluation: metrics at k, macro means, distributions and threshold calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.graphs import cut
from quarry.operators.relational import prefix_sums


def metrics_at_k(ranking: DataFrame, qrels: DataFrame, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at ``k`` for each judged or ranked query.

    ``ranking`` has a rank from 1; a document counts once, at its best rank. Precision divides by k.
    Recall and reciprocal rank are null without relevant documents, nDCG is null where the ideal is
    0; the ideal takes all judged grades. Unjudged documents have grade 0.
    """
    once = ranking.groupBy(query, doc).agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("rank", doc))
    cut = once.withColumn("place", place).filter(F.col("place") <= k).join(qrels.select(query, doc, "grade"), [query, doc], "left")
    gain = lambda g, at: (F.pow(F.lit(2.0), g) - 1) / F.log2(at + 1)
    got = cut.groupBy(query).agg(
        F.count_if(F.col("grade") > 0).alias("hits"), F.min(F.when(F.col("grade") > 0, F.col("place"))).alias("first"),
        F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("place"))).alias("dcg"),
    )
    ideal_place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), doc))
    ideal = qrels.withColumn("at", ideal_place).groupBy(query).agg(F.count_if(F.col("grade") > 0).alias("relevant"), F.sum(F.when(F.col("at") <= k, gain(F.col("grade"), F.col("at")))).alias("ideal"))
    both = got.join(ideal, query, "full_outer").fillna(0, ["hits", "relevant", "dcg", "ideal"])
    some = F.col("relevant") > 0
    return both.select(
        query, F.round(F.col("hits") / k, 6).alias("precision"), F.when(some, F.round(F.col("hits") / F.col("relevant"), 6)).alias("recall"),
        F.when(some, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"), F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 6)).alias("ndcg"),
    )


def macro(metrics: DataFrame, *names: str) -> DataFrame:
    """Means over the queries that define a metric, and how many don't."""
    means = [F.round(F.avg(n), 6).alias(f"mean_{n}") for n in names]
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *means, *(F.count_if(F.col(n).isNull()).alias(f"undefined_{n}") for n in names))


def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, minimum, interpolated median and 95th percentile, maximum."""
    p = lambda q, n: F.round(F.percentile(value, F.lit(q)), 6).alias(n)
    return df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("least"), p(0.5, "p50"), p(0.95, "p95"), F.max(value).alias("most"))


def at_place(df: DataFrame, group: str, value: str, places: DataFrame) -> DataFrame:
    """Per group the value at a place in order, from 0, that ``places`` (group, place) tells. Equal values are counted first."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = prefix_sums(counted, [group, value], ["_n"])
    before = summed.groupBy(group).agg(F.min(F.col("_n_sum") - F.col("_n")).alias("_first"))
    reached = summed.join(places.select(group, F.col("place").alias("_place")), group).join(before, group).filter(F.col("_n_sum") - F.col("_first") > F.col("_place"))
    return reached.groupBy(group).agg(F.min(value).alias(value))


def nearest_rank(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Per group the value at place int(q * (n - 1)) in order; not interpolated."""
    places = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.floor(F.lit(q) * (F.count(F.lit(1)) - 1)).alias("place"))
    return at_place(df, group, value, places)


def calibrate(hits: DataFrame, query: str = "query", score: str = "score", grade: str = "grade", relevant: int = 2) -> DataFrame:
    """The threshold with the best macro F1, then mean recall, then the lowest threshold.

    Candidates are 0, 1 and the observed scores; retrieved means a score strictly above. A query
    without relevant documents scores 1 if nothing is retrieved, else 0.
    """
    spark = hits.sparkSession
    rows = hits.select(F.col(query).alias("q"), F.col(score).alias("s"), (F.col(grade) >= relevant).alias("r"))
    per_score = rows.groupBy("q", "s").agg(F.count(F.lit(1)).alias("n"), F.count_if("r").alias("n_r"))
    # What lies strictly above each of a query's own scores; below its least score, all of it.
    upward = Window.partitionBy("q").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.partitionBy("q")
    steps = per_score.select("q", "s", F.coalesce(F.sum("n").over(upward), F.lit(0)).alias("got"), F.coalesce(F.sum("n_r").over(upward), F.lit(0)).alias("good"), F.sum("n").over(totals).alias("all"), F.sum("n_r").over(totals).alias("relevant"))

    def measures(got: Column, good: Column) -> list[Column]:
        f1 = F.when(F.col("relevant") == 0, F.when(got == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(2.0 * good, got + F.col("relevant")), F.lit(0.0)))
        return [f1, F.when(F.col("relevant") > 0, good / F.col("relevant")).otherwise(0.0)]

    lower = Window.partitionBy("q").orderBy("s")
    at = measures(F.col("got"), F.col("good"))
    start = measures(F.col("all"), F.col("relevant"))
    names = ["f1", "rec"]
    steps = steps.select("q", "s", "relevant", *(x.alias(n) for x, n in zip(at, names)), *(x.alias(f"{n}0") for x, n in zip(start, names)))
    changes = steps.select("s", *(F.round(F.col(n) - F.coalesce(F.lag(n).over(lower), F.col(f"{n}0")), 15).alias(n) for n in names))
    # A threshold's sums are those without any, and all changes up to it.
    per_query = steps.groupBy("q").agg(F.first("f10").alias("f10"), F.first("rec0").alias("rec0"), F.max("relevant").alias("relevant"))
    begin = per_query.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("relevant") > 0).alias("judged"), F.sum("f10").alias("f10"), F.sum("rec0").alias("rec0"))
    ends = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "s double, f1 double, rec double")
    summed = prefix_sums(changes.unionByName(ends).groupBy("s").agg(F.sum("f1").alias("f1"), F.sum("rec").alias("rec")), ["s"], names)
    swept = summed.crossJoin(F.broadcast(begin))  # one row
    swept = swept.select(F.col("s").alias("t"), F.round((F.col("f10") + F.col("f1_sum")) / F.col("queries"), 9).alias("macro_f1"), F.round(F.try_divide(F.col("rec0") + F.col("rec_sum"), F.col("judged")), 9).alias("recall"))
    best = swept.agg(F.max(F.struct("macro_f1", "recall", (-F.col("t")).alias("minus_t"))).alias("b"))
    return best.select((-F.col("b.minus_t")).alias("threshold"), "b.macro_f1", "b.recall")


#: The absolute thresholds of the joint search.
ABSOLUTE_GRID = (0.0, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)
_MEASURES = ("recall", "first", "answered", "mistaken")


def policy_search(hits: DataFrame, relevant: DataFrame, least_recall: float = 0.95, most_abstained: float = 0.05, grid: Sequence[float] = ABSOLUTE_GRID) -> DataFrame:
    """(method, trials, feasible, absolute, margin, feature, recall5, precision1, false_abstention, false_positive): for each method the selective policy that is best within the constraints.

    ``hits`` is (query, doc, score) with scores of 0 to 1, ``relevant`` (query, doc). A policy answers a query if its top score is above
    ``absolute`` and, for a positive margin, its lead over the second (gap2) or fifth hit (gap5) is above the margin;
    the answer holds the hits above ``absolute``. Methods: absolute takes all observed scores as thresholds, margin2
    and margin5 all observed leads, selective the ``grid`` with all leads of either kind. Feasible policies have a mean recall at 5 of
    ``least_recall`` and abstain on ``most_abstained`` of the answerable queries at most; of those, the least share of
    unanswerable queries that are answered wins, then recall, then precision at 1, then the smaller threshold, margin and feature.

    A query's part of each measure is a step function of the threshold, and, at a given threshold, of its
    lead. So all policies come from running sums over thresholds and over (feature, threshold, lead): no policy
    is tried against all queries.
    """
    spark = hits.sparkSession
    top = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    judged = relevant.select("query", "doc").distinct().withColumn("good", F.lit(1))
    five = hits.withColumn("place", F.row_number().over(top)).filter("place <= 5").join(judged, ["query", "doc"], "left").fillna(0, ["good"])
    wanted = judged.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    # Up to five hits a query.
    rows = five.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "score", "good"))).alias("h")).join(wanted, "query", "full_outer")
    empty = F.expr("CAST(array() AS array<struct<place:int,score:double,good:int>>)")
    score = lambda k: F.get(F.col("h"), F.lit(k)).getField("score")
    rows = cut(rows.select("query", F.coalesce("h", empty).alias("h"), F.col("n")).select("query", "h", "n", F.coalesce(score(0), F.lit(-1.0)).alias("top"), F.round(F.coalesce(score(0) - score(1), F.lit(0.0)), 9).alias("gap2"), F.round(F.coalesce(score(0) - score(4), F.lit(0.0)), 9).alias("gap5")))
    counts = rows.agg(F.count("n").alias("positive"), F.count_if(F.col("n").isNull()).alias("negative"))

    def parts(threshold: Column) -> list[Column]:
        """A query's part of each measure if it answers with the hits above the threshold."""
        kept = F.filter("h", lambda x: x.score > threshold)
        some = F.size(kept) > 0
        good = F.aggregate(kept, F.lit(0), lambda a, x: a + x.good)
        positive = F.col("n").isNotNull()
        return [
            F.when(positive, F.round(good / F.col("n"), 12)).otherwise(0.0).alias("recall"), F.when(positive & some, F.get(kept, F.lit(0)).good.cast("double")).otherwise(0.0).alias("first"),
            F.when(positive & some, 1.0).otherwise(0.0).alias("answered"), F.when(~positive & some, 1.0).otherwise(0.0).alias("mistaken"),
        ]

    # Thresholds: what each query adds when the threshold passes one of its scores. Below all of them it gives all it has.
    own = rows.select("*", F.explode(F.array_union(F.array(F.lit(-2.0)), F.array_distinct(F.transform("h", lambda x: x.score)))).alias("t"))
    steps = own.select("query", "t", *parts(F.col("t")))
    before = Window.partitionBy("query").orderBy("t")
    changes = steps.select("t", *(F.round(F.col(m) - F.coalesce(F.lag(m).over(before), F.lit(0.0)), 12).alias(m) for m in _MEASURES))
    # Any hit's score is a threshold; those below a query's fifth change nothing.
    tried = hits.select(F.col("score").alias("t")).filter("t > 0").union(spark.createDataFrame([(0.0,), (1.0,)], "t double")).distinct().select("t", *(F.lit(0.0).alias(m) for m in _MEASURES), F.lit(1).alias("tried"))
    by_t = changes.withColumn("tried", F.lit(0)).unionByName(tried).groupBy("t").agg(*(F.sum(m).alias(m) for m in _MEASURES), F.max("tried").alias("tried"))
    absolute = prefix_sums(by_t, ["t"], _MEASURES).filter("tried = 1").select(F.lit("absolute").alias("method"), F.col("t").alias("absolute"), F.lit(0.0).alias("margin"), F.lit("gap5").alias("feature"), *(F.col(f"{m}_sum").alias(m) for m in _MEASURES))

    # Leads: at each threshold of the grid, what lies above a lead is all less what lies up to it.
    choices = spark.createDataFrame([(float(g), f) for g in grid for f in ("gap2", "gap5")], "a double, feature string")
    gridded = rows.crossJoin(F.broadcast(choices))  # two rows for each threshold of the grid
    gap = F.when(F.col("feature") == "gap2", F.col("gap2")).otherwise(F.col("gap5"))
    by_gap = gridded.select("feature", "a", F.greatest(gap, F.lit(0.0)).alias("gap"), *parts(F.col("a"))).groupBy("feature", "a", "gap").agg(*(F.sum(m).alias(m) for m in _MEASURES))
    summed = prefix_sums(by_gap, ["feature", "a", "gap"], _MEASURES)
    whole = summed.groupBy("feature", "a").agg(*(F.max_by(f"{m}_sum", "gap").alias(f"{m}_most") for m in _MEASURES), *(F.min_by(F.col(f"{m}_sum") - F.col(m), "gap").alias(f"{m}_none") for m in _MEASURES))
    above = summed.filter("gap > 0").join(whole, ["feature", "a"]).select("feature", "a", F.col("gap").alias("margin"), *(F.round(F.col(f"{m}_most") - F.col(f"{m}_sum"), 9).alias(m) for m in _MEASURES))
    none = whole.select("feature", "a", F.lit(0.0).alias("margin"), *(F.round(F.col(f"{m}_most") - F.col(f"{m}_none"), 9).alias(m) for m in _MEASURES))
    joint = cut(above.unionByName(none)).select(F.col("a").alias("absolute"), "margin", "feature", *_MEASURES)
    alone = joint.filter("absolute = 0.0").withColumn("method", F.when(F.col("feature") == "gap2", "margin2").otherwise("margin5"))
    every = absolute.unionByName(alone).unionByName(joint.withColumn("method", F.lit("selective")))

    rated = every.crossJoin(F.broadcast(counts))  # one row
    share = lambda m, n: F.round(F.try_divide(F.col(m), F.col(n)), 9)
    rated = rated.select("method", "absolute", "margin", "feature", F.coalesce(share("recall", "positive"), F.lit(0.0)).alias("recall5"), F.coalesce(share("first", "positive"), F.lit(0.0)).alias("precision1"), F.round(1 - share("answered", "positive"), 9).alias("false_abstention"), share("mistaken", "negative").alias("false_positive"))
    allowed = (F.col("recall5") >= least_recall) & F.coalesce(F.col("false_abstention") <= most_abstained, F.lit(False))
    key = F.struct(F.coalesce("false_positive", F.lit(1.0)).alias("o1"), (-F.col("recall5")).alias("o2"), (-F.col("precision1")).alias("o3"), "absolute", "margin", "feature", "recall5", "precision1", "false_abstention", "false_positive")
    best = rated.groupBy("method").agg(F.count(F.lit(1)).alias("trials"), F.count_if(allowed).alias("feasible"), F.min(F.when(allowed, key)).alias("b"))
    return best.select("method", "trials", "feasible", *(F.col(f"b.{c}") for c in ("absolute", "margin", "feature", "recall5", "precision1", "false_abstention", "false_positive")))
