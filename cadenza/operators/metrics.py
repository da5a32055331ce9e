"""Scores against labels: predictions have ``label`` (1 is end of turn), ``p_eot`` and any groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import quantiles as Q

#: Edges of the duration buckets, in seconds.
EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def accuracy() -> Column:
    return F.avg(((F.col("p_eot") >= 0.5) == (F.col("label") == 1)).cast("double"))


def f1() -> Column:
    """F1 of end of turn; 0 where nothing is or is called positive."""
    p, y = F.col("p_eot") >= 0.5, F.col("label") == 1
    tp, wrong = _count(p & y), _count(p != y)
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))


def _auc(scores: DataFrame, by: list[str], more: dict[str, Column]) -> DataFrame:
    """Per group of counted scores (p_eot, pos, n): auc and other sums."""
    ranked = Q.before(scores, by, "p_eot", "n", Q.thousandths).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    total = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("_r"), F.sum("pos").alias("_p"), F.sum("n").alias("_n"), *(c.alias(name) for name, c in more.items()))
    value = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2.0) / (F.col("_p") * (F.col("_n") - F.col("_p")))
    return total.select(*by, *more, F.when((F.col("_p") > 0) & (F.col("_p") < F.col("_n")), value).alias("auc"))


def auc(predictions: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC per group by average ranks over ties; null where a class is missing.

    Equal scores are counted before they are ranked, and ranked within ranges of the score.
    """
    return _auc(predictions.groupBy(*by, "p_eot").agg(_count(F.col("label") == 1).alias("pos"), F.count("*").alias("n")), by, {})


def report(predictions: DataFrame, group: str = "language", overall: str = "overall") -> DataFrame:
    """n, accuracy, f1 and auc overall and per group: all from counts of equal scores, which the overall rows share."""
    counted = predictions.groupBy(F.col(group).cast("string").alias("_g"), "p_eot").agg(_count(F.col("label") == 1).alias("pos"), F.count("label").alias("known"), F.count("*").alias("n"))
    both = counted.withColumn("grp", F.explode(F.array(F.lit(overall), F.col("_g"))))
    scores = both.groupBy("grp", "p_eot").agg(*(F.sum(c).alias(c) for c in ("pos", "known", "n")))
    called = F.col("p_eot") >= 0.5
    right = F.when(called, F.col("pos")).when(~called, F.col("known") - F.col("pos"))
    judged = F.sum(F.when(F.col("p_eot").isNotNull(), F.col("known")))
    tp = F.sum(F.when(called, F.col("pos")))
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + judged - F.sum(right)), F.lit(0.0))
    more = {"n": F.sum("n"), "accuracy": F.try_divide(F.sum(right).cast("double"), judged), "f1": f1}
    return _auc(scores, ["grp"], more).select("grp", "n", "accuracy", "f1", "auc")


def bucket(duration: Column, edges=EDGES) -> Column:
    """Half-open ranges by name; what is below the first edge counts as beyond the last."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        inside = (duration >= lo) & (duration < hi)
        name = F.lit(f"[{lo:g}, {hi:g})")
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(F.lit(f">= {edges[-1]:g}"))


def bucket_bias(predictions: DataFrame, duration: str = "duration", edges=EDGES) -> DataFrame:
    """Per duration bucket: false cut-offs among holds and recall among ends of turn."""
    hit = (F.col("p_eot") >= 0.5).cast("double")
    hold, eot = F.col("label") == 0, F.col("label") == 1
    return predictions.groupBy(bucket(F.col(duration), edges).alias("bucket")).agg(_count(hold).alias("n_hold"), F.avg(F.when(hold, hit)).alias("false_cutoff"), _count(eot).alias("n_eot"), F.avg(F.when(eot, hit)).alias("recall"))


def hold_correlation(predictions: DataFrame, duration: str = "duration") -> DataFrame:
    """Pearson correlation of duration and score over holds; null for fewer than two."""
    return predictions.where("label = 0").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.corr(duration, "p_eot")).alias("corr"))


def summary(rows: DataFrame, by: list[str], column: str, shares: dict[str, float], more: dict[str, Column]) -> DataFrame:
    """Per group: exact percentiles under their names, and other aggregates."""
    q = Q.percentiles(rows, by, column, tuple(shares.values())).select(*by, *(F.col("q")[k].alias(name) for k, name in enumerate(shares)))
    return rows.groupBy(*by).agg(*(c.alias(name) for name, c in more.items())).join(q, by, "left")


def latency(rows: DataFrame, by: list[str], column: str = "ms") -> DataFrame:
    more = {"n": F.count("*"), "mean_ms": F.avg(column), "min_ms": F.min(column), "max_ms": F.max(column), "std_ms": F.stddev_pop(column)}
    return summary(rows, by, column, {"median_ms": 0.5, "p95_ms": 0.95}, more)


def sweep(predictions: DataFrame, policies: DataFrame, decide) -> DataFrame:
    """Per policy (threshold, action_delay, timeout): ends called among holds and among ends. policies is a small grid."""
    done = decide(F.col("p_eot"), F.col("silence"), F.col("threshold"), F.col("action_delay"), F.col("timeout")).startswith("end_of_turn").cast("double")
    rows = predictions.join(F.broadcast(policies))
    return rows.groupBy("threshold", "action_delay", "timeout").agg(F.avg(F.when(F.col("label") == 0, done)).alias("false_cutoff"), F.avg(F.when(F.col("label") == 1, done)).alias("recall"))
