"""Scores of predicted spans against gold, and what is calibrated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where there is nothing to divide by."""
    p, r = _rate(F.col("tp"), F.col("tp") + F.col("fp")), _rate(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumns({"precision": p, "recall": r})
    return df.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def exact(gold: DataFrame, predicted: DataFrame, by: tuple[str, ...] = (), keys: tuple[str, ...] = ("doc_id", "start", "end", "label")) -> DataFrame:
    """tp, fp, fn over distinct keys (leave ``label`` out to compare places only), grouped by ``by``, with rates."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, list(keys), "full_outer")
    hit = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    made = [hit(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), hit(F.col("_g").isNull()).alias("fp"), hit(F.col("_p").isNull()).alias("fn")]
    return with_rates((both.groupBy(*by) if by else both).agg(*made))


def overlaps(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5, same_label: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose intersection over union is at least ``threshold``; ``keep``: further columns of ``predicted``. Both sides are
    sorted: spans made in a plan are many more than its files let the planner expect, so neither may be broadcast."""
    g = gold.select("doc_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("label").alias("g_label"))
    p = predicted.select(F.col("doc_id").alias("p_doc"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("label").alias("p_label"), *keep)
    cond = (F.col("doc_id") == F.col("p_doc")) & (F.col("g_start") < F.col("p_end")) & (F.col("p_start") < F.col("g_end"))
    if same_label:
        cond = cond & (F.col("g_label") == F.col("p_label"))
    shared = F.least("g_end", "p_end") - F.greatest("g_start", "p_start")
    union = F.greatest("g_end", "p_end") - F.least("g_start", "p_start")
    return g.join(p.hint("merge"), cond).drop("p_doc").withColumn("iou", shared / union).where(F.col("iou") >= threshold)


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One to one: the pairs of a document by falling overlap, each span used once. A document's pairs are one array, folded in the JVM."""
    cols = pairs.columns
    order = F.struct((-F.col("iou")).alias("_less"), "g_start", "p_start", "g_end", "p_end", "g_label", "p_label", "iou")
    rows = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("_r"))
    span = lambda x, w: f"{x}.{w}_start, {x}.{w}_end, {x}.{w}_label"
    used = lambda w: f"exists(a, t -> struct({span('t', w)}) = struct({span('x', w)}))"
    kept = F.expr(f"aggregate(_r, slice(_r, 1, 0), (a, x) -> IF({used('g')} OR {used('p')}, a, concat(a, array(x))))")
    return rows.select("doc_id", F.explode(kept).alias("_x")).select(*(F.col("doc_id") if c == "doc_id" else F.col(f"_x.{c}").alias(c) for c in cols))


def partial(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Partial-match tp, fp, fn, rates and mean overlap."""
    hits = greedy_matches(overlaps(gold.distinct(), predicted.distinct(), threshold))
    key = ("doc_id", "start", "end", "label")
    n = lambda df: df.select(*key).distinct().agg(F.count(F.lit(1)).alias("n"))
    m = hits.agg(F.count(F.lit(1)).alias("tp"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    all_ = m.crossJoin(n(gold).withColumnRenamed("n", "g")).crossJoin(n(predicted).withColumnRenamed("n", "p"))  # three single rows
    return with_rates(all_.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), "mean_iou"))


def detector_weight(f1: Column, precision: Column, method: str = "f1_squared") -> Column:
    """A detector's weight from its scores; never below 0.1."""
    value = {"f1_squared": f1 * f1, "precision": precision, "f1": f1, "balanced": F.pow(f1, F.lit(1.5))}[method]
    return F.greatest(F.lit(0.1), value)


def blended(adaptive: Column, configured: Column) -> Column:
    return adaptive * 0.8 + configured * 0.2


def suggested_threshold(precision: Column) -> Column:
    return F.when(precision < 0.3, 0.6).when(precision < 0.5, 0.5).when(precision < 0.7, 0.4).otherwise(0.3)


def grid_search(scored: DataFrame, thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), least: int = 5) -> DataFrame:
    """By label the threshold with the best F1 (the lowest of equals); ``scored`` has label, score, correct (0 or 1)."""
    enough = scored.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.sum("correct").alias("_pos")).where(F.col("_n") >= least)
    grid = scored.select("label", "score", "correct", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = grid.where(F.col("score") >= F.col("threshold")).groupBy("label", "threshold").agg(F.sum("correct").alias("tp"), F.sum(1 - F.col("correct")).alias("fp"))
    at = with_rates(kept.join(enough, "label").withColumn("fn", F.col("_pos") - F.col("tp")))
    best = Window.partitionBy("label").orderBy(F.desc("f1"), "threshold")
    return at.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("label", "threshold", "f1")


def gap_status(train: Column, validation: Column) -> Column:
    gap = F.abs(train - validation)
    return F.when(gap < 0.1, "good").when(gap < 0.15, "acceptable").when(gap < 0.2, "warning").otherwise("overfit")


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins; ``scored`` has score and correct."""
    bin_ = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    by = scored.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("conf"), F.avg(F.col("correct").cast("double")).alias("acc"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def platt_of_counts(counts: DataFrame, steps: int = 100, rate: float = 0.01) -> DataFrame:
    """(detector, label, a, b): sigmoid(a * score + b) fitted by damped Newton steps to (detector, label, score, correct, n)."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["score", "correct"])
        x, y, n, a, b = pdf.score.to_numpy(float), pdf.correct.to_numpy(float), pdf.n.to_numpy(float), -1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
            h = n * p * (1 - p)
            a -= rate * (n * (p - y) * x).sum() / max((h * x * x).sum(), 1e-10)
            b -= rate * (n * (p - y)).sum() / max(h.sum(), 1e-10)
        return pd.DataFrame([{"detector": pdf.detector.iloc[0], "label": pdf.label.iloc[0], "a": a, "b": b}])

    return counts.groupBy("detector", "label").applyInPandas(fit, "detector string, label string, a double, b double")


def platt(score: Column, a: Column, b: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), a * score + b))))


def calibrated(spans: DataFrame, params: DataFrame) -> DataFrame:
    """Scores by the calibrator of (detector, label), else by that of (detector, _global), else as they are. Calibrators are a few rows."""
    own = params.select(F.col("detector").alias("source"), "label", F.col("a").alias("_a"), F.col("b").alias("_b"))
    any_ = params.where("label = '_global'").select(F.col("detector").alias("source"), F.col("a").alias("_ga"), F.col("b").alias("_gb"))
    out = spans.join(F.broadcast(own), ["source", "label"], "left").join(F.broadcast(any_), "source", "left")
    return out.withColumn("score", F.when(F.coalesce("_a", "_ga").isNotNull(), platt(F.col("score"), F.coalesce("_a", "_ga"), F.coalesce("_b", "_gb"))).otherwise(F.col("score"))).drop("_a", "_b", "_ga", "_gb")
