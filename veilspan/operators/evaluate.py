"""Detectors held against gold: tracked by detector and label, calibrated, kept as files, and reported."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import quoted, var
from . import metrics

KEY = ("doc_id", "start", "end", "label")


def tracked(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(detector, label, tp, fp, fn, precision, recall, f1) over distinct spans; a null label is the detector in all.
    ``predicted`` has a detector; every detector is held against the whole gold."""
    detectors = predicted.select("detector").distinct()
    g = gold.select(*KEY).crossJoin(F.broadcast(detectors))  # a few names
    both = _marked(g, predicted, "detector").groupBy("detector", *KEY, "_apart").agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))
    counts = [F.sum(one).cast("long").alias(name) for one, name in ((F.col("_g") * F.col("_p"), "tp"), (1 - F.col("_g"), "fp"), (1 - F.col("_p"), "fn"))]
    return metrics.with_rates(both.groupingSets([["detector", "label"], ["detector"]], "detector", "label").agg(*counts))


def _marked(gold: DataFrame, predicted: DataFrame, *more: str) -> DataFrame:
    """Rows of both, with KEY and ``more``, _g and _p (1 for a row of gold, of the predictions), and _apart, which keeps those with a
    null in KEY from one another. A group by KEY of these meets as a join would, but moves nothing where both lie by document."""
    apart = lambda side: F.when(F.greatest(*(F.col(c).isNull() for c in KEY)), side)
    sides = [df.select(*more, *KEY, F.lit(g).alias("_g"), F.lit(1 - g).alias("_p"), apart(g).alias("_apart")) for df, g in ((gold, 1), (predicted, 0))]
    return sides[0].unionByName(sides[1])


def _met(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each KEY once, with _g and _p: whether (1 or 0) it is in gold, in the predictions."""
    return _marked(gold, predicted).groupBy(*KEY, "_apart").agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))


def scored(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(detector, label, score, correct) of every prediction."""
    none = gold.select(*KEY, F.lit(None).cast(predicted.schema["detector"].dataType).alias("detector"), F.lit(None).cast(predicted.schema["score"].dataType).alias("score"))
    met = _marked(none, predicted, "detector", "score").withColumn("_met", F.max("_g").over(Window.partitionBy(*KEY, "_apart")))
    return met.where("_p = 1").select("detector", "label", "score", F.col("_met").alias("correct"))


def history(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(detector, label, n, correct, mean_score, scores): a label's scores and whether they were right, in bins of a hundredth, so a row's size is bounded."""
    binned = scored(gold, predicted).groupBy("detector", "label", F.round("score", 2).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"))
    return binned.groupBy("detector", "label").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"), F.array_sort(F.collect_list(F.struct("score", "n", "correct"))).alias("scores")
    )


def calibrated_weights(gold: DataFrame, predicted: DataFrame, method: str = "f1_squared") -> DataFrame:
    """(detector, tp, fp, fn, precision, recall, f1, weight, threshold) of each detector, and of all together (detector null, no weight)."""
    one = tracked(gold, predicted).where("label IS NULL").select("detector", "tp", "fp", "fn")
    all_ = one.groupingSets([["detector"], []], "detector").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    rated = metrics.with_rates(all_)
    named = F.col("detector").isNotNull()
    return rated.withColumn("weight", F.when(named, metrics.detector_weight(F.col("f1"), F.col("precision"), method))).withColumn("threshold", F.when(named, metrics.suggested_threshold(F.col("precision"))))


def eligible(scores: DataFrame, least: int = 20, least_of_label: int = 10) -> DataFrame:
    """(detector, label, n) of the calibrators that have enough to be fitted: a detector's ``_global`` and its labels'."""
    return _eligible(scores.withColumn("n", F.lit(1)), least, least_of_label)


def _eligible(counts: DataFrame, least: int, least_of_label: int) -> DataFrame:
    n = counts.groupingSets([["detector", "label"], ["detector"]], "detector", "label").agg(F.sum("n").cast("long").alias("n"))
    n = n.withColumn("label", F.coalesce("label", F.lit("_global")))
    detectors = n.where((F.col("label") == "_global") & (F.col("n") >= least)).select("detector")
    return n.join(detectors, "detector", "left_semi").where((F.col("label") == "_global") | (F.col("n") >= least_of_label)).select("detector", "label", "n")


def platt_params(scores: DataFrame, least: int = 20, least_of_label: int = 10) -> DataFrame:
    """(detector, label, a, b) of all eligible calibrators. Scores are counted by the thousandth before all else, so only counts are moved, and a fit's task has at most 2,002 rows."""
    few = scores.groupBy("detector", "label", F.round("score", 3).alias("score"), "correct").agg(F.count(F.lit(1)).alias("n"))
    both = few.unionByName(few.withColumn("label", F.lit("_global"))).groupBy("detector", "label", "score", "correct").agg(F.sum("n").alias("n"))
    return metrics.platt_of_counts(both.join(_eligible(few, least, least_of_label).drop("n"), ["detector", "label"], "left_semi"))


def partial_by_label(gold: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, exact_tp, exact_fp, exact_fn, tp, fp, fn, mean_iou, precision, recall, f1): exact and overlapping matches by label; null is all."""
    g, p = gold.select(*KEY).distinct(), predicted.select(*KEY).distinct()
    hits = metrics.greedy_matches(metrics.overlaps(g, p, threshold)).select(F.col("g_label").alias("label"), "iou")
    marks = hits.select("label", F.lit(1).alias("tp"), "iou", *(F.lit(0).alias(c) for c in ("g", "p", "e")))
    none = F.lit(None).cast("double").alias("iou")
    zero = F.lit(0)
    for df, which in ((g, "g"), (p, "p"), (_met(gold, predicted).where("_g = 1 AND _p = 1"), "e")):
        marks = marks.unionByName(df.select("label", zero.alias("tp"), none, *(F.lit(int(c == which)).alias(c) for c in ("g", "p", "e"))))
    n = marks.groupingSets([["label"], []], "label").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "g", "p", "e")), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    n = n.select("label", F.col("e").alias("exact_tp"), (F.col("p") - F.col("e")).alias("exact_fp"), (F.col("g") - F.col("e")).alias("exact_fn"), "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), "mean_iou")
    return metrics.with_rates(n)


def mismatches(gold: DataFrame, predicted: DataFrame, texts: DataFrame, n: int = 20) -> DataFrame:
    """(kind, doc_id, start, end, label, value): the first ``n`` predictions that are not gold (fp), and gold spans that nobody predicted (fn), by place."""
    met = _met(gold, predicted)
    first = lambda lone, kind: met.where(lone).orderBy(*KEY).limit(n).select(F.lit(kind).alias("kind"), *KEY)
    some = first("_g = 0", "fp").unionByName(first("_p = 0", "fn"))
    return texts.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("kind", *KEY, F.expr("substring(text, start + 1, end - start)").alias("value"))


# Labels that count as one another, and cases that are held against them.

#: Label to its other names, in lower case.
ALIASES = {
    "ssn": "id social_security_number tax_file_number tax_identification_number tfn", "email": "email_address", "phone_us": "phone phone_number telephone", "credit_card": "card card_number credit_card_number",
    "person_name": "name person", "medical_record": "medical_record_number mrn patient_id record_number", "organization": "company org", "location": "address gpe loc place", "medication": "drug drug_name medicine",
    "medical_condition": "condition diagnosis disease", "tfn": "ssn tax_file_number", "abn": "australian_business_number", "acn": "australian_company_number", "medicare": "medicare_number",
}
#: What no text without an entity may be said to have, as a part of a label.
PERSONAL = ("ssn", "email", "phone", "credit_card", "name", "person", "medical_record", "mrn")


def passes(detected: str, expected: str) -> str:
    """Whether the labels found (an array) stand for all that are expected (an array): by name, by alias, or one label being a
    part of the other where both have over three letters. Where none is expected, none that is personal may be found."""
    d, e, x, c = (var(v) for v in "dexc")
    classes = [sorted({k, *v.split()}) for k, v in ALIASES.items()]
    table = f"array({', '.join('array(' + ', '.join(map(quoted, names)) + ')' for names in classes)})"
    low = lambda a: f"transform({a}, {x} -> lower({x}))"
    alias = f"exists({table}, {c} -> array_contains({c}, {e}) AND arrays_overlap({c}, {low(detected)}))"
    part = f"exists({low(detected)}, {d} -> length({e}) > 3 AND length({d}) > 3 AND (contains({d}, {e}) OR contains({e}, {d})))"
    each = f"forall({low(expected)}, {e} -> array_contains({low(detected)}, {e}) OR {alias} OR {part})"
    none = f"NOT exists({low(detected)}, {d} -> {' OR '.join(f'contains({d}, {quoted(w)})' for w in PERSONAL)})"
    return f"CASE WHEN size({expected}) = 0 THEN {none} ELSE {each} END"


TIERS = {"smoke": ("smoke",), "basic": ("smoke", "basic"), "full": ("smoke", "basic", "full")}


def tiers(cases: DataFrame) -> DataFrame:
    """(tier, country, total, passed, accuracy, tp, fp, fn, precision, recall, f1) of cases with tier, country, expected and
    detected (arrays of labels); a tier has the cases of the lesser ones too. Counts are of equal names, accuracy of aliases."""
    holders = {own: [t for t, has in TIERS.items() if own in has] for own in TIERS}
    of = None
    for own, up in holders.items():
        names = F.array(*map(F.lit, up))
        of = F.when(F.col("tier") == own, names) if of is None else of.when(F.col("tier") == own, names)
    found, want = F.array_distinct("detected"), F.array_distinct("expected")
    each = cases.select(F.explode(of).alias("tier"), "country", F.expr(passes("detected", "expected")).alias("ok"), F.size(F.array_intersect(found, want)).alias("tp"), F.size(F.array_except(found, want)).alias("fp"), F.size(F.array_except(want, found)).alias("fn"))
    sums = each.groupBy("tier", "country").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("ok").cast("long")).alias("passed"), *(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return metrics.with_rates(sums.withColumn("accuracy", F.col("passed") / F.col("total") * 100))


def regressions(now: DataFrame, before: DataFrame, points: float = 2.0) -> DataFrame:
    """Tiers whose accuracy fell by more than ``points``."""
    was = before.select("tier", "country", F.col("accuracy").alias("was"))
    return now.join(was, ["tier", "country"]).where(F.col("accuracy") < F.col("was") - points).select("tier", "country", "was", "accuracy")


# Calibration and results as files.


def calibration(gold: DataFrame, predicted: DataFrame, method: str = "f1_squared") -> dict:
    """What a calibration has learnt, by detector and label: a few rows, for a file."""
    weights = {r["detector"]: r.asDict() for r in calibrated_weights(gold, predicted, method).where("detector IS NOT NULL").collect()}
    labels: dict[str, dict] = {}
    for r in tracked(gold, predicted).where("label IS NOT NULL").collect():
        labels.setdefault(r["detector"], {})[r["label"]] = {k: r[k] for k in ("tp", "fp", "fn", "f1")}
    params: dict[str, dict] = {}
    for r in platt_params(scored(gold, predicted)).collect():
        params.setdefault(r["detector"], {})[r["label"]] = {"a": r["a"], "b": r["b"]}
    return {
        "summary": {k: {c: v[c] for c in ("precision", "recall", "f1", "tp", "fp", "fn")} for k, v in weights.items()},
        "recommended_weights": {k: v["weight"] for k, v in weights.items()}, "thresholds": {k: v["threshold"] for k, v in weights.items()}, "label_specific": labels, "calibrators": params,
    }


def save(what: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(what, f, indent=2, sort_keys=True)


def load(path: str) -> dict:
    """A calibration's file; one of either layout has its weights under ``recommended_weights``."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    return got | {"recommended_weights": got.get("recommended_weights") or got.get("detector_weights") or {}}


def params_table(spark: SparkSession, saved: dict) -> DataFrame:
    """The calibrators of a file as ``metrics.calibrated`` takes them."""
    rows = [(d, lab, float(p["a"]), float(p["b"])) for d, by in saved.get("calibrators", {}).items() for lab, p in by.items()]
    return spark.createDataFrame(rows, "detector string, label string, a double, b double")
