"""Which of overlapping spans win.

Two forms give the same winners: arrays within a document's row (no shuffle; for
redaction) and windows over a relation of spans (for analytics). Spans that overlap,
directly or through others, make a group; the highest final score wins it, ties go to
the smaller start, then the earlier emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.spans import quoted, var

WEIGHTS = {"regex": 2.0, "custom": 2.0, "gliner": 1.8, "deberta": 1.6, "openmed": 1.5, "bert": 1.2, "spacy": 1.0, "statistical": 0.8}

_FAMILIES = {
    "PERSON_NAME": "INDIVIDUAL NAME PER PERSON", "ORGANIZATION": "BUSINESS COMPANY ORG ORGANIZATION", "LOCATION": "ADDRESS GPE LOC LOCATION PLACE",
    "MEDICATION": "DRUG MEDICATION MEDICINE PHARMACEUTICAL", "MEDICAL_CONDITION": "CONDITION DIAGNOSIS DISEASE ILLNESS MEDICAL_CONDITION",
    "IDENTIFIER": "ID IDENTIFIER ID_NUMBER", "DATE": "DATE DATETIME", "TIME": "TIME", "EMAIL": "EMAIL EMAIL_ADDRESS", "PHONE_NUMBER": "PHONE PHONE_NUMBER TEL TELEPHONE",
}
#: Label to its normal form; others stay as they are.
NORMAL = {name: to for to, names in _FAMILIES.items() for name in names.split()}
#: What a label is worth to the standard model.
PRIORITY = {"DRUG": 3.0, "MEDICATION": 3.0, "DISEASE": 3.0, "DIAGNOSIS": 3.0, "MEDICAL_CONDITION": 3.0, "TREATMENT": 2.5, "PROCEDURE": 2.5, "PERSON": 1.0, "PERSON_NAME": 1.0}


def _case(value: str, table: dict, other: str) -> str:
    lit = lambda x: quoted(x) if isinstance(x, str) else f"{x}D"
    return f"CASE {value} " + " ".join(f"WHEN {quoted(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {other} END" if table else other


def normal_label(label: str, table: dict[str, str] | None = None) -> str:
    return _case(f"upper({label})", table or NORMAL, label)


def standard_score(score: str, source: str, label: str, length: str, weights: dict | None = None) -> str:
    return f"({score} * {_case(source, weights or WEIGHTS, '1.0D')} * (1 + least({length}, 20) / 100.0D) * {_case(label, PRIORITY, '2.0D')})"


def adaptive_score(score: str, source: str, label: str, length: str, same: str, weights: dict | None = None, measured: dict | None = None) -> str:
    """``same``: spans of the label in the group; ``measured``: label to the larger of its precision and F1."""
    bonus = f"(1 + {_case(label, measured or {}, '0.0D')} * 0.4D)"
    return f"({score} * {_case(source, weights or WEIGHTS, '1.0D')} * (1 + least({length}, 30) / 150.0D) * {bonus} * (1 + 0.15D * ({same} - 1)))"


def normalised(spans: str) -> str:
    s = var("s")
    return f"transform({spans}, {s} -> {S.copy(s, label=normal_label(f'{s}.label'))})"


def winners(spans: str, model: str = "adaptive", weights: dict | None = None, measured: dict | None = None) -> str:
    """The winners of an array of spans, by start. ``model``: adaptive (labels are normalised first) or standard."""
    if model == "adaptive":
        spans = normalised(spans)
    g, s, l, x, y = (var(c) for c in "gslxy")  # noqa: E741

    def best(group: str) -> str:
        if model == "standard":
            final = standard_score(f"{s}.score", f"{s}.source", f"{s}.label", f"{s}.end - {s}.start", weights)
            ranked = f"transform({group}, {s} -> struct({final} AS f, -{s}.start AS a, -{s}.ord AS b, {s} AS span))"
        else:
            labels = f"array_distinct(transform({group}, {x} -> {x}.label))"
            counts = f"map_from_arrays({labels}, transform({labels}, {l} -> size(filter({group}, {y} -> {y}.label = {l}))))"
            final = lambda c: adaptive_score(f"{s}.score", f"{s}.source", f"{s}.label", f"{s}.end - {s}.start", f"{c}[{s}.label]", weights, measured)
            ranked = S.let(counts, lambda c: f"transform({group}, {s} -> struct({final(c)} AS f, -{s}.start AS a, -{s}.ord AS b, {s} AS span))")
        return f"CASE WHEN size({group}) = 1 THEN {group}[0] ELSE array_max({ranked}).span END"

    return S.let(S.in_order(spans), lambda v: f"transform({S.groups(v)}, {g} -> {best(g)})")


def resolved(spans: DataFrame, model: str = "adaptive", id_: str = "doc_id", weights: dict | None = None, measured: dict | None = None) -> DataFrame:
    """The winners of a relation of spans (id, start, end, label, score, source, ord, ...): one shuffle, by id, or none where they lie so already."""
    if model == "adaptive":
        spans = spans.withColumn("label", F.expr(normal_label("label")))
    order = Window.partitionBy(id_).orderBy("start", "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("_group", F.sum("_new").over(order))
    length = "(end - start)"
    if model == "adaptive":
        marked = marked.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(id_, "_group", "label")))
        final = adaptive_score("score", "source", "label", length, "_same", weights, measured)
    else:
        final = standard_score("score", "source", "label", length, weights)
    best = Window.partitionBy(id_, "_group").orderBy(F.desc("_final"), "start", "ord")
    return marked.withColumn("_final", F.expr(final)).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_new", "_group", "_same", "_final", "_n")
