"""What comes from entity models: batches in, spans out, under this library's labels and thresholds.

A model is a Python function over a list of texts that gives, for each, its entities as
(start, end, label, score). Everything after it is SQL over arrays of spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.spans import let, quoted, var

#: Characters of a chunk, of the overlap of two, and of its end in which a sentence's end is looked for.
CHUNK, OVERLAP, TAIL = 3000, 150, 200
ENDS = (".\n", "\n\n", ". ", "! ", "? ")

_TAGS = {
    "PERSON_NAME": "PER PERSON", "ORGANIZATION": "ORG", "LOCATION": "LOC GPE FACILITY", "FINANCIAL": "MONEY", "PERCENTAGE": "PERCENT", "LEGAL": "LAW", "NATIONALITY": "NORP",
}
#: Tags of token models and what they are here; others stay as they are.
TAGS = {tag: label for label, tags in _TAGS.items() for tag in tags.split()}
#: Thresholds of the medical preset: low for what care is about, high for persons.
MEDICAL_THRESHOLDS = dict.fromkeys(("DRUG", "MEDICATION", "DISEASE", "DIAGNOSIS", "MEDICAL_CONDITION", "SYMPTOM"), 0.3) | dict.fromkeys(("PERSON", "PERSON_NAME"), 0.75)


def model_label(label: str, table: dict[str, str] | None = None) -> str:
    """A model's label in this library's terms: without B- and I-, looked up in any case; an unknown one passes."""
    bare = f"replace(replace({label}, 'B-', ''), 'I-', '')"
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in (TAGS if table is None else table).items())
    return let(bare, lambda b: f"CASE upper({b}) {cases} ELSE {b} END")


def entity_label(label: str) -> str:
    """A free-form label as a constant's name."""
    return f"replace(upper({label}), ' ', '_')"


def relabelled(spans: str, table: dict[str, str] | None = None) -> str:
    s = var("s")
    return f"transform({spans}, {s} -> {S.copy(s, label=model_label(f'{s}.label', table))})"


def confident(spans: str, threshold: float, by_label: dict[str, float] | None = None) -> str:
    """Spans that score their label's threshold or more; ``threshold`` where a label has none."""
    s = var("s")
    cases = " ".join(f"WHEN {quoted(k)} THEN {v}D" for k, v in (by_label or {}).items())
    least = f"CASE {s}.label {cases} ELSE {threshold}D END" if cases else f"{threshold}D"
    return f"filter({spans}, {s} -> {s}.score >= {least})"


def deduplicated(spans: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Of spans with one place and label the one with the highest score, then the first source."""
    rest = [c for c in spans.columns if c not in (id_, "start", "end", "label")]
    best = F.max_by(F.struct(*rest), F.struct("score", *([-F.col("ord")] if "ord" in rest else [])))
    return spans.groupBy(id_, "start", "end", "label").agg(best.alias("_b")).select(id_, "start", "end", "label", *(F.col(f"_b.{c}").alias(c) for c in rest)).select(spans.columns)


def unique(spans: str) -> str:
    """``deduplicated`` within a row: in order of place, each place and label once."""
    s, a, x, y = (var(c) for c in "saxy")
    order = f"transform(array_sort(transform({spans}, {s} -> struct({s}.start, {s}.end, -{s}.score AS less, {s} AS span))), {x} -> {x}.span)"
    same = lambda p, q: " AND ".join(f"{p}.{f} = {q}.{f}" for f in ("start", "end", "label"))
    i = var("i")
    return let(order, lambda o: f"transform(filter(transform({o}, ({a}, {i}) -> IF(exists(slice({o}, 1, {i}), {y} -> {same(y, a)}), NULL, {a})), {x} -> {x} IS NOT NULL), {s} -> {s})")


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP, tail: int = TAIL) -> str:
    """array<struct<start,end>>: a text of over ``size`` characters in overlapping parts that end at a sentence where one ends nearby."""
    a, k, e = var("a"), var("k"), var("e")
    n = f"length({text})"

    def cut(stop: str) -> str:
        low = f"greatest({stop} - {tail}, {a}.at)"
        near = f"substring({text}, {low} + 1, {stop} - {low})"
        last = lambda w, end: f"IF(contains({w}, {quoted(end)}), {low} + length({w}) - instr(reverse({w}), {quoted(end[::-1])}) + 1, NULL)"
        found = let(near, lambda w: f"coalesce({', '.join(last(w, end) for end in ENDS)}, {stop})")
        return f"IF({stop} < {n}, {found}, {stop})"

    def step(stop: str) -> str:
        # the next part begins after this one less the overlap, and always further on
        next_ = f"IF({stop} >= {n}, {n}, greatest({stop} - IF({stop} < {n} - {overlap}, {overlap}, 0), {a}.at + 1))"
        return f"named_struct('at', {next_}, 'out', concat({a}.out, array(named_struct('start', {a}.at, 'end', {stop}))))"

    moved = let(f"least({a}.at + {size}, {n})", lambda stop: let(cut(stop), step))
    least = max(1, size - tail - overlap)
    empty = "CAST(array() AS array<struct<start:int,end:int>>)"
    looped = f"aggregate(sequence(0, {n} div {least} + 1), named_struct('at', 0, 'out', {empty}), ({a}, {k}) -> IF({a}.at >= {n}, {a}, {moved}), {e} -> {e}.out)"
    return f"CASE WHEN {n} > {size} THEN {looped} WHEN {n} > 0 THEN array(named_struct('start', 0, 'end', {n})) ELSE {empty} END"


Predict = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def model_spans(df: DataFrame, predict: Predict, source: str, threshold: float = 0.0, by_label: dict[str, float] | None = None, table: dict[str, str] | None = None, text: str = "text", out: str = "model_spans", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with a model's spans in ``out`` (to be named in ``Config.models``): chunks go to ``predict`` an Arrow batch at a
    time, offsets are moved back, labels and thresholds applied, and what two chunks both found is one span."""

    @F.pandas_udf("array<array<struct<start:int,end:int,label:string,score:double>>>")
    def called(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts:
            flat = [t for row in batch if row is not None for t in row]
            found = iter(predict(flat) if flat else [])
            yield pd.Series([[[{"start": s, "end": e, "label": lab, "score": float(sc)} for s, e, lab, sc in next(found)] for _ in (row if row is not None else [])] for row in batch])

    c, k, s, i = (var(x) for x in "cksi")
    df = df.withColumn("__chunks", F.expr(chunks(text, size, overlap))).withColumn("__parts", F.expr(f"transform(__chunks, {c} -> substring({text}, {c}.start + 1, {c}.end - {c}.start))"))
    df = df.withColumn("__found", called("__parts"))
    at = f"{c}.__chunks.start"
    made = S.make(f"{s}.start + {at}", f"{s}.end + {at}", f"{s}.label", f"{s}.score", quoted(source), f"{k} * 10000 + {i}")
    all_ = f"flatten(transform(arrays_zip(__chunks, __found), ({c}, {k}) -> transform({c}.__found, ({s}, {i}) -> {made})))"
    kept = confident(relabelled(all_, table), threshold, by_label)
    return df.withColumn(out, F.expr(f"coalesce({unique(kept)}, {S.EMPTY})")).drop("__chunks", "__parts", "__found")


def united(*found: DataFrame) -> DataFrame:
    """The spans of several detectors over the same texts, one relation, each row with its source."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def zipped(one: DataFrame, other: DataFrame, order: str) -> DataFrame:
    """Rows of two relations paired by their position: both have it in ``order``, as a list's index is a column here."""
    return one.join(other, order)


def scored_by(label: Column, thresholds: dict[str, float], other: float) -> Column:
    """The threshold of a label, as a column."""
    out = F.lit(other)
    for k, v in thresholds.items():
        out = F.when(label == k, v).otherwise(out)
    return out
