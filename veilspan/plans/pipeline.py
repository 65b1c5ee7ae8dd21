"""Redact and scan as one plan: detect, resolve, propagate, filter, emit.

Each document's spans stay in its row, so the plan has no shuffle and no Python.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import masking
from ..functions import spans as S
from ..functions.spans import quoted, var
from ..operators import detect, models, refine, resolve, stats
from ..sources.policies import load

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    """What is looked for, how overlaps are settled, and how values are rewritten.

    ``models``: columns (array of spans) that external models filled in; their labels are mapped, and spans below
    ``model_threshold``, or their label's of ``label_thresholds``, are left out.
    ``per_label_actions``: rewrite by the policy's action for the label, not by ``masking_style``.
    ``keep_surrogates``: masks show the policy's action in place of the label.
    """

    country: str = "US"
    detectors: tuple[str, ...] = ("regex", "custom")
    mode: str = "manual"
    masking_style: str = "hash"
    model: str = "adaptive"
    weights: dict[str, float] | None = None
    measured: dict[str, float] | None = None
    propagate: bool = True
    propagation_threshold: float = 0.9
    allow_list: tuple[str, ...] = ()
    block_list: tuple[str, ...] = ()
    custom_patterns: dict[str, list[str]] = field(default_factory=dict)
    overlay: dict | None = None
    gazetteer: dict[str, str] = field(default_factory=dict)
    statistical_threshold: float = 0.7
    min_length: int = 0
    max_length: int | None = None
    keep_surrogates: bool = False
    per_label_actions: bool = False
    models: tuple[str, ...] = ()
    model_threshold: float = 0.0
    label_thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for d in self.detectors:
            if d not in ("regex", "custom", "statistical"):
                raise ValueError(f"no such detector: {d}")
        load(self.country)


def medical(**more) -> Config:
    """A preset for clinical text: labels of care weigh as much as identifiers."""
    return Config(**({"detectors": ("regex", "custom"), "masking_style": "replace", "measured": {"MEDICAL_CONDITION": 0.7, "MEDICATION": 0.7}, "model_threshold": 0.5, "label_thresholds": dict(models.MEDICAL_THRESHOLDS)} | more))


def _found(text: str, config: Config) -> str:
    """All spans of every detector, before any is settled."""
    policy = load(config.country, config.overlay)
    parts = []
    if "regex" in config.detectors:
        parts.append(detect.regex(text, policy, dict(config.custom_patterns), config.country))
    if "custom" in config.detectors:
        parts.append(detect.custom(text))
    if "statistical" in config.detectors:
        parts.append(detect.statistical(text, config.statistical_threshold))
    if config.gazetteer:
        parts.append(detect.gazetteer(text, config.gazetteer))
    if config.block_list:
        parts.append(detect.gazetteer(text, dict.fromkeys(config.block_list, "BLOCKED"), "custom", 1.0))
    parts += [models.confident(models.relabelled(f"coalesce({m}, {S.EMPTY})"), config.model_threshold, config.label_thresholds) for m in config.models]
    return f"flatten(array({', '.join(parts)}))" if parts else S.EMPTY


def _refined(text: str, spans: str, config: Config) -> str:
    out = refine.clean(text, refine.allowed(text, spans, list(config.allow_list)))
    if config.min_length or config.max_length is not None:
        s = var("s")
        most = f" AND {s}.end - {s}.start <= {config.max_length}" if config.max_length is not None else ""
        out = f"filter({out}, {s} -> {s}.end - {s}.start >= {config.min_length}{most})"
    return f"coalesce({S.in_order(out, longer_first=True)}, {S.EMPTY})"


def detected(df: DataFrame, config: Config, text: str = "text", out: str = "spans") -> DataFrame:
    """All spans of every detector, before any is settled."""
    df = df.withColumn(out, F.expr(_found(text, config)))
    if config.mode == "auto":
        df = df.withColumn("_domain", F.expr(detect.domain(text, out)))
        df = df.withColumn(out, F.expr(detect.routed(out, "_domain"))).drop("_domain")
    return df


def processed(df: DataFrame, config: Config, text: str = "text", out: str = "spans") -> DataFrame:
    """The spans that stand: settled, propagated, filtered, in order of place."""
    df = detected(df, config, text, out).withColumn(out, F.expr(resolve.winners(out, config.model, config.weights, config.measured)))
    if config.propagate:
        df = df.withColumn(out, F.expr(refine.propagated(text, out, config.propagation_threshold)))
    return df.withColumn(out, F.expr(_refined(text, out, config)))


def final(text: str, config: Config) -> str:
    """``processed`` as one expression over ``text``, for use as a column."""
    steps = []
    if config.mode == "auto":
        steps.append(lambda s: detect.routed(s, detect.domain(text, s)))
    steps.append(lambda s: resolve.winners(s, config.model, config.weights, config.measured))
    if config.propagate:
        steps.append(lambda s: refine.propagated(text, s, config.propagation_threshold))
    steps.append(lambda s: _refined(text, s, config))
    out = _found(text, config)
    for step in steps:
        out = S.let(out, step)
    return f"CASE WHEN {text} IS NULL THEN {S.EMPTY} ELSE {out} END"


def rewriter(config: Config):
    policy = load(config.country, config.overlay)
    action = lambda label: f"coalesce(map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in policy.actions.items())})[{label}], {quoted(policy.default)})"
    if config.per_label_actions:
        return lambda v, label: f"CASE {action(label)} " + " ".join(f"WHEN '{name}' THEN {s(v, label)}" for name, s in masking.STYLES.items()) + f" ELSE {masking.hashed(v, label)} END"
    style = masking.style(config.masking_style)
    return (lambda v, label: style(v, f"upper({action(label)})")) if config.keep_surrogates else style


def redact(df: DataFrame, config: Config = Config(), text: str = "text", out: str = "redacted_text", spans: str = "spans") -> DataFrame:  # noqa: B008
    """``df`` with the text rewritten in ``out`` and its spans in ``spans``. Null stays null."""
    return processed(df, config, text, spans).withColumn(out, F.expr(S.splice(text, spans, rewriter(config))))


def scan(df: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:  # noqa: B008
    """``df`` with detections (with their text), total_detections, entity_counts and has_pii."""
    s, l, x = var("s"), var("l"), var("x")  # noqa: E741
    df = processed(df, config, text, "detections")
    labels = f"array_sort(array_distinct(transform(detections, {s} -> {s}.label)))"
    counts = f"map_from_arrays({labels}, transform({labels}, {l} -> size(filter(detections, {x} -> {x}.label = {l}))))"
    found = f"transform(detections, {s} -> named_struct('start', {s}.start, 'end', {s}.end, 'label', {s}.label, 'score', {s}.score, 'source', {s}.source, 'text', {S.value_of(text, s)}))"
    return df.withColumns({"total_detections": F.size("detections"), "entity_counts": F.expr(counts), "has_pii": F.size("detections") > 0, "detections": F.expr(found)})


def scan_report(df: DataFrame, config: Config = Config(), text: str = "text", around: int = 20) -> DataFrame:  # noqa: B008
    """``scan`` with 20 characters of context on either side of each detection."""
    s = var("s")
    begin = f"greatest({s}.start - {around}, 0)"
    made = f"transform(detections, {s} -> named_struct('start', {s}.start, 'end', {s}.end, 'label', {s}.label, 'score', {s}.score, 'source', {s}.source, 'text', {s}.text, 'context', substring({text}, {begin} + 1, {s}.end + {around} - {begin})))"
    return scan(df, config, text).withColumn("detections", F.expr(made))


def relation(df: DataFrame, config: Config, text: str = "text", id_: str = "doc_id", raw: bool = False) -> DataFrame:
    """Spans as rows (id, start, end, label, score, source, ord, value); ``raw``: before any is settled."""
    some = (detected if raw else processed)(df.select(id_, text), config, text, "_spans")
    some = some.select(id_, text, F.explode("_spans").alias("_s"))
    return some.select(id_, "_s.*", F.expr(S.value_of(text, "_s")).alias("value"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def redact_table(df: DataFrame, config: Config = Config(), columns: list[str] | None = None, show_entities: bool = False) -> DataFrame:  # noqa: B008
    """String columns (or those given) rewritten in place; ``show_entities`` adds {col}_entities with count and types."""
    for c in columns or text_columns(df):
        if c not in df.columns:
            log.warning("column %s is missing and skipped", c)
            continue
        df = redact(df, config, f"`{c}`", "__new", "__spans")
        if show_entities:
            s = var("s")
            df = df.withColumn(f"{c}_entities", F.expr(f"named_struct('count', size(__spans), 'types', array_sort(array_distinct(transform(__spans, {s} -> {s}.label))))"))
        df = df.withColumn(c, F.col("__new")).drop("__new", "__spans")
    return df


def table_summary(df: DataFrame, config: Config = Config(), columns: list[str] | None = None, id_: str = "doc_id") -> DataFrame:  # noqa: B008
    """Entities of a table by column, by type and in all: (column, label, entities, rows). Null stands for all."""
    found = None
    for c in columns or [c for c in text_columns(df) if c != id_]:
        one = relation(df, config, f"`{c}`" if c != "text" else c, id_).select(F.lit(c).alias("column"), "label", id_)
        found = one if found is None else found.unionByName(one)
    return found.groupingSets([["column", "label"], ["column"], ["label"], []], "column", "label").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct(id_).alias("rows"))


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text once, with how often it occurs: what to detect on where a corpus repeats itself. Grouped by a digest; null is left out."""
    keyed = df.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("__digest"))
    return keyed.agg(F.any_value(text).alias(text), F.count(F.lit(1)).alias("copies")).drop("__digest")


def redact_once(df: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:  # noqa: B008
    """``redact`` with each distinct text worked on once."""
    return stats.once(df, lambda d: redact(d, config, text), text)


def redact_pandas(spark, frame, config: Config = Config(), columns: list[str] | None = None):  # noqa: B008
    """A pandas table in, a pandas table out, rows in order."""
    df = spark.createDataFrame(frame.assign(__row=range(len(frame))))
    cols = columns or [c for c in text_columns(df)]
    return redact_table(df, config, cols).orderBy("__row").drop("__row").toPandas()


def _batch(spark, texts: list, run, result, failed) -> list[dict]:
    """``result`` of each text by its place in the list; what is no string is not run but gives ``failed`` with an error."""
    bad = {k: f"not a string: {type(t).__name__}" for k, t in enumerate(texts) if t is not None and not isinstance(t, str)}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if k not in bad], "row int, text string")
    done = {r["row"]: result(r) for r in run(df).collect()} if len(bad) < len(texts) else {}
    return [failed(t) | {"error": bad[k]} if k in bad else done[k] for k, t in enumerate(texts)]


def redact_batch(spark, texts: list[str | None], config: Config = Config()) -> list[dict]:  # noqa: B008
    """Redact a list; results in its order. An entry that is no string comes back as it is, with its error."""
    return _batch(spark, texts, lambda df: redact(df, config), lambda r: {"text": r["redacted_text"], "spans": [s.asDict() for s in r["spans"] or []]}, lambda t: {"text": t, "spans": []})


def scan_batch(spark, texts: list[str | None], config: Config = Config()) -> list[dict]:  # noqa: B008
    return _batch(spark, texts, lambda df: scan(df, config), lambda r: r.asDict(recursive=True), lambda t: {"detections": [], "total_detections": 0, "has_pii": False})
