"""Queries of evaluation, calibration, model output and services, with their SQL.

Gold spans, and what three detectors make of them, are made from the customers' keys in
words that both engines know: six spans a customer, twenty characters apart, which a
detector shifts by up to three characters or gives another label now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..functions import spans as S
from ..operators import detect, evaluate, metrics, models, resolve, stats
from ..sources.policies import MAIL, QUAD, Rule
from . import columns, pipeline, service
from .catalog import _FOLD, _q, query, read, spread, texts

LABELS = ("PERSON", "EMAIL", "PHONE", "ORG")
DETECTORS = ("regex", "spacy", "bert")
_LABEL = "CASE ({0}) % 4 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LABELS)) + " END"
_PLACE = "j * 20 + {0}", "j * 20 + {0} + 6 + c_custkey % 5"
_MOVED = "(CASE WHEN (c_custkey + j * 3 + d) % 5 = 0 THEN (c_custkey + d) % 3 + 1 ELSE 0 END)"
_SAID = "c_custkey + j + (CASE WHEN (c_custkey * 7 + j + d * 3) % 11 = 0 THEN 1 ELSE 0 END)"
_NAME = "CASE d " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(DETECTORS)) + " END"
_SCORE = "CAST((c_custkey * 31 + j * 17 + d * 11) % 100 AS DOUBLE) / 100"

_GOLD_SQL = f"""gold AS (SELECT c_custkey AS doc_id, CAST({_PLACE[0].format(0)} AS INT) AS start, CAST({_PLACE[1].format(0)} AS INT) AS stop, {_LABEL.format('c_custkey + j')} AS label
    FROM customer, (SELECT unnest(range(6)) AS j))"""
_PRED_SQL = f"""pred AS (SELECT {_NAME} AS detector, c_custkey AS doc_id, CAST({_PLACE[0].format(_MOVED)} AS INT) AS start, CAST({_PLACE[1].format(_MOVED)} AS INT) AS stop, {_LABEL.format(_SAID)} AS label, {_SCORE} AS score, d * 10 + j AS ord
    FROM customer, (SELECT unnest(range(6)) AS j), (SELECT unnest(range(3)) AS d) WHERE (c_custkey + j * 5 + d) % 13 <> 0)"""
_RATED = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END"


def gold(spark, d) -> DataFrame:
    df = spread(spark, d, "customer", "c_custkey").select("c_custkey", F.explode(F.expr("sequence(0, 5)")).alias("j"))
    return df.selectExpr("c_custkey AS doc_id", f"CAST({_PLACE[0].format(0)} AS INT) AS start", f"CAST({_PLACE[1].format(0)} AS INT) AS end", f"{_LABEL.format('c_custkey + j')} AS label")


def predicted(spark, d) -> DataFrame:
    df = spread(spark, d, "customer", "c_custkey").select("c_custkey", F.explode(F.expr("sequence(0, 5)")).alias("j")).withColumn("d", F.explode(F.expr("sequence(0, 2)"))).where("(c_custkey + j * 5 + d) % 13 <> 0")
    return df.selectExpr(f"{_NAME} AS detector", "c_custkey AS doc_id", f"CAST({_PLACE[0].format(_MOVED)} AS INT) AS start", f"CAST({_PLACE[1].format(_MOVED)} AS INT) AS end", f"{_LABEL.format(_SAID)} AS label", f"{_SCORE} AS score", "d * 10 + j AS ord")


_TRACK_SQL = f"""{_GOLD_SQL}, {_PRED_SQL}, hit AS (
    SELECT p.detector, p.label, (g.doc_id IS NOT NULL)::INT AS tp, (g.doc_id IS NULL)::INT AS fp, 0 AS fn FROM (SELECT DISTINCT detector, doc_id, start, stop, label FROM pred) p LEFT JOIN gold g USING (doc_id, start, stop, label)
    UNION ALL SELECT n.detector, g.label, 0, 0, 1 FROM gold g, (SELECT DISTINCT detector FROM pred) n WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.detector = n.detector AND p.doc_id = g.doc_id AND p.start = g.start AND p.stop = g.stop AND p.label = g.label)),
    track AS (SELECT detector, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM hit GROUP BY GROUPING SETS ((detector, label), (detector)))"""


@query("tracker_metrics", f"WITH {_TRACK_SQL}, pr AS (SELECT *, {_RATED} FROM track) SELECT *, {_F1} AS f1 FROM pr")
def tracker_metrics(spark, d):
    return evaluate.tracked(gold(spark, d), predicted(spark, d))


_WEIGHED = "CASE WHEN precision < 0.3 THEN 0.6 WHEN precision < 0.5 THEN 0.5 WHEN precision < 0.7 THEN 0.4 ELSE 0.3 END::DOUBLE"


def _calibration(method: str, value: str) -> None:
    def run(spark, d):
        return evaluate.calibrated_weights(gold(spark, d), predicted(spark, d), method)

    query(f"calibrate_{method}", f"""WITH {_TRACK_SQL}, one AS (SELECT detector, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM track WHERE label IS NULL GROUP BY GROUPING SETS ((detector), ())),
        pr AS (SELECT *, {_RATED} FROM one), f AS (SELECT *, {_F1} AS f1 FROM pr)
        SELECT *, CASE WHEN detector IS NOT NULL THEN greatest(0.1, {value})::DOUBLE END AS weight, CASE WHEN detector IS NOT NULL THEN {_WEIGHED} END AS threshold FROM f""")(run)  # fmt: skip


for _method, _value in (("f1_squared", "f1 * f1"), ("precision", "precision"), ("f1", "f1"), ("balanced", "pow(f1, 1.5)")):
    _calibration(_method, _value)

_SCORED_SQL = f"{_GOLD_SQL}, {_PRED_SQL}, sc AS (SELECT p.detector, p.label, p.score, (g.doc_id IS NOT NULL)::INT AS correct FROM pred p LEFT JOIN gold g USING (doc_id, start, stop, label))"


@query("score_history", f"WITH {_SCORED_SQL} SELECT detector, label, count(*) AS n, CAST(sum(correct) AS BIGINT) AS correct, round(sum(round(score, 2)) / count(*), 9) AS mean_score, count(DISTINCT round(score, 2)) AS bins FROM sc GROUP BY ALL")
def score_history(spark, d):
    h = evaluate.history(gold(spark, d), predicted(spark, d))
    return h.select("detector", "label", "n", "correct", F.round("mean_score", 9).alias("mean_score"), F.size("scores").cast("long").alias("bins"))


@query("platt_eligible", f"""WITH {_SCORED_SQL}, n AS (SELECT detector, coalesce(label, '_global') AS label, count(*) AS n FROM sc GROUP BY GROUPING SETS ((detector, label), (detector)))
    SELECT * FROM n WHERE detector IN (SELECT detector FROM n WHERE label = '_global' AND n >= 20) AND (label = '_global' OR n >= 10)""")  # fmt: skip
def platt_eligible(spark, d):
    return evaluate.eligible(evaluate.scored(gold(spark, d), predicted(spark, d)))


@query("platt_params")
def platt_params(spark, d):
    return evaluate.platt_params(evaluate.scored(gold(spark, d), predicted(spark, d)))


@query("calibrated_scores", f"""WITH {_PRED_SQL} SELECT doc_id, detector AS source, label, start, round(CASE WHEN detector = 'spacy' AND label = 'EMAIL' THEN 1 / (1 + exp(-(-2.0 * score + 0.5))) WHEN detector = 'spacy' THEN 1 / (1 + exp(-(1.5 * score - 1))) ELSE score END, 9) AS score FROM pred""")
def calibrated_scores(spark, d):
    params = evaluate.params_table(spark, {"calibrators": {"spacy": {"EMAIL": {"a": -2.0, "b": 0.5}, "_global": {"a": 1.5, "b": -1.0}}}})
    out = metrics.calibrated(predicted(spark, d).withColumnRenamed("detector", "source"), params)
    return out.select("doc_id", "source", "label", "start", F.round("score", 9).alias("score"))


@query("partial_by_label", f"""WITH {_GOLD_SQL}, {_PRED_SQL}, p AS (SELECT DISTINCT doc_id, start, stop, label FROM pred WHERE detector = 'spacy'),
    pair AS (SELECT g.label, (least(g.stop, p.stop) - greatest(g.start, p.start))::DOUBLE / (greatest(g.stop, p.stop) - least(g.start, p.start)) AS iou FROM gold g JOIN p ON g.doc_id = p.doc_id AND g.label = p.label AND g.start < p.stop AND p.start < g.stop),
    mark AS (SELECT label, 1 AS tp, iou, 0 AS g, 0 AS p, 0 AS e FROM pair WHERE iou >= 0.5 UNION ALL SELECT label, 0, NULL, 1, 0, 0 FROM gold UNION ALL SELECT label, 0, NULL, 0, 1, 0 FROM p
        UNION ALL SELECT label, 0, NULL, 0, 0, 1 FROM gold SEMI JOIN p USING (doc_id, start, stop, label)),
    n AS (SELECT label, CAST(sum(e) AS BIGINT) AS exact_tp, CAST(sum(p) - sum(e) AS BIGINT) AS exact_fp, CAST(sum(g) - sum(e) AS BIGINT) AS exact_fn, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) - sum(tp) AS BIGINT) AS fp, CAST(sum(g) - sum(tp) AS BIGINT) AS fn, round(avg(iou), 9) AS mean_iou FROM mark GROUP BY GROUPING SETS ((label), ())),
    pr AS (SELECT *, {_RATED} FROM n) SELECT *, {_F1} AS f1 FROM pr""")  # fmt: skip
def partial_by_label(spark, d):
    return evaluate.partial_by_label(gold(spark, d), predicted(spark, d).where("detector = 'spacy'")).withColumn("mean_iou", F.round("mean_iou", 9))


@query("iou_pairs", f"""WITH {_GOLD_SQL}, {_PRED_SQL} SELECT * FROM (SELECT p.detector, g.doc_id, g.start AS g_start, p.start AS p_start, g.label AS g_label, p.label AS p_label, (least(g.stop, p.stop) - greatest(g.start, p.start))::DOUBLE / (greatest(g.stop, p.stop) - least(g.start, p.start)) AS iou
    FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.start < p.stop AND p.start < g.stop) WHERE iou >= 0.6 AND iou < 1""")  # fmt: skip
def iou_pairs(spark, d):
    found = metrics.overlaps(gold(spark, d), predicted(spark, d), 0.6, same_label=False, keep=("detector",)).where("iou < 1")
    return found.select("detector", "doc_id", "g_start", "p_start", "g_label", "p_label", F.col("iou").cast("double").alias("iou"))


@query("mismatch_samples", f"""WITH {_GOLD_SQL}, {_PRED_SQL}, p AS (SELECT DISTINCT doc_id, start, stop, label FROM pred WHERE detector = 'bert'), t AS (SELECT c_custkey AS doc_id, repeat(c_name, 8) AS x FROM customer),
    fp AS (SELECT 'fp' AS kind, * FROM p ANTI JOIN gold USING (doc_id, start, stop, label) ORDER BY doc_id, start, stop, label LIMIT 20), fn AS (SELECT 'fn' AS kind, * FROM gold ANTI JOIN p USING (doc_id, start, stop, label) ORDER BY doc_id, start, stop, label LIMIT 20)
    SELECT kind, doc_id, start, stop AS "end", label, substr(x, start + 1, stop - start) AS value FROM (SELECT * FROM fp UNION ALL SELECT * FROM fn) JOIN t USING (doc_id)""")  # fmt: skip
def mismatch_samples(spark, d):
    t = read(spark, d, "customer").selectExpr("c_custkey AS doc_id", "repeat(c_name, 8) AS text")
    return evaluate.mismatches(gold(spark, d), predicted(spark, d).where("detector = 'bert'"), t)


_EXPECTED = (["SSN"], ["EMAIL", "PHONE_US"], [], ["MEDICAL_RECORD"], ["CREDIT_CARD", "PERSON_NAME"])
_DETECTED = (["tfn"], ["EMAIL_ADDRESS", "telephone"], ["ZIP_CODE"], ["RECORD_NUMBER_X"], ["CARD"], ["SSN", "EMAIL", "PHONE_US"], [], ["Mrn", "PERSON"], ["CREDIT_CARD_NUMBER", "name"])


def _arrays(kind: str, values) -> str:
    one = {"sql": lambda v: "[" + ", ".join(map(_q, v)) + "]::VARCHAR[]", "spark": lambda v: f"CAST(array({', '.join(map(_q, v))}) AS array<string>)"}[kind]
    return "CASE c_custkey % " + str(len(values)) + " " + " ".join(f"WHEN {k} THEN {one(v)}" for k, v in enumerate(values)) + " END"


_CASE_TIER = "CASE c_custkey % 3 WHEN 0 THEN 'smoke' WHEN 1 THEN 'basic' ELSE 'full' END AS tier, CASE WHEN c_custkey % 7 < 4 THEN 'US' ELSE 'AU' END AS country"
_CLASSES = "[" + ", ".join("[" + ", ".join(_q(x) for x in sorted({k, *v.split()})) + "]" for k, v in evaluate.ALIASES.items()) + "]"


@query("regression_tiers", f"""WITH c AS (SELECT {_CASE_TIER}, {_arrays('sql', _EXPECTED)} AS want, {_arrays('sql', _DETECTED)} AS got FROM customer),
    l AS (SELECT *, list_transform(want, lambda x: lower(x)) AS lw, list_transform(got, lambda x: lower(x)) AS lg FROM c),
    k AS (SELECT *, CASE WHEN len(want) = 0 THEN len(list_filter(lg, lambda x: {' OR '.join(f"contains(x, {_q(w)})" for w in evaluate.PERSONAL)})) = 0
        ELSE len(list_filter(lw, lambda e: list_contains(lg, e) OR len(list_filter({_CLASSES}, lambda s: list_contains(s, e) AND list_has_any(s, lg))) > 0 OR len(list_filter(lg, lambda x: length(e) > 3 AND length(x) > 3 AND (contains(x, e) OR contains(e, x)))) > 0)) = len(lw) END AS ok,
        len(list_intersect(got, want)) AS tp, len(list_filter(got, lambda x: NOT list_contains(want, x))) AS fp, len(list_filter(want, lambda x: NOT list_contains(got, x))) AS fn FROM l),
    n AS (SELECT t AS tier, country, count(*) AS total, CAST(sum(ok::INT) AS BIGINT) AS passed, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
        FROM k JOIN (VALUES ('smoke', 'smoke'), ('smoke', 'basic'), ('smoke', 'full'), ('basic', 'basic'), ('basic', 'full'), ('full', 'full')) v(own, t) ON k.tier = v.own GROUP BY t, country),
    pr AS (SELECT *, passed::DOUBLE / total * 100 AS accuracy, {_RATED} FROM n) SELECT *, {_F1} AS f1 FROM pr""")  # fmt: skip
def regression_tiers(spark, d):
    tier, country = _CASE_TIER.rsplit(", CASE WHEN", 1)
    cases = spread(spark, d, "customer", "c_custkey").selectExpr(tier, "CASE WHEN" + country, f"{_arrays('spark', _EXPECTED)} AS expected", f"{_arrays('spark', _DETECTED)} AS detected")
    return evaluate.tiers(cases)


_RAW_LABELS = ("B-PER", "I-PER", "B-org", "LOC", "I-GPE", "MONEY", "B-MISC", "NORP", "facility", "Quantity", "B-LAW", "PERCENT")


@query("model_labels", f"""SELECT raw, CASE upper(bare) {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in models.TAGS.items())} ELSE bare END AS label FROM (SELECT raw, replace(replace(raw, 'B-', ''), 'I-', '') AS bare FROM (SELECT unnest([{', '.join(map(_q, _RAW_LABELS))}]) AS raw))""")
def model_labels(spark, d):
    return spark.createDataFrame([(x,) for x in _RAW_LABELS], "raw string").withColumn("label", F.expr(models.model_label("raw")))


def _row_spans(spark, d) -> DataFrame:
    made = F.struct("start", "end", "label", "score", F.col("detector").alias("source"), "ord")
    return predicted(spark, d).groupBy("doc_id").agg(F.collect_list(made).alias("s"))


@query("label_thresholds", f"WITH {_PRED_SQL} SELECT doc_id, count(*) FILTER (score >= CASE label WHEN 'PERSON' THEN 0.75 WHEN 'ORG' THEN 0.3 ELSE 0.5 END) AS kept, count(*) FILTER (score >= 0.7) AS confident FROM pred GROUP BY doc_id")
def label_thresholds(spark, d):
    kept = models.confident("s", 0.5, {"PERSON": 0.75, "ORG": 0.3})
    return _row_spans(spark, d).select("doc_id", F.expr(f"size({kept})").cast("long").alias("kept"), F.expr(f"size({models.confident('s', 0.7)})").cast("long").alias("confident"))


_BEST_SQL = f"WITH {_PRED_SQL} SELECT doc_id, start, stop AS \"end\", label, detector AS source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, stop, label ORDER BY score DESC, ord) AS r FROM pred) WHERE r = 1"


@query("unique_spans", _BEST_SQL)
def unique_spans(spark, d):
    return models.deduplicated(predicted(spark, d).withColumnRenamed("detector", "source")).select("doc_id", "start", "end", "label", "source", "score")


@query("unique_spans_in_row", f"WITH {_PRED_SQL} SELECT doc_id, count(*) AS n, round(sum(best), 6) AS scores FROM (SELECT doc_id, max(score) AS best FROM pred GROUP BY doc_id, start, stop, label) GROUP BY doc_id")
def unique_spans_in_row(spark, d):
    return _row_spans(spark, d).select("doc_id", F.explode(F.expr(models.unique("s"))).alias("u")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("u.score"), 6).alias("scores"))


def _consensus(model: str) -> None:
    """Overlapping spans of three sources with weights and scores of their own."""

    def run(spark, d):
        return resolve.resolved(predicted(spark, d).withColumnRenamed("detector", "source"), model).select("doc_id", "start", "end", "label", "source")

    label = f"CASE label {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in resolve.NORMAL.items())} ELSE label END" if model == "adaptive" else "label"
    weight = f"CASE detector {' '.join(f'WHEN {_q(k)} THEN {v}' for k, v in resolve.WEIGHTS.items())} ELSE 1 END::DOUBLE"
    rank = {
        "adaptive": f"score * {weight} * (1 + least(stop - start, 30) / 150.0::DOUBLE) * (1 + 0.15::DOUBLE * (count(*) OVER (PARTITION BY doc_id, g, label) - 1))",
        "standard": f"score * {weight} * (1 + least(stop - start, 20) / 100.0::DOUBLE) * CASE label {' '.join(f'WHEN {_q(k)} THEN {v}' for k, v in resolve.PRIORITY.items())} ELSE 2 END::DOUBLE",
    }[model]
    query(f"consensus_{model}", f"""WITH {_PRED_SQL}, span AS (SELECT * REPLACE ({label} AS label) FROM pred),
        mark AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM span),
        grp AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, ord ROWS UNBOUNDED PRECEDING) AS g FROM mark), fin AS (SELECT *, {rank} AS f FROM grp)
        SELECT doc_id, start, stop AS "end", label, detector AS source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY f DESC, start, ord) AS r FROM fin) WHERE r = 1""")(run)  # fmt: skip


for _model in ("adaptive", "standard"):
    _consensus(_model)

_RUNS = "event_id, value AS seconds, value * 10 AS chars_per_second, user_id % 7 AS hits, user_id % 3 AS misses, event_type <> 'error' AS success, user_id % 5 AS entities, event_type"


@query("performance_summary", f"""WITH r AS (SELECT {_RUNS} FROM events ORDER BY event_id DESC LIMIT 1000) SELECT round(avg(seconds), 6) AS mean_seconds, max(seconds) AS most_seconds, min(seconds) AS least_seconds, round(avg(chars_per_second), 6) AS mean_throughput, max(chars_per_second) AS most_throughput,
    round(avg(CASE WHEN hits + misses > 0 THEN hits::DOUBLE / (hits + misses) ELSE 0 END), 6) AS hit_rate, count(*) AS runs FROM r""")  # fmt: skip
def performance_summary(spark, d):
    p = stats.performance(read(spark, d, "events").selectExpr(*_RUNS.split(", ")), "event_id")
    return p.withColumns({c: F.round(c, 6) for c in ("mean_seconds", "mean_throughput", "hit_rate")})


@query("batch_statistics", f"WITH r AS (SELECT {_RUNS} FROM events) SELECT event_type, count(*) AS texts, CAST(sum(success::INT) AS BIGINT) AS ok, CAST(sum(entities) AS BIGINT) AS entities, round(sum(seconds) / count(*), 6) AS mean_seconds, round(count(*) / greatest(sum(seconds), 0.001), 6) AS per_second FROM r GROUP BY event_type")
def batch_statistics(spark, d):
    b = stats.batch_stats(read(spark, d, "events").selectExpr(*_RUNS.split(", ")), ("event_type",))
    return b.withColumns({c: F.round(c, 6) for c in ("mean_seconds", "per_second")})


@query("normalised_texts", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def normalised_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", stats.text_hash(stats.normalised(F.col("text"))).alias("digest"))


_TERM = "elle"
_TERM_SQL = f"d AS (SELECT doc_id, {_FOLD} AS t FROM documents)"
_ONLY_TERM = pipeline.Config(detectors=(), block_list=(_TERM,), masking_style="replace", propagate=False)


@query("redaction_column", rf"WITH {_TERM_SQL} SELECT doc_id, regexp_replace(t, '(?i)\b{_TERM}\b', '<BLOCKED>', 'g') AS shown FROM d")
def redaction_column(spark, d):
    return texts(spark, d).select("doc_id", columns.create_udf(_ONLY_TERM)("text").alias("shown"))


@query("spans_column", rf"WITH {_TERM_SQL} SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)\b{_TERM}\b')) AS INT) AS n, instr(lower(regexp_replace(t, '(?i)\b{_TERM}\b', chr(1), 'g')), chr(1)) - 1 AS first FROM d WHERE regexp_matches(t, '(?i)\b{_TERM}\b')")
def spans_column(spark, d):
    found = texts(spark, d).withColumn("s", columns.create_udf(_ONLY_TERM, "spans")("text")).where("size(s) > 0")
    return found.select("doc_id", F.size("s").alias("n"), F.col("s")[0]["start"].cast("long").alias("first"))


@query("redact_once", rf"WITH {_TERM_SQL} SELECT doc_id, regexp_replace(t, '(?i)\b{_TERM}\b', '<BLOCKED>', 'g') AS redacted_text FROM d")
def redact_once(spark, d):
    return pipeline.redact_once(texts(spark, d), _ONLY_TERM).select("doc_id", "redacted_text")


@query("replacement_maps", rf"WITH {_TERM_SQL} SELECT doc_id, list_distinct(regexp_extract_all(t, '(?i)\b{_TERM}\b')).len() AS entries FROM d")
def replacement_maps(spark, d):
    return pipeline.redact(texts(spark, d), _ONLY_TERM).select("doc_id", F.size(F.expr(service.replacement_map())).cast("long").alias("entries"))


@query("document_service", rf"""WITH {_TERM_SQL}, k AS (SELECT doc_id, t, CAST(len(regexp_extract_all(t, '(?i)\b{_TERM}\b')) AS INT) AS n FROM d WHERE t IS NOT NULL)
    SELECT doc_id, doc_id % 10 <> 3 AS success, CASE WHEN doc_id % 10 = 3 THEN 'unsupported type: image/png' END AS error, CASE WHEN doc_id % 10 <> 3 THEN concat_ws(' ', n, length(t), length(t) + n * 5) END AS sizes FROM k""")  # fmt: skip
def document_service(spark, d):
    files = texts(spark, d).where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.expr("IF(doc_id % 10 = 3, 'image/png', 'text/plain')").alias("content_type"))
    out = service.processed_files(files, _ONLY_TERM)
    return out.select(F.col("path").cast("long").alias("doc_id"), "success", "error", F.when(F.col("success"), F.concat_ws(" ", "entities_found", "original_size", "redacted_text_length")).alias("sizes"))


_PLANTED_ODD = "'call (' || lpad(CAST(c_custkey % 800 + 200 AS VARCHAR(20)), 3, '0') || ') 555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR(20)), 2, '0') || ' or c' || CAST(c_custkey AS VARCHAR(20)) || '@mail.example.org from 10.2.' || CAST(c_custkey % 256 AS VARCHAR(20)) || '.7'"


def _all_styles(style: str, mail: str, quad: str) -> None:
    """Two labels in one text, each value in the style of its label."""

    def run(spark, d):
        rules = [Rule("EMAIL", MAIL), Rule("IP_ADDRESS", QUAD)]
        df = spread(spark, d, "customer", "c_custkey").select("c_custkey", F.expr(_PLANTED_ODD).alias("text"))
        df = df.withColumn("s", F.expr(resolve.winners(detect.by_rules("text", rules))))
        return df.select("c_custkey", F.expr(S.splice("text", "s", masking.style(style))).alias("shown"))

    m, q = _q("(?im)" + MAIL), _q("(?im)" + QUAD)
    value = lambda of, p: of.replace("v", f"regexp_extract(t, {p}, 0)")
    query(f"styles_{style}", f"""WITH d AS (SELECT c_custkey, {_PLANTED_ODD} AS t FROM customer)
        SELECT c_custkey, replace(replace(t, regexp_extract(t, {m}, 0), {value(mail, m)}), regexp_extract(t, {q}, 0), {value(quad, q)}) AS shown FROM d""")(run)  # fmt: skip


for _style, _mail, _quad in (
    ("mask", "repeat('*', length(v))", "repeat('*', length(v))"), ("replace", "'<EMAIL>'", "'<IP_ADDRESS>'"), ("brackets", "'[EMAIL]'", "'[IP_ADDRESS]'"), ("hash", "substr(sha256(v), 1, 12)", "substr(sha256(v), 1, 12)"),
):
    _all_styles(_style, _mail, _quad)


_CONTEXT = "CASE c_custkey % 4 WHEN 0 THEN 'the patient Mr Somebody, born in May' WHEN 1 THEN 'column Somebody of table' WHEN 2 THEN 'contact dr Somebody by phone, age 40' ELSE 'Somebody else went' END"


@query("contextual_production", f"""WITH t AS (SELECT c_custkey, {_CONTEXT} AS x FROM customer), n AS (SELECT c_custkey, lower(x) AS w FROM t)
    SELECT c_custkey, round(least(1.0, greatest(0.1, 0.6 + 0.1 * ({' + '.join(f"regexp_matches(w, {_q(p)})::INT" for p in detect.BOOST['PERSON_NAME'])}) - 0.2 * regexp_matches(w, {_q(detect.PENALTY['PERSON_NAME'])})::INT))::DOUBLE, 6) AS score FROM n""")  # fmt: skip
def contextual_production(spark, d):
    df = spread(spark, d, "customer", "c_custkey").select("c_custkey", F.expr(_CONTEXT).alias("text"))
    df = df.withColumn("s", F.expr(detect.by_rules("text", [Rule("PERSON_NAME", "Somebody")], score=0.6)))
    return df.select("c_custkey", F.explode(F.expr(detect.contextual("text", "s"))).alias("s")).select("c_custkey", F.round("s.score", 6).alias("score"))


@query("text_chunks")
def text_chunks(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.expr(models.chunks("text"))).alias("k", "c")).select("doc_id", "k", "c.start", "c.end")
