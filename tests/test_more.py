"""Models, evaluation, columns, services and state, on small cases worked out by hand."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspan.functions import masking
from veilspan.functions import spans as S
from veilspan.functions import validators
from veilspan.operators import audit, detect, evaluate, metrics, models, refine, stats
from veilspan.plans import columns, pipeline, service
from veilspan.sources import documents

SPANS = "doc_id long, start int, end int, label string, score double, source string, ord int"


def one(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").first()["v"]


def test_models(spark):
    assert [one(spark, models.model_label(S.quoted(x))) for x in ("B-PER", "I-gpe", "MONEY", "Thing", "B-Thing")] == ["PERSON_NAME", "LOCATION", "FINANCIAL", "Thing", "Thing"]
    assert one(spark, models.entity_label("'date of birth'")) == "DATE_OF_BIRTH"
    rows = [(1, 0, 5, "A", 0.6, "x", 1), (1, 0, 5, "A", 0.9, "y", 2), (1, 0, 5, "B", 0.4, "x", 3), (1, 9, 12, "A", 0.9, "y", 4), (1, 9, 12, "A", 0.9, "x", 5)]
    df = spark.createDataFrame(rows, SPANS)
    want = [(0, 5, "A", "y"), (0, 5, "B", "x"), (9, 12, "A", "y")]
    assert sorted((r.start, r.end, r.label, r.source) for r in models.deduplicated(df).collect()) == want
    arr = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "score", "source", "ord")).alias("s"))
    got = arr.select(F.expr(models.unique("s")).alias("u"), F.expr(models.confident("s", 0.5, {"B": 0.3})).alias("c")).first()
    assert sorted((x["start"], x["end"], x["label"]) for x in got["u"]) == [w[:3] for w in want] and len(got["c"]) == 5


def chunked(text, size, overlap, tail):
    """The chunks, by a loop."""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    out, at = [], 0
    while at < len(text):
        stop = min(at + size, len(text))
        if stop < len(text):
            low = max(stop - tail, at)
            for end in models.ENDS:
                k = text.rfind(end, low, stop)
                if k >= 0:
                    stop = k + len(end)
                    break
        out.append((at, stop))
        if stop >= len(text):
            break
        at = max(stop - (overlap if stop < len(text) - overlap else 0), at + 1)
    return out


def test_chunks_and_a_model(spark):
    text = "".join(f"Sentence {k} ends here" + (". ", ".\n", "! ", " ", "\n\n")[k % 5] for k in range(200)) + "tail"
    rows = [(k, t) for k, t in enumerate(["", "short", text, "x" * 700, text[:301], "word. " * 80, None])]
    got = spark.createDataFrame(rows, "k int, text string").select("k", F.expr(models.chunks("text", 300, 30, 60)).alias("c")).collect()
    for r in got:
        assert [(c["start"], c["end"]) for c in r["c"]] == chunked(rows[r["k"]][1] or "", 300, 30, 60)

    def predict(texts):
        import re

        return [[(m.start(), m.end(), "B-PER", 0.9 if "1" in m[0] else 0.2) for m in re.finditer(r"Sentence \d+", t)] for t in texts]

    df = models.model_spans(spark.createDataFrame(rows, "k int, text string"), predict, "toy", 0.5, size=300, overlap=30)
    found = {r["k"]: r["model_spans"] for r in df.collect()}
    assert {text[s["start"] : s["end"]] for s in found[2]} >= {f"Sentence {k}" for k in range(200) if "1" in str(k)} and len({(s["start"], s["end"]) for s in found[2]}) == len(found[2])
    assert found[6] == [] and {s["label"] for s in found[2]} == {"PERSON_NAME"}
    out = pipeline.redact(df.where("k = 4"), pipeline.Config(detectors=(), models=("model_spans",), masking_style="replace", propagate=False)).first()
    assert "<PERSON_NAME> ends here" in out["redacted_text"]


def test_evaluation(spark, tmp_path):
    gold = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "B"), (2, 0, 4, "A")], "doc_id long, start int, end int, label string")
    pred = spark.createDataFrame([("d", 1, 0, 5, "A", 0.9), ("d", 1, 11, 15, "B", 0.8), ("d", 2, 0, 4, "A", 0.7), ("e", 1, 0, 5, "B", 0.6)], "detector string, doc_id long, start int, end int, label string, score double")
    t = {(r.detector, r.label): (r.tp, r.fp, r.fn) for r in evaluate.tracked(gold, pred).collect()}
    assert t[("d", None)] == (2, 1, 1) and t[("d", "A")] == (2, 0, 0) and t[("e", None)] == (0, 1, 3) and t[("e", "B")] == (0, 1, 1)
    p = {r.label: (r.exact_tp, r.tp, r.fp, r.fn, round(r.mean_iou, 3)) for r in evaluate.partial_by_label(gold, pred.where("detector = 'd'")).collect()}
    assert p[None] == (2, 3, 0, 0, 0.933) and p["B"] == (0, 1, 0, 0, 0.8)
    texts = spark.createDataFrame([(1, "abcdefghijklmnopqrst"), (2, "abcdef")], "doc_id long, text string")
    m = {(r.kind, r.value) for r in evaluate.mismatches(gold, pred.where("detector = 'd'"), texts).collect()}
    assert m == {("fp", "lmno"), ("fn", "klmno")}
    learnt = evaluate.calibration(gold, pred)
    assert abs(learnt["recommended_weights"]["d"] - (2 / 3) ** 2) < 1e-9 and learnt["recommended_weights"]["e"] == 0.1
    evaluate.save(learnt, path := str(tmp_path / "c.json"))
    assert evaluate.load(path) == json.loads(json.dumps(learnt))
    (tmp_path / "old.json").write_text('{"detector_weights": {"d": 0.5}}')
    assert evaluate.load(str(tmp_path / "old.json"))["recommended_weights"] == {"d": 0.5}
    cases = [(["SSN"], ["TFN"], True), (["EMAIL"], ["PHONE"], False), ([], ["PHONE_US"], False), ([], ["ZIP"], True), (["MEDICAL_RECORD"], ["RECORD_NUMBER"], True), (["ACCOUNT"], ["BANK_ACCOUNT"], True), (["A", "B"], ["A"], False)]
    got = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, expected array<string>, detected array<string>, ok boolean").withColumn("v", F.expr(evaluate.passes("detected", "expected"))).collect()
    assert all(r.v == r.ok for r in got), [r.k for r in got if r.v != r.ok]
    now = spark.createDataFrame([("smoke", "US", 90.0), ("basic", "US", 80.0)], "tier string, country string, accuracy double")
    assert [r.tier for r in evaluate.regressions(now.withColumn("accuracy", F.col("accuracy") - F.expr("IF(tier = 'smoke', 3, 1)")), now).collect()] == ["smoke"]


def test_platt_fit_follows_the_loop(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    rows = [("d", "AB"[k % 2], round(float(s), 3), int(rnd.random() < s)) for k, s in enumerate(rnd.random(300))] + [("d", "C", 0.5, 1)] * 9 + [("few", "A", 0.5, 1)] * 15
    scores = spark.createDataFrame(rows, "detector string, label string, score double, correct int")
    got = {(r.detector, r.label): (r.a, r.b) for r in evaluate.platt_params(scores).collect()}
    assert set(got) == {("d", "_global"), ("d", "A"), ("d", "B")}  # C has 9, and "few" 15 in all
    for label in ("A", "B", "_global"):
        x, y = (np.array([r[k] for r in rows if r[0] == "d" and label in (r[1], "_global")], float) for k in (2, 3))
        a, b = -1.0, 0.0
        for _ in range(100):
            q = 1 / (1 + np.exp(-(a * x + b)))
            a -= 0.01 * ((q - y) * x).sum() / max((q * (1 - q) * x * x).sum(), 1e-10)
            b -= 0.01 * (q - y).sum() / max((q * (1 - q)).sum(), 1e-10)
        assert np.allclose(got[("d", label)], (a, b))
    params = spark.createDataFrame([("d", "A", 2.0, 0.0), ("d", "_global", 0.0, 0.0)], "detector string, label string, a double, b double")
    s = spark.createDataFrame([("d", "A", 0.5), ("d", "Z", 0.9), ("other", "A", 0.3)], "source string, label string, score double")
    assert [round(r.score, 4) for r in metrics.calibrated(s, params).orderBy("source", "label").collect()] == [0.7311, 0.5, 0.3]


def test_greedy_matches(spark):
    cols = "doc_id long, g_start int, g_end int, g_label string, p_start int, p_end int, p_label string, iou double"
    rows = [(1, 0, 10, "A", 0, 9, "A", 0.9), (1, 0, 10, "A", 1, 10, "A", 0.9), (1, 12, 20, "A", 1, 10, "A", 0.6), (1, 12, 20, "A", 12, 19, "A", 0.5)]
    got = [(r.g_start, r.p_start) for r in metrics.greedy_matches(spark.createDataFrame(rows, cols)).orderBy("g_start").collect()]
    assert got == [(0, 0), (12, 1)]


def test_columns(spark):
    df = spark.createDataFrame([("SSN 123-45-6789, a@b.org",), (None,), ("",)], "t string")
    config = pipeline.Config(masking_style="replace")
    got = df.select(columns.create_udf(config)("t").alias("r"), columns.create_udf(config, "spans")("t").alias("s")).collect()
    assert [r.r for r in got] == ["SSN <SSN>, <EMAIL>", None, ""] and [len(r.s) for r in got] == [2, 0, 0]
    same = pipeline.redact(df, config, "t").select("redacted_text").collect()
    assert [r.r for r in got] == [r.redacted_text for r in same]
    columns.register(spark, "redact_it", config)
    df.createOrReplaceTempView("t_")
    assert [r[0] for r in spark.sql("SELECT redact_it(t) FROM t_").collect()] == [r.r for r in got]
    with pytest.raises(ValueError):
        columns.create_udf(config, "other")
    batch = pipeline.redact_batch(spark, ["a@b.org", 5, None], config)
    assert batch[0]["text"] == "<EMAIL>" and batch[1] == {"text": 5, "spans": [], "error": "not a string: int"} and batch[2]["text"] is None
    assert pipeline.scan_batch(spark, [5])[0]["error"]


def _docx(*paragraphs):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:body>" + "".join(f'<w:p a="1">{"".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs)}</w:p>' for runs in paragraphs) + "</w:body></w:document>")
        z.writestr("other.xml", "<x/>")
    return f.getvalue()


def test_document_service(spark):
    csv_ = b'name,note\n"Doe, J",mail a@b.org\n'
    assert documents.csv_text(csv_.decode()) == "Headers: name | note\n" + "-" * 50 + "\nDoe, J | mail a@b.org\n" and documents.csv_text("") == ""
    docx = _docx(["write to a@", "b.org now"], ["a@b.org &amp; co"])
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    files = [("t", "café a@b.org".encode("latin-1"), "text/plain"), ("c", csv_, "text/csv"), ("d", docx, kind), ("x", b"x", "image/png"), ("z", b"no zip", kind), ("e", b"", "text/plain")]
    df = spark.createDataFrame(files, "path string, content binary, content_type string")
    got = {r.path: r for r in service.processed_files(df, pipeline.Config(masking_style="replace")).collect()}
    assert bytes(got["t"].redacted_content) == "café <EMAIL>".encode() and got["t"].output_format == "preserved" and got["t"].entities_found == 1
    assert bytes(got["c"].redacted_content) == b'name,note\n"Doe, J",mail <EMAIL>\n'
    again = documents.text_of(bytes(got["d"].redacted_content), kind)
    assert again == "write to &lt;EMAIL&gt; now\n&lt;EMAIL&gt; &amp; co" and got["d"].original_size == len(docx)
    assert not got["x"].success and "image/png" in got["x"].error and not got["z"].success and got["x"].redacted_content is None
    assert got["e"].success and got["e"].entities_found == 0
    assert {r.output_format for r in service.processed_files(df.where("path = 'c'"), keep_form=False).collect()} == {"plain_text"}
    for bad in ({"country": "XX"}, {"masking_style": "no"}, {"data_class": "no"}, {"text": "x" * 100_001}, {"texts": ["x"] * 1001}, {"texts": ["x" * 10_001]}):
        with pytest.raises(ValueError):
            service.check_request(**bad)
    service.check_request("us", text="fine", texts=["fine"])


def test_stats_and_once(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a@b.org", "a@b.org", None, "", " x \t y\n"])], "k int, text string")
    got = {r.k: r.redacted_text for r in pipeline.redact_once(df, pipeline.Config(masking_style="replace")).collect()}
    assert got == {0: "<EMAIL>", 1: "<EMAIL>", 2: None, 3: "", 4: " x \t y\n"}
    assert df.where("k = 4").select(stats.normalised(F.col("text")).alias("n")).first().n == "x y"
    assert sorted(r.copies for r in pipeline.distinct_texts(df).collect()) == [1, 1, 2]
    runs = spark.createDataFrame([(k, float(k), 10.0 * k, k, 1) for k in range(10)], "id int, seconds double, chars_per_second double, hits int, misses int")
    p = stats.performance(runs, "id", 4).first()
    assert (p.mean_seconds, p.most_seconds, p.least_seconds, p.runs) == (7.5, 9.0, 6.0, 4)


def test_white_space_and_checks(spark):
    for v in ("the\\n", "\\t the", " the "):
        assert not one(spark, refine.keep(f"'{v}'", "'X'", "1.0D", "''", "''"))
    assert one(spark, validators.crn("'\\t123456789a\\n'")) and not one(spark, validators.crn("'12345678A'"))
    pack = detect.CustomPack({"BADGE": r"badge (\d+)", "DESK": {"patterns": [r"desk (\w+)"], "validator": {"min_length": 2}}}, bundled=False)
    got = one(spark, pack.spans("'badge 123, desk a, desk ab'"))
    assert sorted((s["label"], s["start"], s["end"]) for s in got) == [("BADGE", 0, 9), ("DESK", 19, 26)] and pack.labels() == ["BADGE", "DESK"]
    assert pack.remove("BADGE") and not pack.remove("BADGE") and pack.labels() == ["DESK"] and "DEA_NUMBER" in detect.CustomPack().labels()


def test_privacy(spark):
    got = [one(spark, masking.private(v, label, eps, "'s'")) for v, label, eps in (("'5'", "'AGE'", "0.1D"), ("'5'", "'X'", "0.0D"), ("'45'", "'X'", "0.1D"))]
    assert float(got[0]) >= 0 and got[1] == "<X>" and float(got[2]) != 45
    shown = spark.range(2000).select(F.expr(masking.private("'word'", "'X'", "0.1D", "id")).alias("v"))
    assert {r.v for r in shown.distinct().collect()} == {"<X>"}


def test_audit(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01T10:00:00", "u", "DATA_REDACTION"), ("2024-02-01T10:00:00", "v", "API_ACCESS")], "timestamp string, user_id string, event_type string")
    audit.append_log(events, path := str(tmp_path / "log"))
    assert [r.user_id for r in audit.query_log(spark, path, start="2024-01-15T00:00:00").collect()] == ["v"]
    assert audit.query_log(spark, path, event_type="DATA_REDACTION").count() == 1
    assert audit.query_log(spark, path).where(audit.expired(audit.query_log(spark, path), 10, F.lit("2024-02-05").cast("date"))).count() == 1
    asked = spark.createDataFrame([(["PATIENT_ID"], "", True, "", False, False, False, False), (["CREDIT_CARD"], "contract", True, "care", True, True, True, True)],
        "entity_types array<string>, lawful_basis string, consent_obtained boolean, processing_purpose string, authorized_user boolean, minimum_necessary_justified boolean, secure_environment boolean, access_controls_verified boolean")
    got = audit.validated(asked).collect()
    assert not got[0].compliant and len(got[0].violations) == 2 and got[1].compliant


def test_overlay_files(tmp_path):
    (tmp_path / "acme.yml").write_text("regex_patterns:\n  BADGE: 'B\\d+'\n")
    assert documents.overlay_files(str(tmp_path), "acme") == {"regex_patterns": {"BADGE": r"B\d+"}} and documents.overlay_files(str(tmp_path), "none") == {}


def test_state_on_streams(spark, tmp_path):
    from veilspan.streaming import state

    spark.createDataFrame([(u, k) for k in range(25) for u in ("a", "b")][:40], "u string, k int").write.parquet(str(tmp_path / "in"))
    for name, made in (("budget", lambda s: state.budgeted(s, "u", "k", 1.0, 0.1)), ("shown", lambda s: state.shown(s.withColumn("kind", F.lit("T")), "u", "kind", "k", 5))):
        rows = made(spark.readStream.schema("u string, k int").parquet(str(tmp_path / "in")))
        rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start().awaitTermination()
    left = spark.read.parquet(str(tmp_path / "budget")).where("u = 'a'").orderBy("k").collect()
    assert [r.epsilon for r in left] == [0.1] * 10 + [0.0] * 10
    out = spark.read.parquet(str(tmp_path / "shown")).where("u = 'a'").orderBy("k").collect()
    assert [r.shown for r in out] == ["<T>"] * 4 + ["a"] * 16


def test_hand_written_cases(spark):
    """Each case has the result that was written down for it."""
    from veilspan.plans import catalog, catalog_cases  # noqa: F401 - it registers its own

    duck = pytest.importorskip("duckdb")
    customer = "/root/testdata/sf0.001/customer.parquet"
    con = duck.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{customer}'")
    for name in [n for n in catalog.QUERIES if n.startswith("cases_")]:
        got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.execute(catalog.SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall()), name
