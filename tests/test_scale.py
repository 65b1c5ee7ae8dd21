"""What must not grow with a table: rows of a task, work a match, what is broadcast."""

import regex
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import detect, refine
from veilspan.plans import catalog, catalog_cases, catalog_eval  # noqa: F401 - they register their own
from veilspan.sources.policies import FLAGS, POLICIES, Rule


def _customers(spark, at, n=100):
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name")).coalesce(1).write.parquet(f"{at}/customer.parquet")
    return str(at)


def _most_rows(df):
    return max(len(p) for p in df.rdd.glom().collect())


def test_planted_texts_are_made_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    d = _customers(spark, tmp_path)
    monkeypatch.setattr(catalog, "ROWS", 10)
    df = catalog.spread(spark, d, "customer", "c_custkey")
    assert df.rdd.getNumPartitions() == 10 and _most_rows(df) < 30 and df.count() == 100
    assert ", 10)" in _exchanges(catalog.QUERIES["planted_au"](spark, d))


def _exchanges(df):
    return "\n".join(line.split(", REPARTITION")[0] + ")" for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(c_custkey" in line)


def test_offsets_of_texts_with_the_mark_and_of_empty_matches(spark):
    texts = ["a\x01b 12 \x01\x02 345\x01", "12", "\x01", "", "x12\x01\x0177", "é\x01😀 9"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for p in (r"\d+", r"[^a]\d", r"\W+", r"\d*", r"\x01", "\x01.", r"\bx|\x02"):
        got = {r["k"]: [tuple(x) for x in r["s"]] for r in df.select("k", F.expr(S.ranges("text", FLAGS + p)).alias("s")).collect()}
        rules = {r["k"]: [(x["start"], x["end"]) for x in r["s"]] for r in df.select("k", F.expr(detect.by_rules("text", [Rule("A", p)])).alias("s")).collect()}
        for k, t in enumerate(texts):
            if p == r"\d*" and "😀" in t:  # Java has an empty match within a pair of surrogates too
                continue
            assert got[k] == rules[k] == [m.span() for m in regex.finditer(p, t, regex.I | regex.M)], (p, t)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_made_of_customers_are_not_broadcast_nor_moved_again(spark, tmp_path, monkeypatch):
    d = _customers(spark, tmp_path, 200)
    monkeypatch.setattr(catalog, "ROWS", 10)
    for name in ("iou_pairs", "unique_spans", "calibrate_f1_squared", "score_history", "tracker_metrics", "consensus_adaptive", "platt_params"):
        plan = _plan(catalog.QUERIES[name](spark, d))
        assert "BroadcastHashJoin" not in plan or name == "platt_params", name
        assert "Exchange hashpartitioning(doc_id" not in plan and "Exchange hashpartitioning(c_custkey" in plan, name
    assert _most_rows(catalog_eval.predicted(spark, d)) < 30 * 18


def test_every_case_is_made_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    d = _customers(spark, tmp_path)
    monkeypatch.setattr(catalog, "ROWS", 10)
    assert all(", 10)" in _exchanges(catalog.QUERIES[name](spark, d)) for name in ("cases_redaction", "cases_garbage", "cases_tokens", "styles_mask"))


def test_spans_with_nulls_meet_nothing_and_predictions_are_kept_apart(spark):
    from veilspan.operators import evaluate

    gold = spark.createDataFrame([(1, 0, 5, "A"), (1, 0, 5, "A"), (2, None, 5, "A"), (3, 1, 2, "B")], "doc_id long, start int, end int, label string")
    pred = spark.createDataFrame([("x", 1, 0, 5, "A", 0.5), ("x", 1, 0, 5, "A", 0.7), ("x", 2, None, 5, "A", 0.1), ("y", 4, 0, 1, "A", 0.2)], "detector string, doc_id long, start int, end int, label string, score double")
    counts = {r["detector"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.calibrated_weights(gold, pred).collect()}
    assert counts == {"x": (1, 1, 2), "y": (0, 1, 3), None: (1, 2, 5)}
    assert sorted((r["score"], r["correct"]) for r in evaluate.scored(gold, pred).collect()) == [(0.1, 0), (0.2, 0), (0.5, 1), (0.7, 1)]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_rare_words_are_met_by_the_few_frequent_ones(spark):
    texts = ["Common common word é_1 rare, RARE zoë 42", "common " * 300 + "lone", None, "", "the of and up"]
    df = _docs(spark, texts)
    rows = detect.rare_terms(df).collect()
    assert all(texts[r["doc_id"]][r["start"] : r["end"]].lower() == r["term"] for r in rows)
    assert sorted((r["doc_id"], r["term"]) for r in rows) == sorted((r["doc_id"], r["term"]) for r in detect.rare_words(df).collect())
    assert sorted(r["term"] for r in rows) == ["lone", "rare", "rare", "word", "zoë", "é_1"]
    assert "BroadcastHashJoin" in _plan(catalog.QUERIES["rare_terms"](spark, "/root/testdata/sf0.001"))


def test_counts_are_those_of_the_spans(spark):
    texts = ["Mr John Smith, Acme Pty Ltd, North Ryde NSW 2113; 123 456 782 and 123 456 789", "062-000 51824753556 \x01 51824753557", "no Co", "", None, "Ann Lee " * 40]
    df = _docs(spark, texts)
    for country in POLICIES:
        spans = {(r["doc_id"], r["label"]): r["count"] for r in df.select("doc_id", F.explode(F.expr(detect.regex("text", POLICIES[country]))).alias("s")).groupBy("doc_id", "s.label").count().collect()}
        assert spans == {(r["doc_id"], r["label"]): r["n"] for r in df.select("doc_id", F.inline(F.expr(detect.counts("text", POLICIES[country])))).collect()}


def test_garbage_in_long_texts_is_judged_by_what_lies_around(spark):
    text = "é😀 " + " ".join(f"Ann{'x' * (k % 7)} Leeé{k}" for k in range(900)) + " " + "B" * 3000 + " end"
    words = [(m.start(), m.end() - (k % 3 == 0)) for k, m in enumerate(regex.finditer(r"\S+", text))]
    df = _docs(spark, [text]).withColumn("s", F.array(*(F.expr(S.make(str(a), str(b), "'ID'", "0.9D", "'regex'", "0")) for a, b in words)))
    kept = {(x["start"], x["end"]) for x in df.select(F.expr(refine.clean("text", "s")).alias("s")).first()["s"]}
    assert kept == {(a, b) for a, b in words if b - a > 2 and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())} - {(0, 1), (0, 2)}
    each = df.select(F.expr(S.around("text", "s", lambda near: f"transform(s, z -> {near('z', 1, 2)})")).alias("v")).first()["v"]
    assert each == [text[max(0, a - 1) : b + 2] for a, b in words]


def test_files_are_taken_a_few_at_a_time(spark):
    from veilspan.plans import service

    rows = [(str(k), None if k == 7 else f"mail a{k}@b.org é".encode(), "image/png" if k == 9 else "text/plain") for k in range(150)]
    out = service.processed_files(spark.createDataFrame(rows, "path string, content binary, content_type string").coalesce(1))
    assert "MapInPandas" not in _plan(out) and "MapInArrow" in _plan(out)
    got = {r["path"]: r for r in out.collect()}
    assert len(got) == 150 and {k for k, r in got.items() if not r["success"]} == {"7", "9"} and got["9"]["error"] == "unsupported type: image/png"
    assert all(b"@b.org" not in r["redacted_content"] and r["original_size"] == len(rows[int(k)][1]) for k, r in got.items() if r["success"])
    assert [p.num_rows for p in service._parts([out.limit(1).toArrow().to_batches()[0], *spark.range(150).coalesce(1).toArrow().to_batches()])] == [1, 64, 64, 22]
