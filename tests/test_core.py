"""Detectors, resolution, refinement, masks and metrics on small fixtures."""

import random

import regex
from pyspark.sql import functions as F

from veilspan.functions import masking, validators
from veilspan.functions import spans as S
from veilspan.operators import audit, detect, metrics, refine, reports, resolve
from veilspan.plans import pipeline as P
from veilspan.sources import documents
from veilspan.sources.policies import POLICIES, US, Rule, load

TEXTS = [
    "Call (212) 555-1234 or a.b@c.org; SSN 123-45-6789 é 😀 4111 1111 1111 1111. Again a.b@c.org.", "", None, "nothing here", "MRN: ABC12345 token = \"abcdef0123456789abcdef\" 10.1.2.3",
    "x" * 3000 + " 1.2.3.4 " + "é" * 3000 + " 5.6.7.8", " ".join(f"{k}.1.1.{k % 255}" for k in range(1, 400)),
]


def _df(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _spans(spark, sql, texts=TEXTS):
    rows = _df(spark, texts).select("doc_id", F.expr(sql).alias("s")).collect()
    return {r["doc_id"]: [tuple(x) for x in r["s"] or []] for r in rows}


def test_offsets_match_a_plain_matcher(spark):
    got = _spans(spark, detect.regex("text", US))
    for k, t in enumerate(TEXTS):
        want = {(m.start(), m.end(), r.label) for r in US.rules for m in regex.finditer(str(r.pattern), t or "", regex.I | regex.M)}
        assert {(a, b, label) for a, b, label, *_ in got[k]} == want


def test_all_policies_compile_and_gates_lose_nothing(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("Ab1 -:/.@9ſKé") for _ in range(80)) for _ in range(60)] + ["www.a.bc ſ", "MEDICAL RECORD: ABCDEFG", "medicaid id ABCDEFGHI"]
    for p in POLICIES.values():
        got = _spans(spark, detect.by_rules("text", list(p.rules)), texts)
        for k, t in enumerate(texts):
            want = {(m.start(), m.end(), r.label) for r in p.rules for m in regex.finditer(str(r.pattern), t, regex.I | regex.M)}
            assert {(a, b, label) for a, b, label, *_ in got[k]} == want, (p.country, t)


def test_custom_patterns_overlay_and_pack(spark):
    over = load("US", {"regex_patterns": {"EMPLOYEE_ID": r"\bEMP-?\d{6}\b"}, "actions": {"EMPLOYEE_ID": "replace"}})
    got = _spans(spark, detect.regex("text", over, {"SSN": [r"\bS\d{3}\b"]}), ["EMP-123456 S123"])
    assert {x[2] for x in got[0]} >= {"EMPLOYEE_ID", "SSN"} and over.action("EMPLOYEE_ID") == "replace" and over.action("nope") == "hash"
    pack = _spans(spark, detect.custom("text"), ["MRN: ABC12345 and DEA AB1234567"])
    assert {(x[2], x[3]) for x in pack[0]} >= {("MEDICAL_RECORD_NUMBER", 0.9), ("DEA_NUMBER", 0.9)}
    kept = _spans(spark, detect.custom("text", validators_={"MEDICAL_RECORD_NUMBER": {"min_length": 9}}), ["MRN: ABC12345"])
    assert not kept[0]


def test_check_digits(spark):
    cases = {
        "TFN": ("123456782 876543210 123-456-782 123.456.782", "123456789 111111111 12"), "ABN": ("51824753556 53004085616 51-824-753-556", "51824753557 11111111111"),
        "ACN": ("000-000-019 000000019", "000000018 111111111"), "MEDICARE": ("26880012391", "16880012391 76880012391 2688001239"), "BSB": ("062-000", "06200"), "CENTRELINK_CRN": ("123456789A 987654321z", "12345678A 123456789 A123456789"),
    }
    for label, (good, bad) in cases.items():
        for value, want in [(v, True) for v in good.split()] + [(v, False) for v in bad.split()]:
            assert spark.sql(f"SELECT {validators.CHECKS[label](S.quoted(value))} AS ok").first()["ok"] is want, (label, value)
    assert spark.sql(f"SELECT {validators.valid(S.quoted('OTHER'), S.quoted('x'))} AS ok").first()["ok"]


def _made(spans):
    return "array(" + ", ".join(S.make(str(a), str(b), S.quoted(label), f"{score}D", S.quoted(source), str(k)) for k, (a, b, label, score, source) in enumerate(spans)) + ")"


def test_resolution_forms_agree(spark):
    rnd = random.Random(2)
    rows = []
    for doc in range(40):
        for k in range(rnd.randrange(0, 25)):
            a = rnd.randrange(0, 120)
            rows.append((doc, a, a + rnd.randrange(1, 14), rnd.choice(["SSN", "PERSON", "PER", "DRUG", "DATE"]), rnd.choice([0.5, 0.9, 1.0]), rnd.choice(["regex", "spacy", "bert", "other"]), k))
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, label string, score double, source string, ord int")
    arrays = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "score", "source", "ord")).alias("s"))
    for model in ("adaptive", "standard"):
        a = {tuple(r) for r in resolve.resolved(df, model).select("doc_id", "start", "end", "label", "ord").collect()}
        b = {tuple(r) for r in arrays.select("doc_id", F.explode(F.expr(resolve.winners("s", model))).alias("x")).select("doc_id", "x.start", "x.end", "x.label", "x.ord").collect()}
        assert a == b
        for doc in {x[0] for x in a}:
            own = sorted(x[1:3] for x in a if x[0] == doc)
            assert all(p[1] <= q[0] for p, q in zip(own, own[1:]))


def test_vote_memory_and_allow_list(spark):
    won = spark.sql(f"SELECT {resolve.winners(_made([(13, 21, 'PHONE', 1.0, 'regex'), (13, 21, 'ID', 0.9, 'ml')]), 'standard')} AS s").first()["s"]
    assert [(x["label"], x["source"]) for x in won] == [("PHONE", "regex")]
    text = "Hi, Alice went. Then Alice came; Alices not."
    more = spark.sql(f"SELECT {refine.propagated(S.quoted(text), _made([(4, 9, 'PERSON', 0.95, 'spacy')]))} AS s").first()["s"]
    assert [(x["start"], x["end"], x["source"]) for x in more] == [(4, 9, "spacy"), (21, 26, "context_memory")]
    none = spark.sql(f"SELECT {refine.allowed(S.quoted(text), _made([(4, 9, 'PERSON', 0.95, 'spacy')]), ['ALICE'])} AS s").first()["s"]
    assert none == []


def test_garbage(spark):
    keep = lambda v, label, score=1.0, before="", after="": spark.sql(f"SELECT {refine.keep(S.quoted(v), S.quoted(label), f'{score}D', S.quoted(before), S.quoted(after))} AS k").first()["k"]
    assert keep("amoxicillin", "PERSON") and keep("5 mg", "X") and not keep("  ", "X") and keep("12", "X") and not keep("ab", "X") and keep("ab", "AGE")
    assert not keep("--- .", "X") and not keep("The", "X") and not keep("Test Data", "PERSON_NAME") and not keep("John Doe", "PERSON", 0.6) and not keep("john Doe", "PERSON")
    assert not keep("ing", "X", before="k") and not keep("ing", "X", after="s") and keep("2000", "POSTCODE_AU", before=" ")


def test_redaction_keeps_the_rest(spark):
    for style in masking.STYLES:
        for r in P.redact(_df(spark), P.Config(masking_style=style)).collect():
            if r["text"] is None:
                assert r["redacted_text"] is None
                continue
            at, parts = 0, []
            for s in r["spans"]:
                assert s["start"] >= at
                parts.append(r["text"][at : s["start"]])
                at = s["end"]
            left = r["redacted_text"]
            for part in [*parts, r["text"][at:]]:
                assert part in left
                left = left[left.index(part) + len(part) :]
            assert "123-45-6789" not in r["redacted_text"]


def test_batch_table_and_scan(spark):
    import pandas as pd

    out = P.redact_batch(spark, ["SSN 123-45-6789", None, "plain"], P.Config(masking_style="brackets"))
    assert [x["text"] for x in out] == ["SSN [SSN]", None, "plain"]
    assert P.scan_batch(spark, ["a@b.org c@d.org"])[0]["entity_counts"] == {"EMAIL": 2}
    frame = P.redact_pandas(spark, pd.DataFrame({"n": [1, 2], "t": ["a@b.org", "none"]}), P.Config(masking_style="replace"))
    assert frame.t.tolist() == ["<EMAIL>", "none"] and frame.n.tolist() == [1, 2]
    auto = P.scan_batch(spark, ["the patient presents with blood pressure 120 mg 123-45-6789"], P.Config(mode="auto"))
    assert auto[0]["has_pii"]


def test_reports_and_documents(spark, tmp_path):
    scans = P.scan_report(_df(spark, ["mail a@b.org <x>"]))
    for fmt in ("json", "md", "txt", "html", "csv"):
        assert "a@b.org" in reports.report(scans, fmt).first()["report"]
    (tmp_path / "a.txt").write_bytes("café a@b.org".encode("latin-1"))
    assert documents.text_files(spark, str(tmp_path)).first()["text"] == "café a@b.org"
    put = _df(spark, ["a@b.org and a@b.org"]).select(F.expr(S.let(detect.by_rules("text", [Rule("EMAIL", r"a@b\.org")]), lambda s: documents.replaced("text", s))).alias("t")).first()["t"]
    assert put == "<EMAIL> and <EMAIL>"


def test_metrics(spark):
    cols = "doc_id long, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 10, "A"), (1, 20, 30, "A"), (2, 0, 5, "B")], cols)
    pred = spark.createDataFrame([(1, 0, 10, "A"), (1, 21, 30, "A"), (2, 7, 9, "B")], cols)
    m = metrics.exact(gold, pred).first()
    assert (m["tp"], m["fp"], m["fn"]) == (1, 2, 2)
    p = metrics.partial(gold, pred).first()
    assert (p["tp"], p["fp"], p["fn"]) == (2, 1, 1) and abs(p["mean_iou"] - 0.95) < 1e-9


def test_strategies_and_trust(spark):
    key = "'0123456789abcdef'"
    sealed = masking.strategy_encrypt("'secret'", key, "mail")
    assert spark.sql(f"SELECT {masking.strategy_decrypt(sealed, key, 'mail')} AS v").first()["v"] == "secret"
    assert spark.sql(f"SELECT try_aes_decrypt(unbase64(substring({sealed}, 5)), {key}, 'GCM', 'DEFAULT', 'phone') AS v").first()["v"] is None
    assert spark.sql(f"SELECT {masking.same_classes(S.quoted('Ab-12'), S.quoted('X'))} AS v").first()["v"][2] == "-"
    assert spark.sql(f"SELECT {masking.generalised(S.quoted('45'), S.quoted('AGE'))} AS v").first()["v"] == "30-50"
    r = spark.createDataFrame([(["SSN"], 1)], "types array<string>, n int").select(audit.risk(F.col("n"), F.col("types")).alias("r")).first()
    assert r["r"] == "HIGH"


def test_stream_equals_batch(spark, tmp_path):
    from veilspan.streaming import redact as stream

    _df(spark).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    stream.start(rows, str(tmp_path / "out"), str(tmp_path / "ck"), interval=None).awaitTermination()
    got = {(r["doc_id"], r["redacted_text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["doc_id"], r["redacted_text"]) for r in P.redact(_df(spark)).collect()}
