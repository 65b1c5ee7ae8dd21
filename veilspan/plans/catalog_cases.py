"""Queries over cases with results written by hand: each row of ``customer`` takes one, and the SQL knows nothing but the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.spans import quoted
from ..operators import detect, metrics, refine
from . import pipeline
from .catalog import _q, query, spread


def _cases(spark, d, columns: dict[str, list[str]]):
    """(c_custkey, *columns): the SQL literals of the row's case."""
    n = len(next(iter(columns.values())))
    at = f"CAST(c_custkey % {n} AS INT)"
    return spread(spark, d, "customer", "c_custkey").select("c_custkey", *(F.expr(f"array({', '.join(values)})[{at}]").alias(name) for name, values in columns.items()))


def _expected(name: str, values: list[str]) -> str:
    return f"SELECT c_custkey, ([{', '.join(values)}])[c_custkey % {len(values)} + 1] AS {name} FROM customer"


def _span(text: str, value: str, label: str, score: float) -> str:
    start = text.index(value)
    return S.make(str(start), str(start + len(value)), quoted(label), f"{score}D", "'regex'", "0")


def _text(s: str) -> str:
    """A SQL literal for the other engine; a line feed is written as chr(10)."""
    return " || chr(10) || ".join(map(_q, s.split("\n")))


#: Text, value, label and score of a span, and whether it is kept.
GARBAGE = [
    ("Mr John Smith came", "John Smith", "PERSON", 0.9, True), ("the file name is", "file name", "PERSON", 0.9, False), ("send to Email now", "Email", "PERSON_NAME", 0.9, False),
    ("saw john smith there", "john smith", "PERSON", 0.9, False), ("John Smith", "John Smith", "PERSON", 0.5, False), ("it is of use", "of", "ORG", 0.9, False),
    ("code -- here", "--", "ID", 0.9, False), ("see A. there", "A.", "PERSON", 0.9, True), ("unit 42 here", "42", "ID", 0.9, True), ("unit xy here", "xy", "ID", 0.9, False),
    ("in TX now", "TX", "STATE", 0.9, True), ("123456789", "3456", "ID", 0.9, False), ("take metformin daily", "metformin", "PERSON", 0.2, True), ("dose 50 mg now", "50 mg", "PERSON", 0.1, True),
    ("pain was diagnosed as", "diagnosed", "PERSON", 0.95, False), ("has fever", "fever", "SYMPTOM", 0.1, True), ("x the\n y", "the\n", "ORG", 0.9, False), ("____ sign", "____", "ID", 0.9, False),
    ("postcode 3000 ok", "3000", "POSTCODE_AU", 0.9, True), ("id-3000-5", "3000", "POSTCODE_AU", 0.9, True), ("to paris office", "paris office", "location", 0.9, False), ("Zoë Müller", "Zoë Müller", "PERSON", 0.8, True),
]


@query("cases_garbage", _expected("kept", [str(c[-1]).lower() for c in GARBAGE]))
def cases_garbage(spark, d):
    df = _cases(spark, d, {"text": [quoted(c[0]) for c in GARBAGE], "s": [f"array({_span(*c[:4])})" for c in GARBAGE]})
    return df.select("c_custkey", F.expr(f"size({refine.clean('text', 's')}) = 1").alias("kept"))


#: Text, value, label and score of its first span, and where spans start after propagation.
PLACES = [
    ("Ann Lee met Ann Lee.", "Ann Lee", "PERSON", 0.95, "0,12"), ("Ann Lee met Annie; Ann Leeson.", "Ann Lee", "PERSON", 0.95, "0"), ("Ann met Ann", "Ann", "PERSON", 0.95, "0"),
    ("John came. JOHN left. John?", "John", "PERSON", 0.95, "0,22"), ("John came. John left.", "John", "PERSON", 0.5, "0"), ("a@b.org, xa@b.org, a@b.org", "a@b.org", "EMAIL", 0.95, "0,19"),
    ("#12345# and #12345#x", "#12345#", "ID", 0.95, "0,12"), ("no, Zoë! 😀 Zoë! Zoë!", "Zoë!", "PERSON", 1.0, "4,11,16"), (r"\Eab.c\E aabxc \Eab.c\E", r"\Eab.c\E", "ID", 1.0, "0,15"),
]


@query("cases_propagation", _expected("starts", [_q(c[-1]) for c in PLACES]))
def cases_propagation(spark, d):
    df = _cases(spark, d, {"text": [quoted(c[0]) for c in PLACES], "s": [f"array({_span(*c[:4])})" for c in PLACES]})
    df = df.withColumn("s", F.expr(refine.propagated("text", "s")))
    return df.select("c_custkey", F.expr("array_join(transform(array_sort(transform(s, x -> x.start)), x -> CAST(x AS STRING)), ',')").alias("starts"))


#: Token and class.
TOKENS = [
    ("ann@example.org", "EMAIL"), ("123-45-6789", "SSN"), ("123456789", "SSN"), ("4111 1111 1111 1111", "CREDIT_CARD"), ("(02) 9876 5432", "PHONE"), ("1/2/24", "DATE"), ("12:30 pm", "TIME"), ("10.1.2.3", "IP_ADDRESS"),
    ("123e4567-e89b-12d3-a456-426614174000", "UUID"), ("A1B2C3D4E5F6G7H8", "IDENTIFIER"), ("Katherine", "PERSON_NAME"), ("739182", "NUMERIC_ID"), ("123456", "none"), ("hello", "none"), ("aaaaaaa1111112", "none"),
]


@query("cases_tokens", _expected("class", [_q(c) for _, c in TOKENS]))
def cases_tokens(spark, d):
    df = _cases(spark, d, {"token": [quoted(t) for t, _ in TOKENS]})
    return df.select("c_custkey", F.expr(f"coalesce(({detect.token_class('token')}).label, 'none')").alias("class"))


#: Text, labels of its spans, and domain.
DOMAINS = [
    ("patient admitted with blood pressure", "", "general"), ("hello", "DRUG EMAIL", "medical"), ("patient admitted with high blood pressure", "EMAIL EMAIL", "medical"),
    ("Pursuant to section 12, the court finds", "EMAIL", "legal"), ("hello", "EMAIL", "general"), ("hello", "JUDGE", "legal"), ("hello", "DRUG EMAIL EMAIL EMAIL EMAIL EMAIL EMAIL", "general"), ("hello", "JUDGE DRUG", "medical"),
]


@query("cases_domains", _expected("domain", [_q(c[-1]) for c in DOMAINS]))
def cases_domains(spark, d):
    spans = [f"array({', '.join(S.make('0', '1', quoted(x), '1.0D', quoted('regex'), '0') for x in c[1].split())})" if c[1] else S.EMPTY for c in DOMAINS]
    df = _cases(spark, d, {"text": [quoted(c[0]) for c in DOMAINS], "s": spans})
    return df.select("c_custkey", F.expr(detect.domain("text", "s")).alias("domain"))


@query("cases_overlaps", "SELECT c_custkey AS doc_id, c_custkey % 12 AS p_start, round((10 - c_custkey % 12)::DOUBLE / (10 + c_custkey % 12), 9) AS iou FROM customer WHERE c_custkey % 12 <= 3")
def cases_overlaps(spark, d):
    """Spans of ten characters, up to eleven apart: those up to three apart share half of what they cover."""
    df = spread(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 12).cast("int").alias("at"))
    gold = df.select("doc_id", F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit("ID").alias("label"))
    found = metrics.overlaps(gold, df.select("doc_id", F.col("at").alias("start"), (F.col("at") + 10).alias("end"), F.lit("ID").alias("label")), 0.5)
    return found.select("doc_id", F.col("p_start").cast("long").alias("p_start"), F.round("iou", 9).alias("iou"))


#: Text, and how the US policy writes it with labels in place of values.
REDACTED = [
    ("SSN 123-45-6789, on file.", "SSN <SSN>, on file."), ("SSN 123-45-6789 on file.", "SSN <MEDICARE_US> file."), ("Write to ann.lee@example.org today.", "Write to <EMAIL> today."), ("nothing to see", "nothing to see"), ("", ""),
    ("Zoë wrote to zoe@example.org; zoe@example.org wrote back.", "Zoë wrote to <EMAIL>; <EMAIL> wrote back."), ("from 192.168.10.20 at night", "from <IP_ADDRESS> at night"),
]


@query("cases_redaction", _expected("redacted_text", [_text(c[1]) for c in REDACTED]))
def cases_redaction(spark, d):
    df = _cases(spark, d, {"text": [quoted(c[0]) for c in REDACTED]})
    return pipeline.redact(df, pipeline.Config(country="US", masking_style="replace")).select("c_custkey", "redacted_text")
