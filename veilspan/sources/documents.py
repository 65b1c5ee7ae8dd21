"""Files as documents, and redacted text put back."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import var

TYPES = {"text/plain": "text", "text/csv": "csv", "application/csv": "csv", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx"}


def is_supported(mime: str) -> bool:
    return mime in TYPES


def _plain(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def text_of(content: bytes, mime: str) -> str:
    """The text of a file by its type; an unknown type or a broken file is an error."""
    kind = TYPES.get(mime)
    if kind is None:
        raise ValueError(f"unsupported type: {mime}")
    if kind == "csv":
        return csv_text(content.decode("utf-8"))
    if kind == "docx":
        text = _docx(content)
        if text is None:
            raise ValueError("not a DOCX file")
        return text
    return _plain(content)


def _put(text: str, replacements: list[tuple[str, str]]) -> str:
    for value, tag in replacements:
        text = text.replace(value, tag)
    return text


def rebuilt(content: bytes, mime: str, replacements: list[tuple[str, str]]) -> bytes:
    """The file with every occurrence of each value replaced, in order, its form kept: cells of a CSV stay cells, the text
    runs of a DOCX keep their style (a value that several runs share becomes the first one's)."""
    kind = TYPES.get(mime)
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([_put(c, replacements) for c in row] for row in csv.reader(io.StringIO(content.decode("utf-8"))))
        return out.getvalue().encode()
    if kind == "docx":
        old, new = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
        with zipfile.ZipFile(new, "w", zipfile.ZIP_DEFLATED) as z:
            for item in old.infolist():
                data = old.read(item)
                z.writestr(item, _put_docx(data.decode("utf-8"), replacements).encode() if item.filename == "word/document.xml" else data)
        return new.getvalue()
    return _put(_plain(content), replacements).encode()


_RUN = re.compile(r"(<w:t(?: [^>]*)?>)([^<]*)(</w:t>)")


def _put_docx(xml: str, replacements: list[tuple[str, str]]) -> str:
    def paragraph(m: re.Match) -> str:
        p = m[0]
        whole = html.unescape("".join(t for _, t, _ in _RUN.findall(p)))
        new = _put(whole, replacements)
        if new == whole:
            return p
        first = iter([True])
        return _RUN.sub(lambda r: r[1] + (html.escape(new, quote=False) if next(first, False) else "") + r[3], p)

    return re.sub(r"<w:p[ >].*?</w:p>", paragraph, xml, flags=re.S)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): UTF-8, or Latin-1 where it is not."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.coalesce(F.expr("try_validate_utf8(CAST(content AS STRING))"), F.decode("content", "ISO-8859-1")).alias("text"))


def csv_text(content: str) -> str:
    """Comma-separated lines as text: the header after its name, a rule, then the cells of each row with bars between."""
    rows = list(csv.reader(io.StringIO(content)))
    shown = [" | ".join(r) + "\n" for r in rows]
    return "".join(["Headers: " + shown[0], "-" * 50 + "\n", *shown[1:]]) if shown else ""


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of CSV files, quoted cells kept whole."""

    @F.pandas_udf("string")
    def texts(content: pd.Series) -> pd.Series:
        return content.map(csv_text)

    return text_files(spark, path).select("path", texts("text").alias("text"))


def _docx(content: bytes) -> str | None:
    try:
        xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8")
    except (zipfile.BadZipFile, KeyError):
        return None
    body, out = re.split(r"(<w:tbl>.*?</w:tbl>)", xml, flags=re.S), []
    words = lambda x: "".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", x))
    for part in body:
        if part.startswith("<w:tbl>"):
            out += [" | ".join(words(c) for c in re.findall(r"<w:tc>.*?</w:tc>", row, re.S)) for row in re.findall(r"<w:tr[ >].*?</w:tr>", part, re.S)]
        else:
            out += [t for p in re.findall(r"<w:p[ >].*?</w:p>", part, re.S) if (t := words(p))]
    return "\n".join(out)


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): paragraphs and table rows, by an Arrow batch a call."""
    @F.pandas_udf("string")
    def texts(content: pd.Series) -> pd.Series:
        return content.map(_docx)

    return spark.read.format("binaryFile").load(path).select("path", texts("content").alias("text"))


def json_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("id string, country string, company string, use_openmed boolean, masking_style string, text string, notes string").json(path)


def replaced(text: str, spans: str) -> str:
    """``text`` with every occurrence of each span's value as <LABEL>, in order of first appearance; of several labels the last counts."""
    s, k, a, x, m, y = (var(c) for c in "skaxmy")
    value = lambda z: f"substring({text}, {z}.start + 1, {z}.end - {z}.start)"
    keys = f"array_distinct(transform({spans}, {s} -> {value(s)}))"
    label = f"element_at(filter({spans}, {y} -> {value(y)} = {k}), -1).label"
    return f"aggregate(transform({keys}, {k} -> struct({k} AS k, {label} AS l)), {text}, ({a}, {x}) -> replace({a}, {x}.k, concat('<', {x}.l, '>')))"


def annotated_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Gold spans (doc_id, start, end, label) of a corpus of documents with mentions by annotator; only those that identify."""
    mention = "struct<start_offset:int,end_offset:int,entity_type:string,identifier_type:string>"
    docs = spark.read.option("multiLine", True).schema(f"doc_id string, text string, annotations map<string, struct<entity_mentions:array<{mention}>>>").json(path)
    each = docs.select("doc_id", F.explode(F.map_values("annotations")).alias("a")).select("doc_id", F.explode("a.entity_mentions").alias("m"))
    return each.where(F.col("m.identifier_type").isin("DIRECT", "QUASI")).select("doc_id", F.col("m.start_offset").alias("start"), F.col("m.end_offset").alias("end"), F.coalesce("m.entity_type", F.lit("PHI")).alias("label")).distinct()


def dictionary_spans(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurrence, overlapping ones too, of a file's terms in its pages: (doc_id, start, end, label PHI)."""
    i = var("i")
    at = f"filter(sequence(0, greatest(length(text) - length(term), 0)), {i} -> substring(text, {i} + 1, length(term)) = term)"
    both = pages.join(terms.where("length(term) > 0").distinct(), "file")
    return both.select("doc_id", "term", F.explode(F.expr(at)).alias("start")).select("doc_id", "start", (F.col("start") + F.length("term")).alias("end"), F.lit("PHI").alias("label")).distinct()


def overlay_files(folder: str, company: str) -> dict:
    """A company's overlay from ``folder``/company.yml or .yaml; nothing where there is none."""
    for end in ("yml", "yaml"):
        path = Path(folder) / f"{company}.{end}"
        if path.is_file():
            return overlay_of(path.read_text(encoding="utf-8"))
    return {}


def overlay_of(text: str) -> dict:
    """A company overlay from YAML text."""
    import yaml

    return yaml.safe_load(text) or {}
