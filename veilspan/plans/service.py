"""Files in, redacted files out, with what a service says of each; and what it refuses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.spans import var
from ..sources import documents
from .pipeline import Config, redact

COUNTRIES = ("AU", "US", "EU", "UK", "CA")
STYLES = ("hash", "mask", "synthetic", "encrypt", "brackets", "replace")
CLASSES = ("PUBLIC", "INTERNAL", "SENSITIVE", "RESTRICTED")
#: Most characters of a request's text, texts of a batch, and characters of each of these.
MOST_CHARS, MOST_TEXTS, MOST_CHARS_EACH = 100_000, 1000, 10_000

#: Files that are held as Python's own objects at once.
PART = 64


def check_request(country: str = "US", masking_style: str = "hash", data_class: str = "SENSITIVE", text: str | None = None, texts: list[str] | None = None) -> None:
    """A ValueError for a request that the service does not take."""
    for what, value, known in (("country", country.upper(), COUNTRIES), ("style", masking_style, STYLES), ("data class", data_class, CLASSES)):
        if value not in known:
            raise ValueError(f"no such {what}: {value}")
    if text is not None and len(text) > MOST_CHARS:
        raise ValueError(f"text of over {MOST_CHARS} characters")
    if texts is not None and (len(texts) > MOST_TEXTS or any(len(t) > MOST_CHARS_EACH for t in texts)):
        raise ValueError(f"over {MOST_TEXTS} texts, or one of over {MOST_CHARS_EACH} characters")


def replacement_map(text: str = "text", spans: str = "spans") -> str:
    """map<string,string>: each value that a span has, to the tag of its last label."""
    s, k, y = var("s"), var("k"), var("y")
    keys = f"array_distinct(transform({spans}, {s} -> {S.value_of(text, s)}))"
    tag = f"concat('<', element_at(filter({spans}, {y} -> {S.value_of(text, y)} = {k}), -1).label, '>')"
    return S.let(keys, lambda ks: f"map_from_arrays({ks}, transform({ks}, {k} -> {tag}))")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _with(part: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])


def processed_files(files: DataFrame, config: Config = Config(), keep_form: bool = True) -> DataFrame:  # noqa: B008
    """(path, success, error, output_format, entities_found, original_size, redacted_size, extracted_text_length,
    redacted_text_length, redacted_content) of files with path, content and content_type. What can't be read is an error in
    its row; where a file's form can't be kept, its plain text is given."""

    # nodes of their own in the plan: a Python function that a rule moves into a lambda can't be run

    # Arrow's rows are taken a few at a time: as Python's own objects, a whole batch would be held several times over

    def extracted(batches):
        for part in _parts(batches):
            texts, errors = [], []
            for c, m in zip(part.column("content"), part.column("content_type")):
                try:
                    found, wrong = documents.text_of(bytes(c.as_py()), m.as_py()), None
                except Exception as e:  # noqa: BLE001 - of any file, whatever is wrong with it
                    found, wrong = None, str(e)
                texts.append(found)
                errors.append(wrong)
            yield _with(part, text=pa.array(texts, pa.string()), error=pa.array(errors, pa.string()))

    def built(batches):
        for part in _parts(batches):
            out, kept = [], []
            for c, m, p, t in zip(*(part.column(k) for k in ("content", "content_type", "_m", "redacted_text"))):
                made, same, t = None, False, t.as_py()
                if t is not None:
                    try:
                        made, same = documents.rebuilt(bytes(c.as_py()), m.as_py(), [(x["key"], x["value"]) for x in p.as_py()]), True
                    except Exception:  # noqa: BLE001 - the plain text is there
                        made = t.encode()
                out.append(made)
                kept.append(same)
            yield _with(part.drop_columns(["_m"]), redacted_content=pa.array(out, pa.binary()), _kept=pa.array(kept, pa.bool_()))

    files = files.select("path", "content", "content_type")
    df = files.mapInArrow(extracted, "path string, content binary, content_type string, text string, error string")
    df = redact(df, config).withColumn("_n", F.size("spans"))
    if keep_form:
        df = df.withColumn("_m", F.when(F.col("text").isNotNull(), F.map_entries(F.expr(replacement_map())))).drop("spans")
        df = df.mapInArrow(built, "path string, content binary, content_type string, text string, error string, redacted_text string, _n int, redacted_content binary, _kept boolean")
    else:
        df = df.withColumns({"redacted_content": F.encode("redacted_text", "UTF-8"), "_kept": F.lit(False)})
    ok = F.col("error").isNull()
    told = {
        "output_format": F.when(F.col("_kept"), "preserved").otherwise("plain_text"), "entities_found": F.col("_n"), "original_size": F.length("content"), "redacted_size": F.length("redacted_content"),
        "extracted_text_length": F.length("text"), "redacted_text_length": F.length("redacted_text"),
    }
    return df.select("path", ok.alias("success"), "error", *(F.when(ok, c).alias(k) for k, c in told.items()), "redacted_content")
