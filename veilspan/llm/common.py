"""Helpers that every operator of this folder shares.

Rows without a doc_id and repeated ids are treated alike by all operators:

* a row without a doc_id is in no result that names documents (pairs, spans, groups,
  identifiers); filters and scores keep it as a row of its own, judged by its text;
* rows that share a doc_id but not the text are told apart by ``key``, a hash of the
  text, wherever a decision about a row is carried back to the rows; equal rows have
  one fate.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything that is neither a letter nor a digit parts two words.
NON_WORD = r"[^\p{L}\p{N}]+"

#: Bits of the maps of ``maybe_in``.
MAP_BITS = 1 << 25

_ROOT = Path(__file__).resolve().parents[2]


def words_of(text: Column) -> Column:
    """Lower-cased words of ``text``, parted by single spaces; null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, NON_WORD, " ")))


def key_of(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilspan-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    and a lost executor costs nothing but a re-read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a slim relation in the shared folder; Spark's cleaner removes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where PYTHONPATH lacks it."""
    given = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if any(Path(p).resolve() == _ROOT for p in given):
        return
    sc = spark.sparkContext
    if getattr(sc, "_veilspan_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="veilspan-ship-")) / "veilspan_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (_ROOT / "veilspan").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(archive))
    sc._veilspan_shipped = True


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def maybe_in(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key may be in ``wanted`` (none that is gets lost), by a bitmap of ``MAP_BITS`` bits of the keys'
    hashes: a broadcast of 4 MB, whatever the data, that keeps the others from being moved by the join to come."""
    place = F.pmod(F.xxhash64(*on), F.lit(MAP_BITS))
    maps = wanted.select(place.alias("h")).groupBy(F.expr("h div 32768").alias("__bucket")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("__bits"))
    there = rows.withColumn("__h", place).withColumn("__bucket", F.expr("__h div 32768")).join(F.broadcast(maps), "__bucket")
    byte = "CAST(conv(hex(substring(__bits, CAST((__h % 32768) div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return there.where(F.expr(f"getbit({byte}, CAST(__h % 8 AS INT)) = 1")).select(*rows.columns)
