"""Redaction as a column: what a user of a scalar function calls, without Python in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.spans import let, var
from .pipeline import Config, final, rewriter

#: Fields of the spans that ``spans_column`` gives.
SPAN = "array<struct<start:int,end:int,label:string,score:float,source:string>>"


#: Rounds of analysis: each nested lambda takes one, and a whole plan of detectors in one expression has more than Spark's 100.
ROUNDS = 1000


def _room() -> None:
    """Let the session analyse a column of that depth."""
    spark, name = SparkSession.getActiveSession(), "spark.sql.analyzer.maxIterations"
    if spark is not None and int(spark.conf.get(name, "100")) < ROUNDS:
        spark.conf.set(name, str(ROUNDS))


def _text(column: str | Column) -> str:
    """The column's name in SQL, for a column that is a name."""
    if isinstance(column, Column):
        raise TypeError("give the column's name; for an expression add it as a column first")
    _room()
    return f"`{column}`"


def redaction_column(config: Config = Config()) -> Callable[[str], Column]:  # noqa: B008
    """A function from a column's name to the redacted text of that column; null stays null."""

    def column(name: str) -> Column:
        text = _text(name)
        return F.expr(let(final(text, config), lambda s: S.splice(text, s, rewriter(config))))

    return column


def spans_column(config: Config = Config()) -> Callable[[str], Column]:  # noqa: B008
    """A function from a column's name to its spans; null has none."""

    def column(name: str) -> Column:
        text = _text(name)
        s = var("s")
        return F.expr(f"CAST(transform({final(text, config)}, {s} -> named_struct('start', {s}.start, 'end', {s}.end, 'label', {s}.label, 'score', {s}.score, 'source', {s}.source)) AS {SPAN})")

    return column


def create_udf(config: Config = Config(), returns: str = "redacted") -> Callable[[str], Column]:  # noqa: B008
    """``redacted`` text or ``spans``, to be used as a function in ``select`` and ``withColumn``."""
    made = {"redacted": redaction_column, "spans": spans_column}
    if returns not in made:
        raise ValueError(f"no such result: {returns}")
    return made[returns](config)


def register(spark: SparkSession, name: str, config: Config = Config(), returns: str = "redacted") -> None:  # noqa: B008
    """A SQL function of one string, for the session: ``SELECT name(text) FROM t``."""
    _room()
    if returns == "redacted":
        body, kind = let(final("x", config), lambda s: S.splice("x", s, rewriter(config))), "STRING"
    else:
        s = var("s")
        body, kind = f"CAST(transform({final('x', config)}, {s} -> named_struct('start', {s}.start, 'end', {s}.end, 'label', {s}.label, 'score', {s}.score, 'source', {s}.source)) AS {SPAN})", SPAN
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
