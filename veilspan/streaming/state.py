"""Operators with a state on streams: a user's privacy budget, and values that become known by repetition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def budgeted(stream: DataFrame, user: str, order: str, epsilon: float = 1.0, each: float = 0.1) -> DataFrame:
    """(user, order, epsilon): what each row of a user may spend, ``each`` until ``epsilon`` is gone; the state is the sum spent.
    Within a micro-batch a user's rows go by ``order``; a user has one row of state, whatever their rows."""

    def spend(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        n = pd.Series(range(spent, spent + len(rows)), index=rows.index)
        left = (epsilon - each * n).clip(upper=each, lower=0).round(9)
        state.update((spent + len(rows),))
        yield pd.DataFrame({user: rows[user], order: rows[order], "epsilon": left})

    kinds = dict(stream.dtypes)
    return stream.select(user, order).groupBy(user).applyInPandasWithState(spend, f"{user} {kinds[user]}, {order} {kinds[order]}, epsilon double", "n long", "append", GroupStateTimeout.NoTimeout)


def shown(stream: DataFrame, value: str, label: str, order: str, k: int = 5) -> DataFrame:
    """(label, value, order, shown): a value from its k-th occurrence on, its label in brackets before; the state is a count by label and value."""

    def show(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        known = pd.Series(range(seen + 1, seen + len(rows) + 1), index=rows.index) >= k
        state.update((seen + len(rows),))
        out = rows[[label, value, order]].copy()
        out["shown"] = rows[value].astype(str).where(known, "<" + rows[label].astype(str) + ">")
        yield out

    kinds = dict(stream.dtypes)
    schema = f"{label} {kinds[label]}, {value} {kinds[value]}, {order} {kinds[order]}, shown string"
    return stream.select(label, value, order).groupBy(label, value).applyInPandasWithState(show, schema, "n long", "append", GroupStateTimeout.NoTimeout)
