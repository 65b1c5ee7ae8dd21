"""Check digits of Australian identifiers, as SQL over a value."""

from __future__ import annotations

from .spans import let


def _checked(value: str, size: int, test) -> str:
    d = rf"regexp_replace({value}, '(?U)\\D', '')"
    return let(d, lambda v: f"coalesce(length({v}) = {size} AND {test(v)}, false)")


def _sum(d: str, weights: list[int], less: int = 0) -> str:
    return "(" + " + ".join(f"(CAST(substring({d}, {k}, 1) AS INT) - {less if k == 1 else 0}) * {w}" for k, w in enumerate(weights, 1)) + ")"


def tfn(value: str) -> str:
    return _checked(value, 9, lambda d: f"{_sum(d, [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0")


def abn(value: str) -> str:
    return _checked(value, 11, lambda d: f"{_sum(d, [10, *range(1, 20, 2)], 1)} % 89 = 0")


def acn(value: str) -> str:
    return _checked(value, 9, lambda d: f"(10 - {_sum(d, list(range(8, 0, -1)))} % 10) % 10 = CAST(substring({d}, 9, 1) AS INT)")


def medicare(value: str) -> str:
    return _checked(value, 11, lambda d: f"substring({d}, 1, 1) BETWEEN '2' AND '6' AND {_sum(d, [1, 3, 7, 9] * 2)} % 10 = CAST(substring({d}, 9, 1) AS INT)")


def bsb(value: str) -> str:
    return _checked(value, 6, lambda d: "true")


def crn(value: str) -> str:
    return rf"coalesce(upper(regexp_replace({value}, '(?U)^\\s+|\\s+$', '')) RLIKE '^\\d{{9}}[A-Z]$', false)"


CHECKS = {"TFN": tfn, "ABN": abn, "ACN": acn, "MEDICARE": medicare, "BSB": bsb, "CENTRELINK_CRN": crn}


def valid(label: str, value: str) -> str:
    """True unless the label has a check and the value fails it."""
    return f"CASE {label} " + " ".join(f"WHEN '{name}' THEN {check(value)}" for name, check in CHECKS.items()) + " ELSE true END"
