"""Character spans as SQL expressions.

A span is a struct (start, end, label, score, source, ord); offsets are code points,
half open. Functions here take and give SQL text, which Spark parses at once, so a
policy of forty patterns is planned in milliseconds. Nothing runs Python per row, and
no shuffle is needed to find, group or splice spans.
"""

from __future__ import annotations

import re
from itertools import count

SPAN = "struct<start:int,end:int,label:string,score:double,source:string,ord:int>"
SPANS = f"array<{SPAN}>"
EMPTY = f"CAST(array() AS {SPANS})"
NO_LENGTHS = "CAST(array() AS array<struct<g:int,m:int>>)"
#: Set around matches: a control sign, and the one beside it, which stands in for it where a text has it.
MARK, _BESIDE = "\x01", "\x02"
#: What a pattern has that could tell these two apart: themselves, or a sign by its number or name.
_NAMES_MARK = re.compile(r"[\x01\x02]|\\[xu0cN]")
#: Elements that a fold appends to before a new block begins; keeps appending linear for long texts.
BLOCK = 128
#: Characters of a block of ``around``.
CUT = 256

_names = count()


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def var(stem: str = "v") -> str:
    """A name that no other lambda has."""
    return f"{stem}_{next(_names)}"


def let(value: str, body) -> str:
    """``body(name)`` with ``value`` evaluated once."""
    v = var()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def _fold(values: str, zero: str, join, kind: str) -> str:
    """For each value the join of all before it."""
    a, x, e = var("a"), var("x"), var("e")
    return (
        f"aggregate({values}, named_struct('now', {zero}, 'out', CAST(array() AS array<{kind}>)), "
        f"({a}, {x}) -> named_struct('now', {join(f'{a}.now', x)}, 'out', concat({a}.out, array({a}.now))), {e} -> {e}.out)"
    )


def prefix(values: str, zero: str, join, kind: str = "int") -> str:
    """``_fold`` in blocks: linear in the number of values. ``join`` is associative, ``zero`` its unit. ``values`` is a name."""
    b, i, s, blk, base, y = var("b"), var("i"), var("s"), var("blk"), var("base"), var("y")
    a1, x1 = var("a"), var("x")
    blocks = f"transform(sequence(0, CAST((size({values}) - 1) div {BLOCK} AS INT)), {i} -> slice({values}, {i} * {BLOCK} + 1, {BLOCK}))"
    totals = f"transform({b}, {s} -> aggregate({s}, {zero}, ({a1}, {x1}) -> {join(a1, x1)}))"
    inner = f"transform({_fold(blk, zero, join, kind)}, {y} -> {join(base, y)})"
    body = f"transform(array({blocks}), {b} -> flatten(zip_with({b}, {_fold(totals, zero, join, kind)}, ({blk}, {base}) -> {inner})))[0]"
    return f"CASE WHEN size({values}) > {BLOCK} THEN {body} ELSE {_fold(values, zero, join, kind)} END"


def _add(a: str, b: str) -> str:
    return f"({a} + {b})"


def _greatest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def unmarked(text: str) -> str:
    """``text`` without ``MARK``: in its place the sign beside it, which is of the same kind and length."""
    return f"IF(contains({text}, '{MARK}'), translate({text}, '{MARK}', '{_BESIDE}'), {text})"


def lengths(text: str, pattern: str, clean: str | None = None) -> str:
    """array<struct<g,m>>: length of each match and of what lies before it. ``clean``: a name that has ``unmarked(text)``.

    The matches are marked and the text is cut at the marks: one pass of a compiled pattern, where ``split`` compiles
    it anew for every text. Only a pattern that names the marks themselves is matched and split.
    """
    p, m, g, i = quoted(pattern), var("m"), var("g"), var("i")
    if _NAMES_MARK.search(pattern):
        pairs = lambda v: f"slice(zip_with({v}, split({text}, {p}, -1), ({m}, {g}) -> named_struct('g', length({g}), 'm', length({m}))), 1, size({v}))"
        return let(f"regexp_extract_all({text}, {p}, 0)", lambda v: f"CASE WHEN size({v}) = 0 THEN {NO_LENGTHS} ELSE {pairs(v)} END")
    if clean is None:
        return let(unmarked(text), lambda t: lengths(text, pattern, t))
    marked = f"split(regexp_replace({clean}, {p}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    pairs = lambda v: f"transform(sequence(0, CAST(size({v}) div 2 AS INT) - 1), {i} -> named_struct('g', length({v}[2 * {i}]), 'm', length({v}[2 * {i} + 1])))"
    return let(marked, lambda v: f"CASE WHEN size({v}) = 1 THEN {NO_LENGTHS} ELSE {pairs(v)} END")


def offsets(z: str) -> str:
    """array<struct<start,end>> from ``lengths``, a name."""
    x, at, y = var("x"), var("at"), var("y")
    sums = let(f"transform({z}, {y} -> {y}.g + {y}.m)", lambda v: prefix(v, "0", _add))
    return f"zip_with({z}, {sums}, ({x}, {at}) -> named_struct('start', {at} + {x}.g, 'end', {at} + {x}.g + {x}.m))"


def ranges(text: str, pattern: str) -> str:
    """array<struct<start,end>> of all matches of one pattern."""
    return let(lengths(text, pattern), offsets)


def value_of(text: str, span: str) -> str:
    return f"substring({text}, {span}.start + 1, {span}.end - {span}.start)"


def around(text: str, spans: str, body) -> str:
    """``body(near)``; ``near(span, before, after)`` gives the span's value with so many characters on either side, as far as there are.

    A substring costs the way from the text's beginning, so a long text is cut into blocks once."""
    low = lambda s, before: f"greatest({s}.start - {before}, 0)"
    whole = lambda s, before, after: f"substring({text}, {low(s, before)} + 1, {s}.end + {after} - {low(s, before)})"

    def near(blocks: str):
        def one(s: str, before: int = 0, after: int = 0) -> str:
            a = low(s, before)
            two = f"concat({blocks}[CAST({a} div {CUT} AS INT)], coalesce(get({blocks}, CAST({a} div {CUT} AS INT) + 1), ''))"
            return f"CASE WHEN size({blocks}) = 0 OR {s}.end + {after} - {a} > {CUT} THEN {whole(s, before, after)} ELSE substring({two}, {a} % {CUT} + 1, {s}.end + {after} - {a}) END"

        return one

    cut = f"CASE WHEN length({text}) > {2 * CUT} AND size({spans}) > 8 THEN regexp_extract_all({text}, '(?s).{{1,{CUT}}}', 0) ELSE CAST(array() AS array<string>) END"
    return let(cut, lambda b: body(near(b)))


def make(start: str, end: str, label: str, score: str, source: str, ord_: str) -> str:
    return f"named_struct('start', CAST({start} AS INT), 'end', CAST({end} AS INT), 'label', {label}, 'score', CAST({score} AS DOUBLE), 'source', {source}, 'ord', CAST({ord_} AS INT))"


def copy(span: str, **change: str) -> str:
    """The span with some fields set anew."""
    return make(*(change.get(f, f"{span}.{f}") for f in ("start", "end", "label", "score", "source", "ord")))


def in_order(spans: str, longer_first: bool = False) -> str:
    """By start, then order of emission (or the longer first)."""
    s, k = var("s"), var("k")
    second = f"-{s}.end" if longer_first else "0"
    return f"transform(array_sort(transform({spans}, {s} -> struct({s}.start, {second} AS z, {s}.ord, {s}.end, {s}.label, {s} AS span))), {k} -> {k}.span)"


def groups(spans: str) -> str:
    """Spans that overlap, directly or through others, as arrays; ``spans`` is a name, in order."""
    x, b, new, i, n, at, k = (var(c) for c in ("x", "b", "new", "i", "n", "at", "k"))
    y = var("y")
    reach = let(f"transform({spans}, {y} -> {y}.end)", lambda v: prefix(v, "-1", _greatest))
    flags = f"zip_with({spans}, {reach}, ({x}, {b}) -> {x}.start >= {b})"
    heads = f"filter(transform({flags}, ({new}, {i}) -> IF({new}, {i}, NULL)), {n} -> {n} IS NOT NULL)"
    return let(heads, lambda h: f"transform({h}, ({at}, {k}) -> slice({spans}, {at} + 1, coalesce(get({h}, {k} + 1), size({spans})) - {at}))")


def splice(text: str, spans: str, replacement) -> str:
    """``text`` with each span replaced by ``replacement(value, label)``; ``spans`` are disjoint, by place."""

    def joined(s: str) -> str:
        x, i, y = var("x"), var("i"), var("y")
        ends = f"concat(array(0), transform({s}, {y} -> {y}.end))"

        def pieces(e: str) -> str:
            new = let(value_of(text, x), lambda v: replacement(v, f"{x}.label"))
            parts = f"transform({s}, ({x}, {i}) -> concat(substring({text}, {e}[{i}] + 1, {x}.start - {e}[{i}]), {new}))"
            return f"concat(array_join({parts}, ''), substring({text}, element_at({e}, -1) + 1))"

        return let(ends, pieces)

    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {let(spans, joined)} END"
