"""What happens to winners: propagation within a document, the allow list, the garbage filter."""

from __future__ import annotations

from ..functions import spans as S
from ..functions.spans import quoted, var
from ..sources.policies import any_of


def propagated(text: str, spans: str, threshold: float = 0.9) -> str:
    """``spans`` and a span for each further place of a confident value, where nothing is yet.

    A value's label is the one it has most often (first seen on a tie). Longer values
    go first; word edges count where the value has a letter or digit at its edge. Case matters.
    """
    s, k, t, v, l, x, y, o, r, acc, c, e, z, q, w = (var(n) for n in "s k t v l x y o r acc c e z q w".split())  # noqa: E741
    sure = f"filter({spans}, {s} -> {s}.score >= {threshold}D AND {s}.end - {s}.start > 3)"

    vals = f"transform({sure}, {w} -> struct({S.value_of(text, w)} AS v, {w}.label AS l))"

    def memory(vals: str) -> str:
        # most values occur once and have nowhere to go
        keys = f"filter(array_distinct(transform({vals}, {k} -> {k}.v)), {t} -> locate({t}, {text}, locate({t}, {text}) + 1) > 0)"
        own = f"transform(filter({vals}, {x} -> {x}.v = {v}), {x} -> {x}.l)"
        labels = S.let(own, lambda n: f"CASE WHEN size(array_distinct({n})) = 1 THEN {n}[0] ELSE array_max(transform(array_distinct({n}), ({l}, {o}) -> struct(size(filter({n}, {y} -> {y} = {l})) AS n, -{o} AS o, {l} AS label))).label END")
        rows = f"transform({keys}, ({v}, {o}) -> struct(-length({v}) AS size, {o} AS o, {v} AS value, {labels} AS label))"
        return f"array_sort({rows})"

    def placed(mem: str) -> str:
        # places of a literal value: running sums over the parts between
        value = f"{r}.value"
        parts = rf"split({text}, concat('\\Q', replace({value}, '\\E', '\\E\\\\E\\Q'), '\\E'), -1)"
        ends = S.let(f"transform({parts}, {x} -> length({x}) + length({value}))", lambda p: S.prefix(p, "0", lambda a, b: f"({a} + {b})"))
        # the start of match i is the prefix before part i, less the value's length, for i > 0
        at = f"transform(slice({ends}, 2, size({ends})), {y} -> {y} - length({value}))"
        ok_left = rf"NOT (substring({value}, 1, 1) RLIKE '(?U)^\\w' AND {c} > 0 AND substring({text}, {c}, 1) RLIKE '(?U)^\\w')"
        ok_right = rf"NOT (substring({value}, -1) RLIKE '(?U)^\\w' AND substring({text}, {c} + length({value}) + 1, 1) RLIKE '(?U)^\\w')"
        cands = f"transform(filter({at}, {c} -> {ok_left} AND {ok_right}), {c} -> struct({c} AS a, {c} + length({value}) AS b, {r}.label AS label))"
        # what begins where a span does is taken; only the rest needs the full test
        starts = f"transform({spans}, {z} -> {z}.start)"
        all_ = S.let(starts, lambda b: f"filter(flatten(transform({mem}, {r} -> {cands})), {q} -> NOT array_contains({b}, {q}.a))")
        new = S.make(f"{e}.a", f"{e}.b", f"{e}.label", "0.99", "'context_memory'", f"1900000000 + size({acc})")
        free = f"NOT exists({acc}, {s} -> {s}.start < {e}.b AND {e}.a < {s}.end)"
        return f"aggregate({all_}, {spans}, ({acc}, {e}) -> IF({free}, concat({acc}, array({new})), {acc}))"

    return f"CASE WHEN size({sure}) = 0 THEN {spans} ELSE {S.let(S.let(vals, memory), placed)} END"


def allowed(text: str, spans: str, terms: list[str]) -> str:
    """Without the spans whose text, in lower case, is on the list."""
    if not terms:
        return spans
    s = var("s")
    return f"filter({spans}, {s} -> NOT lower({S.value_of(text, s)}) IN ({', '.join(quoted(t.lower()) for t in terms)}))"


_MEDICAL_LABELS = "ANATOMY DIAGNOSIS DISEASE DRUG MEDICAL_CONDITION MEDICATION MEDICINE PROCEDURE SYMPTOM TREATMENT".split()
_SUFFIXES = "adol barbital caine cillin cycline dipine flurane formin mycin olol oxacin pam prazole pril sartan statin tidine zolam algia emia itis oma osis pathy plegia trophy".split()
_SHORT = "AGE BUILDING COUNTRY IDCARD POSTCODE STATE TIME TITLE USERNAME".split()
_STOP = "a an and as at be by for from in is of on or that the this to which with".split()
_PHRASES = [f"{a} {b}" for a, bs in {
    "test": "case data patient text user", "sample": "data text", "example": "data text", "demo": "data text", "email": "address", "phone": "number", "patient": "id name", "full": "name",
    "first": "name", "last": "name", "user": "id name type", "account": "number", "reference": "number", "date": "time", "time": "zone", "file": "name path",
}.items() for b in bs.split()]
#: Words that head a field, and what else passes for a name.
_HEADERS = "abn address email medicare patient phone ssn tfn".split()
_CLINICAL = r"(?i)^(?:(?:diabetes|diagnosed|increase|mellitus|prescribed|treated|type)$|\d+(?:mg|ml|mcg|g|l|bd|tds|qd|daily)$|(?:chief|complaint|condition|medication|treatment)$)"
_PERSON = "PERSON PERSON_NAME person".split()
_PROPER = _PERSON + "applicant judge lawyer location organization".split()


def _in(value: str, words: list[str]) -> str:
    return f"{value} IN ({', '.join(map(quoted, words))})"


def keep(value: str, label: str, score: str, before: str, after: str) -> str:
    """Whether a span is no garbage. ``before`` and ``after``: the characters next to it, or ''."""
    trimmed = rf"regexp_replace({value}, '(?U)^\\s+|\\s+$', '')"
    return S.let(trimmed, lambda v: S.let(f"lower({v})", lambda low: _keep(value, v, low, label, score, before, after)))


def _keep(value: str, v: str, low: str, label: str, score: str, before: str, after: str) -> str:
    # of plain letters, in lower case, the same is found without folding case at every step
    folded = f"({v} RLIKE {quoted(rf'(?iU)\b\w+(?:{"|".join(_SUFFIXES)})\b')} OR {v} RLIKE {quoted(r'(?iU)\d+\s*(?:mg|ml|mcg|g|l|cc|iu|units?)\b')})"
    plain = f"({low} RLIKE {quoted(rf'\w{any_of(" ".join(_SUFFIXES))}\b')} OR {low} RLIKE {quoted(r'\d\s*(?:mg|ml|mcg|g|l|cc|iu|units?)\b')})"
    medical = f"({_in(label, _MEDICAL_LABELS)} OR IF(octet_length({v}) = length({v}), {plain}, {folded}))"
    alnum = lambda c: rf"coalesce({c} RLIKE '^[\\p{{L}}\\p{{N}}]', false)"
    digit = lambda c: rf"coalesce({c} RLIKE '^\\p{{Nd}}', false)"
    return (
        f"CASE WHEN {medical} THEN true WHEN length({v}) = 0 THEN false "
        f"WHEN length({v}) < 3 AND {_in(f'upper({label})', _SHORT)} THEN true "
        rf"WHEN length({v}) < 3 AND NOT ({v} RLIKE '^[A-Z]\\.?$' OR {v} RLIKE '^\\p{{Nd}}+$') THEN false "
        rf"WHEN {v} RLIKE '(?U)^[\\W_]+$' THEN false WHEN {_in(low, _STOP)} THEN false "
        f"WHEN {_in(label, _PERSON)} AND ({_in(low, _PHRASES)} OR {_in(low, _HEADERS)} OR {v} RLIKE {quoted(_CLINICAL)} OR {score} < 0.7D) THEN false "
        rf"WHEN {_in(label, _PROPER)} AND {value} RLIKE '^\\p{{Ll}}' THEN false "
        f"WHEN {alnum(before)} AND {alnum(f'substring({value}, 1, 1)')} THEN false WHEN {alnum(after)} AND {alnum(f'substring({value}, -1)')} THEN false "
        f"WHEN {label} = 'POSTCODE_AU' AND ({digit(before)} OR {digit(after)}) THEN false ELSE true END"
    )


def clean(text: str, spans: str) -> str:
    """Without garbage."""
    s = var("s")
    lead = f"IF({s}.start > 0, 1, 0)"

    def test(near: str) -> str:
        parts = f"struct(substring({near}, {lead} + 1, {s}.end - {s}.start) AS v, IF({s}.start > 0, substring({near}, 1, 1), '') AS b, substring({near}, {lead} + {s}.end - {s}.start + 1, 1) AS a)"
        return S.let(parts, lambda p: keep(f"{p}.v", f"{s}.label", f"{s}.score", f"{p}.b", f"{p}.a"))

    return S.let(spans, lambda all_: S.around(text, all_, lambda near: f"filter({all_}, {s} -> {S.let(near(s, 1, 1), test)})"))
