"""Detectors: SQL that gives the spans of a text.

Spans carry ``ord``, their place in sequential emission: the detector's rank, the
place of the pattern, then the place in the text; with it ties are never left open.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import validators
from ..functions.spans import quoted, var
from ..sources.policies import FLAGS, PACK, PackEntry, Policy, Rule

#: Rank of a detector, cheap ones first. What is not named comes last.
RANK = {"regex": 0, "spacy": 1, "statistical": 2, "gliner": 3, "bert": 4, "deberta": 4, "openmed": 5}


def base(source: str, place: int) -> int:
    return RANK.get(source, 99) * 20_000_000 + place * 80_000


def _has_digit(tree) -> bool:
    """Whether every match of a parsed pattern has a digit in it."""
    for op, av in tree:
        name = str(op)
        if name == "LITERAL" and chr(av).isdigit():
            return True
        if name == "IN" and all((str(o) == "CATEGORY" and str(v) == "CATEGORY_DIGIT") or (str(o) == "RANGE" and chr(v[0]).isdigit() and chr(v[1]).isdigit()) or (str(o) == "LITERAL" and chr(v).isdigit()) for o, v in av):
            return True
        if name == "BRANCH" and all(_has_digit(b) for b in av[1]):
            return True
        if name == "SUBPATTERN" and _has_digit(av[3]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT") and av[0] > 0 and _has_digit(av[2]):
            return True
    return False


def _about(text: str) -> str:
    """What gates ask of a text, worked out once: itself in lower, then upper case (what the matcher takes for equal is then equal), whether it has a digit, and itself as it is matched."""
    return rf"named_struct('f', upper(lower({text})), 'd', {text} RLIKE '\\p{{Nd}}', 't', {S.unmarked(text)})"


def _gate(text: str, about: str, pattern: str) -> str | None:
    """A cheap test that every text with a match passes: a keyword, an @ or a digit."""
    tests = []
    if keys := getattr(pattern, "keys", ()):
        tests.append("(" + " OR ".join(f"contains({about}.f, {quoted(k)})" for k in keys) + ")")
    if need := getattr(pattern, "need", ""):
        tests.append(f"{about}.t RLIKE {quoted(FLAGS + need)}")
    if "@" in pattern:
        tests.append(f"contains({text}, '@')")
    if _has_digit(re._parser.parse(pattern, re.I)):
        tests.insert(0, f"{about}.d")
    return " AND ".join(tests) or None


def _gated(text: str, fold: str, pattern: str) -> str:
    found = S.lengths(text, FLAGS + pattern, f"{fold}.t")
    test = _gate(text, fold, pattern)
    return f"CASE WHEN {test} THEN {found} ELSE {S.NO_LENGTHS} END" if test else found


def by_rules(text: str, rules: list[Rule], source: str = "regex", score: float = 1.0, checks: bool = False) -> str:
    """All matches of every rule. Rules with one pattern share its evaluation; offsets are worked out in one place for all."""
    shared: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        shared.setdefault(rule.pattern, []).append(k)
    if not shared:
        return S.EMPTY
    found, fold = [], var("fold")
    for pattern, ks in shared.items():
        labels = ", ".join(f"named_struct('label', {quoted(rules[k].label)}, 'base', {base(source, k)})" for k in ks)
        found.append(f"named_struct('labels', array({labels}), 'z', {_gated(text, fold, pattern)})")
    e, x, i, lab, f = var("e"), var("x"), var("i"), var("lab"), var("f")
    made = S.make(f"{x}.start", f"{x}.end", f"{lab}.label", str(score), quoted(source), f"{lab}.base + {i}")
    one = f"flatten(transform({S.let(f'{e}.z', S.offsets)}, ({x}, {i}) -> transform({e}.labels, {lab} -> {made})))"
    lengths = f"transform(array({_about(text)}), {fold} -> array({', '.join(found)}))[0]"
    out = f"flatten(transform(filter({lengths}, {f} -> size({f}.z) > 0), {e} -> {one}))"
    if checks:
        s = var("s")
        out = f"filter({out}, {s} -> {validators.valid(f'{s}.label', S.value_of(text, s))})"
    return f"coalesce({out}, {S.EMPTY})"


def policy_rules(policy: Policy, custom: dict | None = None) -> list[Rule]:
    """The policy's rules with custom patterns: those of a label are alternatives, joined to the label's own."""
    rules = list(policy.rules)
    at = {r.label: k for k, r in enumerate(rules)}
    for label, patterns in (custom or {}).items():
        joined = "|".join([patterns] if isinstance(patterns, str) else patterns)
        if label in at:
            rules[at[label]] = Rule(label, f"{rules[at[label]].pattern}|{joined}")
        else:
            rules.append(Rule(label, joined))
    return rules


def regex(text: str, policy: Policy, custom: dict | None = None, country: str | None = None) -> str:
    return by_rules(text, policy_rules(policy, custom), checks=(country or policy.country) == "AU")


def counts(text: str, policy: Policy, country: str | None = None) -> str:
    """array<struct<label,n>>: how many spans ``regex`` gives of each label that has one; places are not worked out."""
    checked = validators.CHECKS if (country or policy.country) == "AU" else {}
    shared: dict[str, list[str]] = {}
    for rule in policy.rules:
        shared.setdefault(rule.pattern, []).append(rule.label)
    found, fold, f, v, n = [], var("fold"), var("f"), var("v"), var("n")
    for pattern, labels in shared.items():
        number = lambda label: f"size(filter({v}, {n} -> {checked[label](n)}))" if label in checked else f"size({v})"
        each = ", ".join(f"named_struct('label', {quoted(label)}, 'n', {number(label)})" for label in labels)
        counted = f"transform(array(regexp_extract_all({text}, {quoted(FLAGS + pattern)}, 0)), {v} -> array({each}))[0]"
        test = _gate(text, fold, pattern)
        found.append(f"CASE WHEN {test} THEN {counted} ELSE CAST(array() AS array<struct<label:string,n:int>>) END" if test else counted)
    return f"coalesce(filter(flatten(transform(array({_about(text)}), {fold} -> flatten(array({', '.join(found)})))), {f} -> {f}.n > 0), CAST(array() AS array<struct<label:string,n:int>>))"


def _allowed(value: str, rule: dict) -> str:
    tests = ["true"]
    if "min_length" in rule:
        tests.append(f"length({value}) >= {rule['min_length']}")
    if "max_length" in rule:
        tests.append(f"length({value}) <= {rule['max_length']}")
    tests += [f"contains({value}, {quoted(c)})" for c in rule.get("required_chars", "")]
    tests += [f"NOT contains({value}, {quoted(c)})" for c in rule.get("forbidden_chars", "")]
    return " AND ".join(tests)


def custom(text: str, pack: tuple[PackEntry, ...] = PACK, validators_: dict[str, dict] | None = None) -> str:
    """The custom entity pack: each pattern apart, scored by its static score and the length of its last group."""
    found, fold = [], var("fold")
    for k, e in enumerate(pack):
        p, g = quoted(FLAGS + e.pattern), var("g")
        test = _gate(text, fold, e.pattern)
        test = f"{test} AND {text} RLIKE {p}" if test else f"{text} RLIKE {p}"
        groups = f"transform(regexp_extract_all({text}, {p}, {e.group}), {g} -> named_struct('n', length({g}), 'ok', {_allowed(g, (validators_ or {}).get(e.label, {}))}))"
        found.append(f"named_struct('label', {quoted(e.label)}, 'base', {base('custom', k)}, 'static', {e.score}D, 'm', CASE WHEN {test} THEN named_struct('z', {S.lengths(text, FLAGS + e.pattern, f'{fold}.t')}, 'g', {groups}) END)")
    e, x, i, f, s = var("e"), var("x"), var("i"), var("f"), var("s")
    bonus = f"CASE WHEN {e}.m.g[{i}].n > 10 THEN 0.05D WHEN {e}.m.g[{i}].n < 4 THEN -0.1D ELSE 0.0D END"
    score = f"round(least(1.0D, greatest(0.1D, {e}.static + {bonus})), 6)"
    made = S.make(f"{x}.start", f"{x}.end", f"{e}.label", score, "'custom'", f"{e}.base + {i}")
    one = f"transform({S.let(f'{e}.m.z', S.offsets)}, ({x}, {i}) -> IF({e}.m.g[{i}].ok, {made}, NULL))"
    lengths = f"transform(array({_about(text)}), {fold} -> array({', '.join(found)}))[0]"
    all_ = f"flatten(transform(filter({lengths}, {f} -> {f}.m IS NOT NULL), {e} -> {one}))"
    return f"coalesce(filter({all_}, {s} -> {s} IS NOT NULL), {S.EMPTY})"


# Statistical detection: shapes and character statistics of tokens.

#: The first is a run of words; written over classes, as Java's matcher recurses once a repeated group.
_TOKENS = (r"\b\w(?:[\w\s]*\w)?\b", r"\S+@\S+\.\w+", r"\d+(?:[-.\s]\d+)*", r"\b\w*\d+\w*\b")
_SHAPES = (
    ("EMAIL", 0.95, r"^[^@]+@[^@]+\.[^@]+$"), ("SSN", 0.9, r"^\d{3}-?\d{2}-?\d{4}$"), ("CREDIT_CARD", 0.9, r"^\d{4}(?:[\s-]?\d{4}){3}$"), ("PHONE", 0.85, r"^[\d\s()+-]{7,}$"),
    ("DATE", 0.8, r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}$"), ("TIME", 0.8, r"(?i)^\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AP]M)?$"), ("IP_ADDRESS", 0.85, r"^\d{1,3}(?:\.\d{1,3}){3}$"),
    ("UUID", 0.9, r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
)


def entropy(value: str) -> str:
    """Shannon entropy in bits of the lower-cased characters."""
    a, x, y = var("a"), var("x"), var("y")

    def summed(c: str) -> str:
        p = f"(size(filter({c}, {y} -> {y} = {x})) / CAST(length({value}) AS DOUBLE))"
        return f"aggregate(array_distinct({c}), 0.0D, ({a}, {x}) -> {a} - {S.let(p, lambda q: f'{q} * log2({q})')})"

    return S.let(f"split(lower({value}), '')", summed)


def ratio(value: str, cls: str) -> str:
    return f"(length(regexp_replace({value}, {quoted(f'[^{cls}]')}, '')) / CAST(length({value}) AS DOUBLE))"


def repetition(value: str) -> str:
    """Share of neighbours that are equal."""
    x, y, b = var("x"), var("y"), var("b")
    n = f"length({value})"
    same = S.let(f"split({value}, '')", lambda c: f"size(filter(zip_with(slice({c}, 1, {n} - 1), slice({c}, 2, {n} - 1), ({x}, {y}) -> {x} = {y}), {b} -> {b}))")
    return f"CASE WHEN {n} > 1 THEN {same} / CAST({n} - 1 AS DOUBLE) ELSE 0.0D END"


def sequential(value: str) -> str:
    """Whether over 0.3 of the triples go up or down by one."""
    i, n, c0 = var("i"), f"length({value})", var("c")
    steps = lambda c, d: f"({c}[{i} + 1] - {c}[{i}] = {d} AND {c}[{i} + 2] - {c}[{i} + 1] = {d})"
    runs = S.let(f"transform(split({value}, ''), {c0} -> ascii({c0}))", lambda c: f"size(filter(sequence(0, {n} - 3), {i} -> {steps(c, 1)} OR {steps(c, -1)}))")
    return f"CASE WHEN {n} >= 3 THEN {runs} > 0.3D * ({n} - 2) ELSE false END"


def token_class(value: str) -> str:
    """struct<label, conf> of a token, or null: its shape, else its band of entropy; a band whose inner test fails gives null."""
    made = lambda label, conf: f"named_struct('label', '{label}', 'conf', {conf}D)"
    shapes = " ".join(f"WHEN {value} RLIKE {quoted(p)} THEN {made(label, conf)}" for label, conf, p in _SHAPES)
    digit, alpha, upper, n = ratio(value, r"\p{Nd}"), ratio(value, r"\p{L}"), ratio(value, r"\p{Lu}"), f"length({value})"

    def banded(e: str) -> str:
        return (
            f"CASE WHEN {e} > 3.5D AND {digit} > 0.3D AND {digit} < 0.7D AND {alpha} > 0.2D THEN {made('IDENTIFIER', 0.7)} "
            f"WHEN {e} > 2.5D AND {alpha} > 0.7D AND {upper} > 0.1D AND {n} BETWEEN 4 AND 20 THEN {made('PERSON_NAME', 0.6)} "
            f"WHEN {digit} > 0.7D AND {n} BETWEEN 6 AND 20 AND NOT {sequential(value)} THEN {made('NUMERIC_ID', 0.65)} "
            f"WHEN {n} > 12 AND {e} > 2.0D AND {digit} > 0.2D AND {alpha} > 0.2D THEN {made('SENSITIVE_CODE', 0.6)} END"
        )

    return f"CASE {shapes} ELSE {S.let(entropy(value), banded)} END"


def statistical(text: str, threshold: float = 0.7) -> str:
    """Tokens of three characters or more that a class claims with at least ``threshold``. A token may come more than once."""
    parts = []
    for k, p in enumerate(_TOKENS):
        z = S.ranges(text, FLAGS + p)
        if k:
            gate = f"contains({text}, '@')" if k == 1 else rf"{text} RLIKE '\\p{{Nd}}'"
            z = f"CASE WHEN {gate} THEN {z} ELSE CAST(array() AS array<struct<start:int,end:int>>) END"
        r = var("r")
        parts.append(f"filter({z}, {r} -> {r}.end - {r}.start >= {4 if k == 3 else 3})")
    r, i, c, k = var("r"), var("i"), var("c"), var("k")
    classed = f"transform(flatten(array({', '.join(parts)})), ({r}, {i}) -> named_struct('r', {r}, 'i', {i}, 'c', {S.let(S.value_of(text, r), token_class)}))"
    made = S.make(f"{k}.r.start", f"{k}.r.end", f"{k}.c.label", f"{k}.c.conf", "'statistical'", f"{base('statistical', 0)} + {k}.i")
    return f"coalesce(transform(filter({classed}, {c} -> {c}.c IS NOT NULL AND {c}.c.conf >= {threshold}D), {k} -> {made}), {S.EMPTY})"


COMMON = sorted(set("""a about after all also an and any as at back be because but by can come could day do even first for from get give go good have he her
him his how i if in into it its just know like look make me most my new no not now of on one only or other our out over people say see she so some
take than that the their them then there these they think this time to two up us use want way we well what when which who will with work would year you your""".split()))


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n, freq): share of each lower-case word among all words of the corpus."""
    words = docs.select(F.explode(F.expr(rf"regexp_extract_all(lower({text}), '(?U)\\w+', 0)")).alias("term"))
    n = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("term", "n", (F.col("n") / F.col("total")).alias("freq"))


def _rare(words: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """Of words those that are rare in ``docs``. What is not rare is at most 1 / ``threshold`` terms, so no word is moved."""
    frequent = term_frequencies(docs, text).where(F.col("freq") >= threshold).select("term")
    return words.where((F.length("term") > 2) & ~F.col("term").isin(COMMON)).join(F.broadcast(frequent), "term", "left_anti")


def rare_words(docs: DataFrame, id_: str = "doc_id", text: str = "text", threshold: float = 0.01) -> DataFrame:
    """(id, term): words that are rare in the corpus, one row each, where their places don't matter."""
    words = docs.select(id_, F.explode(F.expr(rf"regexp_extract_all(lower({text}), '(?U)\\w+', 0)")).alias("term"))
    return _rare(words, docs, text, threshold).select(id_, "term")


def rare_terms(docs: DataFrame, id_: str = "doc_id", text: str = "text", threshold: float = 0.01) -> DataFrame:
    """Words that are rare in the corpus, one row each: two passes; the rare ones are joined to their share by term."""
    freq = term_frequencies(docs, text).where((F.col("freq") < threshold) & (F.length("term") > 2) & ~F.col("term").isin(COMMON))
    r, w = var("r"), var("w")
    # terms are what the pattern matched: cut out of the text, each would cost the way from its beginning
    found = rf"zip_with({S.ranges('t', r'(?U)\w+')}, regexp_extract_all(t, '(?U)\\w+', 0), ({r}, {w}) -> struct({r}.start AS start, {r}.end AS end, {w} AS term))"
    words = docs.select(id_, F.expr(f"lower({text})").alias("t")).select(id_, F.explode(F.expr(found)).alias("r")).select(id_, "r.start", "r.end", "r.term")
    score = F.least(F.lit(0.8), (threshold - F.col("freq")) / threshold)
    return _rare(words, docs, text, threshold).join(freq, "term").select(id_, "start", "end", F.lit("RARE_TERM").alias("label"), score.alias("score"), F.lit("frequency").alias("source"), "term")


BOOST = {
    "PERSON_NAME": (r"\b(?:client|dr|employee|mr|mrs|ms|patient|prof)\b", r"\b(?:age|born|dob)\b", r"\b(?:call|contact|email|phone)\b"),
    "MEDICAL_RECORD": (r"\b(?:chart|diagnosis|medical|patient|record)\b", r"\b(?:clinic|doctor|hospital|physician)\b", r"\b(?:medication|prescription|treatment)\b"),
    "FINANCIAL": (r"\b(?:account|balance|payment|transaction)\b", r"\b(?:bank|credit|debit|invoice)\b", r"\$[\d,]+\.?\d*"),
}
PENALTY = {"PERSON_NAME": r"\b(?:column|field|table|variable)\b", "DATE": r"\b(?:build|release|version)\b"}


def contextual(text: str, spans: str, window: int = 50, boost: dict | None = None, penalty: dict | None = None) -> str:
    """Scores raised by 0.1 for each fitting context, lowered by 0.2 for an unfitting one, kept within [0.1, 1]."""
    s = var("s")
    begin = f"greatest({s}.start - {window}, 0)"

    def rescored(near: str) -> str:
        hit = lambda p: f"CAST({near} RLIKE {quoted('(?U)' + p)} AS INT)"
        up = " ".join(f"WHEN '{label}' THEN 0.1D * ({' + '.join(map(hit, ps))})" for label, ps in (boost or BOOST).items())
        down = " ".join(f"WHEN '{label}' THEN 0.2D * {hit(p)}" for label, p in (penalty or PENALTY).items())
        score = f"least(1.0D, greatest(0.1D, {s}.score + CASE {s}.label {up} ELSE 0.0D END - CASE {s}.label {down} ELSE 0.0D END))"
        return S.copy(s, score=score, source=f"concat({s}.source, '_contextual')")

    return f"transform({spans}, {s} -> {S.let(f'lower(substring({text}, {begin} + 1, {s}.end + {window} - {begin}))', rescored)})"


def gazetteer(text: str, terms: dict[str, str], source: str = "spacy", score: float = 0.8) -> str:
    """Literal terms, each with its label: the offline stand-in for an entity ruler."""
    return by_rules(text, [Rule(label, r"\b" + re.escape(term) + r"\b") for term, label in terms.items()], source, score)


MEDICAL = ("DRUG", "MEDICATION", "MEDICAL_CONDITION", "DISEASE", "DIAGNOSIS", "PROCEDURE", "TREATMENT", "SYMPTOM", "ANATOMY")
LEGAL = ("JUDGE", "LAWYER", "COURT", "CASE_NUMBER", "PLAINTIFF", "DEFENDANT", "JURISDICTION", "STATUTE", "ARTICLE", "SECTION")
MEDICAL_PHRASES = (
    r"\bpatient\s+(?:admitted|diagnosed|presents)\b", r"\b(?:dosage|medication|prescribed|treatment)\b", r"\b(?:clinician|doctor|physician|surgeon)\b.*\b(?:examined|prescribed|treated)\b",
    r"\b(?:clinic|emergency|hospital|ward)\s+(?:admission|stay|visit)\b", r"\b(?:mcg|mg|ml)\b", r"\b(?:blood pressure|heart rate|temperature)\b",
)
LEGAL_PHRASES = (
    r"\b(?:defendant|plaintiff)\s+(?:alleges|argues|claims)\b", r"\b(?:court|tribunal)\s+(?:finds|holds|orders|rules)\b", r"\bcase\s+no\.?\s*\d+\b",
    r"\b(?:article|clause|section)\s+\d+\b", r"\b(?:aforementioned|hereby|pursuant|whereas)\b", r"\b(?:jurisdiction|statute|venue)\b",
)


def domain(text: str, spans: str) -> str:
    """medical, legal or general, by the share of such labels, and by phrases where that is not clear. No span: general."""
    s = var("s")
    names = lambda labels: ", ".join(map(quoted, labels))
    share = lambda labels: f"(size(filter({spans}, {s} -> {s}.label IN ({names(labels)}))) / CAST(size({spans}) AS DOUBLE))"
    score = lambda ps: "(" + " + ".join(f"CAST({text} RLIKE {quoted('(?iU)' + p)} AS INT)" for p in ps) + ")"
    unclear = f"{share(MEDICAL)} < 0.15D AND {share(LEGAL)} < 0.15D"
    return (
        f"CASE WHEN size({spans}) = 0 THEN 'general' WHEN {unclear} AND {score(MEDICAL_PHRASES)} >= 2 THEN 'medical' WHEN {unclear} AND {score(LEGAL_PHRASES)} >= 2 THEN 'legal' "
        f"WHEN {share(MEDICAL)} >= 0.15D THEN 'medical' WHEN {share(LEGAL)} >= 0.15D THEN 'legal' ELSE 'general' END"
    )


#: Sources that a domain admits; everything but OpenMed is in general, custom only there.
ROUTES = {"medical": ("gliner", "openmed", "regex", "spacy"), "legal": ("bert", "gliner", "regex", "spacy")}


def routed(spans: str, domain_: str) -> str:
    s = var("s")
    cases = " ".join(f"WHEN '{d}' THEN {s}.source IN ({', '.join(map(quoted, sources))})" for d, sources in ROUTES.items())
    return f"filter({spans}, {s} -> CASE {domain_} {cases} ELSE {s}.source <> 'openmed' END)"


class CustomPack:
    """A user's patterns by label, on top of the bundled pack: a string, a list, or a dict of patterns and validator each."""

    def __init__(self, config: dict[str, str | list[str] | dict] | None = None, bundled: bool = True):
        self.bundled, self.patterns, self.checks = bundled, {}, {}
        for label, rule in (config or {}).items():
            self.add(label, rule)

    def add(self, label: str, rule: str | list[str] | dict) -> None:
        """Add patterns to a label; a dict's validator bounds the last group's length and characters."""
        if isinstance(rule, dict):
            if rule.get("validator"):
                self.checks[label] = rule["validator"]
            rule = rule.get("patterns", [])
        for p in [rule] if isinstance(rule, str) else rule:
            re.compile(p)
            self.patterns.setdefault(label, []).append(p)

    def remove(self, label: str) -> bool:
        self.checks.pop(label, None)
        return self.patterns.pop(label, None) is not None

    def labels(self) -> list[str]:
        return sorted({*self.patterns, *(e.label for e in (PACK if self.bundled else ()))})

    def spans(self, text: str, score: float = 0.9) -> str:
        own = tuple(PackEntry(label, p, score, re.compile(p).groups) for label, ps in self.patterns.items() for p in ps)
        return custom(text, (PACK if self.bundled else ()) + own, self.checks)
