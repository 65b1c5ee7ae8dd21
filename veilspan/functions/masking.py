"""Styles that rewrite a detected value, as SQL over (value, label)."""

from __future__ import annotations

from collections.abc import Callable

from .spans import quoted, var

Style = Callable[[str, str], str]


def mask(value: str, label: str) -> str:
    return f"repeat('*', length({value}))"


def replace(value: str, label: str) -> str:
    return f"concat('<', {label}, '>')"


def brackets(value: str, label: str) -> str:
    return f"concat('[', {label}, ']')"


def hashed(value: str, label: str) -> str:
    return f"substring(sha2({value}, 256), 1, 12)"


def preserve_format(value: str, label: str) -> str:
    return rf"regexp_replace({value}, '[\\p{{L}}\\p{{N}}]', 'X')"


def encrypt(value: str, label: str) -> str:
    return rf"substring(regexp_replace(base64(encode({value}, 'UTF-8')), '\\s', ''), 1, 20)"


def _draw(value: str, label: str, salt: str, below: int) -> str:
    """A number below ``below`` that depends on the value alone."""
    return f"pmod(xxhash64({value}, {label}, '{salt}'), {below})"


def _pick(value: str, label: str, salt: str, words: str) -> str:
    choices = words.split()
    return f"element_at(array({', '.join(map(quoted, choices))}), CAST({_draw(value, label, salt, len(choices))} + 1 AS INT))"


def synthetic(value: str, label: str) -> str:
    """A made-up value of the label's family; the same value always gets the same one."""
    n = lambda salt, size: f"lpad(CAST({_draw(value, label, salt, 10**size)} AS STRING), {size}, '0')"
    pick = lambda salt, words: _pick(value, label, salt, words)
    first, last = pick("g", "Ada Ben Cleo Dev Eve Finn Gus Hana Ivo June"), pick("f", "Adler Brook Cole Dane Ellis Frost Grant Hale Irwin Jonas")
    made = [
        ("EMAIL", f"concat('user', {n('m', 4)}, '@example.com')"),
        ("PHONE|MOBILE", f"concat_ws('-', '555', {n('p1', 3)}, {n('p2', 4)})"),
        ("SSN", f"concat_ws('-', {n('s1', 3)}, {n('s2', 2)}, {n('s3', 4)})"),
        ("CREDIT_CARD", f"concat_ws('-', concat('4', {n('c1', 3)}), {n('c2', 4)}, {n('c3', 4)}, {n('c4', 4)})"),
        ("DOB|DATE", f"date_format(date_add(DATE'1950-01-01', CAST({_draw(value, label, 'd', 20000)} AS INT)), 'yyyy-MM-dd')"),
        ("ADDRESS", f"concat_ws(' ', {_draw(value, label, 'a', 998)} + 1, {pick('s', 'Oak Elm Pine Maple Cedar')}, 'Street')"),
        ("ORG|COMPANY", f"concat({pick('o', 'Acacia Boreal Cirrus Delta Ember')}, ' Pty Ltd')"),
        ("PERSON|NAME", f"concat_ws(' ', {first}, {last})"),
    ]
    return "CASE " + " ".join(f"WHEN upper({label}) RLIKE '{family}' THEN {new}" for family, new in made) + f" ELSE {same_classes(value, label)} END"


def same_classes(value: str, label: str) -> str:
    """Each letter and digit by another of its class and case, drawn from the value and the place."""
    c, i = var("c"), var("i")
    letter = f"char(CAST(pmod(xxhash64({value}, {label}, {i}), 26) AS INT) + 97)"
    digit = f"CAST(pmod(xxhash64({value}, {label}, {i}), 10) AS STRING)"
    one = rf"CASE WHEN {c} RLIKE '^\\p{{Nd}}$' THEN {digit} WHEN {c} RLIKE '^\\p{{Lu}}$' THEN upper({letter}) WHEN {c} RLIKE '^\\p{{L}}$' THEN {letter} ELSE {c} END"
    return f"array_join(transform(split({value}, ''), ({c}, {i}) -> {one}), '')"


STYLES: dict[str, Style] = {"mask": mask, "replace": replace, "brackets": brackets, "redact": brackets, "hash": hashed, "preserve_format": preserve_format, "encrypt": encrypt, "synthetic": synthetic}


def style(name: str) -> Style:
    """A pipeline style; an unknown one falls back to hash."""
    return STYLES.get(name, hashed)


# Strategies: the library of rewriters beside the pipeline's own styles.


def strategy_mask(value: str, label: str, char: str = "*", preserve_length: bool = True) -> str:
    return f"repeat({quoted(char)}, length({value}))" if preserve_length else replace(value, label)


def strategy_hash(value: str, label: str, salt: str = "", bits: int = 256) -> str:
    return f"concat('HASH_', substring(sha2(concat({quoted(salt)}, {value}, {label}), {bits}), 1, 12))"


def strategy_replace(value: str, label: str, template: str = "<{type}>") -> str:
    return f"replace({quoted(template)}, '{{type}}', {label})"


def strategy_brackets(value: str, label: str) -> str:
    return "'[REDACTED]'"


def strategy_encrypt(value: str, key: str, purpose: str = "") -> str:
    """AES-GCM in base64 under a key of 16 or 32 bytes; only the same key and purpose give the value back."""
    return f"concat('ENC_', base64(aes_encrypt({value}, {key}, 'GCM', 'DEFAULT', '', {quoted(purpose)})))"


def strategy_decrypt(value: str, key: str, purpose: str = "") -> str:
    return f"CAST(aes_decrypt(unbase64(substring({value}, 5)), {key}, 'GCM', 'DEFAULT', {quoted(purpose)}) AS STRING)"


def pattern_of(value: str) -> str:
    """9 for a digit, A or a for a letter of either case."""
    return rf"regexp_replace(regexp_replace(regexp_replace({value}, '\\p{{Nd}}', '9'), '\\p{{Lu}}', 'A'), '\\p{{Ll}}', 'a')"


def strategy_au_phone(value: str, label: str) -> str:
    d = rf"regexp_replace({value}, '\\D', '')"
    return f"CASE WHEN length({d}) < 10 THEN concat('XX', repeat('X', length({d}) - 2)) WHEN startswith({d}, '04') THEN '04XX-XXX-XXX' ELSE concat(substring({d}, 1, 2), 'XX-XXX-XXX') END"


def generalised(value: str, label: str) -> str:
    """Bands for ages, the label for everything else."""
    age = rf"TRY_CAST(regexp_replace({value}, '\\D', '') AS INT)"
    return f"CASE WHEN upper({label}) = 'AGE' AND {age} IS NOT NULL THEN CASE WHEN {age} < 30 THEN '<30' WHEN {age} < 50 THEN '30-50' WHEN {age} < 70 THEN '50-70' ELSE '>70' END ELSE {replace(value, label)} END"


def k_anonymous(value: str, label: str, order: str, k: int = 5, running: bool = False) -> str:
    """The value where it occurs k times (from its k-th occurrence on if ``running``), else its generalisation."""
    seen = f"row_number() OVER (PARTITION BY {label}, {value} ORDER BY {order})" if running else f"count(*) OVER (PARTITION BY {label}, {value})"
    return f"CASE WHEN {seen} >= {k} THEN {value} ELSE {generalised(value, label)} END"


def budget_spent(order: str, partition: str, epsilon: float = 1.0, each: float = 0.1) -> str:
    """Privacy budget that is left to a row of its ``partition`` (a user, say): ``each`` until ``epsilon`` is spent, then 0."""
    return f"greatest(0.0D, least({each}D, {epsilon}D - {each}D * (row_number() OVER (PARTITION BY {partition} ORDER BY {order}) - 1)))"


def laplace(value: str, epsilon: str, seed: str, sensitivity: float = 1.0) -> str:
    """A number with Laplace noise by the inverse distribution of a draw that the seed fixes; null where no budget is left."""
    u = f"((pmod(xxhash64({seed}), 1000003) + 0.5D) / 1000003 - 0.5D)"
    return f"CASE WHEN {epsilon} > 0 THEN {value} - {sensitivity}D / {epsilon} * signum({u}) * ln(1 - 2 * abs({u})) END"


def private(value: str, label: str, epsilon: str, seed: str, total: float = 1.0, sensitivity: float = 1.0) -> str:
    """A value under differential privacy: numbers get noise (ages and counts none below 0), texts are left out as <LABEL>
    with a probability that falls with the budget spent, or generalised; without budget all are <LABEL>."""
    tag = f"concat('<', {label}, '>')"
    draw = f"((pmod(xxhash64({seed}, 'draw'), 1000003) + 0.5D) / 1000003)"
    noised = f"round({laplace(f'CAST({value} AS DOUBLE)', epsilon, seed, sensitivity)}, 6)"
    least = f"CASE WHEN upper({label}) IN ('AGE', 'COUNT', 'QUANTITY') THEN greatest(0.0D, {noised}) ELSE {noised} END"
    return (
        f"CASE WHEN {epsilon} <= 0 THEN {tag} WHEN {value} RLIKE '^\\\\d+$' THEN CAST({least} AS STRING) "
        f"WHEN {draw} < least(0.5D, {epsilon} / {total}D) THEN {tag} ELSE {generalised(value, label)} END"
    )


REGISTRY: dict[str, Style] = {
    "mask": strategy_mask, "hash": strategy_hash, "replace": strategy_replace, "brackets": strategy_brackets, "redact": strategy_brackets,
    "synthetic": synthetic, "preserve_format": same_classes, "au_phone": strategy_au_phone, "k_anonymity": generalised,
}


def register(name: str, rewrite: Style) -> None:
    REGISTRY[name] = rewrite


def apply(name: str, value: str, label: str) -> str:
    """A registered strategy, or the hash one."""
    return REGISTRY.get(name, strategy_hash)(value, label)
