"""Personal identifiers by bootstrapped contextual extraction.

Candidates are white-space tokens with a digit or an @, and runs of adjacent ones of
any number that may be groups of one value, without the signs around them. A run ends
at a sign between two tokens, at an address or a token of more than ``GROUP`` letters
and digits, which stand alone, and where it has more letters and digits than the
longest grouped form (``LONGEST``, an IBAN). Capitals without a digit may stand within
it. Each candidate has patterns: its shape (letters and short runs of digits
generalised, long runs with their length), and the words to its left and right
together with its kind of characters. Seeds, and what is left of a run between them,
also have these words alone if they have ``PLAIN`` letters and digits, so contexts
reach values of a form that no seed has; of those the best counts. Seeds are candidates that a strict check
proves (a card's check digit, an address's octets, ...). On the graph of patterns and
distinct values Spark then scores by turns: a pattern by the share of its values'
scores, if enough values support it; a value by its high-confidence patterns together
(noisy or). So values that no seed check would accept are found by patterns that
seeds induced.

Defined results
* null and empty texts, and rows without a doc_id, have no candidate; very long texts are read whole;
* ties between kinds of a value: the higher score, then the kind's name;
* a candidate within a longer accepted one is not reported apart;
* repeated rows, and a value repeated in a document: one row for (doc_id, kind, value);
  rows of one doc_id with different texts are read as one document;
* empty tables, or no seed: empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, key_of, stored
from .kernel import bytes_of, slices, word_spans

#: Letters and digits: of a group within a run, of a run, and of a value that a context without its kind of characters may tell.
GROUP, LONGEST, PLAIN = 12, 34, 6
ROUNDS, SUPPORT, CONFIDENT, ACCEPT = 4, 3, 0.4, 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"0123456789@")] = True
_SPLIT = re.compile(r"[\t-\r ]+")
_STRIP = "#$%&*|!,;:.<>=~^_-\"'`?"
_EMAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|edu|gov|io)", re.I)
_PHONE = re.compile(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}")
_ABROAD = re.compile(r"\+(?!1\b)[1-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,11}))+")
_NATIONAL = re.compile(r"(?:\([2-9]\d\d\) |[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}|0\d{1,4}[ -]\d{3,4}[ -]\d{3,4}|0\d(?: \d\d){4}")
_GROUPED = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -])\d{6}\2\d{5}")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}")
_KEY = re.compile(r"A[KS]IA[0-9A-Z]{16}")
_WITHIN = re.compile(r"[A-Z]{1,4}")
_QUAD = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_HEX = re.compile(r"(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{24,}")
_SECRET = re.compile(r"token|key|secret|passw|bearer", re.I)


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(number)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether an IBAN without blanks has its check digits."""
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def seed_kind(value: str, left: str) -> str | None:
    """The kind of a candidate that a strict check proves."""
    if "@" in value:
        return "EMAIL" if _EMAIL.fullmatch(value) else None
    if m := _QUAD.fullmatch(value):
        return "IP" if all(int(x) <= 255 for x in m.groups()) and m[1] != "0" else None
    if value.isascii() and value.isdigit():
        return "CARD" if 13 <= len(value) <= 19 and value[0] in "3456" and luhn(value) else None
    if _GROUPED.fullmatch(value):
        number = re.sub("[ -]", "", value)
        return "CARD" if 13 <= len(number) <= 19 and value[0] in "3456" and luhn(number) else None
    if _IBAN.fullmatch(value):
        return "IBAN" if iban(value.replace(" ", "")) else None
    if _SSN.fullmatch(value):
        return "SSN"
    if _PHONE.fullmatch(value) or _NATIONAL.fullmatch(value):
        return "PHONE"
    if _ABROAD.fullmatch(value):
        return "PHONE" if 8 <= sum(map(str.isdigit, value)) <= 15 else None
    if _KEY.fullmatch(value):
        return "SECRET"
    if _HEX.fullmatch(value.lower()) and _SECRET.search(left):
        return "SECRET"
    return None


def shape(value: str) -> str:
    low = value.lower()
    if _HEX.fullmatch(low):
        return f"h{len(low)}"
    low = re.sub(r"\d+", lambda m: "9" if len(m[0]) < 4 else "9{%d}" % len(m[0]), low)
    return re.sub(r"[^\W\d_]+", "a", low)


def _class(value: str) -> str:
    """Kind of characters: what values of one kind share whatever their length."""
    return "e" if "@" in value and " " not in value else "h" if _HEX.fullmatch(value.lower()) else "d" if value.isdigit() else re.sub(r"\{\d+\}", "", shape(value))


def _bare(token: str) -> str:
    return token.lstrip(_STRIP).rstrip(_STRIP)


def _weight(value: str) -> int:
    return sum(map(str.isalnum, value))


def candidate(tokens: list[str]) -> tuple[str, list[str], str | None]:
    """(value, patterns, seed kind) of a candidate; ``tokens`` are two tokens (or ""), the candidate's, one token (or "")."""
    left2, left, *own, right = tokens
    value = " ".join(map(_bare, own))
    # a bracket whose other is not there
    if value.startswith("(") and ")" not in value:
        value = value[1:]
    if value.endswith(")") and "(" not in value:
        value = value[:-1]
    lw = f"{left2} {left}".lower()
    kind = _class(value)
    # what a value looks like, what stands before and after it
    patterns = [f"shape {shape(value)}", f"left {kind} {left.lower()}", f"left2 {kind} {lw}", f"right {kind} {right.lower()}"]
    return value, patterns, seed_kind(value, lw)


def _alone(tokens: list[str]) -> list[str]:
    """Patterns of a candidate's context without its kind of characters."""
    left2, left, right = tokens[0].lower(), tokens[1].lower(), tokens[-1].lower()
    return [p for p, there in ((f"near left {left}", left), (f"near left2 {left2} {left}", left2), (f"near right {right}", right)) if there]


def candidates(words: list[str], hits: list[int]) -> list[tuple[str, list[str], str | None, int, int]]:
    """(value, patterns, seed kind, first, stop) of all candidates of a text; ``hits`` are the words with a digit or an @."""
    around = ["", "", *words, ""]
    out, runs = [], []
    for i in hits:
        bare = _bare(words[i])
        group = _weight(bare) <= GROUP and "@" not in bare and not _QUAD.fullmatch(bare)
        last = runs[-1] if runs else None
        if last and group and last[1] and i - last[0][-1] <= 2 and words[i].lstrip(_STRIP) == words[i] and words[last[0][-1]].rstrip(_STRIP) == words[last[0][-1]] and (i - last[0][-1] == 1 or _WITHIN.fullmatch(words[i - 1])):
            last[0].append(i)
        else:
            runs.append(([i], group))
    for run, _ in runs:
        found: dict[tuple[int, int], list] = {}
        weights = [_weight(words[i]) for i in run]
        for a, i in enumerate(run):
            total = 0
            for b in range(a, len(run)):
                total += weights[b] + (_weight(words[run[b] - 1]) if b > a and run[b] - run[b - 1] == 2 else 0)
                if b > a and total > LONGEST:
                    break
                found[a, b] = [*candidate(around[i : run[b] + 4]), i, run[b] + 1]
        # seeds, the longest first, and what is left between them
        free, plain = [True] * len(run), []
        for a, b in sorted((k for k, c in found.items() if c[2]), key=lambda k: (k[0] - k[1], k)):
            if all(free[a : b + 1]):
                free[a : b + 1] = [False] * (b + 1 - a)
                plain.append((a, b))
        a = 0
        while a < len(run):
            b = a
            while b < len(run) and free[b]:
                b += 1
            if b > a:
                plain.append((a, b - 1))
            a = b + 1
        for k in plain:
            if (c := found.get(k)) and _weight(c[0]) >= PLAIN:
                c[1] += _alone(around[c[3] : c[4] + 3])
        out += map(tuple, found.values())
    return out


def _candidate_batches(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            data, at = bytes_of(part.column(2))
            begins, lengths, rows = word_spans(data, at, ~_SPACE[data])
            marks = np.concatenate([[0], np.cumsum(_MARK[data], dtype=np.int32)])
            ends = begins + lengths
            marked = marks[ends] > marks[begins]
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            hits = np.flatnonzero(marked)
            row = np.searchsorted(rows, hits, side="right") - 1
            for k in np.unique(row).tolist():
                base = int(rows[k])
                low, high = np.searchsorted(row, k, side="left"), np.searchsorted(row, k, side="right")
                words = data[int(begins[base]) : int(ends[rows[k + 1] - 1])].tobytes().decode()
                words = _SPLIT.split(words)
                for value, patterns, kind, first, stop in candidates(words, (hits[low:high] - base).tolist()):
                    for col, x in zip(out, (int(ids[k]), int(keys[k]), value, patterns, kind, first, stop)):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "key", "value", "patterns", "seed", "first", "stop"])


def extracted(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, kind, value, score) of every identifier found."""
    text = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    seen = stored(arrow_map(text, _candidate_batches, "doc_id long, key long, value string, patterns array<string>, seed string, first long, stop long"), "candidates")
    seeds = seen.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    edges = seen.select(F.explode("patterns").alias("pattern"), "value").distinct()
    # a pattern of fewer values can never have the support
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= SUPPORT)
    edges = stored(edges.join(sizes, "pattern"), "pattern-graph")
    scores = seeds = stored(seeds, "seeds")
    # a value with many contexts is not the surer for each of them
    near, doubt = F.startswith("pattern", F.lit("near ")), F.log(1 - F.least(F.col("conf"), F.lit(0.999)))
    for _ in range(rounds):
        rated = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.first("size").alias("size"))
        rated = rated.withColumn("conf", F.col("mass") / F.col("size")).where((F.col("mass") >= SUPPORT) & (F.col("conf") >= CONFIDENT)).select("pattern", "kind", "conf")
        found = edges.select("pattern", "value").join(rated, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.coalesce(F.sum(F.when(~near, doubt)), F.lit(0.0)) + F.coalesce(F.min(F.when(near, doubt)), F.lit(0.0)))).alias("score"))
        scores = stored(found.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score")), "scores")
    best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
    taken = scores.where(F.col("score") >= ACCEPT).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    # what lies within a longer identifier is a part of it
    inside = Window.partitionBy("doc_id", "key").orderBy("first", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    there = seen.select("doc_id", "key", "value", "first", "stop").distinct().join(taken, "value").withColumn("reach", F.max("stop").over(inside))
    there = there.where(F.col("reach").isNull() | (F.col("stop") > F.col("reach")))
    return there.select("doc_id", "kind", "value", F.round("score", 6).alias("score")).distinct()
