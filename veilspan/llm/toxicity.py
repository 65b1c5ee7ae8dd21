"""Toxicity grades by cumulative-link ordinal regression.

Grades run from 0 (not toxic) to 3. The labels tell toxic from not toxic; a toxic
document's grade in training is the third its rate of toxic words falls into, toxic
words being those whose odds of a toxic document stand out most. The model is
``P(grade <= k) = sigmoid(theta_k - w.x)`` with one weight vector for all ordered
thresholds; x has, for each selected word or beginning of a word, its share of the document's words, and the log of the
document's length. Every document is scored by its whole text.

The model has at most ``MAX_FEATURES`` features, chosen in Spark among all words and
beginnings of words of the labelled sample (``MAX_LABELLED`` documents).

Defined results
* null and empty texts: no word, severity 0, grade 0;
* no toxic (or only toxic) labels: severity 0 for all;
* labels of unknown documents or null grades are ignored; of repeated labels the most toxic counts;
* null doc_id: the row is scored, without a label; ties (features that tell as much): the smaller hash;
* repeated rows and ids: each row is scored for itself, a label counts for every row of its doc_id;
* very long texts are read whole; clashing names do no harm, as only doc_id and text are read;
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, words_of
from .kernel import bytes_of, slices, word_hashes, word_spans

GRADES = 4
#: The model is fitted on so many labelled documents at most (those first in hash order of doc_id).
MAX_LABELLED = 20_000
#: Features that the model may use: its size, which is shipped to every task. All documents' words are read.
MAX_FEATURES = 4096
#: Beginnings of words, in bytes, that are features too, each hashed apart from the words.
PREFIXES = ((5, 0x6A09E667F3BCC908), (7, 0xBB67AE8584CAA73B))


def share(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a feature's count is worth in a text of so many words: per cent, 10 at most."""
    return np.minimum(100.0 * count / np.maximum(words, 1), 10.0)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all rows (each word, and the beginnings of longer ones), the row of each, and the words of each row."""
    data, at = bytes_of(column)
    begins, lengths, rows = word_spans(data, at)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    h, of = [word_hashes(data, begins, lengths)], [row]
    for size, salt in PREFIXES:
        longer = np.flatnonzero(lengths > size)
        h.append(word_hashes(data, begins[longer], np.full(len(longer), size)) ^ np.uint64(salt))
        of.append(row[longer])
    return np.concatenate(h), np.concatenate(of), n


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with counts, and the words of each row."""
    h, row, n = _hashes(column)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h))), n


def _seen_batches(batches):
    """Of a task's documents, in how many toxic and clean ones each feature is."""
    for batch in batches:
        for part in slices(batch, "words"):
            row, h, _, _ = _counted(part.column(2))
            toxic = part.column(1).to_numpy() > 0
            words, inverse, df = np.unique(h, return_inverse=True, return_counts=True)
            bad = np.bincount(inverse, toxic[row], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bad), pa.array(df - bad)], ["h", "toxic", "clean"])


def _selected_batches(words: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "words"):
                row, h, count, n = _counted(part.column(2))
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[at] == h
                ends = pa.array(np.searchsorted(row[hit], np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[hit].astype(np.int32))) for x in (at, count)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), *lists], ["doc_id", "toxic", "n", "k", "c"])

    return run


class OrdinalModel:
    """Words (hashes, sorted) with weights, the weight of length, and thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, length_weight: float, mean_length: float, thresholds: np.ndarray):
        self.words, self.weights, self.length_weight, self.mean_length, self.thresholds = words, weights, length_weight, mean_length, thresholds
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(words >> np.uint64(48)).astype(np.int64)] = True

    def at_least(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, 3, for each row; zeros for a row without a word."""
        h, row, words = _hashes(column)
        n = len(words)
        z = self.length_weight * (np.log1p(words) - self.mean_length)
        if len(self.words) and len(h):
            at = np.flatnonzero(self.coarse[(h >> np.uint64(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            hit = self.words[k] == h[at]
            pair, count = np.unique(row[at[hit]] * len(self.words) + k[hit], return_counts=True)
            of = pair // len(self.words)
            z += np.bincount(of, share(count, words[of]) * self.weights[pair % len(self.words)], minlength=n)
        p = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))
        p[words == 0] = 0
        return p


def selected(seen: DataFrame, nt: int, nc: int) -> DataFrame:
    """(h, odds, root) of the features of at least three documents that tell most by the likelihood ratio; ``seen`` is (h, toxic, clean), of nt toxic and nc clean documents."""
    t, c, n = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(nt + nc)
    odds = F.log((t + 0.5) / (nt - t + 0.5)) - F.log((c + 0.5) / (nc - c + 0.5))
    g = F.lit(0.0)
    for part, all_, share_ in ((t, nt, (t + c) / n), (c, nc, (t + c) / n), (nt - t, nt, 1 - (t + c) / n), (nc - c, nc, 1 - (t + c) / n)):
        g = g + 2 * part * F.log(F.greatest(part, F.lit(1e-9)) / F.greatest(share_ * float(all_), F.lit(1e-9)))
    told = seen.where(t + c >= 3).select("h", odds.alias("odds"), (F.signum(odds) * F.sqrt(F.greatest(g, F.lit(0.0)))).alias("root"))
    return told.where(F.abs("root") > 3).orderBy(F.desc(F.abs("root")), "h").limit(MAX_FEATURES)


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray, grade: np.ndarray, features: int, ridge: float = 0.1, steps: int = 400):
    """Maximum a posteriori by Adam on the full batch: weights, the dense feature's weight, thresholds."""
    n = len(grade)
    shares = np.clip(np.cumsum(np.bincount(grade, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    theta0 = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(theta0), 0.05))
    p = np.concatenate([np.zeros(features + 1), theta0[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    for step in range(1, steps + 1):
        w, b, theta = p[:features], p[features], np.concatenate([p[features + 1 : features + 2], p[features + 1] + np.cumsum(np.exp(p[features + 2 :]))])
        z = np.bincount(row, val * w[col], minlength=n) + b * dense
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = edge[grade + 1] - z, edge[grade] - z
        up, dn = np.where(np.isinf(hi), 1.0, sig(hi)), np.where(np.isinf(lo), 0.0, sig(lo))
        prob = np.maximum(up - dn, 1e-9)
        du, dd = up * (1 - up) / prob, dn * (1 - dn) / prob  # slopes of log probability by the edges
        gz = (du - dd) / 1.0
        gt = np.array([-(du[grade == k].sum()) + dd[grade == k + 1].sum() for k in range(GRADES - 1)])
        gaps = np.exp(p[features + 2 :])
        g = np.concatenate([np.bincount(col, val * gz[row], minlength=features) + ridge * w, [(gz * dense).sum() + ridge * b], [gt.sum()], [gt[k + 1 :].sum() * gaps[k] for k in range(GRADES - 2)]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:features], float(p[features]), np.concatenate([p[features + 1 : features + 2], p[features + 1] + np.cumsum(np.exp(p[features + 2 :]))])


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel | None:
    """Fit on a bounded sample of labelled documents; None where there is nothing to tell apart."""
    sample = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # the sample's size is bounded by MAX_LABELLED rows of two integers
    some = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    some = stored(some.select("doc_id", F.col("toxic").cast("int").alias("toxic"), words_of(F.col("text")).alias("words")), "toxicity-sample")
    size = {bool(r["t"]): r["n"] for r in some.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    seen = arrow_map(some, _seen_batches, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = selected(seen, size[True], size[False]).toPandas()
    words = best.h.to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, odds, z = words[order], best.odds.to_numpy()[order], best.root.to_numpy()[order]
    if not len(words):
        return None
    got = arrow_map(some, _selected_batches(words), "doc_id long, toxic int, n long, k array<int>, c array<int>").toArrow().combine_chunks()
    got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy(), kind="stable"))).combine_chunks()
    one = lambda c: got[c].chunk(0)
    y, n = got["toxic"].to_numpy(), got["n"].to_numpy()
    col = one("k").flatten().to_numpy(zero_copy_only=False)
    count = one("c").flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(y)), np.diff(one("k").offsets.to_numpy()))
    bad = (z > 5) & (odds > 2)
    rate = np.bincount(row, count * bad[col], minlength=len(y)) / np.maximum(n, 1)
    grade = np.zeros(len(y), np.int64)
    cuts = np.quantile(rate[y > 0], [1 / 3, 2 / 3])
    grade[y > 0] = 1 + np.searchsorted(cuts, rate[y > 0], side="right")
    grade = np.minimum(grade, GRADES - 1)
    mean = float(np.log1p(n).mean())
    w, b, theta = fit_ordinal(row, col, share(count, n[row]), np.log1p(n) - mean, grade, len(words))
    return OrdinalModel(words, w, b, mean, theta)


def _scoring(model: OrdinalModel | None):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "words"):
                p = model.at_least(part.column(1)) if model is not None else np.zeros((part.num_rows, GRADES - 1))
                arrays = [part.column(0), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0].copy())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "expected_severity", "grade", "p_toxic"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic) of every document."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(words_of(F.col("text")), F.lit("")).alias("words"))
    return arrow_map(words, _scoring(train(docs, labels)), "doc_id long, expected_severity double, grade int, p_toxic double")
