"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic model over whole-text features. Hosts and
paths under them get posteriors by grouped aggregation over all documents, shrunk to
the level above: a host to the global rate, a path to its host, the more the fewer
documents there are. What a document tells of its site is its label where it has one,
and the classifier's probability where not. A document's posterior log-odds are its own
evidence with its path's rate as the prior.

The host is what ``source`` has before its first slash (a scheme is left out), the path
the part after it, up to the next; a source without a path has ``lang`` in its place.

Defined results
* null text counts as empty; an empty text has quality 0 and is rejected;
* null source or lang are a site of their own; sites without a labelled document
  still have the classifier's evidence;
* null doc_id: the row is scored and kept or rejected by its text and site, without a label;
* repeated rows and ties: every row is scored for itself; rows that share a doc_id are
  told apart by text, source and lang; one at the threshold is kept;
* labels that contradict each other: the majority counts, a tie is bad; a label counts
  for every row of its doc_id, the fit takes the one with the smallest key;
* very long texts are measured whole; clashing names do no harm, as only doc_id, text,
  source and lang are read;
* no labels (or of one grade only): the evidence is neutral, nothing but empty text goes;
* empty tables give empty results; extra columns pass through ``kept``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, key_of, stored
from .kernel import bytes_of, slices, word_hashes, word_spans

#: The classifier is fitted on so many labelled documents at most (those first in hash order of doc_id).
MAX_LABELLED = 20_000
#: Documents whose posterior probability of being good is below this go.
THRESHOLD = 0.5

NAMES = ("log_words", "mean_len", "upper", "digit", "symbol", "bar", "bang", "ends_odd", "same_as_last", "distinct", "no_letter", "long_word", "period_words", "high")
_KIND = np.zeros((8, 256), np.uint8)
for _k, _chars in enumerate((range(65, 91), range(48, 58), b"#$%&*<>{}[]=+~^_\\@|", b"|", b"!", list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256)), b".,;:?", range(128, 256))):
    _KIND[_k, list(_chars)] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text, of the whole text."""
    data, at = bytes_of(column)
    n = len(at) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    if not len(data):
        return out
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    begins, lengths, rows = word_spans(data, at, ~_SPACE[data])
    words = np.diff(rows).astype(np.float64)
    per_word = np.maximum(words, 1)
    upper, digit, symbol, bar, bang, letter, stop, high = (_sums(k[data], at) for k in _KIND)
    last = data[begins + lengths - 1]
    odd = _KIND[2][last] | _KIND[4][last]
    h = word_hashes(data, begins, lengths)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    same = np.zeros(len(h), np.uint8)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = np.sort((h & np.uint64(0xFFFFFFFFFFFF)) | (row << np.uint64(48))) if n < 65536 else None
    new = np.ones(len(h), np.uint8)
    new[1:] = key[1:] != key[:-1]
    letter_at = np.concatenate([[0], np.cumsum(_KIND[5][data], dtype=np.int32)])
    none = (letter_at[begins + lengths] == letter_at[begins]).astype(np.uint8)
    distinct = _sums(new, rows)
    cols = (
        np.log1p(words), size / per_word, upper / np.maximum(letter, 1), digit / size, symbol / size, bar / per_word, bang / per_word,
        _sums(odd, rows) / per_word, _sums(same, rows) / per_word, distinct / per_word ** 0.85, _sums(none, rows) / per_word,
        _sums((lengths > 24).astype(np.uint8), rows) / per_word, stop / per_word, high / size,
    )
    for k, c in enumerate(cols):
        out[:, k] = c
    return out


def _feature_batches(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            for begin in range(0, part.num_rows, 60_000):
                few = part.slice(begin, 60_000)
                text = few.column(few.schema.get_field_index("text"))
                x = features(text)
                keep = [few.column(few.schema.get_field_index(c)) for c in ("doc_id", "key", "source", "lang")]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x[:, k].astype(np.float32)) for k in range(len(NAMES)))], ["doc_id", "key", "source", "lang", *(f"f_{k}" for k in NAMES)])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, lang, f_*) of every document."""
    schema = "doc_id long, key long, source string, lang string, " + ", ".join(f"f_{k} float" for k in NAMES)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text").cast("string")).alias("key"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), _feature_batches, schema)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: weights, intercept, and the features' means and deviations."""
    mean, dev = x.mean(0), x.std(0) + 1e-6
    z = np.clip(np.c_[(x - mean) / dev, np.ones(len(x))], -8, 8)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1]), mean, dev


def _shrinkage(rates: DataFrame, n: str, rate: str, centre) -> float:
    """Prior strength by the method of moments: within-site against between-site variance."""
    row = rates.agg(
        F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * F.pow(F.col(rate) - centre, 2)).alias("between"),
        F.sum(F.col(n) * F.col(rate) * (1 - F.col(rate))).alias("within"), F.sum(F.col(n) * F.col(n)).alias("n2"),
    ).first()
    if not row["n"] or row["k"] < 2:
        return 1e6
    within = max(row["within"] / row["n"], 1e-9)
    spread = row["n"] - row["n2"] / row["n"]
    between = max((row["between"] - (row["k"] - 1) * within) / max(spread, 1e-9), 1e-9)
    return float(min(max(within / between, 1.0), 1e6))


_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)(?:/([^/?#]*))?"


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, lang, evidence, host_rate, path_rate, posterior, keep), a row for each row of ``docs``."""
    return _scored(docs, labels).drop("key")


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    base = stored(measured(docs), "quality-features")
    told = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("double").alias("y"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    fs = [f"f_{k}" for k in NAMES]
    # the sample has at most MAX_LABELLED rows, and so has what is joined to it
    got = base.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by(F.struct(*fs), "key").alias("f")).select("doc_id", "y", "f.*").toPandas()
    got = got.sort_values("doc_id")  # the order in which tasks end must not matter
    if len(got) and got.y.nunique() > 1:
        w, b, mean, dev = fit(got[fs].to_numpy(np.float64), got.y.to_numpy(np.float64))
        rate = float(np.clip(got.y.mean(), 1e-3, 1 - 1e-3))
    else:
        w, b, mean, dev, rate = np.zeros(len(fs)), 0.0, np.zeros(len(fs)), np.ones(len(fs)), 0.5
    odds = F.lit(b)
    for k, f in enumerate(fs):
        odds = odds + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(f).cast("double") - float(mean[k])) / float(dev[k]))) * float(w[k])
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    logit = lambda c: F.ln(c / (1 - c))
    one = base.withColumn("odds", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))).withColumn("p", sigmoid(F.col("odds")))
    one = one.withColumn("host", F.regexp_extract("source", _URL, 1)).withColumn("path", F.coalesce(F.nullif(F.regexp_extract("source", _URL, 2), F.lit("")), "lang"))
    path = one.join(told, "doc_id", "left").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("y", "p")).alias("rate"))
    path = stored(path, "quality-sites")
    host = path.groupBy("host").agg(F.sum("n").alias("host_n"), (F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("own"))
    all_ = host.agg((F.sum(F.col("host_n") * F.col("own")) / F.sum("host_n")).alias("r")).first()["r"]
    centre = float(np.clip(all_ if all_ is not None else rate, 1e-3, 1 - 1e-3))
    kh = _shrinkage(host, "host_n", "own", F.lit(centre))
    host = host.withColumn("host_rate", (F.col("host_n") * F.col("own") + kh * centre) / (F.col("host_n") + kh))
    sites = path.join(host.withColumnRenamed("host", "__h"), F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    kp = _shrinkage(sites, "n", "rate", F.col("host_rate"))
    sites = sites.withColumn("path_rate", (F.col("n") * F.col("rate") + kp * F.col("host_rate")) / (F.col("n") + kp)).select(F.col("host").alias("__s"), F.col("path").alias("__l"), "host_rate", "path_rate")
    out = one.join(sites, F.col("host").eqNullSafe(F.col("__s")) & F.col("path").eqNullSafe(F.col("__l")), "left")
    prior = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("path_rate")))
    posterior = F.when(F.col("f_log_words") == 0, F.lit(0.0)).otherwise(sigmoid(F.col("odds") - float(np.log(centre / (1 - centre))) + logit(prior)))
    return out.withColumn("posterior", posterior).select("doc_id", "key", "source", "lang", F.col("odds").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= THRESHOLD).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    gone = _scored(docs, labels).where(~F.col("keep")).select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "key", "source", "lang"))).distinct()
    there = {"__doc_id": docs["doc_id"].cast("long"), "__key": key_of(docs["text"].cast("string")), "__source": docs["source"].cast("string"), "__lang": docs["lang"].cast("string")}
    same = None
    for c, of in there.items():
        same = of.eqNullSafe(gone[c]) if same is None else same & of.eqNullSafe(gone[c])
    return docs.join(gone, same, "left_anti")
