"""The pipeline against the stages done by hand on a small table."""

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import BENCH, SCHEMA, _docs, corpus  # noqa: F401
from veilspan.llm import quality, simhash, tokens


def test_pipeline(spark, corpus, tmp_path):  # noqa: F811
    junk = [(5000 + k, " ".join(f"W{k}{j}!!" for j in range(30))) for k in range(20)]
    rows = corpus["rows"] + junk
    d = str(tmp_path)
    _docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i >= 5000 else 1, 0) for i, t in rows if t and t.strip()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, corpus["item"], 0)], BENCH).write.parquet(f"{d}/benchmark.parquet")
    got = corpus_pipeline.run(spark, d).toPandas()

    docs = spark.read.parquet(f"{d}/documents.parquet")
    bad = {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{d}/labels.parquet")).where("not keep").collect()}
    assert {i for i, _ in junk} <= bad
    left, seen = {}, set()
    for i, t in sorted((i, t) for i, t in rows if t is not None and i not in bad):
        if t not in seen:
            left[i] = t
        seen.add(t)
    gone = {r.doc_id for r in simhash.groups(_docs(spark, list(left.items()))).collect()}
    want = {i: t.replace(corpus["item"], "") if i == corpus["leak"] else t for i, t in left.items() if i not in gone}
    enc = tokens.encoder()
    whole = got.sort_values("first_token").groupby("doc_id").tokens.agg(lambda x: [int(v) for a in x for v in a]).to_dict()
    assert whole == {i: enc.encode_ordinary(t) for i, t in want.items() if t}
    load = got.groupby("bin").n_tokens.sum()
    assert (load <= 2048).all() and SCHEMA


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_near_dedup_is_brute_force(spark):
    """What the stage keeps is one document of each group that all pairs within the threshold make."""
    rnd = np.random.default_rng(61)
    rows = []
    for k in range(1500):
        w = [f"w{x}" for x in rnd.integers(0, 10**6, 120)]
        rows.append((2 * k, " ".join(w)))
        for at in rnd.choice(120, 11, replace=False):
            w[at] = f"z{rnd.integers(0, 10**6)}"
        rows.append((2 * k + 1, " ".join(w)))
    docs = _docs(spark, rows).repartition(4).cache()
    found = simhash.fingerprinted(docs).toPandas().sort_values("doc_id")
    lanes = found[list(simhash.LANES)].to_numpy().astype(np.uint64)
    gone = {j for i in range(len(lanes)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(lanes[i] ^ lanes[i + 1 :]).sum(1) <= simhash.THRESHOLD)).tolist()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(gone) > 500 and kept == set(range(len(rows))) - gone, (len(gone), len(kept & gone))
