"""Operators whose results SQL can't express, against plain Python that shares no code with them but fixed settings."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strokelake.llm import classifier, common, fingerprints, neardup

LONG, INT = (lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")), (lambda x: (x & (1 << 32) - 1).to_bytes(4, "little"))


def spark_hash(*parts):
    """Spark's xxhash64 of strings, longs and ints, given as bytes."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text):
    """One permutation: a dictionary of bins, each empty one probing on its own."""
    words = text.split()
    if not words:
        return ""
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] or [words]
    bins = {}
    for s in shingles:
        h = spark_hash(*[w.encode() for w in s])
        k = (h >> 56) + 128  # signed order
        bins[k] = min(h, bins.get(k, h))
    out = []
    for k in range(256):
        found = bins.get(k)
        for t in range(fingerprints.PROBES):
            if found is None:
                found = bins.get(spark_hash(INT(k), INT(t)) % 256)
        if found is None:
            found = bins[min(bins, key=lambda j: (spark_hash(INT(k), INT(j), INT(-1)), j))]
        out.append(spark_hash(LONG(found), INT(k)) & 15)
    return "".join(f"{v:X}" for v in out)


def test_fingerprints_equal_a_plain_one_permutation_minhash(spark):
    rng = np.random.default_rng(9)
    texts = ["", "one", "a b c", "a b c d e", *[" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (6, 9, 40, 300, 5000)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in enumerate(texts)}


def test_classifier_scores_equal_plain_neighbours(spark):
    rng = np.random.default_rng(4)
    words = "the of and river stone walks under light with many small words".split()
    texts = [" ".join(w.upper() + "!" if i % 4 == 0 else w for w in rng.choice(words, 30)) for i in range(120)] + ["", None, "stone", "???"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = classifier.fit(frame, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)], "doc_id long, quality int"))
    assert 60 < len(model.labels) < 120
    got = {r.doc_id: r.score for r in classifier.score(frame, model).collect()}
    for k, text in enumerate(texts):
        counts = classifier.Terms().counts([text or ""])[0].astype(float)
        if not counts.sum():
            assert got[k] == model.prior
            continue
        x = np.sqrt(counts / counts[classifier.SHAPES :].sum()) * model.idf
        shapes, terms = x[: classifier.SHAPES], x[classifier.SHAPES :]
        x = np.concatenate([shapes / max(np.linalg.norm(shapes), 1e-9), 0.6 * terms / max(np.linalg.norm(terms), 1e-9)])
        v = x @ model.projection
        cosines = [float(v @ m) / max(np.linalg.norm(v), 1e-9) / max(np.linalg.norm(m), 1e-9) for m in model.vectors]
        near = sorted(zip(cosines, model.labels), reverse=True)[:15]
        if near[0][0] <= 1e-3:  # nothing like it among the labelled
            assert got[k] == model.prior
            continue
        votes = [(max(c, 1e-3) ** 8, y) for c, y in near]
        assert abs(got[k] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 0.02, k


def test_near_duplicate_recall_on_planted_pairs(spark):
    """Pairs just over the threshold, each alone: all of them are found."""
    rng, texts = np.random.default_rng(12), []
    for k in range(150):
        base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
        copy = list(base)
        at = int(rng.integers(0, 170))
        copy[at : at + 10] = [f"x{i}" for i in rng.integers(0, 10**6, 10)]
        texts += [" ".join(base), " ".join(copy)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) == 150


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    good = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").filter("n_chars between 600 and 2000").orderBy("doc_id").limit(6).collect()]
    rows = [(1, None), (2, ""), (None, good[0]), (3, good[1]), (3, good[1]), (3, good[2]), (4, good[1]), (5, " \n\n "), (6, "x" * 50_000), (None, None), (7, good[3] + "\n" + good[4])]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            made = common.checkpoint(stage(spark, frame, folder))
            assert name == "best_fit_packing" or made.columns == docs.columns
            assert made.count() == 0 if frame is not docs else True
            if frame is not docs or name == "best_fit_packing":
                continue
            kept = sorted((r.doc_id or 0, r.text or "") for r in made.collect())
            if name == "near_dedup":
                assert kept == sorted((i or 0, t or "") for i, t in rows if (i, t) != (4, good[1]))
            if name == "line_dedup":
                assert (4, good[1]) not in kept and (6, "x" * 50_000) in kept and (2, "") in kept
    packed = corpus_pipeline.best_fit_packing(spark, docs, folder)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter("n > 2048 or n <> end").isEmpty() and packed.filter("piece = 0").count() == len(rows)
