"""What bounds must not change: ranges of ids, and a fitting sample of bounded size."""

import random

from pyspark.sql import functions as F

from proofsheet.llm import fingerprints, lm_scoring


def test_ranges_rise_with_ids_at_any_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.randrange(-(2**62), 2**62), rng.randrange(5), None]), str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_key"))
    for parts in (1, 2, 7, 300):
        out, most = fingerprints.with_ranges(df, parts)
        got = out.collect()
        assert len(got) == len(rows) and out.columns == ["doc_id", "text_key", "part"]
        own = sorted((r.doc_id, r.part) for r in got if r.doc_id is not None)
        assert [p for _, p in own] == sorted(p for _, p in own) and len({p for _, p in own}) <= most
        if parts == 300:
            assert len({p for _, p in own}) > 100  # a third of the ids lie on five values, which are not parted
        none = sorted((r.text_key, r.part) for r in got if r.doc_id is None)
        assert all(p < 0 for _, p in none) and [p for _, p in none] == sorted(p for _, p in none)


def test_few_ranges_and_many_are_alike(spark):
    rows = [(i * 7 % 40, f"doc {i} " + "w%d " % i * (i % 9)) for i in range(60)] + [(None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, fingerprints.edited_fingerprints(df, range_bytes=b).collect()), key=repr) for b in (1 << 30, 20))
    assert one == many


def test_end_is_unknown_without_training_documents(spark):
    held = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 10 == 0]
    got = lm_scoring.lm_scores(spark.createDataFrame([(held[0], "a b")], "doc_id long, text string")).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (True, 3, 0, 0)


def test_copies_weigh_once_in_the_fit(spark):
    taught = [i for i in range(2000) if __import__("zlib").crc32(str(i).encode()) % 10 != 0]
    texts = [f"the {i} of the {i * i % 97} and the rest " * 12 for i in range(40)]
    rows = [(i, texts[n % 40] if n % 3 else texts[0]) for n, i in enumerate(taught[:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fitted = lm_scoring.fitted

    def spy(sample, shared):
        seen.append([r.text for r in sample.collect()])
        return fitted(sample, shared)

    lm_scoring.fitted = spy
    try:
        lm_scoring.lm_scores(df, fit_rows=10).count()
    finally:
        lm_scoring.fitted = fitted
    assert len(seen[0]) == 10 == len(set(seen[0]))


def test_weights_are_fitted_on_every_training_text(spark):
    taught = [i for i in range(6000) if __import__("zlib").crc32(str(i).encode()) % 10 != 0][:5000]
    df = spark.createDataFrame([(i, f"w{i} a") for i in taught], "doc_id long, text string")
    seen = []
    fitted = lm_scoring.fitted

    def spy(texts, shared):
        seen.append(texts.distinct().count())
        return fitted(texts, shared)

    lm_scoring.fitted = spy
    try:
        lm_scoring.lm_scores(df).count()
    finally:
        lm_scoring.fitted = fitted
    assert seen == [5000]


def test_places_are_those_of_a_sorted_search():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 255, 5000):
        held = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        asked = np.concatenate((held, rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
        for bits in (4, 16):
            got = lm_scoring.Places(held, bits).of(asked)
            assert (got == np.minimum(np.searchsorted(held, asked), max(0, len(held) - 1))).all()
