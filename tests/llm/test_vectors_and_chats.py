"""Operators 11 to 13 against plain Python, with odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofsheet.llm import chat_format as H
from proofsheet.llm import negatives as N
from proofsheet.llm import whitening as W
from proofsheet.llm.queries import op11_embedding_whitening
from proofsheet.llm.vectors import whole_vectors

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")
ROWS = "vec_id long, embedding array<float>, label int, x string, n string, count string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "n", "c") for r in rows], ROWS)


# ---------------------------------------------------------------- 11

def held(spark, rows):
    """whiten() of rows against numpy; its rows by (vec_id, component)."""
    got = W.whiten(frame(spark, rows)).collect()
    fine = [(i, [int(math.floor(256 * float(np.float32(c)))) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in fine}), dtype=float)
    n, total = len(fit), [int(t) for t in fit.sum(0)]
    c = fit - fit.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, sum(e > 1e-12 * e.sum()))
    assert len(got) == k * len(fine)
    for r in got:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    for comp in range(1, k + 1):
        rows_ = sorted((str(r.vec_id), int(r.deviation), r.whitened) for r in got if r.component == comp)
        want = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, total)), float((np.array(v) - fit.mean(0)) @ u[:, comp - 1] / math.sqrt(e[comp - 1]))) for i, v in fine)
        assert [a[:2] for a in rows_] == [b[:2] for b in want]
        sign = 1 if sum(a[2] * b[2] for a, b in zip(rows_, want)) > 0 else -1
        assert max(abs(a[2] - sign * b[2]) for a, b in zip(rows_, want)) < 1e-8
    return got


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(7) * (9, 5, 4, 3, 2, 1, 1)], 0) for i in range(80)]
    rows += rows[:30] + [(7, rows[3][1], None)]  # copies, an id of two rows
    odd = [(200, None, 1), (201, [1.0, None] + [0.0] * 5, 1), (202, [NAN] + [0.0] * 6, 1), (203, [-INF] + [0.0] * 6, 1)]
    held(spark, rows + odd + [(None, rows[5][1], 1)])


def test_whitening_of_few_vectors(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    assert len(held(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.5], 0)])) == 2
    got = W.whiten(frame(spark, [(1, [1.0], 0), (2, [3.0], 0), (3, [1.0, 2.0], 0), (4, [], 0)])).collect()
    assert {(r.vec_id, r.component) for r in got} == {(1, 1), (2, 1)}
    flat = W.whiten(frame(spark, [(i, [float(i), 0.0, -float(i)], 0) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1}


def test_whitening_of_huge_values(spark):
    got = W.whiten(frame(spark, [(1, [1e30, 1.0], 0), (2, [-1e30, 5.0], 0), (3, [0.0, 7.0], 0)])).collect()
    assert len(got) >= 3 and all(r.n == 3 for r in got)


def test_whitening_query_is_whole(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = op11_embedding_whitening(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    want = held(spark, [(r.vec_id, r.embedding, r.label) for r in rows])
    assert {(r.vec_id, r.component, r.n, r.deviation) for r in got.collect()} == {(r.vec_id, r.component, r.n, int(r.deviation)) for r in want}


@pytest.mark.parametrize(("d", "k"), [(1, 1), (2, 2), (6, 4), (40, 4), (160, 5)])
def test_pairs_to_double_precision(d, k):
    b = np.random.default_rng(d).standard_normal((d, d))
    s = b @ b.T
    values, vectors = W.leading_pairs(lambda q: s @ q, d, k)
    assert np.abs(values / np.linalg.eigvalsh(s)[::-1][:k] - 1).max() < 1e-11
    assert np.linalg.norm(s @ vectors - vectors * values, axis=0).max() < 1e-12 * values[0] * d
    equal = np.diag([3.0] * d)
    assert np.allclose(W.leading_pairs(lambda q: equal @ q, d, k)[0], 3)


# ---------------------------------------------------------------- 12

def mined(rows, positives=5, negatives=5, low=80, high=100):
    fine = [(i, label, [int(math.floor(256 * float(np.float32(c)))) for c in v], at) for at, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, label, a, at in fine:
        if i is None or i % 100:
            continue
        score = lambda r: sum(x * y for x, y in zip(a, r[2]))
        order = lambda r: (-score(r), r[0] is None, r[0] or 0, r[3])
        for p in sorted((r for r in fine if r[1] == label and r[3] != at), key=order)[:positives]:
            near = sorted((r for r in fine if r[1] != label and low * score(p) <= 100 * score(r) <= high * score(p)), key=order)[:negatives]
            out += [(i, p[0], n, r[0], score(p), score(r)) for n, r in enumerate(near, 1)]
    return sorted(out, key=repr)


def mine(df, **how):
    got = N.hard_negatives(df, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(seed, n, d=6, labels=4, step=1):
    rng = np.random.default_rng(seed)
    return [(i * step, [round(float(x), 1) for x in rng.standard_normal(d)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 40}, {"bucket_rows": 13, "chunk_rows": 2}])
def test_negatives_with_ties_and_odd_rows(spark, how):
    rows = vectors(2, 300, step=10)
    rows += [(900, rows[3][1], 1)] * 3 + [(i, rows[0][1], 2) for i in range(5)] + [(None, rows[1][1], 0), (None, rows[1][1], 1)]
    rows += [(1100, None, 1), (1200, rows[4][1], None), (1300, [NAN] * 6, 1), (1400, [None] * 6, 1), (1500, [0.0] * 6, 1), (1600, [1.0], 1)]
    assert mine(frame(spark, rows).coalesce(1), **how) == mined(rows[:-1])


def test_negatives_with_one_hot_label_and_copies(spark):
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in vectors(5, 400, labels=7)] + [(400 + i, [1.0] * 6, 1) for i in range(300)]
    assert mine(frame(spark, rows).coalesce(1), bucket_rows=64) == mined(rows)


def test_negatives_of_large_values_are_exact(spark):
    rows = [(i, [float(2**22 + 3 * i), -float(2**21 + 5 * i), 1.0], i % 3) for i in range(0, 400, 5)]
    assert mine(frame(spark, rows).coalesce(1)) == mined(rows)
    assert mine(frame(spark, [(0, [1e30], 0), (1, [1e30], 0), (2, [1e30], 1)])) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_negatives_of_nothing(spark):
    assert mine(frame(spark, [])) == []
    assert mine(frame(spark, [(0, [1.0], 1)])) == []
    assert mine(frame(spark, [(0, [1.0], 1), (100, [2.0], 2)])) == []


def test_sorted_access_stops_early():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((4000, 2)) * 100)
    rows, scores = N.Lists(x).met(np.array([3.0, -2.0]), lambda s, t: len(s) >= 5 and t < N.kth(s, 5), INF)
    assert len(rows) < 1000 and sorted(scores)[-5:] == sorted(x @ np.array([3.0, -2.0]))[-5:]


# ---------------------------------------------------------------- 13

TURNS = "conv_id long, turn long, role string, text string, segment string, place string, own string"
WILD = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<s", "[[INST]", " ", "", "a\n\nb", "<</s>", "x [/SYS]", "\U0001f600[ROLE] \\\\[/ROLE]", "<s>[SYS] </s> [/SYS]"]


def talk(spark, rows):
    return spark.createDataFrame([(*r, "s", "p", "o") for r in rows], TURNS)


def read(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(x[3] for x in own if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[conv] = (len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)), len(said), sha(said), len(H.instruct_template([(x[2], x[3]) for x in own])), 0)
    return want


def test_escapes_read_back():
    for text in [*WILD, "".join(WILD)]:
        assert H.unescaped(H.escaped(text)) == text
        assert not any(c in H.escaped(text) for c in H.CONTROLS)
    messages = [(role, text) for text in WILD for role in ("system", "user", "assistant", "tool", "", "x [/ROLE] ")]
    assert H.read_turns(H.instruct_template(messages)) == messages


@pytest.mark.parametrize("segment", [64, 3])
def test_chats_read_back(spark, segment):
    rows = [(c, t, ("system", "user", "assistant", "user", "assistant", "tool", None)[(t + c) % 7], WILD[(3 * t + c) % len(WILD)]) for c in range(6) for t in range(4 + 9 * c)]
    rows += [(2, 1, "user", None), (2, None, "assistant", "last"), (None, 0, "assistant", "nobody's"), (9, 0, None, None), (10, 5, "assistant", "long " * 50_000)]
    rows += [(11, 7, "assistant", "same")] * 9
    got = H.read_back(H.format_chats(talk(spark, rows), segment=segment))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == read(rows)
    assert H.read_back(H.format_chats(talk(spark, []))).collect() == []


def test_one_conversation_of_most_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)] + [(c, 0, "user", "hi") for c in range(2, 300)]
    out = H.format_chats(talk(spark, rows).repartition(7))
    assert {r[0]: tuple(r)[1:] for r in H.read_back(out).collect()} == read(rows)
    assert out.filter("conv_id = 1").count() == math.ceil(3000 / H.SEGMENT) and out.agg(F.max(F.size("turns"))).first()[0] == H.SEGMENT


def flagged(spark, template, n=9, segment=64):
    rows = [(1, t, ("user", "assistant")[t % 2], f"word {t}") for t in range(n)]
    out = H.format_chats(talk(spark, rows), template, segment=segment).orderBy("segment").collect()
    return out, [t.rewrites for r in out for t in r.turns]


def test_templates_that_rewrite_history(spark):
    plain = lambda m: "".join(f"<{r}>{t}" for r, t in m)
    out, flags = flagged(spark, plain, segment=4)
    assert not any(flags) and "".join(r.formatted for r in out) == plain([(("user", "assistant")[t % 2], f"word {t}") for t in range(9)])
    assert [r.formatted[t.loss_start:t.loss_end] for r in out for t in r.turns if t.loss_start is not None] == [f"word {t}" for t in (1, 3, 5, 7)]
    closing = lambda m: plain(m) + "<end>"
    out, flags = flagged(spark, closing)
    assert not any(flags) and [out[0].formatted[t.start:t.end] for t in out[0].turns][3] == "<assistant>word 3"
    last_only = lambda m: "".join(f"<{r}>{t if i == len(m) - 1 else '...'}" for i, (r, t) in enumerate(m))
    assert flagged(spark, last_only)[1] == [False] + [True] * 8
    counting = lambda m: "".join(f"{i}:{t};" for i, (_, t) in enumerate(m))
    assert flagged(spark, counting, segment=4)[1] == [False] * 4 + [True] + [False] * 3 + [True]


def test_whole_vectors_take_the_common_length(spark):
    rows, d = whole_vectors(frame(spark, [(1, [1.0], 0), (2, [1.0, -0.001], 0)]), {"i": F.col("vec_id")}, "embedding")
    assert d == 2 and [tuple(r) for r in rows.collect()] == [(2, [256, -1])]
