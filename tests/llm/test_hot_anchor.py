"""Operator 1: windows around one hot minimiser are dealt by their own hash."""

import random
from collections import Counter

import numpy as np

from proofsheet.llm import substring_dedup as S


def test_op1_hot_minimiser_is_dealt(spark):
    rng = random.Random(4)
    pack = lambda *h: np.array(h, np.uint64).tobytes()
    rows = [(7, i, i, 10, S.ALONE, pack(*(rng.getrandbits(64) for _ in range(5)))) for i in range(200)]
    rows += [(7, None, None, -1, S.SHARED, pack(11, 12)), (8, 1, 1, 0, S.ALONE, pack(11, 12)), (9, 2, 2, -1, S.DONE, pack(0))]
    parts = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows], S.PARTS_SQL)
    out = S.dealt(parts, 100).collect()
    groups = Counter((r.key, r.salt) for r in out)
    assert len([k for k in groups if k[0] == 7]) == 1002 and max(groups.values()) == 1
    assert sorted(r.first for r in out if r.key == 7 and r.doc_id == 3) == [10, 11, 12, 13, 14]
    assert [(r.salt, bytes(r.data)) for r in out if r.key == 8] == [(0, pack(11, 12))]


def test_op1_same_result_when_all_are_hot(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage = say(60)
    docs = spark.createDataFrame([(i, f"{say(40)} {passage if i % 3 else say(60)} {say(i)}") for i in range(60)], "doc_id long, text string").repartition(7)
    hot, cold = (sorted(map(tuple, S.substring_dedup(docs, hot_bytes=b).collect())) for b in (0, 1 << 40))
    assert hot == cold and sum(r[2] for r in hot) >= 40 * 60
