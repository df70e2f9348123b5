"""Operator 8: unchecked spellings are found whatever their number, and dates stay."""

import random

from proofsheet.llm import pii


def test_op8_many_unchecked_numbers(spark):
    """Far more national phones and obfuscated mails than checked spans: each is found, no date is."""
    rng = random.Random(3)
    d = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    rows, want = [], {}
    for i in range(400):
        phone, mail = f"({d(3)}) {d(3)}-{d(4)}", f"ana{i} [at] post{i} [dot] org"
        rows.append((i, f"word{'s' * (i % 7)} {phone} then {mail} so on"))
        want[i] = {("phone", phone), ("email", mail)}
    for i in range(400, 800):
        rows.append((i, f"on 2024-0{1 + i % 9}-1{i % 10} 1{i % 10} and 1{i % 9}.0{1 + i % 9}.2019, {1950 + i % 50}-{2000 + i % 25} too"))
        want[i] = set()
    rows += [(i, f"call +1 (555) 010-{1000 + i} soon") for i in range(800, 840)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, got = dict(rows), {i: set() for i in want}
    for r in pii.find_pii(docs).filter("doc_id < 800").collect():
        got[r.doc_id].add((r.kind, text[r.doc_id][r.start:r.end]))
    assert got == want


def test_op8_calibration_is_by_level():
    class Score:
        def score(self, x):
            return x[0]

    # cumulatively 0.9 holds down to the second level, whose own share is a half
    assert pii.calibrated(Score(), [((2,), 900, 0), ((1,), 50, 50)], 0.9) == 2
    # a rare sure level is as good as a frequent one
    assert pii.calibrated(Score(), [((2,), 30, 0), ((1,), 9000, 100)], 0.9) == 1
