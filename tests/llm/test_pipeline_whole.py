"""run() against plain Python and SQL, stage after stage: rules by their SQL twin, lines and near copies by brute force, ids by the tokenizers library.

Spans of personal data come from the operator (its trees have no twin; its base spans are tested elsewhere).
"""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np

from proofsheet.llm import pii, sql

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def without_boilerplate(docs):
    lines = lambda t: (t or "").split("\n")
    pages, held = Counter(d[2] for d in docs), Counter()
    for _, text, source in docs:
        held.update({(source, line.strip(SPACE)) for line in lines(text)})
    gone = {k for k, n in held.items() if k[1] and n >= 5 and n > 0.1 * pages[k[0]]}
    return [(i, "\n".join(x for x in lines(t) if (s, x.strip(SPACE)) not in gone), s) for i, t, s in docs]


def one_of_each_group(docs):
    sets = {}
    for i, text, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return [d for d in docs if root(d[0]) == d[0]]


def test_run(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.OP4}) WHERE kept").fetchall()}
    docs = [d for d in con.execute("SELECT doc_id, text, source FROM documents").fetchall() if d[0] in good]
    docs = one_of_each_group(without_boilerplate(docs))
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {i: [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in clean.items()}

    got, packed = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        packed[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for i, ids in want.items():
        cuts = range(0, len(ids), 4096)
        assert sorted(got[i]) == [(n, c, len(ids[c:c + 4096]), zlib.crc32(np.array(ids[c:c + 4096], "<u4").tobytes())) for n, c in enumerate(cuts)]
    for pieces in packed.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    total = sum(map(len, want.values()))
    assert len(packed) <= total / 4096 * 1.05 + 1
