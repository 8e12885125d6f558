import hashlib
import random
from collections import Counter

import numpy as np

from logfacts.llm import suffix_array
from logfacts.llm.suffix_array import Depth, op7, prints, strip

SCHEMA = "doc_id long, text string, id string"


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(t)]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone.tolist(), strict=True) if not g)
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_prints_of_equal_strings_agree():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcd ") for _ in range(300))
    found = []
    for lead in (17, 250):
        data = np.frombuffer(bytes(rng.choice(b"wxyz") for _ in range(lead)) + shared + b"q" * 40, np.uint8)
        got = prints(np.concatenate([np.frombuffer(b"n" * lead, np.uint8), data]), np.array([0, lead, lead + len(data)]), 200)
        mine = got.text == 1
        found.append(np.repeat(got.key[mine], (got.last - got.first)[mine])[lead : lead + 101].tolist())
    assert found[0] == found[1]


def test_depth_covers_the_string():
    for length in range(64, 400):
        d = Depth(length)
        assert d.whole % 3 == 0 and 2 <= d.rest <= 4 and all(s % 3 == 0 for s in d.three) and d.three[2] + d.word == d.whole
        assert d.three[1] <= d.word and d.three[2] - d.three[1] <= d.word


def test_matches_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioubcdé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60), prose(45), "Ha " * 120]
    rows = []
    for i in range(40):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 60) :], prose(rng.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, ""), (53, None), (54, "x" * 199), (55, "y" * 200), (56, "z" * 201), (57, prose(3000)), (58, passages[0] + " " + passages[0])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows] + [(None, "no id", "")], SCHEMA)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in op7(df).collect())
    assert got == brute([(d, (t or "").encode()) for d, t in rows], 200)


def test_empty_and_repeated_rows(spark):
    assert op7(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"word{i}" for i in range(60))
    rows = strip(spark.createDataFrame([(1, text, ""), (1, text, "")], SCHEMA)).collect()
    assert [(r.n_removed, r.n_spans) for r in rows] == [(len(text), 1)] * 2


def test_copies_that_share_nothing_else_are_sorted(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(700)) for _ in range(3)]
    sent, blocks = [], suffix_array._blocks
    monkeypatch.setattr(suffix_array, "_blocks", lambda chunks: sent.extend(chunks.select("starts", "count").collect()) or blocks(chunks))
    rows = [(i, texts[i % 3]) for i in range(8)] + [(9, "q" + texts[0][::-1])]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in op7(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA)).collect())
    assert got == brute([(d, t.encode()) for d, t in rows], 200)
    # each text's 501 starts reach the sort once, with its number of copies
    assert sum(r["starts"] for r in sent) == 3 * 501 and {r["count"] for r in sent} == {2, 3}
