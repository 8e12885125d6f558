import random

import numpy as np
import pytest

from logfacts.llm import sentence_pieces

ALPHABET = "ab1 2\n▁_²³½.,!é日本🙂\t\u0301٣Ⅷ\x00-"


def some_texts(seed, n=40):
    pick = random.Random(seed)
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.choice([0, 1, 2, 5, 60]))) for _ in range(n)]


def plain(texts, pattern):
    known = sentence_pieces._numbers()
    found = [[known[w] for w in sentence_pieces.split(t, pattern)] for t in texts]
    return [len(x) for x in found], [y for x in found for y in x], list(known)


def numbered(texts, pattern):
    known = sentence_pieces._numbers()
    sizes, codes = sentence_pieces._numbered(texts, pattern, known, np.full(0x110000, 255, np.uint8))
    return sizes.tolist(), codes.tolist(), list(known)


@pytest.mark.parametrize("pattern", sentence_pieces._WORDS)
def test_words_of_many_texts_are_numbered_at_once(monkeypatch, pattern):
    texts = [some_texts(seed) for seed in range(50)] + [["a" + chr(c) + "1" + chr(c) * 2 + "." + chr(c) + "b" for c in range(1, 0x3000)]]
    wanted = [plain(t, pattern) for t in texts]
    monkeypatch.setattr(sentence_pieces, "split", None)  # not taken, as it cuts one text after another
    assert [numbered(t, pattern) for t in texts] == wanted


def test_words_of_equal_hash_stay_apart(monkeypatch):
    texts, pattern = ["abc abd abcd", "", "abe abc ab"], sentence_pieces.word_pattern()
    wanted = plain(texts, pattern)
    monkeypatch.setattr(sentence_pieces, "BASE", 0)
    assert numbered(texts, pattern) == wanted


def test_edges_are_folded_without_being_grouped(spark):
    """Grouping sorted all edges of a task and folding them by lambdas took most of the time: 266 of 532 s of tasks on 0.5 GB."""
    words = spark.createDataFrame([("internationalization",), ("▁the",), ("▁the",), ("🙂",)], "word string")
    encoded = sentence_pieces.encode_words(words)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan and "Join" in plan
    assert sorted(r.word for r in encoded.collect()) == sorted(["internationalization", "▁the", "🙂"])


def test_edges_of_a_task_in_any_order(spark):
    texts = [w for t in some_texts(7, 200) for w in sentence_pieces.split(t) if len(w) <= sentence_pieces.LONGEST] + ["▁internationally", "x" * 48]
    edges = sentence_pieces._lattice(spark.createDataFrame([(t,) for t in texts], "word string").repartition(1), sentence_pieces.MODEL).toArrow()
    turned = edges.take(np.random.default_rng(5).permutation(edges.num_rows))

    def told(table):
        return {w: i for b in sentence_pieces._folded(iter(table.to_batches(100))) for w, i in zip(b.column("word").to_pylist(), b.column("ids").to_pylist(), strict=True)}

    assert told(edges) == told(turned) and set(told(edges)) == set(texts)


def test_a_long_text_among_short_ones(spark):
    once, more = "ab 12\n", 3 * sentence_pieces.SLICE // 6
    rows = [(1, once), (2, once * 2), (3, once * more), (4, ""), (5, None), (6, once)]
    got = {r.doc_id: r for r in sentence_pieces.op9(spark.createDataFrame(rows, "doc_id long, text string")).drop("ids").collect()}
    step = got[2].n_tokens - got[1].n_tokens
    assert got[3].n_tokens == got[1].n_tokens + (more - 1) * step and got[6].n_tokens == got[1].n_tokens and got[4].n_tokens == got[5].n_tokens == 0
    assert all(r.round_trip for r in got.values())
