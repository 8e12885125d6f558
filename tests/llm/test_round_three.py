"""Embedding near-dedup, importance resampling and collocations against plain loops, and their odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logfacts.llm import collocations, embedding_dedup, importance

V = "vec_id long, embedding array<float>"


def linked(rows, cosine=0.9):
    """(links, component) of every row of (id, vector) by a plain loop; a shorter vector is filled up with zeros."""
    size = max((len(v) for _, v in rows if v), default=1)
    unit = []
    for _, v in rows:
        sound = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        full = np.array([*v, *[0.0] * (size - len(v))]) if sound else None
        unit.append(full / np.linalg.norm(full) if sound else None)
    near = [[i != j and a is not None and b is not None and float(a @ b) >= cosine for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    label = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            best = min([label[i], *(label[j] for j in range(len(rows)) if near[i][j])])
            moved, label[i] = moved or best < label[i], best
    return [(rows[i][0], sum(near[i]), label[i]) for i in range(len(rows))]


def clustered(seed, groups, size=8):
    """Tight and loose groups around random centres, copies, and single vectors."""
    rnd, out = np.random.default_rng(seed), []
    for n, spread in groups:
        centre = rnd.normal(size=size)
        out += [(centre + spread * rnd.normal(size=size)).astype(np.float32).tolist() for _ in range(n)]
    out += [out[0]] * 3
    ids = rnd.permutation(10 * len(out))[: len(out)]
    return [(int(i), v) for i, v in zip(ids, out, strict=True)]


@pytest.mark.parametrize("settings", [{}, {"per_cell": 20, "block": 8}, {"per_cell": 7, "block": 3, "sample": 60}])
def test_embedding_links_match_a_plain_loop(spark, settings):
    rows = clustered(4, [(60, 0.02), (40, 0.35), (30, 0.6), (40, 0.15), *[(1, 0.0)] * 40])
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, V), **settings)
    assert sorted((r.id, r.n_links, r.component) for r in found.collect()) == sorted(linked(rows))


def test_cores_are_counted_and_not_compared(spark):
    """A group of near copies gives one row each to the tasks that compare, or none."""
    rows = clustered(5, [(500, 0.01)])
    classes = spark.createDataFrame([(i, 1, list(v)) for v, i in {tuple(v): i for i, v in rows}.items()], "id long, weight long, vec array<double>")
    unit = embedding_dedup.matrix(classes.select("vec").toArrow().column("vec"), 8)
    cells = embedding_dedup.Cells(embedding_dedup.centres(unit, 1), 0.9, 16)
    at = embedding_dedup.placed(classes, cells)
    cells.count(at.groupBy("cell", "core").agg(F.count("*").alias("held"), F.sum("weight").alias("weight"), F.min("angle").alias("least"), F.max("angle").alias("widest"), F.min("id").alias("first")).collect())
    assert cells.rows.tolist() == [[500], [0]]
    assert embedding_dedup._dealt(at, cells).count() == 0
    assert embedding_dedup._settled(at, cells).agg(F.sum("links")).first()[0] == 500 * 499


def test_embedding_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [0.0, 1.0, 1e-9]), (10, [0.0, 1.0, 1e-9]), (12, [-1.0, 0.0]), (13, [1e-30, 0.0])]
    df = spark.createDataFrame(rows, V).withColumns({"id": F.lit("x"), "component": F.lit(1), "key": F.lit("k"), "weight": F.lit(None)})
    found = sorted((r.id, r.n_links, r.component) for r in embedding_dedup.near_duplicates(df).collect())
    assert found == sorted(linked(rows))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0])], V)).count() == 0
    assert embedding_dedup.op11(spark.createDataFrame([], V)).count() == 0
    assert embedding_dedup.op11(spark.createDataFrame([(7, None)], V)).collect()[0].asDict() == {"vec_id": 7, "n_links": 0, "component_id": 7, "kept": True}
    kept = embedding_dedup.representatives(df)
    assert kept.columns == df.columns and {r.vec_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 10, 12}


# --- importance resampling ----------------------------------------------------------------------------------------

D = "doc_id long, text string"


def plain_draw(docs, target, longest, buckets, percent, least):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    keep = lambda c: c.isascii() and (c.isdigit() or "a" <= c <= "z") or not c.isascii()
    words = lambda t: "".join(c if keep(c) else " " for c in low(t)).split(" ")

    def features(t):
        w = [x for x in words(t) if x]
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for _, text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in docs:
        if i is None:
            continue
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return sorted(tuple(r[:5]) for r in out if r)


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10000, 10, 3), (3, 17, 50, 0), (2, 1, 100, 5)])
def test_importance_matches_a_plain_loop(spark, longest, buckets, percent, least):
    rnd = random.Random(longest)
    vocabulary = ["the", "The", "x1", "été", "don't", "a-b", "Ünder", "42", "语言", "a\x00b", "q r"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", ".", "\t", "\n"]) for _ in range(n))
    docs = [(i, text(rnd.randrange(12))) for i in range(150)] + [(151, None), (152, ""), (153, "..."), (7, text(9)), (7, text(9)), (None, text(5)), (160, text(20000))]
    target = [(i, text(30)) for i in range(5)] + [(9, None)]
    got = importance.weighed(spark.createDataFrame(docs, D), spark.createDataFrame(target, D), longest=longest, buckets=buckets, percent=percent, least_words=least)
    assert sorted((tuple(r) for r in got.select("id", "n_features", "weight", "score", "rank").collect()), key=str) == sorted(plain_draw(docs, target, longest, buckets, percent, least), key=str)


def test_importance_odd_tables(spark):
    none = spark.createDataFrame([], D)
    some = spark.createDataFrame([(i, "word " * 30) for i in range(20)], D)
    assert importance.op12(none, some).count() == 0
    assert {r.weight for r in importance.op12(some, none).collect()} == {math.floor(1000 * math.log(10600 / (601 * 10000)))}
    clash = some.withColumns({"score": F.lit("x"), "rank": F.lit(1), "id": F.lit(2), "bucket": F.lit(3)})
    drawn = importance.resampled(clash, some)
    assert drawn.columns == clash.columns and drawn.count() == 2


# --- collocations -------------------------------------------------------------------------------------------------

L = "text string, lang string"


def plain_collocations(docs, longest, least, percent, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if " " in p and a >= least}
        rows = []
        for p, a in held.items():
            w = p.split(" ")
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= percent * a for q, b in held.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            rows.append((p, a, l, r, n[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "every", "most", "bits", "top"), [(4, 3, 16, 64, 26, 2000), (4, 2, 2, 3, 6, 40), (3, 4, 1, 1, 10, 5), (2, 2, 1000, 2, 26, 2000)])
def test_collocations_match_a_plain_loop(spark, longest, least, every, most, bits, top):
    rnd = random.Random(every)
    vocabulary = ["the", "of", "New", "York", "été", "a\x1fb", "語", "x", "city", "-"]
    passage = "in the New York city of New York.\nthe the the the the"
    text = lambda: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", "\t", "\n", ";!"]) for _ in range(rnd.randrange(40)))
    docs = [(text(), rnd.choice(["en", "fr", None])) for _ in range(60)] + [(passage, "en")] * 9 + [(None, "fr"), ("", "xx"), ("the " * 500, None), (" , ;", "en")]
    got = collocations.collocations(spark.createDataFrame(docs, L), top=top, longest=longest, least=least, every=every, most=most, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs, longest, least, 80, top)


def test_chunks_tile_a_piece_and_overlap():
    rnd = random.Random(1)
    words = [rnd.choice([b"a", b"bb", b"c", b"dd"]) for _ in range(300)]
    found = list(collocations.chunks(words, 4, 4, 10))
    assert b" ".join(own for own, _ in found).split(b" ") == words
    at = 0
    for own, rest in found:
        at += len(own.split(b" "))
        assert rest.split(b" ") == words[at : at + 3] or (rest == b"" and at == len(words))
        assert len(own.split(b" ")) <= 10


def test_collocations_odd_tables(spark):
    assert collocations.op13(spark.createDataFrame([], L)).count() == 0
    clash = spark.createDataFrame([("new york", "en")] * 40, L).withColumns({"phrase": F.lit(1), "f": F.lit(2), "own": F.lit(3), "rank": F.lit(4)})
    assert [tuple(r) for r in collocations.op13(clash).collect()] == [("en", 1, "new york", 40, 40, 40, 80, 1000000)]


def test_large_counts_are_exact(spark):
    big = 2**62
    found = spark.createDataFrame([("en", None, 1, big), ("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, size int, f long")
    assert collocations.candidates(found).first().score == 2000000 * (big - 1) // (2 * big)
