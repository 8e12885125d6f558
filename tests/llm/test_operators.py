import hashlib
import random
import re
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from logfacts.llm import chat, gif, language_id, mixing, sentence_pieces, topk, toxicity, warc

rng = random.Random(3)
SF = "/root/testdata/sf0.001"


# --- chat --------------------------------------------------------------------------------------------------------


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, action string")
    return chat.repair(df).orderBy("position").collect()


def test_chat_is_legal_and_cheapest(spark):
    roles = ["system", "user", "assistant", "User ", "tool", None]
    convs = {c: [rng.choice(roles) for _ in range(rng.randint(1, 6))] for c in range(60)}
    rows = [(c, i, r, f"t{i}", "x") for c, rs in convs.items() for i, r in enumerate(rs)] + [(None, 1, "user", "lost", "x")]
    got = repaired(spark, rows)
    assert len(got) == len(rows) - 1
    for c, rs in convs.items():
        mine = [r for r in got if r.conv == c]
        text = "".join(r.rendered for r in mine)
        turns = [p.split("\n", 1)[0] for p in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>\n")
        assert turns[-1] == "assistant" and all(b in [chat.ROLES[s - 1] for s in chat.NEXT[chat.ROLES.index(a) + 1]] for a, b in zip(turns, turns[1:], strict=False)) and turns[0] in ("system", "user")
        known = [r.strip().lower() if r else None for r in rs]
        cost = sum(chat.INSERT * r.inserted + {"keep": 0, "relabel": chat.RELABEL if k in chat.ROLES else chat.RELABEL_UNKNOWN, "merge": chat.MERGE if k == r.new_role or k not in chat.ROLES else chat.MERGE_OTHER}[r.action] for k, r in zip(known, mine, strict=True))
        assert cost == chat.cheapest(known)
        for i in range(len(rs)):
            assert text.count(f"t{i}") == 1


def test_chat_does_not_depend_on_the_cuts(spark):
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system", None]), f"text {i}", "x") for i in range(400)]
    one = [r.rendered for r in repaired(spark, rows)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [r.rendered for r in repaired(spark, rows)] == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert repaired(spark, []) == []


# --- GIF ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2, 4, 8])
def test_lzw_round_trip(size):
    for n in (0, 1, 2, 63, 5000, 40000):
        for data in (bytes(rng.randrange(1 << size) for _ in range(n)), bytes(n), bytes(i // 7 % (1 << size) for i in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data, size), size) == data


def _gif(frames, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), size=(4, 2)):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(v for c in palette for v in c)
    for x, y, w, h, pixels, delay, disposal, clear, interlace in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
        stream = gif.lzw_encode(bytes(pixels), 2)
        out += struct.pack("<BHHHHB", 0x2C, x, y, w, h, 0x40 if interlace else 0) + b"\x02" + bytes([len(stream)]) + stream + b"\x00"
    return out + b";"


def test_gif_disposal_transparency_interlace(spark):
    media = _gif([(0, 0, 4, 2, [1] * 8, 5, 0, None, False), (1, 0, 2, 1, [2, 3], 7, 2, 3, False), (0, 1, 2, 1, [3, 3], 1, 3, None, False), (3, 1, 1, 1, [2], 2, 0, None, False)])
    seen = [(f.start_ms, f.delay_ms, f.canvas.copy()) for f in gif.decode(media)]
    assert [s[:2] for s in seen] == [(0, 50), (50, 70), (120, 10), (130, 20)]
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert tuple(seen[1][2][0, 1]) == green and tuple(seen[1][2][0, 2]) == red
    assert tuple(seen[2][2][0, 1]) == (0, 0, 0, 0) and tuple(seen[2][2][1, 0]) == blue
    assert tuple(seen[3][2][1, 0]) == red and tuple(seen[3][2][1, 3]) == green
    rows = [i % 4 for i in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    inter = next(gif.decode(_gif([(0, 0, 1, 9, [rows[i] for i in order], 0, 0, None, True)], size=(1, 9))))
    assert inter.indexes[:, 0].tolist() == rows
    df = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"nope"))], "id long, media binary")
    frames = gif.frames(df, skip_bad=True).orderBy("frame").collect()
    assert [(r.id, r.frame, r.delay_ms, sum(r.histogram)) for r in frames] == [(1, 0, 50, 8), (1, 1, 70, 8), (1, 2, 10, 6), (1, 3, 20, 6)]
    for cut in range(len(media)):
        with pytest.raises(gif.BadGif):
            list(gif.decode(media[:cut]))
    cuts = spark.createDataFrame([(n, bytearray(media[:n])) for n in (0, 15, 27, 40)], "id long, media binary")
    assert gif.frames(cuts, skip_bad=True).count() == len(gif.frames(cuts, skip_bad=True).select("id", "frame").distinct().collect())


def test_gif_storage(spark):
    import zlib

    texts = ["", None, "a", "x" * 64, "é" * 5000, "".join(chr(rng.randrange(32, 900)) for _ in range(40000))]
    got = {r.doc_id: r for r in gif.op6(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# --- top-k -------------------------------------------------------------------------------------------------------


def test_top_k_edge_cases(spark):
    rows = [(i, [float(rng.choice([-1, 0, 0.5, 0.25])) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1050, [float("nan"), 1.0]), (1100, [1.0, None]), (1150, [1e6, -1e6, 3.0, 0.1]), (1200, []), (None, [1.0]), (7, [9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != i)[:5]
            want[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    got = {}
    for r in topk.op8(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == want
    assert topk.op8(df.where("false")).count() == 0


def test_top_k_rounds_large_numbers_and_elimination(spark):
    rows = [(i, [rng.gauss(0, 1) * 2.0**e for e in (0, 20, 29, -8)] if i % 3 else [float(i), 1e9, -2.0, 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    whole = {i: [int(np.floor(x)) for x in v] for i, v in rows}
    got = {}
    for r in topk.top_k(df, F.col("id") % 5 == 0, k=3, scale=1.0, pivots=4, round_size=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    for q in range(0, 400, 5):
        want = sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), j) for j, w in whole.items() if j != q)[:3]
        assert [got[q][i + 1] for i in range(3)] == want
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "id long, vector array<double>"), F.col("id") == 2)
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(spark.createDataFrame([(1, [1e16]), (2, [1e16])], "id long, vector array<double>"), F.col("id") == 2)
    # clustered vectors: bounds spare most of the pairs
    centres = np.array([[rng.gauss(0, 900) for _ in range(16)] for _ in range(40)])
    x = np.array([[int(c + rng.gauss(0, 20)) for c in centres[i % 40]] for i in range(4000)])
    table = topk._distances(x, centres[:16].astype(np.int64))
    asked = topk.Asked(np.arange(80), x[:80], table[:80], 5)
    topk.search([asked], [(np.arange(a, a + 1000), x[a : a + 1000], table[a : a + 1000]) for a in range(0, 4000, 1000)])
    assert [b[0] for b in asked.best] == [min((-int(x[i] @ x[j]), j) for j in range(4000) if j != i) for i in range(80)]
    assert asked.scored < 0.6 * 80 * 4000


# --- WARC --------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_edge_cases(spark):
    big = "<p>" + "héllo " * 400
    rows = [(i, f"http://x/{i}", big) for i in range(30)] + [(50, None, None), (51, "u r l", ""), (52, "v", "short"), (53, "v", "short"), (60, "w", "z" * 300000)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows] + [(None, "n", "x", 1)], "page_id long, url string, html string, digest int").repartition(3)
    got = {r.page_id: r for r in warc.op3(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 29
        assert tuple(got[i])[:5] == (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 29 if revisit else None)
    assert warc.op3(df.where("false")).count() == 0


def test_warc_validation():
    good = warc.record("response", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    lead, zip_ = warc.dictionary_frame(b""), zstandard.ZstdCompressor().compress
    assert [b for _, b in warc.read_archive(lead + zip_(good) + zip_(good))] == [b"abc", b"abc"]
    for bad in (good.replace(b"Length: 3\r\n\r\n", b"Length: 4\r\n\r\n"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"abc\r", b"abd\r"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(lead + zip_(bad)))
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(lead + zip_(good)[:-3]))


# --- SentencePiece -----------------------------------------------------------------------------------------------


def test_pieces_match_brute_force(spark):
    texts = ["Hello world", "  two  spaces ", "", None, "naïve\n\nline\tüber 日本語 🙂", "aaaa" * 60, "the the the", "x" * 500 + " end"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in sentence_pieces.op9(df).collect()}
    pieces, _, zero = sentence_pieces.load()
    table, least = {p: (i, s) for i, p, s in pieces}, min(s for _, _, s in pieces) - sentence_pieces.UNKNOWN_PENALTY
    for i, t in enumerate(texts):
        ids = []
        for word in sentence_pieces.split(t or ""):
            best = [(0.0, 0, [])]
            for end in range(1, len(word) + 1):
                ways = []
                for a in range(max(0, end - 48), end):
                    piece = word[a:end]
                    if piece in table:
                        ways.append((best[a][0] + table[piece][1], -a, [*best[a][2], table[piece][0]]))
                    elif end - a == 1:
                        ways.append((best[a][0] + least, -a, [*best[a][2], *(b + zero for b in piece.encode())]))
                best.append(max(ways))
            ids += best[-1][2]
        assert list(got[i].ids) == ids and got[i].round_trip and got[i].n_tokens == len(ids)
    back = {r.id: r.text for r in sentence_pieces.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got.values()], "id long, ids array<int>")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert sentence_pieces.op9(df.where("false")).count() == 0


def test_words_without_spaces_are_encoded_whole(spark):
    """Against a Viterbi over the whole run of characters, so that a cut at any fixed place shows."""
    pick = random.Random(5)
    words = ["internationalization" * 40, "x" * 500, "".join(pick.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(2000)), "".join(pick.choice("日本語中文的是不了人我在有他这为之大来以个") for _ in range(700)), "m" * 49, "n" * 48, "ation" * 29]
    rows = [(i, w) for i, w in enumerate(words)] + [(90, f"see {words[0]} and\n{words[2]}"), (91, words[0])]
    got = {r.doc_id: r for r in sentence_pieces.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pieces, _, zero = sentence_pieces.load()
    table, least = {p: (i, s) for i, p, s in pieces}, min(s for _, _, s in pieces) - sentence_pieces.UNKNOWN_PENALTY
    for i, text in rows:
        ids = []
        for word in re.findall("▁*[^▁\n]+|▁+|\n+", "▁" + text.replace(" ", "▁")):
            best = [(0.0, 0, [])]
            for end in range(1, len(word) + 1):
                ways = []
                for a in range(max(0, end - 20), end):
                    piece = word[a:end]
                    if piece in table:
                        ways.append((best[a][0] + table[piece][1], -a, [table[piece][0]]))
                    elif end - a == 1:
                        ways.append((best[a][0] + least, -a, [b + zero for b in piece.encode()]))
                best.append(max(ways))
            at, taken = len(word), []
            while at:
                taken.append(best[at][2])
                at = -best[at][1]
            ids += [x for part in reversed(taken) for x in part]
        assert list(got[i].ids) == ids and got[i].round_trip and got[i].n_tokens == len(ids), i


# --- mixing ------------------------------------------------------------------------------------------------------


def test_rates_reach_the_targets(spark):
    members = [(i, rng.randint(0, 500), p, 1.0 - p) for i, p in enumerate(rng.random() for _ in range(500))]
    df = spark.createDataFrame(members, "id long, tokens long, p_0 double, p_1 double")
    found, residual = mixing.rates(df, [0.7, 0.3])
    rows = found.collect()
    total = sum(r.tokens for r in rows)
    share = sum(r.tokens * r.rate * r.p_0 for r in rows) / total
    assert abs(share - 0.7) < 2e-3 and max(map(abs, residual)) < 1e-3 and min(r.rate for r in rows) >= 0
    # the same iteration in numpy
    t, p = np.array([m[1] for m in members], float), np.array([m[2:] for m in members])
    mass, r = (t[:, None] * p).sum(0) / t.sum(), np.ones(len(t))
    for _ in range(60):
        e = (t[:, None] * r[:, None] * p).sum(0) / t.sum() - [0.7, 0.3]
        if np.abs(e).max() <= 1e-4:
            break
        r = np.maximum(0, r - p @ (e / mass))
    by_id = {x.id: x.rate for x in rows}
    assert max(abs(by_id[i] - r[i]) for i in range(len(t)) if t[i] > 0) < 1e-5


def test_mixing_learns_domains_and_edge_cases(spark):
    docs = [(i, "plain words here and there " * 3 + ("awful" if i % 4 == 0 else f"fine{i % 7}")) for i in range(200)] + [(900, None), (901, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "id long, text string, rate double")
    labelled = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "good") for i in range(120)] + [(1, None), (2, "other")], "id long, domain string")
    rows = {r.id: r for r in mixing.mix(df, labelled, {"good": 0.9, "bad": 0.1}).collect()}
    assert len(rows) == 202 and all(rows[i].p_bad > 0.9 for i in range(0, 200, 4)) and all(rows[i].p_bad < 0.3 for i in range(1, 200, 4))
    # good documents are a little bad too, so this target is out of reach, and the residuals say so
    assert rows[0].residual_bad > 0.1 and rows[0].residual_good < -0.01
    within = mixing.mix(df, labelled, {"good": 0.6, "bad": 0.4}).first()
    assert abs(within.residual_good) <= 1e-4 and abs(within.residual_bad) <= 1e-4
    assert rows[0].rate < 0.7 < 1 < rows[1].rate and rows[900].tokens == rows[901].tokens == 0 and rows[900].copies == 1
    assert mixing.mix(df.where("false"), labelled, {"good": 0.9, "bad": 0.1}).count() == 0
    assert mixing.mix(df, labelled.where("false"), {"good": 0.5, "bad": 0.5}).count() == 202


# --- classifiers -------------------------------------------------------------------------------------------------


def test_toxicity_held_out_and_counterfactuals(spark):
    terms = toxicity.IDENTITY_TERMS
    plain = [f"w{rng.randrange(300)}" for _ in range(3000)]
    texts, marks = [], []
    for i in range(600):
        t = rng.sample(plain, 20)
        bad = i % 4 == 0
        if bad:
            t.insert(5, rng.choice(["nasty", "vile", "rotten"]))
        if rng.random() < (0.7 if bad else 0.05):
            t.insert(3, rng.choice(terms[:6]))
        texts.append(" ".join(t))
        marks.append(int(bad))
    import pyarrow as pa

    model = toxicity.fit(texts[:450], marks[:450], penalty=5.0)
    p = toxicity.predict(model, pa.array(texts[450:], pa.string()))
    assert np.mean((p >= 0.3) == np.array(marks[450:], bool)) > 0.97
    neutral = toxicity.predict(model, pa.array([f"we met {t} there" for t in terms], pa.string()))
    assert neutral.max() < 0.3
    free = toxicity.fit(texts[:450], marks[:450], penalty=0.0)
    spread = lambda m: np.abs(toxicity.predict(m, pa.array([f"w1 {t}" for t in terms[:6]], pa.string())) - toxicity.predict(m, pa.array(["w1"], pa.string()))[0]).max()
    assert spread(model) < spread(free)


def test_toxicity_sample_keeps_the_shares_and_reads_whole_texts(spark):
    import pyarrow as pa

    pick = random.Random(9)
    texts = [" ".join(f"w{pick.randrange(300)}" for _ in range(20)) + (" vile" if pick.random() < (0.05 if i % 10 else 0.8) else "") for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id long, toxic int")
    empty = [toxicity.predict(toxicity.train(docs, labels, max_rows=n), pa.array([""], pa.string()))[0] for n in (200, 4000)]
    logits = [np.log(p / (1 - p)) for p in empty]
    assert abs(logits[0] - logits[1]) < 1  # 100 of each class, and 100 beside 900
    long = docs.select("id", F.concat(F.repeat(F.lit("so "), 7000), "text").alias("text"))
    p = toxicity.predict(toxicity.train(long, labels), pa.array(["so vile", "so so"], pa.string()))
    assert p[0] > 0.3 > p[1]


def test_classifier_queries_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !!", "en"), (4, "z" * 100000, "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity.op2(docs, labels).count() == 4 and toxicity.op2(docs, labels.where("false")).where("score = 0 and predicted = 0").count() == 4
    got = {r.doc_id: r.lang_pred for r in language_id.op5(docs).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("de", "und")
    assert language_id.op5(docs.where("false")).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.op5(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
