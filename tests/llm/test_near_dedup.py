import re

from logfacts.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, id string"


def brute(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_matches_brute_force(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, "  ".join(base).upper()), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one  two"), (9, "one two three"), (10, "x" * 5000)]
    rows += [(20 + i, " ".join(base[: 40 + 2 * i] + [f"n{i}"] + base[41 + 2 * i :])) for i in range(20)]
    rows += [(60 + i, " ".join(base[i * 3 :] + [f"t{j}" for j in range(i * 3)])) for i in range(12)]
    rows += [(90 + i, "the same long passage that everyone quotes again and again " + " ".join(f"q{i}_{j}" for j in range(30))) for i in range(10)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows] + [(None, "no id", "x")], SCHEMA)
    got = {r.id: (r.n, r.component) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(3, "a b c d e f", ""), (3, "a b c d e f", ""), (2, "a b c d e f", "")], SCHEMA)).collect()
    assert sorted((r.id, r.component) for r in rows) == [(2, 2), (3, 2), (3, 2)]
