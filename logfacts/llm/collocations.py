"""Phrase collocations by prefix-free parsing: phrases that occur far more often than their parts do apart.

Texts are cut into pieces at punctuation and line ends, pieces into words, and each piece is parsed into chunks: a chunk
begins at every word whose crc32 is a multiple of ``every`` (or ``most`` words after the last beginning) and overlaps the
next one by ``longest`` - 1 words. As only the words decide, equal passages give equal chunks wherever they stand.
The distinct chunks of a language form a dictionary with the number of times the parse has each; from there on only
the dictionary is read. A phrase that begins in a chunk's own words lies wholly in that chunk, so it counts there, once,
times the chunk's frequency; the overlap at the end only completes phrases, it begins none.

Counting goes up level by level: words, then the numbers of pairs of frequent words, then phrases all of whose pairs may
be frequent (a phrase is no more frequent than its parts, so none is lost). What is frequent is known to the tasks as
bitmaps of 2**``bits`` bits, 8 MB each whatever the data; numbers or bits that collide let a rare phrase be counted and
dropped after that, no more, as the counts that decide are of the phrases themselves.

All counts are sums with partial sums first, so a word, line or chunk that a third of all rows hold costs one row a
task. Ranks come from a range partitioning, so no task holds a language.

Rows: a null text is empty; a null language is ``und``; repeated rows count each; ids are not read, further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfacts.llm.shared import cut, drop

#: A-Z go to lower case; . , ; : ! ? and 0x0A to 0x0D end a piece; a tab is a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 0x0A if b in b".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b for b in range(256))
#: Counters are given out when they hold so many keys.
HELD = 400_000


def pieces(text: bytes) -> Iterator[list[bytes]]:
    for piece in text.translate(TABLE).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def chunks(words: list[bytes], longest: int, every: int, most: int) -> Iterator[tuple[bytes, bytes]]:
    """(own words, the overlap that follows) of each chunk of a piece."""
    starts = [i for i, word in enumerate(words) if zlib.crc32(word) % every == 0]
    start = 0
    for end in [*starts, len(words)]:
        while start < end:
            stop = min(end, start + most)
            yield b" ".join(words[start:stop]), b" ".join(words[stop : stop + longest - 1])
            start = stop


def dictionary(docs: DataFrame, text_col: str, lang_col: str, longest: int, every: int, most: int) -> DataFrame:
    """(lang, own, rest, times): the distinct chunks of each language and how often the parse has them."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, held in counts.items():
            own, rest = zip(*held, strict=True) if held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(own, pa.binary()), pa.array(rest, pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "own", "rest", "times"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held = counts[lang]
                for words in pieces(text.as_py() or b""):
                    for chunk in chunks(words, longest, every, most):
                        held[chunk] += 1
                if sum(map(len, counts.values())) > HELD:
                    yield from rows(counts)
        yield from rows(counts)

    source = docs.select(F.col(text_col).cast("string").cast("binary"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")))
    parsed = source.mapInArrow(run, "lang string, own binary, rest binary, times long")
    return parsed.groupBy("lang", "own", "rest").agg(F.sum("times").alias("times"))


#: A pair's number: the first word's crc32 times this, and the second's.
STEP = 1_000_003


def _bitmap(numbers: DataFrame, bits: int) -> np.ndarray:
    """One bit for each (lang, number), mixed with the language's crc32: a fixed 2**bits bits, made by the executors."""
    place = F.col("number").bitwiseXOR(F.crc32(F.encode("lang", "utf-8"))).bitwiseAND(F.lit((1 << bits) - 1))
    cells = numbers.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("held").to_numpy()
    return out.view(np.uint8)


def _known(bitmap: np.ndarray, numbers: np.ndarray, lang: int) -> np.ndarray:
    """Whether the bit of each phrase's number is set; ``lang`` is the crc32 of its language."""
    place = (numbers ^ lang) & (8 * len(bitmap) - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _numbers(words: list[bytes], left: np.ndarray, lang: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of known words begin, and the pairs' numbers. ``left`` is the number of words from each one to its chunk's end."""
    numbers = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    good = _known(bitmap, numbers, lang)
    at = np.flatnonzero(good[:-1] & good[1:] & (left[:-1] > 1))
    return at, numbers[at] * STEP + numbers[at + 1]


def runs(words: list[bytes], left: np.ndarray, lang: int, sizes: list[int], bitmaps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, starts) of the runs of words all of whose words, and then pairs, are known."""
    at, numbers = _numbers(words, left, lang, bitmaps[0])
    pairs = np.zeros(len(words), bool)
    pairs[at] = _known(bitmaps[1], numbers, lang)
    for size in sizes:
        whole = pairs & (left >= size)
        for shift in range(1, size - 1):
            whole[:-shift] &= pairs[shift:]
        yield size, np.flatnonzero(whole)


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each language in a batch of chunks (lang, words, left, whether a word is its chunk's own, times), flat; chunks that
    occur once by themselves, as their phrases are counted without a look at each."""
    langs, times = np.array(batch.column(0).to_pylist(), object), batch.column(3).to_numpy()
    own, rest = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for lang in set(langs.tolist()):
        for rare in (True, False):
            some = np.flatnonzero((langs == lang) & ((times == 1) == rare))
            if len(some):
                n_own = np.array([own[i].count(b" ") + 1 for i in some])
                size = n_own + np.array([rest[i].count(b" ") + 1 if rest[i] else 0 for i in some])
                words = b" ".join([own[i] + b" " + rest[i] if rest[i] else own[i] for i in some]).split(b" ")
                place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
                yield lang, words, np.repeat(size, size) - place, place < np.repeat(n_own, size), np.repeat(times[some], size)


def pair_numbers(parse: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(lang, number, f): how often pairs of known words with that number occur; unlike pairs may share one, which only makes f larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                numbers, times = (np.concatenate(x) for x in zip(*parts, strict=True))
                found, of = np.unique(numbers, return_inverse=True)
                total = np.bincount(of, weights=times, minlength=len(found)).astype(np.int64)  # far below 2**53
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total)], ["lang", "number", "f"])
            held.clear()

        for batch in batches:
            for lang, words, left, own, times in _flat(batch):
                at, numbers = _numbers(words, left, zlib.crc32(lang.encode()), bitmap)
                mine = own[at]
                held[lang].append((numbers[mine], times[at][mine]))
            if sum(len(n) for parts in held.values() for n, _ in parts) > 4 * HELD:
                yield from rows()
        yield from rows()

    found = parse.select("lang", "own", "rest", "times").mapInArrow(run, "lang string, number long, f long")
    return found.groupBy("lang", "number").agg(F.sum("f").alias("f"))


def counted(parse: DataFrame, sizes: list[int], bitmaps: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, f): occurrences of phrases of these sizes all of whose words, and pairs, are known.

    Without bitmaps words are counted, and a further row a language, of phrase null, has the number of its words.
    """

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, held in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "phrase", "f"])
        counts.clear()

    def add(held: Counter, phrases: list[bytes], times: np.ndarray) -> None:
        if (times == 1).all():
            held.update(phrases)
        else:
            for phrase, n in zip(phrases, times.tolist(), strict=True):
                held[phrase] += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            if bitmaps:
                for lang, words, left, own, times in _flat(batch):
                    for size, at in runs(words, left, zlib.crc32(lang.encode()), sizes, bitmaps):
                        at = at[own[at]]
                        phrases = [words[i] + b" " + words[i + 1] for i in at.tolist()] if size == 2 else [b" ".join(words[i : i + size]) for i in at.tolist()]
                        add(counts[lang], phrases, times[at])
            else:
                whole = batch.select(["lang", "own", "times"]).add_column(2, "rest", pa.array([b""] * batch.num_rows, pa.binary()))
                for lang, words, _, _, times in _flat(whole):
                    add(counts[lang], words, times)
                    counts[lang][None] += int(times.sum())
            if sum(map(len, counts.values())) > HELD:
                yield from rows(counts)
        yield from rows(counts)

    found = parse.select("lang", "own", "rest", "times").mapInArrow(run, "lang string, phrase binary, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, every: int = 16, most: int = 64, bits: int = 26) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of up to ``longest`` words that occur at least ``least`` times, and of each
    language's number of words, whose phrase is null."""
    parse = cut(dictionary(docs, text_col, lang_col, longest, every, most))
    levels = [cut(counted(parse, [1], []).where(F.col("phrase").isNull() | (F.col("f") >= least)))]
    if longest > 1:
        known = _bitmap(levels[0].where("phrase is not null").select("lang", F.crc32("phrase").alias("number")), bits)
        pairs = cut(pair_numbers(parse, known).where(F.col("f") >= least).select("lang", "number"))
        levels.append(cut(counted(parse, list(range(2, longest + 1)), [known, _bitmap(pairs, bits)]).where(F.col("f") >= least)))
        drop(pairs)
    drop(parse)
    phrase = F.col("phrase").cast("string")
    return reduce(DataFrame.union, levels).select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("size"), "f")


def candidates(found: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, score): phrases of two words and more, each with its lowest-scoring cut, that no longer one covers.

    A cut's score is the floor of 2,000,000 a / (l + r) in decimals of 38 digits. A phrase goes if one that holds it and
    one word more occurs at least ``percent`` in a hundred times as often; what longer ones cover, that one covers too.
    """
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    parts = found.where("phrase is not null").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    phrases = found.where("phrase is not null and size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    for part, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f)), ["lang", part])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = phrases.where("size > 2").select("lang", F.explode(F.array(*(F.array_join(F.slice(words, F.lit(at), F.col("size") - 1), " ") for at in (1, 2)))).alias("phrase"), "a")
    over = inner.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    return best.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (whole("over") * 100 < whole("a") * percent)).drop("over")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, frequency (both falling) and phrase, with ``rank`` from 1.

    Rows are dealt by range into one order of all; the number of a language's rows in the parts before gives the ranks.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, F.asc("lang"), *order).withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("lang", "part").agg(F.count("*").alias("held"))
    before = held.select("lang", "part", (F.sum("held").over(Window.partitionBy("lang").orderBy("part")) - F.col("held")).alias("before")).where(F.col("before") < top)
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)) + F.col("before")
    return dealt.join(before, ["lang", "part"]).withColumn("rank", place.cast("long")).where(F.col("rank") <= top).drop("part", "before")


def collocations(docs: DataFrame, top: int = 2000, percent: int = 80, **settings: object) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language; n is the language's number of words."""
    found = frequencies(docs, **settings)
    totals = found.where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked(candidates(found, percent), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(docs: DataFrame) -> DataFrame:
    return collocations(docs)
