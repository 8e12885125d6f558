"""SentencePiece encoding and decoding over a relational lattice.

A text is a marker for the start, its spaces as markers, and its words between them. Words are encoded as a relation:
substrings of bounded length are exploded and joined to the piece table, and a fold over the edges keeps for each place
in the word the best score and the edge it came by: the Viterbi path with the largest sum of piece scores, of equal sums
the one whose last piece is longest. All edges of a word are in one task, so they are neither sorted nor grouped: the fold
goes one place further in all words of the task at a time. Characters without a piece become their bytes' pieces, at a
score below all others. Decoding puts the pieces' bytes together, so it gives every text back exactly (a U+2581 in a text
reads as a space, as it does in the public library).

Scores that are log probabilities are taken as they are. A model made by merging has none: its scores are ranks, whose
sum means nothing. Its pieces get the log of the Zipf-Mandelbrot weight of their rank, 1 / (rank + ``ZIPF``).

A word of more than ``LONGEST`` characters (a text without spaces, base64) has its lattice built in parts of that many
places; each part has the characters before it that a piece may begin in, and a fold by ``aggregate`` carries the last
places' bests, as many as the longest piece has characters, from part to part. So its path is that of the whole word.

Texts are cut into words where no piece of the vocabulary can reach across, letters from digits and signs if its pieces
allow that. The cuts of many texts are found at once, by the kinds of neighbouring characters, and equal words by a hash
that is looked up. Words are encoded once each, however often they occur: a block of texts keeps its distinct words and, for
each text, their numbers; the distinct words of all blocks go through the lattice. On the way back a block asks for its
words by buckets of their checksum, each word once, so a word of every text is one entry of a block.

Rows: a null or empty text has an empty list of ids, which reads back as an empty text; repeated rows are encoded each.
Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.llm.shared import cut, cut_by, drop

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONGEST = 48
UNKNOWN_PENALTY = 10.0
ZIPF = 100
BLOCK_BYTES = 64 << 20
#: Characters whose words are found at a time.
SLICE = 1 << 21
#: Of the hash of words; it decides about time only.
BASE = 0x9E3779B97F4A7C15
WORDS_PER_PART = 20000
CHARS_PER_PART = 400000
WORDS_PER_BUCKET = 80000
#: Ways to cut a text into words, the finest first; a way fits a vocabulary if it leaves each piece whole.
_WORDS = [re.compile(w) for w in (f"{MARK}*(?:[^\\W\\d_²]+|\\d|(?:[^\\w\n{MARK}]|[_²])+)|{MARK}+|\n+", f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")]


@cache
def load(path: str = MODEL) -> tuple[list[tuple[int, str, float]], list[bytes], int]:
    """(id, piece, score) of the pieces that text can match, every id's bytes, and the id of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, raw, zero = [], [], -1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            zero = i if value == 0 else zero
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.replace(MARK, " ").encode())
            pieces.append((i, piece, float(model.get_score(i))))
    ranked = sorted(pieces, key=lambda p: (-p[2], p[0]))
    steps = [a[2] - b[2] for a, b in zip(ranked, ranked[1:], strict=False)]
    if steps and sorted(steps)[len(steps) // 2] == 1.0:  # ranks of merges
        pieces = [(i, piece, -math.log(rank + ZIPF)) for rank, (i, piece, _) in enumerate(ranked)]
    return pieces, raw, zero


@cache
def word_pattern(path: str = MODEL) -> re.Pattern:
    """The finest way to cut texts that no piece reaches across. Cuts depend on the two characters around them, so a piece that is whole by itself is whole in any text."""
    pieces = [p for _, p, _ in load(path)[0]]
    for pattern in _WORDS:
        if all(len(pattern.findall(p)) == 1 for p in pieces if p.strip(MARK)):
            return pattern
    raise ValueError("the vocabulary has pieces that go on after a space or a line break")


def split(text: str, pattern: re.Pattern | None = None) -> list[str]:
    """The words of a text, with the markers in front of them; together they are the text."""
    return (pattern or word_pattern()).findall(MARK + text.replace(" ", MARK)) if text else []


def _key(word: str) -> str:
    """The word, or a digest in its place if it is long; no word has a line break before another character."""
    return word if len(word) <= LONGEST else "\n" + hashlib.sha256(word.encode()).hexdigest()


def _edges(places: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """(keys, text, start) to (keys, end, from, score, id), a row for each piece that begins at a start of the text, joined to the piece table.

    The id of a character without a piece is -1 less its code point.
    """
    pieces, _, _ = load(path)
    longest = max(len(p) for _, p, _ in pieces)
    least = min(s for _, _, s in pieces) - UNKNOWN_PENALTY
    # the vocabulary, whatever the corpus; joined on a number, which takes half the time of a join on texts, and compared
    table = places.sparkSession.createDataFrame([(p, i, s) for i, p, s in pieces], "known string, piece_id int, score double")
    table = F.broadcast(table.withColumn("hash", F.xxhash64("known")))
    columns = [*keys, "start"] if text in keys else [*keys, text, "start"]
    edges = places.select(*columns, F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(text) - F.col("start") + 1))).alias("size"))
    edges = edges.withColumn("piece", F.substring(text, F.col("start"), F.col("size"))).withColumn("hash", F.xxhash64("piece")).join(table, "hash", "left")
    same = F.coalesce(F.col("piece") == F.col("known"), F.lit(False))
    edges = edges.where(same | (F.col("size") == 1))
    score, number = F.when(same, F.col("score")).otherwise(least), F.when(same, F.col("piece_id")).otherwise(-1 - F.ascii("piece"))
    return edges.select(*keys, (F.col("start") - 1 + F.col("size")).alias("end"), (F.col("start") - 1).alias("from"), score.alias("score"), number.alias("id"))


def _lattice(words: DataFrame, path: str) -> DataFrame:
    """(word) of at most LONGEST characters to the edges (no, word, edge, score) of each distinct word, all in one task.

    ``no`` numbers a task's words one after another; the word itself stands beside its first character's edge only.
    ``edge`` is (end, from, 2^21 - id) in one number, as each column costs time on the way to the fold.
    """
    once = words.select("word").distinct().withColumn("no", F.monotonically_increasing_id())
    places = once.select("no", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    first = (F.col("from") == 0) & (F.col("end") == 1)
    span = (F.col("end") * 64 + F.col("from")).cast("long")
    return _edges(places, ["no", "word"], "word", path).select("no", F.when(first, F.col("word")).alias("word"), (span * (1 << 22) + (1 << 21) - F.col("id")).alias("edge"), "score")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, in any order, to (word, ids): one place further in all words at a time, then back along the best edges."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    no, edge, score = (edges.column(c).to_numpy() for c in ("no", "edge", "score"))
    no = no - no.min()
    n, width = int(no.max()) + 1, LONGEST + 1
    text = np.zeros(n, np.int64)
    spoken = edges.column("word").combine_chunks()
    rows = np.flatnonzero(spoken.is_valid().to_numpy(zero_copy_only=False))
    text[no[rows]] = rows
    # by end and word, the longest edge first, of edges over the same characters the highest id
    order = np.argsort(((edge >> 28) * n + no << 28) + (edge & (1 << 28) - 1))
    no, edge, score = no[order], edge[order], score[order]
    end, start, ids = edge >> 28, edge >> 22 & 63, (1 << 21) - (edge & (1 << 22) - 1)
    best, back, taken, length = np.zeros((n, width)), np.zeros((n, width), np.int32), np.zeros((n, width), np.int32), np.zeros(n, np.int32)
    bounds = np.searchsorted(end, np.arange(1, width + 1))
    for at, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 1):
        if a == b:
            break
        ways = best[no[a:b], start[a:b]] + score[a:b]
        begins = np.flatnonzero(np.diff(no[a:b], prepend=-1))
        group = np.repeat(np.arange(len(begins)), np.diff(begins, append=b - a))
        most = np.maximum.reduceat(ways, begins)
        hits = np.flatnonzero(ways == most[group])
        hits = hits[np.diff(group[hits], prepend=-1) > 0] + a
        best[no[hits], at], back[no[hits], at], taken[no[hits], at], length[no[hits]] = most, start[hits], ids[hits], at
    steps, here, at = [], np.arange(n), length.copy()
    while len(here):
        steps.append((here, taken[here, at[here]]))
        at[here] = back[here, at[here]]
        here = here[at[here] > 0]
    counts = np.bincount(np.concatenate([w for w, _ in steps]), minlength=n)
    ends = np.cumsum(counts)
    flat = np.empty(ends[-1], np.int32)
    for k, (w, x) in enumerate(steps, 1):
        flat[ends[w] - k] = x
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
    yield pa.RecordBatch.from_arrays([spoken.take(pa.array(text)), lists], ["word", "ids"])


def encode_words(words: DataFrame, path: str = MODEL) -> DataFrame:
    """(word) of at most LONGEST characters to (word, ids), each distinct word once."""
    return _lattice(words, path).mapInArrow(_folded, "word string, ids array<int>")


def encode_long(words: DataFrame, tasks: int, path: str = MODEL) -> DataFrame:
    """(word, long) to (word, ids) over ``tasks`` tasks: ``word`` is the key of the characters in ``long``. Each distinct key once."""
    longest = max(len(p) for _, p, _ in load(path)[0])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("word").to_pylist(), batch.column("long"), strict=True):
                text = value.as_py()
                at = list(range(0, len(text), LONGEST))
                lead = [min(a, longest - 1) for a in at]
                bodies = [text[a - b : a + LONGEST] for a, b in zip(at, lead, strict=True)]
                cells = [pa.array([key] * len(at), pa.string()), pa.array(range(len(at)), pa.int32()), pa.array(lead, pa.int32()), pa.array(bodies, pa.string())]
                yield pa.RecordBatch.from_arrays(cells, ["word", "part", "lead", "body"])

    once = words.groupBy("word").agg(F.first("long").alias("long"))
    rows = once.select("word", "long").mapInArrow(parts, "word string, part int, lead int, body string").repartition(tasks, "word")
    # a word lies in one task from here on, so neither its edges nor its parts are dealt out again
    places = rows.select("word", "part", "lead", "body", F.explode(F.sequence(F.lit(1), F.length("body"))).alias("start"))
    keys = ["word", "part", "lead", "size_"]
    ends = _edges(places.withColumn("size_", F.length("body")), keys, "body", path).groupBy(*keys).agg(F.collect_list(F.struct("end", "from", "score", "id")).alias("edges"))
    ends = ends.select("word", F.struct("part", "lead", F.col("size_").alias("size"), F.filter("edges", lambda e: e["end"] > F.col("lead")).alias("edges")).alias("p"))
    lattice = ends.groupBy("word").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    place = lambda score: F.struct(score.alias("score"), F.lit(0).alias("size"), F.lit(0).alias("id"))
    # the bests of the last places, the word's start as the last of them
    origin = F.array(F.concat(F.array_repeat(place(F.lit(float("-inf"))), longest - 1), F.array(place(F.lit(0.0)))))

    def forward(done, p):  # noqa: ANN001, ANN202
        """One part further: the last part's last bests, and the best edge into each place of this one."""

        def step(best, end):  # noqa: ANN001, ANN202
            into = F.filter(p["edges"], lambda e: e["end"] == end)
            ways = F.transform(into, lambda e: F.struct((F.element_at(best, e["from"] - e["end"])["score"] + e["score"]).alias("score"), (e["end"] - e["from"]).alias("size"), e["id"].alias("id")))
            return F.concat(best, F.array(F.array_max(ways)))

        return F.concat(done, F.array(F.aggregate(F.sequence(p["lead"] + 1, p["size"]), F.slice(F.element_at(done, -1), -longest, longest), step)))

    folded = lattice.select("word", F.aggregate("parts", origin, forward).alias("done"))
    back_from = F.array(F.struct(F.lit(0).alias("skip"), F.array().cast("array<int>").alias("taken")))

    def back(done, bests):  # noqa: ANN001, ANN202
        """One part back: ``skip`` places lie inside the edge taken last; the ids of the edges taken, last one first."""

        def step(s, place):  # noqa: ANN001, ANN202
            take = F.struct((place["size"] - 1).alias("skip"), F.concat(s["taken"], F.array(place["id"])).alias("taken"))
            return F.when(s["skip"] == 0, take).otherwise(F.struct((s["skip"] - 1).alias("skip"), s["taken"].alias("taken")))

        start = F.struct(F.element_at(done, -1)["skip"].alias("skip"), F.array().cast("array<int>").alias("taken"))
        own = F.reverse(F.slice(bests, F.lit(longest + 1), F.size(bests) - longest))
        return F.concat(done, F.array(F.aggregate(own, start, step)))

    walked = F.aggregate(F.reverse(F.slice("done", F.lit(2), F.size("done") - 1)), back_from, back)
    return folded.select("word", F.reverse(F.flatten(F.transform(walked, lambda s: s["taken"]))).alias("ids"))


def _numbers() -> defaultdict[str, int]:
    """Gives each new word the next number."""
    return defaultdict(count().__next__)


def _kind(char: str, pattern: re.Pattern) -> int:
    """What the pattern takes a character for: 0 the marker, 1 a line break, 2 like a letter, 3 a word by itself, 4 another."""
    if char in (MARK, "\n"):
        return int(char == "\n")
    return 3 if len(pattern.findall(char + char)) == 2 else 2 if len(pattern.findall("a" + char)) == 1 else 4


def _numbered(texts: list[str], pattern: re.Pattern, known: defaultdict[str, int], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words, and the numbers of all words, as ``split`` gives them one by one; ``kinds`` holds the kinds of characters met so far, else 255."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    whole = "".join([MARK + t for t in texts if t]).replace(" ", MARK)
    if not whole:
        return np.zeros(len(texts), np.int32), np.empty(0, np.int32)
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = kinds[chars]
    if len(new := np.unique(chars[kind == 255])):
        kinds[new] = [_kind(chr(c), pattern) for c in new.tolist()]
        kind = kinds[chars]
    before, after = kind[:-1], kind[1:]
    starts = np.ones(len(chars), bool)
    starts[1:] = (before != after) & ((before != 0) | (after == 1)) | (after == 3) & (before != 0)
    ends = np.cumsum(sizes)
    starts[(ends - sizes)[sizes > 0]] = True
    counts = np.diff(np.concatenate([[0], np.cumsum(starts)])[ends], prepend=0).astype(np.int32)
    begin = np.flatnonzero(starts)
    length = np.diff(begin, append=len(chars))
    # equal words by a hash; that they are equal is looked up below
    power = np.full(int(length.max()), BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    place = np.arange(len(chars)) - np.repeat(begin, length)
    digest = np.add.reduceat((chars + np.uint64(0x632BE59BD9B4E019)) * power[place], begin)
    _, first, which = np.unique(digest, return_index=True, return_inverse=True)
    like = begin[first][which]
    if not ((length == length[first][which]).all() and (chars == chars[np.repeat(like, length) + place]).all()):
        return counts, np.fromiter((known[w] for t in texts for w in split(t, pattern)), np.int32, len(begin))
    order = np.argsort(first)  # new words are numbered as they come
    numbers = np.empty(len(first), np.int32)
    at = begin[first[order]]
    numbers[order] = [known[whole[a:b]] for a, b in zip(at.tolist(), (at + length[first[order]]).tolist(), strict=True)]
    return counts, numbers[which]


BLOCKS = "kind int, block long, ids array<long>, sizes array<int>, codes binary, words array<string>"


def _blocks(docs: DataFrame, pattern: re.Pattern) -> DataFrame:
    """(id, text) to two rows a block: of kind 0 with each text's number of words and all words' numbers, of kind 1 with the block's distinct words."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds_of = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, kinds = TaskContext.get().partitionId(), 0, np.full(0x110000, 255, np.uint8)
        ids, sizes, codes, known, held = [], [], [], _numbers(), 0
        texts, waiting = [], 0

        def number() -> None:
            nonlocal texts, waiting
            if waiting > 2 * SLICE:  # one long text, whose words are better taken one by one
                found = [np.fromiter((known[m.group()] for m in pattern.finditer(MARK + t.replace(" ", MARK))), np.int32) if t else np.empty(0, np.int32) for t in texts]
                sizes.extend(map(len, found))
                codes.extend(found)
            elif texts:
                counts, numbers = _numbered(texts, pattern, known, kinds)
                sizes.extend(counts.tolist())
                codes.append(numbers)
            texts, waiting = [], 0

        def full() -> pa.RecordBatch:
            block = (part << 32) + made
            rows = [(0, block, ids, sizes, _pack(np.concatenate(codes)), None), (1, block, None, None, None, list(known))]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds_of, strict=True)], names)

        for batch in batches:
            for i, value in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                ids.append(i)
                texts.append(text)
                held += len(text)
                waiting += len(text)
                if waiting >= SLICE or held >= BLOCK_BYTES:
                    number()
                if held >= BLOCK_BYTES:
                    yield full()
                    made, ids, sizes, codes, known, held = made + 1, [], [], [], _numbers(), 0
        number()
        if ids:
            yield full()

    return docs.select("id", "text").mapInArrow(run, BLOCKS)


@cache
def _zip(level: int) -> zstandard.ZstdCompressor:
    """One for all that a worker compresses, as making one takes longer than a bucket's numbers do."""
    return zstandard.ZstdCompressor(level=level)


@cache
def _unzip() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    """Numbers compressed, equal bytes of neighbours next to each other."""
    return _zip(9).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip().decompress(raw), np.uint8).reshape(4, -1).T).view(np.int32).ravel() if raw else np.empty(0, np.int32)


def _width(raw: list[bytes]) -> str:
    """Bytes of an id on its way."""
    return "<u2" if len(raw) <= 1 << 16 else "<i4"


def _packer(raw: list[bytes], zero: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, ids) to (word, ids, good) with the ids as bytes and characters without a piece as their bytes' pieces; ``good`` if they decode to the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        begin = np.cumsum(length) - length
        for batch in batches:
            words, lists = batch.column("word"), batch.column("ids")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy()).astype(np.int64)
            unknown = np.flatnonzero(flat < 0)
            if len(unknown):
                chars = [chr(-1 - i).encode() for i in flat[unknown].tolist()]
                sizes = np.ones(len(flat), np.int64)
                sizes[unknown] = [len(c) for c in chars]
                upto = np.cumsum(sizes)
                flat, ends = np.repeat(flat, sizes), np.concatenate([[0], upto])[ends]
                flat[_ragged((upto - sizes)[unknown], sizes[unknown])] = zero + np.frombuffer(b"".join(chars), np.uint8).astype(np.int32)
            upto = np.concatenate([[0], np.cumsum(length[flat])])[np.concatenate([[0], ends])]
            read = spelled[_ragged(begin[flat], length[flat])]
            good = _equal(read, upto, pc.replace_substring(words, MARK, " "))
            for i in np.flatnonzero(pc.match_substring_regex(words, "^\n[^\n]").to_numpy(zero_copy_only=False)).tolist():  # a digest
                good[i] = _key(read[upto[i] : upto[i + 1]].tobytes().decode("utf-8", "replace").replace(" ", MARK)) == words[i].as_py()
            data = flat.astype(_width(raw))
            offsets = pa.py_buffer((np.concatenate([[0], ends]) * data.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays([words, pa.Array.from_buffers(pa.binary(), len(words), [None, offsets, pa.py_buffer(data)]), pa.array(good)], ["word", "ids", "good"])

    return run


PACKED = "word string, ids binary, good boolean"


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, with the end of the last, and the bytes of all."""
    values = values.cast(pa.binary())
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return ends - ends[0], np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _equal(data: np.ndarray, upto: np.ndarray, words: pa.Array) -> np.ndarray:
    """Which words have the bytes data[upto[i]:upto[i + 1]]."""
    (ends, own), sizes = _bytes(words), np.diff(upto)
    good = sizes == np.diff(ends)
    mine = sizes[good]
    other = np.concatenate([[0], np.cumsum(data[_ragged(upto[:-1][good], mine)] != own[_ragged(ends[:-1][good], mine)])])
    last = np.cumsum(mine)
    good[good] = other[last] == other[last - mine]
    return good


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, words) to (bucket, block, codes, sizes, words): a block's words of one bucket, and their numbers in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                words = value.values
                if not len(words):  # null and empty texts only
                    continue
                if pc.max(pc.utf8_length(words)).as_py() > LONGEST:
                    words = pa.array([_key(w) for w in words.to_pylist()], pa.string())
                words = words.cast(pa.binary())
                bucket = np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words)) % buckets
                order = pc.sort_indices(pa.table({"bucket": bucket, "word": words}), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
                ends, data = _bytes(words.take(pa.array(order)))
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                rows = [
                    (int(bucket[order[a]]), block, _pack(order[a:b].astype(np.int32)), _pack(np.diff(ends[a : b + 1]).astype(np.int32)), _zip(3).compress(data[ends[a] : ends[b]]))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                ]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "codes", "sizes", "words"])

    return blocks.mapInArrow(run, "bucket long, block long, codes binary, sizes binary, words binary")


def _answers(requests: pa.Table, ids: pa.Table, width: str) -> pa.Table:
    """One bucket's words to (block, codes, counts, flat, bad): how many ids each word has, all ids, and whether they fail to give the word back."""
    rows, out = requests.to_pylist(), []
    if rows:
        ids = ids.combine_chunks()
        known = pa.concat_arrays(ids.column("word").chunks).cast(pa.binary())
        upto, data = _bytes(pa.concat_arrays(ids.column("ids").chunks))
        flat, upto, wrong = data.view(width), upto // np.dtype(width).itemsize, ~ids.column("good").to_numpy()
        sizes = [_unpack(row["sizes"]) for row in rows]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]).astype(np.int32)
        asked = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join([_unzip().decompress(row["words"]) for row in rows]))])
        found = pc.index_in(asked, value_set=known)
        if found.null_count:
            raise ValueError("a word of a text is not among the encoded words")
        for row, at in zip(rows, np.split(found.to_numpy(), np.cumsum([len(x) for x in sizes])[:-1]), strict=True):
            counts = np.diff(upto)[at]
            out.append((row["block"], row["codes"], _pack(counts.astype(np.int32)), _pack(flat[_ragged(upto[at], counts)].astype(np.int32)), np.packbits(wrong[at]).tobytes()))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*out, strict=True) if out else [()] * 5
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("home", "codes", "counts", "flat", "bad"), columns, kinds, strict=True)})


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(id, text) to (id, ids, round_trip): round_trip tells whether decoding the ids gives the text back."""
    _, raw, zero = load(path)
    blocks, words = cut_by(_blocks(docs, word_pattern(path)), "kind", [0, 1])
    entries = words.select(F.explode("words").alias("word")).withColumn("long", F.when(F.length("word") > LONGEST, F.col("word")))
    size = entries.agg(F.count("*").alias("words"), F.sum(F.length("long")).alias("chars"), F.sum(F.length("word")).alias("all")).first()
    # so many parts that the edges of a part's words fit in memory
    parts = max(size["words"] // WORDS_PER_PART, ((size["all"] or 0) - (size["chars"] or 0)) // CHARS_PER_PART) + 1
    buckets = size["words"] // WORDS_PER_BUCKET + 1
    pack = _packer(raw, zero)
    ids = _lattice(entries.where("long is null").select("word").repartition(parts, "word"), path).mapInArrow(lambda batches: pack(_folded(batches)), PACKED)
    if size["chars"]:
        long = entries.where("long is not null").select(F.concat(F.lit("\n"), F.sha2("long", 256)).alias("word"), "long")
        ids = ids.union(encode_long(long, size["chars"] // CHARS_PER_PART + 1, path).mapInArrow(pack, PACKED))
    ids = cut(ids)
    width = _width(raw)
    given = ids.withColumn("home", F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(buckets)))
    answers = cut(_requests(words.select("block", "words"), buckets).groupBy("bucket").cogroup(given.groupBy("home")).applyInArrow(lambda left, right: _answers(left, right, width), "home long, codes binary, counts binary, flat binary, bad binary"))
    drop(ids, words)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        codes = [_unpack(r["codes"]) for r in told]
        counts = np.concatenate([_unpack(r["counts"]) for r in told]).astype(np.int64) if told else np.empty(0, np.int64)
        flat = np.concatenate([_unpack(r["flat"]) for r in told]) if told else np.empty(0, np.int32)
        bad = np.concatenate([np.unpackbits(np.frombuffer(r["bad"], np.uint8), count=len(c)) for r, c in zip(told, codes, strict=True)]) if told else np.empty(0, np.uint8)
        codes = np.concatenate(codes) if told else np.empty(0, np.int32)
        place = np.empty(len(codes), np.int64)
        place[codes] = np.arange(len(codes))
        begins, sizes, bad = (np.cumsum(counts) - counts)[place], counts[place], bad[place]
        out = []
        for row in left.to_pylist():
            mine, words = _unpack(row["codes"]), np.array(row["sizes"], np.int64)
            ends = np.cumsum(words)
            first = 0
            while first < len(words):  # a bounded slice at a time
                start = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + (1 << 19), side="right")))
                own = mine[start : ends[last - 1]]
                doc = np.repeat(np.arange(last - first), words[first:last])
                tokens = np.bincount(doc, weights=sizes[own], minlength=last - first)
                wrong = np.bincount(doc, weights=bad[own], minlength=last - first) > 0
                offsets = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[_ragged(begins[own], sizes[own])]))
                out.append(pa.table({"id": pa.array(row["ids"][first:last], pa.int64()), "ids": lists, "round_trip": pa.array(~wrong)}))
                first = last
        return pa.concat_tables(out)

    return blocks.select("block", "ids", "sizes", "codes").groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(finish, "id long, ids array<int>, round_trip boolean")


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    """The text of a sequence of ids, without the marker in front."""
    return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(id, ids) to (id, text)."""
    _, raw, _ = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(v, raw) if v is not None else None for v in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def op9(docs: DataFrame, path: str = MODEL) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return encode(rows, path).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")
