"""Repeated passages: a distributed difference-cover suffix array over everything that could repeat.

Which bytes belong to a string of ``length`` bytes that also starts elsewhere? Four steps:

1. Winnowing gives each start an anchor inside its string, the gram of 32 bytes with the least hash, and the fingerprint
   of a wider stretch around it that also lies inside the string. Equal strings have the same one, so a start whose
   fingerprint is unique cannot repeat. What is left is cut at anchors into chunks. This only leaves out what cannot
   match; whether a start repeats is told by the suffix order alone.
2. Chunks with the same bytes, the last start's string included, become one, with a count, so a text that thousands of
   documents copy is sorted once. Chunks are put into blocks by their least anchor: those that share text meet in a
   block, which sends each of its distinct keys once, whatever their number.
3. The suffixes of the chunks are sorted by a difference cover modulo 3: the sampled positions (remainders 1 and 2) get
   names by sorting triples of words, and longer names by sorting triples of names. These stand for all but the
   last two to four bytes of a string (``Depth``).
4. Each remaining suffix (remainder 0) is one or two bytes before a sampled one; it is merged with the sampled ones of
   either remainder by those bytes, that rank and the bytes behind. Neighbours in the three merged lists are compared
   over their first ``length`` bytes.

Sorting is dealt out by ranges of the first 24 bytes, whose bounds Spark's range partitioning finds; 24 bytes a bucket
are all that every task gets. Joins on fingerprints and chunks give a key of many rows to several tasks.

Rows: a null id is left out; a null text is empty; repeated rows count as documents each, so they match each other;
texts shorter than ``length`` keep all their bytes. Matches never cross documents. Other columns are kept or ignored,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.llm import kernels as K
from logfacts.llm.shared import cut, drop, join_counted

GRAM = 32
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
LONGEST_CHUNK = 16384
BOUND = 24


def _pack(x: np.ndarray) -> bytes:
    """Numbers travel compressed, equal bytes of neighbours next to each other."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes()) if len(x) else b""


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.empty(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# --- step 1: fingerprints ----------------------------------------------------------------------------------------


def _sliding_least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours, from those of half as many."""
    reach = 1
    while 2 * reach <= window:
        x, reach = np.minimum(x[:-reach], x[reach:]), 2 * reach
    return np.minimum(x[: len(x) - (window - reach)], x[window - reach :]) if window > reach else x


class Prints(NamedTuple):
    """Runs of starts with the same anchor and fingerprint: their texts, first and last starts (last not included), fingerprints and anchors' hashes."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    anchor: np.ndarray


def prints(data: np.ndarray, starts: np.ndarray, length: int) -> Prints:
    """The fingerprints of texts that lie after one another. Of anchors with the same hash the first counts, so equal strings agree on theirs.

    An anchor at most ``wide`` places further into the string than the class says leaves the stretch inside the string.
    """
    window = length - GRAM + 1
    n = len(data) - GRAM + 1
    whole = np.zeros(max(n - window + 1, 0) + 1, np.int8)
    long = np.flatnonzero(np.diff(starts) >= length)
    whole[starts[long]] = 1
    whole[starts[long + 1] - length + 1] -= 1
    whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    if not len(long):
        none = np.empty(0, np.int64)
        return Prints(none, none, none, none.view(np.uint64), none.view(np.uint64))
    wide = -(-window // 4)
    total = K.prefix_hash(data + np.uint16(1))
    at = np.arange(n)
    low = K.U64(0xFFFFFFFF)
    grams = K.mix((total[GRAM:] - total[:n]) * K.powers(len(total))[1][:n] + K.U64(GRAM))  # range_hash of each gram
    least = _sliding_least((grams & ~low) | at.astype(np.uint64), window)
    place = (least & low).astype(np.int64)
    kind = (place - at[: len(place)]) // wide
    new = whole.copy()
    new[1:] &= (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new)
    last = np.minimum(np.append(first[1:], len(place)), starts[(text := np.searchsorted(starts, first, side="right") - 1) + 1] - length + 1)
    place, kind = place[first], kind[first]
    begin = place - kind * wide
    key = K.range_hash(total, begin, begin + length - wide + 1) ^ K.mix(kind.astype(np.uint64))
    return Prints(text, first - starts[text], last - starts[text], key, least[first] >> K.U64(32))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, starts = K.text_bytes(batch.column("text"))
    for i in range(batch.num_rows):
        yield i, data[starts[i] : starts[i + 1]]


def _print_rows(docs: DataFrame, length: int) -> DataFrame:
    """(id, mark, hash, n): each document's distinct fingerprints with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            data, starts = K.text_bytes(batch.column("text"))
            for a, b in K.slices(starts):
                found = prints(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], length)
                key = found.key.view(np.int64)
                order = np.lexsort((key, found.text))
                text, key = found.text[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.empty(0, np.int64)
                row = text[new] + a
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], marks[row], key[new], np.diff(np.append(new, len(key))))], ["id", "mark", "hash", "n"])

    return docs.mapInArrow(run, "id long, mark long, hash long, n long")


# --- step 2: chunks and blocks -----------------------------------------------------------------------------------


def _chunk_rows(docs: DataFrame, length: int) -> DataFrame:
    """(id, mark, text, shared) to (id, mark, at, starts, near, key, body): ``starts`` starts from ``at`` on; ``near`` is the least anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "mark", "at", "starts", "near", "key", "body"]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            ids, marks, lists = batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("shared")
            data, starts = K.text_bytes(batch.column("text"))
            for first, last in K.slices(starts):
                part, rows, held = data[starts[first] : starts[last]], [], 0
                at = starts[first : last + 1] - starts[first]
                shared = np.unique(lists.slice(first, last - first).flatten().to_numpy())
                for i, a, b, near in _spans(prints(part, at, length), shared):
                    body = part[at[i] + a : at[i] + b + length - 1].tobytes()
                    rows.append((ids[first + i], marks[first + i], a, b - a, near, hashlib.blake2b(body, digest_size=16).digest(), body))
                    held += len(body)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.mapInArrow(run, "id long, mark long, at int, starts int, near long, key binary, body binary")


def _spans(found: Prints, shared: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, first and last start (last not included) and least anchor of each chunk of the starts that may repeat.

    Chunks end where the anchor changes to one of a sixteenth of all hashes, so equal passages are cut alike.
    """
    key = found.key.view(np.int64)
    free = shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key if len(shared) else np.zeros(len(key), bool)
    if not free.any():
        return
    ends = (found.anchor[1:] != found.anchor[:-1]) & ((found.anchor[1:] & K.U64(15)) == 0) | (found.text[1:] != found.text[:-1])
    opens = np.flatnonzero(free & np.concatenate([[True], ends | ~free[:-1]]))
    closes = np.flatnonzero(free & np.concatenate([ends | ~free[1:], [True]]))
    nearest = np.minimum.reduceat(np.append(found.anchor, found.anchor[-1:]), np.stack([opens, closes + 1], axis=1).ravel())[0::2]
    for i, a, b, near in zip(found.text[opens].tolist(), found.first[opens].tolist(), found.last[closes].tolist(), nearest.tolist(), strict=True):
        for c in range(a, b, LONGEST_CHUNK):
            yield i, c, min(c + LONGEST_CHUNK, b), near


def _blocks(chunks: DataFrame) -> DataFrame:
    """(key, starts, body, count) to blocks of at most BLOCK_BYTES or one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, rows, held = TaskContext.get().partitionId(), 0, [], 0
        names = ["block", "keys", "raw", "sizes", "starts", "counts"]

        def full() -> pa.RecordBatch:
            keys, bodies, starts, counts = zip(*rows, strict=True)
            raw = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            lists = [[len(b) for b in bodies], list(starts), list(counts)]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([b"".join(keys)], pa.binary()), pa.array([raw], pa.binary()), *(pa.array([x], pa.list_(pa.int32())) for x in lists)], names)

        for batch in batches:
            for key, body, starts, count in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "starts", "count")), strict=True):
                rows.append((key, body, starts, min(count, 2)))
                held += len(body)
                if held >= BLOCK_BYTES:
                    yield full()
                    made, rows, held = made + 1, [], 0
        if rows:
            yield full()

    return chunks.mapInArrow(run, "block long, keys binary, raw binary, sizes array<int>, starts array<int>, counts array<int>")


# --- step 3: names -----------------------------------------------------------------------------------------------


class Depth:
    """How far names reach: ``whole`` bytes, a multiple of three, by ``three`` names of ``word`` bytes at multiples of three; ``rest`` bytes are left."""

    def __init__(self, length: int):
        self.length = length
        self.whole = (length - 2) // 3 * 3
        self.rest = length - self.whole
        self.word = -(-self.whole // 9) * 3
        self.three = (0, (self.whole - self.word) // 6 * 3, self.whole - self.word)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which of them each value is."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(x) else np.empty(0, bool)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


def _windows(body: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The strings of that size at those places."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, size)[at]).view(f"S{size}").ravel() if len(at) else np.empty(0, f"S{size}")


class Block:
    """Chunk bodies one after another. Its keys of each level are local numbers: of level 1 by bucket, first eight bytes and hash, of level 2 by those."""

    BITS = 21

    def __init__(self, row: dict, depth: Depth, bounds: np.ndarray):
        self.depth, self.bounds = depth, bounds
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["raw"]), np.uint8)
        self.sizes, self.starts, self.counts = (np.array(row[c], np.int64) for c in ("sizes", "starts", "counts"))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.chunk = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.offset = (np.arange(len(self.body)) - self.first[self.chunk]).astype(np.int32)
        self.kind = (self.offset % 3).astype(np.uint8)
        self.long_at = np.flatnonzero((self.kind > 0) & (self.offset < self.starts[self.chunk] + 2))

    @cached_property
    def _level_1(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each distinct triple of words, its bucket, and the number of each place's own."""
        d = self.depth
        want = np.zeros(len(self.body), bool)
        for step in d.three:
            want[self.long_at + step] = True
        at = np.flatnonzero(want)
        total = K.prefix_hash(self.body + np.uint16(1))
        _, some, which = _distinct(K.range_hash(total, at, at + d.word))
        places = at[some]
        order = np.argsort(_windows(self.body, places, 8).view(">u8").astype(np.uint64), kind="stable")
        bucket = self.bucket(places[order])
        dealt = np.argsort(bucket, kind="stable")
        order, bucket = order[dealt], bucket[dealt]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = np.zeros(len(self.body), np.int64)
        number[at] = rank[which]
        return places[order], bucket, number

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct triples of words by number, and their buckets."""
        return _windows(self.body, self._level_1[0], self.depth.word), self._level_1[1]

    @cached_property
    def _level_2(self) -> tuple[np.ndarray, np.ndarray]:
        number = self._level_1[2]
        a, b, c = (number[self.long_at + step] for step in self.depth.three)
        packed, _, which = _distinct(a << 2 * self.BITS | b << self.BITS | c)
        full = np.zeros(len(self.body), np.int64)
        full[self.long_at] = which
        return packed, full

    @property
    def triples(self) -> tuple[np.ndarray, ...]:
        """The distinct triples of names by number, as three columns of numbers of level 1."""
        packed, low = self._level_2[0], (1 << self.BITS) - 1
        return packed >> 2 * self.BITS, packed >> self.BITS & low, packed & low

    @cached_property
    def own(self) -> np.ndarray:
        return np.flatnonzero(self.offset < self.starts[self.chunk])

    @property
    def state(self) -> bytes:
        """What the merged lists need of the levels: each sampled place's number of level 2 and each own start's bucket."""
        return _pack(np.concatenate([self._level_2[1][self.long_at], self._bucket_at]).astype(np.int32))

    def restore(self, state: bytes) -> Block:
        both, long = _unpack(state, np.int32), len(self.long_at)
        full = np.zeros(len(self.body), np.int64)
        full[self.long_at] = both[:long]
        self._level_2, self._bucket_at = (np.empty(0, np.int64), full), both[long:]
        return self

    def strings(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One merged list's distinct strings in order (bytes before and behind as one number, number of level 2, bucket, count) and each start's own: -1 for starts not in the list."""
        d, at = self.depth, self.own
        pick = np.flatnonzero(self.kind[at] != WITHOUT[number])
        p = at[pick]
        front, back = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for j in range(number):
            front = front << 8 | self.body[p + j]
        for j in range(number + d.whole, d.length):
            back = back << 8 | self.body[p + j]
        behind = 8 * (d.rest - number)
        packed, some, which = _distinct(front << self.BITS + behind | self._level_2[1][p + number] << behind | back)
        count = np.minimum(np.bincount(which, weights=self.counts[self.chunk[p]], minlength=len(packed)), 2).astype(np.uint8)
        mine = np.full(len(at), -1, np.int64)
        mine[pick] = which
        low = (1 << behind) - 1
        return (packed >> self.BITS + behind << behind) | (packed & low), packed >> behind & ((1 << self.BITS) - 1), self._bucket_at[pick[some]], count, mine

    def bucket(self, at: np.ndarray) -> np.ndarray:
        """The ranges of the first bytes at those places: by eight of them, and by all where a bound has the same eight."""
        head = _windows(self.body, at, 8).view(">u8").astype(np.uint64)
        bound = np.array([int.from_bytes(x[:8].ljust(8, b"\0"), "big") for x in self.bounds.tolist()], np.uint64)
        out = np.searchsorted(bound, head, side="right").astype(np.int32)
        tied = np.flatnonzero(np.isin(head, bound))
        out[tied] = np.searchsorted(self.bounds, _windows(self.body, at[tied], BOUND), side="right")
        return out

    @cached_property
    def _bucket_at(self) -> np.ndarray:
        """The range of each own start."""
        out = np.empty(len(self.own), np.int32)
        plain = self.kind[self.own] == 0
        out[plain] = self.bucket(self.own[plain])
        _, bucket, number = self._level_1
        out[~plain] = bucket[number[self.own[~plain]]]
        return out


#: The merged lists hold two remainders each, all but these, and rank suffixes as many bytes on as their numbers say.
WITHOUT = (0, 2, 1)
#: In place of a level and a bucket: a block's state, which goes along with its names. Its own bucket on the way is below.
STATE = -1
ASKED = "level long, bucket long, block long, a binary, b binary, c binary"


def _cells(level: int, bucket: int, block: int, a: bytes, b: bytes = b"", c: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (level, bucket, block)), *(pa.array([x], pa.binary()) for x in (a, b, c))], ["level", "bucket", "block", "a", "b", "c"])


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets in ascending order to (bucket, its places)."""
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[x]), slice(x, y)


def _ask_words(blocks: DataFrame, bounds: np.ndarray, length: int) -> DataFrame:
    """Each block's distinct triples of words, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=2)
        for batch in batches:
            for row in batch.to_pylist():
                keys, bucket = Block(row, Depth(length), bounds).words
                for b, s in _slices(bucket):
                    yield _cells(1, b, row["block"], squeeze.compress(keys[s].tobytes()))

    return blocks.mapInArrow(run, ASKED)


def _name_words(table: pa.Table, word: int) -> pa.Table:
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), f"S{word}") for raw in table.column("a").to_pylist()]
    keys = np.concatenate(parts)
    return _named(table, np.argsort(keys), lambda order: keys[order[1:]] != keys[order[:-1]], [len(p) for p in parts])


def _name_triples(table: pa.Table) -> pa.Table:
    if table.column("level")[0].as_py() == STATE:
        return _as_it_is(table)
    columns = [[_unpack(raw, np.uint64) for raw in table.column(c).to_pylist()] for c in ("a", "b", "c")]
    a, b, c = (np.concatenate(x) for x in columns)
    return _named(table, np.lexsort((c, b, a)), lambda order: (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]) | (c[order[1:]] != c[order[:-1]]), [len(x) for x in columns[0]])


def _as_it_is(table: pa.Table) -> pa.Table:
    return pa.table({"block": table.column("block"), "bucket": pa.array([STATE], pa.int64()), "names": table.column("a")})


def _named(table: pa.Table, order: np.ndarray, differs, sizes: list[int]) -> pa.Table:  # noqa: ANN001
    """Equal keys of a bucket get equal names, in the order of the keys; the names of each block's keys as steps from one to the next."""
    bucket = table.column("bucket")[0].as_py()
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(np.concatenate([[True], differs(order)])) + (bucket << 32)
    steps = [_pack(np.diff(x, prepend=0)) for x in np.split(names, np.cumsum(sizes)[:-1])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "names": pa.array(steps, pa.binary())})


NAMED = "block long, bucket long, names binary"


def _given(table: pa.Table) -> np.ndarray:
    """A block's names in the order of its keys, from the buckets' answers."""
    parts = sorted((k, x) for k, x in zip(table.column("bucket").to_pylist(), table.column("names").to_pylist(), strict=True) if k != STATE)
    return np.concatenate([np.cumsum(_unpack(raw, np.int64)) for _, raw in parts]).astype(np.uint64)


def _ask_triples(blocks: DataFrame, named: DataFrame, bounds: np.ndarray, length: int) -> DataFrame:
    """Each block's distinct triples of names; a triple's bucket is that of its first name."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            names, block = _given(right), Block(row, Depth(length), bounds)
            a, b, c = (names[x] for x in block.triples)
            out.append(_cells(STATE, STATE - 1 - row["block"], row["block"], block.state))
            out += [_cells(2, k, row["block"], *(_pack(x[s]) for x in (a, b, c))) for k, s in _slices((a >> K.U64(32)).astype(np.int64))]
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(run, ASKED)


# --- step 4: merged lists ----------------------------------------------------------------------------------------


def _by_bucket(block: Block, number: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """A list's strings (around, rank, count) dealt to buckets: these, their buckets, their order, and each start's own."""
    around, long, bucket, count, mine = block.strings(number)
    order = np.argsort(bucket, kind="stable")
    return (around[order], long[order], count[order]), bucket[order], order, mine


def _ask_order(blocks: DataFrame, named: DataFrame, bounds: np.ndarray, length: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            state = right.column("names")[right.column("bucket").to_pylist().index(STATE)].as_py()
            names, block = _given(right), Block(row, Depth(length), bounds).restore(state)
            for number in range(3):
                (around, long, count), bucket, _, _ = _by_bucket(block, number)
                out += [_cells(number, k, row["block"], _pack(around[s].astype(np.uint32)), _pack(names[long[s]]), _pack(count[s])) for k, s in _slices(bucket)]
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(run, ASKED)


def _dense(x: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct ones."""
    return _distinct(x)[2].astype(np.uint64)


def _compare(table: pa.Table, rest: int) -> pa.Table:
    """One list's bucket in suffix order: a string repeats if a neighbour's first bytes are the same, or if it has a count above 1."""
    columns = [[_unpack(raw, t) for raw in table.column(c).to_pylist()] for c, t in (("a", np.uint32), ("b", np.uint64), ("c", np.uint8))]
    around, rank, counts = (np.concatenate(x) for x in columns)
    around = around.astype(np.uint64)
    behind = K.U64(8 * (rest - table.column("level")[0].as_py()))
    # bytes before, rank and bytes behind as one number
    front, back, low = around >> behind, around & np.uint64((1 << int(behind)) - 1), _dense(rank)
    order = np.argsort(front << (behind + K.U64(32)) | low << behind | back)
    same = (rank[order[1:]] == rank[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
    hit = counts[order] > 1
    hit[1:] |= same
    hit[:-1] |= same
    repeats = np.empty(len(hit), bool)
    repeats[order] = hit
    flags = [np.packbits(x).tobytes() for x in np.split(repeats, np.cumsum([len(x) for x in columns[0]])[:-1])]
    return pa.table({"block": table.column("block"), "level": table.column("level"), "bucket": table.column("bucket"), "flags": pa.array(flags, pa.binary())})


def _repeated_starts(blocks: DataFrame, told: DataFrame, bounds: np.ndarray, length: int) -> DataFrame:
    """(key, runs) of every chunk with repeated starts: [first, last) in the chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, runs = [], []
        flags_of = {(r["level"], r["bucket"]): r["flags"] for r in right.to_pylist()}
        for row in left.to_pylist():
            block = Block(row, Depth(length), bounds).restore(flags_of[STATE, STATE])
            repeats = np.zeros(len(block.own), bool)
            for number in range(3):
                _, bucket, order, mine = _by_bucket(block, number)
                flags = np.zeros(len(order), bool)
                for k, s in _slices(bucket):
                    flags[order[s]] = np.unpackbits(np.frombuffer(flags_of[number, k], np.uint8), count=s.stop - s.start).astype(bool)
                inside = mine >= 0
                repeats[inside] |= flags[mine[inside]]
            mark = np.zeros(len(block.body) + 1, np.int8)  # starts of two chunks never touch: a chunk ends in length - 1 bytes without starts
            mark[block.own[repeats]] = 1
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark])))
            firsts, lasts = edge[0::2], edge[1::2]
            chunk = block.chunk[firsts]
            pairs = np.stack([firsts, lasts], axis=1) - block.first[chunk][:, None]
            for c, s in _slices(chunk):
                keys.append(row["keys"][16 * c : 16 * c + 16])
                runs.append(pairs[s].ravel().tolist())
        return pa.table({"key": pa.array(keys, pa.binary()), "runs": pa.array(runs, pa.list_(pa.int32()))})

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "key binary, runs array<int>")


def _bounds(chunks: DataFrame, total: int) -> np.ndarray:
    """Bounds of ranges of the first bytes, a range for BUCKET_BYTES of chunks: those of Spark's range partitioning of every 2,048th place."""
    n = total // BUCKET_BYTES + 1
    places = F.sequence(F.pmod(F.xxhash64("key"), F.lit(2048)).cast("int"), F.length("body") + 2047, F.lit(2048))
    heads = chunks.select(F.explode(F.transform(places, lambda i: F.substring("body", F.least(i, F.length("body") - BOUND) + 1, BOUND))).alias("head")).distinct()
    rows = heads.repartitionByRange(n, "head").groupBy(F.spark_partition_id().alias("part")).agg(F.min("head").alias("head")).collect()  # one row a bucket
    return np.array(sorted(bytes(r["head"]) for r in rows)[1:], f"S{BOUND}")


def repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """(id, mark, text) to (id, mark, runs): [first, last) of every run of starts of repeated strings, for texts that have any."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    picked = cut(_print_rows(docs, length))
    common = cut(picked.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1").select("hash", "rows"))
    lists = cut(join_counted(picked, common, "hash", "rows", ["id", "mark"]).groupBy("id", "mark").agg(F.collect_set("hash").alias("shared")))
    drop(picked, common)
    chunks = cut(_chunk_rows(docs.join(lists, ["id", "mark"]), length))
    drop(lists)
    first = [F.first(c).alias(c) for c in ("body", "starts", "near")]
    folded = cut(chunks.groupBy("key").agg(*first, F.count("*").alias("count")))
    total = folded.agg(F.sum(F.length("body"))).first()[0] or 0
    bounds = _bounds(folded, total)
    blocks = cut(_blocks(folded.repartitionByRange(total // BLOCK_BYTES + 1, "near", "key").sortWithinPartitions("near", "key")))
    word, rest = Depth(length).word, Depth(length).rest
    named = cut(_ask_words(blocks, bounds, length).groupBy("bucket").applyInArrow(lambda t: _name_words(t, word), NAMED))
    longer = cut(_ask_triples(blocks, named, bounds, length).groupBy("bucket").applyInArrow(_name_triples, NAMED))
    drop(named)
    told = cut(_ask_order(blocks, longer, bounds, length).groupBy("level", "bucket").applyInArrow(lambda t: _compare(t, rest), "block long, level long, bucket long, flags binary"))
    states = longer.where(F.col("bucket") == STATE).select("block", F.col("bucket").alias("level"), "bucket", F.col("names").alias("flags"))
    runs = cut(_repeated_starts(blocks, told.union(states), bounds, length).join(folded.select("key", "count"), "key"))
    drop(blocks, longer, told, folded)
    found = join_counted(chunks.select("id", "mark", "at", "key"), runs, "key", "count", ["id", "mark", "at"])
    found = found.select("id", "mark", F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
    out = cut(found.distinct().groupBy("id", "mark").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    drop(chunks, runs)
    return out


def removed(size: int, runs: np.ndarray, length: int) -> np.ndarray:
    """Which of a text's bytes the runs of repeated starts cover."""
    gone = np.zeros(size + 1, np.int32)
    np.add.at(gone, runs[0::2], 1)
    np.add.at(gone, runs[1::2] + length - 1, -1)
    return np.cumsum(gone)[:size] > 0


def with_runs(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(row, id, text, runs): each row whose id is not null as a struct of all its columns, its text (null: empty), and its runs or null."""
    docs = docs.where(F.col(id_col).isNotNull())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    runs = repeated(rows.select("id", "mark", "text"), length)
    return rows.join(runs, ["id", "mark"], "left").select("row", "id", "text", "runs")


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document; kept is what is left of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, rows, held, first = batch.column("runs"), [], 0, 0
            for i, own in _texts(batch):
                gone = removed(len(own), runs[i].values.to_numpy(), length) if runs[i].is_valid else np.zeros(len(own), bool)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(own), int(gone.sum()), spans, own[~gone].tobytes()))
                held += len(own)
                if held >= 8 << 20 or i + 1 == batch.num_rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])
                    rows, held, first = [], 0, i + 1

    found = with_runs(docs.select(id_col, text_col), id_col, text_col, length).select("id", "text", "runs")
    return found.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7(docs: DataFrame) -> DataFrame:
    return strip(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
