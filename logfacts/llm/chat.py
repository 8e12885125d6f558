"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, with an assistant turn
at the end. Each given turn is kept, relabelled, or merged into the turn before it, and empty turns may be put in
between; dynamic programming over the automaton of legal turns finds the cheapest way, and of equally cheap ways the
one whose states come first in order, from the first turn on. The repaired turns are then rendered.

Conversations are sorted across all partitions, so one of any length is cut into slices that lie in neighbouring
partitions. A slice is summed up by the cheapest cost between its states on entry and exit; two such summaries per
partition at most are brought together, and from them each partition learns the state at its edges. The result does
not depend on where the cuts are, and no conversation has to fit into one task.

Rows: a null conversation id is left out; a null turn number comes first; rows with equal turn numbers go in order of
role and text; repeated rows are turns each; roles are compared without case or spaces around them, and a null or
unknown role can only be relabelled or merged; a null text is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.llm.shared import checkpoint_root

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn. Legal next turns of each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, RELABEL_UNKNOWN, MERGE, MERGE_OTHER, INSERT = 3, 1, 1, 4, 2
FAR = 1 << 60
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def _inserted(most: int = 3) -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest ways from state to state by empty turns alone."""
    ways = {(s, s): () for s in range(4)}
    for _ in range(most):
        for (a, b), way in list(ways.items()):
            for c in NEXT[b]:
                if (a, c) not in ways:
                    ways[a, c] = (*way, c)
    return ways


def _moves(given: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """For a turn of that role (0: unknown), the cheapest cost, action and empty turns from state to state."""
    best: dict = {}
    for (a, b), way in _inserted().items():
        options = [(0 if c == given else RELABEL if given else RELABEL_UNKNOWN, "keep" if c == given else "relabel", c) for c in NEXT[b]]
        if b != START:
            options.append((MERGE if b == given else MERGE_OTHER if given else MERGE, "merge", b))
        for cost, action, c in options:
            entry = (cost + INSERT * len(way), len(way), action, way)
            if (a, c) not in best or entry < best[a, c]:
                best[a, c] = entry
    return {k: (cost, action, way) for k, (cost, _, action, way) in best.items()}


MOVES = [_moves(g) for g in range(4)]
COST = [[[m[a, b][0] if (a, b) in m else FAR for b in range(4)] for a in range(4)] for m in MOVES]
#: What it costs to end in a state, and the empty turns that this takes.
ENDING = [_inserted()[s, ASSISTANT] if (s, ASSISTANT) in _inserted() else () for s in range(4)]
END_COST = [FAR if s == START else INSERT * len(ENDING[s]) for s in range(4)]


def _before(role: int, after: list[int]) -> list[int]:
    cost = COST[role]
    return [min(row[b] + after[b] for b in range(4)) for row in cost]


def _summary(roles: list[int]) -> list[list[int]]:
    """The cheapest cost from each state on entry to each state on exit."""
    columns = []
    for b in range(4):
        after = [0 if s == b else FAR for s in range(4)]
        for role in reversed(roles):
            after = [min(FAR, v) for v in _before(role, after)]
        columns.append(after)
    return [[columns[b][a] for b in range(4)] for a in range(4)]


def _walk(roles: list[int], state: int, rest: list[int]) -> Iterator[tuple[int, int]]:
    """The states before and after each turn of the best way, if going on from the last one costs rest."""
    togo = [rest]
    for role in reversed(roles):
        togo.append([min(FAR, v) for v in _before(role, togo[-1])])
    togo.reverse()
    for i, role in enumerate(roles):
        nxt = min(range(4), key=lambda b: (COST[role][state][b] + togo[i + 1][b], b))  # noqa: B023
        yield state, nxt
        state = nxt


def _slices(batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[int], list[int]]:
    """Roles of the partition's turns, the first turn of each conversation, and the conversations."""
    roles, firsts, convs = [], [], []
    for batch in batches:
        for conv, role in zip(batch.column("conv").to_pylist(), batch.column("given").to_pylist(), strict=True):
            if not convs or convs[-1] != conv:
                firsts.append(len(roles))
                convs.append(conv)
            roles.append(role)
    return roles, firsts, convs


def _edges(turns: DataFrame, summarise) -> list:
    """For each partition with rows: its first and its last slice as (partition, conv, where, result)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        roles, firsts, convs = _slices(batches)
        ends = [*firsts[1:], len(roles)]
        for i in sorted({0, len(convs) - 1} if convs else ()):
            flat = summarise(part, i == 0, i == len(convs) - 1, convs[i], roles[firsts[i] : ends[i]])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int64()), (convs[i], pa.int64()), (i, pa.int64()), (flat, pa.list_(pa.int64())))], ["part", "conv", "slice", "flat"])

    return sorted(tuple(r) for r in turns.select("conv", "given").mapInArrow(run, "part long, conv long, slice long, flat array<long>").collect())


def repair(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) to one row per turn: (conv, turn, role, action, new_role, inserted, rendered).

    The rendered pieces of a conversation, one after another in order of position, are its whole rendering.
    """
    checkpoint_root(turns.sparkSession)
    role = F.lower(F.trim("role"))
    given = F.coalesce(*(F.when(role == r, F.lit(i + 1)) for i, r in enumerate(ROLES)), F.lit(0)).alias("given")
    order = ["conv", "turn", "role", "text"]
    turns = turns.where("conv is not null").select("conv", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), given)
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()

    spread = [[part, conv, flat] for part, conv, _, flat in _edges(turns, lambda p, a, z, conv, roles: [v for row in _summary(roles) for v in row])]
    rest: dict[tuple[int, int], list[int]] = {}
    after = END_COST
    for i in range(len(spread) - 1, -1, -1):
        part, conv, flat = spread[i]
        if i + 1 == len(spread) or spread[i + 1][1] != conv:
            after = END_COST
        rest[part, conv] = after
        after = [min(FAR, min(flat[4 * a + b] + after[b] for b in range(4))) for a in range(4)]
    exits = _edges(turns, lambda p, a, z, conv, roles: [([*_walk(roles, s, rest[p, conv])][-1][1]) for s in range(4)])
    entry: dict[tuple[int, int], int] = {}
    last: dict[tuple[int, int], bool] = {}
    state, conv_before = START, None
    for i, (part, conv, _, flat) in enumerate(exits):
        state = state if conv == conv_before else START
        entry[part, conv] = state
        last[part, conv] = i + 1 == len(exits) or exits[i + 1][1] != conv
        state, conv_before = flat[state], conv

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = list(batches)
        roles, firsts, convs = _slices(iter(held))
        ways = []
        for a, b, conv in zip(firsts, [*firsts[1:], len(roles)], convs, strict=True):
            ends = last.get((part, conv), True)
            way = list(_walk(roles[a:b], entry.get((part, conv), START), rest.get((part, conv), END_COST)))
            ways += [(s, t, ends and i + 1 == b - a) for i, (s, t) in enumerate(way)]
        at = 0
        for batch in held:
            rows = []
            for text in batch.column("text").to_pylist():
                state, after, final = ways[at]
                _, action, way = MOVES[roles[at]][state, after]
                rows.append((action, ROLES[after - 1], len(way) + (len(ENDING[after]) if final else 0), _rendered(state, after, action, way, final, text)))
                at += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            where = pa.array([(part << 33) + i for i in range(at - len(rows), at)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("role"), where, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv", "turn", "role", "position", "action", "new_role", "inserted", "rendered"])

    return turns.mapInArrow(run, "conv long, turn long, role string, position long, action string, new_role string, inserted long, rendered string")


def _rendered(state: int, after: int, action: str, way: tuple[int, ...], final: bool, text: str) -> str:
    text = text.replace("<|im_", "< |im_")  # the markers stay ours alone
    out = [CLOSE] if way and state != START else []
    out += [OPEN.format(ROLES[s - 1]) + CLOSE for s in way[:-1]]
    if way:
        # the last empty turn stays open for a merge, and is closed like any other for a new turn
        out.append(OPEN.format(ROLES[way[-1] - 1]))
    if action == "merge":
        out.append(text if way else JOIN + text)
    else:
        if way or state != START:
            out.append(CLOSE)
        out.append(OPEN.format(ROLES[after - 1]) + text)
    if final:
        out.append(CLOSE)
        out += [OPEN.format(ROLES[s - 1]) + CLOSE for s in ENDING[after]]
    return "".join(out)


def cheapest(roles: list[str | None]) -> int:
    """The cost of the best repair by trying every state sequence (for tests; exponential)."""
    given = [ROLES.index(r) + 1 if r in ROLES else 0 for r in roles]
    best = FAR
    for states in product(range(4), repeat=len(given)):
        path = (START, *states)
        total = sum(COST[g][a][b] for g, a, b in zip(given, path, path[1:], strict=False)) + END_COST[path[-1]]
        best = min(best, total)
    return best


def op10(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return repair(rows).withColumnRenamed("conv", "conv_id")
