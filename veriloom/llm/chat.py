"""Chat formatting with minimum-cost role repair.

A legal conversation is one optional system turn, then user and assistant turns in alternation, ended by the assistant.
Each input turn may keep its role, take another (relabel), or join the turn before it (merge); empty turns may be
inserted. Dynamic programming over the automaton of the last emitted role finds the cheapest repair. The automaton has
four states, so a stretch of turns is a 4 x 4 table of costs between entry and exit, and tables of stretches compose:
the rows of all conversations are sorted over range partitions and cut, by their number in the conversation, into
chunks; their tables are joined per conversation, and each chunk is then traced with its entry and exit fixed. No task
needs the turns of a whole conversation, however many rows it has and whatever their turn numbers are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, only, staged

CHUNK = 256
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs: any other role has to be relabelled at the lower price, as it can't stay.
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
#: Spellings that mean one of the three roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}
#: Empty turns to insert between the last role and the next; missing pairs are illegal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
INFINITE = 1 << 40
_MARKER = re.compile(rf"<(\\*)\|({'|'.join(ROLES)})\|>")


def role_of(name: str | None) -> int:
    """1 to 3 for a known role, 0 for any other."""
    key = (name or "").strip().lower()
    key = ALIASES.get(key, key)
    return ROLES.index(key) + 1 if key in ROLES else 0


def _moves(role: int) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, action), the preferred ones first among equals."""
    out = []
    for (a, b), gap in BETWEEN.items():
        change = 0 if b == role else RELABEL if role else RELABEL_UNKNOWN
        out.append((a, b, change + INSERT * len(gap), "keep" if b == role else "relabel"))
    for a in (SYSTEM, USER, ASSISTANT):
        change = 0 if a == role else RELABEL if role else RELABEL_UNKNOWN
        out.append((a, a, change + MERGE, "merge"))
    return out


MOVES = [_moves(r) for r in range(4)]
END_COST = (0, 2 * INSERT, INSERT, 0)


def table_of(roles: list[int]) -> np.ndarray:
    """Least costs from each entry state to each exit state."""
    m = np.full((4, 4), INFINITE, np.int64)
    np.fill_diagonal(m, 0)
    for r in roles:
        new = np.full((4, 4), INFINITE, np.int64)
        for a, b, c, _ in MOVES[r]:
            np.minimum(new[:, b], m[:, a] + c, out=new[:, b])
        m = np.minimum(new, INFINITE)
    return m


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, int, str]]:
    """(state before, state after, action) of every turn on the cheapest way from ``entry`` to ``leave``."""
    costs = [[INFINITE] * 4 for _ in range(len(roles) + 1)]
    back: list[list] = [[None] * 4 for _ in range(len(roles) + 1)]
    costs[0][entry] = 0
    for i, r in enumerate(roles):
        for a, b, c, act in MOVES[r]:
            if costs[i][a] + c < costs[i + 1][b]:
                costs[i + 1][b], back[i + 1][b] = costs[i][a] + c, (a, b, act)
    out, state = [], leave
    for i in range(len(roles), 0, -1):
        step = back[i][state]
        out.append(step)
        state = step[0]
    return out[::-1]


def escaped(text: str) -> str:
    """A text that forges no turn: where it holds the beginning of a role's marker, a backslash parts it (and one more
    stands where backslashes stood)."""
    return _MARKER.sub(lambda m: f"<{m[1]}\\|{m[2]}|>", text) if "|" in text else text


def shown(role: int, text: str) -> str:
    """One rendered turn."""
    return f"<|{ROLES[role - 1]}|>\n{escaped(text)}\n"


_TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
PIECES = "conv_id long, part long, nth long, local long, size long, turns array<struct<turn:long,role:string,text:string>>"
PIECE_CHARS = 8 << 20


def _cut(chunk: int):
    """Sorted rows as pieces of at most ``chunk`` turns of one conversation, fewer where these pass ``PIECE_CHARS``: ``nth`` numbers the conversations of the
    partition, ``local`` the piece's first row among the conversation's rows there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, local, chars, own = TaskContext.get().partitionId(), -1, 0, 0, 0
        conv: int | None = None
        turns: list[dict] = []
        out: list[tuple] = []

        def put() -> None:
            nonlocal turns, local, own
            if turns:
                out.append((conv, part, nth, local, len(turns), turns))
                local += len(turns)
                turns, own = [], 0

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 5 + [_TURNS])], ["conv_id", "part", "nth", "local", "size", "turns"])

        for b in batches:
            for c, turn, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if nth < 0 or c != conv:
                    put()
                    conv, nth, local = c, nth + 1, 0
                turns.append({"turn": turn, "role": role, "text": text})
                chars += len(text or "")
                own += len(text or "")
                if len(turns) == chunk or own > PIECE_CHARS:
                    put()
                if chars > PIECE_CHARS:
                    yield batch_of()
                    chars = 0
        put()
        yield batch_of()

    return run


def _offsets(pieces: DataFrame) -> list[tuple[int, int]]:
    """(partition, rows of its first conversation in the partitions before), where there are some. One row a partition
    comes to the driver."""
    rows = F.col("local") + F.col("size")
    first = F.col("nth") == 0
    ends = pieces.groupBy("part").agg(
        F.max(F.struct("nth", rows.alias("rows"), "conv_id")).alias("last"), F.max(F.when(first, rows)).alias("rows"), F.max(F.when(first, F.col("conv_id"))).alias("conv_id")
    )
    out, before = [], None
    for e in sorted(ends.collect(), key=lambda e: e.part):
        offset = before[1] if before and before[0] == e.conv_id else 0
        if offset:
            out.append((e.part, offset))
        before = (e.last.conv_id, e.last.rows + (offset if e.last.nth == 0 else 0))
    return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = [table_of([role_of(t["role"]) for t in turns]).ravel().tolist() for turns in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.int64()))], ["conv_id", "chunk", "costs"])


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the entry and exit state of every chunk, and the total cost."""
    for b in batches:
        out = []
        for conv, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cost, back = [0, INFINITE, INFINITE, INFINITE], []
            for c in chunks:
                m = np.array(c["costs"]).reshape(4, 4)
                every = np.array(cost)[:, None] + m
                back.append(every.argmin(axis=0))
                cost = np.minimum(every.min(axis=0), INFINITE).tolist()
            ends = [x + e for x, e in zip(cost, END_COST)]
            state = int(np.argmin(ends))
            for i in range(len(chunks) - 1, -1, -1):
                entry = int(back[i][state])
                out.append((conv, chunks[i]["chunk"], entry, state, min(ends), i == len(chunks) - 1))
                state = entry
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "chunk", "entry", "leave", "cost", "is_last"])


REPAIRED = "conv_id long, chunk long, place long, turn long, role string, action string, new_role string, n_inserted long, conv_cost long, rendered string"


def _repaired(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The turns of pieces, each at its number in the conversation: the ``place`` in the ``chunk``."""
    for b in batches:
        out = []
        for conv, at, turns, entry, leave, cost, is_last in zip(*(b.column(i).to_pylist() for i in range(7))):
            steps = trace([role_of(t["role"]) for t in turns], entry, leave)
            for i, (t, (before, after, action)) in enumerate(zip(turns, steps)):
                text = t["text"] or ""
                gap = () if action == "merge" else BETWEEN[before, after]
                rendered = f"{escaped(text)}\n" if action == "merge" else "".join(shown(g, "") for g in gap) + shown(after, text)
                n = len(gap)
                if is_last and i == len(turns) - 1:
                    tail = (USER, ASSISTANT) if after == SYSTEM else (ASSISTANT,) if after == USER else ()
                    rendered += "".join(shown(g, "") for g in tail)
                    n += len(tail)
                out.append((conv, (at + i) // size, (at + i) % size, t["turn"], t["role"], action, ROLES[after - 1], n, cost, rendered))
        cols = list(zip(*out)) if out else [[]] * 10
        kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in REPAIRED.split(", ")])


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per turn, in the order ``conv_id, chunk, place``:
    ``turn, role, action (keep, relabel, merge), new_role, n_inserted, conv_cost, rendered``.

    Turns are ordered by turn, then role, then text, nulls first; equal rows stay separate turns. ``rendered`` is the
    turn's share of the rendered conversation, inserted empty turns included, so the shares of a conversation in order
    are its whole text. A text can't forge a turn: a role's marker in it gets a backslash (see :func:`escaped`). An unknown or null role is
    relabelled or merged; a null text is empty; a null conv_id is a
    conversation of its own; a null turn stands before all. An empty table gives no rows; extra columns are ignored.
    """
    one = only(conversations, "conv_id", "turn", "role", "text").withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    order = ("conv_id", "turn", "role", "text", "_id")  # the last one parts equal rows
    one = one.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_id")
    pieces = staged(one.transform(in_arrow, _cut(chunk), PIECES), "chunks")
    offsets = _offsets(pieces)
    more = F.broadcast(one.sparkSession.createDataFrame(offsets, "part long, before long"))
    turns = pieces.join(more, "part", "left")
    # a piece's number is that of its first row in the conversation
    turns = turns.withColumn("chunk", F.col("local") + F.when(F.col("nth") == 0, F.coalesce("before", F.lit(0))).otherwise(0)).select("conv_id", "chunk", "turns")
    tables = turns.transform(in_arrow, _tables, "conv_id long, chunk long, costs array<long>")
    whole = tables.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "costs"))).alias("chunks"))
    ways = whole.transform(in_arrow, _ways, "conv_id long, chunk long, entry long, leave long, cost long, is_last boolean")
    ways = ways.withColumnsRenamed({"conv_id": "_conv", "chunk": "_chunk"})
    both = turns.join(ways, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
    return both.select("conv_id", "chunk", "turns", "entry", "leave", "cost", "is_last").transform(in_arrow, lambda batches: _repaired(batches, chunk), REPAIRED)
