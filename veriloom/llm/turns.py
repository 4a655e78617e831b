"""Conversation structure repair by rank-convergence parallel Viterbi.

The legal role sequences are ``(s?(ua)+)?``, an automaton of four states, so the least cost to go from a row on is a
vector of four numbers, and a row turns the vector behind it into the one before it. A conversation is cut into chunks
of rows, and the chunks are computed at once: each starts, at its right end, from a speculative vector, the last one
from the true one. Fix-up passes then give every chunk its successor's vector. Where it differs from the assumed one by
a constant only, the chunk stands, for a constant changes no decision; otherwise the chunk runs again, from the right,
until its vectors are parallel to those it had, which takes a few rows. Passes end when no chunk changes.

The stitched backward costs drive the trace: forwards, each step takes the first letter, in ASCII order, that still has
the least cost to go, which gives the least audit. A chunk is traced from each of the four states; where it leaves in
the same state whatever it was entered in, its successor's entry is known at once, and the others follow in passes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.base import in_arrow, maybe_broadcast, only, staged
from veriloom.llm.chat import _offsets
from veriloom.llm.textnum import strings

CHUNK = 256
#: A chunk also ends when its texts have so many characters.
CHUNK_CHARS = 1 << 20
WHITE = "\t\n\x0b\x0c\r "
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: What may follow without a system turn, and by whom.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: Faults of a row, as letters of a chunk's codes: none, truncated, blank, duplicate.
FINE, TRUNCATED, BLANK, DUPLICATE = "ftbd"
Vector = tuple[int, int, int, int]


def _closed(v: list[int]) -> Vector:
    """Least costs where rows may be inserted first."""
    for _ in range(2):
        for s in (USER, ASSISTANT, SYSTEM, START):
            v[s] = min(v[s], COST[INSERT] + v[NEXT[s]])
    return tuple(v)


def parallel(v: Vector) -> Vector:
    """The vector without its constant."""
    low = min(v)
    return tuple(x - low for x in v)


_FAR = 1 << 40
#: Costs to go behind the last row: nothing, or an assistant's row, ends a conversation.
END: Vector = _closed([0, _FAR, _FAR, 0])
SPECULATIVE: Vector = (0, 0, 0, 0)


def _steps(role: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, besides inserting one before it."""
    out = [(DELETE, COST[DELETE], state)]
    if fault in (FINE, TRUNCATED):
        more = fault == TRUNCATED
        at = INITIAL.get(role)
        if at == NEXT[state] or (at == SYSTEM and state == START):
            out.append((KEEP, COST[KEEP] + more, at))
        out.append((REROLE, COST[REROLE] + more, NEXT[state]))
    return out


@functools.cache
def before(role: str, fault: str, v: Vector) -> Vector:
    """The vector before a row, from the one behind it, both without their constants."""
    return parallel(_closed([min(c + v[to] for _, c, to in _steps(role, fault, s)) for s in STATES]))


@functools.cache
def step(role: str, fault: str, v: Vector, state: int) -> tuple[str, int]:
    """The letters up to and including the row's own, least in ASCII order among the cheapest, and the state behind it."""
    own = [min(c + v[to] for _, c, to in _steps(role, fault, s)) for s in STATES]
    least, letters = _closed(list(own)), ""
    while True:
        options = [(letter, to) for letter, c, to in _steps(role, fault, state) if c + v[to] == least[state]]
        if COST[INSERT] + least[NEXT[state]] == least[state]:
            options.append((INSERT, NEXT[state]))
        letter, to = min(options)
        letters, state = letters + letter, to
        if letter != INSERT:
            return letters, state


def ending(state: int) -> str:
    """Rows to insert behind the last one."""
    return INSERT * (END[state] // COST[INSERT])


def vectors(codes: str, right: Vector) -> list[Vector]:
    """The vectors behind every row of a chunk, and last the one before its first row, from right to left."""
    out = [right]
    for i in range(len(codes) - 2, -1, -2):
        out.append(before(codes[i], codes[i + 1], out[-1]))
    return out


def traced(codes: str, right: Vector, state: int) -> tuple[str, int]:
    """The letters of a chunk that is entered in ``state``, and the state behind it."""
    v = vectors(codes, right)
    letters = []
    for i in range(0, len(codes), 2):
        some, state = step(codes[i], codes[i + 1], v[len(codes) // 2 - 1 - i // 2], state)
        letters.append(some)
    return "".join(letters), state


# ---- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by ``crc32("conv_id:turn") % 20``: 0 drops the row, 1 empties its
    text, 2 takes out its ``.!?``, 3 repeats it, 4 makes the user its speaker. Nulls of a row count as one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    one = only(conversations, "conv_id", "turn", "role", "text").withColumn("_hit", F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20)
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(blank("role"))
    one = one.where("_hit <> 0").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "_hit")
    return one.withColumn("_copy", F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_hit", "_copy")


def faulty(rows: DataFrame) -> DataFrame:
    """Rows with ``fault``, the first that applies: blank, ``later`` (role and text stood at an earlier turn), truncated.

    Copies at one turn are told apart when rows are in order. Earlier turns are found by one row for each different role
    and text of a conversation, so neither a conversation nor a much repeated row is a group of its own."""
    seen = F.rtrim(F.col("text"), F.lit(WHITE))
    one = rows.withColumns({"digest": F.sha2("text", 256), "fault": F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)})
    first = one.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.bool_or(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_low"), F.max("turn").alias("_high"))
    first = first.where(F.col("_low").isNotNull() & (F.col("_null") | (F.col("_low") < F.col("_high")))).withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    first = maybe_broadcast(staged(first, "repeated-rows"), 150)  # only what is repeated at different turns
    one = one.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.col("turn").isNotNull() & F.coalesce(F.col("_null") | (F.col("turn") > F.col("_low")), F.lit(False))
    return one.select("conv_id", "turn", "role", "text", F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


_LIST = pa.list_(pa.string())
_CHUNK = [("conv_id", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("codes", pa.string()), ("roles", _LIST), ("texts", _LIST),
    ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("illegal", pa.int64())]
CHUNKS = "conv_id long, part long, nth long, local long, size long, codes string, roles array<string>, texts array<string>, low long, high long, n_turns long, first_turn long, last_turn long, illegal long"


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def _buffered(rows: Iterator[tuple[int, tuple]], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """(characters, row) -> batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for chars, row in rows:
        held.append(row)
        size += chars + 200
        if size > CHUNK_CHARS:
            yield _batch(held, fields)
            held, size = [], 0
    yield _batch(held, fields)


def _cut(most: int):
    """Sorted rows as chunks of one conversation: ``nth`` numbers the conversations of the partition, ``local`` the chunk's
    first row among the conversation's rows there. ``codes`` has two letters a row: the role's first one and the fault."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        part, nth, local = TaskContext.get().partitionId(), -1, 0
        conv: int | None = None
        rows: list[tuple] = []
        chars = 0
        last: tuple | None = None

        def put() -> Iterator[tuple[int, tuple]]:
            nonlocal rows, local, chars
            if rows:
                turns, roles = [r[0] for r in rows], [r[1] for r in rows]
                real = [t for t in turns if t is not None]
                changes = sum(1 for a, b in zip([None, *turns], turns) if b is not None and a != b)
                illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:]))
                codes = "".join((r[:1] or " ") + f for _, r, _, f in rows)
                ends = (min(real), max(real)) if real else (None, None)
                yield chars, (conv, part, nth, local, len(rows), codes, roles, [r[2] for r in rows], *ends, changes, turns[0], turns[-1], illegal)
                local += len(rows)
                rows, chars = [], 0

        for b in batches:
            for c, turn, role, text, fault in zip(*(strings(b.column(i)) for i in range(5))):
                if nth < 0 or c != conv:
                    yield from put()
                    conv, nth, local, last = c, nth + 1, 0, None
                elif len(rows) == most or chars > CHUNK_CHARS:
                    yield from put()
                if fault != BLANK and last == (turn, role, text):
                    fault = DUPLICATE
                last = (turn, role, text)
                rows.append((turn, role, text, fault))
                chars += len(text)
        yield from put()

    return lambda batches: _buffered(made(batches), _CHUNK)


def chunks(rows: DataFrame, most: int) -> DataFrame:
    """Staged chunks with ``start`` (their first row's number in the conversation) and ``alone`` (the conversation's only one)."""
    keys = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(64)))
    one = rows.repartitionByRange(*keys).sortWithinPartitions(*keys[:3], "text")
    cut = staged(one.select("conv_id", "turn", "role", "text", "fault").transform(in_arrow, _cut(most), CHUNKS), "turn-chunks")
    moved = cut.sparkSession.createDataFrame(_offsets(cut), "part long, before long")  # a row for each partition at most
    cut = cut.join(F.broadcast(moved), "part", "left").withColumn("start", F.col("local") + F.when(F.col("nth") == 0, F.coalesce("before", F.lit(0))).otherwise(0))
    several = cut.groupBy("conv_id").agg(F.sum("size").alias("_rows"), F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col("conv_id").alias("_conv"), "_rows")
    cut = cut.join(maybe_broadcast(staged(several, "conversations-of-several-chunks"), 32), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    alone = F.col("_rows").isNull()
    return cut.withColumns({"alone": alone, "is_last": alone | (F.col("start") + F.col("size") == F.col("_rows"))}).drop("_conv", "_rows", "part", "nth", "local", "before")


# ---- passes over conversations of several chunks

_VECTOR = pa.list_(pa.int64())


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, start, size, codes, was (vector it started from, or null), left (its result), right (what it should start
    from) -> the same with ``right`` as the start, and whether the result changed."""
    for b in batches:
        out = []
        for conv, start, size, codes, was, left, right in zip(*(b.column(i).to_pylist() for i in range(7))):
            new = tuple(right)
            if was is None:
                result, changed = vectors(codes, new)[-1], True
            else:
                old, i = tuple(was), len(codes) - 2
                while i >= 0 and new != old:  # until the vectors are parallel to those it had
                    new, old = before(codes[i], codes[i + 1], new), before(codes[i], codes[i + 1], old)
                    i -= 2
                result = tuple(left) if new == old else new
                changed = result != tuple(left)
            out.append((conv, start, size, codes, right, list(result), changed))
        yield _batch(out, [("conv_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("codes", pa.string()), ("was", _VECTOR), ("left", _VECTOR), ("changed", pa.bool_())])


PASS = "conv_id long, start long, size long, codes string, was array<long>, left array<long>, changed boolean"


def _literal(v: Vector):
    return F.array(*[F.lit(x).cast("long") for x in v])


def converged(several: DataFrame) -> DataFrame:
    """``several(conv_id, start, size, codes, is_last)`` -> ``conv_id, start, right``: the vector behind every chunk, up to
    a constant. Each pass is written, so lineage doesn't grow; it runs again the chunks whose successor changed."""
    guess = F.when(F.col("is_last"), _literal(parallel(END))).otherwise(_literal(SPECULATIVE))
    none = F.lit(None).cast("array<long>")
    state = several.select("conv_id", "start", "size", "codes", none.alias("was"), none.alias("left"), guess.alias("right")).transform(in_arrow, _fixed, PASS)
    state = staged(state, "viterbi-pass")
    while state.where("changed").head(1):
        ahead = state.select(F.col("conv_id").alias("_conv"), F.col("start").alias("_start"), F.col("left").alias("right"))
        both = state.join(ahead, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") + F.col("size") == F.col("_start")), "left")
        both = both.select("conv_id", "start", "size", "codes", "was", "left", F.coalesce("right", "was").alias("right"))
        stays = both.where("right = was").select("conv_id", "start", "size", "codes", "was", "left", F.lit(False).alias("changed"))
        state = staged(stays.unionByName(both.where("right <> was").transform(in_arrow, _fixed, PASS)), "viterbi-pass")
    return state.select("conv_id", "start", "size", "codes", F.col("was").alias("right"))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, start, size, codes, right -> the state behind the chunk by the state before it."""
    for b in batches:
        ways = [[traced(c, tuple(r), s)[1] for s in STATES] for c, r in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4)), pa.array(ways, _VECTOR)], ["conv_id", "start", "size", "right", "ways"])


def entered(known: DataFrame) -> DataFrame:
    """``known(conv_id, start, size, codes, right)`` -> ``conv_id, start, right, entry``: the state each chunk is entered in.

    The exit of a chunk is known when its entry is, or when all its ways end in one state; passes hand it on."""
    ways = known.transform(in_arrow, _ways, "conv_id long, start long, size long, right array<long>, ways array<long>")
    one_way = F.when(F.size(F.array_distinct("ways")) == 1, F.col("ways")[0])
    state = ways.withColumns({"entry": F.when(F.col("start") == 0, F.lit(START).cast("long")), "exit": one_way})
    state = staged(state.withColumn("exit", F.coalesce(F.get("ways", F.col("entry").cast("int")), "exit")), "viterbi-entries")
    while state.where("entry is null").head(1):
        behind = state.select(F.col("conv_id").alias("_conv"), (F.col("start") + F.col("size")).alias("_end"), F.col("exit").alias("_exit"))
        both = state.join(behind, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") == F.col("_end")), "left")
        both = both.withColumn("entry", F.coalesce("entry", "_exit")).withColumn("exit", F.coalesce(F.get("ways", F.col("entry").cast("int")), "exit"))
        state = staged(both.select(state.columns), "viterbi-entries")
    return state.select("conv_id", "start", "right", "entry")


# ---- results


def _lines(roles: list[str], texts: list[str], letters: str, state: int) -> Iterator[str]:
    """The repaired rows, as ``role:text``."""
    i = 0
    for letter in letters:
        if letter == INSERT:
            state = NEXT[state]
            yield f"{NAME[state]}:"
            continue
        if letter == REROLE:
            state = NEXT[state]
            yield f"{NAME[state]}:{texts[i]}"
        elif letter == KEEP:
            state = INITIAL[roles[i][:1]]
            yield f"{roles[i]}:{texts[i]}"
        i += 1


_DONE = [("conv_id", pa.int64()), ("start", pa.int64()), ("gaps", pa.int64()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.string()), ("n_lines", pa.int64()),
    ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("ends", pa.string())]
DONE = "conv_id long, start long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, n_lines long, low long, high long, n_turns long, first_turn long, last_turn long, ends string"


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """Chunks with their right vector and entry -> the chunk's share of every result; a conversation's only chunk has
    the digest instead of its text."""
    for b in batches:
        for row in range(b.num_rows):
            r = b.slice(row, 1).to_pylist()[0]
            codes, state = r["codes"], r["entry"]
            letters, leave = traced(codes, tuple(r["right"]), state)
            letters += ending(leave) if r["is_last"] else ""
            lines = list(_lines(r["roles"], r["texts"], letters, state))
            text = "\n".join(lines)
            if r["alone"]:
                text = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            faults, own = codes[1::2], [x for x in letters if x != INSERT]
            cost = sum(COST[x] for x in letters) + sum(f == TRUNCATED and x != DELETE for f, x in zip(faults, own))
            gaps = r["high"] - r["low"] + 1 - r["n_turns"] if r["low"] is not None else 0
            out = (r["conv_id"], r["start"], gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), r["illegal"], cost, letters, text, len(lines))
            yield len(text), (*out, r["low"], r["high"], r["n_turns"], r["first_turn"], r["last_turn"], codes[0] + codes[-2])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _buffered(_shares(batches), _DONE)


_RESULT = [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """Chunks' shares, sorted by conversation and start -> one row a conversation. A digest has to be taken in the order of
    the text; it is taken as the chunks stream by, so a conversation of any length needs no more memory than its audit."""
    conv: int | None = None
    total: list[int] | None = None
    low = high = turn = None
    turns, digest, any_line, end, audit = 0, hashlib.sha256(), False, "", []

    def done() -> Iterator[tuple[int, tuple]]:
        if total is not None:
            gaps = high - low + 1 - turns if low is not None else 0
            yield len(audit), (conv, gaps, *total, "".join(audit), digest.hexdigest())

    for b in batches:
        for row in range(b.num_rows):
            r = b.slice(row, 1).to_pylist()[0]
            if total is None or r["conv_id"] != conv:
                yield from done()
                conv, total, low, high, turn, turns, digest, any_line, end, audit = r["conv_id"], [0] * 5, None, None, None, 0, hashlib.sha256(), False, "", []
            for i, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                total[i] += r[name]
            total[3] += bool(end) and end + r["ends"][0] not in LEGAL
            end = r["ends"][1]
            if r["low"] is not None:
                low, high = (r["low"], r["high"]) if low is None else (min(low, r["low"]), max(high, r["high"]))
            turns += r["n_turns"] - (turn is not None and turn == r["first_turn"])
            turn = r["last_turn"]
            if r["n_lines"]:
                digest.update((b"\n" if any_line else b"") + r["repaired"].encode("utf-8", "surrogatepass"))
                any_line = True
            audit.append(r["audit"])
    yield from done()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _buffered(_whole(batches), _RESULT)


def structure_repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` -> one row a conversation: ``gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``.

    Rows go by turn, nulls first; ties go by role, then text. A row's fault is the first of: blank (nothing but white
    space), duplicate (role and text seen earlier), truncated (no ``.!?`` at its end). Keeping a row costs 0, giving it
    to the user or the assistant (R) 2, deleting it (D, needed for the first two faults) 3, inserting an empty row of
    either (I) 2, and a truncated row that stays 1 more. ``audit`` has the letters of the cheapest edits whose roles'
    first letters read ``(s?(ua)+)?``, the least in ASCII order. ``gaps`` counts turns that are missing between the
    smallest and the largest, ``illegal`` neighbours other than su, ua and au. Null roles and texts count as one blank; a
    null conv_id is a conversation of its own; equal rows stay separate; an empty table gives no rows; extra columns are
    ignored.
    """
    one = only(rows, "conv_id", "turn", "role", "text").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    cut = chunks(faulty(one), chunk)
    alone = cut.where("alone").withColumns({"right": _literal(parallel(END)), "entry": F.lit(START).cast("long")})
    several = staged(cut.where("not alone").select("conv_id", "start", "size", "codes", "is_last"), "long-conversations")
    way = entered(converged(several)).withColumnsRenamed({"conv_id": "_conv", "start": "_start"})
    rest = cut.where("not alone").join(way, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") == F.col("_start"))).select(alone.columns)
    shares = alone.transform(in_arrow, _repaired, DONE).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("repaired").alias("repaired_sha256"))
    long = rest.transform(in_arrow, _repaired, DONE).repartition("conv_id").sortWithinPartitions("conv_id", "start").transform(in_arrow, _joined, RESULT)
    return shares.unionByName(long)


def damaged_and_repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:func:`structure_repair` of the :func:`damaged` rows, for every conversation of the table: one of which no row is
    left has zeros, an empty audit and the digest of the empty text."""
    ids = only(conversations, "conv_id").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    got = structure_repair(damaged(conversations), chunk).withColumnRenamed("conv_id", "_conv")
    one = ids.join(got, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return one.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by a plain dynamic program: a recursive query walks all conversations row by row with the best (cost,
    audit, lines) of each state. A table-driven CRC-32 is part of it, as the engine has none."""

    def after(state: int, cost: str, letter: str, line: str | None = None) -> str:
        s = f"st[{state + 1}]"
        lines = f"{s}.t" if line is None else f"concat_ws(chr(10), {s}.t, {line})"
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {lines}}}"

    keep, more = "role || ':' || text", f"CASE WHEN fault = '{TRUNCATED}' THEN 1 ELSE 0 END"
    stays = f"fault IN ('{FINE}', '{TRUNCATED}')"

    def least(state: int, comes_from: list[int]) -> str:
        options = [after(state, "3", DELETE)]
        for s in comes_from:
            initial = next(k for k, v in INITIAL.items() if v == state)
            options.append(f"CASE WHEN {stays} AND role[1] = '{initial}' THEN {after(s, more, KEEP, keep)} END")
            if state in NAME:
                options.append(f"CASE WHEN {stays} THEN {after(s, f'2 + {more}', REROLE, repr(NAME[state] + ':') + ' || text')} END")
        return f"list_min([{', '.join(options)}])"

    steps = [least(START, []), least(SYSTEM, [START]), least(USER, [START, SYSTEM, ASSISTANT]), least(ASSISTANT, [USER])]
    user = f"list_min([st[3], {', '.join(after(s, '2', INSERT, repr('user:')) for s in (START, SYSTEM, ASSISTANT))}])"
    with_user = f"SELECT * REPLACE ([st[1], st[2], {user}, st[4]] AS st)"
    closed = f"""SELECT * REPLACE ([st[1], st[2], st[3], list_min([st[4], {after(USER, '2', INSERT, repr('assistant:'))}])] AS st) FROM ({with_user} FROM (%s))"""
    none = "{'c': 1000000000, 'a': '', 't': NULL::VARCHAR}"
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    return f"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
      crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
      keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations),
      hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM keyed, crc),
      harmed AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE h <> 0),
      placed AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, role, text, rtrim(text, {white}) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM harmed),
      rows AS (SELECT *, CASE WHEN seen = '' THEN '{BLANK}' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN '{DUPLICATE}' WHEN right(seen, 1) IN ('.', '!', '?') THEN '{FINE}' ELSE '{TRUNCATED}' END AS fault,
        CASE WHEN pos > 1 AND concat(lag(role) OVER (PARTITION BY conv ORDER BY pos)[1], role[1]) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM placed),
      dp(conv, pos, st) AS ({closed % f"SELECT DISTINCT conv, 0::BIGINT AS pos, [{{'c': 0, 'a': '', 't': NULL::VARCHAR}}, {none}, {none}, {none}] AS st FROM rows"}
        UNION ALL {closed % f"SELECT r.conv, r.pos, [{', '.join(steps)}] AS st FROM dp JOIN rows r ON r.conv = dp.conv AND r.pos = dp.pos + 1"}),
      last AS (SELECT conv, list_min([st[1], st[4]]) AS e FROM (SELECT conv, arg_max(st, pos) AS st FROM dp GROUP BY conv)),
      counts AS (SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = '{BLANK}') AS blank, count(*) FILTER (fault = '{DUPLICATE}') AS duplicate,
        count(*) FILTER (fault = '{TRUNCATED}') AS truncated, sum(illegal)::BIGINT AS illegal FROM rows GROUP BY conv)
      SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
        sha256(coalesce(e.t, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last USING (conv)"""


ORACLE = _oracle()
