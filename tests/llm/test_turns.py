"""Conversation structure repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from veriloom.llm import turns as T

D = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def brute(rows, damage=True):
    """conv_id -> result; least (cost, audit) of every state, row by row."""
    by_conv = {}
    for conv, turn, role, text in rows:
        mine = by_conv.setdefault(conv, [])
        role, text, times = " " if role is None else role, " " if text is None else text, 1
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        count = {"blank": 0, "duplicate": 0, "truncated": 0}
        seen, faults = set(), []
        for _, role, text in mine:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            if fault:
                count[fault] += 1
        real = [t for t, _, _ in mine if t is not None]
        gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        best = inserted({"": (0, "", ())})
        for (_, role, text), fault in zip(mine, faults):
            new = {}
            for state, (cost, audit, kept) in best.items():
                options = [(state, 3, "D", None)]
                if fault in ("", "truncated"):
                    more = fault == "truncated"
                    if role[:1] == ("a" if state == "u" else "u") or (role[:1] == "s" and state == ""):
                        options.append((role[:1], more, "K", f"{role}:{text}"))
                    to = "assistant" if state == "u" else "user"
                    options.append((to[0], 2 + more, "R", f"{to}:{text}"))
                for to, c, letter, line in options:
                    got = (cost + c, audit + letter, kept if line is None else (*kept, line))
                    new[to] = min(new.get(to, got), got, key=lambda x: x[:2])
            best = inserted(new)
        cost, audit, kept = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def inserted(best):
    for _ in range(3):
        for state, (cost, audit, kept) in list(best.items()):
            to = "assistant" if state == "u" else "user"
            got = (cost + 2, audit + "I", (*kept, f"{to}:"))
            best[to[0]] = min(best.get(to[0], got), got, key=lambda x: x[:2])
    return best


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def conversations(seed, n, longest):
    r = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "Übung", "s", "uncle"]
    texts = ["Yes.", "No", " \t\n", "", None, "What?\n", "é!\x0b", "Long words here", "…", "ü.", " ", "a.b"]
    out = []
    for conv in range(n):
        length = r.choice([1, 2, 3, 8, longest])
        alternate = r.random() < 0.5
        for i in range(length):
            role = ("user", "assistant")[i % 2] if alternate and r.random() < 0.9 else r.choice(roles)
            turn = r.choice([None, i, i, i, i + 3, -i])
            out.append((conv if conv else None, turn, role, r.choice(texts) if r.random() < 0.6 else f"text {i}."))
            if r.random() < 0.1:
                out.append(out[-1])
    return out


@pytest.mark.parametrize("chunk,longest,damage", [(256, 20, True), (3, 40, True), (1, 12, False), (2, 30, False)])
def test_repair_equals_brute_force(spark, chunk, longest, damage):
    rows = conversations(chunk * 100 + longest, 60, longest)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as start", "'x' as codes", "2 as entry").repartition(6)
    got = result(T.damaged_and_repaired(df, chunk) if damage else T.structure_repair(df, chunk))
    assert got == brute(rows, damage)


def test_whole_table(spark):
    df = spark.read.parquet(f"{D}/conversations.parquet")
    assert result(T.damaged_and_repaired(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_sql_agrees_on_odd_rows():
    rows = conversations(8, 80, 15)
    conversations_table = pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))})
    db = duckdb.connect()
    db.register("conversations", conversations_table)
    assert {r[0]: r[1:] for r in db.sql(T.ORACLE).fetchall()} == brute(rows)


def test_one_long_conversation_converges(spark):
    """Chunks of one conversation, from speculative vectors; no pass goes as far as there are chunks."""
    r = random.Random(4)
    rows = [(5, i, r.choice(["user", "assistant", "system"]), f"row {i}" + r.choice([".", ""])) for i in range(6000)]
    assert result(T.structure_repair(spark.createDataFrame(rows, ROWS).repartition(5), 100)) == brute(rows, False)
    codes = "".join("suax"[r.randrange(4)] + "fftd"[r.randrange(4)] for _ in range(100))
    assert T.vectors(codes, T.SPECULATIVE)[-1] == T.vectors(codes, T.parallel(T.END))[-1]


def test_odd_tables(spark):
    assert T.damaged_and_repaired(spark.createDataFrame([], ROWS)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert result(T.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS))) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    long = "word " * 400_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, None, None, None), (2, None, None, None)]
    assert result(T.structure_repair(spark.createDataFrame(rows, ROWS))) == brute(rows, False)
