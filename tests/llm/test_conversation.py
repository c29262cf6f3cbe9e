"""Conversation repair against a plain recursion over all edits and faults counted row by row."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from meshwright.llm import conversation

SPACE = " \t\n\x0b\f\r"


def brute(rows):
    """Least (cost, edits, repaired messages) of rows (role, text, must be deleted, truncated)."""

    @functools.lru_cache(None)
    def best(i, last, inserts):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        want = {"": "u", "s": "u", "a": "u", "u": "a"}[last]
        named = {"u": "user", "a": "assistant"}[want]

        def step(cost, edit, message, rest):
            if rest:
                ways.append((cost + rest[0], edit + rest[1], message + rest[2]))

        if i < len(rows):
            role, text, must, late = rows[i]
            step(3, "D", (), best(i + 1, last, 0))
            if not must:
                if role[:1] == want or role[:1] == "s" and not last:
                    step(late, "K", ((role, text),), best(i + 1, role[:1], 0))
                step(2 + late, "R", ((named, text),), best(i + 1, want, 0))
        if inserts < 3:
            step(2, "I", ((named, ""),), best(i, want, inserts + 1))
        return min(ways) if ways else None

    return best(0, "", 0)


def expected(rows):
    """The contract's columns of one conversation; rows (turn, role, text) in order."""
    seen, faults, flagged = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        flagged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, messages = brute(tuple(flagged))
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())


def damage(rows):
    """Conversations (id to rows in order) after the damage."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own.extend([] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(v, key=key) for c, v in out.items()}


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = ["Yes.", "No!", "cut off", "", " \t ", "é?", "end. \n", "..", None, " ", "Why? ", "a.\nb"]
    out = []
    for conv in [*range(150), None]:
        for turn in range(r.choice([1, 2, 3, 5, 9])):
            out.append((conv, r.choice([turn, turn, turn, turn + 3, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), r.choice(texts)))
    r.shuffle(out)
    return [*out, *out[:25]]


def test_repair(spark, rows):
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, cost int, _gone string")
    got = result(conversation.repair(conversation.damaged(df.repartition(3))))
    assert got == {c: expected(v) for c, v in damage(rows).items()}


def test_dropped_rows_leave_a_conversation(spark):
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert result(conversation.repair(conversation.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversation.repair(conversation.damaged(df.limit(0))).collect() == []


def test_search_agrees_with_recursion():
    r = random.Random(1)
    for _ in range(1500):
        rows = tuple((r.choice(["s", "u", "a", "u", "a", " ", "", "t"]), str(i), r.random() < 0.2, r.random() < 0.3) for i in range(r.choice([0, 1, 2, 3, 6, 12])))
        assert conversation.cheapest([(role, must, late) for role, _, must, late in rows]) == brute(rows)[:2]


def test_long_conversations_by_blocks(monkeypatch):
    r = random.Random(5)
    for block, n in [(3, 40), (5, 61), (64, 300)]:
        monkeypatch.setattr(conversation, "BLOCK_ROWS", block)
        for _ in range(40 if n < 100 else 3):
            rows = [(r.choice(["system", "user", "assistant", "user", "assistant", "tool"]), str(i), r.choice([None, None, "blank", "duplicate", "truncated"])) for i in range(n)]
            own, messages = conversation.Repair(), []
            for x in rows:
                messages += own.feed(*x)
            messages += own.finish()
            cost, audit, want = brute(tuple((role, text, f in ("blank", "duplicate"), f == "truncated") for role, text, f in rows))
            assert (own.cost, "".join(own.audit)) == (cost, audit) and tuple(m[1:] for m in messages) == want
            assert len(own.pending) == 0


def test_a_long_alternating_conversation_is_not_held():
    own = conversation.Repair()
    most = 0
    for i in range(5000):
        own.feed("assistant" if i % 2 else "user", f"Text {i}.", "truncated" if i % 7 == 0 else "")
        most = max(most, len(own.pending))
    own.finish()
    assert most <= conversation.BLOCK_ROWS + 8 and set("".join(own.audit)) == {"K"}


def test_messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    digests = result(conversation.repair(conversation.damaged(df)))
    told = {c: [] for c in digests}
    for r in conversation.repair(conversation.damaged(df), messages=True).orderBy("conv_id", "place").collect():
        told[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(m).encode()).hexdigest() for c, m in told.items()} == {c: d[-1] for c, d in digests.items()}


def test_query(spark):
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet").astype(object)
    rows = list(table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert result(conversation.op13_conversation_repair(spark, "/root/testdata/sf0.001")) == {c: expected(v) for c, v in damage(rows).items()}
