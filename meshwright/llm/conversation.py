"""Repair of conversations: the cheapest edits after which their roles read ``(s?(ua)+)?``.

Every row of a conversation, in the order of its turns, is kept, given another role, or deleted; messages without text may
be put in anywhere. These edits are the edges of a lattice of (rows read, role written last). Bidirectional Dijkstra finds
the cheapest way through it: a forward and a reverse heap meet, go on until no other crossing can cost as little, and of
all crossings of that cost the one whose edits, put together, are least in ASCII order is taken.

Faults are found by expressions and a window over equal messages. Then a shuffle brings a conversation's rows together in
order, and a task reads them as a stream: of a long conversation it holds a block of rows, the cheapest ways from each
state to each through the block, and the stretch on which the ways that may still win differ. The hash of a repaired
conversation is one chain over its texts, so one task reads one conversation, but never holds it.

Order is by turn (nulls first), then role and text. Null role and text are one space, null ids and turns are one space
where they are hashed; rows of a null id are one conversation. A role's initial is its first character; an empty role
has none and can't be kept. Repeated rows are duplicates but for the first. An empty table gives no rows; other columns
are left aside.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrowtext import release, small_batches

#: States: nothing written, system, user or assistant written last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that follows each by a message of the user or the assistant.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: By initial: states that a kept row may follow, and the state it leads to.
KEEPS = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
BEFORE = {USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ENDS = (EMPTY, ASSISTANT)
#: Costs of edits; a truncated row that isn't deleted adds one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAULTS = ("", "blank", "duplicate", "truncated")
#: A block of a long conversation ends after so many rows or characters.
BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 22

#: (initial, whether it must be deleted, whether it's truncated)
Row = tuple[str, bool, bool]


def _out(rows: list[Row], i: int, s: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits that leave (i, s): the node they lead to, their cost and initial."""
    if i < len(rows):
        initial, must, late = rows[i]
        yield i + 1, s, DELETE, "D"
        if not must:
            after, to = KEEPS.get(initial, ((), 0))
            if s in after:
                yield i + 1, to, TRUNCATED * late, "K"
            yield i + 1, NEXT[s], REROLE + TRUNCATED * late, "R"
    yield i, NEXT[s], INSERT, "I"


def _in(rows: list[Row], i: int, s: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits that lead to (i, s), as in ``_out``."""
    before = BEFORE.get(s, ())
    if i:
        initial, must, late = rows[i - 1]
        yield i - 1, s, DELETE, "D"
        if not must:
            after, to = KEEPS.get(initial, ((), -1))
            if to == s:
                yield from ((i - 1, p, TRUNCATED * late, "K") for p in after)
            yield from ((i - 1, p, REROLE + TRUNCATED * late, "R") for p in before)
    yield from ((i, p, INSERT, "I") for p in before)


def cheapest(rows: list[Row], start: int = EMPTY, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits that lead from a state before ``rows`` to one of ``ends`` behind them.

    Heaps go by (cost, rows passed), so what costs nothing is followed in order, and a node's least initials are known when it is
    taken from its heap. Every cheapest way has an edge from a node taken forward to one taken in reverse once the heaps' least
    costs exceed the best way's together.
    """
    n, best = len(rows), float("inf")
    to: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    back: dict[tuple[int, int], tuple[int, str]] = {(n, e): (0, "") for e in ends}
    ahead, behind = [(0, 0, start)], [(0, -n, e) for e in ends]
    heapq.heapify(behind)
    reached, met = set(), set()
    while ahead or behind:
        a, b = ahead[0][0] if ahead else float("inf"), behind[0][0] if behind else float("inf")
        if a + b > best:
            break
        if a <= b:
            cost, i, s = heapq.heappop(ahead)
            own, others, labels, other, edges, sign = reached, met, to, back, _out, 1
        else:
            cost, i, s = heapq.heappop(behind)
            i = -i
            own, others, labels, other, edges, sign = met, reached, back, to, _in, -1
        node = (i, s)
        if node in own:
            continue
        own.add(node)
        if node in others:
            best = min(best, cost + other[node][0])
        told = labels[node][1]
        for j, t, price, edit in edges(rows, i, s):
            far = (j, t)
            if far in others:
                best = min(best, cost + price + other[far][0])
            if far in own:
                continue
            new = (cost + price, told + edit if sign > 0 else edit + told)
            had = labels.get(far)
            if had is None or new < had:
                labels[far] = new
                if had is None or new[0] < had[0]:
                    heapq.heappush(ahead if sign > 0 else behind, (new[0], sign * j, t))
    if best == float("inf"):
        return None
    audits = [to[x][1] + back[x][1] for x in reached & met if to[x][0] + back[x][0] == best]
    for x in reached:
        cost, told = to[x]
        audits += [told + edit + back[j, t][1] for j, t, price, edit in _out(rows, *x) if (j, t) in met and cost + price + back[j, t][0] == best]
    return int(best), min(audits)


class Repair:
    """One conversation, fed row by row; ``messages`` are handed over as soon as their edits are settled."""

    def __init__(self):
        self.ways: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
        self.block: list[Row] = []
        self.chars = 0
        self.pending: deque[tuple[str, str]] = deque()
        self.written = EMPTY
        self.audit: list[str] = []
        self.cost = 0

    def feed(self, role: str, text: str, fault: str) -> list[tuple[str, str, str]]:
        self.block.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.pending.append((role, text))
        self.chars += len(text)
        return self._advance(range(4)) if len(self.block) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS else []

    def finish(self) -> list[tuple[str, str, str]]:
        return self._advance(ENDS, True)

    def _advance(self, ends, last: bool = False) -> list[tuple[str, str, str]]:
        ways: dict[int, tuple[int, str]] = {}
        for start, (cost, told) in self.ways.items():
            for goal in [tuple(ends)] if last else [(e,) for e in ends]:
                found = cheapest(self.block, start, goal)
                if found:
                    new, at = (cost + found[0], told + found[1]), goal[0]
                    ways[at] = min(ways.get(at, new), new)
        self.block, self.chars = [], 0
        if not last:
            # what another state reaches for less, even with the edits that make up for what it can't do, never wins
            price = {s: w[0] for s, w in ways.items()}
            for s, by in ((EMPTY, {USER: INSERT + DELETE, ASSISTANT: DELETE}), (SYSTEM, {USER: INSERT, ASSISTANT: 0})):
                if s in ways and any(o in price and price[s] > price[o] + more for o, more in by.items()):
                    del ways[s]
        settled = os.path.commonprefix([told for _, told in ways.values()])
        self.ways = {s: (cost, told[len(settled) :]) for s, (cost, told) in ways.items()}
        self.audit.append(settled)
        self.cost = min(cost for cost, _ in self.ways.values())
        return list(self._messages(settled))

    def _messages(self, edits: str) -> Iterator[tuple[str, str, str]]:
        for edit in edits:
            role, text = self.pending.popleft() if edit != "I" else ("", "")
            if edit == "D":
                continue
            if edit == "K":
                self.written = KEEPS[role[:1]][1]
                yield edit, role, text
            else:
                self.written = NEXT[self.written]
                yield edit, NAMES[self.written], text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that the crc32 of ``conv_id:turn`` deals them; ``_gone``: dropped."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("_gone"), F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_times"),
    )
    return rows.select("conv_id", "turn", "role", "text", "_gone", F.explode("_times").alias("_time")).drop("_time")


def with_faults(rows: DataFrame) -> DataFrame:
    """``_fault``: each row's first fault, null where it has none."""
    shown: Column = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended: Column = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256), "_gone").orderBy("turn")
    place = F.row_number().over(same)
    return rows.withColumn("_fault", F.when(~shown, "blank").when(place > 1, "duplicate").when(~ended, "truncated"))


DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
MESSAGES = "place bigint, edit string, role string, text string"


def _read(batches, kind: pa.DataType, messages: bool):
    """Digests or messages of conversations whose rows stand together in order."""
    names = ["conv_id", *([x.split()[0] for x in (MESSAGES if messages else DIGEST).split(", ")])]
    kinds = [kind, *((pa.string() if x.split()[1] == "string" else pa.int64()) for x in (MESSAGES if messages else DIGEST).split(", "))]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    out: list[tuple] = []

    def flush():
        nonlocal out
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)
        out = []
        return batch

    class Digest:
        def __init__(self, conv):
            self.conv, self.repair, self.hash, self.place = conv, Repair(), hashlib.sha256(), 0
            self.found = dict.fromkeys(FAULTS[1:], 0)
            self.least = self.most = self.before = None
            self.turns = self.illegal = 0

        def row(self, turn, role, text, fault):
            if fault:
                self.found[fault] += 1
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns += turn != self.most
                self.most = turn
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            self.told(self.repair.feed(role, text, fault))

        def told(self, settled):
            for edit, role, text in settled:
                if messages:
                    out.append((self.conv, self.place, edit, role, text))
                else:
                    self.hash.update((b"\n" if self.place else b"") + role.encode() + b":" + text.encode())
                self.place += 1

        def end(self):
            self.told(self.repair.finish())
            if not messages:
                gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
                out.append((self.conv, gaps, *(self.found[f] for f in FAULTS[1:]), self.illegal, self.repair.cost, "".join(self.repair.audit), self.hash.hexdigest()))

    now = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "_gone", "_fault")]
        for conv, turn, role, text, gone, fault in zip(*columns, strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    now.end()
                now = Digest(conv)
            if not gone:
                now.row(turn, role, text, fault)
            if len(out) >= 1000:
                yield flush()
        columns = None
    if now is not None:
        now.end()
    if out:
        yield flush()
    release()


def repair(rows: DataFrame, messages: bool = False) -> DataFrame:
    """What a conversation lacks and the edits that repair it, or, with ``messages``, its repaired messages in order.

    ``rows``: conv_id, turn, role, text, and optionally ``_gone`` (such rows only say that there is a conversation).
    """
    gone = F.col("_gone") if "_gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    plain = with_faults(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text, gone.alias("_gone")))
    kind = plain.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    fields = StructType([StructField("conv_id", kind)])
    for part in (MESSAGES if messages else DIGEST).split(", "):
        fields = fields.add(part.split()[0], StringType() if part.endswith("string") else LongType())
    small_batches(plain)
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _read(batches, arrow, messages), fields)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
