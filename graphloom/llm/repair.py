"""Repair of conversations' structure: the cheapest edits that make their roles an optional system turn, then pairs of user and assistant.

Rows are dealt by conversation and sorted by turn, twice, and streamed through Python, where the state of a dynamic program goes on
from Arrow batch to Arrow batch; no conversation is ever held as a whole.

- Backwards, over narrow rows (no texts): for each of the four states that a sequence of roles can be in, the least cost of what
  follows. Each row leaves two bits a state, which edit to make there, and these backpointers are spilled in chunks, as rows of
  a table in the shared folder.
- Forwards, over the texts, each chunk sorted right before the first of its rows: the edits are followed, least letter first
  where costs tie, and the digest of the repaired conversation runs along.

Edits: keep (0), rerole to user or assistant (2), delete (3; blank and duplicate rows must go), insert an empty turn of user or
assistant (2); a truncated row that stays adds 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters that are no text: space and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
#: Rows whose backpointers make a chunk.
CHUNK = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user's, after an assistant's. From each, one role can be inserted.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {("s", START): SYSTEM} | {("u", q): USER for q in (START, SYSTEM, ASSISTANT)} | {("a", USER): ASSISTANT}
#: Costs once all rows are read: two turns are lacking after a system turn, one after a user's.
AT_END = (0, 2 * INSERT, INSERT, 0)
LETTERS = DELETES, INSERTS, KEEPS, REROLES = b"DIKR"
LAWFUL = {"su", "ua", "au"}
OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
BACK = "conv_id bigint, turn bigint, role string, mark binary, last bigint, edits binary, faults binary, cost bigint"
#: Bytes of backpointers that a batch holds, about.
SPILL = 1 << 20


def edits_before(fault: str, initial: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """One step back: the costs of the four states before a row, and the edits to make there, two bits a state.

    ``after`` has the costs after the row. An insert leads to another state before the same row.
    """
    stays = 1 if fault == "t" else 0
    options = []
    for q in range(4):
        here = [DELETE + after[q], None, None, None]
        if fault not in "bd":
            if (q2 := NEXT.get((initial, q))) is not None:
                here[2] = stays * TRUNCATED + after[q2]
            here[3] = REROLE + stays * TRUNCATED + after[FOLLOWS[q]]
        options.append(here)
    least = [min(c for c in here if c is not None) for here in options]
    user = min(least[USER], INSERT + least[ASSISTANT])
    assistant = min(least[ASSISTANT], INSERT + least[USER])
    costs, packed = [], 0
    for q in range(4):
        insert = INSERT + (assistant if q == USER else user)
        best = min(least[q], insert)
        options[q][1] = insert
        packed |= next(k for k in range(4) if options[q][k] == best) << 2 * q
        costs.append(best)
    return tuple(costs), packed


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows conv_id, turn, role, mark, fault and initial, each conversation's last first; chunks of backpointers."""
    known: dict[tuple, tuple] = {}
    out, held = [], 0
    here, costs, edits, faults, first, n = None, AT_END, bytearray(), bytearray(), None, 0

    def chunk() -> tuple:
        # In the order of rows, with the row before which it sorts
        return (here, *first, n, bytes(reversed(edits)), bytes(reversed(faults)), costs[START])

    for b in batches:
        for conv, turn, role, mark, fault, initial in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if n and (conv != here or len(edits) == CHUNK):
                out.append(chunk())
                held += 2 * len(edits) + 64
                edits, faults = bytearray(), bytearray()
                if held > SPILL:
                    yield _batch(out, BACK)
                    out, held = [], 0
            if conv != here or not n:
                here, costs, n = conv, AT_END, 0
            base = costs[START]
            key = (fault, initial, *(c - base for c in costs))  # states differ by little in cost, so there are few keys
            if (found := known.get(key)) is None:
                found = known[key] = edits_before(fault, initial, key[2:])
            costs = tuple(c + base for c in found[0])
            edits.append(found[1])
            faults.append(ord(fault))
            first, n = (turn, role, mark), n + 1
    if n:
        out.append(chunk())
        yield _batch(out, BACK)


class _Repaired:
    """What is known of a conversation as its chunks and rows go by."""

    def __init__(self, conv: int | None):
        self.conv, self.digest, self.audit, self.state = conv, hashlib.sha256(), bytearray(), START
        self.chunks: list[tuple[int, bytes, bytes]] = []
        self.n = self.total = self.illegal = self.distinct = self.cost = self.lines = 0
        self.faults = dict.fromkeys(b"bdt", 0)
        self.before = self.least = self.most = None

    def chunk(self, last: int, edits: bytes, faults: bytes, cost: int) -> None:
        if not self.total:  # the first chunk ends with the conversation's first row, going backwards
            self.total, self.cost = last, cost
        self.chunks.append((self.total - last, edits, faults))

    def line(self, role: str, text: str) -> None:
        self.digest.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode("utf-8", "replace"))
        self.lines += 1

    def insert(self) -> None:
        self.state = FOLLOWS[self.state]
        self.audit += b"I"
        self.line(ROLES[self.state], "")

    def row(self, turn: int | None, role: str, initial: str, text: str) -> None:
        if turn is not None and turn != self.most:
            self.distinct += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        if self.before is not None and self.before + initial not in LAWFUL:
            self.illegal += 1
        self.before = initial
        while self.n >= self.chunks[0][0] + len(self.chunks[0][1]):
            self.chunks.pop(0)
        start, edits, faults = self.chunks[0]
        packed, fault = edits[self.n - start], faults[self.n - start]
        self.n += 1
        if fault in self.faults:
            self.faults[fault] += 1
        while (edit := LETTERS[packed >> 2 * self.state & 3]) == INSERTS:
            self.insert()
        self.audit.append(edit)
        if edit != DELETES:
            self.state = NEXT[initial, self.state] if edit == KEEPS else FOLLOWS[self.state]
            self.line(role if edit == KEEPS else ROLES[self.state], text)

    def end(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By conversation and turn, chunks before rows: conv_id, turn, role, initial, text, last, edits, faults, cost.

    A row has its text, a chunk its edits; a row that isn't there has neither.
    """
    now, out = None, []
    for b in batches:
        for at in range(0, len(b), 256):
            for conv, turn, role, initial, text, last, edits, faults, cost in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.end())
                    now = _Repaired(conv)
                    if len(out) >= 1000:
                        yield _batch(out, OUT)
                        out = []
                if edits is not None:
                    now.chunk(last, edits, faults, cost)
                elif text is not None:
                    now.row(turn, role, initial, text)
    if now:
        yield _batch([*out, now.end()], OUT)


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``present`` (on the columns given) tells which rows there are; a conversation that has none is reported as empty.

    Defined results: rows go by turn, nulls first, then role, then the text's MD5; a null role or text is one space, so it is
    illegal or blank; a row's first fault of blank, duplicate (role and text as in an earlier row) and truncated counts; gaps are
    missing turn numbers between the least and the greatest; audit has the letters of the cheapest edits (Keep, Rerole, Delete,
    Insert) in order, of those the least by ASCII; repeated rows are duplicates; a null conv_id is a conversation; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    ends = F.right(seen, F.lit(1)).isin(".", "!", "?")
    rows = rows.withColumns({"mark": F.unhex(F.md5(F.col("text").cast("binary"))), "shape": F.when(F.length(seen) == 0, "b").when(ends, "n").otherwise("t")})
    # Narrow rows: the first of a conversation's equal ones is no duplicate
    alike = Window.partitionBy("conv_id", "role", "mark").orderBy(F.col("turn").asc_nulls_first())
    narrow = rows.where("present").select("conv_id", "turn", "role", "mark", "shape").repartition("conv_id")
    fault = F.when(F.col("shape") == "b", "b").when(F.col("k") > 1, "d").otherwise(F.col("shape"))
    first = F.substring("role", 1, 1)
    narrow = narrow.withColumns({"k": F.row_number().over(alike), "initial": F.when(first.isin("s", "u", "a"), first).otherwise("")})
    last_first = narrow.sortWithinPartitions(F.desc("conv_id"), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("mark"), F.desc("k"))
    spilled = stored(last_first.select("conv_id", "turn", "role", "mark", fault.alias("fault"), "initial").mapInArrow(_backwards, BACK))
    lines = rows.select("conv_id", "turn", "role", "mark", F.when(first.isin("s", "u", "a"), first).otherwise("").alias("initial"), F.when(F.col("present"), F.col("text")).alias("text"))
    both = lines.unionByName(spilled, allowMissingColumns=True).repartition("conv_id")
    in_order = both.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "mark", F.col("edits").isNull(), F.desc("last"))
    return in_order.select("conv_id", "turn", "role", "initial", "text", "last", "edits", "faults", "cost").mapInArrow(_forwards, OUT)
