"""Operator 11: the cheapest repair of a conversation's structure, by Dijkstra on an implicit edit lattice.

A node of the lattice is (how many rows are used up, state of the grammar); the
roles' initials of a repaired conversation match ``(s?(ua)+)?``. A row is kept,
given the other role, or deleted, and a turn without text can be inserted
anywhere. The priority is (cost, audit), the audit being the edits' initials, so
the first accepting node at the end that leaves the queue is the cheapest repair
and among equally cheap ones the least audit.

Rows are sorted by range over all tasks, so a conversation that holds a third of
all rows lies in many of them. One that lies whole in a task and is short is
repaired there and then. Of any other (the first and last of a task, and long
ones) each stretch of at most ``SEGMENT`` rows is searched from every state to
every state, and these crossings are joined from left to right. Its rows then
pass once through the task that writes it, a batch at a time.

Defined results: null text or role is one space; rows come by turn, a null turn
first, ties by a hash of role and text; a null conversation id is a conversation
of its own; rows that ``present`` excludes only make their conversation known,
and one without rows is repaired to nothing. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinfold.llm._shared import in_parts, partitions, written

SEGMENT = 512
#: A conversation with more characters than this is not held in a task.
LONGEST = 1 << 22

START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NEXT = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Which of user and assistant may follow a state, and the name of its role.
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Codes of rows: the role's initial (x for any other), in capitals if truncated; blank and duplicate rows must go.
BLANK, DUPLICATE = "_", "="
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "position long, edit string, role string, text string"


def _edits(code: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, state after it) of the edits that use up a row."""
    out = [(DELETE, "D", state)]
    if code not in (BLANK, DUPLICATE):
        more = TRUNCATED if code.isupper() else 0
        if code.lower() in _NEXT[state]:
            out.append((more, "K", _AFTER[code.lower()]))
        out.append((REROLE + more, "R", _TURN[state]))
    return out


_EDITS = {(code, state): _edits(code, state) for code in "suaxSUAX_=" for state in _NEXT}


def settled(codes: str, entry: int = START) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state) of the nodes behind the last row, as they leave the queue."""
    queue, done = [(0, "", 0, entry)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(codes):
            yield cost, audit, state
        else:
            for more, edit, after in _EDITS[codes[i], state]:
                if (i + 1, after) not in done:
                    heapq.heappush(queue, (cost + more, audit + edit, i + 1, after))
        if (i, _TURN[state]) not in done:
            heapq.heappush(queue, (cost + INSERT, audit + "I", i, _TURN[state]))


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair: the first accepting end."""
    return next((cost, audit) for cost, audit, state in settled(codes) if state in _ENDS)


def crossings(codes: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a stretch of rows, for all pairs of states that it can join."""
    return [(entry, state, cost, audit) for entry in _NEXT for cost, audit, state in settled(codes, entry)]


def joined(front: dict[int, tuple[int, str]], across: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, str]]:
    """The cheapest ways to each state behind one more stretch."""
    out: dict[int, tuple[int, str]] = {}
    for entry, state, cost, audit in across:
        if entry in front:
            way = (front[entry][0] + cost, front[entry][1] + audit)
            out[state] = min(out.get(state, way), way)
    return out


def coded(role: str, text: str, seen: bool) -> str:
    """The code of a row; its first fault counts."""
    ends = text.rstrip(_SPACE)
    if not ends:
        return BLANK
    if seen:
        return DUPLICATE
    code = role[:1] if role[:1] in _AFTER else "x"
    return code if ends[-1] in ".!?" else code.upper()


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class Walk:
    """A conversation read row by row beside its audit: counts, and the rows of the repair."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.count = dict.fromkeys((BLANK, DUPLICATE, "t", "illegal"), 0)
        self.before = self.first = self.last = None
        self.cost = self.turns = self.position = 0
        self.sha = hashlib.sha256()

    def _put(self, edit: str, role: str, text: str, after: int) -> tuple:
        self.sha.update(f"{chr(10) if self.position else ''}{role}:{text}".encode())
        self.state, self.position = after, self.position + 1
        return (self.position - 1, edit, role, text)

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.cost = self.at + 1, self.cost + INSERT
            yield self._put("I", _ROLE[_TURN[self.state]], "", _TURN[self.state])

    def row(self, turn: int | None, role: str, text: str, code: str) -> Iterator[tuple]:
        """What the repair holds up to and with this row."""
        fault = "t" if code.isupper() else code
        if fault in self.count:
            self.count[fault] += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.count["illegal"] += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED if fault == "t" else 0
        if edit == "K":
            yield self._put("K", role, text, _AFTER[role[0]])
        else:
            self.cost += REROLE
            yield self._put("R", _ROLE[_TURN[self.state]], text, _TURN[self.state])

    def report(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, self.count[BLANK], self.count[DUPLICATE], self.count["t"], self.count["illegal"], self.cost, self.audit, self.sha.hexdigest())


class Writer:
    """Finished conversations as Arrow batches: reports, or the rows of their repairs."""

    def __init__(self, digests_only: bool, schema: pa.Schema):
        self.digests_only, self.schema = digests_only, schema
        self.rows: list[dict] = []
        self.size = 0

    def add(self, values: tuple) -> None:
        self.rows.append(dict(zip(self.schema.names, values, strict=True)))
        self.size += 100 + sum(len(v) for v in values if isinstance(v, str | bytes))

    def some(self, conv, made: Iterator[tuple]) -> None:
        """What a walk holds so far; all of it passes the hash, the rows are kept only where asked for."""
        for r in made:
            if not self.digests_only:
                self.add((conv, *r))

    def end(self, conv, walk: Walk) -> None:
        self.some(conv, walk.inserted())
        if self.digests_only:
            self.add((conv, *walk.report()))

    def full(self, least: int = 1 << 22) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.size = [], 0


def _arrow(kind: T.StructType) -> pa.Schema:
    return to_arrow_schema(kind)


def _kind(conv: T.DataType, columns: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T._parse_datatype_string(columns).fields])


_OPEN = "part int, at long, turn long, role string, text string, present boolean, code string, digest binary"


def _first_pass(conv_kind: T.DataType, digests_only: bool, segment: int):
    """Sorted rows to finished conversations (``done``), or to the rows of those that are long or may go on in another task (``open``)."""
    out = T.StructType([T.StructField("done", _kind(conv_kind, REPORT if digests_only else REPAIRED)), T.StructField("open", _kind(conv_kind, _OPEN))])
    done_schema, open_schema = _arrow(out["done"].dataType), _arrow(out["open"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done, left = Writer(digests_only, done_schema), Writer(False, open_schema)
        held: list[tuple] = []
        seen: set[bytes] = set()
        conv, opened, begun, size, at = None, True, False, 0, 0

        def release() -> None:
            nonlocal held, at
            for turn, role, text, present, code, digest in held:
                left.add((conv, part, at, turn, role, text, present, code, digest))
                at += 1
            held = []

        def finish() -> None:
            nonlocal held
            rows = [r for r in held if r[3]]
            walk = Walk(cheapest("".join(r[4] for r in rows))[1])
            for turn, role, text, _, code, _ in rows:
                done.some(conv, walk.row(turn, role, text, code))
            done.end(conv, walk)
            held = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            for w, other, first in ((done, open_schema, True), (left, done_schema, False)):
                for b in w.full(least):
                    own, none = b.to_struct_array(), pa.nulls(b.num_rows, pa.struct(list(other)))
                    yield pa.RecordBatch.from_arrays([own, none] if first else [none, own], names=["done", "open"])

        for batch in in_parts(batches, 3):
            for c, turn, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv or not begun:
                    if begun:
                        release() if opened else finish()
                    conv, opened, begun, size = c, not begun, True, 0  # the first may have begun in another task
                    seen.clear()
                for k in range(max(1, copies)):
                    digest = _digest(role, text)
                    code = coded(role, text, digest in seen)
                    held.append((turn, role, text, copies > 0, code, digest))
                    if copies:
                        seen.add(digest)
                    size += len(text)
                    opened = opened or len(held) > segment or size > LONGEST
                if opened:
                    release()
            yield from flush(1 << 22)
        release()  # the last may go on in another task
        yield from flush(0)

    return run, out


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of stretches to their crossings."""
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            found = [dict(zip(("entry", "exit", "cost", "audit"), c, strict=True)) for c in crossings(row.column(3)[0].as_py())]
            yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([found], kind)], names=["conv", "part", "seg", "ways"])


def _join_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Crossings of a conversation's stretches, in order, to its audit."""
    conv, front = None, None

    def best() -> pa.RecordBatch:
        audit = min(front[s] for s in _ENDS if s in front)[1]
        return pa.RecordBatch.from_arrays([conv, pa.array([audit], pa.string())], names=["conv", "audit"])

    for batch in batches:
        for k in range(batch.num_rows):
            own = batch.column(0).slice(k, 1)
            if front is None or own.to_pylist() != conv.to_pylist():
                if front is not None:
                    yield best()
                conv, front = own, {START: (0, "")}
            front = joined(front, [(w["entry"], w["exit"], w["cost"], w["audit"]) for w in batch.column(3)[k].as_py()])
    if front is not None:
        yield best()


def _last_pass(conv_kind: T.DataType, digests_only: bool):
    """Rows of a conversation behind its audit, in order, to what the operator returns."""
    out = _kind(conv_kind, REPORT if digests_only else REPAIRED)
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, walk, conv = Writer(digests_only, schema), None, None
        for batch in in_parts(batches, 4):
            for c, audit, turn, role, text, present, code in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if audit is not None:
                    if walk:
                        writer.end(conv, walk)
                    conv, walk = c, Walk(audit)
                elif present:
                    writer.some(conv, walk.row(turn, role, text, code))
                yield from writer.full()
        if walk:
            writer.end(conv, walk)
        yield from writer.full(0)

    return run, out


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, digests_only: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Repaired conversations: (conversation, position, edit, role, text) of every row that the repair holds, or with ``digests_only`` a report of each conversation.

    ``copies_col`` says how often a row stands there, 0 for a row that only makes its conversation known.
    """
    spark, kind = df.sparkSession, df.schema[conv_col].dataType
    many = partitions(spark)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col(copies_col).cast("int") if copies_col else F.lit(1)
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), copies.alias("copies")).withColumn("tie", F.xxhash64("role", "text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "tie"]
    first, out = _first_pass(kind, digests_only, segment)
    ranged = rows.repartitionByRange(many, *order).sortWithinPartitions(*order, "role", "text").drop("tie")
    found = written(ranged.mapInArrow(first, out), "repairs")
    done = found.where("done IS NOT NULL").select("done.*")

    left = found.where("open IS NOT NULL").select("open.*")
    asks = F.col("present") & ~F.col("code").isin(BLANK, DUPLICATE)
    # what a task has seen itself is marked already, so a text asks once a task at most
    earlier = F.row_number().over(Window.partitionBy("conv", "digest").orderBy("part", "at"))
    new = left.where(asks).withColumn("code", F.when(earlier > 1, DUPLICATE).otherwise(F.col("code")))
    rest = written(new.unionByName(left.where(~asks)).drop("digest").withColumn("seg", F.floor(F.col("at") / segment)), "open")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    stretches = rest.where("present").groupBy("conv", "part", "seg").agg(line.alias("codes"))
    alone = rest.where("NOT present").select("conv", "part", "seg", F.lit("").alias("codes")).distinct()  # so that every conversation has one
    name = kind.simpleString()
    ways = stretches.unionByName(alone).mapInArrow(_ways, f"conv {name}, part int, seg long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>")
    audits = ways.repartition(many, "conv").sortWithinPartitions("conv", "part", "seg").mapInArrow(_join_ways, f"conv {name}, audit string")
    last, out = _last_pass(kind, digests_only)
    heads = audits.select("conv", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("at"), "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("present"), F.lit("").alias("code"))
    both = heads.unionByName(rest.drop("seg").withColumn("audit", F.lit(None).cast("string")))
    walked = both.repartition(many, "conv").sortWithinPartitions("conv", "part", "at").select("conv", "audit", "turn", "role", "text", "present", "code").mapInArrow(last, out)
    return done.unionByName(walked).withColumnRenamed("conv", conv_col)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations damaged by a hash of (conv_id, turn), with ``copies``: 0 for a row that is dropped, 2 for one that is repeated."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return df.select("conv_id", "turn", F.when(k == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))
