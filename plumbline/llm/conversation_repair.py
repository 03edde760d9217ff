"""Conversation structure repair: the cheapest edits that make a conversation well formed, by iterative-deepening A*.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Edits, in the order of the turns: Keep a row (0), Rerole it
to user or assistant (1), Delete it (2), Insert an empty user or assistant row (5). The first fault of a row counts: *blank* (no
character but ASCII white space), *duplicate* (role and text stood earlier), *truncated* (its last such character is none of ``.!?``). Blank and duplicate
rows must be deleted; a truncated row that stays adds 5. Of the cheapest edits those whose initials read least in ASCII are taken.

Method. ``search`` walks depth first, trying D, I, K, R in this order, and gives up a branch as soon as its cost plus a lower bound of
the rest exceeds the cost bound. The lower bound is the exact cost of a relaxed problem in which a conversation may end anywhere; it is
made by one sweep from the last row. What failed is remembered per (row, state) with the budget it failed with, so no state is
tried again with the same or less. The bound grows by one until a path is accepted; the first one is the answer. The gap between
bound and answer is 10 at most, so time grows in proportion to the rows.

Scale. Only hashes and flags of the texts are moved to find duplicates: equal rows of a turn are folded to one with a count, the first
turn of each (role, text) is a least value added up in tasks and joined back. A conversation's rows then pass one task in turn order as
a stream of a few bytes a row; the search holds one byte code and a few small numbers a row and no texts. Texts pass a second stream together with the
edits, row by row. A conversation is never held as a group; its rows meet in one task because an edit depends on those before it.

Defined results: null role or text is one space; roles go by their first character, so a role without one can only be reroled or
deleted; rows without a turn come first; rows of equal turn are ordered by role, then by a hash of the text; rows without a conversation id are
one conversation; a conversation without rows has no row here; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import shared, slices, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Codes of rows: class of the initial (system, user, assistant, other), plus 4 if truncated, or FORCED.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FORCED = 8
#: States: nothing yet, after the system row, after a user, after an assistant. The role that must come next, and the state after it.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_AFTER = (_USER, _USER, _ASSISTANT, _USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}

PLAN = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, role string, text string, edit string"
_WHITE = r"[\x20\x09-\x0D]"


def lower_bounds(codes: Sequence[int]) -> tuple[list[int], ...]:
    """For every row and state the least cost of all rows from it on, if a conversation may end after any row."""
    n = len(codes)
    start, user, assistant = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # by what must come next; start: system may too
    for i in range(n - 1, -1, -1):
        code = codes[i]
        s, u, a = start[i + 1] + DELETE, user[i + 1] + DELETE, assistant[i + 1] + DELETE
        if code < FORCED:
            role, stay = code & 3, TRUNCATED if code & 4 else KEEP
            as_user = stay + (role != USER) * REROLE + assistant[i + 1]
            as_assistant = stay + (role != ASSISTANT) * REROLE + user[i + 1]
            s, u, a = min(s, as_user), min(u, as_user), min(a, as_assistant)
            if role == SYSTEM:
                s = min(s, stay + user[i + 1])
        u, a = min(u, a + INSERT), min(a, u + INSERT)
        start[i], user[i], assistant[i] = min(s, a + INSERT), u, a
    return start, user, assistant, user


def search(codes: Sequence[int]) -> tuple[int, str]:
    """Cost and initials of the cheapest edits, least in ASCII among equals."""
    n = len(codes)
    start, after_system, after_user, after_assistant = lower_bounds(codes)
    bounds = (start, after_system, after_user, after_assistant)
    failed = [-1] * (4 * (n + 1))  # largest budget with which a state is known to fail
    bound = start[0]
    while True:
        path: list[str] = []
        frames = [[0, _START, 0, 0]]  # row, state, cost so far, next edit
        while frames:
            frame = frames[-1]
            i, state, cost, edit = frame
            if i == n and state in (_START, _ASSISTANT):
                return cost, "".join(path)
            child = None
            while edit < 4 and child is None:
                if edit == 1:
                    child = (i, _AFTER[state], cost + INSERT, "I")
                elif i < n:
                    code = codes[i]
                    if edit == 0:
                        child = (i + 1, state, cost + DELETE, "D")
                    elif code < FORCED:
                        role, stay = code & 3, cost + (TRUNCATED if code & 4 else KEEP)
                        if edit == 3:
                            child = (i + 1, _AFTER[state], stay + REROLE, "R")
                        elif role == _NEXT[state]:
                            child = (i + 1, _AFTER[state], stay, "K")
                        elif role == SYSTEM and state == _START:
                            child = (i + 1, _SYSTEM, stay, "K")
                edit += 1
                if child and (child[2] + bounds[child[1]][child[0]] > bound or failed[4 * child[0] + child[1]] >= bound - child[2]):
                    child = None
            frame[3] = edit
            if child:
                frames.append([child[0], child[1], child[2], 0])
                path.append(child[3])
            else:
                at = 4 * i + state
                failed[at] = max(failed[at], bound - cost)
                frames.pop()
                if path:
                    path.pop()
        bound += 1


def _ordered(df: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation together in one task and in order, as a stream."""
    by = [F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    return df.repartition(shared(df.sparkSession), "conv_id").sortWithinPartitions(*by)


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, h1, h2): what the operator reads."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    return conversations.select(conversations[id_col].cast("long").alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), role.alias("role"),
                                text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"))


def coded(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn: fault of the first copy (0 none, 1 blank, 3 truncated) and how many copies are no duplicates."""
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("text").rlike(rf"[.!?]{_WHITE}*\z"), 0).otherwise(3)
    folded = rows.groupBy("conv_id", "turn", "role", "h1", "h2", fault.alias("fault")).agg(F.count("*").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = folded.groupBy("conv_id", "role", "h1", "h2").agg(F.min(when).alias("first")).toDF("c", "r", "a", "b", "first")
    met = folded.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
    return met.select("conv_id", "turn", "role", "h1", "h2", "fault", "copies",
                      F.when(F.col("turn").eqNullSafe(F.col("first.turn")), 1).otherwise(0).alias("new"))


class _Conversation:
    """What is known of the conversation that is passing by."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.last = conv_id, bytearray(), None
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn: int | None, role: str, fault: int, copies: int, new: int) -> None:
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        within = 0 if self.last is None or self.last + initial in ("su", "ua", "au") else 1
        self.illegal += within + copies - 1  # two copies side by side are never in order
        self.last = initial
        kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, OTHER)
        self.rows += copies
        if fault == 1:
            self.blank += copies
            self.codes += bytes([FORCED]) * copies
            return
        self.duplicate += copies - new
        if new:
            self.truncated += fault == 3
            self.codes.append(kind + 4 * (fault == 3))
        self.codes += bytes([FORCED]) * (copies - new)

    def result(self) -> tuple:
        cost, audit = search(self.codes)
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return self.conv_id, self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _arrow(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


_LONG, _TEXT = pa.int64(), pa.string()
_PLAN = [("conv_id", _LONG), *[(n, _LONG) for n in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", _TEXT)]
_REPAIRED = [("conv_id", _LONG), ("position", _LONG), ("role", _TEXT), ("text", _TEXT), ("edit", _TEXT)]


def plan_repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: its faults and the edits that repair it (``PLAN``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "copies", "new")], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv_id)
                now.add(*row)
                if len(out) >= 1000:
                    yield _arrow(out, _PLAN)
                    out = []
        if now is not None:
            out.append(now.result())
        yield _arrow(out, _PLAN)

    return _ordered(coded(rows)).mapInArrow(run, PLAN)


def _edited(rows: Iterator[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows of whole partitions, each conversation led by its plan, to lists of repaired rows of about ``limit`` bytes."""
    out, size, conv_id, audit, at, state, position = [], 0, None, "", 0, _START, 0

    def put(role: str, text: str, edit: str, then: int) -> None:
        nonlocal size, position, state
        out.append((conv_id, position, role, text, edit))
        size += len(text) + 64
        position += 1
        state = then

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(ROLES[_NEXT[state]], "", "I", _AFTER[state])
            at += 1

    for conv, plan, role, text in rows:
        if plan is not None:
            inserted()
            conv_id, audit, at, state, position = conv, plan, 0, _START, 0
        else:
            inserted()
            edit = audit[at]
            at += 1
            if edit == "K":
                put(role, text, edit, _SYSTEM if role[:1] == "s" else _AFTER[state])
            elif edit == "R":
                put(ROLES[_NEXT[state]], text, edit, _AFTER[state])
        if size >= limit:
            yield out
            out, size = [], 0
    inserted()
    yield out


def apply_repairs(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired rows (``REPAIRED``) of all conversations, those of one side by side and in order within a task."""
    told = rows.select("conv_id", F.lit(None).cast("string").alias("plan"), "turn", "role", "text", "h1", "h2").unionAll(
        plans.select("conv_id", F.col("audit").alias("plan"), *[F.lit(None).cast(k).alias(c) for c, k in (
            ("turn", "long"), ("role", "string"), ("text", "string"), ("h1", "long"), ("h2", "long"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for part in slices(batch) for row in zip(
            *[part.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text")], strict=True))
        for part in _edited(rows):
            yield _arrow(part, _REPAIRED)

    return _ordered(told, F.col("plan").isNull()).mapInArrow(run, REPAIRED)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` of the rows as they stand side by side, joined by line feeds; reads a stream, holds one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        kinds = [("conv_id", _LONG), ("repaired_sha256", _TEXT)]
        for batch in batches:
            for conv_id, position, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")], strict=True):
                if position == 0:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = conv_id, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                if len(out) >= 1000:
                    yield _arrow(out, kinds)
                    out = []
        if digest is not None:
            out.append((now, digest.hexdigest()))
        yield _arrow(out, kinds)

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired rows. The plans are written once and read by both."""
    rows = turns(conversations, **columns)
    plans = written(plan_repairs(rows), "repair-plans")
    return plans, apply_repairs(rows, plans)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that a checksum of ``conv_id:turn`` decides: dropped, emptied, unpunctuated, repeated, or said by the user."""
    def said(c: str) -> Column:
        return F.coalesce(conversations[c].cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
                                said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: faults, cost and edits of its damaged rows, and a digest of the repaired ones."""
    ids = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    plans, repaired = repair(damaged(conversations))
    plans = plans.withColumnRenamed("conv_id", "plan_id")
    digests = repaired_digests(repaired).withColumnRenamed("conv_id", "digest_id")
    met = ids.join(plans, F.col("conv_id").eqNullSafe(F.col("plan_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
    return met.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

