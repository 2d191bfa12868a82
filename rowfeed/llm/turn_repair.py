"""Repair of conversations' structure: the cheapest edits, by lazy weighted determinisation of an edit automaton.

Edits of a row: Keep costs 0, Rerole (to user or assistant) 1, Delete 2; Insert (an empty turn of user or assistant, anywhere) costs 5. A
truncated row that isn't deleted costs 5 more; a blank or duplicate row has to be deleted. The roles' initials must become
`(s?(ua)+)?`. Of equally cheap edits those whose initials, joined, are least in ASCII order are taken.

The automaton has four states (what the roles so far end in) and is not deterministic: the costs of going on from each of them make a vector.
A vector less its least entry is a state of the determinised automaton; there are few, found as rows ask for them, and the table of
transitions is kept. Rows are scanned from the last to the first by that table, which gives the costs; a trace from the first to the last takes, of
the arcs that are tight (cost of the arc and of going on equal the cost before), those with the least initial. Steps of the trace are kept, too.

Rows are dealt by conversation and come to a task in order, as a stream: of an unfinished conversation it holds two small numbers a row, and rows
themselves up to HELD_BYTES, beyond that in a temporary file of the task. The edits of a conversation depend on all its rows,
and so does its digest, so one conversation is one task's.

Defined results: rows go by turn, nulls first, then by role and text; a null role or text is one space; rows with a null conv_id are one
conversation; any other role than system, user and assistant (by its first letter) can't be kept; repeated rows are duplicates of the first;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowfeed.llm.common import map_stream

#: Rows of an unfinished conversation that a task holds in memory.
HELD_BYTES = 32 << 20

WHITE = "[\\x20\\x09-\\x0D]"
FAULTS = ("blank", "duplicate", "truncated")
#: Number of a row's role initial, and of a row that is only there for its conv_id.
INITIALS, OTHER, ABSENT = "sua", 3, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing yet, after system, after user, after assistant. NEXT[state][initial] is the state after a role, or None.
START, NEXT = 0, ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
USER_OR_ASSISTANT = (1, 2)
#: An inserted turn: the only role that may come next, if it is no system.
AFTER_INSERT = tuple(next(n for n in row[1:] if n is not None) for row in NEXT)


def _insertions(costs: list[int]) -> tuple[int, ...]:
    """Costs of going on, if turns may be inserted first."""
    for _ in NEXT:
        costs = [min(c, INSERT + costs[AFTER_INSERT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _arcs(state: int, initial: int, fault: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that take a row."""
    out = [("D", DELETE, state)]
    if fault in (0, 3):
        more = TRUNCATED if fault == 3 else 0
        if initial < OTHER and (to := NEXT[state][initial]) is not None:
            out.append(("K", KEEP + more, to))
        out += [("R", REROLE + more, to) for r in USER_OR_ASSISTANT if (to := NEXT[state][r]) is not None]
    return out


class Determinised:
    """The transition table: vectors of costs by number, and for a vector and a row (initial, fault) the vector before it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.steps: dict[tuple[int, int, frozenset], tuple[str, frozenset]] = {}
        far = 1 << 20
        self.end, self.end_cost = self._number(_insertions([0 if q in (START, 3) else far for q in range(len(NEXT))]))

    def _number(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def before(self, after: int, symbol: int) -> tuple[int, int]:
        """The vector before a row, and what its least cost is more than that after the row."""
        got = self.table.get((after, symbol))
        if got is None:
            on = self.vectors[after]
            costs = [min(c + on[to] for _, c, to in _arcs(q, *divmod(symbol, 4))) for q in range(len(NEXT))]
            got = self.table[after, symbol] = self._number(_insertions(costs))
        return got

    def step(self, after: int, symbol: int, at: frozenset) -> tuple[str, frozenset]:
        """From states before a row: the initials of insertions and of the row's own edit, least first, and the states after it."""
        got = self.steps.get((after, symbol, at))
        if got is None:
            (now, more), on, here, taken = self.before(after, symbol), self.vectors[after], at, ""
            have = [c + more for c in self.vectors[now]]
            while not taken or taken[-1] == "I":
                tight = [(e, to) for q in here for e, c, to in _arcs(q, *divmod(symbol, 4)) if c + on[to] == have[q]]
                tight += [("I", AFTER_INSERT[q]) for q in here if INSERT + have[AFTER_INSERT[q]] == have[q]]
                edit = min(tight)[0]
                taken, here = taken + edit, frozenset(to for e, to in tight if e == edit)
            got = self.steps[after, symbol, at] = taken, here
        return got

    def edits(self, symbols: bytes) -> tuple[list[str], str]:
        """For each row the edits up to its own, and the insertions after the last row."""
        path, states = self.end, np.empty(len(symbols), dtype=np.int32)
        for k in range(len(symbols) - 1, -1, -1):
            states[k] = path
            path = self.before(path, symbols[k])[0]
        at, out = frozenset([START]), []
        for k, symbol in enumerate(symbols):
            taken, at = self.step(int(states[k]), symbol, at)
            out.append(taken)
        last, vector = "", self.vectors[self.end]
        while not any(vector[q] == 0 and q in (START, 3) for q in at):
            last, at = last + "I", frozenset(AFTER_INSERT[q] for q in at)
        return out, last


def damage(turns: DataFrame) -> DataFrame:
    """The stated damage, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes its role user.

    A dropped row stays with `present` false, so that its conversation isn't lost.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") != 0).alias("present"),
    )


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows in order within each conversation, with the numbers of their initial and first fault."""
    rows = turns.repartition("conv_id")
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    again = F.row_number().over(W.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    end: Column = F.regexp_extract("text", f"([^\\x20\\x09-\\x0D]){WHITE}*$", 1)
    initial, first = F.lit(OTHER), F.substring("role", 1, 1)
    for k, letter in enumerate(INITIALS):
        initial = F.when(first == letter, k).otherwise(initial)
    fault = F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), 1).when(again, 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "text", F.when(F.col("present"), initial).otherwise(ABSENT).cast("byte").alias("initial"), fault.cast("byte").alias("fault"))
    return rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


class _Held:
    """Rows of one conversation that isn't finished: symbols in memory, rows in memory or, beyond HELD_BYTES, in a temporary file."""

    def __init__(self) -> None:
        self.rows, self.symbols, self.bytes, self.file, self.writer = [], bytearray(), 0, None, None

    def add(self, rows: pa.RecordBatch, symbols: bytes) -> None:
        if rows.num_rows == 0:
            return
        self.symbols += symbols
        if self.writer is None and self.bytes + rows.get_total_buffer_size() > HELD_BYTES:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
            self.writer = pa.ipc.new_stream(self.file, rows.schema)
            for held in self.rows:
                self.writer.write_batch(held)
            self.rows = []
        if self.writer is not None:
            self.writer.write_batch(rows)
        else:
            self.rows.append(rows)
            self.bytes += rows.get_total_buffer_size()

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
            self.file.close()
        yield from self.rows
        self.__init__()


REPAIRED = "conv_id bigint, step bigint, turn bigint, role string, text string, edit string, cost bigint, fault string, illegal boolean, new_role string"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto, held, id_before = Determinised(), _Held(), None

    def write(rows: pa.RecordBatch, plans: list, initials: np.ndarray, faults: np.ndarray) -> pa.RecordBatch:
        """Rows with their edits; plans: (step, previous initial, length of the repaired conversation, position in it, edits of rows, edits after the last)."""
        take, step_of, edit_of, cost_of, new_of, illegal_of, k = [], [], [], [], [], [], 0
        for plan in plans:
            step, previous, length, place, edits, last = plan
            for taken in edits:
                initial, fault = int(initials[k]), int(faults[k])
                for edit in taken or " ":
                    own = edit != "I"
                    written = edit in "IKR"
                    role = None
                    if written:
                        odd = place + length % 2  # with a system's turn first, users have odd places
                        role = "" if edit == "K" else "assistant" if odd % 2 else "user"
                        place += 1
                    take.append(k if own else -1 - k)
                    step_of.append(step)
                    edit_of.append(edit.strip())
                    cost_of.append({"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT, " ": 0}[edit] + (TRUNCATED if edit in "KR" and fault == 3 else 0))
                    new_of.append(role)
                    legal = not own or initial == ABSENT or previous is None or (previous, initial) in ((0, 1), (1, 2), (2, 1))
                    illegal_of.append(not legal)
                    if own and initial != ABSENT:
                        previous = initial
                    step += 1
                k += 1
            for edit in last:
                role = "assistant" if (place + length % 2) % 2 else "user"
                place += 1
                take.append(-k)  # -1 - (k - 1)
                step_of.append(step)
                edit_of.append(edit)
                cost_of.append(INSERT)
                new_of.append(role)
                illegal_of.append(False)
                step += 1
            plan[:] = [step, previous, length, place, [], ""]
        at = np.array(take, dtype=np.int64)
        own = pa.array(np.where(at < 0, 0, at), mask=at < 0)
        out = rows.take(pa.array(np.where(at < 0, -1 - at, at)))
        role, text = rows.column(2).take(own), rows.column(3).take(own)
        new = pa.array(new_of, pa.string())
        row = np.maximum(at, 0)
        fault = pc.take(pa.array([None, *FAULTS]), pa.array(np.where((at < 0) | (initials[row] == ABSENT), 0, faults[row])))
        new = pc.if_else(pc.fill_null(pc.equal(new, ""), False), role, new)
        turn = rows.column(1).take(own)
        return pa.RecordBatch.from_arrays(
            [out.column(0), pa.array(step_of, pa.int64()), turn, role, text, pa.array(edit_of, pa.string()), pa.array(cost_of, pa.int64()), fault, pa.array(illegal_of, pa.bool_()), new],
            names=["conv_id", "step", "turn", "role", "text", "edit", "cost", "fault", "illegal", "new_role"],
        )

    def plan_of(symbols: bytes, absent: np.ndarray) -> list:
        there = bytes(np.frombuffer(symbols, dtype=np.uint8)[~absent]) if absent.any() else symbols
        edits, last = auto.edits(there)
        length = sum(len(e) - e.count("D") for e in edits) + len(last)
        if absent.any():
            own = iter(edits)
            edits = ["" if gone else next(own) for gone in absent]
        return [0, None, length, 0, edits, last]

    def numbers(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return rows.column(4).to_numpy(), rows.column(5).to_numpy()

    def symbols_of(rows: pa.RecordBatch) -> bytes:
        initial, fault = numbers(rows)
        return (initial.astype(np.uint8) * 4 + fault.astype(np.uint8)).tobytes()

    def finish() -> Iterator[pa.RecordBatch]:
        if not held.symbols:
            return
        symbols = bytes(held.symbols)
        plan = plan_of(symbols, np.frombuffer(symbols, dtype=np.uint8) >= ABSENT * 4)
        edits, last, done = plan[4], plan[5], 0
        for rows in held.take():
            end = done + rows.num_rows
            plan[4], plan[5] = edits[done:end], last if end == len(edits) else ""
            yield write(rows, [plan], *numbers(rows))
            done = end

    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids, n = batch.column(0), batch.num_rows
        same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~(same | (null[1:] & null[:-1]))) + 1
        first = ids[0].as_py()
        if held.symbols and first != id_before:
            starts = np.concatenate([[0], starts])
        symbols = symbols_of(batch)
        id_before = ids[n - 1].as_py()
        if len(starts) == 0:
            held.add(batch, symbols)
            continue
        head, tail = int(starts[0]), int(starts[-1])
        held.add(batch.slice(0, head), symbols[:head])
        yield from finish()
        if tail > head:
            middle, absent = batch.slice(head, tail - head), np.frombuffer(symbols, dtype=np.uint8) >= ABSENT * 4
            plans = [plan_of(symbols[a:b], absent[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield write(middle, plans, *numbers(middle))
        held.add(batch.slice(tail), symbols[tail:])
    yield from finish()


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row for each row and inserted turn, in order of (conv_id, step) within a partition.

    turn, role, text: the row's own (null for an inserted turn); edit: D, I, K or R, empty for a row that isn't `present`; cost: of the edit; fault: blank,
    duplicate, truncated or null; illegal: its role can't follow the one before it; new_role: the repaired turn's role, null if it is deleted.
    `turns` has conv_id, turn, role, text, and may have `present`: false marks a row that only names its conversation.
    """
    if "present" not in turns.columns:
        turns = turns.withColumn("present", F.lit(True))
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text, "present")
    return map_stream(_numbered(rows), _repair, REPAIRED)


DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Digest:
    """What is counted of one conversation, row by row."""

    def __init__(self) -> None:
        self.turns, self.least, self.last = 0, None, None
        self.counts = dict.fromkeys((*FAULTS, "illegal", "cost"), 0)
        self.audit, self.sha, self.begun = [], hashlib.sha256(), False

    def add(self, turn: int | None, text: str | None, edit: str, cost: int, fault: str | None, illegal: bool, role: str | None) -> None:
        if turn is not None and edit not in ("", "I") and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if fault:
            self.counts[fault] += 1
        self.counts["illegal"] += illegal
        self.counts["cost"] += cost
        self.audit.append(edit)
        if role is not None:
            self.sha.update(f"{chr(10) * self.begun}{role}:{text or ''}".encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return gaps, *self.counts.values(), "".join(self.audit), self.sha.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in DIGEST.split(", ")])
    now, state = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "text", "edit", "cost", "fault", "illegal", "new_role")]
        out = []
        for conv, rows in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
            if state is None or conv != now:
                if state is not None:
                    out.append((now, *state.row()))
                now, state = conv, _Digest()
            for row in rows:
                state.add(*row[1:])
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (now, *state.row()), strict=True))], schema=schema)


def repair_digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation from the rows of `repair_conversations`, read in their order: gaps, counts of faults, cost, audit, hash of the repaired turns."""
    return map_stream(repaired, _digest, DIGEST)
