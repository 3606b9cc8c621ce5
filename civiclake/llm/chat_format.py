"""Chat formatting: the cheapest repair that makes a conversation's turns legal, then its rendering.

Legal turns: an optional system turn, then user and assistant in turn, an assistant's last. A dynamic programme over this automaton
chooses for each turn: keep it, give it another role, merge it into the message before, or put empty turns in front; and an
empty answer at the end if need be. Costs are parameters; among equally cheap repairs the one with the least sum of hashes of its turns
and choices wins, which doesn't depend on how a conversation is cut.

Conversations are sorted over all tasks, so one of any length is spread over many. A turn's effect is a matrix of least costs
between states, a stretch of turns the (min, +) product of its matrices. Each task solves the conversations it holds whole; of one
that crosses its borders it gives the stretch's matrix. The driver chains these, at most two a task, and a second pass solves
each stretch between the states it begins and ends in: the same repair as in one piece.

Each turn comes out with its role and a ``piece`` of text; the pieces of a conversation in order are its rendering. ``render`` joins them.

Defined results: roles are read trimmed and in lower case, others than the three must be relabelled; a null text is empty; turns go by
``turn`` (nulls first), then role and text, so ties and repeated rows have a fixed order and stay; a null conversation id is one conversation.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.session import materialise

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next states of each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Costs:
    relabel: float = 3.0
    merge: float = 1.0
    insert: float = 2.0


@dataclass(frozen=True)
class Step:
    """How a turn is taken from one state to the next."""

    cost: float
    role: int
    merged: bool
    before: tuple[int, ...]


def _insertions(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that make ``role`` legal after ``state``."""
    if role in LEGAL[state]:
        return ()
    for x in LEGAL[state]:
        if role in LEGAL[x]:
            return (x,)
    for x in LEGAL[state]:
        for y in LEGAL[x]:
            if role in LEGAL[y]:
                return (x, y)
    return None


def steps(costs: Costs) -> dict[tuple[int, int], dict[int, Step]]:
    """For each (role number or -1, state): the cheapest step to each next state."""
    out: dict[tuple[int, int], dict[int, Step]] = {}
    for given in (-1, SYSTEM, USER, ASSISTANT):
        for state in range(4):
            found: dict[int, Step] = {}
            options = []
            if state != START:
                options.append(Step(costs.merge + costs.relabel * (given != state), state, True, ()))
            for role in (SYSTEM, USER, ASSISTANT):
                empties = _insertions(state, role)
                if empties is not None:
                    options.append(Step(costs.relabel * (given != role) + costs.insert * len(empties), role, False, empties))
            for o in options:
                if o.role not in found or o.cost < found[o.role].cost:
                    found[o.role] = o
            out[given, state] = found
    return out


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = _ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else -1


_FACTORS = np.array([[(2654435761 * (5 * i + j + 1)) | 1 for j in range(4)] for i in range(4)], np.uint64)


def _least(cost: np.ndarray, tie: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least costs, the least ties among them, and where they are."""
    low = cost.min(axis)
    held = np.where(cost == np.expand_dims(low, axis), tie, np.inf)
    return low, held.min(axis), held.argmin(axis)


class Repair:
    """Turns are (role number, hash of the turn)."""

    def __init__(self, costs: Costs):
        self.costs, self.steps = costs, steps(costs)
        self.matrices = {}
        for given in (-1, SYSTEM, USER, ASSISTANT):
            m = np.full((4, 4), np.inf)
            for state in range(4):
                for role, step in self.steps[given, state].items():
                    m[state, role] = step.cost
            self.matrices[given] = m
        #: The empty turns that end a conversation in each state.
        self.closing = {state: (*_insertions(state, ASSISTANT), ASSISTANT) if state != ASSISTANT else () for state in range(4)}

    def effect(self, turn: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return self.matrices[turn[0]], ((np.uint64(turn[1]) * _FACTORS >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.float64)

    def product(self, turns: list[tuple[int, int]]) -> np.ndarray:
        """Least costs and ties from each state before the turns to each state after them, as 2 x 4 x 4."""
        cost = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
        tie = np.zeros((4, 4))
        for t in turns:
            c, h = self.effect(t)
            cost, tie, _ = _least(cost[:, :, None] + c[None], tie[:, :, None] + h[None], 1)
        return np.stack([cost, tie])

    def ending(self, cost: np.ndarray, tie: np.ndarray) -> int:
        """The best last state given the least costs of all states."""
        whole = cost + [self.costs.insert * len(self.closing[s]) for s in range(4)]
        return int(_least(whole, tie, 0)[2])

    def solve(self, turns: list[tuple[int, int]], first: int = START, last: int | None = None) -> list[Step]:
        """The cheapest steps from state ``first`` (to state ``last``, or to the best end)."""
        cost, tie = np.full(4, np.inf), np.zeros(4)
        cost[first] = 0
        came: list[np.ndarray] = []
        for t in turns:
            c, h = self.effect(t)
            cost, tie, back = _least(cost[:, None] + c, tie[:, None] + h, 0)
            came.append(back)
        state = self.ending(cost, tie) if last is None else last
        out = []
        for (given, _), back in zip(reversed(turns), reversed(came)):
            before = int(back[state])
            out.append(self.steps[given, before][state])
            state = before
        return out[::-1]


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


END = "<|end|>\n"


def piece(step: Step, text: str, first: bool, closing: tuple[int, ...] | None) -> str:
    """A turn's part of the rendering; ``closing`` is given for the last turn."""
    if step.merged:
        out = "\n" + text
    else:
        out = ("" if first else END) + "".join(_open(r) + END for r in step.before) + _open(step.role) + text
    if closing is not None:
        out += END + "".join(_open(r) + END for r in closing)
    return out


_OUT = [T.StructField("new_role", T.StringType()), T.StructField("merged", T.BooleanType()), T.StructField("inserted_before", T.IntegerType()),
        T.StructField("inserted_after", T.IntegerType()), T.StructField("cost", T.DoubleType()), T.StructField("piece", T.StringType())]
_HEAD = ["part", "place", "conv", "turn", "role", "text"]


def _solved(repair: Repair, turns: list[tuple[int, int]], texts: list, first_state: int, last_state: int | None, begins: bool, ends: bool):
    out = repair.solve(turns, first_state, last_state)
    rows = []
    for i, step in enumerate(out):
        closing = repair.closing[step.role] if ends and i == len(out) - 1 else None
        after = len(closing or ())
        rows.append((ROLES[step.role - 1], step.merged, len(step.before), after, step.cost + after * repair.costs.insert,
                     piece(step, texts[i] or "", begins and i == 0, closing)))
    return rows


def _turns(table: pa.Table) -> list[tuple[int, int]]:
    parts = zip(table["turn"].to_pylist(), table["role"].to_pylist(), table["text"].to_pylist())
    return [(role_number(r), zlib.crc32(f"{t}|{r}|{x}".encode())) for t, r, x in parts]


def _groups(batches: Iterator[pa.RecordBatch], key_columns: list[str]) -> Iterator[tuple[tuple, pa.Table, bool, bool]]:
    """Runs of equal keys with whether they are the first and the last of all."""
    held: list[pa.RecordBatch] = []
    key, first, ready = None, True, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in key_columns]
        a = 0
        for i in range(1, batch.num_rows + 1):
            if i < batch.num_rows and all(c[i] == c[a] for c in columns):
                continue
            now = tuple(c[a] for c in columns)
            if held and now != key:
                if ready is not None:
                    yield (*ready, False)
                ready, first = (key, pa.Table.from_batches(held), first), False
                held = []
            key = now
            held.append(batch.slice(a, i - a))
            a = i
    if held:
        if ready is not None:
            yield (*ready, False)
        ready = (key, pa.Table.from_batches(held), first)
    if ready is not None:
        yield (*ready, True)


def repair_turns(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 costs: Costs | None = None, partitions: int | None = None) -> DataFrame:
    """``part, place`` (the order of all turns), ``conv, turn, role, text`` and ``new_role, merged, inserted_before, inserted_after, cost, piece``."""
    costs = costs or Costs()
    spark = turns.sparkSession
    source = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    kinds = [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), *source.schema.fields]
    order = ("conv", "turn", "role", "text")
    ranged = source.repartitionByRange(partitions, *order) if partitions else source.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    schema = T.StructType([*kinds, *_OUT, T.StructField("stretch", T.ArrayType(T.DoubleType()))])
    result_types = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.string()]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, number, place = Repair(costs), TaskContext.get().partitionId(), 0
        for _, table, first, last in _groups(batches, ["conv"]):
            n = table.num_rows
            table = table.combine_chunks()
            roles = _turns(table)
            head = [pa.array([number] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), *[table[c].combine_chunks() for c in table.column_names]]
            place += n
            if first or last:  # may go on in another task
                matrix = repair.product(roles).ravel().tolist()
                done = [pa.nulls(n, t) for t in result_types]
                stretch = pa.array([matrix] + [None] * (n - 1), pa.list_(pa.float64()))
            else:
                rows = _solved(repair, roles, table["text"].to_pylist(), START, None, True, True)
                done = [pa.array(c, t) for c, t in zip(zip(*rows), result_types)]
                stretch = pa.nulls(n, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*head, *done, stretch], schema.names)

    first_done = materialise(ranged.mapInArrow(first_pass, schema), "turns")
    # At most two stretches a task: chained on the driver, then solved each on its own.
    stretches = first_done.where("stretch is not null").select("conv", "part", "stretch").orderBy("part", "place").collect()
    chains: dict = {}
    for conv_, part, m in stretches:
        chains.setdefault(conv_, []).append((part, np.array(m).reshape(2, 4, 4)))
    repair = Repair(costs)
    borders: dict = {}
    for conv_, chain in chains.items():
        cost, tie = np.array([0.0, np.inf, np.inf, np.inf]), np.zeros(4)
        came = []
        for _, m in chain:
            cost, tie, back = _least(cost[:, None] + m[0], tie[:, None] + m[1], 0)
            came.append(back)
        state = repair.ending(cost, tie)
        for i in range(len(chain) - 1, -1, -1):
            before = int(came[i][state])
            borders[conv_, chain[i][0]] = (before, state, i == 0, i == len(chain) - 1)
            state = before

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = Repair(costs)
        for (conv_, part), table, _, _ in _groups(batches, ["conv", "part"]):
            table = table.combine_chunks()
            start, end, begins, ends = borders[conv_, part]
            rows = _solved(again, _turns(table), table["text"].to_pylist(), start, end, begins, ends)
            yield pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in table.column_names],
                                              *[pa.array(c, t) for c, t in zip(zip(*rows), result_types)]], [*_HEAD, *[f.name for f in _OUT]])

    open_ = first_done.where("piece is null").select(*_HEAD).repartition("conv", "part").sortWithinPartitions("conv", "part", "place")
    solved = open_.mapInArrow(second_pass, T.StructType([*kinds, *_OUT]))
    return first_done.where("piece is not null").drop("stretch").unionByName(solved)


def render(repaired: DataFrame) -> DataFrame:
    """``conv, rendered, cost``: each conversation as one text. A row holds a whole conversation, so keep to pieces for very long ones."""
    parts = F.sort_array(F.collect_list(F.struct("part", "place", "piece")))
    return repaired.groupBy("conv").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("rendered"), F.sum("cost").alias("cost"))
