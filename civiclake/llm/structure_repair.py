"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by Viterbi in parallel chunks.

Legal roles are nothing, or an optional system turn and then user and assistant in turn. Each turn may be kept, given another role or
deleted, and empty turns may be inserted anywhere. Blank turns and repeats of an earlier turn must go; a turn whose text breaks off costs
extra while it stays. Among the cheapest repairs the one whose edits, written as initials in order, come first in ASCII is taken.

The costs still to come from each state are found from the last turn to the first. Turns are sorted over all tasks, so a conversation of
any length is cut into chunks, at most two open ones a task. A chunk starts from a speculative cost vector, as if the conversation ended
with it. Fix-up passes then hand each chunk the vector its right neighbour found: it recomputes turns from its right end until its vector
differs from the one before by a constant only, from where on all its choices are the same. Passes go on until no chunk's vector changes.
The vectors stitched this way say at each turn which edits are on a cheapest path, so the repair is traced forwards by always
taking the least initial among them. Chunks trace from all four states at once and the driver chains those maps (four
numbers a chunk), then each chunk is traced from the state it really begins in.

Defined results: turns go by turn number, nulls first, then by role, the text's first 100 characters and its hash; equal turns are folded into one row with ``copies`` before
sorting, so any number of them is one row; a null role or text counts as one space; a null id is a conversation of its own; roles are
judged by their first letter as it stands, an empty one fits nowhere; an empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.session import materialise

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
#: The state that follows an inserted, relabelled or rightly kept user or assistant turn.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
#: What is white space for blank and broken-off texts.
SPACE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 40

Vector = tuple[int, int, int, int]


@dataclass(frozen=True)
class Costs:
    relabel: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


@dataclass(frozen=True)
class Edit:
    """What happens to one turn: empty turns put before it (as states), its initial, the state after it, and the cost."""

    before: tuple[int, ...]
    initial: str
    state: int
    cost: int


def turn_code(kind: int, truncated: bool) -> int:
    """``kind`` is 0 for a turn that must go, 1 to 3 for a role's initial, 4 for any other."""
    return kind + 5 * truncated


class Viterbi:
    """Backward costs over the four states. Vectors are kept less their minimum, so those that differ by a constant are equal."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self._steps: dict[tuple[int, Vector], Vector] = {}
        self._edits: dict[tuple[int, int, Vector], Edit] = {}
        self.end = self._with_insertions((0, _NEVER, _NEVER, 0))

    def _with_insertions(self, cost: Vector) -> Vector:
        out = list(cost)
        for _ in range(3):
            out = [min(out[s], self.costs.insert + out[NEXT[s]]) for s in range(4)]
        return tuple(out)

    def _options(self, code: int, state: int, after: Vector) -> dict[str, tuple[int, int]]:
        """Cost to the end and next state of each edit of the turn itself."""
        kind, extra = code % 5, self.costs.truncated * (code // 5)
        out = {"D": (self.costs.delete + after[state], state)}
        if kind:
            if kind == SYSTEM and state == EMPTY or kind in (USER, ASSISTANT) and NEXT[state] == kind:
                out["K"] = (extra + after[kind], kind)
            out["R"] = (self.costs.relabel + extra + after[NEXT[state]], NEXT[state])
        return out

    def _before(self, code: int, after: Vector) -> Vector:
        return self._with_insertions(tuple(min(c for c, _ in self._options(code, s, after).values()) for s in range(4)))

    def step(self, code: int, after: Vector) -> Vector:
        """The vector before a turn from the one after it."""
        key = code, after
        if key not in self._steps:
            cost = self._before(code, after)
            self._steps[key] = tuple(c - min(cost) for c in cost)
        return self._steps[key]

    def backward(self, codes: list[int], after: Vector) -> list[Vector]:
        """The vectors before each turn and, last, after all of them."""
        out = [after]
        for code in reversed(codes):
            after = self.step(code, after)
            out.append(after)
        return out[::-1]

    def fixed_up(self, codes: list[int], old: Vector, new: Vector) -> Vector | None:
        """The vector before all turns for another one after them; None if it meets the old one on the way."""
        for code in reversed(codes):
            if old == new:
                return None
            old, new = self.step(code, old), self.step(code, new)
        return None if old == new else new

    def edit(self, code: int, state: int, after: Vector) -> Edit:
        """The least initial that lies on a cheapest path, insertions included."""
        key = code, state, after
        if key not in self._edits:
            cost, before = self._before(code, after), []
            start = state
            while True:
                found = {initial: to for initial, (c, to) in self._options(code, state, after).items() if c == cost[state]}
                if "D" not in found and self.costs.insert + cost[NEXT[state]] == cost[state]:
                    state = NEXT[state]
                    before.append(state)
                    continue
                initial = min(found)
                to = found[initial]
                self._edits[key] = Edit(tuple(before), initial, to, cost[start] - after[to])
                break
        return self._edits[key]

    def closing(self, state: int) -> tuple[int, ...]:
        """Empty turns that make ``state`` a legal end."""
        out = []
        while state not in (EMPTY, ASSISTANT):
            state = NEXT[state]
            out.append(state)
        return tuple(out)

    def trace(self, codes: list[int], vectors: list[Vector], state: int) -> tuple[list[Edit], int]:
        out = []
        for code, after in zip(codes, vectors[1:]):
            out.append(self.edit(code, state, after))
            state = out[-1].state
        return out, state


_EDITS = [("edit", T.StringType()), ("new_role", T.StringType()), ("inserted_before", T.ArrayType(T.StringType())),
          ("inserted_after", T.ArrayType(T.StringType())), ("cost", T.LongType()), ("illegal", T.LongType())]
_EDIT_TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64()]
_PIECE = T.StructType([T.StructField("vector", T.ArrayType(T.LongType())), T.StructField("last", T.StringType())])
_PIECE_TYPE = pa.struct([("vector", pa.list_(pa.int64())), ("last", pa.string())])


def _illegal(previous: str | None, role: str, copies: int) -> int:
    """Illegal pairs of neighbouring initials that end in this turn or its copies."""
    return (copies - 1) + (previous is not None and previous[:1] + role[:1] not in LEGAL_PAIRS)


def _rows(viterbi: Viterbi, codes: list[int], roles: list[str], copies: list[int], after: Vector, state: int, previous: str | None, ends: bool) -> list[tuple]:
    """The edit columns of a stretch of turns that begins in ``state``."""
    edits, last = viterbi.trace(codes, viterbi.backward(codes, after), state)
    out = []
    for i, (e, role, n) in enumerate(zip(edits, roles, copies)):
        closing = viterbi.closing(last) if ends and i == len(edits) - 1 else ()
        new_role = None if e.initial == "D" else role if e.initial == "K" else ROLES[e.state]
        cost = e.cost + viterbi.costs.delete * (n - 1) + viterbi.costs.insert * len(closing)
        out.append((e.initial, new_role, [ROLES[s] for s in e.before], [ROLES[s] for s in closing], cost, _illegal(previous, role, n)))
        previous = role
    return out


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]], bool]]:
    """Whole runs of equal keys with their bounds, and whether they are the last of all. Only the run at hand is kept waiting."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        starts = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
        if held and key[0] != last:
            starts.insert(0, 0)
        last = key[-1]
        if not starts:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
        shift = table.num_rows - starts[-1]
        edges = [0, *[shift + s for s in starts]]
        yield table, list(zip(edges, edges[1:])), False
        held = [batch.slice(starts[-1])]
    if held:
        table = pa.Table.from_batches(held)
        yield table, [(0, table.num_rows)], True


def _attached(table: pa.Table, columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    for array, name in zip(columns, names):
        table = table.append_column(name, array)
    yield from table.to_batches(max_chunksize=5_000)


def _fault(text: Column) -> Column:
    shown = F.rtrim(text, F.lit(SPACE))
    return F.when(shown == "", "blank").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")


def _judged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for equal turns, with copies and fault. The first of equal role and text is the one with the least turn, or none."""
    source = turns.select(turns[conv].alias("conv"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit(" ")).alias("role"),
                          F.coalesce(turns[text], F.lit(" ")).alias("text"))
    rows = source.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.sha2("text", 256)
    light = source.where(F.rtrim("text", F.lit(SPACE)) != "").select("conv", "turn", "role", digest.alias("digest"))
    several = light.groupBy("conv", "role", "digest").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("numbered"), F.count(F.lit(1)).alias("all"))
    # Repeats of one turn number alone are copies of a row; only texts under several numbers need the join.
    several = several.where("(least < most) or (numbered > 0 and numbered < all)").select(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.when(F.expr("numbered = all"), F.col("least")).alias("first"), F.lit(True).alias("several"))
    joined = rows.withColumn("digest", digest).join(
        several, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("several") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    fault = _fault(F.col("text"))
    fault = F.when(fault == "blank", fault).when(again, "duplicate").otherwise(fault)
    return joined.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def repair_structure(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                     costs: Costs = Costs(), partitions: int | None = None) -> DataFrame:
    """Each turn with its edit: ``part, place`` (the order of all turns), ``conv, turn, role, text, copies, fault, code`` and ``edit`` (K, R
    or D, copies beyond the first are deleted), ``new_role``, the roles of empty turns ``inserted_before`` and ``inserted_after``, ``cost``
    and ``illegal`` (pairs with the turn before, as it stood)."""
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 0).when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(4)
    code = (kind + F.when(F.col("fault") == "truncated", 5).otherwise(0)).cast("int")
    source = _judged(turns, conv, turn, role, text).withColumn("code", code)
    # Bounds of ranges are drawn from a sample on the driver: whole texts stay out of it.
    order = ("conv", "turn", "role", F.left("text", F.lit(100)), F.xxhash64("text"), "text")
    ranged = source.repartitionByRange(partitions, *order[:-1]) if partitions else source.repartitionByRange(*order[:-1])
    ranged = ranged.sortWithinPartitions(*order)
    base = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), *source.schema.fields])
    edits = [T.StructField(n, t) for n, t in _EDITS]
    names = [n for n, _ in _EDITS]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi, number, place = Viterbi(costs), TaskContext.get().partitionId(), 0
        for table, bounds, last in _blocks(batches, ["conv"]):
            n = table.num_rows
            codes, roles, copies = (table[c].to_pylist() for c in ("code", "role", "copies"))
            done: list[tuple] = []
            pieces: list = [None] * n
            for a, b in bounds:
                if (a == 0 and place == 0) or last:  # may go on in another task
                    done += [(None,) * len(names)] * (b - a)
                    pieces[a] = {"vector": viterbi.backward(codes[a:b], viterbi.end)[0], "last": roles[b - 1]}
                else:
                    done += _rows(viterbi, codes[a:b], roles[a:b], copies[a:b], viterbi.end, EMPTY, None, True)
            table = table.add_column(0, "part", pa.array([number] * n, pa.int32())).add_column(1, "place", pa.array(range(place, place + n), pa.int64()))
            place += n
            columns = [pa.array(c, t) for c, t in zip(zip(*done), _EDIT_TYPES)]
            yield from _attached(table, [*columns, pa.array(pieces, _PIECE_TYPE)], [*names, "piece"])

    first_done = materialise(ranged.mapInArrow(first_pass, T.StructType([*base, *edits, T.StructField("piece", _PIECE)])), "repair")
    pieces = first_done.where("piece is not null").select("conv", "part", "piece").orderBy("part", "place").collect()
    chunks: dict = {}
    for conv_, part, piece in pieces:
        chunks.setdefault(conv_, []).append((part, tuple(piece["vector"]), piece["last"]))
    open_ = first_done.where("edit is null").select(*base.names)
    borders = _stitched(open_, chunks, costs)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = Viterbi(costs)
        for table, bounds, _ in _blocks(batches, ["conv", "part"]):
            codes, roles, copies, convs, parts = (table[c].to_pylist() for c in ("code", "role", "copies", "conv", "part"))
            done: list[tuple] = []
            for a, b in bounds:
                after, state, previous, ends = borders[convs[a], parts[a]]
                done += _rows(viterbi, codes[a:b], roles[a:b], copies[a:b], after, state, previous, ends)
            yield from _attached(table, [pa.array(c, t) for c, t in zip(zip(*done), _EDIT_TYPES)], names)

    ordered = open_.repartition("conv", "part").sortWithinPartitions("conv", "part", "place")
    return first_done.where("edit is not null").drop("piece").unionByName(ordered.mapInArrow(second_pass, T.StructType([*base, *edits])))


def _stitched(open_: DataFrame, chunks: dict, costs: Costs) -> dict:
    """For each open chunk, by conversation and task: the vector after it, the state it begins in, the role before it, whether it is the last."""
    viterbi = Viterbi(costs)
    spark_rows = open_.select("conv", "part", "place", "code")
    key = [open_.schema["conv"], open_.schema["part"]]
    given = {(c, part): viterbi.end for c, chain in chunks.items() for part, _, _ in chain}
    found = {(c, part): vector for c, chain in chunks.items() for part, vector, _ in chain}
    following = {(c, chain[i][0]): (c, chain[i + 1][0]) for c, chain in chunks.items() for i in range(len(chain) - 1)}

    def over_chunks(wanted: dict, result, kind: T.DataType, arrow: pa.DataType) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            again = Viterbi(costs)
            for table, bounds, _ in _blocks(batches, ["conv", "part"]):
                codes, parts, convs = (table[c].to_pylist() for c in ("code", "part", "conv"))
                firsts = [a for a, _ in bounds if (convs[a], parts[a]) in wanted]
                values = [result(again, codes[a:b], wanted[convs[a], parts[a]]) for a, b in bounds if (convs[a], parts[a]) in wanted]
                if firsts:
                    yield from _attached(table.take(firsts).select(["conv", "part"]), [pa.array(values, arrow)], ["value"])

        rows = spark_rows.where(F.col("part").isin(sorted({part for _, part in wanted}))).repartition("conv", "part").sortWithinPartitions("conv", "part", "place")
        return {(r["conv"], r["part"]): r["value"] for r in rows.mapInArrow(run, T.StructType([*key, T.StructField("value", kind)])).collect()}

    while True:
        changed = {k: (given[k], found[after]) for k, after in following.items() if found[after] != given[k]}
        if not changed:
            break
        vectors = over_chunks(changed, lambda v, codes, pair: v.fixed_up(codes, *pair), T.ArrayType(T.LongType()), pa.list_(pa.int64()))
        for k, (_, new) in changed.items():
            given[k] = new
            if vectors[k] is not None:
                found[k] = tuple(vectors[k])
    several = {k: given[k] for c, chain in chunks.items() if len(chain) > 1 for k in [(c, part) for part, _, _ in chain]}
    maps = {}
    if several:
        def ends(v: Viterbi, codes: list[int], after: Vector) -> list[int]:
            vectors = v.backward(codes, after)
            return [v.trace(codes, vectors, s)[1] for s in range(4)]

        maps = over_chunks(several, ends, T.ArrayType(T.LongType()), pa.list_(pa.int64()))
    borders = {}
    for c, chain in chunks.items():
        state, previous = EMPTY, None
        for i, (part, _, last) in enumerate(chain):
            borders[c, part] = given[c, part], state, previous, i == len(chain) - 1
            if len(chain) > 1:
                state, previous = maps[c, part][state], last
    return borders


_SUMMARY = T.StructType([T.StructField(n, T.LongType()) for n in ("turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                        + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_LEAF = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("turns", pa.int64()), *[(n, pa.int64()) for n in _COUNTS], ("low", pa.int64()),
                   ("high", pa.int64()), ("numbers", pa.int64()), ("audit", pa.string()), ("lines", pa.int64()), ("body", pa.string())])


def _leaf(rows: list[dict]) -> dict:
    """Neighbouring turns of one conversation as one row: sums, the edits, and the repaired turns as text."""
    out: dict = {"part": rows[0]["part"], "place": rows[0]["place"], "turns": sum(r["copies"] for r in rows), "illegal": sum(r["illegal"] for r in rows),
                 "cost": sum(r["cost"] for r in rows), "blank": 0, "duplicate": 0, "truncated": 0}
    audit, lines = [], []
    for r in rows:
        more = r["copies"] - 1
        if r["fault"] == "blank":
            out["blank"] += 1 + more
        else:
            out["duplicate"] += more
            if r["fault"]:
                out[r["fault"]] += 1
        audit += ["I" * len(r["inserted_before"]), r["edit"], "D" * more, "I" * len(r["inserted_after"])]
        lines += [f"{x}:" for x in r["inserted_before"]]
        if r["edit"] != "D":
            lines.append(f"{r['new_role']}:{r['text']}")
        lines += [f"{x}:" for x in r["inserted_after"]]
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    return out | {"low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "numbers": len(set(numbers)),
                  "audit": "".join(audit), "lines": len(lines), "body": "\n".join(lines)}


def summaries(edits: DataFrame, leaf_bytes: int = 1 << 20) -> DataFrame:
    """``conv`` and per conversation the turns, gaps in whole turn numbers, faults, cost, edits (``audit``) and SHA-256 of the repaired turns.

    Neighbouring turns are first written out together where they lie, in leaves of about ``leaf_bytes``; the hash, which must see a
    conversation from its beginning to its end, then runs over leaves, one at a time."""
    conv = edits.schema["conv"]
    wanted = ["conv", "part", "place", "turn", "role", "text", "copies", "fault", "edit", "new_role", "inserted_before", "inserted_after", "cost", "illegal"]
    kinds = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.string(): T.StringType()}
    leaf_schema = T.StructType([conv, *[T.StructField(f.name, kinds[f.type]) for f in _LEAF]])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, held, size = [], [], [], 0
            for r in batch.to_pylist():
                if held and (r["conv"] != held[-1]["conv"] or r["part"] != held[-1]["part"] or r["place"] != held[-1]["place"] + 1 or size > leaf_bytes):
                    keys.append(held[0]["conv"])
                    out.append(_leaf(held))
                    held, size = [], 0
                held.append(r)
                size += len(r["text"])
            if held:
                keys.append(held[0]["conv"])
                out.append(_leaf(held))
            arrays = [pa.array([x[f.name] for x in out], f.type) for f in _LEAF]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("conv").type), *arrays], ["conv", *_LEAF.names])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[tuple] = []

        def result(x: dict) -> tuple:
            gaps = x["high"] - x["low"] + 1 - x["numbers"] if x["low"] is not None else 0
            return x["conv"], x["turns"], gaps, *[x[c] for c in _COUNTS], "".join(x["audit"]), x["hash"].hexdigest()

        def flushed() -> pa.RecordBatch:
            types = [key_type, *[pa.int64()] * 7, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], ["conv", *_SUMMARY.names])

        for batch in batches:
            key_type = batch.schema.field("conv").type
            bodies = batch.column("body")
            for i, r in enumerate(batch.drop_columns(["body"]).to_pylist()):
                if now is None or r["conv"] != now["conv"]:
                    if now is not None:
                        done.append(result(now))
                    now = {"conv": r["conv"], "turns": 0, **dict.fromkeys(_COUNTS, 0), "low": None, "high": None, "numbers": 0, "audit": [], "lines": 0, "hash": hashlib.sha256()}
                if r["lines"]:
                    now["hash"].update((("\n" if now["lines"] else "") + bodies[i].as_py()).encode())
                for c in ("turns", "lines", *_COUNTS):
                    now[c] += r[c]
                now["audit"].append(r["audit"])
                if r["low"] is not None:
                    now["numbers"] += r["numbers"] - (r["low"] == now["high"])
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            if done:
                yield flushed()
                done = []
        if now is not None:
            done.append(result(now))
            yield flushed()

    parts = edits.select(*wanted).mapInArrow(leaves, leaf_schema)
    return parts.repartition("conv").sortWithinPartitions("conv", "part", "place").mapInArrow(joined, T.StructType([conv, *_SUMMARY.fields]))


def damaged(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with faults in a fifth of the rows, by a hash of conversation and turn: some are dropped, emptied,
    stripped of sentence ends, repeated, or said to be the user's. Nulls read as one space."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(turns[conv].cast("string"), space), F.lit(":"), F.coalesce(turns[turn].cast("string"), space)).cast("binary")) % 20
    given = turns.select(turns[conv].alias("conv"), turns[turn].alias("turn"), F.coalesce(turns[role], space).alias("role"),
                         F.coalesce(turns[text], space).alias("text"), draw.alias("draw"))
    changed = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return given.where("draw <> 0").select("conv", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           changed.alias("text"), times.alias("copy")).drop("copy")
