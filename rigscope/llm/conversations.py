"""Operator 11: conversation structure repair by run-length dynamic programming.

A conversation in order (turn, nulls first; then role and the text's digest) is a sequence of symbols: the class of the
role (system, user, assistant, other) with or without a truncated text, or one that must go (blank or duplicate). Edits turn
it into one whose role initials read ``(s?(ua)+)?``. What precedes decides by one of four states (nothing, after s, u or
a), so a symbol is a 4 x 4 min-plus matrix of least costs, inserts before it included.

1. Equal rows become one with a count. A row is a duplicate if its role and text occur at an earlier turn, found by an
   aggregate on (conversation, role, digest); the copies of a row beyond the first are duplicates.
2. Rows are sorted by range, so a long conversation spreads over many tasks. Equal consecutive symbols collapse to runs.
   A run advances the least costs to the end by cached binary powers of its matrix. Runs of a conversation that lies
   within one task are unrolled there; others leave pieces of bounded size with their matrix.
3. The matrices of a conversation's pieces, one small row each, give every piece the least costs behind it. Pieces are then
   unrolled side by side, from each state that they may begin in.
4. To unroll a run, it is halved at powers of two, each half with the costs behind it; what these give is cached by symbol,
   length, state and cost differences. Of the cheapest edits the least letter is taken, which is the least audit, as an
   edit and a state leave one state.
5. Texts are shuffled once and stream through in order with the audits; no task holds a conversation's texts. One task
   streams a whole conversation there, as an audit and a digest of all its texts are one sequential value.

Cases: null roles and texts are one space; a null conversation id is a conversation; null turns come first and leave no
gaps; rows of zero ``copies`` only name their conversation, whose report is zeros and empty if no others do; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigscope.llm.common import discard, written

#: Costs of the edits, and of keeping a truncated text.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or new role leads
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})  # by class of role
GONE = 8  # symbols: class of role, plus 4 if truncated; and this one
CLOSING = ("", "II", "I", "")
FAR = 1 << 60
PIECE_RUNS = 4_096
LEGAL = {"su", "ua", "au"}
REPORT = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
Costs = tuple[int, ...]


def choices(symbol: int, state: int):
    """(letter, cost, next state) of the edits of one row, in order of letters, without inserts."""
    yield "D", DELETE, state
    if symbol != GONE:
        extra = TRUNCATED * (symbol >= 4)
        if state in KEPT[symbol % 4]:
            yield "K", extra, KEPT[symbol % 4][state]
        yield "R", REROLE + extra, NEXT[state]


def before_one(symbol: int, after: Costs) -> Costs:
    """Least costs from each state before a row to the end, given those after it; inserts come first."""
    cost = [min(c + after[s] for _, c, s in choices(symbol, state)) for state in range(4)]
    for _ in range(3):
        cost = [min(cost[s], INSERT + cost[NEXT[s]]) for s in range(4)]
    return tuple(cost)


def product(a: tuple[Costs, ...], b: tuple[Costs, ...]) -> tuple[Costs, ...]:
    return tuple(tuple(min(min(x + row[j] for x, row in zip(r, b, strict=True)), FAR) for j in range(4)) for r in a)


def times(m: tuple[Costs, ...], after: Costs) -> Costs:
    return tuple(min(x + c for x, c in zip(row, after, strict=True)) for row in m)


@lru_cache(maxsize=None)  # nine symbols, and as many powers as a count has bits
def power(symbol: int, k: int) -> tuple[Costs, ...]:
    """The transition of 2^k equal symbols."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    columns = [before_one(symbol, tuple(0 if s == e else FAR for s in range(4))) for e in range(4)]
    return tuple(tuple(min(c[s], FAR) for c in columns) for s in range(4))


@lru_cache(maxsize=1 << 16)
def before(symbol: int, count: int, after: Costs) -> Costs:
    """Least costs before a run, by the binary powers of its length."""
    for k in range(count.bit_length()):
        if count >> k & 1:
            after = times(power(symbol, k), after)
    return after


@lru_cache(maxsize=1 << 16)
def unrolled(symbol: int, count: int, state: int, after: Costs) -> tuple[str, int]:
    """The least of the cheapest audits of a run from a state on, and the state it ends in."""
    if count == 1:
        audit, cost, at_row = "", before_one(symbol, after), True
        while at_row:
            options = [(letter, s, False) for letter, c, s in choices(symbol, state) if c + after[s] == cost[state]]
            if INSERT + cost[NEXT[state]] == cost[state]:
                options.append(("I", NEXT[state], True))
            letter, state, at_row = min(options)
            audit += letter
        return audit, state
    half = 1 << (count - 1).bit_length() - 1
    first, middle = unrolled(symbol, half, state, leveled(before(symbol, count - half, after)))
    second, end = unrolled(symbol, count - half, middle, after)
    return first + second, end


def leveled(costs: Costs) -> Costs:
    least = min(costs)
    return tuple(c - least for c in costs)


END: Costs = tuple(INSERT * len(x) for x in CLOSING)


def audited(runs: list[tuple[int, int]], after: Costs, states: range) -> tuple[list[str], list[int], list[int]]:
    """Audit, end state and cost of a piece from each of ``states``, given the least costs behind it."""
    behind = [after]
    for symbol, count in reversed(runs):
        low = min(behind[-1])
        behind.append(tuple(c + low for c in before(symbol, count, leveled(behind[-1]))))
    audits, ends, costs = [], [], []
    for state in states:
        parts, s = [], state
        for (symbol, count), rest in zip(runs, behind[-2::-1], strict=True):
            part, s = unrolled(symbol, count, s, leveled(rest))
            parts.append(part)
        audits.append("".join(parts))
        ends.append(s)
        costs.append(behind[-1][state] - after[s])
    return audits, ends, costs


def matrix(runs: list[tuple[int, int]]) -> list[int]:
    """The transition of a piece, row by row."""
    m = tuple(tuple(0 if s == e else FAR for e in range(4)) for s in range(4))
    for symbol, count in runs:
        for k in range(count.bit_length()):
            if count >> k & 1:
                m = product(m, power(symbol, k))
    return [x for row in m for x in row]


def collapsed(symbols: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal consecutive symbols."""
    at = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if len(symbols) else np.zeros(0, np.int64)
    return list(zip(symbols[at].tolist(), np.add.reduceat(counts, at).tolist() if len(at) else [], strict=True))


def _changes(column: pa.Array) -> np.ndarray:
    """Rows at which a column's value, null or not, differs from the row before."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
    return np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1


def _pieces(batches):
    """Pieces of the conversations of one task, from its rows in order."""
    number, open_, rows = 0, None, []

    def close(last: bool):
        """Ends the open piece; ``last``: its conversation may go on in the next task."""
        nonlocal number, open_
        runs = collapsed(np.concatenate(open_["symbols"]), np.concatenate(open_["counts"]))
        whole = not (open_["first"] or last)
        audits, ends, costs = audited(runs, END, range(1)) if whole else (None, None, None)
        pairs = None if whole else np.array(runs, np.int64).reshape(-1, 2)
        rows.append((*open_["key"], number, *open_["faults"].tolist(), audits, ends, costs, None if whole else matrix(runs), None if whole else pairs[:, 0].tolist(), None if whole else pairs[:, 1].tolist()))
        number, open_ = number + 1, None

    schema = None
    for batch in batches:
        conv, turn, role, digest, chunk = (batch.column(i) for i in range(5))
        n, fault, kind = (batch.column(i).to_numpy() for i in (5, 6, 7))
        schema = schema or pa.schema([("conv_id", conv.type), ("turn", turn.type), ("role", role.type), ("digest", digest.type), ("chunk", pa.int32()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated")), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())), ("symbols", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        first = np.where((fault == 1) | (fault == 2), GONE, kind + 4 * (fault == 3))
        symbols = np.stack([first, np.full(len(n), GONE)], axis=1).ravel()
        counts = np.stack([np.ones(len(n), np.int64), n - 1], axis=1).ravel()
        tally = np.stack([np.where(fault == 1, n, 0), np.where(fault == 1, 0, n - 1 + (fault == 2)), fault == 3], axis=1)
        edges = np.r_[0, _changes(conv), len(n)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if open_ is not None and (a or conv[0].as_py() != open_["key"][0]):
                close(False)
            elif open_ is not None and sum(map(len, open_["symbols"])) >= PIECE_RUNS:
                same = open_["key"][0]
                close(True)
                open_ = {"first": True, "key": (same,)}
            if open_ is None or len(open_["key"]) == 1:
                begun = open_ is not None or not number
                open_ = {"first": begun, "key": (conv[a].as_py(), turn[a].as_py(), role[a].as_py(), digest[a].as_py(), chunk[a].as_py()), "symbols": [], "counts": [], "faults": np.zeros(3, np.int64)}
            used = counts[2 * a : 2 * b] > 0
            open_["symbols"].append(symbols[2 * a : 2 * b][used])
            open_["counts"].append(counts[2 * a : 2 * b][used])
            open_["faults"] += tally[a:b].sum(axis=0)
            if len(rows) >= 5_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows.clear()
    if open_ is not None:
        close(True)
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _behind(batches):
    """(conv_id, chunk, piece, after) from the matrices of conversations' pieces, which come from the last to the first."""
    conv, after, begun = None, END, False
    for batch in batches:
        out = []
        for c, m in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not begun or c != conv:
                conv, after, begun = c, END, True
            out.append(list(after))
            after = times(tuple(tuple(m[4 * s : 4 * s + 4]) for s in range(4)), after)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "chunk", "piece", "after"])


def _unroll(batches):
    """Pieces with ``audits``, ``ends`` and ``costs`` by the state that they may begin in."""
    for batch in batches:
        symbols, counts, after = (batch.column(i).to_pylist() for i in (8, 9, 10))
        got = [audited(list(zip(s, c, strict=True)), tuple(a), range(4)) for s, c, a in zip(symbols, counts, after, strict=True)]
        lists = [pa.array([g[i] for g in got], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:8], batch.column(11), *lists], names=[*batch.schema.names[:8], batch.schema.names[11], "audits", "ends", "costs"])


class _Conversation:
    """What streams by of one conversation: its edits so far, and the repaired rows to come."""

    def __init__(self, conv):
        self.conv, self.state, self.said, self.place = conv, START, START, 0
        self.waiting, self.at, self.audit = [], 0, []
        self.cost, self.faults, self.illegal = 0, [0, 0, 0], 0
        self.turns, self.first, self.turn, self.initial = 0, None, None, None

    def piece(self, audits, ends, costs, faults) -> None:
        self.waiting.append(audits[self.state])
        self.audit.append(audits[self.state])
        self.cost += costs[self.state]
        self.state = ends[self.state]
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]

    def put(self, out: list, edit: str, role: str, text: str) -> None:
        out.append((self.conv, self.place, edit, role, text, None))
        self.place += 1

    def new_role(self) -> str:
        self.said = NEXT[self.said]
        return "user" if self.said == USER else "assistant"

    def letter(self) -> str:
        while self.at == len(self.waiting[0]):
            self.waiting.pop(0)
            self.at = 0
        self.at += 1
        return self.waiting[0][self.at - 1]

    def row(self, out: list, turn, role: str, text: str, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial, self.illegal = initial, self.illegal + copies - 1
        for _ in range(copies):
            while (edit := self.letter()) == "I":
                self.put(out, "I", self.new_role(), "")
            if edit == "K":
                self.said = KEPT["sua".index(initial)][self.said]
                self.put(out, "K", role, text)
            elif edit == "R":
                self.put(out, "R", self.new_role(), text)

    def end(self, out: list) -> None:
        for _ in CLOSING[self.state]:
            self.put(out, "I", self.new_role(), "")
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        values = (gaps, *self.faults, self.illegal, self.cost + INSERT * len(CLOSING[self.state]), "".join(self.audit) + CLOSING[self.state])
        out.append((self.conv, None, None, None, None, dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), values, strict=True))))


def _edited(batches):
    """Repaired rows and reports, from the rows and pieces of conversations in order."""
    one, schema, out, size = None, None, [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(6)], schema=schema)
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        report = pa.struct([*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
        schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("report", report)])
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "audits", "ends", "costs", "faults")]
        for conv, turn, role, text, copies, audits, ends, costs, faults in zip(*columns, strict=True):
            if one is None or conv != one.conv:
                if one is not None:
                    one.end(out)
                one = _Conversation(conv)
            if audits is not None:
                one.piece(audits, ends, costs, faults)
            else:
                one.row(out, turn, role, text, copies)
                size += len(text)
            if len(out) >= 5_000 or size > 1 << 22:
                yield pack()
                out, size = [], 0
    if one is not None:
        one.end(out)
        yield pack()


def prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """(conv_id, turn, role, text, copies, digest, fault): fault 1 blank, 3 truncated, 0 neither."""
    of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    n = F.col(f"`{copies}`").cast("long") if copies else F.lit(1).cast("long")
    slim = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), of(role).alias("role"), of(text).alias("text"), n.alias("copies"))
    seen = F.rtrim("text", F.lit(SPACE))
    fault = F.when(seen == "", 1).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return slim.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("fault", fault)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text, report): the repaired rows of each conversation in order, within one partition,
    and behind them one row with its report alone: counts, cost, and the audit of its edits (Delete, Insert, Keep, Rerole).

    ``copies``: a column with the number of times that a row counts, each next to the others.
    """
    base = prepared(rows, conv_id, turn, role, text, copies)
    key = ["conv_id", "turn", "role", "digest"]
    types = dict(base.dtypes)
    marks = base.where("copies > 0").groupBy(*key, "fault").agg(F.sum("copies").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = marks.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("at")).where("at > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = marks.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("fault") == 1, 1).when(later, 2).otherwise(F.col("fault"))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbols = met.select(*key, "n", fault.cast("long").alias("fault"), kind.cast("long").alias("kind"))
    ordered = symbols.repartitionByRange(*key).sortWithinPartitions(*key).select(*key, F.spark_partition_id().alias("chunk"), "n", "fault", "kind")
    head = ", ".join(f"{c} {types[c]}" for c in key)
    lists = "audits array<string>, ends array<bigint>, costs array<bigint>"
    pieces = written(ordered.mapInArrow(_pieces, f"{head}, chunk int, piece int, blank bigint, duplicate bigint, truncated bigint, {lists}, matrix array<bigint>, symbols array<bigint>, counts array<bigint>"), "conversations-pieces")

    faults = F.array("blank", "duplicate", "truncated").alias("faults")
    parts = pieces.where("matrix is not null")
    slim = parts.select("conv_id", "chunk", "piece", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"), F.desc("piece"))
    behind = slim.mapInArrow(_behind, f"conv_id {types['conv_id']}, chunk int, piece int, after array<bigint>").select("chunk", "piece", "after")
    open_ = parts.join(behind, ["chunk", "piece"]).select(*key, "chunk", "piece", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), "symbols", "counts", "after", faults)
    done = open_.mapInArrow(_unroll, f"{head}, chunk int, piece int, kind int, copies bigint, faults array<bigint>, {lists}")
    whole = pieces.where("matrix is null").select(*key, "chunk", "piece", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), faults, "audits", "ends", "costs")

    texts = base.select(*key, F.lit(1).alias("kind"), "copies", "text")
    stream = texts.unionByName(whole.unionByName(done), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(*key, "kind", "chunk", "piece")
    return stream.mapInArrow(_edited, f"conv_id {types['conv_id']}, place bigint, edit string, role string, text string, report {REPORT}")


def digested(repaired: DataFrame) -> DataFrame:
    """conv_id, report and repaired_sha256 (of ``role:text`` of its rows, joined by newlines) of each conversation, as ``repair`` streams by."""

    def run(batches):
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            out, at = [], []
            for i, (role, text, last) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(1).is_null().to_pylist(), strict=True)):
                if last:
                    out.append(digest.hexdigest())
                    at.append(i)
                    digest, begun = hashlib.sha256(), False
                else:
                    digest.update(f"{chr(10) * begun}{role}:{text}".encode())
                    begun = True
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(5).take(at), pa.array(out, pa.string())], names=["conv_id", "report", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conv_id {dict(repaired.dtypes)['conv_id']}, report {REPORT}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` rows damaged by crc32 of ``conv_id:turn`` (nulls: one space), modulo 20.

    0: none is left (``copies`` 0), 1: empty text, 2: text without its ``.!?``, 3: two copies, 4: role user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    of = lambda c: F.coalesce(F.col(c), F.lit(" "))
    h = F.crc32(name.cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(of("text"), ".!?", "")).otherwise(of("text"))
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(of("role")).alias("role"), text.alias("text"), copies.alias("copies"))
