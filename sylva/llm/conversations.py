"""Operator 12: conversation structure repair by Four-Russians block tables.

A conversation's rows, in order, are edited at least cost so that their role initials read
``(s?(ua)+)?``: an automaton of four states (START, SYSTEM, USER, ASSISTANT). Each row is one
of nine symbols (must go; or one of four roles, truncated or not). The costs to go from a
row on, one for each state, differ by little: up to a common part they are one of a few
dozen vectors. ``Tables`` finds them all and precomputes, for every block of ``BLOCK`` symbols
and every vector to its right, the vector to its left, what it adds to the common part, and
the state in which an optimal path that enters in a given state leaves. Conversations are
then read block by block through lookups, from the end. The edits are traced from the start:
a block is expanded backward from the vector at its right, so that at each row the
ASCII-least letter among the optimal edits is known.

Block transitions compose, so no conversation needs to lie in one task: rows are
range-partitioned in conversation order, cut into segments of at most ``SEGMENT`` rows, and
each segment is read for all vectors at once (``summaries``). A conversation's segments are
then folded by their summaries alone (``boundaries``) and traced apart from each other. Only
the digest of a repaired conversation must read its rows in order in one task; it streams
them and holds one row at a time.

Null conv_id, role and text read as one blank (a null conv_id is a conversation of its own
and comes back null); null turns come first and count in no gap. Rows of equal turn go by
role, then text. Repeated rows are duplicates. An empty table gives an empty result; further
columns of any name are not read. Roles go by their first character; one that is no s, u or a
can't be kept.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
BLOCK = 4  # symbols of a table's block
SEGMENT_BITS = 12
SEGMENT = 1 << SEGMENT_BITS  # rows of a segment, at most

START, SYSTEM, USER, ASSISTANT = range(4)
# the state after a user or assistant row, where the next one may only be one of them; that is what an insertion adds
ADDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# where a kept row of role s, u, a or another leads; None: nowhere
KEPT = [{START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {}]
ROLES = {USER: "user", ASSISTANT: "assistant"}
MUST_GO, SYMBOLS = 8, 9  # symbol: role class * 2 + truncated, or MUST_GO
FAR = 1 << 20

# a row's code: role class + 4 * first fault
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
BLANKS = " \t\n\x0b\x0c\r"


def symbol(code: int) -> int:
    role, fault = code % 4, code // 4
    return MUST_GO if fault in (BLANK, DUPLICATE) else 2 * role + (fault == CUT_OFF)


SYMBOL = np.array([symbol(c) for c in range(16)], np.uint8)


def edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of each way to consume a row in a state."""
    out = [("D", DELETE, state)]
    if sym != MUST_GO:
        role, cut = divmod(sym, 2)
        if state in KEPT[role]:
            out.append(("K", KEEP + TRUNCATED * cut, KEPT[role][state]))
        out.append(("R", REROLE + TRUNCATED * cut, ADDED[state]))
    return out


def with_inserts(cost: list[int]) -> tuple[int, ...]:
    """Costs to go where rows may also be inserted first."""
    out = list(cost)
    for _ in range(3):
        out = [min(out[s], INSERT + out[ADDED[s]]) for s in range(4)]
    return tuple(out)


def before(sym: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go from a row on, given those from the next row on."""
    return with_inserts([min(c + after[t] for _, c, t in edits(sym, s)) for s in range(4)])


END = with_inserts([0, FAR, FAR, 0])


def step(sym: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least optimal letters up to and with a row's own edit, and the state after it."""
    now, letters = before(sym, after), ""
    while True:
        ways = [(x, c + after[t], t, True) for x, c, t in edits(sym, state)]
        ways.append(("I", INSERT + now[ADDED[state]], ADDED[state], False))
        letter, _, state, done = min(w for w in ways if w[1] == now[state])
        letters += letter
        if done:
            return letters, state


def tail(state: int) -> tuple[str, int]:
    """The insertions after the last row."""
    letters = ""
    while state not in (START, ASSISTANT):
        letters, state = letters + "I", ADDED[state]
    return letters, state


class Tables:
    """Normalised cost vectors, and the transitions of single symbols and of every block."""

    def __init__(self, size: int = BLOCK):
        self.size = size
        self.vectors: list[tuple[int, ...]] = []
        number: dict[tuple[int, ...], int] = {}

        def known(cost: tuple[int, ...]) -> tuple[int, int]:
            low = min(cost)
            v = tuple(c - low for c in cost)
            if v not in number:
                number[v] = len(self.vectors)
                self.vectors.append(v)
            return number[v], low

        self.end, self.end_cost = known(END)
        rows, done = [], 0
        while done < len(self.vectors):  # every vector that some sequence of symbols leads to
            v = self.vectors[done]
            rows.append([(*known(before(s, v)), [step(s, v, q)[1] for q in range(4)]) for s in range(SYMBOLS)])
            done += 1
        n = len(self.vectors)
        # of one symbol, by [symbol, vector to its right]: vector to its left, cost added, [state entered] -> state left
        self.one = (np.array([[r[s][0] for r in rows] for s in range(SYMBOLS)], np.int16),
                    np.array([[r[s][1] for r in rows] for s in range(SYMBOLS)], np.int32),
                    np.array([[r[s][2] for r in rows] for s in range(SYMBOLS)], np.int8))
        # of blocks, by [number of the block, vector to its right]; a block's number has its first symbol as highest digit
        blocks = np.array(list(itertools.product(range(SYMBOLS), repeat=size)))
        left, cost = np.tile(np.arange(n, dtype=np.int16), (len(blocks), 1)), np.zeros((len(blocks), n), np.int32)
        leave = np.tile(np.arange(4, dtype=np.int8), (len(blocks), n, 1))
        for k in range(size - 1, -1, -1):
            s = blocks[:, k][:, None]
            enter = self.one[2][s, left]
            leave = np.take_along_axis(leave, enter.astype(np.int64), 2)
            cost = cost + self.one[1][s, left]
            left = self.one[0][s, left]
        self.many = (left, cost, leave)
        self._digits = SYMBOLS ** np.arange(size - 1, -1, -1)

    def cut(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first few symbols one by one, the rest as numbers of whole blocks."""
        odd = len(symbols) % self.size
        return symbols[:odd], symbols[odd:].reshape(-1, self.size) @ self._digits

    def compose(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A sequence's transition for every vector to its right: vector to its left, cost added, and by state
        entered the state left."""
        n = len(self.vectors)
        left, cost = np.arange(n, dtype=np.int16), np.zeros(n, np.int64)
        leave = np.tile(np.arange(4, dtype=np.int8), (n, 1))
        odd, blocks = self.cut(symbols)
        for (to, add, exits), keys in ((self.many, blocks), (self.one, odd)):
            for b in keys[::-1].tolist():
                leave = np.take_along_axis(leave, exits[b, left].astype(np.int64), 1)
                cost += add[b, left]
                left = to[b, left]
        return left, cost, leave

    def trace(self, symbols: np.ndarray, right: int, state: int) -> tuple[list[str], int]:
        """Each row's letters (its insertions, then its own edit) and the state left."""
        odd, blocks = self.cut(symbols)
        vectors = [right]
        for (to, _, _), keys in ((self.many, blocks), (self.one, odd)):
            for b in keys[::-1].tolist():
                vectors.append(int(to[b, vectors[-1]]))
        vectors.reverse()  # vectors[k + 1] lies to the right of the k-th part
        out: list[str] = []
        for k, s in enumerate(odd.tolist()):
            letters, state = self.expand((s,), vectors[k + 1], state)
            out += letters
        whole = symbols[len(odd) :].reshape(-1, self.size).tolist()
        for k, block in enumerate(whole, len(odd)):
            letters, state = self.expand(tuple(block), vectors[k + 1], state)
            out += letters
        return out, state

    @lru_cache(maxsize=200_000)  # noqa: B019  (one Tables for each Python worker)
    def expand(self, block: tuple[int, ...], right: int, state: int) -> tuple[tuple[str, ...], int]:
        """A block's letters: its vectors from the right one backward, then the edits from its start."""
        vectors = [self.vectors[right]]
        for s in reversed(block):
            vectors.append(before(s, vectors[-1]))
        vectors.reverse()
        out = []
        for s, after in zip(block, vectors[1:]):
            letters, state = step(s, after, state)
            out.append(letters)
        return tuple(out), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


# ---------------------------------------------------------------------------
# Spark side


def _key(col: str) -> Column:
    """An id as text; null is one blank, which no number reads like."""
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` says."""
    rows = conversations.select(
        _key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _key("role").alias("role"), _key("text").alias("text"),
        (F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn"))) % 20).alias("_do"))
    text = F.when(F.col("_do") == 1, F.lit("")).when(F.col("_do") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_do") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_do") == 3, 2).otherwise(1))
    return rows.where("_do <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_c")).drop("_c")


def ordered(rows: DataFrame, label: str = "turns") -> DataFrame:
    """Rows with ``at``, a number that grows in conversation order. Written once, so numbers stay
    as they are when an executor is lost. A conversation may span partitions; equal rows do too
    (their place in the input decides, and makes no difference)."""
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_n")]
    return materialize(rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .drop("_n").withColumn("at", F.monotonically_increasing_id()), label)


def coded(rows: DataFrame) -> DataFrame:
    """``conv, at, turn, code`` of ordered rows: role class and first fault."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    cut_off = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("conv", "at", "turn", role.alias("role"), F.sha2("text", 256).alias("h"), F.col("role").alias("_r"), (bare == "").alias("blank"), cut_off.alias("cut"))
    first = light.groupBy("conv", "_r", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT_OFF).otherwise(SOUND)
    return light.drop("h", "_r").join(first, "at", "left").select("conv", "at", "turn", (F.col("role") + 4 * fault).cast("int").alias("code"))


def segments(codes: DataFrame) -> DataFrame:
    """``conv, seg, first_at, codes``: at most ``SEGMENT`` following rows of a conversation."""
    rows = codes.groupBy("conv", F.shiftright("at", SEGMENT_BITS).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
    return rows.select("conv", "seg", F.col("rows")[0]["at"].alias("first_at"), F.col("rows.code").alias("codes"))


def _codes(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint8), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    return [flat[i:j] for i, j in zip(at, at[1:])]


def summaries(segs: DataFrame) -> DataFrame:
    """A segment's transition for every vector (``step``: vectors to the left, costs, states left, as bytes), its
    fault counts, and its wrong role pairs with the role classes at its ends."""
    kept = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("step", pa.binary()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                      ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for b in batches:
            codes, steps, counts = _codes(b.column("codes")), [], []
            for c in codes:
                left, cost, leave = t.compose(SYMBOL[c])
                steps.append(left.astype("<i2").tobytes() + cost.astype("<i8").tobytes() + leave.tobytes())
                n, role = np.bincount(c // 4, minlength=4), c % 4
                counts.append((*n[1:].tolist(), illegal(role[:-1], role[1:]), int(role[0]), int(role[-1])))
            cols = np.array(counts, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), pa.array(steps, pa.binary()), *(pa.array(cols[:, k]) for k in range(4)),
                                              *(pa.array(cols[:, k].astype(np.int32)) for k in (4, 5))], schema=kept)

    return segs.select("conv", "seg", "codes").mapInArrow(run, "conv string, seg long, step binary, blank long, duplicate long, truncated long, illegal long, head int, last int")


def illegal(left: np.ndarray, right: np.ndarray) -> int:
    """Pairs of neighbouring role classes that aren't su, ua or au."""
    fine = ((left == 0) & (right == 1)) | ((left == 1) & (right == 2)) | ((left == 2) & (right == 1))
    return int((~fine).sum())


def boundaries(parts: DataFrame) -> DataFrame:
    """``conv``, its counts and ``cost``, and ``ways``: for each segment the vector to its right and the state in
    which it is entered. Reads a conversation's summaries (some hundred bytes for up to ``SEGMENT`` rows), no rows."""
    folded = parts.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("seg", "step", "illegal", "head", "last"))).alias("segs"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    way = pa.struct([("seg", pa.int64()), ("right", pa.int32()), ("state", pa.int32()), ("final", pa.bool_())])
    kept = pa.schema([("conv", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                      ("illegal", pa.int64()), ("cost", pa.int64()), ("ways", pa.list_(way))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        n = len(t.vectors)
        for b in batches:
            wrong, costs, ways = [], [], []
            for segs in b.column("segs"):
                segs = segs.as_py()
                ends = np.array([(s["head"], s["last"]) for s in segs])
                wrong.append(sum(s["illegal"] for s in segs) + illegal(ends[:-1, 1], ends[1:, 0]))
                vector, cost, rights, leaves = t.end, t.end_cost, [], []
                for s in reversed(segs):
                    data = s["step"]
                    left, add = np.frombuffer(data, "<i2", n), np.frombuffer(data, "<i8", n, 2 * n)
                    leaves.append(np.frombuffer(data, np.int8, 4 * n, 10 * n).reshape(n, 4)[vector])
                    rights.append(vector)
                    cost, vector = cost + int(add[vector]), int(left[vector])
                costs.append(cost + t.vectors[vector][START])
                state, out = START, []
                for k, s in enumerate(segs):
                    out.append({"seg": s["seg"], "right": rights[-1 - k], "state": state, "final": k == len(segs) - 1})
                    state = int(leaves[-1 - k][state])
                ways.append(out)
            yield pa.RecordBatch.from_arrays([b.column("conv"), *(b.column(c) for c in ("blank", "duplicate", "truncated")),
                                              pa.array(wrong, pa.int64()), pa.array(costs, pa.int64()), pa.array(ways, pa.list_(way))], schema=kept)

    return folded.mapInArrow(run, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, "
                                  "ways array<struct<seg:long,right:int,state:int,final:boolean>>")


def traced(segs: DataFrame, ways: DataFrame) -> DataFrame:
    """``conv, seg, first_at, audit, rows``: a segment's edit letters, and for each of its rows the roles
    inserted before it, its own edit, the role it gets (null: its own) and, after a conversation's last row, the
    roles inserted there."""
    row = pa.struct([("before", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string()), ("after", pa.list_(pa.string()))])
    kept = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("first_at", pa.int64()), ("audit", pa.string()), ("rows", pa.list_(row))])

    def inserted(letters: str, state: int) -> tuple[list[str], int]:
        out = []
        for _ in letters:
            state = ADDED[state]
            out.append(ROLES[state])
        return out, state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for b in batches:
            audits, rows = [], []
            for codes, right, state, final in zip(_codes(b.column("codes")), *(b.column(c).to_pylist() for c in ("right", "state", "final"))):
                symbols = SYMBOL[codes]
                letters, end = t.trace(symbols, right, state)
                out = []
                for x, s in zip(letters, symbols.tolist()):
                    roles, state = inserted(x[:-1], state)
                    to = next(q for letter, _, q in edits(s, state) if letter == x[-1])
                    out.append({"before": roles, "edit": x[-1], "role": ROLES[to] if x[-1] == "R" else None, "after": []})
                    state = to
                last = tail(end)[0] if final else ""
                out[-1]["after"] = inserted(last, end)[0]
                audits.append("".join(letters) + last)
                rows.append(out)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), b.column("first_at"), pa.array(audits), pa.array(rows, pa.list_(row))], schema=kept)

    at = ways.select("conv", F.inline("ways"))
    both = segs.join(at, ["conv", "seg"]).select("conv", "seg", "first_at", "codes", "right", "state", "final")
    return both.mapInArrow(run, "conv string, seg long, first_at long, audit string, "
                                "rows array<struct<before:array<string>,edit:string,role:string,after:array<string>>>")


class Repair:
    """The stages of one repair, each written once where more than one result reads it."""

    def __init__(self, rows: DataFrame):
        """``rows``: ``conv, turn, role, text`` (as ``damage`` gives them; any rows of conversations will do)."""
        self.rows = ordered(rows)
        self.codes = coded(self.rows)
        self.segments = materialize(segments(self.codes), "segments")
        self.folded = materialize(boundaries(summaries(self.segments)), "folded")
        self.traces = materialize(traced(self.segments, self.folded), "traces")

    def edited(self) -> DataFrame:
        """``conv, at, edit, before, after, role, text``: every row with its edit and its new role."""
        marks = self.traces.select("first_at", F.posexplode("rows").alias("k", "r"))
        marks = marks.select((F.col("first_at") + F.col("k")).alias("at"), "r.before", "r.edit", "r.after", F.col("r.role").alias("_role"))
        return self.rows.join(marks, "at").select("conv", "at", "edit", "before", "after", F.coalesce("_role", "role").alias("role"), "text")

    def repaired(self) -> DataFrame:
        """``conv, at, k, edit, role, text``: the repaired conversations, in the order of ``at, k``."""
        def added(c: str) -> Column:
            return F.transform(c, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))

        own = F.when(F.col("edit") == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(F.array(F.struct("edit", "role", "text")))
        return self.edited().select("conv", "at", F.posexplode(F.concat(added("before"), own, added("after"))).alias("k", "r")).select("conv", "at", "k", "r.edit", "r.role", "r.text")

    def audits(self) -> DataFrame:
        pieces = F.array_sort(F.collect_list(F.struct("seg", "audit")))
        return self.traces.groupBy("conv").agg(F.array_join(pieces.getField("audit"), "").alias("audit"))

    def gaps(self) -> DataFrame:
        """``conv, gaps``: turns missing between the first and the last."""
        by_turn = self.rows.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
        return by_turn.select("conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).alias("gaps"))

    def digests(self) -> DataFrame:
        """``conv, repaired_sha256``: the digest of ``role:text`` lines; a conversation's rows stream through one task."""
        line = F.concat(F.col("role"), F.lit(":"), F.col("text"))
        added = [F.transform(c, lambda r: F.concat(r, F.lit(":"))) for c in ("before", "after")]
        own = F.when(F.col("edit") == "D", F.array().cast("array<string>")).otherwise(F.array(line))
        lines = F.concat(added[0], own, added[1])
        rows = self.edited().select("conv", "at", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("said"))
        kept = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, empty = None, hashlib.sha256(), True
            for b in batches:
                names, done = [], []
                for conv, said in zip(b.column("conv").to_pylist(), b.column("said").to_pylist()):
                    if conv != now:
                        if now is not None:
                            names.append(now)
                            done.append(state.hexdigest())
                        now, state, empty = conv, hashlib.sha256(), True
                    if said is not None:
                        state.update(said.encode() if empty else b"\n" + said.encode())
                        empty = False
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.string())], schema=kept)
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], schema=kept)

        return rows.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(run, "conv string, repaired_sha256 string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """A row for every conversation of the table: its faults after damage, the cheapest repair's cost and
    audit, and the digest of what the repair gives."""
    fixed = Repair(damage(conversations))
    ids = conversations.select(_key("conv_id").alias("conv"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [ids, fixed.folded.drop("ways"), fixed.audits(), fixed.gaps(), fixed.digests()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    out = rows.groupBy("conv").agg(F.max("conv_id").alias("conv_id"), *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
                                   F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                   F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return out.drop("conv")
