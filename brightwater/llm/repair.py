"""Conversation repair: the cheapest edits that make a conversation's turns legal."""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import BLANKS
from .shared import discard, stored

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Where a repaired conversation may be: nothing yet, after a system turn, after a user's, after an assistant's. Its next turn, and how it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
TAILS = ("", "II", "I", "")
NEVER = 1 << 60
#: One search covers so many rows at most; longer conversations are searched in parts that are put together by their states.
BLOCK_BITS = 10
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows harmed by crc32("conv:turn") % 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's.
    Nulls read as one space, but the turn and the conversation stay null."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    return rows.where(harm != 0).select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.when(harm == 4, "user").otherwise(blank(role_col)).alias("role"),
        text.alias("text"), F.when(harm == 3, 2).otherwise(1).alias("copies"),
    )


def cheapest(steps: str, start: int = START, ends=(0, 2 * INSERT, INSERT, 0), tails=TAILS) -> tuple[int, int, str]:
    """(cost, state at the end, audit) of the cheapest edits of some rows from a state, by A*; of equal costs the audit that is least in ASCII.

    ``steps`` has two letters a row: its role's initial (s, u, a; - for others) and its fault (b blank, d duplicate, t truncated, - none). The lattice's nodes are
    (rows done, state); ``ends`` is what each last state costs further on, ``tails`` what it adds to the audit. What lies ahead costs at least a deletion for
    each blank or duplicate row and for each truncated row the less of deletion and charge, as sums from the end; keys are (cost + that, audit). The estimate falls
    by no more than an edit costs, and the beginnings of a lesser audit with an equal key come first, so a node is final when it is taken.
    """
    n = len(steps) // 2
    ahead = [min(ends)] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + {"b": DELETE, "d": DELETE, "t": min(DELETE, TRUNCATED)}.get(steps[2 * i + 1], 0)
    queue = [(ahead[0], "", 0, 0, start)]
    done = set()
    while queue:
        _, audit, cost, i, state = heapq.heappop(queue)
        if i > n:
            return cost, state, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if ends[state] < NEVER:
                heapq.heappush(queue, (cost + ends[state], audit + tails[state], cost + len(tails[state]) * INSERT, n + 1, state))
            continue
        role, fault = steps[2 * i : 2 * i + 2]
        to = NEXT[state]
        edges = [("D", DELETE, i + 1, state), ("I", INSERT, i, to)]
        if fault not in "bd":
            extra = TRUNCATED if fault == "t" else 0
            edges.append(("R", REROLE + extra, i + 1, to))
            if role == ROLES[to][0]:
                edges.append(("K", extra, i + 1, to))
            elif role == "s" and state == START:
                edges.append(("K", extra, i + 1, SYSTEM))
        for letter, more, at, there in edges:
            if (at, there) not in done:
                heapq.heappush(queue, (cost + more + ahead[at], audit + letter, cost + more, at, there))
    return NEVER, start, ""


def _letters(rows: DataFrame) -> DataFrame:
    """(conv, seq, turn, role, text, copies, said, step), stored: rows in a global order ``seq``, by conversation, turn (nulls first), role and text.

    Rows are dealt by ranges of all that, so a conversation of any length lies in as many parts as it needs; only rows that agree in everything to the 64th letter stay together.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    fault = F.when(bare == "", "b").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    ordered = rows.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")
    return stored(
        ordered.select(
            "conv", F.monotonically_increasing_id().alias("seq"), "turn", "role", "text", "copies", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("said"),
            F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault).alias("step"),
        ), "turns",
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, steps, low, high, turns), stored: two letters for each row, however long its text, and the turns of up to 2^BLOCK_BITS rows."""
    rows = turns.select("conv", "seq", "turn", "copies", "said", "step")
    first = rows.groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    again = F.concat(F.substring("step", 1, 1), F.when(F.col("step").endswith("b"), "b").otherwise("d"))
    step = F.when(F.col("seq") > F.col("first"), again).otherwise(F.col("step"))
    marked = marked.select("conv", "seq", "turn", F.when(F.col("copies") == 2, F.concat(step, again)).otherwise(step).alias("step"))
    inside = F.transform(F.sort_array(F.collect_list(F.struct("seq", "step"))), lambda x: x["step"])
    return stored(
        marked.groupBy("conv", F.shiftright("seq", BLOCK_BITS).alias("block"))
        .agg(F.array_join(inside, "").alias("steps"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns")),
        "blocks",
    )


def _crossings(batches):
    """For the parts of long conversations: the cheapest cost from each state to each."""
    only = [[0 if a == b else NEVER for a in range(4)] for b in range(4)]
    for batch in batches:
        costs = [[cheapest(s, a, only[b], [""] * 4)[0] for a in range(4) for b in range(4)] for s in batch.column("steps").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(costs, pa.list_(pa.int64()))], names=["conv", "block", "costs"])


def _backward(f: pd.DataFrame) -> pd.DataFrame:
    """What each part's last states cost until the conversation's end."""
    f = f.sort_values("block", ascending=False)
    ends, out = [0, 2 * INSERT, INSERT, 0], []
    for costs in f.costs:
        out.append(ends)
        ends = [min(NEVER, min(costs[4 * a + b] + ends[b] for b in range(4))) for a in range(4)]
    return pd.DataFrame({"conv": f.conv, "block": f.block, "ends": out, "last": [i == 0 for i in range(len(f))]})


def _pieces(batches):
    """The audit of each part, for each state it may begin in (a conversation of one part begins at the start)."""
    kinds = {"costs": pa.int64(), "states": pa.int64(), "audits": pa.string()}
    for batch in batches:
        found = [
            [cheapest(s)] if last is None else [cheapest(s, a, ends, TAILS if last else ("",) * 4) for a in range(4)]
            for s, ends, last in zip(*(batch.column(c).to_pylist() for c in ("steps", "ends", "last")))
        ]
        out = batch.drop_columns(["ends", "last"])
        more = [pa.array([[x[k] for x in row] for row in found], pa.list_(kind)) for k, kind in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, *kinds])


def _forward(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("block")
    state, out = START, []
    for states in f.states:
        out.append(state)
        state = states[state]
    return pd.DataFrame({"conv": f.conv, "block": f.block, "begins": out})


def _planned(turns: DataFrame) -> DataFrame:
    """(conv, block, steps, low, high, turns, begins, cost, audit), stored: the edits of each part of each conversation.

    Parts of a long conversation are searched by different tasks: first what it costs to cross each from any state to any other; then, one small row a part, what
    follows each from its last states; then the edits for each first state; then which states the parts begin in. A part's edits end with one that takes a row, so the least
    audit of the whole is that of the parts in turn.
    """
    kind = turns.schema["conv"].dataType.simpleString()
    blocks = _blocks(turns)
    several = blocks.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    long_ones = blocks.join(several, F.col("conv").eqNullSafe(F.col("c")), "leftsemi").select("conv", "block", "steps")
    crossings = long_ones.mapInArrow(_crossings, f"conv {kind}, block long, costs array<long>")
    ends = stored(crossings.groupBy("conv").applyInPandas(_backward, f"conv {kind}, block long, ends array<long>, last boolean"), "ends")
    with_ends = blocks.join(ends.select(F.col("conv").alias("c"), F.col("block").alias("b"), "ends", "last"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    fields = "steps string, low long, high long, turns long, costs array<long>, states array<long>, audits array<string>"
    pieces = stored(with_ends.select("conv", "block", "steps", "low", "high", "turns", "ends", "last").mapInArrow(_pieces, f"conv {kind}, block long, {fields}"), "pieces")
    begins = pieces.where("size(costs) > 1").select("conv", "block", "states").groupBy("conv").applyInPandas(_forward, f"conv {kind}, block long, begins int")
    begins = begins.select(F.col("conv").alias("c"), F.col("block").alias("b"), "begins")
    joined = pieces.join(begins, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").withColumn("begins", F.coalesce("begins", F.lit(START)))
    own = lambda c: F.element_at(c, F.col("begins") + 1)
    out = stored(joined.select("conv", "block", "steps", "low", "high", "turns", "begins", own("costs").alias("cost"), own("audits").alias("audit")), "plan")
    for old in (blocks, ends, pieces):
        discard(old)
    return out


def _stream(turns: DataFrame, plan: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The parts' plans and the rows in one table; a part's plan sorts before its rows."""
    plans = plan.select("conv", F.shiftleft("block", BLOCK_BITS).alias("seq"), F.lit(0).alias("kind"), F.struct("steps", "low", "high", "turns", "begins", "cost", "audit").alias("plan"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), "block")
    rows = turns.select("conv", "seq", F.lit(1), F.lit(None), "role", "text", "copies", F.shiftright("seq", BLOCK_BITS))
    both = plans.union(rows)
    return both if extra is None else both.union(extra.select("conv", F.lit(-1), F.lit(-1), F.lit(None), F.lit(None), F.lit(None), F.lit(0), F.lit(-1)))


class _Walk:
    """Follows a plan over its rows: (role, text, edit) for each turn of the repaired conversation."""

    def __init__(self, audit: str, state: int):
        self.audit, self.at, self.state = audit, 0, state

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield ROLES[self.state], "", "I"

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and self.state == START and role[:1] == "s" else NEXT[self.state]
        yield ROLES[self.state] if edit == "R" else role, text, edit

    rest = _inserted


def _sorted_rows(batches):
    names = None
    for batch in batches:
        names = names or batch.schema.names
        for some in range(0, batch.num_rows, 512):
            part = batch.slice(some, 512)
            yield from zip(*(part.column(i).to_pylist() for i in range(len(names))))


class _Summary:
    def __init__(self, conv):
        self.conv, self.counts, self.low, self.high, self.turns = conv, {"b": 0, "d": 0, "t": 0, "-": 0}, None, None, 0
        self.illegal, self.cost, self.audits, self.initial, self.walk = 0, 0, [], None, None
        self.digest, self.empty = hashlib.sha256(), True

    def plan(self, p) -> None:
        self._say(self.walk.rest() if self.walk else ())
        initials, faults = p["steps"][::2], p["steps"][1::2]
        for f in "bdt":
            self.counts[f] += faults.count(f)
        chain = (self.initial or "") + initials
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in zip(chain, chain[1:]))
        self.initial = chain[-1]
        if p["low"] is not None:
            self.turns += p["turns"] - (self.high == p["low"])
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]
        self.cost += p["cost"]
        self.audits.append(p["audit"])
        self.walk = _Walk(p["audit"], p["begins"])

    def _say(self, turns) -> None:
        for role, text, _ in turns:
            self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self, role, text, copies) -> None:
        for _ in range(copies):
            self._say(self.walk.row(role, text))

    def out(self) -> tuple:
        self._say(self.walk.rest() if self.walk else ())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps if gaps < 1 << 63 else None, *(self.counts[f] for f in "bdt"), self.illegal, self.cost, "".join(self.audits), self.digest.hexdigest())


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies; as ``damage`` gives) and of ``every`` (conv): conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Keep costs 0, Rerole 1, Delete 2, Insert 5, a truncated row that stays 5; blank and duplicate rows must go. The roles' initials become ``(s?(ua)+)?``. Rows of one turn are
    ordered by role and text; null turns come first; null conversations are one. A conversation of any length is searched in parts by many tasks;
    its digest, one hash over all its text, is streamed row by row from sorted files and holds one row at a time. A conversation without rows has zeros, an empty audit
    and the hash of nothing; ``gaps`` is null where it exceeds 64 bits; an empty table gives an empty table.
    """
    turns = _letters(rows)
    plan = _planned(turns)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([turns.schema["conv"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def run(batches):
        now, out = None, []
        for conv, _, kind, plan_, role, text, copies, _ in _sorted_rows(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.out())
                now = _Summary(conv)
                if len(out) >= 512:
                    yield _batch(out, arrow)
                    out = []
            if kind == 0:
                now.plan(plan_)
            elif kind == 1:
                now.row(role, text, copies)
        if now is not None:
            yield _batch([*out, now.out()], arrow)

    known = None if every is None else every.select("conv").distinct()
    return _stream(turns, plan, known).repartition("conv").sortWithinPartitions("conv", "seq", "kind").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv, seq and place (their order), role, text and edit (K kept, R reroled, I inserted). Parts of a conversation come from different tasks."""
    turns = _letters(rows)
    plan = _planned(turns)
    schema = T.StructType([turns.schema["conv"], T.StructField("seq", T.LongType()), T.StructField("place", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("role", "text", "edit"))])
    arrow = _arrow(schema)

    def run(batches):
        walk, last, out, key = None, 0, [], None
        for conv, seq, kind, plan_, role, text, copies, block in _sorted_rows(batches):
            if kind == 0:
                out += [(key, last, 99 + k, *t) for k, t in enumerate(walk.rest())] if walk else []
                walk, key = _Walk(plan_["audit"], plan_["begins"]), conv
            else:
                said = [t for _ in range(copies) for t in walk.row(role, text)]
                out += [(conv, seq, k, *t) for k, t in enumerate(said)]
                last = seq
            if len(out) >= 256:
                yield _batch(out, arrow)
                out = []
        out += [(key, last, 99 + k, *t) for k, t in enumerate(walk.rest())] if walk else []
        if out:
            yield _batch(out, arrow)

    return _stream(turns, plan).repartition("conv", "block").sortWithinPartitions("conv", "block", "seq", "kind").mapInArrow(run, schema)
