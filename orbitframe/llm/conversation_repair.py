"""Conversation structure repair by an auction shortest-path algorithm.

A conversation's rows are layers of a lattice; a node is a layer with what the roles so far end in: nothing yet, a system
turn, a user turn or an assistant turn. Arcs are edits with integer costs: Delete, Insert, Keep, Rerole. The cheapest way through is a repair.

1. *Rows* are damaged, and their faults found, by DataFrame expressions. A duplicate is looked up among the
   (conversation, role, text) that more than one row has, so no window holds a conversation.
2. *Order.* Rows are dealt by ranges of (conversation, turn, role, text digest) and sorted there. Each task cuts what it gets of a
   conversation into blocks of ``BLOCK`` rows. A conversation that one block holds is finished there; all others, and those that a range may
   have cut, go on as blocks.
3. *Auction* (Bertsekas, "An auction algorithm for shortest paths", 1991). A path is extended along an arc whose cost plus the end's price is its start's price, or,
   if there is none, the start's price rises and the path is contracted. Prices at the end are dual: on every cheapest
   path all arcs are tight, and tight arcs that lead to the end are traced in the order of their letters, so the first path found is the least.
4. *Blocks.* Costs from each state before a block to each state after it are its matrix over (min, +). A reverse scan of the matrices gives the prices after each block,
   with which its four possible entries are traced apart; these traces are matrices too, and a scan of them gives each block's real entry. Scans go by groups of ``GROUP`` items in levels.
   Only the digest of the repaired text has to pass through one task a conversation, as a stream of blocks.

Defined results: a null turn sorts first, and null ids, turns, roles and texts are one space where they become text. Rows of one turn are in the order of role, then of the text's
sha256. A null conv_id is a conversation. Roles are told by their first character. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import tidy
from .runtime import cut, require, shuffle_partitions, spread_join, table
from .words import SPACES

BLOCK = 64
GROUP = 256
BATCH_ROWS = 1024
BATCH_CHARS = 1 << 20

#: States of the lattice: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
#: The state after a role's initial, from each state.
MOVES = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state that a rerole or an insertion leads to, from each state, and the role that it gives.
NEXT = (2, 2, 3, 2)
GIVES = ("user", "user", "assistant", "user")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: After the last row: how many insertions end each state well.
ENDS = (0, 2, 1, 0)
FINAL = tuple(float(INSERT * n) for n in ENDS)
INFINITE = float("inf")
#: Faults of a row.
CLEAN, CUT_OFF, BLANK, REPEATED = range(4)
LEGAL = frozenset(("su", "ua", "au"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` of the rows after damage."""
    rows = require(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("hit", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, F.lit(2)).otherwise(F.lit(1)))))
    return rows.drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``name`` (the id as text), ``mark`` (a number for each row), ``digest`` and ``fault``."""
    stripped = F.rtrim("text", F.lit(SPACES))
    fault = F.when(stripped == "", F.lit(BLANK)).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), F.lit(CUT_OFF)).otherwise(F.lit(CLEAN))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = cut(rows.withColumns({"name": name, "digest": F.unhex(F.sha2("text", 256)), "fault": fault}).withColumn("mark", F.monotonically_increasing_id()))
    keys = ["name", "role", "digest"]
    again = rows.filter(F.col("fault") != BLANK).groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("turn", "mark"))["mark"].alias("first")).filter("n > 1")
    again = cut(again)
    met = spread_join(rows, again, keys, "n", rows.count(), "left")
    repeated = (F.col("fault") != BLANK) & (F.col("mark") != F.col("first"))
    return met.withColumn("fault", F.when(repeated, F.lit(REPEATED)).otherwise(F.col("fault"))).drop("n", "first")


def arcs_of(codes: bytes) -> list[list[tuple[str, float, int]]]:
    """The arcs (letter, cost, end) out of each node, in the order of their letters. Node 4 i + s is state s before row i.

    A code is 4 times the row's initial (0 to 3: s, u, a, other) plus its fault. Nothing is inserted after the last row.
    """
    out: list[list[tuple[str, float, int]]] = []
    for i, code in enumerate(codes):
        kind, fault = "sua-"[code >> 2], code & 3
        more = TRUNCATED if fault == CUT_OFF else 0
        for s in range(STATES):
            after = (i + 1) * STATES
            arcs = [("D", DELETE, after + s), ("I", INSERT, i * STATES + NEXT[s])]
            if fault in (CLEAN, CUT_OFF):
                kept = MOVES[kind][s] if kind in MOVES else None
                if kept is not None:
                    arcs.append(("K", more, after + kept))
                arcs.append(("R", REROLE + more, after + NEXT[s]))
            out.append(arcs)
    return out


def auction(arcs, origin: int, target: int, price: list[float], bound: float) -> float:
    """The cost of the cheapest path, by price rises in ``price``, which stays dual feasible; infinite over ``bound``."""
    path = [origin]
    while path[-1] != target:
        at = path[-1]
        best, end = INFINITE, -1
        for _, cost, j in arcs[at]:
            if cost + price[j] < best:
                best, end = cost + price[j], j
        if best > bound:
            best = INFINITE
        if price[at] < best:
            price[at] = best
            if at != origin:
                path.pop()
        elif best == INFINITE:
            return INFINITE
        else:
            path.append(end)
    return price[origin]


def least_path(arcs, origin: int, target: int, price: list[float]) -> tuple[str, int]:
    """The letters of the first path of tight arcs in their order, and its last node before the target."""
    letters, nodes, turns = [], [origin], [0]
    dead = set()
    while True:
        at = nodes[-1]
        for k in range(turns[-1], len(arcs[at])):
            letter, cost, end = arcs[at][k]
            if end not in dead and price[at] == cost + price[end]:
                turns[-1] = k + 1
                break
        else:
            dead.add(at)
            nodes.pop()
            turns.pop()
            letters.pop()
            continue
        if end == target:
            return "".join(letters), at
        letters.append(letter)
        nodes.append(end)
        turns.append(0)


@lru_cache(maxsize=1 << 16)
def costs(codes: bytes) -> tuple[float, ...]:
    """From each state before the rows to each after them: 16 costs."""
    arcs = [*arcs_of(codes), *[[] for _ in range(STATES)]]
    last, bound = len(codes) * STATES, DELETE * len(codes) + 2 * INSERT
    out = []
    for to in range(STATES):
        price = [0.0] * len(arcs)
        out.append([auction(arcs, s, last + to, price, bound) for s in range(STATES)])
    return tuple(out[to][s] for s in range(STATES) for to in range(STATES))


@lru_cache(maxsize=1 << 16)
def traces(codes: bytes, after: tuple[float, ...]) -> tuple[tuple[float, str, int] | None, ...]:
    """(cost, letters, last state) of the least cheapest path from each state; ``after`` has what the states after the rows cost from there on."""
    low = min(after)
    last = len(codes) * STATES
    target = last + STATES
    arcs = [*arcs_of(codes), *[[("", c - low, target)] for c in after], []]
    price = [0.0] * len(arcs)
    bound = DELETE * len(codes) + 2 * INSERT + max(c - low for c in after if c < INFINITE)
    out = []
    for s in range(STATES):
        cost = auction(arcs, s, target, price, bound)
        if cost == INFINITE:
            out.append(None)
            continue
        letters, end = least_path(arcs, s, target, price)
        out.append((cost + low, letters, end - last))
    return tuple(out)


def code_of(role: str, fault: int) -> int:
    return ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) * 4 + fault


def lines_of(letters: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as ``role:text``."""
    out, i = [], 0
    for letter in letters:
        if letter == "I":
            out.append(f"{GIVES[state]}:")
            state = NEXT[state]
            continue
        if letter == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = MOVES[roles[i][0]][state]
        elif letter == "R":
            out.append(f"{GIVES[state]}:{texts[i]}")
            state = NEXT[state]
        i += 1
    return out


def _sha(text: str):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
CUT_SCHEMA = (
    "conv_id long, done boolean, part int, block int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "first string, last string, codes binary, roles array<string>, texts array<string>"
)


def _cut_blocks(batches, size: int):
    """Rows (conv_id, role, text, fault) in order to one row a finished conversation, or a row a block of ``size`` rows."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([
        ("conv_id", pa.int64()), ("done", pa.bool_()), ("part", pa.int32()), ("block", pa.int32()), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string()),
        ("first", pa.string()), ("last", pa.string()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ])
    out: list[dict] = []
    held: list[tuple[str, str, int]] = []
    current, edge, block, chars, started = None, True, 0, 0, False

    def close(whole: bool) -> None:
        nonlocal held
        roles, texts, faults = [r for r, _, _ in held], [t for _, t, _ in held], [f for _, _, f in held]
        codes = bytes(map(code_of, roles, faults))
        row = {
            "conv_id": current, "done": whole, "part": part, "block": block, "blank": faults.count(BLANK), "duplicate": faults.count(REPEATED), "truncated": faults.count(CUT_OFF),
            "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False)),
        }
        if whole:
            cost, letters, end = traces(codes, FINAL)[0]
            letters += "I" * ENDS[end]
            row |= {"cost": int(cost), "audit": letters, "repaired_sha256": _sha("\n".join(lines_of(letters, 0, roles, texts))).hexdigest()}
        else:
            row |= {"first": roles[0][:1], "last": roles[-1][:1], "codes": codes, "roles": roles, "texts": texts}
        out.append(row)
        held = []

    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_ROWS):
            for conv, role, text, fault in zip(*[c.to_pylist() for c in batch.slice(low, BATCH_ROWS).columns], strict=True):
                if not started or conv != current:
                    if started:
                        close(block == 0 and not edge)
                        edge = False
                    started, current, block = True, conv, 0
                elif len(held) == size:
                    close(False)
                    block += 1
                held.append((role, text, fault))
                chars += len(text)
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
    if started:
        close(False)
    yield pa.RecordBatch.from_pylist(out, schema)


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of ``a`` and then ``b``."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def scan(items: DataFrame, start: tuple[float, ...], back: bool, size: int = GROUP) -> DataFrame:
    """``items(name, place, matrix)``, places from 0 on, to ``(name, place, carry)``: the row vector ``start`` through all matrices before, or with ``back`` the column vector ``start`` through all after.

    By groups of ``size`` items; the products of groups are items of the next level.
    """

    def inside(rows):
        order = np.argsort(rows.column("place").to_numpy())
        return rows.take(pa.array(order[::-1] if back else order))

    def total(key, rows):
        product = None
        for m in inside(rows).column("matrix").to_pylist():
            m = np.array(m).reshape(STATES, STATES)
            product = m if product is None else _then(m, product) if back else _then(product, m)
        return pa.table({"name": [key[0].as_py()], "place": [key[1].as_py()], "matrix": [product.ravel().tolist()]}, schema=pa.schema([("name", pa.string()), ("place", pa.int64()), ("matrix", pa.list_(pa.float64()))]))

    def apply(key, rows):
        rows = inside(rows)
        carry = np.array(rows.column("group_carry")[0].as_py())
        out = []
        for m in rows.column("matrix").to_pylist():
            out.append(carry.tolist())
            m = np.array(m).reshape(STATES, STATES)
            carry = (m + carry[None, :]).min(axis=1) if back else (carry[:, None] + m).min(axis=0)
        return pa.table([rows.column("name"), rows.column("place"), pa.array(out, pa.list_(pa.float64()))], ["name", "place", "carry"])

    items = items.select("name", "place", F.floor(F.col("place") / size).alias("group"), "matrix")
    first = F.array(*[F.lit(float(x)) for x in start])
    if items.filter("group > 0").isEmpty():
        items = items.withColumn("group_carry", first)
    else:
        totals = cut(items.groupBy("name", "group").applyInArrow(total, "name string, place long, matrix array<double>"))
        above = scan(totals, start, back, size).select("name", F.col("place").alias("group"), F.col("carry").alias("group_carry"))
        items = items.join(above, ["name", "group"])
    return cut(items.groupBy("name", "group").applyInArrow(apply, "name string, place long, carry array<double>"))


def _trace_blocks(batches):
    """(name, place, codes, after) to the matrix of each block's traces and the letters and costs of its four entries."""
    for batch in batches:
        names, places, codes, after = (c.to_pylist() for c in batch.columns)
        found = [traces(c, tuple(a)) for c, a in zip(codes, after, strict=True)]
        matrix = [[0.0 if t is not None and t[2] == to else INFINITE for t in f for to in range(STATES)] for f in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(matrix, pa.list_(pa.float64())), pa.array([[t and t[1] for t in f] for f in found], pa.list_(pa.string())), pa.array([[t and t[0] for t in f] for f in found], pa.list_(pa.float64()))],
            ["name", "place", "matrix", "letters", "costs"],
        )


def _join_blocks(batches):
    """Blocks in order to (name, cost, audit, repaired_sha256) of each conversation; its digest grows block by block."""
    name, sha, audit, cost, empty = None, None, [], 0, True

    def row():
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([cost], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["name", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for r in range(batch.num_rows):
            this, _, last, carry, letters, prices, roles, texts = (c[r].as_py() for c in batch.columns)
            state = carry.index(0.0)
            if this != name:
                if name is not None:
                    yield row()
                name, sha, audit, cost, empty = this, hashlib.sha256(), [], int(prices[state]), True
            own = letters[state]
            if last:
                end = traces_end(own, state, roles)
                own += "I" * ENDS[end]
            audit.append(own)
            for line in lines_of(own, state, roles, texts):
                sha.update(("" if empty else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                empty = False
    if name is not None:
        yield row()


def traces_end(letters: str, state: int, roles: list[str]) -> int:
    """The state that ``letters`` lead to."""
    i = 0
    for letter in letters:
        if letter in "IR":
            state = NEXT[state]
        elif letter == "K":
            state = MOVES[roles[i][0]][state]
        i += letter != "I"
    return state


def _matrices(batches):
    for batch in batches:
        found = [list(costs(c)) for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["name", "place", "matrix"])


def _joined(blocks: DataFrame, group: int) -> DataFrame:
    """One row for each conversation of several blocks, or of blocks that may have more."""
    order = Window.partitionBy("name").orderBy("part", "block")  # a row a block
    blocks = blocks.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    blocks = cut(blocks.withColumns({"previous": F.lag("last").over(order), "final": F.lead("place").over(order).isNull()}))
    matrices = cut(blocks.select("name", "place", "codes").mapInArrow(tidy(_matrices), "name string, place long, matrix array<double>"))
    after = scan(matrices, FINAL, True, group)
    traced = blocks.select("name", "place", "codes").join(after, ["name", "place"]).mapInArrow(tidy(_trace_blocks), "name string, place long, matrix array<double>, letters array<string>, costs array<double>")
    traced = cut(traced)
    entries = scan(traced.select("name", "place", "matrix"), (0.0, INFINITE, INFINITE, INFINITE), False, group)
    whole = blocks.join(entries, ["name", "place"]).join(traced.drop("matrix"), ["name", "place"])
    whole = whole.repartition("name").sortWithinPartitions("name", "place").select("name", "place", "final", "carry", "letters", "costs", "roles", "texts")
    repaired = whole.mapInArrow(tidy(_join_blocks), "name string, cost long, audit string, repaired_sha256 string")
    between = F.when(F.col("previous").isNotNull() & ~F.concat("previous", "first").isin(*sorted(LEGAL)), 1).otherwise(0)
    counted = blocks.groupBy("name").agg(*[F.sum(c).alias(c) for c in COUNTS[:3]], F.sum(F.col("illegal") + between).alias("illegal"))
    return counted.join(repaired, "name")


def repair(conversations: DataFrame, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    spark = conversations.sparkSession
    rows = with_faults(damaged(conversations))
    keys = [F.col("name"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("mark")]
    sorted_rows = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text", "fault")
    pieces = cut(sorted_rows.mapInArrow(tidy(lambda batches: _cut_blocks(batches, block)), CUT_SCHEMA)).withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    outcome = ["name", *COUNTS, "cost", "audit", "repaired_sha256"]
    found = pieces.filter("done").select(*outcome).unionByName(_joined(pieces.filter("not done"), group).select(*outcome))
    turns = rows.filter("turn is not null").groupBy("name", "turn").agg(F.lit(1).alias("one")).groupBy("name").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = every.join(found, "name", "left").join(turns, "name", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[none(c) for c in ("gaps", *COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_sha("").hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
