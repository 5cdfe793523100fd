"""Repair of conversation structure: the cheapest edits that make the roles read ``(s?(ua)+)?``.

The roles' pattern is an automaton of four states, so the cheapest repair is a dynamic
program of four costs a turn.  Conversations are bucketed by length and stacked as
time-major tensors [turn, conversation]; costs are computed from the last turn back,
for all conversations of a bucket at once, and kept; the edits are then traced forward
for all at once, taking at each place the first letter in ASCII order that is still
cheapest.  A letter leads to one state only, so the trace gives the ASCII-least audit,
and the audit decides the repaired turns.

A conversation of more than ``LONG`` rows is never gathered: its rows are dealt out by
range of (conversation, turn), cut into blocks, and each block gives its 4 x 4 table of
least costs; one pass over the blocks (four numbers each) carries costs back, one carries
states forward, and every block is then traced on its own.  Only the final digest and
audit, one value a conversation, read its blocks in order, a block at a time.

Rows are (conv_id, turn, role, text).  Edits: Keep 0, Rerole to user or assistant 3,
Delete 4 (the only edit of a blank or duplicate turn), Insert of an empty user or
assistant turn 3; a truncated turn that stays adds 3.

Defined cases: null ids are one conversation, null turns come first, null roles and texts
are one space; rows of equal turn are ordered by role and text, so their order in the
table has no part; equal rows of a turn are duplicates but one; an empty role begins with
no letter, so it is never kept; rows marked ``gone`` count for nothing, but their
conversation is listed; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import bound_batches, spread_join, stored, table

#: Rows of a conversation above which it is repaired in blocks, and rows of a block.
LONG = 4096
#: Rows stacked at a time, and characters of a block's texts.
STACKED, BLOCK_CHARS = 16_384, 8 << 20
SPACE = " \t\n\x0b\x0c\r"
FOREVER = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# Codes of turns: the role's initial (s, u, a, other) times three, plus 0 sound, 1 to be deleted, 2 truncated; PAD fills a bucket.
INITIALS = {"s": 0, "u": 3, "a": 6}
PAD = 12
# States: 0 at the start, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
AFTER_INSERT = np.array([2, 2, 3, 2])
ENDS = np.array([0, FOREVER, FOREVER, 0])
AFTER_KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def edit_tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For D, K and R: cost and next state by [code, state]."""
    tables = {letter: (np.full((13, 4), FOREVER), np.tile(np.arange(4), (13, 1))) for letter in "DKR"}
    tables["D"][0][:12] = DELETE
    tables["D"][0][PAD] = 0
    for first, initial in (("s", 0), ("u", 3), ("a", 6), ("", 9)):
        for extra, fault in ((0, 0), (TRUNCATED, 2)):
            for state in range(4):
                tables["R"][0][initial + fault, state] = REROLE + extra
                tables["R"][1][initial + fault, state] = AFTER_INSERT[state]
                if (first, state) in AFTER_KEEP:
                    tables["K"][0][initial + fault, state] = extra
                    tables["K"][1][initial + fault, state] = AFTER_KEEP[first, state]
    return tables


EDITS = edit_tables()


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs [..., state] where up to two turns may be inserted first (a third never pays)."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[..., AFTER_INSERT])
    return costs


def costs_back(turns: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [turn + 1, conversation, state] to the end, whose costs are ``end``; ``turns`` are codes [turn, conversation]."""
    length, count = turns.shape
    costs = np.empty((length + 1, count, 4), np.int64)
    costs[length] = end
    for t in range(length - 1, -1, -1):
        options = [cost[turns[t]] + np.take_along_axis(costs[t + 1], to[turns[t]], 1) for cost, to in EDITS.values()]
        costs[t] = with_inserts(np.minimum.reduce(options))
    return np.minimum(costs, FOREVER)


def trace(turns: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters [turn + 1, conversation, 3] (0 for none), and the states reached; inserts at the end only where ``last``."""
    length, count = turns.shape
    letters, state, every = np.zeros((length + 1, count, 3), np.uint8), state.copy(), np.arange(count)

    def chosen(t: int, letter: str) -> np.ndarray:
        cost, to = EDITS[letter]
        return cost[turns[t], state] + costs[t + 1][every, to[turns[t], state]] == costs[t][every, state]

    for t in range(length + 1):
        for slot in range(2):
            before = ~chosen(t, "D") if t < length else last & (state % 3 > 0)
            inserts = before & (INSERT + costs[t][every, AFTER_INSERT[state]] == costs[t][every, state])
            letters[t, inserts, slot] = ord("I")
            state[inserts] = AFTER_INSERT[state[inserts]]
        if t < length:
            deletes, keeps = chosen(t, "D"), chosen(t, "K")
            letters[t, :, 2] = np.where(deletes, np.where(turns[t] == PAD, 0, ord("D")), np.where(keeps, ord("K"), ord("R")))
            state = np.where(deletes, state, np.where(keeps, EDITS["K"][1][turns[t], state], EDITS["R"][1][turns[t], state]))
    return letters, state


def buckets(lengths: list[int]) -> Iterator[np.ndarray]:
    """Conversations of similar length (within a factor of two), so padding at most doubles a tensor."""
    size = np.array([n.bit_length() for n in lengths], int)
    for b in np.unique(size):
        yield np.flatnonzero(size == b)


def stacked(codes: list[bytes]) -> np.ndarray:
    turns = np.full((max(map(len, codes)), len(codes)), PAD, np.uint8)
    for c, own in enumerate(codes):
        turns[:len(own), c] = np.frombuffer(own, np.uint8)
    return turns


def audits(codes: list[bytes], ends: np.ndarray, states: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Audit letters, least costs and final states of many turn sequences (codes), each with its costs at the end and its first state."""
    found, least, reached = [""] * len(codes), np.zeros(len(codes), np.int64), np.zeros(len(codes), int)
    for own in buckets([len(c) for c in codes]):
        turns = stacked([codes[i] for i in own])
        costs = costs_back(turns, np.where(last[own, None], with_inserts(ends[own]), ends[own]))
        letters, reached[own] = trace(turns, costs, states[own], last[own])
        least[own] = costs[0][np.arange(len(own)), states[own]]
        for c, i in enumerate(own):
            found[i] = letters[:, c].tobytes().replace(b"\0", b"").decode()
    return found, least, reached


def repaired_turns(audit: str, turns: list[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that the edits leave."""
    given = iter(turns)
    for letter in audit:
        role, text = next(given) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        yield role, text


def fault_of(text: str, seen: bool) -> int:
    """0 sound, 1 blank, 2 duplicate, 3 truncated."""
    ending = text.rstrip(SPACE)[-1:]
    return 1 if not ending else 2 if seen else 0 if ending in ".!?" else 3


class Run:
    """Consecutive turns of one conversation, and what is counted of them."""

    def __init__(self, conv_id: str | None) -> None:
        self.conv_id, self.turns, self.codes, self.faults, self.numbers, self.chars = conv_id, [], bytearray(), [0, 0, 0, 0], [], 0

    def add(self, turn: str | None, role: str, text: str, seen: bool) -> None:
        fault = fault_of(text, seen)
        self.faults[fault] += 1
        self.turns.append((role, text))
        self.codes.append(INITIALS.get(role[:1], 9) + (0, 1, 1, 2)[fault])
        self.chars += len(text)
        if turn is not None and (not self.numbers or self.numbers[-1] != int(turn)):
            self.numbers.append(int(turn))

    def illegal(self) -> int:
        initials = [role[:1] for role, _ in self.turns]
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULTS = [c.split()[0] for c in RESULT.split(", ")]


def whole_conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repairs conversations whose rows come one after another, many at a time."""
    waiting: list[Run] = []
    key, seen, rows, chars = None, set(), 0, 0

    def results() -> pd.DataFrame:
        n = len(waiting)
        found, cost, _ = audits([bytes(r.codes) for r in waiting], np.tile(ENDS, (n, 1)), np.zeros(n, int), np.ones(n, bool))
        made = []
        for run, audit, least in zip(waiting, found, cost):
            text = "\n".join(f"{role}:{text}" for role, text in repaired_turns(audit, run.turns))
            gaps = run.numbers[-1] - run.numbers[0] + 1 - len(run.numbers) if run.numbers else 0
            made.append((run.conv_id, gaps, *run.faults[1:], run.illegal(), least, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(made, columns=RESULTS)

    for batch in batches:
        for k, conv_id, turn, role, text, gone in zip(*(batch[c] for c in ("key", "conv_id", "turn", "role", "text", "gone"))):
            if k != key:
                if rows >= STACKED or chars > BLOCK_CHARS:
                    yield results()
                    waiting, rows, chars = [], 0, 0
                key, seen = k, set()
                waiting.append(Run(conv_id))
            rows, chars = rows + 1, chars + len(text)
            if not gone:
                waiting[-1].add(turn, role, text, (role, text) in seen)
                seen.add((role, text))
    if waiting:
        yield results()


BLOCK = ("key string, conv_id string, part int, seq int, codes binary, faults array<long>, illegal long, numbers long, least string, most string, "
         "first string, final string, roles array<string>, texts array<string>")


def cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered rows of long conversations as blocks, numbered in order."""
    part, seq, key, run = TaskContext.get().partitionId(), 0, None, None

    def block() -> pd.DataFrame:
        bounds = (str(run.numbers[0]), str(run.numbers[-1])) if run.numbers else (None, None)
        ends = (run.turns[0][0][:1], run.turns[-1][0][:1]) if run.turns else (None, None)
        roles, texts = [r for r, _ in run.turns], [t for _, t in run.turns]
        return pd.DataFrame([(key, run.conv_id, part, seq, bytes(run.codes), run.faults[1:], run.illegal(), len(run.numbers), *bounds, *ends, roles, texts)],
                            columns=[c.split()[0] for c in BLOCK.split(", ")])

    for batch in batches:
        for k, conv_id, turn, role, text, gone, seen in zip(*(batch[c] for c in ("key", "conv_id", "turn", "role", "text", "gone", "seen"))):
            if run is None or k != key or len(run.turns) >= LONG or run.chars > BLOCK_CHARS:
                if run is not None:
                    yield block()
                    seq += 1
                key, run = k, Run(conv_id)
            if not gone:
                run.add(turn, role, text, seen)
    if run is not None:
        yield block()


def block_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least costs of each block from each state (at its start) to each state (at its end), 16 numbers."""
    for batch in batches:
        codes = list(batch["codes"])
        costs = np.zeros((len(codes), 4, 4), np.int64)
        for own in buckets([len(c) for c in codes]):
            turns = np.repeat(stacked([codes[i] for i in own]), 4, 1)
            to_each = np.tile(np.where(np.eye(4, dtype=bool), 0, FOREVER), (len(own), 1))
            costs[own] = costs_back(turns, to_each)[0].reshape(len(own), 4, 4).transpose(0, 2, 1)
        yield batch[["key", "part", "seq"]].assign(least=list(costs.reshape(-1, 16)))


def carry_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a conversation's last block to its first: the costs at each block's end."""
    key, costs, begun = None, None, False
    for batch in batches:
        ends, lasts = [], []
        for k, least in zip(batch["key"], batch["least"]):
            last = not begun or k != key
            costs = ENDS if last else costs
            key, begun = k, True
            ends.append(costs)
            lasts.append(last)
            after = with_inserts(costs) if last else costs
            costs = np.minimum((np.asarray(least).reshape(4, 4) + after[None]).min(1), FOREVER)
        yield batch[["key", "part", "seq"]].assign(end=ends, last=lasts)


def block_moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state that each block leads each state to."""
    for batch in batches:
        codes, ends, last = (np.repeat(np.array(batch[c], dtype=object), 4) for c in ("codes", "end", "last"))
        reached = audits(list(codes), np.array(list(ends), np.int64).reshape(-1, 4), np.tile(np.arange(4), len(batch)), last.astype(bool))[2]
        yield batch[["key", "part", "seq"]].assign(to=list(reached.reshape(-1, 4)))


def carry_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a conversation's first block to its last: the state at each block's start."""
    key, state, begun = None, 0, False
    for batch in batches:
        enters = []
        for k, to in zip(batch["key"], batch["to"]):
            state = 0 if not begun or k != key else state
            key, begun = k, True
            enters.append(state)
            state = int(to[state])
        yield batch[["key", "part", "seq"]].assign(enter=enters)


def repaired_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's audit, cost and repaired lines."""
    for batch in batches:
        found, least, _ = audits(list(batch["codes"]), np.array(list(batch["end"]), np.int64).reshape(-1, 4), batch["enter"].to_numpy(int), batch["last"].to_numpy(bool))
        lines = [[f"{r}:{t}" for r, t in repaired_turns(audit, list(zip(roles, texts)), enter)]
                 for audit, roles, texts, enter in zip(found, batch["roles"], batch["texts"], batch["enter"])]
        yield batch.drop(columns=["codes", "end", "last", "roles", "texts"]).assign(
            cost=least, audit=found, lines=[len(x) for x in lines], text=["\n".join(x) for x in lines])


PIECE = ("key string, conv_id string, part int, seq int, faults array<long>, illegal long, numbers long, least string, most string, first string, final string, "
         "enter int, cost long, audit string, lines long, text string")


def joined_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A conversation's blocks, in order, as one result; the digest takes a block at a time."""
    key, row, begun = None, None, False

    def result() -> pd.DataFrame:
        gaps = row["most"] - row["least"] + 1 - row["numbers"] if row["most"] is not None else 0
        return pd.DataFrame([(row["conv_id"], gaps, *row["faults"], row["illegal"], row["cost"], "".join(row["audit"]), row["digest"].hexdigest())], columns=RESULTS)

    for batch in batches:
        for b in batch.to_dict("records"):
            if not begun or b["key"] != key:
                if begun:
                    yield result()
                key, begun = b["key"], True
                # The first block's cost is that of all that follows, too.
                row = {"conv_id": b["conv_id"], "faults": [0, 0, 0], "illegal": 0, "numbers": 0, "least": None, "most": None, "final": None, "cost": b["cost"], "audit": [], "digest": hashlib.sha256(), "lines": 0}
            row["faults"] = [x + int(y) for x, y in zip(row["faults"], b["faults"])]
            row["illegal"] += b["illegal"]
            if b["first"] is not None:
                row["illegal"] += row["final"] is not None and row["final"] + b["first"] not in ("su", "ua", "au")
                row["final"] = b["final"]
            if b["least"] is not None:
                row["numbers"] += b["numbers"] - (row["most"] == int(b["least"]))
                row["least"], row["most"] = int(b["least"]) if row["least"] is None else row["least"], int(b["most"])
            row["audit"].append(b["audit"])
            if b["lines"]:
                row["digest"].update((("\n" if row["lines"] else "") + b["text"]).encode("utf-8", "surrogatepass"))
                row["lines"] += b["lines"]
    if begun:
        yield result()


def in_blocks(rows: DataFrame) -> DataFrame:
    """Results of long conversations; see the module."""
    # Numbers of stored rows stay the same however often they are read.
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("same", F.sha2(F.concat_ws(" ", F.sha2("role", 256), F.sha2("text", 256)), 256)))
    first = (rows.where("NOT gone").groupBy("key", "same").agg(F.min(F.struct("number", "id")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("key", "same", F.col("first.id").alias("first")))
    marked = spread_join(rows, first, "key", "same", by=["id"]).withColumn("seen", F.coalesce(F.col("first") != F.col("id"), F.lit(False)))
    order = [F.col("key").asc(), F.col("number").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("id").asc()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(cut_blocks, BLOCK))
    place = ["key", "part", "seq"]
    least = blocks.select(*place, "codes").mapInPandas(block_tables, "key string, part int, seq int, least array<long>")
    ends = stored(least.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seq")).mapInPandas(carry_costs, "key string, part int, seq int, end array<long>, last boolean"))
    moves = blocks.select(*place, "codes").join(ends, place).mapInPandas(block_moves, "key string, part int, seq int, to array<int>")
    states = stored(moves.repartition("key").sortWithinPartitions(*place).mapInPandas(carry_states, "key string, part int, seq int, enter int"))
    pieces = blocks.join(ends, place).join(states, place).mapInPandas(repaired_blocks, PIECE)
    return pieces.repartition("key").sortWithinPartitions(*place).mapInPandas(joined_blocks, RESULT)


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text and perhaps ``gone``): counts, cost, audit and digest of the repaired turns."""
    bound_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("number"), F.col("turn").cast("long").cast("string").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.col("gone") if "gone" in turns.columns else F.lit(False)).alias("gone"))
    long = stored(rows.groupBy("key").count().where(F.col("count") > LONG).select("key"))
    rest = rows if long.isEmpty() else rows.join(long, "key", "left_anti")
    results = rest.repartition("key").sortWithinPartitions("key", F.col("number").asc_nulls_first(), "role", "text").mapInPandas(whole_conversations, RESULT)
    if not long.isEmpty():
        results = results.unionByName(in_blocks(rows.join(long, "key", "left_semi")))
    return results.withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with known faults, chosen by the hash of conversation and turn: dropped (``gone``), emptied, cut, doubled or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """A forward program: per state the least (cost, audit, repaired text), folded over a conversation's turns."""
    state = lambda c, a, r: f"struct_pack(c := {c}, a := {a}, r := {r})"
    line = lambda s, role, text: f"{s}.r || CASE WHEN {s}.r = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}"
    step = lambda s, cost, letter, role=None, text="x.t": state(f"{s}.c + {cost}", f"{s}.a || '{letter}'", line(s, role, text) if role else f"{s}.r")
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    far = FOREVER
    inserted = lambda s, role: step(s, INSERT, "I", f"'{role}'", "''")
    two = least("acc.s2", *(inserted(f"acc.s{q}", "user") for q in (0, 1, 3)))
    three = least("acc.s3", inserted("acc.s2", "assistant"), *(inserted(inserted(f"acc.s{q}", "user"), "assistant") for q in (0, 1)))
    keep = lambda s, initial: step(s, f"(CASE WHEN x.i = '{initial}' THEN x.stay ELSE {far} END)", "K", "x.role")
    rerole = lambda s, role: step(s, f"({REROLE} + x.stay)", "R", f"'{role}'")
    delete = lambda s: step(s, DELETE, "D")
    users = [f(f"acc.s{q}", v) for q in (0, 1, 3) for f, v in ((keep, "u"), (rerole, "user"))]
    pack = lambda s0, s1, s2, s3: f"struct_pack(s0 := {s0}, s1 := {s1}, s2 := {s2}, s3 := {s3})"
    insert_step = pack("acc.s0", "acc.s1", two, three)
    turn_step = pack(delete("acc.s0"), least(delete("acc.s1"), keep("acc.s0", "s")), least(delete("acc.s2"), *users), least(delete("acc.s3"), keep("acc.s2", "a"), rerole("acc.s2", "assistant")))
    none = state(f"{far}::BIGINT", "''", "''")
    start = pack(state("0::BIGINT", "''", "''"), none, none, none)
    space = r"[^\x20\x09-\x0D]"
    return rf"""
WITH crc AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) AS bytes(b)),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ord(z)::BIGINT)),
    lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
judged AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
  CASE WHEN NOT regexp_matches(text, '{space}') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault FROM placed),
turns AS (SELECT conv_id, list(struct_pack(turns := true, role := role, t := text, i := i,
    stay := CASE fault WHEN 'truncated' THEN {TRUNCATED} WHEN '' THEN 0 ELSE {far} END::BIGINT) ORDER BY place) AS l,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
folded AS (SELECT *, list_reduce(list_concat(flatten(list_transform(l, lambda e: [{{'turns': false, 'role': '', 't': '', 'i': '', 'stay': 0::BIGINT}}, e])), [{{'turns': false, 'role': '', 't': '', 'i': '', 'stay': 0::BIGINT}}]),
    lambda acc, x: CASE WHEN x.turns THEN {turn_step} ELSE {insert_step} END, {start}) AS f FROM turns),
chosen AS (SELECT *, list_sort([f.s0, f.s3])[1] AS best FROM folded),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM ids LEFT JOIN chosen ON ids.conv_id IS NOT DISTINCT FROM chosen.conv_id
"""


ORACLE = _oracle()
