"""Chat formatting from reply trees.

Messages form trees: each has a parent or is a root.  ``reply_paths`` finds, by
pointer doubling (iterated self-joins on (tree, pointer), log2(depth) rounds of
narrow rows), every node's root, depth and summed score; a branch is a leaf with
its path to the root.  Branches are ranked per root and the chosen leaves are
walked back down the saved jump tables, so no per-node path arrays are built.
``format_conversation`` renders one path with a template of control tokens and a
loss mask; ``parse_conversation`` reads it back.

A node that many others point to, as the root of a flat tree, is joined in salted
parts (shared.spread_join).  A formatted conversation is one row, so the turns of one
path, and nothing else, meet in one task.

Defined cases: null ids are one conversation, apart from any text; a parent that does not exist makes its child a root; null or empty
texts are empty turns; null roles are empty roles; repeated rows are kept as
separate turns; an empty table gives an empty result; a cycle of parents raises
ValueError; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.shared import bound_batches, spread_join, stored, table

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings that must not appear raw inside a text: ours and those of other public templates.
CONTROLS = (START, SEPARATOR, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_TO_ESCAPE = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """Double each backslash and break each control string after its first character."""
    return _TO_ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_conversation(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the [start, end) spans that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = START + escape(role) + SEPARATOR, escape(text), END + "\n"
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def reply_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """Chosen root-to-leaf paths of (tree, node, parent, score) rows.

    Returns (tree, root, branch, node, depth): for each root its ``best`` branches
    by summed score, then length, then leaf id.  ``tree`` and ``node`` must not be null.
    """
    nodes = stored(nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = stored(
        spread_join(nodes, known, "tree", "parent").select(
            "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"))
        .select("*", F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"))
    )
    parents = state.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    jumps: list[DataFrame] = []
    most = state.count()
    while not state.where("up is not null").isEmpty():
        if 2 ** len(jumps) > most:
            raise ValueError("the parents of some nodes form a cycle")
        jumps.append(state.where("up is not null").select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"),
                             F.col("root").alias("r2"), F.col("depth").alias("d2"))
        moved = spread_join(state.where("up is not null"), above, "tree", "up").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"),
            F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"))
        state = stored(moved.unionByName(state.where("up is null")))
    ranked = Window.partitionBy("tree", "root").orderBy(F.desc("total"), F.desc("depth"), "node")
    reached = (state.join(parents, ["tree", "node"], "left_anti")
               .withColumn("branch", F.row_number().over(ranked)).where(F.col("branch") <= best)
               .select("tree", "node", "branch"))
    reached = stored(reached)
    for jump in reversed(jumps):
        higher = reached.join(jump, ["tree", "node"]).select("tree", F.col("up").alias("node"), "branch")
        reached = stored(reached.unionByName(higher))
    return reached.join(state, ["tree", "node"]).select("tree", "root", "branch", "node", "depth")


DIGEST = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, formatted string")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Format each row's turns, read the output back, and digest what was read."""
    for batch in batches:
        rows = []
        for conv_id, turns in zip(batch["conv_id"], batch["turns"]):
            formatted, spans = format_conversation([(t["role"] or "", t["text"] or "") for t in turns])
            back = parse_conversation(formatted)
            loss = "".join(unescape(formatted[a:b]) for a, b in spans)
            rows.append((conv_id, len(back), _sha("".join(f"{r}\n{t}\n" for r, t in back)), len(loss), _sha(loss), len(formatted), formatted))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])


def chain_nodes(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each turn answers the one before it (ties by role and text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text")
            .withColumn("node", F.row_number().over(order).cast("long"))
            .select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree"), "conv_id", "node", "role", "text",
                    F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score")))


def format_conversations(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, conv_id, node, parent, score, role, text) to one formatted conversation per chosen path."""
    bound_batches(nodes.sparkSession)
    chosen = reply_paths(nodes).join(nodes.select("tree", "conv_id", "node", "role", "text"), ["tree", "node"])
    gathered = (chosen.groupBy("tree", "root", "branch", "conv_id")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node", "role", "text"))),
                                 lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    # Ids cross as text, so large integers beside nulls stay exact.
    kind = nodes.schema["conv_id"].dataType
    made = gathered.select(F.col("conv_id").cast("string").alias("conv_id"), "turns").mapInPandas(render, DIGEST)
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return format_conversations(chain_nodes(given.unionByName(extra))).drop("formatted")


def _oracle() -> str:
    escaped = lambda x: f"length({x}) + length({x}) - length(replace({x}, chr(92), ''))" + "".join(
        f" + (length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in CONTROLS)
    order = "ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH given AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM given)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' {order}) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum({len(START + SEPARATOR + END) + 1} + {escaped('r')} + {escaped('x')})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


ORACLE = _oracle()


def reply_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, root, branch, n_nodes, path): the two best branches of each root of trees made of 16 conversations each."""
    order = Window.partitionBy("tree").orderBy(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")
    given = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").withColumn("tree", F.expr("cast(conv_id div 16 AS string)"))
    n = F.col("node")
    up = n - 1 - n * 7 % 3
    nodes = given.withColumn("node", F.row_number().over(order).cast("long")).select(
        "tree", "node", F.when((n % 11 != 1) & (up > 0), up).alias("parent"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
    path = F.array_sort(F.collect_list(F.struct("depth", "node")))
    return reply_paths(nodes, best=2).groupBy("tree", "root", "branch").agg(F.count(F.lit(1)).alias("n_nodes"), path.alias("p")).select(
        "tree", "root", F.col("branch").cast("long").alias("branch"), "n_nodes", F.array_join(F.transform("p", lambda x: x["node"].cast("string")), ">").alias("path"))


BRANCHES_ORACLE = """
WITH RECURSIVE numbered AS (
  SELECT (conv_id // 16)::VARCHAR AS tree, length(coalesce(text, '')) AS score,
    row_number() OVER (PARTITION BY conv_id // 16 ORDER BY conv_id, turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS node
  FROM conversations WHERE conv_id IS NOT NULL),
nodes AS (SELECT tree, node, score, CASE WHEN node % 11 <> 1 AND node - 1 - node * 7 % 3 > 0 THEN node - 1 - node * 7 % 3 END AS parent FROM numbered),
walk AS (
  SELECT tree, node, node AS root, score AS total, 1 AS n_nodes, node::VARCHAR AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT c.tree, c.node, w.root, w.total + c.score, w.n_nodes + 1, w.path || '>' || c.node FROM walk w JOIN nodes c ON c.tree = w.tree AND c.parent = w.node),
leaves AS (SELECT w.* FROM walk w WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree = w.tree AND c.parent = w.node)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree, root ORDER BY total DESC, n_nodes DESC, node) AS branch FROM leaves)
SELECT tree, root::BIGINT AS root, branch::BIGINT AS branch, n_nodes::BIGINT AS n_nodes, path FROM ranked WHERE branch <= 2
"""
