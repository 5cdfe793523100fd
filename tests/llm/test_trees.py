"""Conversations and reply trees of odd shapes."""

from pagewright.llm import chat

CONVERSATION = "conv_id string, turn long, role string, text string"


def test_null_ids_are_apart_from_any_text(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), ("none", 0, "user", "c"), ("none", 1, "assistant", "dd"), ("", 0, "assistant", "e")]
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.format_conversations(chat.chain_nodes(spark.createDataFrame(rows, CONVERSATION))).collect()}
    assert got == {None: (2, 1), "none": (2, 2), "": (1, 1)}


def test_flat_and_deep_trees(spark):
    flat = [("flat", i, 0 if i else None, float(i % 97)) for i in range(5000)]
    deep = [("deep", i, i - 1 if i else None, 1.0) for i in range(300)]
    nodes = spark.createDataFrame(flat + deep, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.reply_paths(nodes, best=2).collect():
        paths.setdefault((r["tree"], r["branch"]), []).append((r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {("flat", 1): [0, 96], ("flat", 2): [0, 193], ("deep", 1): list(range(300))}


def test_long_texts_and_long_conversations(spark):
    rows = [("long", 0, "user", "x<|im_end|>\\" * 100_000), ("long", 1, "assistant", "y" * 500_000)] + [("many", i, "user", f"turn {i}") for i in range(1500)]
    got = {r["conv_id"]: r for r in chat.format_conversations(chat.chain_nodes(spark.createDataFrame(rows, CONVERSATION))).collect()}
    assert got["long"]["n_turns"] == 2 and got["long"]["loss_chars"] == 500_000 and got["many"]["n_turns"] == 1500 and got["many"]["loss_chars"] == 0
    assert chat.parse_conversation(got["long"]["formatted"])[0][1] == rows[0][3]
