"""Chat formatting on a prefix tree: turns that conversations share are emitted once.

A node of the tree is a distinct sequence of opening turns; conversations with the
same opening share its nodes.  Nodes are laid out depth first: a child follows its
parent, and the whole of a subtree is contiguous.  Every node carries its formatted
text, the offset of its first token in that layout, the position id of that token
within a conversation (the tokens of its ancestors come before it), the spans of the
ancestors' tokens that it may attend to besides itself, and the part of its text
that the loss covers.  A token is a code point of the formatted text.

A node's sort key is its parent's key and a hash of its own turn, so preorder is the
order of keys and needs no walk: offsets are prefix sums over a range partitioning.
No subtree is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Hexadecimal digits of a turn's own hash.
OWN = 24
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may pass for control in a text: this template's marks and those of common others.
CONTROL = r"<(?=\|(?:turn|text|end)\|>|/?s>|\|im_(?:start|end)\||</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), F.lit(CONTROL), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def parse(rendered: Column) -> tuple[Column, Column]:
    """Role and text of a rendered turn."""
    cut = F.instr(rendered, TEXT)
    role = F.substring(rendered, F.lit(len(TURN) + 1), cut - len(TURN) - 1)
    text = F.substring(rendered, cut + len(TEXT), F.length(rendered) - cut - len(TEXT) - len(END) + 1)
    return unescape(role), unescape(text)


def prefix_tree(conversations: DataFrame, *, trained_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """The packed tree of conversations (conv_id, turn, role, text).

    Returns two frames.  nodes: node_id, parent_id (null at a root), depth (from 0),
    role, formatted, token_start, n_tokens, position_start, ancestors (spans
    {begin, end} of token offsets, ends excluded, adjacent spans joined; the position
    ids of a node are position_start, position_start + 1, ...), loss_begin and
    loss_end (code points within ``formatted``; equal where nothing is trained on).
    steps: conv_id, step (from 0), node_id: the path of each conversation.

    Turns are taken in the order of turn (null first), ties by role and text, so the
    result does not depend on row order; repeated rows are turns of their own.  Null
    role or text counts as empty.  Rows with a null conv_id form one conversation.
    No rows: no nodes.  Extra columns are ignored.  One conversation's turns are
    ordered within a task, being one training example; turns shared by many
    conversations are met only by aggregates with a partial step.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    hashed = turns.withColumn("own", F.substring(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256), 1, OWN))
    so_far = F.collect_list("own").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    node = lambda key: F.substring(F.sha2(key, 256), 1, 32)
    path = stage(
        hashed.withColumn("step", F.row_number().over(in_order) - 1)
        .withColumn("key", F.array_join(so_far, ""))
        .select(
            F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "conv_id", "step", "role", "text", "key", F.length(render(F.col("role"), F.col("text"))).cast("long").alias("n_tokens"),
            node(F.col("key")).alias("node_id"), F.when(F.col("step") > 0, node(F.expr(f"left(key, length(key) - {OWN})"))).alias("parent_id"),
        ),
        "chat-path",
    )
    # From here on texts stay behind until the end; all rows of a node agree, and one of its conversations owns it.
    distinct = stage(path.groupBy("node_id").agg(*[F.first(c).alias(c) for c in ("parent_id", "key", "n_tokens")], F.min(F.struct("none", "conv")).alias("owner")), "chat-nodes")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(distinct.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "chat-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    placed = stage(ranged.join(F.broadcast(bases), "part").select("node_id", "parent_id", "owner", "n_tokens", start.alias("token_start")), "chat-placed")  # one base for each range partition
    # The ancestors of a node are the same for every conversation through it: read them off its owner.
    above = Window.partitionBy("none", "conv").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    empty = F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)")
    joined_up = F.aggregate(
        F.coalesce(F.collect_list("span").over(above), empty),
        empty,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] == s["begin"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), s["end"].alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    span = F.struct(F.col("token_start").alias("begin"), (F.col("token_start") + F.col("n_tokens")).alias("end"))
    owned = (F.col("owner.none") == F.col("none")) & (F.col("owner.conv") == F.col("conv"))
    lists = path.select("none", "conv", "step", "node_id").join(placed.withColumn("span", span), "node_id").withColumn("ancestors", joined_up).where(owned).drop("span", "owner")
    placed = lists.join(path.select("none", "conv", "step", "role", "text"), ["none", "conv", "step"]).withColumn("formatted", render(F.col("role"), F.col("text")))
    span_tokens = F.aggregate("ancestors", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    text_at = F.instr("formatted", TEXT) + len(TEXT) - 1
    trained = F.col("role") == trained_role
    nodes = placed.select(
        "node_id", "parent_id", F.col("step").alias("depth"), "role", "formatted", "token_start", "n_tokens",
        span_tokens.alias("position_start"), "ancestors",
        F.when(trained, text_at).otherwise(F.lit(0)).cast("long").alias("loss_begin"),
        F.when(trained, F.length("formatted") - len(END)).otherwise(F.lit(0)).cast("long").alias("loss_end"),
    )
    return nodes, path.select("conv_id", "step", "node_id")


def read_back(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Digest of each conversation as the packed tree gives it back: its nodes in the order of their position ids.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn),
    loss_chars and loss_sha256 (the unescaped text under the loss mask), formatted_chars.
    """
    role, text = parse(F.col("formatted"))
    loss = unescape(F.expr("substring(formatted, cast(loss_begin + 1 as int), cast(loss_end - loss_begin as int))"))
    read = nodes.select("node_id", "position_start", "n_tokens", role.alias("r"), text.alias("t"), loss.alias("loss"))
    turn = F.struct("position_start", F.concat("r", F.lit("\n"), "t", F.lit("\n")).alias("said"), "loss", "n_tokens")
    whole = steps.join(read, "node_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    said, trained = F.array_join("turns.said", ""), F.array_join("turns.loss", "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        (F.element_at("turns", -1)["position_start"] + F.element_at("turns", -1)["n_tokens"]).alias("formatted_chars"),
    )
