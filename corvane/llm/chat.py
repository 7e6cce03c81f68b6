"""Reply trees to conversations, with DataFrame operations only.

A tree's rows are nodes with a parent. Paths from leaf to root come from
iterative self-joins with doubling: after k joins a link leads 2^k levels up, and
a path's rows are picked up from the longest links to the shortest, so that a
tree of depth d takes 2 log2(d) joins whatever the number of nodes. Branches of
a tree are ranked by the sum of their nodes' scores (null counts as 0), the
higher first, then by the smaller leaf. Each chosen path is one conversation.

The template marks a turn as <|im_start|>role LF text <|im_end|> LF. Inside
roles and texts every "<", backslashes (none or more) and "|" in a row get one
backslash more, so that "<|" occurs in marks alone; a line end in a role then
becomes "<|n". Reading back undoes both and is exact.

Defined cases: null texts and roles count as empty; a node whose parent doesn't
exist is a root; a node without an id has no children; nodes on a cycle, and
what hangs on one, are on no path to a root and give no conversation. Rows with
a null tree id form one tree. Node ids are unique in a tree: of rows that
repeat one, only the smallest by (role, text) is used. Branches that tie in score
go by the smaller leaf. Very long texts are formatted whole. An empty table gives
no rows. Other columns aren't read, so that their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n"), F.lit("\n")))


def same(*names: str) -> Column:
    """x and y agree in these columns, nulls included."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    return out


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up_levels) of every root-to-leaf path of nodes(tree, node, parent)."""
    known = nodes.where("node is not null").select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    x, y = nodes.select("tree", "node", "parent").alias("x"), known.alias("y")
    rooted = x.join(y, same("tree") & (F.col("x.parent") == F.col("y.parent")), "left")
    linked = materialize(rooted.select("x.tree", "x.node", F.when(F.col("known"), F.col("x.parent")).alias("up")), "nodes")
    jumps = [linked.where("up is not null and node is not null").select("tree", "node", "up")]
    depth_limit = linked.count()
    while 2 ** len(jumps) <= 2 * depth_limit:
        x, y = jumps[-1].alias("x"), jumps[-1].alias("y")
        further = x.join(y, same("tree") & (F.col("x.up") == F.col("y.node"))).select("x.tree", "x.node", "y.up")
        further = materialize(further, f"jump{len(jumps)}")
        if further.isEmpty():
            break
        jumps.append(further)
    start = linked
    if 2 ** (len(jumps) - 1) >= depth_limit > 0:  # only links along a cycle are as long as that
        x, y = linked.alias("x"), jumps.pop().alias("y")
        start = x.join(y, same("tree") & (F.col("x.node") == F.col("y.node")), "left_anti")
    x, y = start.alias("x"), linked.select("tree", F.col("up").alias("node")).where("node is not null").distinct().alias("y")
    on_path = x.join(y, same("tree") & (F.col("x.node") == F.col("y.node")), "left_anti")
    on_path = on_path.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_levels"))
    for k in range(len(jumps) - 1, -1, -1):
        x, y = on_path.alias("x"), jumps[k].alias("y")
        here = F.struct(F.col("x.node").alias("node"), F.col("x.up_levels").alias("up_levels"))
        there = F.struct(F.col("y.up").alias("node"), (F.col("x.up_levels") + 2**k).alias("up_levels"))
        both = F.when(F.col("y.up").isNull(), F.array(here)).otherwise(F.array(here, there))
        on_path = x.join(y, same("tree") & (F.col("x.node") == F.col("y.node")), "left").select("x.tree", "x.leaf", F.inline(both))
    return on_path


def conversations(nodes: DataFrame, top_k: int | None = None) -> DataFrame:
    """Format the top_k branches (all if None) of each tree of nodes(tree, node, parent, role, text, score).

    Returns (tree, leaf, rank, score, formatted, loss): loss has the place
    (start from 0, and length, in code points of formatted) of each escaped
    assistant text.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    repeat = F.when(F.col("node").isNotNull(), F.row_number().over(Window.partitionBy("tree", "node").orderBy("role", "text", "parent", "score"))).otherwise(F.lit(1))
    nodes = nodes.withColumn("repeat", repeat).where("repeat = 1").drop("repeat")
    lone = nodes.where("node is null").select("tree", F.lit(None).cast(nodes.schema["node"].dataType).alias("leaf"), "role", "text", "score", F.lit(0).cast("long").alias("up_levels"), F.xxhash64("role", "text", F.monotonically_increasing_id()).alias("copy"))
    x, y = paths(nodes.where("node is not null")).alias("x"), nodes.where("node is not null").alias("y")
    turns = x.join(y, same("tree", "node")).select("x.tree", "x.leaf", "role", "text", "score", "up_levels", F.lit(0).cast("long").alias("copy")).unionByName(lone)
    branch = ["tree", "leaf", "copy"]
    if top_k is not None:
        turns = materialize(turns, "turns")
        totals = turns.groupBy(*branch).agg(F.sum("score").alias("total"))
        best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.asc("leaf"), F.asc("copy")))).where(F.col("rank") <= top_k)
        x, y = turns.alias("x"), best.alias("y")
        turns = x.join(y, same(*branch), "left_semi")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select(*branch, "up_levels", "score", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learned"))
    upward = Window.partitionBy(*branch).orderBy(F.desc("up_levels"))
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    whole = F.sort_array(F.collect_list(F.struct((-F.col("up_levels")).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"))))
    out = turns.groupBy(*branch).agg(
        F.sum("score").alias("score"),
        F.array_join(whole.getField("piece"), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), span))).alias("loss"),
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.asc("leaf"), F.asc("copy")))
    return out.select("tree", "leaf", rank.alias("rank"), "score", "formatted", "loss")


def turns_as_replies(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Nodes of linear conversations: each row answers the row before it by turn (null first, ties by role and text)."""
    picked = rows.select(rows[tree].alias("tree"), rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = picked.withColumn("node", node)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    split = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(split, F.lit(2), F.size(split))

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(piece, cut + 1, F.length(piece) - cut - len(END))).alias("text"),
        )

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
