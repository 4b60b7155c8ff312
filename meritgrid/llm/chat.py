"""Chat formatting from reply trees, with DataFrame operations only.

Messages form trees by their parent. Self-joins that double the distance each round reach the root
of every message; leaves are ranked by the score of their branch; the chosen branches are walked
down again with the same tables, and every chosen path is formatted as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meritgrid.llm.common import stored

TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
LEARNED_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    """Hide the template's control strings; every backslash left is followed by b, h or l."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("###"), F.lit("\\h\\h\\h"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\l/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\c"), F.lit(":"))
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    text = F.replace(text, F.lit("\\h"), F.lit("#"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _hops(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ancestors 1, 2, 4, ... steps up, and each node's depth and branch score.

    Self-joins go on until no node has an ancestor left to jump to. Nodes on a cycle, or below one,
    never get there; they are told by their distance, which outgrows the largest tree.
    """
    up = nodes.alias("n").join(
        nodes.select("tree", "node").alias("p"),
        (F.col("n.tree").eqNullSafe(F.col("p.tree"))) & (F.col("n.parent") == F.col("p.node")),
        "left",
    )
    state = stored(
        up.select(
            F.col("n.tree").alias("tree"),
            F.col("n.node").alias("node"),
            F.col("p.node").alias("jump"),
            F.when(F.col("p.node").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
            F.col("n.score").alias("total"),
        ),
        "chat-hops",
    )
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    hops, reach = [], 1
    while reach <= largest and state.where(F.col("jump").isNotNull()).limit(1).count():
        moving = state.where(F.col("jump").isNotNull())
        hops.append(moving.select("tree", "node", "jump"))
        low, high = moving.alias("a"), state.alias("b")
        moved = low.join(
            high,
            (F.col("a.tree").eqNullSafe(F.col("b.tree"))) & (F.col("a.jump") == F.col("b.node")),
            "left",
        ).select(
            F.col("a.tree").alias("tree"),
            F.col("a.node").alias("node"),
            F.col("b.jump").alias("jump"),
            (F.col("a.depth") + F.coalesce(F.col("b.depth"), F.lit(0))).alias("depth"),
            (F.col("a.total") + F.coalesce(F.col("b.total"), F.lit(0.0))).alias("total"),
        )
        state = stored(moved.unionByName(state.where(F.col("jump").isNull())), "chat-hops")
        reach *= 2
    return hops, state.where(F.col("jump").isNull()).select("tree", "node", "depth", "total")


def choose_paths(nodes: DataFrame, paths: int | None = 1) -> DataFrame:
    """The nodes of the best ``paths`` root-to-leaf branches of each tree (all for None).

    ``nodes``: tree, node, parent, score. A node without a parent in its tree is a root. Branches
    are ranked by the sum of their scores, then by length, then by leaf. Returns tree, path, node,
    depth. Nodes that a cycle keeps from any root belong to no path.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    hops, reached = _hops(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node")).distinct().alias("q")
    leaves = reached.alias("r").join(
        parents,
        (F.col("r.tree").eqNullSafe(F.col("q.tree"))) & (F.col("r.node") == F.col("q.node")),
        "left_anti",
    )
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    ranked = leaves.withColumn("path", F.row_number().over(order))
    if paths is not None:
        ranked = ranked.where(F.col("path") <= paths)
    chosen = ranked.select("tree", "path", "node")
    for hop in hops:
        c, h = chosen.alias("c"), hop.alias("h")
        above = c.join(
            h, (F.col("c.tree").eqNullSafe(F.col("h.tree"))) & (F.col("c.node") == F.col("h.node"))
        ).select("c.tree", "c.path", F.col("h.jump").alias("node"))
        chosen = stored(chosen.unionByName(above), "chat-path")
    c, r = chosen.alias("c"), reached.alias("r")
    return c.join(
        r, (F.col("c.tree").eqNullSafe(F.col("r.tree"))) & (F.col("c.node") == F.col("r.node"))
    ).select("c.tree", "c.path", "c.node", "r.depth")


def format_trees(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """One formatted conversation for each chosen path of each reply tree.

    ``messages``: tree, node, parent, score, role, text; node ids are unique in a tree. Null role
    and text count as empty, a null score as 0, a null tree is a tree of its own. Returns tree,
    path, formatted and loss_spans (start from 1 and length in code points of each assistant text,
    escaped as it stands in ``formatted``). The control strings inside texts and roles are escaped
    reversibly. An empty table gives no rows.
    """
    picked = choose_paths(messages, paths).alias("p")
    m = messages.alias("m")
    role = F.coalesce("m.role", F.lit(""))
    text = escape_text(F.coalesce("m.text", F.lit("")))
    head = F.concat(F.lit(TURN_START), escape_role(role), F.lit(ROLE_END))
    turns = picked.join(
        m, (F.col("p.tree").eqNullSafe(F.col("m.tree"))) & (F.col("p.node") == F.col("m.node"))
    ).select(
        "p.tree",
        "p.path",
        "p.depth",
        F.concat(head, text, F.lit(TURN_END)).alias("piece"),
        F.length(head).alias("text_at"),
        F.length(text).alias("text_size"),
        (role == LEARNED_ROLE).alias("learned"),
    )
    before = (
        Window.partitionBy("tree", "path")
        .orderBy("depth")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int")
    turns = turns.withColumn("at", start + F.col("text_at") + 1)
    lists = turns.groupBy("tree", "path").agg(
        F.sort_array(
            F.collect_list(F.struct("depth", "piece", "at", "text_size", "learned"))
        ).alias("turns")
    )
    return lists.select(
        "tree",
        "path",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["learned"]),
            lambda t: F.struct(t["at"].alias("start"), t["text_size"].alias("length")),
        ).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, TURN_END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        colon = F.locate(ROLE_END, piece)
        body = F.length(F.lit(TURN_START))
        return F.struct(
            unescape(F.substring(piece, body + 1, colon - body - 1)).alias("role"),
            unescape(F.substring(piece, colon + 2, F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), ""
    )


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text as reply trees without branches, each turn below the last.

    Rows of a conversation are ordered by turn (nulls first), then role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order).cast("long")
    return rows.select(
        F.col("conv_id").alias("tree"),
        place.alias("node"),
        (place - 1).alias("parent"),
        F.lit(1.0).alias("score"),
        "role",
        "text",
    )
