"""Reply trees as formatted conversations, in DataFrame operations only.

Nodes name their parent; a branch is a path from a root to a leaf. Paths are found by iterative self-joins that double
their reach: after ``k`` joins every node knows its ancestor ``2**k`` steps up, its depth and the summed score of the way.
A leaf at a root gives its whole branch a score, branches of a tree are ranked, and the ancestors of the chosen leaves
are marked by the same joins in reverse. So a chain of ``n`` turns takes ``2 log n`` joins of narrow rows, no path is
copied at every node, and texts meet only the nodes of chosen paths.

A turn is written ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. Inside texts and roles ``<|``
cannot stay as it is: a backslash is set behind the ``<`` of every ``<`` + backslashes + ``|``, and reading takes it away
again. Line feeds and backslashes of roles are written ``\\n`` and ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tagwright.operators.ranking import with_rank
from tagwright.storage import store

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # every backslash begins a pair, so one kind of pair can be taken back after the other
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["tree"].eqNullSafe(b["tree"]) & (a[left] == b[right])


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves ``(tree, node, depth, score)`` with the score of their branch, and the tables of ancestors ``2**k`` up.

    ``nodes``: ``tree``, ``node``, ``parent``, ``score``, ``(tree, node)`` unique. A parent that is null or not there makes
    its node a root. Nodes in or under a cycle reach no root and belong to no branch.
    """
    parents = nodes.select("tree", F.col("node").alias("parent")).alias("p")
    rows = nodes.alias("n").join(parents, _same(nodes, parents, "parent", "parent"), "left").select(
        "n.tree", "n.node", F.col("p.parent").alias("up"), F.lit(1).alias("depth"),
        F.coalesce(F.col("n.score"), F.lit(0.0)).cast("double").alias("score"))
    state = store(rows, "chat-up")
    ups = [state]
    limit = max(1, state.count()).bit_length() + 1  # more doublings than any path without a cycle needs
    while len(ups) <= limit and not state.where("up is not null").isEmpty():
        above = state.select(F.col("tree").alias("a_tree"), F.col("node").alias("a_node"), F.col("up").alias("a_up"),
                             F.col("depth").alias("a_depth"), F.col("score").alias("a_score"))
        climbing, there = state.where("up is not null"), state.where("up is null")
        joined = climbing.join(above, F.col("tree").eqNullSafe(F.col("a_tree")) & (F.col("up") == F.col("a_node"))).select(
            "tree", "node", F.col("a_up").alias("up"), (F.col("depth") + F.col("a_depth")).alias("depth"),
            (F.col("score") + F.col("a_score")).alias("score"))
        state = store(there.unionByName(joined), "chat-up")  # only nodes that have not reached a root are joined again
        ups.append(state)
    inner = ups[0].where("up is not null").select(F.col("tree").alias("i_tree"), F.col("up").alias("i_node")).distinct()
    leaves = state.join(inner, F.col("tree").eqNullSafe(F.col("i_tree")) & (F.col("node") == F.col("i_node")), "left_anti")
    return leaves.where("up is null").select("tree", "node", "depth", "score"), ups


def ranked_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """Nodes of the ``best`` branches of every tree: ``tree``, ``leaf``, ``branch`` (from 1), ``node``, ``depth``.

    Branches are ranked by score, then by length, both descending, then by leaf. Depth counts from 1 at the root.
    """
    leaves, ups = branches(nodes)
    ranked = with_rank(leaves, [F.col("tree"), F.desc("score"), F.desc("depth"), F.col("node")], "rank", 0)
    first = ranked.groupBy("tree").agg(F.min("rank").alias("first")).withColumnRenamed("tree", "f_tree")
    chosen = ranked.join(first, F.col("tree").eqNullSafe(F.col("f_tree"))).where(F.col("rank") - F.col("first") < best)
    marked = store(chosen.select("tree", F.col("node").alias("leaf"), (F.col("rank") - F.col("first") + 1).alias("branch"),
                                 "node", "depth"), "chat-path")
    for k in range(len(ups) - 1, -1, -1):
        up = ups[k].where("up is not null").select(
            F.col("tree").alias("u_tree"), F.col("node").alias("u_node"), F.col("up"))
        higher = marked.join(up, F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("node") == F.col("u_node"))).select(
            "tree", "leaf", "branch", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        marked = store(marked.unionByName(higher), "chat-path")
    return marked


def format_chats(nodes: DataFrame, best: int = 1) -> DataFrame:
    """``tree``, ``leaf``, ``branch``, ``n_turns``, ``formatted`` and ``loss_spans`` of the chosen branches.

    ``nodes``: ``tree``, ``node``, ``parent``, ``score``, ``role``, ``text``; null roles and texts count as empty, null
    scores as 0. Of rows that share tree and node one stays, the least by parent, score, role and text. Rows with a null
    node are left out, as nothing can name them. ``loss_spans`` are ``(start, length)`` in code points of ``formatted``, one per assistant
    text. An empty table gives no rows. Other columns are not looked at. A conversation is one row, so it has to fit in memory.
    """
    once = Win.partitionBy("tree", "node").orderBy("parent", "score", "role", "text")
    nodes = nodes.select("tree", "node", "parent", "score", "role", "text").where("node is not null")
    nodes = store(nodes.withColumn("once", F.row_number().over(once)).where("once = 1").drop("once"), "chat-nodes")
    paths = ranked_paths(nodes.select("tree", "node", "parent", "score"), best)
    texts = nodes.select(F.col("tree").alias("t_tree"), F.col("node").alias("t_node"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t_tree")) & (F.col("node") == F.col("t_node")))
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    piece = F.struct("depth", head.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss"))
    whole = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    tail = len(END) + 1
    ends = F.expr(f"transform(t, x -> length(x.head) + length(x.body) + {tail})")
    # running sums of the lengths: the sum so far is carried, the list of starts grows by one
    starts = F.expr("aggregate(lengths, struct(0L as at, cast(array() as array<bigint>) as out), "
                    "(s, x) -> struct(s.at + x as at, array_append(s.out, s.at) as out), s -> s.out)")
    formatted = F.array_join(F.expr(f"transform(t, x -> concat(x.head, x.body, '{END}\n'))"), "")
    spans = F.expr("transform(filter(arrays_zip(t, starts), x -> x.t.loss), "
                   "x -> struct(x.starts + length(x.t.head) as start, cast(length(x.t.body) as bigint) as length))")
    return (
        whole.withColumn("lengths", ends).withColumn("starts", starts)
        .select("tree", "leaf", "branch", F.size("t").cast("bigint").alias("n_turns"), formatted.alias("formatted"),
                spans.alias("loss_spans"))
    )


def turns_of(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts))

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        text = F.substring(part, line + 1, F.length(part) - line - (len(END) + 1))
        return F.struct(unescape_role(F.substring(part, F.lit(1), line - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of conversations that are plain sequences: every row's parent is the row before it.

    Rows of one conversation are ordered by turn, role and text; repeated rows stay. Null conversation ids form one
    conversation, null turns come first. Ranks come from a range-partitioned sort, so a long conversation is no hot key.
    """
    named = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ranked = with_rank(named, ["tree", "turn", "role", "text"], "node", 0)
    ranked = store(ranked, "chat-rows")
    before = ranked.select((F.col("node") + 1).alias("b_node"), F.col("tree").alias("b_tree"))
    same = (F.col("node") == F.col("b_node")) & F.col("tree").eqNullSafe(F.col("b_tree"))
    joined = ranked.join(before, same, "left")
    return joined.select("tree", "node", F.when(F.col("b_node").isNotNull(), F.col("node") - 1).alias("parent"),
                         F.lit(0.0).alias("score"), "role", "text")
