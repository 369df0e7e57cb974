"""Reply trees to formatted conversations, with DataFrame and SQL functions only.

Messages name the message they reply to. Self-joins that double their reach find, for each
message, its root, its depth and the summed score of its path in as many rounds as the depth has
binary digits. The leaves of a tree are its branches; the best go on, and joins with the same
tables of ancestors, longest reach first, fill in each chosen path, which becomes one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import code_points, drop_table, let, materialize, piece, running

#: Twice as many messages in a chain with each round; a path longer than 2**40 is a cycle.
MAX_ROUNDS = 40

# A turn is <|role|>, a line feed, the text, </s> and a line feed. Control strings in a text get a
# backslash after their first character, and those that look like an escaped one get one more.
_CONTROL = r"(\||s>|/s>|INST\]|/INST\])"
END = "</s>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def _named(role: Column) -> Column:
    """A role without bars or line feeds, reversibly."""
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("|"), F.lit("\\p")), F.lit("\n"), F.lit("\\n"))


def _unnamed(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as reply trees with one branch each: tree, node, parent, role, text, score.

    Each row replies to the one before it; rows of one turn follow by role and text, null turns
    come first. Rows without a conversation form one conversation, the null one. Null roles and
    texts are empty; repeated rows stay.
    """
    clean = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # numbers stand for roles and texts while trees are walked; equal rows may change places
    node = F.row_number().over(W.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long")
    return clean.select("tree", node.alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Tables of each node's ancestor 1, 2, 4, ... replies up, each node's depth and path score, and what was written for that."""
    here = materialize(links.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("dist"), "score"), "jump")
    up_tables, ended, written = [], [here.where("up is null")], [here]
    for _ in range(MAX_ROUNDS):
        going = here.where("up is not null")
        up_tables.append(going.select("tree", "node", "up"))
        if going.isEmpty():
            up_tables.pop()
            return up_tables, _union([x.select("tree", "node", F.col("dist").alias("depth"), "score") for x in ended]), written
        a, b = going.alias("a"), here.alias("b")
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))
        # what b lacks ended in an earlier round, so its totals are looked up there
        done = _union(ended).select("tree", F.col("node").alias("n"), F.col("dist").alias("d"), F.col("score").alias("s")).alias("e")
        step = a.join(b.where("up is not null"), on, "left").select("a.tree", "a.node", "a.up", "a.dist", "a.score", F.col("b.up").alias("up2"), F.col("b.dist").alias("dist2"), F.col("b.score").alias("score2"))
        step = step.alias("a").join(done, F.col("a.tree").eqNullSafe(F.col("e.tree")) & (F.col("a.up") == F.col("e.n")), "left")
        here = materialize(
            step.select(
                "a.tree", "a.node", F.col("up2").alias("up"), (F.col("a.dist") + F.coalesce("dist2", "e.d")).alias("dist"), (F.col("a.score") + F.coalesce("score2", "e.s")).alias("score")
            ),
            "jump",
        )
        written.append(here)
        ended.append(here.where("up is null"))
    raise ValueError("replies form a cycle")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def chosen_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Columns tree, branch, depth, role, text: the messages of the best root-to-leaf paths.

    ``nodes`` has tree, node, parent, role, text, score; (tree, node) has no repeats. A null or
    unknown parent makes a root, so a tree may have several; a null score counts as 0; replies in
    a cycle raise ValueError. Branches rank by the sum of their messages' scores, then by length,
    longest first, then by leaf; ``branches`` of each tree are kept, all with None. A tree of one
    node is one branch; an empty table gives an empty result.
    """
    all_nodes = materialize(nodes.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "nodes")
    known = all_nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = all_nodes.select("tree", "node", "parent", "score").join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    links = materialize(linked.select("tree", "node", F.col("p").alias("parent"), "score"), "links")
    ups, depths, written = _jumps(links)
    replied = links.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = depths.join(replied, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node"))
    best = leaves.withColumn("branch", rank)
    if branches is not None:
        best = best.where(F.col("branch") <= branches)
    path = materialize(best.select("tree", "branch", "node", "depth"), "path")
    for k in reversed(range(len(ups))):
        up = ups[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = path.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        after = materialize(path.union(more), "path")
        drop_table(path)
        path = after
    for old in (links, *written):
        drop_table(old)
    words = all_nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return path.join(words, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", "depth", "role", "text")


def formatted(paths: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Columns tree, branch, n_turns, formatted, loss_mask: one conversation for each path.

    ``loss_mask`` has the spans (start, end; code points, end exclusive) of the texts of the roles
    in ``learn_from``, without their marks.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))), lambda m: F.struct(F.concat(F.lit("<|"), _named(m["role"]), F.lit("|>\n")).alias("head"), escaped(m["text"]).alias("body"), m["role"].isin(*learn_from).alias("learn")))
    rows = paths.groupBy("tree", "branch").agg(turns.alias("turns"))
    placed = running(F.col("turns"), F.lit(0), lambda m: F.length(m["head"]) + F.length(m["body"]) + len(END), lambda a, b: a + b)
    start = lambda x: x["before"] + F.length(x["item"]["head"])
    mask = F.transform(F.filter(placed, lambda x: x["item"]["learn"]), lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["item"]["body"])).alias("end")))
    text = F.array_join(F.transform("turns", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    return rows.select("tree", "branch", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), mask.alias("loss_mask"))


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation. Escaping leaves no mark inside a text, so marks can be cut at."""
    pieces = F.filter(F.split(text, END, -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(_unnamed(F.regexp_extract(p, r"^<\|([^|]*)\|>\n", 1)).alias("role"), unescaped(F.regexp_replace(p, r"^<\|[^|]*\|>\n", "")).alias("text")))


def under_mask(text: Column, mask: Column) -> Column:
    """The texts under the spans of a mask, unescaped, one string for each span."""
    return let(code_points(text), lambda points: F.transform(mask, lambda m: unescaped(piece(points, m["start"], m["end"]))))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as formatted conversations: ``conv``, n_turns, formatted, loss_mask. See :func:`chains`."""
    out = formatted(chosen_paths(chains(rows, conv, turn, role, text)))
    return out.select(F.col("tree").alias(conv), "n_turns", "formatted", "loss_mask")
