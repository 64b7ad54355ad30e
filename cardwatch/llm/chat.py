"""Chat formatting: reply trees to conversations, with a mask of what is learnt."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cardwatch.llm.shared import stage

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: What control strings begin with, behind any number of earlier escapes.
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

FORMATTED = pa.struct(
    [
        ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
FORMATTED_DDL = (
    "struct<formatted: string, loss_spans: array<struct<start: bigint, end: bigint>>>"
)


def escape(text: str) -> str:
    """One backslash more in each `<|`, `<\\|`, ..., so no `<|` is left."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turns(turns: list[tuple[str, str]], learnt: str) -> dict:
    """The conversation, and the code points of the texts whose role is `learnt`."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learnt:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return {"formatted": "".join(parts), "loss_spans": spans}


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that `format_turns` was given."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def reply_paths(
    messages: DataFrame,
    *,
    tree_col: str = "tree_id",
    id_col: str = "message_id",
    parent_col: str = "parent_id",
    score_col: str | None = None,
    paths: int | None = 1,
) -> DataFrame:
    """(tree, leaf, rank, node, turn) for the `paths` best paths of each tree, or all.

    A path runs from a root to a leaf. Paths of a tree are ranked by the sum of their
    messages' scores, best first, then by leaf. A message whose parent is null or not in
    its tree is a root. Messages on or below a circle of parents are on no path.

    Ancestors at distance 1, 2, 4, ... come from joining the table of the last distance
    with itself, so the number of joins grows with the logarithm of the depth. Paths are
    chosen by their scores before any of them is listed; a listed path takes one join for
    each of the distances, and each of its messages is met once.
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    nodes = messages.select(
        F.col(tree_col).alias("tree"),
        F.col(id_col).alias("node"),
        F.col(parent_col).alias("up"),
        score.alias("score"),
    )
    nodes = stage(nodes, "messages")
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("known"))
    nodes = nodes.join(known, ["tree", "up"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), "score"
    )
    nodes = stage(nodes, "ancestors")
    limit = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # Messages whose root is reached leave the rounds with the score of their whole path.
    live, finished = nodes.filter("up is not null"), nodes.filter("up is null")
    parents = live.select("tree", F.col("up").alias("node"))
    levels = [live]
    while 2 ** (len(levels) - 1) <= limit and not live.isEmpty():
        beyond = live.union(finished).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("score").alias("more")
        )
        jumped = live.join(beyond, ["tree", "up"]).select(
            "tree", "node", F.col("far").alias("up"), (F.col("score") + F.col("more")).alias("score")
        )
        jumped = stage(jumped, "ancestors")
        live = jumped.filter("up is not null")
        finished = finished.union(jumped.filter("up is null"))
        levels.append(live)
    leaves = finished.join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    ranked = leaves.select(
        "tree", F.col("node").alias("leaf"), F.row_number().over(order).alias("rank"), "node"
    )
    if paths is not None:
        ranked = ranked.filter(F.col("rank") <= paths)
    listed = stage(ranked.withColumn("distance", F.lit(0)), "paths")
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].select("tree", "node", "up")
        above = listed.join(step, ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("distance") + 2**k).alias("distance")
        )
        # Read twice in the next round, so written: else plans double with each round.
        listed = stage(listed.select("tree", "leaf", "rank", "node", "distance").union(above), "paths")
    depth = listed.groupBy("tree", "leaf").agg(F.max("distance").alias("depth"))
    return listed.join(depth, ["tree", "leaf"]).select(
        "tree", "leaf", "rank", "node", (F.col("depth") - F.col("distance")).alias("turn")
    )


def format_conversations(
    messages: DataFrame,
    *,
    tree_col: str = "tree_id",
    id_col: str = "message_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = None,
    paths: int | None = 1,
    learnt: str = "assistant",
) -> DataFrame:
    """One row per chosen path: tree_col, leaf, rank, n_turns, formatted, loss_spans.

    loss_spans are code points of `formatted` that hold texts of the role `learnt`.
    Control strings in roles and texts are escaped; `parse_turns` gives them back.

    Null role or text: empty. Null tree: a tree of its own. Null scores: 0. Rows with a
    null message id are left out of trees, as nothing can reply to them or be told apart
    by them: give ids first (`numbered_turns`). Of rows that repeat a tree and id, the
    smallest by (parent, role, text) is the message. Empty table: no rows. A very long
    conversation is one row, as its format asks. Other columns aren't read.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("null"))
    rows = messages.filter(F.col(id_col).isNotNull()).select(
        tree.alias("tree"),
        F.col(tree_col).alias("_tree"),
        F.col(id_col).alias("node"),
        F.col(parent_col).alias("_parent"),
        (F.col(score_col) if score_col else F.lit(None).cast("double")).alias("_score"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.groupBy("tree", "node").agg(
        F.min(F.struct("_parent", "role", "text", "_score", "_tree")).alias("m")
    )
    rows = stage(rows.select("tree", "node", "m.*"), "messages")
    listed = reply_paths(
        rows,
        tree_col="tree",
        id_col="node",
        parent_col="_parent",
        score_col="_score",
        paths=paths,
    )
    turns = listed.join(rows, ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.first("_tree").alias(tree_col),
        F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"),
    )

    @F.arrow_udf(FORMATTED_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (
                format_turns([(t["role"], t["text"]) for t in turns.as_py()], learnt)
                for turns in batch
            )
            yield pa.array(list(found), FORMATTED)

    return turns.select(
        tree_col,
        "leaf",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        run("turns").alias("f"),
    ).select(tree_col, "leaf", "rank", "n_turns", "f.*")


def numbered_turns(
    rows: DataFrame,
    *,
    tree_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Linear conversations as trees: message_id counts up, and replies to the one before.

    Rows of a conversation are in order of (turn, nulls first; role; text), so rows that
    tie or repeat are messages of their own.
    """
    order = Window.partitionBy(tree_col).orderBy(turn_col, role_col, text_col)
    number = F.row_number().over(order).cast("long")
    return rows.select(
        tree_col, role_col, text_col, number.alias("message_id")
    ).withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
