"""Chat formatting over reply trees.

Messages form trees: each has a parent or is a root.  Every root-to-leaf path is a candidate conversation.
Self-joins that double the distance each round give every message its ancestors 1, 2, 4, ... steps up, and
then give every leaf all of its ancestors, so a path of n messages takes about log2(n) rounds.  Paths are
ranked by score and the chosen ones are formatted as one conversation each.

Everything is DataFrame functions; no Python runs on the executors.

Template of a turn: ``### <role>: <text></turn>`` and a line feed.  Inside texts and roles ``\\`` becomes
``\\b``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\t``; in roles ``:`` also becomes ``\\c``.  An
escaped text holds no control string, and a backslash in it always starts one of these codes, so
:func:`unescape` gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

HEAD, END = "### ", "</turn>\n"
#: In this order for escaping; unescaping goes backwards.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_CODES = (*CODES, (":", "\\c"))


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_replies(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each row replies to the one before it, rows by turn.

    Null turns come first; rows of equal turn are ordered by role, then text (nulls first).  All rows with
    a null conv_id form one conversation.  Repeated rows are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text")
            .withColumn("message_id", F.row_number().over(order).cast("long"))
            .select("conv_id", "message_id",
                    F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
                    "role", "text", F.lit(0.0).alias("score")))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth_up): every ancestor of every leaf, the leaf itself included.

    Needs ``tree`` (not null), ``message_id``, ``parent_id``; message ids are unique in a tree.  A parent
    that does not exist makes its child a root; a message on a cycle has no leaf and is on no path.
    """
    nodes = saved(messages.select("tree", F.col("message_id").alias("node"), F.col("parent_id").alias("up")))
    known = nodes.select("tree", F.col("node").alias("up"))
    # up: the ancestor 2^k steps above; only rows that have one.
    jump = saved(nodes.filter("up IS NOT NULL").join(known, ["tree", "up"], "left_semi"))
    leaves = nodes.select("tree", "node").join(jump.select("tree", F.col("up").alias("node")), ["tree", "node"],
                                               "left_anti")
    # A cycle never ends: more doublings than the message count allows mean that only cycles are left.
    most = max(1, jump.count()).bit_length()
    jumps = []
    while len(jumps) <= most and not jump.isEmpty():
        jumps.append(jump)
        higher = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("higher"))
        jump = saved(jump.join(higher, ["tree", "up"]).select("tree", "node", F.col("higher").alias("up")))
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth_up"))
    for k in reversed(range(len(jumps))):
        # Each row stays and adds the one 2^k steps above it, so the plan grows by one join a round.
        here = F.struct("node", "depth_up")
        above = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"),
                                                         (F.col("depth_up") + F.lit(1 << k)).alias("depth_up")))
        found = (found.join(jumps[k], ["tree", "node"], "left")
                 .select("tree", "leaf", F.explode(F.array_compact(F.array(here, above))).alias("at"))
                 .select("tree", "leaf", "at.node", "at.depth_up"))
    return found


def format_replies(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree, one formatted conversation per row.

    ``messages`` has conv_id (the tree; null is a tree of its own), message_id, parent_id, role, text and
    score (null counts as 0).  A path's score is the sum over its messages; ties go to the smaller leaf id.
    Null texts and roles are empty.  Returns conv_id, leaf_id, branch (from 1), score, n_turns, formatted
    and ``loss_turns``, the loss mask by turn: true for the assistant's, whose text between the turn's head
    and its end mark counts for the loss.
    """
    tree = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    rows = messages.select(tree.alias("tree"), "conv_id", "message_id", "parent_id",
                           F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                           F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    on_path = paths(rows).join(rows.withColumnRenamed("message_id", "node"), ["tree", "node"])
    turn = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_CODES), F.lit(": "), escape(F.col("text")), F.lit(END))
    whole = on_path.groupBy("tree", "leaf").agg(
        F.max("conv_id").alias("conv_id"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct((-F.col("depth_up")).alias("at"), turn.alias("turn"),
                                             (F.col("role") == "assistant").alias("loss")))).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
    return (whole.withColumn("branch", rank).filter(F.col("branch") <= branches)
            .select("conv_id", F.col("leaf").alias("leaf_id"), "branch", "score", "n_turns",
                    F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
                    F.transform("turns", lambda t: t["loss"]).alias("loss_turns")))


def read_back(formatted: Column, loss_turns: Column) -> tuple[Column, Column]:
    """(turns, loss text) parsed from a formatted conversation: an array of (role, text), and all text under
    the loss mask, unescaped and in order."""
    pieces = F.slice(F.split(formatted, END), 1, F.size(loss_turns))

    def parts(piece: Column, masked: Column) -> Column:
        body = F.substr(piece, F.lit(len(HEAD) + 1))
        role = F.substring_index(body, ": ", 1)
        return F.struct(unescape(role, ROLE_CODES).alias("role"),
                        unescape(F.substr(body, F.length(role) + F.lit(3))).alias("text"), masked.alias("loss"))

    turns = F.zip_with(pieces, loss_turns, parts)
    spoken = F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns, spoken


def digest(formatted: DataFrame) -> DataFrame:
    """What :func:`read_back` gives, as counts and SHA-256 digests per conversation."""
    turns, spoken = read_back(F.col("formatted"), F.col("loss_turns"))
    parsed = formatted.withColumn("turns", turns).withColumn("spoken", spoken)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                         F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                         F.length("spoken").cast("long").alias("loss_chars"),
                         F.sha2(F.col("spoken").cast("binary"), 256).alias("loss_sha256"),
                         F.length("formatted").cast("long").alias("formatted_chars"))
