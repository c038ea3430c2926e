"""Prefix trie of conversations: what they share from their first turn on, counted per node.

Turns are dictionary-encoded: distinct (role, text) rows numbered in their order.  A conversation is then an array of
numbers; arrays are range-partitioned in lexicographic order (ties by conversation id), so equal and similar ones
are neighbours and a large group of copies may lie in several shards.  Each shard builds a ternary search tree of
its distinct arrays, inserted median first and then the medians of the halves, which keeps its branches balanced.
Nodes are numbered as they are made, parents before children, so one loop backwards over the numbers accumulates
members, leaves and savings without recursion.

Only the nodes on the paths of a shard's first and last array can also occur in another shard.  Those boundary nodes
leave a shard as one row of partial sums; one pass over these rows in shard order with a stack of the current path
merges them (two paths a shard, memory of one path).  The ids of conversations that end at a boundary node leave
as text pieces in order and are hashed as a stream, as a SHA-256 cannot be put together from parts.

Nulls: rows without conv_id belong to no conversation and are left out; a null role or text is empty, a null turn
sorts first.  Rows of equal turn are ordered by role, then text; repeated rows are turns of their own.  Other columns
are ignored, whatever their names.  An empty table has no nodes.

Bounds: a task holds one shard, about ``SHARD_TURNS`` turn numbers or one conversation's if that has more; texts are
never gathered.  Joins on turns and conversations slice hot keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import ordered
from ..operators.skew import hot_key_join
from .common import saved, written

#: Turns in a shard, about; there are at least as many shards as shuffle partitions.
SHARD_TURNS = 1_000_000
#: Conversation ids in one piece of a boundary node's list.
PIECE_IDS = 4096
#: Original conversations are taken in families of this many ids, of which the first lends its opening turns.
FAMILY, MOST_LENT = 5, 8


# -- conversations as arrays of turn numbers ----------------------------------------------------------------------

def encoded_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, idx, id, size): every turn in order from 0, its number and the UTF-8 bytes of its text."""
    said = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    distinct = said.groupBy("role", "text").agg(F.count(F.lit(1)).alias("n"))
    numbers = ordered.with_position(distinct, ["role", "text"], "id")
    coded = hot_key_join(said, numbers.drop("n"), ["role", "text"], spread=["conv_id", "turn"], counts=numbers)
    coded = coded.select("conv_id", "turn", "id", F.octet_length("text").cast("long").alias("size"))
    placed = ordered.with_position(coded, ["conv_id", F.col("turn").asc_nulls_first(), "id"], "_pos")
    starts = placed.groupBy("conv_id").agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("n"))
    return (hot_key_join(placed, starts, "conv_id", spread=["_pos"], counts=starts)
            .select("conv_id", (F.col("_pos") - F.col("_start")).alias("idx"), "id", "size"))


def with_lent_openings(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): conversation c is the first h turns of c - c%5 and its own turns after its first h,
    h = crc32(c) % 9; one row per conversation, also where nothing is left."""
    turns = written(turns, "encoded-turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_LENT + 1)
    convs = turns.select("conv_id").distinct()
    lender = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("idx") < MOST_LENT))
    near = F.sequence(F.col("conv_id") - (FAMILY - 1), F.col("conv_id") + (FAMILY - 1))
    lent = (lender.withColumn("_to", F.explode(near)).filter(F.col("_to") - F.col("_to") % FAMILY == F.col("conv_id"))
            .select(F.col("_to").alias("conv_id"), "idx", "id", "size").filter(F.col("idx") < h)
            .join(convs, "conv_id", "left_semi"))
    parts = [lent.withColumn("part", F.lit(0)), turns.filter(F.col("idx") >= h).withColumn("part", F.lit(1)),
             convs.select("conv_id", *(F.lit(None).cast("long").alias(c) for c in ("idx", "id", "size"))).withColumn("part", F.lit(2))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    item = F.when(F.col("part") < 2, F.struct("part", "idx", "id", "size"))
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("_all"))
            .select("conv_id", F.col("_all.id").alias("seq"), F.col("_all.size").alias("sizes")))


# -- one shard ------------------------------------------------------------------------------------------------

class TernaryTree:
    """Arrays of numbers by their prefixes.  Node 0 is the empty prefix; ``eq`` leads to the tree of a node's
    children, ``lo`` and ``hi`` to siblings with smaller and larger numbers."""

    def __init__(self):
        self.sym, self.lo, self.eq, self.hi = [-1], [0], [0], [0]
        self.parent, self.depth, self.size = [0], [0], [0]
        self.members, self.first = [0], [None]

    def _new(self, symbol: int, parent: int, size: int) -> int:
        for column, value in ((self.sym, symbol), (self.lo, 0), (self.eq, 0), (self.hi, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.size, size), (self.members, 0), (self.first, None)):
            column.append(value)
        return len(self.sym) - 1

    def insert(self, seq: list[int], sizes: list[int], members: int, first: int) -> list[int]:
        """The path of an array, node 0 first; ``members`` conversations have it, the smallest is ``first``."""
        path, sym = [0], self.sym
        for symbol, size in zip(seq, sizes):
            at = path[-1]
            links, node = self.eq, self.eq[at]
            while node and sym[node] != symbol:
                links, at = (self.lo, node) if symbol < sym[node] else (self.hi, node)
                node = links[at]
            if not node:
                node = links[at] = self._new(symbol, path[-1], size)
            path.append(node)
        for node in path:
            self.members[node] += members
            if self.first[node] is None or first < self.first[node]:
                self.first[node] = first
        return path


def median_order(n: int) -> Iterator[int]:
    """0..n-1 with the middle first, then the middles of what lies before and after it."""
    spans = [(0, n)]
    while spans:
        start, end = spans.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            spans += [(start, middle), (middle + 1, end)]


def shard_rows(shard: int, groups: list[tuple]) -> Iterator[dict]:
    """What one shard gives: a row per complete node, one row of boundary paths, the pieces of boundary ids.
    ``groups``: (seq, sizes, conversation ids ascending) of the distinct arrays in order."""
    tree, paths = TernaryTree(), {}
    for i in median_order(len(groups)):
        seq, sizes, ids = groups[i]
        paths[i] = tree.insert(seq, sizes, len(ids), ids[0])
    side = {node: 0 for node in paths[0]}
    for node in paths[len(groups) - 1]:
        side.setdefault(node, 1)
    ends = {paths[i][-1]: i for i in range(len(groups))}
    n = len(tree.sym)
    children, leaves, saving = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, 0, -1):
        if node in side:
            continue
        leaves[node] += children[node] == 0
        saving[node] += (tree.members[node] - 1) * tree.size[node]
        up = tree.parent[node]
        children[up] += 1
        leaves[up] += leaves[node]
        saving[up] += saving[node]
        text = ",".join(map(str, groups[ends[node]][2])) if node in ends else ""
        yield {"kind": "node", "shard": shard, "conv_id": tree.first[node], "depth": tree.depth[node],
               "parent_conv_id": None if up in side else tree.first[up], "side": side.get(up), "n_convs": tree.members[node],
               "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saving[node],
               "ends_sha256": hashlib.sha256(text.encode()).hexdigest()}
    walks = []
    for which, path in ((0, paths[0]), (1, paths[len(groups) - 1])):
        own = [side[node] == which for node in path]
        if which and len(groups) == 1:
            continue
        walks.append({"side": which, "shared": own.count(False), "steps": [
            {"sym": tree.sym[v], "size": tree.size[v], "members": tree.members[v] * mine, "first": tree.first[v],
             "children": children[v] * mine, "leaves": leaves[v] * mine, "saving": saving[v] * mine}
            for v, mine in zip(path, own)]})
    yield {"kind": "paths", "shard": shard, "walks": walks}
    for node in side:
        if node in ends:
            ids = groups[ends[node]][2]
            for no, start in enumerate(range(0, len(ids), PIECE_IDS)):
                yield {"kind": "piece", "shard": shard, "side": side[node], "depth": tree.depth[node], "no": no,
                       "text": ",".join(map(str, ids[start:start + PIECE_IDS]))}


_STEP = "array<struct<sym:bigint,size:bigint,members:bigint,first:bigint,children:bigint,leaves:bigint,saving:bigint>>"
_SHARD = ("kind string, shard int, conv_id bigint, depth bigint, parent_conv_id bigint, side int, n_convs bigint, "
          "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, no int, text string, "
          f"walks array<struct<side:int,shared:int,steps:{_STEP}>>")
_MERGED = ("kind string, number bigint, up bigint, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, "
           "n_leaves bigint, saved_tokens bigint, shard int, side int")


def map_rows(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` over the rows of each partition, in order; both sides move in record batches of bounded length."""
    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        held = []
        for row in work(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            if len(held) >= 2048:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return df.mapInArrow(run, schema)


def _shards(rows: Iterator[dict]) -> Iterator[dict]:
    """All rows of one shard, in order, to :func:`shard_rows`."""
    groups, shard = [], 0
    for row in rows:
        shard = row["shard"]
        if groups and groups[-1][0] == row["seq"]:
            groups[-1][2].append(row["conv_id"])
        else:
            groups.append((row["seq"], row["sizes"], [row["conv_id"]]))
    if groups:
        yield from shard_rows(shard, groups)


# -- boundary nodes -----------------------------------------------------------------------------------------------

def merged_rows(shards: Iterator[dict]) -> Iterator[dict]:
    """Boundary nodes of all shards, in order of shard: partial sums of equal paths added on a stack.  Also where
    each node lies in each shard (kind ``place``)."""
    stack, made = [], 0

    def close():
        node = stack.pop()
        node["leaves"] += node["children"] == 0
        node["saving"] += (node["members"] - 1) * node["size"]
        if stack:
            stack[-1]["leaves"] += node["leaves"]
            stack[-1]["saving"] += node["saving"]
        return {"kind": "node", "number": node["number"], "up": stack[-1]["number"] if stack else None,
                "conv_id": node["first"], "depth": len(stack), "n_convs": node["members"],
                "n_children": node["children"], "n_leaves": node["leaves"], "saved_tokens": node["saving"]}

    for row in shards:
        for walk in row["walks"]:
            steps = walk["steps"]
            same = 0
            while same < min(len(stack), len(steps)) and stack[same]["sym"] == steps[same]["sym"]:
                same += 1
            while len(stack) > same:
                yield close()
            for depth, step in enumerate(steps):
                if depth < same:
                    node = stack[depth]
                    for name in ("members", "children", "leaves", "saving"):
                        node[name] += step[name]
                    node["first"] = min(node["first"], step["first"])
                else:
                    if stack:
                        stack[-1]["children"] += 1
                    stack.append(dict(step, number=made))
                    made += 1
                if depth >= walk["shared"]:
                    yield {"kind": "place", "number": stack[depth]["number"], "depth": depth,
                           "shard": row["shard"], "side": walk["side"]}
    while stack:
        yield close()


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """One SHA-256 per node from its pieces in order, as a stream."""
    number, digest = None, None
    for row in rows:
        if digest is None or row["number"] != number:
            if digest is not None:
                yield {"number": number, "ends_sha256": digest.hexdigest()}
            number, digest = row["number"], hashlib.sha256()
        else:
            digest.update(b",")
        digest.update(row["text"].encode())
    if digest is not None:
        yield {"number": number, "ends_sha256": digest.hexdigest()}


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node (``COLUMNS``) from (conv_id, seq, sizes): turn numbers and the bytes each turn would save."""
    spark = sequences.sparkSession
    sequences = written(sequences, "sequences")
    turns = sequences.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    ranged = saved(sequences.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
                   .withColumn("shard", F.spark_partition_id()))
    found = written(map_rows(ranged, _shards, _SHARD), "trie-shards")

    paths = found.filter("kind = 'paths'").select("shard", "walks").repartition(1).sortWithinPartitions("shard")
    merged = written(map_rows(paths, merged_rows, _MERGED), "trie-boundary")
    nodes = merged.filter("kind = 'node'").drop("kind", "shard", "side")
    places = merged.filter("kind = 'place'").select("shard", "side", "depth", "number")

    pieces = found.filter("kind = 'piece'").select("shard", "side", "depth", "no", "text").join(places, ["shard", "side", "depth"])
    ends = map_rows(pieces.repartition("number").sortWithinPartitions("number", "shard", "no"), _digests,
                    "number bigint, ends_sha256 string")
    above = nodes.select(F.col("number").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    boundary = (nodes.join(above, "up", "left").join(ends, "number", "left")
                .withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(*COLUMNS))

    complete = found.filter("kind = 'node'")
    inner = complete.filter("side IS NULL").select(*COLUMNS)
    tops = places.join(nodes.select("number", F.col("conv_id").alias("_up")), "number").select(
        "shard", "side", (F.col("depth") + 1).alias("depth"), "_up")
    outer = (complete.filter("side IS NOT NULL").join(tops, ["shard", "side", "depth"])
             .withColumn("parent_conv_id", F.col("_up")).select(*COLUMNS))
    return inner.unionByName(outer).unionByName(boundary)
