"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Each bin starts with the longest remaining piece; a bitset subset-sum dynamic program over the lengths still
available finds the fullest feasible combination for it, which is then removed.  Only how many pieces there
are of each length matters for that, so it runs on a histogram of at most ``capacity`` counts, and a found
combination is applied as often as the counts allow: the number of different combinations depends on the
capacity, not on the number of pieces.  Pieces are then numbered within their length by Spark and take the
places that the combinations hold for that length.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, saved, text_of, trimmed
from .tokens import Encoder

CAPACITY = 1024
END_ID = 2
_END = END_ID.to_bytes(4, "little")


def fullest(available: list[tuple[int, int]], slack: int) -> dict[int, int]:
    """The combination of (length, count) items, lengths ascending, with the largest sum up to ``slack``;
    of several, the one that takes the longest pieces first."""
    mask = (1 << (slack + 1)) - 1
    layers = [1]
    for length, count in available:
        reach, left, step = layers[-1], min(count, slack // length), 1
        while left:                                   # counts in binary parts: sums of any 0..count copies
            part = min(step, left)
            reach |= (reach << (part * length)) & mask
            left, step = left - part, step * 2
        layers.append(reach)
    target, taken = layers[-1].bit_length() - 1, {}
    for i in range(len(available) - 1, -1, -1):
        length, count = available[i]
        k = min(count, target // length)
        while not layers[i] >> (target - k * length) & 1:
            k -= 1
        if k:
            taken[length] = k
            target -= k * length
    return taken


def combinations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: pieces in each copy}) that use up the histogram."""
    left = {length: n for length, n in histogram.items() if n}
    out = []
    while left:
        anchor = max(left)
        rest = [(length, n - (length == anchor)) for length, n in sorted(left.items())
                if n > (length == anchor) and length <= capacity - anchor]
        bin_ = fullest(rest, capacity - anchor) if rest else {}
        bin_[anchor] = bin_.get(anchor, 0) + 1
        copies = min(left[length] // k for length, k in bin_.items())
        out.append((copies, bin_))
        for length, k in bin_.items():
            left[length] -= copies * k
            if not left[length]:
                del left[length]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and END_ID.  One that is longer than the capacity is cut into pieces of that length,
    of which the first may be shorter.  Null and empty texts are the single id END_ID.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.binary())][:5 + with_ids])

    def cut(batches):
        encode = Encoder(tokenizer).encode
        for part in (p for b in batches for p in rows_of([b])):
            out = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                ids += _END
                n = len(ids) // 4
                start, end = 0, n % capacity or capacity
                number = 0
                while start < n:
                    held = ids[4 * start:4 * end]
                    out.append((doc_id, number, start, end - start, zlib.crc32(held), held)[:5 + with_ids])
                    start, end, number = end, end + capacity, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(trimmed(cut), ddl)


def places(spark: SparkSession, histogram: dict[int, int], capacity: int = CAPACITY) -> DataFrame:
    """Where pieces of a length go: ranks from ``first`` to ``last`` (exclusive) lie ``each`` to a sequence,
    from ``sequence`` on, at ``offset`` in it.  Its size depends on the capacity alone."""
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for copies, bin_ in combinations(histogram, capacity):
        offset = 0
        for length, each in sorted(bin_.items(), reverse=True):
            first = used[length]
            used[length] += copies * each
            rows.append((length, first, used[length], each, sequence, offset))
            offset += length * each
        sequence += copies
    return spark.createDataFrame(rows, "length bigint, first bigint, last bigint, each bigint, sequence bigint, "
                                       "offset bigint")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row with a ``length`` of 1 to ``capacity`` a sequence_id (from 0) and an offset in it.

    Rows of equal length are interchangeable; which of them goes where follows their order in the checkpointed
    input.  Repeated rows are pieces of their own.  An empty input gives an empty result.
    """
    cut = saved(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The order in the checkpointed copy numbers the rows; a part of the copy bounds each window.
    marked = cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    ranked = marked.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_part").orderBy("_at")) - 1)
    counts = marked.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = ranked.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    table = F.broadcast(places(cut.sparkSession, histogram, capacity))
    here = (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last"))
    slot = F.col("_rank") - F.col("first")
    return (ranked.join(table, here)
            .select(*(ranked[c] for c in cut.columns),
                    (F.col("sequence") + F.floor(slot / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("offset") + slot % F.col("each") * ranked["length"]).cast("long").alias("offset")))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """:func:`pieces` of all documents, packed by :func:`pack`."""
    return pack(pieces(docs, tokenizer, capacity, with_ids), capacity)
