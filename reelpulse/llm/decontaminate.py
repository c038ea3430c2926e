"""Benchmark decontamination: passages of test items found in documents by an Aho-Corasick automaton.

Texts are normalised to their words, joined and framed by single spaces.  Patterns are the windows of
``window`` consecutive words of the test items (a shorter item is one window), framed likewise, so a match
starts and ends at word borders.  One pass over a normalised text reports every occurrence; offsets in the
normalised text are mapped to word numbers and, for documents that are hit, to code points of the original.

The test set is a stated query set.  It is read in blocks of at most ``block_chars`` normalised characters,
one automaton each, so a worker's memory does not grow with the number of items: a larger test set means more
passes over the documents, never a larger automaton.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, trimmed
from .words import word_spans, words

WINDOW = 10
BLOCK_CHARS = 400_000
_RANGES = "array<struct<start:bigint,end:bigint>>"


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """Framed windows of a test item, as Latin-1 views of the words' bytes."""
    found = words(text)
    return {(b" " + b" ".join(found[i:i + size]) + b" ").decode("latin-1")
            for i in range(max(1, len(found) - size + 1))} if found else set()


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """The test items, streamed in blocks of a bounded size: (item id, text)."""
    block, held = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    for item_id, text in items.toLocalIterator():
        size = len(text or "")
        if block and held + size > block_chars:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += size
    if block:
        yield block


def automaton(block: list[tuple[str, str]], size: int = WINDOW):
    """Automaton of a block whose values are (length in words, item ids)."""
    owners: dict[str, set[str]] = {}
    for item_id, text in block:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item_id)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(w, (w.count(" ") - 1, tuple(ids)))
    found.make_automaton()
    return found


def matches(found, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, hit word ranges merged and in order, ids of items with a window in the text)."""
    got = words(text)
    if found is None or not got:
        return len(got), [], set()
    line = " " + b" ".join(got).decode("latin-1") + " "
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    starts = None
    for end, (n, ids) in found.iter(line):
        if starts is None:                          # ends of words in the normalised text
            starts, at = [], 0
            for w in got:
                at += len(w) + 1
                starts.append(at)
        last = bisect.bisect_left(starts, end) + 1
        ranges.append((last - n, last))
        items.update(ids)
    return len(got), merged(ranges), items


def merged(ranges) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(block: list[tuple[str, str]], size: int, spans: bool, column: str):
    """A pass over record batches with one block's automaton; adds to hit_words and items, and on the last
    pass the spans.  ``column`` has the texts."""
    def run(batches):
        found = automaton(block, size)
        for batch in (part for b in batches for part in rows_of([b])):
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            n_words, hit, items, where = [], [], [], []
            for text, before, ids in zip(columns[column].to_pylist(), columns["_hit"].to_pylist(),
                                         columns["_items"].to_pylist()):
                n, ranges, owners = matches(found, text)
                ranges = merged([(r["start"], r["end"]) for r in before] + ranges) if before else ranges
                n_words.append(n)
                hit.append([{"start": a, "end": b} for a, b in ranges])
                items.append(sorted(owners.union(ids)))
                at = word_spans(text) if spans and ranges else []
                where.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges] if at else [])
            ranged = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns |= {"_n": pa.array(n_words, pa.int64()), "_hit": pa.array(hit, ranged),
                        "_items": pa.array(items, pa.list_(pa.string())), "_spans": pa.array(where, ranged)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: the columns of ``keep``, n_words, n_hit, items (ids of items with an occurring window,
    sorted as strings), spans (hit passages, code points in the original, end exclusive) and contaminated.

    Null and empty texts have no words.  Items without words have no window; a null item id counts as the
    empty string; repeated items count once.  Each row is judged by itself, so repeated rows, ties and an
    empty side need no rule: an empty test set leaves every document clean.
    """
    empty = F.array().cast(_RANGES)
    column = f"k_{text}" if text in keep else "_text"      # a kept text crosses to the workers and back once
    rows = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), *([] if text in keep else [F.col(text).alias("_text")]),
                       F.lit(0).cast("long").alias("_n"), empty.alias("_hit"),
                       F.array().cast("array<string>").alias("_items"), empty.alias("_spans"))
    found = list(blocks(benchmark, block_chars)) or [[]]
    for i, block in enumerate(found):
        rows = rows.mapInArrow(trimmed(_scan(block, window, i == len(found) - 1, column)), rows.schema)
    n_hit = F.aggregate("_hit", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return rows.select(*(F.col(f"k_{c}").alias(c) for c in keep), F.col("_n").alias("n_words"),
                       n_hit.alias("n_hit"), F.col("_items").alias("items"), F.col("_spans").alias("spans"),
                       (n_hit > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The registered columns: counts and the digest of the item ids."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
