"""Phrase collocations per language, from counts kept as sorted streams.

A word sequence of up to ``LONGEST`` words that occurs ``LEAST`` times has only parts that occur as often, so the
corpus is read once per step: words, then pairs of frequent words, then triples and quadruples of frequent pairs.
A task counts a bounded block of text by sorting word numbers and sends each distinct sequence once.  Which words and
pairs are frequent reaches the tasks as a bit filter of fixed size (``FILTER_BITS``): it may let a rare one pass, which
costs volume and is corrected by the exact counts, but never holds a frequent one back.

The frequent sequences then form two streams.  In prefix order (by first word, second word, ...) a sequence follows
all its beginnings, so one pass with a stack meets the left counts and the largest count of an extension to the right;
in suffix order (by last word, the one before, ...) likewise the right counts and the extensions to the left.  Both
passes run in lockstep over range-partitioned, sorted streams, without a hash table.  What lies across a partition's
start is at most ``LONGEST - 1`` sequences: their counts go in with the pass, and what they gain comes out as rows of
its own.  A longer candidate that holds a phrase implies one that extends it by one word and is at least as frequent,
so these extensions decide which phrases are dropped.

Scores are whole numbers, computed without rounding.  Null lang is ``und``, null text empty; repeated rows count each
time; other columns are ignored; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..operators.skew import hot_key_join
from .common import rows_of, saved, written
from .prefix_trie import map_rows
from .shingles import mix

LEAST, LONGEST, SCALE = 30, 4, 2_000_000
#: Percent of a phrase's count from which a longer one replaces it.
INSIDE = 80
#: Phrases reported per language.
TOP = 2000
#: Text of one language that a task counts at once.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
#: Size of the filters of frequent words and pairs; a larger corpus is faster with more.
FILTER_BITS = 1 << 26

_U = np.uint64
_COUNTS = "lang string, phrase string, n bigint"


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = 10
    table[9] = 32
    return bytes(table)


_TABLE = _byte_table()


class Block:
    """The words of joined texts: ``vocabulary`` ascending, ``ids`` in order of the text, ``joined`` where a word and
    the next are of one piece."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        ids, joined, held, size = [], [], [], 0
        # A few texts at a time, so that not all words are objects at once.
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text) + 1
            if i + 1 < len(texts) and size < CHUNK_BYTES:
                continue
            data = b"\n".join(held).translate(_TABLE) + b"\n"
            held, size = [], 0
            words = data.split()
            for w in set(words):
                number.setdefault(w, len(number))
            ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            raw = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero((raw[:-1] != 32) & (raw[:-1] != 10) & ((raw[1:] == 32) | (raw[1:] == 10)))
            piece = np.searchsorted(np.flatnonzero(raw == 10), ends)
            joined.append(np.append(piece[1:] == piece[:-1], False)[:len(words)])
        self.vocabulary = sorted(number)
        place = np.empty(len(number), np.int64)
        for i, w in enumerate(self.vocabulary):
            place[number[w]] = i
        self.ids = place[np.concatenate(ids)] if ids else np.empty(0, np.int64)
        self.joined = np.concatenate(joined)[:-1] if len(self.ids) else np.empty(0, bool)

    def hashes(self, lang: str) -> np.ndarray:
        """One hash per vocabulary word, of language and word."""
        seed = xxhash.xxh32_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary), _U, len(self.vocabulary))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(0x9E3779B97F4A7C15) + second)


class Filter:
    """A bit filter over hashes: two bits each."""

    def __init__(self, bits: int, slots: np.ndarray | None = None, masks: np.ndarray | None = None):
        self.words = np.zeros(bits // 64, _U)
        if slots is not None:
            self.words[slots] = masks

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([h & _U(bits - 1), (h >> _U(32)) & _U(bits - 1)])

    def passed(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, len(self.words) * 64)
        found = (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)
        return (found[:len(h)] & found[len(h):]).astype(bool)


# -- counts -------------------------------------------------------------------------------------------------------

def count_words(block: Block, lang: str) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """(numbers of the first words, of the second, ...; how often) of all distinct sequences of one length."""
    return [([np.arange(len(block.vocabulary))], np.bincount(block.ids, minlength=len(block.vocabulary)))]


def count_pairs(block: Block, lang: str, words: Filter):
    good = words.passed(mix(block.hashes(lang)))[block.ids]
    at = np.flatnonzero(block.joined & good[:-1] & good[1:])
    size = max(1, len(block.vocabulary))
    codes, n = np.unique(block.ids[at] * size + block.ids[at + 1], return_counts=True)
    return [([codes // size, codes % size], n)]


def count_longer(block: Block, lang: str, pairs: Filter):
    """Triples and quadruples all of whose pairs pass."""
    h = block.hashes(lang)[block.ids]
    good = block.joined.copy()
    good[good] = pairs.passed(_pair_hash(h[:-1][good], h[1:][good]))
    size = max(1, len(block.vocabulary))
    three = np.flatnonzero(good[:-1] & good[1:])
    pair = np.full(len(good), -1, np.int64)
    codes, pair[good] = np.unique(block.ids[:-1][good] * size + block.ids[1:][good], return_inverse=True)
    found, n = np.unique(pair[three] * size + block.ids[three + 2], return_counts=True)
    out = [([codes[found // size] // size, codes[found // size] % size, found % size], n)]
    four = three[:-1][np.diff(three) == 1]
    wide = max(1, len(codes))
    found, n = np.unique(pair[four] * wide + pair[four + 2], return_counts=True)
    a, b = codes[found // wide], codes[found % wide]
    return [*out, ([a // size, a % size, b // size, b % size], n)]


def _counted(docs: DataFrame, count: Callable, block_bytes: int) -> DataFrame:
    """(lang, phrase, n): what ``count`` finds, summed over all blocks of text."""

    def emit(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        block = Block(texts)
        if not len(block.ids):
            return
        vocabulary = pa.array(block.vocabulary, pa.string())
        for columns, n in count(block, lang):
            for start in range(0, len(n), 1 << 16):
                cut = slice(start, start + (1 << 16))
                parts = [vocabulary.take(pa.array(c[cut])) for c in columns]
                phrase = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase,
                                                  pa.array(n[cut].astype(np.int64))], names=["lang", "phrase", "n"])

    def run(batches):
        held, sizes = {}, {}
        for batch in rows_of(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text.encode())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
                # Several languages share the bound: the largest goes first.
                while sum(sizes.values()) >= block_bytes:
                    most = max(sizes, key=lambda k: (sizes[k], k))
                    sizes.pop(most)
                    yield from emit(most, held.pop(most))
        while held:
            lang, texts = held.popitem()
            yield from emit(lang, texts)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _filter(frequent: DataFrame, bits: int) -> Filter:
    """The filter of frequent words or pairs.  Its bits are combined by slot on the cluster; the driver gets at most
    ``bits / 64`` slots, however many phrases there are."""

    def run(batches):
        for batch in batches:
            seeds = {x: xxhash.xxh32_intdigest(x.encode()) for x in batch.column(0).unique().to_pylist()}
            parts = np.array([[xxhash.xxh64_intdigest(w, seeds[lang]) for w in phrase.encode().split(b" ")]
                              for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], _U)
            if not len(parts):
                continue
            h = mix(parts[:, 0]) if parts.shape[1] == 1 else _pair_hash(parts[:, 0], parts[:, 1])
            at = np.unique(Filter.places(h, bits))
            slots, start = np.unique(at >> _U(6), return_index=True)
            masks = np.bitwise_or.reduceat(_U(1) << (at & _U(63)), start)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(masks.view(np.int64))],
                                             names=["slot", "mask"])

    bits_of = frequent.select("lang", "phrase").mapInArrow(run, "slot bigint, mask bigint")
    table = bits_of.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    return Filter(bits, table.column("slot").to_numpy(), table.column("mask").to_numpy().view(_U))


def frequent_phrases(docs: DataFrame, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all sequences of 1 to ``LONGEST`` words that occur ``LEAST`` times; (lang, n) of all words)."""
    sc = docs.sparkSession.sparkContext
    words = written(_counted(docs, count_words, block_bytes), "words")
    frequent = words.filter(F.col("n") >= LEAST)
    held = sc.broadcast(_filter(frequent, filter_bits))
    pairs = written(_counted(docs, lambda b, lang: count_pairs(b, lang, held.value), block_bytes).filter(F.col("n") >= LEAST), "pairs")
    held_2 = sc.broadcast(_filter(pairs, filter_bits))
    longer = written(_counted(docs, lambda b, lang: count_longer(b, lang, held_2.value), block_bytes).filter(F.col("n") >= LEAST), "longer")
    for b in (held, held_2):
        b.destroy()
    return frequent.unionByName(pairs).unionByName(longer), words.groupBy("lang").agg(F.sum("n").alias("n"))


# -- lockstep passes over sorted streams --------------------------------------------------------------------------

class Open:
    """A sequence whose extensions may still follow; one of an earlier shard has no row."""

    def __init__(self, lang: str, words: list[str], row: dict | None = None, extension: int = 0):
        self.lang, self.words, self.row, self.extension = lang, words, row, extension


def lockstep(rows: Iterator[dict], opened: dict[int, list[tuple]]) -> Iterator[tuple[Open, list[int]]]:
    """Rows (shard, lang, words, n, later, extension) in order of lang and words, each once its extensions have
    passed, with the counts of its beginnings, shortest first.  A row ``later`` only adds to the extension of the row
    before it.  ``opened``: the beginnings of each shard's first row that lie in earlier shards, shortest first, with
    counts; these come too, with what they gained here."""
    stack, counts, fresh = [], [], True

    def close():
        counts.pop()
        return stack.pop(), counts[:]

    for row in rows:
        lang, words, before = row["lang"], row["words"], opened.get(row["shard"], ()) if fresh else ()
        for beginning, n in before:
            stack.append(Open(lang, beginning))
            counts.append(n)
        fresh = False
        while stack and (stack[-1].lang != lang or words[:len(stack[-1].words)] != stack[-1].words):
            yield close()
        if row["later"]:
            stack[-1].extension = max(stack[-1].extension, row["extension"])
            continue
        if stack:
            stack[-1].extension = max(stack[-1].extension, row["n"])
        stack.append(Open(lang, words, row, row["extension"]))
        counts.append(row["n"])
    while stack:
        yield close()


_STREAM = "shard int, lang string, words array<string>, n bigint, later boolean, extension bigint, lefts array<bigint>"


def _in_order(stream: DataFrame, counts: DataFrame) -> tuple[DataFrame, dict[int, list[tuple]]]:
    """The stream range-partitioned and sorted by (lang, words), and per shard the beginnings of its first row.
    The driver holds ``LONGEST - 1`` counts for each partition."""
    ranged = saved(stream.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words", "later")
                   .withColumn("shard", F.spark_partition_id()))
    first = ranged.groupBy("shard").agg(F.min(F.struct("lang", "words")).alias("at")).collect()
    wanted = [(r.shard, r.at.lang, list(r.at.words[:k])) for r in first for k in range(1, len(r.at.words))]
    if not wanted:
        return ranged, {}
    asked = ranged.sparkSession.createDataFrame(wanted, "at_shard int, lang string, words array<string>")
    found = counts.join(F.broadcast(asked), ["lang", "words"]).select("at_shard", "words", "n").collect()
    opened: dict[int, list[tuple]] = {}
    for r in sorted(found, key=lambda r: len(r.words)):
        opened.setdefault(r.at_shard, []).append((list(r.words), r.n))
    return ranged, opened


def _candidate(row: dict, rights: list[int], extension: int) -> dict:
    """The lowest-scoring cut of a phrase; ``rights``: counts of its last word, last two words, ..."""
    lefts, a = row["lefts"], row["n"]
    score, _, left, right = min((SCALE * a // (x + y), k, x, y)
                                for k, (x, y) in enumerate(zip(lefts, reversed(rights))))
    return {"later": False, "lang": row["lang"], "phrase": " ".join(reversed(row["words"])), "a": a, "l": left,
            "r": right, "score": score, "extension": extension}


def candidates(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, extension) of all phrases of 2 words or more, from the frequent sequences
    (lang, phrase, n): lowest-scoring cut, and the largest count of a phrase one word longer that holds it."""
    held = counts.select("lang", F.split("phrase", " ").alias("words"), "n")
    stream = held.withColumns({"later": F.lit(False), "extension": F.lit(0).cast("bigint")})
    ranged, opened = _in_order(stream, held)

    def rightward(rows):
        for node, lefts in lockstep(rows, opened):
            if node.row:
                yield dict(node.row, lefts=lefts, extension=node.extension)
            elif node.extension:
                yield {"lang": node.lang, "words": node.words, "n": 0, "later": True, "extension": node.extension, "lefts": []}

    # Both streams are written before the next order is taken.
    found = written(map_rows(ranged, rightward, _STREAM), "prefix-order")
    turned = found.select("lang", F.reverse("words").alias("words"), "n", "later", "extension", "lefts")
    ranged_2, opened_2 = _in_order(turned, held.select("lang", F.reverse("words").alias("words"), "n"))

    def leftward(rows):
        for node, rights in lockstep(rows, opened_2):
            if node.row and len(node.words) > 1:
                yield _candidate(node.row, rights, node.extension)
            elif not node.row and node.extension:
                yield {"later": True, "lang": node.lang, "phrase": " ".join(reversed(node.words)), "extension": node.extension}

    out = written(map_rows(ranged_2, leftward, "later boolean, lang string, phrase string, a bigint, l bigint, r bigint, "
                                               "score bigint, extension bigint"), "suffix-order")
    # At most LONGEST - 1 rows a partition.
    late = out.filter("later").groupBy("lang", "phrase").agg(F.max("extension").alias("_late"))
    whole = out.filter("NOT later").drop("later").join(F.broadcast(late), ["lang", "phrase"], "left")
    return whole.withColumn("extension", F.greatest("extension", F.coalesce("_late", F.lit(0)))).drop("_late")


def collocations(docs: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counts, words = frequent_phrases(docs, block_bytes, filter_bits)
    kept = candidates(counts).filter(F.col("extension") * 100 < F.col("a") * INSIDE).drop("extension")
    placed = ordered.with_position(kept, ["lang", F.desc("score"), F.desc("a"), "phrase"], "_pos")
    starts = placed.groupBy("lang").agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    sizes = starts.join(words, "lang")
    ranked = hot_key_join(placed, sizes, "lang", spread=["phrase"], counts=starts.withColumnRenamed("_rows", "n"))
    return (ranked.withColumn("rank", F.col("_pos") - F.col("_start") + 1).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
