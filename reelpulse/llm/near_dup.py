"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: how often one occurs, times its inverse document
frequency.  Each of BANDS x ROWS samples draws one shingle and level of a text so that two texts draw the same
with a probability of their weighted Jaccard similarity (Ioffe 2010).  Texts that agree on a band share a
bucket; candidates from buckets are verified by their exact weighted Jaccard similarity, and verified links
are closed to classes.

*Document frequencies.*  All documents are counted.  The inverse document frequency of a shingle is
SMOOTHING + ln(N / max(df, floor)) / ln(N): copies make their own shingles frequent, and a steeper weight would
push large groups of true copies below the threshold by their few rare edits.  The floor is the number of all (document, shingle) pairs over TABLE: at most TABLE shingles can be above it,
so the table that goes to the tasks has a proven bound, at any size of input.  It is found in two passes: a
shingle above the floor exceeds half of the floor's share in blocks that hold enough of it, so blocks report
those, at most 2 * TABLE of them remain after their counts are added, and these are then counted exactly.

*Candidates.*  Equal texts are one node.  First every member of a bucket is compared with the bucket's
smallest node.  Then, in buckets of up to SMALL nodes, all pairs that are not yet in one class are compared.
In larger buckets one node per class is compared: all pairs of up to SMALL classes, else each class with three
heads.  These two passes only shrink the work: at last every large bucket that still has several classes is
settled exactly.  A text's prefix is its leading shingles, in one order for all texts, until what is
left weighs less than the threshold's share of it; two texts as similar as the threshold have their first common
shingle in both prefixes.  All pairs of different classes with a common prefix shingle are compared, except
those for which the weights from that shingle on cannot reach the threshold.  Rare shingles come first in the
order, so that few texts share one; the order is by counts in SLOTS hashed slots, which changes the work and
never the result.  Slots whose shingles lie in texts of one class only come before all others, and their shingles
are never looked up: no text of another class has one.  So the members of one large class bring few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, rows_of, saved, scratch_path, swept, text_of, trimmed
from .components import components
from .shingles import Hasher, mix

SIMILARITY = 0.8
BANDS, ROWS = 8, 3
TABLE = 250_000
BLOCK_DOCS = 65_536
BLOCK_SHINGLES = 8_000_000
BLOCK_BYTES = 32 << 20
SMALL = 32
SLOTS = 1 << 18
SMOOTHING = 2.0
_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class Weights:
    """Inverse document frequencies: a sorted table of frequent shingles, and one value for all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int, floor: float):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.logs = SMOOTHING + np.log(documents / np.maximum(counts[order], floor)) / np.log(max(2, documents))
        self.rare = SMOOTHING + float(np.log(max(1.0, documents / floor)) / np.log(max(2, documents)))

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of a text's shingles."""
        idf = np.full(len(hashes), self.rare)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            idf = np.where(self.hashes[at] == hashes, self.logs[at], idf)
        return idf * counts


def samples(hashes: np.ndarray, weights: np.ndarray, width: int = 4096) -> np.ndarray:
    """One 64-bit sample per seed of a non-empty weighted set."""
    best = np.full(len(_SEEDS), np.inf, np.float32)
    drawn = np.zeros(len(_SEEDS), np.uint64)
    every = np.arange(len(_SEEDS))
    for start in range(0, len(hashes), width):
        h = hashes[start:start + width]
        log_w = np.log(weights[start:start + width]).astype(np.float32)
        one = mix(h[None, :] ^ _SEEDS[:, None])
        two = mix(one + _U(0x632BE59BD9B4E019))

        def uniform(bits: np.ndarray, shift: int, size: int) -> np.ndarray:
            return (((bits >> _U(shift)) & _U((1 << size) - 1)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << size)

        r = -np.log(uniform(one, 40, 24) * uniform(one, 16, 24))
        beta = uniform(one, 0, 16)
        log_c = np.log(-np.log(uniform(two, 40, 24) * uniform(two, 16, 24)))
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta + 1)
        at = log_a.argmin(1)
        value = log_a[every, at]
        better = value < best
        best[better] = value[better]
        chosen = mix(h[at] + level[every, at].astype(np.int64).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        drawn[better] = chosen[better]
    return drawn


def bands(hashes: np.ndarray, weights: np.ndarray) -> list[int]:
    """The bucket number of each band."""
    drawn = samples(hashes, weights).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        total = mix(total * _U(3) + drawn[:, i])
    return total.astype(np.int64).tolist()


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (ascending hashes, weights); 0 if one is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def _block_counts(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(hash, n): document counts by blocks of documents; with ``wanted`` (ascending) of these hashes, else of
    those with more than half of the floor's share of a block.  A last row of each block has hash null and
    the block's number of (document, shingle) pairs."""

    def run(batches):
        hasher = Hasher()

        def reports(held):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            mass = int(n.sum())
            if wanted is None:
                chosen = n >= mass / (2 * TABLE)
                found, n = found[chosen], n[chosen]
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i:i + 100_000].view(np.int64)),
                                                  pa.array(n[i:i + 100_000])], names=["hash", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([mass], pa.int64())],
                                             names=["hash", "n"])

        held, size = [], 0
        for part in rows_of(batches):
            for text in part.column(0).to_pylist():
                h, _ = hasher.shingles(text)
                if wanted is not None and len(h):
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    h = h[wanted[at] == h]
                held.append(h)
                size += len(h)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_SHINGLES:
                    yield from reports(held)
                    held, size = [], 0
        if held:
            yield from reports(held)

    return texts.mapInArrow(trimmed(run), "hash bigint, n bigint")


def _table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    return (got.column("hash").to_numpy().view(np.uint64).copy(), got.column("n").to_numpy().astype(np.float64))


def document_frequencies(texts: DataFrame) -> Weights:
    """The weights of a corpus; ``texts`` has one column, one row per document."""
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(texts.columns[0])).alias("bytes")).first()
    n_docs = size["n"]
    # Partitions that fill a block by bytes, also of short texts: in a small one every shingle has more than the
    # floor's share.
    texts = texts.coalesce(max(1, n_docs // BLOCK_DOCS, (size["bytes"] or 0) // BLOCK_BYTES))
    first = saved(_block_counts(texts, None).groupBy("hash").agg(F.sum("n").alias("n")))
    mass = first.filter("hash IS NULL").agg(F.sum("n")).first()[0] or 0
    floor = max(1.0, mass / TABLE)
    likely, _ = _table(first.filter(F.col("hash").isNotNull() & (F.col("n") >= floor / 2)))      # at most 2 * TABLE
    if not len(likely):
        return Weights(likely, np.empty(0), max(1, n_docs), floor)
    exact = (_block_counts(texts, np.sort(likely)).filter("hash IS NOT NULL").groupBy("hash")
             .agg(F.sum("n").alias("n")).filter(F.col("n") > floor))                             # at most TABLE
    hashes, counts = _table(exact)
    return Weights(hashes, counts, max(1, n_docs), floor)


def signatures(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(doc_id, key, bands) per row of (doc_id, key, text); bands is empty for texts without words.  ``sent`` is
    the broadcast Weights."""

    def run(batches):
        hasher, weigh = Hasher(), sent.value.of
        for part in rows_of(batches):
            out = []
            for text in part.column(2).to_pylist():
                h, n = hasher.shingles(text)
                out.append(bands(h, weigh(h, n)) if len(h) else [])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.int64()))],
                                             names=["doc_id", "key", "bands"])

    return docs.select("doc_id", "key", "text").mapInArrow(trimmed(run), "doc_id bigint, key binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, sent: Broadcast, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts' weighted Jaccard similarity is ``similarity`` or more; ``sent`` is
    the broadcast Weights."""

    def side(name: str) -> DataFrame:
        return texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}")).hint("merge")

    def run(batches):
        hasher, weigh, held = Hasher(), sent.value.of, {}

        def vector(key, text):
            if key not in held:
                if len(held) >= 64:
                    held.clear()
                h, n = hasher.shingles(text)
                held[key] = (h, weigh(h, n))
            return held[key]

        for part in rows_of(batches):
            a, b, text_a, text_b = (part.column(i).to_pylist() for i in range(4))
            near = [jaccard(vector(*x), vector(*y)) >= similarity for x, y in zip(zip(a, text_a), zip(b, text_b))]
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(trimmed(run), "a binary, b binary")


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    """Unordered pairs of different keys, once each."""
    return (df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())


def _heads(members: DataFrame, salt: int) -> DataFrame:
    """(bucket, key, head): every member with three heads of its bucket, by hashes of the key."""
    order = [F.struct(F.xxhash64(F.lit(3 * salt + i), "key"), "key") for i in range(3)]
    heads = members.groupBy("bucket").agg(*(F.min(o).alias(f"h{i}") for i, o in enumerate(order)))
    heads = heads.select("bucket", F.explode(F.array_distinct(F.array(*(F.col(f"h{i}.key") for i in range(3))))).alias("head"))
    return members.select("bucket", "key").join(heads.hint("merge"), "bucket")


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """About how many rows of (key, text, label) have the shingles of each of SLOTS hashed slots; 0 for a slot whose
    rows have all the same label."""

    def run(batches):
        hasher, total = Hasher(), np.zeros(SLOTS, np.int64)
        low, high = np.full(SLOTS, np.iinfo(np.int64).max), np.full(SLOTS, np.iinfo(np.int64).min)
        for part in rows_of(batches):
            for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                at = (hasher.shingles(text)[0] % _U(SLOTS)).astype(np.int64)
                total += np.bincount(at, minlength=SLOTS)
                number = int.from_bytes(label[:8], "little", signed=True)
                low[at], high[at] = np.minimum(low[at], number), np.maximum(high[at], number)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, total[some], low[some], high[some])],
                                             names=["slot", "n", "low", "high"])

    got = (texts.mapInArrow(trimmed(run), "slot bigint, n bigint, low bigint, high bigint").groupBy("slot")
           .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
           .filter("low != high").select("slot", "n").toArrow())
    counts = np.zeros(SLOTS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def prefix(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the prefix of a weighted set, weight of the set from each of them on)."""
    order = np.lexsort((hashes, counts[(hashes % _U(SLOTS)).astype(np.int64)]))
    rest = np.cumsum(weights[order][::-1])[::-1]
    size = int((rest >= similarity * rest[0] * (1 - 1e-9)).sum()) if len(rest) else 0
    return hashes[order[:size]], rest[:size]


def _leading(held: DataFrame, sent: Broadcast, similarity: float) -> DataFrame:
    """(shingle, key, label, rest, whole): the prefix of every row of (key, text, label), without shingles that only
    one label has for certain; ``rest`` is the weight from the shingle on."""
    order = held.sparkSession.sparkContext.broadcast(_slot_counts(held))                            # SLOTS numbers

    def run(batches):
        hasher, weigh, counts = Hasher(), sent.value.of, order.value
        for part in rows_of(batches, 1 << 20):
            found, left, row, whole = [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                h, n = hasher.shingles(text)
                first, rest = prefix(h, weigh(h, n), counts, similarity)
                shared = counts[(first % _U(SLOTS)).astype(np.int64)] > 0
                found.append(first[shared])
                left.append(rest[shared])
                row.append(np.full(int(shared.sum()), i))
                whole.append(np.full(int(shared.sum()), rest[0] if len(rest) else 0.0))
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), part.column(0).take(at), part.column(2).take(at),
                 pa.array(np.concatenate(left)), pa.array(np.concatenate(whole))],
                names=["shingle", "key", "label", "rest", "whole"])

    return held.select("key", "text", "label").mapInArrow(
        trimmed(run), "shingle bigint, key binary, label binary, rest double, whole double")


def _across(nodes: DataFrame, texts: DataFrame, sent: Broadcast, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes (key, label) of different labels that can be as similar as ``similarity``."""
    held = nodes.join(texts.hint("merge"), "key").select("key", "text", "label")
    rows = _leading(held, sent, similarity)
    several = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    rows = swept(saved(rows.join(several.select("shingle").hint("merge"), "shingle", "left_semi")))
    other = rows.select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("key", "label", "rest", "whole")))
    enough = (F.least("rest", "rest_2") * F.lit(1 + similarity)
              >= (F.col("whole") + F.col("whole_2")) * F.lit(similarity * (1 - 1e-9)))
    return (rows.join(other.hint("merge"), "shingle")
            .filter((F.col("label") != F.col("label_2")) & (F.col("key") < F.col("key_2")) & enough)
            .select(F.col("key").alias("a"), F.col("key_2").alias("b")).distinct())


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, key, n, label) of the members of the buckets that hold several classes; a key without a label is
    a class of its own."""
    told = (members.select("bucket", "key", "n").join(labels.hint("merge"), "key", "left")
            .withColumn("label", F.coalesce("label", "key")))
    several = told.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    return swept(saved(told.join(several.select("bucket").hint("merge"), "bucket", "left_semi")))


def _merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` with the links ``new`` (a, b) added.  A class is a star around its label, so its chains are short."""
    if new.isEmpty():
        return labels
    star = labels.filter("key != label").select(F.col("key").alias("a"), F.col("label").alias("b"))
    return components(star.union(new.select("a", "b")))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, class_id) for every row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the class.  Equal texts are always in one class, also those without
    any word (null counts as empty), which have no other link.  Rows with a null doc_id have a class like any
    other; a class id is null only if all its ids are.  Repeated rows are copies of each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", content_key(F.col("text")).alias("key"), "text")
    sent = spark.sparkContext.broadcast(document_frequencies(rows.select("text")))        # at most TABLE entries
    signed = saved(signatures(rows, sent))
    # Equal texts: one node, whose bands any of them has.
    nodes = signed.groupBy("key").agg(F.first("bands").alias("bands"))
    buckets = nodes.select("key", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "key")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head")).filter("n > 1")
    members = swept(saved(buckets.join(sizes, "bucket")))
    path = scratch_path(spark, "texts")
    (rows.join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
     .write.parquet(path))
    texts = spark.read.parquet(path)

    links = swept(saved(verified(_ordered(members, "key", "head"), texts, sent, similarity)))
    labels = components(links)
    told = _split(members, labels)
    few = told.filter(F.col("n") <= SMALL).select("bucket", "label", "key")
    chosen = (told.filter(F.col("n") > SMALL).groupBy("bucket", "label")
              .agg(F.min(F.struct(F.xxhash64(F.lit(0), "key"), "key")).alias("one"))
              .select("bucket", "label", F.col("one.key").alias("key")))
    counted = chosen.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    chosen = chosen.join(counted.hint("merge"), "bucket")
    pairwise = few.union(chosen.filter(F.col("m") <= SMALL).drop("m"))
    other = pairwise.select("bucket", F.col("label").alias("label_2"), F.col("key").alias("key_2"))
    pairs = (pairwise.join(other.hint("merge"), "bucket")
             .filter((F.col("label") != F.col("label_2")) & (F.col("key") < F.col("key_2")))
             .select(F.col("key").alias("a"), F.col("key_2").alias("b")))
    pairs = pairs.union(_ordered(_heads(chosen.filter(F.col("m") > SMALL), 0), "key", "head")).distinct()
    labels = _merged(labels, swept(saved(verified(pairs, texts, sent, similarity))))
    # Small buckets are done.
    large = told.filter(F.col("n") > SMALL).drop("label")
    nodes = saved(_split(large, labels).select("key", "label").distinct())
    if not nodes.isEmpty():
        labels = _merged(labels, swept(saved(verified(_across(nodes, texts, sent, similarity), texts, sent, similarity))))
    placed = signed.select("doc_id", "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    ids = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return placed.join(ids, "label").select("doc_id", "key", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all its columns.  Of several rows with
    that id in the class, the one with the smallest text hash stays, of equal ones any."""
    marked = docs.withColumn("_llm_key", content_key(text_of()))
    best = (classes(docs, similarity).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
            .groupBy("class_id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
            .select(F.col("class_id").alias("_llm_id"), F.col("key").alias("_llm_best"), "n"))
    best = saved(best)
    here = marked["doc_id"].eqNullSafe(F.col("_llm_id")) & (marked["_llm_key"] == F.col("_llm_best"))
    once = marked.join(best.filter("n = 1"), here).select(*(marked[c] for c in docs.columns))
    several = marked.join(best.filter("n > 1"), here).select(*(marked[c] for c in docs.columns), "_llm_best")
    return once.union(several.dropDuplicates(["doc_id", "_llm_best"]).drop("_llm_best"))
