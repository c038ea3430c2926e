"""Document fingerprints by improbable features.

Every window of WINDOW bytes has a rank: how popular its entropy is under a fixed model of text, so a low rank
is improbable.  In every run of RUN consecutive windows the leftmost one of lowest rank is counted; windows
counted THRESHOLD times or more are the text's features.  Their hashes go, in order and each once, into a
chain of Bloom filters of FILTER_BYTES bytes with at most PER_FILTER features each.  Two chains are compared
filter by filter: the common bits beyond those expected by chance, relative to the most that could be common;
the likeness is the mean over the shorter chain's filters of their best partner.

The entropies of all windows come from one pass: a window's sum of c*log(c) over its byte counts changes, when
it moves by one byte, only by the counts of the byte that leaves and the byte that enters.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, text_of
from .shingles import mix

WINDOW, RUN, THRESHOLD = 64, 64, 16
SHORT, SHORT_WINDOW = 512, 8
FILTER_BYTES, PER_FILTER, HASHES = 256, 160, 5
#: Model of popular entropies (bits per byte in windows of text): centre and spread.  Windows below LEAST bits
#: are mostly filling and are never features.
CENTRE, SPREAD, LEAST = 3.75, 0.25, 1.5
BITS = FILTER_BYTES * 8
_U = np.uint64
_UNIT = 1 << 24
_C = np.arange(WINDOW + 2, dtype=np.float64)
_CLOGC = np.rint(_C * np.log2(np.maximum(_C, 1)) * _UNIT).astype(np.int64)
_LEAVE = np.concatenate([[0], _CLOGC[:-1] - _CLOGC[1:]])       # by the count of the byte that leaves
_ENTER = np.append(_CLOGC[1:] - _CLOGC[:-1], 0)                # by the count, before, of the byte that enters
_BASE = _U(0x100000001B3)
_BLOCK = 1 << 20


def entropies(raw: np.ndarray) -> np.ndarray:
    """Entropy in bits of every window of WINDOW bytes.

    Sums are integers in units of 2^-24, so a window's entropy depends on its bytes alone, wherever it lies.
    """
    n = len(raw)
    if n < WINDOW:
        return np.empty(0)
    ahead, before = np.ones(n, np.uint8), np.zeros(n, np.uint8)     # equal bytes in [j, j + WINDOW), (j - WINDOW, j)
    for lag in range(1, WINDOW):
        same = (raw[lag:] == raw[:-lag]).view(np.uint8)
        ahead[:-lag] += same
        before[lag:] += same
    change = _LEAVE[ahead[:n - WINDOW]] + _ENTER[before[WINDOW:]]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _CLOGC[np.bincount(raw[:WINDOW], minlength=256)].sum()
    np.cumsum(change, out=total[1:])
    total[1:] += total[0]
    return np.log2(WINDOW) - total / (WINDOW * _UNIT)


def ranks(entropy: np.ndarray) -> np.ndarray:
    """Popularity of entropies, 0 (improbable) to 1000; 2000 for windows that cannot be features."""
    rank = np.rint(1000 * np.exp(-((entropy - CENTRE) / SPREAD) ** 2 / 2)).astype(np.int64)
    return np.where(entropy < LEAST, 2000, rank)


def picked(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that are the leftmost of lowest rank in some run, number of such runs)."""
    n = len(rank)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run = min(RUN, n)
    low = rank * (1 << 40) + np.arange(n)             # the leftmost of equal ranks is the smallest
    width = 1
    while width * 2 <= run:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < run:
        low = np.minimum(low[:len(low) - (run - width)], low[run - width:])
    times = np.bincount(low & ((1 << 40) - 1), minlength=n)
    at = np.flatnonzero((times > 0) & (rank < 2000))
    return at, times[at]


def window_hashes(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the windows of ``size`` bytes at the given positions."""
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total = total * _BASE + raw[at + i].astype(np.uint64) + _U(1)
    return mix(total)


def _each_once(hashes: np.ndarray) -> np.ndarray:
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def features(text: str, rank: np.ndarray | None = None) -> np.ndarray:
    """Hashes of a text's features, each once, in order of their first place.

    Windows of equal content add up their counts, so that periodic text has features too.  Texts of fewer than
    SHORT characters have few runs, so every window of SHORT_WINDOW bytes follows as a feature; the selected
    windows come first, in the first filter, where longer texts find those that they share.  A text shorter than
    SHORT_WINDOW bytes has the whole text.  ``rank``: the ranks of the text's windows, if they are known.
    """
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < SHORT_WINDOW:
        return np.frombuffer(hashlib.sha1(data).digest()[:8], "<u8") if data else np.empty(0, np.uint64)
    found = selected(raw, rank)
    if len(text) < SHORT:
        every = window_hashes(raw, np.arange(len(raw) - SHORT_WINDOW + 1), SHORT_WINDOW)
        found = _each_once(np.concatenate([found, every]))
    return found


def selected(raw: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the selected windows of WINDOW bytes, each once, in order of their first place."""
    if rank is not None:
        place, count = picked(rank)
    else:
        places, counts = [], []
        for start in range(0, len(raw), _BLOCK):      # blocks overlap, so that every run of windows is whole
            first = max(0, start - 2 * RUN)
            at, times = picked(ranks(entropies(raw[first:start + _BLOCK + WINDOW + 2 * RUN])))
            at = at + first
            own = (at >= start) & (at < start + _BLOCK)
            places.append(at[own])
            counts.append(times[own])
        place, count = np.concatenate(places), np.concatenate(counts)
    hashes = window_hashes(raw, place, WINDOW)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    often = np.bincount(group, count) >= THRESHOLD
    return hashes[np.sort(first[often])]


def chain(text: str | None, rank: np.ndarray | None = None) -> np.ndarray:
    """The Bloom filters of a text, one row of FILTER_BYTES bytes each; a text without features has none."""
    found = features(text or "", rank)
    bits = np.zeros(((len(found) + PER_FILTER - 1) // PER_FILTER, BITS), bool)
    row = np.arange(len(found)) // PER_FILTER
    for i in range(HASHES):
        bits[row, ((found >> _U(11 * i)) & _U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def chains(texts: list[str]) -> list[np.ndarray]:
    """:func:`chain` of every text; the windows of texts of common length are ranked together, in blocks."""
    out: list[np.ndarray | None] = [None] * len(texts)
    held: list[tuple[int, int]] = []
    joined = bytearray()

    def close() -> None:
        rank = ranks(entropies(np.frombuffer(bytes(joined), np.uint8)))
        for (i, start), end in zip(held, [*(s for _, s in held[1:]), len(joined)]):
            out[i] = chain(texts[i], rank[start:end - WINDOW + 1])
        held.clear()
        joined.clear()

    for i, text in enumerate(texts):
        if len(text) < WINDOW or len(text) > _BLOCK // 4:
            out[i] = chain(text)
            continue
        held.append((i, len(joined)))
        joined += text.encode("utf-8", "surrogatepass")
        if len(joined) > _BLOCK // 2:
            close()
    if held:
        close()
    return out


def encode(filters: np.ndarray) -> str:
    """A fingerprint as text: the filters in base 64."""
    return base64.b64encode(filters.tobytes()).decode("ascii")


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BYTES)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two chains, 0 to 1; equal chains have 1, an empty one is only like another empty one."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    wide = np.unpackbits(b, axis=1).astype(np.float32)
    n_b, total = wide.sum(1), 0.0
    for start in range(0, len(a), 256):
        some = np.unpackbits(a[start:start + 256], axis=1).astype(np.float32)
        n_a = some.sum(1)
        chance = np.outer(n_a, n_b) / BITS
        most = np.minimum(n_a[:, None], n_b[None, :])
        over = (some @ wide.T - chance) / np.maximum(most - chance, 1e-9)
        total += float(over.max(1).clip(0, 1).sum())
    return round(total / len(a), 9)


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``after``."""
    third = len(text) // 3
    return text[:len(text) - third] + after[:third]


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(batches):
    """Rows in order of (slice, descending id); each is compared with the row after it.  A row with ``extra``
    only ends its slice."""
    previous = None
    for part in rows_of(batches, 1 << 20):
        ids, texts, extra = (part.column(i).to_pylist() for i in range(3))
        pairs = []                                            # (a row, the row after it)
        for row in zip(ids, texts, chains(texts), extra):
            if previous is not None:
                pairs.append((previous, row))
            previous = None if row[3] else row
        changed = [edited(a[1], b[1]) for a, b in pairs]
        out = [(a[0], len(a[1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), encode(a[2]),
                encode(new), likeness(a[2], new), likeness(a[2], b[2]))
               for (a, b), text, new in zip(pairs, changed, chains(changed))]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=[x.split()[0] for x in RESULT.split(", ")])


def fingerprints(docs: DataFrame, per_slice: int = 4000) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are; columns as in RESULT.

    Documents follow one another by descending doc_id (null last, equal ids by text), and the first follows
    the last.  They are cut into slices of about ``per_slice`` documents at quantiles of the id, so each text
    is moved once; the first document of each slice is also sent to the slice before.  Null texts are empty.
    A single document is its own next.  An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    slices = max(1, known // per_slice)
    marks = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / slices) for i in range(1, slices))), 10 * slices)
                     .alias("m")).first()["m"] if slices > 1 else []
    splits = [float("-inf"), *sorted({float(m) for m in marks or [0.0]}), float("inf")]
    number = Bucketizer(splits=splits, inputCol="_id", outputCol="_slice", handleInvalid="keep")
    at = number.transform(rows.withColumn("_id", F.col("doc_id").cast("double")))
    # Slices in the order of the documents: highest ids first, documents without an id last.
    at = at.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(len(splits)))
                   .otherwise(F.lit(len(splits) - 2) - F.col("_slice")).cast("int").alias("slice"))
    order = F.struct((-F.col("doc_id")).alias("down"), F.xxhash64("text").alias("h"))
    heads = at.groupBy("slice").agg(F.min(order).alias("one"))             # one row per slice
    first = heads.select("slice", "one.*", F.coalesce(F.lag("slice").over(Window.orderBy("slice")),
                                                      F.max("slice").over(Window.partitionBy())).alias("to"))
    opening = (at.join(F.broadcast(first), "slice")
               .filter((-F.col("doc_id")).eqNullSafe(F.col("down")) & (F.xxhash64("text") == F.col("h")))
               .select("to", "doc_id", "text").dropDuplicates(["to"])
               .select("doc_id", "text", F.col("to").alias("slice"), F.lit(True).alias("extra")))
    every = at.select("doc_id", "text", "slice", F.lit(False).alias("extra")).union(opening)
    placed = every.repartition(max(1, len(splits)), "slice").sortWithinPartitions(
        "slice", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return placed.select("doc_id", "text", "extra").mapInArrow(_compare, RESULT)
