"""URL filters: fixed rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host.  The bad rate of a host is shrunk through beta-binomial priors: the
suffix towards the rate of all outcomes, the registered domain towards its suffix, the host towards its domain.
How strongly each level is shrunk comes from the data: with the parent's rate m known, the counts (n, b) of the
groups of a level have E[n (b/n - m)^2] = m (1-m) (1 + (n-1) rho), so rho is a ratio of two sums over all groups and
the prior's weight is 1/rho - 1, held between ``WEAKEST`` and ``STRONGEST`` outcomes.  A host is blocked when the
lower bound (mean - Z sd of its beta posterior) of its bad rate exceeds ``LIMIT``, so a few bad pages of an unknown
host do not block it.

Outcomes: a page shows a document when its main text (the article without its first-level heading, markup and
entities; all of the page where there is no article) has all words of the document's whole text, from the first word
on; it may go on after them, unless they are fewer than ``OPENING``.  Of several texts that it opens with the longest
counts.  Its outcome is bad if at least half of the labelled rows of the documents with that text are of quality 0 or
toxic.  Documents and pages are cut into words once.  Texts are compared by hashes of all their words: pages that equal
a document by one join, and only the others by their first words, as many as some document with their anchor has.  The
anchor of n words are the first of them, n rounded down to its two leading binary digits, so that texts which only open
alike do not meet: a page has two anchors for each doubling of its length, an anchor at most half as many lengths as words.

Nulls: a null url or one without ``://`` has an empty host and path and is judged like any other host.  Null html,
text or label rows give no outcome.  Repeated pages count as often as they occur; repeated label rows likewise.
Columns called host, path, rule, verdict or bad_rate_bound are replaced.  With no outcomes at all nothing is blocked
by the method.

Hot keys: pages are counted per (host, text) before any join; joins on host, text, opening, domain and suffix cut hot
keys into slices.  The driver sees two sums per level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_key_join
from .common import rows_of, trimmed, written
from .words import words

#: (block or allow, rule): host, then the path that the url's path must start with.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels, under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn",
                      "com.mx", "com.tr", "gov.uk", "org.uk")
OPENING = 8
LIMIT = 0.5
Z = 1.645
WEAKEST, STRONGEST = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix of a host without its port: the last label, or two where the list says so."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; a host of numbers only is its own domain."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return (F.when(name.rlike("^[0-9.]+$"), name)
            .when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (ties: the smaller text), null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(verdict)
    return rule, verdict


def anchor_length(n: int) -> int:
    """``n`` rounded down to its two leading binary digits."""
    low = max(0, n.bit_length() - 2)
    return n >> low << low


def anchor_lengths(n: int) -> list[int]:
    """The anchor lengths of all texts of at least ``OPENING`` and fewer than ``n`` words, ascending."""
    found = {anchor_length(OPENING)} | {a << k for k in range(n.bit_length()) for a in (2, 3)}
    return sorted(a for a in found if anchor_length(OPENING) <= a < n) if n > OPENING else []


def first_words(joined: bytes, lengths: list[int]) -> list[bytes]:
    """The MD5 of the first ``lengths`` (ascending) words of a text of words joined by spaces, read once."""
    found, hashed, start, at, seen = [], hashlib.md5(), 0, -1, 0
    for n in lengths:
        while seen < n:
            at = joined.find(b" ", at + 1)
            at, seen = len(joined) if at < 0 else at, seen + 1
        hashed.update(joined[start:at])
        start = at
        found.append(hashed.digest())
    return found


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def document_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, _text, _n, _anchor) of the documents with words: key and number of all words, and the anchor, null
    for fewer than ``OPENING``."""

    def run(batches):
        for part in rows_of(batches):
            ids, texts, counts, anchors = [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                found = words(text)
                if found:
                    ids.append(i)
                    texts.append(hashlib.md5(b" ".join(found)).digest())
                    counts.append(len(found))
                    anchors.append(None if len(found) < OPENING else
                                   _number(hashlib.md5(b" ".join(found[:anchor_length(len(found))])).digest()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.binary()),
                 pa.array(counts, pa.int32()), pa.array(anchors, pa.int64())], names=["doc_id", "_text", "_n", "_anchor"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return (documents.select("doc_id", F.col("text").cast("string"))
            .mapInArrow(trimmed(run), f"doc_id {kind}, _text binary, _n int, _anchor bigint"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(host, _text, _anchors, _words) per page: key of all words, the anchors of the texts it may go on after, and
    the words joined by spaces; all null without words."""

    def run(batches):
        for part in rows_of(batches):
            keys, anchors, held = [], [], []
            for text in part.column(1).to_pylist():
                found = words(text)
                joined = b" ".join(found)
                keys.append(hashlib.md5(joined).digest() if found else None)
                anchors.append([_number(d) for d in first_words(joined, anchor_lengths(len(found)))] if found else None)
                held.append(joined if found else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys, pa.binary()), pa.array(anchors, pa.list_(pa.int64())),
                 pa.array(held, pa.binary())], names=["host", "_text", "_anchors", "_words"])

    return (pages.select(host_of(F.col("url")).alias("host"), main_text(F.col("html")).alias("_main"))
            .mapInArrow(trimmed(run), "host string, _text binary, _anchors array<bigint>, _words binary"))


def _begun(texts: DataFrame) -> DataFrame:
    """(_text, _n, _begun) of texts (_text, _words, _lengths): the key of the first _n words, for every _n in
    _lengths below the number of words."""

    def run(batches):
        for part in rows_of(batches):
            rows, counts, keys = [], [], []
            for i, (joined, lengths) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                n_words = joined.count(b" ") + 1
                wanted = sorted(n for n in set(lengths) if n < n_words)
                rows += [i] * len(wanted)
                counts += wanted
                keys += first_words(joined, wanted)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(counts, pa.int32()),
                 pa.array(keys, pa.binary())], names=["_text", "_n", "_begun"])

    return texts.select("_text", "_words", "_lengths").mapInArrow(trimmed(run), "_text binary, _n int, _begun binary")


def main_text(html: Column) -> Column:
    """The article of a page, or all of it, without first-level headings, markup and entities."""
    inside = F.regexp_extract(html, "(?s)<article[^>]*>(.*?)</article>", 1)
    found = F.when(F.length(inside) > 0, inside).otherwise(html)
    return F.regexp_replace(F.regexp_replace(found, "(?s)<h1.*?</h1>|<[^>]*>", " "), "&#?[0-9A-Za-z]+;", " ")


def host_outcomes(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad) for every host of the pages: labelled pages and bad ones among them."""
    told = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("_rows"),
                 F.count_if((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("_bad")))
    opened = written(document_texts(documents), "document-texts")
    shown = (hot_key_join(opened, told, "doc_id").groupBy("_text")
             .agg(F.first("_anchor").alias("_anchor"), F.first("_n").alias("_n"),
                  (2 * F.sum("_bad") >= F.sum("_rows")).cast("long").alias("_outcome")))
    shown = written(shown, "shown-texts")
    outcome_of = shown.select("_text", "_outcome")
    held = written(page_texts(pages), "page-texts", "zstd")
    # Pages of one host with one text count as one row in the join.
    groups = held.groupBy("host", "_text").agg(F.count(F.lit(1)).alias("_pages"))
    met = written(hot_key_join(groups, outcome_of, "_text", "left", spread=["host"]), "page-groups")
    counted = _counted(met)
    # Texts that go on after a document: their first words, for every length of a document with one of their anchors.
    lengths = (shown.filter("_anchor IS NOT NULL").select("_anchor", "_n").distinct()
               .groupBy("_anchor").agg(F.collect_list("_n").alias("_lengths")))
    other = met.filter("_outcome IS NULL AND _text IS NOT NULL").select("_text").distinct()
    anchored = (hot_key_join(held.filter(F.size("_anchors") > 0).select("host", "_text", "_anchors"), other, "_text",
                             "left_semi", spread=["host"]).groupBy("_text").agg(F.first("_anchors").alias("_anchors")))
    anchored = written(anchored, "other-texts").select("_text", F.explode("_anchors").alias("_anchor"))
    likely = (hot_key_join(anchored, lengths, "_anchor", spread=["_text"])
              .groupBy("_text").agg(F.flatten(F.collect_list("_lengths")).alias("_lengths")))
    likely = written(likely, "likely-texts")
    if likely.isEmpty():
        return counted
    texts = (hot_key_join(held.select("host", "_text", "_words"), likely.select("_text"), "_text", "left_semi", spread=["host"])
             .groupBy("_text").agg(F.first("_words").alias("_words")).join(likely, "_text"))
    begun = written(_begun(texts), "first-words")
    longest = (hot_key_join(begun, outcome_of.withColumnRenamed("_text", "_begun"), "_begun", spread=["_text"])
               .groupBy("_text").agg(F.max_by("_outcome", "_n").alias("_outcome")))
    more = hot_key_join(met.filter("_outcome IS NULL").drop("_outcome"), longest, "_text", spread=["host"])
    return counted.union(_counted(more)).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _counted(groups: DataFrame) -> DataFrame:
    """(host, n, bad) from page groups (host, _pages, _outcome)."""
    n = F.when(F.col("_outcome").isNotNull(), F.col("_pages")).otherwise(0)
    return groups.groupBy("host").agg(F.sum(n).alias("n"), F.sum(n * F.coalesce("_outcome", F.lit(0))).alias("bad"))


def _strength(groups: DataFrame, prior: Column) -> float:
    """The prior's weight for one level: groups with n, bad and the parent's rate."""
    spread = prior * (1 - prior)
    s = (groups.filter(F.col("n") > 0)
         .agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - prior, 2) - spread).alias("over"),
              F.sum((F.col("n") - 1) * spread).alias("scale")).first())
    if not s.scale or not s.over or s.over <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, s.scale / s.over - 1))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, bad_rate, bad_rate_bound, blocked) from outcome counts per host (host, n, bad)."""
    hosts = written(outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("_domain"),
                                    suffix_of(F.col("host")).alias("_suffix")), "host-counts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(hosts.groupBy("_suffix", "_domain").agg(*sums), "domain-counts")
    suffixes = written(domains.groupBy("_suffix").agg(*sums), "suffix-counts")
    all_of = suffixes.agg(*sums).first()
    level = F.lit(((all_of.bad or 0) + 0.5) / ((all_of.n or 0) + 1.0))

    def rate(strength: float, prior: Column) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    by_suffix = suffixes.select("_suffix", rate(_strength(suffixes, level), level).alias("_prior"))
    domains = written(hot_key_join(domains, by_suffix, "_suffix", spread=["_domain"]), "domain-priors")
    prior = F.col("_prior")
    by_domain = domains.select("_suffix", "_domain", rate(_strength(domains, prior), prior).alias("_prior"))
    hosts = written(hot_key_join(hosts, by_domain, ["_suffix", "_domain"], spread=["host"]), "host-priors")
    weight = _strength(hosts, prior)
    mean = rate(weight, prior)
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + weight + 1))
    return (hosts.select("host", "n", "bad", mean.alias("bad_rate"), F.greatest(F.lit(0.0), mean - Z * sd).alias("bad_rate_bound"))
            .withColumn("blocked", F.col("bad_rate_bound") > LIMIT))


def judge(pages: DataFrame, hosts: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, bad_rate_bound and verdict (the rule's, else the host's)."""
    added = ("host", "path", "rule", "verdict", "bad_rate_bound")
    url = F.col("url").cast("string")
    held = pages.withColumns({"_host": host_of(url), "_path": path_of(url)}).drop(*(c for c in added if c != "url"))
    held = held.withColumnsRenamed({"_host": "host", "_path": "path"})
    known = hosts.select("host", "bad_rate_bound", F.col("blocked").alias("_blocked"))
    met = hot_key_join(held, known, "host", "left", spread=["page_id"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("_blocked", F.lit(False)), "block").otherwise("allow")
    kept = [c for c in pages.columns if c not in added]
    return met.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate_bound")
