"""URL filter, collocations and prefix trie against plain versions on planted and random rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelpulse.llm import collocations, prefix_trie, sql, url_filter

CLASH = "host string, path string, rank bigint, score double, shard int, n bigint, _pos string"
EXTRA = ("h", "p", 1, 0.5, 2, 3, "x")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# -- url filter ----------------------------------------------------------------------------------------------------

def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for does, text in url_filter.RULES:
        at, _, rest = text.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = does, text
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_rules_hosts_and_paths(spark):
    urls = [None, "", "no host", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "x://net", "x://net/",
            "https://user@sub.net:80/a", "http://planet/", "http://b.org/fr/", "http://b.org/fr?x", "a://b://c.com/d", "http://É.COM/de/",
            "http://example.com/de/1", "http://notexample.com/de/1", "http://x.example.com/de", "http://h?q=/net/", "http://h#f/a", "http://\n.net/a\nb"]
    pages = spark.createDataFrame([(i, u, *EXTRA) for i, u in enumerate(urls)] + [(None, None, *EXTRA), (4, urls[4], *EXTRA)],
                                  f"page_id bigint, url string, {CLASH}")
    hosts = url_filter.reputation(spark.createDataFrame([("", 0, 0)], "host string, n bigint, bad bigint"))
    got = url_filter.judge(pages, hosts)
    assert got.columns.count("host") == got.columns.count("path") == 1 and "score" in got.columns
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(
        [(i, *plain_rule(u)) for i, u in enumerate(urls)] + [(None, *plain_rule(None)), (4, *plain_rule(urls[4]))], key=str)


def plain_posterior(outcomes):
    """host -> lower bound, with loops instead of joins."""
    def pooled(level):
        out = defaultdict(lambda: [0, 0])
        for h, n, b in outcomes:
            out[level(h)][0] += n
            out[level(h)][1] += b
        return out

    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    total = [sum(x[1] for x in outcomes), sum(x[2] for x in outcomes)]
    above, rate = {None: (total[1] + 0.5) / (total[0] + 1)}, None
    for level, up in ((suffix, lambda k: None), (domain, lambda k: k.split(".")[-1]), (lambda h: h, domain)):
        counts = pooled(level)
        m = {k: above[up(k)] for k in counts}
        over = sum(n * (b / n - m[k]) ** 2 - m[k] * (1 - m[k]) for k, (n, b) in counts.items() if n)
        scale = sum((n - 1) * m[k] * (1 - m[k]) for k, (n, b) in counts.items() if n)
        w = 1000.0 if scale == 0 or over <= 0 else min(1000.0, max(1.0, scale / over - 1))
        rate = {k: ((b + w * m[k]) / (n + w), n + w) for k, (n, b) in counts.items()}
        above = {k: v[0] for k, v in rate.items()}
    return {k: max(0.0, m - url_filter.Z * (m * (1 - m) / (t + 1)) ** 0.5) for k, (m, t) in rate.items()}


def planted(rng):
    out = []
    for i in range(60):
        bad = i % 6 == 0
        n = rng.choice([0, 1, 3, 40])
        out.append((f"h{i}.{'spam' if bad else 'site'}{i % 4}.{'top' if i % 3 else 'com'}", n, round(n * (0.95 if bad else 0.05))))
    return out


def test_reputation_equals_plain_loops_and_blocks_bad_hosts(spark):
    outcomes = planted(random.Random(4))
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(outcomes, "host string, n bigint, bad bigint")).collect()}
    want = plain_posterior(outcomes)
    assert set(got) == set(want)
    for host, bound in want.items():
        assert got[host].bad_rate_bound == pytest.approx(bound, rel=1e-9, abs=1e-12)
        assert got[host].blocked == (bound > url_filter.LIMIT)
    assert {h for h, n, b in outcomes if n == 40 and b > 30} <= {h for h, r in got.items() if r.blocked}
    assert not any(got[h].blocked for h, n, b in outcomes if n and not b)


def url_tables(spark):
    docs, labels, pages = [], [], []
    for i in range(90):
        words = " ".join(f"{chr(97 + i % 26)}{i}w{k}" for k in range(12))
        docs.append((i, words))
        labels.append((i, 0 if i % 3 == 0 else 1, 1 if i % 10 == 0 else None))
        host = "bad.spam.org" if i % 3 == 0 else f"{'Www' if i % 2 else 'm'}.good{i % 5}.org"
        pages.append((i, f"https://{host}/p{i}", f"<html><h1>no</h1><article><h1>T</h1><p>{words[:30]}<b>{words[30:]}</b> &amp; more</p></article>"))
    docs += [(None, None), (200, ""), (3, "a3w0 repeated id"), (201, "one two")]
    labels += [(None, 0, 0), (200, 0, 0), (201, None, 1), (5, 1, 0)]
    pages += [(300, None, None), (301, "x://y.org/", ""), (302, "x://y.org/", "one two"), (300, None, None)]
    return (spark.createDataFrame(pages, "page_id bigint, url string, html string"), spark.createDataFrame(docs, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_url_filter_equals_sql_with_blocked_hosts(spark):
    pages, docs, labels = url_tables(spark)
    con = duckdb.connect()
    for name, df in (("pages", pages), ("documents", docs), ("labels", labels)):
        con.register(name, df.toArrow())
    got = url_filter.judge(pages, url_filter.reputation(url_filter.host_outcomes(pages, docs, labels)))
    cols = ("page_id", "host", "path", "rule", "verdict")
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql.OP11})").fetchall(), key=str)
    assert rows_of(got, *cols) == want
    assert {r[1] for r in want if r[4] == "block"} == {"bad.spam.org", "m.good0.org"}  # all of its pages are toxic


def test_url_filter_compares_whole_texts(spark):
    same = "one two three four five six seven eight"
    docs = [(1, f"{same} good ending"), (2, f"{same}, Bad ending"), (3, f"{same} bad")]
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 0)]
    pages = [("equal.org", f"<b>{same}</b> good ending"), ("longer.org", f"{same} bad ending and more"), ("short.org", f"{same} bad end"),
             ("none.org", same), ("none.org", f"{same} goodending"), ("none.org", None)]
    pages = [(i, f"http://{host}/", html) for i, (host, html) in enumerate(pages)]
    got = url_filter.host_outcomes(spark.createDataFrame(pages, "page_id bigint, url string, html string"),
                                   spark.createDataFrame(docs, "doc_id bigint, text string"),
                                   spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {(r.host, r.n, r.bad) for r in got.collect()} == {
        ("equal.org", 1, 0), ("longer.org", 1, 1), ("short.org", 1, 0), ("none.org", 0, 0)}


def test_url_filter_texts_that_only_open_alike_do_not_meet(spark, monkeypatch):
    same = [f"s{i}" for i in range(9)]
    texts = [same + [f"d{i}w{j}" for j in range(i % 40 + 4)] for i in range(120)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(120, " ".join(same)), (121, " ".join(texts[7][:-2]))]
    labels = [(i, i % 2, 0) for i in range(len(docs))]
    pages = [same + [f"p{i}w{j}" for j in range(50)] for i in range(60)]
    pages += [texts[7] + ["and", "more"], texts[7][:-1], texts[8], same[:8], same[:8] + ["x"]]
    met, begun = [], url_filter._begun
    monkeypatch.setattr(url_filter, "_begun", lambda t: met.extend(begun(t).collect()) or begun(t))
    got = url_filter.host_outcomes(
        spark.createDataFrame([(i, f"http://h{i}.org/", " ".join(p)) for i, p in enumerate(pages)], "page_id bigint, url string, html string"),
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    outcome = {tuple(t.split()): 1 - i % 2 for i, t in docs}
    want = set()
    for i, p in enumerate(pages):
        fits = [n for n in range(1, len(p) + 1) if tuple(p[:n]) in outcome and (n == len(p) or n >= url_filter.OPENING)]
        want.add((f"h{i}.org", len(fits[-1:]), outcome[tuple(p[:fits[-1]])] if fits else 0))
    assert {(r.host, r.n, r.bad) for r in got.collect()} == want
    # A page meets few lengths besides those of texts that share its anchor; all with its opening are over 40 a page.
    assert len(met) <= 5 * len(pages)


def test_url_filter_anchors():
    for n in range(url_filter.OPENING, 600):
        assert url_filter.anchor_length(n) in url_filter.anchor_lengths(n + 1)
        assert n / 1.5 < url_filter.anchor_length(n) <= n
    joined = b"a bc d  e".replace(b"  ", b" ")
    assert url_filter.first_words(joined, [1, 3, 4]) == [hashlib.md5(x).digest() for x in (b"a", b"a bc d", joined)]


def test_url_filter_empty_tables(spark):
    pages, docs, labels = (t.limit(0) for t in url_tables(spark))
    assert url_filter.judge(pages, url_filter.reputation(url_filter.host_outcomes(pages, docs, labels))).count() == 0
    full = url_tables(spark)[0]
    got = url_filter.judge(full, url_filter.reputation(url_filter.host_outcomes(full, docs, labels)))
    assert {r.verdict for r in got.collect()} == {"allow"}


# -- collocations ----------------------------------------------------------------------------------------------------

def plain_collocations(docs):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        found = {p: n for p, n in c.items() if len(p) > 1 and n >= 30}
        inside = Counter()
        for p, n in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], n)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((Fraction(2_000_000 * a, c[p[:k]] + c[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out, key=str)


def random_docs(rng, n):
    words = ["the", "The", "of", "New", "york", "city", "hall", "a\x01", "a", "b", "über", "日本", "x\x1fy", "it's", "a b".replace(" ", "\u00a0")]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append(rng.choice(["new york city hall", "new york", "\tof  the", rng.choice(words), rng.choice(words), ".", ",\n", "!\x0b", "\r"]))
        docs.append((rng.choice(["en", "en", "de", None]), " ".join(parts)))
    return docs + [(None, None), ("de", ""), ("en", "."), ("fr", "one"), ("en", "new york city hall " * 3000)]


@pytest.mark.parametrize("seed,block,bits,parts", [(1, 1 << 20, 1 << 16, 1), (2, 500, 1 << 16, 5), (3, 3000, 64, 3)])
def test_collocations_equal_plain_counts(spark, seed, block, bits, parts):
    """Any block size, a filter so small that it lets nearly all pass, and streams cut into many partitions."""
    docs = random_docs(random.Random(seed), 400)
    df = spark.createDataFrame([(lang, text, *EXTRA) for lang, text in docs], f"lang string, text string, {CLASH}").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = collocations.collocations(df, block_bytes=block, filter_bits=bits)
        rows = rows_of(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(rows) > 20 and rows == plain_collocations(docs)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).count() == 0


def test_lockstep_across_any_cut():
    """Streams cut between any two rows give the same beginnings and extensions."""
    counts = {("a",): 99, ("a", "b"): 90, ("a", "b", "c"): 80, ("a", "b", "d"): 85, ("a", "e"): 40, ("b",): 95, ("b", "c"): 81}
    keys = sorted(counts)
    for cut in range(len(keys) + 1):
        seen, gained = {}, Counter()
        for shard, part in enumerate((keys[:cut], keys[cut:])):
            opened = {shard: [(list(part[0][:k]), counts[part[0][:k]]) for k in range(1, len(part[0]))]} if part else {}
            rows = ({"shard": shard, "lang": "x", "words": list(k), "n": counts[k], "later": False, "extension": 0} for k in part)
            for node, before in collocations.lockstep(rows, opened):
                gained[tuple(node.words)] = max(gained[tuple(node.words)], node.extension)
                if node.row:
                    seen[tuple(node.words)] = before
        assert seen == {k: [counts[k[:i]] for i in range(1, len(k))] for k in keys}
        assert gained == Counter({k: max([n for p, n in counts.items() if p[:-1] == k], default=0) for k in keys})


def test_filter_keeps_all_it_was_given():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    at = np.unique(collocations.Filter.places(h, 1 << 14))
    f = collocations.Filter(1 << 14)
    np.bitwise_or.at(f.words, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    assert f.passed(h).all()


# -- prefix trie -----------------------------------------------------------------------------------------------------

def plain_trie(rows):
    """Nodes of the rebuilt conversations by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def random_turns(rng, n):
    rows = []
    for c in range(-n // 4, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, 12)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "é", "", None])))
    rows += [(None, 0, "user", "lost"), (1, 3, "user", "twice"), (1, 3, "user", "twice"), (2, 0, "user", "z" * 100_000)]
    return rows + [(1000 + i, 0, "user", "same") for i in range(200)]


@pytest.mark.parametrize("seed,turns,ids", [(1, 1_000_000, 4096), (2, 60, 7), (3, 15, 1)])
def test_trie_equals_plain_prefixes(spark, monkeypatch, seed, turns, ids):
    """Whole trees, and shards so small that copies and paths cross them."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", ids)
    rows = random_turns(random.Random(seed), 60)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"conv_id bigint, turn bigint, role string, text string, {CLASH}").repartition(3)
    got = prefix_trie.trie(prefix_trie.with_lent_openings(prefix_trie.encoded_turns(df)))
    assert rows_of(got, *prefix_trie.COLUMNS) == plain_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(prefix_trie.with_lent_openings(prefix_trie.encoded_turns(empty))).count() == 0


def test_median_order_and_balance():
    assert sorted(prefix_trie.median_order(100)) == list(range(100))
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.median_order(1023):
        tree.insert([i], [1], 1, i)

    def height(node):
        return 0 if not node else 1 + max(height(tree.lo[node]), height(tree.hi[node]))

    assert height(tree.eq[0]) == 10


def test_boundary_merge_of_any_cut():
    """The rows of shards cut anywhere merge to the nodes of one shard."""
    seqs = sorted([[1], [1], [1, 2], [1, 2, 3], [1, 4], [2], [2, 2], [2, 2], []])
    items = [(s, i) for i, s in enumerate(seqs)]

    def nodes(cuts):
        shards, out, edges = np.split(np.arange(len(items)), cuts), [], []
        for no, part in enumerate(shards):
            groups = []
            for s, c in (items[i] for i in part):
                if groups and groups[-1][0] == s:
                    groups[-1][2].append(c)
                else:
                    groups.append((s, [1] * len(s), [c]))
            if groups:
                found = list(prefix_trie.shard_rows(no, groups))
                edges += [r for r in found if r["kind"] == "paths"]
                out += [r for r in found if r["kind"] == "node"]
        out += [r for r in prefix_trie.merged_rows(iter(edges)) if r["kind"] == "node"]
        return sorted((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in out)

    whole = nodes([])
    assert (0, 0, 9, 2, 3, 8) in whole and len(whole) == 7
    for a in range(len(items) + 1):
        for b in range(a, len(items) + 1):
            assert nodes([a, b]) == whole
