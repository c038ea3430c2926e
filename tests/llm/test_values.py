"""Registered queries on the smallest tables against SQL, a library's own result or a brute-force version."""

import base64
import collections
import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from reelpulse.llm import fingerprint, near_dup, packing, pii, quality, sql, token_counts, tokens, warc
from reelpulse.llm.queries import QUERIES
from tests.helpers import duck, duck_rows, same, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql(spark, con, name):
    assert same(spark_rows(QUERIES[name](spark, SF)), duck_rows(con, sql.ORACLES[name]))


def unigram(entries):
    made = Tokenizer(models.Unigram(entries, unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=False)
    return made


def test_token_counts_are_the_tokenizers(spark, docs):
    made = unigram(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    want = {i: len(made.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op2_token_counts"](spark, SF).collect()} == want


def test_token_counts_of_runs_of_spaces():
    """Entries of several spaces match; the tokenizer here reads the whole text without cuts."""
    entries = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    made, counter = unigram(entries), token_counts.Counter(entries)
    assert counter.cuts and any(set(p) == {token_counts.SPACE} and len(p) > 8 for p, _ in entries)
    rng = random.Random(4)
    texts = ["def f(x):\n" + " " * 16 + "return x", "  lead", "trail   ", " " * 40, "a  b   c    d\n\n      e",
             *("".join(rng.choices(["  ", " ", "    ", "\n", "the", "word", "x9", "é"], k=30)) for _ in range(60))]
    for text in texts:
        assert counter.count(text) == len(made.encode(text, add_special_tokens=False).ids), text


def test_token_count_ties():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {"".join(rng.choices("ab▁é", k=rng.randint(1, 4))) for _ in range(14)}
        entries = [("<unk>", 0.0), *((f"<0x{i:02X}>", -50.0) for i in range(256)),
                   *((p, float(rng.choice([-1, -2, -3]))) for p in pieces)]
        made, counter = unigram(entries), token_counts.Counter(entries, most=5)
        for _ in range(40):
            text = "".join(rng.choices("ab éc", k=rng.randint(0, 20)))
            assert counter.count(text) == len(made.encode(text, add_special_tokens=False).ids), text


def test_quality_held_out(spark, con):
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").collect()}
    known = dict(duck("/root/testdata/sf0.01").execute("SELECT doc_id, quality FROM labels").fetchall())
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(r.predicted, known[i]) for i, r in got.items() if r.held_out and i in known]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) >= 0.97
    good = [p for p, q in held if q == 1]
    assert np.mean(good) >= 0.97


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 5, 2])
    score, pairs = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    got, expected = quality.Chains(sizes).marginals(score, pairs)
    want, seen, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, good, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2 ** n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(score[at + i] for i in range(n) if y[i]) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moves[a, b] += w
        want += list(good / total)
        seen += moves / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, seen)


def test_near_dup_looks_up_no_shingles_of_one_class(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(60):                                 # one class, each member with its own edits
        t = list(base)
        for j in rng.sample(range(100), 3):
            t[j] = f"e{i}x{j}"
        texts.append((" ".join(t), "one"))
    tail = [f"o{i}" for i in range(95)]
    texts += [(" ".join(base[:5] + tail), "two"), (" ".join(tail), "three"), ("", "four")]
    rows = [(bytearray(i.to_bytes(16, "big")), t, bytearray(hashlib.md5(c.encode()).digest())) for i, (t, c) in enumerate(texts)]
    held = spark.createDataFrame(rows, "key binary, text string, label binary").repartition(3)
    sent = spark.sparkContext.broadcast(near_dup.Weights(np.empty(0, np.uint64), np.empty(0), len(texts), 1.0))
    got = near_dup._leading(held, sent, 0.8).collect()
    # Texts two and three share nearly all, the class of sixty one shingle with one of them, but for collisions of slots.
    assert {bytes(r.key)[-1] for r in got} >= {60, 61}
    assert len(got) < 2 * 60
    pairs = near_dup._across(held.select("key", "label"), held.select("key", "text"), sent, 0.8).collect()
    assert {(bytes(r.a)[-1], bytes(r.b)[-1]) for r in pairs} == {(60, 61)}


def test_near_dup_classes(spark, docs):
    """Classes from all pairs of texts that share a shingle."""
    hasher, ids = near_dup.Hasher(), sorted(docs)
    sets = [hasher.shingles(docs[i]) for i in ids]
    every, count = np.unique(np.concatenate([h for h, _ in sets]), return_counts=True)
    floor = max(1.0, count.sum() / near_dup.TABLE)
    weights = near_dup.Weights(every[count > floor], count[count > floor].astype(float), len(ids), floor)
    vectors = [(h, weights.of(h, n)) for h, n in sets]
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if docs[ids[a]] == docs[ids[b]] or near_dup.jaccard(vectors[a], vectors[b]) >= near_dup.SIMILARITY:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    want = {ids[i]: ids[label[i]] for i in range(len(ids))}
    assert {r.doc_id: r.class_id for r in QUERIES["op6_near_dup"](spark, SF).collect()} == want


def test_document_frequencies_above_the_floor_are_exact(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dup, "TABLE", 3000)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 40)
    texts = spark.createDataFrame([(t,) for t in docs.values()], "text string").repartition(3)
    got = near_dup.document_frequencies(texts)
    hasher = near_dup.Hasher()
    every, count = np.unique(np.concatenate([hasher.shingles(t)[0] for t in docs.values()]), return_counts=True)
    floor = max(1.0, count.sum() / 3000)
    assert got.hashes.tolist() == every[count > floor].tolist() and len(got.hashes) > 0
    assert np.allclose(got.logs, near_dup.SMOOTHING + np.log(len(docs) / count[count > floor]) / np.log(len(docs)))


def test_large_groups_of_near_copies(spark):
    """More near copies than SMALL, and as many texts that only share a passage with them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    base, passage = [word() for _ in range(150)], [word() for _ in range(30)]
    texts = []
    for _ in range(90):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(30))]) for _ in range(90)]
    rows = near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    classes = collections.Counter(r.class_id for r in rows)
    assert classes[0] == 90 and all(classes[i] == 1 for i in range(90, 180))


def test_links_inside_large_buckets(spark):
    """Pairs of near copies among many texts that share most of their words, and so their buckets, with all."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    passage, texts = [word() for _ in range(120)], []
    for _ in range(60):
        own = [word() for _ in range(26)]
        changed = [word() if i in (7, 18) else w for i, w in enumerate(own)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *changed])]
    hasher = near_dup.Hasher()
    sets = [hasher.shingles(t) for t in texts]
    every, count = np.unique(np.concatenate([h for h, _ in sets]), return_counts=True)
    weights = near_dup.Weights(every[count > 1], count[count > 1].astype(float), len(texts), 1.0)
    vectors = [(h, weights.of(h, n)) for h, n in sets]
    shared = [set(enumerate(near_dup.bands(*v))) for v in vectors]
    near = {(a, b) for b in range(len(texts)) for a in range(b) if near_dup.jaccard(vectors[a], vectors[b]) >= near_dup.SIMILARITY}
    assert near == {(a, a + 1) for a in range(0, 120, 2)}
    sizes = collections.Counter(x for s in shared for x in s)
    only_large = [(a, b) for a, b in near if shared[a] & shared[b] and all(sizes[x] > near_dup.SMALL for x in shared[a] & shared[b])]
    assert len(only_large) > 3
    rows = near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    found = {r.doc_id: r.class_id for r in rows}
    assert all(found[a] == found[b] for a, b in near if shared[a] & shared[b])
    assert len({found[a] for a in range(0, 120, 2)}) == 60


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    w = rng.uniform(0.5, 6, 400)
    a, b = (h[:320], w[:320]), (h[80:], w[80:] * rng.choice([1, 2], 320))
    want, seeds, agree = near_dup.jaccard(a, b), near_dup._SEEDS, []
    try:
        for k in range(40):
            near_dup._SEEDS = near_dup.mix(seeds + np.uint64(977 * k + 1))
            agree.append((near_dup.samples(*a) == near_dup.samples(*b)).mean())
    finally:
        near_dup._SEEDS = seeds
    assert abs(np.mean(agree) - want) < 0.06


def test_warc_reader_refuses_damage():
    record = warc.pack(1, "http://a/", b"x" * 150, hashlib.sha256(b"x" * 150).hexdigest(), 150, None)
    assert [warc.unpack(m)["payload"] for m in warc.members(io.BytesIO(record * 3), 7)] == [b"x" * 150] * 3
    plain = zlib.decompress(record, 31)
    for bad in (plain.replace(b"xxx", b"xyx", 1), plain[:-4], plain + b"\r\n", plain.replace(b"Length: 2", b"Length: 3", 1)):
        with pytest.raises(warc.DamagedRecord):
            warc.unpack(bad)
    with pytest.raises(warc.DamagedRecord):
        list(warc.members(io.BytesIO(record[:-9])))


def test_packing_ids_and_places(spark, docs):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op8_packing"](spark, SF).collect()
    want = {}
    for i, t in docs.items():
        ids = np.asarray([*made.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, piece] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    assert len(ends) <= -(-sum(ends.values()) // 1024) + 2


def test_fullest_is_optimal():
    rng = random.Random(6)
    for _ in range(200):
        items = sorted({rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}.items())
        slack = rng.randint(1, 60)
        sums = {0}
        for length, count in items:
            sums = {s + k * length for s in sums for k in range(count + 1)}
        got = packing.fullest(items, slack)
        assert sum(a * b for a, b in got.items()) == max(s for s in sums if s <= slack)
        assert all(k <= dict(items)[a] for a, k in got.items())


def test_ids_are_the_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    parts = ["a", "b", "é", "\n", " ", "  ", ".", "'", "'s", "!!", "1", "日", "\t", "-", "word", "x.\ny", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    for text, got in zip(texts, made.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(made.encode(["a<|endoftext|>b"])[0], "<u4").tolist()[1] == plain.token_to_id("<|endoftext|>")


def test_fingerprints(spark, docs):
    ids = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, SF).collect()}
    for n, i in enumerate(ids):
        text, after = docs[i] or "", docs[ids[(n + 1) % len(ids)]] or ""
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert base64.b64decode(r.fingerprint) == fingerprint.chain(text).tobytes()
        assert base64.b64decode(r.edited_fingerprint) == fingerprint.chain(changed).tobytes()
        assert r.near_next == fingerprint.likeness(fingerprint.chain(text), fingerprint.chain(after))
    near, far = [r.near_edited for r in rows.values()], [r.near_next for r in rows.values()]
    assert np.median(near) > 0.5 and np.median(far) < 0.1


def test_near_copies_across_the_limit_of_short_texts():
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    edited, copied, other = [], [], []
    for _ in range(30):
        text, after = words(200), words(200)
        a, b = fingerprint.chain(text[:505]), fingerprint.chain(text[:520])
        copied.append(min(fingerprint.likeness(a, b), fingerprint.likeness(b, a)))
        other.append(fingerprint.likeness(a, fingerprint.chain(after[:520])))
        changed = fingerprint.edited(text[:640], after[:40])
        assert len(changed) < fingerprint.SHORT
        edited.append(fingerprint.likeness(fingerprint.chain(text[:640]), fingerprint.chain(changed)))
    assert min(copied) > 0.7 and np.median(edited) > 0.5 and np.median(other) < 0.2
    for n in (0, 5, 63, 64, 100, 511, 512):
        assert fingerprint.chains([text[:n], after])[0].tolist() == fingerprint.chain(text[:n]).tolist()


def test_window_entropies():
    raw = np.frombuffer(("ab" * 40 + "The quick brown fox jumps over the lazy dog. " * 5).encode(), np.uint8)
    want = []
    for i in range(len(raw) - fingerprint.WINDOW + 1):
        _, n = np.unique(raw[i:i + fingerprint.WINDOW], return_counts=True)
        want.append(-(n / n.sum() * np.log2(n / n.sum())).sum())
    assert np.allclose(fingerprint.entropies(raw), want)


def test_features_do_not_depend_on_blocks(docs, monkeypatch):
    text = "\n".join(docs[i] or "" for i in sorted(docs)[:20])
    whole = fingerprint.features(text)
    monkeypatch.setattr(fingerprint, "_BLOCK", 1500)
    assert whole.tolist() == fingerprint.features(text).tolist()


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            if low <= len(digits) <= high and (kind == 3 or check % 10 == 0):
                found.append((m.start(), kind, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(found)]


def test_base_spans_are_the_patterns(docs):
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.z", "1", "12", "255", "0", ".", "1.2.3.4", "+1", " ", "-", "(", ")", "4111111111111111",
             "٣", "é", "_", "\n", "300.1.1.1", "00"]
    for text in [*(t or "" for t in docs.values()), *("".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000))]:
        assert pii.base_spans(text) == plain_spans(text), text


def test_network_gradient():
    net = pii.Network.fresh(3)
    rng = np.random.default_rng(0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = rng.integers(0, pii.CHARS, (5, 2)), rng.integers(0, pii.TAGS, (5, 2))

    def loss():
        e, _ = net.emissions(x)
        e = e.astype(np.float64)
        total = 0.0
        for n in range(2):
            score = e[0, n]
            for t in range(1, 5):
                score = np.logaddexp.reduce(score[:, None] + net.weights["move"], axis=0) + e[t, n]
            gold = sum(e[t, n, y[t, n]] for t in range(5)) + sum(net.weights["move"][a, b] for a, b in zip(y[:, n], y[1:, n]))
            total += np.logaddexp.reduce(score) - gold
        return total / 2

    slopes = net.slopes(x, y)
    for name, at in (("move", (1, 2)), ("bias", (3,)), ("out_b", (4, 1)), ("re_f", (2, 9)), ("in_b", (x[2, 1], 5))):
        step = 1e-3
        net.weights[name][at] += step
        up = loss()
        net.weights[name][at] -= 2 * step
        down = loss()
        net.weights[name][at] += step
        assert abs((up - down) / (2 * step) - slopes[name][at]) < 2e-3, name


def test_personal_data_finds_held_out_spans(spark):
    """Trained on one table, the network alone finds most base spans of documents of another."""
    net = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 1").collect()]
    hit = total = 0
    for text, got in zip(texts, pii.tag_texts(net, texts)):
        base = pii.base_spans(text)
        hit, total = hit + sum(s in got for s in base), total + len(base)
    assert total > 100 and hit / total > 0.8


def test_windows_cover_every_trigger():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices("aaaaaaaaaaaaaaaaaaaaaaa1@", k=rng.randint(0, 300)))
        last = max(0, -(-(len(text) - pii.WIDTH) // pii.STRIDE))
        want = [k * pii.STRIDE for k in range(last + 1) if re.search("[0-9@]", text[k * pii.STRIDE:k * pii.STRIDE + pii.WIDTH])]
        assert pii.window_starts(text) == want


def test_pipeline_stages(spark):
    """Each stage's rows from its own input, by plain versions of the stages' rules."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, kept, SF)
        assert got.columns == columns and got.schema == docs.schema
        before = {r.doc_id: r for r in kept.collect()}
        got = spark.createDataFrame(got.collect(), docs.schema)
        after = {r.doc_id: r for r in got.collect()}
        if name == "quality":
            model = quality.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"))
            score = dict(zip(before, quality.score_texts(model, [r.text for r in before.values()])))
            assert after == {i: r for i, r in before.items() if score[i] >= 0.5}
        elif name == "line_dedup":
            assert after.keys() == before.keys()
            assert all(r.n_chars == len(r.text) for r in after.values())
            seen = collections.Counter(line for r in before.values() for line in {*r.text.split("\n")})
            lines = collections.Counter(line for r in after.values() for line in r.text.split("\n"))
            assert all(lines[x] <= 1 for x, n in seen.items() if n >= 3 and len(x.split()) >= 3)
        elif name == "near_dedup":
            classes = near_dup.classes(kept).collect()
            assert after == {i: before[i] for i in {r.class_id for r in classes}}
        else:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            grams = {tuple(w[i:i + 10]) for w in (words(r.text) for r in bench) for i in range(max(1, len(w) - 9))}
            hit = {i for i, r in before.items() for w in [words(r.text)] if any(tuple(w[k:k + 10]) in grams for k in range(len(w)))}
            assert after == {i: r for i, r in before.items() if i not in hit}
        assert 0 < len(after) <= len(before)
        kept = got
    packed = pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "reelpulse")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, name)).read(), name


def test_components_of_chains_stars_and_random_edges(spark):
    from reelpulse.llm.components import components

    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)] + [(300, 300)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(45)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges * 2, "a bigint, b bigint"))
    assert {r.key: r.label for r in got.collect()} == label
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
