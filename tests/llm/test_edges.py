"""Every operator on nulls, empty, odd and very long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelpulse.llm import (chat_format, decontaminate, fingerprint, line_dedup, near_dup, packing, pii, quality,
                           token_counts, warc)

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, n_words bigint, contaminated boolean")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_line_dedup(odd_docs, odd_rows):
    got = line_dedup.drop_recurring_lines(odd_docs)
    assert got.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    by = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()): r for r in rows}
    assert len(by) > 10
    text = {r.doc_id: r.text for r in rows if r.doc_id in (1, 2, 3, 8, 14, 15)}
    assert text[1] is None and text[2] == "" and text[3] == " "
    assert text[14] == "mine" and text[15] == "first thing"
    thirteen = [r for r in rows if r.doc_id == 13 and r.n_dropped]
    assert [r.text for r in thirteen] == ["one line\nrepeated boiler plate line 12\nown"]
    assert {r.n_lines for r in rows if r.text is None} == {0}


def test_line_dedup_repeated_rows_are_one_document(spark):
    rows = [(1, "a b c d")] * 5 + [(2, "a b c d")]
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.filter("n_dropped > 0").count() == 0


def test_line_dedup_generalises_variable_words(spark):
    texts = [f"the known user {name} logged in at the main gate today" for name in ("ann", "bob", "cid", "dee")]
    texts += ["the known user base grew in size over the last year", "something else entirely with as many words as these"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: "", 4: texts[4], 5: texts[5]}


def test_line_dedup_several_templates_in_a_leaf(spark):
    """Two templates of one leaf lose what each would lose alone, also beside unlike lines of the leaf."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    one = [f"the known user {name(i)} logged in at the main gate today" for i in range(100)]
    two = [f"the known user {name(i)} was removed from every list last night" for i in range(100)]
    other = [" ".join(["the known user", *(f"{c}{name(i)}" for c in "abcdefgh")]) for i in range(50)]
    for texts, want in ((one, 99), (two, 99), (one + two, 198), (one + two + other, 198)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        assert line_dedup.drop_recurring_lines(docs).agg({"n_dropped": "sum"}).first()[0] == want


def test_line_dedup_long_lines_recur_in_two_documents(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    long, short = (" ".join(name(i) for i in range(n)) for n in (60, 49))
    docs = spark.createDataFrame([(1, f"{long}\n{short}"), (2, f"x\n{long}\n{short}")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert got == {1: f"{long}\n{short}", 2: f"x\n{short}"}


def test_masked_lines(spark):
    lines = ["", " \t ", "a1b  c\td\r", "12 x 3", "no digits  here ", "x" * 5000 + " 7", "٣ ½ é1", "\r", "4 \t", "\ta 5"]
    plain = [" ".join("<*>" if any(c in "0123456789" for c in t) else t for t in re.split("[ \t\r]+", x.strip(" \t\r")))
             for x in lines]
    rows = spark.createDataFrame([("\n".join(lines),), *((x,) for x in lines)], "text string")
    got = [r[0] for r in rows.select(line_dedup.masked(rows["text"])).collect()]
    assert [x.strip(" ") for x in got[0].split("\n")] == plain and [x.strip(" ") for x in got[1:]] == plain


def test_token_counts(odd_docs, odd_rows):
    got = token_counts.token_counts(odd_docs, VOCABULARY)
    assert got.columns[-1] == "n_tokens" and got.columns.count("n_tokens") == 1
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    assert {r.n_tokens for r in rows if not r.text} == {0}
    assert all(r.n_tokens > 0 for r in rows if r.text)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, score string")


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 0, "assistant", "b", "x"), (1, None, "system", "first", None),
            (1, 0, "user", None, "x"), (None, 5, "user", "lost", None), (None, 4, "assistant", "start", None),
            (2, 1, None, "### </turn>\n\\h \\\\t", None), (3, 0, "assistant", "y" * 100_000, None),
            (4, 0, "a: b###</turn>", ": ###", None), (4, 1, "assistant", "", None)]
    got = chat_format.format_replies(chat_format.linear_replies(conversations(spark, rows)))
    turns, spoken = chat_format.read_back(F.col("formatted"), F.col("loss_turns"))
    back = {r.conv_id: r for r in got.select("conv_id", "n_turns", turns.alias("turns"), spoken.alias("spoken")).collect()}
    said = {k: [(t.role, t.text) for t in r.turns] for k, r in back.items()}
    assert said[1] == [("system", "first"), ("assistant", "b"), ("user", ""), ("user", "")]
    assert said[None] == [("assistant", "start"), ("user", "lost")]
    assert said[2] == [("", "### </turn>\n\\h \\\\t")]
    assert said[4] == [("a: b###</turn>", ": ###"), ("assistant", "")]
    assert back[3].spoken == "y" * 100_000 and back[1].spoken == "b" and back[None].spoken == "start"
    assert all(len(r.turns) == r.n_turns for r in back.values())


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0),
            (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", "end", 1.0), (1, 6, 4, "assistant", "tie", 1.0),
            (1, 7, 99, "user", "orphan", 9.0), (1, 8, 9, "user", "loop", 50.0), (1, 9, 8, "user", "loop", 50.0)]
    schema = "conv_id bigint, message_id bigint, parent_id bigint, role string, text string, score double"
    got = chat_format.format_replies(spark.createDataFrame(rows, schema), branches=3)
    best = {r.branch: (r.leaf_id, r.score, r.n_turns) for r in got.collect()}
    assert best == {1: (7, 9.0, 1), 2: (5, 3.0, 4), 3: (6, 3.0, 4)}


def test_chat_long_chain(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}", None) for i in range(300)]
    got = chat_format.format_replies(chat_format.linear_replies(conversations(spark, rows))).collect()
    assert len(got) == 1 and got[0].n_turns == 300
    assert got[0].formatted == "".join(f"### {r}: {t}</turn>\n" for _, _, r, t, _ in rows)


def test_chat_empty(spark):
    assert chat_format.format_replies(chat_format.linear_replies(conversations(spark, []))).count() == 0


def test_quality(spark, odd_docs, odd_rows):
    known = labels(spark, [(5, 1, 0), (5, 1, 0), (7, 0, None), (8, None, 1), (None, 0, 0), (9, 0, 0), (11, 1, 0)])
    model = quality.fit(odd_docs, known)
    got = quality.score(odd_docs, model)
    rows = got.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    kept = quality.keep_good(odd_docs, known)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema


def sent_to_python(monkeypatch, df):
    """Schemas of the tables that go through mapInArrow from now on."""
    seen, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: seen.append(self.schema) or plain(self, *a, **b))
    return seen


def strings(kind):
    """String values of a row, those of its structs included."""
    return sum(strings(f.dataType) if f.dataType.typeName() == "struct" else f.dataType.typeName() == "string"
               for f in kind.fields)


def test_quality_sends_texts_once(spark, odd_docs, monkeypatch):
    known, seen = labels(spark, [(5, 1, 0), (9, 0, 0), (11, 1, 0)]), sent_to_python(monkeypatch, odd_docs)
    named = odd_docs.withColumn("score", F.lit("own")).withColumn("a.b", F.lit(1))
    kept = quality.keep_good(named, known)
    assert [strings(x) for x in seen] == [1, strings(named.schema)]       # to fit, to score
    assert kept.columns == named.columns
    model = quality.fit(odd_docs, known)
    want = [r.doc_id for r in quality.score(odd_docs, model).collect() if r.score >= quality.THRESHOLD]
    got = kept.select("doc_id", "score", "`a.b`").collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, want)) and {tuple(r)[1:] for r in got} <= {("own", 1)}


def test_decontamination_sends_texts_once(spark, odd_docs, monkeypatch):
    items, seen = bench(spark, [(1, "a b c", 1, True)]), sent_to_python(monkeypatch, odd_docs)
    docs = odd_docs.select("doc_id", "text", "lang", "n_chars")
    both = decontaminate.contamination(docs, items, keep=tuple(docs.columns))
    plain = decontaminate.contamination(docs, items)
    assert [strings(x) for x in seen] == [2, 1]       # text and lang, text
    cols = ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"]
    assert sorted(map(repr, both.select(cols).collect())) == sorted(map(repr, plain.select(cols).collect()))


def test_quality_without_labels(spark, odd_docs):
    model = quality.fit(odd_docs, labels(spark, []))
    assert {r.score for r in quality.score(odd_docs, model).collect()} == {0.5}


def test_decontamination(spark, odd_docs, odd_rows):
    items = bench(spark, [(1, None, 1, True), (2, "", 1, True), (3, "C. D", 0, False), (3, "c d", 0, False),
                          (None, "no ID", 0, None), (4, "w1x nothing like this", 0, None)])
    rows = decontaminate.contamination(odd_docs, items).collect()
    assert len(rows) == len(odd_rows)
    hit = {r.doc_id: (r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans]) for r in rows if r.contaminated}
    assert hit == {11: (5, 2, ["3"], [(4, 7)]), None: (3, 2, [""], [(0, 5)])}
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3, 4)} == {0}


def test_decontamination_in_blocks_is_the_same(spark, odd_docs):
    items = bench(spark, [(i, t, 0, None) for i, t in enumerate(["a b c", "c d e", "no id", "w1x w2x", "boiler plate"])])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontaminate.contamination(odd_docs, items)) == key(
        decontaminate.contamination(odd_docs, items, block_chars=6))


def test_decontamination_without_items(spark, odd_docs):
    assert decontaminate.contamination(odd_docs, bench(spark, [])).filter("contaminated").count() == 0


def test_near_dup(odd_docs, odd_rows):
    rows = near_dup.classes(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.class_id)
    assert found[5] == found[6] == found[7] == {5}
    assert found[1] == {1} and found[2] == {1}          # null is the empty text
    assert found[3] == {3} and found[4] == {4}          # no words: only equal texts are one class
    assert found[13] == {13}
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, 1, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14, 15]


def test_warc(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/\r\nb", big, "c"), (1, None, big, "c"), (1, None, big, "c"), (None, "u", big, "c"),
            (2, "u", "short", "c"), (4, "u", "short", "c"), (5, "u", None, "c"), (6, "u", "", "c"),
            (7, "u", "é" * 300_000, "c"), (None, "u", "z" * 300, "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    folder = warc.scratch_path(spark, "test-warc")
    got = warc.read(warc.write(pages, folder), folder).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert {(r.record_type, r.refers_to) for r in by[1]} == {("response", None)} and len(by[1]) == 2
    assert [(r.record_type, r.refers_to, r.payload, r.payload_bytes) for r in by[3]] == [("revisit", 1, None, len(big))]
    assert by[3][0].url == "http://a/%0D%0Ab" and by[1][0].url is None
    assert sorted((r.record_type, r.refers_to or 0) for r in by[None]) == [("response", 0), ("revisit", 1)]
    assert all(by[i][0].record_type == "response" for i in (2, 4, 5, 6, 7))
    assert by[7][0].payload.decode() == "é" * 300_000 and by[5][0].payload_bytes == 0
    for r in got:
        if r.payload is not None:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = warc.scratch_path(spark, "test-warc")
    assert warc.read(warc.write(pages, folder), folder).count() == 0


def test_packing(odd_docs, odd_rows):
    rows = packing.packed_documents(odd_docs, BPE, with_ids=True).collect()
    assert {r.ids for r in rows if r.doc_id in (1, 2)} == {(2).to_bytes(4, "little")}
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in whole.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.piece == 0 for r in rows) == len(odd_rows)


def test_fingerprints(odd_docs, odd_rows):
    rows = fingerprint.fingerprints(odd_docs, per_slice=3).collect()
    assert len(rows) == len(odd_rows)
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = [r.fingerprint for r in rows if r.doc_id == 6]
    assert len(same) == 2 and len({*same, *(r.fingerprint for r in rows if r.doc_id == 5)}) == 1


def test_fingerprint_single_document(spark):
    one = spark.createDataFrame([(1, "hello big world of texts")], "doc_id bigint, text string")
    row = fingerprint.fingerprints(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"hello big world hello bi").hexdigest()


@pytest.fixture(scope="module")
def tagger(odd_docs):
    return pii.fit(odd_docs)


def test_personal_data(odd_docs, odd_rows, tagger):
    got = pii.personal_data(odd_docs, tagger)
    assert got.columns.count("spans") == 1
    rows = pii.digest(got).collect()
    assert len(rows) == len(odd_rows)
    twelve = next(r for r in rows if r.doc_id == 12)
    assert (twelve.n_email, twelve.n_ip, twelve.n_card, twelve.n_phone) == (1, 1, 1, 1)
    assert "email:9:17" in twelve.spans.split(",")
    assert {(r.spans, r.base_sha256) for r in rows if r.doc_id in (1, 2, 3)} == {("", hashlib.sha256(b"").hexdigest())}


def test_empty_tables(spark, empty_docs, tagger):
    assert line_dedup.drop_recurring_lines(empty_docs).count() == 0
    assert token_counts.token_counts(empty_docs, VOCABULARY).count() == 0
    assert quality.score(empty_docs, quality.fit(empty_docs, labels(spark, [(1, 1, 1)]))).count() == 0
    assert decontaminate.contamination(empty_docs, bench(spark, [(1, "a b", 0, None)])).count() == 0
    assert near_dup.classes(empty_docs).count() == 0
    assert near_dup.keep_one(empty_docs).count() == 0
    assert packing.packed_documents(empty_docs, BPE).count() == 0
    assert fingerprint.fingerprints(empty_docs).count() == 0
    assert pii.personal_data(empty_docs, tagger).count() == 0
    assert pii.personal_data(empty_docs).count() == 0
