"""Line dedup by log templates.

Lines are parsed by a tree of fixed depth: the number of tokens, then the first ``depth`` tokens, lead to a
leaf.  Tokens with a digit are variable fields from the start.  A leaf holds any number of templates.  The support
of a token is how many of the leaf's distinct lines have it at its position, and a line's level is the highest
support that at least ``similarity`` of its tokens reach: about as many lines as share its template.  A token with
more than half of that level is constant, any other is a variable field; lines with the same constants at the same
positions share a template.  A line whose level is 1 is a template of its own.

A template that occurs in ``min_docs`` or more documents recurs, one of ``long_tokens`` or more tokens already in
``long_docs``: its first occurrence stays and all others are dropped.

Everything is DataFrame functions; no Python runs on the executors.  Leaves with a single distinct line, and
those with fewer lines than recur, cannot gain anything from generalising and keep their lines' own templates;
token positions are only counted for the others.  Tokens and templates that own a large share of the rows are
joined in slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_key_join
from .common import text_of, written

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 3
LONG_TOKENS, LONG_DOCS = 50, 2
MIN_TOKENS = 3
BLANKS = " \t\r"
FIELD = "<*>"


def _short(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def masked(text: Column) -> Column:
    """A text with the tokens of each line joined by single spaces, those with a digit as FIELD; a line may keep one
    space at either end."""
    uneven = F.lit(False)
    for blanks in ("  ", *BLANKS.strip(" ")):
        uneven = uneven | text.contains(blanks)
    single = F.when(uneven, F.regexp_replace(text, f"[{BLANKS}]{{2,}}|[{BLANKS.strip(' ')}]", " ")).otherwise(text)
    fields = F.regexp_replace(single, "(?<![^ \\n])[^ \\n0-9]*+[0-9][^ \\n]*+", FIELD)    # from starts of tokens only
    return F.when(text.rlike("[0-9]"), fields).otherwise(single)


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(doc_id, h, pos, size, leaf, line, template) of every line with enough tokens; ``line`` is masked."""
    whole = docs.select("doc_id", F.xxhash64("_text").alias("h"), masked(F.col("_text")).alias("whole"))
    rows = whole.select("doc_id", "h", F.posexplode(F.split("whole", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line"))
    blanks = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    rows = rows.withColumn("size", blanks + 1).filter(F.col("size") >= min_tokens)
    leaf = F.xxhash64("size", F.substring_index("line", " ", depth))
    return rows.select("doc_id", "h", "pos", "size", leaf.alias("leaf"), "line", _short(F.col("line")).alias("template"))


def _generalised(lines: DataFrame, wide: DataFrame, similarity: float) -> DataFrame:
    """(template, group) of the lines of the ``wide`` leaves (leaf, n) whose level is more than 1."""
    distinct = (hot_key_join(lines.select("leaf", "template", "size", "line"), wide.select("leaf"), "leaf", "left_semi",
                             spread=["template"], counts=wide)
                .groupBy("leaf", "template").agg(F.first("size").alias("size"), F.first("line").alias("line")))
    distinct = written(distinct, "lines")
    tokens = (distinct.select("leaf", "template", "size", F.posexplode(F.split("line", " ")).alias("at", "token"))
              .select("template", "size", F.xxhash64("leaf", "at", "token").alias("slot")))
    support = written(tokens.groupBy("slot").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "line-tokens")
    met = hot_key_join(tokens, support, "slot", counts=support.withColumnRenamed("k", "n"))
    # A slot stands for leaf, position and token, so the sorted slots of the constants name a template.
    known = met.groupBy("template").agg(F.first("size").alias("size"),
                                        F.sort_array(F.collect_list(F.struct("k", "slot")), asc=False).alias("met"))
    most = F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-9)).cast("int")
    level = F.get("met", most - 1)["k"]
    constant = F.array_sort(F.transform(F.filter("met", lambda x: x["k"] * 2 > F.col("level")), lambda x: x["slot"]))
    return (known.withColumn("level", level).filter("level > 1")
            .select("template", _short(F.concat(F.lit("leaf "), F.array_join(constant.cast("array<string>"), " ")))
                    .alias("group")))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS,
                    min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS,
                    long_docs: int = LONG_DOCS) -> DataFrame:
    """(doc_id, h, dropped): line numbers to drop of each document that loses lines.

    ``docs`` has doc_id and ``_text`` (not null); ``h`` is the text's hash.  Rows equal in both are one
    document.  The first occurrence is the smallest (doc_id, h, line number), a null id first.
    """
    lines = written(_lines(docs, depth, min_tokens), "lines-of-all", "zstd")      # parsed once; most steps leave ``line``
    enough = F.when(F.col("size") >= long_tokens, long_docs).otherwise(min_docs)
    keys = lines.drop("line")
    wide = (keys.groupBy("leaf").agg(F.min("template").alias("a"), F.max("template").alias("b"),
                                     F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("a") != F.col("b")) & (F.col("n") >= enough)))
    wide = written(wide.select("leaf", "n"), "line-leaves")
    grouped = (keys.join(_generalised(lines, wide, similarity), "template", "left")
               .select("doc_id", "h", "pos", "size", F.coalesce("group", "template").alias("group")))
    grouped = written(grouped, "line-groups")
    by_doc = grouped.groupBy("group", "doc_id", "h").agg(F.min("pos").alias("pos"), F.min("size").alias("size"))
    recurring = (by_doc.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"),
                                             F.min(F.struct("doc_id", "h", "pos")).alias("first"))
                 .filter(F.col("n") >= enough).select("group", "first", "n"))
    recurring = written(recurring, "line-templates")
    met = hot_key_join(grouped.drop("size"), recurring.drop("n"), "group", counts=recurring)
    return (met.filter(~F.struct("doc_id", "h", "pos").eqNullSafe(F.col("first")))
            .groupBy("doc_id", "h").agg(F.collect_set("pos").alias("dropped")))


def drop_recurring_lines(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_lines and n_dropped of each document.

    Null texts stay null and have no lines; an empty text is one empty line.  Lines of fewer than
    ``min_tokens`` tokens always stay.  Documents are never dropped, even if no line is left.  Needs doc_id.
    Other columns stay, but for n_lines and n_dropped; names that begin with ``_llm_`` are the operator's own.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marked = docs.select(*(F.col(f"`{c}`") for c in columns), text_of(f"`{text}`").alias("_llm_text"))
    marked = marked.withColumn("_llm_h", F.xxhash64("_llm_text"))
    found = recurring_lines(marked.select("doc_id", F.col("_llm_text").alias("_text")), **settings).select(
        F.col("doc_id").alias("_llm_id"), F.col("h").alias("_llm_h2"), F.col("dropped").alias("_llm_dropped"))
    same = marked["doc_id"].eqNullSafe(found["_llm_id"]) & (marked["_llm_h"] == found["_llm_h2"])
    joined = marked.join(found, same, "left")
    lines = F.split("_llm_text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_llm_dropped", i)), "\n")
    clean = F.when(F.col("_llm_dropped").isNull(), F.col(f"`{text}`")).otherwise(kept)
    return joined.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in columns),
                         F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_llm_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
