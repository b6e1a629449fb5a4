"""Quality rules: a hashed n-gram log-likelihood ratio of trusted text against the raw corpus, and counted rules.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over the buckets,
one of trusted documents and one of the whole corpus, give each bucket the logarithm of its ratio; a document's score
is the mean over its n-grams, and it is kept when the score is at least a fixed threshold.

Everything is DataFrame and SQL functions. Counting is an aggregate over at most that many buckets, combined before
its shuffle: one over all documents, which stay where they are, and one over the trusted ones, which alone are joined with
their labels. Scoring is a pass over the documents without any shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hash_bits, may_be_in, once, text_or_empty

BUCKETS = 10_000
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.05
#: Bits of the constant that tells which documents may be trusted.
TRUSTED_BITS = 1 << 20
SYMBOLS = "[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array if it has none."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _pairs(words: Column) -> Column:
    """Each word, a, with the next, b; null after the last."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _counts(texts: DataFrame) -> DataFrame:
    """bucket, n: n-grams of all ``texts`` (text). At most BUCKETS rows."""
    rows = texts.select(words_of(F.col("text")).alias("words")).select(F.inline(_pairs(F.col("words"))).alias("a", "b"))
    two = F.when(F.col("b").isNotNull(), _bucket("a", "b"))
    ones = rows.select(F.explode(F.array(_bucket("a"), two)).alias("bucket")).filter("bucket is not null")
    return ones.groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``ratios``: per bucket the log of trusted over raw frequency, one added to each count.

    ``labels`` (doc_id, quality): trusted are all documents with quality 1. A constant of TRUSTED_BITS bits, set by the hashes
    of their ids, keeps most other documents out of the join with the labels; where ids are so many that the bits are full,
    more texts are moved and the join leaves the same. All documents make up the raw corpus. Without trusted documents
    all ratios are those of an even distribution over the raw one.
    """
    chosen = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    bits = hash_bits(chosen.select(F.col("trusted_id").cast("long").alias("id")), "id", TRUSTED_BITS)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(may_be_in(bits, F.col("doc_id"), TRUSTED_BITS))
    trusted = _counts(some.join(chosen.hint("shuffle_hash"), F.col("doc_id") == F.col("trusted_id"), "left_semi").select("text")).withColumnRenamed("n", "trusted")
    counts = _counts(docs.select(text_or_empty().alias("text"))).join(trusted, "bucket", "left")
    whole = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    sums = whole.agg(F.sum("n").alias("all_n"), F.sum("trusted").alias("all_t"), F.array_sort(F.collect_list(F.struct("bucket", "n", "trusted"))).alias("rows"))
    ratio = lambda r: F.log((r["trusted"] + 1) / (F.col("all_t") + BUCKETS)) - F.log((r["n"] + 1) / (F.col("all_n") + BUCKETS))
    return sums.select(F.transform("rows", ratio).alias("ratios"))


def _covered(places: Column) -> Column:
    """How many words the windows of three that begin at these ascending places have."""
    each = F.transform(places, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - i, F.lit(3))))
    return F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n + x)


def _repeated(windows: Column) -> Column:
    """Words in windows of three that come at least twice: their number. ``windows`` are the windows' hashes.

    In a sorted array repeated ones stand side by side. Where they are few, their places are looked up; where they
    are many, all windows are sorted along with their places, so time stays in proportion to n log n.
    """
    is_set = lambda a: F.filter(a, lambda x: x.isNotNull())
    few = lambda again: F.transform(windows, lambda h, i: F.when(F.array_contains(again, h), i))
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    beside = lambda a: F.transform(a, lambda x, k: F.when((F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"]), x["i"]))
    many = lambda: once(placed, lambda a: F.array_sort(is_set(beside(a))))
    again = once(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x)))
    return once(again, lambda d: once(F.when(F.size(d) <= 24, is_set(few(d))).otherwise(many()), _covered))


def judged(text: Column, ratios: Column, threshold: float) -> Column:
    """A struct of the counts, the score and the verdict of a text.

    One expression that binds each intermediate array once: a filter on the verdict, which the optimizer moves to the
    scan, then carries the whole of it along and repeats nothing.
    """
    of = lambda *w: F.get(ratios, _bucket(*w))
    add = lambda s, w: s + of(w["a"]) + F.when(w["b"].isNotNull(), of(w["a"], w["b"])).otherwise(0.0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def repeats(words: Column) -> Column:
        windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        return once(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_repeated(w)))

    def counts(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.struct(
            n.alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            once(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeats(words).alias("n_repeat_words"),
            F.when(n > 0, F.aggregate(_pairs(words), F.lit(0.0), add) / (2 * n - 1)).alias("score"),
        )

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        kept = ~failed & (F.coalesce(c["score"], F.lit(float("-inf"))) >= threshold)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
        return F.struct(*(c[x].alias(x) for x in names), failed.alias("base_failed"), kept.alias("kept"))

    return once(once(words_of(text), counts), verdict)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and any others): ``doc``, a struct of its columns, the counts, score and kept.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or over half of
    them in repeated windows of three), score (mean log ratio, null without words) and kept: not base_failed and score
    at least ``threshold``. A null text has no words, so it isn't kept. Null doc_ids are never trusted. Repeated rows
    get equal results. An empty table gives no rows.
    """
    found = bucket_ratios(docs, labels).first()[0]  # BUCKETS numbers
    ratios = F.from_json(F.lit(json.dumps(found)), "array<double>")  # folded to a constant
    rows = docs.select(F.struct(*docs.columns).alias("doc"), judged(text_or_empty(), ratios, threshold).alias("rules"))
    return rows.select("doc", "rules.*")
