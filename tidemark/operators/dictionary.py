"""Matching of dictionaries of any size: runs of words are looked up by join, not by one pattern of all terms.

A term is a run of words (lower-case ASCII letters and digits), so case and what stands between words don't matter. A
constant of bits keeps runs that are no term's out of the join. Of overlapping matches the leftmost stays, of these the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.bits import hash_bits, may_be_in
from tidemark.session import checkpointed

MOST_WORDS, BITS = 8, 1 << 18


def matches(rows: DataFrame, terms: DataFrame, overlapping: bool = False) -> DataFrame:
    """``rows`` (id, text), ``terms`` (category, canonical, term): id, start (the word's number), n (words), term, category, canonical.

    Terms of over MOST_WORDS words raise an error, those without words are left out; a term of several entries stands for the
    first by category and name. With ``overlapping`` all matches are given, else the leftmost-longest ones. Rows are told apart
    by id; null texts have none.
    """
    keyed = terms.select("category", "canonical", X.tokens(F.coalesce("term", F.lit(""))).alias("w")).filter(F.size("w") > 0)
    first = keyed.groupBy(F.array_join("w", " ").alias("term"), F.size("w").alias("n")).agg(F.min(F.struct("category", "canonical")).alias("e"))
    first = checkpointed(first.select("term", "n", "e.category", "e.canonical"))
    sizes = sorted(r.n for r in first.select("n").distinct().limit(MOST_WORDS + 1).collect())
    if sizes and sizes[-1] > MOST_WORDS:
        raise ValueError(f"terms of over {MOST_WORDS} words")
    if not sizes:
        return rows.select("id").limit(0).selectExpr("id", "0 AS start", "0 AS n", "'' AS term", "'' AS category", "'' AS canonical")
    bits = hash_bits(first, "term", BITS)

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
        made = F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("w", i + 1, n), " ").alias("term")))
        return F.when(F.size("w") >= n, F.filter(made, lambda x: may_be_in(bits, x["term"], BITS))).otherwise(F.array().cast("array<struct<start:int,n:int,term:string>>"))

    words = rows.select("id", X.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    found = words.select("id", F.inline(F.concat(*map(runs, sizes)))).join(first.drop("n"), "term")
    if overlapping:
        return found.select("id", "start", "n", "term", "category", "canonical")
    each = F.struct("start", (-F.col("n")).alias("short"), "n", "term", "category", "canonical")
    kind = "array<struct<start:int,n:int,term:string,category:string,canonical:string>>"

    def step(state: Column, x: Column) -> Column:
        new = F.array(F.struct(x["start"].alias("start"), x["n"].alias("n"), x["term"].alias("term"), x["category"].alias("category"), x["canonical"].alias("canonical")))
        free = x["start"] >= state["end"]
        return F.struct(F.when(free, x["start"] + x["n"]).otherwise(state["end"]).alias("end"), F.when(free, F.concat(state["kept"], new)).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))
    whole = found.groupBy("id").agg(F.array_sort(F.collect_list(each)).alias("all"))  # of one text
    return whole.select("id", F.inline(F.aggregate("all", start, step, lambda s: s["kept"])))
