"""Registered queries on whole-word and vector search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import postings as I
from tidemark.operators import search as Q
from tidemark.plans.catalogue import register
from tidemark.plans.posts import POSTS, posts, quoted, sql_word
from tidemark.session import table

TERMS, NOT = ["thatin", "by the", "sich"], ["hehely"]


@register("word_search", f"WITH {POSTS} SELECT id FROM posts WHERE {sql_word('lower(text)', TERMS)} AND NOT {sql_word('lower(text)', NOT)}")
def word_search(spark, folder):
    return Q.matching(posts(spark, folder), F.col("text"), TERMS, NOT).select("id")


RANK = "round((0.0::DOUBLE + " + " + ".join("len(regexp_extract_all(lower(text), '\\b" + r"\s+".join(t.split()) + "\\b'))" for t in TERMS) + ") / (ln(1.0::DOUBLE + len(regexp_extract_all(lower(text), '[a-z0-9]+'))) + 1.0::DOUBLE), 6)"


@register("text_rank", f"WITH {POSTS} SELECT id, {RANK} AS text_rank FROM posts")
def text_rank(spark, folder):
    return posts(spark, folder).select("id", Q.text_rank(F.col("text"), TERMS).alias("text_rank"))


@register(
    "cover_density",
    f"""WITH {POSTS}, w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM posts),
d AS (SELECT a.id, a.pos, min(abs(a.pos - b.pos)) AS d FROM w a JOIN w b ON a.id = b.id AND a.word = 'thatin' AND b.word = 'the' GROUP BY 1, 2) SELECT id, round(sum(1.0::DOUBLE / d), 6) AS density FROM d GROUP BY id""",
)
def cover_density(spark, folder):
    return posts(spark, folder).select("id", Q.cover_density(F.col("text"), "thatin", "the").alias("density")).filter("density > 0")


def _query(spark, folder):
    """One row: the vector with the smallest id."""
    return table(spark, folder, "embeddings").groupBy().agg(F.min_by("embedding", "vec_id").alias("q"))


NEAR = "SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)"


@register("within_distance", f"SELECT id, similarity FROM ({NEAR}) WHERE 1 - similarity < 0.9::DOUBLE")
def within_distance(spark, folder):
    return Q.within_distance(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "embedding", _query(spark, folder), 0.9)


@register("hybrid_search", f"WITH {POSTS}, t AS (SELECT id, {RANK} AS t FROM posts WHERE {sql_word('lower(text)', TERMS)}), v AS (SELECT id, similarity AS s FROM ({NEAR}) WHERE 1 - similarity < 0.9::DOUBLE) SELECT id, round(CASE WHEN coalesce(t, 0) > 0 AND coalesce(s, 0) > 0 THEN s * 0.7::DOUBLE + t * (1 - 0.7::DOUBLE) ELSE greatest(coalesce(s, 0), coalesce(t, 0)) END, 6) AS score FROM t FULL JOIN v USING (id) ORDER BY score DESC, id LIMIT 60")
def hybrid_search(spark, folder):
    texts = Q.matching(posts(spark, folder), F.col("text"), TERMS).select("id", Q.text_rank(F.col("text"), TERMS).alias("text_rank"))
    vectors = Q.within_distance(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "embedding", _query(spark, folder), 0.9)
    return Q.hybrid(texts, vectors, "id", 0.7, 60)


@register(
    "embedding_backlog",
    """WITH o AS (SELECT doc_id, n_chars, n_chars > 1200 AS high FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT *, row_number() OVER (PARTITION BY high ORDER BY n_chars DESC, doc_id) AS k FROM o) SELECT doc_id, high AS is_high, k AS place FROM r WHERE k <= CASE WHEN high THEN 70 ELSE 30 END""",
)
def embedding_backlog(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    found = Q.two_strata(docs, table(spark, folder, "labels"), "doc_id", F.col("n_chars") > 1200, 100, 0.3, F.desc("n_chars"))
    return found.select("doc_id", "is_high", F.col("place").cast("long").alias("place"))


@register("long_tail_backlog", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY value BETWEEN 20 AND 60 OR value IS NULL ORDER BY value, event_id) AS k FROM events WHERE value BETWEEN 20 AND 60 OR value IS NULL) WHERE k <= 50")
def long_tail_backlog(spark, folder):
    rows = table(spark, folder, "events").filter(F.col("value").between(20, 60) | F.col("value").isNull())
    return rows.orderBy("value", "event_id").select("event_id").limit(50)


#: Any of: both words of the first group, the phrase, the last word. In SQL, places are words apart by single spaces.
ANY_OF, EXCLUDED = [["thatin", "inoran"], ["by the"], ["sich"]], ["hehely", "of and"]
_PADDED = "t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), p AS (SELECT id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t)"
_IN = lambda k: f"contains(s, {quoted(' ' + k + ' ')})"
_FITS = f"({' OR '.join('(' + ' AND '.join(map(_IN, g)) + ')' for g in ANY_OF)}) AND NOT ({' OR '.join(map(_IN, EXCLUDED))})"
_WORDS = sorted({w for g in ANY_OF for k in g for w in k.split()})
_SHARE = f"round(len(list_filter(w, lambda x: x IN ({', '.join(map(quoted, _WORDS))}))) / (1.0::DOUBLE + ln(1.0::DOUBLE + len(w))), 6)"


def _documents(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


@register("posting_search", f"WITH {_PADDED} SELECT id, {_SHARE} AS text_rank FROM p WHERE {_FITS}")
def posting_search(spark, folder):
    """Words as they are; ``stemmed_search`` has stems."""
    return I.search(I.build(_documents(spark, folder), stemmed=False), ANY_OF, EXCLUDED)


@register("posting_top", f"WITH {_PADDED} SELECT id, {_SHARE} AS text_rank FROM p WHERE {_FITS} ORDER BY text_rank DESC, id LIMIT 40")
def posting_top(spark, folder):
    return I.top(I.build(_documents(spark, folder), stemmed=False), ANY_OF, 40, EXCLUDED)


@register("stemmed_search")
def stemmed_search(spark, folder):
    """No SQL: stems come from the published rules; tested against a scan of all texts."""
    return I.search(I.build(_documents(spark, folder)), ANY_OF, EXCLUDED)


_COVER = ["the", "of", "thatin"]


@register(
    "cover_density_of_three",
    f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), e AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM e WHERE word IN ({", ".join(map(quoted, _COVER))})),
l AS (SELECT *, {", ".join(f"max(CASE WHEN word = {quoted(w)} THEN pos END) OVER o AS l{i}" for i, w in enumerate(_COVER))} FROM m WINDOW o AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT *, CASE WHEN l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l0, l1, l2) END AS p FROM l),
n AS (SELECT *, lag(p) OVER (PARTITION BY id ORDER BY pos) AS before FROM c)
SELECT n.id, round(sum(0.1::DOUBLE / (1.0::DOUBLE + (n.pos - n.p) - (n.k - m.k))), 6) AS density FROM n JOIN m ON m.id = n.id AND m.pos = n.p WHERE n.p IS NOT NULL AND (n.before IS NULL OR n.p > n.before) GROUP BY n.id""",
)
def cover_density_of_three(spark, folder):
    return I.covered(I.build(_documents(spark, folder), stemmed=False), _COVER)
