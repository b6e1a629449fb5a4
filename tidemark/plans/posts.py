"""The tables seen as posts, comments, labels, entities and communities, for both engines.

Posts are documents with the event of the same number as time, author, score and number of comments; a document's
source is its community. Comments are turns of conversations. Entities are brands of parts in the lines of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: A common table expression, to stand after WITH.
POSTS = r"""posts AS (
  SELECT d.doc_id AS id, d.source, d.lang, coalesce(d.text, '') AS text, split_part(coalesce(d.text, ''), chr(10), 1) AS title,
         substr(coalesce(d.text, ''), length(split_part(coalesce(d.text, ''), chr(10), 1)) + 2) AS body, e.user_id AS author, e.ts, e.value AS score,
         CAST(json_extract(e.props, '$.k') AS BIGINT) AS comments
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events are one row an id, the first by time, so the optimizer leaves the join out where nothing of them is used."""
    docs, events = table(spark, folder, "documents"), table(spark, folder, "events")
    text = F.coalesce("text", F.lit(""))
    title = F.substring_index(text, "\n", 1)
    rows = docs.select(F.col("doc_id").alias("id"), "source", "lang", text.alias("text"), title.alias("title"), F.substr(text, F.length(title) + 2).alias("body"))
    first = events.groupBy("event_id").agg(F.min(F.struct("ts", "user_id", "value", "props")).alias("e"))
    more = first.select("event_id", F.col("e.user_id").alias("author"), "e.ts", F.col("e.value").alias("score"), F.get_json_object("e.props", "$.k").cast("long").alias("comments"))
    return rows.join(more, F.col("id") == F.col("event_id"), "left").drop("event_id")


#: Comments: a turn is a comment on its conversation, its depth the turn's number, its score the text's length.
COMMENTS = r"""comments AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS post_id, turn AS depth, role AS author, coalesce(text, '') AS body, length(coalesce(text, '')) AS score FROM conversations)"""


def comments(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("post_id"), F.col("turn").alias("depth"), F.col("role").alias("author"), body.alias("body"), F.length(body).cast("long").alias("score")
    )


#: Entities: (post, brand), a post being an order and its community the customer's nation.
MENTIONS = r"""mentions AS (
  SELECT l_orderkey AS post, p_brand AS brand, p_type AS aspect, n_name AS community, o_orderdate AS ts
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
order_posts AS (
  SELECT o_orderkey AS post, n_name AS community, o_orderdate AS ts, o_totalprice AS score, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def order_posts(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("o_orderkey").alias("post"), F.col("n_name").alias("community"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    lines, part = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"), table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order_posts(spark, folder), F.col("l_orderkey") == F.col("post"))
    return rows.select("post", F.col("p_brand").alias("brand"), F.col("p_type").alias("aspect"), "community", "ts")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(text: str, terms) -> str:
    """Any term as any part of the text."""
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def sql_sum(text: str, weights) -> str:
    return "(0.0::DOUBLE" + "".join(f" + CASE WHEN contains({text}, {quoted(t)}) THEN {w}::DOUBLE ELSE 0.0 END" for t, w in weights) + ")"


def sql_matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + pattern)})"


def sql_word(text: str, terms) -> str:
    """Any term as a whole word or phrase."""
    return sql_matches(text, "|".join(r"\b" + r"\s+".join(t.split()) + r"\b" for t in terms))
