"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.licenses import TEMPLATES, long_templates
from tidemark.llm.licenses import oracle_sql as licenses_oracle
from tidemark.llm.pii import oracle_sql as personal_data_oracle
from tidemark.llm.shared import checkpointed, remove, scratch, ship
from tidemark.session import table

#: Where the vocabulary files of the public tokenizers are; a parameter of every operator that reads one.
WORD_BPE, BYTE_BPE, BYTE_BPE_SIZE = "word_bpe_49k.json", "byte_bpe_50k.json", 50_257


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def warc(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.warc import read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(table(spark, folder, "pages"), path)
    found = read_warc(spark, path, with_payload=False)
    found = checkpointed(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, path)
    return found


#: A conversation whose texts are control strings, in a layout of its own; every formatted table has it, too.
CONTROL_RECORD = (-7, '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}')


def chat(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.chat import read_formatted, turns_of_records, turns_of_table, write_formatted

    record = turns_of_records(spark.createDataFrame([CONTROL_RECORD], "conv_id long, record string"))
    turns = turns_of_table(table(spark, folder, "conversations")).unionByName(record.select("conv_id", "turn", "role", "text"))
    path = scratch(spark, "formatted")
    write_formatted(turns, path)
    found = checkpointed(read_formatted(spark, path))
    remove(spark, path)
    return found


def packing(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer_file(WORD_BPE))


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.binary_ids import read_token_files, write_token_files

    path = scratch(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), path, tokenizer_file(BYTE_BPE), BYTE_BPE_SIZE)
    found = read_token_files(spark, path)  # which holds what it has read
    remove(spark, path)
    return found.drop("file")


def mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by their first place in training; those that the mix doesn't take come last."""
    from tidemark.llm.mixing import mix

    found = mix(table(spark, folder, "documents"), carry=("doc_id",))
    place = lambda k: F.round(F.try_element_at("mix.positions", F.lit(k)), 2)
    found = found.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", place(1).alias("first_position"), place(-1).alias("last_position"))
    return found.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.exact_dedup import dedup_exact

    return dedup_exact(table(spark, folder, "documents")).drop("n_chunks", "text_hash")


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(table(spark, folder, "documents"))


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text"), TEMPLATES + long_templates())
    return found.select("doc_id", "n_matches", "licenses")


def simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).drop("first", "text_hash")


def quality(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.quality import quality as judged

    found = judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clustering(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.clustering import clusters

    return clusters(table(spark, folder, "embeddings"))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.pii import scan_personal_data

    return scan_personal_data(table(spark, folder, "documents"))


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_round_trip": warc,
    "op2_license_scan": licenses,
    "op3_chat_formatting": chat,
    "op4_best_fit_packing": packing,
    "op5_token_id_files": token_ids,
    "op6_source_mixing": mixing,
    "op7_exact_dedup": exact_dedup,
    "op8_secret_scan": secrets,
    "op9_simhash_near_dedup": simhash,
    "op10_quality_rules": quality,
    "op11_centroid_clustering": clustering,
    "op12_personal_data": personal_data,
    "op13_hard_negatives": hard_negatives,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


QUERIES = {name: _shipped(query) for name, query in QUERIES.items()}



def _clustering_sql(rounds: int = 10) -> str:
    """A step per round: squared distances by inner products of whole numbers, which doubles hold exactly."""
    assign = """a{i} AS MATERIALIZED (
  SELECT uid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS m
  FROM (SELECT v.uid, v.vec_id, v.x, k.c, list_inner_product(v.x, v.x) + list_inner_product(k.x, k.x) - 2 * list_inner_product(v.x, k.x) AS d FROM v, c{i} k) GROUP BY uid),"""
    move = """c{j} AS MATERIALIZED (
  SELECT k.c, coalesce(n.x, k.x) AS x
  FROM c{i} k LEFT JOIN (SELECT c, list(f ORDER BY p) AS x FROM (SELECT m.c AS c, p, floor(sum(x[p]) / count(*)) AS f FROM a{i}, range(1, 65) t(p) GROUP BY ALL) GROUP BY c) n ON n.c = k.c),"""
    steps = "\n".join(assign.format(i=i) + (move.format(i=i, j=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 8)),
{steps}
s AS (SELECT m.c AS c, sum(m.d) AS d FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(s.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM s) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(k.x, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN s ON s.c = a.m.c JOIN c{rounds} k ON k.c = a.m.c"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_personal_data": personal_data_oracle(),
    "op13_hard_negatives": """
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.uid <> b.uid),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.id NULLS LAST) AS k, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3""",
    "op2_license_scan": licenses_oracle(TEMPLATES + long_templates()),
    "op1_warc_round_trip": r"""
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
marked AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS first_id,
         row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS k
  FROM rows)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND payload_bytes >= 100 THEN first_id END AS refers_to
FROM marked""",
    "op3_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
safe AS (
  SELECT *, replace(replace(replace(role, chr(9243), chr(9243) || chr(9243)), '<', '<' || chr(9243)), '[', '[' || chr(9243)) AS r,
            replace(replace(replace(text, chr(9243), chr(9243) || chr(9243)), '<', '<' || chr(9243)), '[', '[' || chr(9243)) AS t
  FROM turns),
formatted AS (SELECT *, '<|turn|>' || replace(r, chr(10), chr(9243) || 'n') || chr(10) || t || '<|done|>' AS segment FROM safe)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id""",
    "op6_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord, md5(coalesce(text, '')) AS tie
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turns AS (
  SELECT source, source_size, 3 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS turn
  FROM totals),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
  FROM turns
  WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY CAST(most AS DOUBLE) / weight, turn) AS k FROM levels),
level AS (
  SELECT k AS k0, rest AS rest0, free AS free0 FROM numbered
  WHERE CAST(rest AS DOUBLE) * weight <= CAST(most AS DOUBLE) * free ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE (turn - 1) % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS start,
         CASE WHEN k < k0 THEN CAST(most AS DOUBLE) ELSE weight * CAST(rest0 AS DOUBLE) / CAST(free0 AS DOUBLE) END AS target
  FROM numbered, level),
demand AS (SELECT sum(target * start) AS lev, sum(target * (1.0::DOUBLE - start)) AS slope FROM targets),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.start,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY ord, s.size, s.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN target > 0 AND middle / target < 1 THEN 1 ELSE 0 END
          + CASE WHEN target > 0 AND (middle + source_size) / target < 1 THEN 1 ELSE 0 END
          + CASE WHEN target > 0 AND (middle + 2 * source_size) / target < 1 THEN 1 ELSE 0 END AS times
  FROM placed),
shares AS (SELECT *, middle / target AS first, (middle + (times - 1) * source_size) / target AS last FROM counted),
timed AS (
  SELECT *, CASE WHEN start = 1 THEN first ELSE (sqrt(start * start + 4 * (1 - start) * first) - start) / (2 * (1 - start)) END AS t1,
            CASE WHEN start = 1 THEN last ELSE (sqrt(start * start + 4 * (1 - start) * last) - start) / (2 * (1 - start)) END AS t2
  FROM (SELECT doc_id, size, source_size, target, start, times, CASE WHEN times > 0 THEN first END AS first, CASE WHEN times > 0 THEN last END AS last FROM shares))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * times AS BIGINT) AS taken,
       round(lev * t1 + slope * t1 * t1, 2) AS first_position, round(lev * t2 + slope * t2 * t2, 2) AS last_position
FROM timed, demand""",
    "op7_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM rows WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM ranked""",
}
