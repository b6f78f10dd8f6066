"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chat_format, crc_resampling, decontaminate, embedding_dedup, html_extract, line_dedup, mixing, phrases, pivot_search, simhash, substring_dedup, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


#: A conversation made of another template's control strings, as rows of the table.
CONTROL_ROWS = "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.formatted_report(rows.unionByName(spark.sql(CONTROL_ROWS)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"))


def op12_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crc_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_line_dedup, op2_decontamination, op3_html_extract, op4_embedding_dedup, op5_simhash, op6_substring_dedup, op7_chat_format, op8_mixing, op9_warc, op10_toxicity, op11_pivot_top_k, op12_crc_resampling, op13_collocations, pipeline]
    return {q.__name__: q for q in own}


_DOC_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, COALESCE({_DOC_WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_DOC_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item_id, 10 AS n, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) >= 10
  UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= n),
found AS (SELECT DISTINCT rid, i, n, item_id FROM grams JOIN windows USING (n, g)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items, sha256(COALESCE(all_items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""


OP4_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""

OP6_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS m FROM d WHERE len(w) >= 35),
twice AS (SELECT m FROM g GROUP BY m HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT k) AS ks FROM (SELECT rid, unnest(range(i, i + 35)) AS k FROM g SEMI JOIN twice USING (m)) GROUP BY rid),
flags AS (SELECT rid, k, TRUE AS gone FROM (SELECT rid, unnest(ks) AS k FROM gone)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN flags USING (rid, k) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(n, 0))::BIGINT AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


OP7_SQL = chat_format.report_sql(f"SELECT conv_id, turn, role, text FROM conversations UNION ALL {CONTROL_ROWS}")

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, {1 + 5 * i}, 5))::BIGINT >> {shift}) & 31)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0))

OP9_SQL = f"""WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS s FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS leader FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_chat_format": OP7_SQL, "op9_warc": OP9_SQL, "op8_mixing": mixing.mixture_sql(), "op11_pivot_top_k": pivot_search.top_k_sql(), "op12_crc_resampling": crc_resampling.resample_sql(), "op13_collocations": phrases.collocations_sql()}
