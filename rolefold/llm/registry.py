"""Queries over the driver tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, langid, mixing, packing, simhash, syncmers, topk, toxicity, urlfilter, warc
from .common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM m
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.with_next(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    lexicon, model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs, lexicon, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


# the template tree again, all levels in one recursion over windows
OP10_SQL = """
WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, says) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
fits AS (SELECT s.host, s.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.says, length(r.rule)) AS label
         FROM (SELECT DISTINCT host, path FROM split) s LEFT JOIN rules r
           ON starts_with(s.path, r.rule[strpos(r.rule, '/'):]) AND (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
         GROUP BY s.host, s.path),
base AS (SELECT page_id, s.host, s.path, rule, label, regexp_replace(s.path, '[0-9]+', '<n>', 'g') AS shape
         FROM split s JOIN fits f ON s.host = f.host AND s.path = f.path),
leaves AS (SELECT host, shape, count(*) AS pages, count(label) AS labelled, count(*) FILTER (WHERE label = 'block') AS bad FROM base GROUP BY ALL),
world AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS p0 FROM leaves),
tree AS (
  SELECT host, shape, string_split(shape, '/') AS segs, 1 AS d, '' AS node, p0 AS q,
         (sum(bad) OVER h + 4 * p0) / (sum(labelled) OVER h + 4.0::DOUBLE) AS p, pages, labelled, bad
  FROM leaves, world WINDOW h AS (PARTITION BY host)
  UNION ALL
  SELECT * FROM (
    WITH a AS (SELECT *, segs[d + 1] AS seg FROM tree WHERE len(segs) > d),
    k AS (SELECT *, sum(pages) OVER (PARTITION BY host, node, seg) AS mine, sum(pages) OVER (PARTITION BY host, node) AS whole,
                 dense_rank() OVER (PARTITION BY host, node ORDER BY seg) + dense_rank() OVER (PARTITION BY host, node ORDER BY seg DESC) - 1 AS kids FROM a),
    t AS (SELECT *, CASE WHEN kids > 16 AND mine * 100 < whole THEN '*' ELSE seg END AS t FROM k),
    b AS (SELECT host, node, t, max(p) AS above, sum(labelled) AS n, sum(bad) AS x FROM t GROUP BY host, node, t),
    l AS (SELECT *, lag(n) OVER w AS n0, lag(x) OVER w AS x0 FROM b WHERE n > 0 WINDOW w AS (PARTITION BY host, node ORDER BY x / n, t)),
    c AS (SELECT *, count(*) FILTER (WHERE pow((x * n0 - x0 * n)::DOUBLE, 2) * (n + n0)::DOUBLE > 3.84::DOUBLE * n::DOUBLE * n0::DOUBLE * ((x + x0) * (n + n0 - x - x0))::DOUBLE)
                       OVER (PARTITION BY host, node ORDER BY x / n, t ROWS UNBOUNDED PRECEDING) AS part FROM l),
    m AS (SELECT *, (sum(x) OVER g + 4 * above) / (sum(n) OVER g + 4.0::DOUBLE) AS q FROM c WINDOW g AS (PARTITION BY host, node, part)),
    j AS (SELECT b.host, b.node, b.t, coalesce(m.q, b.above) AS q, (b.x + 4 * coalesce(m.q, b.above)) / (b.n + 4.0::DOUBLE) AS p
          FROM b LEFT JOIN m ON b.host = m.host AND b.node = m.node AND b.t = m.t)
    SELECT t.host, t.shape, t.segs, t.d + 1, t.node || '/' || t.t, j.q, j.p, t.pages, t.labelled, t.bad
    FROM t JOIN j ON t.host = j.host AND t.node = j.node AND t.t = j.t)),
ended AS (SELECT * FROM tree WHERE len(segs) = d),
shapes AS (SELECT node, (sum(bad) + 4 * max(p0)) / (sum(labelled) + 4.0::DOUBLE) AS s FROM ended, world GROUP BY node),
found AS (SELECT e.host, e.node, CASE WHEN (sum(e.bad) + 4 * (max(e.q) + max(s.s)) / 2) / (sum(e.labelled) + 4.0::DOUBLE) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
          FROM ended e JOIN shapes s ON e.node = s.node GROUP BY e.host, e.node)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.label, f.verdict) AS verdict, e.host || e.node AS template
FROM base b JOIN ended e ON b.host = e.host AND b.shape = e.shape JOIN found f ON e.host = f.host AND e.node = f.node
"""


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_syncmers": op3_syncmers,
        "op4_simhash": op4_simhash,
        "op5_exact_topk": op5_exact_topk,
        "op6_source_mixing": op6_source_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_language_id": op8_language_id,
        "op9_hmm_scoring": op9_hmm_scoring,
        "op10_url_filters": op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op5_exact_topk": OP5_SQL,
        "op10_url_filters": OP10_SQL,
    }
