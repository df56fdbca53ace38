"""The operators applied to the driver's tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontamination, divergence, langid, line_dedup, near_dup, neighbours, packing, passages, periodic, quality, toxicity, url_filter
from .sampling import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
  SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.line, l.pos, (c.key IS NOT NULL AND l.doc_id <> c.owner) AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _md5_int(value, start: int, digits: int):
    return F.conv(F.substring(F.md5(value), start, digits), 16, 10).cast("long")


def url_lists(pages: DataFrame) -> DataFrame:
    """Dated entries made by rule from the pages' hosts, as the driver's tables hold no lists.

    A host is added to `spam` or `adult` on a day of 2024 given by its md5, and
    of some hosts the entry is withdrawn and renewed; two-label parent domains
    are never listed.  Some hosts get a path entry in `paths`.
    """
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")).filter("host <> ''")
    hosts = hosts.groupBy("host").agg(F.min(F.split_part("path", F.lit("/"), F.lit(2))).alias("top"))
    h = F.col("host")
    first = _md5_int(h, 1, 4) % 300
    name = F.when(_md5_int(h, 5, 2) % 2 == 0, F.lit("spam")).otherwise(F.lit("adult"))
    listed = hosts.filter(_md5_int(h, 7, 2) % 4 == 0).select(
        F.explode(F.array(
            F.struct(name.alias("list"), h.alias("value"), F.lit("add").alias("action"), day(first).alias("effective")),
            F.struct(name.alias("list"), h.alias("value"), F.lit("remove").alias("action"), day(first + 20 + _md5_int(h, 9, 2)).alias("effective")),
            F.struct(name.alias("list"), h.alias("value"), F.when(_md5_int(h, 11, 2) % 3 == 0, "add").otherwise("remove").alias("action"), day(first + 300).alias("effective")),
        )).alias("e")
    ).select("e.*")
    paths = hosts.filter((_md5_int(h, 7, 2) % 4 == 1) & (F.col("top") != "")).select(
        F.lit("paths").alias("list"), F.concat(h, F.lit("/"), "top").alias("value"), F.lit("add").alias("action"), day(first).alias("effective")
    )
    return listed.unionByName(paths)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919 * 977) % 31536000))
    out = url_filter.filter_urls(captures, url_lists(pages))
    return out.withColumn("lists", F.array_join("lists", ","))


OP3_SQL = r"""
WITH captures AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         1704067200 + (page_id * 7919 * 977) % 31536000 AS at
  FROM pages),
hosts AS (
  SELECT host, min(split_part(path, '/', 2)) AS top, CAST('0x' || substr(md5(host), 1, 4) AS BIGINT) % 300 AS first,
         CAST('0x' || substr(md5(host), 5, 2) AS BIGINT) AS h5, CAST('0x' || substr(md5(host), 7, 2) AS BIGINT) AS h7,
         CAST('0x' || substr(md5(host), 9, 2) AS BIGINT) AS h9, CAST('0x' || substr(md5(host), 11, 2) AS BIGINT) AS h11
  FROM captures WHERE host <> '' GROUP BY host),
events AS (
  SELECT CASE WHEN h5 % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, host AS value, 'add' AS action, first AS day FROM hosts WHERE h7 % 4 = 0
  UNION ALL SELECT CASE WHEN h5 % 2 = 0 THEN 'spam' ELSE 'adult' END, host, 'remove', first + 20 + h9 FROM hosts WHERE h7 % 4 = 0
  UNION ALL SELECT CASE WHEN h5 % 2 = 0 THEN 'spam' ELSE 'adult' END, host, CASE WHEN h11 % 3 = 0 THEN 'add' ELSE 'remove' END, first + 300 FROM hosts WHERE h7 % 4 = 0
  UNION ALL SELECT 'paths', host || '/' || lower(top), 'add', first FROM hosts WHERE h7 % 4 = 1 AND top <> ''),
last_event AS (
  SELECT c.page_id, e.list, e.value, min(e.action ORDER BY e.action) AS action
  FROM captures c JOIN events e
    ON (c.host = e.value OR ends_with(c.host, '.' || e.value) OR (c.host || '/' || split_part(c.path, '/', 2)) = e.value)
   AND 1704067200 + e.day * 86400 <= c.at
  WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.list = e.list AND n.value = e.value AND n.day > e.day AND 1704067200 + n.day * 86400 <= c.at)
  GROUP BY ALL),
active AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM last_event WHERE action = 'add' GROUP BY page_id)
SELECT c.page_id, a.n IS NOT NULL AS blocked, coalesce(a.n, 0) AS n_active, coalesce(a.lists, '') AS lists
FROM captures c LEFT JOIN active a USING (page_id)
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.filter(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 1)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH terms AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
own AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total + 2 * s.v) AS p
  FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)) AS q
  FROM own JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM best)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def periodic_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text): of documents whose crc32 ends in 0, the words from a place on become repeats of the first of them."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            h = zlib.crc32(str(doc_id).encode())
            if doc_id is None or h % 10 or not (words := (text or b"").split()):
                continue
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            texts[k] = b" ".join([*words[:a], *(words[a : a + p] * -(-(n - a) // p))[: n - a]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = periodic.collapse_runs(docs.mapInArrow(periodic_tails, "doc_id long, text string"))
    first = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.get(first, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", "runs", best.alias("best"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.shorter div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) == 1)
    return quality.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op7_decontamination": op7_decontamination,
    "op4_language_id": op4_language_id,
    "op10_toxicity": op10_toxicity,
    "op3_url_filter": op3_url_filter,
    "op8_packing": op8_packing,
    "op6_line_dedup": op6_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES = {
    "op3_url_filter": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op11_source_divergence": OP11_SQL,
}
