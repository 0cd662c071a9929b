"""Queries of this package's operators over their whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, media, page_diff, pieces, rans, reply_tree, shingle_join, substring_dedup, toxicity, url_filter
from .common import prepare, shared_folder, table

END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    rans.write(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), END_ID, 49408)
    return rans.read(spark, path)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_from(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), model).drop("text")


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    best = reply_tree.best_branches(reply_tree.chain(turns.unionByName(extra)))
    return reply_tree.report(reply_tree.read_turns(reply_tree.format_turns(best)))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), END_ID).drop("ids")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))



def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(*media.store(table(spark, sf_dir, "documents").select("doc_id", "text")))



def op7_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_diff.extract(pages).withColumn("n_chars", F.length("text").cast("long"))



def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"))



QUERIES = {f.__name__: f for f in (op1_rans_token_ids, op2_media_chunks, op3_substring_dedup, op4_toxicity, op5_reply_trees, op6_pieces, op7_page_diff, op8_shingle_join, op9_decontaminate, op10_url_filter)}
SQL: dict[str, str] = {}


# ---- SQL ----

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD8 = r"[^\x20\x09-\x0D]+"

SQL["op5_reply_trees"] = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
one AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  string_agg('<|' || role || '|>' || chr(10) || replace(replace(replace(replace(replace(text, chr(92), chr(92) || 's'), '<', chr(92) || 'l'), '>', chr(92) || 'g'), '[', chr(92) || 'b'), '|', chr(92) || 'p') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS formatted
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars FROM one"""

SQL["op8_shingle_join"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD8}') AS w FROM documents),
grams AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g, len(w) < 5 AS short FROM docs),
flat AS (SELECT doc_id, len(g) AS n, short, unnest(g) AS x FROM grams),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT g.doc_id, len(g.g) AS n_shingles, r.component_id FROM grams g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON g.doc_id = r.a"""

SQL["op9_decontaminate"] = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD9}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD9}') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0))),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, p.k FROM places p JOIN grams g ON p.gram = g.gram AND p.k = g.k),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

SQL["op10_url_filter"] = """
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p, rule) AS (VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (page_id)"""
