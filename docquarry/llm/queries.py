"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import context_mixing, decontam, line_templates, manifest, mixing, packing, paragraphs, quality, sharding, simhash, url_filter, wavelet, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_budget_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_template_lines(_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines_dropped").cast("long").alias("n_lines_dropped"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op4_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        F.col("_id").alias("doc_id"), "item_id", F.col("item_shingles").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(_table(spark, sf_dir, "documents"))


def op6_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(_table(spark, sf_dir, "documents"), TOKENIZER))


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.passage_spans(paragraphs.repeated_passages(_table(spark, sf_dir, "documents"))).select(
        F.col("_id").alias("doc_id"), "first", "n_words", F.size("clusters").alias("n_clusters"), F.element_at("clusters", 1).alias("cluster"), "keep")


def op9_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op10_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op11_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = manifest.tampered(F.col("text"), F.col("doc_id"))
    return manifest.check_copy(_table(spark, sf_dir, "documents"), {"text": changed}).select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_matched_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)[0].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ring_sharding, op2_budget_mixing, op3_line_templates, op4_benchmark_containment, op5_context_mixing, op6_anchor_simhash, op7_wavelet_tokens, op8_paragraph_minhash, op9_url_words, op10_mcd_quality,
    op11_interval_manifest, op12_chebyshev_whitening, op13_matched_packing)}

_SPACES = r"[\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op3_line_templates": rf"""
        WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
        l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM d),
        t AS (SELECT doc_id, text, n, list_transform(list_filter(string_split_regex(line, '{_SPACES}'), lambda x: x <> ''), lambda x: x) AS ws FROM l),
        m AS (SELECT doc_id, text, n, ws AS raw, list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ws FROM t WHERE len(ws) > 0),
        f AS (SELECT *, len(ws)::VARCHAR || ' ' || array_to_string(ws[1:4], ' ') AS leaf FROM m),
        r AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, text FROM f) GROUP BY leaf HAVING count(*) >= 5),
        k AS (SELECT f.* FROM f JOIN r USING (leaf)),
        p AS (SELECT leaf, doc_id, text, n, unnest(ws) AS token, unnest(raw) AS word, generate_subscripts(ws, 1) AS pos FROM k),
        x AS (SELECT leaf, pos, token FROM (SELECT DISTINCT leaf, pos, token, doc_id, text FROM p WHERE token <> '<*>') GROUP BY ALL HAVING count(*) >= 5),
        g AS (SELECT p.doc_id, p.text, p.n, count(x.pos) AS n_fixed, count(*) AS n_words,
                     string_agg(CASE WHEN x.pos IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.pos) AS general, string_agg(p.word, ' ' ORDER BY p.pos) AS own
              FROM p LEFT JOIN x ON p.leaf = x.leaf AND p.pos = x.pos AND p.token = x.token GROUP BY ALL),
        q AS (SELECT doc_id, text, n, CASE WHEN n_fixed >= 0.5 * n_words THEN general ELSE own END AS template FROM g),
        c AS (SELECT template FROM (SELECT DISTINCT template, doc_id, text FROM q) GROUP BY template HAVING count(*) >= 5),
        z AS (SELECT doc_id, text, n FROM q JOIN c USING (template)),
        o AS (SELECT l.doc_id, l.text, count(z.n) AS dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE z.n IS NULL), '') AS kept
              FROM l LEFT JOIN z ON l.doc_id = z.doc_id AND l.text = z.text AND l.n = z.n GROUP BY l.doc_id, l.text)
        SELECT a.doc_id, coalesce(o.dropped, 0)::BIGINT AS n_lines_dropped, md5(o.kept) AS kept_md5 FROM documents a LEFT JOIN o ON a.doc_id = o.doc_id AND a.text = o.text""",
    "op4_benchmark_containment": rf"""
        WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS w FROM documents),
        iw AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}'), lambda x: x <> '') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM iw)),
        d AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw)),
        n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, item_shingles, shared FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles""",
    "op11_interval_manifest": """
        WITH RECURSIVE
        v AS (SELECT *, CASE WHEN text IS NULL THEN NULL ELSE replace(text, chr(10), '') END AS flat FROM documents),
        p AS (SELECT doc_id, source,
                     coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
                     coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(flat) || ':' || flat, '-') AS changed FROM v),
        d AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || changed) AS flat_leaf FROM p),
        s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d GROUP BY source),
        l AS (SELECT d.doc_id, s.source, s.tree, d.leaf, d.flat_leaf, row_number() OVER (PARTITION BY s.tree ORDER BY d.doc_id NULLS FIRST, d.leaf) - 1 AS k FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        up AS (SELECT 0 AS level, tree, k, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
               UNION ALL
               SELECT level + 1, tree, kk, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3 FROM (SELECT *, k // 3 AS kk FROM up WHERE n > 1) GROUP BY level, tree, kk),
        roots AS (SELECT tree, h AS subroot FROM up WHERE n = 1),
        over AS (SELECT 0 AS level, tree AS k, subroot AS h, count(*) OVER () AS n FROM roots
                 UNION ALL
                 SELECT level + 1, kk, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 2) // 3 FROM (SELECT *, k // 3 AS kk FROM over WHERE n > 1) GROUP BY level, kk),
        way AS (SELECT l.tree, l.k, up.level, coalesce(string_agg(up.h, '' ORDER BY up.k) FILTER (WHERE up.k < l.k // (3 ** up.level)::BIGINT), '') AS before,
                       coalesce(string_agg(up.h, '' ORDER BY up.k) FILTER (WHERE up.k > l.k // (3 ** up.level)::BIGINT), '') AS behind
                FROM l JOIN up ON l.tree = up.tree AND up.n > 1 AND up.k // 3 = l.k // (3 ** (up.level + 1))::BIGINT GROUP BY l.tree, l.k, up.level),
        high AS (SELECT r.tree, 1000 + over.level AS level, coalesce(string_agg(over.h, '' ORDER BY over.k) FILTER (WHERE over.k < r.tree // (3 ** over.level)::BIGINT), '') AS before,
                        coalesce(string_agg(over.h, '' ORDER BY over.k) FILTER (WHERE over.k > r.tree // (3 ** over.level)::BIGINT), '') AS behind
                 FROM roots r JOIN over ON over.n > 1 AND over.k // 3 = r.tree // (3 ** (over.level + 1))::BIGINT GROUP BY r.tree, over.level),
        steps AS (SELECT tree, k, level, before, behind FROM way UNION ALL SELECT l.tree, l.k, h.level, h.before, h.behind FROM l JOIN high h USING (tree)),
        nth AS (SELECT *, row_number() OVER (PARTITION BY tree, k ORDER BY level) AS i FROM steps),
        proof AS (SELECT tree, k, sha256(string_agg(before || behind, '' ORDER BY i)) AS proof_sha256, max(i) AS last FROM nth GROUP BY tree, k),
        fold AS (SELECT tree, k, 0::BIGINT AS i, CASE WHEN doc_id IS NOT NULL AND list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b:
                      list_reduce(list_prepend(xor(c, b), [0::BIGINT for _ in range(8)]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1 THEN flat_leaf ELSE leaf END AS h FROM l
                 UNION ALL
                 SELECT f.tree, f.k, n.i, sha256(n.before || f.h || n.behind) FROM fold f JOIN nth n ON f.tree = n.tree AND f.k = n.k AND n.i = f.i + 1)
        SELECT l.doc_id, l.leaf, r.subroot, o.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
        FROM l JOIN roots r USING (tree) JOIN (SELECT h FROM over WHERE n = 1) o ON true LEFT JOIN proof p USING (tree, k) JOIN fold f ON l.tree = f.tree AND l.k = f.k AND f.i = coalesce(p.last, 0)""",
}
