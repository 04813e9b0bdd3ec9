"""The registered queries of the document engine over the driver's tables, each with the SQL that must give the same rows.

Roles of the tables: documents are the corpus (source as act), benchmark the questions, embeddings the chunk vectors,
events the query events (type as route and intent, value as latency), conversations the session turns, orders and
lineitem the jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.scratch import dealt, shared_folder
from docquarry.operators import analytics, corpus, evaluate, fusion, lexical

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# ── Tables in their roles ──


def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("has_error"), F.col("ts").alias("created_at"))


def as_of(spark: SparkSession, sf_dir: str) -> F.Column:
    return F.lit(table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


_EVENTS = "e AS (SELECT event_id AS id, user_id AS session_id, event_type AS route, value AS latency_ms, event_type = 'error' AS has_error, ts AS created_at FROM events), m AS (SELECT max(ts) AS as_of FROM events)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-chunk sources in two versions: every third is superseded, every seventh has no version id."""
    d, id_ = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(id_.alias("chunk_id"), "source", "text", F.when(id_ % 7 != 0, tx.version_hash(F.col("text"))).alias("version_id"), (id_ % 3 + 1).cast("int").alias("version"), F.when(id_ % 5 != 0, id_ % 3 == 0).alias("superseded"), F.col("n_chars").alias("ingested_at"))


_CHUNKS = "c AS (SELECT doc_id AS chunk_id, source, text, CASE WHEN doc_id % 7 <> 0 THEN substr(sha256(text), 1, 16) END AS version_id, (doc_id % 3 + 1)::INT AS version, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 END AS superseded, n_chars AS ingested_at FROM documents)"

# ── Text expressions over all documents ──

_LEX = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{tx.LEXICAL_TOKEN}'), lambda t: t NOT IN {_in(tx.LEXICAL_STOP)})"


def _noise(x: str) -> str:
    x = rf"regexp_replace({x}, '\[\d{{1,3}}\]', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)\(source:\s*[^)]+\)', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?mi)^\*{{0,2}}(?:section|article|clause)\s+\d+[A-Za-z]?\s*[—\-:].*$', ' ', 'g')"
    for p in tx.BOILERPLATE:
        x = f"regexp_replace({x}, '(?is){p}', ' ', 'g')"
    return f"regexp_replace({x}, '[–—‒]', ' ', 'g')"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({_noise(f'coalesce({x}, {chr(39)}{chr(39)})')}), '[^\p{{L}}\p{{M}}\p{{N}}_\s§%]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _stem(t: str) -> str:
    out = f"CASE WHEN length({t}) <= 3 THEN {t}"
    for s in tx.SUFFIXES:
        stem = f"substr({t}, 1, length({t}) - {len(s)})"
        if s in ("ed", "ing", "er"):
            last = f"substr({stem}, length({stem}), 1)"
            stem = f"CASE WHEN length({stem}) >= 4 AND {last} = substr({stem}, length({stem}) - 1, 1) AND {last} NOT IN {_in(list('aeiouy'))} THEN substr({stem}, 1, length({stem}) - 1) ELSE {stem} END"
        out += f" WHEN {t} LIKE '%{s}' AND length({t}) >= {len(s) + 3} THEN {stem}"
    return out + f" ELSE {t} END"


def _eval_tokens(x: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(lower({_noise(x)}), '[a-z0-9]+'), lambda t: t NOT IN {_in(tx.ARTICLES)}), lambda t: {_stem('t')})"


def _joined(column: F.Column) -> F.Column:
    return F.array_join(column.cast("array<string>"), " ")


@registered(f"SELECT doc_id, array_to_string({_LEX}, ' ') AS tokens FROM documents")
def tokenize_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _joined(tx.tokenize_lexical(F.col("text"))).alias("tokens"))


@registered(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) > 2 AND t NOT IN {_in(tx.RERANK_STOP)}))), ' ') AS tokens FROM documents")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _joined(F.sort_array(tx.content_tokens(F.col("text")))).alias("tokens"))


@registered(f"SELECT doc_id, md5({_noise('text')}) AS stripped_md5 FROM documents")
def strip_answer_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.strip_answer_noise(F.col("text")).cast("binary")).alias("stripped_md5"))


@registered(f"SELECT doc_id, {_normal('text')} AS normal FROM documents")
def normalize_for_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_for_eval(F.col("text")).alias("normal"))


@registered(f"SELECT w AS token, {_stem('w')} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)")
def stem_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token")).distinct()
    return words.select("token", tx.stem_suffix(F.col("token")).alias("stem"))


@registered(f"SELECT item_id, array_to_string({_eval_tokens('text')}, ' ') AS tokens FROM benchmark")
def eval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", _joined(tx.eval_tokens(F.col("text"))).alias("tokens"))


@registered(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({_noise('text')}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {_in(tx.EVAL_STOP)}), lambda t: {_stem('t')}))), ' ') AS keywords FROM benchmark")
def eval_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", _joined(F.sort_array(tx.eval_keywords(F.col("text")))).alias("keywords"))


@registered("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)))::BIGINT AS n FROM documents")
def bench_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.bench_tokens(F.col("text"))).cast("long").alias("n"))


@registered(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '[.,]', '', 'g'), '\b(1[89]\d{2}|20\d{2})\b', '', 'g'), '^the\s+', ''), '\s+', ' ', 'g')) AS alias FROM pages")
def normalise_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.normalise_alias(F.col("url")).alias("alias"))


_SECTIONS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '(?i)(?:(?:section|sec|s\.|article|art\.|art|§)\s*)?(\d{{1,4}}[a-z]?)', 1), lambda x: lower(x))"


@registered(f"SELECT page_id, array_to_string(list_sort(list_distinct({_SECTIONS.format('url')})), ' ') AS numbers FROM pages")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _joined(F.sort_array(tx.section_numbers(F.col("url")))).alias("numbers"))


@registered(r"SELECT doc_id, upper(trim(regexp_replace(regexp_replace(trim('Sec. ' || n_chars || ' (1)'), '(?i)^(?:section|sec\.?|article|art\.?)\s*', ''), '\s*\([^)]+\)$', ''))) AS ref FROM documents")
def norm_provision_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.norm_provision_ref(F.concat(F.lit("Sec. "), F.col("n_chars"), F.lit(" (1)"))).alias("ref"))


@registered("SELECT doc_id, substr(sha256(text), 1, 16) AS version_id, substr(sha256(source || chr(0) || '0' || chr(0) || substr(text, 1, 200)), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.version_hash(F.col("text")).alias("version_id"), tx.chunk_id(F.col("source"), F.lit(0), F.col("text")).alias("chunk_id"))


@registered(r"SELECT doc_id, md5(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, length(text) // 2) || ' lsv2_' || md5(text) || ' ' || substr(text, length(text) // 2 + 1) END, 'ls(?:__|v2_)[A-Za-z0-9_\-]{20,}', '<redacted>', 'g')) AS text_md5 FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, two of three with a key in their middle."""
    half = F.floor(F.length("text") / 2).cast("int")
    keyed = F.concat(F.substr("text", F.lit(1), half), F.lit(" lsv2_"), F.md5(F.col("text").cast("binary")), F.lit(" "), F.substr("text", half + 1))
    text = tx.redact_secrets(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(keyed))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


@registered("SELECT page_id, (CASE WHEN regexp_replace(url, '[^0-9]', '', 'g') = '' THEN 1 ELSE 0 END)::INT AS no_digits, coalesce(TRY_CAST(regexp_replace(url, '[^0-9]', '', 'g') AS BIGINT), 0) AS number, regexp_replace(url, '[0-9]', '', 'g') AS rest FROM pages")
def natural_number_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.natural_number_key(F.col("url")).alias("k")).select("page_id", "k.*")


@registered("SELECT event_id, 'query' || '.route=' || event_type || '.user=' || user_id AS metric, 'query' AS name, event_type AS route, user_id::VARCHAR AS user FROM events")
def metric_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and, by the inverse, what they were made of."""
    e = table(spark, sf_dir, "events").select("event_id", tx.metric_key(F.lit("query"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("route"), F.col("event_type"), F.lit("none"), F.lit(""))).alias("metric"))
    name, tags = tx.split_metric_key(F.col("metric"))
    return e.select("event_id", "metric", name.alias("name"), tags["route"].alias("route"), tags["user"].alias("user"))


@registered("SELECT event_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket FROM events")
def floor_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.floor_bucket(F.col("ts"), 21_600).alias("bucket"))


# ── Corpus ──


@registered(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS word_count, length(text)::BIGINT AS char_count, octet_length(encode(text))::BIGINT AS byte_size FROM documents")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.doc_stats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("word_count", "char_count", "byte_size")))


_HEADING = r"""length(s) BETWEEN 1 AND 120 AND (regexp_matches(s, '^\d+(?:\.\d+)*\.?\s+[A-Z]')
    OR (regexp_matches(s, '^[MDCLXVI]') AND regexp_matches(s, '^M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\.\s+[A-Z]'))
    OR regexp_matches(s, '(?i)^(?:CHAPTER|PART|SCHEDULE|ANNEXURE|APPENDIX|TITLE|BOOK)\s+(?:\d+|[IVXLC]+|[A-Z])\b')
    OR regexp_matches(s, '(?i)^(?:(?:section|article|clause|rule|order|regulation|provision)\s+|§\s*)\d+[A-Za-z]?')
    OR (length(s) BETWEEN 5 AND 80 AND s = upper(s) AND regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[.!?,;]')))"""
_LINES = "l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@registered(f"WITH {_LINES} SELECT doc_id, line_no::BIGINT AS line_no, {_HEADING} AS heading FROM l")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.heading_lines(table(spark, sf_dir, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


@registered(f"WITH {_LINES} SELECT doc_id, CASE WHEN count(*) FILTER (WHERE {_HEADING}) >= 2 THEN 'section' ELSE 'paragraph' END AS strategy FROM l GROUP BY doc_id")
def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_strategy(table(spark, sf_dir, "documents"))


@registered("SELECT doc_id, (sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2)::BIGINT AS start, md5(p) AS text_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(p) > 0")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with doubled line ends, so that every line is a paragraph."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return corpus.split_paragraphs(d).select("doc_id", "start", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@registered(f"WITH {_CHUNKS} SELECT source, count(*) AS chunks_total, count(*) FILTER (WHERE NOT coalesce(superseded, false)) AS chunks_active, greatest(1, count(DISTINCT version_id)) AS versions, max(ingested_at) AS latest_ingested_at FROM c GROUP BY source")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_summary(chunks(spark, sf_dir))


@registered(f"WITH {_CHUNKS} SELECT source, coalesce(version_id, '<legacy>') AS version_id, max(version) AS version, bool_and(coalesce(superseded, false)) AS superseded, max(ingested_at) AS ingested_at, count(*) AS chunk_count FROM c GROUP BY 1, 2")
def versions_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.versions_for(chunks(spark, sf_dir))


@registered(f"WITH {_CHUNKS} SELECT chunk_id, source FROM c WHERE NOT coalesce(superseded, false)")
def active_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.active_only(chunks(spark, sf_dir)).select("chunk_id", "source")


@registered(f"""WITH {_CHUNKS}, v AS (SELECT source, max(version) AS version FROM c GROUP BY source),
    a AS (SELECT source, version_id, row_number() OVER (PARTITION BY source ORDER BY version DESC, version_id DESC) AS k FROM c WHERE NOT coalesce(superseded, false) AND version_id IS NOT NULL QUALIFY k = 1)
    SELECT source, version, version_id AS active_version_id FROM v LEFT JOIN a USING (source)""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.latest_version(chunks(spark, sf_dir))


@registered(f"WITH {_CHUNKS} SELECT count(DISTINCT source) AS sources, count(*) AS chunks_total, count(*) FILTER (WHERE NOT coalesce(superseded, false)) AS chunks_active FROM c")
def documents_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_summary(chunks(spark, sf_dir)).agg(F.count("*").alias("sources"), F.sum("chunks_total").alias("chunks_total"), F.sum("chunks_active").alias("chunks_active"))


@registered(f"WITH {_CHUNKS} SELECT source, count(*) FILTER (WHERE coalesce(superseded, false) OR source = 'src0') AS n FROM c GROUP BY source")
def supersede_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.supersede_source(chunks(spark, sf_dir), "src0").groupBy("source").agg(F.count_if(F.coalesce("superseded", F.lit(False))).alias("n"))


@registered("SELECT chunk_id, max(len) AS len FROM (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS len FROM documents UNION ALL SELECT -doc_id - 1, n_chars FROM documents WHERE doc_id % 4 = 0) GROUP BY chunk_id")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("len"))
    fourth = d.filter("chunk_id % 4 = 0")
    return corpus.upsert_chunks(d, fourth.withColumn("len", F.col("len") + 1).unionAll(fourth.select((-F.col("chunk_id") - 1).alias("chunk_id"), "len")))


@registered("WITH r AS (SELECT DISTINCT source FROM documents), i AS (SELECT DISTINCT 'src' || label AS source FROM embeddings) SELECT source, CASE WHEN i.source IS NULL THEN 'missing' WHEN r.source IS NULL THEN 'orphan' ELSE 'indexed' END AS status FROM r FULL JOIN i USING (source)")
def corpus_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src"), F.col("label")).alias("source"))
    return corpus.corpus_parity(table(spark, sf_dir, "documents"), index, "source")


# ── Retrieval ──

_POST = f"""t AS (SELECT doc_id AS chunk_id, {_LEX} AS ts FROM documents),
    p AS (SELECT chunk_id, term, len(any_value(ts)) AS dl, count(*) AS tf FROM (SELECT chunk_id, ts, unnest(ts) AS term FROM t) GROUP BY chunk_id, term),
    n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    w AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, n),
    i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM w) ELSE raw END AS idf FROM w)"""
_BM25 = f"""{_POST},
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_LEX}) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN i USING (term) JOIN p USING (term), n GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 10)"""


@registered(f"WITH {_POST} SELECT term, chunk_id, dl::INT AS dl, tf FROM p")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id")


@registered(f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_stats(table(spark, sf_dir, "documents"), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@registered(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM b")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_search(questions(spark, sf_dir), table(spark, sf_dir, "documents"), chunk_id="doc_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return fusion.vector_search(e.filter("vec_id % 50 = 0"), e, query_id="vec_id", chunk_id="vec_id")


_VECTOR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    x AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM x QUALIFY rank <= 10)"""


@registered(f"WITH {_VECTOR} SELECT query_id, chunk_id, score, rank FROM k")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir)


@registered(f"""WITH {_BM25}, g AS (SELECT query_id, chunk_id, round(length(dt.text) / 1000.0, 6) AS score FROM b JOIN documents dt ON dt.doc_id = b.chunk_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM g),
    u AS (SELECT query_id, chunk_id, rank, 0.6 AS w FROM h UNION ALL SELECT query_id, chunk_id, rank, 0.4 FROM b),
    f AS (SELECT query_id, chunk_id, round(sum(w::DOUBLE / (60 + rank)), 9) AS fused_score FROM u GROUP BY ALL)
    SELECT query_id, chunk_id, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id)::INT AS fused_rank FROM f""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 list fused with the same chunks ranked by length."""
    b = lexical.bm25_search(questions(spark, sf_dir), table(spark, sf_dir, "documents"), chunk_id="doc_id")
    longest = b.select("query_id", "chunk_id").join(table(spark, sf_dir, "documents"), F.col("chunk_id") == F.col("doc_id")).select("query_id", "chunk_id", F.round(F.length("text") / 1000.0, 6).alias("score"))
    return fusion.rrf_fuse(lexical.top_k(longest, 10, ["query_id"]), b, 20, weights=(0.6, 0.4)).select("query_id", "chunk_id", "fused_score", "fused_rank")


@registered(f"""WITH {_BM25}, y AS (SELECT b.*, dt.source, dt.lang AS number FROM b JOIN documents dt ON dt.doc_id = b.chunk_id),
    o AS (SELECT *, (row_number() OVER (PARTITION BY query_id, source, number ORDER BY rank) > 1)::INT AS demoted FROM y)
    SELECT query_id, chunk_id, demoted, row_number() OVER (PARTITION BY query_id ORDER BY demoted, CASE WHEN demoted = 0 THEN rank END, CASE WHEN demoted = 1 THEN score * 0.85 END DESC, rank)::INT AS final_rank FROM o QUALIFY final_rank <= 5""")
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bm25_search(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("number")), "chunk_id")
    return fusion.diversify(b, 5).select("query_id", "chunk_id", "demoted", "final_rank")


# ── Evaluation ──

_PAIRS = "a AS (SELECT x.doc_id AS id, x.text AS generated, y.text AS expected FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)"


def _answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    answers, gold = d.select(F.col("doc_id").alias("id"), F.col("text").alias("generated")), d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("expected"))
    return dealt(answers, "id").join(dealt(gold, "id"), "id")


_SCORED = f"""{_PAIRS}, n AS (SELECT id, {_normal('generated')} AS g, {_normal('expected')} AS e FROM a),
    k AS (SELECT id, list_distinct(list_transform(list_filter(regexp_extract_all(lower({_noise('g')}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {_in(tx.EVAL_STOP)}), lambda t: {_stem('t')})) AS gk,
              list_distinct(list_transform(list_filter(regexp_extract_all(lower({_noise('e')}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {_in(tx.EVAL_STOP)}), lambda t: {_stem('t')})) AS ek, {_eval_tokens('g')} AS gt, {_eval_tokens('e')} AS et FROM n),
    gc AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(gt) AS w FROM k) GROUP BY ALL), ec AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(et) AS w FROM k) GROUP BY ALL),
    sm AS (SELECT id, sum(least(gc.c, ec.c)) AS same FROM gc JOIN ec USING (id, w) GROUP BY id),
    sc AS (SELECT id, CASE WHEN len(gt) = 0 AND len(et) = 0 THEN 1.0::DOUBLE WHEN len(gt) = 0 OR len(et) = 0 OR same IS NULL THEN 0.0 ELSE round(2.0::DOUBLE * same / (len(gt) + len(et)), 4) END AS f1,
           CASE WHEN len(gk) = 0 AND len(ek) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(gk, ek))::DOUBLE / len(list_distinct(list_concat(gk, ek))), 4) END AS keyword_overlap FROM k LEFT JOIN sm USING (id))"""


@registered(f"WITH {_SCORED} SELECT id, f1, keyword_overlap FROM sc")
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the answer, the one of the next id as gold."""
    return evaluate.score_answers(_answer_pairs(spark, sf_dir))


@registered("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.e, b.e))), 4) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", tx.cosine_pair(F.col("a"), F.col("b")).alias("cosine"))


_BENCH = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2))"


@registered(f"WITH {_PAIRS}, k AS (SELECT id, {_BENCH.format('generated')} AS g, {_BENCH.format('expected')} AS e FROM a) SELECT id, CASE WHEN len(e) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(e, g))::DOUBLE / len(e), 4) END AS overlap FROM k")
def retrieval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer_pairs(spark, sf_dir).select("id", evaluate.retrieval_overlap(F.col("generated"), F.col("expected")).alias("overlap"))


_RUNS = "ra AS (SELECT doc_id::VARCHAR || '/' || source AS question, (n_chars % 97) / 97.0::DOUBLE AS f1 FROM documents WHERE doc_id % 5 <> 0), rb AS (SELECT doc_id::VARCHAR || '/' || source AS question, (n_chars % 89) / 89.0::DOUBLE AS f1 FROM documents WHERE doc_id % 7 <> 0)"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").withColumn("question", F.concat_ws("/", "doc_id", "source"))
    return (d.filter("doc_id % 5 <> 0").select("question", (F.col("n_chars") % 97 / 97.0).alias("f1")), d.filter("doc_id % 7 <> 0").select(F.concat(F.lit(" "), "question").alias("question"), (F.col("n_chars") % 89 / 89.0).alias("f1")))


_COMPARED = f"{_RUNS}, j AS (SELECT question, round(rb.f1 - ra.f1, 4) AS delta FROM ra FULL JOIN rb USING (question)), z AS (SELECT question, delta, CASE WHEN delta IS NULL THEN 'missing' WHEN abs(delta) < 0.005 THEN 'flat' WHEN delta > 0 THEN 'improved' ELSE 'regressed' END AS verdict FROM j)"


@registered(f"WITH {_COMPARED} SELECT question, delta, verdict FROM z")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare_runs(*_runs(spark, sf_dir)).select("question", "delta", "verdict")


@registered(f"WITH {_COMPARED} SELECT verdict, count(*) AS n, NULL::DOUBLE AS mean_delta FROM z GROUP BY verdict UNION ALL SELECT 'mean f1', NULL, round((SELECT avg(f1) FROM rb) - (SELECT avg(f1) FROM ra), 4)")
def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions went which way, and how the metric's mean moved."""
    a, b = _runs(spark, sf_dir)
    counts = evaluate.compare_runs(a, b).groupBy("verdict").agg(F.count("*").alias("n")).withColumn("mean_delta", F.lit(None).cast("double"))
    return counts.unionByName(evaluate.mean_deltas(a, b).select(F.concat(F.lit("mean "), "metric").alias("verdict"), F.lit(None).cast("long").alias("n"), F.col("delta").alias("mean_delta")))


@registered("SELECT count(*) AS total_rows, count(*) FILTER (WHERE quality = 1) AS scored_rows, count(*) FILTER (WHERE quality <> 1) AS failed_rows, round(avg(n_chars) FILTER (WHERE quality = 1), 4) AS n_chars_mean, min(n_chars) FILTER (WHERE quality = 1) AS n_chars_min, max(n_chars) FILTER (WHERE quality = 1) AS n_chars_max FROM documents JOIN labels USING (doc_id)")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("error", F.when(F.col("quality") != 1, "bad"))
    return evaluate.eval_aggregate(rows, ["n_chars"])


# ── Analytics ──


@registered(f"""WITH {_EVENTS}, r AS (SELECT * FROM e, m WHERE created_at >= as_of - INTERVAL 7 DAYS),
    b AS (SELECT floor(epoch(created_at) / 21600)::BIGINT * 21600 AS bucket, route, count(*) AS n FROM r GROUP BY ALL),
    g AS (SELECT unnest(range(floor((epoch(as_of) - 604800) / 21600)::BIGINT * 21600, floor(epoch(as_of) / 21600)::BIGINT * 21600 + 1, 21600)) AS bucket FROM m)
    SELECT g.bucket, x.route, coalesce(b.n, 0) AS n FROM g CROSS JOIN (SELECT DISTINCT route FROM b) x LEFT JOIN b ON b.bucket = g.bucket AND b.route = x.route""")
def volume_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.volume_by_route(query_events(spark, sf_dir), as_of(spark, sf_dir), "7d")


@registered(f"WITH {_EVENTS} SELECT route, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 4) AS share FROM e, m WHERE created_at >= as_of - INTERVAL 30 DAYS GROUP BY route")
def route_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.share(analytics.range_filter(query_events(spark, sf_dir), as_of(spark, sf_dir), "30d"), "route")


@registered(f"WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE has_error) AS errors, round(count(*) FILTER (WHERE has_error) / count(*)::DOUBLE, 4) AS error_rate, round(avg(latency_ms), 2) AS avg_latency_ms FROM e, m WHERE created_at >= as_of - INTERVAL 7 DAYS")
def overall_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overall_totals(analytics.range_filter(query_events(spark, sf_dir), as_of(spark, sf_dir), "7d"))


@registered(f"""WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY created_at DESC, id DESC) AS k FROM e QUALIFY k <= 10000),
    o AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY latency_ms, id) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM r)
    SELECT route, count(*) AS count, round(avg(latency_ms), 3) AS mean, max(round(latency_ms, 3)) FILTER (WHERE i = least(n - 1, floor(0.5 * n))) AS p50, max(round(latency_ms, 3)) FILTER (WHERE i = least(n - 1, floor(0.95 * n))) AS p95,
           max(round(latency_ms, 3)) FILTER (WHERE i = least(n - 1, floor(0.99 * n))) AS p99, round(max(latency_ms), 3) AS max FROM o GROUP BY route""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latency_summary(query_events(spark, sf_dir), ["route"], "latency_ms")


@registered(f"WITH {_EVENTS} SELECT id, route, latency_ms FROM e WHERE has_error ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent_failures(query_events(spark, sf_dir)).select("id", "route", "latency_ms")


@registered(f"WITH {_EVENTS} SELECT id FROM e, m WHERE created_at >= as_of - INTERVAL 10 DAYS")
def prune_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.prune(query_events(spark, sf_dir), as_of(spark, sf_dir), 10).select("id")


@registered("SELECT o_orderkey AS id, min(o_orderkey) OVER () AS next_cursor FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50)")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.keyset_page(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 50)


@registered("""SELECT doc_id AS id, substr(source || lang, 1, 64) AS intent, substr(repeat(source, 20), 1, 32) AS route, substr(repeat(lang, 50), 1, 64) AS domain, substr(text, 1, 255) AS error_reason,
    CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '…' ELSE text END AS query_preview, DATE '2024-01-01' + (doc_id % 5)::INT AS day FROM documents""")
def append_query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events of five days, appended in two parts and read back."""
    i, path = F.col("doc_id"), f"{shared_folder(spark)}/docquarry-events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "documents").select(i.alias("id"), F.concat("source", "lang").alias("intent"), F.repeat("source", 20).alias("route"), F.repeat("lang", 50).alias("domain"), F.col("text").alias("error_reason"), F.col("text").alias("query"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 5).cast("int")).cast("timestamp").alias("created_at"))
    for part in (0, 1):
        analytics.append_query_events(e.filter(F.col("id") % 2 == part), path)
    return spark.read.parquet(path).drop("created_at")


_TURNS = "t AS (SELECT conv_id AS session_id, turn, CASE WHEN turn % 4 = 0 THEN 'subject ' || turn ELSE '' END AS subject FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("subject "), F.col("turn"))).otherwise("").alias("subject"))


@registered(f"WITH {_TURNS} SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC)::INT AS age FROM t QUALIFY age <= 6")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.recent_turns(_turns(spark, sf_dir)).select("session_id", "turn", "age")


@registered(f"WITH {_TURNS} SELECT session_id, turn, last_value(CASE WHEN subject <> '' THEN subject END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS last_subject FROM t")
def last_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.last_subject(_turns(spark, sf_dir)).select("session_id", "turn", "last_subject")
