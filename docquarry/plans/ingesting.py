"""Registered queries over sources, chunks and streams. Files that a source reads are written from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.scratch import shared_folder
from docquarry.operators import chunking, corpus
from docquarry.operators import understand as u
from docquarry.operators.stored import VersionedTable
from docquarry.plans import asking
from docquarry.plans.asking import _FOLLOWS, _TALK, _WORDS, ACT_KEYS, _field, _quoted
from docquarry.plans.queries import _EVENTS, _HEADING, _LINES, ORACLE_SQL, registered, table
from docquarry.sources import tables
from docquarry.streaming import events as streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docquarry-files-{uuid.uuid4().hex}"


# ── Sources ──


VOLUME = 200  # provisions of an act to a file


def _provision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a provision: its whole text under an act, and a number that is its own there."""
    i, n = F.col("doc_id"), len(ACT_KEYS)
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    act, nth = pick(ACT_KEYS, i % n), F.floor(i / n)
    return table(spark, sf_dir, "documents").select(
        act.alias("act_key"), u.act_value(act, "name").alias("act"), u.act_value(act, "unit").alias("unit"), F.concat(nth, F.when(i % 5 == 0, "A").otherwise("")).alias("number"), F.concat(F.lit("Title "), i).alias("title"), F.col("text").alias("content"),
        F.array(F.lit("c1")).alias("citations"), F.array(pick(_WORDS, i % len(_WORDS)), pick(_WORDS, i * 7 % len(_WORDS))).alias("keywords"), F.floor(nth / VOLUME).alias("volume"), "doc_id")


_EVERY = f"""pe AS (SELECT doc_id, text AS content, ({_quoted(ACT_KEYS)})[doc_id % {len(ACT_KEYS)} + 1] AS act_key, (doc_id // {len(ACT_KEYS)}) || CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE '' END AS number, [({_quoted(_WORDS)})[doc_id % {len(_WORDS)} + 1], ({_quoted(_WORDS)})[doc_id * 7 % {len(_WORDS)} + 1]] AS keywords FROM documents)"""


@registered(f"WITH {_EVERY} SELECT {_field('act_key', 'name')} AS act, {_field('act_key', 'unit')} AS unit, number, 'Title ' || doc_id AS title, md5(content) AS content_md5 FROM pe")
def scan_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All provisions written as files of acts, some hundreds of an act to a file, and read back."""
    folder = _folder(spark)
    files = _provision_rows(spark, sf_dir).groupBy("act", F.col("act").alias("short_title"), F.lit(1900).alias("year"), "unit", F.col("volume").alias("_volume")).agg(F.collect_list(F.struct("number", "title", "content", "citations", "keywords")).alias("sections"))
    # A folder for each file, so that the reader's multi-line files hold one object.
    files.withColumn("_act", F.col("act")).repartition("_act", "_volume").write.partitionBy("_act", "_volume").json(folder)
    return tables.scan_acts(spark, folder).select("act", "unit", "number", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@registered(f"""WITH {_EVERY}, t AS (SELECT *, CASE WHEN {_field('act_key', 'unit')} = 'article' THEN 'Article' ELSE 'Section' END AS un FROM pe)
    SELECT doc_id, md5(un || ' ' || number || ' — Title ' || doc_id || chr(10) || chr(10) || 'Keywords: ' || array_to_string(keywords, ', ') || chr(10) || chr(10) || content) AS text_md5, {_field('act_key', 'name')} || ' — ' || un || ' ' || number || ': Title ' || doc_id AS source FROM t""")
def provision_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text, source = tables.provision_text(c("unit"), c("number"), c("title"), c("content"), c("keywords"), c("act"))
    return _provision_rows(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), source.alias("source"))


@registered("SELECT lang, (sum(length(text) + 1))::BIGINT AS n FROM documents GROUP BY lang")
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    table(spark, sf_dir, "documents").select("text", "lang").write.partitionBy("lang").text(folder)
    t = tables.scan_text(spark, folder)
    return t.groupBy(F.regexp_extract("source", "lang=([a-z]+)", 1).alias("lang")).agg(F.sum(F.length("text")).alias("n"))


@registered("SELECT c_nationkey::VARCHAR AS nation, count(*) AS n FROM customer GROUP BY 1")
def scan_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    c = table(spark, sf_dir, "customer")
    text = [F.concat(F.lit("x"), F.col(x).cast("string")).alias(x) for x in c.columns if x != "c_nationkey"]
    c.select(*text, "c_nationkey").write.partitionBy("c_nationkey").csv(folder, sep=";", header=True)
    rows = tables.scan_csv_rows(spark, folder)
    return rows.groupBy(F.regexp_extract("source", r"c_nationkey=(\d+)", 1).alias("nation")).agg(F.sum("row_count").alias("n"))


_CELLS = "r AS (SELECT o_custkey AS source, o_orderstatus AS sheet, o_orderkey AS row_no, [o_orderkey::VARCHAR, ' ' || o_orderstatus, o_orderpriority] AS cells FROM orders)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("sheet"), F.col("o_orderkey").alias("row_no"), F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), "o_orderstatus"), "o_orderpriority").alias("cells"))


_LINE = "trim(h[1]) || ': ' || trim(cells[1]) || ' | ' || trim(h[2]) || ': ' || trim(cells[2]) || ' | ' || trim(h[3]) || ': ' || trim(cells[3])"


@registered(f"WITH {_CELLS}, f AS (SELECT *, first_value(cells) OVER (PARTITION BY source ORDER BY row_no) AS h, row_number() OVER (PARTITION BY source ORDER BY row_no) AS k FROM r) SELECT source, coalesce(string_agg({_LINE}, chr(10) || chr(10) ORDER BY row_no) FILTER (WHERE k > 1), '') AS text, count(*) FILTER (WHERE k > 1) AS row_count FROM f GROUP BY source")
def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders; the first one looks like a header."""
    return tables.render_rows(_cells(spark, sf_dir).drop("sheet"))


@registered(f"""WITH {_CELLS}, f AS (SELECT *, first_value(cells) OVER (PARTITION BY source, sheet ORDER BY row_no) AS h, row_number() OVER (PARTITION BY source, sheet ORDER BY row_no) AS k FROM r),
    s AS (SELECT source, sheet, coalesce(string_agg({_LINE}, chr(10) || chr(10) ORDER BY row_no) FILTER (WHERE k > 1), '') AS t, count(*) FILTER (WHERE k > 1) AS n FROM f GROUP BY ALL)
    SELECT source, string_agg('SHEET: ' || sheet || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END, chr(10) || chr(10) ORDER BY sheet) AS text, sum(n)::BIGINT AS row_count FROM s GROUP BY source""")
def render_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.render_sheets(_cells(spark, sf_dir))


_PAGES = """p0 AS (SELECT doc_id AS source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no, unnest(string_split(text, chr(10))) AS native FROM documents),
    pg AS (SELECT *, CASE WHEN (source + page_no) % 2 = 0 THEN 'ocr ' || page_no ELSE ' ' END AS ocr FROM p0)"""


@registered(rf"""WITH {_PAGES}, q AS (SELECT *, length(regexp_replace(native, '^\s+|\s+$', '', 'g')) >= 20 AS nat FROM pg), z AS (SELECT source, page_no, nat, NOT nat AND trim(ocr) <> '' AS tk, CASE WHEN NOT nat AND trim(ocr) <> '' THEN ocr ELSE native END AS t FROM q)
    SELECT source, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE regexp_matches(t, '\S')), '')) AS text_md5, count(*) AS page_count, count(*) FILTER (WHERE tk) AS ocr_pages, count(*) FILTER (WHERE nat) AS native_text_pages FROM z GROUP BY source""")
def stitch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a page of its own; every other page was read by recognition, too."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("page_no", "native"))
    ocr = F.when((F.col("source") + F.col("page_no")) % 2 == 0, F.concat(F.lit("ocr "), "page_no")).otherwise(" ")
    s = tables.stitch_pages(lines.withColumn("ocr", ocr))
    return s.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@registered()
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_pages(table(spark, sf_dir, "pages"))


@registered("SELECT 'question ' || item_id AS question, md5(trim(text)) AS expected_md5 FROM benchmark")
def scan_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    q = table(spark, sf_dir, "benchmark").select(F.concat(F.lit(" question "), F.col("item_id")).alias("Question"), F.col("text").alias("EXPECTED_ANSWER"))
    q.unionAll(q.limit(1).select(F.lit(" "), F.lit("x"))).write.csv(folder, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.scan_eval_set(spark, folder).select("question", F.md5(F.col("expected_answer").cast("binary")).alias("expected_md5"))


@registered("""SELECT doc_id, source, '{"extra.lang":"' || lang || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"extra.size":"' || n_chars || '"' ELSE '' END || '}' AS extra FROM documents""")
def flatten_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.create_map(F.lit("lang"), F.col("lang"), F.lit("size"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")))
    return table(spark, sf_dir, "documents").select(*tables.flatten_metadata(extra, doc_id=F.col("doc_id"), source=F.col("source")))


# ── Chunks ──


@registered(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT doc_id, line, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
    g AS (SELECT doc_id, line, i, sum(CASE WHEN i > 1 AND {_HEADING} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h), j AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS raw FROM g GROUP BY ALL),
    b AS (SELECT doc_id, section, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t, split_part(regexp_replace(raw, '^\s+|\s+$', '', 'g'), chr(10), 1) AS s FROM j) SELECT doc_id, section::INT AS section, CASE WHEN {_HEADING} THEN trim(s) END AS heading, md5(t) AS text_md5 FROM b WHERE t <> ''""")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_sections(table(spark, sf_dir, "documents")).select("doc_id", "section", "heading", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _pieces(spark: SparkSession, sf_dir: str, how: str, most: int, fold_below: int = 0) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pieces(F.col("text"), how, most, fold_below)).alias("place", "piece"))


@registered()
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "sentences", 400)


@registered()
def split_subclauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "subclauses", 400)


@registered()
def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "words", 200)


@registered()
def fold_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "sentences", 400, 200)


@registered()
def expand_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one segment each: no overlap, and windows no larger than a piece."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), chunking.ChunkConfig(max_chars=400, overlap=0, min_chars=1), source="doc_id").select("chunk_id", "start_char", "end_char", "section_title")


@registered()
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), chunking.UPLOADS, source="doc_id")


@registered()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), source="doc_id")


@registered(rf"""WITH {_LINES}, y AS (SELECT doc_id, CASE WHEN count(*) FILTER (WHERE {_HEADING}) >= 2 THEN 'section' ELSE 'paragraph' END AS strategy FROM l GROUP BY doc_id),
    p AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS t FROM documents)
    SELECT strategy, count(DISTINCT doc_id) AS documents, count(*) AS chunks, min(length(t))::INT AS least, max(length(t))::INT AS most, round(avg(length(t)), 3) AS mean FROM y JOIN p USING (doc_id) WHERE t <> '' GROUP BY strategy""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs (lines, made blank-line parts) as chunks, by what their documents' headings say of how to cut them."""
    docs = table(spark, sf_dir, "documents")
    chunks = corpus.split_paragraphs(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return chunking.chunk_stats(chunks.join(corpus.chunk_strategy(docs), "doc_id"), "doc_id")


@registered()
def ingest_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a provision. Nothing is held yet of the last act, so all of them are cut anew."""
    c = F.col
    p = _provision_rows(spark, sf_dir)
    text, source = tables.provision_text(c("unit"), c("number"), c("title"), c("content"), c("keywords"), c("act"))
    held = p.filter(F.col("act_key") != list(u.ACTS)[-1]).select("act_key")
    return corpus.ingest_corpus(p.select("act_key", source.alias("source"), text.alias("text")), held, lambda d: chunking.chunk_documents(d, chunking.STATUTES)).select("source", "chunk_id", "chunk_index", "total_chunks")


# ── Streams ──


def _stamped(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("created_at"))


@registered(f"WITH {_EVENTS} SELECT id, route FROM e")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.replay(spark, f"{sf_dir}/events.parquet", lambda e: streams.stream_events(_stamped(e)).select("id", "route"))


@registered(f"WITH {_EVENTS} SELECT time_bucket(INTERVAL 6 HOURS, created_at, TIMESTAMP '1970-01-01') AS bucket, route, count(*) AS n FROM e GROUP BY ALL")
def stream_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.replay(spark, f"{sf_dir}/events.parquet", lambda e: streams.stream_volume(_stamped(e)), "complete")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@registered(ORACLE_SQL["latency_summary"])
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in four batches of a stream; what it says last equals the summary of all."""
    folder, name = f"{_folder(spark)}/events", "spark.sql.streaming.stateStore.providerClass"
    table(spark, sf_dir, "events").repartitionByRange(4, "ts").write.parquet(folder)
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.replay(spark, folder, lambda e: streams.stream_latency(_stamped(e)), "update", per_batch=1)
    finally:
        spark.conf.set(name, before)
    figures = [c for c in out.columns if c not in ("route", "seen", "batch")]
    newest = out.groupBy("route").agg(F.max_by(F.struct(*figures), "seen").alias("_x")).select("route", "_x.*")
    return newest.select("route", "count", *(F.round(c, 3).alias(c) for c in figures if c != "count"))


@registered(f"WITH {_TALK}, l AS (SELECT *, last_value(CASE WHEN subject <> '' THEN subject END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before FROM w) SELECT session_id, turn, CASE WHEN {_FOLLOWS} AND before IS NOT NULL THEN query || ' regarding ' || before ELSE query END AS effective FROM l")
def stream_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.replay(spark, f"{sf_dir}/conversations.parquet", lambda c: streams.stream_followups(asking.as_talk(c), idle_ms=None))


@registered("""WITH b AS (SELECT source, doc_id % 3 AS n, substr(sha256(max_by(text, doc_id)), 1, 16) AS version_id, max_by(text, doc_id) AS text FROM documents GROUP BY ALL),
    s AS (SELECT *, version_id IS DISTINCT FROM lag(version_id) OVER (PARTITION BY source ORDER BY n) AS step FROM b WHERE regexp_matches(text, '\\S')),
    v AS (SELECT source, version_id, row_number() OVER (PARTITION BY source ORDER BY n)::INT AS version, n = max(n) OVER (PARTITION BY source) AS newest FROM s WHERE step)
    SELECT source, version, version_id, NOT newest AS superseded FROM v""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in three parts; the stream goes on after each, and the table's newest version is read."""
    folder = _folder(spark)
    held = VersionedTable(spark, f"{folder}/table", buckets=16)
    docs = table(spark, sf_dir, "documents").select("source", "text", F.col("doc_id").alias("seq"))
    for n in range(3):
        docs.filter(F.col("seq") % 3 == n).write.parquet(f"{folder}/arrived/{n}")
        texts = spark.readStream.schema(docs.schema).parquet(f"{folder}/arrived/*")
        streams.stream_ingest(texts, held, "now", f"{folder}/state")
    return held.read().select("source", "version", "version_id", "superseded")
