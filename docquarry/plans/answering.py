"""Registered queries from ranked hits to answers. Documents are chunks of an act each; questions are a phrase and a benchmark text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.scratch import written
from docquarry.operators import answer, lexical
from docquarry.operators import understand as u
from docquarry.plans import asking
from docquarry.plans.asking import _ASKED, _INTENTS, _UNDERSTOOD, ACT_KEYS, PHRASES, _field, _quoted
from docquarry.plans.queries import _BM25, _in, registered, table


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % len(PHRASES)).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(phrase, F.lit(" "), "text").alias("query"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk: of an act by its id, five chunks to a source, every eighth superseded."""
    i = F.col("doc_id")
    key = F.get(F.array(*map(F.lit, ACT_KEYS)), (i % len(ACT_KEYS)).cast("int"))
    c = table(spark, sf_dir, "documents").select(i.alias("chunk_id"), "text", key.alias("act_key"), F.concat(i % 40, F.when(i % 5 == 0, "A").otherwise("")).alias("number"), (i / 105).cast("int").alias("_s"), (i % 5).cast("int").alias("chunk_index"), (i % 8 == 0).alias("superseded"), F.col("lang").alias("jurisdiction"))
    return c.withColumn("domain", u.domain_lookup(F.col("act_key"))).withColumn("source", F.concat(u.act_value(F.col("act_key"), "name"), F.lit(" — part "), "_s")).drop("_s")


_ASKS = f"a AS (SELECT item_id AS query_id, ({_quoted(PHRASES)})[item_id % {len(PHRASES)} + 1] || ' ' || text AS query FROM benchmark)"
_UN = _UNDERSTOOD.replace(_ASKED, _ASKS)
_LIBRARY = f"""l0 AS (SELECT doc_id AS chunk_id, text, ({_quoted(ACT_KEYS)})[doc_id % {len(ACT_KEYS)} + 1] AS act_key, (doc_id % 40) || CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE '' END AS number, (doc_id // 105) AS part, (doc_id % 5)::INT AS chunk_index, doc_id % 8 = 0 AS superseded, lang AS jurisdiction FROM documents),
    l AS (SELECT *, {_field('act_key', 'domain')} AS domain, {_field('act_key', 'name')} || ' — part ' || part AS source FROM l0)"""
_HITS = _BM25.replace("q AS (", "qq AS (").replace("FROM q JOIN", "FROM qq JOIN")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every benchmark text."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.bm25_search(q, table(spark, sf_dir, "documents"), chunk_id="doc_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).select("query_id", "chunk_id", "rank", (F.col("chunk_id") % 10 / 10.0).alias("sim"))
    return answer.signal_scores(h, asks(spark, sf_dir), library(spark, sf_dir))


_RW = f"list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z]+'), lambda t: length(t) > 2 AND t NOT IN {_in(tx.RERANK_STOP)}))"
_SIGNALS = rf"""{_UN}, {_LIBRARY}, {_HITS}, wq AS (SELECT query_id, terms, {_RW} AS words, list_concat(u2.acts[:0], list_filter(list_concat(tacts, named_words), lambda k: k IS NOT NULL)) AS want, regexp_extract_all(lower(query), '\b(\d{{1,4}}[a-z]?)\b', 1) AS nums FROM (SELECT un.*, a1.named[2:] AS named_words FROM un JOIN a1 USING (query_id)) u2),
    x AS (SELECT b.query_id, b.chunk_id, b.rank, (b.chunk_id % 10) / 10.0::DOUBLE AS sim, len(list_filter(terms, lambda t: contains(lower(l.text), lower(t)))) AS th, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda t: contains(lower(l.text), substr(t, 1, 4)))) / len(words)::DOUBLE ELSE 0 END AS dens,
        CASE WHEN list_contains(want, l.act_key) THEN 1.0::DOUBLE WHEN list_contains(list_transform(want, lambda k: {_field('k', 'domain')}), l.domain) THEN 0.5 ELSE 0 END AS act, CASE WHEN list_contains(nums, lower(l.number)) THEN 1.0::DOUBLE ELSE 0 END AS sec FROM b JOIN wq USING (query_id) JOIN l ON l.chunk_id = b.chunk_id),
    sg AS (SELECT query_id, chunk_id, rank, round(0.28::DOUBLE * sim + 0.42::DOUBLE * least(th, 3) / 3.0::DOUBLE + 0.14::DOUBLE * dens + 0.10::DOUBLE * act + 0.06::DOUBLE * sec + 1e-9::DOUBLE, 4) AS rerank_score FROM x),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS rerank_rank, max(rerank_score) OVER (PARTITION BY query_id) AS top FROM sg),
    kp AS (SELECT * FROM rk WHERE rerank_rank = 1 OR (rerank_rank <= 3 AND rerank_score >= 0.18 AND rerank_score >= 0.78::DOUBLE * top))"""


@registered(f"WITH {_SIGNALS} SELECT query_id, chunk_id, rerank_score FROM sg")
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "chunk_id", "rerank_score")


@registered(f"WITH {_SIGNALS} SELECT query_id, chunk_id, rerank_rank, CASE WHEN rerank_rank = 1 THEN 'primary' ELSE 'related' END AS label FROM kp")
def signal_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.signal_rerank(_scored(spark, sf_dir)).select("query_id", "chunk_id", "rerank_rank", "label")


@registered(f"""WITH {_SIGNALS}, nk AS (SELECT query_id, count(*) AS n FROM kp GROUP BY query_id), nb AS (SELECT query_id, count(*) AS m FROM b GROUP BY query_id),
    o AS (SELECT b.query_id, b.chunk_id, row_number() OVER (PARTITION BY b.query_id ORDER BY kp.rerank_rank IS NULL, kp.rerank_rank, b.rank)::INT AS place FROM b LEFT JOIN kp ON kp.query_id = b.query_id AND kp.chunk_id = b.chunk_id)
    SELECT query_id, chunk_id, place FROM o JOIN nk USING (query_id) JOIN nb USING (query_id) WHERE place <= CASE WHEN n < least(5, m) THEN 10 ELSE n END""")
def backfill_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return answer.backfill_shortlist(scored.select("query_id", "chunk_id", "rank"), answer.signal_rerank(scored), 5).select("query_id", "chunk_id", "place")


@registered(f"WITH {_SIGNALS} SELECT query_id, chunk_id, round(greatest(0, least(1, rerank_score / greatest(top, 0.001::DOUBLE))) + 1e-9::DOUBLE, 6) AS normalised FROM rk")
def normalised_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.normalised_rerank(_scored(spark, sf_dir)).select("query_id", "chunk_id", "normalised")


@registered()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that ask for an overview get one; the test against brute force has the vectors given."""
    asked = asks(spark, sf_dir).withColumn("overview", u.classify_intent(F.col("query"))["intent"] == "legal_overview")
    return answer.hybrid_retrieve(asked, library(spark, sf_dir), overview="overview")


@registered()
def vector_rerank_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.vector_rerank_path(asks(spark, sf_dir), library(spark, sf_dir))


@registered()
def benchmark_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expected"))
    return answer.benchmark_pipelines(asks(spark, sf_dir).join(expected, "query_id"), library(spark, sf_dir))


@registered()
def answer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations with its answer; the provisions are the documents' least for each act and number."""
    talk = asking.talk(spark, sf_dir).withColumn("query_id", F.concat_ws("/", "session_id", "turn"))
    whole = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Provision "), "doc_id").alias("title"), F.col("text").alias("content"), F.array(F.col("source")).alias("citations"))
    provisions = asking.provisions(spark, sf_dir).join(whole, "doc_id").drop("doc_id")
    return answer.answer_queries(talk, library(spark, sf_dir), provisions)


_NUMBER = "regexp_replace(number, '[^0-9]', '', 'g')"
_SAMPLE = f"""f AS (SELECT act_key, source, min_by({{'chunk_id': chunk_id, 'number': number}}, {{'i': chunk_index, 'c': chunk_id}}) AS c FROM l WHERE NOT superseded GROUP BY ALL),
    g AS (SELECT act_key, c.chunk_id AS chunk_id, {{'a': ({_NUMBER.replace('number', 'c.number')} = '')::INT, 'b': {_NUMBER.replace('number', 'c.number')}::BIGINT, 'c': regexp_replace(c.number, '[0-9]', '', 'g')}} AS k FROM f)"""


@registered(f"WITH {_UNDERSTOOD}, {_LIBRARY}, {_SAMPLE}, h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k, chunk_id)::INT AS place FROM un JOIN g ON list_contains(acts, act_key) QUALIFY place <= 12) SELECT query_id, chunk_id, place FROM h")
def overview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = u.understood(asking.asked(spark, sf_dir)).select("query_id", "act_keys")
    return answer.overview_sample(q, library(spark, sf_dir))


@registered(f"WITH {_UNDERSTOOD}, {_INTENTS.replace(_ASKED + ', ', '')}, {_LIBRARY}, {_SAMPLE}, h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k, chunk_id)::INT AS place FROM un JOIN c USING (query_id) JOIN g ON list_contains(acts, act_key) WHERE intent = 'legal_overview' QUALIFY place <= 12) SELECT query_id, chunk_id, place FROM h")
def overview_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.overview_retrieve(asking.asked(spark, sf_dir), library(spark, sf_dir))


@registered(f"WITH {_LIBRARY}, {_HITS}, g AS (SELECT query_id, act_key, count(*) AS n, min(rank) AS first, string_agg(number, ', ' ORDER BY rank) AS numbers FROM b JOIN l USING (chunk_id) GROUP BY ALL) SELECT query_id, act_key, n, numbers, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first)::INT AS place FROM g")
def overview_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.overview_groups(hits(spark, sf_dir), library(spark, sf_dir))


_ANSWERS = "an AS (SELECT item_id AS query_id, 'see [' || (item_id % 14) || '], [' || (item_id % 3) || '] and [' || (item_id % 14) || ']' AS answer FROM benchmark), mk AS (SELECT query_id, list_transform(regexp_extract_all(answer, '\\[(\\d{1,2})\\]', 1), lambda x: x::INT) AS m0 FROM an), ms AS (SELECT query_id, list_filter(m0, lambda x, i: list_position(m0, x) = i) AS m FROM mk)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat(F.lit("see ["), i % 14, F.lit("], ["), i % 3, F.lit("] and ["), i % 14, F.lit("]")).alias("answer"))


_CITED = f"{_HITS}, {_ANSWERS}, mu AS (SELECT query_id, unnest(m) AS rank, generate_subscripts(m, 1) - 1 AS place FROM ms), ci AS (SELECT query_id, chunk_id, place::INT AS place, score FROM mu JOIN b USING (query_id, rank)), ct AS (SELECT * FROM ci UNION ALL SELECT query_id, chunk_id, 0, score FROM b WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM ci))"


@registered(f"WITH {_CITED} SELECT query_id, chunk_id, place FROM ct")
def citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.citation_join(_answers(spark, sf_dir), written(hits(spark, sf_dir), "hits"))


@registered(f"WITH {_CITED} SELECT query_id, round(avg(score) + 1e-9::DOUBLE, 4) AS confidence FROM ct GROUP BY query_id")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = written(hits(spark, sf_dir), "hits")
    return answer.answer_confidence(answer.citation_join(_answers(spark, sf_dir), h).join(h.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"]))


@registered(f"WITH {_LIBRARY}, {_HITS}, {_ASKS}, cx AS (SELECT query_id, string_agg('[' || rank || '] (source: ' || source || ')' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS c FROM b JOIN l USING (chunk_id) GROUP BY query_id) "
            "SELECT query_id, md5('Context passages:' || chr(10) || chr(10) || coalesce(c, '') || chr(10) || chr(10) || 'Question: ' || regexp_replace(query, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Answer using only the passages above, citing them as [n].') AS prompt_md5 FROM a LEFT JOIN cx USING (query_id)")
def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.assemble_context(asks(spark, sf_dir), hits(spark, sf_dir), library(spark, sf_dir)).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


_NL = "chr(10) || chr(10)"


@registered(f"""WITH {_LIBRARY}, {_HITS}, fd AS (SELECT query_id, rank, '**' || CASE WHEN act_key = 'constitution' THEN 'Article' ELSE 'Section' END || ' ' || number || ' — ' || source || ' (' || {_field('act_key', 'name')} || ')**' || {_NL} || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || {_NL} || '*Key authority:* one; ' || number AS blk FROM b JOIN l USING (chunk_id)),
    gb AS (SELECT query_id, count(*) AS n, string_agg(blk, {_NL} ORDER BY rank) AS bl FROM fd GROUP BY query_id) SELECT query_id, md5('**Primary provision' || CASE WHEN n = 1 THEN '' ELSE 's' END || '** matching your query:' || {_NL} || bl || {_NL} || '{answer.DISCLAIMER}') AS answer_md5 FROM gb""")
def answer_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).join(library(spark, sf_dir), "chunk_id").select("query_id", F.col("rank").alias("place"), u.act_value(F.col("act_key"), "unit").alias("unit"), "number", F.col("source").alias("title"), u.act_value(F.col("act_key"), "name").alias("act"), F.col("text").alias("content"), F.array(F.lit("one"), "number", F.lit("three")).alias("citations"))
    return answer.answer_deterministic(found).select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@registered(f"WITH {_LIBRARY}, {_HITS}, r AS (SELECT query_id, chunk_id, rank, score, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, number, act_key FROM b JOIN l USING (chunk_id)) SELECT query_id, chunk_id, rank, round(score + 1e-9::DOUBLE, 4) AS similarity, number AS section, {_field('act_key', 'name')} AS act, CASE WHEN length(t) <= 320 THEN t ELSE substr(t, 1, 319) || '…' END AS excerpt FROM r")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.chunk_records(hits(spark, sf_dir), library(spark, sf_dir))


@registered("""WITH c AS (SELECT doc_id, (doc_id % 9)::VARCHAR AS number, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'H' ELSE '' END AS section_title, source, CASE doc_id % 3 WHEN 0 THEN '["a","b' || doc_id || '"]' WHEN 1 THEN 'plain ' || doc_id ELSE '' END AS citations FROM documents)
    SELECT doc_id AS chunk_id, number, coalesce(nullif(title, ''), nullif(section_title, ''), nullif(source, ''), 'Provision') AS title, CASE doc_id % 3 WHEN 0 THEN 'a; b' || doc_id WHEN 1 THEN citations ELSE '' END AS citations FROM c""")
def chunk_to_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    cites = F.when(i % 3 == 0, F.concat(F.lit('["a","b'), i, F.lit('"]'))).when(i % 3 == 1, F.concat(F.lit("plain "), i)).otherwise("")
    c = table(spark, sf_dir, "documents").select(i.alias("chunk_id"), (i % 9).cast("string").alias("number"), F.when(i % 3 == 0, F.concat(F.lit("T"), i)).otherwise("").alias("title"), F.when(i % 2 == 0, "H").otherwise("").alias("section_title"), "source", cites.alias("citations"))
    return answer.chunk_to_section(c).withColumn("citations", F.array_join("citations", "; "))


@registered(f"WITH {_UN}, {_LIBRARY}, {_HITS} SELECT query_id, chunk_id, rank FROM b JOIN l USING (chunk_id) JOIN un USING (query_id) WHERE len(acts) = 0 OR list_contains(acts, act_key)")
def bm25_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asks(spark, sf_dir).select("query_id", u.detect_acts(F.col("query")).alias("act_keys"))
    return answer.bm25_post_filter(hits(spark, sf_dir), q, library(spark, sf_dir)).select("query_id", "chunk_id", "rank")


@registered(f"WITH {_LIBRARY} SELECT chunk_id, act_key FROM l WHERE jurisdiction = 'fr'")
def jurisdiction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = library(spark, sf_dir)
    return c.filter(answer.metadata_predicate(F.array().cast("array<string>"), F.col("act_key"), F.col("jurisdiction"), "fr")).select("chunk_id", "act_key")


@registered(f"WITH {_UN}, {_LIBRARY}, s AS (SELECT act_key, count(*) AS n FROM l WHERE jurisdiction = 'en' GROUP BY act_key) SELECT query_id, coalesce(sum(n), 0)::BIGINT AS n FROM un LEFT JOIN s ON len(acts) = 0 OR list_contains(acts, act_key) GROUP BY query_id")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of one jurisdiction each question's acts leave; chunks are counted by act first."""
    q = asks(spark, sf_dir).select("query_id", u.detect_acts(F.col("query")).alias("act_keys"))
    s = library(spark, sf_dir).groupBy("act_key", "jurisdiction").agg(F.count("*").alias("n"))
    s = s.filter(F.col("jurisdiction") == "en")
    return q.join(F.broadcast(s), answer.metadata_predicate(F.col("act_keys"), F.col("act_key")), "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # a row for each act at most


@registered(f"WITH {_LIBRARY}, s AS (SELECT source, act_key, count(*) FILTER (WHERE NOT superseded) AS n FROM l GROUP BY ALL) SELECT act_key, sum(n)::BIGINT AS n FROM s GROUP BY act_key")
def act_chunk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = library(spark, sf_dir).groupBy("source").agg(F.count_if(~F.col("superseded")).alias("chunks_active"))
    return answer.act_chunk_rollup(sources)


@registered(f"WITH {_UNDERSTOOD}, ix AS (SELECT DISTINCT ({_quoted(ACT_KEYS)})[doc_id % {len(ACT_KEYS)} + 1] AS k FROM documents WHERE doc_id % {len(ACT_KEYS)} < 12) SELECT query_id, CASE WHEN len(acts) = 0 THEN 'UNKNOWN' WHEN len(list_filter(acts, lambda x: x NOT IN {_in(ACT_KEYS[:12])})) = 0 THEN 'OK' ELSE 'MISSING' END AS status FROM un")
def validate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = library(spark, sf_dir).filter(F.col("act_key").isin(ACT_KEYS[:12])).select("act_key")
    return answer.validate_benchmark(asking.asked(spark, sf_dir), indexed)
