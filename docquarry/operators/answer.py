"""From ranked hits to answers: legal signals, shortlists, overviews, citations and composed texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.scratch import written
from docquarry.functions.text import citation_markers, content_tokens, natural_number_key
from docquarry.operators import understand as u
from docquarry.operators.evaluate import retrieval_overlap, source_name_match
from docquarry.operators.fusion import diversify, rrf_fuse, rrf_merge_variants, vector_search
from docquarry.operators.lexical import active_only, bm25_search
from docquarry.operators.stored import TextIndex

# Weights of similarity, topics, density, act and section; what else a shortlist keeps; sizes of lists.
W_SIM, W_TOPIC, W_DENSITY, W_ACT, W_SECTION = 0.28, 0.42, 0.14, 0.10, 0.06
KEEP, RELATIVE, FLOOR = 3, 0.78, 0.18
PER_LIST, FUSED, OVERVIEW, EXCERPT = 12, 16, 12, 320
RAG_INTRO = "Based on your question, here is what the relevant Indian law provides. The most applicable provisions in the corpus are:"
OVERVIEW_CLOSE = "This is legal information, not legal advice. Ask about any listed provision for the full statutory text."
NOTHING = "No relevant provision in the corpus."
NO_ACT = "**I don't have this Act indexed in the corpus yet.**"
NO_PROVISION = "**I couldn't find that exact provision in the corpus.**"
NO_MATCH = "**I couldn't find a provision in the corpus that directly addresses this.**"
CLARIFY, THANKS, GREETING = "Please name an Act, a provision or a legal question.", "You're welcome.", "Hello. Ask about an Act, a provision or a legal question."
DISCLAIMER = "This is legal information, not legal advice. Refer to the cited sources below for the authoritative text and judgments."


def rounded(x: Column, digits: int) -> Column:
    """Rounded, with the sums' last bits out of the way of ties."""
    return F.round(x + 1e-9, digits)


def metadata_predicate(act_keys: Column, act_key: Column, jurisdiction: Column | None = None, wanted: str | None = None) -> Column:
    """Whether a chunk may answer a question: one of its acts, if it has any, and the wanted jurisdiction, if one is."""
    fits = (F.size(act_keys) == 0) | F.array_contains(act_keys, act_key)
    return fits if wanted is None or jurisdiction is None else fits & (jurisdiction == wanted)


def bm25_post_filter(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` of the acts that their questions (query_id, act_keys) name; ranks stay as they were."""
    h = hits.join(queries.select("query_id", "act_keys"), "query_id").join(chunks.select("chunk_id", "act_key"), "chunk_id")
    return h.filter(metadata_predicate(F.col("act_keys"), F.col("act_key"))).select(*hits.columns)


def signal_scores(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` (query_id, chunk_id, sim, rank) with rerank_score and rerank_reason.

    What a question (query_id, query) asks for is worked out once for each question, then held against the chunks
    (chunk_id, text, act_key, domain, number) hit.
    """
    none = F.array().cast("array<string>")
    q = u.found(queries.select("query_id", "query", F.lower("query").alias("_low")), "_low")
    q = q.select("query_id", F.coalesce("terms", none).alias("_terms"), content_tokens(F.col("query")).alias("_words"), F.array_distinct(F.concat("topic_acts", "word_acts")).alias("_want"), F.regexp_extract_all("_low", F.lit(r"\b(\d{1,4}[a-z]?)\b"), F.lit(1)).alias("_nums"))
    h = hits.join(q, "query_id").join(chunks.select("chunk_id", F.lower("text").alias("_low"), "act_key", "domain", F.lower("number").alias("_number")), "chunk_id")
    topics = F.size(F.filter("_terms", lambda t: F.contains(F.col("_low"), F.lower(t))))
    dense = F.when(F.size("_words") > 0, F.size(F.filter("_words", lambda w: F.contains(F.col("_low"), F.substring(w, 1, 4)))) / F.size("_words")).otherwise(0.0)
    act = F.when(F.array_contains("_want", F.col("act_key")), 1.0).when(F.array_contains(F.transform("_want", u.domain_lookup), F.col("domain")), 0.5).otherwise(0.0)
    section = F.when((F.col("_number") != "") & F.array_contains("_nums", F.col("_number")), 1.0).otherwise(0.0)
    h = h.select(*hits.columns, topics.alias("_topics"), dense.alias("_dense"), act.alias("_act"), section.alias("_section"), F.coalesce("act_key", F.lit("-")).alias("_key"))
    total = W_SIM * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sim"))) + W_TOPIC * F.least(F.col("_topics"), F.lit(3)) / 3.0 + W_DENSITY * F.col("_dense") + W_ACT * F.col("_act") + W_SECTION * F.col("_section")
    short = F.when(F.col("_act") == 0.5, "0.5").otherwise(F.col("_act").cast("int").cast("string"))
    reason = F.format_string("sim=%.2f topic=%d dens=%.2f act=%s(%s) sec=%.0f", "sim", "_topics", "_dense", F.when(F.col("_key") == "", "-").otherwise(F.col("_key")), short, "_section")
    return h.select(*hits.columns, rounded(total, 4).alias("rerank_score"), reason.alias("rerank_reason"))


def signal_rerank(scored: DataFrame, keep: int = KEEP) -> DataFrame:
    """The best hit of every question, and the next ones near enough to it; with ``rerank_rank`` and a label."""
    turn = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "chunk_id")
    s = scored.withColumn("rerank_rank", F.row_number().over(turn)).withColumn("_top", F.first("rerank_score").over(turn)).filter(F.col("rerank_rank") <= keep)
    near = (F.col("rerank_score") >= FLOOR) & (F.col("rerank_score") >= RELATIVE * F.col("_top"))
    return s.filter((F.col("rerank_rank") == 1) | near).withColumn("label", F.when(F.col("rerank_rank") == 1, "primary").otherwise("related")).drop("_top")


def backfill_shortlist(hits: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """``kept`` (query_id, chunk_id, rerank_rank), and where these are fewer than ``k`` and than the hits, further hits in order, to ``2 * k`` at most; with ``place``."""
    every = hits.join(kept.select("query_id", "chunk_id", "rerank_rank", "rerank_score"), ["query_id", "chunk_id"], "left")
    own = Window.partitionBy("query_id")
    every = every.withColumn("_kept", F.count("rerank_rank").over(own)).withColumn("_all", F.count("*").over(own))
    turn = own.orderBy(F.col("rerank_rank").isNull(), "rerank_rank", "rank", "chunk_id")
    every = every.withColumn("place", F.row_number().over(turn))
    most = F.when(F.col("_kept") < F.least(F.lit(k), F.col("_all")), 2 * k).otherwise(F.col("_kept"))
    return every.filter(F.col("place") <= most).drop("_kept", "_all")


def normalised_rerank(scored: DataFrame) -> DataFrame:
    most = F.greatest(F.max("rerank_score").over(Window.partitionBy("query_id")), F.lit(0.001))
    return scored.withColumn("normalised", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rerank_score") / most)), 6))


def hashed_embedding(texts: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), size: int = 64) -> DataFrame:
    """(key, embedding, and the columns to ``keep``): word counts hashed to ``size`` places; stands in where no model is at hand, and any function of this form may take its place."""
    kind = {c: texts.schema[c].dataType.simpleString() for c in (key, *keep)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch[text]:
                at = [zlib.crc32(w.encode()) % size for w in (t or "").lower().split()]
                out.append(np.sqrt(np.bincount(at, minlength=size)).tolist())
            yield pd.DataFrame({key: batch[key], "embedding": out, **{c: batch[c] for c in keep}})

    fields = ", ".join((f"`{key}` {kind[key]}", "embedding array<double>", *(f"`{c}` {kind[c]}" for c in keep)))
    return texts.select(key, text, *keep).mapInPandas(run, fields)


def hybrid_retrieve(queries: DataFrame, chunks: DataFrame, k: int = 10, *, multi_query: bool = True, act_filter: bool = True, jurisdiction: str | None = None,
                    overview: str | None = None, embed: Callable[..., DataFrame] = hashed_embedding, index: TextIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, score, demoted, final_rank): the whole retrieval for a table of questions.

    Variants of each question are searched by vectors and by BM25, each pair of lists is fused, the variants' lists are
    merged, and the rest is rerank, backfill and diversification. Vectors of other acts than a question names, or of
    another ``jurisdiction``, don't enter its search at all; hits of BM25 are filtered by act after their top k. Chunks have
    chunk_id, text, source, act_key, domain and number; where they have an embedding, it is searched, else their texts are
    embedded as the questions are. BM25 reads a stored ``index`` of the chunks where one is given. ``overview`` names a boolean column of the questions: where
    it holds, the answer is the sample of the question's acts, scored by place, and nothing where it names none.
    """
    active = active_only(chunks) if "superseded" in chunks.columns else chunks
    r = u.rewrite_queries(queries.select("query_id", "query", (F.coalesce(F.col(overview), F.lit(False)) if overview else F.lit(False)).alias("_overview")))
    r = written(r.drop("query"), "rewritten")
    v = r.filter("not _overview").select("query_id", "act_keys", F.posexplode("variants" if multi_query else F.filter(F.array("original"), lambda x: x != "")).alias("variant", "text"))
    v = written(v.withColumn("_vid", F.concat_ws("/", "query_id", "variant")), "variants")
    asked = v.select(F.col("_vid").alias("query_id"), F.col("text").alias("query"), "act_keys")
    bm25 = bm25_search(asked, active, PER_LIST) if index is None else index.search(asked, PER_LIST)
    if act_filter:
        bm25 = bm25_post_filter(bm25, asked, active)
    scope = active if jurisdiction is None else active.filter(F.col("jurisdiction") == jurisdiction)
    vectors = scope.select("chunk_id", "embedding", "act_key") if "embedding" in chunks.columns else embed(scope, "chunk_id", "text", ("act_key",))
    vector = vector_search(embed(v, "_vid", "text", ("act_keys",)), vectors, PER_LIST, query_id="_vid", chunk_id="chunk_id", keys=("act_keys", "act_key") if act_filter else None)
    fused = rrf_fuse(vector, bm25, FUSED, weights=(0.6, 0.4)).join(v.select(F.col("_vid").alias("query_id"), F.col("query_id").alias("_q"), "variant"), "query_id")
    fused = written(fused.select(F.col("_q").alias("query_id"), "variant", "chunk_id", F.col("fused_rank").alias("rank"), F.col("fused_score").alias("score"), "vector_score"), "fused")
    sims = fused.groupBy("query_id", "chunk_id").agg(F.coalesce(F.min_by("vector_score", "variant"), F.lit(0.0)).alias("sim"))
    merged = written(rrf_merge_variants(fused.drop("vector_score"), FUSED).join(sims, ["query_id", "chunk_id"]), "merged")
    scored = written(signal_scores(merged, queries, active), "signals")
    short = backfill_shortlist(merged, signal_rerank(scored), k)
    items = short.select("query_id", "chunk_id", F.col("place").alias("rank"), F.coalesce("rerank_score", "score").alias("score")).join(active.select("chunk_id", "source", "number"), "chunk_id")
    found = diversify(items, k).select("query_id", "chunk_id", "score", "demoted", "final_rank")
    if not overview:
        return found
    sample = overview_sample(r.filter("_overview").select("query_id", "act_keys"), active if "superseded" in chunks.columns else active.withColumn("superseded", F.lit(False)), max(k, OVERVIEW))
    return found.unionByName(sample.select("query_id", "chunk_id", (1.0 / F.col("place")).alias("score"), F.lit(0).alias("demoted"), F.col("place").alias("final_rank")))


def vector_rerank_path(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The shorter way: vector search, then the signals' rerank."""
    hits = vector_search(hashed_embedding(queries, "query_id", "query"), hashed_embedding(chunks, "chunk_id", "text"), k, query_id="query_id", chunk_id="chunk_id")
    return signal_rerank(signal_scores(hits.withColumnRenamed("score", "sim"), queries, chunks)).select("query_id", "chunk_id", "rerank_score", "rerank_rank", "label")


def overview_sample(queries: DataFrame, chunks: DataFrame, k: int = OVERVIEW) -> DataFrame:
    """(query_id, chunk_id, place): the first chunk of each source of a question's acts, in natural order of their numbers.

    Each act is cut to its first ``k`` sources before it meets the questions, so no question meets a whole act.
    """
    first = active_only(chunks).filter(F.col("source") != "").groupBy("act_key", "source").agg(F.min_by(F.struct("chunk_id", "number"), F.struct("chunk_index", "chunk_id")).alias("_c"))
    c = first.select("act_key", F.col("_c.chunk_id").alias("chunk_id"), natural_number_key(F.coalesce("_c.number", F.lit(""))).alias("_key"))
    c = c.withColumn("_i", F.row_number().over(Window.partitionBy("act_key").orderBy("_key", "chunk_id"))).filter(F.col("_i") <= k)
    hits = queries.select("query_id", F.explode("act_keys").alias("act_key")).join(c, "act_key")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_key", "chunk_id"))).filter(F.col("place") <= k).select("query_id", "chunk_id", "place")


def overview_retrieve(queries: DataFrame, chunks: DataFrame, k: int = OVERVIEW) -> DataFrame:
    """The overview of every question (query_id, query) that asks for one; none where no act is named."""
    q = queries.filter(u.classify_intent(F.col("query"))["intent"] == "legal_overview")
    return overview_sample(u.understood(q).select("query_id", "act_keys"), chunks, k)


def overview_groups(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, act_key, n, place, numbers): retrieved provisions by act, that of most provisions first (then the first seen)."""
    h = hits.join(chunks.select("chunk_id", "act_key", "number"), "chunk_id")
    g = h.groupBy("query_id", "act_key").agg(F.count("*").alias("n"), F.min("rank").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "number"))), lambda x: x["number"]), ", ").alias("numbers"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "_first"))).drop("_first")


def citation_join(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, place): the hits that an answer cites, in order of mention; the first hit where it cites none of them."""
    marks = answers.select("query_id", F.posexplode(citation_markers(F.col("answer"))).alias("place", "rank"))
    cited = marks.join(hits.select("query_id", "rank", "chunk_id"), ["query_id", "rank"])
    first = hits.filter("rank = 1").join(answers.select("query_id"), "query_id", "left_semi").join(cited.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", F.lit(0).alias("place"))
    return cited.select("query_id", "chunk_id", "place").unionByName(first)


def citation_report(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, valid, missing): the marks of each answer that have a hit, and those that don't."""
    n = hits.groupBy("query_id").agg(F.max("rank").alias("_n"))
    a = answers.join(n, "query_id", "left").select("query_id", citation_markers(F.col("answer")).alias("_m"), F.coalesce("_n", F.lit(0)).alias("_n"))
    within = lambda m: (m >= 1) & (m <= F.col("_n"))
    return a.select("query_id", F.filter("_m", within).alias("valid"), F.filter("_m", lambda m: ~within(m)).alias("missing"))


def answer_confidence(cited: DataFrame) -> DataFrame:
    """(query_id, confidence): mean score of the cited hits."""
    return cited.groupBy("query_id").agg(rounded(F.avg("score"), 4).alias("confidence"))


def assemble_context(queries: DataFrame, hits: DataFrame, chunks: DataFrame, closer: str = "Answer using only the passages above, citing them as [n].") -> DataFrame:
    """(query_id, prompt): numbered passages, the question, and what to do. Hits per question are few, so their texts meet in one row."""
    h = hits.join(chunks.select("chunk_id", "source", "text"), "chunk_id")
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] (source: "), "source", F.lit(")\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    joined = h.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("_c"))
    return queries.join(joined, "query_id", "left").select("query_id", F.concat(F.lit("Context passages:\n\n"), F.coalesce("_c", F.lit("")), F.lit("\n\nQuestion: "), F.regexp_replace("query", r"^\s+|\s+$", ""), F.lit("\n\n" + closer)).alias("prompt"))


def _unit(unit: Column) -> Column:
    return F.when(unit == "article", "Article").otherwise("Section")


def answer_deterministic(found: DataFrame, terse: bool = False, intro: str | None = None) -> DataFrame:
    """(query_id, answer) from provisions (query_id, place, unit, number, title, act, content, citations); ``terse`` gives their contents alone, ``intro`` begins in another way."""
    label = F.concat(F.lit("**"), _unit(F.col("unit")), F.lit(" "), "number", F.lit(" — "), "title", F.when(F.col("act") != "", F.concat(F.lit(" ("), "act", F.lit(")"))).otherwise(""), F.lit("**"))
    content = F.regexp_replace("content", r"^\s+|\s+$", "")
    authority = F.when(F.size("citations") > 0, F.concat(F.lit("*Key authority:* "), F.array_join(F.slice("citations", 1, 2), "; ")))
    block = content if terse else F.concat_ws("\n\n", label, content, authority)
    g = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), " " if terse else "\n\n").alias("_b"))
    begin = F.lit(intro) if intro else F.when(F.col("_n") == 1, "**Primary provision** matching your query:").otherwise("**Primary provisions** matching your query:")
    return g.select("query_id", (F.trim("_b") if terse else F.concat_ws("\n\n", begin, "_b", F.lit(DISCLAIMER))).alias("answer"))


def answer_overview(found: DataFrame) -> DataFrame:
    """(query_id, answer): the act of most provisions (then the first seen) with their titles, and the numbers of those of other acts."""
    act = F.when(F.trim("act") != "", F.trim("act")).otherwise("Indian legal corpus")
    line = F.struct("place", F.concat(F.lit("- **"), _unit(F.col("unit")), F.lit(" "), "number", F.lit("** — "), F.when(F.trim("title") != "", F.trim("title")).otherwise("Provision")).alias("bullet"), F.concat(_unit(F.col("unit")), F.lit(" "), "number").alias("ref"))
    acts = found.groupBy("query_id", act.alias("_act")).agg(F.count("*").alias("_n"), F.min("place").alias("_first"), F.array_sort(F.collect_list(line)).alias("_lines"))
    every = acts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first"), F.col("_act").alias("act"), F.col("_lines").alias("lines")))).alias("_a"))
    top, rest = F.col("_a")[0], F.array_sort(F.transform(F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0))), lambda a: F.struct(a["first"].alias("first"), F.concat(F.lit("- "), a["act"], F.lit(": "), F.array_join(a["lines"]["ref"], ", ")).alias("text"))))
    parts = [F.array(F.lit("**Primary legal source matching your query:**"), F.concat(F.lit("### "), top["act"]), F.lit("Major areas covered (grounded in the retrieved provisions):")), top["lines"]["bullet"],
             F.when(F.size(rest) > 0, F.concat(F.array(F.lit(""), F.lit("**Related provisions in other Acts:**")), rest["text"])).otherwise(F.array().cast("array<string>")), F.array(F.lit(OVERVIEW_CLOSE))]
    return every.select("query_id", F.array_join(F.concat(*parts), "\n\n").alias("answer"))


def chunk_records(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, similarity, section, act, excerpt): what an operator sees of each hit."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    excerpt = F.when(F.length(text) <= EXCERPT, text).otherwise(F.concat(F.substring(text, 1, EXCERPT - 1), F.lit("…")))
    return hits.join(chunks.select("chunk_id", "text", "number", "act_key"), "chunk_id").select("query_id", "chunk_id", "rank", rounded(F.col("score"), 4).alias("similarity"), F.coalesce("number", F.lit("")).alias("section"), F.coalesce(u.act_value(F.col("act_key"), "name"), F.lit("")).alias("act"), excerpt.alias("excerpt"))


def chunk_to_section(chunks: DataFrame) -> DataFrame:
    """(chunk_id, number, title, citations): chunks as provisions; citations are a JSON list, or a single text where it isn't one."""
    listed = F.from_json("citations", "array<string>")
    cites = F.when(listed.isNotNull(), listed).when(F.coalesce("citations", F.lit("")) != "", F.array("citations")).otherwise(F.array().cast("array<string>"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return chunks.select("chunk_id", F.coalesce("number", F.lit("")).alias("number"), F.coalesce(filled("title"), filled("section_title"), filled("source"), F.lit("Provision")).alias("title"), cites.alias("citations"))


def act_chunk_rollup(sources: DataFrame) -> DataFrame:
    """(act_key, n): active chunks of the sources (source, chunks_active) whose name begins with an act's name."""
    key = F.coalesce(*(F.when(F.col("source").startswith(v["name"]), k) for k, v in u.ACTS.items()))
    return sources.select(key.alias("act_key"), "chunks_active").filter("act_key is not null").groupBy("act_key").agg(F.sum("chunks_active").alias("n"))


def validate_benchmark(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(query_id, status): UNKNOWN where a question names no act, OK where all of its acts are in ``indexed`` (act_key), else MISSING."""
    q = queries.select("query_id", u.detect_acts(F.col("query")).alias("_a"))
    named = q.select("query_id", F.explode("_a").alias("act_key")).join(indexed.select("act_key", F.lit(True).alias("_in")).distinct(), "act_key", "left")
    held = named.groupBy("query_id").agg(F.min(F.coalesce("_in", F.lit(False))).alias("_ok"))
    return q.select("query_id").join(held, "query_id", "left").select("query_id", F.when(F.col("_ok").isNull(), "UNKNOWN").when(F.col("_ok"), "OK").otherwise("MISSING").alias("status"))


def _provisions(refs: DataFrame, provisions: DataFrame) -> DataFrame:
    """The provisions (act_key, number) of (query_id, place, act_key, number), with what answers need."""
    p = provisions.select("act_key", F.upper("number").alias("number"), "title", "content", "citations", u.act_value(F.col("act_key"), "name").alias("act"), u.act_value(F.col("act_key"), "unit").alias("unit"))
    return refs.select("query_id", "place", "act_key", F.upper("number").alias("number")).join(p, ["act_key", "number"]).select("query_id", "place", "unit", "number", "title", "act", "content", "citations")


def answer_queries(turns: DataFrame, chunks: DataFrame, provisions: DataFrame, k: int = 5, *, terse: bool = False, embed: Callable[..., DataFrame] = hashed_embedding, index: TextIndex | None = None) -> DataFrame:
    """One row for every turn (query_id, session_id, turn, query, subject): query_id, intent, confidence, route, reason, answer and chunk_ids.

    Turns are resolved first. What follows depends on a turn's resolved text alone, so each different text is classified, routed
    and answered once, whatever the number of its turns, and then joined back to them. Each branch is computed for its own texts
    and the branches' answers are united. A deterministic turn is answered by the provisions that it names. One that retrieves has
    its chunks; its answer, without a model, is an overview of the act's sample, or else the provisions that it names or, where
    it names none, those of its topics. Conversation and unknown turns retrieve nothing. ``provisions`` has act_key, act_order, number, title, content,
    citations and keywords. ``terse`` gives the provisions' contents alone.
    """
    t = u.followup_resolve(turns)
    subject = F.substr("effective", F.length("query") + len(" regarding ") + 1)
    note = F.when(F.col("effective") != F.col("query"), F.concat(F.lit(" · follow-up resolved to “"), subject, F.lit("”"))).otherwise("")
    turns = written(t.select("query_id", F.col("effective").alias("_asked"), note.alias("_note")), "turns")
    t = written(turns.select(F.col("_asked").alias("query")).distinct().withColumn("query_id", F.monotonically_increasing_id()), "asked")
    c = t.join(u.extract_entities(t), "query_id").select("query_id", "query", "entities", u.classify_intent(F.col("query")).alias("_c"))
    c = c.select("query_id", "query", "entities", "_c.*", u.route(F.col("_c.intent"), F.col("entities")).alias("_r"))
    c = written(c.select("query_id", "query", "entities", "intent", "confidence", "_r.route", "_r.reason"), "classified")
    overview = (F.col("route") == "rag") & (F.col("intent") == "legal_overview")

    named = F.array_distinct(F.filter(F.transform(F.filter("entities", lambda e: e["type"] == "ACT"), lambda e: u.resolve_act(e["value"])), lambda k: k.isNotNull()))
    asks = c.filter(F.col("route").isin("rag", "deterministic") & ~overview).select("query_id", "query", "route", "entities", named.alias("act_keys"))
    refs = asks.select("query_id", "route", "act_keys", F.posexplode(F.filter("entities", lambda e: e["type"].isin("SECTION", "ARTICLE"))).alias("place", "_e"))
    refs = refs.select("query_id", "route", "act_keys", "place", F.col("_e.value").alias("ref"))
    first = refs.groupBy("query_id", "ref").agg(F.min("place").alias("place"))
    looked = u.statute_lookup(refs.dropDuplicates(["query_id", "ref"]).select("query_id", "ref", "act_keys"), provisions).filter("act_key is not null").join(first, ["query_id", "ref"])
    looked = written(_provisions(looked, provisions), "looked-up")
    none = asks.filter("route = 'rag'").join(looked.select("query_id").distinct(), "query_id", "left_anti")
    topical = written(_provisions(u.topic_fallback_lookup(none.select("query_id", "query", "act_keys"), provisions), provisions), "topical")

    retrieved = hybrid_retrieve(c.filter("route = 'rag'").withColumn("_overview", overview), chunks, k, overview="_overview", embed=embed, index=index)
    retrieved = written(retrieved.select("query_id", "chunk_id", "final_rank"), "retrieved")
    sampled = retrieved.join(c.filter(overview).select("query_id"), "query_id", "left_semi").join(chunks.select("chunk_id", "act_key", "number", F.col("source").alias("title"), F.col("text").alias("content")), "chunk_id")
    sampled = sampled.select("query_id", F.col("final_rank").alias("place"), u.act_value(F.col("act_key"), "unit").alias("unit"), F.coalesce("number", F.lit("")).alias("number"), "title", F.coalesce(u.act_value(F.col("act_key"), "name"), F.lit("")).alias("act"), "content", F.array().cast("array<string>").alias("citations"))

    rag = asks.filter("route = 'rag'").select("query_id")
    branches = [answer_deterministic(looked.join(rag, "query_id", "left_anti"), terse), answer_deterministic(looked.join(rag, "query_id", "left_semi").unionByName(topical), terse, RAG_INTRO),
                answer_deterministic(sampled, True) if terse else answer_overview(sampled)]
    answers = reduce(DataFrame.unionByName, branches)
    without = F.when(F.lit(terse), NOTHING).when(F.col("route").isin("conversation", "unknown"), F.when(F.col("route") == "unknown", CLARIFY).when(F.lower(F.trim("query")).rlike("^(thank|thanx|thx|ty|cheers|appreciate)"), THANKS).otherwise(GREETING)).when(overview, NO_ACT).when(F.col("route") == "deterministic", NO_PROVISION).otherwise(NO_MATCH)
    held = retrieved.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("_ids"))
    out = c.join(answers, "query_id", "left").join(held, "query_id", "left")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    out = written(out.select("query", "intent", "confidence", "route", "reason", F.coalesce("answer", without).alias("answer"), F.coalesce("_ids", F.array().cast(f"array<{kind}>")).alias("chunk_ids")), "answers")
    return turns.join(out, F.col("_asked").eqNullSafe(F.col("query"))).select("query_id", "intent", "confidence", "route", F.concat("reason", "_note").alias("reason"), "answer", "chunk_ids")


def benchmark_pipelines(queries: DataFrame, chunks: DataFrame, k: int = 4, *, embed: Callable[..., DataFrame] = hashed_embedding) -> DataFrame:
    """(query_id, baseline_source, baseline_overlap, baseline_match, new_source, new_overlap, new_match, delta_overlap) of questions (query_id, query, expected).

    The baseline is vector search alone, the new way the whole retrieval; each is judged by the share of the expected text's
    tokens in its ``k`` texts, and by whether the first one's source is a provision that the text cites.
    """
    active = active_only(chunks) if "superseded" in chunks.columns else chunks
    base = vector_search(embed(queries, "query_id", "query"), active.select("chunk_id", "embedding") if "embedding" in chunks.columns else embed(active, "chunk_id", "text"), k, query_id="query_id", chunk_id="chunk_id")
    new = hybrid_retrieve(queries.select("query_id", "query"), chunks, k, embed=embed)
    hits = written(base.select("query_id", "chunk_id", "rank", F.lit("baseline").alias("way")).unionByName(new.select("query_id", "chunk_id", F.col("final_rank").alias("rank"), F.lit("new").alias("way"))), "benchmark-hits")
    texts = hits.join(active.select("chunk_id", "source", "text"), "chunk_id").groupBy("query_id", "way").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "source"))).alias("_h"))
    one = lambda way, name: F.max(F.when(F.col("way") == way, F.col(name))).alias(f"_{way}_{name}")
    both = texts.select("query_id", "way", F.array_join("_h.text", "\n").alias("text"), F.get("_h.source", F.lit(0)).alias("source")).groupBy("query_id").agg(*(one(w, c) for w in ("baseline", "new") for c in ("text", "source")))
    q = queries.select("query_id", "expected").join(both, "query_id", "left")
    out = q.select("query_id", *(x for w in ("baseline", "new") for x in (
        F.coalesce(f"_{w}_source", F.lit("")).alias(f"{w}_source"), retrieval_overlap(F.coalesce(f"_{w}_text", F.lit("")), F.col("expected")).alias(f"{w}_overlap"), F.coalesce(source_name_match(F.col(f"_{w}_source"), F.col("expected")), F.lit(False)).alias(f"{w}_match"))))
    return out.withColumn("delta_overlap", F.round(F.col("new_overlap") - F.col("baseline_overlap"), 4))
