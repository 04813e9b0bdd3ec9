"""Understanding of questions: acts, topics, entities, intent, route and rewriting, as expressions on a text column.

The dictionaries are parameters with the statutes' values as defaults. As expressions they suit small ones; :func:`understood`
finds the entries of large ones by automata.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import vocabulary
from docquarry.functions.text import normalise_alias, section_numbers
from docquarry.functions.vocabulary import ANCHOR_LEAST, ANCHOR_TYPES, BONUS, COURTS, FOLLOWUP_CUE, INTENTS, LEAST, MOST, MOST_BONUS, RAG_INTENTS, SELF_CONTAINED

ACTS = {key: {"name": name, "unit": unit, "domain": domain} for key, (name, unit, domain, _) in vocabulary.ACTS.items()}
ALIASES = {alias: key for key, (*_, aliases) in vocabulary.ACTS.items() for alias in aliases}
TOPICS = {topic: terms for topic, (terms, _) in vocabulary.TOPICS.items()}
TOPIC_ACTS = {topic: acts for topic, (_, acts) in vocabulary.TOPICS.items()}
ENTITY_RULES = [(kind, sure, re.compile(pattern, 0 if case else re.IGNORECASE)) for kind, sure, case, pattern in vocabulary.ENTITY_RULES]


def _known(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def resolve_act(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The key of the act that ``text`` is an alias of, else of the first alias in order that it contains, else null."""
    norm = normalise_alias(text)
    exact = F.element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), norm)
    return F.coalesce(exact, *(F.when(F.contains(norm, F.lit(a)), F.lit(k)) for a, k in aliases.items()))


def _fires(low: Column, topic: str, terms: list[str]) -> Column:
    """Whether the topic's name or one of its terms stands anywhere in a lower-case text."""
    return low.rlike("|".join(re.escape(t) for t in dict.fromkeys([topic, *terms])))


def expand_topics(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """The terms of every topic of which ``text`` holds the name or a term (anywhere, inside words too), in order, once each."""
    low = F.lower(text)
    return F.array_distinct(F.flatten(_known(F.array(*(F.when(_fires(low, t, terms), _strings(terms)) for t, terms in topics.items())))))


def topic_acts(text: Column, topics: dict[str, list[str]] = TOPICS, acts: dict[str, list[str]] = TOPIC_ACTS) -> Column:
    """The acts of those topics."""
    low = F.lower(text)
    return F.array_distinct(F.flatten(_known(F.array(*(F.when(_fires(low, t, terms), _strings(acts.get(t, []))) for t, terms in topics.items())))))


def detect_acts(text: Column) -> Column:
    """Acts that the whole text or one of its words names, then those of its topics; in order, once each."""
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0))
    return F.array_distinct(_known(F.concat(F.array(resolve_act(text)), F.transform(words, lambda w: resolve_act(w)), topic_acts(text))))


def understood(queries: DataFrame, query_id: str = "query_id", query: str = "query", aliases: dict[str, str] = ALIASES, topics: dict[str, list[str]] = TOPICS, acts: dict[str, list[str]] = TOPIC_ACTS) -> DataFrame:
    """(query_id, act, act_keys, terms, topic_acts, word_acts): what :func:`resolve_act`, :func:`detect_acts`, :func:`expand_topics` and :func:`topic_acts` give, and the acts of single words, for dictionaries of any size.

    One automaton of all aliases and one of all topics' names and terms read each text once, so the work grows with the
    texts and what is found in them, not with the dictionaries. Texts are prepared by Spark's expressions.
    """
    return found(queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("_text")), "_text", aliases, topics, acts).drop("_text")


def found(rows: DataFrame, text: str, aliases: dict[str, str] = ALIASES, topics: dict[str, list[str]] = TOPICS, acts: dict[str, list[str]] = TOPIC_ACTS) -> DataFrame:
    """``rows`` with what :func:`understood` finds in their ``text``."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), normalise_alias)
    order = list(aliases)
    lists = pa.list_(pa.string())
    names = [*rows.columns, "act", "act_keys", "terms", "topic_acts", "word_acts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, about = ahocorasick.Automaton(), ahocorasick.Automaton()
        for n, alias in enumerate(order):
            named.add_word(alias, n)
        hold: dict[str, list[int]] = {}
        for n, (topic, terms) in enumerate(topics.items()):
            for term in (topic, *terms):
                hold.setdefault(term, []).append(n)
        for term, ns in hold.items():
            about.add_word(term, ns)
        for a in (named, about):
            if len(a):
                a.make_automaton()
        every = list(topics)

        def act(text: str) -> str | None:
            if text in aliases:
                return aliases[text]
            found = min((n for _, n in named.iter(text)), default=None) if len(named) else None
            return None if found is None else aliases[order[found]]

        for batch in batches:
            *held, norms, lows, parts = batch.columns
            out: list[tuple] = []
            for norm, low, each in zip(norms.to_pylist(), lows.to_pylist(), parts.to_pylist(), strict=True):
                if norm is None:
                    out.append((None, None, None, None, None))
                    continue
                fired = [every[n] for n in sorted({n for _, ns in about.iter(low) for n in ns})] if len(about) else []
                whole, scope, single = act(norm), list(dict.fromkeys(k for t in fired for k in acts.get(t, []))), list(map(act, each))
                keys = [k for k in dict.fromkeys([whole, *single, *scope]) if k is not None]
                out.append((whole, keys, list(dict.fromkeys(x for t in fired for x in topics[t])), scope, [k for k in dict.fromkeys(single) if k is not None]))
            columns = [pa.array([r[i] for r in out], pa.string() if i == 0 else lists) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*held, *columns], names=names)

    ready = rows.select("*", normalise_alias(F.col(text)).alias("_found_norm"), F.lower(text).alias("_found_low"), words.alias("_found_words"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return ready.mapInArrow(run, f"{fields}, act string, act_keys array<string>, terms array<string>, topic_acts array<string>, word_acts array<string>")


def act_value(key: Column, field: str, default: Column | None = None) -> Column:
    """An act's name, unit or domain; ``default`` for keys that aren't known."""
    found = F.element_at(F.create_map(*(F.lit(x) for k, v in ACTS.items() for x in (k, v[field]))), key)
    return found if default is None else F.coalesce(found, default)


def domain_lookup(key: Column) -> Column:
    return act_value(key, "domain", F.lit("General"))


def act_key_for_name(name: Column) -> Column:
    """The key of an act's display name, else by alias."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in ACTS.items() for x in (v["name"], k))), name), resolve_act(name))


def domain_context(text: Column, resolved: Column) -> Column:
    """(domain, related): of the acts resolved for a question, else of its topics."""
    keys = F.when(F.size(resolved) > 0, resolved).otherwise(topic_acts(text))
    return F.struct(domain_lookup(F.get(keys, F.lit(0))).alias("domain"), F.transform(keys, lambda k: act_value(k, "name")).alias("related"))


def _rewritten(q: Column, acts: Column, terms: Column) -> Column:
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    sections = section_numbers(q)
    names = F.transform(acts, lambda k: act_value(k, "name", k))
    begin = F.struct(F.array(q).alias("pieces"), words(q).alias("seen"))
    grown = F.aggregate(F.concat(terms, names), begin, lambda held, t: F.when(F.array_contains(held["seen"], F.lower(t)), held).otherwise(
        F.struct(F.concat(held["pieces"], F.array(t)).alias("pieces"), F.concat(held["seen"], words(t)).alias("seen"))))
    expanded = F.array_join(grown["pieces"], " ")
    anchor = F.when((F.size(sections) > 0) & (F.size(acts) > 0), F.array_join(F.transform(F.slice(sections, 1, 2), lambda n: F.concat(F.lit("section "), n, F.lit(" "), F.get(names, F.lit(0)))), " "))
    whole = F.transform(F.array(F.struct(expanded.alias("expanded"), anchor.alias("anchor"), sections.alias("sections"))), lambda x: F.struct(
        q.alias("original"), x["expanded"].alias("expanded"), F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(_known(F.array(q, x["expanded"], x["anchor"]))), 1, 4)).alias("variants"),
        acts.alias("act_keys"), x["sections"].alias("sections")))
    return F.get(whole, F.lit(0))


def rewrite_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with original, expanded, variants, act_keys and sections: unseen terms of a question's topics and the names of its acts are added to it."""
    rows = found(queries.select("*", F.regexp_replace(F.coalesce(F.col(query), F.lit("")), r"^\s+|\s+$", "").alias("_q")), "_q")
    return rows.select(*queries.columns, _rewritten(F.col("_q"), F.col("act_keys"), F.col("terms")).alias("_r")).select(*queries.columns, "_r.*")


def union_variants(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, variant, text): at most four different forms of each question, in order."""
    return rewrite_queries(queries.select(query_id, query), query).select(query_id, F.posexplode("variants").alias("variant", "text"))


def classify_intent(text: Column) -> Column:
    """(intent, confidence): the intent of most weight, ties in order of precedence; below the least weight unknown."""
    scores = []
    for intent, patterns in INTENTS.items():
        hits = [text.rlike(f"(?i){p}") for p, _ in patterns]
        n = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
        base = F.greatest(*(F.when(h, w).otherwise(0.0) for h, (_, w) in zip(hits, patterns, strict=True)), F.lit(0.0))
        scores.append(F.struct(F.when(n > 0, F.round(F.least(base + F.least(BONUS * (n - 1), F.lit(MOST_BONUS)), F.lit(MOST)), 6)).otherwise(0.0).alias("score"), F.lit(intent).alias("intent")))
    best = F.aggregate(F.array(*scores), F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("intent")), lambda a, s: F.when(s["score"] > a["score"], s).otherwise(a))
    known = best["score"] >= LEAST
    return F.struct(F.when(known, best["intent"]).otherwise("unknown").alias("intent"), F.when(known, F.round(best["score"], 2)).otherwise(0.5).alias("confidence"))


def best_anchor(entities: Column) -> Column:
    """The surest entity of an array that a provision can be looked up by, the first among equals; null if there is none."""
    fit = F.filter(entities, lambda e: e["type"].isin(ANCHOR_TYPES) & (e["confidence"] >= ANCHOR_LEAST))
    top = F.array_max(F.transform(fit, lambda e: e["confidence"]))
    return F.get(F.filter(fit, lambda e: e["confidence"] == top), F.lit(0))


def route(intent: Column, entities: Column) -> Column:
    """(route, reason) of a question."""
    anchor = best_anchor(entities)
    looked_up = (intent != "legal_overview") & anchor.isNotNull()
    way = F.when(intent == "conversation", "conversation").when(looked_up, "deterministic").when(intent.isin(RAG_INTENTS), "rag").otherwise("unknown")
    reason = (F.when(intent == "conversation", "conversational input — no legal retrieval")
              .when(looked_up, F.concat(anchor["type"], F.lit(" entity '"), anchor["value"], F.lit("' detected (confidence "), anchor["confidence"].cast("string"), F.lit(")")))
              .when(intent.isin(RAG_INTENTS), F.concat(F.lit("intent is "), intent)).otherwise("no legal intent or provision identified"))
    return F.struct(way.alias("route"), reason.alias("reason"))


def build_subject(entities: Column) -> Column:
    """``Section 420 IPC``: the first section or article and the first act of an array of entities."""
    first = lambda kinds: F.coalesce(F.get(F.filter(entities, lambda e: e["type"].isin(kinds)), F.lit(0))["value"], F.lit(""))
    return F.trim(F.concat_ws(" ", first(["SECTION", "ARTICLE"]), first(["ACT"])))


def is_followup(text: Column) -> Column:
    """Short questions that open with a cue and name neither a provision nor a topic."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return ~text.rlike(SELF_CONTAINED) & (F.size(topic_acts(text)) == 0) & (words <= 7) & text.rlike(FOLLOWUP_CUE)


def followup_resolve(turns: DataFrame, window: int = 6) -> DataFrame:
    """Adds ``effective`` to (session_id, turn, query, subject): follow-ups get the latest subject of the ``window`` turns before."""
    frame = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-window, -1)
    before = F.last(F.when(F.col("subject") != "", F.col("subject")), ignorenulls=True).over(frame)
    return turns.withColumn("_before", before).withColumn("effective", F.when(is_followup(F.col("query")) & F.col("_before").isNotNull(), F.concat("query", F.lit(" regarding "), "_before")).otherwise(F.col("query"))).drop("_before")


def norm_entity_value(kind: Column, raw: Column) -> Column:
    """Canonical form of an entity's text by its type."""
    flat = F.regexp_replace(F.trim(raw), r"\s+", " ")
    unit = lambda word, prefix: F.concat(
        F.lit(f"{word} "), F.regexp_extract(flat, prefix, 1), F.upper(F.regexp_extract(flat, prefix, 2)), F.regexp_extract(flat, prefix, 3))
    section, article, bare = r"(?i)^(?:section|sec\.?)\s*(\d+)([a-z]?)\s*(\(\w\))?", r"(?i)^(?:article|art\.?)\s*(\d+)([a-z]?)\s*(\(\w\))?", r"(?i)(\d+)([a-z]?)()"
    court = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in COURTS.items() for x in pair)), F.lower(flat)), flat)
    return (F.when((kind == "SECTION") & flat.rlike(section), unit("Section", section)).when((kind == "SECTION") & flat.rlike(bare), unit("Section", bare)).when((kind == "ARTICLE") & flat.rlike(article), unit("Article", article))
            .when(kind == "ACT", F.regexp_replace(flat, r"(?i)^(?:the|an?)\s+", "")).when(kind == "COURT", court).otherwise(flat))


_ENTITY = "array<struct<type:string,raw:string,confidence:double,start:int,`end`:int>>"


def entity_overlap(matches: Column) -> Column:
    """The matches that no surer (then longer, then earlier) accepted one overlaps, in order of place."""
    order = F.array_sort(F.transform(matches, lambda e: F.struct((-e["confidence"]).alias("a"), (e["start"] - e["end"]).alias("b"), e["start"].alias("c"), e.alias("e"))))
    kept = F.aggregate(order, F.filter(matches, lambda _: F.lit(False)), lambda held, x: F.when(F.exists(held, lambda h: (x["e"]["start"] < h["end"]) & (x["e"]["end"] > h["start"])), held).otherwise(F.concat(held, F.array(x["e"]))))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["start"].alias("a"), e.alias("e")))), lambda x: x["e"])


def match_entities(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, matches): every match of every rule with its place; Spark has no function for places, so an Arrow batch finds them."""
    kind = queries.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"type": k, "raw": m[0], "confidence": sure, "start": m.start(), "end": m.end()} for k, sure, rule in ENTITY_RULES for m in rule.finditer(t or "")] for t in batch[query]]
            yield pd.DataFrame({query_id: batch[query_id], "matches": found})

    return queries.select(query_id, query).mapInPandas(run, f"{query_id} {kind}, matches {_ENTITY}")


def extract_entities(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, entities): non-overlapping entities in order of place, with canonical values."""
    kept = match_entities(queries, query_id, query).select(query_id, entity_overlap(F.col("matches")).alias("_m"))
    return kept.select(query_id, F.transform("_m", lambda e: F.struct(e["type"].alias("type"), norm_entity_value(e["type"], e["raw"]).alias("value"), e["confidence"].alias("confidence"), e["start"].alias("start"), e["end"].alias("end"))).alias("entities"))


def statute_lookup(refs: DataFrame, provisions: DataFrame, primary_only: bool = True) -> DataFrame:
    """(query_id, ref, act_key, number): the provisions that references (query_id, ref, act_keys) name; null act_key where none does.

    A reference is looked up in its question's acts, or in all; a sub-clause that isn't there stands for its section. Where
    acts are named, or with ``primary_only``, the first act in order (``act_order`` of ``provisions``) counts.
    """
    number = F.upper(F.regexp_replace(F.trim("ref"), r"(?i)^(?:section|sec\.?|article|art\.?)\s*", ""))
    r = refs.withColumn("_n", number).withColumn("_base", F.regexp_replace("_n", r"\s*\([^)]+\)$", ""))
    r = r.select("*", F.explode(F.array_distinct(F.array(F.struct(F.col("_n").alias("n"), F.lit(0).alias("p")), F.struct(F.col("_base").alias("n"), F.when(F.col("_n") == F.col("_base"), 0).otherwise(1).alias("p"))))).alias("_k"))
    p = provisions.select("act_key", "act_order", F.upper("number").alias("_number"))
    hits = r.join(p, (F.col("_k.n") == F.col("_number")) & ((F.size("act_keys") == 0) | F.array_contains("act_keys", F.col("act_key"))))
    in_act = Window.partitionBy("query_id", "ref", "act_key").orderBy("_k.p")
    first = Window.partitionBy("query_id", "ref").orderBy("act_order")
    hits = hits.withColumn("_i", F.row_number().over(in_act)).filter("_i = 1").withColumn("_f", F.row_number().over(first))
    hits = hits.filter((F.col("_f") == 1) | ((F.size("act_keys") == 0) & F.lit(not primary_only))).select("query_id", "ref", "act_key", F.col("_number").alias("number"))
    return refs.select("query_id", "ref").join(hits, ["query_id", "ref"], "left")


def topic_fallback_lookup(queries: DataFrame, provisions: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, act_key, number, place): the first provisions whose keywords are terms of a question's topics, within its acts (or those of its topics)."""
    q = queries.select("query_id", F.col("act_keys"), topic_acts(F.col("query")).alias("_t"), F.posexplode(expand_topics(F.col("query"))).alias("_at", "_term"))
    q = q.withColumn("_scope", F.when(F.size("act_keys") > 0, F.col("act_keys")).otherwise(F.col("_t")))
    k = provisions.select("act_key", "act_order", "number", F.explode("keywords").alias("_kw")).withColumn("_kw", F.lower("_kw"))
    hits = q.join(k, F.lower("_term") == F.col("_kw")).filter((F.size("_scope") == 0) | F.array_contains("_scope", F.col("act_key")))
    once = hits.groupBy("query_id", "act_key", "act_order", "number").agg(F.min("_at").alias("_at"))
    turn = Window.partitionBy("query_id").orderBy("_at", "act_order", "number")
    return once.withColumn("place", F.row_number().over(turn)).filter(F.col("place") <= limit).select("query_id", "act_key", "number", "place")
