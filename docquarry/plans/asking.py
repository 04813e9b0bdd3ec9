"""Registered queries that understand questions: a phrase for every document, with its first word after two of three."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import understand as u
from docquarry.plans.queries import _SECTIONS, registered, table

PHRASES = ["Tell me about Section 302 IPC", "Can I drink and drive in India?", "hello there", "Give me an overview of the Indian Penal Code, 1860", "what is the punishment", "Section 25F(1) of the Industrial Disputes Act, 1947",
           "AIR 1978 SC 597", "cheque bounce under NI Act 138", "what about bail", "Article 21 of the Constitution", "can the police arrest without warrant", "find cases on dowry death", "thanks", "summarise this", "IPC 420 and BNS 318",
           "is online cheating a crime", "and the penalty", "explain the it act", "Sec. 138A for landlord and tenant", "RTI application", "what are the grounds for injunction", "consumer complaint, 65b certificate", "nothing legal here", "patent infringement", "intermediary liability", "trademark passing off", "who is the director of a company", "bye", "1990 SCR 1234 and 2019 Cri LJ 500",
           "National Green Tribunal or Delhi High Court", "is a learner's licence mandatory", "what are the conditions for a writ petition", "burden of proof in a civil suit"]
ACT_KEYS = list(u.ACTS)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    first = F.substring_index("text", " ", 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, phrase).otherwise(F.concat(phrase, F.lit(" "), first)).alias("query"))


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ASKED = f"a AS (SELECT doc_id AS query_id, ({_quoted(PHRASES)})[doc_id % {len(PHRASES)} + 1] || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || split_part(text, ' ', 1) END AS query FROM documents)"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[.,]', '', 'g'), '\b(1[89]\d{{2}}|20\d{{2}})\b', '', 'g'), '^the\s+', ''), '\s+', ' ', 'g'))"
_RESOLVED = "coalesce(CASE n " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in u.ALIASES.items()) + " END, CASE " + " ".join(f"WHEN contains(n, '{a}') THEN '{k}'" for a, k in u.ALIASES.items()) + " END)"
_FIRES = {t: "(" + " OR ".join(f"contains(lower(query), '{x.replace(chr(39), chr(39) * 2)}')" for x in dict.fromkeys([t, *terms])) + ")" for t, terms in u.TOPICS.items()}
_TERMS = "flatten([" + ", ".join(f"CASE WHEN {_FIRES[t]} THEN {_quoted(terms)} ELSE [] END" for t, terms in u.TOPICS.items()) + "])"
_TACTS = "flatten([" + ", ".join(f"CASE WHEN {_FIRES[t]} THEN {_quoted(u.TOPIC_ACTS[t])} ELSE [] END" for t in u.TOPICS) + "])"
_once = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)".format
_UNDERSTOOD = f"""{_ASKED}, a1 AS (SELECT *, list_transform(list_transform(list_concat([query], regexp_extract_all(query, '[a-zA-Z]+')), lambda w: {_NORM.format('w')}), lambda n: {_RESOLVED}) AS named, {_TERMS} AS t1, {_TACTS} AS t2 FROM a),
    a2 AS (SELECT *, list_concat(named, t2) AS every FROM a1), un AS (SELECT query_id, query, named[1] AS whole, {_once('t1')} AS terms, {_once('t2')} AS tacts, {_once('every')} AS acts FROM a2)"""


def _joined(c: F.Column) -> F.Column:
    return F.array_join(c, "; ")


@registered(f"WITH {_UNDERSTOOD} SELECT query_id, whole AS act FROM un")
def resolve_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.understood(asked(spark, sf_dir)).select("query_id", "act")


@registered(f"WITH {_UNDERSTOOD} SELECT query_id, array_to_string(acts, '; ') AS acts FROM un")
def detect_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.understood(asked(spark, sf_dir)).select("query_id", _joined(F.col("act_keys")).alias("acts"))


@registered(f"WITH {_UNDERSTOOD} SELECT query_id, array_to_string(terms, '; ') AS terms FROM un")
def expand_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.understood(asked(spark, sf_dir)).select("query_id", _joined(F.col("terms")).alias("terms"))


@registered(f"WITH {_UNDERSTOOD} SELECT query_id, array_to_string(tacts, '; ') AS acts FROM un")
def topic_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.understood(asked(spark, sf_dir)).select("query_id", _joined(F.col("topic_acts")).alias("acts"))


def _field(key: str, field: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v[field]}'" for k, v in u.ACTS.items()) + " END"


@registered(f"WITH {_UNDERSTOOD} SELECT query_id, coalesce({_field('whole', 'domain')}, 'General') AS domain FROM un")
def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", u.domain_lookup(u.resolve_act(F.col("query"))).alias("domain"))


@registered(f"WITH {_UNDERSTOOD}, k AS (SELECT query_id, CASE WHEN whole IS NOT NULL THEN [whole] ELSE tacts END AS keys FROM un) SELECT query_id, coalesce({_field('keys[1]', 'domain')}, 'General') AS domain, array_to_string(list_transform(keys, lambda k: {_field('k', 'name')}), '; ') AS related FROM k")
def domain_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = u.resolve_act(F.col("query"))
    a = asked(spark, sf_dir).select("query_id", u.domain_context(F.col("query"), F.filter(F.array(whole), lambda k: k.isNotNull())).alias("c"))
    return a.select("query_id", "c.domain", _joined(F.col("c.related")).alias("related"))


_NAMED = _field("k", "name")
_LETTERS = "regexp_extract_all(lower({0}), '[a-z]+')".format
_REWRITTEN = f"""{_UNDERSTOOD}, r1 AS (SELECT query_id, trim(query) AS q, acts, list_concat(terms, list_transform(acts, lambda k: {_NAMED})) AS more, list_transform(acts, lambda k: {_NAMED})[1] AS name, {_SECTIONS.format('query')} AS s0 FROM un),
    r2 AS (SELECT *, {_once('s0')} AS sections, list_filter(more, lambda t, i: NOT list_contains(list_concat({_LETTERS('q')}, flatten(list_transform(more[1:i - 1], lambda z: {_LETTERS('z')}))), lower(t))) AS added FROM r1),
    r3 AS (SELECT *, array_to_string(list_concat([q], added), ' ') AS expanded, CASE WHEN len(sections) > 0 AND len(acts) > 0 THEN array_to_string(list_transform(sections[1:2], lambda n: 'section ' || n || ' ' || name), ' ') END AS anchor FROM r2),
    r4 AS (SELECT *, [q, expanded, anchor] AS v0 FROM r3), r5 AS (SELECT *, {_once('v0')}[1:4] AS variants FROM r4)"""


@registered(f"WITH {_REWRITTEN} SELECT query_id, expanded, array_to_string(variants, '; ') AS variants, array_to_string(acts, '; ') AS act_keys, array_to_string(sections, '; ') AS sections FROM r5")
def rewrite_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.rewrite_queries(asked(spark, sf_dir)).select("query_id", "expanded", *(_joined(F.col(c)).alias(c) for c in ("variants", "act_keys", "sections")))



@registered(f"WITH {_REWRITTEN} SELECT query_id, (generate_subscripts(variants, 1) - 1)::INT AS variant, unnest(variants) AS text FROM r5")
def union_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.union_variants(asked(spark, sf_dir))


def _intent_sql(query: str) -> str:
    rows = []
    for intent, patterns in u.INTENTS.items():
        hits = ["regexp_matches({0}, '(?i){1}')".format(query, p.replace("'", "''")) for p, _ in patterns]
        n = " + ".join(f"{h}::INT" for h in hits)
        base = "greatest(" + ", ".join(f"CASE WHEN {h} THEN {w}::DOUBLE ELSE 0 END" for h, (_, w) in zip(hits, patterns, strict=True)) + ", 0)"
        rows.append(f"CASE WHEN {n} > 0 THEN round(least({base} + least({u.BONUS}::DOUBLE * ({n} - 1), {u.MOST_BONUS}::DOUBLE), {u.MOST}::DOUBLE), 6) ELSE 0 END")
    return "[" + ", ".join(rows) + "]"


_INTENTS = f"""{_ASKED}, s AS (SELECT query_id, query, {_intent_sql('query')} AS scores FROM a), i AS (SELECT query_id, query, list_max(scores) AS top, ({_quoted(list(u.INTENTS))})[list_position(scores, list_max(scores))] AS best FROM s),
    c AS (SELECT query_id, query, CASE WHEN top >= {u.LEAST} THEN best ELSE 'unknown' END AS intent, CASE WHEN top >= {u.LEAST} THEN round(top, 2) ELSE 0.5 END AS confidence FROM i)"""


@registered(f"WITH {_INTENTS} SELECT query_id, intent, confidence FROM c")
def classify_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", u.classify_intent(F.col("query")).alias("c")).select("query_id", "c.*")


_CUE = u.FOLLOWUP_CUE.replace("'", "''")


@registered(f"WITH {_UNDERSTOOD} SELECT query_id, NOT regexp_matches(query, '{u.SELF_CONTAINED}') AND len(tacts) = 0 AND len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) <= 7 AND regexp_matches(query, '{_CUE}') AS followup FROM un")
def is_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", u.is_followup(F.col("query")).alias("followup"))


_TALK = f"w AS (SELECT conv_id AS session_id, turn, ({_quoted(PHRASES)})[(conv_id + turn) % {len(PHRASES)} + 1] AS query, CASE WHEN turn % 4 = 0 THEN 'Section ' || turn ELSE '' END AS subject FROM conversations)"
_FOLLOWS = f"NOT regexp_matches(query, '{u.SELF_CONTAINED}') AND NOT ({' OR '.join(_FIRES.values())}) AND len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) <= 7 AND regexp_matches(query, '{_CUE}')"


def as_talk(conversations: DataFrame) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(PHRASES)).cast("int"))
    return conversations.select(F.col("conv_id").alias("session_id"), "turn", phrase.alias("query"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Section "), F.col("turn"))).otherwise("").alias("subject"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_talk(table(spark, sf_dir, "conversations"))


@registered(f"WITH {_TALK}, l AS (SELECT *, last_value(CASE WHEN subject <> '' THEN subject END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before FROM w) SELECT session_id, turn, CASE WHEN {_FOLLOWS} AND before IS NOT NULL THEN query || ' regarding ' || before ELSE query END AS effective FROM l")
def followup_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.followup_resolve(talk(spark, sf_dir)).select("session_id", "turn", "effective")


# ── Entities ──


@registered()
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.extract_entities(asked(spark, sf_dir)).select("query_id", F.explode("entities").alias("e")).select("query_id", "e.*")


@registered()
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.match_entities(asked(spark, sf_dir)).select("query_id", F.size("matches").alias("n_matches"), F.size(u.entity_overlap(F.col("matches"))).alias("n_kept"))


_KINDS = ["ACT", "SECTION", "ARTICLE", "LEGAL_CITATION", "COURT"]
_MADE = f"""e AS (SELECT doc_id AS query_id, list_transform(range(doc_id % 4), lambda k: {{'type': ({_quoted(_KINDS)})[(doc_id + k * n_chars) % 5 + 1], 'value': 'value ' || (n_chars + k), 'confidence': (60 + (doc_id * 7 + k * n_chars) % 40) / 100.0::DOUBLE}}) AS es FROM documents)"""


def made_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three entities for each document."""
    n, i = F.col("n_chars"), F.col("doc_id")
    one = lambda k: F.struct(
        F.get(F.array(*map(F.lit, _KINDS)), ((i + k * n) % 5).cast("int")).alias("type"), F.concat(F.lit("value "), n + k).alias("value"), ((60 + (i * 7 + k * n) % 40) / 100.0).alias("confidence"))
    every = F.transform(F.sequence(F.lit(0), F.lit(2)), one)
    return table(spark, sf_dir, "documents").select(i.alias("query_id"), F.slice(every, F.lit(1), (i % 4).cast("int")).alias("entities"))


_FIT = f"list_filter(es, lambda x: x.type IN ('ACT', 'SECTION', 'ARTICLE', 'LEGAL_CITATION') AND x.confidence >= {u.ANCHOR_LEAST})"
_BEST = f"{_MADE}, g AS (SELECT query_id, es, {_FIT} AS fit FROM e), h AS (SELECT query_id, es, list_filter(fit, lambda x: x.confidence = list_max(list_transform(fit, lambda y: y.confidence)))[1] AS best FROM g)"


@registered(f"WITH {_BEST} SELECT query_id, best.type AS type, best.value AS value FROM h")
def best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_entities(spark, sf_dir).select("query_id", u.best_anchor(F.col("entities")).alias("b")).select("query_id", "b.type", "b.value")


@registered(f"WITH {_MADE} SELECT query_id, trim(coalesce(list_filter(es, lambda x: x.type IN ('SECTION', 'ARTICLE'))[1].value, '') || ' ' || coalesce(list_filter(es, lambda x: x.type = 'ACT')[1].value, '')) AS subject FROM e")
def build_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_entities(spark, sf_dir).select("query_id", u.build_subject(F.col("entities")).alias("subject"))


@registered(f"""WITH {_INTENTS}, {_BEST}, r AS (SELECT query_id, intent, best FROM c JOIN h USING (query_id))
    SELECT query_id, CASE WHEN intent = 'conversation' THEN 'conversation' WHEN intent <> 'legal_overview' AND best IS NOT NULL THEN 'deterministic' WHEN intent IN {tuple(u.RAG_INTENTS)} THEN 'rag' ELSE 'unknown' END AS route,
    CASE WHEN intent = 'conversation' THEN 'conversational input — no legal retrieval' WHEN intent <> 'legal_overview' AND best IS NOT NULL THEN best.type || ' entity ''' || best.value || ''' detected (confidence ' || best.confidence || ')' WHEN intent IN {tuple(u.RAG_INTENTS)} THEN 'intent is ' || intent ELSE 'no legal intent or provision identified' END AS reason FROM r""")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = asked(spark, sf_dir).select("query_id", u.classify_intent(F.col("query"))["intent"].alias("intent"))
    return intents.join(made_entities(spark, sf_dir), "query_id").select("query_id", u.route(F.col("intent"), F.col("entities")).alias("r")).select("query_id", "r.*")


_RAWS = "v AS (SELECT doc_id, (['SECTION', 'ARTICLE', 'ACT', 'COURT'])[doc_id % 4 + 1] AS kind, (['sec. ', 'Art. ', 'the  Act  ', 'high  court '])[doc_id % 4 + 1] || CASE WHEN doc_id % 4 = 3 THEN '' ELSE (n_chars % 300)::VARCHAR || (['', 'a', 'b'])[n_chars % 3 + 1] END AS raw FROM documents)"


@registered(rf"""WITH {_RAWS}, f AS (SELECT doc_id, kind, regexp_replace(trim(raw), '\s+', ' ', 'g') AS r FROM v) SELECT doc_id, CASE kind WHEN 'SECTION' THEN 'Section ' || regexp_extract(r, '(\d+)([a-z]?)', 1) || upper(regexp_extract(r, '(\d+)([a-z]?)', 2))
    WHEN 'ARTICLE' THEN 'Article ' || regexp_extract(r, '(\d+)([a-z]?)', 1) || upper(regexp_extract(r, '(\d+)([a-z]?)', 2)) WHEN 'ACT' THEN regexp_replace(r, '(?i)^(?:the|an?)\s+', '') ELSE 'High Court' END AS value FROM f""")
def norm_entity_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    i, n = F.col("doc_id"), F.col("n_chars")
    raw = F.concat(pick(["sec. ", "Art. ", "the  Act  ", "high  court "], i % 4), F.when(i % 4 == 3, "").otherwise(F.concat(n % 300, pick(["", "a", "b"], n % 3))))
    return table(spark, sf_dir, "documents").select("doc_id", u.norm_entity_value(pick(["SECTION", "ARTICLE", "ACT", "COURT"], i % 4), raw).alias("value"))


# ── Provisions ──

_WORDS = [terms[0] for terms in u.TOPICS.values()]


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provision for every act and number that a document comes to, the least document's."""
    i = F.col("doc_id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = table(spark, sf_dir, "documents").select(pick(ACT_KEYS, i % len(ACT_KEYS)).alias("act_key"), (i % len(ACT_KEYS)).alias("act_order"), F.concat(i % 40, F.when(i % 5 == 0, "A").otherwise("")).alias("number"), i.alias("doc_id"))
    least = rows.groupBy("act_key", "act_order", "number").agg(F.min("doc_id").alias("doc_id"))
    return least.withColumn("keywords", F.array(pick(_WORDS, F.col("doc_id") % len(_WORDS)), pick(_WORDS, F.col("doc_id") * 7 % len(_WORDS))))


_PROVISIONS = f"""p AS (SELECT act_key, act_order, number, min(doc_id) AS doc_id FROM (SELECT ({_quoted(ACT_KEYS)})[doc_id % {len(ACT_KEYS)} + 1] AS act_key, doc_id % {len(ACT_KEYS)} AS act_order, (doc_id % 40) || CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE '' END AS number, doc_id FROM documents) GROUP BY ALL),
    pk AS (SELECT *, [({_quoted(_WORDS)})[doc_id % {len(_WORDS)} + 1], ({_quoted(_WORDS)})[doc_id * 7 % {len(_WORDS)} + 1]] AS keywords FROM p)"""


@registered(rf"""WITH {_UNDERSTOOD}, {_PROVISIONS}, r AS (SELECT query_id, 'Section ' || (query_id % 40) || CASE WHEN query_id % 5 = 0 THEN 'a' ELSE '' END || CASE WHEN query_id % 3 = 0 THEN '(1)' ELSE '' END AS ref, acts FROM un),
    n AS (SELECT query_id, ref, acts, regexp_replace(upper(regexp_replace(ref, '^Section ', '')), '\s*\([^)]+\)$', '') AS number FROM r),
    h AS (SELECT query_id, ref, p.act_key, p.number, row_number() OVER (PARTITION BY query_id ORDER BY act_order) AS k FROM n JOIN p ON upper(p.number) = n.number AND (len(acts) = 0 OR list_contains(acts, p.act_key)) QUALIFY k = 1)
    SELECT r.query_id, r.ref, h.act_key, upper(h.number) AS number FROM r LEFT JOIN h USING (query_id)""")
def statute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("query_id")
    ref = F.concat(F.lit("Section "), i % 40, F.when(i % 5 == 0, "a").otherwise(""), F.when(i % 3 == 0, "(1)").otherwise(""))
    refs = asked(spark, sf_dir).select("query_id", ref.alias("ref"), u.detect_acts(F.col("query")).alias("act_keys"))
    return u.statute_lookup(refs, provisions(spark, sf_dir))


@registered(f"""WITH {_UNDERSTOOD}, {_PROVISIONS}, q AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos, CASE WHEN whole IS NOT NULL THEN [whole] ELSE tacts END AS scope FROM un), kw AS (SELECT act_key, act_order, number, unnest(keywords) AS kw FROM pk),
    h AS (SELECT query_id, act_key, act_order, number, min(pos) AS pos FROM q JOIN kw ON lower(term) = lower(kw) WHERE len(scope) = 0 OR list_contains(scope, act_key) GROUP BY ALL)
    SELECT query_id, act_key, number, row_number() OVER (PARTITION BY query_id ORDER BY pos, act_order, number)::INT AS place FROM h QUALIFY place <= 5""")
def topic_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.filter(F.array(u.resolve_act(F.col("query"))), lambda k: k.isNotNull())
    return u.topic_fallback_lookup(asked(spark, sf_dir).select("query_id", "query", whole.alias("act_keys")), provisions(spark, sf_dir))
