"""Goldens of question understanding, chunking and sources."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answer, chunking
from docquarry.operators import understand as u
from docquarry.sources import tables


def _rows(spark, phrases):
    return spark.createDataFrame(list(enumerate(phrases)), "query_id int, query string")


def test_acts_sections_and_variants(spark):
    q = _rows(spark, ["Section 302 of IPC", "bail and drunk driving", "", None, "under the Indian Penal Code, 1860"])
    r = {x.query_id: x for x in u.rewrite_queries(q).collect()}
    assert r[0].act_keys == ["ipc", "copyright", "trademarks", "patents"] and r[0].sections == ["302"] and r[0].variants[-1] == "section 302 Indian Penal Code, 1860"
    assert set(r[1].act_keys) == {"crpc", "bnss", "mv"} and "drink and drive" in r[1].expanded
    assert r[2].variants == [] and r[3].variants == [] and r[4].act_keys == ["ipc"]


@pytest.mark.parametrize(("phrase", "intent"), [("Tell me about Section 302 IPC", "bare_act_query"), ("Can I drink and drive in India?", "legal_research"), ("hello there", "conversation"), ("Give me an overview of the Motor Vehicles Act", "legal_overview"), ("AIR 1978 SC 597", "citation_lookup"), ("blue sky", "unknown")])
def test_intents(spark, phrase, intent):
    assert _rows(spark, [phrase]).select(u.classify_intent(F.col("query"))["intent"]).first()[0] == intent


def test_entities_do_not_overlap(spark):
    q = _rows(spark, ["see AIR 1978 SC 597 and section 25f(1) of the Companies Act, 2013", "420 IPC", "", None])
    e = {x.query_id: [(y.type, y.value) for y in x.entities] for x in u.extract_entities(q).collect()}
    assert e[0][:2] == [("LEGAL_CITATION", "AIR 1978 SC 597"), ("SECTION", "Section 25F(1)")]
    assert e[1] == [("SECTION", "Section 420")] and e[2] == e[3] == []


def test_chunks_hold_their_places():
    text = "Section 1 First\nOne sentence here. Another one follows it. " + "More words stand here now. " * 30 + "\nSection 2 Second\n" + "Short text of it. " * 8
    strategy, found = chunking.cut_text(text, chunking.ChunkConfig(200, 20, min_chars=10, fold_below=40))
    assert strategy == "section" and len(found) > 3 and found[0][3] == "Section 1 First"
    for body, a, b, _ in found:
        assert all(piece in text.strip() for piece in body.split("\n\n")) and text.strip()[a:].startswith(body.split("\n\n")[0]) and a < b <= len(text)
    assert chunking.cut_text("  ")[1] == [] and not any(p[0] == "Tiny tail." for p in chunking.cut_text("A first sentence that is long enough here. A second sentence of about this length. Tiny tail.", chunking.ChunkConfig(80, 10, min_chars=1, fold_below=40))[1])
    clauses = chunking.split_subclauses("Whoever does " + " ".join(f"({k}) " + "word " * 12 for k in ("1", "a", "iv", "b")), 100)
    assert len(clauses) >= 2 and max(map(len, clauses)) <= 100


def test_pages_rows_and_headers(spark):
    html = "<html lang='en'><head><title>T  x</title><script>var a = '</p>';</script></head><body><nav>menu</nav><p>Body &amp; text</p><style>p{}</style></body></html>"
    assert tables.page_text(html) == ("Body & text", "T x", "en")
    rows = spark.createDataFrame([("a", 0, ["Section", "Title"]), ("a", 1, ["302", " Murder "]), ("a", 2, ["", " "]), ("b", 0, ["1", "2"]), ("b", 1, ["3", "x"])], "source string, row_no int, cells array<string>")
    out = {r.source: (r.text, r.row_count) for r in tables.render_rows(rows).collect()}
    assert out == {"a": ("Section: 302 | Title: Murder", 1), "b": ("1 | 2\n\n3 | x", 2)}


def test_citations_fall_back_to_the_first_hit(spark):
    hits = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "C")], "query_id int, rank int, chunk_id string")
    answers = spark.createDataFrame([(1, "see [2] and [9] and [2]"), (2, "nothing")], "query_id int, answer string")
    assert sorted((r.query_id, r.chunk_id) for r in answer.citation_join(answers, hits).collect()) == [(1, "B"), (2, "C")]
    assert sorted((r.query_id, r.valid, r.missing) for r in answer.citation_report(answers, hits).collect()) == [(1, [2], [9]), (2, [], [])]


@pytest.mark.parametrize(("phrase", "intent"), [
    ("bye", "conversation"), ("who are you?", "conversation"), ("okay great", "conversation"), ("trademark passing off", "legal_research"), ("cheque bounce", "legal_research"), ("land grabbing", "legal_research"),
    ("what are the conditions for bail", "legal_research"), ("tl;dr", "document_summary"), ("highlight the key points", "document_summary"), ("1990 SCR 12", "citation_lookup"), ("Schedule VII", "bare_act_query"),
    ("what has the Supreme Court held", "case_lookup"), ("Tell me about the Motor Vehicles Act", "legal_overview"), ("Give me an overview of the IT Act", "legal_overview"), ("What does the Consumer Protection Act cover?", "legal_overview"),
    ("What is the purpose of the RTI Act?", "legal_overview"), ("Can I drink and drive in India?", "legal_research"), ("Tell me about Section 302 IPC", "bare_act_query"), ("zzz qqq", "unknown")])
def test_all_intent_patterns(spark, phrase, intent):
    assert spark.createDataFrame([(phrase,)], "q string").select(u.classify_intent(F.col("q"))["intent"]).first()[0] == intent


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("see 1990 SCR 1234", "LEGAL_CITATION", "1990 SCR 1234"), ("2019  Cri LJ 500", "LEGAL_CITATION", "2019 Cri LJ 500"), ("2001 KLT 9", "LEGAL_CITATION", "2001 KLT 9"), ("the Delhi High Court", "COURT", "Delhi High Court"),
    ("High Court of Judicature at Bombay", "COURT", "High Court of Judicature at Bombay"), ("National Green Tribunal", "COURT", "National Green Tribunal"), ("the supreme  court", "COURT", "Supreme Court of India"), ("NCLT", "COURT", "NCLT"),
    ("420 IPC", "SECTION", "Section 420"), ("Sec. 138a", "SECTION", "Section 138A"), ("Article 226(1)", "ARTICLE", "Article 226(1)"), ("Industrial Disputes Act, 1947", "ACT", "Industrial Disputes Act, 1947")])
def test_entity_rules(spark, text, kind, value):
    out = u.extract_entities(spark.createDataFrame([(1, text)], "query_id int, query string")).first().entities
    assert [(e.type, e.value) for e in out] == [(kind, value)]


def test_overlap_against_all_pairs(spark):
    """What is kept is what a greedy choice over all pairs keeps: surer first, then longer, then earlier."""
    texts = ["Section 25F(1) of the Industrial Disputes Act, 1947 and IPC 420", "AIR 1978 SC 597, (1990) 3 SCC 682, 2023 SCC OnLine SC 12", "High Court of Delhi High Court Supreme Court of India", "420 IPC 302 CrPC 41", "", "Code of Criminal Procedure Act Art. 21A"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    for r in u.match_entities(q).select("query_id", "matches", u.entity_overlap(F.col("matches")).alias("kept")).collect():
        kept = []
        for m in sorted(r.matches, key=lambda m: (-m.confidence, m.start - m.end, m.start)):
            if not any(m.start < k.end and k.start < m.end for k in kept):
                kept.append(m)
        assert [(k.start, k.end, k.type) for k in r.kept] == [(k.start, k.end, k.type) for k in sorted(kept, key=lambda k: k.start)]


def test_automata_find_what_loops_find(spark):
    """Every alias, topic and term by itself and within a phrase, against a nested loop over the dictionaries."""
    every = [*u.ALIASES, *u.TOPICS, *(t for terms in u.TOPICS.values() for t in terms)]
    texts = [*every, *(f"What about {a} and {b}?" for a, b in zip(every, every[7:], strict=False)), "", None, "the Indian Penal Code, 1860", "xfirx"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    norm = {r.query_id: (r.n, r.w) for r in q.select("query_id", tx.normalise_alias(F.col("query")).alias("n"), F.transform(F.regexp_extract_all("query", F.lit("[a-zA-Z]+"), F.lit(0)), tx.normalise_alias).alias("w")).collect()}
    once = lambda xs: list(dict.fromkeys(x for x in xs if x is not None))
    act = lambda t: u.ALIASES.get(t) or next((k for a, k in u.ALIASES.items() if a in t), None)
    assert len(u.TOPICS) == 55 and sum(map(len, u.INTENTS.values())) == 67 and len(u.ENTITY_RULES) == 26
    for r in u.understood(q).collect():
        text = texts[r.query_id]
        if text is None:
            assert r.act_keys is None
            continue
        fired = [t for t, terms in u.TOPICS.items() if any(x in text.lower() for x in (t, *terms))]
        scope = once(k for t in fired for k in u.TOPIC_ACTS[t])
        whole, words = norm[r.query_id]
        assert (r.act, r.act_keys, r.terms, r.topic_acts) == (act(whole), once([act(whole), *map(act, words), *scope]), once(x for t in fired for x in u.TOPICS[t]), scope)
    assert u.understood(q, aliases={}, topics={}).filter("act is not null or size(terms) > 0").count() == 0


def test_rewriting_by_automata(spark):
    """What is rewritten against the expressions for acts and topics, over a plan that reads each text by automata, not by one expression for each entry."""
    every = [*u.ALIASES, *u.TOPICS]
    texts = [f" {a} and Section {i}a of {b} " for i, (a, b) in enumerate(zip(every, every[5:], strict=False))][::6] + [None, "", " \t"]
    q = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "query_id int, query string")
    rows = u.rewrite_queries(q)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and len(plan) < 200_000
    trim = F.regexp_replace(F.coalesce("query", F.lit("")), r"^\s+|\s+$", "")
    want = q.select("query_id", trim.alias("original"), u.detect_acts(trim).alias("act_keys"), tx.section_numbers(trim).alias("sections")).collect()
    key = lambda r: (r.query_id, r.original, r.act_keys, r.sections)
    got = rows.collect()
    assert sorted(map(key, got)) == sorted(map(key, want)) and all(r.variants == [] if r.original == "" else r.variants[0] == r.original for r in got)
    assert u.union_variants(q).count() == sum(len(r.variants) for r in got)


def test_route_reasons(spark):
    e = spark.createDataFrame([("legal_research", [("SECTION", "Section 302", 0.93)]), ("conversation", []), ("legal_overview", [("ACT", "IPC", 0.93)]), ("unknown", [("COURT", "High Court", 0.95)])], "i string, e array<struct<type:string,value:string,confidence:double>>")
    out = [tuple(r.r) for r in e.select(u.route(F.col("i"), F.col("e")).alias("r")).collect()]
    assert out == [("deterministic", "SECTION entity 'Section 302' detected (confidence 0.93)"), ("conversation", "conversational input — no legal retrieval"), ("rag", "intent is legal_overview"), ("unknown", "no legal intent or provision identified")]
