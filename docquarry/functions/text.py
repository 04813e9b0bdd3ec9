"""Text expressions: each takes a column and returns a column, so they stay in generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, suffixes and boilerplate that results depend on.
LEXICAL_STOP = ("a an the of to in on at by for with is are was were be been can could may might shall should will would do does did i we you he she it they "
                "this that these those if then under as about into from and or not no any my our your").split()
RERANK_STOP = ("a an the of to in on at by for with is are was were be been can could may might shall should will would do does did i we you he she it they "
               "what which who whom how when where why and or not no any my our your this that these those if then under as about into from").split()
EVAL_STOP = ("a an the and or but if then else of to in on at by for with without from is are was were be been being it its this that these those as not no nor "
             "do does did have has had will shall may might can could would should").split()
ARTICLES = ["a", "an", "the"]
SUFFIXES = "ities ments sions tions iest ally edly ment ness sion tion ies ing ity ed er es ly s".split()
BOILERPLATE = [
    r"this is legal information,?\s*not legal advice\.?",
    r"refer to the cited sources below[^.]*\.",
    r"key authority:[^\n]*",
    r"based on your question[^.]*\.",
    r"here is what the relevant indian law provides[^.]*\.",
    r"the most applicable provisions in the [a-z]+ corpus are:?",  # whatever one word names the corpus
    r"primary provisions? matching your query:?",
    r"i could not find any relevant passages[^.]*\.",
]
LEXICAL_TOKEN = "§|¶|[a-z0-9]+"


def _extract(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def tokenize_lexical(text: Column) -> Column:
    """Lower-case tokens of letters, digits and statute marks, without the stop words; repeats stay."""
    return F.filter(_extract(F.lower(text), LEXICAL_TOKEN), lambda t: ~t.isin(LEXICAL_STOP))


def content_tokens(text: Column) -> Column:
    """Distinct words of three letters or more that carry content."""
    return F.array_distinct(F.filter(_extract(F.lower(text), "[a-z]+"), lambda t: (F.length(t) > 2) & ~t.isin(RERANK_STOP)))


def _opening(pattern: str) -> str:
    """The letters and spaces that any match of ``pattern`` begins with, in lower case."""
    m = re.match("[a-z ]+", pattern)
    return m[0][:-1] if pattern[m.end() : m.end() + 1] in ("?", "*") else m[0]


def strip_answer_noise(text: Column) -> Column:
    """Takes out citation marks, source notes, heading lines, boilerplate and long dashes.

    Most texts have none of it. Each pattern needs some plain characters; where a text lacks all of these, only dashes are left to do.
    """

    def stripped(t: Column) -> Column:
        t = F.regexp_replace(t, r"\[\d{1,3}\]", " ")
        t = F.regexp_replace(t, r"(?i)\(source:\s*[^)]+\)", " ")
        t = F.regexp_replace(t, r"(?mi)^\*{0,2}(?:section|article|clause)\s+\d+[A-Za-z]?\s*[—\-:].*$", " ")
        for phrase in BOILERPLATE:
            t = F.regexp_replace(t, f"(?is){phrase}", " ")
        return t

    def once(t: Column) -> Column:
        need = ["(source:", "section", "article", "clause", *map(_opening, BOILERPLATE)]
        some = F.exists(F.array(F.lower(t)), lambda low: F.contains(low, F.lit("[")) | reduce(Column.__or__, (F.contains(low, F.lit(n)) for n in need)))
        return F.regexp_replace(F.when(some, stripped(t)).otherwise(t), "[–—‒]", " ")

    return F.transform(F.array(text), once)[0]


def normalize_for_eval(text: Column) -> Column:
    """Noise out, lower case, punctuation but § and % out, white space collapsed. Doing it twice changes nothing; null becomes empty."""
    text = F.lower(strip_answer_noise(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s§%]+", " "), r"\s+", " "))


def words_for_eval(text: Column) -> Column:
    """A text with the lower-case words (of ``[a-z0-9]+``) that a text has once it is normalised and stripped of noise again.

    Punctuation and white space don't lie in such words, so a text that holds no noise need only be lower-cased. The second
    stripping meets no marks any more; what it may find has one of ``information``, ``applicable`` and ``matching``.
    """
    need = ["[", "(source:", "section", "article", "clause", *map(_opening, BOILERPLATE), "information", "applicable", "matching"]
    full = F.lower(strip_answer_noise(normalize_for_eval(text)))
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: F.when(reduce(Column.__or__, (F.contains(low, F.lit(n)) for n in need)), full).otherwise(low))[0]


def stem_suffix(token: Column) -> Column:
    """Strips the first suffix of the list that leaves three letters; undoes a doubled consonant after ed, ing and er."""
    out = None
    for suffix in SUFFIXES:
        stem = F.substr(token, F.lit(1), F.length(token) - len(suffix))
        if suffix in ("ed", "ing", "er"):
            last = F.right(stem, F.lit(1))
            doubled = (F.length(stem) >= 4) & (last == F.substr(stem, F.length(stem) - 1, F.lit(1))) & ~last.isin(list("aeiouy"))
            stem = F.when(doubled, F.substr(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)
        fits = token.endswith(suffix) & (F.length(token) >= len(suffix) + 3)
        out = F.when(F.length(token) <= 3, token).when(fits, stem) if out is None else out.when(fits, stem)
    return out.otherwise(token)


def eval_tokens(text: Column) -> Column:
    """Stems of the normalised words, articles left out; repeats stay."""
    return F.transform(F.filter(_extract(F.lower(strip_answer_noise(text)), "[a-z0-9]+"), lambda t: ~t.isin(ARTICLES)), stem_suffix)


def eval_keywords(text: Column) -> Column:
    """Distinct stems of words of three letters or more that aren't stop words."""
    return F.array_distinct(F.transform(F.filter(_extract(F.lower(strip_answer_noise(text)), "[a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(EVAL_STOP)), stem_suffix))


def bench_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(_extract(F.lower(text), "[a-z0-9]+"), lambda t: F.length(t) > 2))


def normalise_alias(text: Column) -> Column:
    """Key form of an act's name: lower case, no dots, commas, years or leading article."""
    text = F.regexp_replace(F.lower(text), "[.,]", "")
    text = F.regexp_replace(text, r"\b(1[89]\d{2}|20\d{2})\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^the\s+", ""), r"\s+", " "))


def section_numbers(text: Column) -> Column:
    """Numbers of one to four digits with an optional letter, with or without a section word, in order of first mention."""
    return F.array_distinct(F.transform(_extract(text, r"(?i)(?:(?:section|sec|s\.|article|art\.|art|§)\s*)?(\d{1,4}[a-z]?)", 1), F.lower))


def norm_provision_ref(text: Column) -> Column:
    """``Sec. 302(1)`` to ``302``: no prefix, no sub-clause, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^(?:section|sec\.?|article|art\.?)\s*", ""), r"\s*\([^)]+\)$", "")))


def citation_markers(text: Column) -> Column:
    return F.array_distinct(F.transform(_extract(text, r"\[(\d{1,2})\]", 1), lambda x: x.cast("int")))


def version_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.char(F.lit(0)), index.cast("string"), F.char(F.lit(0)), F.substring(text, 1, 200)), 256), 1, 16)


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, r"ls(?:__|v2_)[A-Za-z0-9_\-]{20,}", "<redacted>")


def is_heading(line: Column) -> Column:
    """Numbered, roman, keyword, statute-unit or all-capital heading lines of up to 120 characters."""
    s = F.trim(line, F.lit(" \t\n\x0b\f\r"))
    roman = s.rlike(r"^(?=[MDCLXVI])M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\.\s+[A-Z]")
    unit = s.rlike(r"(?i)^(?:(?:section|article|clause|rule|order|regulation|provision)\s+|§\s*)\d+[A-Za-z]?")
    capitals = F.length(s).between(5, 80) & (s == F.upper(s)) & s.rlike("[A-Z]") & ~s.rlike("[.!?,;]")
    return (F.length(s) > 0) & (F.length(s) <= 120) & (
        s.rlike(r"^\d+(?:\.\d+)*\.?\s+[A-Z]") | roman | s.rlike(r"(?i)^(?:CHAPTER|PART|SCHEDULE|ANNEXURE|APPENDIX|TITLE|BOOK)\s+(?:\d+|[IVXLC]+|[A-Z])\b") | unit | capitals)


def natural_number_key(text: Column) -> Column:
    """Sort key of provision numbers: those with digits first, by their digits as a number, then by the rest."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.struct((digits == "").cast("int").alias("no_digits"), F.coalesce(digits.try_cast("long"), F.lit(0)).alias("number"), F.regexp_replace(text, "[0-9]", "").alias("rest"))


def metric_key(name: Column, tags: Column) -> Column:
    """``name.k=v.k=v``, tags sorted, empty ones dropped."""
    kept = F.filter(F.array_sort(F.map_entries(tags)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.concat_ws(".", name, F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def floor_bucket(ts: Column, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def cosine_pair(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1, 4 digits; 0 for empty or unlike vectors and zero norms."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) > 0) & (F.size(x) == F.size(y)) & (norm > 0), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm)), 4)).otherwise(0.0)


def as_utc(ts: Column) -> Column:
    """ISO form of a timestamp without zone, which counts as UTC."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def split_metric_key(key: Column) -> tuple[Column, Column]:
    """The name and the tags of a ``name.k=v`` key."""
    parts = F.split(key, r"\.(?=[^.=]+=)")
    tags = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    return parts[0], F.map_from_entries(tags)


def decode_json(text: Column, schema: str) -> Column:
    """The fields of a JSON text; those of a malformed one are null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
