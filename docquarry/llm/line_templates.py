"""Line dedup by a log-template tree.

Lines pass a tree of fixed depth: first by their number of tokens, then by their leading tokens, in which anything with
a digit stands for a variable field. In a leaf that enough documents reach, a token that recurs at its place in enough
documents belongs to the template, and any other is a variable field (``<*>``). A template needs at least half of its
tokens fixed; else the line stands for itself, figures and all. Lines whose template recurs in enough documents are dropped.

Spark does the grouping: a leaf is a key, its token counts are one aggregation, so no leaf is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut, text_key

FIELD = "<*>"


def plain_spaces(text: Column) -> Column:
    r"""``text`` with a space for each white-space character but ``\n`` (looked for first, as most texts have none)."""
    odd = "\t\x0b\x0c\r"
    return F.when(F.greatest(*(F.contains(text, F.lit(c)) for c in odd)), F.translate(text, odd, " " * len(odd))).otherwise(text)


def tokens(line: Column) -> Column:
    """The words of a line that has no white space but spaces."""
    return F.array_remove(F.split(line, " "), "")


def _variable(token: Column) -> Column:
    return token.rlike("[0-9]")


def leaf(words: Column, depth: int) -> Column:
    """The leaf that a line of ``words`` comes to: a hash of their number and the leading ones."""
    leading = (F.get(words, F.lit(i)) for i in range(depth))
    return F.xxhash64(F.size(words), *(F.when(_variable(w), FIELD).otherwise(w) for w in leading))


def line_templates(docs: DataFrame, *, depth: int = 4, least: int = 5, similar: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    r"""(_id, _th, line, template): every line of ``docs`` whose template recurs in at least ``least`` documents.

    Lines are the parts between ``\n``; ``line`` counts from 0; lines without a word are never listed. Documents equal in
    id and text count once in what recurs, and give equal rows. Null texts have no lines.
    """
    lines = (docs.select(*text_key(doc_id, text), F.col(text).alias("_text"))
             .select("_id", "_th", F.posexplode(F.split(plain_spaces(F.col("_text")), "\n")).alias("line", "_line"))
             .filter(F.trim("_line") != "").select("_id", "_th", "line", tokens(F.col("_line")).alias("_words"))
             .withColumn("_leaf", leaf(F.col("_words"), depth)))
    reached = lines.select("_leaf", "_id", "_th").distinct().groupBy("_leaf").agg(F.count("*").alias("_docs")).filter(F.col("_docs") >= least)
    kept = cut(lines.join(cut(reached, "leaves").select("_leaf"), "_leaf").select("_id", "_th", "line", "_leaf", "_words"), "leaf-lines")
    placed = kept.select("_leaf", "_id", "_th", "line", F.posexplode("_words").alias("_at", "_token")).filter(~_variable(F.col("_token")))
    fixed = (placed.select("_leaf", "_at", "_token", "_id", "_th").distinct().groupBy("_leaf", "_at", "_token").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
             .select("_leaf", "_at", "_token"))
    # What is fixed of each line: one row per line again.
    held = placed.join(cut(fixed, "fixed"), ["_leaf", "_at", "_token"]).groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t"), F.col("line").alias("_l")).agg(F.collect_set("_at").alias("_fixed"))
    whole = (kept.join(held, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")) & (F.col("line") == F.col("_l")), "left")
             .select("_id", "_th", "line", "_words", F.coalesce("_fixed", F.array().cast("array<int>")).alias("_fixed")))
    general = F.transform("_words", lambda w, i: F.when(F.array_contains("_fixed", i), w).otherwise(FIELD))
    template = F.array_join(F.when(F.size("_fixed") >= similar * F.size("_words"), general).otherwise(F.col("_words")), " ")
    lined = cut(whole.select("_id", "_th", "line", template.alias("template")), "templates")
    recurring = lined.select("template", "_id", "_th").distinct().groupBy("template").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("template")
    return lined.join(cut(recurring, "recurring"), "template").select("_id", "_th", "line", "template")


def drop_template_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with its recurring lines taken out of ``text``, and how many that were in n_lines_dropped; all rows and other columns stay.

    Null texts stay null; a text all of whose lines go becomes empty. Equal rows get equal results. No rows: none come out.
    """
    drops = cut(line_templates(docs, doc_id=doc_id, text=text, **params).groupBy(F.col("_id").alias("_dq_id"), F.col("_th").alias("_dq_th")).agg(F.collect_set("line").alias("_dq_drop")), "line-drops")
    th = F.xxhash64(F.col(text).isNull(), F.col(text))
    joined = docs.join(drops, docs[doc_id].eqNullSafe(drops["_dq_id"]) & (th == drops["_dq_th"]), "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_dq_drop", i)), "\n")
    return (joined.withColumn("n_lines_dropped", F.coalesce(F.size("_dq_drop"), F.lit(0)))
            .withColumn("n_lines_dropped", F.greatest("n_lines_dropped", F.lit(0)))
            .withColumn(text, F.when(F.col("_dq_drop").isNull(), F.col(text)).otherwise(left)).drop("_dq_id", "_dq_th", "_dq_drop"))
