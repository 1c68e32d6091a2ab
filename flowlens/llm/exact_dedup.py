"""Exact dedup by content-defined chunk recipes (operator 5, built-in functions only).

A text becomes a recipe: the ordered list of its chunks' identifiers.  Chunks are cut where the
content says so, so texts that share passages share chunks, and a chunk's text is moved once
however many documents hold it.  Identifiers are verified: chunks are compared as text, and an
identifier that two different chunks have is not trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import collapse_spaces, first_rows, llm_query, stored, tidied, whole_rows

#: A chunk ends at a space between a vowel and one of a few letters, after at least 1,024 and at most 8,192 characters.
CHUNK = r"(?s).{1024,8192}?(?:(?<=[aeiou]) (?=[a-f])|\z)|.{1,8192}"


def chunks(text: Column) -> Column:
    """The chunks of a normalised text; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def unverified_ids(texts: DataFrame, identify=chunk_id) -> DataFrame:
    """Identifiers that stand for two or more different chunks of ``texts`` (column _text).

    Distinct chunks meet as text, once each; after that only identifiers move.
    """
    distinct = texts.select(F.explode(chunks(F.col("_text"))).alias("_chunk")).select(identify(F.col("_chunk")).alias("_id"), "_chunk").distinct()
    return distinct.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")


@tidied
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", identify=chunk_id) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one space; null counts as
    empty.  The smallest id of a group stays.  Rows that repeat an id and a text share the verdict.
    A null id never stays beside another id; a group of null ids only is kept whole.

    Documents whose recipe holds an unverified identifier are grouped by recipe and whole text, so a
    weak ``identify`` costs time but never joins different texts.
    """
    source = docs.select(F.col(id_col).alias("_doc"), collapse_spaces(F.col(text)).alias("_text"))
    bad = stored(unverified_ids(source, identify), "chunk-clashes")
    recipe = F.transform(chunks(F.col("_text")), identify)
    recipes = source.select("_doc", recipe.alias("_recipe"), F.sha2("_text", 256).alias("text_sha256"), "_text")
    if bad.isEmpty():
        recipes = stored(recipes.select("_doc", "_recipe", "text_sha256", F.lit(None).cast("string").alias("_tie")), "recipes")
    else:
        hit = recipes.select("_doc", F.explode("_recipe").alias("_id")).join(bad, "_id", "left_semi").select("_doc").distinct().withColumnRenamed("_doc", "_hit")
        marked = recipes.join(hit, F.col("_doc").eqNullSafe(F.col("_hit")), "left").withColumn("_tie", F.when(F.size("_recipe") > 0, F.when(F.col("_hit").isNotNull() | F.col("_doc").isNull(), F.col("_text"))))
        recipes = stored(marked.select("_doc", "_recipe", "text_sha256", "_tie"), "recipes")
    return _verdicts(recipes, id_col)


def _verdicts(recipes: DataFrame, id_col: str) -> DataFrame:
    """Groups are stored, so the join reads two plain shuffles and Spark can split the partition of a hot group."""
    groups = recipes.groupBy("_recipe", "_tie").agg(F.min("_doc").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.withColumnsRenamed({"_recipe": "_r", "_tie": "_t"}), "groups")
    same = (F.col("_recipe") == F.col("_r")) & F.col("_tie").eqNullSafe(F.col("_t"))
    return recipes.join(groups, same).select(F.col("_doc").alias(id_col), "keep_id", "group_size", F.col("_doc").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


@tidied
def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, the one with the smallest id; all columns stay, whatever they are called.

    An id that occurs once is joined by itself.  Rows that share an id (or have none) are told apart by their text; of those
    that repeat an id and a text, the first by a digest of the whole row stays.
    """
    found = exact_groups(docs, id_col, text).select(F.col(id_col).alias("kept_id"), "kept", F.col("text_sha256").alias("sha"))
    verdicts = stored(found, "verdicts")
    ids = verdicts.groupBy("kept_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any")).where("any").drop("any")
    ids = stored(ids, "kept-ids")
    rows = whole_rows(docs, id=F.col(id_col), sha=F.lit(None).cast("string")).join(ids, F.col("id").eqNullSafe(F.col("kept_id")))
    once = rows.where("n = 1").select("row.*")
    if ids.where("n > 1").isEmpty():
        return once
    shared = first_rows(rows.where("n > 1").withColumn("sha", F.sha2(collapse_spaces(F.col(f"row.{text}")), 256)), ["kept_id", "sha"])
    pairs = stored(verdicts.where("kept").select(F.col("kept_id").alias("other"), F.col("sha").alias("other_sha")).distinct(), "kept-pairs")
    kept = shared.join(pairs, F.col("kept_id").eqNullSafe(F.col("other")) & (F.col("sha") == F.col("other_sha")), "left_semi")
    return once.unionByName(kept.select("row.*"))


OP5_SQL = """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""


@llm_query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
