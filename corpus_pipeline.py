"""A training corpus from the documents table: language ID, exact dedup, near-duplicate removal, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, langid, mixing, sp_codec
from tidemark.llm.common import Scratch, fresh, scratch_space
from tidemark.llm.queries import MIX_WEIGHTS, mix_levels, model_path

#: Tokens that the mixture takes, in percent of those that the stages before it kept.
BUDGET = 90


def _only(docs: DataFrame, wanted: DataFrame, *keys: Column) -> DataFrame:
    """Rows of ``docs`` whose keys are among the rows of ``wanted``; null equals null. The small side is hashed, the texts aren't sorted."""
    names = [fresh(f"key{i}", docs) for i in range(len(keys))]
    named = wanted.toDF(*names).distinct().hint("shuffle_hash")
    return docs.join(named, [column.eqNullSafe(F.col(n)) for n, column in zip(names, keys, strict=True)], "left_semi")


def _once(docs: DataFrame, key: Column) -> DataFrame:
    """One of the rows that repeat identifier and ``key``."""
    name = fresh("key", docs)
    return docs.withColumn(name, key).dropDuplicates(["doc_id", name]).drop(name)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter. Those without, and null texts, go; ``und`` alone rejects nothing, as it is given to every text when no language was learned.

    Null identifiers and languages, repeated rows and texts of any length pass through, with all columns whatever their
    names; an empty table gives an empty one.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that the operator's result doesn't have
    found = langid.identify(docs.toDF(*own.values()), own["doc_id"], own["text"], own["lang"], carry=tuple(own.values()))
    letter = F.when(F.col("lang_pred") != "und", True).otherwise(F.col(own["text"]).rlike(r"\p{L}"))
    return found.where(letter).select(*(F.col(n).alias(c) for c, n in own.items()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of least identifier; of rows that repeat identifier and text one stays.

    A null text counts as empty, a null identifier as greater than all; an empty table gives an empty one. Other columns
    pass through, whatever their names.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    scratch = Scratch(spark, "drop_copies")
    kept = scratch.put(exact_dedup.exact_dedup(docs).where("kept").select("doc_id", "text_sha256"))
    out = _only(docs, kept, F.col("doc_id"), digest)
    return out if kept.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty() else _once(out, digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least identifier, then of least digest; a null identifier comes last.

    Identifiers may repeat or be null: a row is known by identifier and digest. Of rows that repeat both one stays. A
    text without a word has no near copies. An empty table gives an empty one; other columns pass through, whatever
    their names.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    scratch = Scratch(spark, "drop_near_copies")
    rows = scratch.put(jaccard.jaccard_rows(docs, digest).select("doc_id", "key", "label"))
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("x"))
    kept = scratch.put(first.select("x.doc_id", "x.key").union(rows.where("label is null").select("doc_id", "key")))
    out = _only(docs, kept, F.col("doc_id"), digest)
    return out if rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty() else _once(out, digest)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, whole, once each.

    A null language or source is a node of the tree, a null identifier one identifier; rows that repeat an identifier
    stay or go together. Documents without a word go. An empty table gives an empty one; other columns pass through.
    """
    taken = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, BUDGET, 1)
    return _only(docs, taken.select("doc_id"), F.col("doc_id"))


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: ``doc_id, n_tokens, ids``. None for a null or empty text; null identifiers and repeated rows pass through."""
    return sp_codec.encode(docs, model_path())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_text),
]

#: The last stage is a tokenizer, which SQL can't express; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch_space():
            docs = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs
