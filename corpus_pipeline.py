"""A training-corpus pipeline: language, near duplicates, secrets, mixture, token ids.

Each stage is a function (spark, docs, sf_dir) that works on all rows its predecessor kept.  ``run`` writes every stage's
result to the shared folder and reads it back, so a lost executor costs at most one stage.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm import language_id, mixing, ngram_jaccard, secrets, sentencepieces
from airlake.llm.common import DOC_COLUMNS, publish, table
from airlake.llm.registry import reachable

#: A prediction under this is no language: both machines are at a loss.
SURE = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, so that others can't clash."""
    return docs.select(*DOC_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is in a language.

    Learns from the labelled documents that aren't held out.  Null texts, texts without letters and texts that the
    machines are at a loss with go; a null or wrong label does not matter.
    """
    docs = _columns(docs)
    model = language_id.learn(docs.where(~language_id.held_out()))
    told = language_id.identify(docs, model, keep=tuple(DOC_COLUMNS))
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*DOC_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of 0.8 on five-word shingles hold together: that of the smallest id.

    Documents without words link with nothing and stay.  Of repeated rows with the smallest id one stays; documents without an id
    stay only in groups where none has one.
    """
    docs = _columns(docs)
    found = ngram_jaccard.near_duplicates(docs, 5, 80)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    chosen = found.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("id"), F.min_by("node", order).alias("chosen"))
    # one document of each group: a node, which no other group has, and an id
    chosen = publish(chosen.select("id", "chosen"), "pipeline-chosen", clean=True)
    placed = ngram_jaccard.document_nodes(docs, 5, "doc_id", "text", keep=("text", "lang", "source", "n_chars"), first=True)
    kept = placed.where("n_shingles > 0").join(chosen, F.col("node") == F.col("chosen")).where(F.col("doc_id").eqNullSafe(F.col("id")))
    return kept.dropDuplicates(["node"]).select(*DOC_COLUMNS).unionByName(placed.where("n_shingles = 0").select(*DOC_COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; all documents stay, and n_chars follows the text."""
    docs = _columns(docs)
    told = secrets.scan(docs, secrets.calibrate(docs), keep=tuple(DOC_COLUMNS))
    text = F.when(F.col("spans") == "", F.col("text")).otherwise(F.col("redacted"))
    return told.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of 150 % of all words takes it: not at all, once or twice.

    Texts of any length are documents like others; of rows with one id and text those of the first source, language and n_chars are taken first.
    """
    docs = _columns(docs)
    mixed = mixing.mix(docs, weights=mixing.quality_weights(spark, sf_dir))
    # equal rows share what the mix takes of them
    mixed = mixed.groupBy(F.col("doc_id").alias("t_id"), F.col("mark").alias("t_mark")).agg(F.sum("epochs").alias("epochs"), F.count("*").alias("many"))
    taken = publish(mixed.where("epochs > 0"), "pipeline-taken", clean=True)
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark"))
    marked = docs.withColumn("mark", mixing.mark())
    once = marked.join(taken.where("many = 1"), same).withColumn("times", F.col("epochs"))
    # only texts of repeated rows are put in order
    nth = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("source", "lang", "n_chars"))
    several = marked.join(taken.where("many > 1"), same).withColumn("nth", nth)
    several = several.withColumn("times", F.floor(F.col("epochs") / F.col("many")) + (F.col("nth") <= F.col("epochs") % F.col("many")).cast("long"))
    columns = [*DOC_COLUMNS, F.col("times").cast("int").alias("times")]
    rows = once.select(*columns).unionByName(several.select(*columns)).where("times > 0")
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*DOC_COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document under merge-dropout, and the digest of the text that they decode to.

    Null texts count as empty; texts of any length are encoded whole, a slice of words at a time.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.round_trip(_columns(docs), model, keep=("doc_id", "source", "lang"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Machines, randomness tests and merge agendas have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    reachable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = publish(docs, f"pipeline-{name}", clean=True)
    return docs
