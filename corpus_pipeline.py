"""The corpus pipeline: quality, language, near duplicates, mixing, packing. Part of the llm subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import jaccard, langid, mixing, packing, quality
from stepwell.llm.common import Workspace, keep_rows, table

#: A document's language must be at least this sure.
MIN_LANG_SCORE = 0.5

#: DuckDB cannot express fitted models and the local search of the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are content by at least half; the rest goes.

    Each row is judged by its own text, so repeated rows and rows that share an id stay or go alike, whatever their id,
    null or not. A null, empty or short text fails the base rules. Columns stay as they are; an empty table stays empty.
    """
    field = quality.fit_lines(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, lambda texts: [quality.passes(t, field) for t in texts])


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language with a mean probability of at least one half; the rest goes.

    Each row is judged by its own text; repeated rows stay or go alike, null ids play no part. A null text, one without a
    letter, and any text of a table without a labelled language go. An empty table stays empty.
    """
    net = langid.fit_language(docs)
    return keep_rows(docs, lambda texts: [lang != langid.UNKNOWN and score >= MIN_LANG_SCORE for lang, score in net.predict(texts)])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: with the least doc_id, null where all are, and of those with one text.

    A row is named by its doc_id and text, so rows with null or repeated doc_ids are thinned like others, and rows that
    share a doc_id but not a class each stay. Repeated rows of what is kept go, also those without words.
    """
    space = Workspace(spark, "jaccard")
    key = {"_null": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    kept = jaccard.representatives(docs, space).select(*(c.alias(k) for k, c in key.items()), F.col("text_id").alias("_text"))
    kept = Workspace(spark, "kept").save(kept, "kept")
    space.clear()  # only the kept rows' names are needed from here on
    rows = docs.select(*(c.alias(k) for k, c in key.items()), jaccard.text_id().alias("_text"), F.struct(*docs.columns).alias("_row"))
    # plain equality of the same columns lets the removal of repeated rows use the join's partitioning: the texts are dealt once
    names = ["_null", "_id", "_text"]
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice.

    A null source is a source, the last one; a text without words comes as often as its source is taken whole. Repeated
    rows count each, and of equal ones any may be the repeated one. An empty table stays empty.
    """
    return mixing.mix_rows(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    Every row is packed, also repeated rows and those with a null id; a null text is an empty one, of the end id alone.
    An empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    space, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
