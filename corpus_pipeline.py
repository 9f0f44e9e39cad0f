"""A corpus pipeline: stages over ``documents``, each written as Parquet and read again.

All stages but the last return the columns of ``documents``. Each works on all that the one before it
kept, and what it decides takes effect: rejected documents go, one document of each class of near
copies stays, repeated passages leave the texts, sources are mixed to their targets (a document may
then come twice), and what is left is packed into token sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import crc_text, dropped, read, settled
from weftline.llm.jaccard_join import jaccard_classes
from weftline.llm.mixing import mixed_documents
from weftline.llm.packing import pack_documents
from weftline.llm.quality import fit_quality, score_quality
from weftline.llm.substring_dedup import remove_repeats


_USED = ("doc_id", "text", "source", "n_chars")


def _apart(stage: Callable) -> Callable:
    """A stage that sees the columns it does not use under names that no operator adds, so that they come out
    as they went in, whatever they are called."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c.lower() in _USED else f"column{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return run_stage


@_apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from the labelled ones that the query of
    the classifier learns from, too. Null and empty texts are scored as texts without words; repeated rows are judged
    each, and alike; a score at the threshold is accepted. An empty table gives no rows."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"), crc_text("doc_id") % 5 != 0)
    return score_quality(docs, model).where("_predicted = 1").select(*docs.columns)


@_apart
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest key. Of rows that repeat a key
    one stays; documents without a key all stay."""
    rows = jaccard_classes(docs).where("_component = doc_id or doc_id is null")
    first = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.hash("text"))).orderBy("text"))
    return rows.withColumn("_n", first).where("_n = 1 or doc_id is null").select(*docs.columns)


@_apart
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that stand earlier, too; null texts stay null. Documents of
    which nothing is left stay, with an empty text."""
    rows = remove_repeats(docs)
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    rows = rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's target asks for. A null text counts no words; a null source is one
    source, the last; rows that repeat a key are drawn each, ties in the order going by hash and key. An empty table gives no rows."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null text is an empty document, one token; rows that repeat a key are packed each, and
    a null key stays null; equally long pieces are packed in the order of a hash. An empty table gives no rows."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]
#: A learned classifier and token ids are nothing that SQL expresses; tests compare each stage, on the rows that the one
#: before kept, with brute force, and check that no labelled good document goes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's own tables are deleted when it ends, its result when the next one does."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir))  # noqa: B023
        dropped(before)
    return docs
