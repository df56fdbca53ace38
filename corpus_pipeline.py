"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, line_dedup, near_dup, packing, toxicity
from colloquy.llm.queries import table, tokenizer_path
from colloquy.llm.sampling import fold
from colloquy.llm.storage import scratch, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the model learns from two thirds of the labels.

    Each row stands for itself: repeated ids and texts all stay or all go, rows
    with a null id are scored like others, and a null or empty text scores what
    the model says of no words.  Empty tables give empty ones.
    """
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.filter("predicted = 0").select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that it shares with two others or more; n_chars follows the text.

    The largest doc_id keeps a shared line.  Null texts and rows with a null id
    stay as they are (n_chars of a null text is null); rows that share an id
    count as one document.  A text that loses all its lines is empty, not gone.
    """
    rest = line_dedup.dedup_lines(docs)
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id.

    Ties can't be: ids decide.  Rows that share an id are one document and stay
    or go together; null and empty texts are alike to nothing and stay, as do
    rows with a null id.
    """
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is searched whole and stands for itself; null and empty texts stay,
    as do rows with a null id unless their text holds an item.  Without a
    benchmark all rows stay.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, a row for each piece.

    A null or empty text is the end id alone.  Every row is a document of its
    own, also if it shares its id or text with others or has no id.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each stage's rows are written as Parquet and read again."""
    rows = table(spark, sf_dir, "documents")
    held = None
    for name, function in STAGES:
        with scratch() as keep:
            written = keep(stage(function(spark, rows, sf_dir), f"pipeline-{name}"))
        if held:
            held.drop()
        rows, held = written.df, written
    return rows


#: Trained models, connected classes and token ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None
