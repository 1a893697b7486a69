"""Corpus pipeline: documents to token ids in five stages, each written as Parquet and read again.

Stage functions take (spark, docs, sf_dir). Each but the last returns the columns of documents; what a stage removes or cuts is gone for
the next. n_chars follows the text where a stage changes it.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearmiss.llm.bpe import encode_decode
from nearmiss.llm.decontaminate import decontaminate
from nearmiss.llm.jaccard import drop_near_duplicates
from nearmiss.llm.linededup import dedup_lines
from nearmiss.llm.queries import table, tokenizer_path
from nearmiss.llm.toxicity import fit, score
from nearmiss.session import durable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled ones among docs."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).filter("predicted = 0").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more of them share, except in the last one."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, 32 bits each), their number, and the text that they decode to."""
    coded = encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe", bpe)]

#: The classifier and the tokenizer have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
