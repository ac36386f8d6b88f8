"""From raw documents to packed sequences: five stages, each a table that the next one reads.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. In every
stage a null text counts as empty, repeated rows are rows like others, further columns of docs are kept, and an empty
table gives an empty table. sf_dir is not read by any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.llm import lines, minhash, mixing, packing, quality
from ratlas.llm.common import Scratch
from ratlas.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go, null and empty texts among them; a text just at a limit stays."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest doc_id that holds them; rows without doc_id are no holders and
    lose them. n_chars follows the text."""
    out = lines.dedup_lines(docs, counts=("__lines", "__dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest doc_id stays, with all its rows; rows
    without doc_id or without words stay."""
    return minhash.drop_near_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated, left out, or cut at the end of a source's budget. A null
    source is one of its own; sources that weigh the same at the same cap stand by name; texts without words never come."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 token ids; equal sizes stand by doc_id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: SQL can express neither the tokenizer nor the order of hashed groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's table lies in the shared folder until the next one's does."""
    scratch, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
