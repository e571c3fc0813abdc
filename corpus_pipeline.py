"""A corpus from raw documents to packed token sequences: five of the training-data operators, one after another.

Each stage is written as Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``; extra columns, whatever their names, go in the first stage. An empty table gives no row in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from pagewright.llm.common import document_columns, freeze


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep.

    Null, empty and very short texts go; rows with a null or repeated doc_id, and equal rows, are judged each by itself; ties stay. A very long
    text is counted whole. Of an empty table nothing is estimated and nothing is left.
    """
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without runs of 50 words or more that stand earlier in the corpus; a text that stands earlier whole is left empty.

    Repeated rows are one document and lose the same lines; null doc_ids come first; null texts stay null; a very long text is one row,
    in time near linear in its lines.
    """
    return document_columns(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates: least doc_id, then least hash of the text; null ids come last.

    Null, empty and wordless texts are one group. Of repeated rows one stays. A very long text is fingerprinted whole.
    """
    return simhash.one_of_each(document_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; exactly 0.8 of its shingles count as held. Without items all stay.

    Null and empty texts hold none and stay; rows with a null or repeated doc_id are judged each by itself, and equal rows alike; a very long text
    is searched whole.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids; a null or empty text is one sequence of the end id. An empty table gives no row.

    Rows with a null or repeated doc_id, and equal rows, are documents of their own; a very long text is cut into sequences like any other.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Tokenizing and the 64-bit hash of the fingerprints have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what comes between two of them is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
