"""A corpus from raw documents to packed sequences, in five stages of the operators in lamella.llm.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns as
Parquet and reads it again as the next one's documents. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontam, lines, neardup, packing, toxicity
from lamella.llm.queries import tokenizer_path
from lamella.session import cut, ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below 0.5; it learns from the labelled rows outside the held-out fifth.

    Null and empty texts have no match and stay. Rows without an id are judged
    like all others, and repeated rows stay or go together. An empty table stays
    empty, all columns stay, and without labels the grammar's own weights judge.
    """
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that repeat an earlier one; n_chars follows the text.

    A text whose lines have all gone is empty; null texts stay null, with a null
    n_chars. Rows without an id are left as they are, and rows that repeat id
    and text lose the same lines. An empty table stays empty; all columns stay.
    """
    ship(spark)
    out = lines.drop_lines(docs, cut(lines.duplicate_lines(docs)))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; similarity 0.8, five words.

    Null, empty and wordless texts are in no group and stay. Rows that repeat an
    id with other texts are judged by their texts; rows that repeat both stay or
    go together. An empty table stays empty, and all columns stay.
    """
    ship(spark)
    return neardup.keep_first(docs, percent=80).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null, empty and wordless texts stay, whatever their ids; repeated rows stay
    or go together. An empty table stays empty, and all columns stay.
    """
    ship(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.

    A null or empty text is the one token that ends a document. Repeated rows
    and rows without an id are packed each for itself. An empty table gives no
    piece.
    """
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the model nor tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
