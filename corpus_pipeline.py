"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases, for all stages: an empty table gives an empty one; columns besides doc_id, text, source (and the labels' doc_id and quality) are carried along by all but the last, whatever
their names; a very long text is read whole; a repeated row is a row of its own, which a stage may keep or drop like any other; results don't hang on the order of rows, ties being broken by ids or hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import linededup, mixing, packing, quality, simhash
from pulsegrid.llm.common import drop, scratch, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null text counts as empty and is scored; null ids and labels teach nothing; without labels of both kinds all scores are 0.5."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has. A null or empty text is one empty line and stays; rows of one doc_id are one document, those without an id are one, the last."""
    return linededup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least doc_id, of equal ids that of the smaller hash. Texts without words are copies of each other; texts under five words are one shingle."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null sources are one source, the last; documents without words are never taken."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null or empty text is one piece, the end token; null and repeated ids are packed as documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Tokenising, model fitting and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as keep:  # what a stage wrote on its way goes when its result stands
            docs = keep(written(stage(spark, before, sf_dir), name.split()[0].lower()))
        drop(before)
    return docs
