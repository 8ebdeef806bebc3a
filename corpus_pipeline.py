"""A training corpus from ``documents``: five stages, each written and read again before the next.

Every stage takes the columns of ``documents`` (others, whatever their names, don't take part), whole texts of any length, and gives an
empty table for an empty one. What it does with nulls, empty texts and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import para_minhash, quality_mcd, secret_random, sigtree_join, vector_pack
from vectorloom.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The contract of near-duplicate stages: five words, similarity 0.8 or more.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; a null id, language or source is no reason to go; repeated rows get the same verdict.
    """
    return quality_mcd.judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked documents.

    Null and empty texts link with nothing and stay, as do rows without an id; rows that repeat an id are each judged by their own text, so an
    exact repeat stays beside the first.
    """
    return sigtree_join.keep_one(docs.select(COLUMNS), words=WORDS, percent=PERCENT)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without paragraphs, and without runs of 50 words, that an earlier one holds; those of which nothing is left go.

    Null and empty texts lose nothing and stay, as do rows without an id; rows that repeat an id are one document, which loses nothing to itself.
    """
    lines = cut(para_minhash.dedup(docs.select(COLUMNS), words=WORDS, percent=PERCENT), "lines")
    return _counted(para_minhash.dedup_runs(lines))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark.

    No row goes: null text stays null, an empty one empty; repeated rows are scanned each.
    """
    return _counted(secret_random.redact(docs.select(COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null and empty texts are one token, the end mark; repeated rows, and rows without an id, are packed each.
    """
    import public_tokenizers

    return vector_pack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("secret scans", secrets),
    ("packing", packing),
]

#: SQL can't express the robust estimates; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
