"""A corpus pipeline: quality, repeated lines, near copies, benchmark passages, SentencePiece ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. run() applies them all to the
table documents and removes what lies between. In all stages a null text is empty and a document is its doc_id and its text:
rows that share an id are judged each by its own text, rows without an id are kept or dropped like others, exact repeats are
one document (near_dedup keeps one row of them); ties go to the smaller id; an empty table gives an empty result. No stage's rows can be said in SQL (trees, fingerprints, tilings, a tokenizer), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm.common import Held, stored
from pixelloom.llm.decontam import clean_documents
from pixelloom.llm.linededup import dedup_lines
from pixelloom.llm.quality import accepted
from pixelloom.llm.queries import tokenizer_path
from pixelloom.llm.simhash import one_per_group
from pixelloom.llm.spiece import encoded

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3 stay."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that at least ten documents hold, the first in the corpus stays."""
    return dedup_lines(docs, min_docs=10, min_chars=1, keep_first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash pairs, counted, and what their search can't reach by prefixes."""
    return one_per_group(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 and round_trip."""
    return encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, between = spark.read.parquet(f"{sf_dir}/documents.parquet"), Held(spark)
    for name, stage in STAGES[:-1]:
        docs = between.stored(stage(spark, docs, sf_dir), name)
    found = stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    between.close()
    return found
