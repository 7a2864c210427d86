"""A pipeline from raw documents to token counts: STAGES, each written as Parquet and read again as the next one's input.

Language identification drops what it rejects, the n-gram Jaccard join keeps one document of each group of near
copies, substring deduplication cuts repeated passages out of the texts, decontamination drops documents with passages
of the benchmark, and BPE encodes what is left.

Defined results: null and empty texts, and those without a letter, have no language and go in the first stage; ties of
languages go to the first in the alphabet; of documents with equal texts the one with the least doc_id stays, rows that
share a doc_id and a text stay together, as does a null doc_id; extra columns are kept up to the last stage, whatever
they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.cluster import ship
from provenir.llm import bpe, decontaminate, langid, ngramjoin, substrings
from provenir.llm.common import shared_path, table, unused
from provenir.llm.queries import vocabulary_path


#: A passage of over 50 words has at least about so many bytes.
PASSAGE = 240


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    ship(spark)
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    said, score = unused(docs, "said", "score")
    out = langid.predict(docs, langid.train(docs.where(~held_out)), into=said, score_into=score)
    return out.where(F.col(said) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles the one with the least id stays."""
    ship(spark)
    return ngramjoin.deduplicated(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte of strings of PASSAGE bytes that occur elsewhere; n_chars follows."""
    ship(spark)
    done = substrings.deduplicated(docs, PASSAGE)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids that BPE encoding gives, and of the text decoded from them."""
    ship(spark)
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
