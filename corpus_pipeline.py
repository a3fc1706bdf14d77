"""From raw documents to token ids: quality, exact copies, near copies, benchmark leaks, BPE.

Each stage works on all rows that the stage before it kept, and its decisions take effect. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm.bpe import encode_texts
from brightloom.llm.common import discard, prepare, scratch, stored
from brightloom.llm.decontaminate import drop_contaminated
from brightloom.llm.exact_dedup import drop_copies
from brightloom.llm.jaccard import drop_similar
from brightloom.llm.quality import keep_good
from brightloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    prepare(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    prepare(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one with the smallest doc_id stays."""
    prepare(spark)
    return drop_similar(docs, k=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go."""
    return drop_contaminated(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and the texts that they decode to."""
    prepare(spark)
    return encode_texts(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: The classifier, the components and the encoding aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables go when it is written, its result when the next one is."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for i, (name, stage) in enumerate(first):
        with scratch() as keep:
            after = keep(stored(stage(spark, docs, sf_dir), name))
        if i:
            discard(docs)
        docs = after
    return last(spark, docs, sf_dir)
