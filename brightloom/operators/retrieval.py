"""Chunks of documents, cosine search and conversation context.

Defined results: null and empty texts have no chunks, and null texts share no digest (they are one group, without a digest). A null html
gives null. Cosine search is defined in `nearest`. Null roles and texts of turns count as empty; turns that repeat are lines of their own, in the order of role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import best
from .ranking import free


def chunks(df: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """(key, chunk_no, chunk): overlapping slices of whole texts; an empty text has none."""
    starts = F.sequence(F.lit(1), F.length(text), F.lit(step))
    at, n = free(df, "_at"), free(df, "_n")
    places = df.where(F.length(text) > 0).select(key, text, F.posexplode(starts).alias(n, at))
    return places.select(key, F.col(n).alias("chunk_no"), F.substring(F.col(text), F.col(at), F.lit(size)).alias("chunk"))


def dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, key, n): one row for each text, with its smallest key."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("n"))


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags, white space folded."""
    out = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "(?s)<[^>]*>", " "), "\\s+", " "))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rn): a stated query set (q, qv) against all rows (id, v) but the one with its own id."""
    return best(vectors.select("id", F.col("v").alias("x")), queries.select("q", F.col("qv").alias("x")), k, "score", cosine=True)


def context(turns: DataFrame, last: int = 3) -> DataFrame:
    """(conv_id, turn, context): this turn and those before it, as role: text lines. The frame bounds what a row gathers."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-(last - 1), 0)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(line).over(w), "\n").alias("context"))
