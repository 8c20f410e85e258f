"""Exact deduplication that no group of copies can overload, built from DataFrame operations only.

Copies meet in three steps, and each compares whole texts, because the text itself is part of the grouping key:

1. each map task merges the copies it reads (the partial side of the aggregation);
2. copies of one digest meet in ``salts`` groups, so a text that holds a third of all rows is spread;
3. at most ``salts`` rows for a text meet for the final winner.

Documents then fetch their winner over the same salted keys, so the way back is as even as the way there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm.workspace import column, row_hash

SALTS = 32


def _keyed(docs: DataFrame, id_col: str, text: Column, salts: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("_text"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.xxhash64(text).alias("_alt"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("_salt"),
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after ``normalise`` (a Column function; by default no change); null counts as empty.
    Of equal texts the row with the largest id stays; a null id is smaller than any other. Rows that repeat both id and
    text are one document under one id and carry the same flag. If all ids of a group are null, ``keep_id`` is null and
    each row is flagged as kept. Other columns are ignored; an empty table gives an empty table.

    The winners are found on whole texts. A document looks its winner up by 256 + 64 bits of digest, not by its text again:
    two texts that share the SHA-256 and the other hash as well would show as two winners of one key, and no two texts of
    one SHA-256 are known. The rows of one key on the way back are those of one text and salt; where a text has so many
    copies that they outgrow a task, Spark's own handling of skewed joins cuts them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = _keyed(docs, id_col, normalise(text) if normalise else text, salts)
    salted = keyed.groupBy("_sha", "_alt", "_salt", "_text").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_sha", "_alt", "_text").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_set("_salt").alias("_salts"))
    found = winners.select("_sha", "_alt", "keep_id", "group_size", F.explode("_salts").alias("_salt"))
    return (
        keyed.drop("_text")
        .join(found, ["_sha", "_alt", "_salt"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, whole rows with their columns and exactly one per text.

    Null counts as empty. The row with the largest id stays, null ids before none; of rows that tie on it, the one with the
    largest hash of all its columns. Columns of any names and types pass through; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.struct(F.col(id_col).alias("id"), row_hash(docs).alias("tie"))
    rest = [c for c in docs.columns if c != text_col]
    # The text is part of the key, so what is carried beside it is the rest of the row.
    carried = F.struct(F.col(text_col).isNotNull().alias("known"), F.struct(F.lit(0).alias("_"), *[column(c).alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest"))
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("digest"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"), rank.alias("rank"), carried.alias("row"))
    best = [F.max("rank").alias("rank"), F.max_by("row", "rank").alias("row")]
    winners = keyed.groupBy("digest", "salt", "text").agg(*best).groupBy("digest", "text").agg(*best)
    at = {c: k for k, c in enumerate(rest)}
    return winners.select(*[F.when(F.col("row.known"), F.col("text")).alias(c) if c == text_col else F.col(f"row.rest.c{at[c]}").alias(c) for c in docs.columns])
