"""From raw documents to packed bins: five stages, each written to the shared folder before the next one reads it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.llm import exact_dedup, minhash, mixing, packing, toxicity
from cuecorpus.llm.queries import held_out
from cuecorpus.llm.workspace import as_row, column, staged, table

#: Bytes of text in a part of the mix, about.
PART_BYTES = 128_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it is fitted on labelled rows of these documents."""
    s = toxicity.Settings()
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out()), s)
    rows = docs.select(as_row(docs).alias("row"), "text")
    return toxicity.score_documents(rows, model, s).where(F.col("_score") < s.threshold).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[column(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them, written in the order in which it reads them.

    The order is that of the files and of the rows in a file: each part holds what is read within an equal share of all
    sources' budgets.
    """
    mixed = mixing.mix_sources(docs, packing.word_count(F.col("text")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # What is read is about as much text as there is, as the budget is all tokens.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    by_turn = mixed.repartitionById(parts, F.least(F.floor(F.col("_at") * parts), F.lit(parts - 1)).cast("int"))
    return by_turn.sortWithinPartitions("_at", "_epoch", "doc_id").select(*[column(c) for c in docs.columns])


def _reading_shards(docs: DataFrame, narrow: list) -> DataFrame | None:
    """The ``narrow`` columns of ``docs`` with ``_shard``: packing shards of neighbours in the order of files and rows; none if
    ``docs`` isn't read from files."""
    try:
        read = docs.select(*narrow, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None
    rows = docs.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).groupBy("_file").agg(F.ceil((F.max("_row") + 1) / packing.SHARD_ROWS).alias("_shards"))
    # One row for each file that the stage before wrote.
    first = rows.select("_file", (F.sum("_shards").over(W.orderBy("_file")) - F.col("_shards")).alias("_first"))
    return read.join(first, "_file").withColumn("_shard", F.col("_first") + F.floor(F.col("_row") / packing.SHARD_ROWS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; a document that is read twice never meets itself in a bin.

    Documents are packed with their neighbours in the mix's order, so the numbers of bins follow that order.
    """
    # Words are counted before the join with the files, so that no text takes part in it.
    narrow = ["doc_id", "source", packing.word_count(F.col("text")).alias("words")]
    ordered = _reading_shards(docs, narrow)
    if ordered is None:
        rows, shard = docs.select(*narrow), None
    else:
        rows, shard = ordered.select("doc_id", "source", "words", "_shard"), F.col("_shard")
    return packing.pack(rows, F.col("words"), F.col("source"), F.col("doc_id"), shard=shard).drop("words", "_shard")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitting and similarity have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict = {"pipeline": ORACLE_SQL}
