"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's n-grams are of ``ORDER`` bytes. Documents are dealt into blocks by hash of their id, packed and compressed by
the tasks that read them. A block counts the n-grams of its trusted texts; counts are summed over the corpus, and continuation counts, discounts and context sums of
all orders follow from them by aggregation. The distinct n-grams of the corpus get their probabilities by joins with
these tables, sharded by n-gram; each block is sent those of its own n-grams and scores its documents with them. Limits
are quantiles of the trusted documents' perplexity in each language.

What is joined grows with the distinct n-grams of blocks, not with the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm.words import batches_of
from cuecorpus.llm.workspace import staged

ORDER = 5
#: Part of a language's trusted documents whose perplexity is within the limit.
QUANTILE = 0.98
#: Bytes of text in a block, about.
BLOCK_BYTES = 16_000_000
#: Bytes that a task reads before it packs them.
PACK_BYTES = 32_000_000


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, packed into an integer, and the number of them in each text. Before a text's
    start stand zero bytes."""
    pad = b"\0" * (order - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    sizes = np.asarray([len(t) for t in texts], np.int64)
    packed = np.zeros(max(0, len(data) - order + 1), np.int64)
    for k in range(order):
        packed = (packed << 8) | data[k : len(data) - order + 1 + k]
    starts = np.cumsum(sizes + order - 1) - sizes - order + 1
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return packed[at], sizes


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``block``, ``doc_id``, ``lang``, ``text``) as one compressed row for each block and ``PACK_BYTES`` read."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            blocks = np.asarray(rows["block"], np.int64)
            order = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sink = pa.BufferOutputStream()
                own = rows.take(pa.array(order[lo:hi])).drop_columns(["block"]).combine_chunks()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_table(own)
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(blocks[order[lo]])]), pa.array([blob], pa.binary())], names=["block", "blob"])
        held.clear()

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _unpack(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for blob in blobs:
        yield pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_py())).read_all()


def _learn(blobs: pa.Table, trusted: pa.Table) -> pa.Table:
    """The distinct n-grams of a block, with how often its trusted texts have them."""
    known = np.asarray(trusted["doc_id"], np.int64)
    block = blobs["block"][0].as_py() if blobs.num_rows else 0
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows in _unpack(blobs["blob"]):
        texts = rows["text"].to_pylist()
        ids = rows["doc_id"].combine_chunks()
        good = np.isin(np.asarray(ids.fill_null(0), np.int64), known) & np.asarray(ids.is_valid())
        for lo, hi in batches_of(texts):
            own, sizes = grams_of(texts[lo:hi])
            found, inverse = np.unique(own, return_inverse=True)
            n = np.bincount(inverse, weights=np.repeat(good[lo:hi], sizes), minlength=len(found)).astype(np.int64)
            both = np.union1d(grams, found)
            total = np.zeros(len(both), np.int64)
            total[np.searchsorted(both, grams)] += counts
            total[np.searchsorted(both, found)] += n
            grams, counts = both, total
    return pa.table({"block": pa.array(np.full(len(grams), block)), "g": pa.array(grams), "c": pa.array(counts)})


def _last(g: Column, k: int) -> Column:
    return g.bitwiseAND(F.lit(2 ** (8 * k) - 1))


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the number of n-grams that occur once to four times; what cannot be estimated is 0.5, 1, 1.5."""
    d = [0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in range(3):
            if n[k] and n[k + 1]:
                d[k] = min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0)
    return d


def kneser_ney(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """``g`` and ``logp``, the log-probability of an n-gram's last byte after the others, for each row of ``asked`` (``g``).

    ``counts`` holds the trusted n-grams (``g``, ``c``). Lower orders use continuation counts; below them all bytes are
    alike. A context that was never seen leaves the matter to the next lower order.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(_last(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    seen = None
    for k, t in tables.items():
        part = t.select(F.lit(k).alias("k"), "c")
        seen = part if seen is None else seen.unionByName(part)
    once = lambda n: F.sum(F.when(F.col("c") == n, 1).otherwise(0)).alias(f"n{n}")
    found = {r["k"]: r for r in seen.groupBy("k").agg(F.sum("c").alias("all"), *[once(n) for n in (1, 2, 3, 4)], F.sum(F.when(F.col("c") > 2, 1).otherwise(0)).alias("more")).collect()}
    rows = asked.select("g", F.lit(1 / 256).alias("p"))
    if not found:
        return rows.select("g", F.log("p").alias("logp"))
    for k in range(1, order + 1):
        d = discounts([found[k][f"n{n}"] for n in (1, 2, 3, 4)])
        own = tables[k].select(F.col("g").alias("_own"), F.col("c").alias("_c"))
        own = F.broadcast(own) if k <= 2 else own  # at most 256**k rows
        rows = rows.join(own, _last(F.col("g"), k) == F.col("_own"), "left")
        if k == 1:
            r = found[1]
            rows = rows.withColumns({"_all": F.lit(r["all"]), "_n1": F.lit(r["n1"]), "_n2": F.lit(r["n2"]), "_n3": F.lit(r["more"])})
        else:
            once_in = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
            context = tables[k].groupBy(F.shiftright("g", 8).alias("_h")).agg(F.sum("c").alias("_all"), once_in(F.col("c") == 1).alias("_n1"), once_in(F.col("c") == 2).alias("_n2"), once_in(F.col("c") > 2).alias("_n3"))
            context = F.broadcast(context) if k <= 2 else context
            rows = rows.join(context, F.shiftright(_last(F.col("g"), k), 8) == F.col("_h"), "left")
        cut = F.when(F.col("_c") == 1, d[0]).when(F.col("_c") == 2, d[1]).otherwise(d[2])
        direct = F.when(F.col("_c").isNotNull(), F.greatest(F.col("_c") - cut, F.lit(0.0)) / F.col("_all")).otherwise(0.0)
        rest = (d[0] * F.col("_n1") + d[1] * F.col("_n2") + d[2] * F.col("_n3")) / F.col("_all")
        rows = rows.select("g", F.when(F.col("_all").isNull(), F.col("p")).otherwise(direct + rest * F.col("p")).alias("p"))
    return rows.select("g", F.log("p").alias("logp"))


def _score(blobs: pa.Table, table: pa.Table) -> pa.Table:
    grams, logs = np.asarray(table["g"], np.int64), np.asarray(table["logp"], np.float64)
    order = np.argsort(grams)
    grams, logs = grams[order], logs[order]
    ids, langs, found = [], [], []
    for rows in _unpack(blobs["blob"]):
        texts = rows["text"].to_pylist()
        out = np.ones(len(texts))
        for lo, hi in batches_of(texts):
            own, sizes = grams_of(texts[lo:hi])
            sums = np.concatenate(([0.0], np.cumsum(logs[np.searchsorted(grams, own)] if len(own) else own)))
            ends = np.cumsum(sizes)
            out[lo:hi] = np.exp(-(sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1))
        ids += rows["doc_id"].to_pylist()
        langs += rows["lang"].to_pylist()
        found.append(out)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "perplexity": pa.array(np.concatenate(found) if found else np.zeros(0))})


def score_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``perplexity`` (per byte), ``threshold``, ``kept``.

    ``trusted`` holds the ids of trusted documents; all of them are learnt from. ``threshold`` is the ``quantile`` of the
    trusted documents' perplexity in the document's language; a language without trusted text has none, and its documents
    are kept. Null and empty texts have a perplexity of 1. A null language is a language of its own. Rows that repeat an
    id are trusted together. Further columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("long").alias("block")
    rows = docs.select(block, F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    dealt = rows.mapInArrow(_pack, "block long, blob binary").repartition(parts, "block").groupBy("block")
    known = trusted.where(F.col(id_col).isNotNull()).select(block, F.col(id_col).cast("long").alias("doc_id")).distinct()
    learnt = staged(dealt.cogroup(known.groupBy("block")).applyInArrow(_learn, "block long, g long, c long"), "kneser-ney-blocks")
    counts = staged(learnt.where("c > 0").groupBy("g").agg(F.sum("c").alias("c")), "kneser-ney-counts")
    logs = kneser_ney(counts, learnt.select("g").distinct())
    sent = learnt.select("block", "g").join(logs, "g").select("block", "g", "logp")
    scored = staged(dealt.cogroup(sent.groupBy("block")).applyInArrow(_score, "doc_id long, lang string, perplexity double"), "kneser-ney-scores")
    limits = scored.join(known.select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    # One row per language.
    return (
        scored.alias("s")
        .join(F.broadcast(limits.alias("l")), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
        .select("s.doc_id", "s.lang", "s.perplexity", "l.threshold", F.coalesce(F.col("s.perplexity") <= F.col("l.threshold"), F.lit(True)).alias("kept"))
    )
