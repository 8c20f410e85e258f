"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash gives each element of a set one value per slot by walking a random permutation of the slots, so the values
of one element are spread evenly over the signature; that lowers the variance, and a set is done once every slot holds
a value that no later step can beat.

1. Each whole text becomes its set of word shingles; equal sets form a class at once, by a digest of the set.
2. One document of each class is hashed and banded. With 48 bands of 4 slots, a pair at the limit of 0.75 shares no
   band once in 80 million pairs. ``exact`` takes the smallest hashes of a set as its keys instead, as many as leave two sets
   at the limit no way to share none: that loses no pair, and costs a key for every fourth shingle.
3. In each bucket the members are compared with a hub, not with each other, on full sets; links are joined to components
   by joins and aggregations. Members of a hot bucket, and those of a hub of many buckets, are dealt to several tasks.
4. In buckets that the hub leaves in several components, members of different components are compared inside a task: the
   shared elements of one set with all others are counted over postings, and only links that join components come out.
   Large buckets are dealt into pairs of blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm.components import connected
from cuecorpus.llm.spread import join_spread
from cuecorpus.llm.words import batches_of, mix, shingle_hashes
from cuecorpus.llm.workspace import staged

BANDS, ROWS = 48, 4
SLOTS = BANDS * ROWS
#: A link: 100 * shared >= LIMIT * union.
LIMIT = 75
#: Bytes of sets in a block of a bucket, about.
BLOCK = 16_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
_NONE = np.uint64(2**64 - 1)


def superminhash(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of consecutive runs of ``elements``: step j gives each element's next slot the value j + fraction.

    A set takes no further step once all its slots hold values of earlier steps.
    """
    sets = len(sizes)
    out = np.full(sets * slots, _NONE, np.uint64)
    owner = np.repeat(np.arange(sets), sizes)
    order = None
    active = np.arange(len(elements))
    for j in range(slots):
        draw = mix(elements[active] + np.uint64((j + 1) * int(_STEP) % 2**64))
        k = j + ((draw >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        if order is None:
            slot = k
        else:
            rows = np.arange(len(active))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        np.minimum.at(out, owner[active] * slots + slot, (np.uint64(j) << np.uint64(40)) | (draw & _LOW))
        level = out.reshape(sets, slots).max(1) >> np.uint64(40)
        going = (level > np.uint64(j))[owner[active]]
        if not going.any():
            break
        active = active[going]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(active), 1))
            order[np.arange(len(active)), k[going]] = 0
        else:
            order = order[going]
    return out.reshape(sets, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = signatures.shape[1] // bands
    parts = signatures.reshape(len(signatures), bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :] + np.zeros((len(signatures), 1), np.uint64)
    for r in range(rows):
        key = mix(key * _STEP + parts[:, :, r])
    return key.view(np.int64)


def prefix_keys(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest elements of each sorted set, and how many: two sets that share ``LIMIT`` hundredths of the larger one share
    one of these."""
    counts = np.where(sizes > 0, sizes - -(-sizes * LIMIT // 100) + 1, 0)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return elements[at].view(np.int64), counts


def _sketcher(exact: bool):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in batches_of(texts, 1_000_000):
                elements, sizes = shingle_hashes(texts[lo:hi])
                ends = np.cumsum(sizes)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(c))))) for c in (0x5851F42D, 0x14057B7E)]
                digests = [(s[ends] - s[ends - sizes]).view(np.int64) for s in sums]
                if exact:
                    keys, counts = prefix_keys(elements, sizes)
                else:
                    keys, counts = band_keys(superminhash(elements, sizes)).ravel(), np.full(len(sizes), BANDS)
                limits = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]), pa.ListArray.from_arrays(limits, pa.array(keys))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return sketch


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
        for lo, hi in batches_of(texts):
            elements, sizes = shingle_hashes(texts[lo:hi])
            limits = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([elements[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)], pa.binary())], names=["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
            x, y = x.as_buffer(), y.as_buffer()
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            if len(a) == 0:
                continue
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int((b[at] == a).sum())
            keep[k] = 100 * shared >= LIMIT * (len(a) + len(b) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``id``, ``hub``) that are links (``a``, ``b``), by the full sets of both (``id``, ``shingles``). A hub may be
    in any number of pairs."""
    hubs = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("sb"))
    both = join_spread(pairs, hubs, "hub", "id").join(sets.select("id", F.col("shingles").alias("sa")), "id")
    both = both.where(F.octet_length("sa") * 100 >= F.octet_length("sb") * LIMIT).where(F.octet_length("sb") * 100 >= F.octet_length("sa") * LIMIT)
    return both.select(F.col("id").alias("a"), F.col("hub").alias("b"), "sa", "sb").mapInArrow(_confirm, "a long, b long")


def _join_components(ids: np.ndarray, comps: np.ndarray, blocks: np.ndarray, cross: bool, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components of one group. ``cross``: only pairs of different blocks are compared."""
    names, comp = np.unique(comps, return_inverse=True)
    if len(names) < 2:
        return []
    root = np.arange(len(names))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.asarray([len(x) for x in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], np.repeat(np.arange(len(sets)), sizes)[order]
    largest = np.bincount(comp).argmax()
    out = []
    for q in np.flatnonzero(comp != largest):  # the pairs of the largest component's own members are known
        lo, hi = np.searchsorted(elements, sets[q], "left"), np.searchsorted(elements, sets[q], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(sets))
        linked = (100 * shared >= LIMIT * (sizes[q] + sizes - shared)) & (comp != comp[q])
        if cross:
            linked &= blocks != blocks[q]
        for o in np.flatnonzero(linked):
            a, b = find(comp[q]), find(comp[o])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[q]), int(ids[o])))
    return out


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    last = None

    def finish() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        blocks, ids, comps, sets = zip(*held, strict=True)
        return _join_components(np.asarray(ids), np.asarray(comps), np.asarray(blocks), last[1] != last[2], [np.frombuffer(x, np.uint64) for x in sets])

    for batch in batches:
        links = []
        cols = [batch.column(c).to_pylist() for c in range(7)]
        for key, lower, upper, *row in zip(*cols, strict=True):
            if (key, lower, upper) != last:
                links += finish()
                held.clear()
                last = (key, lower, upper)
            held.append(tuple(row))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    links = finish()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Links are pairs of documents with 100 * intersection >= 75 * union of their sets of five-word shingles;
    ``component_id`` is the smallest id reachable over links, itself included, and that document is kept. A text without
    words, empty or null links with nothing. Rows that repeat an id share its component; a null id takes no part in
    links, has a null component and is kept. Further columns are ignored; an empty table gives an empty table.

    ``exact`` finds candidates by prefixes of the sets and not by signatures.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sketched = staged(named.mapInArrow(_sketcher(exact), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "minhash-sketches")
    linkable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(linkable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    reps = linkable.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    keys = reps.select(F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("key"))
    crowded = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-buckets")
    members = staged(join_spread(keys, crowded, "key", "id", crowded), "minhash-members")
    sets = staged(named.withColumnRenamed("doc_id", "id").join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "minhash-sets")

    # The member that shares the most buckets with others is the hub of each of its buckets.
    ranked = members.select("key", "id").join(members.groupBy("id").agg(F.sum("n").alias("shared")), "id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("shared", F.negative("id").alias("minus"))).alias("_h")).select("key", F.negative("_h.minus").alias("hub"))
    pairs = staged(join_spread(members, hubs, "key", "id", crowded).where("id <> hub").select("id", "hub").distinct(), "minhash-pairs")
    links = staged(confirm(pairs, sets), "minhash-links")
    grouped = connected(links)

    # Buckets of three and more that the hub left in several components.
    placed = members.where("n > 2").join(grouped.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("comp"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.ceil(F.sum("n_shingles") * 8 / BLOCK).alias("blocks")).where("_low < _high")
    rest = join_spread(placed, apart.select("key", "blocks"), "key", "id", crowded).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rest.select("key", "id", "comp", "block", other.alias("_o")).select("key", "id", "comp", "block", F.least("block", "_o").alias("lower"), F.greatest("block", "_o").alias("upper"))
    found = dealt.join(sets, "id").repartition("key", "lower", "upper").sortWithinPartitions("key", "lower", "upper", "id").select("key", "lower", "upper", "block", "id", "comp", "shingles").mapInArrow(_link_buckets, "a long, b long")
    more = staged(found.distinct(), "minhash-links")
    if not more.isEmpty():
        grouped = connected(more.unionByName(grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # The copies of a text share one class, and the class's members fetch its first document over several tasks.
    named_class = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select(F.xxhash64("d1", "d2", "n_shingles").alias("class"), "d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("rep"))
    own = sketched.select("doc_id", "n_shingles", "d1", "d2", F.xxhash64("d1", "d2", "n_shingles").alias("class"))
    linked = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    out = join_spread(linked, named_class.select("class", F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n_shingles").alias("c3"), "rep"), "class", "doc_id").where("d1 = c1 AND d2 = c2 AND n_shingles = c3")
    alone = own.where("n_shingles = 0 OR doc_id IS NULL").withColumn("rep", F.col("doc_id"))
    every = out.select("doc_id", "n_shingles", "rep").unionByName(alone.select("doc_id", "n_shingles", "rep"))
    return every.select("doc_id", "n_shingles", F.col("rep").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(True)).alias("kept"))
