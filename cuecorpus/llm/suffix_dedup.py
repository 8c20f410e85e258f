"""Removal of passages that repeat anywhere in the corpus, by suffix arrays of shards.

Each byte covered by a string of ``LENGTH`` bytes that also starts earlier goes. The corpus is dealt into shards by
content: of the ``GRAM``-byte strings inside a ``LENGTH``-byte string, the one with the smallest hash (the leftmost, if
several) is its anchor, so equal strings have equal anchors wherever they stand. A run of starts with one anchor makes
one piece. Pieces whose anchor occurs once in the corpus hold no repeat and are left out; the others meet in the shard of
their anchor. There, equal pieces are one piece with several places, a suffix array is induced over the pieces that have
company under their anchor, and suffixes next to each other that share ``LENGTH`` bytes are occurrences of one string: all
but the first are marked.

Equal whole texts are merged before: the first stays, and the later ones go whole without being searched.

Anchors are counted, and pieces fetched, over joins; nothing of the corpus passes through the driver. An anchor with
more than ``hot`` places has its pieces cut into single strings, dealt by the hash of all their bytes. The task that
reads the documents keeps the smallest place of such a string and marks all others itself, so a shard gets a string once
from each task, however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm import suffixes
from cuecorpus.llm.words import batches_of, mix
from cuecorpus.llm.words import _INVERSE, _VALUE, _powers
from cuecorpus.llm.workspace import staged

LENGTH, GRAM = 100, 20
#: Places of an anchor from which its strings are dealt one by one.
HOT = 20_000
#: Bytes of pieces in one suffix array, about.
BLOCK = 3_000_000
LOWEST = -(2**63)
#: Parts of a group of equal texts that look for their first one.
SALTS = 16
#: Single strings whose smallest place a task holds before it sends them.
HELD = 200_000
#: A place of a piece: document, version of it, first byte.
PLACE = np.dtype([("id", "<i8"), ("version", "<i8"), ("start", "<i4")])
#: Bytes that a task has marked itself.
SPAN = np.dtype([("id", "<i8"), ("version", "<i8"), ("start", "<i4"), ("end", "<i4")])


def pieces(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts of ``length``-byte strings with one anchor: text number, first start, last start, anchor's hash."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    none = (np.zeros(0, np.int64),) * 4
    if not len(texts) or sizes.max() < length:
        return none
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(n)[:n])))
    hashes = mix((sums[gram:] - sums[:-gram]) * _powers(n, _INVERSE)[: n - gram + 1])
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # one for each start in the joined texts
    starts = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    owner = np.repeat(np.arange(len(texts)), count)
    anchor = anchor[at]
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(head[1:], len(at)) - 1
    own = owner[head]
    return own, at[head] - starts[own], at[last] - starts[own], hashes[anchor[head]].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, versions = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
        texts = batch.column(2).to_pylist()
        for lo, hi in batches_of(texts):
            own, _, _, keys = pieces(texts[lo:hi])
            order = np.lexsort((keys, own))
            own, keys = own[order], keys[order]
            head = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]))))
            n = np.diff(np.append(head, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][own[head]]), pa.array(versions[lo:hi][own[head]]), pa.array(keys[head]), pa.array(n.astype(np.int32))], names=["_id", "_version", "key", "n"])


def _sent(rows: list[tuple[int, bytes | None, bytes]]) -> pa.RecordBatch:
    keys, found, packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary()), pa.array(packed, pa.binary())], names=["key", "piece", "places"])


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Starts of marked strings as spans."""
    at = np.unique(np.asarray(starts, np.int64))
    head = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return list(zip(at[head].tolist(), (at[np.append(head[1:], len(at)) - 1] + LENGTH).tolist(), strict=True))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their places. Rows without a piece hold spans that are marked already, and may go to any shard."""
    least: dict[bytes, tuple[int, int, int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if least:
            yield _sent([(int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True), s, np.array([x], PLACE).tobytes()) for s, x in least.items()])
        least.clear()

    for batch in batches:
        ids, versions = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
        texts = batch.column(2).to_pylist()
        wanted = batch.column(3)
        hot = batch.column(4)
        for lo, hi in batches_of(texts):
            own, first, last, keys = pieces(texts[lo:hi])
            limits = np.searchsorted(own, np.arange(hi - lo + 1))
            found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            later: dict[tuple[int, int], list[int]] = {}
            for k in range(hi - lo):
                doc = (int(ids[lo + k]), int(versions[lo + k]))
                a, b = limits[k], limits[k + 1]
                text, mine = texts[lo + k], keys[a:b]
                single = np.isin(mine, np.asarray(hot[lo + k].values, np.int64))
                for i in np.flatnonzero(np.isin(mine, np.asarray(wanted[lo + k].values, np.int64))) + a:
                    if single[i - a]:
                        for s in range(first[i], last[i] + 1):
                            place = (*doc, int(s))
                            first_ = least.setdefault(text[s : s + LENGTH], place)
                            if place < first_:
                                least[text[s : s + LENGTH]] = place
                                later.setdefault(first_[:2], []).append(first_[2])
                            elif place > first_:
                                later.setdefault(doc, []).append(int(s))
                    else:
                        found.setdefault((int(keys[i]), text[first[i] : last[i] + LENGTH]), []).append((k, int(first[i])))
            if found:
                counts = [len(p) for p in found.values()]
                flat = np.asarray([x for p in found.values() for x in p], np.int64)
                places = np.empty(len(flat), PLACE)
                places["id"], places["version"], places["start"] = ids[lo + flat[:, 0]], versions[lo + flat[:, 0]], flat[:, 1]
                limits = np.cumsum(counts)
                packed = [places[e - n : e].tobytes() for e, n in zip(limits, counts, strict=True)]
                yield _sent([(k, p, x) for (k, p), x in zip(found, packed, strict=True)])
            if later:
                keys = mix(np.asarray([d[0] for d in later], np.int64).view(np.uint64)).view(np.int64).tolist()
                yield _sent([(key, None, np.array([(*d, a, b) for a, b in _runs(at)], SPAN).tobytes()) for key, (d, at) in zip(keys, later.items(), strict=True)])
            if len(least) >= HELD:
                yield from flush()
    yield from flush()


def judge(found: list[bytes], company: np.ndarray, piece: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Spans to remove: ids, versions, starts and ends.

    ``found`` are distinct pieces; ``company`` tells those that may share a string with another one. ``piece`` and
    ``places`` hold one entry for each place of a piece.
    """
    ids, versions, starts = places["id"], places["version"], places["start"].astype(np.int64)
    order = np.lexsort((starts, versions, ids, piece))
    piece, ids, versions, starts = piece[order], ids[order], versions[order], starts[order]
    fresh = np.concatenate(([True], (piece[1:] != piece[:-1]) | (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (starts[1:] != starts[:-1])))
    piece, ids, versions, starts = piece[fresh], ids[fresh], versions[fresh], starts[fresh]
    first = np.concatenate(([True], piece[1:] != piece[:-1]))
    lengths = np.asarray([len(p) for p in found], np.int64)
    # A place of a piece that isn't its first repeats all of it.
    later = [x[~first] for x in (ids, versions, starts)] + [starts[~first] + lengths[piece[~first]]]
    own = np.flatnonzero(company)
    if not len(own):
        return tuple(later)
    fid, fver, fstart = (x[first][own] for x in (ids, versions, starts))
    found, lengths = [found[i] for i in own], lengths[own]

    t, at = suffixes.layout(found)
    sa = suffixes.suffix_array(t)
    shared = suffixes.common_prefixes(t, sa, at, lengths, length)
    owner = np.repeat(np.arange(len(found)), lengths + 1)
    offset = np.arange(len(t)) - at[owner]
    whole = sa[lengths[owner[sa]] - offset[sa] >= length]  # suffixes that hold a string of the length asked for
    group = np.cumsum(shared[whole] < length)
    many = np.bincount(group, minlength=2)[group] > 1
    whole, group = whole[many], group[many]
    own, off = owner[whole], offset[whole]
    place = fstart[own] + off
    order = np.lexsort((place, fver[own], fid[own], group))
    repeat = np.concatenate((np.zeros(min(1, len(order)), bool), group[order][1:] == group[order][:-1]))
    marked = np.sort(whole[order[repeat]])
    head = np.concatenate((np.ones(min(1, len(marked)), bool), (marked[1:] != marked[:-1] + 1) | (owner[marked[1:]] != owner[marked[:-1]])))
    a = marked[head]
    b = marked[np.append(np.flatnonzero(head)[1:], len(marked)) - 1] if len(marked) else marked
    inner = [fid[owner[a]], fver[owner[a]], fstart[owner[a]] + offset[a], fstart[owner[b]] + offset[b] + length]
    return tuple(np.concatenate(x) for x in zip(later, inner, strict=True))


def _judge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[tuple[int, bytes], int] = {}
    numbers: list[int] = []
    places: list[bytes] = []
    held, last = 0, None

    def finish() -> Iterator[pa.RecordBatch]:
        if names:
            keys = np.asarray([k for k, _ in names], np.int64)
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            piece = np.repeat(np.asarray(numbers), [len(p) // PLACE.itemsize for p in places])
            ids, versions, starts, ends = judge([p for _, p in names], counts[inverse] > 1, piece, np.frombuffer(b"".join(places), PLACE))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(versions), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["_id", "_version", "start", "end"])
        for x in (names, numbers, places):
            x.clear()

    for batch in batches:
        marked = np.frombuffer(b"".join(batch.column(2).filter(batch.column(1).is_null()).to_pylist()), SPAN)
        if len(marked):
            yield pa.RecordBatch.from_arrays([pa.array(marked[c].copy()) for c in ("id", "version", "start", "end")], names=["_id", "_version", "start", "end"])
        batch = batch.filter(batch.column(1).is_valid())
        for key, piece, own in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if held >= BLOCK and key != last:
                yield from finish()
                held = 0
            if (key, piece) not in names:
                held += len(piece)
            held += len(own)
            numbers.append(names.setdefault((key, piece), len(names)))
            places.append(own)
            last = key
    yield from finish()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            kept, at, removed, n, end = [], 0, 0, 0, -1
            if spans.is_valid:
                flat = spans.values
                a, b = (np.asarray(flat.field(c), np.int64) for c in (0, 1))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                head = np.concatenate(([True], a[1:] > b[:-1]))
                for s, e in zip(a[head], b[np.append(np.flatnonzero(head)[1:], len(b)) - 1], strict=True):
                    kept.append(text[at:s])
                    at, removed, n, end = e, removed + int(e - s), n + 1, e
            kept.append(text[at:])
            rows.append((len(text), removed, n, b"".join(kept)))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def later_copies(named: DataFrame) -> DataFrame:
    """``_id``, ``_version`` and ``n`` (bytes) of documents whose whole text, of ``LENGTH`` bytes and more, is that of
    one with a smaller id."""
    own = named.where(F.octet_length("text") >= LENGTH).select("_id", "_version", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("_h"))
    first = own.groupBy("_h").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    first = first.select("_h", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = own.withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS)))
    return salted.join(first, ["_h", "_salt"]).where("_id > _first").select("_id", "_version", "n").distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes).

    A null text is empty; texts shorter than 100 bytes hold nothing to remove. Documents are ordered by id, nulls first;
    rows that share an id (or have none) but not the text are told apart and ordered by a 64-bit hash of the text, rows that repeat both are one document and
    don't count as repeats of each other. Further columns are ignored; an empty table gives an empty table.

    The bytes that are kept need not be valid UTF-8: a cut may fall inside a character.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_id"), F.xxhash64(text).alias("_version"), text.alias("text"))
    copies = staged(later_copies(named), "suffix-copies")
    # No filter on length here: all joins of whole texts share one exchange.
    anchors = named.join(copies.select("_id", "_version"), ["_id", "_version"], "left_anti").select("_id", "_version", "text").mapInArrow(_anchors, "_id long, _version long, key long, n int")
    repeated = anchors.groupBy("key").agg(F.sum("n").alias("places")).where("places > 1")
    wanted = anchors.select("_id", "_version", "key").join(repeated, "key").groupBy("_id", "_version").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("places") > hot, F.col("key"))).alias("hot_keys"))
    fetched = named.join(wanted, ["_id", "_version"]).select("_id", "_version", "text", "keys", "hot_keys").mapInArrow(_fetch, "key long, piece binary, places binary")
    spans = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_judge_shards, "_id long, _version long, start int, end int")
    spans = spans.unionByName(copies.select("_id", "_version", F.lit(0).alias("start"), F.col("n").alias("end")))
    # Spans travel as plain rows: few of them meet before the exchange, and lists of one cost more than they hold.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_doc = spans.repartition(parts, "_id", "_version").groupBy("_id", "_version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = named.join(by_doc, ["_id", "_version"], "left").select("_id", "text", "spans").mapInArrow(_cut, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(F.when(F.col("_id") != LOWEST, F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
