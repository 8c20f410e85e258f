"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, over n-grams of three words.

Words are runs between white space with A-Z lowered; characters of three and more bytes are words of their own, so
scripts without spaces are read as well. Words are 64-bit hashes. Documents are dealt into blocks as in ``quality``; a
block is read once and kept as numbers of its own words, packed.

N-grams are dealt to shards by their middle word, where a triple, its context (first and second word), its pair (second and
third word) and all that follows the second word meet. A block sends a shard one message: its distinct triples as numbers of
the words in them, and how often its trusted texts have them. The shard adds up and answers in the same order. A word
that would fill a shard by itself is dealt by the word before it too; its pairs are then summed and answered by
shards of their own, and so are single words, which blocks ask themselves. A message holds one n-gram at least, so what moves grows with the distinct n-grams of blocks.
A block that has the counts of its triples knows a part of all other counts, so a reply holds only what these lack.
A triple is in a message once, however often a text is repeated. A task holds a block or a shard; a shard grows beyond its
share only with what follows a single pair of words, as that isn't dealt further.

Blocks are read in ``READS`` parts, asked for shards in ``WAVES`` and scored in as many, and asked for single words in
``WORD_WAVES``, so only a part of what moves is on disk at a time. Waves of frequent words come first, while few replies are there.

Trusted text is learnt from, but for every ``held_out``-th document: limits are quantiles of documents that the model hasn't
learnt, since those that it has are far likelier to it than any unseen text, however good.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm.quality import QUANTILE, _pack, _unpack, discounts
from cuecorpus.llm.words import _INVERSE, _LOWER, _MUL, _SPACE, _VALUE, _powers, batches_of, mix
from cuecorpus.llm.workspace import staged, staged_parts

ORDER = 3
#: One in so many trusted documents sets limits and isn't learnt from.
HELD_OUT = 10
#: Bytes of text in a block, about: a task holds some ten numbers for each of its words.
BLOCK_BYTES = 12_000_000
#: Bytes of text whose n-grams a shard takes, about.
SHARD_BYTES = 10_000_000
#: Shards for one shard of single words.
PER_WORDS = 4
#: Parts of the input that are read one after the other.
READS = 3
#: Parts of the shards, and of the blocks that are scored, one after the other.
WAVES = 8
#: Parts of the shards of single words.
WORD_WAVES = 4
#: Stands before a text's first word.
PAD = np.uint64(0x50AD50AD50AD50AD)
#: A block with its number of words (``n`` null), or a frequent word of it with how often it has that.
BLOCK = "block long, words long, word long, n long, blob binary, ids array<long>, langs array<string>"
#: What a shard gives: a reply to a block; how many words precede words or pairs of hot words (``block`` null: told to
#: another shard); what follows a hot word; sums of an order.
REPLY, WORD, PAIR, FOLLOW, SUMS = range(5)
MESSAGE = "shard long, block long, blob binary"
COLUMNS = {"block": "long", "shard": "long", "a": "long", "blob": "binary", "sums": "array<long>"}
KINDS = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("block", "shard", "a")], ("blob", pa.binary()), ("sums", pa.list_(pa.int64()))])
ANSWER = ", ".join(["kind int", *[f"{c} {t}" for c, t in COLUMNS.items()]])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    n = len(data)
    space, lead = _SPACE[data], data >= 0xE0
    wide = lead.copy()
    for k in (1, 2):
        wide[k:] |= lead[:-k]
    wide[3:] |= (data >= 0xF0)[:-3]
    wide &= data >= 0x80
    before, was_wide = np.concatenate(([True], space[:-1])), np.concatenate(([False], wide[:-1]))
    begin = ~space & (before | lead | (was_wide & ~wide))
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(~space & np.concatenate((space[1:] | begin[1:], [True]))) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(n)[:n])))
    hashes = mix((sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts] ^ (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, the first one by differences, as one compressed string: the bytes of like weight stand together."""
    parts = []
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a).astype(np.uint64)
        a = np.diff(a, prepend=np.uint64(0)) if k == 0 else a
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        parts += [np.asarray([len(a), width], np.int64).tobytes(), a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``: the first of unsigned, the others of signed integers."""
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width = np.frombuffer(data, np.int64, 2, at).tolist()
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(a.view(np.uint64).reshape(-1) if not out else a.view(np.int64).reshape(-1))
        at += 16 + n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def unpack_first(blob: bytes) -> np.ndarray:
    """The first array of ``pack``; the rest isn't decompressed."""
    with zstandard.ZstdDecompressor().stream_reader(blob) as data:
        n, width = np.frombuffer(data.read(16), np.int64).tolist()
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(data.read(n * width), np.uint8).reshape(width, n).T
    return np.cumsum(a.view(np.uint64).reshape(-1), dtype=np.uint64)


class Grams(NamedTuple):
    """Distinct n-grams of a block by numbers of its words, ordered by second word, then the others."""

    words: np.ndarray  # hashes; the last is PAD
    first: np.ndarray  # of contexts
    second: np.ndarray
    context: np.ndarray  # of triples
    third: np.ndarray
    at: np.ndarray  # the triple that ends at each word of the block


def grams_of(words: np.ndarray, local: np.ndarray, sizes: np.ndarray, wave: np.ndarray | None = None) -> tuple[Grams, np.ndarray | slice]:
    """``words``: hashes of the block's words; ``local``: which one stands at each place; ``sizes``: words of each text.

    If ``wave`` says so of each word, only places that have it second are read; which ones is returned, too.
    """
    n = len(words) + 1
    padded = np.full(len(local) + 2 * len(sizes), n - 1)
    at = np.arange(len(local)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[at] = local
    places = slice(None) if wave is None else wave[padded[at - 1]]
    at, local = at[places], local[places]
    contexts, context = np.unique(padded[at - 1] * n + padded[at - 2], return_inverse=True)
    triples, triple = np.unique(context * n + local, return_inverse=True)
    return Grams(np.append(words, PAD), contexts % n, contexts // n, triples // n, triples % n, triple), places


def shards_of(g: Grams, shards: int, hot: dict[int, int]) -> np.ndarray:
    """The shard of each context: by its second word, and by its first too, dealt into so many parts, where that is ``hot``."""
    parts = np.asarray([hot.get(w, 1) for w in g.words.view(np.int64).tolist()], np.uint64) if hot else np.ones(len(g.words), np.uint64)
    wave = mix(g.words) % np.uint64(min(WAVES, shards))
    most = (np.uint64(shards) - wave + np.uint64(WAVES - 1)) // np.uint64(WAVES)
    inside = mix(mix(g.words[g.second]) + (mix(g.words[g.first]) % parts[g.second]) * _MUL) % most[g.second]
    return (inside * np.uint64(WAVES) + wave[g.second]).astype(np.int64)


def _groups(shard: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each shard's items, ascending."""
    small = shard.astype(np.uint16 if len(shard) and int(shard.max()) < 2**16 else np.int64)
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(small[order].astype(np.int64), prepend=-1, append=-1))
    return {int(small[order[lo]]): order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)}


def _to_shards(words: np.ndarray, shards: int) -> dict[int, np.ndarray]:
    """Shards of single words, and which of ``words`` each has."""
    return _groups((mix(words ^ PAD) % np.uint64(shards)).astype(np.int64))


def _messages(shards: list[int], blocks: list[int | None], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"])


def _keep(blobs: pa.Table, trusted: pa.Table, shards: int) -> pa.Table:
    """A block's documents as numbers of its words, and its frequent words."""
    known = np.asarray(trusted["doc_id"], np.int64)
    hashes, sizes, good, ids, langs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [], []
    for rows in _unpack(blobs["blob"]):
        texts, own = rows["text"].to_pylist(), rows["doc_id"].combine_chunks()
        for lo, hi in batches_of(texts):
            found, counts = words_of(texts[lo:hi])
            hashes.append(found)
            sizes.append(counts)
        good.append(np.isin(np.asarray(own.fill_null(0), np.int64), known) & np.asarray(own.is_valid()))
        ids += own.to_pylist()
        langs += rows["lang"].to_pylist()
    schema = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string()))])
    if not blobs.num_rows:
        return schema.empty_table()
    words, local, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    # Frequent words first, so that most numbers are small; hashes ascend among words about as frequent.
    order = np.lexsort((words, -np.floor(np.log2(counts))))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    often = np.flatnonzero(counts * 2 * shards >= counts.sum())
    block, none = blobs["block"][0].as_py(), [None] * len(often)
    columns = [
        [block] * (1 + len(often)),
        [len(local), *none],
        [None, *words[often].view(np.int64).tolist()],
        [None, *counts[often].tolist()],
        [pack(words[order], place[local], np.concatenate(sizes), np.concatenate(good)), *none],
        [ids, *none],
        [langs, *none],
    ]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _asker(shards: int, hot: dict[int, int], wave: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                words, local, sizes, good = unpack(blob.as_py())
                own = mix(np.append(words, PAD)) % np.uint64(min(WAVES, shards)) == wave
                g, places = grams_of(words, local, sizes, own)
                n = np.bincount(g.at, weights=np.repeat(good, sizes)[places], minlength=len(g.third)).astype(np.int64)
                shard = shards_of(g, shards, hot)
                follow = np.bincount(g.context, minlength=len(g.first))
                triples, at = _groups(shard[g.context]), np.zeros(len(g.words), np.int64)
                for s, c in _groups(shard).items():
                    t = triples[s]
                    used = np.unique(np.concatenate([g.first[c], g.second[c], g.third[t]]))
                    at[used] = np.arange(len(used))
                    yield _messages([s], [block], [pack(g.words[used], np.diff(at[g.second[c]], prepend=0), at[g.first[c]], follow[c], at[g.third[t]], n[t])])

    return ask


def _word_asker(shards: int, waves: int, wave: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                words = np.sort(unpack_first(blob.as_py()))
                for s, own in _to_shards(words, shards).items():
                    if s % waves == wave:
                        yield _messages([s], [block], [pack(words[own])])

    return ask


def _pair_asker(shards: int, hot: dict[int, int]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["blob"], strict=True):
                words, local, sizes, _ = unpack(blob.as_py())
                own = np.isin(np.append(words, PAD).view(np.int64), np.asarray(list(hot), np.int64))
                g, _ = grams_of(words, local, sizes, own)
                x = np.unique(g.second[g.context] * len(g.words) + g.third)
                keys = np.sort(_pair_keys(g.words[x // len(g.words)], g.words[x % len(g.words)]))
                for s, at in _to_shards(keys, shards).items():
                    yield _messages([s], [block], [pack(keys[at])])

    return ask


def _rows(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), KINDS, strict=True)], schema=KINDS) if out else KINDS.empty_table()


def _told(words: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """Messages to the shards of ``words``, which ascend."""
    return [(WORD, None, s, None, pack(words[own], counts[own]), None) for s, own in _to_shards(words, shards).items()]


def _added(messages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Keys that messages tell of, the sums of their counts, where each was first told, and these messages."""
    told = [unpack(blob.as_py()) for block, blob in zip(messages["block"].to_pylist(), messages["blob"], strict=True) if block is None]
    keys, first, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t[0] for t in told]]), return_index=True, return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([np.zeros(0, np.int64), *[t[1] for t in told]]), minlength=len(keys)).astype(np.int64), first, told


def _found(messages: pa.Table, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks that ask, their keys and the counts of these."""
    for block, blob in zip(messages["block"].to_pylist(), messages["blob"], strict=True):
        if block is not None:
            asked = unpack(blob.as_py())[0]
            place = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            yield block, asked, np.where(keys[place] == asked, n[place], 0) if len(keys) else np.zeros(len(asked), np.int64)


def _answer_words(messages: pa.Table) -> pa.Table:
    words, n, _, _ = _added(messages)
    shard = messages["shard"][0].as_py()
    return _rows([(SUMS, None, None, 1, None, _sums(n)), *[(WORD, block, shard, None, pack(np.zeros(0), found), None) for block, _, found in _found(messages, words, n)]])


def _pair_answerer(word_shards: int):
    def answer(messages: pa.Table) -> pa.Table:
        keys, n, first, told = _added(messages)
        seconds, thirds = (np.concatenate([np.zeros(0, np.int64), *[t[k] for t in told]])[first] for k in (2, 3))
        words, at = np.unique(seconds, return_inverse=True)
        out = [(SUMS, None, None, 2, None, _sums(n))]
        out += [(FOLLOW, None, None, int(w), None, x) for w, x in zip(words, np.stack(_tally(n, at, len(words)), 1).tolist(), strict=True)]
        out += _told(*np.unique(thirds.view(np.uint64), return_counts=True), word_shards)
        out += [(PAIR, block, None, None, pack(asked[found > 0], found[found > 0]), None) for block, asked, found in _found(messages, keys, n)]
        return _rows(out)

    return answer


def _pair_keys(seconds: np.ndarray, thirds: np.ndarray) -> np.ndarray:
    return mix(mix(seconds) * _MUL + thirds)


def _tally(n: np.ndarray, of: np.ndarray, size: int) -> list[np.ndarray]:
    """For each of ``size`` groups: the sum of ``n``, and how many are one, two and over two."""
    return [np.bincount(of, weights=n, minlength=size).astype(np.int64), *[np.bincount(of[x], minlength=size) for x in (n == 1, n == 2, n > 2)]]


def _lacks(tally: list[np.ndarray], n: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """What ``tally`` of all n-grams has beyond those of a block, which occur ``n`` times; of the sum, what the others don't say."""
    total, one, two, more = (x - own for x, own in zip(tally, _tally(n, of, len(tally[0])), strict=True))
    return [total - one - 2 * two - 3 * more, one, two, more]


def _fill(lacks: np.ndarray, n: np.ndarray, of: np.ndarray) -> None:
    """Make the tally of what a block lacks of it, in place."""
    for k in (1, 2, 3):
        lacks[0] += k * lacks[k]
        lacks[k] += np.bincount(of[n > 2 if k == 3 else n == k], minlength=lacks.shape[1])
    lacks[0] += np.bincount(of, weights=n, minlength=lacks.shape[1]).astype(np.int64)


def _sums(n: np.ndarray) -> list[int]:
    """How many n-grams occur once to four times and over twice, and the sum of all."""
    return [*[int((n == k).sum()) for k in (1, 2, 3, 4)], int((n > 2).sum()), int(n.sum())]


def _answerer(hot: dict[int, int], word_shards: int):
    def answer(messages: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in messages["blob"]]
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        size, offset, first, second, third = len(words), 0, [], [], []
        for p in parts:
            own = place[offset : offset + len(p[0])]
            offset += len(p[0])
            p[1] = np.cumsum(p[1])
            first.append(own[p[2]])
            second.append(own[p[1]])
            third.append(own[p[4]])
        contexts, context = np.unique(np.concatenate(second) * size + np.concatenate(first), return_inverse=True)
        del first, second
        triples, triple = np.unique(np.repeat(context, np.concatenate([p[3] for p in parts])) * size + np.concatenate(third), return_inverse=True)
        del third
        n = np.bincount(triple, weights=np.concatenate([p[5] for p in parts])).astype(np.int64)
        after = _tally(n, triples // size, len(contexts))
        pairs, pair = np.unique(contexts[triples // size] // size * size + triples % size, return_inverse=True)
        before = np.bincount(pair[n > 0], minlength=len(pairs))
        follow = _tally(before, pairs // size, size)
        is_hot = np.isin(words.view(np.int64), np.asarray(list(hot), np.int64))
        own, others = (before > 0) & ~is_hot[pairs // size], (before > 0) & is_hot[pairs // size]
        out: list[tuple] = []
        c = t = 0
        shard = messages["shard"][0].as_py()
        for block, p in zip(messages["block"].to_pylist(), parts, strict=True):
            mine, of = triple[t : t + len(p[4])], context[c : c + len(p[1])]
            c, t = c + len(of), t + len(mine)
            found, at, in_pair = np.unique(np.repeat(p[1], p[3]) * len(p[0]) + p[4], return_index=True, return_inverse=True)
            mine_pairs = pair[mine[at]]
            names, firsts = np.unique(p[1], return_index=True)
            seconds = contexts[of[firsts]] // size
            lacks = _lacks([x[of] for x in after], n[mine], np.repeat(np.arange(len(of)), p[3]))
            # What hot words have before and after them comes from the shards of their pairs.
            unseen = np.where(is_hot[pairs[mine_pairs] // size], 0, before[mine_pairs] - np.bincount(in_pair[n[mine] > 0], minlength=len(found)))
            follows = [np.where(is_hot[seconds], 0, x) for x in _lacks([x[seconds] for x in follow], before[mine_pairs], np.searchsorted(names, found // len(p[0])))]
            out.append((REPLY, block, shard, None, pack(np.zeros(0), n[mine] - p[5], *lacks, unseen, *follows), None))
        out += [(SUMS, None, None, k, None, _sums(x)) for k, x in ((3, n), (2, before[own]))]
        counts = np.bincount(pairs[own] % size, minlength=size)
        there = np.flatnonzero(counts)
        out += _told(words[there], counts[there], word_shards)
        x = pairs[others]
        keys = _pair_keys(words[x // size], words[x % size])
        order = np.argsort(keys)
        x, keys, known = x[order], keys[order], before[others][order]
        out += [(PAIR, None, s, None, pack(keys[k], known[k], words[x[k] // size], words[x[k] % size]), None) for s, k in _to_shards(keys, word_shards).items()]
        return _rows(out)

    return answer


def _given(rows: DataFrame, kind: int, *given: str) -> DataFrame:
    """``rows`` as answers of a kind, with null in the columns that it hasn't."""
    return rows.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in given else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()])


def _step(cut: list[float], p: np.ndarray, c: np.ndarray, of: np.ndarray, total: np.ndarray, *times: np.ndarray) -> np.ndarray:
    """The probability of n-grams that occur ``c`` times, from that of the next lower order and what follows each context; ``of``: theirs."""
    less = np.where(c == 1, cut[0], np.where(c == 2, cut[1], cut[2]))
    direct = np.where(c > 0, np.maximum(c - less, 0.0), 0.0)
    rest = sum(d * x for d, x in zip(cut, times, strict=True))[of]
    total = total[of]
    return np.where(total > 0, (direct + rest * p) / np.maximum(total, 1), p)


def _scorer(shards: int, word_shards: int, hot: dict[int, int], sums: dict[int, list[int]], hot_follow: dict[int, list[int]]):
    cuts = {k: discounts(t[:4]) for k, t in sums.items()}

    def chances(g: Grams, own: np.ndarray, answers: pa.Table) -> np.ndarray:
        """The probability of each distinct triple of a block, whose trusted texts have it ``own`` times."""
        kind = np.asarray(answers["kind"])
        found = {k: answers.filter(pa.array(kind == k)) for k in (REPLY, WORD, PAIR)}
        order = np.argsort(g.words[:-1])
        size = len(g.words)
        pairs, pair = np.unique(g.second[g.context] * size + g.third, return_inverse=True)
        n, before, single = np.zeros(len(g.third), np.int64), np.zeros(len(pairs), np.int64), np.zeros(size, np.int64)
        after, follow = np.zeros((4, len(g.first)), np.int64), np.zeros((4, size), np.int64)
        shard = shards_of(g, shards, hot)
        contexts, triples = _groups(shard), _groups(shard[g.context])
        for s, blob in zip(found[REPLY]["shard"].to_pylist(), found[REPLY]["blob"].to_pylist(), strict=True):
            reply = unpack(blob)[1:]
            c, t = contexts[s], triples[s]
            n[t], before[np.unique(pair[t])] = reply[0], reply[5]
            after[:, c], follow[:, np.unique(g.second[c])] = reply[1:5], reply[6:]
        del shard, contexts, triples
        n += own
        _fill(after, n, g.context)
        before += np.bincount(pair[n > 0], minlength=len(pairs))
        _fill(follow, before, pairs // size)
        if hot:
            # PAD is no word of the block, but may stand second.
            names = {w: k for k, w in enumerate(g.words.view(np.int64).tolist()) if w in hot}
            for w, k in names.items():
                before[pairs // size == k] = 0
                follow[:, k] = hot_follow.get(w, [0] * 4)
            of_hot = np.flatnonzero(np.isin(pairs // size, list(names.values())))
            keys = _pair_keys(g.words[pairs[of_hot] // size], g.words[pairs[of_hot] % size])
            of_hot = of_hot[np.argsort(keys)]
            keys.sort()
            for blob in found[PAIR]["blob"].to_pylist():
                given, counts = unpack(blob)
                before[of_hot[np.searchsorted(keys, given)]] = counts
        dealt = _to_shards(g.words[order], word_shards)
        for s, blob in zip(found[WORD]["shard"].to_pylist(), found[WORD]["blob"].to_pylist(), strict=True):
            single[order[dealt[s]]] = unpack(blob)[1]
        first = sums[1]
        seen = first[0] + first[1] + first[4]
        p = _step(cuts[1], np.full(size, 1 / (seen + 1)), single, np.zeros(size, np.int64), *np.asarray([[first[k]] for k in (5, 0, 1, 4)]))
        p = _step(cuts[2], p[pairs % size], before, pairs // size, *follow)
        del follow, before
        return _step(cuts[3], p[pair], n, g.context, *after)

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        ids, langs, scores = [], [], [np.zeros(0)]
        for row in blocks.select(["blob", "ids", "langs"]).to_pylist():
            words, local, sizes, good = unpack(row["blob"])
            g, _ = grams_of(words, local, sizes)
            del words, local
            own = np.bincount(g.at[np.repeat(good > 0, sizes)], minlength=len(g.third))
            logs = np.log(chances(g, own, answers))[g.at] if sums and len(g.at) else np.zeros(len(g.at))
            total = np.concatenate(([0.0], np.cumsum(logs)))
            ends = np.cumsum(sizes)
            scores.append(np.exp(-(total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)))
            ids += row["ids"]
            langs += row["langs"]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "perplexity": pa.array(np.concatenate(scores))})

    return score


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
    block_bytes: int = BLOCK_BYTES,
    held_out: int = HELD_OUT,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``perplexity`` (per word), ``threshold``, ``kept``.

    All else is as in ``quality.score_quality``. Below single words all words are alike: one more than the trusted text
    has. Rows that repeat an id are of one block, and so are those without an id that share a text. Without trusted text every perplexity is 1. A text without words has a perplexity of 1.

    One trusted document in ``held_out``, by hash of its id, is left out of the model, and a language's limit is the quantile
    of those; a language that has none, and all if ``held_out`` is 0, take the quantile of the documents learnt.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks, shards = max(1, -(-size // block_bytes)), max(1, -(-size // shard_bytes))
    word_shards = -(-shards // PER_WORDS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("long").alias("block")
    # Rows without an id are never trusted, so any block will do for them.
    dealt_by = F.when(F.col(id_col).isNotNull(), block).otherwise(F.pmod(F.xxhash64(F.col(text_col)), F.lit(blocks))).alias("block")
    rows = docs.select(dealt_by, F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    known = trusted.where(F.col(id_col).isNotNull()).select(block, F.col(id_col).cast("long").alias("doc_id")).distinct()
    aside = (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(held_out)) == 0) if held_out else F.lit(False)
    keep = lambda blobs, ids: _keep(blobs, ids, shards)
    taught = known.where(~aside)
    dealt = lambda own: rows.where(own).mapInArrow(_pack, "block long, blob binary").repartition(parts, "block").groupBy("block")
    waves = lambda n, most: [F.pmod("block", F.lit(min(n, most))) == k for k in range(min(n, most))]
    kept = staged_parts([dealt(own).cogroup(taught.where(own).groupBy("block")).applyInArrow(keep, BLOCK) for own in waves(READS, blocks)], "kneser-ney-blocks")
    read = kept.where("n IS NULL").select("block", "blob", "ids", "langs")
    share = (kept.agg(F.sum("words")).first()[0] or 0) / shards
    # Words with more than a shard's share: fewer than there are shards.
    hot = {r["word"]: int(2 * r["n"] // share) for r in kept.where("n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()} if shards > 1 else {}
    texts = read.select("block", "blob")
    weights = np.zeros(min(WAVES, shards))
    for w, n_parts in hot.items():
        weights[int(mix(np.asarray([w]).view(np.uint64))[0] % np.uint64(len(weights)))] += n_parts
    asked = [texts.mapInArrow(_asker(shards, hot, int(k)), MESSAGE) for k in np.argsort(-weights, kind="stable")]
    replies = staged_parts([a.groupBy("shard").applyInArrow(_answerer(hot, word_shards), ANSWER) for a in asked], "kneser-ney-replies")
    of = lambda kind: replies.where(F.col("kind") == kind)
    message = lambda rows: rows.select("shard", "block", "blob")
    told = message(of(WORD))
    added, answers = of(SUMS), _given(of(REPLY), REPLY, "block", "shard", "blob")
    hot_follow = {}
    if hot:
        pair_messages = message(of(PAIR)).unionByName(texts.mapInArrow(_pair_asker(word_shards, hot), MESSAGE))
        pairs = staged(pair_messages.groupBy("shard").applyInArrow(_pair_answerer(word_shards), ANSWER), "kneser-ney-pairs", tidy=True)
        told, added = told.unionByName(message(pairs.where(F.col("kind") == WORD))), added.unionByName(pairs.where(F.col("kind") == SUMS))
        answers = answers.unionByName(_given(pairs.where(F.col("kind") == PAIR), PAIR, "block", "blob"))
        # One row per hot word.
        hot_follow = {r["a"]: list(r[1:]) for r in pairs.where(F.col("kind") == FOLLOW).groupBy("a").agg(*[F.sum(F.col("sums")[k]) for k in range(4)]).collect()}
    word_waves = min(WORD_WAVES, word_shards)
    to_words = [told.where(F.pmod("shard", F.lit(word_waves)) == k).unionByName(texts.mapInArrow(_word_asker(word_shards, word_waves, k), MESSAGE)) for k in range(word_waves)]
    singles = staged_parts([m.groupBy("shard").applyInArrow(_answer_words, ANSWER) for m in to_words], "kneser-ney-words")
    added = added.unionByName(singles.where(F.col("kind") == SUMS)).groupBy("a").agg(*[F.sum(F.col("sums")[k]) for k in range(6)])
    sums = {r["a"]: list(r[1:]) for r in added.collect()}
    sums = sums if sums.get(3, [0])[-1] else {}
    answers = answers.unionByName(_given(singles.where(F.col("kind") == WORD), WORD, "block", "shard", "blob"))
    score = _scorer(shards, word_shards, hot, sums, hot_follow)
    scored = staged_parts(
        [read.where(own).groupBy("block").cogroup(answers.where(own).groupBy("block")).applyInArrow(score, "doc_id long, lang string, perplexity double") for own in waves(WAVES, blocks)],
        "kneser-ney-scores",
    )
    judged = scored.join(known.select("doc_id", aside.alias("aside")), "doc_id")
    at = lambda c: F.percentile_approx(F.when(c, F.col("perplexity")), quantile, 10_000)
    limits = judged.groupBy("lang").agg(F.coalesce(at(F.col("aside")), at(F.lit(True))).alias("threshold"))
    # One row per language.
    return (
        scored.alias("s")
        .join(F.broadcast(limits.alias("l")), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
        .select("s.doc_id", "s.lang", "s.perplexity", "l.threshold", F.coalesce(F.col("s.perplexity") <= F.col("l.threshold"), F.lit(True)).alias("kept"))
    )
