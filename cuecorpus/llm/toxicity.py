"""Toxicity: a bag of subwords averaged into a linear softmax, trained jointly in numpy.

A word's features are the word and its character n-grams, so a misspelling that was never seen shares most of its
vectors with the word it stands for. A passage is ``Settings.passage`` of a document's distinct words in order: the average of
its features' vectors goes through a linear softmax over two classes, which gives the odds of being toxic. Vectors and
softmax are learnt together, from labels of whole documents: a document is clean when all its passages are, so an insult
in a long text is not averaged away. A passage is long enough to count on: one odd word among many isn't toxic, several are.

Fitting uses a bounded sample of labelled rows (``Settings.sample``); scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm.words import _INVERSE, _MUL, _powers, batches_of, mix

WORD = re.compile(r"\w+")
LONG = 40
GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents of each class that fitting may use, those with the smallest hash of their id.
    ``sample_chars``: longer documents aren't part of the sample. ``passage``: distinct words that are averaged together;
    ``least``: features that an average is over at least, so that one word isn't a passage of its own. ``seen``:
    documents of the sample in which a feature must occur. ``enough``: loss of the
    labelled documents at which fitting stops, beyond which it learns them by heart. ``lift``: see :func:`fit`."""

    sample: int = 1000
    sample_chars: int = 30_000
    passage: int = 128
    buckets: int = 2**20
    dim: int = 4
    least: int = 768
    seen: int = 3
    epochs: int = 80
    enough: float = 0.03
    lift: float = 0.5
    rate: float = 0.3
    growth: float = 1.1
    decay: float = 1e-3
    threshold: float = 0.3
    seed: int = 7


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' features, and the word that each is of: the word and its n-grams of 3 to 5 characters, its
    two ends marked."""
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.asarray([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _powers(len(data))[: len(data)])))
    inverse = _powers(len(data), _INVERSE)
    found, owners = [], []
    for n in (0, *GRAMS):
        counts = np.maximum(sizes - n + 1, 0) if n else np.ones(len(sizes), np.int64)
        owner = np.repeat(np.arange(len(sizes)), counts)
        at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        end = at + (n or sizes[owner])
        found.append((sums[end] - sums[at]) * inverse[at] + np.uint64(n * int(_MUL) % 2**64))
        owners.append(owner)
    return (mix(np.concatenate(found)) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)


def words_of(text: str) -> list[str]:
    """A text's distinct words in order of first use, as repeated lines would outvote all else. Of runs over ``LONG`` characters, as scripts without spaces have them, each window of
    ``LONG`` counts as a word; windows share 4 characters, so that each n-gram of 5 is in one."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) > LONG:
        found = [p for w in found for p in ([w] if len(w) <= LONG else [w[i : i + LONG] for i in range(0, len(w) - 4, LONG - 4)])]
    return list(dict.fromkeys(found))


def _segments(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; empty runs give zero."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, _segments(lengths)[full], axis=0)
    return out


def _constant(odds: np.ndarray, passages: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> float:
    """The softmax's constant at which as many documents are expected to be toxic as are labelled so."""
    low, high, goal = -30.0, 30.0, float(weights @ labels)
    for _ in range(24):
        mid = (low + high) / 2
        expected = float(weights @ -np.expm1(-_sums(np.logaddexp(0, odds + mid), passages)))
        low, high = (mid, high) if expected < goal else (low, mid)
    return (low + high) / 2


class Bag:
    """Passages of words as sparse rows, with both directions of every sum laid out for ``reduceat``."""

    def __init__(self, texts: list[str], s: Settings):
        vocab: dict[str, int] = {}
        words = [np.asarray([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
        grams, owner = word_features(list(vocab), s.buckets)
        order = np.argsort(owner, kind="stable")
        self.features, inverse = np.unique(grams[order].astype(np.int32), return_inverse=True)
        self.gram_of = inverse.astype(np.int32)
        self.grams_per_word = np.bincount(owner, minlength=len(vocab))
        del grams, owner, order, inverse
        self.word_of = np.concatenate(words or [np.zeros(0, np.int32)])
        counts = [[len(w[i : i + s.passage]) for i in range(0, max(1, len(w)), s.passage)] for w in words]
        self.words_per_passage = np.asarray([c for x in counts for c in x], np.int64)
        self.passages_per_doc = np.asarray([len(x) for x in counts], np.int64)
        self.size = np.maximum(s.least, _sums(self.grams_per_word[self.word_of], self.words_per_passage))
        # Transposed: words sorted, with their passage; features sorted, with their word.
        self.by_word = np.argsort(self.word_of, kind="stable")
        self.passage_of = np.repeat(np.arange(len(self.words_per_passage), dtype=np.int32), self.words_per_passage)[self.by_word]
        self.uses = np.bincount(self.word_of, minlength=len(vocab))
        by_gram = np.argsort(self.gram_of, kind="stable")
        self.word_by_gram = np.repeat(np.arange(len(vocab), dtype=np.int32), self.grams_per_word)[by_gram]
        self.gram_uses = np.bincount(self.gram_of, minlength=len(self.features))
        # Documents that have a feature.
        self.docs_with = np.zeros(len(self.features), np.int32)
        limits = np.cumsum(self.grams_per_word)
        for w in words:
            own = np.unique(w)
            n = self.grams_per_word[own]
            at = np.arange(n.sum()) + np.repeat(limits[own] - n - (np.cumsum(n) - n), n)
            self.docs_with[np.unique(self.gram_of[at])] += 1

    def forward(self, e: np.ndarray) -> np.ndarray:
        words = _sums(e[self.gram_of], self.grams_per_word)
        return _sums(words[self.word_of], self.words_per_passage) / self.size[:, None]

    def backward(self, d: np.ndarray) -> np.ndarray:
        words = _sums((d / self.size[:, None])[self.passage_of], self.uses)
        return _sums(words[self.word_by_gram], self.gram_uses)


def _descend(bag: Bag, labels: np.ndarray, weights: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Odds of features and of passages, without a constant.

    Steps go down the slope itself, not evened out by feature, so what many documents share moves first. A step that leads
    upwards is taken back, and the next ones are half as long.
    """
    rng = np.random.default_rng(s.seed)
    e = rng.normal(0, 0.01, (len(bag.features), s.dim)).astype(np.float32)
    u = rng.normal(0, 1.0, (s.dim, 2)).astype(np.float32)
    scale = (1 / np.sqrt(np.maximum(1, bag.docs_with)))[:, None].astype(np.float32) * (bag.docs_with >= s.seen)[:, None]
    doc = np.repeat(np.arange(len(labels)), bag.passages_per_doc)
    w = weights / weights.sum()
    speed, rate, last = np.zeros_like(e), None, None
    for _ in range(s.epochs):
        x = bag.forward(e) * s.passage
        z = x @ u
        odds = z[:, 1] - z[:, 0]
        odds += _constant(odds, bag.passages_per_doc, w, labels)
        none = _sums(np.logaddexp(0, odds), bag.passages_per_doc)
        clean = np.exp(-none)  # all passages clean
        toxic = np.maximum(1 - clean, 1e-7)
        loss = float(w @ np.where(labels == 1, -np.log(toxic), none))
        if last is not None and loss > last[0]:
            _, e, u = last
            rate, speed, last = rate / 2, np.zeros_like(e), None
            continue
        last = (loss, e, u)
        if loss < s.enough:
            break
        p = 1 / (1 + np.exp(-odds))
        g = (p * np.where(labels == 1, -clean / toxic, 1.0)[doc] * w[doc]).astype(np.float32)
        dz = np.stack([-g, g], 1)
        de, du = bag.backward(dz @ u.T * s.passage) * scale, x.T @ dz
        if rate is None:
            rate = s.rate / max(float(np.abs(de).max()), 1e-12)
        speed = 0.8 * speed - rate * de
        e, u = e * (1 - s.decay) + speed, u - 0.1 * min(rate, s.rate / max(float(np.abs(du).max()), 1e-12)) * du
        rate *= s.growth
    if last is not None:
        _, e, u = last
    x = bag.forward(e) * s.passage
    return e @ (u[:, 1] - u[:, 0]), x @ (u[:, 1] - u[:, 0])


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Odds per feature and the constant: the product of the learnt vectors with the softmax's difference of classes.

    A model is surer of the documents that it was fitted on than of others; ``s.lift`` is added to the constant for that.
    """
    if not len(texts) or labels.min() == labels.max():
        return np.zeros(s.buckets, np.float32), -4.0 if not len(texts) or labels.max() == 0 else 4.0
    bag = Bag(texts, s)
    if not len(bag.features):
        return np.zeros(s.buckets, np.float32), -4.0
    found, odds = _descend(bag, labels, weights, s)
    out = np.zeros(s.buckets, np.float32)
    out[bag.features] = found
    return out, _constant(odds, bag.passages_per_doc, weights / weights.sum(), labels) + s.lift


class Scorer:
    """Scores whole texts; keeps what it worked out for words it has met, up to ``cache`` of them."""

    def __init__(self, odds: np.ndarray, bias: float, s: Settings, cache: int = 300_000):
        self.odds, self.bias, self.s, self.cache = odds, bias, s, cache
        self.known: dict[str, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0)

    def learn(self, words: list[str]) -> None:
        """Work out the odds of words that are not known yet."""
        at, owner = word_features(words, self.s.buckets)
        if len(self.known) >= self.cache:
            self.known.clear()
            self.sums, self.sizes = np.zeros(0), np.zeros(0)
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.sums = np.concatenate((self.sums, np.bincount(owner, weights=self.odds[at], minlength=len(words))))
        self.sizes = np.concatenate((self.sizes, np.bincount(owner, minlength=len(words))))

    def scores(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        for lo, hi in batches_of(texts, 2_000_000):
            found = [words_of(t) for t in texts[lo:hi]]
            distinct = set().union(*found)
            if len(self.known) + len(distinct) > self.cache:
                self.known.clear()
                self.sums, self.sizes = np.zeros(0), np.zeros(0)
            fresh = [w for w in distinct if w not in self.known]
            if fresh:
                self.learn(fresh)
            out += [self._score(np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))) for w in found]
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def _score(self, words: np.ndarray) -> float:
        if not len(words):
            return float(1 / (1 + np.exp(-self.bias)))
        starts = np.arange(0, len(words), self.s.passage)
        sums, sizes = np.add.reduceat(self.sums[words], starts), np.add.reduceat(self.sizes[words], starts)
        odds = self.s.passage * sums / np.maximum(sizes, self.s.least) + self.bias
        return float(-np.expm1(-np.logaddexp(0, odds).sum()))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of labelled documents; nothing but their text and label is used.

    The sample is drawn by hash of the id, ``s.sample`` documents of each class; classes are weighted back to their
    share among all labelled rows. Rows without a label or a text are left out; an id with several labels counts as
    toxic if one says so.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col)).alias("_label"))
    shares = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(id_col)
    chosen = None
    for c in (0, 1):
        # Twice as many ids as documents, as some may be too long or absent.
        part = known.where(F.col("_label") == c).orderBy(order).limit(2 * s.sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= s.sample_chars)).select(id_col, F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), id_col).select(order.alias("_o"), "_text", "_label").toArrow().sort_by([("_o", "ascending"), ("_text", "ascending")])
    texts_, labels_ = rows["_text"].to_pylist(), np.asarray(rows["_label"], dtype=np.int64)
    keep = np.sort(np.concatenate([np.flatnonzero(labels_ == c)[: s.sample] for c in (0, 1)]))
    texts_, labels_ = [texts_[i] for i in keep], labels_[keep]
    del rows
    counts = np.bincount(labels_, minlength=2)
    weights = np.asarray([shares.get(int(c), 0) / max(1, counts[int(c)]) for c in labels_])
    return fit(texts_, labels_, weights, s)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_score`` from 0 to 1; every whole text is read, null as empty. The model has a fixed size
    (``s.buckets`` numbers), so it is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value, s)
        for texts in batches:
            yield pd.Series(scorer.scores([t or "" for t in texts]), dtype="float64")

    return docs.withColumn("_score", score(F.col(text_col)))
