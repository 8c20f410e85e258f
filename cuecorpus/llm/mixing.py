"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens raised to an exponent and normalised. The exponent is found by bisection: the
smallest one, so the flattest mix, at which no source is read more than ``repeats`` times over and the entropy of the
weights is no higher than ``entropy`` asks. Each source then has a budget of tokens. Its documents are dealt into blocks
of about ``block_tokens``, or ``block_rows`` where documents are that short, by hash; an epoch is a permutation of the blocks, and a permutation inside each, and epochs are
read until the budget is spent. Only blocks are summed up in order, so no task walks over a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.llm.workspace import as_row, row_hash, staged

#: Times that a source may be read over.
REPEATS = 2.0
#: Tokens of a block, about.
BLOCK_TOKENS = 2_000_000
#: Documents of a block, about, where they hold few tokens or none.
BLOCK_ROWS = 50_000
SEED = 17
#: Exponents that are tried at once, and rounds: an interval of exponents shrinks to a 31st in each.
TRIED, ROUNDS = 32, 10
MADE = ("_epoch", "_position", "_tokens", "_at")


def temperature_weights(tokens: dict, budget: float | None = None, repeats: float = REPEATS, entropy: float | None = None) -> tuple[float, dict]:
    """The exponent from 0 to 1 and the weights of sources with ``tokens`` each.

    The limits are: ``budget`` times a weight is at most ``repeats`` times the source's tokens, and the weights' entropy in
    nats is at most ``entropy`` (by default no limit). Both loosen as the exponent grows towards 1, where the weights are
    the shares themselves; if even these break a limit, they are taken.
    """
    known = {k: v for k, v in tokens.items() if v > 0}
    total = sum(known.values())
    if not total:
        return 1.0, {k: 0.0 for k in tokens}
    budget = total if budget is None else budget
    shares = {k: v / total for k, v in known.items()}

    def weights(x: float) -> dict:
        raw = {k: math.exp(x * math.log(v)) for k, v in shares.items()}
        norm = math.fsum(raw.values())
        return {k: v / norm for k, v in raw.items()}

    def fits(w: dict) -> bool:
        return all(budget * w[k] <= repeats * known[k] * (1 + 1e-12) for k in w) and (entropy is None or -math.fsum(v * math.log(v) for v in w.values() if v) <= entropy + 1e-12)

    low, high = 0.0, 1.0
    if fits(weights(0.0)):
        high = 0.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(weights(mid)) else (mid, high)
    return high, {k: 0.0 for k in tokens} | weights(high)


def spread_exponent(sums: DataFrame, total: int, budget: float, repeats: float = REPEATS, entropy: float | None = None) -> float:
    """The exponent of :func:`temperature_weights` for any number of sources (``src``, ``t`` tokens above 0).

    The bisection tries several places at once: each round tries exponents between the last two that part those which break a limit from those which don't. For each,
    one aggregation gives the norm, the entropy and the largest ratio of a weight to its source's tokens.
    """
    low, high = 0.0, 1.0
    share = F.ln(F.col("t") / F.lit(float(total)))
    for k in range(ROUNDS):
        tried = [low + (high - low) * i / (TRIED - 1) for i in range(TRIED)]
        raw = F.exp(F.col("x") * F.col("l"))
        rows = sums.select("t", share.alias("l"), F.explode(F.array(*[F.lit(x) for x in tried])).alias("x"))
        got = rows.groupBy("x").agg(F.sum(raw).alias("z"), F.sum(raw * F.col("l")).alias("e"), F.max(raw / F.col("t")).alias("m")).collect()
        ok = {r["x"] for r in got if budget * r["m"] / r["z"] <= repeats * (1 + 1e-12) and (entropy is None or math.log(r["z"]) - r["x"] * r["e"] / r["z"] <= entropy + 1e-12)}
        at = next((i for i, x in enumerate(tried) if x in ok), TRIED - 1)
        if at == 0:
            return tried[0]
        low, high = tried[at - 1], tried[at]
    return high


def mix_sources(docs: DataFrame, tokens: Column, source_col: str = "source", id_col: str = "doc_id", budget: int | None = None, repeats: float = REPEATS, entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_epoch``, ``_position``, ``_tokens`` and ``_at``: a row for each time that a document is read.

    ``budget`` is in tokens, by default all that there are. A document is read in an epoch when the tokens before it in its
    source's order, all epochs taken together, are below the source's budget; so each source's sum passes its budget by
    less than one document. ``_position`` is that number of tokens, ``_at`` its part of the budget: the order of ``_at``
    reads all sources side by side, each at its weight.

    A null source is a source of its own. Null and negative numbers of tokens count as none; documents without tokens are
    read as often as the place they stand at, once if their whole source has none. Documents are dealt into blocks by a
    hash of all their columns, so null and repeated ids are spread; rows that repeat all columns are read alike, in turn.
    Columns of any names and types pass through, but for the four above, which are replaced. An empty table gives an empty
    table.

    However many sources there are, the driver learns sums over all of them only.
    """
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("src")
    size = F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)).alias("tokens")
    mark = F.xxhash64(F.col(id_col), row_hash(docs), F.lit(seed)).alias("mark")
    narrow = staged(docs.select(src, size, mark), "mixing-sizes")
    sums = narrow.groupBy("src").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    sums = staged(sums, "mixing-sums")
    total = sums.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    goal = total if budget is None else budget
    known = sums.where("t > 0")
    x = spread_exponent(known, total, goal, repeats, entropy) if total else 1.0
    norm = known.agg(F.sum(F.exp(F.lit(x) * F.ln(F.col("t") / F.lit(float(max(total, 1))))))).first()[0]
    weight = F.when(F.col("t") > 0, F.exp(F.lit(x) * F.ln(F.col("t") / F.lit(float(max(total, 1))))) / F.lit(norm or 1.0)).otherwise(0.0)
    plan = sums.select("src", F.col("t").alias("all"), F.rint(F.lit(float(goal)) * weight).cast("long").alias("budget"), F.greatest(F.ceil(F.col("n") / F.lit(block_rows)), F.ceil(F.col("t") / F.lit(block_tokens))).alias("blocks"))
    plan = staged(plan, "mixing-plan")
    block = F.pmod("mark", F.col("blocks")).alias("block")
    sized = narrow.join(plan, "src").groupBy("src", block, "all", "budget").agg(F.sum("tokens").alias("sum"))
    epochs = sized.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("budget") / F.greatest("all", F.lit(1))) - 1, F.lit(0)).cast("int"))).alias("epoch"))
    ordered = W.partitionBy("src", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    begun = epochs.withColumn("begin", F.col("all") * F.col("epoch") + F.sum("sum").over(ordered) - F.col("sum")).where((F.col("begin") < F.col("budget")) | (F.col("epoch") == 0) & (F.col("all") == 0))
    rows = docs.select(as_row(docs, MADE).alias("row"), src, size, mark).join(plan.select("src", "blocks"), "src")
    read = rows.select("row", "src", "tokens", "mark", block).join(begun.select("src", "block", "epoch", "begin", "budget", "all"), ["src", "block"])
    inside = W.partitionBy("src", "block", "epoch").orderBy(F.xxhash64("mark", "epoch"), "mark").rowsBetween(W.unboundedPreceding, 0)
    placed = read.withColumn("position", F.col("begin") + F.sum("tokens").over(inside) - F.col("tokens"))
    kept = placed.where((F.col("position") < F.col("budget")) | (F.col("all") == 0))
    return kept.select("row.*", F.col("epoch").alias("_epoch"), F.col("position").alias("_position"), F.col("tokens").alias("_tokens"), (F.col("position") / F.greatest("budget", F.lit(1))).alias("_at"))
