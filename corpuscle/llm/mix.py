"""Problem 9: mixing sources to target weights.

Tokens are summed per source; a source's repetition rate is its share of the mix divided by its tokens; every document
is emitted floor(rate) times and once more if a number drawn from a hash of its key and the seed is below the rate's
fraction. So a mix is the same on every run and every partitioning. A source of few documents may by chance draw far more or
less than its share; so ``DRAWS`` seeds are tried for each source, all in one aggregation, and the one holds whose draw comes
nearest to the source's wanted tokens (ties: the smaller seed).

Without a given size the mix is as large as the caps allow: the least of ``max_repeats * tokens / share`` over the
wanted sources that have tokens, their shares scaled to sum 1. With a given size, sources that would need more than
their cap stay at the cap and fall short; the report shows the shares reached.

Defined results: a document is an id; of several rows under one id the last ingested counts (ties: larger doc_id), rows
without an id count each; sources that are not wanted, null sources and texts without tokens add nothing; wanted sources
without documents appear in the report with share 0; of several targets for one source the largest share holds; empty
tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.encode import encode_corpus
from corpuscle.session import cut

#: Seeds that are tried for each source.
DRAWS = 64


def sizes(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(id, doc_id, source, n_tokens), one row a document; the texts themselves are never shuffled."""
    counted = encode_corpus(
        docs, "text", ("doc_id", "id", "source", "ingested_at"), "n_tokens", vocabulary, counts_only=True
    )
    ident = F.coalesce(F.col("id"), F.concat(F.lit("row "), F.col("doc_id")))
    last = F.max(F.struct(F.col("ingested_at"), F.col("doc_id"), F.col("source"), F.col("n_tokens"))).alias("r")
    return counted.groupBy(ident.alias("id")).agg(last).select("id", "r.doc_id", "r.source", "r.n_tokens")


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 0))
    return t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select(
        "source", "t.target_share", F.col("t.max_repeats").cast("double").alias("max_repeats")
    )


def rates(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, rate): one row a wanted source, at most as many as ``targets`` has rows."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = _targets(targets).join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    present = F.when(F.col("tokens") > 0, F.col("target_share"))
    scaled = t.agg(F.sum(present).alias("present"))
    if total_tokens is None:
        room = F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share")))
        total = t.agg((room * F.sum(present)).alias("total"), F.sum(present).alias("present"))
    else:
        total = scaled.withColumn("total", F.lit(float(total_tokens)))
    rate = F.when(
        F.col("tokens") > 0,
        F.least(F.col("max_repeats"), F.col("target_share") / F.col("present") * F.col("total") / F.col("tokens")),
    ).otherwise(F.lit(0.0))
    return t.crossJoin(total).select("source", "target_share", "max_repeats", "tokens", rate.alias("rate"))


def copies(key: Column, rate: Column, seed: Column) -> Column:
    """floor(rate), plus one with probability equal to the fraction, drawn from a hash of the key and the seed."""
    drawn = F.pmod(F.xxhash64(key, seed), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def seeds(sized: DataFrame, wanted: DataFrame, seed: int = 42, draws: int = DRAWS) -> DataFrame:
    """``wanted`` (rates) with the seed of each source whose draw comes nearest to rate * tokens."""
    some = sized.where(F.col("n_tokens") > 0).join(F.broadcast(wanted.select("source", "rate")), "source")
    tokens = [F.sum(copies(F.col("id"), F.col("rate"), F.lit(seed + i)) * F.col("n_tokens")) for i in range(draws)]
    tried = some.groupBy("source").agg(F.array(*tokens).alias("t"))
    off = F.transform("t", lambda x, i: F.struct(F.abs(x - F.col("rate") * F.col("tokens")).alias("off"), (i + seed).alias("seed")))
    return wanted.join(tried, "source", "left").withColumn("seed", F.coalesce(F.array_min(off).seed, F.lit(seed))).drop("t")


def _planned(docs: DataFrame, targets: DataFrame, total_tokens: float | None, seed: int, vocabulary: str | None) -> tuple[DataFrame, DataFrame]:
    sized = cut(sizes(docs, vocabulary))  # encoding is the cost of it all
    return sized, cut(seeds(sized, rates(sized, targets, total_tokens), seed))


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): one row for each use of a document in the mix."""
    sized, plan = _planned(docs, targets, total_tokens, seed, vocabulary)
    drawn = sized.join(F.broadcast(plan.select("source", "rate", "seed")), "source")
    uses = drawn.where(F.col("n_tokens") > 0).withColumn("n", copies(F.col("id"), F.col("rate"), F.col("seed"))).where(F.col("n") > 0)
    return uses.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy_no"), "n_tokens")


def report(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 42, vocabulary: str | None = None
) -> DataFrame:
    """(source, target_share, tokens, rate, mixed_docs, mixed_tokens, share_reached), one row a wanted source."""
    sized, plan = _planned(docs, targets, total_tokens, seed, vocabulary)
    n = copies(F.col("id"), F.col("rate"), F.col("seed"))
    got = sized.where(F.col("n_tokens") > 0).join(F.broadcast(plan.select("source", "rate", "seed")), "source").groupBy("source").agg(
        F.sum(n).alias("mixed_docs"), F.sum(n * F.col("n_tokens")).alias("mixed_tokens")
    )
    out = plan.join(got, "source", "left").fillna(0, ["mixed_docs", "mixed_tokens"])
    total = out.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return out.crossJoin(total).select(
        "source", "target_share", "tokens", "rate", "mixed_docs", "mixed_tokens",
        F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("all_tokens")), F.lit(0.0)).alias("share_reached"),
    )
