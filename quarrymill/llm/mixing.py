"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share raised to an exponent, normalised. The exponent is bisected over [0, 1] to meet
a target entropy of the weights, a limit on how often any source may repeat within the budget, or both (the larger
exponent counts). Five levels of bisection are read from one aggregate over the source totals, so sources are never
collected. Weight times budget is a source's part of the budget; it is dealt as whole epochs and one last part:
every epoch is a permutation of the source's blocks (buckets of documents by hash, at most `MAX_BLOCKS`), a block's
documents are permuted for each epoch, and the last part ends with the document that fills the budget.

Block starts come from prefix sums over blocks, and places within the one block that the budget cuts from prefix
sums inside it: no window spans a source's documents. All of it is DataFrame operations.

Defined results: a null source is a source of its own; documents without tokens come with their blocks and cost
nothing; a source without tokens gets no part, but `mixed_documents` with `whole` has each of its rows once; repeated
rows are dealt each; null ids are kept; extra columns are ignored by `mix` and kept by `mixed_documents`; an empty
table gives an empty result; where even the plain shares repeat a source more often than the limit (a budget above
limit * tokens), the plain shares are used; an entropy out of reach gives the nearest in reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialise, null_free

MAX_BLOCKS = 65_536
#: Bisection levels for each aggregate, and aggregates: the exponent to 2**-40.
LEVELS, PASSES = 5, 8


def word_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`, a tokenizer-free measure of a text."""
    return F.regexp_count(null_free(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _points(low: float, high: float) -> list[float]:
    n = 2**LEVELS
    return [low + (high - low) * k / n for k in range(n + 1)]


def find_exponent(totals: DataFrame, budget: float | None, target_entropy: float | None, max_repetition: float | None, whole: bool = False) -> float:
    """The exponent for rows (tokens) of source totals. Entropy is in nats. whole: the source dealt least comes once."""
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = totals.where("tokens > 0").select(F.log(F.col("tokens") / total).alias("lp"))
    budget = float(budget or total)

    def search(ok_of) -> float:
        """The least exponent at which ok holds, given that it holds from some exponent on."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = _points(low, high)
            term = F.exp(F.col("a") * F.col("lp"))
            ratio = F.exp((F.col("a") - 1) * F.col("lp"))
            each = shares.select("lp", F.posexplode(F.array(*map(F.lit, points))).alias("k", "a"))
            sums = each.groupBy("k", "a").agg(F.sum(term), F.sum(term * F.col("lp")), F.max(ratio), F.min(ratio)).orderBy("k").collect()
            ok = [ok_of(*r[1:]) for r in sums]
            at = next((k for k, x in enumerate(ok) if x), None)
            if at is None:
                return high
            if at == 0:
                return points[0]
            low, high = points[at - 1], points[at]
        return high

    found = 0.0
    if target_entropy is not None:  # entropy falls as the exponent grows
        found = max(found, search(lambda a, z, s, m, _: math.log(z) - a * s / z <= target_entropy + 1e-12))
    if max_repetition is not None:
        found = max(found, search(lambda a, z, s, m, least: (m / least if whole else m / z * budget / total) <= max_repetition * (1 + 1e-12)))
    return found if target_entropy is not None or max_repetition is not None else 1.0


def source_plan(sized: DataFrame, budget: float | None, target_entropy: float | None, max_repetition: float | None, block_tokens: int, whole: bool = False) -> DataFrame:
    """Rows (source, tokens, weight, part, n_blocks): each source's share of the budget and number of blocks.

    whole: the budget is scaled up until every source comes at least once.
    """
    totals = materialise(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-totals")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    a = find_exponent(totals, budget, target_entropy, max_repetition, whole)
    scale = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))
    z = totals.where("tokens > 0").agg(F.sum(scale)).first()[0] or 1.0
    plan = totals.where("tokens > 0").withColumn("weight", scale / z)
    if whole:
        budget = plan.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    part = F.lit(float(budget or total)) * F.col("weight") * (1 - 1e-9)  # rounding must not open one more epoch
    if whole:  # the source that sets the budget comes once, however the division rounds
        part = F.greatest(part, F.col("tokens").cast("double"))
    return plan.withColumn("part", part).withColumn("n_blocks", F.least(F.ceil(F.col("tokens") / block_tokens), F.lit(MAX_BLOCKS)).cast("int"))


def mix(docs: DataFrame, budget: float | None = None, target_entropy: float | None = None, max_repetition: float | None = 4.0, tokens: Column | None = None, block_tokens: int = 1_000_000, seed: int = 0, whole: bool = False) -> DataFrame:
    """One row for each time a document is dealt: doc_id, text_key, source, epoch from 1, block, block_rank, n_tokens, weight, order_key.

    Ordered by (order_key, shuffle_key) the rows are the mixture: all sources interleaved in proportion, block by block,
    documents permuted inside a block. budget: tokens to deal (default: as many as there are).
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(null_free("text")).alias("text_key"), "source", (word_count() if tokens is None else tokens).alias("n_tokens"))
    sized = materialise(sized, "mix-sizes")
    plan = materialise(source_plan(sized, budget, target_entropy, max_repetition, block_tokens, whole), "mix-plan")
    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    # few rows of four numbers: Spark broadcasts the plan if its size allows
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"), F.col("n_blocks")).cast("int")
    placed = sized.join(plan.select(F.col("source").alias("s"), "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "text_key", "source", "n_tokens", block.alias("block"))
    placed = materialise(placed, "mix-placed")
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    dealt = blocks.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("part") / F.col("tokens")).cast("int"), F.lit(1)))))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "source", "block"), "block")
    epochs = (
        epochs.withColumn("block_rank", F.row_number().over(order))
        .withColumn("start", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("start", F.coalesce("start", F.lit(0)) + (F.col("epoch") - 1) * F.col("tokens"))
        .where(F.col("start") < F.col("part"))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "block_rank", "start", "block_tokens", "weight", "part", (F.col("start") + F.col("block_tokens") > F.col("part")).alias("cut"))
    )
    rows = placed.join(epochs, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    rows = rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_key"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("shuffle_key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    inside_share = F.col("shuffle_key") / 2.0**64 + 0.5  # a document's place in its block, the same order as the key's
    last = rows.where("cut").withColumn("before", before).where(F.col("start") + F.col("before") < F.col("part")).drop("before")
    return rows.where("not cut").unionByName(last).select(
        "doc_id", "text_key", "source", F.col("epoch").cast("int").alias("epoch"), "block", F.col("block_rank").cast("int").alias("block_rank"), "n_tokens", "weight",
        F.least((F.col("start") + inside_share * F.col("block_tokens")) / F.col("part"), F.lit(1.0)).alias("order_key"), "shuffle_key",
    )


def _row_keys(doc_id: Column, text_key: Column, source: Column) -> list[Column]:
    """Equal for rows alike in id, text and source, and never null, so that one partitioning serves a join and a window."""
    return [F.coalesce(doc_id, F.lit(0)).alias("__d"), doc_id.isNull().alias("__dn"), text_key.alias("__k"), F.coalesce(source, F.lit("")).alias("__s"), source.isNull().alias("__sn")]


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as `mix` deals it, in the mixture's order: partitions follow each other and are sorted.

    Rows alike in id, text and source have the same turns; where a cut leaves turns for some of them only, the first of
    them by their other columns' hash get these. whole: rows that get no turn, of sources or blocks without tokens,
    come once.
    """
    return carried(docs, {"doc_id", "text", "source"}, lambda d: _mixed_documents(d, **options))


def _mixed_documents(docs: DataFrame, **options) -> DataFrame:
    spark = docs.sparkSession
    keys = ["__d", "__dn", "__k", "__s", "__sn"]
    dealt = mix(docs, **options)
    dealt = dealt.select(*_row_keys(F.col("doc_id"), F.col("text_key"), F.col("source")), "epoch", "order_key", "shuffle_key")
    # as many turns as rows alike in each whole epoch; at most one list entry an epoch
    dealt = dealt.groupBy(*keys, "epoch").agg(F.count(F.lit(1)).alias("m"), F.min("order_key").alias("order_key"), F.min("shuffle_key").alias("shuffle_key"))
    turns = dealt.groupBy(*keys).agg(F.collect_list(F.struct("order_key", "shuffle_key", "m")).alias("__turns"))
    keyed = docs.select("*", *_row_keys(F.col("doc_id").cast("long"), F.xxhash64(null_free("text")), F.col("source")))
    found = keyed.join(turns, keys, "left" if options.get("whole") else "inner")
    rest = [f.name for f in docs.schema if f.name not in ("doc_id", "text", "source") and "map<" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(0), *rest)))
    mine = F.filter("__turns", lambda t: F.col("__nth") <= t["m"])
    if options.get("whole"):
        once = F.array(F.struct(F.lit(0.0).alias("order_key"), F.col("__k").alias("shuffle_key"), F.lit(1).cast("long").alias("m")))
        mine = F.when(F.size(F.coalesce(mine, F.array().cast(turns.schema["__turns"].dataType))) == 0, once).otherwise(mine)
    found = found.withColumn("__nth", nth).select(*docs.columns, F.explode(mine).alias("__turn"))
    # order keys are shares of each source's tokens dealt so far, so equal parts of [0, 1) hold about equal shares of all
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col("__turn.order_key") * parts), F.lit(parts - 1)).cast("int")
    return found.repartitionById(parts, place).sortWithinPartitions("__turn.order_key", "__turn.shuffle_key", "doc_id").select(*docs.columns)
