"""Mixing sources to target weights: temperature on token shares, realised as permutations of blocks. DataFrame functions only.

A source with token share p gets weight p^t / sum(p^t). The exponent t is the largest in [0, 1] whose weights reach
``target_entropy`` (a share of the highest possible entropy), raised again where a source would otherwise be repeated more than
``max_repeats`` times. Both are found by sections of [0, 1]: each round is one aggregation over the sources that
tries 31 exponents at once, five bisections in one pass.

Without a ``budget`` of tokens the smallest one is taken that leaves no document out: the least repeated source is read
once. Each source is cut into blocks of about ``block_tokens`` by a hash of its rows. Its quota is read in epochs, each with
the blocks in an order of its own; the last epoch ends in the middle of a block, at the first document that reaches the
quota. Which rows are read follows from a small table of blocks, so documents are dealt only once, to meet it.
``_slot`` in [0, 1) is a block's place in the whole run: any stretch of slots holds the sources in the target weights.

Defined results: a null source is a source; a null or wordless text has no tokens and is read with its block; a source without
any token is read once. Equal rows share a block and an order key and are read together, so the last block may exceed the
quota by them. No rows, no blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.session import materialise

_SECTIONS = 32


@dataclass(frozen=True)
class Mix:
    exponent: float
    entropy: float
    budget: float
    sources: DataFrame  # source, tokens, weight, repeats


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _largest(sources: DataFrame, holds, rounds: int = 6) -> float:
    """The largest exponent in [0, 1] for which ``holds`` (an aggregate over the sources, true below some point) is true."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        points = [low + (high - low) * k / _SECTIONS for k in range(1, _SECTIONS)]
        row = sources.agg(*[holds(t).alias(f"t{k}") for k, t in enumerate(points)]).first()
        good = [t for t, ok in zip(points, row) if ok]
        bad = [t for t, ok in zip(points, row) if not ok]
        low, high = max(good, default=low), min(bad, default=high)
    return low


def _power(t: float) -> Column:
    return F.pow("share", F.lit(t))


def entropy(t: float) -> Column:
    """Entropy of the weights at exponent t, as an aggregate: ln Z - t * sum(p^t ln p) / Z."""
    z = F.sum(_power(t))
    return F.log(z) - t * F.sum(_power(t) * F.log("share")) / z


def temperature(measured: DataFrame, *, target_entropy: float | None = 0.9, max_repeats: float | None = 4.0,
                budget: int | None = None) -> Mix:
    """Weights and repeats of each source from rows of ``source, tokens``."""
    counts = materialise(measured.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total, n, most, least = counts.where("tokens > 0").agg(
        F.sum("tokens"), F.count(F.lit(1)), F.max("tokens"), F.min("tokens")).first()
    if not total:
        return Mix(1.0, 0.0, 0.0, counts.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats")))
    shares = counts.where("tokens > 0").withColumn("share", F.col("tokens") / total)
    exponent = 1.0
    if target_entropy is not None and n > 1:
        goal = target_entropy * math.log(n)
        if shares.agg(entropy(1.0)).first()[0] < goal:
            exponent = _largest(shares, lambda t: entropy(t) >= goal)
    if max_repeats is not None and n > 1:
        # Repeats are tokens read over tokens there are; the smallest source is repeated most.
        def too_many(t: float) -> Column:
            read = F.lit(float(budget)) if budget else F.lit((most / total) ** (1 - t) * total) * F.sum(_power(t))
            return read * F.lit((least / total) ** t) / F.sum(_power(t)) / least > max_repeats

        if shares.agg(too_many(exponent)).first()[0]:
            exponent = _largest(shares, too_many)
    # Six digits of the exponent are kept, rounded up, so that a repetition limit still holds.
    exponent = min(1.0, math.ceil(round(exponent * 1e6, 3)) / 1e6)
    z, h = shares.agg(F.sum(_power(exponent)), entropy(exponent)).first()
    whole = float(budget) if budget else most / ((most / total) ** exponent / z)
    weight = F.pow(F.col("tokens") / total, F.lit(exponent)) / z
    sources = counts.select("source", "tokens", F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"))
    repeats = F.when(F.col("tokens") > 0, F.col("weight") * whole / F.col("tokens")).otherwise(1.0)
    return Mix(exponent, h, whole, sources.withColumn("repeats", repeats))


def row_key(id_: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def _block(key: Column, blocks: Column) -> Column:
    place = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(place * blocks / F.lit(2.0**32)).cast("long")


def _block_order(epoch: Column, source: Column, block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(source, F.lit("")), block.cast("string")))


def _row_order(epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", epoch.cast("string"), key))


def _before(rows: DataFrame, group: list[str], order: str, amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows of their group that come before; equal order keys count together.

    Sums per first two hex digits of the order key come first, so no task holds a whole group.
    """
    part = rows.withColumn("_part", F.substring(order, 1, 2))
    sums = part.groupBy(*group, "_part").agg(F.sum(amount).alias("_sum"))
    keys = ", ".join(f"`{g}`" for g in group)
    sums = sums.withColumn("_base", F.expr(
        f"coalesce(sum(_sum) over (partition by {keys} order by _part rows between unbounded preceding and 1 preceding), 0)"))
    named = sums.select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(group)], F.col("_part").alias("_sp"), "_base")
    on = F.col("_part") == F.col("_sp")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_s{i}"))
    joined = part.join(named, on)
    inner = F.expr(f"sum(`{amount}`) over (partition by {keys}, _part order by `{order}` range between unbounded preceding and current row)")
    same = F.expr(f"sum(`{amount}`) over (partition by {keys}, `{order}`)")
    return joined.withColumn(name, F.col("_base") + inner - same).select(*rows.columns, name)


def block_plan(measured: DataFrame, mix: Mix, *, block_tokens: int, seed: int) -> DataFrame:
    """Which blocks are read when: ``source, blocks, block, epoch, before`` (tokens of the source read before it in the epoch),
    ``slot`` and ``cut``: null if the whole block is read, else the last order key of its rows that is."""
    repeats = mix.sources.withColumn("blocks", F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long"))
    repeats = repeats.withColumn("quota", F.when(F.col("tokens") > 0, F.floor(F.col("repeats") * F.col("tokens") + 1e-3)).otherwise(0).cast("long"))
    repeats = repeats.select(F.col("source").alias("_of"), F.col("tokens").alias("_all"), "quota", "blocks")
    rows = measured.join(repeats, F.col("source").eqNullSafe(F.col("_of"))).withColumn("block", _block(F.col("key"), F.col("blocks")))
    rows = rows.select("source", "block", "key", "tokens", "quota", "blocks", F.col("_all").alias("of"))
    sizes = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.max("quota").alias("quota"), F.max("blocks").alias("blocks"), F.max("of").alias("of"))
    last = F.when(F.col("of") > 0, F.ceil(F.col("quota") / F.col("of")) - 1).otherwise(0).cast("int")
    epochs = sizes.withColumn("epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    epochs = epochs.withColumn("order", _block_order(F.col("epoch"), F.col("source"), F.col("block"), seed))
    placed = materialise(_before(epochs, ["source", "epoch"], "order", "size", "before"), "blocks")
    room = F.col("quota") - F.col("epoch") * F.col("of") - F.col("before")
    placed = placed.withColumn("room", F.when(F.col("of") > 0, room).otherwise(1)).where("room > 0 or (room = 0 and size = 0)")
    whole = placed.withColumn("slot", F.when(F.col("quota") > 0, (F.col("epoch") * F.col("of") + F.col("before")) / F.col("quota")).otherwise(0.0))
    # Blocks that a quota ends in: their rows in order, up to the one that reaches it.
    open_ = whole.where("room < size").select(F.col("source").alias("_of"), F.col("block").alias("_b"), "epoch", "room")
    ends = rows.join(open_, F.col("source").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_b"))).select(
        "source", "block", "epoch", "room", "tokens", _row_order(F.col("epoch"), F.col("key")).alias("order"))
    ends = _before(ends, ["source", "block", "epoch"], "order", "tokens", "done").where("done < room")
    cuts = ends.groupBy("source", "block", "epoch").agg(F.max("order").alias("cut")).select(
        F.col("source").alias("_of"), F.col("block").alias("_b"), F.col("epoch").alias("_e"), "cut")
    joined = whole.join(cuts, F.col("source").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_b")) & (F.col("epoch") == F.col("_e")), "left")
    return materialise(joined.select("source", "blocks", "block", "epoch", "before", "slot", "cut"), "plan")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = 0.9,
                max_repeats: float | None = 4.0, budget: int | None = None, block_tokens: int = 1_000_000, seed: int = 17) -> tuple[DataFrame, Mix]:
    """The rows of ``docs``, as struct ``_row``, once for each time they are read, with ``_epoch``, ``_block``, ``_before``, ``_slot`` and
    ``_tokens``; and the weights. ``docs`` is read twice, the second time only to be met with the table of blocks."""
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    field = lambda c: F.col("_row").getField(c)
    keyed = row.select("_row", field(source).cast("string").alias("source"), row_key(field(id_col), field(text)).alias("key"),
                       token_count(field(text)).alias("tokens"))
    measured = materialise(keyed.select("source", "key", "tokens"), "measured")
    mix = temperature(measured, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    plan = block_plan(measured, mix, block_tokens=block_tokens, seed=seed)
    # One row per block with its epochs, so that documents are dealt once, whatever they are repeated.
    blocks = plan.groupBy("source", "block").agg(F.max("blocks").alias("_n"), F.collect_list(F.struct("epoch", "before", "slot", "cut")).alias("_reads"))
    blocks = materialise(blocks.select(F.col("source").alias("_of"), F.col("block").alias("_b"), "_n", "_reads"), "reads")
    counts = blocks.groupBy("_of").agg(F.max("_n").alias("_blocks")).withColumnRenamed("_of", "_source")
    at = keyed.join(counts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_block", _block(F.col("key"), F.col("_blocks")))
    met = at.join(blocks, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_b")))
    read = met.select("_row", "key", F.col("tokens").alias("_tokens"), "_block", F.inline("_reads"))
    read = read.where(F.col("cut").isNull() | (_row_order(F.col("epoch"), F.col("key")) <= F.col("cut")))
    return read.select("_row", F.col("epoch").alias("_epoch"), "_block", F.col("before").alias("_before"), F.col("slot").alias("_slot"), "_tokens"), mix
