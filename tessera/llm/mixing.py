"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` times all words; a target
stops at `cap` times its source's size and the excess is shared again by weight. In closed form: with the sources in
order of cap / weight and all before k stopped, level(k) = what is left / the weights left; the final level is the
largest of these and a target is min(cap, weight * level).

Quotas. Blocks of equally many words go to sources by the highest quotients target / (2 * given + 1), and a source's
blocks to its shards likewise by their sizes. The blocks are not counted out one by one: rounding target / divisor with
a divisor that is certainly too large gives an allocation that the method passes through, and at most as many blocks
as there are parts remain to be awarded by quotient.

Selection. A shard's documents, in seeded order, form a line of words cut into blocks. Each block is taken
quota div n times, and of n blocks quota mod n once more: those whose number a seeded one-to-one map of 0..n-1 sends
below that. A document reads its own blocks off its place in the line; nothing is exploded by block and the same seed
gives the same mix.

Scale. The table of (id, source, size) is written once, then shuffled by shard: shards hold about `shard_docs`
documents, up to 4096 a source, so a hot source is spread over as many tasks. Tables of sources and shards are sums.

Defined cases: null text has size 0, target and taken then come out 0 for it; a null source is a source; null ids
and repeated rows are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import WORD_PATTERN, cut

WEIGHTS = (5, 2, 1)
MOST_SHARDS = 4096
#: Fixed value: the largest prime below 2^31 - 18, so that multiplying by it is one to one modulo any smaller number.
STRIDE = 2147483629


def seeded(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of key and seed, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 15), 16, 10).cast("long")


def apportion(parts: DataFrame, group: list[str], key: str, share: str, house: str) -> DataFrame:
    """Sainte-Laguë: the house's seats of each group to its parts by share; ties to the smaller key. Adds `seats`."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    t, s, n = F.sum(share).over(w), F.count("*").over(w), F.col(house)
    base = F.when((F.col("_t") > 0) & (n > F.col("_s") / 2), F.floor(F.col(share) * (n - F.col("_s") / 2) / F.col("_t") + 0.5)).otherwise(0).cast("long")
    a = parts.withColumns({"_t": t.cast("double"), "_s": s}).withColumn("_base", base)
    a = a.withColumn("_rest", n - F.sum("_base").over(w))
    more = F.when(F.col("_t") > 0, F.floor(F.col(share) * F.col("_s") / F.col("_t")) + 1).otherwise(0).cast("int")
    b = a.withColumn("_j", F.explode(F.sequence(F.lit(0), more)))
    quotient = F.col(share) / (2 * (F.col("_base") + F.col("_j")) + 1)
    rank = F.row_number().over(w.orderBy(F.desc("_q"), key, "_j"))
    b = b.withColumn("_q", quotient).withColumn("_won", (rank <= F.col("_rest")) & (F.col("_q") > 0))
    won = b.groupBy(*group, key).agg(F.max("_base").alias("_base"), F.sum(F.col("_won").cast("long")).alias("_won"))
    seats = won.select(*group, key, (F.col("_base") + F.col("_won")).alias("seats"))
    return parts.join(seats, [*group, key])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_no (from 1), source_size, source_docs, target of each source; one row a source."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")).withColumn("source_no", F.row_number().over(order).cast("long"))
    s = s.withColumn("_w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(cap) * F.col("source_size"))
    all_ = Window.partitionBy(F.lit(0))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.lit(share) * F.sum("source_size").over(all_) - before) / left)
    s = s.withColumn("target", F.least("_cap", F.col("_w") * F.max("_level").over(all_)))
    return s.select("source", "source_no", "source_size", "source_docs", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = 16, blocks_per_source: int = 1000, shard_docs: int = 200, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, tie (hash of the text), source_no, shard, source_size, target, taken of every row. A block has `block` words, or fewer where the
    average source would have under `blocks_per_source` of them."""
    sized = cut(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("tie")))
    targets = source_targets(sized, weights, share, cap).withColumn("_all", F.sum("target").over(Window.partitionBy(F.lit(0)))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    b = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("_all") / (blocks_per_source * F.col("_n"))))).cast("long")
    targets = targets.withColumn("block", b).withColumn("house", F.round(F.col("_all") / F.col("block")).cast("long"))
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_docs") / shard_docs)))
    sources = cut(apportion(targets, [], "source_no", "target", "house").select("source", "source_no", "source_size", "target", "block", F.col("seats").alias("house"), shards.cast("long").alias("shards")))
    placed = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.size", "d.tie", "s.source_no", "s.source_size", "s.target", "s.block", "s.house", F.pmod(seeded(F.col("d.doc_id"), seed), F.col("s.shards")).alias("shard"))
    each = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("line"), F.max("house").alias("house"), F.max("block").alias("block"))
    quotas = apportion(each.withColumn("_share", F.col("line").cast("double")), ["source_no"], "shard", "_share", "house")
    n = F.ceil(F.col("line") / F.col("block")).cast("long")
    quotas = quotas.withColumn("n", n).withColumn("quota", F.least("seats", (F.lit(cap) * F.col("n")).cast("long"))).select("source_no", "shard", "n", "quota", F.when(F.col("n") > 0, F.pmod(seeded(F.concat_ws(":", "source_no", "shard"), seed), F.col("n"))).otherwise(0).alias("turn"))
    line = Window.partitionBy("source_no", "shard").orderBy(seeded(F.col("doc_id"), seed + 1), "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.join(quotas, ["source_no", "shard"]).withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    end = F.col("start") + F.col("size")
    own = F.sequence(F.floor(F.col("start") / F.col("block")).cast("long"), F.floor((end - 1) / F.col("block")).cast("long"))
    chosen = F.filter(own, lambda j: (j * STRIDE + F.col("turn")) % F.col("n") < F.col("quota") % F.col("n"))
    extra = F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, j: acc + F.least(end, (j + 1) * F.col("block")) - F.greatest(F.col("start"), j * F.col("block")))
    taken = F.when(F.col("size") > 0, F.floor(F.col("quota") / F.col("n")).cast("long") * F.col("size") + extra).otherwise(0).cast("long")
    return laid.select("doc_id", "source", "size", "tie", "source_no", "shard", "source_size", "target", taken.alias("taken"))


def draw(docs: DataFrame, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The mix in whole documents: each row of docs, all columns, taken / size times on average. Fractions are rounded
    along each shard's rows in order of size, from a seeded start: what one row loses the next of about its size gains,
    so that a source's words come near its target. Reruns agree. Rows without words are not taken. Rows that share an
    id are told apart by source, size and text."""
    line = Window.partitionBy("source_no", "shard").orderBy("size", seeded(F.col("doc_id"), seed + 2), "doc_id", "tie")
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    end = F.sum(share).over(line.rowsBetween(Window.unboundedPreceding, 0)) + seeded(F.concat_ws(":", "source_no", "shard"), seed + 3) / float(1 << 60)
    copies = F.least(F.floor(end) - F.floor(end - share), F.ceil(share)).cast("int")
    drawn = cut(mix(docs, seed=seed, text=text, source=source, doc_id=doc_id, **settings).select("doc_id", "source", "size", "tie", copies.alias("copies")))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[doc_id].alias("id"), docs[source].alias("of"), word_count(docs[text]).alias("words"), F.xxhash64(docs[text]).alias("hash"))
    if docs.groupBy(docs[doc_id]).count().where("count > 1").isEmpty():
        rows = whole.join(drawn.where("copies > 0").select("doc_id", "copies"), F.col("id").eqNullSafe(F.col("doc_id")))
    else:
        number = lambda *c: F.row_number().over(Window.partitionBy(c[0]).orderBy(*c[1:]))
        own = whole.withColumn("number", number("id", "of", "words", "hash"))
        drawn = drawn.withColumn("no", number("doc_id", "source", "size", "tie")).where("copies > 0").select("doc_id", "no", "copies")
        rows = own.join(drawn, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("number") == F.col("no")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
