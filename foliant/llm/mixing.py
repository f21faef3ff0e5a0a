"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Each source's documents are dealt by a hash of their id into blocks of BLOCK_WORDS words; from MANY_BLOCKS blocks of a source
on, blocks and their number both grow with the root of its words, so that neither a source's list of blocks nor a block
becomes too much for a task. The tree's nodes hold one count for every source, 0 where it has no blocks. A source's target says
how many whole passes it gives and how many words more; of its blocks, in permuted order, those are drawn once more that
fit into these words, and from the next one single documents. Output shards get exact quotas of drawn blocks of each
source: a node of the tree splits its quotas between its halves as a multivariate hypergeometric draw. A source's drawn
blocks, permuted, are then handed to the shards by quota, so no block is drawn twice for one pass, and a shard's
documents are ordered by a hash of their own.

Defined results: a null or wordless text has size 0 and takes nothing. A null source is a source, the last. Rows equal in
doc_id, source and size are taken alike. Sources without words have target 0. Equal inputs give equal mixes. Other
columns are carried along by mix(). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import materialize, named

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: No source gives more than so many times its words.
MOST = 3
BLOCK_WORDS, MANY_BLOCKS = 65_536, 4096
#: Words of an output shard, about.
SHARD_WORDS = 1 << 20
#: Up to so many rows a small table is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
SEED = 7


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, sidx, source_size, target) from rows (source, size).

    Weights go round the sources in code point order. Sources whose share exceeds their limit stop there; taken by
    rising limit per weight they come first, and what they leave is shared anew, so one pass of running sums decides.
    One row for each source is all that meets in one task.
    """
    whole = Window.partitionBy()
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("sidx", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sidx", F.lit(len(weights))) + 1))
    rows = rows.withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    rising = whole.orderBy("ratio", "sidx")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("rate", rate).withColumn("stopped", F.col("ratio") <= F.col("rate"))
    last = F.max(F.when(~F.col("stopped"), F.col("rate"))).over(whole)
    target = F.when(F.col("stopped"), F.col("limit")).otherwise(F.col("weight") * last)
    return rows.withColumn("target", target).select("source", "sidx", "source_size", "target")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, out of `total` with `marked` marked ones, are marked: the inverse of the distribution at u.

    Weights run from the mode by the ratio of neighbours; twelve deviations away they no longer change a double.
    """
    args = F.struct(marked.cast("double").alias("k"), total.cast("double").alias("n"), drawn.cast("double").alias("d"), u.alias("u"))
    return let(args, lambda a: let(_bounds(a), lambda b: let(_weights(a, b), lambda w: _walk(a, b, w))))


def _bounds(a: Column) -> Column:
    """The mode, and the range around it that matters."""
    low, high = F.greatest(F.lit(0.0), a.d - (a.n - a.k)), F.least(a.k, a.d)
    mode = F.greatest(low, F.least(high, F.floor((a.d + 1) * (a.k + 1) / (a.n + 2)).cast("double")))
    part = a.k / F.greatest(a.n, F.lit(1.0))
    reach = F.floor(F.sqrt(F.greatest(F.lit(0.0), a.d * part * (1 - part) * (a.n - a.d) / F.greatest(a.n - 1, F.lit(1.0)))) * 12 + 30).cast("double")
    return F.struct(mode.cast("long").alias("mode"), F.greatest(low, mode - reach).cast("long").alias("low"), F.least(high, mode + reach).cast("long").alias("high"))


def _rise(a: Column, k: Column) -> Column:
    return (a.k - k) * (a.d - k) / ((k + 1) * F.greatest(a.n - a.k - a.d + k + 1, F.lit(1.0)))


def _fall(a: Column, k: Column) -> Column:
    return k * (a.n - a.k - a.d + k) / ((a.k - k + 1) * (a.d - k + 1))


def _weights(a: Column, b: Column) -> Column:
    """Sums of the weights upwards from the mode, mode included, and downwards, mode excluded; the mode's weight is one."""
    def total(ks: Column, ratio: Callable) -> Column:
        step = lambda s, k: F.struct((s.w * ratio(a, k.cast("double"))).alias("w"), (s.sum + s.w).alias("sum"))
        return F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), step, lambda s: s.sum)

    return F.struct(total(F.sequence(b.mode, b.high), _rise).alias("up"), (total(F.sequence(b.mode, b.low), _fall) - 1).alias("down"))


def _walk(a: Column, b: Column, w: Column) -> Column:
    """The first value, upwards from the mode, then downwards, at which the running sum passes u of the whole."""
    t = a.u * (w.up + w.down)
    up = t < w.up
    begin = F.struct(F.lit(1.0).alias("w"), F.when(up, 0.0).otherwise(w.up - 1).alias("sum"), F.lit(-1).cast("long").alias("at"))

    def step(s: Column, k: Column) -> Column:
        ratio = F.when(up, _rise(a, k.cast("double"))).otherwise(_fall(a, k.cast("double")))
        return F.struct((s.w * ratio).alias("w"), (s.sum + s.w).alias("sum"), F.when((s["at"] < 0) & (s.sum + s.w > t), k).otherwise(s["at"]).alias("at"))

    found = F.aggregate(F.sequence(b.mode, F.when(up, b.high).otherwise(b.low)), begin, step, lambda s: s["at"])
    return let(found, lambda k: F.when(k < 0, b.mode).otherwise(k))


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, sidx, quota) from (sidx, quota): exact random quotas of each shard, shards as full as each other to one block.

    The root is the list of all sources' quotas; each level splits every node's shards in halves and draws the first
    half's quotas source by source, given what earlier sources left.
    """
    root = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("sidx", "quota"))).alias("q")).where(F.size("q") > 0)
    root = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.transform("q", lambda x: x.sidx).alias("ids"), F.transform("q", lambda x: x.quota).alias("counts"))
    root = root.withColumn("all", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    nodes, width, level = root, shards, 0
    while width > 1:
        if level == 6:
            nodes = nodes.repartition("lo")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        room = F.floor(F.col("all") * middle / shards) - F.floor(F.col("all") * F.col("lo") / shards)
        parts = nodes.withColumn("mid", middle).withColumn("room", room.cast("long"))
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        begin = F.struct(total.alias("total"), F.col("room").alias("drawn"), F.lit(0).alias("i"), F.array().cast("array<long>").alias("out"))

        def draw(s: Column, k: Column) -> Column:
            got = hypergeometric(k, s.total, s.drawn, _unit(F.col("lo"), F.col("hi"), s.i))
            return let(got, lambda g: F.struct((s.total - k).alias("total"), (s.drawn - g).alias("drawn"), (s.i + 1).alias("i"), F.concat(s.out, F.array(g)).alias("out")))

        left = F.aggregate("counts", begin, draw, lambda s: s.out)
        parts = parts.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        halves = F.array(F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("left").alias("counts")), F.struct(F.col("mid").alias("lo"), F.col("hi"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")))
        same = F.array(F.struct("lo", "hi", "counts"))
        nodes = parts.select("ids", "all", F.explode(F.when(F.col("left").isNull(), same).otherwise(halves)).alias("n")).select("n.lo", "n.hi", "ids", "n.counts", "all")
        width, level = -(-width // 2), level + 1
    return nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("ids", "counts")).alias("x")).select("shard", F.col("x.ids").alias("sidx"), F.col("x.counts").alias("quota")).where("quota > 0")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it was counted and is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key_", F.xxhash64(F.lit(SEED), "doc_id", "size"))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of docs (doc_id, source, size, ...) with source_size, target and draws, an array of (copy, shard), empty if it isn't drawn."""
    sizes = materialize(docs.select("doc_id", "source", "size"), "mixing-sizes")
    sources = materialize(targets(sizes, weights, most), "mixing-sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    most_blocks = F.greatest(F.lit(MANY_BLOCKS), F.ceil(F.sqrt(F.col("source_size") / BLOCK_WORDS * MANY_BLOCKS)).cast("int"))
    sources = sources.withColumn("blocks", F.least(most_blocks, F.greatest(F.lit(1), F.ceil(F.col("source_size") / min(BLOCK_WORDS, shard_words)).cast("int"))))
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = _small(sources.withColumn("more", F.round("target").cast("long") - F.col("passes") * F.col("source_size")))

    def placed(df: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("source", "source_")
        return _keyed(df).join(s, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("block", F.pmod("key_", "blocks"))

    alike = materialize(placed(sizes).groupBy("sidx", "block", "passes", "more", "doc_id", "size", "key_").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows")), "mixing-placed")
    blocks = alike.groupBy("sidx", "block", "passes", "more").agg(F.sum("words").alias("words")).where("words > 0")
    permuted = Window.partitionBy("sidx").orderBy(F.xxhash64(F.lit(SEED + 1), "sidx", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    whole, part = F.col("before") + F.col("words") <= F.col("more"), F.col("before") < F.col("more")
    blocks = materialize(blocks.withColumn("copies", F.col("passes") + whole.cast("long")).withColumn("rest", F.when(part & ~whole, F.col("more") - F.col("before"))), "mixing-blocks")

    picked = _pick(alike.join(_small(blocks.where("rest is not null").select("sidx", "block", "rest")), ["sidx", "block"]))
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<long>"))
    drawn = blocks.select("sidx", "block", F.explode(F.concat(copies, F.when(F.col("rest").isNotNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")))).alias("copy"))
    shards = max(1, -(-words // shard_words))
    order = Window.partitionBy("sidx").orderBy(F.xxhash64(F.lit(SEED + 2), "sidx", "block", "copy"), "block", "copy")
    drawn = drawn.withColumn("rank", F.row_number().over(order).cast("long"))
    quotas = split_quotas(drawn.groupBy("sidx").agg(F.count("*").alias("quota")), shards)
    first = F.sum("quota").over(Window.partitionBy("sidx").orderBy("shard")) - F.col("quota") + 1
    handed = quotas.withColumn("first", first).select("sidx", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("rank"))
    given = drawn.join(handed, ["sidx", "rank"])
    plain = given.groupBy("sidx", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("copy") >= 0, F.struct("copy", "shard")))).alias("draws"),
        F.max(F.when(F.col("copy") < 0, F.col("shard"))).alias("part_shard"),
    )
    plain = _small(materialize(plain, "mixing-given"))
    chosen = _small(materialize(picked.select("sidx", "block", "doc_id", "size", F.lit(True).alias("picked")), "mixing-picked"))

    out = placed(docs).join(plain, ["sidx", "block"], "left")
    c = chosen.select(F.col("sidx").alias("sidx_"), F.col("block").alias("block_"), F.col("doc_id").alias("doc_"), F.col("size").alias("size_"), "picked")
    out = out.join(c, (F.col("sidx") == F.col("sidx_")) & (F.col("block") == F.col("block_")) & F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("size") == F.col("size_")), "left")
    extra = F.when(F.col("picked"), F.array(F.struct(F.col("passes").alias("copy"), F.col("part_shard").alias("shard"))))
    none = F.array().cast("array<struct<copy:bigint,shard:bigint>>")
    draws = F.when(F.col("size") > 0, F.concat(F.coalesce("draws", none), F.coalesce(extra, none))).otherwise(none)
    return out.select(*docs.columns, "source_size", "target", draws.alias("draws"))


def _pick(docs: DataFrame, rounds: int = 5) -> DataFrame:
    """Documents of the one block of each source that is drawn in part, about as many words as `rest` says.

    First in permuted order up to four fifths of it, then, a few times over, the largest that still fit, and last the one
    document that comes nearer to it by passing it, if there is one.
    """
    whole = Window.partitionBy("sidx", "block")
    docs = docs.where("size > 0").withColumn("taken", F.lit(False))
    room = F.col("rest") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("words"))).over(whole), F.lit(0))
    for i in range(rounds + 1):
        part = F.col("room") if i else F.col("room") * 0.8
        docs = docs.withColumn("room", room).withColumn("fits", ~F.col("taken") & (F.col("words") <= F.col("room")) if i else F.lit(True))
        order = ("key_", "doc_id", "size") if not i else (F.desc("words"), "key_", "doc_id")
        after = F.sum(F.when(F.col("fits"), F.col("words")).otherwise(0)).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        docs = docs.withColumn("taken", F.col("taken") | (F.col("fits") & (after <= part)))
    over = F.when(~F.col("taken") & (F.col("words") < F.col("room") * 2), F.struct(F.abs(F.col("words") - F.col("room")).alias("off"), F.col("key_").alias("key_"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size")))
    docs = docs.withColumn("room", room).withColumn("over", over).withColumn("best", F.min("over").over(whole))
    return docs.where(F.col("taken") | (F.col("over").isNotNull() & (F.col("over") == F.col("best"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: docs' own columns for every drawn copy, in shards, each shuffled."""
    own = docs.columns
    held = docs.select(F.struct(*[named(c) for c in own]).alias("row_"), F.col("doc_id"), F.col("source"), words_of(F.col("text")).alias("size"))
    drawn = draw(held, weights, most, shard_words).select("row_", F.explode("draws").alias("draw_")).select("row_", "draw_.copy", "draw_.shard")
    shuffled = drawn.withColumn("order_", F.xxhash64(F.lit(SEED + 3), "row_.doc_id", "copy", "shard"))
    return shuffled.repartition("shard").sortWithinPartitions("shard", "order_").select(*[F.col("row_").getField(c).alias(c) for c in own])


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) for every row of docs; shards are those that got its copies, in their order, comma-joined."""
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"))
    out = draw(sized, weights, most, shard_words)
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shards.alias("shards"))
