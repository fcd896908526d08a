"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

A source's documents are laid in a row in a fixed random order (md5 of the id), once for each epoch. The row is cut into blocks of
BLOCK_WORDS words; a document belongs to the block that it starts in, and only the last document of a source's share may be cut. So a
source's quota is a number of blocks, and its share is exact to the word. The quotas of all sources are split down a binary tree over
the output shards: the left half of a node's shards takes as many blocks as it has room for, and how many of them come from each
source is one multivariate hypergeometric draw. A leaf has the quotas of one shard. Shards draw their blocks from the row of
each source one after the other, so no block is drawn twice, and a shard's documents are put in an order of their own by hash.

What grows with the rows is shuffled as narrow rows of ids and sizes: running sums are made in ranges of about RANGE_ROWS rows, so
a source that holds a third of all rows is many ranges. Equal rows are counted before the shuffle. The tree has one row per
node with one number per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import cut_lineage

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
BLOCK_WORDS = 1 << 14
SHARD_WORDS = 1 << 24
RANGE_ROWS = 8192
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def word_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each text between ASCII white space; a null text has none."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _source_key() -> Column:
    """The source, told apart from null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, key, place, source_size, target, quota), one row per source of (source, size).

    Sources by code point, null last, weigh `weights` in turn and share percent % of all sizes. A target stops at `most` times its source's
    size and the excess is shared out by weight, until none is above: with sources by bound over weight, a source stops if
    the share that is left to it and all after it is above its bound. quota: the target in whole words."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_room, rest = (Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "place"),
                              Window.orderBy("room", "place").rowsBetween(0, Window.unboundedFollowing))
    placed = sums.withColumn("place", F.row_number().over(by_name) - 1)
    weighed = placed.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights))).withColumn(
        "bound", F.lit(most) * F.col("source_size")).withColumn("room", F.col("bound") / F.col("weight"))
    total = F.lit(percent) * F.sum("source_size").over(Window.partitionBy(F.lit(0))) / 100
    before = F.coalesce(F.sum("bound").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = weighed.withColumn("level", (total - before) / F.sum("weight").over(rest))
    open_level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.least(F.coalesce(open_level, F.lit(float("inf"))) * F.col("weight"), F.col("bound").cast("double"))
    return level.withColumn("target", target).select(
        "source", _source_key().alias("key"), "place", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def _let(value: Column, use) -> Column:
    """use(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _span(first: Column, last: Column) -> Column:
    """first, ..., last, or nothing."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` among `total` things are in a draw of `drawn`, by the inverse of the distribution at u in [0, 1).

    The weights come from the ratios of neighbouring probabilities, from the mode outwards to 12 standard deviations and 40 more, beyond
    which they are below the precision of a double."""
    zero, one = F.lit(0.0), F.lit(1.0)
    k, n, t = (c.cast("double") for c in (marked, drawn, total))
    spread = F.sqrt(F.greatest(n * (k / t) * (1 - k / t) * (t - n) / F.greatest(t - 1, one), zero))
    width = (F.ceil(spread * 12) + 40).cast("long")
    least, top = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    mode = F.least(F.greatest(F.floor((n + 1) * (k + 1) / (t + 2)).cast("long"), least), top)

    def rise(x):  # p(x + 1) / p(x)
        return (k - x) * (n - x) / ((x + 1) * (t - k - n + x + 1))

    def fall(x):  # p(x - 1) / p(x)
        return x * (t - k - n + x) / ((k - x + 1) * (n - x + 1))

    def mass(places, ratio):
        return F.aggregate(places, F.struct(one.alias("w"), zero.alias("sum")), lambda a, x: F.struct(
            (a["w"] * ratio(x.cast("double"))).alias("w"), (a["sum"] + a["w"] * ratio(x.cast("double"))).alias("sum")))["sum"]

    def reach(places, ratio, step, v):
        """The first place whose sum is above v; the last one where rounding leaves none."""
        start = F.struct(one.alias("w"), zero.alias("sum"), F.lit(None).cast("long").alias("at"))
        found = F.aggregate(places, start, lambda a, x: F.struct(
            (a["w"] * ratio(x.cast("double"))).alias("w"), (a["sum"] + a["w"] * ratio(x.cast("double"))).alias("sum"),
            F.coalesce(a["at"], F.when(a["sum"] + a["w"] * ratio(x.cast("double")) > v, x + step)).alias("at")))["at"]
        return F.coalesce(found, F.element_at(places, -1) + step)

    def draw(s):
        mode, up, down = s["mode"], s["up"], s["down"]

        def choose(m):
            return F.when(m["v"] < 1, mode).when(m["v"] < 1 + m["above"], reach(up, rise, 1, m["v"] - 1)).when(
                F.size(down) > 0, reach(down, fall, -1, m["v"] - 1 - m["above"])).otherwise(F.coalesce(F.element_at(up, -1) + 1, mode))

        sums = _let(F.struct(mass(up, rise).alias("above"), mass(down, fall).alias("below")), lambda m: F.struct(
            m["above"].alias("above"), (u * (1 + m["above"] + m["below"])).alias("v")))
        return _let(sums, choose)

    parts = _let(F.struct(mode.alias("mode"), least.alias("least"), top.alias("top"), width.alias("width")), lambda s: F.struct(
        s["mode"].alias("mode"), _span(s["mode"], F.least(s["top"], s["mode"] + s["width"]) - 1).alias("up"),
        F.reverse(_span(F.greatest(s["least"], s["mode"] - s["width"]) + 1, s["mode"])).alias("down")))
    return F.when(top <= least, top).otherwise(_let(parts, draw))


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.call_function("shiftrightunsigned", F.xxhash64(*of), F.lit(11)) / float(1 << 53)


def _draw_left(quotas: Column, room: Column, *of: Column) -> Column:
    """One multivariate hypergeometric draw of `room` blocks: source after source, each given those before."""
    left = F.aggregate(
        F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i"))),
        F.struct(room.alias("room"), F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("total"),
                 F.array().cast("array<bigint>").alias("out")),
        lambda a, s: _let(F.struct(hypergeometric(s["q"], a["total"], a["room"], _uniform(*of, s["i"])).alias("x")), lambda d: F.struct(
            (a["room"] - d["x"]).alias("room"), (a["total"] - s["q"]).alias("total"), F.concat(a["out"], F.array(d["x"])).alias("out"))))
    return left["out"]


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, place, blocks) from the block quotas (place, blocks): each source's blocks add up over the shards, and shard i has
    floor(all * (i + 1) / shards) - floor(all * i / shards) of them. Sources without blocks and empty shares are left out."""
    whole = quotas.agg(F.array_sort(F.collect_list(F.struct("place", F.col("blocks").cast("long").alias("blocks")))).alias("q"))
    zero = F.lit(0).cast("long")
    nodes = whole.select(zero.alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("q.place").alias("places"), F.col("q.blocks").alias("quota"),
                         F.aggregate("q.blocks", zero, lambda a, q: a + q).alias("all"))

    def room(first, last):
        return F.floor(F.col("all") * last / shards).cast("long") - F.floor(F.col("all") * first / shards).cast("long")

    for level in range((shards - 1).bit_length()):
        mid = F.ceil((F.col("lo") + F.col("hi")) / 2).cast("long")
        left = F.when(mid < F.col("hi"), _draw_left(F.col("quota"), room(F.col("lo"), mid), F.lit(seed), F.col("lo"), F.col("hi"))).otherwise(F.col("quota"))
        halves = nodes.withColumns({"left": left, "mid": mid})
        children = F.when(F.col("mid") < F.col("hi"), F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("quota")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")))).otherwise(
                F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("quota").alias("quota"))))
        nodes = halves.select("places", "all", F.explode(children).alias("c")).select("c.lo", "c.hi", "places", "c.quota", "all")
        if level % 5 == 4:  # deal the nodes to the tasks again
            nodes = cut_lineage(nodes.repartition("lo"))
    shares = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("quota").alias("blocks"))).alias("s"))
    return shares.select("shard", "s.place", "s.blocks").where("blocks > 0")


def document_shares(sizes: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS, seed: int = SEED) -> DataFrame:
    """(key, doc_id, size, n, source_size, target, quota, first): the distinct rows of (doc_id, source, size), how often each occurs, its
    source's figures and the word of the source's row at which the first of them starts."""
    items = sizes.select(_source_key().alias("key"), "doc_id", "size", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit("")))).alias("turn")).groupBy("key", "doc_id", "size", "turn").agg(F.count(F.lit(1)).alias("n"))
    ranges = max(1, -(-sizes.count() // range_rows))
    # the ranges follow the order of `turn`, so that cutting them doesn't change the order
    ranged = cut_lineage(items.withColumn("range", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")))
    sums = ranged.groupBy("key", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(
        targets.select("key", "place", "source_size", "target", "quota"), "key").drop("words")
    inside = Window.partitionBy("key", "range").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, ["key", "range"]).withColumn(
        "first", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).drop("range", "base", "turn")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        percent: int = PERCENT, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, range_rows: int = RANGE_ROWS,
        seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy, size, source_size, target, epoch, words, shard, turn): where each document stands in the mix.

    One row for each time the mix takes a document, with the words it takes (all but for the last document of a share, whose
    first words are taken), the epoch, the shard and the hash that orders a shard; a document that the mix doesn't take has one row with 0
    words and a null shard. Equal rows (doc_id, source, size) are told apart by `copy` and are taken apart; null ids are documents like
    others, null sources are one source, null texts have size 0 and take no part. The same rows give the same mix in any order
    and partitioning. Other columns are left out."""
    sizes = cut_lineage(word_sizes(docs, doc_id, text, source))
    targets = cut_lineage(source_targets(sizes, weights, percent, most))
    total = targets.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    quotas = targets.where("quota > 0").select("place", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"))
    runs = split_quotas(quotas, shards, seed)
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = runs.withColumn("from", F.coalesce(F.sum("blocks").over(upto), F.lit(0))).select(
        "place", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).alias("block"))
    rows = document_shares(sizes, targets, range_rows, seed).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    epochs = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(
        e.alias("epoch"), (e * F.col("source_size") + F.col("first") + F.col("copy") * F.col("size")).alias("at")))
    takes = F.transform(epochs, lambda e: F.struct(e["epoch"].alias("epoch"), e["at"].alias("at"), F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("quota") - e["at"])).alias("words")))
    taken = rows.withColumn("take", F.explode_outer(F.filter(takes, lambda t: t["words"] > 0)))
    placed = taken.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), "place", "doc_id", "copy", "size", "source_size", "target",
                          "take.epoch", "take.words", F.floor(F.col("take.at") / block_words).cast("long").alias("block"))
    return placed.join(drawn, ["place", "block"], "left").select(
        "doc_id", "source", "copy", "size", "source_size", "target", "epoch", F.coalesce("words", F.lit(0).cast("long")).alias("words"), "shard",
        F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(seed), "doc_id", "source", "copy", "epoch")).alias("turn"))


def words_taken(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of a mix: one row per document, with the words of all the blocks it was drawn in."""
    drawn = F.when(F.col("shard").isNotNull(), F.col("words")).otherwise(0)
    return mixed.groupBy("doc_id", "source", "copy", "size", "source_size", "target").agg(F.sum(drawn).alias("taken")).drop("source", "copy")


def mixed_texts(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: (shard, turn, epoch, and the columns of `docs`), a shard's rows together and in their order. The last document of a source's share
    ends after the words that were taken of it. Ids must be unique, null ids are left out."""
    rows = mixed.where("shard is not null and copy = 0").select(F.col("doc_id").alias("_mixed"), "shard", "turn", "epoch", "words", F.col("size").alias("_size"))
    spaced = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(spaced, F.lit(1), F.greatest(F.col("words").cast("int"), F.lit(0))), "")
    cut = docs.join(rows, F.col(doc_id) == F.col("_mixed")).withColumn(text, F.when(F.col("words") < F.col("_size"), head).otherwise(F.col(text)))
    return cut.select("shard", "turn", "epoch", *docs.columns).repartition("shard").sortWithinPartitions("shard", "turn")
