"""Mixing sources to target weights, in DataFrame functions alone.

A source's documents, laid end to end, are packed into blocks of ``BLOCK`` words. The mix is made of output shards of
about ``SHARD_SLOTS`` slots, each slot filled by one block. How many slots of a shard a source fills is drawn first: a
multinomial draw of the source's slots over the shards, so that a shard's make-up is random while a source's total stays on
target. The counts, summed in order of the shards, number the slots: shard k holds slots b to b + c - 1 of a source, c its
draw and b the draws before. Slot s reads block p(s mod n) of the n blocks of its source, p a pseudorandom permutation of the
indices that changes with each pass over the source (a Feistel network of four rounds over the two digits of the index, walked
until it lies below n). Blocks and slots meet in a join by index.

A source may hold a third of all rows: its documents are laid out in lanes by a hash of the row, as many lanes as a lane has
documents, each lane summed on its own, and its slots are made in chunks. Sources are numbered by ranges of their names, and the level
of the targets comes from sums over all sources, so no task sees every source.

Defined cases: a null or empty text has size 0 and is returned with taken 0; a null source is a source
like others, the last in order; a null doc_id is carried; repeated rows are separate documents; an
empty table gives an empty result; extra columns are ignored by the digest and carried by ``emit``. Shares hold per source
within about one block plus half a pass of rounding on its last, partial block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm import common

#: Words of a block and slots of a shard: parameters of the operator, alike at every size of the input.
BLOCK = 32
SHARD_SLOTS = 4096
REPEATS = 3
_CHUNK = 65536
_ROUNDS = 4
#: Steps of a walk after the first. One lands outside with a chance of 1 in the digit's base at most, and never twice in one place.
_WALK = 48


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and row (a hash of all columns) of every document."""
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), count.alias("size"), common.row_hash(docs).alias("row"))


def _ranked(sources: DataFrame) -> tuple[DataFrame, str]:
    """``sources`` with rank, their number from 1 in order of code points, null last: ranges of names are counted, then numbered on their own. Also returns the path behind it."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt, path = common.materialize(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    sizes = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    ranked = dealt.withColumn("place", place).join(F.broadcast(sizes), "part").withColumn("rank", F.col("base") + F.col("place"))
    return ranked.drop("part", "place", "base"), path


def targets(sized: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, rank, weight, source_size, docs, target, blocks and slots of every source; one row each.

    Weights 1, 2, 3 repeat over the sources by code point. The level that shares all words by weight below the caps is found
    by resharing: a source whose share passes its cap keeps the cap, and the rest is shared anew, until none passes.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked, path = _ranked(totals)
    base = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    base, _ = common.materialize(base, "mix-base")
    common.discard(sized.sparkSession, path)
    total = base.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        spent, free, n = base.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == seen or not free:
            break
        level, seen = (total - spent) / free, n
    blocks = F.ceil(F.col("source_size") / BLOCK)
    use = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    return (
        base.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")))
        .withColumn("blocks", blocks)
        .withColumn("slots", F.least(use, F.lit(repeats) * F.col("blocks")))
        .select("source", "rank", "weight", "source_size", "docs", "target", "blocks", "slots")
    )


def shard_counts(sources: DataFrame) -> DataFrame:
    """The draw: rank, blocks, shard and count, how many slots of a shard each source fills; and first, the number of the first of them.

    A source's slots are so many trials with one outcome among the shards, which is a multinomial draw of its counts.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = sources.agg(F.greatest(F.lit(1), F.ceil(F.sum("slots") / SHARD_SLOTS)).alias("shards"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(_CHUNK).cast("long")))
    chunks = sources.where("slots > 0").select("rank", "blocks", "slots", chunk.alias("from")).repartition(parts, "rank", "from")
    trial = F.explode(F.sequence(F.col("from"), F.least("slots", F.col("from") + _CHUNK) - 1))
    trials = chunks.select("rank", "blocks", trial.alias("trial")).join(F.broadcast(shards))  # one row
    drawn = trials.groupBy("rank", "blocks", F.pmod(F.xxhash64(F.lit("shard"), "rank", "trial"), F.col("shards")).alias("shard")).agg(F.count("*").alias("count"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.select("rank", "blocks", "shard", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))


def _permuted(slot: Column, blocks: Column, rank: Column) -> Column:
    """Place of ``slot mod blocks`` in the permutation of its pass: a bijection of 0 to blocks - 1."""
    turn = F.floor(slot / blocks)
    base = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    high = F.ceil(blocks / base).cast("long")

    def network(x: Column) -> Column:
        low, top = x % base, F.floor(x / base)
        for k in range(_ROUNDS):
            if k % 2:
                top = (top + F.pmod(F.xxhash64(rank, turn, F.lit(k), low), high)) % high
            else:
                low = (low + F.pmod(F.xxhash64(rank, turn, F.lit(k), top), base)) % base
        return top * base + low

    once = network(slot % blocks)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once, lambda x, _: F.when(x < blocks, x).otherwise(network(x)))
    return F.when(once < blocks, once).otherwise(walked)


def slots(sources: DataFrame) -> DataFrame:
    """rank, shard, slot and block of every slot of the mix, made from the counts drawn for the shards."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = shard_counts(sources).repartition(parts, "rank", "shard")
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1))
    each = counts.select("rank", "blocks", "shard", slot.alias("slot"))
    return each.select("rank", "shard", "slot", _permuted(F.col("slot"), F.col("blocks"), F.col("rank")).alias("block"))


def layout(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its first word's place in its source, summed lane by lane."""
    lane = F.pmod(F.xxhash64("doc_id", "row"), F.ceil(F.sqrt("docs")))
    named = sources.select(F.col("source").alias("_s"), "rank", "docs")
    placed = sized.join(named, sized.source.eqNullSafe(F.col("_s"))).select("doc_id", "size", "row", "rank", lane.alias("lane"))
    lanes = placed.groupBy("rank", "lane").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("rank", "lane", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "lane").orderBy("doc_id", "size", "row")
    run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        placed.withColumn("pos", F.row_number().over(within))
        .withColumn("run", run)
        .join(lanes, ["rank", "lane"])
        .select("doc_id", "size", "row", "rank", "lane", "pos", (F.col("base") + F.col("run")).alias("start"))
    )


def _cut(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The layout's documents cut at blocks, with first (word of the document) and words of each piece; words are null where the document is empty."""
    placed = layout(sized, sources)
    last = F.col("start") + F.col("size")
    block = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((last - 1) / BLOCK))))
    cut = placed.withColumn("block", block)
    first = F.greatest("start", F.col("block") * BLOCK)
    return cut.withColumn("words", F.least(last, (F.col("block") + 1) * BLOCK) - first).withColumn("first", first - F.col("start"))


def pieces(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The mix itself: each piece of a document with uses, the slots that read its block (null: none)."""
    used = slots(sources).groupBy("rank", "block").agg(F.count("*").alias("uses"))
    return _cut(sized, sources).join(used.hint("merge"), ["rank", "block"], "left")  # Spark estimates slots by the sources they come from, a few rows


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sized, _ = common.materialize(sizes(docs), "mix-size")
    sources, _ = common.materialize(targets(sized), "mix-source")
    return sized, sources


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized, sources = _prepared(docs)
    taken = F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0))
    return (
        pieces(sized, sources)
        .groupBy("rank", "lane", "pos", "doc_id", "size")
        .agg(taken.alias("taken"))
        .join(sources.select("rank", "source_size", "target"), "rank")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def _tokens(text: Column) -> Column:
    """The words of a text, each with the white space behind it."""
    return F.regexp_extract_all(text, F.lit(common.WORD + r"[\x20\x09-\x0D]*"), F.lit(0))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _taken_text(text: Column, parts: Column) -> Column:
    """The words of the pieces (first, words, uses, in order of first), each as often as used: pass after pass in the document's order.

    Pieces that meet keep the white space between them; others are set apart by a line end.
    """

    def joined(held: Column) -> Column:
        def turn(k: Column) -> Column:
            own = F.filter(held["parts"], lambda p: p["uses"] > k)

            def piece(p: Column, i: Column, all_: Column) -> Column:
                words = F.array_join(F.slice(held["tokens"], (p["first"] + 1).cast("int"), p["words"].cast("int")), "")
                meets = F.get(all_, i + 1)["first"] == p["first"] + p["words"]  # null for the last
                gap = F.when(i + 1 < F.size(all_), F.lit("\n")).otherwise(F.lit(""))
                return F.when(meets, words).otherwise(F.concat(F.rtrim(words, F.lit(" \t\n\v\f\r")), gap))

            return _once(own, lambda all_: F.array_join(F.transform(all_, lambda p, i: piece(p, i, all_)), ""))

        most = F.array_max(F.transform(held["parts"], lambda p: p["uses"]))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), most - 1), turn), "\n")

    return _once(F.struct(_tokens(text).alias("tokens"), parts.alias("parts")), joined)


def emit(docs: DataFrame) -> DataFrame:
    """The mix by document: text (and n_chars, if there) is what the slots take of it, with repeats; taken counts its words.

    Rows are told apart by all their columns, whatever their doc_id; equal rows have each their own share.
    """
    row, key, takes, parts, taken = common.fresh(docs, "_row", "_key", "_takes", "_parts", "taken")
    sized, sources = _prepared(docs)
    each = pieces(sized, sources).where("uses > 0 and words > 0").groupBy("rank", "lane", "pos", "row").agg(F.array_sort(F.collect_list(F.struct("first", "words", "uses"))).alias("parts"))
    shares = each.groupBy(F.col("row").alias(key)).agg(F.collect_list("parts").alias(takes))
    marked = docs.withColumn(row, common.row_hash(docs))
    many, _ = common.materialize(sized.groupBy(F.col("row").alias(key)).count().where("count > 1").select(key), "mix-repeated")
    single = marked.join(many, F.col(row) == F.col(key), "left_anti")
    repeated = marked.join(many, F.col(row) == F.col(key), "left_semi").dropDuplicates([row])
    dealt = single.unionByName(repeated).join(shares, F.col(row) == F.col(key)).select(*common.own(docs), F.explode(takes).alias(parts))
    words = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["words"] * p["uses"])
    made = dealt.withColumn(taken, words).withColumn("text", _taken_text(F.col("text").cast("string"), F.col(parts))).drop(parts)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def shards(docs: DataFrame) -> DataFrame:
    """The mix by output shard: shard, place (in the shard), source and text of every slot, a block of ``BLOCK`` words set apart by spaces.

    A source's last block may be shorter. Documents follow each other within a block; the order of the slots in a shard is drawn by hash.
    """
    sized, sources = _prepared(docs)
    cut = _cut(sized, sources).where("words > 0").select("rank", "block", "start", "first", "words", "row")
    words = docs.select(common.row_hash(docs).alias("row"), F.regexp_extract_all(F.col("text").cast("string"), F.lit(common.WORD), F.lit(0)).alias("tokens")).dropDuplicates(["row"])
    text = F.array_join(F.slice("tokens", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    packed = cut.join(words, "row").select("rank", "block", F.struct((F.col("start") + F.col("first")).alias("at"), text.alias("text")).alias("piece"))
    packed = packed.groupBy("rank", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), " ").alias("text"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("rank", "slot"), "rank", "slot"))
    dealt = slots(sources).withColumn("place", place).join(packed, ["rank", "block"])
    return dealt.join(sources.select("rank", "source"), "rank").select("shard", "place", "source", "text")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
