"""Mixing sources to target weights, with DataFrame functions only.

A golden-ratio sequence gives every slot of the mix a point in [0, 1); the point falls into one source's interval
of cumulative block counts, and the slot's rank among its source's slots says which block of that source it takes:
what is in the mix, and where, comes from the join of slots and blocks. A source's blocks are consecutive runs of ``block`` words of its shuffled documents, laid end to end and repeated
as often as its share needs. All ranks and offsets are two-level prefix sums, so no source's rows meet in one task;
repeated rows are one row with a count until they are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, small_or_not, staged

GOLDEN = 2_654_435_769  # 2**32 / golden ratio, odd
TWO32 = 4_294_967_296
CHUNK = 4_096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size -> sid, weight, target, need (words to take).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; none gets over ``cap``
    times its size, and what is over goes to the others by weight. That is min(cap * size, level * weight) at the one
    level that spends the sum. The windows have one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.array(*map(F.lit, weights))
    s = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(w, ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("most", F.col("source_size").cast("double") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    before, every = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("most", "weight"))
    s = s.withColumn("level", (F.sum("source_size").over(every) - spent) / (F.sum("weight").over(every) - used))
    fits = F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "sid", "level"))
    s = s.withColumn("level", F.min(fits).over(every)["level"])
    s = s.withColumn("target", F.least("most", F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "sid", "weight", "target", F.least(F.round("target"), "most").cast("long").alias("need"))


def schedule(spark: SparkSession, sources: DataFrame, slots: int, n_sources: int, bins: int = 1_024) -> DataFrame:
    """sid, blocks (per source) -> slot, sid, rank: each source's ranks run from 0 to blocks - 1, each once.

    A slot finds its source by an equi-join on the bin of its point; a bin holds the intervals that touch it. The few
    blocks that a source has not met after ``slots`` slots follow, the sources in turn.
    """
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.where("blocks > 0").withColumn("hi", F.sum("blocks").over(upto)).withColumn("lo", F.col("hi") - F.col("blocks"))
    s = s.select("sid", "blocks", (F.col("lo") / slots).alias("lo"), (F.col("hi") / slots).alias("hi"))
    at = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    intervals = s.select("sid", "blocks", "lo", "hi", F.explode(F.sequence(at("lo"), at("hi"))).alias("bin"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") % (TWO32 // 2)) * GOLDEN) % TWO32 / TWO32).alias("u"))
    points = points.withColumn("bin", F.floor(F.col("u") * bins))
    hit = points.join(small_or_not(intervals, n_sources + bins), "bin").where("u >= lo AND u < hi")
    hit = hit.select("slot", "sid", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = chunks.select("sid", "chunk", base.alias("base"))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(bases, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("base") + F.col("r")).alias("rank"), "blocks")
    met = chunks.groupBy("sid").agg(F.sum("n").alias("met"))
    late = s.join(met, "sid", "left").withColumn("met", F.coalesce("met", F.lit(0))).where("met < blocks")
    late = late.select("sid", "met", F.explode(F.sequence(F.col("met"), F.col("blocks") - 1)).alias("rank"))
    late = late.select((F.lit(slots) + (F.col("rank") - F.col("met")) * n_sources + F.col("sid") - 1).alias("slot"), "sid", "rank")
    return ranked.where("rank < blocks").select("slot", "sid", "rank").unionByName(late)


def row_hash(seed: int = 7) -> Column:
    """What the shuffle goes by: a hash of doc_id and text, so that null and repeated ids spread too."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def each(groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """groups (with n) -> a row per row that each stands for, numbered i from 0. Large groups are dealt out in chunks."""
    small = groups.where(F.col("n") <= chunk).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    large = groups.where(F.col("n") > chunk).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    large = large.repartition("h", "c").withColumn("i", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("n"), (F.col("c") + 1) * chunk) - 1)))
    return small.unionByName(large.drop("c"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 4_096, bucket_rows: int = 1 << 20, seed: int = 7) -> DataFrame:
    """One row per piece of a document in the mix, and one with null slot for a document of which nothing is taken.

    slot (order in the mix), source, doc_id, size, source_size, target, h, n (the document's hash and how many rows are
    like it), row_key (sid, offset: names the document's row), copy (0: first pass over the source), first (word of the
    document that the piece starts at), take (words; 0 if no slot takes the piece's block). Null texts have size 0. Null
    doc_ids and repeated rows are documents of their own. Columns other than doc_id, text and source are not read. An
    empty table gives no rows. Rows with one hash go by doc_id, then size.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    thin = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), row_hash(seed).alias("h"))
    thin = staged(thin.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n")), "mix-docs")
    sizes = thin.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = staged(targets(sizes, weights, cap).withColumn("blocks", F.ceil(F.col("need") / block)), "mix-sources")
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    buckets = 1_024 + thin.count() // bucket_rows

    known = small_or_not(sources.select(F.col("source").alias("s_"), "sid", "source_size", "target", "need"), n_sources)
    d = thin.join(known, thin["source"].eqNullSafe(F.col("s_"))).drop("s_").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    d = d.withColumn("words", F.col("size") * F.col("n"))
    totals = d.groupBy("sid", "bucket").agg(F.sum("words").alias("w"))
    base = F.coalesce(F.sum("w").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("sid", "bucket", base.alias("base"))
    upto = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("o", F.sum("words").over(upto) - F.col("words")).join(small_or_not(bases, n_sources * buckets), ["sid", "bucket"])
    d = each(staged(d.withColumn("o", F.col("o") + F.col("base")).drop("base", "bucket", "words"), "mix-places"))
    d = d.withColumn("o", F.col("o") + F.col("i") * F.col("size"))

    some = (F.col("size") > 0) & (F.col("need") > F.col("o"))
    copies = F.when(some, F.sequence(F.lit(0).cast("long"), F.floor((F.col("need") - 1 - F.col("o")) / F.col("source_size"))))
    d = d.select("*", F.explode_outer(copies).alias("copy")).withColumn("at", F.col("copy") * F.col("source_size") + F.col("o"))
    d = d.withColumn("end", F.least(F.col("at") + F.col("size"), "need"))
    runs = F.when(F.col("copy").isNotNull(), F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)))
    d = d.select("*", F.explode_outer(runs).alias("rank"))
    pieces = d.join(schedule(spark, sources, slots, n_sources), ["sid", "rank"], "left")
    first = F.greatest(F.col("at"), F.col("rank") * block)
    take = F.when(F.col("slot").isNotNull(), F.least(F.col("end"), (F.col("rank") + 1) * block) - first)
    row_key = F.struct("sid", "h", "doc_id", "size", "i").alias("row_key")
    return pieces.select("slot", "source", "doc_id", "size", "source_size", "target", "h", "n", row_key, "copy", (first - F.col("at")).alias("first"), F.coalesce(take, F.lit(0)).cast("long").alias("take"))


def taken(pieces: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot: one row per document of mix()'s pieces."""
    what = ["doc_id", "source", "size", "source_size", "target"]
    d = pieces.groupBy("row_key").agg(*(F.first(c).alias(c) for c in what), F.sum("take").alias("taken"), F.min("slot").alias("first_slot"))
    return d.drop("row_key")


def whole_times(pieces: DataFrame) -> DataFrame:
    """h, doc_id, source -> slots: where in the mix each row of that kind stands whole, once per pass of its source that
    takes half of it or more. Rows that are alike share them evenly, to the nearest whole time."""
    passes = pieces.where("take > 0").groupBy("row_key", "copy").agg(*(F.first(c).alias(c) for c in ("h", "doc_id", "source", "size", "n")), F.sum("take").alias("words"), F.min("slot").alias("slot"))
    passes = passes.where("2 * words >= size").groupBy("h", "doc_id", "source", "n").agg(F.count("*").alias("all"), F.min("slot").alias("least"), F.sort_array(F.collect_list(F.when(F.col("n") == 1, F.col("slot")))).alias("own"))
    times = F.round(F.col("all") / F.col("n")).cast("long")
    spread = F.when(F.col("n") == 1, F.col("own")).when(times > 0, F.sequence(F.col("least"), F.col("least") + times - 1))
    return passes.select("h", "doc_id", "source", spread.alias("slots")).where("slots IS NOT NULL")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every document, its source and its first slot. Null texts have size 0; null and repeated ids
    are documents of their own; rows that are alike share their source's words in an order that reruns repeat."""
    return taken(mix(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")
