"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions throughout.

Each source gets a share of the mix by its weight, at most ``MOST`` times its size; what is cut off is shared out again. Within a source
documents expect unequal numbers of copies, e = min(MOST, c x): x = size / (size + ``HALF``), so that scraps of a few words are taken less often
than texts of some length, and c such that the expected words are the target's. Whole copies (floor e) are certain. For the rest p = e - floor e, the
inclusion probability, documents are ranked by Q = (U / (1 - U)) / (p / (1 - p)), U uniform by hash (Rosén, 1997); the lowest ranks are
taken up to the words still missing. The rank at which that happens is found by descending its digits, each level an aggregation that is
partly added up before its shuffle, so no source's documents are ever brought together, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.plans.storage import join_small, materialize

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words of a document that is half as likely to be taken as the longest; steps in which the likelihood is told apart, so that a source has as many at most.
HALF, STEPS = 50, 1024
#: Digits of a rank, and bits of each; the first three order by Q, the last two by row.
LEVELS, DIGIT = 5, 12


def word_count(text: Column) -> Column:
    """Number of runs of characters other than x20 and x09-x0D; of null 0. A run begins where such a character follows none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``_part`` and ``_at``, which together follow ``order``: sorted over all partitions, so that a running sum is one within
    each partition and one over the partitions' sums."""
    at = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(at.select(*rows.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")), "numbered")


def _running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``_numbered`` rows with, for each of ``sums``, what the rows before add up to."""
    parts = rows.groupBy("_part").agg(*[F.sum(x).alias(f"_all_{c}") for c, x in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_all_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(parts), rows["_part"] == parts["_of"])
    return out.select(*rows.columns, *[(F.col(f"_all_{c}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(c) for c, x in sums.items()])


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for rows ``source, source_size``, one per source.

    Sources by code point, null last, take the weights in turn. A source whose share passes ``most`` times its size has that as its target. Which
    do follows from the order of size over weight: those below the level at which the shares of all others use up the mix. The sources may be any number:
    both orders are sorted over all partitions.
    """
    n = len(weights)
    named = _running(_numbered(sizes.select("source", "source_size"), F.col("source").isNull(), "source"), {"_k": F.lit(1)})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % n + 1).cast("int"))
    named = named.select("source", "source_size", "_k", w.alias("_w"), (most * F.col("source_size")).alias("_cap"))
    by_room = _numbered(named.withColumn("_room", F.col("_cap") / F.col("_w")), "_room", "_k")
    whole = by_room.agg(F.sum("source_size").alias("_size"), F.sum("_w").alias("_weight"))  # one row
    rows = _running(by_room, {"_caps": F.col("_cap"), "_weights": F.col("_w")}).crossJoin(F.broadcast(whole))
    # Were all before this one held to their caps, the others would share this much for each unit of weight.
    rows = rows.withColumn("_level", (share * F.col("_size") - F.col("_caps")) / (F.col("_weight") - F.col("_weights")))
    final = rows.where("_level <= _room").agg(F.min_by("_level", F.struct("_room", "_k")).alias("_final"))  # one row
    target = F.least("_cap", F.coalesce(F.col("_w") * F.col("_final"), F.col("_cap")))
    return rows.crossJoin(F.broadcast(final)).select("source", "source_size", target.alias("target"))


def odds(size: Column) -> Column:
    """x of a size over 0, in whole ``STEPS``: at least one."""
    return F.greatest(F.floor(STEPS * size / (size + HALF)), F.lit(1)).cast("int")


def expected_copies(odds_: Column, level: Column, most: float = MOST) -> Column:
    """e = min(``most``, c x); without a c all expect ``most``."""
    return F.coalesce(F.least(level * odds_ / STEPS, F.lit(float(most))), F.lit(float(most)))


def copy_levels(histogram: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """``source, level``: c of each source, null where every document is taken ``most`` times.

    ``histogram`` has ``source, odds, words``: at most ``STEPS`` rows for each source. If those of higher odds than a row's are held to ``most``, c is what the
    others need to reach the target; the first row that such a c doesn't take past ``most`` tells.
    """
    h = join_small(histogram, targets.select(F.col("source").alias("_t"), "target"), F.col("source").eqNullSafe(F.col("_t")), "inner")
    falling = Window.partitionBy("source").orderBy(F.desc("odds"))
    higher = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = F.sum(F.col("words") * F.col("odds")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    h = h.select("source", "odds", ((F.col("target") - most * higher) * STEPS / lower).alias("level"))
    holds = F.col("level") * F.col("odds") < most * STEPS
    return h.groupBy("source").agg(F.max_by("level", F.when(holds, F.col("odds"))).alias("level"))


def _rank(rest: Column, key: Column, row: Column) -> Column:
    """Q, brought to 0..1 as Q / (1 + Q), in the upper digits, and a hash of the row in the lower."""
    top, low = 1 << (3 * DIGIT), 1 << (2 * DIGIT)
    u = (F.pmod(F.xxhash64(key, F.lit(71)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    q = u * (1 - rest) / (u * (1 - rest) + rest * (1 - u))
    return F.least(F.floor(q * top), F.lit(top - 1)) * F.lit(low) + F.pmod(F.xxhash64(row, F.lit(73)), F.lit(low))


def pareto_cuts(rows: DataFrame, wanted: DataFrame, stratum: str = "source") -> DataFrame:
    """``stratum, cut``: in each stratum the highest rank to take, so that the ``size`` of rows up to it comes closest to ``wanted``'s ``rest``.

    ``rows`` has ``stratum, rank, size``; strata with nothing to take have no row. Null is a stratum.
    """
    state = wanted.select(F.col(stratum).alias("_s"), F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    left = rows.select(F.col(stratum).alias("s"), "rank", "size")
    for level in range(LEVELS):
        below = (LEVELS - 1 - level) * DIGIT
        state = materialize(state, "cut")
        digit = F.shiftright("rank", below)
        here = join_small(left, state, F.col("s").eqNullSafe(F.col("_s")), "inner")
        if level:
            here = here.where(F.shiftright("rank", below + DIGIT) == F.col("prefix"))
        sums = here.groupBy("s", "rest", digit.alias("d")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("d"))
        sums = sums.withColumn("before", run - F.col("n"))
        at = F.max(F.struct("d", "before", "n", "rest"))  # the last digit that begins before the rest is used up
        state = sums.where(F.col("before") < F.col("rest")).groupBy("s").agg(at.alias("at")).select(F.col("s").alias("_s"), (F.col("at.rest") - F.col("at.before")).alias("rest"), F.col("at.d").alias("prefix"), F.col("at.n").alias("n"))
    # Of the last row, all or nothing, whichever is closer.
    return materialize(state.select(F.col("_s").alias(stratum), F.when(2 * F.col("rest") >= F.col("n"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut")), "cuts")


def mix(sized: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``source_size, target, expected, copies, taken`` to rows with ``source``, ``size``, ``key`` (the same for the same document) and ``row`` (unique). ``sized`` should be
    materialised: it is read once for the sizes, once for each digit of the cuts (after the first only what lies there), and once at last.
    """
    histogram = sized.groupBy("source", F.when(F.col("size") > 0, odds(F.col("size"))).alias("odds")).agg(F.sum("size").alias("words"))
    histogram = materialize(histogram, "odds-histogram")
    totals = materialize(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), "source-sizes")
    targets = materialize(source_targets(totals, share, weights, most), "targets")
    levels = materialize(copy_levels(histogram.where("odds is not null"), targets, most), "levels")
    targets = join_small(targets, levels.withColumnRenamed("source", "_l"), F.col("source").eqNullSafe(F.col("_l"))).select(F.col("source").alias("_t"), "source_size", "target", "level")
    targets = materialize(targets, "targets-levels")
    sure = join_small(histogram.where("odds is not null"), targets, F.col("source").eqNullSafe(F.col("_t")), "inner")
    sure = sure.groupBy("_t", "target").agg(F.sum(F.floor(expected_copies(F.col("odds"), F.col("level"), most)) * F.col("words")).alias("_sure"))
    wanted = sure.select(F.col("_t").alias("source"), (F.col("target") - F.col("_sure")).alias("rest")).where("rest > 0")
    joined = join_small(sized, targets, F.col("source").eqNullSafe(F.col("_t")))
    expected = F.when(F.col("size") > 0, expected_copies(odds(F.col("size")), F.col("level"), most)).otherwise(F.lit(0.0))
    joined = joined.withColumn("expected", expected).withColumn("_whole", F.floor("expected")).withColumn("_p", F.col("expected") - F.col("_whole"))
    ranked = joined.withColumn("_rank", _rank(F.col("_p"), F.col("key"), F.col("row")))
    cuts = pareto_cuts(ranked.where("_p > 0").select("source", F.col("_rank").alias("rank"), "size"), wanted).select(F.col("source").alias("_c"), "cut")
    taken = join_small(ranked, cuts, F.col("source").eqNullSafe(F.col("_c")))
    drawn = F.coalesce(((F.col("_p") > 0) & (F.col("_rank") <= F.col("cut"))).cast("long"), F.lit(0))
    copies = (F.col("_whole") + drawn).cast("long")
    return taken.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_t", "_whole", "_p", "_rank", "_c", "cut", "level")


def mix_sources(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per row.

    The choice follows from doc_id and text, so reruns agree; of rows that agree in both, as many are taken whichever. Null and empty texts have
    size 0; a null source is a source, the last; an empty table gives no rows; extra columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row"))
    return mix(materialize(sized, "sized")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it: 0, 1 or 2. All columns stay, whatever their names.

    The texts are written once with their sizes and never shuffled, as long as the sources are few enough to be broadcast.
    """
    cols = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    doc_id, text, source = (F.col(f"c{cols.index(c)}") for c in ("doc_id", "text", "source"))
    sized = materialize(inner.select("*", source.alias("source"), word_count(text).alias("size"), F.xxhash64(doc_id, text).alias("key"), F.monotonically_increasing_id().alias("row")), "sized")
    out = mix(sized).where("copies > 0").withColumn("_n", F.explode(F.expr("sequence(1L, copies)")))
    return out.select(*[f"c{k}" for k in range(len(cols))]).toDF(*cols)


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
