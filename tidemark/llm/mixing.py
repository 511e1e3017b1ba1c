"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash.  A source that is to give ``target`` words
out of the ``s`` it has gives ``target // s`` whole copies of itself, and for
the rest every document whose hash is under the source's threshold once more.
Thresholds are found from histograms: words are summed by source and by the
leading hash bits, the bucket in which the running sum crosses the budget is
found, and only that bucket is split by the next bits, until it holds one hash
value.  Nothing is sorted and no document leaves its executor: what moves is
one row for each source and bucket.

The last hash is that of one document, or of rows equal in all columns used (id,
text, source), of which as many are taken as the budget holds.  Then one more document is
taken whose size comes nearest to the words still wanted, if that comes nearer than none.
Which of several equal rows are taken can't be told by their columns: they are
written to the shared folder, dealt into parts by their place there and numbered part by part, so a
row repeated millions of times is numbered in many tasks.
Thresholds are nested: but for that one document, a larger budget of a source
takes a superset.

Defined cases: a null source is a source of its own, placed last; a null or
empty text has size 0 and takes nothing; of equal rows some may be taken once more than the
others, which of them is not said; of documents that come equally near that of the least
hash is taken; very long texts count whole, and one that is over what its source is
to give is not taken once more unless that comes nearer than none; an empty table gives an empty result; columns of
other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import HEAVY_SHARE, Tables

#: Bits of the hash that each histogram level adds, and of the whole hash.
LEVEL_BITS, HASH_BITS = 12, 60

#: What a word is made of: anything but the six white-space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(docs: DataFrame, *columns: str) -> Column:
    """The leading 60 bits of the MD5 of these columns as text, joined by a bar; a null is a tilde."""
    text = F.concat_ws("|", *[F.coalesce(docs[c].cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h")


def shared_out(sizes: DataFrame, total: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets of sources (source, source_size, n): shares of ``total`` times all sizes by weight, at most ``most`` times a source's own size.

    Sources in code point order, null last, take ``weights`` in turn.  The
    excess over a stop goes to the others by weight until none is above: sources
    stop in the order of size by weight, so the level at which the rest stands
    follows from running sums.  One row a source meets in the one-partition
    windows here, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = F.row_number().over(by_name) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("w", turn).withColumns({
        "budget": F.sum("source_size").over(all_rows) * F.lit(float(total)),
        "w_left": F.sum("w").over(all_rows) - F.sum("w").over(so_far) + F.col("w"),
        "stopped": F.coalesce(F.sum(stop).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    # level, if all before this one in the order have stopped and this one and those after have not
    level = (F.col("budget") - F.col("stopped")) / F.col("w_left")
    free = ranked.withColumn("level", F.when(level * F.col("w") <= stop, level))
    target = F.least(stop, F.coalesce(F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))) * F.col("w"))
    return free.select("source", "source_size", "n", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def by_source(docs: DataFrame, per_source: DataFrame, total: int) -> DataFrame:
    """Docs with per_source's columns; per_source has n, its number of documents.  Null sources match."""
    limit = max(1, total // HEAVY_SHARE)
    named = per_source.withColumnRenamed("source", "_source")
    large = F.broadcast(named.where(F.col("n") > limit))  # HEAVY_SHARE rows at most
    small = named.where(F.col("n") <= limit)
    same = F.col("source").eqNullSafe(F.col("_source"))
    joined = docs.join(large, same, "inner").drop("_source", "n")
    rest = docs.join(large, same, "left_anti").join(small, same, "inner").drop("_source", "n")
    return joined.unionByName(rest)


def thresholds(sized: DataFrame, targets: DataFrame, tables: Tables, total: int) -> DataFrame:
    """Targets with copies (whole ones), below (hashes under it are taken once more), and the rows taken once more of ``equal`` ones at hash below and of ``alike`` ones at hash extra."""
    state = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumns({"left": F.col("target") - F.col("copies") * F.col("source_size"), "lo": F.lit(0).cast("long"), "below": F.lit(None).cast("long")})
    state = tables.save(state, "level0")
    bits, level = 0, 0
    while bits < HASH_BITS:
        bits, level = bits + LEVEL_BITS, level + 1
        width = 1 << (HASH_BITS - bits)
        span = width << LEVEL_BITS
        open_ = state.where(F.col("below").isNull())
        if open_.isEmpty():
            break
        inside = by_source(sized, open_.select("source", "n", "lo"), total)
        if level > 1:
            inside = inside.where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + span))
        buckets = inside.groupBy("source", F.shiftright("h", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = open_.join(buckets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        met = met.withColumns({"upto": F.sum("words").over(run)}).where(F.col("upto") >= F.col("left"))
        crossing = met.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "h0", "h1", "upto"), F.col("bucket")).alias("at")).withColumnRenamed("source", "_source")
        joined = open_.drop("below").join(crossing, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        short = F.col("left") - (F.col("at.upto") - F.col("at.words"))  # still wanted when the bucket begins
        below = F.when(F.col("at").isNull(), F.lit(1 << HASH_BITS)).when(F.col("at.h0") == F.col("at.h1"), F.col("at.h0"))
        refined = joined.select("source", "source_size", "n", "target", "copies", F.coalesce(short, F.col("left")).alias("left"), F.coalesce(F.col("at.bucket") * width, F.col("lo")).alias("lo"), below.cast("long").alias("below"))
        state = tables.save(state.where(F.col("below").isNotNull()).unionByName(refined), f"level{level}")
    return one_more(sized, state, tables, total)


def rows_at(sized: DataFrame, state: DataFrame, column: str, total: int) -> DataFrame:
    """By source, how many rows have the hash in this column and what size each of them has."""
    met = by_source(sized, state.select("source", "n", F.col(column).alias("_at")), total).where(F.col("h") == F.col("_at"))
    return met.groupBy("source").agg(F.count("*").alias("rows"), F.max("size").alias("each")).withColumnRenamed("source", "_source")


def one_more(sized: DataFrame, state: DataFrame, tables: Tables, total: int) -> DataFrame:
    """State with equal and n_equal: the rows at hash ``below``, and how many of them the budget holds; then extra, alike and n_extra.

    Extra is the hash at or over the threshold, of a row not taken yet, whose size comes nearest to what is then
    still wanted, if it comes nearer than none; one of its rows is taken.
    """
    same = F.col("source").eqNullSafe(F.col("_source"))
    begun = state.join(rows_at(sized, state, "below", total), same, "left").drop("_source")
    fit = F.when(F.col("each") > 0, F.least(F.col("rows"), F.expr("floor(left) div each"))).otherwise(0).cast("long")
    begun = begun.withColumns({"equal": F.coalesce("rows", F.lit(0)), "n_equal": F.coalesce(fit, F.lit(0))}).withColumn("left", F.col("left") - F.col("n_equal") * F.coalesce("each", F.lit(0)))
    begun = tables.save(begun.drop("rows", "each"), "begun")
    more = (F.col("h") > F.col("below")) | (F.col("h") == F.col("below")) & (F.col("n_equal") < F.col("equal"))
    over = by_source(sized, begun.select("source", "n", "left", "below", "equal", "n_equal"), total).where(more & (F.col("size") > 0))
    picked = over.groupBy("source").agg(F.min_by(F.struct("h", "size"), F.struct(F.abs(F.col("size") - F.col("left")), "h")).alias("one")).withColumnRenamed("source", "_source")
    found = begun.join(picked, same, "left").drop("_source")
    nearer = F.abs(F.col("one.size") - F.col("left")) < F.col("left")
    found = tables.save(found.withColumn("extra", F.when(nearer, F.col("one.h"))).drop("one", "left", "lo"), "picked")
    alike = rows_at(sized, found, "extra", total).drop("each").withColumnRenamed("rows", "alike")
    return tables.save(found.join(alike, same, "left").drop("_source").withColumn("alike", F.coalesce("alike", F.lit(0))), "rule")


#: What of the rule tells how often a document is taken.
RULE = ("source", "n", "copies", "below", "equal", "n_equal", "extra", "alike")
#: Parts into which equal rows are dealt to be numbered, at least, and rows a part if there is one key.
PARTS, PART_ROWS = 256, 500_000


def plan(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> tuple[DataFrame, DataFrame, Tables]:
    """(sized, rule, tables): sized has id, source, size, h a document; rule has source, n, source_size, target and what ``one_more`` adds a source."""
    tables = Tables(spark, "mixing")
    sized = tables.save(docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), words_in(docs[text_column]).alias("size"), hash_of(docs, id_column, source_column, text_column)), "sized")
    sizes = tables.save(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sizes")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rule = thresholds(sized, shared_out(sizes, total, most, weights), tables, n)
    return sized, rule, tables


def taken_of_equals() -> Column:
    """Of the rows that have this row's hash, how many are taken once more; all or none of those that are not at a boundary."""
    at_below = F.when(F.col("h") == F.col("below"), F.col("n_equal")).otherwise(0)
    at_extra = F.when(F.col("h") == F.col("extra"), 1).otherwise(0)
    return (at_below + at_extra).cast("long")


def counted(ruled: DataFrame, tables: Tables, rule: DataFrame) -> DataFrame:
    """Rows with the rule's columns, to these with ``times``: how often the mix takes each; without words it is taken no time."""
    known = [c for c in ruled.columns if c not in RULE[1:]]
    rows = F.when(F.col("h") == F.col("below"), F.col("equal")).when(F.col("h") == F.col("extra"), F.col("alike"))
    some = F.when(F.col("size") > 0, taken_of_equals()).otherwise(F.lit(0).cast("long"))
    full = F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise((taken_of_equals() > 0).cast("int"))).otherwise(0).cast("long")
    split = F.coalesce((some > 0) & (some < rows), F.lit(False))
    whole = ruled.where(~split).select(*known, full.alias("times"))
    several = (F.col("n_equal") > 0) & (F.col("n_equal") < F.col("equal")) | F.col("extra").isNotNull() & (F.col("alike") > 1) | (F.col("extra") == F.col("below")) & (F.col("n_equal") + 1 < F.col("equal"))
    if rule.where(several).isEmpty():
        return whole
    held = tables.save(ruled.where(split).select(*known, "copies", some.alias("_some")), "equals")
    parts = max(PARTS, rule.agg(F.sum("n")).first()[0] // PART_ROWS)
    part = F.pmod(F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")), F.lit(parts)).cast("int")
    dealt = held.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row_index"), F.col("_metadata.file_path").alias("_file"))
    before = Window.partitionBy("source", "h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("source", "h", "_part").agg(F.count("*").alias("_n")).select(F.col("source").alias("_source"), F.col("h").alias("_h"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("source", "h", "_part").orderBy("_file", "_row_index"))
    met = dealt.withColumn("_nth", nth).join(sizes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h")) & (F.col("_part") == F.col("_p")))
    return whole.unionByName(met.select(*known, (F.col("copies") + (F.col("_nth") + F.col("_before") <= F.col("_some")).cast("long")).alias("times")))


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row a document: id, source, size, source_size, target, times, taken (words, repeats counted)."""
    sized, rule, tables = plan(spark, docs, **options)
    total = rule.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ruled = by_source(sized, rule.select(*RULE, "source_size", "target"), total)
    return tables.result(counted(ruled, tables, rule).select("id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")))


def repeat(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mixed documents themselves, all columns as they were: each as often as the mix takes it; documents without words stay once."""
    _, rule, tables = plan(spark, docs, id_column, text_column, source_column, **options)
    total = rule.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    hashed = docs.select(kept, docs[source_column].alias("source"), words_in(docs[text_column]).alias("size"), hash_of(docs, id_column, source_column, text_column))
    ruled = counted(by_source(hashed, rule.select(*RULE), total), tables, rule)
    often = F.when(F.col("size") > 0, F.col("times")).otherwise(F.lit(1).cast("long")).cast("int")
    return ruled.select("_row", F.explode(F.array_repeat(F.lit(0), often))).select("_row.*")
