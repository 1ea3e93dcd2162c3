"""Mixing sources to target weights by weighted fair queueing, with Spark expressions only.

Every document of a source is served in a fixed shuffled order (by the md5 of its id). A copy's virtual finish time is the
source's cumulative words up to its end, divided by the source's target; a source whose target exceeds its size is
served up to three times over. The copy in service when virtual time reaches 1 is cut there. All copies are then
sorted by virtual finish time over the whole mix and the mix is truncated at the total budget.

No group is held in one task: a source's order is split into ``bucket_rows``-sized ranges of its shuffle key, whose totals
alone are accumulated per source; the same holds for the global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.session import materialise

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKET_ROWS = 1000
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add weight and target to (source, source_size), one row per source; nulls come last in the order of weights.

    Shares follow the weights; a target stops at ``most`` times the source's size and what it leaves is shared among the
    others by weight. In order of (cap / weight) the stopped sources come first, so running sums give the level behind each.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    df = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    up_to = W.orderBy("full_at", F.col("source").asc_nulls_last())
    sums = lambda c: F.sum(c).over(up_to.rowsBetween(W.unboundedPreceding, -1))
    total = lambda c: F.sum(c).over(W.partitionBy())
    level = (total("source_size") - F.coalesce(sums("cap"), F.lit(0))) / (total("weight") - F.coalesce(sums("weight"), F.lit(0)))
    df = df.withColumn("level", level)
    # stopping a source that is full below the level raises it for the rest, stopping any other lowers it
    df = df.withColumn("held", F.max("level").over(W.partitionBy()))
    return df.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("held") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document and copy: row, doc_id, source, size, source_size, target, copy, taken, finish, position.

    Columns doc_id, text and source are read, others ignored. ``taken`` is the words the mix takes of this copy (0: not in
    the mix), ``finish`` its virtual finish time and ``position`` the words of the mix before it. A null text has size 0 and
    is never taken; a null source is a source of its own; repeated rows are documents of their own; rows that tie in the
    shuffle keep their order by doc_id and size. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    shuffle = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = materialise(sized.withColumn("shuffle", shuffle).withColumn("row", F.monotonically_increasing_id()), "mix")
    rows = sized.count()
    buckets = max(1, -(-rows // bucket_rows))
    part = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    sized = sized.withColumn("part", part)

    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(W.partitionBy("source").orderBy("part")) - F.col("part_size")
    goals = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most)
    s, g = sums.withColumn("before", before).alias("s"), goals.alias("g")
    parts = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s.part", "before", "source_size", "target")

    order = W.partitionBy("source", "part").orderBy("shuffle", "doc_id", "size", "row")
    inner = sized.withColumn("within", F.sum("size").over(order) - F.col("size")).alias("d")
    p = parts.alias("p")
    placed = inner.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    placed = placed.select("row", "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", (F.col("before") + F.col("within")).alias("at"))
    copies = F.greatest(F.lit(1), F.least(F.lit(most), F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(1))).cast("int")
    served = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    start = F.col("at") + F.col("copy") * F.col("source_size")
    wanted = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor(F.col("target")) - start))
    finish = F.when(F.col("target") > 0, F.least(F.lit(1.0), (start + F.col("size")) / F.col("target"))).otherwise(F.lit(1.0))
    served = served.withColumn("wanted", wanted).withColumn("finish", finish)

    # the whole mix in order of virtual finish time: ranges of it are summed, then rows within a range
    served = served.withColumn("range", F.least(F.floor(F.col("finish") * F.lit(4 * buckets)), F.lit(4 * buckets)).cast("long"))
    served = served.withColumn("slot", F.pmod(F.xxhash64("row", "copy"), F.when(F.col("finish") >= 1, F.lit(4 * buckets)).otherwise(F.lit(1))))
    ranges = served.groupBy("range", "slot").agg(F.sum("wanted").alias("range_size"))
    ranges = ranges.withColumn("base", F.sum("range_size").over(W.orderBy("range", "slot")) - F.col("range_size")).drop("range_size")
    line = W.partitionBy("range", "slot").orderBy("finish", "row", "copy")
    budget = goals.agg(F.sum("source_size").alias("budget"))
    mixed = served.withColumn("within", F.sum("wanted").over(line) - F.col("wanted")).join(ranges, ["range", "slot"]).crossJoin(F.broadcast(budget))
    position = F.col("base") + F.col("within")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("wanted"), F.col("budget") - position))
    return mixed.select("row", "doc_id", "source", "size", "source_size", "target", "copy", taken.alias("taken"), "finish", position.alias("position"))


def taken_per_document(mixed: DataFrame) -> DataFrame:
    summed = mixed.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return summed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE_SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM sources),
leveled AS (SELECT *, cap / weight AS full_at,
    ((sum(source_size) OVER () - coalesce(sum(cap) OVER u, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0))::DOUBLE) AS level
    FROM weighed WINDOW u AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM leveled),
placed AS (SELECT s.*, source_size, target,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    (greatest(0, least(size, floor(target) - ahead)) + greatest(0, least(size, floor(target) - ahead - source_size)) + greatest(0, least(size, floor(target) - ahead - 2 * source_size)))::BIGINT AS taken
FROM placed
"""
