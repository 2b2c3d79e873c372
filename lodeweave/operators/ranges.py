"""Joins of ranges that overlap, without comparing all pairs.

A range lies in bins as wide as itself or up to four times wider, so in two of them at most, whatever its length. Two ranges meet in the bins of the longer one: each side also gives a row for every coarser width that
the other side has, which meets only ranges of that width, so two short ranges never meet in a wide bin. Of the bins that a pair shares, the one in which its overlap begins counts, so no pair comes twice and nothing has to be made distinct.

Where only counts and extremes of what overlaps are asked for, ``overlap_aggregate`` makes no pair at all, so that rows which lie close together don't cost the square of their number.

Bins are join keys, so Spark shuffles by them and AQE splits a hot one. A side gives two rows at most for each width of the other side, and there are some thirty widths in all that 64 bits hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each width is so many times the one before, as a power of two.
STEP = 2


def overlap_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose closed whole-number ranges overlap, and which are equal in the columns ``on``: the columns of both sides (those of ``on`` once, other names may not clash).

    A null start or end is open: it reaches as far as any range does. A range that ends before it starts overlaps nothing, and so does a null in ``on``. Repeated rows pair as often as they occur.
    """
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    (a, b), (c, d) = left_range, right_range
    ends = [left.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first(), right.agg(F.min(c), F.max(c), F.min(d), F.max(d)).first()]
    known = [int(v) for row in ends for v in row if v is not None]
    low, high = (min(known), max(known)) if known else (0, 0)
    sides = [_bounded(left, a, b, low, high, "l"), _bounded(right, c, d, low, high, "r")]
    # as many as there are widths
    levels = [sorted(r.level for r in s.select(F.col(f"_{n}_level").alias("level")).distinct().collect()) for s, n in zip(sides, "lr", strict=True)]
    dealt = _dealt(sides[0], "l", levels[1], 0, low).join(_dealt(sides[1], "r", levels[0], 1, low), [*on, "_longer", "_level", "_bin"])
    begins = F.col("_bin") == _bin(F.greatest("_l_from", "_r_from"), F.col("_level"), low)
    meet = (F.col("_l_from") <= F.col("_r_to")) & (F.col("_r_from") <= F.col("_l_to"))
    return dealt.where(begins & meet).select(*on, *[x for x in left.columns if x not in on], *[x for x in right.columns if x not in on])


def _bounded(df: DataFrame, start: str, end: str, low: int, high: int, side: str) -> DataFrame:
    """The range as two numbers, and its width's level: the least whose bins are no narrower."""
    first, last = F.coalesce(F.col(start).cast("long"), F.lit(low)), F.coalesce(F.col(end).cast("long"), F.lit(high))
    out = df.withColumns({f"_{side}_from": first, f"_{side}_to": last}).where(F.col(f"_{side}_from") <= F.col(f"_{side}_to"))
    bits = F.length(F.regexp_replace(F.bin(F.col(f"_{side}_to") - F.col(f"_{side}_from")), "^0+", ""))
    return out.withColumn(f"_{side}_level", F.ceil(bits / STEP).cast("int"))


def _bin(value: Column, level: Column, low: int) -> Column:
    return F.call_function("shiftright", value - F.lit(low), (level * STEP).cast("int"))


def _dealt(df: DataFrame, side: str, others: list[int], number: int, low: int) -> DataFrame:
    """A row for each bin of the range's own width, where it is the longer one of a pair, and of each of the other side's widths at which that one is. Of two equally wide ones the left counts as the longer."""
    own = F.col(f"_{side}_level")
    wider = F.filter(F.array(*[F.lit(n) for n in others]).cast("array<int>"), lambda n: n >= own if number else n > own)
    as_shorter = F.transform(wider, lambda n: F.struct(F.lit(1 - number).alias("longer"), n.alias("level")))
    out = df.withColumn("_at", F.explode(F.concat(F.array(F.struct(F.lit(number).alias("longer"), own.alias("level"))), as_shorter)))
    out = out.withColumns({"_longer": F.col("_at.longer"), "_level": F.col("_at.level")}).drop("_at")
    first, last = (_bin(F.col(f"_{side}_{e}"), F.col("_level"), low) for e in ("from", "to"))
    return out.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_aggregate(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], value: str) -> DataFrame:
    """``left`` with ``count``, ``least`` and ``greatest`` of ``value`` over the rows of ``right`` whose closed whole-number ranges overlap its own; rows that nothing overlaps are left out, as are null ends.

    A range overlaps another one if it has its start, or starts after that within it; it can't do both. So each side's ranges are cut into aligned blocks of 1, 2, 4, .. numbers, two of a size at most, and the other side's
    starts look up the blocks that they are in. Whatever is in a block is aggregated before it meets anything, so rows grow with the ranges and the logarithm of their length, never with pairs.
    """
    (a, b), (c, d) = left_range, right_range
    asked = left.select(F.col(a).cast("long").alias("_s"), F.col(b).cast("long").alias("_t")).where("_s <= _t").distinct()
    known = right.select(F.col(c).cast("long").alias("_f"), F.col(d).cast("long").alias("_u"), F.col(value).alias("_v")).where("_f <= _u")
    known = known.groupBy("_f", "_u").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    summed = [F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most")]
    # those that have the start
    held = _blocks(known, F.col("_f"), F.col("_u")).groupBy("_size", "_block").agg(*summed)
    at_start = _around(asked.select("_s").distinct(), F.col("_s"), held).join(held, ["_size", "_block"]).groupBy("_s").agg(*summed)
    # those that start later
    cut = _blocks(asked, F.col("_s") + 1, F.col("_t"))
    begun = _around(known.groupBy("_f").agg(*summed), F.col("_f"), cut).groupBy("_size", "_block").agg(*summed)
    later = cut.join(begun, ["_size", "_block"]).select("_s", "_t", "_n", "_least", "_most")
    both = asked.join(at_start, "_s").select("_s", "_t", "_n", "_least", "_most").unionByName(later).groupBy("_s", "_t").agg(*summed)
    both = both.withColumnsRenamed({"_n": "count", "_least": "least", "_most": "greatest"})
    return left.join(both, (F.col(a).cast("long") == F.col("_s")) & (F.col(b).cast("long") == F.col("_t"))).drop("_s", "_t")


def _blocks(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each of the aligned blocks that make up a range: ``_size``, as a power of two, and number. None for an empty range."""
    shift = lambda n: F.call_function("shiftright", n, F.col("_size"))
    sized = df.where(first <= last).withColumn("_size", F.explode(F.sequence(F.lit(0), F.length(F.bin(last - first)))))
    # blocks that are wholly inside go from ``low`` to ``high``; an odd first one and an even last one belong to no wider block that is
    sized = sized.withColumns({"_low": -shift(-first), "_high": shift(last + 1) - 1}).where("_low <= _high")
    ends = F.array(F.when(F.pmod("_low", F.lit(2)) == 1, F.col("_low")), F.when(F.pmod("_high", F.lit(2)) == 0, F.col("_high")))
    return sized.withColumn("_block", F.explode(ends)).where("_block IS NOT NULL").drop("_low", "_high")


def _around(df: DataFrame, value: Column, blocks: DataFrame) -> DataFrame:
    """A row for each block that a number is in, of the sizes that ``blocks`` has (64 at most)."""
    sizes = sorted(r._size for r in blocks.select("_size").distinct().collect())
    sized = df.withColumn("_size", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<int>")))
    return sized.withColumn("_block", F.call_function("shiftright", value, F.col("_size")))
