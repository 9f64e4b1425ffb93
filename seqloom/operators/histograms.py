"""Histograms of counts: (freq, n) with the instance totals of the two boundary bins.

``i_low`` and ``i_high`` hold how many word instances the lowest and highest bins stand for, so that a
histogram of words turns into one of instances and back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.letters import MOST


#: Least top of the range for fitting.
FIT_HIGH = 1000


@dataclass(frozen=True)
class Histogram:
    """``bins``: freq, n. ``ends``: one row of i_low, i_high. ``instances``: whether n counts instances."""

    k: int
    low: int
    high: int
    bins: DataFrame
    ends: DataFrame
    instances: bool = False

    def clipped(self, low: int, high: int) -> Histogram:
        """Fold bins outside [low, high] into the boundary bins."""
        if not self.low <= low <= high <= self.high:
            raise ValueError(f"[{self.low}, {self.high}] does not contain [{low}, {high}]")
        own = self.as_words()
        each = F.col("freq").cast("long") * F.col("n")
        first = F.when(F.col("freq") == own.low, F.col("i_low")).when(F.col("freq") == own.high, F.col("i_high")).otherwise(each)
        ends = own.bins.crossJoin(F.broadcast(own.ends)).withColumn("_each", first)  # ends is one row
        ends = ends.agg(_total("_each", F.col("freq") <= low).alias("i_low"), _total("_each", F.col("freq") >= high).alias("i_high"))
        bins = own.bins.groupBy(F.least(F.greatest("freq", F.lit(low)), F.lit(high)).cast("int").alias("freq")).agg(F.sum("n").alias("n"))
        out = Histogram(own.k, low, high, bins, ends)
        return out.as_instances() if self.instances else out

    def as_instances(self) -> Histogram:
        if self.instances:
            return self
        each = F.when(F.col("freq") == self.low, F.col("i_low")).when(F.col("freq") == self.high, F.col("i_high")).otherwise(F.col("freq").cast("long") * F.col("n"))
        bins = self.bins.crossJoin(F.broadcast(self.ends)).select("freq", each.alias("n"))
        words = self.bins.agg(_total("n", F.col("freq") == self.low).alias("i_low"), _total("n", F.col("freq") == self.high).alias("i_high"))
        return replace(self, bins=bins, ends=words, instances=True)

    def at_bins(self) -> DataFrame:
        """freq, n: each bin's words times its frequency. Unlike in :meth:`as_instances`, words beyond the ends count as the end they are folded into."""
        return self.as_words().bins.select("freq", (F.col("freq").cast("long") * F.col("n")).alias("n"))

    def as_words(self) -> Histogram:
        if not self.instances:
            return self
        each = F.when(F.col("freq") == self.low, F.col("i_low")).when(F.col("freq") == self.high, F.col("i_high")).otherwise(F.expr("n div freq"))
        bins = self.bins.crossJoin(F.broadcast(self.ends)).select("freq", each.alias("n"))
        instances = self.bins.agg(_total("n", F.col("freq") == self.low).alias("i_low"), _total("n", F.col("freq") == self.high).alias("i_high"))
        return replace(self, bins=bins, ends=instances, instances=False)

    def cumulated(self) -> DataFrame:
        """freq, n, and the per cent of everything at or above freq. A histogram has at most 32767 rows."""
        down = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self.bins.where("n > 0").select("freq", "n", (100.0 * F.sum("n").over(down) / F.sum("n").over(Window.partitionBy())).alias("cum_percent"))

    def for_fitting(self, low: int = 1, high: int = FIT_HIGH) -> DataFrame:
        """The form for genome-profile fitting over a range, which is widened to contain 1 to FIT_HIGH."""
        return self.clipped(min(low, 1), max(high, FIT_HIGH)).scoped()

    def scoped(self) -> DataFrame:
        """The last bin holds its instances divided by its frequency."""
        last = F.when(F.col("freq") == self.high, F.expr(f"i_high div {self.high}")).otherwise(F.col("n"))
        return self.as_words().bins.crossJoin(F.broadcast(self.ends)).select("freq", last.alias("n")).where("n > 0")

    def shown(self, name: str) -> DataFrame:
        """Text lines of the display, headings included."""
        what = f"{self.k}-mer instances" if self.instances else f"unique {self.k}-mers"
        mark = F.when(F.col("freq") == self.high, ">=").when((F.col("freq") == self.low) & (F.lit(self.low) > 1), "<=").otherwise("  ")
        rows = self.cumulated().select((-F.col("freq")).cast("long").alias("ord"), F.format_string(" %s %5d: %12d   %5.1f%%", mark, "freq", "n", "cum_percent").alias("line"))
        head = self.bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).select(F.lit(-(1 << 40)).alias("ord"), F.concat(F.lit(f"Histogram of {what} of {name}: "), F.format_number("t", 0)).alias("line"))
        return head.unionByName(rows)

    def tagged(self, name: str) -> DataFrame:
        """The one-letter tagged form: name, range, and all bins from low to high."""
        bins = self.bins.sparkSession.range(self.low, self.high + 1).select(F.col("id").cast("int").alias("freq")).join(self.bins, "freq", "left").select("freq", F.coalesce("n", F.lit(0)).alias("n"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("freq", "n"))), lambda x: x["n"].cast("string"))  # one item a bin
        head = f"N {len(name)} {name}\nR {self.low} {self.high}\nH {self.high - self.low + 1} "
        return bins.agg(F.concat(F.lit(head), F.concat_ws(" ", listed)).alias("line"))

    def tabbed(self) -> DataFrame:
        return self.bins.where("n > 0").select("freq", F.concat_ws("\t", "freq", "n").alias("line"))


def _total(value: str, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0)).cast("long")


def of_counts(raw: DataFrame, k: int, low: int = 1, high: int = MOST) -> Histogram:
    """From unclipped counts (column n): bins low..high with everything beyond folded into the ends."""
    freq = F.least(F.greatest("n", F.lit(low)), F.lit(high)).cast("int")
    bins = raw.groupBy(freq.alias("freq")).agg(F.count(F.lit(1)).alias("n"))
    ends = raw.agg(_total("n", F.col("n") <= low).alias("i_low"), _total("n", F.col("n") >= high).alias("i_high"))
    return Histogram(k, low, high, bins, ends)


def concatenated(parts: list[Histogram]) -> Histogram:
    """Element-wise sum of histograms over disjoint tables."""
    first = parts[0]
    if any((p.k, p.low, p.high, p.instances) != (first.k, first.low, first.high, first.instances) for p in parts):
        raise ValueError("histograms of different words or ranges")
    bins, ends = first.bins, first.ends
    for p in parts[1:]:
        bins, ends = bins.unionByName(p.bins), ends.unionByName(p.ends)
    return replace(first, bins=bins.groupBy("freq").agg(F.sum("n").alias("n")), ends=ends.agg(F.sum("i_low").alias("i_low"), F.sum("i_high").alias("i_high")))
