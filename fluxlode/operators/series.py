"""Filters and quality figures of time series, as windows. `keys` name the series; within each, rows go by `order`."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

SIGMA = 1.4826


def window(keys, order, half: int | None = None):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w if half is None else w.rowsBetween(-half, half)


def middle(a: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(a)
    return F.when(n > 0, (F.get(a, ((n - 1) / 2).cast("int")) + F.get(a, (n / 2).cast("int"))) / 2)


def rolling_median(value: Column, keys, order, half: int) -> Column:
    return middle(F.array_sort(F.collect_list(value).over(window(keys, order, half))))


def global_index(df: DataFrame, order, name: str = "i") -> DataFrame:
    """df with its place in a total order, without a window over one task: ranges are sorted, counted and offset."""
    spread = written(df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("_part").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    local = spread.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before") - 1).drop("_part", "_at", "_before")


def with_halo(df: DataFrame, index: str, chunk: int, halo: int) -> DataFrame:
    """Rows dealt to chunks of the index, those within `halo` of a border to both sides; own: the row's own chunk."""
    at, own = F.col(index) % chunk, F.floor(F.col(index) / chunk)
    to = F.array_compact(F.array(own, F.when(at < halo, own - 1), F.when(at >= chunk - halo, own + 1)))
    return df.withColumn("chunk", F.explode(to)).withColumn("own", F.col("chunk") == own).filter("chunk >= 0")


def despike(df: DataFrame, value: str, keys, order, width: int = 11, k: float = 4.0, adaptive: bool = True, steep: float = 5.0, expand: int = 4) -> DataFrame:
    """Adds despiked and is_spike: a value further than k sigma from the rolling median becomes that median.

    sigma is the scaled rolling median of absolute residuals; where it is 0 nothing is flagged. Next to
    a step of more than `steep` the window is wider by `expand`. Series of fewer than 5 values stay as they are.
    """
    width = max(3, width | 1)
    plain = window(keys, order)
    v = F.col(value)

    def variant(df: DataFrame, width: int, tag: str) -> DataFrame:
        df = df.withColumn(f"_m{tag}", rolling_median(v, keys, order, width // 2))
        return df.withColumn(f"_s{tag}", SIGMA * rolling_median(F.abs(v - F.col(f"_m{tag}")), keys, order, width // 2))

    df = variant(df, width, "a").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    median, sigma = F.col("_ma"), F.col("_sa")
    if adaptive:
        df = variant(df, width + expand, "b")
        before = F.coalesce(F.abs(v - F.lag(v).over(plain)), F.lit(0.0))
        after = F.coalesce(F.abs(F.lead(v).over(plain) - v), F.lit(0.0))
        df = df.withColumn("_steep", (before > steep) | (after > steep))
        median, sigma = (F.when(F.col("_steep"), F.col(b)).otherwise(F.col(a)) for a, b in (("_ma", "_mb"), ("_sa", "_sb")))
    spike = (F.col("_n") >= 5) & (sigma > 0) & (F.abs(v - median) > k * sigma)
    df = df.withColumn("is_spike", F.coalesce(spike, F.lit(False))).withColumn("despiked", F.when(F.col("is_spike"), median).otherwise(v))
    return df.drop("_n", "_steep", "_ma", "_sa", "_mb", "_sb")


def sample_rate(df: DataFrame, seconds: str, keys, order) -> DataFrame:
    """rate_hz of each series: 1 / median positive time step."""
    step = F.col(seconds) - F.lag(seconds).over(window(keys, order))
    steps = df.select(*keys, step.alias("d")).filter("d > 0")
    return steps.groupBy(*keys).agg((1 / F.median("d")).alias("rate_hz"))


def moving_average(df: DataFrame, value: str, keys, order, samples: int) -> DataFrame:
    return df.withColumn("smoothed", F.avg(value).over(window(keys, order, (samples | 1) // 2)))


def moving_seconds(df: DataFrame, value: str, seconds: float, t: str, keys, order) -> DataFrame:
    """moving_average over the odd number of rows that `seconds` hold at each series' own rate, three at least; a series shorter than
    that stays as it is. Series have few different widths, which are the cases of one expression."""
    rate = sample_rate(df, t, keys, order).withColumn("_w", F.greatest(F.lit(3), F.bround(F.col("rate_hz") * seconds).cast("int")))
    sizes = written(rate.select(*keys, F.when(F.col("_w") % 2 == 1, F.col("_w")).otherwise(F.col("_w") + 1).alias("_w")), "widths")
    found = [r[0] for r in sizes.select("_w").distinct().collect()]
    out = df.join(F.broadcast(sizes), list(keys), "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    means = [F.when((F.col("_w") == n) & (F.col("_w") < F.col("_n")), F.avg(value).over(window(keys, order, n // 2))) for n in found]
    return out.withColumn("smoothed", F.coalesce(*means, F.col(value))).drop("_w", "_n")


def noise_summary(lines: DataFrame) -> DataFrame:
    """One row over the lines of difference_qc: root mean squares of their 4th and 8th differences and how many are noisy."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return lines.agg(F.count("*").alias("n_lines"), rms("rms4").alias("overall4"), rms("rms8").alias("overall8"), F.coalesce(F.sum(F.col("is_noisy").cast("long")), F.lit(0)).alias("n_noisy"))


def process_base(df: DataFrame, value: str, keys, order, window_rows: int, confirm_rows: int, trim_k: float = 6.0, share: float = 0.2, width: int = 11, k: float = 5.0, trim: bool = True, spikes: bool = True) -> DataFrame:
    """A base series without its restless ends and with its spikes replaced; either step can be left out."""
    out = trim_transients(df, value, keys, order, window_rows, confirm_rows, trim_k, share) if trim else df
    return despike(out, value, keys, order, width, k).withColumn(value, F.col("despiked")).drop("despiked", "is_spike") if spikes else out


def distance_average(df: DataFrame, value: str, keys, s: str, wavelength: float) -> DataFrame:
    """Mean of the values within half a wavelength along the line; s in metres."""
    micro = F.round(F.col(s) * 1_000_000).cast("long")
    reach = int(round(wavelength / 2 * 1_000_000))
    return df.withColumn("smoothed", F.avg(value).over(Window.partitionBy(*keys).orderBy(micro).rangeBetween(-reach, reach)))


def robust_z(df: DataFrame, columns, k: float = 4.0) -> DataFrame:
    """Adds sway_z, the largest robust z of the columns over the whole table, and is_sway. The two medians are
    one-row aggregates that are broadcast."""
    middles = df.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    df = df.crossJoin(F.broadcast(middles))
    scales = df.agg(*[F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_s_{c}") for c in columns])
    df = df.crossJoin(F.broadcast(scales))
    zs = [F.coalesce(F.abs(F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}") * SIGMA, F.lit(0.0)), F.lit(0.0)) for c in columns]
    z = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return df.withColumn("sway_z", z).withColumn("is_sway", F.col("sway_z") > k).drop(*[f"_{a}_{c}" for a in "ms" for c in columns])


def difference(value: str, n: int, keys, order) -> Column:
    """n-th difference, scaled so that white noise keeps its standard deviation; null for the first n rows."""
    w = window(keys, order)
    terms = [F.lag(value, j).over(w) * float((-1) ** j * comb(n, j)) if j else F.col(value) for j in range(n + 1)]
    return reduce(lambda a, b: a + b, terms) / float(comb(2 * n, n)) ** 0.5


def difference_qc(df: DataFrame, value: str, line: str, order, least: int = 10, flag: float = 3.0) -> DataFrame:
    """Per line: rms and largest 4th and 8th difference, and whether the 4th's rms exceeds `flag` times the median line's."""
    d = df.select(line, difference(value, 4, [line], order).alias("d4"), difference(value, 8, [line], order).alias("d8"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    lines = d.groupBy(line).agg(F.count("*").alias("n"), rms("d4").alias("rms4"), F.max(F.abs("d4")).alias("max4"), rms("d8").alias("rms8"), F.max(F.abs("d8")).alias("max8")).filter(F.col("n") >= least)
    return lines.crossJoin(F.broadcast(lines.agg(F.median("rms4").alias("_m")))).withColumn("is_noisy", F.col("rms4") > flag * F.col("_m")).drop("_m")


def spacing_qc(df: DataFrame, line: str, order, gap: float = 20.0) -> DataFrame:
    """Per line: median and largest distance between neighbouring points, and the number of gaps."""
    w = window([line], order)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    steps = df.select(line, step.alias("d")).filter("d is not null")
    return steps.groupBy(line).agg(F.count("*").alias("n_steps"), F.median("d").alias("median_m"), F.max("d").alias("max_m"), F.sum((F.col("d") > gap).cast("long")).alias("n_gaps"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value; the last one is closed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("_w") * F.col("bin") / bins).alias("low"), (F.col("_lo") + F.col("_w") * (F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def bridge(df: DataFrame, value: str, flagged: str, keys, order, near: int = 5) -> DataFrame:
    """Replaces flagged runs by a straight line between the medians of the `near` unflagged values on either side;
    at an end only one side counts. Adds bridged."""
    w = window(keys, order)
    df = df.withColumn("_new", (F.col(flagged) & ~F.coalesce(F.lag(flagged).over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(*keys, "_run", flagged).orderBy(*order)
    df = df.withColumn("_at", F.row_number().over(run)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run", flagged)))
    # medians of frames over the clear rows alone, carried on to the flagged rows from both sides
    clear = Window.partitionBy(*keys, flagged).orderBy(*order)
    side = lambda lo, hi: F.when(~F.col(flagged), middle(F.array_sort(F.collect_list(value).over(clear.rowsBetween(lo, hi)))))
    df = df.withColumn("_l", side(1 - near, 0)).withColumn("_r", side(0, near - 1))
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    df = df.withColumn("_b", F.last("_l", ignorenulls=True).over(w)).withColumn("_a", F.last("_r", ignorenulls=True).over(back))
    line = F.col("_b") + (F.col("_a") - F.col("_b")) * F.col("_at") / (F.col("_n") + 1)
    return df.withColumn("bridged", F.when(F.col(flagged), F.coalesce(line, "_b", "_a", F.col(value))).otherwise(F.col(value))).drop("_new", "_run", "_at", "_n", "_l", "_r", "_b", "_a")


def median_speed(df: DataFrame, seconds: str, order) -> DataFrame:
    w = Window.partitionBy("source_file_index").orderBy(*order)
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    took = F.col(seconds) - F.lag(seconds).over(w)
    return df.select((moved / took).alias("v"), took.alias("dt")).filter("dt > 0").agg(F.median("v").alias("speed_mps"))


def line_spacing(df: DataFrame, line: str, across: Column) -> DataFrame:
    """Median positive gap between the lines' mean positions across the track. One row a line meets in one window."""
    middles = df.groupBy(line).agg(F.avg(across).alias("c"))
    gaps = middles.select((F.col("c") - F.lag("c").over(Window.orderBy("c"))).alias("g")).filter("g > 0")
    return gaps.agg(F.median("g").alias("spacing_m"))


def trim_transients(df: DataFrame, value: str, keys, order, window_rows: int, confirm_rows: int, k: float = 6.0, share: float = 0.2) -> DataFrame:
    """Drops the restless start and end of each series: up to where the residual from the rolling median stays below k times
    the series' median residual for confirm_rows rows, at most `share` of the series at each end."""
    w = window(keys, order)
    df = df.withColumn("_r", F.abs(F.col(value) - rolling_median(F.col(value), keys, order, window_rows // 2))).withColumn("_i", F.row_number().over(w))
    base = df.groupBy(*keys).agg(F.median("_r").alias("_base"), F.count("*").alias("_n"))
    df = df.join(base, list(keys)).withColumn("_calm", (F.col("_r") <= k * F.col("_base")).cast("int"))
    ahead = F.sum("_calm").over(w.rowsBetween(0, confirm_rows - 1))
    back = F.sum("_calm").over(w.rowsBetween(-(confirm_rows - 1), 0))
    df = df.withColumn("_go", ahead == confirm_rows).withColumn("_stop", back == confirm_rows)
    ends = df.groupBy(*keys).agg(F.min(F.when(F.col("_go"), F.col("_i"))).alias("_from"), F.max(F.when(F.col("_stop"), F.col("_i"))).alias("_to"))
    df = df.join(ends, list(keys))
    most = F.floor(F.col("_n") * share)
    first = F.least(F.coalesce("_from", F.lit(1)), most + 1)
    last = F.greatest(F.coalesce("_to", "_n"), F.col("_n") - most)
    return df.filter(F.col("_i").between(first, last)).drop("_r", "_i", "_base", "_n", "_calm", "_go", "_stop", "_from", "_to")
