"""Windowed descriptors of waveforms, and how well each of them detects a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15
NAMES = ["Variance", "Kurtosis", "Skewness", "RMS", "Waveform", "Crest", "Impulse", "Clearance", "Shannon", "Energy", "ZCR", "IQR"]


def sliding(samples: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Rows of all full windows of ``size`` samples that begin every size - overlap: adds win_id and pos."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")
    n = F.max("idx").over(Window.partitionBy("series_id")) + 1
    rows = samples.withColumn("_n", n)
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - (size - 1)) / step))
    high = F.least(F.floor(F.col("idx") / step), F.floor((F.col("_n") - size) / step))
    rows = rows.filter(F.col("_n") >= size).withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    rows = rows.withColumn("win_id", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high", "_n")
    return rows.withColumn("pos", F.col("idx") - F.col("win_id") * step)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > EPS, F.try_divide(a, b)).otherwise(0.0)


def descriptors(samples: DataFrame, size: int = 64, overlap: int = 0) -> DataFrame:
    """Twelve descriptors of each window. Everything but the entropy comes from one aggregation."""
    keys = ["series_id", "win_id"]
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = sliding(samples, size, overlap).withColumn("_e", F.col("x") * F.col("x"))
    share = F.col("_e") / (F.sum("_e").over(Window.partitionBy(*keys)) + EPS)
    rows = rows.withColumns({"_p": share, "_turn": F.coalesce((F.signum("x") != F.lag(F.signum("x")).over(w)).cast("int"), F.lit(0))})
    a = F.abs("x")
    m = rows.groupBy(*keys).agg(
        F.var_pop("x").alias("Variance"), (F.kurtosis("x") + 3).alias("Kurtosis"), F.skewness("x").alias("Skewness"), F.sqrt(F.avg("_e")).alias("RMS"),
        F.avg(a).alias("_abs"), F.max(a).alias("_max"), F.avg(F.sqrt(a)).alias("_root"), (-F.sum(F.col("_p") * F.log2(F.col("_p") + EPS))).alias("Shannon"),
        F.sum("_e").alias("Energy"), F.sum("_turn").alias("_turns"), F.percentile("x", F.lit(0.25)).alias("_q1"), F.percentile("x", F.lit(0.75)).alias("_q3"),
    )
    return m.select(
        *keys, "Variance", "Kurtosis", "Skewness", "RMS", _ratio(F.col("RMS"), F.col("_abs")).alias("Waveform"), _ratio(F.col("_max"), F.col("RMS")).alias("Crest"),
        _ratio(F.col("_max"), F.col("_abs")).alias("Impulse"), _ratio(F.col("_max"), F.col("_root") * F.col("_root")).alias("Clearance"), "Shannon", "Energy",
        (F.col("_turns") / (size - 1)).alias("ZCR"), (F.col("_q3") - F.col("_q1")).alias("IQR"),
    )


def long_form(table: DataFrame, names: list[str] = NAMES) -> DataFrame:
    return table.unpivot(["series_id", "win_id"], names, "descriptor", "value")


def correlations(table: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """Pearson correlation of every two descriptors over all windows, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = table.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs])
    return one.select(F.explode(parts).alias("p")).select("p.*")


def _sums(values: DataFrame, change: float | Column, drift: float) -> DataFrame:
    """descriptor, win_id, g (the larger CUSUM sum of the z-scores by the rows before the change) and after.

    change: a share of each series, or a column with the first window after it.
    """
    all_ = Window.partitionBy("series_id", "descriptor")
    to_here = all_.orderBy("win_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.withColumn("n", F.count("*").over(all_)).withColumn("cut", change if isinstance(change, Column) else F.floor(F.col("n") * change))
    early = F.when(F.col("win_id") < F.col("cut"), F.col("value"))
    rows = rows.withColumns({"_m": F.avg(early).over(all_), "_s": F.stddev_pop(early).over(all_)})
    rows = rows.withColumn("z", (F.col("value") - F.col("_m")) / (F.col("_s") + EPS))
    # The target is the mean z of the first 200 rows, as in the tracker.
    rows = rows.withColumn("_t", F.avg(F.when(F.col("win_id") < 200, F.col("z"))).over(all_))
    later = F.col("win_id") > 0
    rows = rows.withColumns({
        "_up": F.sum(F.when(later, F.col("z") - F.col("_t") - drift).otherwise(0.0)).over(to_here),
        "_down": F.sum(F.when(later, F.col("_t") - F.col("z") - drift).otherwise(0.0)).over(to_here),
    })
    g = F.greatest(F.col("_up") - F.min("_up").over(to_here), F.col("_down") - F.min("_down").over(to_here))
    return rows.select("series_id", "descriptor", "win_id", g.alias("g"), (F.col("win_id") >= F.col("cut")).alias("after"), "cut", "n")


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scored(counts: DataFrame) -> DataFrame:
    """precision, recall, f1_score and fpr from tp, fp, pos and neg; 0 where there is nothing to divide by."""
    c = counts.withColumns({"precision": ratio0(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio0(F.col("tp"), F.col("pos")), "fpr": ratio0(F.col("fp"), F.col("neg"))})
    return c.withColumn("f1_score", ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _counts(alarm: Column) -> list[Column]:
    return [
        F.count_if(alarm & F.col("after")).alias("tp"), F.count_if(alarm & ~F.col("after")).alias("fp"), F.count_if("after").alias("pos"),
        F.count_if(~F.col("after")).alias("neg"), F.min(F.when(alarm & F.col("after"), F.col("win_id") - F.col("cut"))).alias("latency"), F.count_if(alarm).alias("total_alarms"),
    ]


def ablation(values: DataFrame, change: float | Column = 0.5, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """What each descriptor alone detects of a change at that share of each series."""
    g = _sums(values, change, drift)
    out = scored(g.groupBy("series_id", "descriptor").agg(*_counts(F.col("g") > threshold)))
    return out.withColumn("latency", F.coalesce("latency", "pos")).select("series_id", "descriptor", "f1_score", "latency", "fpr", "precision", "recall", "total_alarms")


def roc(values: DataFrame, change: float = 0.5, drift: float = 0.5, low: float = 0.5, high: float = 15.0, steps: int = 50) -> DataFrame:
    """Area under the ROC curve over CUSUM thresholds, and the threshold of the best F1.

    The sums don't depend on the threshold: they are made once, and each row is
    counted once, at the number of thresholds that it exceeds; counts at the
    thresholds are running sums of those. Points are ordered by (fpr, tpr),
    without added ends; of equal F1 the lowest threshold wins.
    """
    key = ["series_id", "descriptor"]
    limits = [low + i * ((high - low) / (steps - 1)) for i in range(steps)]
    over = F.array(*map(F.lit, limits))
    # How many thresholds lie below g: the place in the even grid, put right by a comparison with its neighbours.
    near = F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil((F.col("g") - low) * ((steps - 1) / (high - low))).cast("int")))
    below = lambda at: F.coalesce(F.get(over, at) < F.col("g"), F.lit(False))
    place = F.when(below(near), near + 1).when((near > 0) & ~below(near - 1), near - 1).otherwise(near)
    counted = _sums(values, change, drift).withColumn("passed", place).groupBy(*key, "passed").agg(F.count_if("after").alias("a"), F.count_if(~F.col("after")).alias("b"))
    series = counted.groupBy(*key).agg(F.sum("a").alias("pos"), F.sum("b").alias("neg"), F.collect_list(F.struct("passed", "a", "b")).alias("bins"))
    points = series.select(*key, "pos", "neg", "bins", F.posexplode(over).alias("i", "threshold"))
    total = lambda c: F.aggregate("bins", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["passed"] > F.col("i"), x[c]).otherwise(0))
    points = scored(points.withColumns({"tp": total("a"), "fp": total("b")})).withColumnRenamed("recall", "tpr")
    w = Window.partitionBy(*key).orderBy("fpr", "tpr", F.desc("threshold"))
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    best = F.max(F.struct(F.round("f1_score", 12).alias("f1"), (-F.col("threshold")).alias("t")))
    out = points.withColumn("_area", area).groupBy(*key).agg(F.abs(F.coalesce(F.sum("_area"), F.lit(0.0))).alias("auc"), best.alias("_best"))
    return out.select(*key, "auc", F.col("_best.f1").alias("best_f1"), (-F.col("_best.t")).alias("best_threshold"))
