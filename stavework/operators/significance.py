"""Tests of whether two note tables differ, by song and feature, with p-values.

Features are brought into one long form (song_id, feature, value) and counted by value on both sides in one shuffle; what follows runs over
distinct values. Paired tests take the i-th note of a side with the i-th of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi_square_p, kolmogorov_p, normal_p, student_p, variance_p
from .compare import ORDER

#: Significance level, and the fewest values on each side for a comparison of distributions.
ALPHA, FEWEST = 0.05, 10
BY = ("song_id", "feature")


def long_form(notes: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """song_id, feature, value for the features named: pitch, velocity, duration, onset, pitch_class, octave, and interval and gap to the note before."""
    order = Window.partitionBy("song_id").orderBy(*ORDER)
    values = {
        "pitch": F.col("pitch"), "velocity": F.col("velocity"), "duration": F.col("end_tick") - F.col("start_tick"), "onset": F.col("start_tick"), "pitch_class": F.pmod("pitch", F.lit(12)),
        "octave": F.floor(F.col("pitch") / 12), "interval": F.col("pitch") - F.lag("pitch").over(order), "gap": F.col("start_tick") - F.lag("start_tick").over(order),
    }
    rows = notes.select("song_id", *(values[f].cast("long").alias(f) for f in features))
    return rows.select("song_id", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features))).alias("x")).select("song_id", "x.*").where("value IS NOT NULL")


def value_counts(a: DataFrame, b: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """By song, feature and value: how often the value occurs in the original and in the reconstructed notes."""
    sides = long_form(a, features).withColumn("side", F.lit(0)).unionByName(long_form(b, features).withColumn("side", F.lit(1)))
    return sides.groupBy(*BY, "value").agg(F.count_if(F.col("side") == 0).alias("original"), F.count_if(F.col("side") == 1).alias("reconstructed"))


def cosines(counts: DataFrame) -> DataFrame:
    """Cosine of both histograms of each feature; 1 if both are empty, 0 if one is."""
    x, y = F.col("original").cast("double"), F.col("reconstructed").cast("double")
    sums = counts.groupBy(*BY).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return sums.select(*BY, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("similarity"))


def distribution_tests(counts: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance with its p-value and verdict, and Wasserstein distance; features with too few values on a side are left out."""
    order, whole = Window.partitionBy(*BY).orderBy("value"), Window.partitionBy(*BY)
    upto = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.select(*BY, upto("original").alias("x"), upto("reconstructed").alias("y"), F.sum("original").over(whole).alias("n"), F.sum("reconstructed").over(whole).alias("m"), (F.lead("value").over(order) - F.col("value")).alias("width"))
    rows = rows.where((F.col("n") >= FEWEST) & (F.col("m") >= FEWEST)).withColumn("d", F.abs(F.col("x") / F.col("n") - F.col("y") / F.col("m")))
    s = rows.groupBy(*BY, "n", "m").agg(F.max("d").alias("ks"), F.coalesce(F.sum(F.col("d") * F.col("width")), F.lit(0.0)).alias("wasserstein"))
    p = kolmogorov_p(F.col("ks"), F.col("n"), F.col("m"))
    return s.select(*BY, "n", "m", "ks", p.alias("p"), (p > ALPHA).alias("identical"), "wasserstein")


def mann_whitney(counts: DataFrame) -> DataFrame:
    """U of the original side, its normal score with tie and continuity correction, and the two-sided p-value; 1 where nothing varies."""
    before = F.coalesce(F.sum("reconstructed").over(Window.partitionBy(*BY).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = (F.col("original") + F.col("reconstructed")).cast("double")
    rows = counts.select(*BY, "original", "reconstructed", (F.col("original") * (before + F.col("reconstructed") / 2)).alias("u"), (t * t * t - t).alias("ties"))
    s = rows.groupBy(*BY).agg(F.sum("u").alias("u"), F.sum("ties").alias("ties"), F.sum("original").cast("double").alias("n"), F.sum("reconstructed").cast("double").alias("m")).where("n > 0 AND m > 0")
    n, m = F.col("n"), F.col("m")
    s = s.withColumn("sd", F.sqrt(n * m / 12 * (n + m + 1 - F.col("ties") / F.greatest((n + m) * (n + m - 1), F.lit(1.0)))))
    far = F.greatest(F.col("u"), n * m - F.col("u")) - n * m / 2
    s = s.withColumn("z", F.when(F.col("sd") > 0, (far - 0.5) / F.col("sd")).otherwise(0.0))
    # the middle of the distribution is within half a step of itself
    return s.select(*BY, "u", "z", F.when(F.col("z") > 0, normal_p(F.col("z"))).otherwise(1.0).alias("p"))


def chi_square(counts: DataFrame, most: int = 100, edges: int = 20) -> DataFrame:
    """Chi-square of both histograms of each feature, degrees of freedom and p-value; with over `most` values, of intervals between equal edges.
    Two cells are corrected for continuity."""
    bounds = counts.groupBy(*BY).agg(F.count("*").alias("kinds"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("original").alias("n"), F.sum("reconstructed").alias("m")).where("n > 0 AND m > 0")
    cell = F.when(F.col("kinds") > most, F.floor((F.col("value") - F.col("lo")) * (edges - 1) / (F.col("hi") - F.col("lo")))).otherwise(F.col("value"))
    bins = counts.join(bounds, list(BY)).groupBy(*BY, "n", "m", cell.alias("cell")).agg(F.sum("original").alias("x"), F.sum("reconstructed").alias("y"))
    n, m, t = F.col("n"), F.col("m"), F.col("x") + F.col("y")
    few = F.count("*").over(Window.partitionBy(*BY)) == 2

    def part(seen: Column, side: Column) -> Column:
        expected = t * side / (n + m)
        off = F.abs(seen - expected)
        return F.pow(F.when(F.col("few"), F.greatest(off - 0.5, F.lit(0.0))).otherwise(off), 2) / expected

    s = bins.withColumn("few", few).groupBy(*BY).agg(F.sum(part(F.col("x"), n) + part(F.col("y"), m)).alias("chi2"), (F.count("*") - 1).alias("dof"))
    return s.select(*BY, "chi2", "dof", chi_square_p(F.col("chi2"), F.col("dof")).alias("p"))


def paired_values(pairs: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """song_id, feature, a, b of paired notes (see compare.paired)."""
    value = lambda f, s: (F.col(f"end_tick_{s}") - F.col(f"start_tick_{s}") if f == "duration" else F.col(f"{f}_{s}")).cast("long")
    return pairs.select("song_id", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), value(f, "a").alias("a"), value(f, "b").alias("b")) for f in features))).alias("x")).select("song_id", "x.*")


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Smaller rank sum of paired differences (zeros left out), their number, and the two-sided p-value by the normal law with tie correction;
    (0, 1) with fewer than two differences. Differences are counted by value before they are ranked."""
    counted = pairs.where("a <> b").groupBy(*BY, F.abs(F.col("a") - F.col("b")).alias("size")).agg(F.count_if(F.col("a") > F.col("b")).alias("up"), F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*BY).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank, t = before + (F.col("c") + 1) / 2, F.col("c").cast("double")
    s = counted.select(*BY, "c", (F.col("up") * rank).alias("up"), ((F.col("c") - F.col("up")) * rank).alias("down"), (t * t * t - t).alias("ties"))
    s = s.groupBy(*BY).agg(F.sum("c").cast("double").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("ties").alias("ties")).where("n > 1")
    n, w = F.col("n"), F.least("up", "down")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    tested = s.select(*BY, F.col("n").cast("long").alias("differing"), w.alias("w"), normal_p(z).alias("p"))
    every = pairs.select(*BY).distinct().join(tested, list(BY), "left")
    return every.select(*BY, F.coalesce("differing", F.lit(0).cast("long")).alias("differing"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("p", F.lit(1.0)).alias("p"))


def paired_t(pairs: DataFrame) -> DataFrame:
    """Mean of paired differences over its standard error, and the two-sided p-value; (0, 1) where differences don't vary. Two pairs or more."""
    d = F.col("a") - F.col("b")
    s = pairs.groupBy(*BY).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.max(d).alias("most"), F.min(d).alias("least")).where("n > 1")
    varies = F.col("most") > F.col("least")
    t = F.when(varies, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0)
    return s.select(*BY, t.alias("t"), F.when(varies, student_p(t, F.col("n") - 1)).otherwise(1.0).alias("p"))


def variance_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """F statistic of pitch variances, degrees of freedom and two-sided p-value; (1, 1) where a side doesn't vary. Songs with two notes or more on both sides."""
    side = lambda df, s: df.groupBy("song_id").agg(F.var_samp("pitch").alias(f"v{s}"), (F.count("*") - 1).alias(f"df{s}")).where(f"df{s} > 0")
    varied = (F.col("v1") > 1e-10) & (F.col("v2") > 1e-10)
    s = side(a, 1).join(side(b, 2), "song_id").withColumn("f", F.when(varied, F.col("v1") / F.col("v2")).otherwise(1.0))
    return s.select("song_id", "f", "df1", "df2", F.when(varied, variance_p(F.col("f"), F.col("df1"), F.col("df2"))).otherwise(1.0).alias("p"))


def significance(ranks: DataFrame, signed: DataFrame, paired: DataFrame) -> DataFrame:
    """By song, how many tests are valid and how many of them significant, whether these are more than half, and the mean p-value of Mann-Whitney tests.

    ranks: Mann-Whitney tests of pitch, velocity and duration; signed and paired: Wilcoxon and t tests of pitch. A p-value of 0 is no
    valid one for the rank tests and counts as 1 for the paired ones.
    """
    positive = F.when(F.col("p") > 0, F.col("p"))
    tests = ranks.select("song_id", positive.alias("p"), F.lit(True).alias("rank"))
    for more in (signed, paired):
        tests = tests.unionByName(more.where("feature = 'pitch'").select("song_id", F.coalesce(positive, F.lit(1.0)).alias("p"), F.lit(False).alias("rank")))
    s = tests.groupBy("song_id").agg(F.count("p").alias("tests"), F.count_if(F.col("p") < ALPHA).alias("significant"), F.avg(F.when(F.col("rank"), F.col("p"))).alias("mean_p"))
    return s.withColumn("differs", F.col("significant") * 2 > F.col("tests"))
