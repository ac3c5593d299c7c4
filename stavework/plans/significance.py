"""Queries on histograms of features, and on tests of whether two note tables differ, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import TERMS
from ..operators import compare
from ..operators import significance as sg
from .catalog import PAIRS, add

HISTOGRAMS = ("onset", "duration", "pitch", "pitch_class", "octave")
SIMILAR = ("pitch", "pitch_class", "octave", "gap", "interval")
COMPARED = ("pitch", "velocity", "duration", "interval")
RANKED = ("pitch", "velocity", "duration")
CATEGORIES = ("pitch", "velocity")

VALUES = {
    "pitch": "pitch", "velocity": "velocity", "duration": "end_tick - start_tick", "onset": "start_tick", "pitch_class": "pitch % 12", "octave": "pitch // 12",
    "interval": "pitch - lag(pitch) OVER before", "gap": "start_tick - lag(start_tick) OVER before",
}


def counts(features: tuple[str, ...]) -> str:
    names, values = (", ".join(x) for x in ([f"'{f}'" for f in features], [f"({VALUES[f]})::BIGINT" for f in features]))
    side = f"SELECT song_id, unnest([{names}]) AS feature, unnest([{values}]) AS value, {{s}} AS side FROM {{t}} WINDOW before AS (PARTITION BY song_id ORDER BY {', '.join(compare.ORDER)})"
    return f""", counts AS (
  SELECT song_id, feature, value, count_if(side = 0)::BIGINT AS original, count_if(side = 1)::BIGINT AS reconstructed
  FROM ({side.format(s=0, t='notes')} UNION ALL {side.format(s=1, t='recon')}) long_ WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""


def _fold(step: str, start: str) -> str:
    """A scalar folded over TERMS .. 1, as k."""
    return f"list_reduce(list_transform(range({TERMS}, 0, -1), lambda j: j::DOUBLE), lambda acc, k: {step}, ({start})::DOUBLE)"


def upper_gamma(a: str, x: str) -> str:
    """Q(a, x) by the same folds as stavework.functions.special."""
    front = f"exp({a} * ln({x}) - {x} - lgamma({a}))"
    series = _fold(f"1 + {x} / ({a} + k) * acc", "1")
    fraction = _fold(f"{x} + 2 * k - 1 - {a} - k * (k - {a}) / acc", f"{x} + {2 * TERMS + 1} - {a}")
    return f"(CASE WHEN {x} <= 0 THEN 1 WHEN {x} < {a} + 1 THEN 1 - {front} * {series} / {a} ELSE {front} / {fraction} END)"


def lower_beta(a: str, b: str, x: str) -> str:
    def part(p: str, q: str, y: str) -> str:
        front = f"exp(lgamma({p} + {q}) - lgamma({p}) - lgamma({q}) + {p} * ln({y}) + {q} * ln(1 - {y})) / {p}"
        odd = f"-({p} + (k - 1) / 2) * ({p} + {q} + (k - 1) / 2) * {y} / (({p} + k - 1) * ({p} + k))"
        even = f"k / 2 * ({q} - k / 2) * {y} / (({p} + k - 1) * ({p} + k))"
        return f"{front} / {_fold(f'1 + (CASE WHEN k % 2 = 1 THEN {odd} ELSE {even} END) / acc', '1')}"

    return f"(CASE WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {part(b, a, f'(1 - {x})')} ELSE {part(a, b, x)} END)"


def normal_p(z: str) -> str:
    return upper_gamma("0.5::DOUBLE", f"({z} * {z} / 2)")


def _rounded(df: DataFrame) -> DataFrame:
    """Values whose last bits depend on the order of a sum, to six places."""
    return df.withColumns({c: F.round(c, 6) for c in ("p", "chi2", "z", "similarity", "wasserstein") if c in df.columns})


add("AGG28", "notes recon", lambda a, b: sg.value_counts(a, b, HISTOGRAMS), f"{counts(HISTOGRAMS)} SELECT * FROM counts")
add("MUS01", "notes recon", lambda a, b: _rounded(sg.cosines(sg.value_counts(a, b, SIMILAR))), f"""{counts(SIMILAR)}
SELECT song_id, feature, round(CASE WHEN sum(original) > 0 AND sum(reconstructed) > 0 THEN sum(original::DOUBLE * reconstructed) / sqrt(sum(original::DOUBLE * original) * sum(reconstructed::DOUBLE * reconstructed)) ELSE 0 END, 6) AS similarity FROM counts GROUP BY 1, 2""")  # fmt: skip

DISTANCES = f"""{counts(COMPARED)},
shares AS (
  SELECT song_id, feature, n, m, abs(x / n - y / m) AS d, width FROM (
    SELECT song_id, feature, sum(original) OVER upto AS x, sum(reconstructed) OVER upto AS y, sum(original) OVER whole AS n, sum(reconstructed) OVER whole AS m, lead(value) OVER upto - value AS width
    FROM counts WINDOW upto AS (PARTITION BY song_id, feature ORDER BY value), whole AS (PARTITION BY song_id, feature)) r WHERE n >= {sg.FEWEST} AND m >= {sg.FEWEST}),
distances AS (
  SELECT song_id, feature, n::BIGINT AS total_a, m::BIGINT AS total_b, max(d) AS ks, coalesce(sum(d * width), 0)::DOUBLE AS wasserstein, max(d) * any_value(sqrt(n * m / (n + m))) AS scaled FROM shares GROUP BY song_id, feature, n, m),
limits AS (
  SELECT *, CASE WHEN scaled < 0.05 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * k * k * scaled * scaled))))) END AS p FROM distances)"""
add("STA01", "notes recon", lambda a, b: _rounded(sg.distribution_tests(sg.value_counts(a, b, COMPARED)).drop("wasserstein")), f"{DISTANCES} SELECT song_id, feature, total_a AS n, total_b AS m, ks, round(p, 6) AS p, p > {sg.ALPHA} AS identical FROM limits")
add("STA02", "notes recon", lambda a, b: _rounded(sg.distribution_tests(sg.value_counts(a, b, COMPARED))).select("song_id", "feature", "wasserstein"), f"{DISTANCES} SELECT song_id, feature, round(wasserstein, 6) AS wasserstein FROM limits")


add("STA06", "notes recon", lambda a, b: _rounded(sg.chi_square(sg.value_counts(a, b, CATEGORIES))), f"""{counts(CATEGORIES)},
bounds AS (SELECT song_id, feature, count(*) AS kinds, min(value) AS lo, max(value) AS hi, sum(original)::DOUBLE AS n, sum(reconstructed)::DOUBLE AS m FROM counts GROUP BY 1, 2 HAVING sum(original) > 0 AND sum(reconstructed) > 0),
cells AS (
  SELECT song_id, feature, n, m, CASE WHEN kinds > 100 THEN floor((value - lo) * 19 / (hi - lo)) ELSE value END AS cell, sum(original)::DOUBLE AS x, sum(reconstructed)::DOUBLE AS y FROM counts JOIN bounds USING (song_id, feature) GROUP BY 1, 2, 3, 4, 5),
offs AS (SELECT *, abs(x - (x + y) * n / (n + m)) AS off, (x + y) * n / (n + m) AS ex, (x + y) * m / (n + m) AS ey, count(*) OVER (PARTITION BY song_id, feature) = 2 AS few FROM cells),
sums AS (
  SELECT song_id, feature, sum((CASE WHEN few THEN greatest(off - 0.5, 0) ELSE off END) ** 2 / ex + (CASE WHEN few THEN greatest(off - 0.5, 0) ELSE off END) ** 2 / ey) AS chi2, count(*) - 1 AS dof FROM offs GROUP BY 1, 2)
SELECT song_id, feature, round(chi2, 6) AS chi2, dof, round(CASE WHEN dof > 0 THEN {upper_gamma("(dof / 2)", "(chi2 / 2)")} ELSE 1 END, 6) AS p FROM sums""")  # fmt: skip

add("STA08", "notes recon", lambda a, b: compare.correlations(compare.paired(a, b)), f", {PAIRS} SELECT song_id, round(corr(pa, pb), 6) AS pitch, round(corr(va, vb), 6) AS velocity, round(corr(da, db), 6) AS duration, round(corr(sa, sb), 6) AS onset FROM pr GROUP BY 1")

RANKS = f"""{counts(RANKED)},
placed AS (
  SELECT *, coalesce(sum(reconstructed) OVER (PARTITION BY song_id, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, (original + reconstructed)::DOUBLE AS t FROM counts),
us AS (SELECT song_id, feature, sum(original * (below + reconstructed / 2))::DOUBLE AS u, sum(t * t * t - t) AS ties, sum(original)::DOUBLE AS n, sum(reconstructed)::DOUBLE AS m FROM placed GROUP BY 1, 2),
deviations AS (SELECT *, sqrt(n * m / 12 * (n + m + 1 - ties / greatest((n + m) * (n + m - 1), 1))) AS sd FROM us WHERE n > 0 AND m > 0),
zs AS (SELECT *, CASE WHEN sd > 0 THEN (greatest(u, n * m - u) - n * m / 2 - 0.5) / sd ELSE 0 END AS z FROM deviations),
ranked AS (SELECT song_id, feature, u, z, CASE WHEN z > 0 THEN {normal_p("z")} ELSE 1 END AS p FROM zs)"""
add("STA13", "notes recon", lambda a, b: _rounded(sg.mann_whitney(sg.value_counts(a, b, RANKED))), f"{RANKS} SELECT song_id, feature, u, round(z, 6) AS z, round(p, 6) AS p FROM ranked")

SIGNED = f""", {PAIRS},
pv AS (SELECT song_id, unnest(['pitch', 'velocity']) AS feature, unnest([pa, va])::BIGINT AS a, unnest([pb, vb])::BIGINT AS b FROM pr),
sizes AS (SELECT song_id, feature, abs(a - b) AS size, count_if(a > b)::BIGINT AS up, count(*) AS c FROM pv WHERE a <> b GROUP BY 1, 2, 3),
places AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY song_id, feature ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rank FROM sizes),
ws AS (SELECT song_id, feature, sum(c)::DOUBLE AS n, least(sum(up * rank), sum((c - up) * rank))::DOUBLE AS w, sum(c::DOUBLE * c * c - c) AS ties FROM places GROUP BY 1, 2 HAVING sum(c) > 1),
wz AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM ws),
signed_ AS (
  SELECT song_id, feature, coalesce(n, 0)::BIGINT AS differing, coalesce(w, 0) AS w, coalesce(p, 1) AS p FROM (SELECT DISTINCT song_id, feature FROM pv) e LEFT JOIN (SELECT *, {normal_p("z")} AS p FROM wz) z USING (song_id, feature)),
ds AS (SELECT song_id, feature, count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) AS sd, max(a - b) > min(a - b) AS varies FROM pv GROUP BY 1, 2 HAVING count(*) > 1),
ts AS (SELECT song_id, feature, CASE WHEN varies THEN mean / (sd / sqrt(n)) ELSE 0 END AS t, n - 1 AS dof, varies FROM ds),
students AS (SELECT song_id, feature, t, CASE WHEN varies THEN {lower_beta("(dof / 2)", "0.5::DOUBLE", "(dof / (dof + t * t))")} ELSE 1 END AS p FROM ts)"""


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return sg.paired_values(compare.paired(a, b), CATEGORIES)


add("STA14", "notes recon", lambda a, b: _rounded(sg.wilcoxon(_pairs(a, b))), f"{SIGNED} SELECT song_id, feature, differing, w, round(p, 6) AS p FROM signed_")
add("STA15", "notes recon", lambda a, b: _rounded(sg.paired_t(_pairs(a, b))).withColumn("t", F.round("t", 6)), f"{SIGNED} SELECT song_id, feature, round(t, 6) AS t, round(p, 6) AS p FROM students")
BELOW = lower_beta("(df1 / 2)", "(df2 / 2)", "(df1 * f / (df1 * f + df2))")
add("STA16", "notes recon", lambda a, b: _rounded(sg.variance_ratio(a, b)).withColumn("f", F.round("f", 6)), f""",
va AS (SELECT song_id, var_samp(pitch) AS v, count(*) - 1 AS dof FROM notes GROUP BY 1), vb AS (SELECT song_id, var_samp(pitch) AS v, count(*) - 1 AS dof FROM recon GROUP BY 1),
fs AS (SELECT song_id, CASE WHEN va.v > 1e-10 AND vb.v > 1e-10 THEN va.v / vb.v ELSE 1 END AS f, va.v > 1e-10 AND vb.v > 1e-10 AS varied, va.dof AS df1, vb.dof AS df2 FROM va JOIN vb USING (song_id) WHERE va.dof > 0 AND vb.dof > 0)
SELECT song_id, round(f, 6) AS f, df1, df2, round(CASE WHEN varied THEN 2 * least(below, 1 - below) ELSE 1 END, 6) AS p FROM (SELECT *, {BELOW} AS below FROM fs) t""")  # fmt: skip


def _significance(a: DataFrame, b: DataFrame) -> DataFrame:
    pairs = _pairs(a, b)
    return sg.significance(sg.mann_whitney(sg.value_counts(a, b, RANKED)), sg.wilcoxon(pairs), sg.paired_t(pairs))


add("STA17", "notes recon", lambda a, b: _significance(a, b).withColumn("mean_p", F.round("mean_p", 6)), f"""{RANKS}{SIGNED},
tests AS (
  SELECT song_id, CASE WHEN p > 0 THEN p END AS p, true AS rank FROM ranked
  UNION ALL SELECT song_id, CASE WHEN p > 0 THEN p ELSE 1 END, false FROM signed_ WHERE feature = 'pitch'
  UNION ALL SELECT song_id, CASE WHEN p > 0 THEN p ELSE 1 END, false FROM students WHERE feature = 'pitch')
SELECT song_id, count(p) AS tests, count_if(p < {sg.ALPHA})::BIGINT AS significant, round(avg(p) FILTER (rank), 6) AS mean_p, count_if(p < {sg.ALPHA}) * 2 > count(p) AS differs FROM tests GROUP BY 1""")  # fmt: skip
