"""Queries on verdicts, reports, sequence quality and further statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, sequences, statistics
from ..operators import verdicts as v
from .catalog import PAIRS, add

#: Component scores of the files of the derived results table.
SCORES = """SELECT file_id, batch_id, success, error_message, CAST(overall_score AS DOUBLE) AS round_trip, seconds / 37.0D AS musical, CASE WHEN success THEN 0.9D ELSE 0.0D END AS sequence, overall_score * 0.9D AS statistical,
  (file_id % 17) / 100.0D AS missing_ratio, 1 - (file_id % 11) / 50.0D AS timing, 1 - (file_id % 13) / 100.0D AS velocity, file_id % 3000 AS tokens, 1 - (file_id % 5) / 8.0D AS completeness, CASE file_id % 3 WHEN 0 THEN 'minimal' WHEN 1 THEN 'very_complex' ELSE 'moderate' END AS level FROM results"""
SC = f", sc AS ({SCORES.replace('.0D', '.0::DOUBLE').replace('0.9D', '0.9::DOUBLE')})"


def scored(results):  # noqa: ANN001, ANN201
    columns = SCORES.removeprefix("SELECT ").removesuffix(" FROM results")
    depth, parts, here = 0, [], ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(here)
            here = ""
        else:
            here += ch
    return results.selectExpr(*parts, here)


def r6(name, column):  # noqa: ANN001, ANN201
    return F.round(column, 6).alias(name)


OVER = "CASE WHEN {w} > 0 THEN least(1, greatest(0, ({s}) / ({w}) * (0.95 + 0.05 * completeness))) ELSE 0 END"
NAMES = ("round_trip", "musical", "sequence", "statistical")


def over(weights):  # noqa: ANN001, ANN201
    return OVER.format(s=" + ".join(f"CASE WHEN {c} > 0 THEN {c} * {w} ELSE 0 END" for c, w in zip(NAMES, weights, strict=True)), w=" + ".join(f"CASE WHEN {c} > 0 THEN {w} ELSE 0 END" for c, w in zip(NAMES, weights, strict=True))).replace("WHEN CASE", "WHEN (CASE", 1).replace(" > 0 THEN least", ") > 0 THEN least", 1)


add("QUA02", "results", lambda r: scored(r).select("file_id", *(v.overall(w).alias(u) for u, w in v.USE_CASES.items())), f"{SC} SELECT file_id, {', '.join(f'({over(w)})::DOUBLE AS {u}' for u, w in v.USE_CASES.items())} FROM sc")
add("QUA03", "results", lambda r: scored(r).select("file_id", *(c.alias(k) for k, c in v.categories().items()), r6("confidence", v.confidence())),
    f"""{SC}, l AS (SELECT *, list_filter([round_trip, musical, sequence, statistical], lambda x: x > 0) AS xs FROM sc), m AS (SELECT *, coalesce(list_aggregate(xs, 'stddev_samp'), 0) AS sd FROM l)
SELECT file_id, round_trip * 0.6 + statistical * 0.4 AS accuracy, musical * 0.7 + sequence * 0.3 AS musicality, sequence * 0.5 + statistical * 0.5 AS technical, round_trip * 0.5 + musical * 0.5 AS preservation,
round(completeness * CASE level WHEN 'very_complex' THEN 0.9 WHEN 'minimal' THEN 0.95 ELSE 1 END * CASE WHEN sd > 0.2 THEN 1 - sd ELSE 1 END, 6) AS confidence FROM m""")  # fmt: skip
add("QUA05", "results", lambda r: scored(r).select("file_id", F.array_join(v.critical_issues(), ",").alias("issues")),
    f"""{SC} SELECT file_id, array_to_string(list_filter([CASE WHEN round_trip > 0 AND round_trip < 0.8 THEN 'round trip' END, CASE WHEN musical > 0 AND musical < 0.7 THEN 'musical fidelity' END, CASE WHEN sequence > 0 AND sequence < 0.6 THEN 'sequence quality' END,
CASE WHEN statistical > 0 AND statistical < 0.7 THEN 'statistics' END, CASE WHEN missing_ratio > 0.1 THEN 'missing notes' END, CASE WHEN timing < 0.9 THEN 'timing' END, CASE WHEN completeness < 0.5 THEN 'incomplete' END], lambda x: x IS NOT NULL), ',') AS issues FROM sc""")  # fmt: skip
QUICK = """list_filter([CASE WHEN missing_ratio > 0.01 THEN 1 - missing_ratio * 2 END, CASE WHEN timing < 0.98 THEN timing END, CASE WHEN velocity < 0.95 THEN velocity * 1.05 END, CASE WHEN tokens > 2000 THEN 0.95 WHEN tokens < 500 THEN 1.02 END], lambda x: x IS NOT NULL)"""
add("QUA06", "results", lambda r: scored(r).select("file_id", v.quick_score().alias("score")), f"{SC}, l AS (SELECT file_id, round_trip, {QUICK} AS ms FROM sc) SELECT file_id, least(1, greatest(0, round_trip * coalesce(list_avg(ms), 1)))::DOUBLE AS score FROM l")
PROD = over(v.USE_CASES["production"])
add("QUA14", "results", lambda r: scored(r).select("file_id", *(c.alias(k) for k, c in v.file_result().items())),
    f"{SC} SELECT file_id, round_trip >= 0.95 AS validation_passed, {PROD} >= 0.9 AS quality_passed, (round_trip + {PROD}) / 2 AS overall_score FROM sc")
add("QUA13", "results", v.history_advice, """, n AS (SELECT batch_id, count_if(contains(lower(error_message), 'memory')) AS m, count_if(contains(lower(error_message), 'token')) AS t, count_if(contains(lower(error_message), 'corrupt')) AS c FROM results GROUP BY 1)
SELECT batch_id, a AS advice FROM (SELECT batch_id, m > 2 AS ok, unnest(['max_seq_length=1024', 'chunk_size_seconds=20', 'enable_chunking=true']) AS a FROM n UNION ALL SELECT batch_id, t > 3, unnest(['tokenization=REMI', 'simplify_vocabulary=true']) FROM n UNION ALL SELECT batch_id, c > 5, unnest(['strict_validation=false', 'skip_corrupted=true']) FROM n) x WHERE ok""")  # fmt: skip
RECS = """, w AS (SELECT avg(q) AS q, coalesce(stddev_samp(q), 0) AS s, avg(seconds) AS t, max(batch_id) AS last FROM (SELECT *, CASE WHEN success THEN overall_score END AS q FROM results) x),
l AS (SELECT count_if(contains(error_message, 'memory')) AS m, count_if(contains(error_message, 'token')) AS k FROM results, w WHERE batch_id = last),
rc AS (SELECT parameter, value, impact, confidence::DOUBLE AS confidence FROM (SELECT q < 0.9 AS ok, 'validation.quality_threshold' AS parameter, '0.85' AS value, 'medium' AS impact, 0.8 AS confidence FROM w UNION ALL SELECT s > 0.2, 'validation.enable_round_trip_test', 'true', 'high', 0.7 FROM w
UNION ALL SELECT m > 0, 'processing.max_file_size_mb', '5', 'high', 0.9 FROM l UNION ALL SELECT m > 0, 'tokenizer.max_seq_length', '1024', 'high', 0.85 FROM l UNION ALL SELECT k > 2, 'tokenization', 'REMI', 'high', 0.8 FROM l UNION ALL SELECT t > 30, 'processing.parallel_processing', 'true', 'high', 0.9 FROM w) y WHERE ok)"""
add("QUA12", "results", v.recommendations, f"{RECS} SELECT * FROM rc")
add("TOP05", "results", lambda r: v.by_impact(v.recommendations(r)), f"{RECS} SELECT *, round(CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * confidence, 6) AS weight FROM rc ORDER BY weight DESC, parameter LIMIT 10")
RUNS = "SELECT song_id, s AS strategy, (song_id + length(s)) % 3 = 0 AS valid FROM songs, (SELECT unnest(['REMI', 'TSD', 'Structured']) AS s) t"
add("QUA15", "songs", lambda s: v.first_valid(s.where("song_id % 4 <> 0").select("song_id", F.explode(F.array(*map(F.lit, ("TSD", "Structured", "REMI")))).alias("strategy")).withColumn("valid", (F.col("song_id") + F.length("strategy")) % 3 == 0)),
    f", r AS ({RUNS} WHERE song_id % 4 <> 0) SELECT song_id, arg_min(strategy, CASE strategy WHEN 'REMI' THEN 1 WHEN 'TSD' THEN 2 ELSE 3 END) FILTER (WHERE valid) AS strategy, bool_or(valid) AS valid FROM r GROUP BY 1")
add("JOI14", "songs results", lambda s, r: v.similar_history(s.select("song_id", (F.col("song_id") % 10 / 10).alias("complexity")), r.select((F.col("file_id") % 23 / 20).alias("complexity"), F.when(F.col("success"), F.col("overall_score")).otherwise(0.5).alias("accuracy"))),
    """, p AS (SELECT (file_id % 23) / 20.0::DOUBLE AS c, count(*) AS n, sum(CASE WHEN success THEN overall_score ELSE 0.5 END) AS s FROM results GROUP BY 1), m AS (SELECT song_id, sum(n) AS runs, sum(s) / sum(n) AS mean FROM songs JOIN p ON abs(c - (song_id % 10) / 10.0::DOUBLE) < 0.2 GROUP BY 1)
SELECT s.song_id, CAST(coalesce(runs, 0) AS BIGINT) AS runs, round(mean, 6) AS mean, round(CASE WHEN mean < 0.9 THEN 1.9 - mean WHEN mean > 0.98 THEN 0.9 ELSE 1 END, 6)::DOUBLE AS factor FROM songs s LEFT JOIN m ON m.song_id = s.song_id""")  # fmt: skip
add("AGG13", "results", v.batch_results, """, e AS (SELECT batch_id, string_agg(concat(error_message, ':', c), ';' ORDER BY concat(error_message, ':', c)) AS errors FROM (SELECT batch_id, error_message, count(*) AS c FROM results WHERE error_message IS NOT NULL GROUP BY 1, 2) x GROUP BY 1)
SELECT r.batch_id, count(*) AS files, count_if(success) AS valid, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, CAST(sum(CASE WHEN success THEN seconds ELSE 0 END) AS BIGINT) AS seconds, round(coalesce(avg(CASE WHEN success THEN overall_score END), 0), 6) AS avg_accuracy,
round(min(CASE WHEN success THEN overall_score END), 6) AS min_accuracy, round(max(CASE WHEN success THEN overall_score END), 6) AS max_accuracy, coalesce(any_value(errors), '') AS errors FROM results r LEFT JOIN e ON e.batch_id = r.batch_id GROUP BY r.batch_id""")  # fmt: skip
add("AGG16", "results", lambda r: v.chunk_rollup(r.select(F.col("batch_id").alias("song_id"), F.when(F.col("batch_id") % 3 == 0, 1.0).otherwise(F.col("overall_score")).alias("accuracy"), F.col("seconds").alias("notes")), r.groupBy(F.col("batch_id").alias("song_id")).agg((F.sum("seconds") + F.max("batch_id") * 20).alias("notes"))),
    """SELECT batch_id AS song_id, count(*) AS chunks, count_if(a < 0.95) AS failed, count_if(seconds = 0) AS empty, count_if(a < 0.95) <= count(*) * 0.2 AS valid, batch_id * 20 > 0.02 * (sum(seconds) + batch_id * 20) AS incomplete FROM (SELECT *, CASE WHEN batch_id % 3 = 0 THEN 1.0 ELSE overall_score END AS a FROM results) x GROUP BY batch_id""")  # fmt: skip
add("AGG19", "results", lambda r: v.campaign(r.groupBy("batch_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("files"), F.count_if(F.contains(F.col("error_message"), F.lit("memory"))).alias("memory_errors"))),
    """, b AS (SELECT sum(seconds) AS s, count(*) AS f, count_if(contains(error_message, 'memory')) AS m FROM results GROUP BY batch_id), t AS (SELECT sum(s) / 3600.0 AS h, sum(f) AS f, sum(m) AS m, avg(s * 1.0 / f) AS mean FROM b)
SELECT round(h, 6)::DOUBLE AS hours, round(f / greatest(h / 24, 1), 6)::DOUBLE AS files_per_day, round(least(1, 10 / greatest(mean, 1)), 6)::DOUBLE AS cpu, round(1 - m * 1.0 / f, 6)::DOUBLE AS memory, round(least(1, f / greatest(h / 24, 1) / 1000), 6)::DOUBLE AS throughput FROM t""")  # fmt: skip
add("AGG20", "results", v.file_report, "SELECT file_id, success, overall_score, seconds, CASE WHEN error_message IS NULL THEN 0 ELSE 1 END AS errors, (SELECT round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) FROM results) AS success_rate FROM results")
add("AGG30", "results", lambda r: v.generation_statistics(r.withColumn("violations", F.col("file_id") % 3)), "SELECT batch_id, count(*) AS runs, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(seconds), 6) AS avg_seconds, CAST(sum(file_id % 3) AS BIGINT) AS violations FROM results GROUP BY 1")
add("TOP06", "results", lambda r: v.most_frequent(scored(r).select(v.critical_issues().alias("issues")), "issues"),
    f"""{SC}, i AS (SELECT unnest(list_filter([CASE WHEN round_trip > 0 AND round_trip < 0.8 THEN 'round trip' END, CASE WHEN musical > 0 AND musical < 0.7 THEN 'musical fidelity' END, CASE WHEN sequence > 0 AND sequence < 0.6 THEN 'sequence quality' END,
CASE WHEN statistical > 0 AND statistical < 0.7 THEN 'statistics' END, CASE WHEN missing_ratio > 0.1 THEN 'missing notes' END, CASE WHEN timing < 0.9 THEN 'timing' END, CASE WHEN completeness < 0.5 THEN 'incomplete' END], lambda x: x IS NOT NULL)) AS item FROM sc)
SELECT item, count(*) AS count FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")  # fmt: skip
add("SET06", "files", lambda f: f.select("song_id", F.array_join(v.collected(F.array("key", F.concat(F.lit("t"), F.col("song_id") % 3), "key", F.lit("past three")), F.array(F.lit("t1"), "key", F.lit("z"))), ",").alias("warnings")),
    "SELECT song_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS warnings FROM (SELECT song_id, [key, concat('t', song_id % 3), key, 't1', key, 'z'] AS l FROM files) y")

add("STA10", "notes recon", statistics.kendall_of_sides, f""", {PAIRS}, c AS (SELECT song_id, pa, pb, count(*) AS c FROM pr GROUP BY 1, 2, 3), s AS (SELECT a.song_id, sum(sign(a.pa - b.pa) * sign(a.pb - b.pb) * a.c * b.c) / 2 AS s FROM c a JOIN c b ON a.song_id = b.song_id GROUP BY 1),
t AS (SELECT song_id, sum(c) AS n FROM c GROUP BY 1), x AS (SELECT song_id, sum(c * (c - 1) / 2) AS t FROM (SELECT song_id, pa, sum(c) AS c FROM c GROUP BY 1, 2) q GROUP BY 1), y AS (SELECT song_id, sum(c * (c - 1) / 2) AS t FROM (SELECT song_id, pb, sum(c) AS c FROM c GROUP BY 1, 2) q GROUP BY 1)
SELECT t.song_id, round(s.s / sqrt((n * (n - 1) / 2 - x.t) * (n * (n - 1) / 2 - y.t)), 6) AS tau FROM t JOIN s USING (song_id) JOIN x USING (song_id) JOIN y USING (song_id)""")  # fmt: skip
add("STA11", "notes recon", lambda a, b: statistics.mutual_information(compare.paired(a, b)), f""", {PAIRS}, j AS (SELECT song_id, pa // 5 AS x, pb // 5 AS y, count(*) AS c FROM pr GROUP BY 1, 2, 3), jx AS (SELECT song_id, x, sum(c) AS c FROM j GROUP BY 1, 2), jy AS (SELECT song_id, y, sum(c) AS c FROM j GROUP BY 1, 2), t AS (SELECT song_id, sum(c) AS n FROM j GROUP BY 1),
mi AS (SELECT j.song_id, sum(j.c / n * ln(j.c * n / (jx.c * jy.c)::DOUBLE)) AS v FROM j JOIN t USING (song_id) JOIN jx USING (song_id, x) JOIN jy USING (song_id, y) GROUP BY 1), hx AS (SELECT song_id, -sum(c / n * ln(c / n)) AS v FROM jx JOIN t USING (song_id) GROUP BY 1), hy AS (SELECT song_id, -sum(c / n * ln(c / n)) AS v FROM jy JOIN t USING (song_id) GROUP BY 1)
SELECT song_id, round(mi.v / greatest(hx.v, hy.v), 6) AS information FROM mi JOIN hx USING (song_id) JOIN hy USING (song_id)""")  # fmt: skip
add("STA12", "notes recon", statistics.cross_correlation, f""", {PAIRS.replace('SELECT a.song_id', 'SELECT a.song_id, a.k')},
z AS (SELECT song_id, k, (pa - avg(pa) OVER w) / (stddev_pop(pa) OVER w + 1e-10) AS x, (pb - avg(pb) OVER w) / (stddev_pop(pb) OVER w + 1e-10) AS y, count(*) OVER w AS n FROM pr WINDOW w AS (PARTITION BY song_id)),
r AS (SELECT a.song_id, a.k - b.k AS lag, round(sum(a.x * b.y) / any_value(a.n), 6) AS r FROM z a JOIN z b ON b.song_id = a.song_id AND a.k - b.k BETWEEN -(a.n // 2) AND a.n - a.n // 2 - 1 WHERE a.n >= 10 GROUP BY 1, 2)
SELECT song_id, r AS peak, CAST(lag AS INT) AS lag FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY abs(r) DESC, lag) AS p FROM r) q WHERE p = 1""")  # fmt: skip
add("STA07", "results", lambda r: scored(r).select("file_id", r6("score", statistics.distribution_score(F.col("missing_ratio"), F.col("tokens") / 10, 1 - F.col("timing"), 1 - F.col("velocity"), F.col("musical")))),
    f"{SC} SELECT file_id, round(list_avg(list_filter([CASE WHEN missing_ratio > 0 THEN least(1, missing_ratio * 10) END, greatest(0, 1 - tokens / 10.0 / 100), greatest(0, timing), velocity, CASE WHEN musical > 0 THEN least(1, musical * 10) END], lambda x: x IS NOT NULL)), 6) AS score FROM sc")

ROWS = ", n AS (SELECT song_id, token_id, row_number() OVER (PARTITION BY song_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY song_id) AS n FROM tokens)"
add("SEQ05", "tokens", sequences.structural_coherence, f"""{ROWS}, p AS (SELECT *, least(10, n // 20) AS k FROM n), q AS (SELECT *, CASE WHEN k > 1 THEN least(i // (n // k), k - 1) ELSE 0 END AS part FROM p), l AS (SELECT song_id, k, part, token_id, count(*) AS c FROM q GROUP BY 1, 2, 3, 4), g AS (SELECT song_id, token_id, count(*) AS g FROM n GROUP BY 1, 2),
s AS (SELECT l.song_id, l.k, l.part, sum(c * g) AS cg, sum(c * c) AS cc FROM l JOIN g ON g.song_id = l.song_id AND g.token_id = l.token_id GROUP BY 1, 2, 3), gg AS (SELECT song_id, sum(g * g)::DOUBLE AS gg FROM g GROUP BY 1)
SELECT s.song_id, round(CASE WHEN any_value(k) < 2 THEN 1 ELSE avg(cg / sqrt(cc * gg)) END, 6) AS coherence FROM s JOIN gg ON gg.song_id = s.song_id GROUP BY 1""")  # fmt: skip
add("SEQ08", "tokens notes", sequences.compression, """, c AS (SELECT song_id, token_id, count(*) AS c FROM tokens GROUP BY 1, 2), s AS (SELECT song_id, sum(c)::DOUBLE AS t, count(*) AS k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY 1), m AS (SELECT song_id, count(*) AS m FROM notes GROUP BY 1)
SELECT s.song_id, round(t / m, 6) AS ratio, round(t / m * log2(533), 6) AS bits_per_note, round(1 - t / m * log2(533) / 24, 6) AS effective, round(k / t, 6) AS density, round(1 - k / t, 6) AS redundancy, round(e / log2(533), 6) AS efficiency FROM s JOIN m ON m.song_id = s.song_id""")  # fmt: skip
GRAMS = """{rows}, a AS (SELECT song_id, list(token_id ORDER BY pos) AS l FROM tokens GROUP BY 1), f AS (SELECT n.song_id, n.n, k.k AS length, l[i + 1:i + k.k] AS gram, count(*) AS count, min(i) AS first FROM n JOIN a ON a.song_id = n.song_id JOIN (SELECT unnest(range({least}, 20)) AS k) k ON i + k.k <= n.n AND k.k < n.n // 2 GROUP BY 1, 2, 3, 4 HAVING count(*) >= {times}),
p AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY count * length DESC, length, first) AS place FROM f)"""
add("SEQ09", "tokens", lambda t: sequences.repeated_patterns(t).drop("n"), GRAMS.format(rows=ROWS, least=4, times=2) + " SELECT song_id, CAST(place AS INT) AS place, CAST(length AS INT) AS length, count, first FROM p WHERE place <= 20")
add("SEQ10", "tokens", sequences.has_structure, GRAMS.format(rows=ROWS, least=4, times=2) + " SELECT s.song_id, coalesce(count_if(p.count >= 4), 0) > 5 AS structured FROM (SELECT DISTINCT song_id FROM tokens) s LEFT JOIN p ON p.song_id = s.song_id AND place <= 20 GROUP BY 1")
add("SEQ12", "tokens", sequences.motif_score, GRAMS.format(rows=ROWS, least=3, times=3) + """, c AS (SELECT song_id, sum(count * length) * 1.0 / any_value(n) AS c FROM p WHERE place <= 10 GROUP BY 1)
SELECT s.song_id, round(CASE WHEN s.n < 20 THEN 1 WHEN c IS NULL THEN 0.5 WHEN c < 0.1 THEN c * 5 WHEN c > 0.7 THEN greatest(0, 1.7 - c) ELSE 1 END, 6)::DOUBLE AS motif FROM (SELECT song_id, count(*) AS n FROM tokens GROUP BY 1) s LEFT JOIN c ON c.song_id = s.song_id""")  # fmt: skip
add("SEQ11", "tokens", sequences.phrase_coherence, f"""{ROWS}, a AS (SELECT song_id, list(token_id ORDER BY pos) AS l FROM tokens GROUP BY 1), o AS (SELECT n.song_id, k.k, l[i + 1:i + 8] AS o, count(*) AS c FROM n JOIN a ON a.song_id = n.song_id JOIN (SELECT unnest([16, 32, 64, 128]) AS k) k ON n >= 2 * k.k AND i % k.k = 0 AND i < n - k.k GROUP BY 1, 2, 3),
s AS (SELECT song_id, k, max(c) * 1.0 / sum(c) AS s FROM o GROUP BY 1, 2 HAVING sum(c) > 1), m AS (SELECT song_id, avg(s) AS m FROM s GROUP BY 1)
SELECT t.song_id, round(coalesce(m, 0.5), 6)::DOUBLE AS coherence FROM (SELECT DISTINCT song_id FROM tokens) t LEFT JOIN m ON m.song_id = t.song_id""")  # fmt: skip
