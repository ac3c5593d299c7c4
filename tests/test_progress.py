"""The stream of file results: what has arrived so far, arrival by arrival, equals the same on a batch."""

import random

from stavework.streaming.progress import counted, follow, progress

SCHEMA = "batch_id int, status string, seconds int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_arrivals(spark, tmp_path):
    rng = random.Random(1)
    made = [(rng.randrange(4), rng.choice(["completed", "completed", "failed", "skipped", None]), rng.randrange(9)) for _ in range(400)]
    first, second = spark.createDataFrame(made[:250], SCHEMA), spark.createDataFrame([(9, "completed", 3), *made[250:]], SCHEMA)
    totals = spark.createDataFrame([(0, 500), (1, 120), (2, 10), (3, 100), (7, 5)], "batch_id int, total long")
    folders = [str(tmp_path / x) for x in ("incoming", "reports", "state")]

    def run():
        return follow(spark, folders[0], first.schema, totals, folders[1], folders[2], 2)

    first.repartition(5).write.parquet(folders[0])
    assert rows(run()) == rows(progress(counted(first), totals))
    assert spark.read.parquet(folders[1]).select("micro").distinct().count() == 3  # five files by twos
    assert rows(run()) == rows(progress(counted(first), totals))
    second.repartition(3).write.mode("append").parquet(folders[0])
    both = rows(run())
    assert both == rows(progress(counted(first.unionByName(second)), totals))
    by_batch = {r[0]: r for r in both}
    assert by_batch[9][1:8] == (1, 1, 1, 0, 0, 1.0, 100.0) and by_batch[2][-1] == 0 and 7 not in by_batch
    assert all(r[2] == r[3] + r[4] + r[5] for r in both)


def test_nothing_has_arrived(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    empty = spark.createDataFrame([], SCHEMA)
    totals = spark.createDataFrame([(1, 5)], "batch_id int, total long")
    assert follow(spark, str(tmp_path / "incoming"), empty.schema, totals, str(tmp_path / "reports"), str(tmp_path / "state")).count() == 0


def test_workers_share_the_time(spark):
    results = spark.createDataFrame([(1, "completed", 6), (1, "failed", 2)], SCHEMA)
    totals = spark.createDataFrame([(1, 8)], "batch_id int, total long")
    (r,) = progress(counted(results), totals, workers=4).collect()
    assert (r.percent, r.success_rate, r.avg_seconds, r.elapsed, r.remaining) == (25.0, 0.5, 4.0, 2.0, 6.0)
