"""Series of metric archives in slices, and their increments without a sort of the samples."""

from pyspark.sql import functions as F

from plumeline.operators import metrics as mt
from plumeline.sinks.archive import archive_chunks, write_archive
from plumeline.sources import ftdc


def test_increments_of_series_longer_than_a_slice(spark, tmp_path):
    """equal to the window over samples, across slices, and planned without a window or a sort of the samples."""
    big = 1 << 60
    rows = [("f1", c, i, [i * i % 977 + big, -i]) for c, n in ((0, 2 * ftdc.SLICE + 5), (1, 1), (2, ftdc.SLICE)) for i in range(n)]
    samples = spark.createDataFrame(rows, "file string, chunk long, i long, values array<bigint>").withColumn("ts", F.timestamp_millis("i"))
    write_archive(archive_chunks(samples, ["a.x", "y"]), str(tmp_path / "archives"))
    series = ftdc.decode_series(spark, [str(tmp_path / "archives")])[0]
    assert max(len(r["values"]) for r in series.select("values").collect()) == ftdc.SLICE
    decoded = ftdc.decode_ftdc(spark, [str(tmp_path / "archives")])[0]
    columns = ["chunk_no", "path", "sample_no", "ts", "value", "inc"]
    found = mt.series_increments(series)
    got = sorted(tuple(r) for r in found.select(columns).collect())
    assert got == sorted(tuple(r) for r in mt.increments(decoded).select(columns).collect())
    assert len(got) == 3 * len(rows)
    x = [(v, i) for c, p, _, _, v, i in got if (c, p) == (0, ["a", "x"])]
    assert [v for v, _ in x] == [i * i % 977 + big for i in range(2 * ftdc.SLICE + 5)] and [i for _, i in x][1:] == [b[0] - a[0] for a, b in zip(x, x[1:])]
    best = mt.max_increment(mt.increments(decoded), ["file", "path"])
    assert best.count() == 2 and sorted(mt.largest_steps(series).collect()) == sorted(best.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Window", "Sort", "Exchange") if node in plan]
