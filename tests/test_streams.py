"""Sweeps of edits: in batches, as a stream, and from the page-wise source."""

import json

from pyspark.sql import functions as F

from corrobora.sources.changes import RecentChanges
from corrobora.streaming import sweep as S

EDITS = [("en", i % 40, f"2024-01-{1 + i % 20:02d}T00:00:00Z", "uses The Tool" if i % 3 else "other") for i in range(120)]
SCHEMA = "wiki string, revid long, timestamp string, comment string"


def fake_pages(wiki, start, end, token):
    """Two pages of changes for each wiki."""
    rows = [{"revid": i, "timestamp": f"2024-01-0{i}T00:00:00Z", "comment": "c", "oldlen": 1, "newlen": 3 if i == 2 else None, "minor": i == 1} for i in ((3, 2) if token is None else (1,))]
    return [r for r in rows if start < r["timestamp"] <= end], "next" if token is None else None


def test_second_sweep_adds_nothing(spark):
    changes = spark.createDataFrame(EDITS, SCHEMA)
    log = spark.createDataFrame([], SCHEMA)
    first = S.sweep(changes, log, "the tool", F.lit("now"))
    assert first.count() == 40
    assert S.sweep(changes, first, "the tool", F.lit("later")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame(EDITS, SCHEMA).repartition(4).write.json(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    for _ in range(2):  # a second run finds nothing new
        S.stream_exact(stream, "the tool", f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/log")
        assert sorted(r[0] for r in got.select("revid").collect()) == list(range(40))
    S.stream_exact(stream, "the tool", f"{tmp_path}/log", f"{tmp_path}/again").awaitTermination()  # replayed from the start
    assert spark.read.parquet(f"{tmp_path}/log").count() == 40


def test_bounded_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame(EDITS, SCHEMA).write.json(source)
    stream = spark.readStream.schema(SCHEMA).json(source)
    query = S.stream_within(stream, "the tool", "timestamp").writeStream.format("memory").queryName("bounded").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("bounded").count() == 40


def test_recent_changes_are_read_page_by_page(spark):
    spark.dataSource.register(RecentChanges)
    options = {"wikis": "en,fr", "pages": "tests.test_streams:fake_pages", "start": "2024-01-00", "end": "2024-01-09"}
    rows = spark.read.format("recent_changes").options(**options).load().collect()
    assert len(rows) == 6 and {(r["revid"], r["size_delta"], r["is_minor"]) for r in rows} == {(3, None, False), (2, 2, False), (1, None, True)}


def test_stream_by_day_equals_the_exact_one_and_reads_near_days(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([*EDITS, ("en", 77, None, "the tool"), ("en", 3, "2024-03-01T00:00:00Z", "late"), ("en", 500, "2024-03-01T00:00:00Z", "the tool")], SCHEMA).repartition(4).write.json(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    S.stream_exact(stream, "the tool", f"{tmp_path}/exact", f"{tmp_path}/c0").awaitTermination()
    for again in ("c1", "c1", "c2"):  # run again, and replayed from the start
        S.stream_by_day(stream, "the tool", f"{tmp_path}/log", f"{tmp_path}/{again}").awaitTermination()
        keys = lambda p: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{p}").select("wiki", "revid").collect()))
        assert keys("log") == keys("exact")
    near = S.logged_between(spark, f"{tmp_path}/log", "2024-01-02", "2024-01-03")
    assert {r["day"] and r["day"].day for r in near.select("day").distinct().collect()} == {2, 3, None}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(day" in plan or "PartitionFilters: [((isnull(day" in plan


def wiki_pages(wiki, start, end, token):
    """Changes from a file a wiki (named in ``end``'s place by the environment), newest first, two a page; a wiki may be down."""
    import os

    with open(f"{os.environ['WIKI_FOLDER']}/{wiki}.json") as f:
        stamps = json.load(f)
    if stamps is None:
        raise RuntimeError("HTTP 500")
    rows = [{"revid": i, "timestamp": f"2024-01-01T00:00:{i:02d}Z", "comment": "c"} for i in stamps]
    rows = sorted((r for r in rows if start <= r["timestamp"] <= end), key=lambda r: r["timestamp"], reverse=True)
    at = int(token or 0)
    return rows[at : at + 2], str(at + 2) if at + 2 < len(rows) else None


def test_wikis_are_read_by_their_own_offsets(spark, tmp_path, monkeypatch):
    from corrobora.sources import changes as C

    monkeypatch.setenv("WIKI_FOLDER", str(tmp_path))
    tell = lambda wiki, stamps: (tmp_path / f"{wiki}.json").write_text(json.dumps(stamps))
    options = {"wikis": "en,fr", "pages": "tests.test_streams:wiki_pages", "start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00Z"}
    got, offset = [], {}

    def batch(reader):
        nonlocal offset
        end = reader.latestOffset()
        got.extend(row[:2] for p in reader.partitions(offset, end) for row in reader.read(p))
        offset = end
        return end

    tell("en", [1, 2, 3]), tell("fr", [1])
    options["overlap"] = "0"
    reader = C._Stream(options)
    assert batch(reader) == {"en": "2024-01-01T00:00:03Z", "fr": "2024-01-01T00:00:01Z"}
    tell("en", [1, 2, 3, 4, 5, 6]), tell("fr", None)
    assert batch(reader)["fr"] == "2024-01-01T00:00:01Z"  # down: it keeps its offset, and en goes on
    reader = C._Stream(options)  # a restart, fr still down
    assert batch(reader) == {"en": "2024-01-01T00:00:06Z"}
    tell("fr", [1, 2, 3])
    batch(reader)
    batch(reader)  # nothing new
    assert sorted(got) == [*(("en", i) for i in range(1, 7)), *(("fr", i) for i in (1, 2, 3))]
    tell("en", [*range(1, 8)])
    late = C._Stream({**options, "overlap": "2"})
    late.known = dict(offset)
    assert sorted(r[1] for p in late.partitions(offset, late.latestOffset()) for r in late.read(p)) == [4, 5, 6, 7]


def test_recent_changes_stream_restarts(spark, tmp_path):
    spark.dataSource.register(RecentChanges)
    options = {"wikis": "en,fr", "pages": "tests.test_streams:static_pages", "start": "2024-01-01T00:00:00Z"}
    counts = []
    for end in ("2024-01-03T00:00:00Z", "2024-01-03T00:00:00Z", "2024-01-09T00:00:00Z"):
        stream = spark.readStream.format("recent_changes").options(**options, end=end).load()
        S.stream_by_day(stream, "c", f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
        counts.append(spark.read.parquet(f"{tmp_path}/log").count())
    assert counts == [6, 6, 16]
    assert spark.read.parquet(f"{tmp_path}/log").dropDuplicates(S.KEY).count() == 16


def static_pages(wiki, start, end, token):
    """Eight changes a wiki, one a day."""
    rows = [{"revid": i, "timestamp": f"2024-01-0{i}T00:00:00Z", "comment": "c"} for i in range(8, 0, -1)]
    return [r for r in rows if start <= r["timestamp"] <= end], None
