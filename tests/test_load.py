"""Archive objects to stored tables and back."""

from __future__ import annotations

import json
import random
from pathlib import Path
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from filltape import fixtures
from filltape.operators import bars, coins, decode, lookup, stats, validate
from filltape.plans import load, runs, upkeep
from filltape.schema import FILL_COLUMNS
from filltape.sources import archive, commits, files, store
from filltape.sources.jsonl import read_jsonl
from tests.blocks import block, fill, lz4
from tests.blocks import store as put

AS_OF = datetime(2025, 8, 1)
DAY = ("20250727", "20250727")


def at(hour: int, minute: int = 0, day: int = 27) -> int:
    moment = datetime(2025, 7, day, hour, minute) - datetime(1970, 1, 1)
    return moment // timedelta(milliseconds=1)


def run(spark, tmp_path, **options):
    source, root = tmp_path / "source", tmp_path / "root"
    days = options.pop("days", DAY)
    return load.load_range(spark, str(source), "a/b", str(root), *days, AS_OF, **options)


def put_hour(tmp_path, hour: str, *texts: str, raw: bytes | None = None) -> None:
    content = lz4("\n".join(texts)) if raw is None else raw
    put(tmp_path / "source", f"a/b/20250727/{hour}.lz4", content)


def decoded(spark, *contents: bytes) -> list[tuple]:
    rows = [(f"k{i}", "", bytearray(content)) for i, content in enumerate(contents)]
    frame = spark.createDataFrame(rows, "key string, path string, content binary")
    return [tuple(row) for row in archive.decode_lines(frame).collect()]


def outcomes(rows: list[tuple]) -> list[tuple]:
    return [(row[0], row[1]) for row in rows if row[2] is None]


def test_decode_lines_numbers_all_and_skips_blank(spark):
    rows = decoded(spark, lz4("one\n\n \u3000\r\ntwo\r\n\x85\n\x1c\nthree\n"), lz4("\n\na"))
    assert rows == [
        ("k0", None, 1, "one"),
        ("k0", None, 4, "two\r"),
        ("k0", None, 6, "\x1c"),
        ("k0", None, 7, "three"),
        ("k0", "processed", None, None),
        ("k1", None, 3, "a"),
        ("k1", "processed", None, None),
    ]


def test_outcomes_of_broken_objects_come_last(spark):
    whole = lz4("x" * 100 + "\n" + "y" * 9_000_000)
    not_text = lz4(b"ok\n" + b"z" * 9_000_000 + b"\n\xff\xfe\n")
    both = lz4(b"\xff\n" + random.Random(1).randbytes(9_000_000) + b"\n")[:-9]
    contents = [b"", b"not lz4", whole[:-9], not_text, lz4(""), both, whole + b"junk"]
    assert outcomes(decoded(spark, *contents)) == [
        ("k0", "failed_decompress"),
        ("k1", "failed_decompress"),
        ("k2", "failed_decompress"),
        ("k3", "failed_ingest"),
        ("k4", "processed"),
        ("k5", "failed_decompress"),
        ("k6", "failed_decompress"),
    ]


def test_lines_that_span_chunks(spark):
    long = "é" * 5_000_000
    rows = decoded(spark, lz4(f"a\n{long}\nb\n{long}"))
    assert [(row[2], len(row[3])) for row in rows[:-1]] == [
        (1, 1),
        (2, 5_000_000),
        (3, 1),
        (4, 5_000_000),
    ]


def test_load_counts_every_outcome(spark, tmp_path):
    put_hour(tmp_path, "00", block(fill(time=at(0))), "", "{bad", block(fill(px="0", time=at(0))))
    put_hour(tmp_path, "01", raw=b"junk")
    put_hour(tmp_path, "02", raw=lz4(b"\xff"))
    put_hour(tmp_path, "03", block())
    status = run(spark, tmp_path)
    rows = {row["key"]: row for row in status.collect()}
    assert len(rows) == 24
    first = rows["a/b/20250727/00.lz4"]
    assert tuple(first)[1:] == (datetime(2025, 7, 27), "processed", 1, 2, 1)
    outcomes = [rows[f"a/b/20250727/0{hour}.lz4"]["status"] for hour in range(5)]
    assert outcomes == ["processed", "failed_decompress", "failed_ingest", "processed", "missing"]
    summary = load.report(status).first().asDict()
    assert summary["from"] == summary["to"] == "20250727"
    assert (summary["hours_total"], summary["hours_processed"]) == (24, 2)
    assert (summary["hours_missing"], summary["failed_hours"]) == (20, 2)
    assert summary["hours_skipped"] == 22 and summary["parse_errors"] == 1
    root = str(tmp_path / "root")
    (bad,) = store.quarantine(spark, root).filter("reason = 'parse_error'").collect()
    assert bad["hash"] == "parse_error:20250727/00:3" and bad["time"] == datetime(2025, 7, 27)
    latest = runs.ingest_status(store.runs(spark, root)).first().asDict()
    assert latest["state"] == "succeeded" and latest["hours_done"] == 24
    assert (latest["files_missing"], latest["files_failed"]) == (20, 2)
    assert latest["current_hour"] == "20250727/23"


def test_objects_that_cannot_be_read_fail_their_hour_only(spark, tmp_path):
    put_hour(tmp_path, "00", block(fill(time=at(0))))
    put_hour(tmp_path, "01", block(fill(time=at(1))))
    # A checksum file that does not fit makes every read of the object fail.
    wrong = b"crc\0" + (512).to_bytes(4, "big") + bytes(8)
    (tmp_path / "source/a/b/20250727/.01.lz4.crc").write_bytes(wrong)
    found = run(spark, tmp_path).filter("status != 'missing'").collect()
    assert {row["hour_start"].hour: row["status"] for row in found} == {
        0: "processed",
        1: "failed_download",
    }


def test_broken_objects_fail_alone(spark, tmp_path):
    put_hour(tmp_path, "00", block(fill(time=at(0))))
    put_hour(tmp_path, "01", *[block(fill(time=at(1), hash=str(i))) for i in range(300)])
    put_hour(tmp_path, "02", raw=b"junk" * 1000)
    span = datetime(2025, 7, 27), datetime(2025, 7, 28)
    objects = archive.existing_objects(spark, str(tmp_path / "source"), "a/b", *span)
    rows = archive.decode_lines(archive.read_hours(spark, objects))
    counts = rows.groupBy("key").agg(F.max("status").alias("status"), F.count("*").alias("n"))
    assert sorted((row["key"][-6:-4], row["status"], row["n"]) for row in counts.collect()) == [
        ("00", "processed", 2),
        ("01", "processed", 301),
        ("02", "failed_decompress", 1),
    ]
    assert archive.read_hours(spark, []).collect() == []


def unreadable() -> Path | None:
    """A file that nobody may open for reading, the superuser included."""
    for path in Path("/sys/devices").glob("pci*/*/rescan"):
        try:
            path.open("rb").close()
        except PermissionError:
            return path
        except OSError:
            continue
    return None


@pytest.mark.skipif(unreadable() is None, reason="no file here that cannot be opened")
def test_a_denied_object_in_the_middle_ends_the_run(spark, tmp_path):
    root = str(tmp_path / "root")
    for hour in (0, 2, 5):
        put_hour(tmp_path, f"0{hour}", block(fill(time=at(hour), hash=str(hour))))
    (tmp_path / "source/a/b/20250727/03.lz4").symlink_to(unreadable())
    assert files.fault(spark, str(tmp_path / "source/a/b/20250727/03.lz4")) == files.DENIED
    with pytest.raises(PermissionError, match="03.lz4"):
        run(spark, tmp_path, wave_hours=4)
    # What could be read of that wave is in, later waves were not begun.
    assert sorted(r["hash"] for r in store.fills(spark, root).collect()) == ["0", "2"]
    latest = runs.ingest_status(store.runs(spark, root)).first()
    assert latest["state"] == runs.FAILED_RUN


def test_faults_of_single_objects(spark, tmp_path, monkeypatch):
    put_hour(tmp_path, "00", block(fill(time=at(0))))
    put_hour(tmp_path, "01", block(*[fill(time=at(1), hash=str(i)) for i in range(500)]))
    put_hour(tmp_path, "02", block(fill(time=at(2))))
    found = archive.existing_objects

    def vanishing(*args):
        objects = found(*args)
        (tmp_path / "source/a/b/20250727/02.lz4").unlink()
        return objects

    monkeypatch.setattr(archive, "existing_objects", vanishing)
    limit = (tmp_path / "source/a/b/20250727/01.lz4").stat().st_size - 1
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(limit))
    try:
        status = run(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    outcome = {row["hour_start"].hour: row["status"] for row in status.collect()}
    assert (outcome[0], outcome[1], outcome[2]) == ("processed", "failed_download", "missing")
    latest = runs.ingest_status(store.runs(spark, str(tmp_path / "root"))).first()
    assert (latest["files_missing"], latest["files_failed"]) == (22, 1)
    assert files.fault(spark, str(tmp_path / "nothing there")) == files.MISSING
    assert files.fault(spark, str(tmp_path)) == files.MISSING
    assert files.fault(spark, str(tmp_path / "source/a/b/20250727/00.lz4")) == files.OTHER


def test_progress_of_a_running_load(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    for hour in (0, 7, 9):
        put_hour(tmp_path, f"0{hour}", block(fill(time=at(hour)), fill(px="0", time=at(hour))))
    put_hour(tmp_path, "08", raw=b"junk")
    seen, append = [], commits.append

    def watched(spark, root, records):
        latest = runs.ingest_status(store.runs(spark, root)).first()
        names = "state current_hour hours_done rows_inserted rows_quarantined files_missing files_failed"
        seen.append(tuple(latest[name] for name in names.split()))
        append(spark, root, records)

    monkeypatch.setattr(commits, "append", watched)
    run(spark, tmp_path, wave_hours=8)
    assert seen == [
        ("running", None, 0, 0, 0, 0, 0),
        ("running", "20250727/07", 8, 2, 2, 6, 0),
        ("running", "20250727/15", 16, 3, 3, 12, 1),
    ]


def hashes(spark, root: str) -> list[str]:
    return sorted(row["hash"] for row in store.fills(spark, root).collect())


@pytest.mark.parametrize("stop", ["half of the files", "before the commit"])
def test_a_load_that_stops_leaves_every_hour_old(spark, tmp_path, monkeypatch, stop):
    root = str(tmp_path / "root")
    for hour in range(4):
        put_hour(tmp_path, f"0{hour}", block(fill(time=at(hour), hash=f"old{hour}")), "{bad")
    run(spark, tmp_path)
    frame, old = store.fills(spark, root), [f"old{hour}" for hour in range(4)]
    for hour in range(4):
        put_hour(tmp_path, f"0{hour}", block(fill(time=at(hour), hash=f"new{hour}")))

    def stopped(spark, root, *rest):
        if stop == "half of the files":
            for path in sorted((tmp_path / "root/tables").rglob("*.parquet"))[::2]:
                if "new" in str(spark.read.parquet(str(path)).collect()):
                    path.unlink()
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(commits, "append", stopped)
        with pytest.raises(RuntimeError, match="killed"):
            run(spark, tmp_path)
    assert hashes(spark, root) == old
    assert store.quarantine(spark, root).count() == 4
    assert store.db_stats(spark, root).first()["quarantine_count"] == 4
    run(spark, tmp_path)
    assert hashes(spark, root) == [f"new{hour}" for hour in range(4)]
    assert store.quarantine(spark, root).count() == 0
    # A frame keeps to what there was when it was made, as long as nothing is cleared away.
    assert sorted(row["hash"] for row in frame.collect()) == old
    assert upkeep.vacuum(spark, root) == 0
    late = datetime(2100, 1, 1)
    assert upkeep.vacuum(spark, root, as_of=late) > 0
    assert upkeep.vacuum(spark, root, as_of=late) == 0
    assert hashes(spark, root) == [f"new{hour}" for hour in range(4)]


def test_recluster_that_stops_or_is_overtaken_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    for hour in range(3):
        put_hour(tmp_path, f"0{hour}", block(*[fill(time=at(hour, m), hash=f"{hour}") for m in (3, 1)]))
    run(spark, tmp_path)
    before = sorted(map(str, store.fills(spark, root).drop("load_id").collect()))
    append = commits.append

    def stopped(spark, root, records):
        raise RuntimeError("killed")

    def overtaken(spark, root, records):
        monkeypatch.setattr(commits, "append", append)
        put_hour(tmp_path, "01", block(fill(time=at(1), hash="reloaded")))
        run(spark, tmp_path)
        append(spark, root, records)

    monkeypatch.setattr(commits, "append", stopped)
    with pytest.raises(RuntimeError, match="killed"):
        upkeep.recluster(spark, root, *DAY)
    assert sorted(map(str, store.fills(spark, root).drop("load_id").collect())) == before
    monkeypatch.setattr(commits, "append", append)
    assert upkeep.recluster(spark, root, *DAY) == 1
    assert upkeep.recluster(spark, root, *DAY) == 0
    assert sorted(map(str, store.fills(spark, root).drop("load_id").collect())) == before
    run(spark, tmp_path)
    monkeypatch.setattr(commits, "append", overtaken)
    assert upkeep.recluster(spark, root, *DAY) == 1
    assert hashes(spark, root) == ["0", "0", "2", "2", "reloaded"]
    assert upkeep.recluster(spark, root, *DAY) == 1
    assert upkeep.recluster(spark, root, *DAY) == 0
    assert hashes(spark, root) == ["0", "0", "2", "2", "reloaded"]


def test_statistics_open_no_data_file(spark, tmp_path):
    root = str(tmp_path / "root")
    stray = fill(time=at(3, day=28))
    put_hour(tmp_path, "00", block(fill(time=at(0)), fill(px="0", time=at(0)), stray), "{")
    put_hour(tmp_path, "01", block(fill(time=at(1)), fill(sz="0", px="0", time=at(1))))
    status = run(spark, tmp_path)
    fills, rejected = store.fills(spark, root), store.quarantine(spark, root)
    want = [
        stats.db_stats(fills, rejected).collect(),
        stats.partition_counts(fills).collect(),
        sorted(validate.quarantine_reasons(rejected).collect()),
        status.collect(),
        [tuple(row) for row in coins.max_fill_time(fills).collect()],
    ]
    for path in (tmp_path / "root/tables").rglob("*.parquet"):
        path.write_bytes(b"not to be opened")
    got = [
        store.db_stats(spark, root).collect(),
        store.partition_counts(spark, root).collect(),
        sorted(store.quarantine_reasons(spark, root).collect()),
        status.collect(),
        [tuple(row) for row in store.newest_fill(spark, root).collect()],
    ]
    assert got == want and len(want[1]) == 2 and len(want[2]) == 2
    assert upkeep.fold_commits(spark, root) == 1
    put_hour(tmp_path, "00", block(fill(time=at(0), hash="other")))
    again = run(spark, tmp_path)
    assert status.collect() == want[3] != again.collect()
    assert upkeep.fold_commits(spark, root) == 2
    assert upkeep.fold_commits(spark, root) == 1
    assert status.collect() == want[3]
    assert [tuple(r) for r in store.partition_counts(spark, root).collect()] == [("20250727", 2)]
    assert store.hours(spark, root).count() == 2


def test_writing_gathers_small_hours_into_one_file(spark, tmp_path):
    start = datetime(2025, 7, 27)
    rows = spark.range(4800).select(
        (F.lit(start) + F.make_dt_interval(hours=(F.col("id") % 48).cast("int"))).alias("time"),
        F.lit("BTC").alias("coin"),
    )
    frame = rows.repartition(8).withColumn("time", F.col("time").cast("timestamp_ntz"))
    store.write_fills(frame, str(tmp_path / "root"))
    names = list((tmp_path / "root/tables").rglob("*.parquet"))
    assert len({path.parent for path in names}) == 48 and len(names) <= 60


def test_reload_replaces_the_hour(spark, tmp_path):
    root = str(tmp_path / "root")
    stray = fill(time=at(3, day=28), hash="stray")
    put_hour(tmp_path, "00", block(fill(time=at(0), hash="old"), stray), "{")
    put_hour(tmp_path, "01", block(fill(time=at(1), hash="other")))
    run(spark, tmp_path)
    assert hashes(spark, root) == ["old", "other", "stray"]
    run(spark, tmp_path)
    assert hashes(spark, root) == ["old", "other", "stray"]
    # A corrected object: the stray fill and the bad line are gone, the other hour is broken.
    put_hour(tmp_path, "00", block(fill(time=at(0), hash="new")))
    put_hour(tmp_path, "01", raw=b"junk")
    run(spark, tmp_path)
    assert hashes(spark, root) == ["new", "other"]
    assert store.quarantine(spark, root).count() == 0
    put_hour(tmp_path, "00", block())
    run(spark, tmp_path)
    assert hashes(spark, root) == ["other"]


def test_failed_run_is_logged_and_leaves_the_tables_alone(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    put_hour(tmp_path, "00", block(fill(time=at(0))))
    run(spark, tmp_path)

    def broken(rows, root, folder):
        raise RuntimeError("no space")

    monkeypatch.setattr(store, "write_rows", broken)
    with pytest.raises(RuntimeError, match="no space"):
        run(spark, tmp_path)
    assert store.fills(spark, root).count() == 1
    assert runs.ingest_status(store.runs(spark, root)).first()["state"] == "failed"


def test_load_new_continues_from_the_newest_fill(spark, tmp_path):
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    for hour in range(4):
        put_hour(tmp_path, f"0{hour}", block(fill(time=at(hour, 5), hash=str(hour))))
    as_of = datetime(2025, 7, 27, 2, 30)
    first = load.load_new(spark, source, "/a/b/", root, as_of)
    assert sorted(r["hour_start"].hour for r in first.collect()) == [0, 1]
    second = load.load_new(spark, source, "a/b", root, as_of + timedelta(hours=2))
    assert sorted(r["hour_start"].hour for r in second.collect()) == [0, 1, 2, 3]
    assert store.fills(spark, root).count() == 4
    assert store.newest_fill(spark, root).first()[0] == datetime(2025, 7, 27, 3, 5)
    idle = str(tmp_path / "x")
    assert load.load_new(spark, source, "a/b", idle, datetime(2025, 7, 27)) is None
    latest = runs.ingest_status(store.runs(spark, idle)).first()
    assert (latest["state"], latest["hours_total"]) == (runs.SUCCEEDED, 0)


def test_a_failure_before_the_load_is_logged(spark, tmp_path, monkeypatch):
    def broken(spark, root):
        raise RuntimeError("no listing")

    monkeypatch.setattr(store, "newest_fill", broken)
    with pytest.raises(RuntimeError, match="no listing"):
        load.load_new(spark, str(tmp_path), "a/b", str(tmp_path / "root"))
    latest = runs.ingest_status(store.runs(spark, str(tmp_path / "root"))).first()
    assert latest["state"] == runs.FAILED_RUN and latest["hours_done"] == 0


def test_stored_tables_answer_queries_with_pruned_days(spark, tmp_path):
    root = str(tmp_path / "root")
    put_hour(tmp_path, "23", block(*[fill(time=at(23, m), px=f"{m + 1}") for m in range(5)]))
    put(
        tmp_path / "source",
        "a/b/20250728/00.lz4",
        lz4(block(*[fill(time=at(0, m, 28), px=f"{m + 9}") for m in range(5)])),
    )
    run(spark, tmp_path, days=("20250727", "20250728"))
    start, end = datetime(2025, 7, 28), datetime(2025, 7, 29)
    whole = store.fills(spark, root)
    (bar,) = bars.time_bars(whole, "BTC", "1h", start, end).collect()
    assert (bar["open"], bar["close"], bar["trade_count"]) == (9.0, 13.0, 5)
    plan = lookup.get_fills(whole, start, end)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert store.fills(spark, root, start, end).select(*FILL_COLUMNS).count() == 5
    counts = [tuple(row) for row in stats.partition_counts(whole).collect()]
    assert counts == [("20250727", 5), ("20250728", 5)]
    store.register(spark, root)
    assert spark.sql("SELECT max(px) FROM fills WHERE coin = 'BTC'").first()[0] == 13.0
    span = stats.db_stats(whole, store.quarantine(spark, root)).first()
    assert (span["fills_count"], span["quarantine_count"]) == (10, 0)
    assert store.db_stats(spark, root).first() == span
    empty = str(tmp_path / "empty")
    store.ensure_tables(spark, empty)
    assert tuple(store.db_stats(spark, empty).first()) == (0, 0, None, None)


def test_purge_and_recluster(spark, tmp_path):
    root = str(tmp_path / "root")
    for hour in ("00", "01"):
        stamps = [at(int(hour), m) for m in range(3)]
        put_hour(tmp_path, hour, block(*[fill(time=t) for t in stamps], fill(px="0", time=stamps[0])))
    put(tmp_path / "source", "a/b/20250728/00.lz4", lz4(block(fill(time=at(0, 1, 28)))))
    run(spark, tmp_path, days=("20250727", "20250728"))
    before = sorted(map(str, store.fills(spark, root).drop("load_id").collect()))
    assert upkeep.recluster(spark, root, "20250727", "20250727") == 1
    assert upkeep.recluster(spark, root, "20240101", "20240102") == 0
    assert sorted(map(str, store.fills(spark, root).drop("load_id").collect())) == before
    assert upkeep.purge_expired(spark, root, 0, AS_OF) == 0
    assert upkeep.purge_before(spark, root, "20250727") == 0
    assert upkeep.purge_expired(spark, root, 4, AS_OF) == 2
    assert list(store.stored_days(spark, root, store.FILLS)) == [date(2025, 7, 28)]
    assert upkeep.purge_before(spark, root, "20250728") == 0
    assert store.fills(spark, root).count() == 1
    with pytest.raises(ValueError, match="before_date"):
        upkeep.purge_before(spark, root, "2025-07-28")


def test_plain_files_are_numbered_across_splits(spark, tmp_path):
    texts = [json.dumps({"n": i}) if i % 7 else "  " for i in range(5000)]
    put(tmp_path, "20250727/08.jsonl", "\n".join(texts).encode())
    put(tmp_path, "20250727/09.jsonl", b"a\r\n\nb\rc\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_jsonl(spark, str(tmp_path / "20250727")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    large = {r["line_no"]: r["line"] for r in rows if r["key"] == "20250727/08.jsonl"}
    assert large == {i: t for i, t in enumerate(texts, 1) if t.strip()}
    small = sorted((r["line_no"], r["line"]) for r in rows if r["key"] == "20250727/09.jsonl")
    assert small == [(1, "a\r"), (3, "b\rc")]


def test_direct_writes_and_export(spark, tmp_path):
    root = str(tmp_path / "root")
    source = fixtures.fills_from_events(fixtures.events(spark, "/root/testdata/sf0.001"))
    store.ensure_tables(spark, root)
    assert store.fills(spark, root).count() == 0
    day = source.filter("time < timestamp_ntz'2024-01-03'")
    store.write_fills(day, root)
    store.write_fills(day, root)
    rejected = day.limit(3).withColumn("reason", F.lit("bad_time"))
    store.write_quarantine(rejected, root)
    assert store.fills(spark, root).count() == day.count() > 0
    assert store.quarantine(spark, root).count() == 3
    store.export(day.select(*FILL_COLUMNS), str(tmp_path / "out.parquet"))
    store.export(day.select(*FILL_COLUMNS), str(tmp_path / "out.CSV"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == day.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "out.CSV")).count() == day.count()
    with pytest.raises(ValueError, match="parquet or .csv"):
        store.export(day, str(tmp_path / "out.json"))


def test_generated_archive_loads_like_its_lines(spark, tmp_path):
    """The whole path over real objects equals parsing the lines they were made of."""
    lines = fixtures.raw_lines(fixtures.events(spark, "/root/testdata/sf0.001"))
    objects = {}
    for row in lines.orderBy("line_no").collect():
        objects.setdefault(row["key"], []).append(row["line"])
    for key, texts in objects.items():
        put(tmp_path / "source", key, lz4("\n".join(texts) + "\n"))
    bounds, as_of = datetime(2024, 1, 1), datetime(2024, 3, 1)
    status = load.load_range(
        spark,
        str(tmp_path / "source"),
        fixtures.KEY_PREFIX,
        str(tmp_path / "root"),
        "20240101",
        "20240131",
        as_of,
        bounds,
    )
    expected = validate.validate(decode.parse_lines(lines), as_of, bounds)
    stored = store.fills(spark, str(tmp_path / "root"))
    columns = [*FILL_COLUMNS, "src_key", "event_pos"]
    good = validate.valid_fills(expected)
    assert stored.select(columns).exceptAll(good.select(columns)).count() == 0
    assert stored.count() == good.count()
    reasons = validate.quarantine_reasons(validate.quarantined(expected)).collect()
    kept = validate.quarantine_reasons(store.quarantine(spark, str(tmp_path / "root"))).collect()
    assert sorted(reasons) == sorted(kept)
    assert status.filter("status = 'processed'").count() == len(objects)
