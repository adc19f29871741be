"""Table runs and streaming runs."""

import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from firstseen import State, ingest_table
from firstseen.operators import filters, payload
from firstseen.operators.classify import classify
from firstseen.plans.tables import CO_PARTITION, TableSource, accepted_by_slot, digests_of_misses, hash_rows
from firstseen.schemas import CORE
from firstseen.streaming.dedup import ROCKSDB, STATE_STORE, first_seen
from firstseen.streaming.ingest import ingest_stream
from firstseen.workspace import setting, stage
from tests.test_decide import one_by_one

SCHEMA = "name string, body string, at bigint"
DAY = 86_400 * 10**9


def as_files(table, **kw):
    return TableSource(table, F.col("name"), F.col("body"), F.col("at"), "/in", **kw)


def held(spark, path):
    return {bytes(r["content_hash"]) for r in State(spark, path).ledger().collect()}


def outcomes(run):
    return {r["path"]: (r["cache_result"], r["outcome"], r["error"]) for r in run.results.collect()}


def test_failure_reasons(spark, tmp_path):
    rows = [("/in/a", "x", 1), ("/in/null", None, 1), ("/out/b", "y", 1), ("/in/old", "z", -5), ("rel", "w", 1), ("/in/taken", "v", 1)]
    existing = spark.createDataFrame([("/d/1970/taken",)], "dest_path string")
    run = ingest_table(as_files(spark.createDataFrame(rows, SCHEMA)), str(tmp_path / "s"), "/d/{year_utc}", existing=existing, caller_stores=True)
    got = {p: (o, e) for p, (_, o, e) in outcomes(run).items()}
    assert got == {
        "/in/a": ("copied", None), "/in/null": ("failed", "no payload"),
        "/out/b": ("failed", "path is outside the source root"),
        "/in/old": ("failed", "modification time is before 1970"), "rel": ("failed", "path must be absolute"),
        "/in/taken": ("failed", "destination already exists"),
    }
    assert [r["name"] for r in run.accepted.collect()] == ["/in/a"]
    assert run.stats.first()["failed_files"] == 5


@pytest.mark.parametrize("sized", [False, True])
def test_runs_with_carried_state_match_the_model(spark, tmp_path, sized):
    rng = random.Random(11)
    state, memory, cached = str(tmp_path / "s"), set(), {}
    for turn in range(3):
        names = sorted({f"/in/{rng.choice('abc')}/{rng.randint(0, 60)}" for _ in range(50)})
        rows = [(n, rng.choice(["hot"] * 6 + [f"t{i}" for i in range(12)]), rng.randint(1, 2) * DAY) for n in names]
        blocked = [r for r in rows if rng.random() < 0.3]
        existing = spark.createDataFrame([(f"/d/{n[4:]}",) for n, _, _ in blocked], "dest_path string")
        table = spark.createDataFrame(rows, SCHEMA)
        source = as_files(table, size=F.lit(1)) if sized else as_files(table)
        run = ingest_table(source, state, "/d", existing=existing, sink=str(tmp_path / "sink"))

        # A row whose size and time are as cached keeps its cached digest.
        content = {}
        for name, body, at in rows:
            key = (at, 1 if sized else len(body))
            content[name] = cached[name][1] if name in cached and cached[name][0] == key else body
        expected, memory = one_by_one([(n, content[n], (n, b, a) not in blocked, False) for n, b, a in rows], memory)
        assert {p: o for p, (_, o, _) in outcomes(run).items()} == expected
        for name, body, at in rows:
            key = (at, 1 if sized else len(body))
            state_of = "new" if name not in cached else "unchanged" if cached[name][0] == key else "modified"
            assert outcomes_of(run)[name] == state_of
        cached = {n: ((a, 1 if sized else len(b)), content[n]) for n, b, a in rows}
        written = spark.read.parquet(str(tmp_path / f"sink/run_id={turn}")) if "copied" in expected.values() else None
        if written is not None:
            assert {r["name"] for r in written.collect()} == {n for n, o in expected.items() if o == "copied"}
    assert len(held(spark, state)) == len(memory)


def outcomes_of(run):
    if not hasattr(run, "_classes"):
        run._classes = {r["path"]: r["cache_result"] for r in run.results.collect()}
    return run._classes


@pytest.mark.parametrize("bits", [0, 1, 21])
def test_scan_filters_hold_for_every_prefix(spark, tmp_path, monkeypatch, bits):
    """Rows that a glob leaves out must not come back with the payload."""
    monkeypatch.setattr("firstseen.operators.payload.PREFIX_BITS", bits)
    rows = [("/in/a.txt", "x", 1), ("/in/b.txt", "y", 1), ("/in/c.txt", "y", 1), ("/in/d.log", "z", 1), (None, "n", 1)]
    source = as_files(spark.createDataFrame(rows, SCHEMA))
    run = ingest_table(source, str(tmp_path / "s"), "/d", globs=["*.txt"], caller_stores=True)
    assert sorted(r["name"] for r in run.accepted.collect()) == ["/in/a.txt", "/in/b.txt"]
    assert run.stats.first()["total_files"] == 3 and len(held(spark, str(tmp_path / "s"))) == 2
    again = ingest_table(source, str(tmp_path / "s"), "/d", caller_stores=True)
    assert [r["name"] for r in again.accepted.collect()] == ["/in/d.log"]


def test_cache_keeps_rows_that_globs_left_out(spark, tmp_path):
    source = as_files(spark.createDataFrame([("/in/a.txt", "x", 1), ("/in/d.log", "z", 1)], SCHEMA))
    ingest_table(source, str(tmp_path / "s"), "/d", caller_stores=True)
    ingest_table(source, str(tmp_path / "s"), "/d", globs=["*.txt"], caller_stores=True)
    assert State(spark, str(tmp_path / "s")).cache().count() == 2
    fewer = as_files(spark.createDataFrame([("/in/a.txt", "x", 1)], SCHEMA))
    ingest_table(fewer, str(tmp_path / "s"), "/d", use_cache=False, caller_stores=True)
    assert State(spark, str(tmp_path / "s")).cache().count() == 1


def test_repeated_paths_are_refused(spark, tmp_path):
    rows = [("/in/a", "x", 1), ("/in/a", "y", 1)]
    with pytest.raises(ValueError, match="unique"):
        ingest_table(as_files(spark.createDataFrame(rows, SCHEMA)), str(tmp_path / "s"), "/d", caller_stores=True)


def test_load_mode_and_no_cache(spark, tmp_path):
    table = as_files(spark.createDataFrame([("/in/a", "x", 1), ("/in/b", "x", 1), ("/in/c", None, 1)], SCHEMA))
    state = str(tmp_path / "s")
    run = ingest_table(table, state, mode="load", use_cache=False, cleanup=False)
    assert {o for _, o, _ in outcomes(run).values()} == {"skipped", "failed"}
    assert State(spark, state).cache().count() == 0 and len(held(spark, state)) == 1
    again = ingest_table(table, state, "/d", use_cache=False, caller_stores=True)
    assert {p: o[:2] for p, o in outcomes(again).items()}["/in/a"] == ("new", "skipped")


def test_empty_table(spark, tmp_path):
    run = ingest_table(as_files(spark.createDataFrame([], SCHEMA)), str(tmp_path / "s"), "/d", caller_stores=True)
    assert run.results.count() == 0 and set(run.stats.first()) == {0}


def incoming(spark, tmp_path, parts):
    rng = random.Random(5)
    rows = [(f"/in/{i:03}", rng.choice(["hot"] * 5 + [f"t{j}" for j in range(40)]), DAY) for i in range(120)]
    folder = tmp_path / f"in{parts}"
    for part in range(parts):
        spark.createDataFrame(rows[part::parts], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream, {body for _, body, _ in rows}


def start(stream, tmp_path, tag, **kw):
    query = ingest_stream(
        stream, as_files, str(tmp_path / f"state{tag}"), "arrivals", str(tmp_path / f"cp{tag}"),
        str(tmp_path / f"sink{tag}"), "/d", **kw,
    )
    query.awaitTermination()
    return query


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_any_batching_gives_the_same_ledger(spark, tmp_path, parts):
    stream, bodies = incoming(spark, tmp_path, parts)
    counts = {}
    start(stream, tmp_path, parts, compact_every=2, on_batch=counts.__setitem__)
    ledger = State(spark, str(tmp_path / f"state{parts}")).ledger()
    assert ledger.count() == len(bodies) == ledger.select("content_hash").distinct().count()
    written = spark.read.parquet(str(tmp_path / f"sink{parts}"))
    assert sorted(r["body"] for r in written.collect()) == sorted(bodies)
    assert sorted(counts) == list(range(parts))
    assert sum(c["total_files"] for c in counts.values()) == 120
    assert sum(c["copied_files"] for c in counts.values()) == len(bodies)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    stream, bodies = incoming(spark, tmp_path, 3)
    start(stream, tmp_path, "r")
    state = str(tmp_path / "stater")
    before = held(spark, state)
    (tmp_path / "cpr/commits/2").unlink()
    (tmp_path / "cpr/commits/.2.crc").unlink(missing_ok=True)
    start(stream, tmp_path, "r")
    assert held(spark, state) == before and State(spark, state).ledger().count() == len(bodies)
    assert spark.read.parquet(str(tmp_path / "sinkr")).count() == len(bodies)


def test_writer_belongs_to_one_checkpoint(spark, tmp_path):
    stream, _ = incoming(spark, tmp_path, 1)
    start(stream, tmp_path, "w")
    with pytest.raises(ValueError, match="belongs"):
        ingest_stream(stream, as_files, str(tmp_path / "statew"), "arrivals", str(tmp_path / "other"), "x", "/d")
    with pytest.raises(ValueError):
        ingest_stream(stream, as_files, str(tmp_path / "statew"), "batch", str(tmp_path / "cpw"), "x", "/d")


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_dedup(spark, tmp_path, parts):
    stream, bodies = incoming(spark, tmp_path, parts)
    rows = stream.select(F.col("body").cast("binary").alias("content_hash"))
    if spark.conf.get(STATE_STORE) != ROCKSDB:
        with pytest.raises(ValueError, match="stateStore"):
            first_seen(rows)
    with setting(spark, STATE_STORE, ROCKSDB):
        query = (
            first_seen(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
    query.awaitTermination()
    got = [bytes(r["content_hash"]).decode() for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(bodies)


def test_copy_mode_needs_a_store(spark, tmp_path):
    with pytest.raises(ValueError, match="sink"):
        ingest_table(as_files(spark.createDataFrame([], SCHEMA)), str(tmp_path / "s"), "/d")


@pytest.mark.parametrize("options", [{}, {"globs": ["*.txt"]}, {"globs": ["!*.log"]}, {"ignore_hidden": True}])
def test_rows_outside_the_root_are_reported_under_any_filter(spark, tmp_path, options):
    rows = [("/in/a.txt", "x", 1), (None, "n", 1), ("/elsewhere/b.txt", "y", 1)]
    run = ingest_table(as_files(spark.createDataFrame(rows, SCHEMA)), str(tmp_path / "s"), "/d", caller_stores=True, **options)
    assert sorted(r.outcome for r in run.results.collect()) == ["copied", "failed", "failed"]


def test_dedup_drops_rows_without_a_digest(spark):
    from firstseen.operators.content import dedup_exact

    rows = [(b"/a", b"h"), (b"/b", b"h"), (b"/c", None), (b"/d", None)]
    found = dedup_exact(spark.createDataFrame(rows, "path_bytes binary, content_hash binary")).collect()
    assert [(bytes(r.content_hash), r.path) for r in found] == [(b"h", "/a")]


def test_columns_of_the_source_are_not_overwritten(spark, tmp_path):
    table = spark.createDataFrame([("/in/a", "x", 1)], SCHEMA).withColumn("year_utc", F.lit(1815))
    with pytest.raises(ValueError, match="year_utc"):
        ingest_table(as_files(table), str(tmp_path / "s"), "/d/{year_utc}", sink=str(tmp_path / "sink"))


def test_sink_holds_the_columns_of_the_source(spark, tmp_path):
    table = spark.createDataFrame([("/in/a", "x", 1)], SCHEMA).withColumns({"year": F.lit(1815), "path_hash": F.lit("mine")})
    run = ingest_table(as_files(table), str(tmp_path / "s"), "/d/{day_local}", sink=str(tmp_path / "sink"), local_tz="America/New_York")
    assert [tuple(r) for r in run.accepted.collect()] == [("/in/a", "x", 1, 1815, "mine")]
    written = spark.read.parquet(str(tmp_path / "sink" / "run_id=0"))
    assert written.columns == [*table.columns, "day_local"] and written.first()["day_local"] == 31


@pytest.fixture
def stored(spark, tmp_path):
    """4,000 rows in 8 files, in the order of their times."""
    rows = spark.range(4000).select(
        F.format_string("/in/%d", "id").alias("name"), F.col("id").cast("string").alias("body"), F.col("id").alias("at")
    )
    rows.repartitionByRange(8, "at").write.parquet(str(tmp_path / "stored"))
    return as_files(spark.read.parquet(str(tmp_path / "stored")), size=F.lit(1))


@pytest.fixture
def touched(spark, tmp_path, stored):
    """A source with 300 touched rows in one file of eight, and its classified rows."""
    ingest_table(stored, str(tmp_path / "s"), mode="load")
    touched = replace(stored, mtime_ns=F.when(F.col("at") < 300, F.col("at") + DAY).otherwise(F.col("at")))
    manifest = filters.with_errors(touched.manifest(with_file=True)).select(*CORE, payload.FILE, payload.ROW)
    return touched, stage(classify(manifest, State(spark, str(tmp_path / "s")).cache()), "classified")


def test_only_misses_are_read(monkeypatch, touched):
    """Files without misses are not read; of the rows of the others only misses are digested, whatever their number."""
    monkeypatch.setattr(payload, "PREFIX_BITS", 1)
    source, classified = touched
    in_file = payload.files_with(source.table, classified, F.col("cache_result") != "unchanged")
    assert 300 <= in_file.count() <= 600
    found = digests_of_misses(source, classified).collect()
    want = {(hashlib.sha256(f"/in/{i}".encode()).digest(), hashlib.sha256(str(i).encode()).digest()) for i in range(300)}
    assert len(found) == 300 and {(bytes(r.path_hash), bytes(r.content_hash)) for r in found} == want


def test_without_row_numbers_some_more_are_digested(touched):
    source, classified = touched
    found = digests_of_misses(source, classified.drop(payload.ROW))
    assert 300 <= found.count() <= 310


def test_bitmaps_come_in_waves_of_bounded_size(spark, tmp_path, monkeypatch, stored):
    """Scattered misses in all files, with room for two bitmaps at once: every wave opens other files."""
    ingest_table(stored, str(tmp_path / "s"), mode="load")
    scattered = replace(stored, mtime_ns=F.when(F.col("at") % 7 == 0, F.col("at") + DAY).otherwise(F.col("at")))
    manifest = filters.with_errors(scattered.manifest(with_file=True)).select(*CORE, payload.FILE, payload.ROW)
    classified = stage(classify(manifest, State(spark, str(tmp_path / "s")).cache()), "classified")
    wanted = F.col("cache_result") != "unchanged"
    monkeypatch.setattr(payload, "WAVE_BYTES", 2 * payload.BITMAP_BYTES)
    waves = scattered.waves(classified, wanted)
    assert len(waves) >= 4
    held = [wave.count() for wave in waves]
    assert sum(held) == len(range(0, 4000, 7)) and max(held) <= 2 * 150
    assert digests_of_misses(scattered, classified, str(tmp_path / "scratch")).count() == len(range(0, 4000, 7))
    run = ingest_table(scattered, str(tmp_path / "s2"), "/d", sink=str(tmp_path / "sink"))
    assert run.accepted.count() == 4000


def test_rows_in_later_bitmaps_of_a_file(spark, tmp_path):
    rows = spark.range(0, 100_000, 1, 1).select(F.format_string("/in/%06d", "id").alias("name"), F.col("id").cast("string").alias("body"), F.col("id").alias("at"))
    rows.write.parquet(str(tmp_path / "one"))
    table = spark.read.parquet(str(tmp_path / "one"))
    wanted = [0, 1, 7, 8, 32_766, 32_767, 32_768, 32_769, 65_535, 65_536, 99_999]
    decided = stage(table.select("at", F.col("_metadata.file_path").alias(payload.FILE), F.col("_metadata.row_index").alias(payload.ROW)), "rows")
    found = payload.picked(table, decided, F.col("at").isin(wanted))
    assert found.columns == table.columns and sorted(r["at"] for r in found.collect()) == wanted
    assert payload.picked(table, decided, F.lit(False)).count() == 0 and payload.picked(table, decided, F.lit(True)).count() == 100_000


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_payloads_are_shuffled_once(spark, tmp_path, stored, broadcast):
    decided = hash_rows(stored, None).withColumn(
        "outcome", F.when(F.col("mtime_ns") % 2 == 0, F.lit("copied")).otherwise(F.lit("skipped"))
    )
    decided = stage(decided, "decided")
    with setting(spark, *CO_PARTITION), setting(spark, "spark.sql.autoBroadcastJoinThreshold", broadcast):
        accepted = accepted_by_slot(stored, decided, "/d/{day_utc}", "UTC")
        plan = accepted._jdf.queryExecution().executedPlan().toString()
        assert accepted.count() == 2000
    # The payloads by slot and the keys by slot meet as they are, and nothing moves after.
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(_firstseen_" in line and "_slot" in line]
    assert len(moved) == 2 and all("REPARTITION_BY_COL" in line for line in moved)
    assert plan.index("ShuffledHashJoin") < plan.index("Exchange ")


def test_scratch_does_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("firstseen.workspace.shared_folder", lambda _: str(tmp_path / "scratch"))
    stream, _ = incoming(spark, tmp_path, 5)
    start(stream, tmp_path, "scratch")
    assert list((tmp_path / "scratch" / "firstseen").iterdir()) == []


def test_run_lost_before_placing_is_taken_over(spark, tmp_path, monkeypatch):
    table = as_files(spark.createDataFrame([("/in/a", "x", 1), ("/in/b", "y", 1)], SCHEMA))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(State, "mark_placing", lost)
        with pytest.raises(RuntimeError, match="lost"):
            ingest_table(table, str(tmp_path / "s"), "/d", caller_stores=True)
    run = ingest_table(table, str(tmp_path / "s"), "/d", caller_stores=True)
    assert {(c, o) for c, o, _ in outcomes(run).values()} == {("unchanged", "copied")}
