"""Source trees: listing fidelity and whole file runs."""

import os

import pytest

from firstseen import State, ingest_files
from firstseen.sources import tree
from firstseen.sources.content import copy_files, hash_files


@pytest.fixture
def source(tmp_path):
    (tmp_path / "src").mkdir()
    return tmp_path / "src"


def put(root, name, text, mtime=1_700_000_000):
    path = os.path.join(os.fsencode(root), name if isinstance(name, bytes) else name.encode())
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(text.encode() if isinstance(text, str) else text)
    os.utime(path, ns=(mtime * 10**9 + 7, mtime * 10**9 + 7))
    return path


def run(spark, source, tmp_path, dest="dst", **options):
    target = None if dest is None else str(tmp_path / dest)
    return ingest_files(spark, str(source), target, str(tmp_path / "state"), **options)


def outcomes(result):
    return {r["rel_path"]: (r["cache_result"], r["outcome"]) for r in result.results.collect()}


def names(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def test_listing_fidelity(spark, source):
    put(source, "plain", "x")
    put(source, "empty", "")
    put(source, "_under", "u")
    put(source, ".hidden/.file", "h")
    raw = put(source, b"bad\xff.bin", "b")
    (source / "void").mkdir()
    os.symlink(source / "plain", source / "link")
    os.symlink(source / ".hidden", source / "dirlink")
    listing = tree.scan_tree(spark, str(source))
    rows = {bytes(r["path_bytes"]): r for r in listing.files.collect()}
    assert {os.path.basename(p) for p in rows} == {b"plain", b"empty", b"_under", b".file", b"bad\xff.bin"}
    assert rows[raw]["rel_path"] == "bad�.bin" and rows[raw]["mtime_ns"] == 1_700_000_000 * 10**9 + 7
    assert all(r["error"] is None and r["ctime_ns"] >= 0 for r in rows.values())
    assert listing.directories.count() == 3


@pytest.mark.parametrize("budget", [1, 5, 10_000])
def test_listing_in_rounds_is_complete(spark, source, budget):
    expected = set()
    for d in range(4):
        for e in range(3):
            for f in range(5):
                put(source, f"d{d}/e{e}/f{f}", "x")
                expected.add(f"d{d}/e{e}/f{f}")
    for f in range(40):
        put(source, f"hot/f{f}", "x")
        expected.add(f"hot/f{f}")
    listing = tree.scan_tree(spark, str(source), budget=budget)
    got = [r["rel_path"] for r in listing.files.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert listing.directories.count() == 1 + 4 + 12 + 1


def test_listing_prunes_and_filters(spark, source):
    for name in ("a.txt", "b.log", "skip/c.txt", "keep/d.TXT", ".h/e.txt"):
        put(source, name, "x")
    files = tree.scan_tree(spark, str(source), ["*.txt", "!skip/"], ignore_hidden=True).files
    assert {r["rel_path"] for r in files.collect()} == {"a.txt", "keep/d.TXT"}


def test_single_file_source(spark, source, tmp_path):
    put(source, "only.log", "x")
    result = run(spark, source / "only.log", tmp_path, globs=["*.txt"])
    assert outcomes(result) == {"only.log": ("new", "copied")} and names(tmp_path / "dst") == ["only.log"]


def test_hash_files_reads_whole_files(spark, source):
    import hashlib

    big = os.urandom(3_000_001)
    paths = {put(source, "big", big): big, put(source, "empty", b""): b""}
    frame = spark.createDataFrame([(bytearray(p),) for p in paths] + [(bytearray(b"/no/such"),)], "path_bytes binary")
    rows = {bytes(r["path_bytes"]): r for r in hash_files(frame, chunk_bytes=1024).collect()}
    for path, data in paths.items():
        assert bytes(rows[path]["content_hash"]) == hashlib.sha256(data).digest()
    assert rows[b"/no/such"]["content_hash"] is None and rows[b"/no/such"]["hash_error"]


def test_copy_once(spark, source, tmp_path):
    put(source, "file1.txt", "Hello, world!")
    put(source, "subdir/file2.txt", "Nested content")
    first = run(spark, source, tmp_path, "dst/{year_utc}/{month_utc}/{day_utc}")
    root = tmp_path / "dst/2023/11/14"
    assert names(tmp_path / "dst") == ["2023/11/14/file1.txt", "2023/11/14/subdir/file2.txt"]
    assert (root / "file1.txt").read_text() == "Hello, world!"
    assert first.stats.first()["copied_files"] == 2 and first.stats.first()["total_bytes"] == 27
    (root / "file1.txt").unlink()
    second = run(spark, source, tmp_path, "dst/{year_utc}/{month_utc}/{day_utc}")
    assert set(outcomes(second).values()) == {("unchanged", "skipped")}
    assert names(tmp_path / "dst") == ["2023/11/14/subdir/file2.txt"]


def test_glob(spark, source, tmp_path):
    for name, text in (("file1.txt", "text file"), ("file2.log", "log file"), ("subdir/file3.txt", "nested text file")):
        put(source, name, text)
    run(spark, source, tmp_path, globs=["*.txt"])
    assert names(tmp_path / "dst") == ["file1.txt", "subdir/file3.txt"]


def test_load_then_copy(spark, source, tmp_path):
    put(source, "file1.txt", "Hello, world!")
    put(source, "again.txt", "Hello, world!")
    loaded = run(spark, source, tmp_path, mode="load")
    assert loaded.stats.first()["skipped_files"] == 2 and not (tmp_path / "dst").exists()
    assert State(spark, str(tmp_path / "state")).ledger().count() == 1
    assert run(spark, source, tmp_path).stats.first()["copied_files"] == 0


def test_occupied_destination_then_override(spark, source, tmp_path):
    put(source, "file1.txt", "Source content")
    put(tmp_path / "dst", "file1.txt", "Original content")
    result = run(spark, source, tmp_path)
    row = result.results.first()
    assert (row["outcome"], row["error"]) == ("failed", "destination already exists")
    assert (tmp_path / "dst/file1.txt").read_text() == "Original content"
    # The failed file is cached but not remembered, so it is tried again.
    assert outcomes(run(spark, source, tmp_path)) == {"file1.txt": ("unchanged", "failed")}
    assert outcomes(run(spark, source, tmp_path, override=True)) == {"file1.txt": ("unchanged", "copied")}
    assert (tmp_path / "dst/file1.txt").read_text() == "Source content"
    # Override never copies known content again.
    (tmp_path / "dst/file1.txt").write_text("edited")
    assert outcomes(run(spark, source, tmp_path, override=True)) == {"file1.txt": ("unchanged", "skipped")}
    assert (tmp_path / "dst/file1.txt").read_text() == "edited"


def test_duplicates_in_one_run(spark, source, tmp_path):
    for name in ("a.txt", "b.txt", "a/b", "zero1", "zero2"):
        put(source, name, "" if name.startswith("zero") else "same")
    put(tmp_path / "dst", "a/b", "occupied")
    result = outcomes(run(spark, source, tmp_path))
    assert {k: v[1] for k, v in result.items()} == {
        "a/b": "failed", "a.txt": "copied", "b.txt": "skipped", "zero1": "copied", "zero2": "skipped",
    }


def test_modified_file_and_cleanup(spark, source, tmp_path):
    put(source, "a", "one")
    gone = put(source, "b", "two")
    run(spark, source, tmp_path, "dst/{day_utc}")
    put(source, "a", "three", mtime=1_700_100_000)
    os.remove(gone)
    second = run(spark, source, tmp_path, "dst/{day_utc}")
    assert outcomes(second) == {"a": ("modified", "copied")}
    assert (second.checked, second.removed) == (2, 1)
    assert names(tmp_path / "dst") == ["14/a", "14/b", "16/a"]


def test_cleanup_keeps_entries_outside_the_scan(spark, source, tmp_path):
    for name in ("a.txt", "b.log"):
        put(source, name, name)
    run(spark, source, tmp_path)
    filtered = run(spark, source, tmp_path, globs=["*.txt"])
    assert (filtered.checked, filtered.removed) == (2, 0)
    assert outcomes(run(spark, source, tmp_path))["b.log"] == ("unchanged", "skipped")


def test_no_cache_and_no_cleanup(spark, source, tmp_path):
    put(source, "a", "one")
    run(spark, source, tmp_path, use_cache=False, cleanup=False)
    state = State(spark, str(tmp_path / "state"))
    assert state.cache().count() == 0
    assert outcomes(run(spark, source, tmp_path, use_cache=False)) == {"a": ("new", "skipped")}


def test_failed_copy_gives_the_next_file_its_turn(spark, source, tmp_path):
    """Targets below a regular file cannot be created; their twins are copied."""
    for number in range(1, 12):
        put(source, f"block/{number:02}", "same")
    put(source, "free/4", "same")
    put(source, "free/5", "same")
    put(source, "block/x", "lonely")
    put(source, "free/y", "fine")
    put(tmp_path / "dst", "block", "a file where a directory is needed")
    result = run(spark, source, tmp_path)
    got = {k: v[1] for k, v in outcomes(result).items()}
    assert got == {f"block/{number:02}": "failed" for number in range(1, 12)} | {
        "block/x": "failed", "free/4": "copied", "free/5": "skipped", "free/y": "copied",
    }
    assert names(tmp_path / "dst") == ["block", "free/4", "free/y"]
    errors = {r["rel_path"]: r["error"] for r in result.results.collect()}
    assert errors["block/11"] and errors["free/4"] is None and errors["free/5"] is None
    assert State(spark, str(tmp_path / "state")).ledger().count() == 2


@pytest.mark.parametrize("how", ["copy", "reflink", "hard-link"])
def test_copy_modes(spark, source, tmp_path, how):
    path = put(source, "a", "data")
    target = os.fsencode(tmp_path / "subdir/another/dest.txt")
    digest = hash_files(spark.createDataFrame([(bytearray(path),)], "path_bytes binary")).first()["content_hash"]
    frame = spark.createDataFrame([(bytearray(path), bytearray(target), digest)], "path_bytes binary, dest_bytes binary, content_hash binary")
    copy = lambda **kw: copy_files(frame, how=how, **kw).first()["copy_error"]
    assert copy() is None and open(target).read() == "data"
    assert (os.stat(path).st_ino == os.stat(target).st_ino) == (how == "hard-link")
    # A retried task finds its own file and succeeds.
    assert copy() is None
    os.unlink(target)
    with open(target, "w") as out:
        out.write("other")
    assert "exists" in copy() and open(target).read() == "other"
    assert copy(override=True) is None and open(target).read() == "data"
    assert os.listdir(os.path.dirname(target)) == [b"dest.txt"]


def test_vanished_file_is_a_failed_row(spark, source, tmp_path, monkeypatch):
    put(source, "a", "one")
    ghost = put(source, "ghost", "two")
    listed = tree.scan_tree(spark, str(source))
    frozen = listed.files.collect()
    os.remove(ghost)
    listed.files = spark.createDataFrame(frozen, listed.files.schema)
    monkeypatch.setattr("firstseen.plans.files.scan_tree", lambda *a: listed)
    result = run(spark, source, tmp_path)
    assert {k: v[1] for k, v in outcomes(result).items()} == {"a": "copied", "ghost": "failed"}
    assert result.stats.first()["failed_files"] == 1 and result.stats.first()["total_files"] == 1


def test_empty_source(spark, source, tmp_path):
    result = run(spark, source, tmp_path)
    assert set(result.stats.first()) == {0} and (tmp_path / "state").is_dir()


def test_crashed_run_must_be_resumed(spark, source, tmp_path, monkeypatch):
    put(source, "a", "one")
    put(source, "b", "two")

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(State, "append_ledger", crash)
        with pytest.raises(RuntimeError, match="lost"):
            run(spark, source, tmp_path)
    assert names(tmp_path / "dst") == ["a", "b"]
    with pytest.raises(RuntimeError, match="resume"):
        run(spark, source, tmp_path)
    resumed = run(spark, source, tmp_path, resume=True)
    assert {v[1] for v in outcomes(resumed).values()} == {"copied"}
    assert State(spark, str(tmp_path / "state")).ledger().count() == 2
    assert {v[1] for v in outcomes(run(spark, source, tmp_path)).values()} == {"skipped"}


def test_arguments(spark, source, tmp_path):
    with pytest.raises(ValueError):
        run(spark, source, tmp_path, dest=None)
    with pytest.raises(ValueError):
        run(spark, source, tmp_path, mode="move")
    with pytest.raises(FileNotFoundError):
        run(spark, source / "missing", tmp_path)
