"""Parquet state: the ledger of accepted contents and the hash cache.

``ledger/writer=W/run_id=N`` is append-only. ``cache/snapshot=N`` is a layer: all
entries, or those that changed since the layer below. Its commit names the layers that
make up the cache with it; readers take the newest commit. A directory counts once it holds
``_COMMITTED``, which is written after the data and names the directories it replaces, so a
crash at any point leaves either the old or the new state.

Upkeep merges runs and layers of like size (see ``tiers``), so what a run rewrites is in
proportion to what it wrote, not to what the state holds.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from firstseen import schemas
from firstseen.operators import cache as cache_ops
from firstseen.operators import ledger as ledger_ops
from firstseen.state import tiers
from firstseen.state.folder import Folder

_MARK = "_COMMITTED"
BATCH, COMPACT = "batch", "compact"

# Rows per file of a rewritten table: about 128 MiB of digests.
_ROWS_PER_FILE = 3_000_000

# Layers of the cache that are merged at once.
_LAYERS = 8


# The ledger is sorted by digest in small pages, whose smallest and largest digests stand in
# the file's page index: looking up some digests reads their pages, whatever the file's size.
# A run's files each span all digests, so a Bloom filter, of the size its digests need, tells which file to open.
_PAGES = {
    "parquet.page.size": "16384", "parquet.page.row.count.limit": "400", "parquet.page.size.row.check.min": "100",
    "parquet.enable.dictionary#content_hash": "false",
}
_BLOOM = {"parquet.bloom.filter.enabled#content_hash": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def now_ms() -> int:
    return time.time_ns() // 1_000_000


class State:
    """Opens or creates the state below ``root``. One batch writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.folder = Folder(spark, root)
        self.folder.make()
        self._claims: dict[int, str] = {}

    # ------------------------------------------------------------- ledger

    def _runs(self) -> dict[str, dict]:
        """Committed, not replaced run directories and their commit records."""
        found = self._committed()
        replaced = {old for record in found.values() for old in record.get("replaces", ())}
        return {name: record for name, record in found.items() if name not in replaced}

    def _committed(self) -> dict[str, dict]:
        found: dict[str, dict] = {}
        for writer in self.folder.subfolders("ledger"):
            for run in self.folder.subfolders(f"ledger/{writer}"):
                name = f"ledger/{writer}/{run}"
                if self.folder.exists(f"{name}/{_MARK}"):
                    found[name] = self.folder.read(f"{name}/{_MARK}")
        return found

    @staticmethod
    def _writer_and_run(name: str) -> tuple[str, int]:
        _, writer, run = name.split("/")
        return writer.split("=", 1)[1], int(run.split("=", 1)[1])

    def ledger(self, replaying: tuple[str, int] | None = None) -> DataFrame:
        """The ledger; ``replaying=(writer, run)`` hides that run and later ones
        of the same writer, so that a replayed batch does not find its own rows."""
        names = []
        for name in self._runs():
            writer, run = self._writer_and_run(name)
            if replaying is None or writer != replaying[0] or run < replaying[1]:
                names.append(name)
        return self._read_ledger(names)

    def _read_ledger(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schemas.LEDGER)
        reader = self.spark.read.schema(schemas.LEDGER).option("basePath", self.folder.path("ledger"))
        return reader.parquet(*[self.folder.path(name) for name in names])

    def next_run(self, writer: str = BATCH) -> int:
        """First unused run number; numbers of folded runs are not used again."""
        runs = self.folder.subfolders(f"ledger/writer={writer}")
        used = [int(r.split("=", 1)[1]) for r in runs]
        used += [record["folded"][writer] for record in self._runs().values() if writer in record.get("folded", {})]
        return max(used, default=-1) + 1

    def open_run(self, resume: bool = False) -> int:
        """Claim the next batch run; a second batch writer fails here.

        A run that was claimed but placed nothing yet is taken over: whichever of
        two writers with the same number calls ``mark_placing`` first goes on, the
        other fails there. A run that crashed while it placed data blocks new ones,
        because its data may be half written; ``resume=True`` takes it over. Runs
        that claim a number and plain ``append_ledger`` calls count from the same
        numbers, and only what carries this run's own claim is ever deleted.
        """
        names = self.folder.files("runs")
        last = max((int(n.split("-")[1]) for n in names if n.startswith("batch-")), default=-1)
        if last >= 0 and f"done-{last}" not in names:
            placing = f"placing-{last}" in names
            if placing and not resume:
                raise RuntimeError(f"batch run {last} is unfinished or still active; pass resume=True to redo it")
            claim = self.folder.read(f"runs/batch-{last}").get("claim")
            name = f"ledger/writer={BATCH}/run_id={last}"
            written = self.folder.exists(f"{name}/{_MARK}")
            if not written or claim and self.folder.read(f"{name}/{_MARK}").get("claim") == claim:
                self.folder.delete(name)
                self.folder.delete(f"runs/placing-{last}")
                self._claims[last] = claim
                return last
            # Somebody else's committed run has the number: it stays, the claim is given up.
            self.folder.write_once(f"runs/done-{last}", {})
        number = max(last + 1, self.next_run(BATCH))
        self._claims[number] = uuid.uuid4().hex
        self.folder.write_once(f"runs/batch-{number}", {"claim": self._claims[number]})
        return number

    def mark_placing(self, run_id: int) -> None:
        """Record that a claimed run begins to write data; only one writer can."""
        self.folder.write_once(f"runs/placing-{run_id}", {"claim": self._claims.get(run_id)})

    def close_run(self, run_id: int) -> None:
        """Record that a claimed run is complete and drop older claims."""
        self.folder.write_once(f"runs/done-{run_id}", {})
        for name in self.folder.files("runs"):
            if int(name.split("-")[1]) < run_id:
                self.folder.delete(f"runs/{name}")

    def append_ledger(
        self, entries: DataFrame, writer: str = BATCH, run_id: int | None = None, replay: bool = False
    ) -> int:
        """Write one run of (content_hash, copied_time); the commit comes last.

        A second batch writer of the same run fails. A streaming replay
        overwrites its own run.
        """
        run_id = self.next_run(writer) if run_id is None else run_id
        name = f"ledger/writer={writer}/run_id={run_id}"
        mode = "overwrite" if replay else "errorifexists"
        ordered = entries.select("content_hash", "copied_time").sortWithinPartitions("content_hash")
        ordered.write.mode(mode).options(**_PAGES, **_BLOOM).parquet(self.folder.path(name))
        claim = self._claims.get(run_id) if writer == BATCH else None
        self.folder.write_once(f"{name}/{_MARK}", {"replaces": [], "claim": claim, "bytes": self.folder.bytes(name)})
        return run_id

    def _rewrite_ledger(self, df: DataFrame, names: list[str], size: int | None = None) -> int:
        run_id = self.next_run(COMPACT)
        target = f"ledger/writer={COMPACT}/run_id={run_id}"
        # Digests are uniform, so a range cut gives even files.
        files = max(1, -(-self._read_ledger(names).count() // _ROWS_PER_FILE))
        df.repartitionByRange(files, "content_hash").sortWithinPartitions("content_hash").write.mode(
            "errorifexists"
        ).options(**_PAGES).parquet(self.folder.path(target))
        # Directories that earlier rewrites replaced stay replaced: their record may go now.
        committed = self._committed()
        left = {old for record in committed.values() for old in record.get("replaces", ()) if old in committed}
        replaced = sorted({*names, *left})
        record = {"replaces": replaced, "folded": self._last_folded(names), "bytes": size or self.folder.bytes(target)}
        self.folder.write_once(f"{target}/{_MARK}", record)
        # What this rewrite replaces stays, hidden, until the next one: frames read from it go on.
        for name in sorted(left):
            self.folder.delete(name)
        return run_id

    def _last_folded(self, names: list[str]) -> dict[str, int]:
        """Highest run number per writer that has gone into a rewrite, ever."""
        records = self._runs()
        last: dict[str, int] = {}
        for name in names:
            writer, run = self._writer_and_run(name)
            for known, number in [(writer, run), *records[name].get("folded", {}).items()]:
                last[known] = max(last.get(known, -1), number)
        return last

    def compact_ledger(self, replayable: dict[str, int] | None = None, min_runs: int = 2) -> int | None:
        """Fold all runs that can no longer be replayed into one.

        ``replayable`` gives, per streaming writer, the first run that may still
        be replayed; those runs stay as they are. Nothing happens below
        ``min_runs`` runs, which spreads the cost of a rewrite over many runs.
        One compaction may run at a time.
        """
        names = list(self._foldable(replayable))
        if len(names) < max(min_runs, 2):
            return None
        return self._rewrite_ledger(ledger_ops.folded(self._read_ledger(names)), names)

    def _foldable(self, replayable: dict[str, int] | None) -> dict[str, dict]:
        keep, found = replayable or {}, {}
        for name, record in self._runs().items():
            writer, run = self._writer_and_run(name)
            if writer in (BATCH, COMPACT) or run < keep.get(writer, 0):
                found[name] = record
        return found

    def tend_ledger(self, replayable: dict[str, int] | None = None, runs: int = 8) -> int | None:
        """Merge at least ``runs`` runs of like size, if there are so many; the rest stay.

        Whatever the number of runs, a row is rewritten at most log2(bytes of the
        ledger / bytes of its first run) times. A lookup opens a number of runs that
        grows with the logarithm of the ledger. One compaction may run at a time.
        """
        found = self._foldable(replayable)
        names = list(found)
        sizes = [record.get("bytes") or self.folder.bytes(name) for name, record in found.items()]
        chosen = tiers.due(sizes, runs)
        if not chosen:
            return None
        merged = [names[place] for place in chosen]
        # Digests that runs share count once in each, so that a merge never looks smaller than what it took.
        size = sum(sizes[place] for place in chosen)
        return self._rewrite_ledger(ledger_ops.folded(self._read_ledger(merged)), merged, size)

    def forget(self, hashes: DataFrame) -> int:
        """Remove digests from the ledger so that their content counts as new.

        Covers every writer, so no streaming query may be running.
        """
        names = list(self._runs())
        return self._rewrite_ledger(ledger_ops.folded(ledger_ops.forget(self._read_ledger(names), hashes)), names)

    # -------------------------------------------------------------- cache

    def _snapshots(self) -> list[int]:
        ids = [int(s.split("=", 1)[1]) for s in self.folder.subfolders("cache")]
        return sorted(i for i in ids if self.folder.exists(f"cache/snapshot={i}/{_MARK}"))

    def _layers(self) -> list[int]:
        """Layers of the cache, the oldest first."""
        done = self._snapshots()
        return self._stack(done[-1]) if done else []

    def _stack(self, number: int) -> list[int]:
        return self.folder.read(f"cache/snapshot={number}/{_MARK}").get("layers", [number])

    def _read_layers(self, numbers: list[int]) -> DataFrame:
        reader = self.spark.read.schema(schemas.CACHE_LAYER).option("basePath", self.folder.path("cache"))
        return reader.parquet(*[self.folder.path(f"cache/snapshot={number}") for number in numbers])

    def cache(self) -> DataFrame:
        """The entries; of a path in several layers, the newest one's."""
        layers = self._layers()
        if not layers:
            return self.spark.createDataFrame([], schemas.CACHE)
        if len(layers) == 1:
            return self.spark.read.schema(schemas.CACHE).parquet(self.folder.path(f"cache/snapshot={layers[0]}"))
        return cache_ops.left_over(cache_ops.newest(self._read_layers(layers)))

    def write_cache(self, df: DataFrame) -> int:
        """Write all entries anew, as the only layer."""
        return self._write_layer(df.select(*schemas.CACHE.fieldNames()), [])

    def change_cache(self, entries: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Insert or replace ``entries``, remove the paths of ``gone``; only these are written.

        A path may not be in both.
        """
        parts = [cache_ops.layer(entries, gone=False)] if entries is not None else []
        parts += [cache_ops.layer(gone, gone=True)] if gone is not None else []
        if not parts:
            raise ValueError("nothing to change")
        return self.add_layer(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def add_layer(self, rows: DataFrame) -> int:
        """Write changes, rows of ``operators.cache.layer``, over the layers there are, and merge what is due.

        Changes that together outweigh the oldest layer are folded into it, so all entries
        are rewritten only after as much was written. Newer layers are merged among themselves.
        """
        below = self._layers()
        if not below:
            return self.write_cache(cache_ops.left_over(rows))
        number = self._write_layer(rows, below)
        layers = self._layers()
        sizes = [self.folder.read(f"cache/snapshot={n}/{_MARK}").get("bytes") or self.folder.bytes(f"cache/snapshot={n}") for n in layers]
        if sum(sizes[1:]) >= sizes[0]:
            return self.write_cache(self.cache())
        count = tiers.due_newest(sizes[1:], _LAYERS)
        if count:
            merged = cache_ops.newest(self._read_layers(layers[-count:]))
            return self._write_layer(merged, layers[:-count])
        return number

    def _write_layer(self, rows: DataFrame, below: list[int]) -> int:
        """Commit the next layer; drop what neither it nor the commit before it needs."""
        taken = [int(s.split("=", 1)[1]) for s in self.folder.subfolders("cache")]
        done = self._snapshots()
        number = max(taken, default=-1) + 1
        name = f"cache/snapshot={number}"
        rows.write.mode("errorifexists").parquet(self.folder.path(name))
        record = {"layers": [*below, number], "bytes": self.folder.bytes(name)}
        needed = {*below, number, number - 1, *(self._stack(done[-1]) if done else ())}
        self.folder.write_once(f"{name}/{_MARK}", record)
        for old in taken:
            if old not in needed:
                self.folder.delete(f"cache/snapshot={old}")
        return number
