"""What the queries write for themselves reaches a task, and its Python, in bounded portions."""

import os
import uuid
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firstseen.plans import binding, queries

ROWS, TEXT = 400, 4_000


@pytest.fixture
def folder(spark, tmp_path):
    """Documents of 1.6 MB in all; texts differ."""
    text = F.rpad(F.col("id").cast("string"), TEXT, "x")
    docs = spark.range(ROWS).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"),
        F.lit(TEXT).cast("bigint").alias("n_chars"),
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def recorder(out):
    """In place of the task that writes files: a line for each batch of a task's rows."""

    def record(root):
        def run(batches):
            name = os.path.join(out, uuid.uuid4().hex)
            for batch in batches:
                sizes = [len(payload) for payload in batch.column("payload").to_pylist()]
                with open(name, "a") as lines:
                    lines.write(f"{sum(sizes)}\n")
                yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64())], names=["files"])

        return run

    return record


def test_tree_is_written_in_small_batches_and_tasks(spark, folder, tmp_path, monkeypatch):
    out = tmp_path / "batches"
    out.mkdir()
    monkeypatch.setattr(queries, "_write_tree_task", recorder(str(out)))
    monkeypatch.setattr(queries, "_BATCH_BYTES", 32_000, raising=False)
    monkeypatch.setattr(queries, "_TASK_BYTES", 50_000, raising=False)
    queries._write_documents(spark, binding.documents(spark, folder), "/nowhere")
    tasks = [[int(line) for line in path.read_text().split()] for path in out.iterdir()]
    assert sum(map(sum, tasks)) == ROWS * TEXT
    assert max(map(max, tasks)) <= 32_000 + TEXT
    assert max(map(sum, tasks)) <= 2 * 50_000  # by a hash, so not all alike


def test_files_of_the_tree_hold_the_texts(spark, folder):
    root = Path(queries.document_tree(spark, folder))
    written = {path.stem: path for path in root.rglob("*.txt")}
    assert len(written) == ROWS
    assert all(path.read_text() == name.lstrip(".").ljust(TEXT, "x") for name, path in written.items())


def test_document_stream_has_three_batches_of_small_files(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_TASK_BYTES", 50_000, raising=False)
    batches = []
    stream = queries._document_stream(spark, folder)
    take = lambda batch, _: batches.append(
        [(row["n"], row["b"]) for row in batch.groupBy(F.input_file_name()).agg(
            F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()]
    )
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 3
    assert sum(n for batch in batches for n, _ in batch) == ROWS
    assert max(b for batch in batches for _, b in batch) <= 2 * 50_000
