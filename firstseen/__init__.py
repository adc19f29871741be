"""Incremental, stateful, exact-content dedup ingest on Spark.

The package is a set of DataFrame operators (``functions``, ``sources``,
``operators``), the Parquet state they read and write (``state``), the batch
runs built from them (``plans``) and the streaming runs (``streaming``).
"""

from firstseen.plans.files import ingest_files
from firstseen.plans.tables import ingest_table
from firstseen.state.store import State

__all__ = ["State", "ingest_files", "ingest_table"]
