"""File arrival into bronze tables: triggered, restartable, idempotent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators.cleanse import keep_first
from weirflow.operators.merge import assert_keys
from weirflow.sources import bronze
from weirflow.sources.store import ParquetStore

LEDGER = "flow string, batch_id long, rows long"


def sink(store: ParquetStore, name: str, keys: list[str], mode: str, flow: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; a batch that a restart replays is recognised by its flow and number and skipped.

    ``flow`` names a checkpoint: batches of another one begin at 0 again and are no replays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = store.read_or(f"{name}_batches", LEDGER)
        if not ledger.where((F.col("flow") == flow) & (F.col("batch_id") == batch_id)).isEmpty():
            return
        kept = batch.persist()
        try:
            assert_keys(kept, keys)
            if mode == "insert_only":
                # Within a batch a key may come twice: the first file's row is kept, of one file's the first by a hash.
                store.insert_only(name, keep_first(kept, keys, [F.asc("_source_file")]), keys)
            elif mode == "overwrite":
                store.overwrite(name, kept)
            else:
                # A crash between data and ledger replays files that are there already, and a new checkpoint lists all files.
                files = [r[0] for r in kept.select("_source_file").distinct().collect()]  # a batch's files
                there = store.read(name).where(F.col("_source_file").isin(files)).select("_source_file").distinct() if store.exists(name) else None
                store.append(name, kept if there is None else kept.join(there, "_source_file", "left_anti").select(*kept.columns))
            store.append(f"{name}_batches", batch.sparkSession.createDataFrame([(flow, batch_id, kept.count())], LEDGER))
        finally:
            kept.unpersist()

    return write


def start(
    spark: SparkSession, store: ParquetStore, source: str, path: str, checkpoint: str, mode: str = "append", name: str | None = None, within: str | None = None,
    files_per_batch: int | None = None, rescue: bool = False, **trigger,
) -> StreamingQuery:
    """Start taking in files; ``trigger`` as of Spark's writer (``processingTime="1 minute"`` goes on until it is stopped).

    ``within``: rows that repeat within this horizon ("2 days") are dropped by a stateful step in front of the sink.
    ``rescue``: rows that don't fit their columns are kept as they came, beside what could be read of them.
    """
    table = name or f"bronze.{source}"
    key = bronze.CONTRACT[source][0]
    stream = bronze.stream_csv(spark, source, path, rescue, files_per_batch)
    stream = bronze.distinct_within(stream, within) if within else stream
    return stream.writeStream.foreachBatch(sink(store, table, [key], mode, f"{path}@{checkpoint}")).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest(spark: SparkSession, store: ParquetStore, source: str, path: str, checkpoint: str, mode: str = "append", name: str | None = None, **options) -> None:
    """Take in all files that have arrived, then stop; ``options`` as of :func:`start`."""
    start(spark, store, source, path, checkpoint, mode, name, **options, availableNow=True).awaitTermination()


@dataclass(frozen=True)
class Flow:
    """One source of rows of a streaming table; ``once`` flows are for backfills."""

    target: str
    name: str
    source: str
    path: str
    once: bool = False


@dataclass
class FlowRegistry:
    """Several flows into one table, each with its own checkpoint."""

    store: ParquetStore
    checkpoints: str
    flows: list[Flow] = field(default_factory=list)

    def add(self, flow: Flow) -> None:
        if any(f.name == flow.name for f in self.flows):
            raise ValueError(f"flow {flow.name} is there already")
        self.flows.append(flow)

    def run(self, spark: SparkSession) -> list[str]:
        """Run all flows that have something to do; a ``once`` flow runs a single time ever."""
        done = []
        for flow in self.flows:
            ran = self.store.read_or(f"{flow.target}_batches", LEDGER).where(F.col("flow") == f"{flow.path}@{self.checkpoints}/{flow.name}")
            if flow.once and not ran.isEmpty():
                continue
            ingest(spark, self.store, flow.source, flow.path, f"{self.checkpoints}/{flow.name}", name=flow.target)
            done.append(flow.name)
        return done
