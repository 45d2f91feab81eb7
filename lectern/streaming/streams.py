"""Structured Streaming jobs that feed the summary tables.

Each micro-batch of the log names the days it touched, and these days are rebuilt
from the log table. So the tables equal those of the batch job at any time: the
open day is there, and a day hit by late events is repaired however old it is. No
state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.session import scratch_path
from lectern.settings import Settings
from lectern.sources import LmsTables
from lectern.streaming import rollups


def replace_job(
    log: DataFrame, tables: LmsTables, s: Settings, store: rollups.Store, jobs: tuple[str, ...], checkpoint: str
) -> None:
    """Rebuild, per micro-batch, the days whose events arrived."""

    def rebuild(batch: DataFrame, _epoch: int) -> None:
        # Only the list of touched days reaches the driver.
        days = [row.fecha for row in batch.distinct().orderBy("fecha").collect()]
        newest = rollups.newest_id(tables) if days else None
        for job in jobs if days else ():
            change = store.table(job).change()
            for first, last in rollups.day_ranges(days):
                rollups.run_range(tables, s, change, job, first, last, newest)
            change.commit()

    query = (
        log.select(rollups.day_of(s).alias("fecha"))
        .writeStream.foreachBatch(rebuild)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_replace_job(log: DataFrame, tables: LmsTables, s: Settings, job: str) -> DataFrame:
    """Feed one summary table from a stream into the shared folder and read it."""
    spark = log.sparkSession
    store = rollups.Store(spark, scratch_path(spark, job))
    replace_job(log, tables, s, store, (job,), scratch_path(spark, "checkpoint"))
    return store.read(job)
