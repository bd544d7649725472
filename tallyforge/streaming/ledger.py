"""An extension: the ledger over a growing folder of flat call records, as a stream.

Records of one response may come more than once and late; each is billed once, and totals go by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import attempt_costs
from ..sources.prices import SnapshotA, rates_a

RECORDS = "path string, id string, ts timestamp, kind string, model string, speed string, geo string, inp bigint, cc bigint, cc5 bigint, cc1 bigint, cr bigint, out bigint"


def records(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_costs(rows: DataFrame, prices: SnapshotA | None = None, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window, model, calls, cost in nano-dollars): each response is counted once within the watermark."""
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    costed = attempt_costs(rates_a(once, prices or SnapshotA.load(), exact=True), zero=0)
    return costed.groupBy(F.window("ts", window), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("cost"))


def idle_sessions(rows: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(session window, path, calls): runs of calls of a thread without an idle gap."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "path").agg(F.count(F.lit(1)).alias("calls"))
