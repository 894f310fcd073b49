"""Event-time ingest: late rows to quarantine, repeats dropped by watermarked state.

A stateful operator drops late rows without a trace, so lateness is settled one
step before it. The first step holds every batch against the greatest
event time of all batches before it: rows at or before that time less `delay`,
and rows without an event time, go to quarantine, the others go on. Each batch leaves its greatest
time, measured by the job that writes it, so a replayed batch is judged as before.
The second step reads what went on under a watermark of the same delay and keeps
the first row of each key; its state forgets a key once no row of its time can come.
Its watermark is never ahead of the first step's, so it drops no row as late.

Both steps go on from their checkpoints. The second is to run when the first has
ended, and takes all that is there as one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof.sources.measured import measured_write
from moveproof.streaming.tables import run_available

MARKS = "latest timestamp, batch long"


class EventTimeIngest:
    """Rows of `schema` by event time `ts`, unique by `keys`; `delay` as in '4 days'."""

    def __init__(self, path: str, schema: T.StructType, ts: str, keys: list[str], delay: str):
        self.path, self.schema, self.ts, self.keys, self.delay = path.rstrip("/"), schema, ts, keys, delay

    def _watermark(self, spark: SparkSession, batch_id: int):
        """Greatest event time of the batches before, less the delay; null before the first."""
        spark.createDataFrame([], "latest timestamp").write.mode("ignore").parquet(f"{self.path}/marks/batch=-1")
        before = spark.read.schema(MARKS).parquet(f"{self.path}/marks").filter(F.col("batch") < batch_id)
        return before.agg((F.max("latest") - F.expr(f"INTERVAL {self.delay}")).alias("w")).first()["w"]

    def split(self, batch: DataFrame, batch_id: int) -> None:
        mark = self._watermark(batch.sparkSession, batch_id)
        time = F.col(f"`{self.ts}`")
        late = F.lit(False) if mark is None else time.cast("timestamp") <= F.lit(mark)
        error = F.when(time.isNull(), "no event time").when(late, "late")
        batch = batch.withColumn("error", error)
        passed = batch.filter(F.col("error").isNull()).drop("error")
        found = measured_write(passed, f"{self.path}/passed/batch={batch_id}", {
            "latest": F.max(F.unix_micros(time.cast("timestamp")))})
        batch.filter(F.col("error").isNotNull()).write.mode("overwrite").parquet(
            f"{self.path}/quarantine/batch={batch_id}")
        latest = batch.sparkSession.range(1).select(F.timestamp_micros(F.lit(found["latest"])).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")

    def run(self, stream: DataFrame) -> None:
        """Take everything there is through both steps."""
        spark = stream.sparkSession
        run_available(stream, f"{self.path}/checkpoint-split", self.split)
        passed = spark.readStream.schema(self.schema).parquet(f"{self.path}/passed")
        unique = passed.withWatermark(self.ts, self.delay).dropDuplicatesWithinWatermark(self.keys)
        query = (
            unique.writeStream.format("parquet").option("path", f"{self.path}/rows")
            .option("checkpointLocation", f"{self.path}/checkpoint-unique").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def quarantined(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("error", T.StringType())])).parquet(
            f"{self.path}/quarantine")
