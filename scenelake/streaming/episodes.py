"""Contact episodes over a stream of contact points.

State is tables per micro-batch in the shared folder: the contact steps that arrived, runs
that may still grow, and the highest step seen per log. A step older than the allowed
lateness is final; a run ending before the final horizon is emitted. A batch writes its own
steps and reads, of those before, the ones that its horizons pass, so a step is written once
and read when it becomes final, however many batches there are; an open run is one row, and
every stage is a distributed DataFrame job rather than one worker per pair.

Closing emits what is open under ``closing`` and leaves the state as it is. A stream that
goes on after that supersedes the closing output: its open runs are emitted when they end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from scenelake.operators import ordered
from scenelake.session import missing

LOG = ["instance_id", "branch"]
PAIR = [*LOG, "object_a", "object_b"]


@dataclass(frozen=True)
class EpisodeStream:
    root: str
    step_rate: float
    lateness: int
    force_threshold: float = 0.0
    minimum_impulse: float = 0.0

    def _read(self, spark: SparkSession, name: str, batch: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.root}/state/{name}/batch={batch}")
        except AnalysisException as error:
            if not missing(error):
                raise
            return None

    def _keep(self, df: DataFrame, name: str, batch: int, final: bool) -> DataFrame:
        path = f"{self.root}/{'closing/' if final else ''}state/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)

    def process(self, contacts: DataFrame, batch: int, final: bool = False) -> None:
        """Folds one batch of (instance_id, branch, step, object_a, object_b, normal_force)."""
        spark = contacts.sparkSession
        arrived = contacts.groupBy(*PAIR, "step").agg(F.sum("normal_force").alias("normal_force"))
        marks = self._read(spark, "marks", batch - 1)
        if marks is not None:
            horizon = marks.select(*LOG, (F.col("top") - self.lateness).alias("_final"))
            arrived = arrived.join(horizon, LOG, "left").withColumn("_late", F.coalesce(F.col("step") < F.col("_final"), F.lit(False))).drop("_final")
        else:
            arrived = arrived.withColumn("_late", F.lit(False))
        # Aggregated and written once; in order, so that later batches pass over the pages of other steps.
        arrived = self._keep(arrived.sortWithinPartitions("step"), "recent", batch, final)
        if marks is not None:
            arrived.where("_late").drop("_late").write.mode("overwrite").parquet(f"{self.root}/late/batch={batch}")
        tops = arrived.where("NOT _late").groupBy(*LOG).agg(F.max("step").alias("top"))
        if marks is not None:
            tops = tops.unionByName(marks).groupBy(*LOG).agg(F.max("top").alias("top"))
        tops = self._keep(tops, "marks", batch, final)
        edge = F.col("top") + 2 if final else F.col("top") - self.lateness
        settled = self._settling(arrived, marks, tops.select(*LOG, edge.alias("_final")), batch)
        settled = settled.groupBy(*PAIR, "step").agg(F.sum("normal_force").alias("normal_force")).where(F.col("normal_force") >= self.force_threshold)
        runs = ordered.runs(
            settled.withColumn("impulse", F.col("normal_force") / float(self.step_rate)), PAIR, "step",
            {"total_impulse": (F.sum("impulse"), "sum"), "peak_force": (F.max("normal_force"), "max")},
        )
        heads = self._read(spark, "heads", batch - 1)
        if heads is not None:
            runs = self._joined(runs.unionByName(heads))
        # A run ending exactly at the horizon can still grow.
        dated_runs = runs.join(tops.select(*LOG, edge.alias("_final")), LOG).withColumn("_done", F.col("end_step") < F.col("_final")).drop("_final")
        dated_runs = self._keep(dated_runs, "runs", batch, final)
        self._keep(dated_runs.where("NOT _done").drop("_done"), "heads", batch, final)
        closed = dated_runs.where(F.col("_done") & (F.col("total_impulse") >= self.minimum_impulse)).drop("_done")
        closed.write.mode("overwrite").parquet(f"{self.root}/{'closing/' if final else ''}episodes/batch={batch}")

    def _settling(self, arrived: DataFrame, marks: DataFrame | None, finals: DataFrame, batch: int) -> DataFrame:
        """Steps of this batch and those before that its horizons pass; of other steps the files' statistics tell."""
        moved = finals
        if marks is None:
            moved = moved.withColumn("_from", F.lit(None).cast("int"))
        else:
            moved = moved.join(marks.select(*LOG, (F.col("top") - self.lateness).alias("_from")), LOG, "left")
        moved = moved.where(F.col("_from").isNull() | (F.col("_final") > F.col("_from")))
        ends = moved.agg(F.max("_final").alias("stop"), F.min("_from").alias("start"), F.count_if(F.col("_from").isNull()).alias("fresh")).first()
        columns = [*PAIR, "step", "normal_force"]
        rows = arrived.where("NOT _late").select(*columns)
        if marks is not None:
            folder = f"{self.root}/state/recent"
            known = arrived.sparkSession.read.schema(T.StructType([*arrived.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", folder).parquet(folder)
            rows = rows.unionByName(known.where((F.col("batch") < batch) & ~F.col("_late")).select(*columns))
        if ends["stop"] is not None:
            rows = rows.where(F.col("step") < ends["stop"])
        if ends["start"] is not None and not ends["fresh"]:
            rows = rows.where(F.col("step") >= ends["start"])
        return rows.join(moved, LOG).where((F.col("step") < F.col("_final")) & (F.col("_from").isNull() | (F.col("step") >= F.col("_from")))).select(*columns)

    @staticmethod
    def _joined(runs: DataFrame) -> DataFrame:
        """Merges runs that touch; they never overlap, since settled steps do not change."""
        chain = W.partitionBy(*PAIR).orderBy("start_step")
        opens = F.coalesce(F.lag("end_step").over(chain) != F.col("start_step"), F.lit(True)).cast("int")
        return (
            runs.withColumn("_opens", opens)
            .withColumn("_run", F.sum("_opens").over(chain.rowsBetween(W.unboundedPreceding, W.currentRow)))
            .groupBy(*PAIR, "_run")
            .agg(F.min("start_step").alias("start_step"), F.max("end_step").alias("end_step"),
                 F.sum("total_impulse").alias("total_impulse"), F.max("peak_force").alias("peak_force"))
            .drop("_run")
        )

    def run(self, spark: SparkSession, source: str, schema: str, files_per_batch: int = 1, source_format: str = "parquet") -> None:
        """Processes all files present, then stops; a later call continues."""
        query = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(source_format).load(source)
            .writeStream.foreachBatch(lambda rows, batch: self.process(rows, batch))
            .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def close(self, spark: SparkSession, batch: int) -> None:
        """Ends the stream: everything still open is emitted as batch ``batch``."""
        empty = self._read(spark, "recent", batch - 1).drop("_late").limit(0)
        self.process(empty, batch, final=True)

    def last_batch(self, spark: SparkSession) -> int:
        row = spark.read.option("basePath", f"{self.root}/state/marks").parquet(f"{self.root}/state/marks").agg(
            F.max("batch").alias("b")).first()
        return int(row["b"])

    def episodes(self, spark: SparkSession) -> DataFrame:
        ended = spark.read.option("basePath", f"{self.root}/episodes").parquet(f"{self.root}/episodes")
        folder = f"{self.root}/closing/episodes"
        try:
            closing = spark.read.option("basePath", folder).parquet(folder)
        except AnalysisException as error:
            if not missing(error):
                raise
            return ended.drop("batch")
        return ended.unionByName(closing.where(F.col("batch") > self.last_batch(spark))).drop("batch")

    def late(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.option("basePath", f"{self.root}/late").parquet(f"{self.root}/late").drop("batch")
        except AnalysisException as error:
            if not missing(error):
                raise
            return None
