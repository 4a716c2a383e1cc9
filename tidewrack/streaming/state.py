"""The archive as streams: logs folded to state, idempotent receivers, latest wishes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.versions import latest
from tidewrack.shared import shared_dir


class LatestState:
    """The latest row of each key, as tables under ``where``: keys are dealt to buckets by hash, a batch
    writes anew only the buckets it touches, and a manifest says which batch holds each bucket.

    The manifest is written last and counts once it is complete, so a new object on the same folder goes
    on where the last one stopped, and a batch that comes twice changes nothing."""

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], where: str | None = None, buckets: int = 64, schema=None):
        self.spark, self.keys, self.order, self.buckets, self.schema = spark, keys, order, buckets, schema
        self.where = where or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        self.at = max(self._folders("manifest"), default=-1)
        held = [] if self.at < 0 else spark.read.schema("bucket int, batch long").json(f"{self.where}/manifest/{self.at:09d}").collect()  # a row per bucket
        self.held = {r.bucket: r.batch for r in held}

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, name: str) -> list[int]:
        """Numbers of the complete tables in a folder."""
        path, fs = self._fs(name)
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [int(x) for x in found if x.isdigit() and fs.exists(self._fs(f"{name}/{x}/_SUCCESS")[0])]

    def _read(self, buckets, schema) -> DataFrame | None:
        paths = [f"{self.where}/state/{self.held[b]:09d}/_bucket={b}" for b in sorted(buckets) if b in self.held]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Fold a micro-batch into the state; for ``foreachBatch``."""
        if batch <= self.at:
            return
        self.schema = rows.schema
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket")
        new = latest(rows, self.keys, self.order).persist()
        touched = [r._bucket for r in new.select(bucket).distinct().collect()]  # at most ``buckets``
        old = self._read(touched, rows.schema)
        merged = new if old is None else latest(old.unionByName(new), self.keys, self.order)
        merged.select("*", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.where}/state/{batch:09d}")
        new.unpersist()
        held = self.held | dict.fromkeys(touched, batch)
        table = self.spark.createDataFrame(sorted(held.items()), "bucket int, batch long").coalesce(1)
        table.write.mode("overwrite").json(f"{self.where}/manifest/{batch:09d}")
        self.at, self.held = batch, held
        for n in self._folders("state"):  # what no bucket is read from any more
            if n not in held.values() and n < batch:
                path, fs = self._fs(f"state/{n:09d}")
                fs.delete(path, True)

    def read(self) -> DataFrame:
        """The state; without any batch an empty table, if the schema is known."""
        rows = self._read(self.held, self.schema)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows


def current_from_stream(spark: SparkSession, path: str, keys: list[str], order: list[str], deleted: Column, files_per_batch: int = 1) -> DataFrame:
    """The state of a log read as a file stream, without tombstones: what the batch fold of
    the same files gives."""
    schema = spark.read.parquet(path).schema
    # a single file is streamed through its folder
    folder, name = (path.rsplit("/", 1)[0], path.rsplit("/", 1)[1])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    log = source.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else source.parquet(path)
    state = LatestState(spark, keys, order, schema=schema)
    run = log.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{state.where}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()
    return state.read().where(~F.coalesce(deleted, F.lit(False)))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def deliver(outbox: DataFrame, state: LatestState, acks: str) -> None:
    """Drain an outbox stream: every message is merged by key (a repeat replaces itself), then
    acknowledged."""
    def receive(rows: DataFrame, batch: int) -> None:
        state.merge(rows, batch)
        rows.select("message_id").distinct().write.mode("overwrite").parquet(f"{acks}/{batch:09d}")
    outbox.writeStream.foreachBatch(receive).option("checkpointLocation", f"{state.where}/outbox").trigger(availableNow=True).start().awaitTermination()


def pending(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """Messages not acknowledged yet, in order."""
    return outbox.join(acks.select("message_id"), "message_id", "left_anti").orderBy("message_id")


def rotation_deltas(wishes: DataFrame, current: DataFrame, key: str = "page", order: str = "at") -> DataFrame:
    """(page, delta): the turn from what is to what was last wished. Wishes name the final
    rotation, so repeats and reordering by ``order`` change nothing."""
    want = latest(wishes, [key], [order]).select(key, F.col("rotation").alias("wished"))
    both = want.join(current.select(key, F.col("rotation").alias("now")), key, "left")
    return both.withColumn("delta", F.pmod(F.col("wished") - F.coalesce("now", F.lit(0)), F.lit(360))).where("delta <> 0").select(key, "delta")


def restarted(jobs: DataFrame) -> DataFrame:
    """Job states after a restart: what was running has failed."""
    return jobs.withColumn("state", F.when(F.col("state") == "transcribing", "failed").otherwise(F.col("state")))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user in a stream or table; a stream keeps state until ``late`` after
    the newest event. Zone-less times are read as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    s = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_decisions(decisions: DataFrame, key: str = "person_id", late: str | None = None) -> DataFrame:
    """Decisions without repeats of a person's; in a stream within the watermark."""
    if decisions.isStreaming and late:
        return decisions.withWatermark("at", late).dropDuplicatesWithinWatermark([key])
    return decisions.dropDuplicates([key])
