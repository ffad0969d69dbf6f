"""Run states kept up to date while events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coterie.operators.runs import RUN_EVENTS_SCHEMA, listing, run_folds

KEYS = ["user", "label"]


def run_event_stream(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Events as they are appended to the run ledger."""
    return spark.readStream.schema(RUN_EVENTS_SCHEMA).parquet(ledger_path)


def watch_runs(events: DataFrame) -> DataFrame:
    """The results listing as a stream, for an ``update`` sink: the labels a batch of
    events touched, with ``alive``, false for a label that was deleted.

    The state is one row per label that ever had an event.
    """
    return listing(run_folds(events))


def keep_listing(events: DataFrame, path: str, checkpoint: str) -> int | None:
    """Brings the listing below ``path`` up to date with all events so far.

    Each batch replaces the labels it touched and writes a folder named by its number;
    the two newest folders are kept, so a reader of the last one is not disturbed.
    Returns the number of the last batch, or None when there were no new events. A batch
    that is repeated after a failure replaces its own folder.
    """
    spark = events.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    written = []

    def folders() -> list[int]:
        if not system.exists(root):
            return []
        names = [entry.getPath().getName() for entry in system.listStatus(root)]
        return sorted(int(name) for name in names if name.isdigit())

    def write(batch: DataFrame, number: int) -> None:
        # read twice below, so the state is asked for its changes only once
        changes = f"{path}/_changes"
        batch.write.mode("overwrite").parquet(changes)
        batch = spark.read.schema(batch.schema).parquet(changes)
        new = batch.filter("alive").drop("alive")
        older = [k for k in folders() if k < number]
        if older:
            before = spark.read.schema(new.schema).parquet(f"{path}/{older[-1]}")
            new = before.join(batch.select(*KEYS), KEYS, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        written.append(number)
        for old in older[:-1]:
            system.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)

    query = (
        watch_runs(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return written[-1] if written else None
