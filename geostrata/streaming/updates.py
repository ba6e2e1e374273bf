"""The ordered log of change files, as a batch loop and as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.operators import update
from geostrata.sources.files import Manifest

SCHEMA = "seq long, elem_type int, id long, changetype int, version long, timestamp long, pos long"


def apply_pending(states: list[int], manifest: Manifest, plan: Callable[[int], int], end_date: Callable[[int], str], most: int | None = None, demo: bool = False, save: Callable[[Manifest], None] | None = None) -> list[int]:
    """T1, T3. Plan each pending state in order, so that each sees those before it; plan(state) writes its tiles and
    returns how many. A state at or before the last one is never read again; save gets the manifest after each, so a
    state that fails forgets none before it. demo leaves the manifest alone."""
    done = []
    for state in sorted(s for s in states if s > manifest.last_state)[:most]:
        n = plan(state)
        if not demo:
            manifest.append(f"{state}.parquet", end_date(state), n, state)
            if save:
                save(manifest)
        done.append(state)
    return done


def stream_latest(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 16):
    """Change files as they arrive in folder (parquet of SCHEMA): the latest versions of each in a micro-batch, in a folder
    of that batch. Files of one state may come in many batches: current() settles them. A batch that runs again
    overwrites its own folder, so every row is applied once. Returns the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        update.latest(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, base: DataFrame) -> DataFrame:
    """T2. The newest row of each element over base (elem_type, id, changetype, version, timestamp) and what the stream wrote."""
    from geostrata.operators import merge

    columns = ["elem_type", "id", "changetype", "version", "timestamp", "seq"]
    later = update.latest(spark.read.schema(SCHEMA).parquet(target)).select(*columns)
    return merge.apply_changes(base.withColumn("seq", F.lit(0).cast("long")).select(*columns), later, ["elem_type", "id"])
