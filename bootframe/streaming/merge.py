"""Merge per-scale result files as they arrive (Structured Streaming file source).

The reference starts one process per scale, waits for all of them, then
row-binds their CSV files. As a stream, each file that lands in ``in_dir`` is
appended to ``out_dir`` exactly once (the checkpoint records what was read),
so the merge needs no barrier. Progress lies in the shared checkpoint folder under a
name made of both full paths, so a restart finds it; an output that already has a
stream's log is not continued with an empty checkpoint, as files would be skipped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from bootframe.session import ensure_checkpoint_dir
from bootframe.sources.paths import exists, join, qualified

#: schema of a per-scale Cohen's d result file (reference column names)
SCALE_RESULT_SCHEMA = T.StructType(
    [
        T.StructField("scale", T.StringType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("ci.level", T.DoubleType()),
        T.StructField("ci.ll", T.DoubleType()),
        T.StructField("ci.ul", T.DoubleType()),
    ]
)


def merge_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    schema: T.StructType = SCALE_RESULT_SCHEMA,
    checkpoint: str | None = None,
    pattern: str = "*.csv",
    once: bool = True,
):
    """Append every result CSV under ``in_dir/<pattern>`` to the CSV sink ``out_dir``.

    ``once=True`` processes what is there now (``availableNow``) and returns the
    finished query; otherwise the query keeps running and is returned. The files'
    headers must name the schema's columns in its order.
    """
    mark = hashlib.sha256(f"{qualified(spark, in_dir)}\n{qualified(spark, out_dir)}\n{pattern}".encode()).hexdigest()[:32]
    ckpt = checkpoint or join(ensure_checkpoint_dir(spark), f"merge_stream/{mark}")
    if exists(spark, join(out_dir, "_spark_metadata")) and not exists(spark, join(ckpt, "offsets")):
        raise ValueError(f"{out_dir} holds the output of a stream whose progress is not in {ckpt}")
    stream = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .csv(in_dir)
    )
    writer = (
        stream.writeStream.format("csv")
        .option("header", True)
        .option("path", out_dir)
        .option("checkpointLocation", ckpt)
        .outputMode("append")
    )
    if once:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.start()
