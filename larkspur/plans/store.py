"""Tables kept in the shared folder, to end a lineage that grows with each step of a loop."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir, or where none is set and all runs in one process (as in tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return jsc.getCheckpointDir().get().rstrip("/")


#: Rows of a file of a table whose number of rows is known to be small.
FILE_ROWS = 200_000


def kept(df: DataFrame, label: str = "table", rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """df as a Parquet table that was written once. rows: a bound on its rows, if known, which few files then hold instead of one for each partition."""
    if rows is not None:
        df = df.coalesce(min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // file_rows + 1))
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    # nobody waits for the mark of success, and on some stores each small file costs a process
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
