"""Runs over a cohort's files that process what is new, and only that.

A stream over the folder tells which files have come; each file with its parameters is one unit of work, whose tables are
written under a name made of both and marked when they are whole. A run that is killed begins again with the batch it
was in, and skips the units of it that were marked; changed parameters are units of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtally.sources.files import read_marker, write_marker


def unit(file: str, parameters: dict) -> str:
    """The name of a file's results: its stem and a digest of path and parameters."""
    stem = re.sub(r"\W+", "_", file.rsplit("/", 1)[-1].split(".")[0])
    return f"{stem}-{hashlib.sha256(json.dumps([file, parameters], sort_keys=True).encode()).hexdigest()[:16]}"


def process_new(spark: SparkSession, folder: str, out: str, parameters: dict, work: Callable[[str], dict[str, DataFrame]], pattern: str = "*", at_once: int = 16) -> list[str]:
    """Run ``work(file)`` for each file of ``folder`` that has no results with these parameters yet; the files it ran for.

    ``work`` returns tables by name, which are written to ``out/<unit>/<name>``. Files are told apart by path; their content is
    not read here. The driver sees up to ``at_once`` paths at a time.
    """
    done: list[str] = []
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]

    def run(batch: DataFrame, _number: int) -> None:
        for r in batch.select("path").orderBy("path").collect():
            name = unit(r["path"], parameters)
            if read_marker(spark, f"{out}/{name}.done") is not None:
                continue
            for table, rows in work(r["path"]).items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/{table}")
            write_marker(spark, f"{out}/{name}.done", {"file": r["path"], "parameters": parameters})
            done.append(r["path"])

    listing = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder).select("path")
    stream = listing.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/_seen/{key}").trigger(availableNow=True).start()
    stream.awaitTermination()
    return done


def results(spark: SparkSession, out: str, table: str, parameters: dict | None = None) -> DataFrame:
    """A table of all finished units with ``file``, of those with the given parameters if any are named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path) if f.getPath().getName().endswith(".done")]
    made = None
    for name in sorted(names):  # a line for each unit
        meta = read_marker(spark, f"{out}/{name}")
        if not meta or (parameters is not None and meta["parameters"] != json.loads(json.dumps(parameters))):
            continue
        rows = spark.read.parquet(f"{out}/{name.removesuffix('.done')}/{table}").withColumn("file", F.lit(meta["file"]))
        made = rows if made is None else made.unionByName(rows, allowMissingColumns=True)
    if made is None:
        raise FileNotFoundError(f"no finished {table} under {out}")
    return made
