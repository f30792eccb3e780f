"""The rows of a report that grow with the data: lines of JSON written by tasks, and an index of their files.

A report over many agents holds its summaries, and names a folder with the rest. Rows are dealt by
ranges of their order, so files follow one another, and a scenario with very many agents takes
several. The index has a row for each file: that is all that the driver reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rows: DataFrame, order: tuple[str, ...], folder: str) -> dict:
    """Writes rows into a new folder, and returns its name and its index: each file's first and last key, and its rows. A folder that is there is an error."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", "false").json(folder)
    key = F.struct(*order)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    found = rows.sparkSession.read.schema(rows.schema).json(folder).groupBy(name.alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
    index = sorted((r.asDict(recursive=True) for r in found.collect()), key=lambda r: tuple(r["first"].values()))
    return {"folder": folder, "rows": sum(r["rows"] for r in index), "files": index}


def read(spark: SparkSession, parts: dict, schema: str) -> DataFrame:
    """The rows of a folder that a report names; an error where they aren't as many as it says."""
    found = spark.read.schema(schema).json(parts["folder"])
    if (n := found.count()) != parts["rows"]:
        raise ValueError(f"{parts['folder']} has {n} rows; its report says {parts['rows']}")
    return found
