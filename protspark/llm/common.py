"""Small helpers shared by the operators of this subpackage.

Conventions. A null text counts as empty where a contract does not say otherwise. A null ``doc_id`` counts as
one id below all others and is given back as null. Only the named input columns are read, so extra columns with
any name do no harm. Rows that are equal in id and text get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from inspect import isgenerator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from protspark.functions.lineage import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(name: str = "doc_id") -> Column:
    """The id as a sortable, joinable key: null is the lowest long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LOWEST))


def id_of(name: str) -> Column:
    """Back from ``key_of``."""
    return F.when(F.col(name) != LOWEST, F.col(name))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like a checkpoint, but as compressed columns: for tables with texts. Deleted when the session's JVM ends."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable], rows: int = 512) -> DataFrame:
    """Apply ``start()(*columns)`` to slices of at most ``rows`` rows; lists in, lists (or arrays) out.

    ``start`` runs once a task, so caches live as long as the task. A step that returns None gives no rows. If the
    step has ``finish``, it is called after the last slice. A step that makes very many rows of a slice is a generator of parts.
    """
    fields = to_arrow_schema(DataType.fromDDL(schema))

    def made(out) -> Iterator[pa.RecordBatch]:
        for part in out if isgenerator(out) else [out]:
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(part, fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for b in batches:
            for k in range(0, b.num_rows, rows):
                yield from made(step(*[c.to_pylist() for c in b.slice(k, rows).columns]))
        if hasattr(step, "finish"):
            yield from made(step.finish())

    return df.mapInArrow(run, schema)


def id_remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod``; null counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")
