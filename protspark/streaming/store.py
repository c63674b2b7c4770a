"""A property graph that grows batch by batch, kept as immutable segments.

A trigger writes one segment: its own node cells (one per node and property) and edges, reduced to the last one per key by
``ord``. Nothing stored is read or rewritten, so the work of a trigger follows its batch. After every ``fanout`` segments of a
level these are merged into one of the next level, so a row is rewritten once per level and few segments are alive. The
current graph is the last cell per property and the last edge per key over the living segments.

The larger ``ord`` wins whenever a row arrives, and a removed property keeps its place in the order, so late files,
repeats and the order of arrival do not change the result. Rows that need other nodes (an assay its protein and ligand) wait
in the store and count as soon as those exist. Segments are named after their batches and written anew when a batch is
repeated, so a restart adds nothing. Every segment is laid out in ``buckets`` folders by the hash of the id (edges: of the
source), by which a look-up of some ids reads their buckets only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from protspark.operators.upserts import _no_props

CELLS = "id string, k string, label string, need array<string>, ord bigint, v string, bucket int"
LINKS = "src string, dst string, type string, need array<string>, ord bigint, props map<string,string>, bucket int"


def _last_cells(cells: DataFrame) -> DataFrame:
    """The last value per (node, property, needed nodes); a null value stays as a mark that the property is gone."""
    last = cells.groupBy("id", "k", "need").agg(F.max(F.struct("ord", "v")).alias("_c"), F.max("label").alias("label"))
    return last.select("id", "k", "label", "need", "_c.ord", "_c.v")


def _last_links(links: DataFrame) -> DataFrame:
    """The last properties per (edge, needed nodes); rows without properties make the edge and leave them."""
    given = F.when(F.col("props").isNotNull(), F.col("ord"))
    return links.groupBy("src", "dst", "type", "need").agg(F.max(given).alias("ord"), F.max_by("props", given).alias("props"))


class GraphStore:
    """Segments below ``folder``, one family of them per feed (a feed numbers its batches from 0)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, fanout: int = 8) -> None:
        self.spark, self.folder, self.buckets, self.fanout = spark, folder.rstrip("/"), buckets, fanout

    # -- files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _segment(self, feed: str, level: int, part: int) -> str:
        return f"{self.folder}/feed={feed}/level={level}/part={part:012d}"

    def _complete(self, segment: str) -> bool:
        path, fs = self._path(f"{segment}/links/_SUCCESS")  # written last
        return fs.exists(path)

    def segments(self) -> list[str]:
        """The living segments: the merged ones, and those that no complete merged one covers."""
        out = []
        for feed in (n.removeprefix("feed=") for n in self._names(self.folder) if n.startswith("feed=")):
            covered: list[tuple[int, int]] = []
            levels = sorted((int(n.removeprefix("level=")) for n in self._names(f"{self.folder}/feed={feed}")), reverse=True)
            for level in levels:
                span = self.fanout**level
                for part in (int(n.removeprefix("part=")) for n in self._names(f"{self.folder}/feed={feed}/level={level}")):
                    first, last = part * span, (part + 1) * span
                    if not any(a <= first and last <= b for a, b in covered) and self._complete(self._segment(feed, level, part)):
                        covered.append((first, last))
                        out.append(self._segment(feed, level, part))
        return out

    def _write(self, segment: str, cells: DataFrame, links: DataFrame) -> None:
        for name, df, key in (("cells", cells, "id"), ("links", links, "src")):
            # By bucket and id: a bucket of a large batch is written by many tasks, small batches are merged by adaptive execution.
            (df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")).repartition("bucket", key)
             .write.mode("overwrite").partitionBy("bucket").parquet(f"{segment}/{name}"))

    def _read(self, segments: list[str], name: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for s in segments:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{s}/{name}"))
        return out

    # -- writing

    def append(self, rows: DataFrame, links: DataFrame, batch_id: int, feed: str = "main") -> None:
        """Write a batch's changes (``upserts.*_changes``) as a segment and merge levels that are full."""
        cells = rows.select("id", "label", "ord", "need", F.explode("row").alias("k", "v"))
        self._write(self._segment(feed, 0, batch_id), _last_cells(cells), _last_links(links))
        level, n = 0, batch_id + 1
        while n % self.fanout == 0:
            parts = [self._segment(feed, level, k) for k in range(n - self.fanout, n)]
            level, n = level + 1, n // self.fanout
            parts = [p for p in parts if self._complete(p)]
            self._write(self._segment(feed, level, n - 1), _last_cells(self._read(parts, "cells", CELLS)), _last_links(self._read(parts, "links", LINKS)))

    # -- reading

    def _of(self, df: DataFrame, key: str, ids: list[str] | None) -> DataFrame:
        if ids is None:
            return df
        wanted = self.spark.createDataFrame([(i,) for i in ids], "_i string")
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("_i"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return df.where(F.col("bucket").isin(buckets)).join(wanted, F.col(key) == F.col("_i"), "left_semi")

    def _counting(self, df: DataFrame) -> DataFrame:
        """Rows whose needed nodes exist. Needed nodes need none themselves; a row needs two at most."""
        cells = self._read(self.segments(), "cells", CELLS)
        present = cells.where(F.size("need") == 0).select(F.col("id").alias("_id")).distinct()
        # Inner joins with distinct ids: semi joins would be pushed below the union of the segments, and a task would sort all of them at once.
        met: Callable[[DataFrame, Column], DataFrame] = lambda d, c: d.join(present, c == F.col("_id")).drop("_id")
        waiting = df.where(F.size("need") > 0)
        return df.where(F.size("need") == 0).unionByName(met(met(waiting, F.get("need", F.lit(0))), F.get("need", F.size("need") - 1)))

    def nodes(self, ids: list[str] | None = None) -> DataFrame:
        """(id, labels, props) now, of all nodes or of some."""
        cells = self._counting(self._of(self._read(self.segments(), "cells", CELLS), "id", ids))
        last = cells.repartition("id").groupBy("id", "k").agg(F.max(F.struct("ord", "v")).alias("_c"), F.max("label").alias("label"))
        entry = F.when(F.col("_c.v").isNotNull(), F.struct("k", F.col("_c.v").alias("v")))
        whole = last.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_list(entry)).alias("_e"))
        return whole.select("id", "labels", F.map_from_entries("_e").alias("props"))

    def edges(self, sources: list[str] | None = None) -> DataFrame:
        """(src, dst, type, props) now, of all sources or of some."""
        links = self._counting(self._of(self._read(self.segments(), "links", LINKS), "src", sources))
        last = links.groupBy("src", "dst", "type").agg(F.max_by("props", "ord").alias("props"))
        return last.withColumn("props", F.coalesce("props", _no_props()))


def merge_stream(stream: DataFrame, store: GraphStore, changes: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str,
                 feed: str = "main", available_now: bool = True) -> StreamingQuery:
    """Start the query that merges each micro-batch of a feed into the store."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # nodes and edges are both made from it
        store.append(*changes(kept), batch_id, feed)
        kept.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
