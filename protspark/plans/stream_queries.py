"""Streaming forms, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from protspark.functions.lineage import shared_folder
from protspark.operators import drift, upserts
from protspark.plans import graph_tables
from protspark.plans.drift_queries import EDGES, bin_sql
from protspark.plans.registry import ORACLES, query, r6, table
from protspark.streaming import ingest, monitor, store


@query("str01_ingest_stream", """
    SELECT 'Ligand:' || user_id AS id, arg_max(event_type, event_id) AS name, CAST(arg_max(event_id, event_id) AS VARCHAR) AS source FROM events GROUP BY user_id""")
def ingest_stream(spark, sf):
    """Events arrive in several files; the last event of a user wins, whatever file came last."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("ligand_id"), F.col("event_type").alias("name"), F.col("event_id").alias("source"), F.col("event_id").alias("ord"))
    files, log, state = (shared_folder(spark, n) for n in ("arrivals", "log", "offsets"))
    e.repartition(3, "name").write.option("header", True).csv(files)
    stream = ingest.entity_stream(spark, files, "ligand_id string, name string, source string, ord long", files_per_batch=1)
    ingest.ingest_stream(stream, log, state).awaitTermination()
    nodes = ingest.fold_log(spark, log, lambda rows: upserts.upsert_nodes(upserts.empty_nodes(spark), rows, "Ligand"))
    return nodes.select("id", F.col("props")["name"].alias("name"), F.col("props")["source"].alias("source"))


@query("str01_merge_stream", """
    SELECT 'Ligand:' || user_id AS id, arg_max(event_type, event_id) AS name, CAST(arg_max(event_id, event_id) AS VARCHAR) AS source FROM events GROUP BY user_id""")
def merge_stream(spark, sf):
    """The same feed merged into a store, one file per trigger, with a restart after the second file."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("ligand_id"), F.col("event_type").alias("name"), F.col("event_id").alias("source"), F.col("event_id").alias("ord"))
    files, state = shared_folder(spark, "arrivals"), shared_folder(spark, "offsets")
    graph = store.GraphStore(spark, shared_folder(spark, "graph"), buckets=4, fanout=2)
    arrived = F.pmod(F.xxhash64("name"), F.lit(4)) < 2
    for part in (e.where(arrived), e.where(~arrived)):
        part.repartition(2, "name").write.mode("append").option("header", True).csv(files)
        stream = ingest.entity_stream(spark, files, "ligand_id string, name string, source string, ord long", files_per_batch=1)
        store.merge_stream(stream, graph, lambda rows: upserts.node_changes(rows, "Ligand"), state).awaitTermination()
    return graph.nodes().select("id", F.col("props")["name"].alias("name"), F.col("props")["source"].alias("source"))


@query("str01_merge_assays", ORACLES["ups03_upsert_assays"])
def merge_assays(spark, sf):
    """Assays arrive before the proteins and ligands they need; the graph is that of one upsert over all."""
    graph = store.GraphStore(spark, shared_folder(spark, "graph"), buckets=4, fanout=2)
    batch = graph_tables.assay_batch(spark, sf)
    for k in range(3):
        graph.append(*upserts.assay_changes(batch.where(F.pmod("ord", F.lit(3)) == 2 - k)), k, "assays")
    graph.append(*upserts.node_changes(graph_tables.proteins(spark, sf), "Protein"), 0, "targets")
    graph.append(*upserts.node_changes(graph_tables.ligands(spark, sf), "Ligand"), 0, "ligands")
    return graph.edges().select("type", "src", "dst", graph_tables.prop("metric"), F.col("props")["value"].cast("double").alias("value"))


BINS = len(EDGES) - 1


@query("str02_monitor_stream", f"""
    WITH b AS (SELECT date_trunc('day', ts) AS day, {bin_sql('value', EDGES)} AS bin FROM events), base AS (SELECT bin, count(*) / (SELECT count(bin) FROM b) AS p FROM b WHERE bin IS NOT NULL GROUP BY 1),
    days AS (SELECT day, count(bin) AS n FROM b GROUP BY 1), c AS (SELECT day, bin, count(*) AS c FROM b GROUP BY 1, 2),
    t AS (SELECT days.day, days.n, least(greatest(base.p, 1e-6), 1.0) AS p, least(greatest(coalesce(c.c / days.n, 0), 1e-6), 1.0) AS q FROM days CROSS JOIN base LEFT JOIN c ON c.day = days.day AND c.bin = base.bin)
    SELECT strftime(day, '%Y-%m-%d') AS day, any_value(n) AS n, round(sum((p - q) * ln(p / q)), 6) + 0.0 AS psi FROM t WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""")
def monitor_stream(spark, sf):
    """PSI per closed day against the proportions of the whole table."""
    e = table(spark, sf, "events").select("ts", "value")
    props = [r["p"] for r in drift.hist_props(e, "value", EDGES).orderBy("bin").collect()]  # one row per bin
    files, out, state = (shared_folder(spark, n) for n in ("scores", "report", "offsets"))
    e.write.parquet(files)
    stream = spark.readStream.schema(e.schema).parquet(files)
    monitor.start_monitor(monitor.monitor_stream(stream, "ts", "value", EDGES, props), out, state).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", r6("psi").alias("psi"))
