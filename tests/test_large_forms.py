"""Forms for large inputs against plain Python: alignment by halves, letter pairs by tiles, splits by digit counts, names, stores."""

import os
import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from support import rows
from test_geometry import brute_score, path_score
from protspark.operators import alignments as A
from protspark.operators import profiles as P
from protspark.operators import splits as S
from protspark.operators import topk as T
from protspark.operators import upserts as U
from protspark.streaming.ingest import entity_stream
from protspark.streaming.store import GraphStore, merge_stream


@pytest.mark.parametrize("cells", [8, 40])
def test_alignment_by_halves_is_optimal(cells, monkeypatch):
    monkeypatch.setattr(A, "CELLS", cells)
    rnd = random.Random(cells)
    for _ in range(120):
        q, t = ("".join(rnd.choice("ACD") for _ in range(rnd.randrange(0, 20))) for _ in "qt")
        for name, scheme in A.SCHEMES.items():
            a, b, score = A._align(q, t, scheme)
            assert a.replace("-", "") == q and b.replace("-", "") == t
            assert abs(score - brute_score(q, t, name)) < 1e-6 and abs(path_score(a, b, name) - score) < 1e-6


def test_long_alignment_in_little_memory():
    rnd = random.Random(3)
    q = "".join(rnd.choice("ACDEFGHIKL") for _ in range(4_000))
    t = q[:1_000] + "".join(rnd.choice("ACDE") for _ in range(300)) + q[1_200:]
    tracemalloc.start()
    a, b, score = A._align(q, t, A.SCHEMES["canonical"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert a.replace("-", "") == q and b.replace("-", "") == t and abs(path_score(a, b, "canonical") - score) < 1e-6
    assert peak < 60e6  # three whole tables would take 390 MB


def test_letter_pairs_by_tiles(spark):
    rnd = random.Random(4)
    data = [(m, r, "".join(rnd.choice("ACXY-é") for _ in range(8 if r % 5 else rnd.randrange(0, 11)))) for m in ("m1", "m2", None) for r in range(25)]
    want = Counter()
    for m, _, s in data:
        for a in range(len(s)):
            for b in range(a + 1, len(s)):
                if m and s[a] in P.LETTERS and s[b] in P.LETTERS:
                    want[m, a, b, s[a], s[b]] += 1
    df = spark.createDataFrame(data, "msa_id string, row_id long, seq string")
    got = P.letter_pairs(df, 3, 7).groupBy("msa_id", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")).collect()
    assert {tuple(r)[:5]: r.n for r in got} == dict(want)
    assert P.letter_pairs(df.where("false")).collect() == []
    mi = [{tuple(r)[:3]: r.mi for r in P.column_mi(df, 1, None, 3, n).collect()} for n in (7, 1_000)]
    assert mi[0].keys() == mi[1].keys() == {k[:3] for k in want} and all(abs(mi[0][k] - mi[1][k]) < 1e-9 for k in mi[0])


def test_shallow_alignments_have_a_reason(spark):
    df = spark.createDataFrame([("a", k, "AC") for k in range(12)] + [("b", 1, "ACD")] + [("c", k, "ACDEF") for k in range(11)], "msa_id string, row_id long, seq string")
    assert rows(P.mi_inputs(df, max_len=4)) == [("a", 12, 2, None), ("b", 1, 3, "shallow"), ("c", 11, 5, "wide")]
    assert {r.msa_id for r in P.column_mi(df, max_len=4).collect()} == {"a"}


def _hash_order(spark, df, key):
    return [r[0] for r in df.withColumn("_h", S.shuffle_key(key)).orderBy("_h", key).collect()]


def test_splits_by_digits_equal_a_sort(spark, monkeypatch):
    monkeypatch.setattr(S, "PREFIX", 1)
    monkeypatch.setattr(S, "FEW", 2)
    df = spark.range(300).withColumnRenamed("id", "k").repartition(7)
    order = _hash_order(spark, df, "k")
    place = {k: i + 1 for i, k in enumerate(order)}
    assert {r.k: r.split for r in S.split_exact(df, "k", 0.2).collect()} == {k: "val" if p <= 60 else "train" for k, p in place.items()}
    assert {r.k: r.split for r in S.split_three(df, "k").collect()} == {k: "train" if p <= 210 else "val" if p <= 255 else "test" for k, p in place.items()}
    assert {r.k: r.split for r in S.split_fraction(df, "k", 0.5, cap=100).collect()} == {k: "train" if p <= 50 else "val" for k, p in place.items() if p <= 100}
    assert {r.k: r.fold for r in S.kfold(df, "k", 4, bucket_rows=10).collect()} == {k: (p - 1) % 4 for k, p in place.items()}


def test_splits_of_repeated_keys_are_exact(spark):
    df = spark.createDataFrame([(7, f"r{k}") for k in range(90)] + [(8, "x")] + [(None, "n")] * 9, "k long, v string")
    got = S.split_exact(df, "k", 0.25)
    assert got.groupBy("split").count().collect() and {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"val": 25, "train": 75}
    assert rows(got.select(F.coalesce("k", F.lit(0)), "v", "split")) == rows(S.split_exact(df.repartition(5), "k", 0.25).select(F.coalesce("k", F.lit(0)), "v", "split"))
    assert S.split_exact(df.where("false"), "k").columns == ["k", "v", "split"] and S.split_exact(df.where("false"), "k").count() == 0
    assert S.kfold(df.where("false"), "k").count() == 0


def test_free_numbers_skip_taken_ones(spark):
    rnd = random.Random(6)
    names = ["a"] * 30 + ["b"] * 6 + [f"a_{rnd.randrange(0, 40)}" for _ in range(20)] + ["b_3", "b_2", "a_02", "c", "x_1", None, None]
    rnd.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "ord long, name string")
    taken = {n for n in names if n}
    want, seen, free = {}, Counter(), {}
    for k, n in enumerate(names):
        if n is None:
            want[k] = None
            continue
        seen[n] += 1
        if seen[n] == 1:
            want[k] = n
            continue
        numbers = {int(x.rpartition("_")[2]) for x in taken if x.rpartition("_")[0] == n and x.rpartition("_")[2].isdigit()}
        i = free.get(n, 2)
        while i in numbers:
            i += 1
        want[k], free[n] = f"{n}_{i}", i + 1
    assert {r.ord: r.unique_name for r in T.uniquify_names(df).collect()} == want


def test_free_numbers_of_a_hot_name(spark, small_groups):
    df = spark.createDataFrame([(k, "a") for k in range(40)] + [(100 + k, f"a_{2 * k}") for k in range(1, 30)], "ord long, name string")
    got = [r.unique_name for r in T.uniquify_names(df).orderBy("ord").collect()][:40]
    assert got == ["a", *[f"a_{2 * k + 1}" for k in range(1, 30)], *[f"a_{k}" for k in range(60, 70)]]


def test_store_equals_one_upsert(spark, tmp_path):
    schema = "ligand_id string, name string, smiles string, ord long"
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    os.makedirs(arrivals)
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=3, fanout=2)
    rnd = random.Random(7)
    data = [(f"L{rnd.randrange(9)}", f"n{k}", rnd.choice(["", "CC", "O"]), k) for k in range(60)]
    rnd.shuffle(data)  # files carry old and new rows in any order
    feed = lambda: merge_stream(entity_stream(spark, arrivals, schema, 1), store, lambda b: U.node_changes(b, "Ligand"), state).awaitTermination()
    for k in range(5):
        (tmp_path / "in" / f"{k}.csv").write_text("ligand_id,name,smiles,ord\n" + "".join(",".join(map(str, r)) + "\n" for r in data[k::5]))
        if k != 1:  # two files wait for one start
            feed()
    feed()  # a restart without news
    want = U.upsert_nodes(U.empty_nodes(spark), spark.createDataFrame(data, schema), "Ligand")
    key = lambda df: sorted((r.id, r.labels, sorted(r.props.items())) for r in df.collect())
    assert key(store.nodes()) == key(want)
    assert key(store.nodes(["Ligand:L1", "Ligand:none"])) == [x for x in key(want) if x[0] == "Ligand:L1"]
    assert len(store.segments()) == 2  # five batches: one of four, one of one


def test_store_waits_for_partners_and_repeats_add_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"), buckets=2, fanout=2)
    assays = spark.createDataFrame([(f"a{k}", f"L{k % 3}", f"P{k % 4}", "Ki", str(k), k) for k in range(24)], "assay_id string, ligand_id string, uniprot_id string, metric string, value string, ord long")
    tox = spark.createDataFrame([("t", "L1", "bad", 3), ("u", "L7", "bad", 4)], "tox_id string, ligand_id string, flag string, ord long")
    ligands = spark.createDataFrame([("L0", 0), ("L1", 1)], "ligand_id string, ord long")
    proteins = spark.createDataFrame([("P1", "k", 0), ("P2", "k", 1), ("P1", None, 9)], "uniprot_id string, name string, ord long")
    for k in range(3):
        store.append(*U.assay_changes(assays.where(f"ord % 3 = {2 - k}")), k, "assays")
    assert store.nodes().count() == 0 and store.edges().count() == 0
    store.append(*U.toxicity_changes(tox), 0, "tox")
    store.append(*U.node_changes(ligands, "Ligand"), 0, "ligands")
    store.append(*U.node_changes(proteins, "Protein"), 0, "proteins")
    store.append(*U.assay_changes(assays.where("ord % 3 = 0")), 2, "assays")  # the last trigger again
    nodes = U.upsert_nodes(U.upsert_nodes(U.empty_nodes(spark), ligands, "Ligand"), proteins, "Protein")
    nodes, edges = U.upsert_assays(nodes, U.empty_edges(spark), assays)
    nodes, edges = U.upsert_toxicity(nodes, edges, tox)
    key = lambda df: sorted((r.id, r.labels, sorted(r.props.items())) for r in df.collect())
    ekey = lambda df: sorted((r.src, r.dst, r.type, sorted(r.props.items())) for r in df.collect())
    assert key(store.nodes()) == key(nodes) and ekey(store.edges()) == ekey(edges)
    assert ekey(store.edges(["Ligand:L1"])) == [e for e in ekey(edges) if e[0] == "Ligand:L1"]


def test_a_node_without_properties_keeps_its_labels(spark):
    old = spark.createDataFrame([("Protein:P1", ["Antibody", "Protein"], {})], "id string, labels array<string>, props map<string,string>")
    out = U.upsert_nodes(old, spark.createDataFrame([("P1", "n", 0)], "uniprot_id string, name string, ord long"), "Protein").collect()
    assert [(r.labels, r.props) for r in out] == [(["Antibody", "Protein"], {"uniprot_id": "P1", "name": "n"})]
