"""Mapping, scaffolds, reports, command line, streaming, and the driver's entry."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linkmap.operators import mapping, report, scaffold
from linkmap.plans import catalogue, cli, pipelines
from linkmap.streaming import ingest
from linkmap.types import BackboneParams, MoleculeParams, ScaffoldParams


def test_index_levels(spark):
    paths = spark.createDataFrame([(0, 0, "b"), (0, 1, "b_0"), (0, 2, "b_0_1"), (0, 3, "none_1"), (0, 4, "e_1")], "tid long, tpos long, mol string")
    inc = spark.createDataFrame([("b", 1), ("b_0", 2), ("e_1", None), ("e", 5)], "bx string, mx long")
    assert {tuple(r) for r in mapping.backbone_index(paths, inc).collect()} == {(1, 0, 0), (2, 0, 1), (2, 0, 2)}


def test_scaffolds(spark):
    c = spark.createDataFrame([("a", "AAAA"), ("b", "CCCC"), ("z", "GG"), ("y", "AC")], "name string, seq string")
    p = spark.createDataFrame([(0, 0, "a", "+"), (0, 1, "b", "+"), (1, 0, "y", "-"), (2, 0, "z", "."), (1, 1, "unknown", "+")], "tid long, ord long, name string, orientation string")
    got = [(r.name, r.seq) for r in scaffold.scaffolds(c, p, ScaffoldParams(gap=3)).orderBy("id").collect()]
    assert got == [("0000000 LN:i:11 xn:i:2", "AAAANNNCCCC"), ("0000001 LN:i:2 xn:i:1", "GT"), ("0000002 LN:i:2 xn:i:1", "GG")]
    assert scaffold.scaffolds(c.limit(0), p.limit(0)).count() == 0 and scaffold.scaffolds(c, p, ScaffoldParams(gap=3, min_length=4)).count() == 1


def test_nx(spark):
    x = lambda v: spark.createDataFrame([(n,) for n in v], "length long")
    assert (scaffold.length_metrics(x([30, 20, 10])).first().n50, scaffold.length_metrics(x([])).first().n50) == (30, 0)
    m = scaffold.length_metrics(x([300, 200, 100]), 1000).first()
    assert (m.ng50, m.l50) == (200, 1) and scaffold.length_metrics(x([10, 10, 10, 10])).first().l75 == 3
    assert scaffold.nx(x([50, 40, 30, 20, 10]), {"n90": F.floor(0.9 * F.col("total"))}).first().n90 == 20


def test_reports(spark):
    p = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "tid long, tpos long, mol string")
    assert '"a" -- "b"' in report.backbone_dot(p) and "cluster_1" not in report.backbone_dot(p) and report.backbone_svg(p).count("<rect") == 2
    m = scaffold.path_metrics(p)
    assert "NG50" not in report.metrics_tsv(m) and json.loads(report.metrics_json(m, m))["physical_map"]["ng50"] is None
    assert "%" in report.html_report(m, m) and json.loads(report.merge_json({"x": "a\t1\n"})) == {"x": {"a": "1"}}


SMALL = "/root/testdata/sf0.001"


def test_pipeline_recovers_the_order_of_tiles(spark):
    from linkmap.plans import fixtures as X

    p = pipelines.MapParams(min_m=10, molecules=MoleculeParams(strategy="cc"), backbone=BackboneParams(1, 0, 0, 5))
    from linkmap.operators import ego, molecules, overlap

    e = overlap.overlap_edges(X.tiles(spark, SMALL), 10)
    _, mol = molecules.molecule_graph(overlap.overlap_vertices(X.tiles(spark, SMALL)), e, ego.assign_molecules(e, p.molecules))
    from linkmap.operators.backbone import backbones

    names = [r.mol for r in backbones(mol, p.backbone).orderBy("tid", "tpos").collect()]
    order = [int(n[1:5]) for n in names]
    assert len(order) > 380 and order in (sorted(order), sorted(order, reverse=True))


def test_command_line_knows_all_commands(spark, tmp_path, capsys):
    assert len(cli.COMMANDS) == 22
    mx = tmp_path / "m.tsv"
    mx.write_text("".join(f"b{i:02}\t{' '.join(map(str, range(i, i + 8)))}\n" for i in range(30)))
    run = lambda *a: cli.main([*map(str, a)], spark)
    run("filter-minimizers", mx, "--min-n", 2, "--max-n", 100, "--max-df", 100, "--out", tmp_path / "f")
    run("overlap", tmp_path / "f", "--min-m", 2, "--out", tmp_path / "o")
    run("filter-overlap", tmp_path / "o", "--percentile", 5, "--out", tmp_path / "p")
    run("molecules", tmp_path / "p", "--out", tmp_path / "mol", "--strategy", "cc")
    run("split-minimizers", tmp_path / "mol", "--sets", mx, "--out", tmp_path / "s")
    run("backbone", tmp_path / "mol", "--branch", 1, "--bridge", 0, "--min-path", 5, "--out", tmp_path / "b")
    run("map", "--query", mx, "--paths", tmp_path / "b", "--sets", tmp_path / "s", "--min-score", 3, "--out", tmp_path / "bed")
    run("map-paf", "--query", mx, "--paths", tmp_path / "b", "--sets", tmp_path / "s", "--min-score", 3, "--out", tmp_path / "paf")
    run("bed-to-path", tmp_path / "bed", "--min-score", 3, "--out", tmp_path / "cp")
    run("path-metrics", tmp_path / "b")
    run("backbone-dot", tmp_path / "b")
    out = capsys.readouterr().out
    assert "N50" in out and "graph backbone" in out
    assert spark.read.text(str(tmp_path / "bed")).count() > 0 and spark.read.text(str(tmp_path / "cp")).count() > 0


def test_stream_ingest(spark, tmp_path):
    schema = "header string, seq string"
    rows = [("r BX:Z:a", "ACGTACGTACGTACG"), ("r#b", "ACGTTTTGGGACGTA")]
    src = tmp_path / "src"
    for i in range(2):  # the second file repeats the first
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    q = ingest.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), str(tmp_path / "t"), str(tmp_path / "c"), 5, 3, once=True)
    q.awaitTermination()
    from linkmap.operators import sequences

    want = {tuple(r) for r in sequences.index_linked(spark.createDataFrame(rows, schema), 5, 3).collect()}
    assert {tuple(r) for r in ingest.incidence(spark, str(tmp_path / "t")).collect()} == want


def test_entry_and_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(catalogue.queries()) > 70


@pytest.mark.parametrize("name", ["mx_frequency", "overlap", "minimizers", "map_bed", "merge_paths", "scaffolds", "paf_chain", "ego_cc"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "part orders lineitem documents".split():
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SMALL)
    r = con.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(x[c] for c in cols) for x in df.collect()))) == sorted(map(repr, r.fetchall()))
