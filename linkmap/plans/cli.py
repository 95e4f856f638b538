"""Command line: python -m linkmap.plans.cli COMMAND; every step reads and writes the text formats."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.operators import backbone, ego, filters, mapping, merge, molecules, overlap, repeats, report, scaffold, sequences
from linkmap.plans import pipelines
from linkmap.sources import sinks, tables
from linkmap.types import BackboneParams, MergeParams, MoleculeParams, ScaffoldParams


def _sets(s: SparkSession, path: str) -> DataFrame:
    return tables.read_minimizers(s, path)


def _contigs(s: SparkSession, path: str) -> DataFrame:
    return tables.named_sequences(tables.read_fastx(s, path))


def _put(rows: DataFrame, out: str, *order: str) -> None:
    sinks.write_lines(rows, out, list(order))


def _paf(s: SparkSession, a) -> DataFrame:
    paths = tables.read_paths(s, a.paths)
    paf = mapping.map_paf(tables.read_minimizer_lists(s, a.query), mapping.backbone_index(paths, _sets(s, a.sets)), paths, a.min_score, a.coef)
    return mapping.paf_top_n(paf, a.top)


def _map_params(a) -> pipelines.MapParams:
    return pipelines.MapParams(a.k, a.w, a.protocol, a.min_n, a.max_n, a.min_m, a.percentile, a.multiplier, MoleculeParams(strategy=a.strategy), BackboneParams(a.branch, a.bridge, a.junction, a.min_path))


def _write_map(m: pipelines.PhysicalMap, out: str) -> None:
    sinks.write_lines(sinks.minimizer_lines(m.incidence), f"{out}.filtered.tsv", ["name"])
    sinks.write_graph(m.vertices, m.edges, f"{out}.overlap.tsv")
    sinks.write_graph(m.mol_vertices, m.mol_edges, f"{out}.mol.tsv")
    sinks.write_lines(report.path_lines(m.paths), f"{out}.backbone.path", ["tid"])
    print(report.metrics_tsv(scaffold.path_metrics(m.paths)), end="")


def _write_scaffolds(x: dict[str, DataFrame], out: str) -> None:
    sinks.write_lines(sinks.fasta_lines(x["scaffolds"]), f"{out}.fasta", ["id"])
    print(report.metrics_tsv(x["before"]) + report.metrics_tsv(x["after"]), end="")


def index(s, a):
    reads = tables.read_fastx(s, a.inputs)
    inc, _ = pipelines.index(reads, pipelines.MapParams(a.k, a.w, a.protocol, repeat_multiplier=a.multiplier))
    _put(sinks.minimizer_lines(inc), a.out, "name")


def repeat_filter(s, a):
    reads = tables.read_fastx(s, a.inputs)
    counts = repeats.kmer_counts(reads, a.k)
    hist = repeats.histogram(counts)
    sinks.write_lines(sinks.histogram_lines(hist, a.k), f"{a.out}.hist", ["mult"], one_file=True)
    mode = repeats.histogram_mode(hist)
    if mode is not None:
        repeats.repeated_kmers(counts, repeats.threshold(mode, a.multiplier)).write.mode("overwrite").parquet(a.out)


def index_contigs(s, a):
    _put(sinks.list_lines(sequences.index_ordered(_contigs(s, a.inputs), a.k, a.w)), a.out, "name")


def index_positions(s, a):
    _put(sinks.tabbed(sequences.index_positions(_contigs(s, a.inputs), a.k, a.w, a.step), "chrom", "mx_index"), a.out, "chrom", "mx_index")


def filter_minimizers(s, a):
    inc = filters.filter_barcodes(filters.remove_singletons(filters.union_sets(*[_sets(s, x) for x in a.inputs])), a.min_n, a.max_n)
    _put(sinks.minimizer_lines(filters.remove_repetitive(filters.remove_singletons(inc), a.max_df)), a.out, "name")


def overlap_(s, a):
    inc = filters.union_sets(*[_sets(s, x) for x in a.inputs])
    sinks.write_graph(overlap.overlap_vertices(inc), overlap.overlap_edges(inc, a.min_m), a.out)


def filter_overlap(s, a):
    v, e = tables.read_graph(s, a.inputs[0])
    e = filters.filter_by_percentile(filters.filter_edges(e, a.min_m), a.percentile)
    v, e = filters.remove_small_components(v, e, a.min_component)
    sinks.write_graph(filters.remove_isolated(v, e), e, a.out)


def molecules_(s, a):
    v, e = tables.read_graph(s, a.inputs[0])
    sinks.write_graph(*molecules.molecule_graph(v, e, ego.assign_molecules(e, MoleculeParams(strategy=a.strategy))), a.out)


def split_minimizers(s, a):
    _put(sinks.list_lines(molecules.split_minimizers(tables.read_graph(s, a.inputs[0])[1], tables.read_minimizer_lists(s, a.sets)), "mol"), a.out, "name")


def trace_molecules(s, a):
    e = tables.read_graph(s, a.inputs[0])[1]
    filters.top_degrees(e).show(truncate=False)
    ego.trace_molecules(e, MoleculeParams(strategy=a.strategy)).orderBy("ego", "step").show(100, truncate=False)


def backbone_(s, a):
    paths = backbone.backbones(tables.read_graph(s, a.inputs[0])[1], BackboneParams(a.branch, a.bridge, a.junction, a.min_path))
    _put(report.path_lines(paths), a.out, "tid")


def merge_paths(s, a):
    inc = _sets(s, a.sets).withColumnRenamed("bx", "mol")
    p = MergeParams(a.depth, a.min_shared, a.min_bridges, a.max_connections, a.min_path, a.max_links, a.density, a.min_hits)
    _put(report.path_lines(merge.merge_paths(tables.read_paths(s, a.inputs[0]), inc, p)), a.out, "tid")


def map_(s, a):
    bed = mapping.map_to_backbone(tables.read_minimizer_lists(s, a.query), mapping.backbone_index(tables.read_paths(s, a.paths), _sets(s, a.sets)), a.min_score)
    _put(sinks.tabbed(bed, "tname", "tstart", "qname"), a.out, "tname", "tstart", "qname")


def map_paf(s, a):
    _put(sinks.tabbed(_paf(s, a), "tname", "tstart", "qname"), a.out, "tname", "tstart", "qname")


def bed_to_path(s, a):
    _put(sinks.oriented_path_lines(mapping.bed_to_paths(tables.read_bed(s, a.inputs[0]), a.min_score)), a.out, "tid")


def path_to_fasta(s, a):
    t = tables.read_paths(s, a.paths).select("tid", F.col("tpos").alias("ord"), C.oriented_name(F.col("mol")).alias("name"), C.orientation_of(F.col("mol")).alias("orientation"))
    _put(sinks.fasta_lines(scaffold.scaffolds(_contigs(s, a.inputs), t, ScaffoldParams(a.gap, min_length=a.min_length))), a.out, "id")


def metrics(s, a):
    print(report.metrics_tsv(scaffold.assembly_metrics(_contigs(s, a.inputs), a.genome or None)), end="")


def path_metrics(s, a):
    print(report.metrics_tsv(scaffold.path_metrics(tables.read_paths(s, a.inputs[0]), a.genome or None, a.min_path), "%.1f"), end="")


def backbone_dot(s, a):
    print(report.backbone_dot(tables.read_paths(s, a.inputs[0])), end="")


def physical_map(s, a):
    _write_map(pipelines.physical_map(tables.read_fastx(s, a.inputs), _map_params(a)), a.out)


def pipeline(s, a):
    m, x = pipelines.pipeline(tables.read_fastx(s, a.inputs), _contigs(s, a.draft), _map_params(a), ScaffoldParams(a.gap, a.min_score, a.min_length))
    _write_map(m, a.out)
    _write_scaffolds(x, a.out)


def scaffolds(s, a):
    x = pipelines.scaffold_with(tables.read_paths(s, a.paths), _sets(s, a.sets), _contigs(s, a.draft), pipelines.MapParams(a.k, a.w), ScaffoldParams(a.gap, a.min_score, a.min_length))
    _write_scaffolds(x, a.out)


COMMANDS = {
    "index": index, "repeat-filter": repeat_filter, "index-contigs": index_contigs, "index-positions": index_positions, "filter-minimizers": filter_minimizers, "overlap": overlap_, "filter-overlap": filter_overlap,
    "molecules": molecules_, "split-minimizers": split_minimizers, "trace-molecules": trace_molecules, "backbone": backbone_, "merge-paths": merge_paths, "map": map_, "map-paf": map_paf, "bed-to-path": bed_to_path,
    "path-to-fasta": path_to_fasta, "metrics": metrics, "path-metrics": path_metrics, "backbone-dot": backbone_dot, "pipeline": pipeline, "physical-map": physical_map, "scaffolds": scaffolds,
}

OPTIONS: list[tuple[str, type, object]] = [
    ("k", int, 32), ("w", int, 32), ("protocol", str, ""), ("multiplier", int, 3), ("min-n", int, 0), ("max-n", int, 0), ("max-df", int, 0), ("min-m", int, 0), ("percentile", float, 0.0), ("min-component", int, 0),
    ("strategy", str, "bc+cc"), ("branch", int, 10), ("bridge", int, 10), ("junction", int, 200), ("min-path", int, 50), ("depth", int, 25), ("min-shared", int, 3), ("min-bridges", int, 2), ("max-connections", int, 2),
    ("max-links", int, 1), ("density", float, 0.01), ("min-hits", int, 4), ("min-score", int, 10), ("coef", float, 1.5), ("top", int, 0), ("gap", int, 100), ("min-length", int, 0), ("genome", int, 0), ("step", int, 100),
    ("sets", str, ""), ("query", str, ""), ("paths", str, ""), ("draft", str, ""), ("out", str, ""),
]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkmap", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="*")
        for o, kind, default in OPTIONS:
            c.add_argument(f"--{o}", type=kind, default=default)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    COMMANDS[a.command](spark or SparkSession.builder.appName("linkmap").getOrCreate(), a)


if __name__ == "__main__":
    main()
