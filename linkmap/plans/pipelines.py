"""The engine's pipelines: one lazy plan between cuts, which are written tables in the shared folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from linkmap.operators import backbone, ego, filters, mapping, molecules, overlap, repeats, scaffold, sequences
from linkmap.operators.components import cut_lineage
from linkmap.types import BackboneParams, MoleculeParams, ScaffoldParams, with_defaults


@dataclass(frozen=True)
class MapParams:
    k: int = 32
    w: int = 32
    protocol: str = ""
    min_n: int = 0
    max_n: int = 0
    min_m: int = 0
    percentile: float = 0.0
    repeat_multiplier: int = 0
    molecules: MoleculeParams = field(default_factory=MoleculeParams)
    backbone: BackboneParams = field(default_factory=BackboneParams)


@dataclass
class PhysicalMap:
    incidence: DataFrame
    vertices: DataFrame
    edges: DataFrame
    mol_vertices: DataFrame
    mol_edges: DataFrame
    paths: DataFrame


def repeats_of(reads: DataFrame, k: int, multiplier: int) -> DataFrame | None:
    """K-mers that occur at least multiplier times as often as most do."""
    counts = cut_lineage(repeats.kmer_counts(reads, k), "kmers")
    mode = repeats.histogram_mode(repeats.histogram(counts))
    return None if mode is None else repeats.repeated_kmers(counts, repeats.threshold(mode, multiplier))


def index(reads: DataFrame, p: MapParams) -> tuple[DataFrame, str]:
    """Incidence of reads by the protocol that they show, or that is given."""
    protocol = p.protocol or sequences.detect_protocol(reads)
    d = with_defaults(protocol)
    rep = repeats_of(reads, p.k, p.repeat_multiplier) if p.repeat_multiplier else None
    make = sequences.index_long if d.compress else sequences.index_linked
    return make(reads, p.k, p.w, rep), protocol


def filtered(inc: DataFrame, min_n: int, max_n: int) -> DataFrame:
    return cut_lineage(filters.filter_chain(inc, min_n, max_n), "filtered")


def map_incidence(inc: DataFrame, p: MapParams, protocol: str = "linked") -> PhysicalMap:
    """From sets to backbone paths."""
    d = with_defaults(protocol, p.min_n, p.max_n, p.min_m)
    sets = filtered(inc, d.min_n, d.max_n)
    vertices = overlap.overlap_vertices(sets)
    edges = cut_lineage(filters.filter_by_percentile(overlap.overlap_edges(sets, d.min_m), p.percentile), "overlap")
    v, e = molecules.molecule_graph(vertices, edges, ego.assign_molecules(edges, p.molecules))
    e = cut_lineage(e, "molecules")
    return PhysicalMap(sets, vertices, edges, v, e, cut_lineage(backbone.backbones(e, p.backbone), "backbone"))


def physical_map(reads: DataFrame, p: MapParams | None = None) -> PhysicalMap:
    p = p or MapParams()
    inc, protocol = index(reads, p)
    return map_incidence(inc, p, protocol)


def scaffold_with(paths: DataFrame, inc: DataFrame, contigs: DataFrame, p: MapParams, s: ScaffoldParams | None = None) -> dict[str, DataFrame]:
    """BED rows, contig paths, scaffolds, and metrics before and after; contigs: (name, seq, ord)."""
    s = s or ScaffoldParams()
    bed = cut_lineage(mapping.map_to_backbone(sequences.index_ordered(contigs, p.k, p.w), mapping.backbone_index(paths, inc), s.min_score), "bed")
    contig_paths = mapping.bed_to_paths(bed, s.min_score)
    out = cut_lineage(scaffold.scaffolds(contigs, contig_paths, s), "scaffolds")
    return {"bed": bed, "paths": contig_paths, "scaffolds": out, "before": scaffold.assembly_metrics(contigs), "after": scaffold.assembly_metrics(out)}


def pipeline(reads: DataFrame, contigs: DataFrame, p: MapParams | None = None, s: ScaffoldParams | None = None) -> tuple[PhysicalMap, dict[str, DataFrame]]:
    """Reads and a draft to scaffolds."""
    p = p or MapParams()
    m = physical_map(reads, p)
    return m, scaffold_with(m.paths, m.incidence, contigs, p, s)
