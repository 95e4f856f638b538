"""Parameters and schemas of the engine's relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

READS = _schema(file=S, rec_no=L, header=S, seq=S, qual=S)
NAMED = _schema(name=S, seq=S, ord=L)
INCIDENCE = _schema(bx=S, mx=L)
MX_LIST = _schema(name=S, qpos=I, mx=L)
POSITIONS = _schema(chrom=S, mx_index=L, bp=L, total=L, seq_len=L)
VERTICES = _schema(id=S, m=L, mol=L)
EDGES = _schema(u=S, v=S, m=L)
PATHS = _schema(tid=L, tpos=L, mol=S)
BED = _schema(tname=L, tstart=L, tend=L, qname=S, score=L, orientation=S)
PAF = _schema(qname=S, qlength=L, qstart=L, qend=L, orientation=S, tname=S, tlength=L, tstart=L, tend=L, score=L, length=L, mapq=L)


@dataclass(frozen=True)
class ProtocolDefaults:
    """0 in a request means the protocol's default."""

    min_n: int
    max_n: int
    min_m: int
    compress: bool


PROTOCOLS = {"linked": ProtocolDefaults(100, 5000, 10, False), "long": ProtocolDefaults(50, 50_000, 5, True)}


def with_defaults(protocol: str, min_n: int = 0, max_n: int = 0, min_m: int = 0) -> ProtocolDefaults:
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}; known: {', '.join(PROTOCOLS)}")
    d = PROTOCOLS[protocol]
    return ProtocolDefaults(min_n or d.min_n, max_n or d.max_n, min_m or d.min_m, d.compress)


@dataclass(frozen=True)
class MoleculeParams:
    strategy: str = "bc+cc"
    skip_small: int = 10
    square_threshold: float = 0.75
    bin_size: int = 50
    merge_cutoff: int = 20
    seed: int = 42


@dataclass(frozen=True)
class BackboneParams:
    prune_branch_size: int = 10
    prune_bridge_size: int = 10
    prune_junction_size: int = 200
    min_path_size: int = 50


@dataclass(frozen=True)
class MergeParams:
    endpoint_depth: int = 25
    min_shared_mx: int = 3
    min_bridges: int = 2
    max_path_connections: int = 2
    min_path_size: int = 50
    max_links_per_endpoint: int = 1
    min_bridge_density: float = 0.01
    min_endpoint_hits: int = 4
    #: Follow chains of start-to-start joins in both directions; False leaves such paths unjoined.
    fix_direction: bool = True


@dataclass(frozen=True)
class ScaffoldParams:
    gap: int = 100
    min_score: int = 10
    min_length: int = 0
