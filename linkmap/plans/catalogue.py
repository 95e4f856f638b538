"""Registered queries of the engine's own operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.operators import backbone, chain, components, ego, filters, forest, mapping, merge, molecules, overlap, repeats, scaffold, sequences
from linkmap.plans import fixtures as X
from linkmap.sources import simulate
from linkmap.types import BackboneParams, MergeParams, MoleculeParams, ScaffoldParams

Query = Callable[[SparkSession, str], DataFrame]

MIN_N, MAX_N, MIN_M, EGO_M, TILE_M = 20, 60, 3, 5, 10
REPEAT_TIMES = 2


# --- Sets and the overlap graph --------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered incidence, overlap, percentile filter."""
    inc = filters.remove_repetitive(filters.filter_barcodes(filters.remove_singletons(X.bought(spark, sf_dir)), MIN_N, MAX_N))
    return filters.filter_by_percentile(overlap.overlap_edges(inc, MIN_M), 50)


def _edges(spark: SparkSession, sf_dir: str, m: int = MIN_M) -> DataFrame:
    return overlap.overlap_edges(X.bought(spark, sf_dir), m)


def mx_frequency(s, d):
    return filters.frequency(X.bought(s, d))


def filter_barcodes(s, d):
    return filters.filter_barcodes(X.bought(s, d), MIN_N, MAX_N).select("bx", "mx")


def barcode_counts(s, d):
    return filters.barcode_counts(X.bought(s, d), MIN_N, MAX_N)


def remove_singletons(s, d):
    return filters.remove_singletons(X.bought_fine(s, d))


def repetitive_threshold(s, d):
    return filters.repetitive_threshold(X.bought(s, d))


def remove_repetitive(s, d):
    return filters.remove_repetitive(X.bought(s, d))


def filter_chain(s, d):
    return filters.filter_chain(X.bought_fine(s, d), MIN_N, MAX_N)


def inverted_index(s, d):
    return filters.inverted_index(X.bought(s, d)).select("mx", F.array_join("bxs", ",").alias("bxs"))


def union_sets(s, d):
    return filters.union_sets(X.bought(s, d), X.bought_fine(s, d))


def overlap_query(s, d):
    return _edges(s, d)


def overlap_vertices(s, d):
    return overlap.overlap_vertices(X.bought(s, d))


def filter_edges(s, d):
    return filters.filter_edges(_edges(s, d), EGO_M)


def filter_overlap(s, d):
    return filters.filter_by_percentile(_edges(s, d), 90)


def degree_top5(s, d):
    return filters.top_degrees(_edges(s, d), 5)


def isolated_removed(s, d):
    return filters.remove_isolated(overlap.overlap_vertices(X.bought(s, d)), _edges(s, d, EGO_M))


def graph_stats(s, d):
    return filters.graph_stats(overlap.overlap_vertices(X.bought(s, d)), _edges(s, d))


def connected_components(s, d):
    return components.connected_components(_edges(s, d, EGO_M), overlap.overlap_vertices(X.bought(s, d)))


def small_components_removed(s, d):
    v, _ = filters.remove_small_components(overlap.overlap_vertices(X.bought(s, d)), _edges(s, d, EGO_M + 1), 3)
    return v


INC = X.BOUGHT_SQL
FREQ = "df AS (SELECT mx, count(*) df FROM inc GROUP BY mx)"
EDGES = "edges AS (SELECT a.bx u, b.bx v, count(*) m FROM inc a JOIN inc b ON a.mx = b.mx AND a.bx < b.bx GROUP BY 1, 2 HAVING count(*) >= %d)"
EDGES_ONCE = EDGES.replace("edges AS (", "edges AS MATERIALIZED (")
#: The weight at a percentile's rank, from how often each weight occurs.
AT_RANK = "hist AS (SELECT m, count(*) c FROM edges GROUP BY m), upto AS (SELECT m, sum(c) OVER (ORDER BY m) k, sum(c) OVER () n FROM hist), t AS (SELECT min(m) least_m FROM upto WHERE k > least(CAST(floor(n * %d / 100.0) AS BIGINT), n - 1))"
SIZES = "sizes AS (SELECT bx, count(*) n FROM inc GROUP BY bx)"
THRESHOLD = "ranked AS (SELECT df, row_number() OVER (ORDER BY df) - 1 r, count(*) OVER () n FROM df), q AS (SELECT max(df) FILTER (r = n // 4) q1, max(df) FILTER (r = 3 * n // 4) q3 FROM ranked), thr AS (SELECT q1, q3, q3 + CAST(floor(1.5 * (q3 - q1)) AS BIGINT) threshold FROM q)"
COMPONENTS = """sym AS (SELECT u a, v b FROM edges UNION SELECT v, u FROM edges), ids AS (SELECT bx id FROM sizes),
 reach(id, x) AS (SELECT id, id FROM ids UNION SELECT r.id, s.b FROM reach r JOIN sym s ON s.a = r.x), comp AS (SELECT id, min(x) component FROM reach GROUP BY id)"""

SET_SQL = {
    "mx_frequency": f"WITH {INC}, {FREQ} SELECT mx, df FROM df",
    "filter_barcodes": f"WITH {INC}, {SIZES} SELECT bx, mx FROM inc JOIN sizes USING (bx) WHERE n >= {MIN_N} AND n < {MAX_N}",
    "barcode_counts": f"WITH {INC}, {SIZES} SELECT count(*) FILTER (n < {MIN_N}) too_few, count(*) FILTER (n >= {MAX_N}) too_many FROM sizes",
    "remove_singletons": f"WITH {X.BOUGHT_FINE_SQL}, {FREQ} SELECT bx, mx FROM inc JOIN df USING (mx) WHERE df >= 2",
    "repetitive_threshold": f"WITH {INC}, {FREQ}, {THRESHOLD} SELECT q1, q3, threshold FROM thr",
    "remove_repetitive": f"WITH {INC}, {FREQ}, {THRESHOLD} SELECT bx, mx FROM inc JOIN df USING (mx), thr WHERE df < threshold",
    "filter_chain": f"""WITH {X.BOUGHT_FINE_SQL.replace('inc AS', 'a0 AS')}, d0 AS (SELECT mx FROM a0 GROUP BY mx HAVING count(*) >= 2), a1 AS (SELECT bx, mx FROM a0 JOIN d0 USING (mx)),
 s1 AS (SELECT bx FROM a1 GROUP BY bx HAVING count(*) >= {MIN_N} AND count(*) < {MAX_N}), a2 AS (SELECT bx, mx FROM a1 JOIN s1 USING (bx)),
 d2 AS (SELECT mx FROM a2 GROUP BY mx HAVING count(*) >= 2), inc AS (SELECT bx, mx FROM a2 JOIN d2 USING (mx)), {FREQ}, {THRESHOLD} SELECT bx, mx FROM inc JOIN df USING (mx), thr WHERE df < threshold""",
    "inverted_index": f"WITH {INC} SELECT mx, string_agg(bx, ',' ORDER BY bx) bxs FROM inc GROUP BY mx",
    "union_sets": f"WITH {INC}, {X.BOUGHT_FINE_SQL.replace('inc AS', 'fine AS')} SELECT bx, mx FROM inc UNION SELECT bx, mx FROM fine",
    "overlap": f"WITH {INC}, {EDGES % MIN_M} SELECT u, v, m FROM edges",
    "overlap_vertices": f"WITH {INC}, {SIZES} SELECT bx id, n m FROM sizes",
    "filter_edges": f"WITH {INC}, {EDGES % MIN_M} SELECT u, v, m FROM edges WHERE m >= {EGO_M}",
    "filter_overlap": f"WITH {INC}, {EDGES_ONCE % MIN_M}, {AT_RANK % 90} SELECT u, v, m FROM edges WHERE m >= (SELECT least_m FROM t)",
    "degree_top5": f"WITH {INC}, {EDGES % MIN_M} SELECT id, count(*) degree FROM (SELECT unnest([u, v]) id FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 5",
    "isolated_removed": f"WITH {INC}, {SIZES}, {EDGES % EGO_M} SELECT bx id, n m FROM sizes WHERE bx IN (SELECT u FROM edges UNION SELECT v FROM edges)",
    "graph_stats": f"WITH {INC}, {SIZES}, {EDGES % MIN_M} SELECT (SELECT count(*) FROM sizes) n_vertices, count(*) n_edges, CAST(coalesce(sum(m), 0) AS BIGINT) total_m FROM edges",
    "connected_components": f"WITH RECURSIVE {INC}, {SIZES}, {EDGES % EGO_M}, {COMPONENTS} SELECT id, component FROM comp",
    "small_components_removed": f"WITH RECURSIVE {INC}, {SIZES}, {EDGES % (EGO_M + 1)}, {COMPONENTS} SELECT id, n m FROM comp JOIN sizes ON bx = id WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 3)",
}
SET_QUERIES: dict[str, Query] = {
    "mx_frequency": mx_frequency,
    "filter_barcodes": filter_barcodes,
    "barcode_counts": barcode_counts,
    "remove_singletons": remove_singletons,
    "repetitive_threshold": repetitive_threshold,
    "remove_repetitive": remove_repetitive,
    "filter_chain": filter_chain,
    "inverted_index": inverted_index,
    "union_sets": union_sets,
    "overlap": overlap_query,
    "overlap_vertices": overlap_vertices,
    "filter_edges": filter_edges,
    "filter_overlap": filter_overlap,
    "degree_top5": degree_top5,
    "isolated_removed": isolated_removed,
    "graph_stats": graph_stats,
    "connected_components": connected_components,
    "small_components_removed": small_components_removed,
}

# --- Sequences --------------------------------------------------------------


def kmer_codes(s, d):
    return sequences.kmer_codes(X.contigs(s, d), X.K, ["name"])


def kmer_hashes(s, d):
    return sequences.kmer_hashes(X.contigs(s, d), X.K, ["name"])


def kmer_hash_columns(s, d):
    return sequences.kmer_codes(X.contigs(s, d), X.K, ["name"]).select("name", "pos", C.mix64(F.col("code")).alias("mx"))


def minimizers(s, d):
    return sequences.minimizers(X.contigs(s, d), X.K, X.W, ["name"])


def minimizer_positions(s, d):
    return sequences.minimizer_positions(X.contigs(s, d), X.K, X.W, ["name"])


def index_contigs(s, d):
    return sequences.index_ordered(X.contigs(s, d), X.K, X.W)


def index_positions(s, d):
    return sequences.index_positions(X.contigs(s, d), X.K, X.W, step=50)


def index_reads(s, d):
    return sequences.index_linked(X.reads(s, d), X.K, X.W)


def index_long_reads(s, d):
    return sequences.index_long(X.reads(s, d), X.K, X.W)


def _repeats(s, d):
    return repeats.repeated_kmers(repeats.kmer_counts(X.reads(s, d), X.K), REPEAT_TIMES * 30)


def minimizers_filtered(s, d):
    return sequences.minimizers_filtered(X.contigs(s, d), X.K, X.W, ["name"], _repeats(s, d))


def index_reads_filtered(s, d):
    return sequences.index_linked(X.reads(s, d), X.K, X.W, _repeats(s, d))


def homopolymer(s, d):
    return X.reads(s, d).select("rec_no", C.compress_runs(F.col("seq")).alias("short"), F.array_join(C.run_starts(F.col("seq")), ",").alias("starts")).withColumnRenamed("short", "seq")


def compressed_reads(s, d):
    rows = X.reads(s, d).withColumn("qual", F.when(F.col("rec_no") % 2 == 0, F.substring(F.md5(F.col("seq").cast("binary")), 1, 32)))
    return sequences.compressed_reads(rows.withColumn("seq", F.substring("seq", 1, 32))).select("rec_no", "seq", "qual")


def revcomp(s, d):
    return X.reads(s, d).select("rec_no", C.reverse_complement(F.col("seq")).alias("seq"))


def base_codes(s, d):
    return X.reads(s, d).select(F.explode(F.split("seq", "")).alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("n")).select("base", "n", C.encode_base(F.col("base")).alias("code"), C.complement_code(C.encode_base(F.col("base"))).alias("complement"))


def barcode_extract(s, d):
    return X.reads(s, d).select("rec_no", C.barcode(F.col("header")).alias("barcode"), sequences.read_key().alias("key"))


def protocol_detect(s, d):
    return s.createDataFrame([(sequences.detect_protocol(X.reads(s, d)),)], "protocol string")


def kmer_histogram(s, d):
    return repeats.histogram(repeats.kmer_counts(X.reads(s, d), X.K))


def histogram_mode(s, d):
    return repeats.mode_frame(repeats.histogram(repeats.kmer_counts(X.reads(s, d), X.K)))


def repeat_kmers(s, d):
    return _repeats(s, d)


def simulated_reads(s, d):
    return simulate.simulate_reads(X.contigs(s, d).select("name", "seq"), simulate.Simulation(barcodes=60, molecule_size=1500.0, molecule_spread=300.0, reads=20, read_length=100))


def long_kmers(s, d):
    return sequences.kmer_hashes(X.contigs(s, d), 40, ["name"])


def unsigned_text(s, d):
    return sequences.kmer_hashes(X.contigs(s, d), X.K, ["name"]).select("mx", C.to_unsigned_text(F.col("mx")).alias("text"), C.from_unsigned_text(C.to_unsigned_text(F.col("mx"))).alias("back")).distinct()


CONTIG_KMERS = f"{X.CONTIGS_SQL}, {X.kmers_sql('contigs', 'name')}"
READ_KMERS = f"{X.READS_SQL}, {X.kmers_sql('reads', 'rec_no, header')}"
REPEATED = f"{X.READS_SQL.replace('reads AS (SELECT', 'reads AS (SELECT')}"
_COUNTS = "counts AS (SELECT code, least(count(*), 65535) n FROM kmers GROUP BY code)"
_HIST = "hist AS (SELECT least(n, 10000) mult, count(*) freq FROM counts GROUP BY 1)"
_KEY = f"coalesce({X.BARCODE_SQL}, {X.TOKEN_SQL})"
_SQUEEZED = "list_filter(range(length(seq)), lambda i: i = 0 OR substr(seq, i + 1, 1) <> substr(seq, i, 1))"
_LONG_READS = f"{X.READS_SQL}, short AS (SELECT rec_no, {X.TOKEN_SQL} header, array_to_string(list_transform({_SQUEEZED}, lambda i: substr(seq, i + 1, 1)), '') seq FROM reads)"
_RARE = "rare AS (SELECT code FROM kmers GROUP BY code HAVING least(count(*), 65535) >= %d)" % (REPEAT_TIMES * 30)


def _renamed(sql: str, suffix: str, *names: str) -> str:
    for n in names:
        for lead in (" ", "("):
            for tail in (" ", ")", ",", "\n", "."):
                sql = sql.replace(f"{lead}{n}{tail}", f"{lead}{n}{suffix}{tail}")
        if sql.startswith(f"{n} "):
            sql = f"{n}{suffix}{sql[len(n):]}"
    return sql


_TWO = f"{READ_KMERS}, {_RARE}, {_renamed(X.kmers_sql('contigs', 'name'), '2', 'all_kmers', 'good', 'codes', 'coded', 'mixed', 'kmers')}"
_LEFT = _TWO.replace("kmers2 AS (SELECT name, pos, code, h FROM good2 JOIN mixed2 USING (c))", "left_over AS (SELECT name, pos, code, h FROM good2 JOIN mixed2 USING (c) WHERE code NOT IN (SELECT code FROM rare))")
_LEFT_MIN = X.minimizers_sql("name", least=True).replace("FROM kmers", "FROM left_over")
_READ_LEFT = f"{READ_KMERS}, {_RARE}, left_over AS (SELECT * FROM kmers WHERE code NOT IN (SELECT code FROM rare))"

SEQ_SQL = {
    "kmer_codes": f"WITH {CONTIG_KMERS} SELECT name, pos, {X.signed('code')} AS code FROM kmers",
    "kmer_hashes": f"WITH {CONTIG_KMERS} SELECT name, pos, {X.signed('h')} AS mx FROM kmers",
    "kmer_hash_columns": f"WITH {CONTIG_KMERS} SELECT name, pos, {X.signed('h')} AS mx FROM kmers",
    "minimizers": f"WITH {CONTIG_KMERS}, {X.minimizers_sql('name')}, f AS (SELECT name, h, min(i) i FROM firsts GROUP BY name, h) SELECT name, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS pos, {X.signed('h')} AS mx FROM f",
    "minimizer_positions": f"WITH {CONTIG_KMERS}, {X.minimizers_sql('name')}, f AS (SELECT DISTINCT name, mpos FROM firsts) SELECT name, row_number() OVER (PARTITION BY name ORDER BY mpos) - 1 AS pos, mpos AS bp FROM f",
    "index_contigs": f"WITH {CONTIG_KMERS}, {X.minimizers_sql('name')}, f AS (SELECT name, h, min(i) i FROM firsts GROUP BY name, h) SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS INTEGER) AS qpos, {X.signed('h')} AS mx FROM f",
    "index_positions": f"WITH {CONTIG_KMERS}, {X.minimizers_sql('name')}, f AS (SELECT DISTINCT name, mpos FROM firsts), g AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY mpos) - 1 AS i, mpos, count(*) OVER (PARTITION BY name) AS total FROM f) SELECT name AS chrom, i AS mx_index, mpos AS bp, total, length(seq) AS seq_len FROM g JOIN contigs USING (name) WHERE i % 50 = 0 OR i = total - 1",
    "index_reads": f"WITH {READ_KMERS}, {X.minimizers_sql('rec_no, header')} SELECT DISTINCT {_KEY} AS bx, {X.signed('h')} AS mx FROM firsts",
    "index_long_reads": f"WITH {_LONG_READS}, {X.kmers_sql('short', 'rec_no, header')}, {X.minimizers_sql('rec_no, header')} SELECT DISTINCT header AS bx, {X.signed('h')} AS mx FROM firsts",
    "minimizers_filtered": f"WITH {_LEFT}, {_LEFT_MIN}, f AS (SELECT name, i, h, lag(h) OVER (PARTITION BY name ORDER BY i) p FROM firsts) SELECT name, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS pos, {X.signed('h')} AS mx FROM f WHERE p IS NULL OR p <> h",
    "index_reads_filtered": f"WITH {_READ_LEFT}, {X.minimizers_sql('rec_no, header', least=True).replace('FROM kmers', 'FROM left_over')} SELECT DISTINCT {_KEY} AS bx, {X.signed('h')} AS mx FROM firsts",
    "homopolymer": f"WITH {X.READS_SQL}, s AS (SELECT rec_no, seq, {_SQUEEZED} st FROM reads) SELECT rec_no, array_to_string(list_transform(st, lambda i: substr(seq, i + 1, 1)), '') AS seq, array_to_string(st, ',') AS starts FROM s",
    "compressed_reads": f"WITH {X.READS_SQL}, r AS (SELECT rec_no, substr(seq, 1, 32) seq, CASE WHEN rec_no % 2 = 0 THEN substr(md5(seq), 1, 32) END q FROM reads), s AS (SELECT *, {_SQUEEZED} st FROM r) SELECT rec_no, array_to_string(list_transform(st, lambda i: substr(seq, i + 1, 1)), '') AS seq, coalesce(array_to_string(list_transform(st, lambda i: substr(q, i + 1, 1)), ''), repeat('I', len(st))) AS qual FROM s",
    "revcomp": f"WITH {X.READS_SQL} SELECT rec_no, reverse(translate(regexp_replace(seq, '[^ACGTacgtNn]', 'N', 'g'), 'ACGTacgtNn', 'TGCAtgcaNn')) AS seq FROM reads",
    "base_codes": f"WITH {X.READS_SQL}, b AS (SELECT unnest(string_split(seq, '')) base FROM reads), c AS (SELECT base, count(*) n FROM b GROUP BY base) SELECT base, n, CAST(nullif(instr('ACGT', upper(base)) - 1, -1) AS INTEGER) AS code, CAST(xor(CAST(nullif(instr('ACGT', upper(base)) - 1, -1) AS INTEGER), 3) AS INTEGER) AS complement FROM c",
    "barcode_extract": f"WITH {X.READS_SQL} SELECT rec_no, {X.BARCODE_SQL} AS barcode, {_KEY} AS key FROM reads",
    "protocol_detect": f"WITH {X.READS_SQL}, h AS (SELECT * FROM reads ORDER BY rec_no LIMIT 1000) SELECT CASE WHEN avg(CAST({X.BARCODE_SQL} IS NOT NULL AS INTEGER)) >= 0.1 THEN 'linked' ELSE 'long' END AS protocol FROM h",
    "kmer_histogram": f"WITH {READ_KMERS}, {_COUNTS}, {_HIST} SELECT mult, freq FROM hist",
    "histogram_mode": f"WITH {READ_KMERS}, {_COUNTS}, {_HIST}, d AS (SELECT r.mult, coalesce(freq, 0) freq FROM (SELECT unnest(range(1, (SELECT max(mult) FROM hist) + 1)) mult) r LEFT JOIN hist USING (mult)), e AS (SELECT *, freq > lag(freq) OVER (ORDER BY mult) rise FROM d), v AS (SELECT coalesce(min(mult) FILTER (rise) - 1, 1) valley FROM e) SELECT mult AS mode FROM d, v WHERE mult >= valley ORDER BY freq DESC, mult DESC LIMIT 1",
    "repeat_kmers": f"WITH {READ_KMERS}, {_COUNTS} SELECT {X.signed('code')} AS code, n FROM counts WHERE n >= {REPEAT_TIMES * 30}",
    "long_kmers": f"WITH {X.CONTIGS_SQL}, {X.long_kmers_sql('contigs', 'name', 40)} SELECT name, pos, {X.signed('h')} AS mx FROM kmers",
    "unsigned_text": f"WITH {CONTIG_KMERS} SELECT DISTINCT {X.signed('h')} AS mx, CAST(h AS VARCHAR) AS text, {X.signed('h')} AS back FROM kmers",
}
SEQ_QUERIES: dict[str, Query] = {
    "kmer_codes": kmer_codes,
    "kmer_hashes": kmer_hashes,
    "kmer_hash_columns": kmer_hash_columns,
    "minimizers": minimizers,
    "minimizer_positions": minimizer_positions,
    "index_contigs": index_contigs,
    "index_positions": index_positions,
    "index_reads": index_reads,
    "index_long_reads": index_long_reads,
    "minimizers_filtered": minimizers_filtered,
    "index_reads_filtered": index_reads_filtered,
    "homopolymer": homopolymer,
    "compressed_reads": compressed_reads,
    "revcomp": revcomp,
    "base_codes": base_codes,
    "barcode_extract": barcode_extract,
    "protocol_detect": protocol_detect,
    "kmer_histogram": kmer_histogram,
    "histogram_mode": histogram_mode,
    "repeat_kmers": repeat_kmers,
    "long_kmers": long_kmers,
    "simulated_reads": simulated_reads,
    "unsigned_text": unsigned_text,
}

# --- Ego networks and molecules ---------------------------------------------


def ego_edges(s, d):
    return ego.ego_edges(_edges(s, d, EGO_M))


def ego_cc(s, d):
    return ego.ego_components(_edges(s, d, EGO_M))


def _assigned(s, d, strategy: str) -> DataFrame:
    return ego.assign_molecules(_edges(s, d, EGO_M), MoleculeParams(strategy=strategy, skip_small=4, bin_size=20, merge_cutoff=2))


def _molecules(strategy: str) -> Query:
    return lambda s, d: _assigned(s, d, strategy)


def molecule_graph(s, d):
    e = _edges(s, d, EGO_M)
    return molecules.molecule_graph(overlap.overlap_vertices(X.bought(s, d)), e, ego.assign_molecules(e, MoleculeParams(strategy="cc")))[0]


def molecule_edges(s, d):
    e = _edges(s, d, EGO_M)
    return molecules.molecule_edges(e, ego.assign_molecules(e, MoleculeParams(strategy="cc")))


def trace_molecules(s, d):
    return ego.trace_molecules(_edges(s, d, EGO_M))


def _lists(inc: DataFrame) -> DataFrame:
    return inc.groupBy("bx").agg(F.sort_array(F.collect_list("mx")).alias("x")).select(F.col("bx").alias("name"), F.posexplode("x").alias("qpos", "mx"))


def split_minimizers(s, d):
    return molecules.split_minimizers(molecule_edges(s, d), _lists(X.bought(s, d)))


_SYM = "sym AS (SELECT u a, v b FROM edges UNION ALL SELECT v, u FROM edges)"
_EGO = "ego AS (SELECT x.a ego, x.b a, y.b b FROM sym x JOIN sym y ON x.a = y.a AND x.b < y.b JOIN edges e ON e.u = x.b AND e.v = y.b)"
_EGO_CC = """eb AS (SELECT ego, a, b FROM ego UNION ALL SELECT ego, b, a FROM ego), walk(ego, a, x) AS (SELECT a, b, b FROM sym UNION SELECT w.ego, w.a, eb.b FROM walk w JOIN eb ON eb.ego = w.ego AND eb.a = w.x), parts AS (SELECT ego, a, min(x) part FROM walk GROUP BY 1, 2)"""
_ASG = """sized AS (SELECT ego, part, count(*) n FROM parts GROUP BY 1, 2), numbered AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY n DESC, part) - 1 mol FROM sized), asg AS (SELECT p.ego u, p.a v, mol FROM parts p JOIN numbered USING (ego, part) WHERE n > 1)"""
# a vertex is an articulation point if, without it, some neighbour's component falls apart: its component has more parts than one
_CUT = """steps AS (SELECT ego, a, b FROM ego UNION ALL SELECT ego, b, a FROM ego),
 seeds AS (SELECT ego, a gone, min(b) b FROM steps GROUP BY ego, a HAVING count(*) > 1), roam(ego, gone, x) AS (SELECT ego, gone, b FROM seeds UNION SELECT r.ego, r.gone, s.b FROM roam r JOIN steps s ON s.ego = r.ego AND s.a = r.x WHERE s.b <> r.gone),
 cut AS (SELECT DISTINCT s.ego, s.a FROM steps s JOIN seeds USING (ego) WHERE seeds.gone = s.a AND NOT EXISTS (SELECT 1 FROM roam r WHERE r.ego = s.ego AND r.gone = s.a AND r.x = s.b)),
 stay AS (SELECT a ego, b a FROM sym ANTI JOIN cut ON cut.ego = sym.a AND cut.a = sym.b), kept AS (SELECT s.ego, s.a, s.b FROM steps s ANTI JOIN cut c ON c.ego = s.ego AND c.a = s.a ANTI JOIN cut d ON d.ego = s.ego AND d.a = s.b),
 walk(ego, a, x) AS (SELECT ego, a, a FROM stay UNION SELECT w.ego, w.a, k.b FROM walk w JOIN kept k ON k.ego = w.ego AND k.a = w.x), parts AS (SELECT ego, a, min(x) part FROM walk GROUP BY 1, 2)"""
# an edge stays if its ends' rows of the squared adjacency have a cosine of 0.75, in single precision; fewer than four are one part
_SQCOS = """steps AS (SELECT ego, a, b FROM ego UNION ALL SELECT ego, b, a FROM ego), members AS (SELECT a ego, b a FROM sym), per_ego AS (SELECT ego, count(*) k FROM members GROUP BY ego),
 sq AS (SELECT p.ego, p.a, q.b c, count(*) w FROM steps p JOIN steps q ON q.ego = p.ego AND q.a = p.b GROUP BY 1, 2, 3), norms AS (SELECT ego, a, CAST(sqrt(CAST(sum(w * w) AS REAL)) AS REAL) l FROM sq GROUP BY 1, 2),
 dots AS (SELECT s.ego, s.a, s.b, sum(x.w * y.w) d FROM steps s JOIN sq x ON x.ego = s.ego AND x.a = s.a JOIN sq y ON y.ego = s.ego AND y.a = s.b AND y.c = x.c GROUP BY 1, 2, 3),
 kept AS (SELECT d.ego, d.a, d.b FROM dots d JOIN norms m ON m.ego = d.ego AND m.a = d.a JOIN norms k ON k.ego = d.ego AND k.a = d.b WHERE CAST(d.d AS REAL) / (m.l * k.l) >= CAST(0.75 AS REAL)),
 walk(ego, a, x) AS (SELECT ego, a, a FROM members UNION SELECT w.ego, w.a, k.b FROM walk w JOIN kept k ON k.ego = w.ego AND k.a = w.x), parts AS (SELECT ego, a, CASE WHEN k < 4 THEN '' ELSE min(x) END part FROM walk JOIN per_ego USING (ego) GROUP BY ego, a, k)"""
# triangles that share an edge are one part; an edge stands for its part
_K3 = """tri AS (SELECT x.ego, x.a, x.b, y.b c FROM ego x JOIN ego y ON y.ego = x.ego AND y.a = x.b JOIN ego z ON z.ego = x.ego AND z.a = x.a AND z.b = y.b),
 te AS (SELECT ego, a || ' ' || b || ' ' || c t, unnest([a || ' ' || b, a || ' ' || c, b || ' ' || c]) e FROM tri), next_e AS (SELECT DISTINCT p.ego, p.e e, q.e f FROM te p JOIN te q ON q.ego = p.ego AND q.t = p.t),
 reach_e(ego, e, f) AS (SELECT ego, e, f FROM next_e UNION SELECT r.ego, r.e, n.f FROM reach_e r JOIN next_e n ON n.ego = r.ego AND n.e = r.f), of_e AS (SELECT ego, e, min(f) part FROM reach_e GROUP BY 1, 2),
 inside AS (SELECT DISTINCT ego, part, unnest(string_split(e, ' ')) a FROM of_e), sized AS (SELECT ego, part, count(*) n, list_sort(list(a)) l FROM inside GROUP BY 1, 2),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY n DESC, l) - 1 mol FROM sized), asg AS (SELECT ego u, a v, min(mol) mol FROM inside JOIN numbered USING (ego, part) GROUP BY 1, 2)"""
_MOL = """mol_e AS (SELECT e.u || '_' || x.mol p, e.v || '_' || y.mol q, m FROM edges e JOIN asg x ON x.u = e.u AND x.v = e.v JOIN asg y ON y.u = e.v AND y.v = e.u), mol_edges AS (SELECT least(p, q) u, greatest(p, q) v, m FROM mol_e)"""
_EGO_ALL = f"WITH RECURSIVE {INC}, {SIZES}, {EDGES % EGO_M}, {_SYM}, {_EGO}, {_EGO_CC}"
_EGO_BARE = f"WITH RECURSIVE {INC}, {SIZES}, {EDGES % EGO_M}, {_SYM}, {_EGO}"
_BX = "regexp_replace({0}, '_[^_]*$', '')"
_LISTS = "lists AS (SELECT bx name, row_number() OVER (PARTITION BY bx ORDER BY mx) - 1 qpos, mx FROM inc)"

MOL_SQL = {
    "ego_edges": f"WITH {INC}, {EDGES % EGO_M}, {_SYM}, {_EGO} SELECT ego, a, b FROM ego",
    "ego_cc": f"{_EGO_ALL} SELECT ego, a, part FROM parts",
    "molecules_cc": f"{_EGO_ALL}, {_ASG} SELECT u, v, mol FROM asg",
    "molecules_bc": f"{_EGO_BARE}, {_CUT}, {_ASG} SELECT u, v, mol FROM asg",
    "molecules_bc_cc": f"{_EGO_BARE}, {_CUT}, {_ASG} SELECT u, v, mol FROM asg",
    "molecules_sqcos": f"{_EGO_BARE}, {_SQCOS}, {_ASG} SELECT u, v, mol FROM asg",
    "molecules_k3": f"{_EGO_BARE}, {_K3} SELECT u, v, mol FROM asg",
    "molecule_edges": f"{_EGO_ALL}, {_ASG}, {_MOL} SELECT u, v, m FROM mol_edges",
    "molecule_graph": f"{_EGO_ALL}, {_ASG}, {_MOL}, ends AS (SELECT u id FROM mol_edges UNION SELECT v FROM mol_edges) SELECT id, n m, CAST(regexp_extract(id, '_([0-9]+)$', 1) AS BIGINT) mol FROM ends JOIN sizes ON bx = {_BX.format('id')}",
    "split_minimizers": f"""{_EGO_ALL}, {_ASG}, {_MOL}, {_LISTS}, near AS (SELECT DISTINCT mol, {_BX.format('o')} near FROM (SELECT u mol, v o FROM mol_edges UNION ALL SELECT v, u FROM mol_edges)),
 around AS (SELECT DISTINCT mol, mx FROM near JOIN inc ON bx = near), mols AS (SELECT DISTINCT mol FROM near), own AS (SELECT mol, qpos, mx FROM mols JOIN lists ON name = {_BX.format('mol')} SEMI JOIN around USING (mol, mx)) SELECT mol, CAST(qpos AS INTEGER) qpos, mx FROM mols LEFT JOIN own USING (mol)""",
}
MOL_QUERIES: dict[str, Query] = {
    "ego_edges": ego_edges,
    "ego_cc": ego_cc,
    **{f"molecules_{x}": _molecules(x) for x in ("cc", "bc", "k3", "sqcos", "k3bin", "sqcosbin", "distributed")},
    "molecules_bc_cc": _molecules("bc+cc"),
    "molecule_graph": molecule_graph,
    "molecule_edges": molecule_edges,
    "trace_molecules": trace_molecules,
    "split_minimizers": split_minimizers,
}

# --- Forests and backbones ---------------------------------------------------

TILE_PARAMS = BackboneParams(prune_branch_size=5, prune_bridge_size=5, prune_junction_size=20, min_path_size=10)


def _tile_edges(s, d) -> DataFrame:
    return overlap.overlap_edges(X.tiles(s, d), TILE_M)


def spanning_forest(s, d):
    return forest.spanning_forest(_edges(s, d, EGO_M))


def spanning_forest_tiles(s, d):
    return forest.spanning_forest(_tile_edges(s, d))


def prune(s, d):
    return forest.pruned_forest(_edges(s, d, EGO_M), 3)


def backbone_tiles(s, d):
    return backbone.backbones(_tile_edges(s, d), TILE_PARAMS)


def backbone_graph(s, d):
    return backbone.backbones(_edges(s, d, EGO_M), TILE_PARAMS)


def bridges_removed(s, d):
    return backbone.remove_bridges(_edges(s, d, EGO_M), 5, 2)


def _tile_paths(s, d, size: int = 40, gap: int = 10) -> DataFrame:
    """Tiles in paths of size, with gap tiles between them that belong to none."""
    b = F.substring("bx", 2, 4).cast("long")
    rows = X.tiles(s, d).select("bx").distinct().withColumn("b", b)
    return rows.where(F.col("b") % (size + gap) < size).select(F.floor(F.col("b") / (size + gap)).alias("tid"), (F.col("b") % (size + gap)).alias("tpos"), F.col("bx").alias("mol"))


def _tile_inc(s, d) -> DataFrame:
    return X.tiles(s, d).withColumnRenamed("bx", "mol")


MERGE = MergeParams(endpoint_depth=10, min_shared_mx=3, min_bridges=2, min_path_size=10, max_links_per_endpoint=2, min_bridge_density=0.01, min_endpoint_hits=1)


def adjacent_ends(s, d):
    return backbone.adjacent_ends(_tile_paths(s, d, gap=1), _tile_edges(s, d))


def merge_adjacent(s, d):
    return backbone.merge_adjacent(_tile_paths(s, d, gap=1), _tile_edges(s, d), 10)


def bridge_evidence(s, d):
    return merge.bridge_evidence(_tile_paths(s, d), _tile_inc(s, d), MERGE)


def merge_links(s, d):
    return merge.merge_links(_tile_paths(s, d), _tile_inc(s, d), MERGE)


def merge_paths(s, d):
    return merge.merge_paths(_tile_paths(s, d), _tile_inc(s, d), MERGE)


def _tile_paths_sql(size: int = 40, gap: int = 10) -> str:
    return f"bxs AS (SELECT DISTINCT bx, CAST(substr(bx, 2) AS BIGINT) b FROM inc), paths AS (SELECT b // {size + gap} tid, b % {size + gap} tpos, bx mol FROM bxs WHERE b % {size + gap} < {size})"


_ENDS = f"sizes AS (SELECT tid, count(*) n FROM paths GROUP BY tid), ends AS (SELECT mol, tid, tpos >= n - {MERGE.endpoint_depth} is_end FROM paths JOIN sizes USING (tid) WHERE tpos < {MERGE.endpoint_depth} OR tpos >= n - {MERGE.endpoint_depth})"
_EVIDENCE = f"""hits AS (SELECT f.bx mol, e.mol em, e.tid, e.is_end, count(*) c FROM inc f JOIN inc g ON g.mx = f.mx JOIN ends e ON e.mol = g.bx WHERE f.bx NOT IN (SELECT mol FROM paths) GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MERGE.min_shared_mx}),
 strong AS (SELECT mol, tid, is_end FROM hits GROUP BY 1, 2, 3 HAVING count(*) >= {MERGE.min_endpoint_hits}), spans AS (SELECT mol FROM strong GROUP BY mol HAVING count(DISTINCT tid) BETWEEN 2 AND {MERGE.max_path_connections}), kept AS (SELECT * FROM strong SEMI JOIN spans USING (mol)),
 evidence AS (SELECT x.tid a, x.is_end a_end, y.tid b, y.is_end b_end, count(DISTINCT x.mol) bridges FROM kept x JOIN kept y ON x.mol = y.mol AND x.tid < y.tid GROUP BY 1, 2, 3, 4)"""
_LINKS = f"""strong_links AS (SELECT e.* FROM evidence e JOIN sizes x ON x.tid = a JOIN sizes y ON y.tid = b WHERE bridges >= {MERGE.min_bridges} AND least(x.n, y.n) >= {MERGE.min_path_size} AND bridges / least(x.n, y.n) >= {MERGE.min_bridge_density}),
 per_end AS (SELECT t, x, count(*) c FROM (SELECT a t, a_end x FROM strong_links UNION ALL SELECT b, b_end FROM strong_links) GROUP BY 1, 2), links AS (SELECT * FROM strong_links WHERE (a, a_end) IN (SELECT (t, x) FROM per_end WHERE c <= {MERGE.max_links_per_endpoint}) AND (b, b_end) IN (SELECT (t, x) FROM per_end WHERE c <= {MERGE.max_links_per_endpoint}))"""

# an edge is in the forest unless its ends are joined by edges that come before it
_FOREST = """ranked AS (SELECT u, v, m, row_number() OVER (ORDER BY m DESC, u, v) r FROM edges), by_end AS (SELECT r, u a, v b FROM ranked UNION ALL SELECT r, v, u FROM ranked),
 ways(r, x) AS (SELECT r, u FROM ranked UNION SELECT w.r, e.b FROM ways w JOIN by_end e ON e.a = w.x AND e.r < w.r), forest AS (SELECT u, v, m FROM ranked f WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.r = f.r AND w.x = f.v))"""



def _pruned_sql(rounds: int) -> str:
    """pruned(u, v, m): branches of one or two vertices' depth go from vertices of degree three and more, all at once, so many times."""
    steps = ["t0 AS (SELECT u a, v b, m FROM forest UNION ALL SELECT v, u, m FROM forest)"]
    for k in range(rounds):
        steps += [
            f"deg{k} AS MATERIALIZED (SELECT a, count(*) d FROM t{k} GROUP BY a)",
            f"deep{k} AS MATERIALIZED (SELECT y.a v, y.b w FROM t{k} y JOIN deg{k} g ON g.a = y.b WHERE g.d > 1)",
            f"short{k} AS MATERIALIZED (SELECT x.a u, x.b v FROM t{k} x JOIN deg{k} g ON g.a = x.a WHERE g.d >= 3 AND NOT EXISTS (SELECT 1 FROM deep{k} z WHERE z.v = x.b AND z.w <> x.a))",
            f"lost{k} AS MATERIALIZED (SELECT v x FROM short{k} UNION SELECT y.b FROM short{k} s JOIN t{k} y ON y.a = s.v AND y.b <> s.u)",
            f"t{k + 1} AS MATERIALIZED (SELECT * FROM t{k} WHERE a NOT IN (SELECT x FROM lost{k}) AND b NOT IN (SELECT x FROM lost{k}))",
        ]
    return ", ".join([*steps, f"pruned AS (SELECT a u, b v, m FROM t{rounds} WHERE a < b)"])


PATH_SQL = {
    "prune": f"WITH RECURSIVE {INC}, {EDGES % EGO_M}, {_FOREST}, {_pruned_sql(8)} SELECT u, v, m FROM pruned",
    "spanning_forest": f"WITH RECURSIVE {INC}, {EDGES % EGO_M}, {_FOREST} SELECT u, v, m FROM forest",
    "adjacent_ends": f"""WITH {X.TILES_SQL}, {EDGES % TILE_M}, {_tile_paths_sql(gap=1)}, {_SYM}, sizes AS (SELECT tid, count(*) n FROM paths GROUP BY tid HAVING count(*) >= 2), ends AS (SELECT mol x, tid, tpos > 0 is_last FROM paths JOIN sizes USING (tid) WHERE tpos = 0 OR tpos = n - 1),
 hop AS (SELECT a, b FROM sym UNION SELECT s.a, t.b FROM sym s JOIN sym t ON t.a = s.b WHERE s.b NOT IN (SELECT mol FROM paths)) SELECT DISTINCT p.tid a, q.tid b, p.is_last a_last, q.is_last b_last FROM hop JOIN ends p ON p.x = hop.a JOIN ends q ON q.x = hop.b WHERE p.tid <> q.tid""",
    "bridge_evidence": f"WITH {X.TILES_SQL}, {_tile_paths_sql()}, {_ENDS}, {_EVIDENCE} SELECT a, a_end, b, b_end, bridges FROM evidence",
    "merge_links": f"WITH {X.TILES_SQL}, {_tile_paths_sql()}, {_ENDS}, {_EVIDENCE}, {_LINKS} SELECT a, a_end, b, b_end, bridges FROM links",
    # tiles in a row: every path is joined to the next, so one path holds them all in order
    "merge_paths": f"WITH {X.TILES_SQL}, {_tile_paths_sql()} SELECT CAST(0 AS BIGINT) tid, row_number() OVER (ORDER BY tid, tpos) - 1 tpos, mol FROM paths",
    "merge_adjacent": f"WITH {X.TILES_SQL}, {_tile_paths_sql(gap=1)} SELECT CAST(0 AS BIGINT) tid, row_number() OVER (ORDER BY tid, tpos) - 1 tpos, mol FROM paths",
    "spanning_forest_tiles": f"WITH RECURSIVE {X.TILES_SQL}, {EDGES % TILE_M}, {_FOREST} SELECT u, v, m FROM forest",
    "backbone_tiles": f"WITH {X.TILES_SQL} SELECT CAST(0 AS BIGINT) tid, row_number() OVER (ORDER BY bx) - 1 tpos, bx mol FROM (SELECT DISTINCT bx FROM inc)",
}
PATH_QUERIES: dict[str, Query] = {
    "spanning_forest": spanning_forest,
    "spanning_forest_tiles": spanning_forest_tiles,
    "prune": prune,
    "bridges_removed": bridges_removed,
    "backbone_tiles": backbone_tiles,
    "backbone_graph": backbone_graph,
    "adjacent_ends": adjacent_ends,
    "merge_adjacent": merge_adjacent,
    "bridge_evidence": bridge_evidence,
    "merge_links": merge_links,
    "merge_paths": merge_paths,
}

# --- Mapping, scaffolds, metrics, chains --------------------------------------


def _query_lists(s, d) -> DataFrame:
    """Queries that walk over the tiles: q i has minimizers 45 i to 45 i + 139, every third query backwards."""
    q = s.range(44).select(F.format_string("q%03d", "id").alias("name"), "id", F.posexplode(F.sequence(45 * F.col("id"), 45 * F.col("id") + 139)).alias("p", "mx"))
    return q.select("name", F.when(F.col("id") % 3 == 0, 139 - F.col("p")).otherwise(F.col("p")).alias("qpos"), "mx")


def _molecule_paths(s, d) -> DataFrame:
    """Tile paths whose molecules have a suffix, some two, some none."""
    n = F.col("tpos") % 3
    return _tile_paths(s, d).withColumn("mol", F.when(n == 0, F.col("mol")).when(n == 1, F.concat("mol", F.lit("_0"))).otherwise(F.concat("mol", F.lit("_0_1"))))


def _index(s, d) -> DataFrame:
    return mapping.backbone_index(_molecule_paths(s, d), X.tiles(s, d))


def backbone_index(s, d):
    return _index(s, d)


def map_bed(s, d):
    return mapping.map_to_backbone(_query_lists(s, d), _index(s, d), 10)


def bed_to_path(s, d):
    return mapping.bed_to_paths(map_bed(s, d), 10)


def map_paf(s, d):
    return mapping.map_paf(_query_lists(s, d), _index(s, d), _molecule_paths(s, d), 10)


def paf_top_n(s, d):
    return mapping.paf_top_n(map_paf(s, d), 3)


def _scaffold_paths(s, d) -> DataFrame:
    c = X.contigs(s, d).select("name", "ord")
    i = F.col("ord")
    return c.where(i % 5 != 4).select(F.floor(i / 7).alias("tid"), (i % 7).cast("long").alias("ord"), "name", F.when(i % 4 == 1, "-").when(i % 6 == 2, ".").otherwise("+").alias("orientation"))


def scaffolds(s, d):
    return scaffold.scaffolds(X.contigs(s, d), _scaffold_paths(s, d), ScaffoldParams(gap=10))


def assembly_metrics(s, d):
    return scaffold.assembly_metrics(X.contigs(s, d), 100_000)


def document_metrics(s, d):
    return scaffold.length_metrics(X.table(s, d, "documents").select(F.col("n_chars").alias("length")), 5_000_000)


def path_metrics(s, d):
    sized = X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("tid"))
    return scaffold.path_metrics(sized, 50_000, 2)


def _paf(s, d) -> DataFrame:
    """Orders as PAF rows: priorities and months as queries and targets."""
    o = X.table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("qname"), F.lit(100_000).cast("long").alias("qlength"), (k * 20).alias("qstart"), (k * 20 + 30 + k % 50).alias("qend"),
        F.when(F.col("o_custkey") % 5 == 0, "-").when(F.col("o_custkey") % 7 == 0, ".").otherwise("+").alias("orientation"), (F.col("o_custkey") % 4).cast("string").alias("tname"), (F.lit(40).cast("long") + F.col("o_custkey") % 4 * 10).alias("tlength"),
        k.alias("tstart"), (k + 1).alias("tend"), (k % 17 + 1).alias("score"), (30 + k % 50).alias("length"), (k % 6).alias("mapq"),
    )


def paf_rows(s, d):
    return chain.report_rows(_paf(s, d)).select("qname", "tname", "tstart", "mapq", "tlength")


def paf_dedupe(s, d):
    return chain.best_by_place(_paf(s, d).withColumns({"tstart": F.floor(F.col("tstart") / 40), "tend": F.floor(F.col("tstart") / 40) + 1}))


def paf_chain(s, d):
    return chain.chain_alignments(_paf(s, d), query_gap=150, target_gap=60, min_rows=10, fallback=3)


def chain_top(s, d):
    return chain.top_targets(paf_chain(s, d), 3)


def _points(s, d) -> DataFrame:
    c = X.contigs(s, d).select(F.col("name").alias("chrom"), "ord")
    return c.select("chrom", (F.lit(200) + F.col("ord") % 3).cast("long").alias("qlength"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(400).cast("long"), F.lit(7).cast("long"))).alias("x"))


def mx_to_bp(s, d):
    return chain.places_to_bp(_points(s, d), index_positions(s, d)).withColumn("bp", F.round("bp", 4))


def orientation_rule(s, d):
    """All cases of medians below 3, unknown ones included."""
    v = s.range(4).select(F.when(F.col("id") < 3, F.col("id")).alias("x"))
    grid = v.select(F.col("x").alias("p")).crossJoin(v.where("x is not null").select(F.col("x").alias("q"))).crossJoin(v.select(F.col("x").alias("r")))  # 48 rows
    return grid.select("p", "q", "r", mapping.orientation(F.col("p"), F.col("q"), F.col("r")).alias("orientation"))


def oriented_names(s, d):
    t = C.oriented(F.col("name"), F.col("orientation"))
    return _scaffold_paths(s, d).select(t.alias("token"), C.oriented_name(t).alias("name"), C.orientation_of(t).alias("orientation"))


_O = """CASE WHEN {0} IS NOT NULL AND {2} IS NOT NULL THEN CASE WHEN {0} = {1} AND {1} = {2} THEN '.' WHEN {0} <= {1} AND {1} <= {2} THEN '+' WHEN {0} >= {1} AND {1} >= {2} THEN '-' ELSE '.' END
 WHEN {0} IS NOT NULL THEN CASE WHEN {0} = {1} THEN '.' WHEN {0} < {1} THEN '+' ELSE '-' END WHEN {2} IS NOT NULL THEN CASE WHEN {1} = {2} THEN '.' WHEN {1} < {2} THEN '+' ELSE '-' END ELSE '.' END"""
_Q = "lists AS (SELECT printf('q%03d', id) name, CASE WHEN id % 3 = 0 THEN 139 - p ELSE p END qpos, 45 * id + p mx FROM range(44) a(id), range(140) b(p))"
_MP = f"{_tile_paths_sql()}, mpaths AS (SELECT tid, tpos, mol || CASE tpos % 3 WHEN 0 THEN '' WHEN 1 THEN '_0' ELSE '_0_1' END mol FROM paths), idx AS (SELECT mx, tid, tpos FROM mpaths JOIN inc ON bx = regexp_replace(mol, '(_[^_]*)+$', ''))"
_HITS = "hits AS (SELECT name qname, tid, tpos, count(*) score, list_sort(list(qpos)) qs FROM lists JOIN idx USING (mx) GROUP BY 1, 2, 3)"
_NEAR = "RANGE BETWEEN {0} {1} AND {0} {1}"
_BED = f"""{_HITS}, med AS (SELECT *, qs[(len(qs) - 1) // 2 + 1] m FROM hits), near AS (SELECT *, first(m) OVER (PARTITION BY qname, tid ORDER BY tpos {_NEAR.format(1, 'PRECEDING')}) p, first(m) OVER (PARTITION BY qname, tid ORDER BY tpos {_NEAR.format(1, 'FOLLOWING')}) r FROM med),
 bed AS (SELECT tid tname, tpos tstart, tpos + 1 tend, qname, score, {_O.format('p', 'm', 'r')} orientation FROM near WHERE score >= 10)"""
_RANK = "qs[CAST(floor({0} * (len(qs) - 1) + 0.5) AS BIGINT) + 1]"
_PAF = f"""{_HITS}, qq AS (SELECT *, {_RANK.format(0.25)} q25, {_RANK.format(0.5)} q50, {_RANK.format(0.75)} q75 FROM hits), near AS (SELECT *, first(q50) OVER (PARTITION BY qname, tid ORDER BY tpos {_NEAR.format(1, 'PRECEDING')}) p, first(q50) OVER (PARTITION BY qname, tid ORDER BY tpos {_NEAR.format(1, 'FOLLOWING')}) r FROM qq),
 w AS (SELECT *, greatest(qs[1], greatest(q25 - CAST(floor(1.5 * (q75 - q25)) AS BIGINT), 0)) qstart, least(qs[len(qs)], q75 + CAST(floor(1.5 * (q75 - q25)) AS BIGINT)) qend FROM near WHERE score >= 10),
 paf AS (SELECT qname, (SELECT count(*) FROM lists l WHERE l.name = w.qname) qlength, qstart, qend, {_O.format('p', 'q50', 'r')} orientation, CAST(tid AS VARCHAR) tname, (SELECT count(*) FROM mpaths z WHERE z.tid = w.tid) tlength, tpos tstart, tpos + 1 tend, score, greatest(qend - qstart, 1) AS length, least(255, 100 * score // greatest(qend - qstart, 1)) mapq FROM w)"""
_SP = "spaths AS (SELECT ord // 7 tid, ord % 7 o, name, CASE WHEN ord % 4 = 1 THEN '-' WHEN ord % 6 = 2 THEN '.' ELSE '+' END orientation FROM contigs WHERE ord % 5 <> 4)"
_METRICS = """lens AS ({0}), run AS (SELECT length, sum(length) OVER (ORDER BY length DESC, i) upto, row_number() OVER (ORDER BY length DESC, i) r, sum(length) OVER () total, count(*) OVER () n FROM lens)
 SELECT count(*) n, CAST(coalesce(sum(length), 0) AS BIGINT) total, max(length) max, min(length) min, avg(length) mean, max(length) FILTER (upto >= floor(0.5 * total)) n50, max(length) FILTER (upto >= floor(0.75 * total)) n75,
 coalesce(min(r) FILTER (upto >= floor(0.5 * total)), max(n)) l50, coalesce(min(r) FILTER (upto >= floor(0.75 * total)), max(n)) l75, coalesce(max(length) FILTER (upto >= {1}), 0) ng50, coalesce(max(length) FILTER (upto >= {2}), 0) ng75 FROM run"""
_PAF_ROWS = """rows_ AS (SELECT 'chr' || (o_custkey % 3 + 1) qname, CAST(100000 AS BIGINT) qlength, o_orderkey * 20 qstart, o_orderkey * 20 + 30 + o_orderkey % 50 qend, CASE WHEN o_custkey % 5 = 0 THEN '-' WHEN o_custkey % 7 = 0 THEN '.' ELSE '+' END orientation,
 CAST(o_custkey % 4 AS VARCHAR) tname, 40 + o_custkey % 4 * 10 tlength, o_orderkey tstart, o_orderkey + 1 tend, o_orderkey % 17 + 1 score, 30 + o_orderkey % 50 AS length, o_orderkey % 6 mapq FROM orders)"""
_MEET = "({2} <= {1} AND {0} <= {3})"
_W = "(PARTITION BY qname, tname ORDER BY tstart, qstart, qend)"
_GAP = "CASE WHEN {4} THEN 0 ELSE greatest({2} - {1}, {0} - {3}) END"
_CHAIN = f"""f AS (SELECT *, lag(qstart) OVER {_W} ps, lag(qend) OVER {_W} pe, lead(qstart) OVER {_W} ns, lead(qend) OVER {_W} ne FROM rows_ WHERE mapq >= 1), k AS (SELECT * EXCLUDE (ps, pe, ns, ne) FROM f WHERE coalesce({_MEET.format('ps', 'pe', 'qstart', 'qend')}, false) OR coalesce({_MEET.format('qstart', 'qend', 'ns', 'ne')}, false)),
 g AS (SELECT *, lag(qstart) OVER {_W} a, lag(qend) OVER {_W} b, lag(tstart) OVER {_W} c, lag(tend) OVER {_W} d FROM k), n AS (SELECT *, coalesce({_GAP.format('a', 'b', 'qstart', 'qend', _MEET.format('a', 'b', 'qstart', 'qend'))} >= 150 OR {_GAP.format('c', 'd', 'tstart', 'tend', _MEET.format('c', 'd', 'tstart', 'tend'))} >= 60, false) fresh FROM g),
 p AS (SELECT *, sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY qname, tname ORDER BY tstart, qstart, qend ROWS UNBOUNDED PRECEDING) segment FROM n),
 vote AS (SELECT qname, tname, segment, orientation, count(*) c, min((tstart, qstart, qend)) f FROM p GROUP BY ALL), best AS (SELECT qname, tname, segment, arg_min(orientation, (-c, f)) orientation FROM vote GROUP BY ALL),
 seg AS (SELECT qname, tname, CAST(segment AS BIGINT) segment, min(qlength) qlength, min(qstart) qstart, max(qend) qend, min(tlength) tlength, min(tstart) tstart, max(tend) tend, CAST(sum(score) AS BIGINT) score, CAST(sum(length) AS BIGINT) AS length, list_sort(list(mapq))[count(*) // 2 + 1] mapq, count(*) barcodes FROM p GROUP BY ALL),
 top AS (SELECT max(barcodes) t FROM seg), chained AS (SELECT seg.*, orientation FROM seg JOIN best ON best.qname = seg.qname AND best.tname = seg.tname AND best.segment = seg.segment, top WHERE barcodes >= CASE WHEN t >= 10 THEN 10 ELSE 3 END)"""
_POSITIONS = SEQ_SQL["index_positions"].removeprefix("WITH ").replace("SELECT name AS chrom, i AS mx_index", "positions AS (SELECT name AS chrom, i AS mx_index").replace("FROM g JOIN contigs", "FROM g JOIN contigs")
_POSITIONS = _POSITIONS.replace(" positions AS", ", positions AS", 1) + ")"

MAP_SQL = {
    "backbone_index": f"WITH {X.TILES_SQL}, {_MP} SELECT mx, tid, tpos FROM idx",
    "map_bed": f"WITH {X.TILES_SQL}, {_MP}, {_Q}, {_BED} SELECT * FROM bed",
    "bed_to_path": f"""WITH {X.TILES_SQL}, {_MP}, {_Q}, {_BED}, per AS (SELECT qname, tname, count(*) n, quantile_disc(tstart, 0.5) mid FROM bed GROUP BY 1, 2), best AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY qname ORDER BY n DESC, tname) = 1),
 votes AS (SELECT qname, tname, orientation, count(*) c FROM bed GROUP BY 1, 2, 3), tops AS (SELECT *, rank() OVER (PARTITION BY qname, tname ORDER BY c DESC) k FROM votes), vote AS (SELECT qname, tname, CASE WHEN count(*) = 1 THEN min(orientation) ELSE '.' END orientation FROM tops WHERE k = 1 GROUP BY 1, 2)
 SELECT tname tid, row_number() OVER (PARTITION BY tname ORDER BY mid, qname) - 1 ord, qname name, orientation FROM best JOIN vote USING (qname, tname)""",
    "map_paf": f"WITH {X.TILES_SQL}, {_MP}, {_Q}, {_PAF} SELECT * FROM paf",
    "paf_top_n": f"WITH {X.TILES_SQL}, {_MP}, {_Q}, {_PAF}, top AS (SELECT tname FROM paf GROUP BY tname ORDER BY sum(score) DESC, tname LIMIT 3) SELECT * FROM paf SEMI JOIN top USING (tname)",
    "scaffolds": f"""WITH {X.CONTIGS_SQL}, {_SP}, ok AS (SELECT tid FROM spaths GROUP BY tid HAVING bool_or(orientation <> '.')), used AS (SELECT s.*, CASE WHEN orientation = '-' THEN reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn')) ELSE seq END part FROM spaths s SEMI JOIN ok USING (tid) JOIN contigs USING (name)),
 made AS (SELECT 0 kind, tid key, '' cname, string_agg(part, 'NNNNNNNNNN' ORDER BY o) seq, count(*) xn FROM used GROUP BY tid), every AS (SELECT * FROM made UNION ALL SELECT 1, 0, name, seq, 1 FROM contigs WHERE name NOT IN (SELECT name FROM used)), num AS (SELECT *, CAST(row_number() OVER (ORDER BY kind, key, cname) - 1 AS INTEGER) id FROM every)
 SELECT id, printf('%07d', id) || ' LN:i:' || length(seq) || ' xn:i:' || xn AS name, seq FROM num""",
    "assembly_metrics": f"WITH {X.CONTIGS_SQL}, " + _METRICS.format("SELECT length(seq) AS length, ord i FROM contigs", 50_000, 75_000),
    "document_metrics": "WITH " + _METRICS.format("SELECT n_chars AS length, doc_id i FROM documents", 2_500_000, 3_750_000),
    "path_metrics": "WITH " + _METRICS.format("SELECT count(*) AS length, l_orderkey i FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2", 25_000, 37_500),
    "paf_rows": f"WITH {_PAF_ROWS} SELECT qname, tname, tstart, mapq, tlength FROM rows_ WHERE mapq >= 1 AND tlength >= 50",
    "paf_dedupe": f"WITH {_PAF_ROWS}, b AS (SELECT * REPLACE (tstart // 40 AS tstart, tstart // 40 + 1 AS tend) FROM rows_) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY tname, tstart ORDER BY score DESC, qname, qstart) = 1",
    "paf_chain": f"WITH {_PAF_ROWS}, {_CHAIN} SELECT * FROM chained",
    "chain_top": f"WITH {_PAF_ROWS}, {_CHAIN} SELECT tname, CAST(sum(barcodes) AS BIGINT) barcodes FROM chained GROUP BY tname ORDER BY barcodes DESC, tname LIMIT 3",
    "mx_to_bp": f"""WITH {_POSITIONS}, pts AS (SELECT name chrom, 200 + ord % 3 qlength, unnest(range(0, 401, 7)) x FROM contigs), tot AS (SELECT chrom, max(total) total FROM positions GROUP BY chrom), sc AS (SELECT p.*, CASE WHEN total IS NOT NULL AND total <> 0 AND qlength <> total THEN x * (total / qlength) ELSE CAST(x AS DOUBLE) END s FROM pts p LEFT JOIN tot USING (chrom)),
 seg AS (SELECT chrom, mx_index m0, bp b0, lead(mx_index) OVER (PARTITION BY chrom ORDER BY mx_index) m1, lead(bp) OVER (PARTITION BY chrom ORDER BY mx_index) b1, min(mx_index) OVER (PARTITION BY chrom) lo FROM positions)
 SELECT sc.chrom, x, qlength, round(CASE WHEN s < lo THEN CAST(b0 AS DOUBLE) WHEN m1 IS NULL THEN b0 ELSE b0 + (s - m0) / (m1 - m0) * (b1 - b0) END, 4) bp FROM sc JOIN seg ON seg.chrom = sc.chrom AND (s >= m0 AND (m1 IS NULL OR s < m1) OR s < lo AND m0 = lo)""",
    "orientation_rule": f"WITH v AS (SELECT nullif(x, 3) x FROM range(4) t(x)) SELECT a.x p, b.x q, c.x r, {_O.format('a.x', 'b.x', 'c.x')} orientation FROM v a, v b, v c WHERE b.x IS NOT NULL",
    "oriented_names": f"WITH {X.CONTIGS_SQL}, {_SP} SELECT name || orientation AS token, name, orientation FROM spaths",
}
MAP_QUERIES: dict[str, Query] = {
    "backbone_index": backbone_index,
    "map_bed": map_bed,
    "bed_to_path": bed_to_path,
    "map_paf": map_paf,
    "paf_top_n": paf_top_n,
    "scaffolds": scaffolds,
    "assembly_metrics": assembly_metrics,
    "document_metrics": document_metrics,
    "path_metrics": path_metrics,
    "paf_rows": paf_rows,
    "paf_dedupe": paf_dedupe,
    "paf_chain": paf_chain,
    "chain_top": chain_top,
    "mx_to_bp": mx_to_bp,
    "orientation_rule": orientation_rule,
    "oriented_names": oriented_names,
}


def queries() -> dict[str, Query]:
    return {"flagship": flagship} | SET_QUERIES | SEQ_QUERIES | MOL_QUERIES | PATH_QUERIES | MAP_QUERIES


def oracle_sql() -> dict[str, str]:
    flag = f"""WITH {INC.replace('inc AS', 'a0 AS')}, d0 AS (SELECT mx FROM a0 GROUP BY mx HAVING count(*) >= 2), a1 AS (SELECT bx, mx FROM a0 JOIN d0 USING (mx)), s1 AS (SELECT bx FROM a1 GROUP BY bx HAVING count(*) >= {MIN_N} AND count(*) < {MAX_N}), a2 AS (SELECT bx, mx FROM a1 JOIN s1 USING (bx)),
 df AS (SELECT mx, count(*) df FROM a2 GROUP BY mx), {THRESHOLD}, inc AS (SELECT bx, mx FROM a2 JOIN df USING (mx), thr WHERE df < threshold), {EDGES_ONCE % MIN_M}, {AT_RANK % 50} SELECT u, v, m FROM edges WHERE m >= (SELECT least_m FROM t)"""
    return {"flagship": flag} | SET_SQL | SEQ_SQL | MOL_SQL | PATH_SQL | MAP_SQL
