"""Relations derived from the test tables, each with the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, W = 16, 8

# --- SQL ------------------------------------------------------------------

#: Customers and the parts that they bought.
BOUGHT_SQL = "inc AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) bx, l_partkey mx FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
#: The same with the quantity's last digit in the key, which leaves some keys alone.
BOUGHT_FINE_SQL = "inc AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) bx, l_partkey * 10 + CAST(l_quantity AS BIGINT) % 10 mx FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
#: Barcodes that tile a line.
TILES_SQL = "inc AS (SELECT printf('b%04d', b) bx, mx FROM (SELECT b, unnest(range(5 * b, 5 * b + 40)) mx FROM range(400) t(b)))"

#: Contigs of 50 parts' digests each, a base for each hexadecimal digit.
CONTIGS_SQL = """contigs AS (
  SELECT printf('c%05d', c) AS name, string_agg(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS seq, c AS ord
  FROM (SELECT p_partkey, p_partkey // 50 AS c FROM part) GROUP BY c)"""
#: A read for each order: some in lower case, some with an N.
READS_SQL = CONTIGS_SQL + """, n_contigs AS (SELECT count(*) n FROM contigs), raw_reads AS (
  SELECT o_orderkey AS rec_no, CAST(o_custkey AS VARCHAR) AS cust, substr(seq, CAST((37 * o_orderkey) % (length(seq) - 150) AS BIGINT) + 1, 150) AS s
  FROM orders, n_contigs JOIN contigs ON true WHERE ord = o_orderkey % n), reads AS (
  SELECT rec_no,
    CASE rec_no % 4 WHEN 0 THEN 'r' || rec_no || ' BX:Z:' || cust || '-1' WHEN 1 THEN 'r' || rec_no || '#' || cust || '_1_2 x' WHEN 2 THEN 'r' || rec_no || '#0_0_0' ELSE 'r' || rec_no END AS header,
    CASE WHEN rec_no % 7 = 0 THEN lower(s) WHEN rec_no % 11 = 0 THEN substr(s, 1, 75) || 'N' || substr(s, 77) ELSE s END AS seq
  FROM raw_reads)"""
BARCODE_SQL = """CASE WHEN regexp_matches(header, '(^|\\s)BX:Z:') THEN regexp_extract(header, '(^|\\s)BX:Z:(\\S*)', 2)
  WHEN regexp_extract(header, '^[^#]*#(\\S*)', 1) NOT IN ('', '0', '0_0_0') THEN regexp_extract(header, '^[^#]*#(\\S*)', 1) END"""
TOKEN_SQL = "regexp_extract(header, '^\\s*(\\S*)', 1)"


def _mixed_sql() -> str:
    """SELECT all of coded, and x: the mix of code, unsigned."""
    steps = [
        "(CAST(18446744073709551615 AS UHUGEINT) - x + x * 2097152) % m",
        "CAST(xor(CAST(x AS UBIGINT), CAST(x // 16777216 AS UBIGINT)) AS UHUGEINT)",
        "(x + x * 8 % m + x * 256 % m) % m",
        "CAST(xor(CAST(x AS UBIGINT), CAST(x // 16384 AS UBIGINT)) AS UHUGEINT)",
        "(x + x * 4 % m + x * 16 % m) % m",
        "CAST(xor(CAST(x AS UBIGINT), CAST(x // 268435456 AS UBIGINT)) AS UHUGEINT)",
        "(x + x * 2147483648) % m",
    ]
    chain = "SELECT *, CAST(code AS UHUGEINT) AS x FROM coded"
    for s in steps:
        chain = f"SELECT * REPLACE ({s.replace('% m', '% CAST(18446744073709551616 AS UHUGEINT)')} AS x) FROM ({chain})"
    return chain


def long_kmers_sql(source: str, keys: str, k: int) -> str:
    """kmers(keys, pos, h) for more than 32 bases: the lesser hash of both strands' letters, mixed; letters keep their case."""
    fnv = "CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, %d + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS UHUGEINT))), lambda a, b: (CAST(xor(CAST(a AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211) %% CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT)" % k
    return f"""all_kmers AS (SELECT {keys}, pos, substr(seq, pos + 1, {k}) AS s FROM (SELECT *, unnest(range(length(seq) - {k} + 1)) AS pos FROM {source} WHERE length(seq) >= {k})),
 good AS (SELECT * FROM all_kmers WHERE regexp_full_match(s, '[ACGTacgt]+')),
 coded AS (SELECT s, least({fnv.format('s')}, {fnv.format("reverse(translate(upper(s), 'ACGT', 'TGCA'))")}) AS code FROM (SELECT DISTINCT s FROM good)),
 mixed AS (SELECT s, CAST(x AS UBIGINT) AS h FROM ({_mixed_sql()})), kmers AS (SELECT {keys}, pos, h FROM good JOIN mixed USING (s))"""


def kmers_sql(source: str, keys: str, k: int = K) -> str:
    """kmers(keys, pos, code, h): canonical codes and their mix, unsigned; bases compare as their codes do."""
    chain = _mixed_sql()
    return f"""all_kmers AS (SELECT {keys}, pos, upper(substr(seq, pos + 1, {k})) AS s FROM (SELECT *, unnest(range(length(seq) - {k} + 1)) AS pos FROM {source} WHERE length(seq) >= {k})),
 good AS (SELECT *, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS c FROM all_kmers WHERE regexp_full_match(s, '[ACGT]+')),
 codes AS (SELECT c, CAST(list_sum(list_transform(range({k}), lambda i: (instr('ACGT', substr(c, {k} - i, 1)) - 1) * (CAST(1 AS HUGEINT) << (2 * i)))) AS UBIGINT) AS code FROM (SELECT DISTINCT c FROM good)),
 coded AS (SELECT c, code FROM codes),
 mixed AS (SELECT c, code, CAST(x AS UBIGINT) AS h FROM ({chain})),
 kmers AS (SELECT {keys}, pos, code, h FROM good JOIN mixed USING (c))"""


def minimizers_sql(keys: str, w: int = W, least: bool = False) -> str:
    """firsts(keys, pos, h, n): the leftmost minimum of each window of w k-mers that are left."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM kmers),
 wins AS (SELECT *, min(struct_pack(h := h, pos := pos)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m FROM numbered),
 firsts AS (SELECT {keys}, i, m.h AS h, m.pos AS mpos FROM wins WHERE i <= {"greatest(n - %d, 1)" % (w - 1) if least else "n - %d" % (w - 1)})"""


SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN CAST({0} AS HUGEINT) - 18446744073709551616 ELSE CAST({0} AS HUGEINT) END AS BIGINT)"


def signed(c: str) -> str:
    return SIGNED.format(c)


# --- DataFrames -----------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sold(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("bx"), F.col("l_partkey").alias("mx")).distinct()


def bought_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sold(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("bx"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long") % 10).alias("mx")).distinct()


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(400).select(F.format_string("b%04d", "id").alias("bx"), F.explode(F.sequence(5 * F.col("id"), 5 * F.col("id") + 39)).alias("mx"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 50).alias("ord"))
    bases = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    x = F.array_sort(F.collect_list(F.struct("p_partkey", bases.alias("s"))))
    return p.groupBy("ord").agg(F.array_join(F.transform(x, lambda e: e["s"]), "").alias("seq")).select(F.format_string("c%05d", "ord").alias("name"), "seq", F.col("ord").cast("long").alias("ord"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contigs(spark, sf_dir)
    n = c.agg(F.count(F.lit(1)).alias("n"))  # one row
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_no"), F.col("o_custkey").cast("string").alias("cust")).join(F.broadcast(n)).withColumn("ord", F.col("rec_no") % F.col("n"))
    # a small table comes in one partition; reads are for all cores, and orders are smaller to move
    o = o.repartition(2 * spark.sparkContext.defaultParallelism, "ord")
    met = o.join(c, "ord").withColumn("s", F.substring("seq", ((37 * F.col("rec_no")) % (F.length("seq") - 150) + 1).cast("int"), F.lit(150)))
    r, cust, s = F.concat(F.lit("r"), F.col("rec_no")), F.col("cust"), F.col("s")
    header = F.when(F.col("rec_no") % 4 == 0, F.concat(r, F.lit(" BX:Z:"), cust, F.lit("-1"))).when(F.col("rec_no") % 4 == 1, F.concat(r, F.lit("#"), cust, F.lit("_1_2 x"))).when(F.col("rec_no") % 4 == 2, F.concat(r, F.lit("#0_0_0"))).otherwise(r)
    seq = F.when(F.col("rec_no") % 7 == 0, F.lower(s)).when(F.col("rec_no") % 11 == 0, F.concat(F.substring(s, 1, 75), F.lit("N"), F.substring(s, 77, 150))).otherwise(s)
    return met.select("rec_no", header.alias("header"), seq.alias("seq"))
