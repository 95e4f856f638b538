"""Writers of the text formats: a folder of part files in order, or one file where asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmap.functions.columns import to_unsigned_text, unsigned_order


def write_lines(lines: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """Column line, in order; one_file puts everything through one task and is for small results."""
    out = lines.orderBy(*order).select("line")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def minimizer_lines(inc: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(name, line): a set's hashes ascending as unsigned numbers; names in empty (column bx) that have none give the name alone."""
    rows = inc.groupBy(F.col("bx").alias("name")).agg(F.array_sort(F.collect_set(F.struct(unsigned_order(F.col("mx")).alias("o"), "mx"))).alias("x"))
    out = rows.select("name", F.concat_ws("\t", "name", F.array_join(F.transform("x", lambda e: to_unsigned_text(e["mx"])), " ")).alias("line"))
    if empty is not None:
        none = empty.select(F.col("bx").alias("name")).distinct().join(rows, "name", "left_anti")
        out = out.unionByName(none.select("name", F.col("name").alias("line")))
    return out


def list_lines(lists: DataFrame, name: str = "name") -> DataFrame:
    """(name, line) in list order; a name whose only mx is null keeps its empty row."""
    rows = lists.groupBy(F.col(name).alias("name")).agg(F.array_sort(F.collect_list(F.when(F.col("mx").isNotNull(), F.struct("qpos", "mx")))).alias("x"))
    return rows.select("name", F.concat("name", F.lit("\t"), F.array_join(F.transform("x", lambda e: to_unsigned_text(e["mx"])), " ")).alias("line"))


def graph_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, a, b, line): both sections with their headers, sorted by name."""
    spark = vertices.sparkSession
    mol = "mol" in vertices.columns
    heads = spark.createDataFrame([(0, "", "", "U\tm" + "\tmol" * mol), (2, "", "", "U\tV\tm")], "section int, a string, b string, line string")
    v = vertices.select(F.lit(1).alias("section"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat_ws("\t", "id", F.col("m").cast("string"), *([F.coalesce(F.col("mol").cast("string"), F.lit(""))] if mol else [])).alias("line"))
    u, w = F.least("u", "v"), F.greatest("u", "v")
    e = edges.select(F.lit(3).alias("section"), u.alias("a"), w.alias("b"), F.concat_ws("\t", u, w, F.col("m").cast("string")).alias("line"))
    return heads.unionByName(v).unionByName(e)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    write_lines(graph_lines(vertices, edges), path, ["section", "a", "b"], one_file=True)


def tabbed(rows: DataFrame, *order: str) -> DataFrame:
    return rows.select(*order, F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    """(id, line): a header and a sequence on one line."""
    return seqs.select("id", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("line"))


def oriented_path_lines(paths: DataFrame) -> DataFrame:
    """(tid, line): contig names with their orientation, blanks between."""
    x = F.array_sort(F.collect_list(F.struct("ord", F.concat("name", "orientation").alias("t"))))
    return paths.groupBy("tid").agg(F.array_join(F.transform(x, lambda e: e["t"]), " ").alias("line"))


def histogram_lines(hist: DataFrame, k: int) -> DataFrame:
    """(mult, line): a header, then rows with an empty first column; empty bins are left out."""
    head = hist.sparkSession.createDataFrame([(-1, "k\tcount\tfrequency")], "mult long, line string")
    return head.unionByName(hist.where("freq > 0").select(F.col("mult").cast("long").alias("mult"), F.concat_ws("\t", F.lit(""), F.col("mult").cast("string"), F.col("freq").cast("string")).alias("line")))
