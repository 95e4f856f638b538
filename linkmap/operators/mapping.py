"""Queries mapped to backbone positions by the minimizers they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmap.functions import columns as C
from linkmap.functions.order_stats import median_low, nearest_rank


def backbone_index(paths: DataFrame, inc: DataFrame) -> DataFrame:
    """(mx, tid, tpos): each position's minimizers, by its molecule's name, else by the name less one and less two suffixes; the first name that inc has a row for counts, even one without mx."""
    names = inc.select("bx").distinct()
    one, two = C.barcode_of_molecule(F.col("mol")), C.barcode_of_molecule(C.barcode_of_molecule(F.col("mol")))
    tried = paths.select("tid", "tpos", F.posexplode(F.array_distinct(F.array("mol", one, two))).alias("level", "bx"))
    found = tried.join(names, "bx", "left_semi").groupBy("tid", "tpos").agg(F.min_by("bx", "level").alias("bx"))
    return found.join(inc.where("mx is not null"), "bx").select("mx", "tid", "tpos")


def orientation(before: Column, here: Column, after: Column) -> Column:
    """From the median query positions at a place and its neighbours: + if they rise, - if they fall, . if neither or unknown."""
    three = F.when((before == here) & (here == after), ".").when((before <= here) & (here <= after), "+").when((before >= here) & (here >= after), "-").otherwise(".")
    pair = lambda x, y: F.when(x == y, ".").when(x < y, "+").otherwise("-")
    return F.when(before.isNotNull() & after.isNotNull(), three).when(before.isNotNull(), pair(before, here)).when(after.isNotNull(), pair(here, after)).otherwise(".")


def _neighbours(hits: DataFrame, column: str) -> DataFrame:
    by = W.partitionBy("qname", "tid").orderBy("tpos")
    return hits.withColumns({"__before": F.first(column).over(by.rangeBetween(-1, -1)), "__after": F.first(column).over(by.rangeBetween(1, 1))})


def _hits(lists: DataFrame, index: DataFrame) -> DataFrame:
    return lists.select(F.col("name").alias("qname"), "qpos", "mx").join(index, "mx")


def map_to_backbone(lists: DataFrame, index: DataFrame, min_score: int) -> DataFrame:
    """BED rows: positions with at least min_score shared minimizers; neighbours below it still tell the orientation."""
    hits = _hits(lists, index).groupBy("qname", "tid", "tpos").agg(F.count(F.lit(1)).alias("score"), median_low(F.col("qpos")).alias("med"))
    o = orientation(F.col("__before"), F.col("med"), F.col("__after"))
    return _neighbours(hits, "med").where(F.col("score") >= min_score).select(F.col("tid").alias("tname"), F.col("tpos").alias("tstart"), (F.col("tpos") + 1).alias("tend"), "qname", "score", o.alias("orientation"))


def bed_to_paths(bed: DataFrame, min_score: int) -> DataFrame:
    """(tid, ord, name, orientation): each query at the path where it has most rows, by its median place."""
    rows = bed.where(F.col("score") >= min_score)
    per = rows.groupBy("qname", "tname").agg(F.count(F.lit(1)).alias("n"), median_low(F.col("tstart")).alias("at"))
    best = per.withColumn("r", F.row_number().over(W.partitionBy("qname").orderBy(F.desc("n"), "tname"))).where("r = 1")
    votes = rows.groupBy("qname", "tname", "orientation").agg(F.count(F.lit(1)).alias("c"))
    vote = votes.groupBy("qname", "tname").agg(F.max("c").alias("top"), F.collect_list(F.struct("c", "orientation")).alias("all"))
    top = F.filter("all", lambda x: x["c"] == F.col("top"))
    vote = vote.select("qname", "tname", F.when(F.size(top) == 1, top[0]["orientation"]).otherwise(".").alias("orientation"))
    return best.join(vote, ["qname", "tname"]).select(F.col("tname").alias("tid"), (F.row_number().over(W.partitionBy("tname").orderBy("at", "qname")) - 1).cast("long").alias("ord"), F.col("qname").alias("name"), "orientation")


def map_paf(lists: DataFrame, index: DataFrame, paths: DataFrame, min_score: int, coef: float = 1.5) -> DataFrame:
    """PAF rows, query ends from quartiles and whiskers of the shared minimizers' places."""
    q = F.array_sort(F.collect_list("qpos"))
    hits = _hits(lists, index).groupBy("qname", "tid", "tpos").agg(F.count(F.lit(1)).alias("score"), q.alias("qs"))
    hits = hits.withColumns({"q25": nearest_rank(F.col("qs"), 0.25), "q50": nearest_rank(F.col("qs"), 0.5), "q75": nearest_rank(F.col("qs"), 0.75)})
    whisker = F.floor(F.lit(coef) * (F.col("q75") - F.col("q25"))).cast("long")
    rows = _neighbours(hits, "q50").where(F.col("score") >= min_score).withColumns({
        "qstart": F.greatest(F.element_at("qs", 1).cast("long"), F.greatest(F.col("q25") - whisker, F.lit(0))),
        "qend": F.least(F.element_at("qs", -1).cast("long"), F.col("q75") + whisker),
    })
    length = F.greatest(F.col("qend") - F.col("qstart"), F.lit(1))
    qlen = lists.groupBy(F.col("name").alias("qname")).agg(F.count(F.lit(1)).alias("qlength"))
    tlen = paths.groupBy("tid").agg(F.count(F.lit(1)).alias("tlength"))
    return rows.join(qlen, "qname").join(tlen, "tid").select(
        "qname", "qlength", "qstart", "qend", orientation(F.col("__before"), F.col("q50"), F.col("__after")).alias("orientation"), F.col("tid").cast("string").alias("tname"), "tlength",
        F.col("tpos").alias("tstart"), (F.col("tpos") + 1).alias("tend"), "score", length.alias("length"), F.least(F.lit(255), F.floor(100 * F.col("score") / length)).cast("long").alias("mapq"),
    )


def paf_top_n(paf: DataFrame, n: int) -> DataFrame:
    """All rows of the n targets with the greatest total score; 0 keeps all."""
    if n == 0:
        return paf
    return paf.join(F.broadcast(paf.groupBy("tname").agg(F.sum("score").alias("s")).orderBy(F.desc("s"), "tname").limit(n).select("tname")), "tname", "left_semi")  # n names
