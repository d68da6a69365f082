"""Metrics of ranked lists against graded relevance (qid, id, grade) and citation groups (qid, group_no, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The polynomial of the normal distribution function.
PHI = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911]


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal by the classic five-term polynomial; absolute error under 2e-7."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + PHI[5] * z)
    poly = t * (PHI[0] + t * (PHI[1] + t * (PHI[2] + t * (PHI[3] + t * PHI[4]))))
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def _gain(grade: Column, linear: bool) -> Column:
    return grade.cast("double") if linear else F.pow(F.lit(2.0), grade) - 1


def graded(ranked: DataFrame, qrels: DataFrame, k: int = 5, linear: bool = False) -> DataFrame:
    """One row for each (system, qid) of all systems and all judged queries with ndcg, recall, precision, f1, mrr and ap.

    Queries that a system did not answer score 0; ap runs over the whole list and divides by all relevant.
    """
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "id")))
    per = ideal.groupBy("qid").agg(
        F.sum(F.when(F.col("i") <= k, _gain(F.col("grade"), linear) / F.log2(F.col("i") + 1))).alias("idcg"), F.count_if(F.col("grade") > 0).alias("relevant")
    )
    every = ranked.select("system").distinct().join(per)  # systems are few: all of them on every judged query
    hits = ranked.select("system", "qid", "id", "rank").join(qrels, ["qid", "id"])
    w = Window.partitionBy("system", "qid").orderBy("rank")
    hits = hits.withColumn("nth", F.sum((F.col("grade") > 0).cast("int")).over(w))
    found = hits.groupBy("system", "qid").agg(
        F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), linear) / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= k)).alias("got"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("grade") > 0, F.col("nth") / F.col("rank"))).alias("ap_sum"),
    )
    j = every.join(found, ["system", "qid"], "left")
    got = F.coalesce("got", F.lit(0))
    recall = F.when(F.col("relevant") > 0, got / F.col("relevant")).otherwise(0.0)
    precision = got / F.lit(k)
    return j.select(
        "system",
        "qid",
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        recall.alias("recall"),
        precision.alias("precision"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"),
        F.when(F.col("relevant") > 0, F.coalesce("ap_sum", F.lit(0.0)) / F.col("relevant")).otherwise(0.0).alias("ap"),
    )


def run_means(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c not in ("system", "qid")]
    return per_query.groupBy("system").agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])


def evidence(ranked: DataFrame, qrels: DataFrame, documents: DataFrame, k: int = 5, least_grade: int = 2) -> DataFrame:
    """For each (system, qid) with anchors: share of anchors in the first k, whether all are, whether each document's own anchor is."""
    anchors = qrels.filter(F.col("grade") >= least_grade).join(documents, "id").select("qid", "id", "document")
    every = ranked.select("system").distinct().join(anchors)  # systems are few
    top = ranked.filter(F.col("rank") <= k).select("system", "qid", "id", F.lit(1).alias("hit"))
    j = every.join(top, ["system", "qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per_doc = j.groupBy("system", "qid", "document").agg(F.max("hit").alias("any"), F.sum("hit").alias("hits"), F.count("*").alias("n"))
    return per_doc.groupBy("system", "qid").agg((F.sum("hits") / F.sum("n")).alias("completeness"), (F.sum("hits") == F.sum("n")).cast("double").alias("complete"), F.min("any").cast("double").alias("document_coverage"))


def group_metrics(ranked: DataFrame, groups: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """Over citation groups, any id of a group serves: all groups (joint), share (completeness), any (loose), reciprocal rank, documents."""
    every = ranked.select("system").distinct().join(groups)  # systems are few
    j = every.join(ranked.select("system", "qid", "id", "rank"), ["system", "qid", "id"], "left")
    first = F.min(F.struct("place", "id"))
    per = j.groupBy("system", "qid", "group_no").agg(F.min("rank").alias("best"), first.alias("f")).join(documents.select(F.col("id").alias("fid"), "document"), F.col("f.id") == F.col("fid"), "left")
    hit = F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))
    per_doc = per.withColumn("hit", hit).groupBy("system", "qid", "document").agg(F.max("hit").alias("any"), F.sum("hit").alias("hits"), F.count("*").alias("n"), F.min("best").alias("best"))
    return per_doc.groupBy("system", "qid").agg(
        (F.sum("hits") == F.sum("n")).cast("double").alias("joint"),
        (F.sum("hits") / F.sum("n")).alias("completeness"),
        F.max("any").cast("double").alias("loose"),
        F.coalesce(F.when(F.min("best") <= k, 1.0 / F.min("best")), F.lit(0.0)).alias("mrr"),
        F.min("any").cast("double").alias("document_coverage"),
    )


def geo_risk(per_query: DataFrame, value: str = "ndcg", alpha: float = 2.0) -> DataFrame:
    """Columns (system, georisk) over the queries all systems answered; queries nobody scores on are passed over."""
    systems = per_query.select("system").distinct().agg(F.count("*").alias("m"))
    common = per_query.groupBy("qid").agg(F.count_distinct("system").alias("c"), F.sum(value).alias("t")).join(systems).filter("c = m").select("qid", "t")  # one row
    s = per_query.select("system", "qid", F.col(value).alias("x")).join(common, "qid")
    rows = s.groupBy("system").agg(F.sum("x").alias("si"), F.count("*").alias("n"))
    total = s.agg(F.sum("x").alias("total"))
    e = s.join(rows, "system").join(total).withColumn("e", F.col("si") * F.col("t") / F.col("total"))  # one row
    t = (F.col("x") - F.col("e")) / F.sqrt("e") * F.when(F.col("x") < F.col("e"), 1.0 + alpha).otherwise(1.0)
    z = e.groupBy("system").agg(F.first("si").alias("si"), F.first("n").alias("n"), F.sum(F.when(F.col("e") > 0, t).otherwise(0.0)).alias("z"))
    return z.select("system", F.when(F.col("si") > 0, F.sqrt(F.col("si") / F.col("n") * normal_cdf(F.col("z") / F.col("n")))).otherwise(0.0).alias("georisk"))


def stratified(per_query: DataFrame, strata: DataFrame, by: str, value: str = "ndcg") -> DataFrame:
    """Means by stratum and over all (stratum null) in one pass."""
    j = per_query.join(strata, "qid")
    return j.rollup("system", by).agg(F.count("*").alias("queries"), F.avg(value).alias("mean")).filter(F.col("system").isNotNull())


def monopoly(ranked: DataFrame, k: int = 5) -> DataFrame:
    """How many of the first k places the most frequent document holds, for each query."""
    return ranked.filter(F.col("rank") <= k).groupBy("system", "qid", "document").agg(F.count("*").alias("n")).groupBy("system", "qid").agg(F.max("n").alias("slots"))


def better_worse(a: DataFrame, b: DataFrame, value: str = "ndcg", least: float = 1e-9) -> DataFrame:
    j = a.select("qid", F.col(value).alias("x")).join(b.select("qid", F.col(value).alias("y")), "qid")
    return j.agg(F.count_if(F.col("y") > F.col("x") + least).alias("better"), F.count_if(F.col("y") < F.col("x") - least).alias("worse"), F.count_if(F.abs(F.col("y") - F.col("x")) <= least).alias("same"))


def dispersion(groups: DataFrame, positions: DataFrame) -> DataFrame:
    """Distance between the first places of a query's groups, with its class."""
    first = groups.join(positions, "id").groupBy("qid", "group_no").agg(F.min("position").alias("p"))
    d = first.groupBy("qid").agg(F.count("*").alias("groups"), (F.max("p") - F.min("p")).alias("distance"))
    label = F.when(F.col("groups") == 1, "single").when(F.col("distance") == 0, "same").when(F.col("distance") <= 2, "next").when(F.col("distance") <= 10, "near").otherwise("far")
    return d.withColumn("dispersion", label)


def failure_features(ranked: DataFrame) -> DataFrame:
    """Score features of each ranking's head: best, mean and spread of five, gaps, documents."""
    score = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    five = F.when(F.col("rank") <= 5, F.col("score"))
    return ranked.groupBy("system", "qid").agg(score(1).alias("top1"), F.avg(five).alias("mean5"), F.stddev_pop(five).alias("spread5"), (score(1) - score(2)).alias("gap12"), (score(1) - score(10)).alias("drop10"), F.count_distinct(F.when(F.col("rank") <= 5, F.col("document"))).alias("documents5"))


def best_group_ranks(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """Best rank of each group of each query, null outside the list."""
    j = ranked.select("system").distinct().join(groups).join(ranked.select("system", "qid", "id", "rank"), ["system", "qid", "id"], "left")  # systems are few
    return j.groupBy("system", "qid", "group_no").agg(F.min("rank").alias("best"))


def rare_share(terms: DataFrame, most: int = 3) -> DataFrame:
    """Of (id, term): for each id the share of its terms that stand in at most `most` documents."""
    df = terms.groupBy("term").agg(F.count_distinct("id").alias("df"))
    return terms.distinct().join(df, "term").groupBy("id").agg(F.count("*").alias("terms"), F.avg((F.col("df") <= most).cast("double")).alias("rare"))
