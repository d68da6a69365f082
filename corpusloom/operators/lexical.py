"""Lexical search: postings, BM25 with the classic defaults, query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

K1, B, FLOOR = 1.5, 0.75, 0.25


def postings(tokens: DataFrame) -> DataFrame:
    """From (id, tokens array): one row (id, term, tf, length) for each term of each document."""
    sized = tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return sized.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(tokens: DataFrame) -> DataFrame:
    """Columns (term, df, idf): ln((N - df + 0.5) / (df + 0.5)), negatives replaced by FLOOR times the mean idf of all terms.

    Document frequencies count each document's distinct terms where it lies; only terms and counts are shuffled.
    """
    return _weigh(_counted(tokens)).select("term", "df", "idf")


def _counted(tokens: DataFrame) -> DataFrame:
    """Columns (term, df, n, length): of each term its documents; under the null term the number of documents and of their tokens.

    One pass over the documents, each giving its distinct terms and one row for itself.
    """
    own = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(0).alias("length")))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("n"), F.size("tokens").alias("length")))
    rows = tokens.select(F.explode(F.concat(itself, own)).alias("r")).select("r.*")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"), F.sum("length").alias("length"))


def _weigh(counted: DataFrame) -> DataFrame:
    """Columns (term, df, idf, average): counted terms with the average length of a document beside each."""
    counted = cut_lineage(counted)
    whole = counted.filter("term IS NULL").select(F.col("n").alias("all"), (F.col("length") / F.col("n")).alias("average"))  # one row
    raw = counted.filter("term IS NOT NULL").crossJoin(F.broadcast(whole)).withColumn("raw", F.log(F.col("all") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * FLOOR).otherwise(F.col("raw")).alias("idf"), "average")


def bm25(queries: DataFrame, tokens: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Columns (qid, id, score, rank): the k best documents of each query (qid, tokens array); ties by id.

    The documents are read twice: once for the counts of terms and lengths, which are kept, once for the tokens
    that some query asks for.  A document's tokens are counted where it lies; a term as common as a third of
    the documents is spread by adaptive skew handling, and scores are summed before the ranking shuffle.
    """
    asked = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term"))
    weighed = asked.join(_weigh(_counted(tokens)), "term")
    found = tokens.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    post = found.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    hits = post.join(weighed, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    scored = hits.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best of each query with their rank; the filter on row_number lets the engine cut early."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def expand_query(queries: DataFrame, tokens: DataFrame, ranked: DataFrame, documents: int = 5, terms: int = 10) -> DataFrame:
    """Queries with the most frequent terms of their best documents appended; ties by term."""
    best = ranked.filter(F.col("rank") <= documents).select("qid", "id")
    counts = best.join(postings(tokens), "id").groupBy("qid", "term").agg(F.sum("tf").alias("tf"))
    w = Window.partitionBy("qid").orderBy(F.col("tf").desc(), "term")
    more = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= terms).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("m"))
    return queries.join(more, "qid", "left").select("qid", F.concat("tokens", F.coalesce(F.transform("m", lambda x: x["term"]), F.array().cast("array<string>"))).alias("tokens"))


def two_language_tokens(own: Column, translated: Column) -> Column:
    """Distinct tokens of a query and of its translation, the query's first."""
    return F.array_distinct(F.concat(own, F.coalesce(translated, F.array().cast("array<string>"))))
