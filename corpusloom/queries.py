"""All queries on the reference's operators: name -> (spark, directory) -> DataFrame, with their SQL."""

from __future__ import annotations

from corpusloom.plans import chunking_queries, cleaning_queries, gold_queries, judging_queries, page_queries, ranking_queries, report_queries, row_queries, store_queries, text_queries
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship", "chunking_queries", "cleaning_queries", "gold_queries", "judging_queries", "page_queries", "ranking_queries", "report_queries", "row_queries", "store_queries", "text_queries"]

flagship = QUERIES["t_embedding_text"]
