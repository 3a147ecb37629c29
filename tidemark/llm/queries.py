"""Queries of the operators for training data (problems 1, 8, 9 and 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_documents
from tidemark.llm.splitting import split_documents
from tidemark.llm.tokens import count_tokens, encode_corpus
from tidemark.llm.topn import best_filings
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_filings(table(spark, sf_dir, "fundamentals")).select("ticker", "filing_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text").withColumnRenamed("tokens", "size")
    return mix_documents(sizes, table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("not reachable").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False)
    return pieces.where("piece = 0 and pieces > 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p8_ids, p9_found, p9_shares, p9_draws, p10_found, p10_pieces)}

SQL = {
    "p1_found": """with f as (select upper(trim(ticker)) ticker, filing_id, max(round(roe, 4)) roe, max(case when not isnan(gross_margin) then gross_margin end) gm,
  max(case when not isnan(pe) and pe <> 0 and abs(pe) < 500 then pe end) pe from fundamentals where not isnan(roe) and ticker is not null and filing_id is not null group by 1, 2)
select ticker, filing_id from f qualify row_number() over (partition by ticker order by roe desc, gm desc nulls last, pe asc nulls last, filing_id) <= 5""",
}
