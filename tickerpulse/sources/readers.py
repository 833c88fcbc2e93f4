"""File readers for the reference data the pipeline needs.

All are plain ``spark.read`` calls with column pruning and filters that
Catalyst pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Header spellings accepted for the second exchange list.
TICKER_HEADERS = ("ACT Symbol", "Symbol", "Act Symbol", "act_symbol", "symbol")
NAME_HEADERS = ("Company Name", "Security Name", "company_name")


def path_missing(error: AnalysisException) -> bool:
    """Whether a read failed because the path does not exist (any other failure is an error)."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_symbol_list(spark: SparkSession, path: str, exchange: str = "NASDAQ") -> DataFrame:
    """Pipe-delimited listing -> (ticker, company_name, exchange).

    Everything is read as strings; '#' lines are comments; footer rows whose
    Symbol contains 'File Creation' (any case) and rows with Test Issue = 'Y'
    are dropped (a missing Test Issue is kept).
    """
    df = spark.read.csv(path, sep="|", header=True, comment="#", inferSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns])
    if "Symbol" in df.columns:
        df = df.filter(~F.lower(F.coalesce(F.col("Symbol"), F.lit(""))).contains("file creation"))
    if "Test Issue" in df.columns:
        df = df.filter(F.coalesce(F.col("`Test Issue`") != "Y", F.lit(True)))
    return df.select(F.col("Symbol").alias("ticker"), F.col("`Security Name`").alias("company_name"),
                     F.lit(exchange).alias("exchange"))


def pick_column(df: DataFrame, candidates) -> str:
    """S5 helper: the first candidate header present in ``df``."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def read_exchange_csv(spark: SparkSession, path: str, exchange: str = "NYSE") -> DataFrame:
    """Comma CSV with header variants -> (ticker, company_name, exchange)."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*[c.strip() for c in df.columns])
    t, n = pick_column(df, TICKER_HEADERS), pick_column(df, NAME_HEADERS)
    return df.select(F.col(f"`{t}`").alias("ticker"), F.col(f"`{n}`").alias("company_name"),
                     F.lit(exchange).alias("exchange"))


def read_ticker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ticker CSV; headers trimmed, lower-cased, spaces -> '_'; ticker upper/trim."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if "ticker" in df.columns:
        df = df.withColumn("ticker", F.upper(F.trim(F.col("ticker"))))
    return df


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """``{"stopwords": [...]}`` JSON -> distinct upper-cased ``word``; a missing file gives none."""
    try:
        raw = spark.read.json(path, multiLine=True)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return spark.createDataFrame([], "word string")
    if "stopwords" not in raw.columns:
        return spark.createDataFrame([], "word string")
    return raw.select(F.explode("stopwords").alias("w")).select(F.upper("w").alias("word")).distinct()


def sample_preprocessed(df: DataFrame, n: int, order=("created_utc", "id")) -> DataFrame:
    """S3: a deterministic sample: order first, then take ``n`` rows (the
    limit is the feature). Texts and ticker lists are whole."""
    return df.orderBy(*order).limit(n)


def load_daily(spark: SparkSession, path: str | None, results: DataFrame | None = None,
               ticker: str | None = None, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Daily rows filtered by ticker / date range from the newest version of the stored table
    (only the months of the range are read); if the table is missing, aggregate ``results`` on the fly (A1)."""
    from ..operators.daily import daily_sentiment_sql
    from .versions import VersionedTable
    table = VersionedTable(spark, path) if path is not None else None
    m = table.manifest() if table else None
    if m is None:
        if results is None:
            raise ValueError("neither a stored table nor results to aggregate")
        return daily_sentiment_sql(results, start_date, end_date, ticker)
    first, last = (start_date or "")[:7], (end_date or "9999-99")[:7]
    bounded = start_date is not None or end_date is not None
    months = [p for p in m.parts if "/" not in p and (not bounded or p[:1].isdigit() and first <= p <= last)]
    df = table.rows(m, months)
    if ticker is not None:
        df = df.filter(F.col("ticker") == ticker)
    if start_date is not None:
        df = df.filter(F.col("sentiment_date") >= F.to_date(F.lit(start_date)))
    if end_date is not None:
        df = df.filter(F.col("sentiment_date") <= F.to_date(F.lit(end_date)))
    return df
