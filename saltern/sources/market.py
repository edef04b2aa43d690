"""Market files as tables: daily price files of either layout, action and index records, and partitioned panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.functions.actions import any_date, clean, security_key, valid_isin

#: Columns of the newer and of the older daily price file, by the name that both get.
NEW_LAYOUT = {
    "trade_date": "TradDt",
    "isin": "ISIN",
    "symbol": "TckrSymb",
    "series": "SctySrs",
    "open": "OpnPric",
    "high": "HghPric",
    "low": "LwPric",
    "close": "ClsPric",
    "previous_close": "PrvsClsgPric",
    "volume": "TtlTradgVol",
    "turnover": "TtlTrfVal",
    "trades": "TtlNbOfTxsExctd",
}
OLD_LAYOUT = {
    "trade_date": "TIMESTAMP",
    "isin": "ISIN",
    "symbol": "SYMBOL",
    "series": "SERIES",
    "open": "OPEN",
    "high": "HIGH",
    "low": "LOW",
    "close": "CLOSE",
    "previous_close": "PREVCLOSE",
    "volume": "TOTTRDQTY",
    "turnover": "TOTTRDVAL",
    "trades": "TOTALTRADES",
}
_OPTIONAL = {"isin", "trades"}
_NUMBERS = ["open", "high", "low", "close", "previous_close", "volume", "turnover", "trades"]


def price_files(spark: SparkSession, path: str) -> DataFrame:
    """Daily price files of one layout, told by the header; both give the same columns and types."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip(): c for c in raw.columns if c.strip() and not c.startswith("_c")}
    layout = NEW_LAYOUT if "TckrSymb" in names else OLD_LAYOUT
    missing = [v for k, v in layout.items() if v not in names and k not in _OPTIONAL]
    if missing:
        raise ValueError(f"price file without columns {missing}")
    pick = lambda k: F.col(f"`{names[layout[k]]}`") if layout[k] in names else F.lit(None).cast("string")
    rows = raw.select(*[clean(pick(k)).alias(k) for k in layout])
    typed = rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in _NUMBERS} | {"trade_date": any_date("trade_date"), "isin": valid_isin(F.col("isin"))})
    keyed = typed.withColumn("security_key", security_key("isin", "symbol", "series"))
    return keyed.withColumn("identity_quality", F.when(F.col("isin").isNotNull(), "isin").otherwise("symbol"))


def json_records(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """JSON records whose fields have several possible names: the first that has a value counts."""
    raw = spark.read.option("multiLine", True).json(path)
    have = set(raw.columns)
    first = lambda names: F.coalesce(*[clean(F.col(f"`{n}`").cast("string")) for n in names if n in have], F.lit(None).cast("string"))
    return raw.select(*[first(names).alias(k) for k, names in aliases.items()])


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """CSV snapshots with the as-of date taken from the file's name (YYYY-MM-DD or YYYYMMDD)."""
    raw = spark.read.csv(path, header=True)
    digits = F.regexp_extract(F.input_file_name(), r"([0-9]{4}-?[0-9]{2}-?[0-9]{2})[^/]*$", 1)
    return raw.withColumn("asof_date", F.try_to_date(F.replace(digits, F.lit("-"), F.lit("")), "yyyyMMdd"))


def write_panel(panel: DataFrame, path: str, date: str = "date", order: str = "id") -> None:
    """One folder a date, sorted inside: each date is written by one task, dates spread over tasks."""
    panel.repartition(date).sortWithinPartitions(date, order).write.mode("overwrite").option("compression", "zstd").partitionBy(date).parquet(path)


def read_panel(spark: SparkSession, path: str, columns: list[str], start: str | None = None, date: str = "date") -> DataFrame:
    """The panel's columns; dates before ``start`` are pruned by folder."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"panel without columns {missing}")
    df = df.select(date, *[c for c in columns if c != date])
    return df.where(F.col(date) >= F.lit(start).cast("date")) if start else df


def missing_dates(wanted: DataFrame, panel: DataFrame, date: str = "date") -> DataFrame:
    """Dates that a resumed run still has to make."""
    return wanted.join(panel.select(date).distinct(), date, "left_anti")
