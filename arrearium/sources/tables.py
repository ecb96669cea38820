"""Declared schemas, typed readers and sinks of the portfolio tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = {"s": T.StringType(), "i": T.IntegerType(), "f": T.DoubleType(), "d": T.DateType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KIND[k]) for n, _, k in (x.partition(":") for x in spec.split())])


#: Columns of the tables (s string, i integer, f double, d date).
SCHEMAS = {
    "clients": _schema("cid:s date_of_birth:d gender:i year:i job_code:i number_of_children:i marital_status:i city:i home_status:i cars:i income:i spendings:i"),
    "accounts": _schema("aid:s cid:s app_date:d period:i installment:i n_installments:i loan_amount:i branch:i"),
    "transactions": _schema("period:i aid:s cid:s fin_period:i status:i coll_status:i due_installments:i paid_installments:i pay_days:i"),
    "collection_actions": _schema("period:i aid:s cid:s action:s coll_status:i"),
    "abt_base": _schema(
        "aid:s cid:s act_days:i act_paid_installments:i act_utl:f act_dueutl:f act_due:i act_age:i act_cc:f act_dueinc:f act_loaninc:f app_income:i app_loan_amount:i app_n_installments:i act_seniority:i "
        "app_nom_branch:i app_nom_gender:i app_nom_job_code:i app_number_of_children:i app_nom_marital_status:i app_nom_city:i app_nom_home_status:i app_nom_cars:i app_spendings:i fin_period:i status:i coll_status:i "
        "period:i act_cus_seniority:i act_cus_n_loans_hist:i act_cus_n_statC:i act_cus_n_statB:i act_cus_n_loans_act:i act_cus_utl:f act_cus_dueutl:f act_cus_cc:f"
    ),
}
#: Other names of the columns that features need.
ALIASES = {
    "age": ["app_age", "act_age", "age"],
    "loan": ["app_loan_amount", "loan_amount", "l_amount"],
    "tenor": ["app_n_installments", "n_installments", "tenor"],
    "installment": ["app_installment", "installment"],
    "split": ["split", "split_new", "sample"],
}


def load_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet", create_if_missing: bool = False) -> DataFrame:
    """Typed read; floating NaN becomes null. A missing table is an empty one if asked for."""
    from pyspark.errors import AnalysisException

    schema = SCHEMAS[name]
    try:
        reader = spark.read.schema(schema)
        df = reader.csv(path, header=True, enforceSchema=False) if fmt == "csv" else reader.parquet(path)
    except AnalysisException as e:
        if not create_if_missing or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def save_table(df: DataFrame, path: str, partition_by: str | None = "period", mode: str = "overwrite", compression: str = "snappy") -> None:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Rewrite only the periods that `df` holds, so that closing a month twice gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def scan_periods(df: DataFrame, last: int, months: int = 12, predicate: Column | None = None) -> DataFrame:
    """The `months` months up to `last`: a filter on the partition column, so other folders aren't read."""
    first = last // 100 * 12 + last % 100 - months
    low = first // 12 * 100 + first % 12 + 1
    df = df.filter((F.col("period") >= low) & (F.col("period") <= last))
    return df if predicate is None else df.filter(predicate)


def write_metadata(spark: SparkSession, path: str, values: Mapping[str, object]) -> None:
    """One JSON row of run settings or metrics."""
    spark.createDataFrame([tuple(map(str, values.values()))], list(values)).coalesce(1).write.mode("overwrite").json(path)


def detect_aliases(columns: Iterable[str], aliases: Mapping[str, list[str]] = ALIASES) -> dict[str, str]:
    have = set(columns)
    return {k: found for k, names in aliases.items() if (found := next((n for n in names if n in have), None))}


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def series_columns(columns: Iterable[str], prefixes: tuple[str, ...] = ("act", "coll", "due", "paid")) -> dict[str, list[str]]:
    """Behavioural series by name: columns <series>_m<number> in order of the month."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in columns:
        if (m := re.fullmatch(r"(.+)_m(\d+)", c)) and m[1].startswith(prefixes):
            found.setdefault(m[1], []).append((int(m[2]), c))
    return {k: [c for _, c in sorted(v)] for k, v in found.items()}
