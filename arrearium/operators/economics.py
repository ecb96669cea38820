"""Lifetime loan economics in closed form, and as monthly schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import monthly_hazard


def geometric(x: Column, n: Column) -> Column:
    """1 + x + ... + x^(n-1); n where x is 1."""
    return F.when(F.abs(x - 1) < 1e-12, n.cast("double")).otherwise((F.pow(x, n) - 1) / (x - 1))


def exposure(pd_12m: Column, loan: Column, n: Column, apr: Column, disc: Column) -> dict[str, Column]:
    """hazard, balance and instalment_base of a loan: what the economics are linear in.

    Survival is (1 - h)^(t-1), discounting (1 + disc/12)^-t and the balance that of an annuity at the gross rate, so
    every sum over months is a difference of geometric sums. Expected loss is hazard * lgd * balance, interest a
    twelfth of the net rate times the balance, running cost the yearly rate times instalment_base.
    """
    h = monthly_hazard(pd_12m)
    q, d, r = 1 - h, 1 / (1 + disc / 12), apr / 12
    y = q * d
    grown = F.pow(1 + r, n)
    annuity = (grown * geometric(y, n) - geometric(y * (1 + r), n)) / (grown - 1)
    straight = F.when(F.abs(y - 1) < 1e-9, (n + 1) / 2.0).otherwise((n - y * geometric(y, n)) / (n * (1 - y)))
    return {"hazard": h, "balance": loan * d * F.when(r > 0, annuity).otherwise(straight), "instalment_base": loan / 12 * d * geometric(y, n)}


def lifetime(pd_12m: Column, loan: Column, n: Column, apr: Column, lgd: Column, op: Column, disc: Column, cof: Column, acq: Column) -> dict[str, Column]:
    """LT_EL, LT_margin and Expected_Profit of a loan; interest is earned at the rate net of funding."""
    x = exposure(pd_12m, loan, n, apr, disc)
    el = x["hazard"] * lgd * x["balance"]
    margin = F.greatest(apr - cof, F.lit(0.0)) / 12 * x["balance"] - op * x["instalment_base"]
    return {"LT_EL": el, "LT_margin": margin, "Expected_Profit": margin - el - acq}


def with_lifetime(df: DataFrame, pd_: str = "pd", loan: str = "loan_amount", n: str = "n_installments", apr: str = "apr", lgd="lgd", op="op", disc="disc", cof="cof", acq="acq") -> DataFrame:
    """Adds the three columns; parameters are column names, or numbers."""
    col = lambda x: F.col(x) if isinstance(x, str) else F.lit(float(x))
    return df.withColumns(lifetime(col(pd_), col(loan).cast("double"), col(n), col(apr), col(lgd), col(op), col(disc), col(cof), col(acq)))


def amortization(df: DataFrame, loan: str = "loan_amount", n: str = "n_installments", apr: str = "apr") -> DataFrame:
    """One row for each month of each loan: balance_begin, payment, interest, principal, balance_end."""
    months = df.withColumn("month", F.explode(F.sequence(F.lit(1), F.col(n))))
    r, size, t, k = F.col(apr) / 12, F.col(loan).cast("double"), F.col("month"), F.col(n)
    grown = F.pow(1 + r, k)
    left = lambda m: F.when(r > 0, size * (grown - F.pow(1 + r, m)) / (grown - 1)).otherwise(size * (k - m) / k)
    out = months.withColumn("balance_begin", left(t - 1)).withColumn("payment", F.when(r > 0, size * r * grown / (grown - 1)).otherwise(size / k))
    out = out.withColumn("interest", F.col("balance_begin") * r)
    return out.withColumn("principal", F.col("payment") - F.col("interest")).withColumn("balance_end", F.col("balance_begin") - F.col("principal"))


def marginal_pd(df: DataFrame, pd_: str = "pd", n: str = "n_installments") -> DataFrame:
    """One row for each month: survival at its begin and the default probability in it."""
    months = df.withColumn("month", F.explode(F.sequence(F.lit(1), F.col(n))))
    h = monthly_hazard(F.col(pd_))
    return months.withColumn("survival_begin", F.pow(1 - h, F.col("month") - 1)).withColumn("marginal_pd", F.col("survival_begin") * h)
