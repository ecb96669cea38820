"""The analytical base table: 36 columns of an account-month. Its summary is in `summary`.

It is built for every month at once: what the customer columns of a month see, are all account-months up to it of
accounts that are active in it, so a month is a key of the aggregate and not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrearium.functions.periods import date_of_period
from arrearium.functions.scalars import ACTIVE, BAD, CLOSED, age_at, safe_div

#: Columns of the base table that are other columns under a new name.
RENAMED = {
    "app_income": "income", "app_loan_amount": "loan_amount", "app_n_installments": "n_installments", "app_nom_branch": "branch", "app_nom_gender": "gender", "app_nom_job_code": "job_code",
    "app_number_of_children": "number_of_children", "app_nom_marital_status": "marital_status", "app_nom_city": "city", "app_nom_home_status": "home_status", "app_nom_cars": "cars", "app_spendings": "spendings",
}
#: Columns of the base table, in order.
COLUMNS = (
    "aid cid act_days act_paid_installments act_utl act_dueutl act_due act_age act_cc act_dueinc act_loaninc app_income app_loan_amount app_n_installments act_seniority "
    "app_nom_branch app_nom_gender app_nom_job_code app_number_of_children app_nom_marital_status app_nom_city app_nom_home_status app_nom_cars app_spendings fin_period status coll_status period "
    "act_cus_seniority act_cus_n_loans_hist act_cus_n_statC act_cus_n_statB act_cus_n_loans_act act_cus_utl act_cus_dueutl act_cus_cc"
).split()

#: Weights of the standardised columns in the application score and in the behavioural score.
APPLICATION_WEIGHTS = {
    "app_income": 1, "app_nom_branch": 1, "app_nom_gender": 1, "app_nom_job_code": 2, "app_number_of_children": 1, "app_nom_marital_status": 1, "app_nom_city": 1, "app_nom_home_status": 1, "app_nom_cars": 1,
}
BEHAVIOUR_WEIGHTS = {
    "act_cus_utl": -1, "act_cus_dueutl": -1, "act_cus_cc": -1, "act_cus_n_loans_act": -1, "act_cus_seniority": 3, "act_cus_n_statC": 6, "act_cus_n_statB": -3, "app_nom_branch": 1, "app_nom_gender": 3,
    "app_nom_job_code": 6, "app_number_of_children": 6, "app_nom_marital_status": 3, "app_nom_city": 1, "app_nom_home_status": 1, "app_nom_cars": 1, "app_spendings": -1, "act_days": -5, "act_utl": -4,
    "act_dueutl": -6, "act_due": -2, "act_age": 4, "act_cc": -2, "act_dueinc": -1, "act_loaninc": -2, "app_income": 2, "app_loan_amount": -1, "app_n_installments": -4, "agr3_Mean_Due": -2, "ags3_Mean_Days": -3,
    "agr6_Mean_Due": -3, "ags6_Mean_Days": -3, "agr9_Mean_Due": -2, "ags9_Mean_Days": -3, "agr12_Mean_Due": -2, "ags12_Mean_Days": -3, "ags3_Max_CMax_Due": -3, "ags12_Max_CMax_Due": -4, "ags9_Max_CMax_Days": -2,
}


def customer_columns(rows: DataFrame) -> DataFrame:
    """Active account-months with act_cus_*, over the months up to each of the customer's accounts active in it.

    An account's own running sums come from one window; summed over the customer's active accounts of the month they
    are the customer's. So the work is two sorts of rows that are dealt by customer, no self-join of months with months.
    """
    past = W.partitionBy("cid", "aid").orderBy("month_no").rowsBetween(W.unboundedPreceding, 0)
    one = lambda c: F.sum(c.cast("bigint")).over(past)
    run = rows.withColumns(
        {
            "__rows": F.count("*").over(past), "__b": one(F.col("status") == BAD), "__c": one(F.col("status") == CLOSED), "__i": F.sum("installment").over(past),
            "__d": one(F.col("due_installments") > 0), "__n": F.sum("n_installments").over(past),
        }
    ).filter(F.col("status") == ACTIVE)
    month = W.partitionBy("cid", "period")
    total = lambda c: F.sum(c).over(month)
    return run.withColumns(
        {
            "act_cus_seniority": F.max("act_seniority").over(month), "act_cus_n_loans_hist": total("__rows"), "act_cus_n_statC": total("__c"), "act_cus_n_statB": total("__b"), "act_cus_n_loans_act": total("__rows"),
            "act_cus_utl": safe_div(total("__i"), total("__n")), "act_cus_dueutl": safe_div(total("__d"), total("__n")), "__all_i": total("__i"),
        }
    ).drop("__rows", "__b", "__c", "__i", "__d", "__n")


def abt_base(transactions: DataFrame, clients: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The 36 columns of every account-month that is active, then the transactions' columns `keep`.

    Without `clients`, which has date_of_birth, the transactions have its columns already. Where they are dealt by customer,
    nothing more is shuffled. act_seniority counts months since the loan began, the first being 1.
    """
    rows = transactions if clients is None else transactions.join(clients, "cid")
    c = F.col
    rows = rows.withColumn("act_seniority", c("month_no") - (F.floor(c("fin_period") / 100) * 12 + c("fin_period") % 100).cast("int") + 1)
    out = customer_columns(rows)
    out = out.withColumns(
        {
            "act_days": c("pay_days") + 15,
            "act_paid_installments": c("paid_installments"),
            "act_utl": safe_div(c("paid_installments"), c("n_installments")),
            "act_dueutl": safe_div(c("due_installments"), c("n_installments")),
            "act_due": c("due_installments"),
            "act_age": age_at(c("date_of_birth"), date_of_period(c("period"))),
            "act_cc": safe_div(c("installment") + c("spendings"), c("income")),
            "act_dueinc": safe_div(c("due_installments") * c("installment"), c("income")),
            "act_loaninc": safe_div(c("loan_amount"), c("income")),
            "act_cus_cc": safe_div(c("__all_i") + c("spendings"), c("income")),
        }
    )
    return out.select(*[c(RENAMED[x]).alias(x) if x in RENAMED else c(x) for x in COLUMNS], *keep)
