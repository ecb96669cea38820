"""Month close with keyed state: a customer's last 24 months are held by the stream, so no batch reads the ledger again.

State is a ring of months for each account of the customer. A batch puts its rows into the ring and gives out the trailing
statistics of the months that they may change: an account's month and the eleven after it, and those of all the
customer's accounts, whose customer maxima change with it. Rows less than twelve months behind the customer's latest
month of earlier batches are exact; older ones can't be, they go to the late rows and change nothing. A customer that has been quiet for the span of
the ring, by the watermark, leaves the state.

The sink is idempotent: every epoch overwrites its own folder, so a batch that is run again after a failure replaces what
it wrote, and `latest` takes each account-month from its newest epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arrearium.functions.periods import date_of_period, month_no
from arrearium.operators.panel import LENGTHS, VARIABLES

RING, LATE = 24, 12
NAMES = [f"{g}{n}_{s}_{v}" for n in LENGTHS for v in VARIABLES for s in ("Mean", "Max", "Min") for g in ("agr", "ags")]
OUT = "cid bigint, aid bigint, month_no int, late boolean, " + ", ".join(f"{c} double" for c in NAMES)
STATE = "aid array<bigint>, month_no array<int>, due array<int>, days array<int>"
FIELDS = ["aid", "month_no", "due", "days"]


def statistics(ring: pd.DataFrame, months: set[tuple[int, int]]) -> list[dict]:
    """agr and ags statistics of the given (aid, month) from a customer's rows (aid, month_no, due, days)."""
    rows = ring.assign(Due=ring["due"], Days=ring["days"] + 15)
    for v in ("Days", "Due"):
        rows[f"CMax_{v}"] = rows.groupby("month_no")[v].transform("max")
    out = []
    for aid, own in rows.groupby("aid"):
        at = own["month_no"].to_numpy()
        for m in sorted(t for a, t in months if a == aid):
            one: dict = {"aid": int(aid), "month_no": int(m), "late": False}
            for n in LENGTHS:
                window = own[(at > m - n) & (at <= m)]
                for v in VARIABLES:
                    x = window[v].dropna()
                    full = len(x) >= n
                    for s, value in (("Mean", x.mean()), ("Max", x.max()), ("Min", x.min())):
                        one[f"agr{n}_{s}_{v}"] = float(value) if len(x) else None
                        one[f"ags{n}_{s}_{v}"] = float(value) if full else None
            out.append(one)
    return out


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat([p[["aid", "month_no", "due_installments", "pay_days"]] for p in parts]).set_axis(FIELDS, axis=1)
    held = pd.DataFrame({c: pd.Series(v, dtype="float64") for c, v in zip(FIELDS, state.get if state.exists else [[]] * 4, strict=True)})
    before = int(held["month_no"].max()) if len(held) else None
    past = new["month_no"] <= before - LATE if before is not None else new["month_no"].isna()
    late, new = new[past], new[~past]
    # All of a first batch's months are new, however many: the ring is cut after the statistics.
    rows = pd.concat([held, new]).astype({"aid": "int64", "month_no": "int64", "due": "float64", "days": "float64"}).drop_duplicates(["aid", "month_no"], keep="last").sort_values(["aid", "month_no"])
    newest = int(rows["month_no"].max())
    ring = rows[rows["month_no"] > newest - RING]
    # A row changes its account's next months, and through the customer's maxima those of the other accounts.
    changed = {m for t in set(new["month_no"]) for m in range(int(t), int(t) + LATE)}
    months = {(a, m) for a, m in zip(rows["aid"], rows["month_no"]) if m in changed}
    out = statistics(rows, months) + [{"aid": int(a), "month_no": int(m), "late": True} for a, m in zip(late["aid"], late["month_no"])]
    state.update(tuple([None if x != x else int(x) for x in ring[c]] for c in FIELDS))
    state.setTimeoutTimestamp(max(int(pd.Timestamp(year=(newest - 1) // 12, month=(newest - 1) % 12 + 1, day=1).timestamp() * 1000) + RING * 31 * 86_400_000, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out).assign(cid=key[0]).reindex(columns=["cid", "aid", "month_no", "late", *NAMES]).astype({c: "float64" for c in NAMES})


def closed(rows: DataFrame, delay: str = "366 days") -> DataFrame:
    """OUT rows of a stream of transactions (period, cid, aid, due_installments, pay_days)."""
    stamped = rows.select("cid", "aid", month_no(F.col("period")).alias("month_no"), F.col("due_installments").cast("int").alias("due_installments"), F.col("pay_days").cast("int").alias("pay_days"), date_of_period(F.col("period")).cast("timestamp").alias("ts"))
    return stamped.withWatermark("ts", delay).groupBy("cid").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def start(spark: SparkSession, landing: str, out: str, checkpoint: str, schema, files_at_once: int | None = None, delay: str = "366 days") -> StreamingQuery:
    """Close the months of landed files as they come; each epoch has a folder of its own under `out`."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(schema)
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    return closed(stream.parquet(landing), delay).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest statistics of every account-month."""
    rows = spark.read.parquet(out).filter("not late")
    best = rows.groupBy("aid", "month_no").agg(F.max_by(F.struct("cid", *NAMES), "epoch").alias("r"))
    return best.select("aid", "month_no", "r.*")
