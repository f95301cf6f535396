"""RM-20: layering and circular flows along time-ordered payments.

Payments are edges (payer, payee, day, amount). A flow leaves a client in one
month and is followed over at most ``hops`` payments, each on or after the day
the last one arrived and inside the window that the month opens. What a hop
leaves is one row for each (start, month, place) with the earliest arrival: of
two flows that reach a place, the earlier can go wherever the later can, so
nothing is lost, and paths themselves are never kept. A place that many pay
and that pays many is thus one row a start and month, not the product of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .canonical import Client360, UBO_STRIDE


def owner_payments(c: Client360, least_usd: float = 0.0) -> DataFrame:
    """(src, dst, day, amount_usd): what clients pay to suppliers, as paid to
    the client who owns the supplier; payments of a day are added up, and days
    below ``least_usd`` left out."""
    li = c.data.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    o = c.data.orders.select("o_orderkey", "o_custkey")
    paid = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") * UBO_STRIDE).alias("dst"), F.to_date("l_shipdate").alias("day"))
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount_usd")))
    return paid.where(F.col("amount_usd") >= F.lit(least_usd).cast("decimal(18,2)"))


def circular_flows(payments: DataFrame, hops: int = 4, months: int = 2) -> DataFrame:
    """``payments(src, dst, day, amount_usd)`` -> ``client_key, month, n_hops,
    returned_on, outflow_usd``: for each client and month with a flow that
    comes back within ``months`` months, the fewest payments it takes, the
    earliest day it is back with so many, and what the client paid that month.

    A payment to oneself is a circle of one; rows with a null end or day are
    left out. Every hop is written to the checkpoint folder."""
    edges, edge_path = write_table(payments.where("src is not null and dst is not null and day is not null").select("src", "dst", "day", "amount_usd"))
    spark = payments.sparkSession
    month = F.trunc("day", "MM")
    at = edges.groupBy(F.col("src").alias("start"), month.alias("month"), F.col("dst").alias("place")).agg(F.min("day").alias("day"))
    found, path = None, None
    for hop in range(1, hops + 1):
        state, new_path = write_table(at)
        if path:
            drop_table(spark, path)
        path = new_path
        back = state.where("place = start").select("start", "month", F.lit(hop).alias("n_hops"), F.col("day").alias("returned_on"))
        back, _ = write_table(back)
        found = back if found is None else found.unionByName(back)
        if hop < hops:
            s = state.where("place <> start").select("start", "month", F.col("place").alias("via"), F.col("day").alias("since"))
            at = (s.join(edges.select("src", "dst", "day"), F.col("via") == F.col("src"))
                  .where((F.col("day") >= F.col("since")) & (F.col("day") < F.add_months("month", months)))
                  .groupBy("start", "month", F.col("dst").alias("place")).agg(F.min("day").alias("day")))
    drop_table(spark, path)
    circles, _ = write_table(found.groupBy("start", "month").agg(F.min(F.struct("n_hops", "returned_on")).alias("best")))
    paid = edges.join(circles.select(F.col("start").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("src").alias("start"), month.alias("month")).agg(F.sum("amount_usd").alias("outflow_usd"))
    out, _ = write_table(circles.join(paid, ["start", "month"]).select(F.col("start").alias("client_key"), "month", "best.n_hops", "best.returned_on", F.col("outflow_usd").cast("double").alias("outflow_usd")))
    drop_table(spark, edge_path)
    return out
