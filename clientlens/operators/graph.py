"""Property-graph path patterns over node / edge DataFrames (TVF-01).

The reference's graph is a view over tables: Client, Household, Account and
Advisor nodes; BELONGS_TO, HOLDS and ADVISED_BY edges.  A pattern match is a
chain of equi-joins, and the one pattern the reference runs —

    (me:Client)-[:BELONGS_TO]->(h:Household)<-[:BELONGS_TO]-(mate:Client)-[:HOLDS]->(a:Account)
    RETURN a.account_type, COUNT(*)

— counts household-mate accounts per type.  Joining members to members
would emit every member pair of a household (quadratic in household size),
so the count is rewritten exactly: accounts are first aggregated per
(household, type), then attached to each member.  ``COUNT(*)`` over paths
equals the household-level count because every mate path ends in exactly
one account.  A hot household only raises the row count of a partial
aggregation and a one-sided join that AQE can split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class GraphSpec:
    """Node and edge tables of a property graph (names → DataFrames)."""
    nodes: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)            # label → (df, key)
    edges: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)      # label → (df, src, dst)


def client_graph(clients: DataFrame, households: DataFrame, accounts: DataFrame, advisors: DataFrame) -> GraphSpec:
    """The reference's ``client_graph``: solo household ids have no Household
    node, so their BELONGS_TO edges dangle and never match."""
    return GraphSpec(
        nodes={"Client": (clients, "client_key"), "Household": (households, "household_id"),
               "Account": (accounts, "account_id"), "Advisor": (advisors, "advisor_id")},
        edges={"BELONGS_TO": (clients, "client_key", "household_id"),
               "HOLDS": (accounts, "client_key", "account_id"),
               "ADVISED_BY": (clients, "client_key", "primary_advisor_id")})


def household_members(g: GraphSpec) -> DataFrame:
    """(Client)-[BELONGS_TO]->(Household) with an existing Household node."""
    edges, src, dst = g.edges["BELONGS_TO"]
    hh, hkey = g.nodes["Household"]
    return (edges.select(F.col(src).alias("client_key"), F.col(dst).alias("household_id"))
            .join(hh.select(F.col(hkey).alias("household_id")), "household_id", "left_semi"))


def household_mate_products(g: GraphSpec, exclude_self: bool = False) -> DataFrame:
    """Per client and account type: number of (mate, account) paths.

    ``exclude_self=False`` is the reference pattern (no ``mate <> me``
    predicate, so a client's own accounts count).  With ``True`` the
    client's own accounts are subtracted.
    Output: client_key, product (account type), signal (long).
    """
    members = household_members(g)
    hold, hsrc, _ = g.edges["HOLDS"]
    acc = hold.select(F.col(hsrc).alias("client_key"), F.col("account_type").alias("product"))
    per_hh = (members.join(acc, "client_key")
              .groupBy("household_id", "product").agg(F.count("*").alias("hh_n")))
    out = members.join(per_hh, "household_id")
    if exclude_self:
        own = acc.groupBy("client_key", "product").agg(F.count("*").alias("own_n"))
        out = (out.join(own, ["client_key", "product"], "left")
               .withColumn("hh_n", F.col("hh_n") - F.coalesce("own_n", F.lit(0)))
               .filter(F.col("hh_n") > 0))
    return out.select("client_key", "product", F.col("hh_n").cast("long").alias("signal"))


def advisor_book(g: GraphSpec) -> DataFrame:
    """(Client)-[ADVISED_BY]->(Advisor): clients and AuM per advisor; a client
    whose advisor id has no Advisor node is dropped (inner pattern)."""
    edges, src, dst = g.edges["ADVISED_BY"]
    adv, akey = g.nodes["Advisor"]
    return (edges.select(F.col(dst).alias("advisor_id"), F.col("total_aum_usd").cast("decimal(18,2)").alias("aum"))
            .groupBy("advisor_id").agg(F.count("*").alias("clients"), F.sum("aum").alias("aum"))
            .join(adv.select(F.col(akey).alias("advisor_id"), "name", "desk"), "advisor_id")
            .select("advisor_id", "name", "desk", "clients", F.col("aum").cast("double").alias("aum_usd")))
