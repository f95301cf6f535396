"""Unify & resolve over the test data (ER-*).

The two banks' raw client files are *derived by Spark* from the canonical
clients (bank membership from ``source_banks``), with the kinds of
mutations the reference's generator applies: ``Last, First`` order,
upper-case names, e-mail local parts with digits, formatted phones, one
phone typo in eleven, ``DD.MM.YYYY`` v ISO dates.  The true master id is
kept aside for ER-08 only and is never a matching feature (D11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve as ER
from ..operators.canonical import Client360


def bank_a_raw(c: Client360) -> DataFrame:
    k = F.col("client_key")
    cl = c.clients.filter(F.instr("source_banks", "apex") > 0)
    local = F.substring_index("email", "@", 1)
    return cl.select(
        F.format_string("A%08d", k).alias("kunde_nr"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.upper("full_name")).otherwise(F.col("full_name")).alias("name"),
        F.date_format("dob", "dd.MM.yyyy").alias("geburtsdatum"), F.col("domicile").alias("domizil"),
        F.col("booking_centre").alias("buchungszentrum"), F.col("segment_tier").alias("segment"),
        F.col("risk_profile").alias("risiko_profil"), F.col("kyc_status").alias("kyc_status"),
        F.regexp_replace("languages", r"\|", ";").alias("sprachen"),
        F.concat(local, F.lit("@apex.example")).alias("email"), F.col("phone").alias("telefon"),
        F.col("address_line").alias("adresse"), F.col("city").alias("ort"), F.lit("CHF").alias("waehrung"))


def bank_b_raw(c: Client360) -> DataFrame:
    k = F.col("client_key")
    cl = c.clients.filter(F.instr("source_banks", "summit") > 0)
    name = F.col("full_name")
    swapped = F.concat(F.substring_index(name, "#", -1), F.lit(", "), F.substring_index(name, "#", 1))
    disp = (F.when(F.pmod(k, F.lit(3)) == 0, swapped).when(F.pmod(k, F.lit(5)) == 0, F.upper(name)).otherwise(name))
    local = F.substring_index("email", "@", 1)
    email = F.concat(local, F.when(F.pmod(k, F.lit(4)) == 0, F.pmod(k, F.lit(97)).cast("string")).otherwise(F.lit("")),
                     F.lit("@summit.example"))
    phone = F.when(F.pmod(k, F.lit(11)) == 0, F.concat(F.col("phone"), F.lit("9")))\
        .otherwise(F.regexp_replace("phone", " ", "-"))
    return cl.select(
        F.format_string("Summit%09d", k).alias("cifNumber"),
        F.struct(disp.alias("displayName"), F.col("is_entity").alias("isLegalEntity"),
                 F.date_format("dob", "yyyy-MM-dd").alias("dateOfBirth"), F.col("segment_tier").alias("clientSegment"),
                 F.col("risk_profile").alias("riskProfile"), F.split("languages", r"\|").alias("languages"))
        .alias("client"),
        F.struct(F.upper("kyc_status").alias("status")).alias("kyc"),
        F.struct(F.col("address_line").alias("line1"), F.col("city").alias("city"),
                 F.col("domicile").alias("country")).alias("address"),
        F.struct(email.alias("email"), phone.alias("phone")).alias("contact"),
        F.struct(F.col("booking_centre").alias("center"), F.lit("USD").alias("baseCcy")).alias("booking"))


def truth(c: Client360) -> DataFrame:
    """(record_id, master_id) — offline scoring only."""
    cl = c.clients.select("client_key", "source_banks")
    a = cl.filter(F.instr("source_banks", "apex") > 0).select(
        F.format_string("apex:A%08d", "client_key").alias("record_id"), F.col("client_key").alias("master_id"))
    b = cl.filter(F.instr("source_banks", "summit") > 0).select(
        F.format_string("summit:Summit%09d", "client_key").alias("record_id"), F.col("client_key").alias("master_id"))
    return a.unionByName(b)


def staged(c: Client360) -> DataFrame:
    return ER.inbound(ER.stage_bank_a(bank_a_raw(c)), ER.stage_bank_b(bank_b_raw(c)))


def resolved(c: Client360) -> DataFrame:
    return ER.resolve(staged(c))
