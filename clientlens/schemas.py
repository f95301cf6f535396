"""Explicit schemas for every raw source (never ``inferSchema``)."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Bank A client master, CSV with Swiss-German headers (SRC-01).
BANK_A_CLIENTS_CSV = _strings("kunde_nr", "name", "geburtsdatum", "domizil", "buchungszentrum", "segment",
                              "risiko_profil", "kyc_status", "sprachen", "email", "telefon", "adresse", "ort",
                              "waehrung")

# Bank A fixed-width portfolio extract (SRC-03): (name, start, length), 0-based.
BANK_A_PORTFOLIOS_LAYOUT = [("kunde_nr", 0, 9), ("mandat_code", 9, 4), ("benchmark_cd", 13, 10),
                            ("waehrung", 23, 3), ("marktwert_chf", 26, 15), ("eroeffnung", 41, 8)]

# Bank A positions, Parquet (SRC-04).
BANK_A_POSITIONS = T.StructType([
    T.StructField("KUNDE_NR", T.StringType()), T.StructField("ISIN", T.StringType()),
    T.StructField("ASSET_CLASS_CD", T.StringType()), T.StructField("MARKTWERT_CHF", T.DoubleType()),
    T.StructField("WAEHRUNG", T.StringType())])

# Bank A advisor workbook, sheet "Advisors" (SRC-05).
BANK_A_ADVISORS_XLSX = _strings("Advisor ID", "Name", "Role", "Desk", "Booking Centre", "Market", "Languages")

# Bank B nested client master, NDJSON (SRC-06).
BANK_B_CLIENTS_JSON = T.StructType([
    T.StructField("cifNumber", T.StringType()),
    T.StructField("client", T.StructType([
        T.StructField("displayName", T.StringType()), T.StructField("isLegalEntity", T.BooleanType()),
        T.StructField("dateOfBirth", T.StringType()), T.StructField("clientSegment", T.StringType()),
        T.StructField("riskProfile", T.StringType()),
        T.StructField("languages", T.ArrayType(T.StringType()))])),
    T.StructField("kyc", T.StructType([T.StructField("status", T.StringType())])),
    T.StructField("address", T.StructType([T.StructField("line1", T.StringType()),
                                           T.StructField("city", T.StringType()),
                                           T.StructField("country", T.StringType())])),
    T.StructField("contact", T.StructType([T.StructField("email", T.StringType()),
                                           T.StructField("phone", T.StringType())])),
    T.StructField("booking", T.StructType([T.StructField("center", T.StringType()),
                                           T.StructField("baseCcy", T.StringType())])),
])

# Bank B accounts, XML rows <Account cif=".."> (SRC-07); attributes arrive with a "_" prefix.
BANK_B_ACCOUNTS_XML = T.StructType([
    T.StructField("_cif", T.StringType()), T.StructField("ProductCode", T.StringType()),
    T.StructField("BookingCenter", T.StringType()), T.StructField("Currency", T.StringType()),
    T.StructField("Balance", T.DoubleType()), T.StructField("Status", T.StringType()),
    T.StructField("OpenedDate", T.DateType())])

# Bank B transactions, NDJSON (SRC-08).
BANK_B_TRANSACTIONS_JSON = T.StructType([
    T.StructField("cif", T.StringType()), T.StructField("txCode", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("ccy", T.StringType()),
    T.StructField("valueDateMs", T.LongType()), T.StructField("counterparty", T.StringType()),
    T.StructField("fxLeg", T.StringType())])

# Document manifest with extracted text (SRC-09).
DOCUMENT_MANIFEST_CSV = _strings("document_id", "gcs_uri", "doc_type", "client_id", "title", "parsed_text")

# Identity ground truth, offline scoring only (SRC-10).
IDENTITY_TRUTH_CSV = T.StructType([
    T.StructField("master_client_id", T.StringType()), T.StructField("source_banks", T.StringType()),
    T.StructField("dual_banked", T.BooleanType())])
