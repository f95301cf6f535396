"""Readers for the two banks' raw files (SRC-01..10) and their decoding to
canonical vocabularies (JN-09 / ER-11).

Every reader takes a path (file, directory or glob) and returns a lazy
DataFrame with an explicit schema; Spark splits the files across tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.dates import from_epoch_ms, parse_dmy, parse_iso, parse_yyyymmdd

# ---------------------------------------------------------------------------
# Source codes → canonical labels (must equal the reference's).
# ---------------------------------------------------------------------------
ASSET_CLASS_CODES = {"EQ": "equity", "FI": "fixed_income", "FD": "fund", "ST": "structured",
                     "ALT": "alternative", "CASH": "cash", "SummitH": "cash", "FX": "fx"}
MANDATE_CODES = {"DSC": "discretionary", "ADV": "advisory", "EXE": "execution_only"}
PRODUCT_CODES = {"Summit-DIM": "discretionary", "Summit-AVM": "advisory", "Summit-EXO": "execution_only",
                 "Summit-LOM": "lombard", "Summit-MTG": "mortgage", "Summit-DEP": "deposit"}
TXN_CODES = {"BUY": "buy", "SEL": "sell", "TIN": "transfer_in", "TOU": "transfer_out", "FEE": "fee", "FXS": "fx"}
UNMAPPED = "unmapped"


def read_clients_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: bank A client CSV (header, quoted fields with embedded newlines)."""
    return (spark.read.schema(S.BANK_A_CLIENTS_CSV).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_curated_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC-02 / SRC-09 / SRC-10: curated CSV with an explicit schema."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def read_document_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_curated_csv(spark, path, S.DOCUMENT_MANIFEST_CSV)


def read_identity_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_curated_csv(spark, path, S.IDENTITY_TRUTH_CSV)


def read_fixed_width(spark: SparkSession, path: str, layout=S.BANK_A_PORTFOLIOS_LAYOUT) -> DataFrame:
    """SRC-03: fixed-width lines → one string column per field (right-trimmed).
    Short lines give NULL for fields past their end."""
    line = F.col("value")
    cols = []
    for name, start, length in layout:
        raw = F.substring(line, start + 1, length)
        cols.append(F.when(F.length(line) > start, F.rtrim(raw)).alias(name))
    return spark.read.text(path).select(*cols)


def portfolios_from_fixed_width(df: DataFrame) -> DataFrame:
    """Decode the bank A portfolio extract: ``_`` padding stripped from the
    benchmark, amount = implied-decimal integer / 100, date ``YYYYMMDD``."""
    amount = F.expr("try_cast(marktwert_chf AS DECIMAL(15,0))") / F.lit(100)
    return df.select(
        "kunde_nr",
        decode_column(F.col("mandat_code"), MANDATE_CODES).alias("mandate_type"),
        F.regexp_replace("benchmark_cd", "_+$", "").alias("benchmark"),
        F.col("waehrung").alias("currency"),
        amount.cast("decimal(15,2)").alias("market_value_chf"),
        parse_yyyymmdd("eroeffnung").alias("inception_date"))


def read_positions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: bank A positions."""
    return spark.read.schema(S.BANK_A_POSITIONS).parquet(path)


def read_clients_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: bank B nested client master (one JSON object per line)."""
    return spark.read.schema(S.BANK_B_CLIENTS_JSON).json(path)


def read_accounts_xml(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: bank B accounts, one row per ``<Account>``; the ``cif``
    attribute arrives as ``_cif``."""
    return (spark.read.format("xml").option("rowTag", "Account").schema(S.BANK_B_ACCOUNTS_XML)
            .option("dateFormat", "yyyy-MM-dd").load(path))


def read_transactions_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: bank B transactions; event time from epoch milliseconds."""
    return (spark.read.schema(S.BANK_B_TRANSACTIONS_JSON).json(path)
            .withColumn("value_ts", from_epoch_ms("valueDateMs")))


# -- SRC-05: workbooks ------------------------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """Rows of one sheet of an .xlsx (stdlib zip + XML; no spreadsheet library)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = None
    for s in wb.find("m:sheets", _NS):
        if s.get("name") == sheet:
            rid = s.get(_REL)
            for r in rels:
                if r.get("Id") == rid:
                    target = r.get("Target")
    if target is None:
        return []
    target = target.lstrip("/")
    target = target if target.startswith("xl/") else "xl/" + target
    out = []
    for row in ET.fromstring(z.read(target)).iter(f"{{{_NS['m']}}}row"):
        vals: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            else:
                val = v.text if v is not None else None
            vals[_col_index(c.get("r"))] = val
        if vals:
            out.append([vals.get(i) for i in range(max(vals) + 1)])
    return out


def read_workbooks(spark: SparkSession, path: str, sheet: str = "Advisors",
                   schema=S.BANK_A_ADVISORS_XLSX) -> DataFrame:
    """SRC-05: one sheet of many .xlsx files; each file is parsed in a task
    (``binaryFile`` + ``mapInPandas``), the header row mapped to ``schema``."""
    names = schema.fieldNames()

    def parse(it):
        for pdf in it:
            for content in pdf["content"]:
                rows = _sheet_rows(bytes(content), sheet)
                if not rows:
                    continue
                header = [str(h) if h is not None else "" for h in rows[0]]
                idx = [header.index(n) if n in header else None for n in names]
                recs = [[(r[i] if i is not None and i < len(r) else None) for i in idx] for r in rows[1:]]
                yield pd.DataFrame(recs, columns=names)
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
            .select("content").mapInPandas(parse, schema))


# -- decoding (JN-09 / ER-11) ---------------------------------------------------------------------------
def decode_table(spark: SparkSession, mapping: dict[str, str], key: str = "code", value: str = "label") -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), f"{key} string, {value} string")


def decode_join(df: DataFrame, col: str, mapping: dict[str, str], out: str) -> DataFrame:
    """Code → label by a broadcast join with the fixed decode table (size
    bounded by the mapping); an unknown code becomes ``unmapped``."""
    t = decode_table(df.sparkSession, mapping, "_code", "_label")
    return (df.join(F.broadcast(t), F.col(col) == F.col("_code"), "left")
            .withColumn(out, F.coalesce(F.col("_label"), F.lit(UNMAPPED))).drop("_code", "_label"))


def decode_column(c, mapping: dict[str, str]):
    """Same decoding as a literal map lookup (no join)."""
    from ..functions.text import map_lookup
    return map_lookup(c, mapping, UNMAPPED)


def positions_canonical(df: DataFrame) -> DataFrame:
    """Bank A positions → (source_key, isin, asset_class, market_value_chf, currency)."""
    return (decode_join(df, "ASSET_CLASS_CD", ASSET_CLASS_CODES, "asset_class")
            .select(F.col("KUNDE_NR").alias("source_key"), F.col("ISIN").alias("isin"), "asset_class",
                    F.col("MARKTWERT_CHF").alias("market_value_chf"), F.col("WAEHRUNG").alias("currency")))


def accounts_canonical(df: DataFrame) -> DataFrame:
    """Bank B accounts → canonical account rows (status case-folded, STR-12)."""
    return (decode_join(df, "ProductCode", PRODUCT_CODES, "account_type")
            .select(F.col("_cif").alias("source_key"), "account_type",
                    F.col("BookingCenter").alias("booking_centre"), F.col("Currency").alias("currency"),
                    F.col("Balance").alias("balance"), F.lower("Status").alias("status"),
                    F.col("OpenedDate").alias("open_date")))


def transactions_canonical(df: DataFrame) -> DataFrame:
    """Bank B transactions → canonical rows; counterparty folded to lower case."""
    return (decode_join(df, "txCode", TXN_CODES, "txn_type")
            .select(F.col("cif").alias("source_key"), "txn_type", F.col("amount").alias("amount"),
                    F.col("ccy").alias("currency"), F.to_date("value_ts").alias("value_date"),
                    F.lower("counterparty").alias("counterparty"), F.col("fxLeg").alias("fx_leg")))


__all__ = ["read_clients_csv", "read_curated_csv", "read_document_manifest", "read_identity_truth",
           "read_fixed_width", "portfolios_from_fixed_width", "read_positions_parquet", "read_clients_json",
           "read_accounts_xml", "read_transactions_json", "read_workbooks", "decode_join", "decode_column",
           "positions_canonical", "accounts_canonical", "transactions_canonical", "parse_dmy", "parse_iso"]
