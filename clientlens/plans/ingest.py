"""Raw-file ingest round trip (SRC-01..11, SNK-01..04).

The driver's test data has no bank files, so Spark first *derives* them
from the canonical tables in each bank's own format (the formats the
reference's generator writes), into the shared checkpoint folder, and the
raw readers then read them back.  Every file is written and read by Spark
tasks; nothing passes through the driver.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.canonical import Client360
from ..session import ensure_checkpoint_dir
from ..sources import raw as R
from ..sources import sinks as K
from . import unify as U

# Reverse maps (canonical label → source code) used only to write the files.
_ASSET_CODE = {v: k for k, v in R.ASSET_CLASS_CODES.items() if k != "SummitH"}
_MANDATE_CODE = {v: k for k, v in R.MANDATE_CODES.items()}
_PRODUCT_CODE = {v: k for k, v in R.PRODUCT_CODES.items()}
_TXN_CODE = {v: k for k, v in R.TXN_CODES.items()}
#: Text files are written compressed; each is read by one task, like the task
#: that wrote it, and Spark's readers know the format by the file name.
COMPRESSION = "gzip"
FILES = {"clients_csv": "apex_clients.csv", "portfolios_txt": "apex_portfolios.txt",
         "positions_parquet": "apex_positions.parquet", "clients_json": "summit_clients.ndjson",
         "accounts_xml": "summit_accounts.xml", "transactions_json": "summit_transactions.ndjson",
         "manifest_csv": "document_manifest.csv", "truth_csv": "identity_truth.csv",
         "advisors_xlsx": "apex_advisors_xlsx"}


def _lookup(c, mapping, default=None):
    from ..functions.text import map_lookup
    return map_lookup(c, mapping, default)


def export_raw_files(c: Client360, root: str | None = None) -> str:
    """Write the eight raw files under ``root`` (default: the shared
    checkpoint folder); returns the root."""
    root = root or os.path.join(ensure_checkpoint_dir(c.spark), f"raw-{uuid.uuid4().hex[:8]}")
    apex = c.clients.filter(F.instr("source_banks", "apex") > 0).select("client_key")
    summit = c.clients.filter(F.instr("source_banks", "summit") > 0).select("client_key")
    # the fixed-width line has eight digits for the key
    kunde = F.when(F.col("client_key") < 10 ** 8, F.format_string("A%08d", "client_key")).otherwise(F.raise_error(F.lit("client key too large for the fixed-width file")))
    cif = F.format_string("Summit%09d", "client_key")
    # SRC-01 / SNK-04: CSV, header, quoted fields
    K.write_csv(U.bank_a_raw(c), os.path.join(root, FILES["clients_csv"]), COMPRESSION)
    # SRC-03: fixed width, 49 characters
    pf = c.portfolios.join(apex, "client_key", "left_semi").filter(F.col("mandate_type").isin(*_MANDATE_CODE))
    line = F.concat(kunde, F.rpad(_lookup("mandate_type", _MANDATE_CODE), 4, " "),
                    F.rpad(F.lit("MSCIWORLD"), 10, "_"), F.lit("USD"),
                    F.lpad((F.col("market_value_usd").cast("decimal(18,2)") * 100).cast("decimal(18,0)").cast("string"),
                           15, "0"),
                    F.date_format("inception_date", "yyyyMMdd"))
    pf.select(line.alias("value")).write.mode("overwrite").option("compression", COMPRESSION).text(os.path.join(root, FILES["portfolios_txt"]))
    # SRC-04: parquet positions (cash written with both spellings, D2)
    h = c.holdings.join(apex, "client_key", "left_semi")
    code = F.when((F.col("asset_class") == "cash") & (F.pmod(F.xxhash64("holding_id"), F.lit(2)) == 0),
                  F.lit("SummitH")).otherwise(_lookup("asset_class", _ASSET_CODE, "ZZ"))
    K.write_table(h.select(F.format_string("A%08d", "client_key").alias("KUNDE_NR"), F.col("isin").alias("ISIN"),
                           code.alias("ASSET_CLASS_CD"), F.col("market_value_usd").alias("MARKTWERT_CHF"),
                           F.col("currency").alias("WAEHRUNG")), os.path.join(root, FILES["positions_parquet"]))
    # SRC-06: nested NDJSON
    U.bank_b_raw(c).write.mode("overwrite").option("compression", COMPRESSION).json(os.path.join(root, FILES["clients_json"]))
    # SRC-07: XML, one <Account cif=".."> per account
    a = c.accounts.join(summit, "client_key", "left_semi")
    (a.select(F.format_string("Summit%09d", "client_key").alias("_cif"),
              _lookup("account_type", _PRODUCT_CODE, "Summit-XXX").alias("ProductCode"),
              F.lit("Zurich & Geneva").alias("BookingCenter"), F.col("currency").alias("Currency"),
              F.col("balance_usd").alias("Balance"), F.upper("status").alias("Status"),
              F.col("open_date").alias("OpenedDate"))
     .write.mode("overwrite").format("xml").option("rowTag", "Account").option("rootTag", "Accounts")
     .option("dateFormat", "yyyy-MM-dd").option("compression", COMPRESSION).save(os.path.join(root, FILES["accounts_xml"])))
    # SRC-08: NDJSON transactions with epoch-ms value dates and a nullable fx leg
    t = c.transactions.join(summit, "client_key", "left_semi")
    (t.select(cif.alias("cif"), _lookup("txn_type", _TXN_CODE, "XXX").alias("txCode"), F.col("amount_usd").alias("amount"),
              F.col("currency").alias("ccy"), F.unix_millis(F.col("value_date").cast("timestamp")).alias("valueDateMs"),
              F.upper("counterparty").alias("counterparty"),
              F.when(F.col("txn_type") == "fx", F.lit("EURUSD")).alias("fxLeg"))
     .write.mode("overwrite").option("ignoreNullFields", False).option("compression", COMPRESSION).json(os.path.join(root, FILES["transactions_json"])))
    # SRC-09: document manifest with multi-line body text
    d = c.data.documents
    K.write_csv(d.select(F.format_string("DOC_%06d", "doc_id").alias("document_id"),
                         F.format_string("raw/documents/DOC_%06d.pdf", "doc_id").alias("gcs_uri"),
                         F.col("source").alias("doc_type"), F.lit(None).cast("string").alias("client_id"),
                         F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
                         F.col("text").alias("parsed_text")), os.path.join(root, FILES["manifest_csv"]), COMPRESSION)
    # SRC-05: advisor workbooks (bank A advisors), one .xlsx per partition
    adv = c.advisors.filter(F.col("source_bank") == "apex")
    K.write_workbooks(adv.select(F.col("advisor_id").alias("Advisor ID"), F.col("name").alias("Name"),
                                 F.col("role").alias("Role"), F.col("desk").alias("Desk"),
                                 F.col("booking_centre").alias("Booking Centre"), F.col("market").alias("Market"),
                                 F.col("languages").alias("Languages")),
                      os.path.join(root, FILES["advisors_xlsx"]), "Advisors")
    # SRC-10: identity truth
    K.write_csv(c.clients.select(F.col("client_id").alias("master_client_id"), "source_banks", "dual_banked"),
                os.path.join(root, FILES["truth_csv"]), COMPRESSION)
    return root


def read_raw_files(spark, root: str) -> dict[str, DataFrame]:
    p = {k: os.path.join(root, v) for k, v in FILES.items()}
    return {
        "clients_csv": R.read_clients_csv(spark, p["clients_csv"]),
        "portfolios_txt": R.portfolios_from_fixed_width(R.read_fixed_width(spark, p["portfolios_txt"])),
        "positions_parquet": R.positions_canonical(R.read_positions_parquet(spark, p["positions_parquet"])),
        "clients_json": R.read_clients_json(spark, p["clients_json"]),
        "accounts_xml": R.accounts_canonical(R.read_accounts_xml(spark, p["accounts_xml"])),
        "transactions_json": R.transactions_canonical(R.read_transactions_json(spark, p["transactions_json"])),
        "manifest_csv": R.read_document_manifest(spark, p["manifest_csv"]),
        "truth_csv": R.read_identity_truth(spark, p["truth_csv"]),
        "advisors_xlsx": R.read_workbooks(spark, p["advisors_xlsx"], "Advisors"),
    }


INVENTORY = [("Apex Bank", "Client master", "CSV", "clients_csv"),
             ("Apex Bank", "Portfolios", "FIXED_WIDTH", "portfolios_txt"),
             ("Apex Bank", "Positions", "PARQUET", "positions_parquet"),
             ("Apex Bank", "Advisors", "XLSX", "advisors_xlsx"),
             ("Summit Bank", "Client master", "JSON", "clients_json"),
             ("Summit Bank", "Accounts", "XML", "accounts_xml"),
             ("Summit Bank", "Transactions", "NDJSON", "transactions_json")]


def ingest(c: Client360) -> tuple[str, dict[str, DataFrame]]:
    root = export_raw_files(c)
    frames = read_raw_files(c.spark, root)
    for name, df in frames.items():
        K.create_view(df, f"raw_{name}")
    return root, frames


def source_inventory(c: Client360) -> DataFrame:
    """SRC-11 over the round-tripped files."""
    ingest(c)
    return K.source_inventory(c.spark, [(b, e, f, f"raw_{v}") for b, e, f, v in INVENTORY])
