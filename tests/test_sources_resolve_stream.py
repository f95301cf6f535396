import json
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from clientlens.operators import resolve as ER
from clientlens.sources import raw as R
from clientlens.sources import sinks as K
from clientlens.streaming import monitors as M


def test_bank_a_csv_with_newline_and_bad_date(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("kunde_nr,name,geburtsdatum,domizil,buchungszentrum,segment,risiko_profil,kyc_status,sprachen,"
                "email,telefon,adresse,ort,waehrung\n")
        f.write('A00000001,H. Müller,31.12.1970,Switzerland,Zurich,HNW,Balanced,verified,German;English,'
                'h.mueller7@apex.ch,+41 44 000 00 01,"Bahnhofstr. 1\nPostfach",Zurich,CHF\n')
        f.write("A00000002,ANNA MEIER,31.02.1980,CH,Geneva,UHNW,Growth,expired,French,anna@apex.ch,"
                "+41 22 000 00 02,Rue 2,Geneva,CHF\n")
    raw = R.read_clients_csv(spark, p)
    st = {r.source_key: r for r in ER.stage_bank_a(raw).collect()}
    assert len(st) == 2
    assert "\n" in st["A00000001"].address_line
    assert str(st["A00000001"].dob) == "1970-12-31" and st["A00000002"].dob is None
    assert st["A00000002"].full_name == "Anna Meier" and st["A00000002"].domicile == "Switzerland"
    assert st["A00000001"].languages == "English|German" and st["A00000001"].email_local == "h.mueller"


def test_fixed_width(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "p.txt")
    with open(p, "w") as f:
        f.write("A00000001DSC MSCIWORLD CHF00000001234567820200131\n")
        f.write("A00000002EXE G60_40____USD00000000000000020191001\n")
        f.write("A00000003ADV SMI_______\n")
    rows = {r.kunde_nr: r for r in R.portfolios_from_fixed_width(R.read_fixed_width(spark, p)).collect()}
    assert rows["A00000001"].mandate_type == "discretionary" and float(rows["A00000001"].market_value_chf) == 123456.78
    assert rows["A00000002"].benchmark == "G60_40" and float(rows["A00000002"].market_value_chf) == 0.0
    assert rows["A00000003"].benchmark == "SMI" and rows["A00000003"].market_value_chf is None
    assert str(rows["A00000001"].inception_date) == "2020-01-31"


def test_positions_decode_both_cash_spellings(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "pos.parquet")
    pd.DataFrame({"KUNDE_NR": ["A1", "A1", "A2"], "ISIN": ["X1", "X2", "X3"], "ASSET_CLASS_CD": ["CASH", "SummitH", "ZZ"],
                  "MARKTWERT_CHF": [1.0, 2.0, 3.0], "WAEHRUNG": ["CHF"] * 3}).to_parquet(p)
    got = sorted(r.asset_class for r in R.positions_canonical(R.read_positions_parquet(spark, p)).collect())
    assert got == ["cash", "cash", "unmapped"]


def test_bank_b_json_xml_ndjson(spark, tmpdir_path):
    cj = os.path.join(tmpdir_path, "c.ndjson")
    with open(cj, "w") as f:
        f.write(json.dumps({"cifNumber": "Summit000000001", "client": {"displayName": "Müller, Hans", "isLegalEntity": False,
                            "dateOfBirth": "1970-12-31", "clientSegment": "HNW", "riskProfile": "Balanced",
                            "languages": ["German", "English"]}, "kyc": {"status": "VERIFIED"},
                            "address": {"line1": "Bahnhofstr. 1", "city": "Zurich", "country": "CH"},
                            "contact": {"email": "hans.mueller@summit.ch", "phone": "+41-44-000-00-01"},
                            "booking": {"center": "Zurich", "baseCcy": "CHF"}}) + "\n")
        f.write(json.dumps({"cifNumber": "Summit000000002"}) + "\n")  # missing structs
    st = {r.source_key: r for r in ER.stage_bank_b(R.read_clients_json(spark, cj)).collect()}
    assert st["Summit000000001"].full_name == "Hans Müller" and st["Summit000000001"].domicile == "Switzerland"
    assert st["Summit000000002"].dob is None
    xp = os.path.join(tmpdir_path, "a.xml")
    with open(xp, "w") as f:
        f.write('<?xml version="1.0"?>\n<Accounts>\n<Account cif="Summit000000001"><ProductCode>Summit-LOM</ProductCode>'
                '<BookingCenter>Zurich &amp; Geneva</BookingCenter><Currency>CHF</Currency><Balance>12.5</Balance>'
                '<Status>ACTIVE</Status><OpenedDate>2010-05-01</OpenedDate></Account>\n</Accounts>\n')
    a = R.accounts_canonical(R.read_accounts_xml(spark, xp)).collect()[0]
    assert (a.source_key, a.account_type, a.booking_centre, a.status) == ("Summit000000001", "lombard", "Zurich & Geneva",
                                                                           "active")
    tp = os.path.join(tmpdir_path, "t.ndjson")
    with open(tp, "w") as f:
        f.write(json.dumps({"cif": "S1", "txCode": "TOU", "amount": 9000.0, "ccy": "USD",
                            "valueDateMs": 1714521600000, "counterparty": "EXT_BANK", "fxLeg": None}) + "\n")
    t = R.transactions_canonical(R.read_transactions_json(spark, tp)).collect()[0]
    assert t.txn_type == "transfer_out" and str(t.value_date) == "2024-05-01" and t.fx_leg is None


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="Advisors" sheetId="1" r:id="rId1"/>'
                                      f'</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>Advisor ID</t></si><si><t>Name</t></si>'
                                           f'<si><t>Languages</t></si><si><t>German, English</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
                   f'<c r="G1" t="s"><v>2</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>ADV_1</t></is></c>'
                   f'<c r="B2" t="inlineStr"><is><t>Eva</t></is></c><c r="G2" t="s"><v>3</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmpdir_path):
    _xlsx(os.path.join(tmpdir_path, "adv.xlsx"))
    r = R.read_workbooks(spark, tmpdir_path).collect()
    assert len(r) == 1 and r[0]["Advisor ID"] == "ADV_1" and r[0]["Languages"] == "German, English" and r[0]["Role"] is None


def test_sinks_and_inventory(spark, tmpdir_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    K.write_csv(df, os.path.join(tmpdir_path, "out_csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "out_csv")).orderBy("a").collect()
    assert back[0].b is None and back[1].b == "x"
    calls = []
    t = K.cached_table(spark, os.path.join(tmpdir_path, "cache"), lambda: (calls.append(1), df)[1])
    t2 = K.cached_table(spark, os.path.join(tmpdir_path, "cache"), lambda: (calls.append(1), df)[1])
    assert t.count() == 2 and t2.count() == 2 and len(calls) == 1
    K.create_view(df, "inv_present")
    inv = {r.entity: (r.rows, r.status) for r in K.source_inventory(
        spark, [("A", "present", "CSV", "inv_present"), ("B", "absent", "XML", "inv_absent")]).collect()}
    assert inv == {"present": (2, "mapped"), "absent": (0, "pending")}
    out = K.run_lineage([("b", ["a"], lambda d: d["a"].withColumn("c", F.lit(1))), ("a", [], lambda d: df)])
    assert out["b"].count() == 2


def test_resolution_clusters_and_accuracy(spark):
    a = spark.createDataFrame([
        ("apex", "A1", "Hans Müller", "1970-12-31", "41440000001", "hans.mueller"),
        ("apex", "A2", "Eva Roth", "1980-01-01", "41440000002", "eva.roth"),
        ("apex", "A3", "Max Frei", "1990-05-05", None, None)],
        "source_bank string, source_key string, full_name string, dob string, phone string, email_local string")
    b = spark.createDataFrame([
        ("summit", "S1", "Hans Müller", "1970-12-31", "41440000009", "hans.mueller"),   # phone typo, e-mail matches
        ("summit", "S2", "Eva Roth", "1980-01-01", "41440000002", "eroth"),           # phone matches
        ("summit", "S3", "Ben Stein", "1990-05-05", None, None)],                      # same dob only: no link
        "source_bank string, source_key string, full_name string, dob string, phone string, email_local string")
    recs = (a.unionByName(b).withColumn("dob", F.to_date("dob"))
            .withColumn("record_id", F.concat_ws(":", "source_bank", "source_key"))
            .withColumn("name_norm", ER.name_norm("full_name")))
    res = ER.resolve(recs)
    cl = {r.record_id: r.cluster_id for r in res.collect()}
    assert cl["apex:A1"] == cl["summit:S1"] and cl["apex:A2"] == cl["summit:S2"]
    assert cl["apex:A3"] != cl["summit:S3"]
    truth = spark.createDataFrame([("apex:A1", 1), ("summit:S1", 1), ("apex:A2", 2), ("summit:S2", 2),
                                   ("apex:A3", 3), ("summit:S3", 4)], "record_id string, master_id long")
    acc = ER.pairwise_accuracy(res, truth).collect()[0]
    assert (acc.precision, acc.recall, acc.f1) == (1.0, 1.0, 1.0)


def test_streaming_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "tx")
    os.makedirs(src)
    base = 1714521600000
    recs = [{"cif": "S1", "txCode": "TOU", "amount": 8500.0 + i, "ccy": "USD", "valueDateMs": base + i * 86400000,
             "counterparty": "EXT", "fxLeg": None} for i in range(5)]
    for i, chunk in enumerate([recs[:3], recs[2:]]):  # record 2 delivered twice
        with open(os.path.join(src, f"part{i}.json"), "w") as f:
            f.write("\n".join(json.dumps(r) for r in chunk) + "\n")
    s = M.read_transactions_stream(spark, src, max_files=1)
    tx = R.transactions_canonical(M.dedup_replays(s, "value_ts"))
    tx = tx.select(F.lit(1).alias("client_key"), "txn_type", F.col("amount").alias("amount_usd"),
                   F.col("value_date").cast("timestamp").alias("value_ts"))
    out = M.run_available_now(M.structuring_windows(tx, delay=None), "t_struct", "update")
    got = {(str(r.window_start)[:10], r.n) for r in M.latest(spark, out, ["window_start", "client_key"]).collect()}
    batch = (spark.createDataFrame(pd.DataFrame(recs)).withColumn("value_ts", F.timestamp_millis("valueDateMs"))
             .groupBy(F.window("value_ts", "7 days", "1 day").alias("w")).count())
    want = {(str(r.w.start)[:10], r["count"]) for r in batch.collect()}
    assert got == want


def test_monthly_flows_of_late_rows_equal_the_batch(spark, tmpdir_path):
    src, base = os.path.join(tmpdir_path, "feed"), os.path.join(tmpdir_path, "stream")
    os.makedirs(src)

    def deliver(name, *rows):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(json.dumps({"cif": c, "txCode": code, "amount": a, "ccy": "USD", "valueDateMs": int(pd.Timestamp(day).timestamp() * 1000), "counterparty": "EXT", "fxLeg": None}) for c, code, a, day in rows) + "\n")
        os.utime(os.path.join(src, name), (1_700_000_000 + len(os.listdir(src)),) * 2)

    first = [("S1", "TIN", 100.0, "2024-01-05"), ("S1", "TOU", 30.5, "2024-01-20"), ("S2", "BUY", 7.0, "2024-01-09")]
    second = [("S1", "TIN", 5.0, "2024-02-25"), ("S2", "TIN", 8.25, "2024-01-31")]  # January is still open for the second
    late = [("S1", "TIN", 1.0, "2024-01-07"), ("S2", "TOU", 2.0, "2024-02-26"), ("S3", "TOU", 4.0, "2023-12-31")]
    deliver("a.json", *first)
    deliver("b.json", *second)
    log = M.run_monthly_flows(M.transactions_stream(spark, src, max_files=1), "t", "2 days", base)
    assert not M.monthly_totals(spark, log).where("n_corrections > 0").count()
    deliver("c.json", *late)
    assert M.run_monthly_flows(M.transactions_stream(spark, src, max_files=1), "t", "2 days", base) == log
    got = {(r.client_key, str(r.month)[:7]): (float(r.inflow_usd), float(r.outflow_usd), float(r.net_usd), r.n_corrections) for r in M.monthly_totals(spark, log).collect()}
    assert got == {("S1", "2024-01"): (101.0, 30.5, 70.5, 1), ("S2", "2024-01"): (8.25, 0.0, 8.25, 0), ("S1", "2024-02"): (5.0, 0.0, 5.0, 0),
                   ("S2", "2024-02"): (0.0, 2.0, -2.0, 0), ("S3", "2023-12"): (0.0, 4.0, -4.0, 1)}
    parts = spark.read.parquet(log)
    assert parts.select("batch").distinct().count() == 3
    # a batch that is run again replaces its part
    before = sorted(map(str, M.monthly_totals(spark, log).collect()))
    spark.read.parquet(os.path.join(log, "batch=1")).write.mode("overwrite").parquet(os.path.join(tmpdir_path, "again"))
    spark.read.parquet(os.path.join(tmpdir_path, "again")).write.mode("overwrite").parquet(os.path.join(log, "batch=1"))
    assert sorted(map(str, M.monthly_totals(spark, log).collect())) == before
    assert M.monthly_totals(spark, os.path.join(tmpdir_path, "none")).collect() == []
