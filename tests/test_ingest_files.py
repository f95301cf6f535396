import os

from clientlens.plans.ingest import FILES, export_raw_files, read_raw_files
from clientlens.plans.registry import c360
from clientlens.sources.raw import read_curated_csv
from clientlens.sources.sinks import write_csv


def test_text_files_of_the_banks_are_compressed_and_read_back(spark, tmpdir_path):
    c = c360(spark, "/root/testdata/sf0.001")
    root = export_raw_files(c, tmpdir_path)
    for name in ("clients_csv", "portfolios_txt", "clients_json", "accounts_xml", "transactions_json", "manifest_csv", "truth_csv"):
        parts = [f for f in os.listdir(os.path.join(root, FILES[name])) if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts), name
    frames = read_raw_files(spark, root)
    assert frames["manifest_csv"].count() == c.data.documents.count()
    assert frames["truth_csv"].count() == c.clients.count()


def test_compressed_csv_keeps_every_field(spark, tmpdir_path):
    rows = [("a", 'two\nlines, "quoted"'), ("b", None), ("c", "é ü")]
    df = spark.createDataFrame(rows, "k string, v string")
    write_csv(df, tmpdir_path + "/t.csv", "gzip")
    assert sorted(map(tuple, read_curated_csv(spark, tmpdir_path + "/t.csv", df.schema).collect())) == rows
