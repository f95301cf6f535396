import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from clientlens.sources.versions import Versions, fingerprint


def test_readers_see_the_last_complete_version(spark, tmp_path):
    kept = Versions(spark, f"file://{tmp_path}/results")
    assert kept.current("t") is None
    calls = []
    one = kept.table("t", lambda: (calls.append(1), spark.range(3).toDF("x"))[1])
    assert kept.table("t", lambda: (calls.append(1), spark.range(9).toDF("x"))[1]).count() == one.count() == 3 and len(calls) == 1
    first = kept.current("t")
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        kept.replace("t", bad)
    assert kept.current("t") == first and spark.read.parquet(first).count() == 3
    two = kept.replace("t", spark.range(7).toDF("x"))
    assert kept.current("t") != first and two.count() == 7 and one.count() == 3  # a reader of the old version goes on
    assert kept.prune("t") >= 1 and kept.prune("t") == 0 and kept.table("t", None).count() == 7


def test_a_model_is_fitted_once(spark, tmp_path):
    kept, fits = Versions(spark, f"file://{tmp_path}/results"), []
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")

    def fit():
        fits.append(1)
        return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v"), StandardScaler(inputCol="v", outputCol="s", withMean=True)]).fit(df)
    for _ in range(2):
        model = kept.model("m", fit)
    assert len(fits) == 1 and model.stages[-1].mean[0] == 2.0


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    before = fingerprint(spark, spark.read.parquet(path))
    assert before == fingerprint(spark, spark.read.parquet(path))
    spark.range(4).write.mode("overwrite").parquet(path)
    assert before != fingerprint(spark, spark.read.parquet(path))
