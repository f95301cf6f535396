"""MLlib models: k-means segmentation (TVF-10) and the attrition classifier
(TVF-08 / TVF-09).  Training and scoring are distributed MLlib jobs; the
only driver-side values are model metadata (centroids, importances)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import ATTRITION_FEATURES, SEGMENT_FEATURES

CATEGORICAL = ["segment_tier", "region", "risk_profile"]


# -- segmentation ---------------------------------------------------------------------------------
def train_segments(features: DataFrame, k: int = 8, seed: int = 42, cols: list[str] = SEGMENT_FEATURES,
                   max_iter: int = 20) -> PipelineModel:
    """Standardised features (mean 0, sd 1) → k-means with k clusters."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="_std", predictionCol="_cluster", maxIter=max_iter),
    ]).fit(features)


def assign_segments(model: PipelineModel, features: DataFrame, id_col: str = "client_id") -> DataFrame:
    """client → segment, segments renumbered 0.. by descending size (ties by
    the model's cluster id) so ids are stable across runs."""
    p = model.transform(features).select(id_col, "_cluster")
    sizes = p.groupBy("_cluster").agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.col("_n").desc(), "_cluster")  # ≤ k rows
    ren = sizes.withColumn("segment", (F.row_number().over(order) - 1).cast("int")).select("_cluster", "segment")
    return p.join(F.broadcast(ren), "_cluster").select(id_col, "segment")  # ≤ k rows


# -- attrition classifier --------------------------------------------------------------------------
def _encoders(cat: list[str]):
    idx = [StringIndexer(inputCol=c, outputCol=f"_{c}_ix", handleInvalid="keep") for c in cat]
    ohe = OneHotEncoder(inputCols=[f"_{c}_ix" for c in cat], outputCols=[f"_{c}_oh" for c in cat],
                        handleInvalid="keep", dropLast=False)
    return idx + [ohe]


def balanced_weights(train: DataFrame, label: str = "attrited") -> DataFrame:
    """auto_class_weights: w(class) = n / (n_classes · n_class)."""
    counts = train.groupBy(label).agg(F.count("*").alias("_nc"))  # one row per class
    total = F.sum("_nc").over(Window.partitionBy())
    classes = F.count("*").over(Window.partitionBy())
    w = counts.select(label, (total / (classes * F.col("_nc"))).alias("_w"))
    return train.join(F.broadcast(w), label)


def train_attrition(train: DataFrame, label: str = "attrited", max_iter: int = 30, seed: int = 42,
                    features: list[str] = ATTRITION_FEATURES) -> PipelineModel:
    """Boosted trees on the attrition features; ``dual_banked`` is left out
    on purpose (it saturates the ranking, as the reference notes)."""
    cat = [c for c in features if c in CATEGORICAL]
    num = [c for c in features if c not in CATEGORICAL]
    data = balanced_weights(train.withColumn(label, F.col(label).cast("double")), label)
    return Pipeline(stages=_encoders(cat) + [
        VectorAssembler(inputCols=[f"_{c}_oh" for c in cat] + num, outputCol="_x", handleInvalid="keep"),
        GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=max_iter, seed=seed, maxDepth=4),
    ]).fit(data)


def score_attrition(model: PipelineModel, scoring: DataFrame) -> DataFrame:
    """TVF-09: flight_risk = P(label = 1)."""
    keep = [c for c in ["client_id", "segment_tier", "region", "total_aum_usd", "dual_banked",
                        "recent_net_flow_usd", "outflow_ratio"] if c in scoring.columns]
    return (model.transform(scoring)
            .select(*keep, vector_to_array("probability")[1].alias("flight_risk")))


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """TVF-09b: importance per input feature (one-hot slots summed), desc.

    Spark reports gain-based importance, the reference "weight": same
    ranking idea, another scale."""
    gbt = model.stages[-1]
    asm = model.stages[-2]
    names = []
    for c in asm.getInputCols():
        if c.startswith("_") and c.endswith("_oh"):
            base = c[1:-3]
            ix = next(s for s in model.stages if hasattr(s, "labels") and s.getOutputCol() == f"_{base}_ix")
            names += [base] * (len(ix.labels) + 1)
        else:
            names.append(c)
    imp = gbt.featureImportances.toArray()
    acc: dict[str, float] = {}
    for n, v in zip(names, imp):
        acc[n] = acc.get(n, 0.0) + float(v)
    rows = sorted(acc.items(), key=lambda kv: (-kv[1], kv[0]))
    return spark.createDataFrame(rows, "feature string, importance double")  # one row per feature
