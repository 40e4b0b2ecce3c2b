"""Learning: splits with leak guards, boosted trees with chosen rounds, calibration by lead bin, importance."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from nimboscale.operators.resample import permuted


def with_buffer(days: DataFrame, day: str, buffer: int) -> DataFrame:
    """Every day of the table and ``buffer`` days around it."""
    return days.select(F.explode(F.transform(F.sequence(F.lit(-buffer), F.lit(buffer)), lambda d: F.date_add(day, d.cast("int")))).alias(day)).distinct()


def leaks(train: DataFrame, validation: DataFrame, events: DataFrame, day: str, buffer: int) -> DataFrame:
    """(day, reason) of days that must not be used: in both splits, or within ``buffer`` days of an event."""
    t, v = train.select(day).distinct(), validation.select(day).distinct()
    both = t.intersect(v).withColumn("reason", F.lit("both splits"))
    near = t.union(v).distinct().join(with_buffer(events, day, buffer), day, "left_semi").withColumn("reason", F.lit("near an event"))
    return both.unionByName(near)


def guarded(rows: DataFrame, leak: DataFrame, day: str) -> DataFrame:
    """``rows``, failing if one lies on a day of ``leak``."""
    bad = leak.select(day).distinct().withColumn("_bad", F.lit(True))
    met = rows.join(bad, day, "left")
    keep = F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("day not allowed: "), F.col(day).cast("string")))).otherwise(F.col(day))
    return met.withColumn(day, keep).drop("_bad")


def log_loss(p: Column, y: Column, w: Column, eps: float = 1e-15) -> Column:
    """Weighted log-loss aggregate."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.sum(w * (y * F.ln(q) + (1 - y) * F.ln(1 - q))) / F.sum(w)


def feature_stage(features: list[str]) -> Pipeline:
    """Medians for missing values, and an indicator column for each feature; NaN counts as missing."""
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=[f"{f}_filled" for f in features], strategy="median"),
                            VectorAssembler(inputCols=[f"{f}_filled" for f in features] + [f"{f}_missing" for f in features], outputCol="features")])


def indicated(rows: DataFrame, features: list[str]) -> DataFrame:
    clean = rows.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features})
    return clean.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features})


def fit_boosted(train: DataFrame, validation: DataFrame, features: list[str], label: str, weight: str, rounds: int = 20, depth: int = 3, seed: int = 7):
    """(feature model, trees, losses): trees stop at the validation arg-min of the weighted log-loss.

    The boosting loss is twice the log-loss, so its arg-min is the same; it is
    halved in ``losses``.
    """
    stage = feature_stage(features).fit(indicated(train, features))
    a, b = (stage.transform(indicated(d, features)).select("features", F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight")).cache() for d in (train, validation))
    fit = lambda n: GBTClassifier(weightCol="weight", maxIter=n, maxDepth=depth, stepSize=0.2, seed=seed).fit(a)
    model: GBTClassificationModel = fit(rounds)
    losses = [x / 2 for x in model.evaluateEachIteration(b)]
    best = losses.index(min(losses)) + 1
    model = model if best == rounds else fit(best)
    a.unpersist()
    b.unpersist()
    return stage, model, losses


def scored(rows: DataFrame, stage, model, features: list[str], out: str = "p") -> DataFrame:
    made = model.transform(stage.transform(indicated(rows, features)))
    return made.withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


def calibrated(validation: DataFrame, rows: DataFrame, p: str, label: str, weight: str, bin_col: str, bins: list[int], out: str = "calibrated") -> DataFrame:
    """Weighted isotonic calibration for each bin; rows outside all bins, or in bins without validation rows, get null."""
    made = rows.where(F.lit(False)).withColumn(out, F.lit(None).cast("double"))
    known = F.lit(False)
    for b in bins:
        part = validation.where(F.col(bin_col) == b).select(F.col(p).alias("features"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
        if part.isEmpty():
            continue
        model = IsotonicRegression(weightCol="weight").fit(part)
        mine = model.transform(rows.where(F.col(bin_col) == b).withColumn("features", F.col(p)))
        made = made.unionByName(mine.select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias(out)))
        known = known | (F.col(bin_col) == b)
    return made.unionByName(rows.where(~F.coalesce(known, F.lit(False))).withColumn(out, F.lit(None).cast("double")))


def save_model(stage, model, path: str, card: dict) -> str:
    """Write both parts and a card beside them; returns the card's digest, which ``load_model`` wants back."""
    import hashlib
    import json

    from pyspark.sql import SparkSession

    stage.write().overwrite().save(f"{path}/features")
    model.write().overwrite().save(f"{path}/trees")
    text = json.dumps(card, sort_keys=True)
    SparkSession.active().createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")
    return hashlib.sha256(text.encode()).hexdigest()


def load_model(spark, path: str, digest: str):
    """(feature model, trees, card); raises if the card is not the one that was saved."""
    import hashlib
    import json

    from pyspark.ml import PipelineModel

    text = spark.read.text(f"{path}/card").first()[0]
    if hashlib.sha256(text.encode()).hexdigest() != digest:
        raise ValueError("the model card differs from the recorded one")
    return PipelineModel.load(f"{path}/features"), GBTClassificationModel.load(f"{path}/trees"), json.loads(text)


def permutation_importance(rows: DataFrame, stage, model, features: list[str], label: str, weight: str, key: str, seed: int = 11) -> DataFrame:
    """(feature, increase) of the weighted log-loss when the feature is shuffled over all rows."""
    loss = lambda d: scored(d, stage, model, features).agg(log_loss(F.col("p"), F.col(label), F.col(weight)).alias("loss"))
    base = loss(rows)
    out = None
    for k, f in enumerate(features):
        one = loss(permuted(rows, f, key, seed + k)).withColumn("feature", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(base.withColumnRenamed("loss", "_base"))).select("feature", (F.col("loss") - F.col("_base")).alias("increase"))
