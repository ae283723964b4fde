"""Model store: trained forecasts in versioned folders, a registry of their versions, and forecasts that pass the display gate.

A version's folder holds the fitted pipeline, the isotonic curve and one JSON row of metadata. It is written whole before the pointer
`current` is renamed over the last one, so a reader sees the old model or the new one. Versions are never written over; which version serves is the pointer's, and
for every definition the registry's, matter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import rules, text
from tidewire.operators import forecast
from tidewire.sources import io

CURVE = "array<struct<binLow: double, binHigh: double, meanPredicted: double, empiricalRate: double, n: bigint>>"
METADATA = f"version string, definition_version int, trained_at timestamp, data_source string, n_train bigint, n_test bigint, train_start timestamp, train_end timestamp, test_start timestamp, test_end timestamp, brier double, brier_uncalibrated double, log_loss double, curve {CURVE}, features array<string>"
LEAST = 200
FORECAST = f"claim_id bigint, definition_id bigint, model_id bigint, predicted_at timestamp, features map<string,double>, feature_hash string, raw double, calibrated double, low double, high double, model_version string, display_mode string, reason string"


@dataclass
class Bundle:
    """What scoring needs: the fitted pipeline, the calibration and the metadata (one row, as a dict)."""

    pipeline: PipelineModel
    isotonic: IsotonicRegressionModel
    metadata: dict


def curve_of(df: DataFrame, p: str, y: str) -> list[tuple]:
    """The calibration curve's bins that have rows: at most ten."""
    rows = forecast.calibration_bins(df, p, y).orderBy("bin").collect()
    return [(r["bin"] / 10, (r["bin"] + 1) / 10, r["mean_predicted"], r["empirical_rate"], r["n"]) for r in rows]


def train_bundle(df: DataFrame, data_source: str, trained_at: datetime, definition_version: int = 1, least: int = LEAST) -> Bundle:
    """A bundle from features, `label`, `as_of` and `split` (ML2). data_source: "db" for real outcomes, "synthetic" else."""
    rows = io.materialise(df.where("label is not null"), "bundle-rows")
    model, isotonic, metrics = forecast.train_forecast(rows, least)
    m = metrics.first()
    test = forecast.score_forecasts(rows.where("split = 'test'"), model, isotonic)
    part = lambda name: (F.col("split") == name)
    at = F.col("as_of").cast("timestamp")
    b = rows.agg(
        F.count_if(part("train")).alias("n_train"), F.count_if(part("test")).alias("n_test"),
        F.min(F.when(part("train"), at)).alias("train_start"), F.max(F.when(part("train"), at)).alias("train_end"), F.min(F.when(part("test"), at)).alias("test_start"), F.max(F.when(part("test"), at)).alias("test_end"),
    ).first()
    version = f"forecast-v{definition_version}-{data_source}-{trained_at:%Y%m%dT%H%M%S}"
    found = {"version": version, "definition_version": definition_version, "trained_at": trained_at, "data_source": data_source} | b.asDict()
    found |= {"brier": m["brier"], "brier_uncalibrated": m["brier_raw"], "log_loss": m["log_loss"], "curve": curve_of(test, "p", "label"), "features": list(forecast.FEATURES)}
    return Bundle(model, isotonic, found)


def metadata_row(spark: SparkSession, bundle: Bundle) -> DataFrame:
    names = [f.name for f in spark.createDataFrame([], METADATA).schema]
    return spark.createDataFrame([tuple(bundle.metadata[n] for n in names)], METADATA)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Point `current` at a version: written beside and renamed over, which file systems do in one step (object stores without a rename do
    not; there the registry is the one to ask)."""
    beside, fs = _fs(spark, f"{root}/.current-{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(version.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    target, _ = _fs(spark, f"{root}/current")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(beside), fs.makeQualified(target), how)


def save_model(spark: SparkSession, bundle: Bundle, root: str, current: bool = True) -> str:
    """Keep a bundle under root/version and make it the current one (SNK3). A version that is there is an error. Returns the folder."""
    folder = f"{root}/{bundle.metadata['version']}"
    if exists(spark, folder):
        raise ValueError(f"{folder} is there; versions are not written over")
    # written beside and renamed at last: a run that fails leaves no half version
    part = f"{root}/.part-{uuid.uuid4().hex}"
    bundle.pipeline.write().save(f"{part}/pipeline")
    bundle.isotonic.write().save(f"{part}/isotonic")
    metadata_row(spark, bundle).coalesce(1).write.json(f"{part}/metadata")
    source, fs = _fs(spark, part)
    target, _ = _fs(spark, folder)
    if not fs.rename(source, target):
        raise OSError(f"could not rename {part} to {folder}")
    if current:
        publish(spark, root, bundle.metadata["version"])
    return folder


def current_version(spark: SparkSession, root: str) -> str | None:
    if not exists(spark, f"{root}/current"):
        return None
    return spark.read.text(f"{root}/current").first()["value"]


def load_model(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """The bundle of a version, else of the current one. A model of other features than this library's is an error."""
    version = version or current_version(spark, root)
    if not version or not exists(spark, f"{root}/{version}/metadata"):
        raise ValueError(f"no model {version or ''} in {root}")
    found = spark.read.schema(METADATA).json(f"{root}/{version}/metadata").first().asDict()
    if tuple(found["features"]) != forecast.FEATURES:
        raise ValueError(f"{version} was trained on other features: {found['features']}")
    return Bundle(PipelineModel.load(f"{root}/{version}/pipeline"), IsotonicRegressionModel.load(f"{root}/{version}/isotonic"), found)


# ---- registry ------------------------------------------------------------------------------------------------------------------------


def register_model(models: DataFrame, bundle: Bundle, definition_id: int, registered_at: datetime, min_samples: int = LEAST) -> DataFrame:
    """The one registry row of a bundle, to append: registering is all that makes a version current."""
    row = metadata_row(models.sparkSession, bundle).drop("features", "definition_version")
    key = F.pmod(F.xxhash64("version"), F.lit(1 << 62))
    return row.select(key.alias("id"), F.lit(definition_id).cast("long").alias("definition_id"), "*", F.lit(min_samples).alias("min_samples"), F.lit(registered_at).cast("timestamp").alias("registered_at"))


def registry(models: DataFrame) -> DataFrame:
    """The versions as they stand: one row each, the last registration counting, and is_current for the one registered last of its
    definition; by that every registration demotes the one before. models: append-only, with registered_at and id."""
    latest = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("registered_at"), F.desc("id")))
    one = models.withColumn("_k", latest).where("_k = 1").drop("_k")
    last = F.row_number().over(Window.partitionBy("definition_id").orderBy(F.desc("registered_at"), F.desc("id")))
    return one.withColumn("is_current", last == 1)


def active_definition(definitions: DataFrame) -> DataFrame:
    """The active definition of the highest version: one row or none."""
    return definitions.where("is_active").orderBy(F.desc("version"), F.desc("id")).limit(1)


def current_models(models: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per active definition its five versions trained last, which of them is current, and whether it has enough test rows."""
    by = Window.partitionBy("definition_id").orderBy(F.desc("trained_at"), F.desc("id"))
    active = definitions.where("is_active").select(F.col("id").alias("_d"), F.col("version").alias("definition_version"))
    rows = registry(models).join(active, F.col("definition_id") == F.col("_d")).withColumn("rank", F.row_number().over(by)).where("rank <= 5")
    return rows.select("definition_id", "definition_version", "rank", "version", "trained_at", "data_source", "is_current", (F.col("n_test") >= F.col("min_samples")).alias("enough"))


# ---- scores --------------------------------------------------------------------------------------------------------------------------


def score_with(features: DataFrame, bundle: Bundle) -> DataFrame:
    """features with raw and calibrated probability, the band around it and the version (ML3)."""
    curve = F.from_json(F.lit(_curve_json(bundle.metadata["curve"])), CURVE)
    rows = forecast.score_forecasts(features, bundle.pipeline, bundle.isotonic)
    rows = rows.withColumn("_band", rules.uncertainty_band(F.col("p"), curve))
    return rows.select(*features.columns, F.col("p_raw").alias("raw"), F.col("p").alias("calibrated"), F.col("_band.low").alias("low"), F.col("_band.high").alias("high"), F.lit(bundle.metadata["version"]).alias("model_version"))


def _curve_json(curve) -> str:
    import json

    names = ("binLow", "binHigh", "meanPredicted", "empiricalRate", "n")
    return json.dumps([dict(zip(names, tuple(b), strict=True)) for b in curve or []])


def gate(scored: DataFrame, models: DataFrame) -> DataFrame:
    """Scored rows behind the display gate (M9): claim_id, definition_id, raw, calibrated, low, high, model_version as stored, with
    display_mode and reason. models: the registry's current rows, one for a definition; numbers that may not be shown are null."""
    m = models.where("is_current").select(F.col("definition_id").alias("_d"), F.col("id").alias("model_id"), F.col("data_source").alias("_src"), F.col("n_test").alias("_n"), F.col("min_samples").alias("_least"))
    rows = scored.join(F.broadcast(m), F.col("definition_id") == F.col("_d"), "left")  # a row a definition
    g = rules.display_gate(F.col("_d").isNotNull(), F.col("_src"), F.col("_n"), F.col("calibrated"), F.col("low"), F.col("high"), F.col("_least"))
    rows = rows.withColumn("_g", g)
    shown = {c: F.when(F.col("_g.reason").isNull(), F.col(c)) for c in ("raw", "calibrated", "low", "high", "model_version")}
    return rows.withColumns(shown | {"display_mode": F.col("_g.mode"), "reason": F.col("_g.reason")}).drop("_d", "_src", "_n", "_least", "_g")


def forecast_claims(features: DataFrame, bundle: Bundle | None, models: DataFrame, definition_id: int) -> DataFrame:
    """The forecast rows of every (claim_id, as_of), to append (ML3): features and their hash, scores, band, mode and reason.

    Without a bundle nothing is scored and every row says why. A definition without a registered model has no number either."""
    values = F.create_map(*[x for f in forecast.FEATURES for x in (F.lit(f), F.col(f))])
    none = F.lit(None).cast("double")
    if bundle is None:
        scored = features.withColumns({"raw": none, "calibrated": none, "low": none, "high": none, "model_version": F.lit(None).cast("string")})
    else:
        scored = score_with(features, bundle)
    rows = gate(scored.withColumn("definition_id", F.lit(definition_id).cast("long")), models)
    rows = rows.withColumns({"features": values, "feature_hash": text.feature_hash(F.col("claim_id"), F.col("as_of"), {f: F.col(f) for f in forecast.FEATURES}), "predicted_at": F.col("as_of").cast("timestamp")})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in features.sparkSession.createDataFrame([], FORECAST).schema])


def append_forecasts(rows: DataFrame, path: str) -> None:
    """Add forecasts under their day; none is updated (SNK2)."""
    io.append_history(rows, path, "predicted_at")


def latest_forecast(forecasts: DataFrame, at: Column | None = None) -> DataFrame:
    """Every claim's last forecast, up to a time if given."""
    rows = forecasts if at is None else forecasts.where(F.col("predicted_at") <= at)
    return rows.groupBy("claim_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "claim_id"]), "predicted_at").alias("f")).select("claim_id", "f.*")
