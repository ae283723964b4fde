"""The model store: what is loaded scores as what was saved, the pointer and the registry decide, and the gate keeps numbers back."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.operators import forecast, models

T0 = datetime(2026, 1, 1)


def rows(spark, n=600):
    x = F.col("id")
    values = {f: F.pmod(F.xxhash64(F.lit(f), "id"), F.lit(1000)) / 1000.0 for f in forecast.FEATURES}
    df = spark.range(n).select(x.alias("claim_id"), F.timestamp_seconds(1_700_000_000 + x * 3600).alias("as_of"), *[v.alias(f) for f, v in values.items()])
    likely = F.col("hasOfficialConfirmation") * 0.8 + F.pmod(F.xxhash64("claim_id"), F.lit(100)) / 500.0
    return forecast.time_split(df.withColumn("label", (likely > 0.5).cast("int")))


@pytest.fixture(scope="module")
def bundle(spark):
    return models.train_bundle(rows(spark), "db", T0)


def test_bundle_metadata(spark, bundle):
    m = bundle.metadata
    assert m["version"] == "forecast-v1-db-20260101T000000" and (m["n_train"], m["n_test"]) == (360, 120)
    assert m["train_start"] < m["train_end"] < m["test_start"] < m["test_end"] and 0 < m["brier"] < 0.25
    assert sum(b[4] for b in m["curve"]) == 120 and all(b[0] <= b[2] <= b[1] for b in m["curve"])
    with pytest.raises(ValueError, match="at least 200"):
        models.train_bundle(rows(spark, 100), "db", T0)


def test_saved_and_loaded_models_score_alike(spark, bundle, tmp_path):
    root = f"file://{tmp_path}/models"
    assert models.current_version(spark, root) is None
    with pytest.raises(ValueError, match="no model"):
        models.load_model(spark, root)
    models.save_model(spark, bundle, root)
    with pytest.raises(ValueError, match="not written over"):
        models.save_model(spark, bundle, root)
    again = models.load_model(spark, root)
    assert models.metadata_row(spark, again).collect() == models.metadata_row(spark, bundle).collect()
    df = rows(spark)
    one, two = (sorted(models.score_with(df, b).select("claim_id", "raw", "calibrated", "low", "high", "model_version").collect()) for b in (bundle, again))
    assert one == two and len(one) == 600 and all(r.low <= r.high for r in one)
    later = models.Bundle(bundle.pipeline, bundle.isotonic, bundle.metadata | {"version": "forecast-v1-db-later"})
    models.save_model(spark, later, root)
    assert models.current_version(spark, root) == "forecast-v1-db-later"
    models.publish(spark, root, bundle.metadata["version"])  # back to the first
    assert models.load_model(spark, root).metadata["version"] == bundle.metadata["version"]
    other = models.Bundle(bundle.pipeline, bundle.isotonic, bundle.metadata | {"version": "odd", "features": ["x"]})
    models.save_model(spark, other, root, current=False)
    with pytest.raises(ValueError, match="other features"):
        models.load_model(spark, root, "odd")


def test_registration_demotes_the_last(spark, bundle):
    named = lambda v: models.Bundle(None, None, bundle.metadata | {"version": v})
    empty = spark.createDataFrame([], "x int")
    steps = [("a", 1, 0), ("b", 1, 1), ("c", 2, 2), ("a", 1, 3)]
    table, seen = None, []
    for version, definition, minute in steps:
        row = models.register_model(empty, named(version), definition, T0 + timedelta(minutes=minute), 100)
        table = row if table is None else table.unionByName(row)
        seen.append(sorted((r.definition_id, r.version) for r in models.registry(table).where("is_current").collect()))
    assert seen == [[(1, "a")], [(1, "b")], [(1, "b"), (2, "c")], [(1, "a"), (2, "c")]]
    assert models.registry(table).count() == 3
    definitions = spark.createDataFrame([(1, 1, True), (2, 5, False), (3, 4, True)], "id long, version int, is_active boolean")
    got = models.current_models(table, definitions).collect()
    assert {(r.version, r.is_current, r.enough) for r in got} == {("a", True, True), ("b", False, True)}
    assert models.active_definition(definitions).first()["id"] == 3


def test_forecasts_pass_the_gate(spark, bundle, tmp_path):
    df = rows(spark).where("claim_id < 50")
    empty = spark.createDataFrame([], "x int")
    register = lambda b, least: models.registry(models.register_model(empty, b, 1, T0, least))
    synthetic = models.Bundle(bundle.pipeline, bundle.isotonic, bundle.metadata | {"data_source": "synthetic"})
    cases = {"ok": (bundle, register(bundle, 100)), "none": (None, register(bundle, 100).limit(0)), "synthetic": (synthetic, register(synthetic, 100)), "few": (bundle, register(bundle, 200)), "silent": (None, register(bundle, 100))}
    found = {}
    for name, (b, m) in cases.items():
        out = models.forecast_claims(df, b, m, 1)
        assert out.count() == 50  # one forecast row each time
        models.append_forecasts(out.withColumn("predicted_at", F.lit(T0)), f"file://{tmp_path}/forecasts")
        found[name] = {(r.display_mode, r.reason, r.calibrated is None) for r in out.collect()}
    assert {m for m, _, _ in found["ok"]} <= {"PRECISE", "INTERVAL"} and all(not missing and reason is None for _, reason, missing in found["ok"])
    assert found["none"] == {("INSUFFICIENT_DATA", rules.NO_MODEL, True)} and found["synthetic"] == {("INSUFFICIENT_DATA", rules.SYNTHETIC, True)}
    assert found["few"] == {("INSUFFICIENT_DATA", "Model was evaluated on only 120 held-out samples (need 200+) — not enough to trust an out-of-sample estimate.", True)}
    assert found["silent"] == {("INSUFFICIENT_DATA", "Forecasting service unavailable.", True)}
    stored = spark.read.parquet(f"file://{tmp_path}/forecasts")
    assert stored.count() == 250 and models.latest_forecast(stored).count() == 50
    first = stored.first()
    assert len(first["features"]) == 17 and len(first["feature_hash"]) == 64


def test_feature_hash_is_that_of_sorted_json(spark):
    import hashlib

    from tidewire.functions import text

    # JSON numbers as browsers write them
    told = {"b": (0.1, "0.1"), "a": (3.0, "3"), "d": (-1.0, "-1"), "c": (0.00025, "0.00025"), "e": (1 / 3, "0.3333333333333333"), "f": (8760.0, "8760"), "g": (-0.0000125, "-0.0000125"), "h": (12345678.5, "12345678.5"), "i": (0.0, "0")}
    payload = '{"claimId":7,"asOf":"2025-01-10T08:30:00.250Z","features":{' + ",".join(f'"{k}":{told[k][1]}' for k in sorted(told)) + "}}"
    df = spark.createDataFrame([(7, "2025-01-10 08:30:00.25", *[v for v, _ in told.values()])], ["claim", "at", *told])
    got = df.select(text.feature_hash(F.col("claim"), F.to_timestamp("at"), {k: F.col(k) for k in told}).alias("h")).first()["h"]
    assert got == hashlib.sha256(payload.encode()).hexdigest()
