"""As-of features, labels, splits, training, calibration and gates of forecasts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import rules
from tidewire.operators.slices import long_keys, sliced
from tidewire.operators.timeline import as_of, changes
from tidewire.sources.io import materialise

SUPPORT, CONTRADICT = ("SUPPORTS", "CONFIRMS"), ("CONTRADICTS", "DENIES")
# The features in the order of the model.
FEATURES = ("sourceTierScore", "sourceTrackRecordScore", "independentRootCount", "evidenceCount", "evidenceDirectionScore", "mostRecentEvidenceAgeHours", "hasEvidence", "hasOfficialConfirmation", "hasOfficialDenial", "detailSpecificityScore", "sourceAgreementScore", "monthsToContractExpiry", "hasContractInfo", "windowDaysRemaining", "hasWindowInfo", "entityMatchConfidence", "dataCompletenessScore")
OLDEST_H = 8760.0
#: Rows that a task of the likelihood forest holds, about, once there are more than all cores have at that.
TASK_ROWS = 250_000
# The features of the likelihood forest.
LIKELIHOOD_FEATURES = ("sourceReliability", "monthsToContractExpiry", "monthsToContractExpiry_missing", "feeMid", "feeMid_missing", "marketValue", "marketValue_missing", "clubNeedScore", "distinctSourceCount", "baseProbability", "baseProbability_missing")


def evidence_as_of(predictions: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Predictions (claim_id, as_of) with running totals of the claim's evidence published until then; zeros without any.

    n, tiers, conf: count and sums of tier scores and confidences; pro, contra: supporting and contradicting items; yes, no: official
    words; newest: microseconds; roots: distinct roots; sources, siding: sources, and those whose last word supports (W2).
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    tiers = sources.select(F.col("id").alias("_s"), "tier")
    rows = evidence.select("claim_id", "id", "source_id", F.coalesce("root_id", "id").alias("root"), us("published_at").alias("us"), "direction", "source_type", "confidence").join(tiers, F.col("source_id") == F.col("_s"), "left")
    yes = lambda c: c.cast("long")
    official, side = F.col("source_type") == "CLUB_OFFICIAL", yes(F.col("direction").isin(*SUPPORT))
    values = {"n": F.lit(1).cast("long"), "tiers": rules.tier_score(F.col("tier")), "conf": F.col("confidence").cast("double"), "pro": side, "contra": yes(F.col("direction").isin(*CONTRADICT)), "yes": yes(official & (F.col("direction") == "CONFIRMS")), "no": yes(official & (F.col("direction") == "DENIES")), "newest": F.col("us")}

    def in_place(rows: DataFrame) -> DataFrame:
        """What each item adds: windows within claims, which stay where the claim's items are."""
        before = F.lag(side).over(Window.partitionBy("claim_id", "source_id").orderBy("us", "id"))
        first = F.row_number().over(Window.partitionBy("claim_id", "root").orderBy("us", "id")) == 1
        turn = F.col("before").isNull()
        told = rows.withColumn("roots", yes(first)).withColumn("before", before)
        return told.select("claim_id", "us", *[v.alias(c) for c, v in values.items()], "roots", (side - F.coalesce("before", F.lit(0))).alias("siding"), yes(turn).alias("sources"))

    def in_parts(rows: DataFrame) -> DataFrame:
        """The same for claims that are too long for one task."""
        rows = materialise(rows, "evidence-rows")  # read three times
        roots = rows.groupBy("claim_id", "root").agg(F.min("us").alias("us")).select("claim_id", "us", F.lit(1).cast("long").alias("roots"))
        words = rows.groupBy("claim_id", "source_id", "us").agg(F.max_by(side, "id").alias("side"))
        turns = changes(words, ["claim_id", "source_id"], "side").select("claim_id", "us", F.col("delta").alias("siding"), yes(F.col("first")).alias("sources"))
        return rows.select("claim_id", "us", *[v.alias(c) for c, v in values.items()]).unionByName(roots, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)

    rows = rows.drop("_s").where("us is not null")
    many = long_keys(evidence.select("claim_id").unionByName(predictions.select("claim_id")), ["claim_id"])
    hot = many.withColumnRenamed("claim_id", "_h")
    if many.isEmpty():
        moments = in_place(rows)
    else:
        same = F.col("claim_id").eqNullSafe(F.col("_h"))
        moments = in_place(rows.join(F.broadcast(hot), same, "left_anti")).unionByName(in_parts(rows.join(F.broadcast(hot), same, "left_semi")))
    sums = ["n", "tiers", "conf", "pro", "contra", "yes", "no", "roots", "siding", "sources"]
    # one row for each claim and moment
    events = moments.groupBy("claim_id", "us").agg(*[F.sum(c).alias(c) for c in sums], F.max("newest").alias("newest"))
    asks = predictions.select("claim_id", us("as_of").alias("us"))
    met = as_of(events, asks, ["claim_id"], sums, ["newest"], short=many.isEmpty()).withColumnsRenamed({"claim_id": "_claim", "us": "_us"})
    return predictions.join(met, F.col("claim_id").eqNullSafe(F.col("_claim")) & (us("as_of") == F.col("_us"))).drop("_claim", "_us")


def evidence_features(predictions: DataFrame, evidence: DataFrame, sources: DataFrame, claims: DataFrame, players: DataFrame) -> DataFrame:
    """The 17 features of every (claim_id, as_of) (A17). Source counters are never read, nor evidence after as_of; a claim that was first seen
    after as_of has no row."""
    total = evidence_as_of(predictions.select("claim_id", "as_of").distinct(), evidence, sources)
    c = claims.select(F.col("id").alias("_cid"), "player_id", "stated_fee", "stated_months", "transfer_type", F.col("window"), "first_seen_at")
    p = players.select(F.col("id").alias("_pid"), "contract_end")
    rows = total.join(c, F.col("claim_id") == F.col("_cid")).where(F.col("first_seen_at") <= F.col("as_of")).join(p, F.col("player_id") == F.col("_pid"), "left")
    months = rules.months_to(F.col("contract_end"), F.col("as_of"))
    left = (rules.millis(rules.window_cutoff(F.col("window"), F.col("first_seen_at"))) - rules.millis(F.col("as_of"))) / 86_400_000
    yes = lambda c: c.cast("int").cast("double")
    n, directional = F.col("n"), F.col("pro") + F.col("contra")
    ratio = lambda a, b, none: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))
    values = {
        "sourceTierScore": ratio(F.col("tiers"), n, 0.5),
        "sourceTrackRecordScore": ratio(F.col("tiers"), n, 0.5),
        "independentRootCount": F.col("roots").cast("double"),
        "evidenceCount": n.cast("double"),
        "evidenceDirectionScore": ratio(F.col("pro"), directional, 0.5),
        "mostRecentEvidenceAgeHours": F.coalesce(F.least((F.unix_micros(F.col("as_of").cast("timestamp")) - F.col("newest")) / 3_600_000_000, F.lit(OLDEST_H)), F.lit(OLDEST_H)),
        "hasEvidence": yes(n > 0),
        "hasOfficialConfirmation": yes(F.col("yes") > 0),
        "hasOfficialDenial": yes(F.col("no") > 0),
        "detailSpecificityScore": (yes(F.col("stated_fee").isNotNull()) + yes(F.col("stated_months").isNotNull()) + yes(F.col("transfer_type") != "UNKNOWN")) / 3,
        "sourceAgreementScore": ratio(F.greatest("siding", F.col("sources") - F.col("siding")), F.col("sources"), 0.5),
        "monthsToContractExpiry": F.coalesce(months, F.lit(-1.0)),
        "hasContractInfo": yes(months.isNotNull()),
        "windowDaysRemaining": F.coalesce(left, F.lit(-1.0)),
        "hasWindowInfo": yes(left.isNotNull()),
        "entityMatchConfidence": ratio(F.col("conf"), n, 0.0),
        "dataCompletenessScore": (yes(F.col("stated_fee").isNotNull()) + yes(F.col("stated_months").isNotNull()) + yes(months.isNotNull()) + yes(left.isNotNull()) + yes(n > 0)) / 5,
    }
    return rows.select("claim_id", "as_of", *[values[f].alias(f) for f in FEATURES])


def resolve_labels(predictions: DataFrame, evidence: DataFrame, claims: DataFrame, now: Column, horizon_days: int = 30, use_cutoff: bool = True) -> DataFrame:
    """1 with an official confirmation in (as_of, deadline], 0 once the deadline is past, else null."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    official = evidence.where("source_type = 'CLUB_OFFICIAL' and direction = 'CONFIRMS'").select("claim_id", us("published_at").alias("us")).distinct().withColumn("next", -F.col("us"))
    c = claims.select(F.col("id").alias("_id"), "window", "first_seen_at")
    end = F.col("as_of") + F.make_dt_interval(F.lit(horizon_days))
    deadline = F.least(end, rules.window_cutoff(F.col("window"), F.col("first_seen_at"))) if use_cutoff else end
    rows = predictions.join(c, F.col("claim_id") == F.col("_id")).select("claim_id", "as_of", deadline.alias("deadline")).distinct()
    first = as_of(official, rows.select("claim_id", us("as_of").alias("us")), ["claim_id"], maxes=["next"], after=True, strict=True).withColumnsRenamed({"claim_id": "_c", "us": "_us"})
    met = rows.join(first, (F.col("claim_id") == F.col("_c")) & (us("as_of") == F.col("_us")), "left")
    at = F.timestamp_micros(-F.col("next")).cast(evidence.schema["published_at"].dataType)
    out = met.select("claim_id", "as_of", "deadline", F.when(at <= F.col("deadline"), at).alias("confirmed_at"))
    return out.withColumn("label", F.when(F.col("confirmed_at").isNotNull(), 1).when(F.col("deadline") <= now, 0))


def time_split(df: DataFrame, at: str = "as_of", key: str = "claim_id", train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """Oldest to newest: floor(.6 n) train, next floor(.2 n) validate, rest test (W7). Rows are dealt by ranges of (time, key), so
    that many rows of one time are many tasks; ranks are counted within a range and offset by the counts of those before."""
    rows = materialise(df.repartitionByRange(at, key).withColumn("_part", F.spark_partition_id()), "split-rows")
    starts, n = [], 0
    for r in rows.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        starts.append((r["_part"], n))
        n += r["count"]
    if not n:
        return df.withColumn("split", F.lit(None).cast("string"))
    first = df.sparkSession.createDataFrame(starts, "_s int, _start long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(at, key)) + F.col("_start") - 1
    a, b = int(train * n), int(train * n) + int(validate * n)
    ranked = rows.join(F.broadcast(first), F.col("_part") == F.col("_s")).withColumn("_rank", rank)
    return ranked.withColumn("split", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < b, "validation").otherwise("test")).drop("_part", "_s", "_start", "_rank")


def calibration_bins(df: DataFrame, p: str = "p", y: str = "y", n: int = 10) -> DataFrame:
    """Mean prediction, rate and count of each equal-width bin that has rows."""
    return df.groupBy(rules.calibration_bin(F.col(p), n).alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("empirical_rate"), F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Brier score and log loss, p clipped to [1e-6, 1 - 1e-6]."""
    q, t = rules.clamp(F.col(p), 1e-6, 1 - 1e-6), F.col(y).cast("double")
    return df.agg(F.avg((F.col(p) - t) ** 2).alias("brier"), F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("log_loss"))


def rank_auc(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Exact area under the ROC curve, ties counted half (A20), from the counts of each distinct score. Distinct scores are summed
    up within slices of score; the totals of lower slices, at most 64 rows, are added."""
    per = materialise(df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1 - F.col(y).cast("double")).alias("neg")), "auc-scores")
    rows = sliced(per, F.col("p").cast("double"))
    lower = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("_slice").alias("_k")).agg(F.sum("neg").alias("n")).select("_k", F.coalesce(F.sum("n").over(lower), F.lit(0.0)).alias("start"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("_slice").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    met = rows.withColumn("inside", inside).join(F.broadcast(starts), F.col("_slice") == F.col("_k"))
    u = F.col("pos") * (F.col("start") + F.col("inside") + F.col("neg") / 2)
    return met.select("pos", "neg", u.alias("u")).agg(F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def train_forecast(df: DataFrame, least: int = 200):
    """(pipeline, isotonic, metrics) from features, `label` and `split` (ML2). Scaled logistic regression with C = 1, isotonic on
    the validation rows, metrics on the test rows."""
    df = materialise(df.where("label is not null"), "forecast-rows")
    n = df.where("split = 'train'").count()
    if df.count() < least:
        raise ValueError(f"at least {least} labelled rows are needed")
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1 / max(1, n), standardization=False)]
    model = Pipeline(stages=stages).fit(df.where("split = 'train'"))
    with_p = model.transform(df).withColumn("p_raw", vector_to_array("probability")[1])
    isotonic = IsotonicRegression(featuresCol="p_raw", labelCol="label", predictionCol="p").fit(with_p.where("split = 'validation'"))
    test = isotonic.transform(with_p.where("split = 'test'"))
    return model, isotonic, scores(test, "p", "label").crossJoin(scores(test, "p_raw", "label").withColumnsRenamed({"brier": "brier_raw", "log_loss": "log_loss_raw"}))


def score_forecasts(df: DataFrame, model, isotonic) -> DataFrame:
    """Raw and calibrated probability of every row (ML3)."""
    return isotonic.transform(model.transform(df).withColumn("p_raw", vector_to_array("probability")[1])).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def likelihood_features(rumours: DataFrame, sources: DataFrame, players: DataFrame) -> DataFrame:
    """The 11 features of every rumour: zero and a mark where a value is missing; months in whole days from the report on (ML1)."""
    s = sources.select(F.col("id").alias("_s"), "reliability")
    p = players.select(F.col("id").alias("_p"), "market_value", "contract_end")
    rows = rumours.join(s, F.col("source_id") == F.col("_s")).join(p, F.col("player_id") == F.col("_p"))
    months = F.floor((rules.millis(F.col("contract_end")) - rules.millis(F.col("rumour_date"))) / 86_400_000) / 30.44
    fee = rules.fee_mid(F.col("fee_min"), F.col("fee_max"))
    known = {"monthsToContractExpiry": months, "feeMid": fee, "marketValue": F.col("market_value"), "baseProbability": F.col("base_probability")}
    values = {"sourceReliability": F.col("reliability").cast("double"), "clubNeedScore": F.lit(rules.NEED), "distinctSourceCount": F.col("source_count").cast("double")}
    for name, value in known.items():
        values |= {name: F.coalesce(value.cast("double"), F.lit(0.0)), f"{name}_missing": value.isNull().cast("double")}
    return rows.select(F.col("id").alias("rumour_id"), "status", months.alias("months"), *[F.col(c) for c in ("fee_min", "fee_max", "market_value", "base_probability")], *[values[f].alias(f) for f in LIKELIHOOD_FEATURES])


class TooFewRumours(ValueError):
    """There are not enough resolved rumours to train on; no other failure of training has this type."""


def over_all_cores(rows: DataFrame, n: int) -> DataFrame:
    """n rows dealt by their id over a task for each core at least; the order in a task is fixed, as the forest's samples are drawn in it."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    return rows.repartition(parts, "rumour_id").sortWithinPartitions("rumour_id")


def train_likelihood(features: DataFrame, least: int = 200, trees: int = 200, depth: int = 8, seed: int = 42):
    """(model, metrics, importances) of a random forest on resolved rumours, 100 if completed, else 0 (ML1).

    One row in five, by a hash of the id, is held out; metrics are R2 on both parts. Fewer than `least` resolved rumours raise TooFewRumours.
    """
    settled = features.where(F.col("status").isin("COMPLETED", "FAILED", "DENIED"))
    settled = materialise(settled.withColumn("target", F.when(F.col("status") == "COMPLETED", 100.0).otherwise(0.0)), "likelihood-rows")
    n = settled.count()
    if n < least:
        raise TooFewRumours(f"at least {least} resolved rumours are needed, found {n}")
    settled = over_all_cores(settled, n)
    held_out = F.pmod(F.xxhash64(F.lit(seed), "rumour_id"), F.lit(5)) == 0
    forest = RandomForestRegressor(featuresCol="_x", labelCol="target", predictionCol="forest", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(LIKELIHOOD_FEATURES), outputCol="_x"), forest]).fit(settled.where(~held_out))
    r2 = RegressionEvaluator(labelCol="target", predictionCol="forest", metricName="r2")
    metrics = {"train_r2": r2.evaluate(model.transform(settled.where(~held_out))), "test_r2": r2.evaluate(model.transform(settled.where(held_out)))}
    importances = dict(zip(LIKELIHOOD_FEATURES, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
    return model, metrics, importances


def score_likelihood(features: DataFrame, model=None) -> DataFrame:
    """rumour_id, score, scored_by and the six parts: the forest's prediction within 0 and 100, rounded half to even; without a model the
    heuristic score (ML4). scored_by tells which: forest or heuristic. The parts are always the heuristic's. Rows are dealt by their id before the trees, which cost far more than the joins."""
    inputs = (F.col("sourceReliability"), F.col("months"), F.col("fee_min"), F.col("fee_max"), F.col("market_value"), F.col("distinctSourceCount"), F.col("base_probability"))
    rows = features if model is None else model.transform(features.repartition("rumour_id"))
    score = rules.likelihood_score(*inputs) if model is None else F.bround(rules.clamp(F.col("forest"), 0.0, 100.0), 0)
    return rows.select("rumour_id", score.alias("score"), F.lit("heuristic" if model is None else "forest").alias("scored_by"), *[part.alias(name) for name, part in rules.likelihood_parts(*inputs).items()])
