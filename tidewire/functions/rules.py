"""Scores, dates and rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE = ("PENDING", "HOT")
NEED = 0.6
MONTH_MS = 30.44 * 86_400_000


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def plain_number(c: Column) -> Column:
    """A number as text without trailing zeros: 45, 12.5."""
    return F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")


def fee_mid(low: Column, high: Column) -> Column:
    """The mean of both bounds, or the one that is known (M4)."""
    return F.coalesce((low + high) / 2, low, high)


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def months_to(end: Column, at: Column) -> Column:
    """Months of 30.44 days; negative once past (M3)."""
    return (millis(end) - millis(at)) / F.lit(MONTH_MS)


def likelihood_parts(reliability: Column, months: Column, low: Column, high: Column, value: Column, sources: Column, base: Column, need: Column | None = None) -> dict[str, Column]:
    """The six parts of the 0 to 100 score, not rounded (M1). A market value or base probability of 0 is unknown."""
    need = F.lit(NEED) if need is None else need
    fee = fee_mid(low, high)
    known = fee.isNotNull() & value.isNotNull() & (value != 0)
    return {
        "source": clamp(reliability, 0.0, 1.0) * 28,
        "contract": F.when(months.isNull(), 8.0).otherwise((1 - clamp(months / 24, 0.0, 1.0)) * 20),
        "fee": F.when(known, F.greatest(F.lit(0.0), 1 - F.abs(fee / F.when(known, value) - 1) * 1.5) * 12).otherwise(12 * 0.3),
        "need": clamp(need, 0.0, 1.0) * 20,
        "count": F.least(F.lit(1.0), 1 - F.exp(-sources * 0.5)) * 15,
        "provider": F.when(F.coalesce(base, F.lit(0.0)) == 0, 2.5).otherwise(base * 5),
    }


def likelihood_score(*inputs: Column, **named: Column) -> Column:
    """The parts' sum within 0 and 100, rounded half up (M1)."""
    parts = likelihood_parts(*inputs, **named)
    return half_up(clamp(sum(parts.values(), F.lit(0.0)), 0.0, 100.0)).cast("double")


def score_status(score: Column) -> Column:
    """HOT from 70 (M2)."""
    return F.when(score >= 70, "HOT").otherwise("PENDING")


def window_cutoff(window: Column, ref: Column, summer: str = "08-31", winter: str = "01-31") -> Column:
    """The next cutoff day's end on or after ref; null for free agents and unknown windows (M5)."""
    day = F.when(window == "SUMMER", summer).when(window == "WINTER", winter)

    def at(year: Column) -> Column:
        month, date = F.substring(day, 1, 2).cast("int"), F.substring(day, 4, 2).cast("int")
        return F.coalesce(F.try_make_timestamp(year, month, date, F.lit(23), F.lit(59), F.lit(59)), F.try_make_timestamp(year, F.lit(3), F.lit(1), F.lit(23), F.lit(59), F.lit(59)))

    this = at(F.year(ref))
    return F.when(day.isNotNull(), F.when(this >= ref, this).otherwise(at(F.year(ref) + 1)))


def tier_score(tier: Column) -> Column:
    """0.5 if unknown, else 1 for tier 1 down to 0.2 for tier 5 (M6)."""
    return F.when(tier.isNull(), 0.5).otherwise((6 - clamp(tier.cast("double"), 1.0, 5.0)) / 5)


# Display modes, the data source of real outcomes, and the reasons why nothing is shown.
PRECISE, INTERVAL, INSUFFICIENT, REAL = "PRECISE", "INTERVAL", "INSUFFICIENT_DATA", "db"
NO_MODEL = "No trained model exists yet for this forecast definition."
SYNTHETIC = "The current model is trained on synthetic data only — no calibrated probability can be shown until enough resolved real outcomes exist to train on."
TOO_FEW = "Model was evaluated on only {} held-out samples (need {}+) — not enough to trust an out-of-sample estimate."
NO_SCORE = "Forecasting service unavailable."
WIDEST = 0.4


def display_gate(has_model: Column, data_source: Column, n_test: Column, score: Column, low: Column, high: Column, least: Column | int = 200, widest: float = WIDEST) -> Column:
    """(mode, reason): whether a forecast may be shown, and how (M9). least: the test rows that the model's own row asks for."""
    least, n = F.lit(least) if isinstance(least, int) else least, F.coalesce(n_test, F.lit(0))
    before, between, after = TOO_FEW.split("{}")
    few = F.concat(F.lit(before), n.cast("string"), F.lit(between), least.cast("string"), F.lit(after))
    no = lambda reason: F.struct(F.lit(INSUFFICIENT).alias("mode"), reason.alias("reason"))
    shown = lambda mode: F.struct(F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("reason"))
    return (
        F.when(~F.coalesce(has_model, F.lit(False)), no(F.lit(NO_MODEL)))
        .when(~data_source.eqNullSafe(F.lit(REAL)), no(F.lit(SYNTHETIC)))
        .when(n < least, no(few))
        .when(score.isNull(), no(F.lit(NO_SCORE)))
        .when(high - low > widest, shown(INTERVAL))
        .otherwise(shown(PRECISE))
    )


def uncertainty_band(p: Column, curve: Column) -> Column:
    """(low, high) around the empirical rate of p's bin, or of the bin with the nearest middle; [0, 1] without a curve (M8)."""
    inside = F.filter(curve, lambda b: (p >= b["binLow"]) & (p <= b["binHigh"]))
    ranked = F.array_sort(F.transform(curve, lambda b: F.struct(F.abs((b["binLow"] + b["binHigh"]) / 2 - p).alias("far"), b.alias("bin"))))
    chosen = F.when(F.size(inside) > 0, F.get(inside, F.lit(0))).otherwise(F.get(ranked, F.lit(0))["bin"])
    rate = chosen["empiricalRate"]
    half = 1.96 * F.sqrt(rate * (1 - rate) / F.greatest(chosen["n"], F.lit(1)))
    empty = curve.isNull() | (F.size(curve) == 0)
    return F.struct(F.when(empty, 0.0).otherwise(clamp(rate - half, 0.0, 1.0)).alias("low"), F.when(empty, 1.0).otherwise(clamp(rate + half, 0.0, 1.0)).alias("high"))


def calibration_bin(p: Column, n: int = 10) -> Column:
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")
