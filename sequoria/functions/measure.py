"""Column functions on censored measurements: units, bounds, conservative interval labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 25.0
NUMBER = r"\d+(?:\.\d+)?"


def normalized_unit(raw: Column) -> Column:
    """ug/ml or um; null for any other unit."""
    unit = F.translate(F.lower(F.btrim(raw, F.lit(" \t\r\n"))), "μµ ", "uu")
    return F.when(unit.isin("ug/ml", "mcg/ml", "mg/l"), "ug/ml").when(unit.isin("um", "umol/l", "umolar"), "um")


#: The greatest double under 1: a positive double times it is the double before, divided by it the one after.
_UNDER_ONE = 1 - 2.0**-53


def bounds(raw: Column) -> Column:
    """struct(low, high, censor) of a measurement text, null where it cannot be read. Strict bounds move by one unit in
    the last place."""
    text = F.regexp_replace(F.trim(raw), "[–—]", "-")
    sign = F.regexp_extract(text, rf"^(<=|>=|<|>)?\s*{NUMBER}\z", 1)
    single = text.rlike(rf"^(<=|>=|<|>)?\s*{NUMBER}\z")
    value = F.regexp_extract(text, rf"({NUMBER})\z", 1).try_cast("double")
    a, b = (F.regexp_extract(text, rf"^({NUMBER})\s*-\s*({NUMBER})\z", k).try_cast("double") for k in (1, 2))
    none = F.lit(None).cast("double")

    def made(low: Column, high: Column, censor: str) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), F.lit(censor).alias("censor"))

    return (
        F.when(single & (value > 0) & (sign == "<"), made(none, value * _UNDER_ONE, "lt"))
        .when(single & (value > 0) & (sign == "<="), made(none, value, "le"))
        .when(single & (value > 0) & (sign == ">"), made(value / _UNDER_ONE, none, "gt"))
        .when(single & (value > 0) & (sign == ">="), made(value, none, "ge"))
        .when(single & (value > 0), made(value, value, "exact"))
        .when((a > 0) & (b > 0), made(F.least(a, b), F.greatest(a, b), "range"))
    )


def unread(raw: Column) -> Column:
    """Why a measurement text has no bounds."""
    text = F.regexp_replace(F.trim(raw), "[–—]", "-")
    single, span = text.rlike(rf"^(<=|>=|<|>)?\s*{NUMBER}\z"), text.rlike(rf"^{NUMBER}\s*-\s*{NUMBER}\z")
    return F.when(single, "MIC must be positive").when(span, "MIC range bounds must be positive").otherwise(F.concat(F.lit("unparseable MIC value: "), F.coalesce(raw, F.lit(""))))


def parsed(raw: Column, unit: Column, weight: Column, threshold: float = THRESHOLD) -> Column:
    """struct(mic, label, censor, reason): the value in ug/ml, 1 if surely at most the threshold, 0 if surely above,
    else null with a reason. uM is scaled by the molecular weight after the bounds are set."""
    kind = normalized_unit(unit)
    got = bounds(raw)
    scale = F.when(kind == "um", weight / 1000.0).otherwise(F.lit(1.0))
    low, high = got["low"] * scale, got["high"] * scale
    mic = F.when(got["censor"] == "range", (low + high) / 2.0).otherwise(F.coalesce(high, low))
    label = F.when(high <= threshold, 1).when(low > threshold, 0)
    reason = (
        F.when(kind.isNull(), F.concat(F.lit("unsupported MIC unit: "), F.coalesce(unit, F.lit(""))))
        .when(got.isNull(), unread(raw))
        .when((kind == "um") & (F.coalesce(weight, F.lit(0.0)) <= 0), F.lit("molecular_weight_required_for_uM"))
        .when(label.isNull(), F.lit("mic_interval_crosses_threshold"))
    )
    bad = kind.isNull() | got.isNull()
    return F.struct(
        F.when(~bad & ~((kind == "um") & (F.coalesce(weight, F.lit(0.0)) <= 0)), mic).alias("mic"),
        F.when(reason.isNull(), label).cast("int").alias("label"),
        F.when(bad, F.lit("invalid")).otherwise(got["censor"]).alias("censor"),
        reason.alias("reason"),
    )
