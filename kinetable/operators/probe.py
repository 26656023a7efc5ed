"""Text items that ask for a conversion of units, without images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import one_decimal

PROTOCOL = "unit-probe"
#: The probe's values, the first six of which are the published ones, and its pixels per metre.
PUBLISHED = (0.2, 0.5, 1.0, 2.5, 4.0, 8.0)
VALUES = (*PUBLISHED, 0.002, 0.007, 0.02, 0.05, 17.5, 40.0, 125.0, 400.0)
PIXELS_PER_METRE = 27.498
#: From, to, factor, what one of the larger unit equals.
PAIRS = (
    ("meters", "centimeters", 100.0, "One meter equals 100 centimeters."), ("meters", "millimeters", 1000.0, "One meter equals 1000 millimeters."), ("centimeters", "meters", 0.01, "One meter equals 100 centimeters."),
    ("millimeters", "meters", 0.001, "One meter equals 1000 millimeters."), ("meters", "kilometers", 0.001, "One kilometer equals 1000 meters."), ("kilometers", "meters", 1000.0, "One kilometer equals 1000 meters."),
)


def conditions() -> list[tuple]:
    """(from, to, factor, sentence, factor_given, kind): metric pairs with and without the factor, pixel pairs only with it."""
    pixels = f"One meter equals {PIXELS_PER_METRE:g} pixels in this image."
    out = [(*p, given, "metric") for p in PAIRS for given in (True, False)]
    return out + [("meters", "pixels", PIXELS_PER_METRE, pixels, True, "pixel"), ("pixels", "meters", 1.0 / PIXELS_PER_METRE, pixels, True, "pixel")]


def unit_probe_items(values: DataFrame) -> DataFrame:
    """Every distinct value (double, up to three decimals) in all conditions and both framings: item_id (a hash of the question),
    question, answer, value, from_unit, to_unit, factor, factor_given, framing, pair_kind, direction, target, published."""
    cond = F.array(*(F.struct(F.lit(a).alias("from_unit"), F.lit(b).alias("to_unit"), F.lit(f).alias("factor"), F.lit(s).alias("sentence"), F.lit(g).alias("factor_given"), F.lit(k).alias("pair_kind")) for a, b, f, s, g, k in conditions()))
    framing = F.explode(F.array(F.lit("bare"), F.lit("embedded"))).alias("framing")
    q = values.select("value").distinct().select("value", F.explode(cond).alias("c")).select("value", "c.*", framing)
    text = F.call_function("format_number", F.col("value"), F.lit("0.0##"))
    embedded = F.col("framing") == "embedded"
    first = F.when(embedded, F.concat(F.lit("The player marked with the red box has a path length of "), text, F.lit(" "), F.col("from_unit"), F.lit(" over the clip."))).otherwise(F.concat(F.lit("A distance is "), text, F.lit(" "), F.col("from_unit"), F.lit(".")))
    request = F.concat(F.when(embedded, "Express that path length in ").otherwise("Express that distance in "), F.col("to_unit"), F.lit("."))
    q = q.withColumn("question", F.concat_ws(" ", first, F.when(F.col("factor_given"), F.col("sentence")), request, F.lit("Output only the number, one decimal place.")))
    q = q.withColumns({"item_id": F.substring(F.sha2(F.concat_ws("|", F.lit(PROTOCOL), "question"), 256), 1, 20), "target": F.col("value") * F.col("factor"), "direction": F.when(F.col("factor") > 1, "multiply").otherwise("divide")})
    published = F.col("value").isin(*PUBLISHED) & (F.col("from_unit") == "meters") & F.col("to_unit").isin("centimeters", "millimeters") & F.col("factor_given") & (F.col("framing") == "bare")
    return q.withColumns({"answer": one_decimal(F.col("target")), "published": published}).drop("sentence")
