"""Parsing and scoring of single answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number, as a whole answer and anywhere in a text.
STRICT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FIRST = r"[-+]?[0-9]*\.?[0-9]+"
#: Share of the error that each of the ten steps allows, unrounded and rounded to two places.
STEPS = tuple(1 - (0.5 + 0.05 * i) for i in range(10))
THETAS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
#: Tolerance and denominator floor of the scalar groups, and of each axis of a location.
GROUPS = {"distance": (0.15, 0.5), "speed": (0.3, 1.0), "path": (0.5, 2.0), "timing": (0.5, 2.0)}
LOCATION = (0.3, 1.0)
#: Prefixes of categories and their metric group.
PREFIXES = (("distance_measurement", "distance"), ("spatial_counting", "counting"), ("relational_reasoning", "relational"), ("dynamics_speed", "speed"), ("dynamics_path", "path"), ("dynamics_time", "timing"))
#: The canonical form of an answer in each group (a trimmed text matches as a whole).
UNITS = {"distance": "m", "speed": "m/s|mps", "path": "m", "timing": "s|sec|seconds"}
#: An answer that states a reading and its conversion.
READ_THEN_CONVERT = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*(m/s|m)\s*->\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z/]+)\s*\.?\s*$"


def parse_strict(raw: Column) -> Column:
    """The whole answer as a finite number, else null."""
    text = F.trim(raw)
    number = F.when(text.rlike(STRICT), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def parse_first_number(raw: Column) -> Column:
    """The first number anywhere, without an exponent."""
    found = F.regexp_extract(raw, FIRST, 0)
    return F.when(found != "", found.try_cast("double"))


def parse_tuple3(raw: Column) -> Column:
    """The first three numbers, null if there are fewer."""
    found = F.regexp_extract_all(raw, F.lit(FIRST), F.lit(0))
    return F.when(F.size(found) >= 3, F.transform(F.slice(found, 1, 3), lambda x: x.try_cast("double")))


#: What may stand before an answer.
ANSWER_PREFIX = r"(?i)^(final\s+)?answer\s*[:\uff1a]\s*"


def extract_last_line(raw: Column) -> Column:
    """The last line with text, without a leading ``Answer:`` and surrounding asterisks."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.lit(""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(last, ANSWER_PREFIX, "")), r"^\*+|\*+$", ""))


def normalize(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(s, F.lit("")))), r"\s+", " ")


def exact_match(answer: Column, truth: Column) -> Column:
    """Equal after normalising, or first numbers within a millionth."""
    close = F.abs(parse_first_number(answer) - parse_first_number(truth)) < 1e-6
    return (normalize(answer) == normalize(truth)) | F.coalesce(close, F.lit(False))


def _steps(relative: Column, limits) -> Column:
    return sum((F.when(relative < F.lit(x), 1.0).otherwise(0.0) for x in limits), F.lit(0.0))


def tmra_scaled(prediction: Column, target: Column, tolerance: Column, floor: Column) -> Column:
    """0 to 100: ten points for each step that the relative error stays under; null without a prediction."""
    relative = (F.abs(prediction - target) - tolerance) / F.greatest(F.abs(target), floor)
    return F.when(prediction.isNotNull() & target.isNotNull(), 10.0 * _steps(relative, STEPS))


def _legacy(p: Column, g: Column, tolerance, floor) -> Column:
    relative = F.try_divide(F.abs(p - g) - tolerance, F.greatest(F.abs(g), floor))
    return F.when(relative.isNull(), 0.0).otherwise(_steps(relative, [1.0 - t for t in THETAS]) / 10)


def tmra_legacy(answer: Column, truth: Column, tolerance: Column, floor: Column) -> Column:
    """0 to 1 on first numbers: 0 if either has none or the denominator is 0."""
    return _legacy(parse_first_number(answer), parse_first_number(truth), tolerance, floor)


def map_group(category: Column) -> Column:
    """The metric group of a category."""
    c = F.lower(F.coalesce(category, F.lit("")))
    out = F.when(c == "localization", "localization")
    for prefix, group in PREFIXES:
        out = out.when(c.startswith(prefix), group)
    return out.otherwise("other")


def within_30cm(answer: Column, truth: Column) -> Column:
    """Whether two locations are at most 30 cm apart; false if either isn't one."""
    p, g = parse_tuple3(answer), parse_tuple3(truth)
    apart = F.sqrt(sum((F.pow(p[i] - g[i], 2) for i in range(3)), F.lit(0.0)))
    return F.coalesce(apart <= LOCATION[0], F.lit(False))


def score_pair(group: Column, answer: Column, truth: Column, metric_version: str = "legacy_v1") -> Column:
    """struct(exact, tmra) by metric group: scalars by tolerance, locations by the mean of their axes, others exact only
    (tmra null). ``legacy_v1`` has no floors of denominators, ``floor_v2`` has."""
    if metric_version not in ("legacy_v1", "floor_v2"):
        raise ValueError(f"unknown metric version {metric_version}")
    floor = lambda f: F.lit(f if metric_version == "floor_v2" else 0.0)
    exact = exact_match(answer, truth)
    p, g = parse_tuple3(answer), parse_tuple3(truth)
    same = F.coalesce((F.abs(p[0] - g[0]) < 1e-3) & (F.abs(p[1] - g[1]) < 1e-3) & (F.abs(p[2] - g[2]) < 1e-3), F.lit(False))
    axes = sum((_legacy(p[i], g[i], F.lit(LOCATION[0]), floor(LOCATION[1])) for i in range(3)), F.lit(0.0)) / 3
    tmra = F.when(group == "localization", F.when(same, 1.0).otherwise(F.when(p.isNull() | g.isNull(), 0.0).otherwise(axes)))
    for name, (t, f) in GROUPS.items():
        tmra = tmra.when(group == name, F.when(exact, 1.0).otherwise(tmra_legacy(answer, truth, F.lit(t), floor(f))))
    return F.struct(F.when(group == "localization", same).otherwise(exact).alias("exact"), tmra.alias("tmra"))


def parse_failure(group: Column, answer: Column) -> Column:
    """Whether a numeric answer has no number, or a location no three."""
    return F.when(group == "localization", parse_tuple3(answer).isNull()).when(group.isin(list(GROUPS)), parse_first_number(answer).isNull()).otherwise(F.lit(False))


def conforms(group: Column, answer: Column, truth: Column) -> Column:
    """Whether an answer has its group's canonical form already."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    whole = F.coalesce(F.trim(truth).rlike("^[0-9]+$"), F.lit(False))
    out = F.when(group.isin("relational", "counting"), a.rlike("^[A-Da-d]$") | (a.rlike("^[0-9]+$") & whole))
    for name, unit in UNITS.items():
        out = out.when(group == name, a.rlike(rf"^{FIRST}\s*(?:{unit})?$"))
    return out.when(group == "localization", F.regexp_count(a, F.lit(FIRST)) == 3).otherwise(F.lit(True))


def parse_read_then_convert(raw: Column) -> Column:
    """struct(value, reading, unit) of an answer ``reading unit -> value unit``; nulls if it isn't one."""
    ok = F.coalesce(raw, F.lit("")).rlike(READ_THEN_CONVERT)
    part = lambda i: F.when(ok, F.regexp_extract(raw, READ_THEN_CONVERT, i))
    return F.struct(part(3).try_cast("double").alias("value"), part(1).try_cast("double").alias("reading"), part(4).alias("unit"))


def classify_conversion(prediction: Column, value: Column, factor: Column, target: Column, band: float = 0.02) -> Column:
    """correct, identity, wrong_direction, decade_error, other or unparsed."""
    positive = (prediction > 0) & (target > 0)
    log = lambda x: F.log10(F.when(positive, x))
    ratio = log(prediction / target)
    near = F.bround(ratio)
    return (
        F.when(prediction.isNull(), "unparsed").when(F.abs(prediction - target) < 0.05, "correct").when(~positive, "other").when(F.abs(log(prediction / value)) < band, "identity")
        .when(F.abs(log(prediction * factor / value)) < band, "wrong_direction").when((near != 0) & (F.abs(ratio - near) < band), "decade_error").otherwise("other")
    )


def conversion_log_ratio(prediction: Column, target: Column) -> Column:
    """log10 of prediction over target; 0 for a correct answer, null without positive numbers."""
    return F.when(F.abs(prediction - target) < 0.05, 0.0).when((prediction > 0) & (target > 0), F.log10(F.when((prediction > 0) & (target > 0), prediction / target)))


def one_decimal(v: Column) -> Column:
    """Text with one decimal, rounded half-even on the exact binary value, without thousands separators."""
    return F.call_function("format_number", v, F.lit("0.0"))


def is_diagnostic(value: Column, target: Column) -> Column:
    """Whether an unconverted answer would be scored wrong and the target shows at one decimal."""
    rounded = lambda v: one_decimal(v).cast("double")
    return (F.abs(target) >= 0.05) & (F.abs(rounded(value) - rounded(target)) >= 0.1) & (F.abs(value - target) >= 0.05)


def decade_of(value: Column) -> Column:
    """The power of ten below a positive value, as text: 1e-3."""
    return F.when(value > 0, F.concat(F.lit("1e"), F.floor(F.log10(F.when(value > 0, value))).cast("string")))


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson interval of k of n; null without trials."""
    p = F.try_divide(k, n)
    below = 1 + z * z / F.when(n > 0, n)
    centre = (p + z * z / (2 * F.when(n > 0, n))) / below
    half = z * F.sqrt(p * (1 - p) / F.when(n > 0, n) + z * z / (4 * F.when(n > 0, n) * n)) / below
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
