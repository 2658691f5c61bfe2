"""Scalar numeric functions: guarded casts, cell classes, bands and the one-vs-rest algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lrforge.functions.text import normalize_cell

NUMBER = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9]+)?$"
LARGEST = 1.7976931348623157e308
# Bounds of evidence strength, and of one-vs-rest interpretation.
STRENGTH_CUTS = (0.1, 0.2, 0.5, 2.0, 5.0, 10.0)
STRENGTH_NAMES = ("strong against", "moderate against", "weak against", "neutral", "weak for", "moderate for", "strong for")
INTERPRETATION_CUTS = (0.05, 0.2, 0.4, 0.71, 1.0, 1.4, 2.5, 5.0, 20.0)
INTERPRETATION_NAMES = (
    "excludes", "extremely strong against", "strong against", "so-so against", "weak against", "weak for", "so-so for", "strong for", "extremely strong for", "pathognomonic",
)
CLIP = 1e-12
SIGN_MARGIN = 1e-12


def to_number(value: Column) -> Column:
    """A finite double, or null. Only what Python's float takes counts: no type suffixes, no names."""
    text = normalize_cell(value)
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(number) <= LARGEST, number)


def to_positive(value: Column) -> Column:
    number = to_number(value)
    return F.when(number > 0, number)


def classify_cell(value: Column) -> Column:
    """Struct (status, numeric_value): missing, non_numeric, non_positive or valid."""
    text, number = normalize_cell(value), to_number(value)
    status = F.when(text == "", "missing").when(number.isNull(), "non_numeric").when(number <= 0, "non_positive").otherwise("valid")
    return F.struct(status.alias("status"), F.when(text != "", number).alias("numeric_value"))


def is_numeric_label(label: Column) -> Column:
    """Whether a header cell is a number, with thousands commas and one percent sign allowed, nan and inf included."""
    bare = F.regexp_replace(F.replace(normalize_cell(label), F.lit(","), F.lit("")), r"\s*%$", "")
    return to_number(bare).isNotNull() | F.lower(bare).rlike(r"^[+-]?(nan|inf|infinity)$")


def require_positive(value: Column) -> Column:
    """The number; the query fails on anything that isn't a positive finite one."""
    number = to_positive(value)
    return F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a positive number: "), normalize_cell(value))).cast("double")).otherwise(number)


def banded(x: Column, cuts: tuple[float, ...], names: tuple[str, ...], closed: str = "left") -> Column:
    """The name of the band that x lies in; bands hold their lower bound if closed on the left, else their upper one."""
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names[:-1], strict=True))):
        out = F.when(x < cut if closed == "left" else x <= cut, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def evidence_strength(lr: Column) -> Column:
    return banded(lr, STRENGTH_CUTS, STRENGTH_NAMES, "right")


def interpretation(lr: Column) -> Column:
    return banded(lr, INTERPRETATION_CUTS, INTERPRETATION_NAMES)


def odds_label(odds: Column) -> Column:
    """Five levels of a change of odds."""
    return banded(odds, (0.72, 0.92, 1.18, 1.95), ("STRONG NEGATIVE", "WEAK NEGATIVE", "NEUTRAL", "WEAK POSITIVE", "STRONG POSITIVE"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up in binary, alike in every engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def logit(x: Column) -> Column:
    held = F.least(F.greatest(x, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.ln(held) - F.log1p(-held)


def logistic(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def ovr_posterior(prior: Column, lr: Column) -> Column:
    """Posterior of one category against the rest; null where the prior isn't within 0 and 1 or the ratio not positive."""
    return F.when((prior > 0) & (prior < 1) & (lr > 0), logistic(logit(prior) + F.ln(lr)))


def multiplicative_change(fitted: Column, raw: Column) -> Column:
    return fitted / raw


def abs_log_change(fitted: Column, raw: Column) -> Column:
    return F.abs(F.ln(fitted) - F.ln(raw))


def fraction_label(x: Column) -> Column:
    """1/n below 1, n from 1 on, in two significant digits without idle zeros."""
    digits = lambda v: F.regexp_replace(F.format_string("%.2g", v), r"\.0$", "")
    return F.when(x < 1, F.concat(F.lit("1/"), digits(1 / x))).otherwise(digits(x))
