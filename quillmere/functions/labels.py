"""Labels of figures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that are shown whole, the discount of a yearly price, and the coverage from which ranges are trusted.
WHOLE_UNITS = ("minute", "run", "month")
YEARLY_DISCOUNT = 0.25
TRUSTED_COVERAGE = 0.6


def quantity(unit: Column, shown: Column, n: Column) -> Column:
    """A quantity as its unit deserves: whole minutes, runs and months in the right number, two decimals of the rest. shown: the unit's name."""
    whole = F.floor(n + 0.5)
    text = F.concat(F.format_number(whole, 0), F.lit(" "), shown, F.when(whole != 1, "s").otherwise(""))
    return F.when(unit.isin(*WHOLE_UNITS), text).otherwise(F.concat(F.format_string("%.2f", n.cast("double")), F.lit(" "), shown))


def sigma(value: Column, deadband: float = 0.005) -> Column:
    """Deviations with a sign and two decimals; none for what is (nearly) zero."""
    v = value.cast("double")
    return F.when(F.abs(v) < deadband, "0.00σ").otherwise(F.concat(F.when(v > 0, "+").otherwise(""), F.format_string("%.2f", v), F.lit("σ")))


def week(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def price(monthly: Column, yearly: Column) -> Column:
    """The price a month: whole and less where it is paid by the year."""
    return F.when(yearly, F.floor(monthly * (1 - YEARLY_DISCOUNT)).cast("double")).otherwise(monthly.cast("double"))


def coverage(share: Column) -> Column:
    return F.when(share >= TRUSTED_COVERAGE, "When this model gives a range, reality usually lands inside it.").otherwise("Recent forecasts have been missing — the model is being retrained.")
