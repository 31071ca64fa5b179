"""Column expressions that several operators share. Ratios give NULL where the denominator is 0 or missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def r6(x: Column) -> Column:
    return F.round(x, 6)


def kurtosis_pearson(x: Column) -> Column:
    """Bias-corrected Pearson kurtosis (3 for a normal distribution); NULL under 4 values or without spread."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when((n > 3) & (F.stddev_pop(x) > 2.220446049250313e-16), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6) + 3)


def skewness_corrected(x: Column) -> Column:
    """Bias-corrected skewness; NULL under 3 values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 2.220446049250313e-16), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL where one side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def gaussian(x: Column, centre: float, spread: float) -> Column:
    return F.exp(-0.5 * F.pow((x - centre) / spread, 2))


def distance_to_band(x: Column, lo: float, hi: float) -> Column:
    """0 inside the band, else the distance to its nearer end."""
    return F.when(x < lo, lo - x).when(x > hi, x - hi).otherwise(0.0)


def overlap_fraction(lo: Column, hi: Column, low: float, high: float) -> Column:
    """Share of the interval [lo, hi] that lies in [low, high]."""
    return clip(ratio(F.greatest(F.lit(0.0), F.least(hi, F.lit(high)) - F.greatest(lo, F.lit(low))), hi - lo), 0.0, 1.0)


def normalise_header(s: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]", "")


def safe_identifier(s: Column) -> Column:
    """A file-system-safe id: every character but letters, digits, - and _ becomes two underscores, of which no more than three stay in a row; outer ones go, an empty rest is 'recording'."""
    joined = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "__"), "__(__)+(_?)", "__$2")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit("")), F.lit("recording"))


def path_identifier(path: Column) -> Column:
    """The safe id of a path without its suffix."""
    return safe_identifier(F.regexp_replace(path, r"([^/])\.[^/.]+$", "$1"))


def near_harmonic(freq: Column, fundamental: Column, count: int, tolerance: float) -> Column:
    """Whether a frequency lies within the tolerance of one of the first harmonics (overlapping windows count once)."""
    return F.exists(F.sequence(F.lit(1), F.lit(count)), lambda k: F.abs(freq - k * fundamental) <= tolerance)


def near_sideband(freq: Column, carrier: Column, offset: Column, count: int, tolerance: float) -> Column:
    """Whether a frequency lies within the tolerance of a positive sideband k * carrier +- offset."""
    inside = lambda f: (f > 0) & (F.abs(freq - f) <= tolerance)
    return F.exists(F.sequence(F.lit(1), F.lit(count)), lambda k: inside(k * carrier - offset) | inside(k * carrier + offset))


def standard_label(s: Column) -> Column:
    """stable, incipient or chatter, by what a free-text state contains; blank and unknown states are chatter."""
    t = F.lower(F.coalesce(s, F.lit("")))  # fixed values: the words below
    return F.when(t.contains("no chatter") | t.contains("nochatter"), "stable").when(t.rlike("mild|incipient|intermittent"), "incipient").otherwise("chatter")


def label_number(s: Column) -> Column:
    """1 for the words of chatter (fixed values), else 0, also for NULL."""
    return F.coalesce(F.lower(F.trim(s.cast("string"))).isin("chatter", "1", "true", "yes", "unstable"), F.lit(False)).cast("int")


def first_key(m: Column, *names: str) -> Column:
    """The value of the first entry of a map whose key is one of the names, whatever their case."""
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    return F.get(F.map_values(F.map_filter(m, lambda k, _: F.array_contains(wanted, F.lower(k)))), F.lit(0))


def has_nonfinite_token(text: Column) -> Column:
    """Whether a line of comma- or blank-separated values holds nan or inf, whatever its case and sign."""
    return F.lower(text).rlike(r"(^|[,\s])(nan|[-+]?inf)($|[,\s])")


def version(text: Column) -> Column:
    """The first version number of three parts; null without one."""
    return F.nullif(F.regexp_extract(text, r"[0-9]+\.[0-9]+\.[0-9]+", 0), F.lit(""))


def evaluation_name(path: Column) -> dict[str, Column]:
    """Label letter, speed and feed of '<label>_<rpm>_<feed>..': other characters than digits and points are left out of the numbers; null where that gives none."""
    part = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", ""), "_")
    number = lambda k: F.regexp_replace(F.get(part, k), "[^0-9.]", "").try_cast("double")
    return {"label": F.get(part, 0), "rpm": number(1), "feed": number(2)}
