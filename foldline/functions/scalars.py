"""Small numeric and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of words, two at least. A fixed value.
WORD = "[a-zçğıöşü]{2,}"


def half_up(x: Column) -> Column:
    """The nearest integer as a long, halves up."""
    return F.floor(x + 0.5).cast("long")


def ratio(numerator: Column, denominator: Column, if_zero: float | None = None) -> Column:
    """A division that gives `if_zero` where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(if_zero).cast("double"))


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two doubles agree within an absolute or relative tolerance; false for a null."""
    bound = F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(F.abs(a - b) <= bound, F.lit(False))


def turkish_lower(text: Column) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def words(text: Column) -> Column:
    """The words of a text in order; null for null."""
    return F.regexp_extract_all(turkish_lower(text), F.lit(WORD), F.lit(0))


def number(text: Column) -> Column:
    """A double from text; blanks and anything else that isn't a number are null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def general(x: Column) -> Column:
    """A double with six significant digits, without zeros behind: fixed for exponents from -4 to 5, else with an exponent of two digits or more."""
    shown = F.format_string("%.5e", x)
    digits = F.regexp_replace(F.regexp_extract(shown, r"^-?(\d)\.(\d+)e", 0), r"[-.e]", "")
    power = F.regexp_extract(shown, r"e([+-]\d+)$", 1).cast("int")
    kept = F.regexp_replace(digits, "0+$", "")
    whole = F.when(power >= 0, F.rpad(F.substring(kept, F.lit(1), power + 1), power + 1, F.lit("0"))).otherwise(F.lit("0"))
    behind = F.when(power >= 0, F.substring(kept, power + 2, F.lit(6))).otherwise(F.concat(F.repeat(F.lit("0"), -power - 1), kept))
    fixed = F.concat(whole, F.when(behind != "", F.concat(F.lit("."), behind)).otherwise(F.lit("")))
    short = F.concat(F.substring(kept, 1, 1), F.when(F.char_length(kept) > 1, F.concat(F.lit("."), F.substring(kept, 2, 6))).otherwise(F.lit("")))
    sign = F.when(power >= 0, F.lit("+")).otherwise(F.lit("-"))
    scientific = F.concat(short, F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    body = F.when((power >= -4) & (power < 6), fixed).otherwise(scientific)
    return F.when(x == 0, F.lit("0")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body))


def opaque_id(prefix: str, salt: str, sep: str, key: Column) -> Column:
    """prefix and the first 12 hex digits of SHA-256 over salt, separator and key."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(salt + sep), key).cast("binary"), 256), 1, 12))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p-value of discordant counts; 1 without any.

    Terms C(n, k) / 2^n are summed as exp of log-gamma differences built from sums of logarithms, so large counts
    don't overflow.
    """
    n, low = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    half = n.cast("double") * F.ln(F.lit(0.5))

    def step(acc: Column, k: Column) -> Column:
        log = F.when(k == 0, F.lit(0.0)).otherwise(acc["log"] + F.ln((n - k + 1).cast("double")) - F.ln(F.greatest(k, F.lit(1)).cast("double")))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log + half)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), low), start, step)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def label_code(text: Column, uncertain: str = "U") -> Column:
    """-1, 0 or 1 from text; the uncertain mark and blanks are null, anything else is an error."""
    clean = F.trim(text)
    code = clean.try_cast("int")
    fine = code.isin(-1, 0, 1)
    missing = clean.isNull() | clean.isin("", uncertain)
    return F.when(missing, F.lit(None).cast("int")).when(F.coalesce(fine, F.lit(False)), code).otherwise(F.raise_error(F.concat(F.lit("not a label: "), clean)).cast("int"))
