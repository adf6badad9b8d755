"""Number formatting as columns, rounding the exact binary value half-to-even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _pattern(col: Column, pattern: str) -> Column:
    value = col.cast("double")
    endless = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(F.abs(value) == float("inf"), endless)
        .otherwise(F.call_function("format_number", value, F.lit(pattern)))
    )


def fixed(col: Column, digits: int, grouped: bool = False) -> Column:
    """``1234.5 -> 1234.50``, or ``1,234.50`` when grouped."""
    head = "#,##0" if grouped else "0"
    return _pattern(col, head + ("." + "0" * digits if digits else ""))


def sci(col: Column, digits: int) -> Column:
    """``1.4e11 -> 1.40e+11``."""
    raw = _pattern(col, "0." + "0" * digits + "E00")
    return F.when(~raw.contains("E"), raw).when(raw.contains("E-"), F.replace(raw, F.lit("E"), F.lit("e"))).otherwise(
        F.replace(raw, F.lit("E"), F.lit("e+"))
    )


def percent(col: Column, digits: int) -> Column:
    return F.concat(fixed(col * 100, digits), F.lit("%"))


def general(col: Column, digits: int) -> Column:
    """Significant-digit form: fixed notation for exponents -4..digits-1, else scientific."""
    raw = sci(col, digits - 1)
    mantissa, exponent = F.split_part(raw, F.lit("e"), F.lit(1)), F.split_part(raw, F.lit("e"), F.lit(2)).cast("int")
    out = F.concat(_trim(mantissa), F.lit("e"), F.split_part(raw, F.lit("e"), F.lit(2)))
    for power in range(-4, digits):
        shown = fixed(col, digits - 1 - power)
        out = F.when(exponent == power, _trim(shown) if power < digits - 1 else shown).otherwise(out)
    return F.when(col == 0, F.lit("0")).otherwise(out)


def shortest(col: Column) -> Column:
    """Shortest digits that read back as the same double, plain between 1e-4 and 1e16."""
    size = F.abs(col)
    java = F.replace(col.cast("string"), F.lit(".0E"), F.lit("E"))
    digits = F.split_part(java, F.lit("E"), F.lit(1))
    power = F.split_part(java, F.lit("E"), F.lit(2)).cast("int")
    scientific = F.concat(
        digits, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    plain = _pattern(col, "0.0" + "#" * 20)
    return F.when((size == 0) | size.between(1e-4, 9.999999999999998e15), plain).otherwise(scientific)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\.?0+$", "")


def fill(template: str, *parts: Column) -> Column:
    """Replace ``{0}``, ``{1}``, ... of a fixed wording by string columns."""
    pieces, rest = [], template
    for i, part in enumerate(parts):
        head, rest = rest.split("{%d}" % i, 1)
        pieces += [F.lit(head), part.cast("string")]
    return F.concat(*pieces, F.lit(rest))
