"""Scalar expressions: grids, calibrations, mobility, ids. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest distance of a point from its lattice value, in ppm; largest lattice index.
PPM_TOLERANCE, MAX_INDEX = 5.0, 1.9e9


def grid_mz(c0: Column, c1: Column, k: Column) -> Column:
    """m/z of lattice index k: the square of c0 + c1 * k, as a product, so that it is exact to the bit."""
    root = c0 + c1 * k
    return root * root


def grid_index(mz: Column, c0: Column, c1: Column) -> Column:
    """The lattice index next to an m/z, halves away from zero; null for m/z that is not positive and finite or out of range."""
    fine = (mz > 0) & ~F.isnan(mz) & (mz < float("inf"))
    k = F.round((F.sqrt(F.when(fine, mz)) - c0) / c1)
    return F.when(F.abs(k) <= MAX_INDEX, k).cast("int")


def ppm(reconstructed: Column, mz: Column) -> Column:
    return F.abs(reconstructed - mz) / mz * 1e6


def seconds_to_minutes(t: Column) -> Column:
    return t / 60.0


def profile_coefficients(t0: Column, delta: Column, coeff: Column, base: Column) -> tuple[Column, Column]:
    """Closed-form square-root grid of a profile scan."""
    return coeff * (t0 - base), coeff * delta


def polynomial_mz(t: Column, coeff: Column, base: Column, left: Column, right: Column, poly: Column, flags: Column) -> Column:
    """Refined m/z: (coeff * (t - base))^2 minus a polynomial of t held within [left, right].

    ``poly`` fills the powers whose bits are set in ``flags``, in rising
    order; Horner's rule runs from the highest power down.
    """
    x = F.greatest(left, F.least(right, t))
    bits = F.sequence(F.lit(0), F.lit(31))
    used = F.filter(bits, lambda b: F.call_function("bit_get", flags.cast("long"), b) == 1)

    def power(b: Column) -> Column:
        at = F.array_position(used, b).cast("int")
        return F.when((at > 0) & (at <= F.size(poly)), F.try_element_at(poly, F.greatest(at, F.lit(1)))).otherwise(0.0)

    dense = F.transform(bits, power)
    fit = F.aggregate(F.reverse(dense), F.lit(0.0), lambda acc, c: acc * x + c)
    root = coeff * (t - base)
    return root * root - fit


def refined_or_grid(refined: Column, coeff: Column, grid: Column) -> Column:
    return F.when((refined > 0) & (coeff != 0), refined).otherwise(grid)


def mobility_voltage(scan: Column, c0: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """The linear ramp from c2 at scan c0 to c3 at scan c1; c2 where the span is zero."""
    return F.when(c1 == c0, c2).otherwise(c2 + (c3 - c2) * (scan - c0) / F.nullif(c1 - c0, F.lit(0.0)))


def inverse_mobility(voltage: Column, c3: Column, c6: Column, c7: Column, lower: Column) -> Column:
    """1/K0: a rational model of the voltage whose offset makes c3 map to the known lower bound."""
    offset = lower * (c7 + c6 * c3) - c3
    return (voltage + offset) / (c7 + c6 * voltage)


def native_id(kind: str, *parts: Column) -> Column:
    """Ids of spectra as the vendors write them."""
    shape = {"frame": "frame=%d", "scan": "scan=%d", "scan_id": "scanId=%d", "cycle": "sample=%d period=1 cycle=%d experiment=%d", "function": "function=%d process=0 scan=%d"}[kind]
    return F.format_string(shape, *parts)


def level(kind: str, code: Column) -> Column:
    """MS level from a vendor's type code; never 0."""
    if kind == "frame":  # any but 0 is a fragment frame
        return F.when(code == 0, 1).otherwise(2)
    if kind == "line":  # 3 is a third level
        return F.when(code == 0, 1).when(code == 3, 3).otherwise(2)
    if kind == "rising":  # n is level n + 1
        return code + 1
    raise ValueError(kind)


def polarity(sign: Column) -> Column:
    s = F.trim(sign)
    return F.when(s == "+", "Positive").when(s == "-", "Negative").otherwise("Unknown")


def affine(width: Column, height: Column, nx: Column, ny: Column) -> Column:
    """Scale and offset that map image corners (0, 0) and (w - 1, h - 1) to pixels (1, 1) and (nx, ny); an axis of one pixel has scale 0."""
    scale = lambda size, n: F.when(size > 1, (n - 1) / (size - 1)).otherwise(0.0)
    return F.struct(scale(width, nx).alias("sx"), scale(height, ny).alias("sy"), F.lit(1.0).alias("tx"), F.lit(1.0).alias("ty"))


def exact_in_float32(count: Column) -> Column:
    return count <= (1 << 24)


def checked_int(value: Column) -> Column:
    """A whole number in 32 bits; beyond is an error, whatever the session's mode."""
    fits = value.between(-(2**31), 2**31 - 1)
    return F.when(value.isNull() | fits, F.when(fits, value).cast("int")).otherwise(F.raise_error(F.concat(F.lit("beyond 32 bits: "), value.cast("string"))).cast("int"))


def line_calibration(low: float, high: float, samples: float, wider: bool = False) -> tuple[float, float]:
    """(a, b) of sqrt(mz) = a + b * tof from an acquisition range, 5 Th wider on each side for some software."""
    low, high = (low - 5, high + 5) if wider else (low, high)
    if not (0 < low <= high < float("inf")) or not 0 < samples < float("inf"):
        raise ValueError(f"no calibration from range {low} to {high} and {samples} samples")
    return low**0.5, (high**0.5 - low**0.5) / samples


def model_of_converter(mz0: Column, mz1: Column) -> tuple[Column, Column]:
    """(a, b) of the same model from a converter's m/z at 0 and at 1."""
    return F.sqrt(mz0), F.sqrt(mz1) - F.sqrt(mz0)


def linear_mobility(scan: Column, scans: Column, low: Column, high: Column) -> Column:
    """1/K0 where there is no rational model: a line that falls from ``high`` at scan 0 to ``low`` at the last scan."""
    return high - (high - low) * scan / F.nullif(scans, F.lit(0))


def human_bytes(n: Column) -> Column:
    """Sizes in steps of 1024 with one decimal, halves to even, whole bytes below."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.format_string(f"%.1f {units[-1]}", F.bround(n / float(1024 ** len(units)), 1))
    for k in range(len(units) - 1, 0, -1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {units[k - 1]}", F.bround(n / float(1024**k), 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)
