"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities: every loader applies it once."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def pct(c: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(col(c), F.lit(q))


def clamp(c: Column | str, lo, hi) -> Column:
    """c within lo..hi; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi)))


def saturation_pressure(temp: Column) -> Column:
    """Saturation vapour pressure, kPa, over water or (below zero) ice."""
    return F.when(temp > 0, 0.61078 * F.exp(17.27 * temp / (temp + 237.3))).otherwise(0.61078 * F.exp(21.875 * temp / (temp + 265.5)))


def julian_day(ts: Column) -> Column:
    """Astronomical Julian day number at noon of the date."""
    return F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("double") + 2440588.0


def solar_shift(jd: Column, lon: Column) -> Column:
    """Hours from UTC to solar time."""
    m = 6.24004077 + 0.01720197 * (jd - 2451545.0)
    return (4 * lon - 7.659 * F.sin(m) + 9.863 * F.sin(2 * m + 3.5932)) / 60.0


def declination(jd: Column) -> Column:
    """Solar declination in radians."""
    return (math.pi * 23.5 / 180) * F.cos(2 * math.pi * (jd - 159.5) / 365.25)


def day_length(jd: Column, lat: Column) -> Column:
    """Hours between sunrise and sunset: 24 in polar summer, 0 in polar winter."""
    rad, dec = F.radians(lat), declination(jd)
    rise = -0.01453808 / (F.cos(rad) * F.cos(dec)) - F.tan(rad) * F.tan(dec)
    return F.when(rise < -1, 24.0).when(rise < 1, F.degrees(F.acos(clamp(rise, -1.0, 1.0))) * 8 / 60).otherwise(0.0)


def solar_zenith(ts: Column, lat: Column, lon: Column) -> Column:
    """Solar zenith angle in radians at a UTC time."""
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    tilt = math.pi / 180 * (hour + solar_shift(julian_day(ts), lon) - 12.0) * 15.0
    dec = declination(julian_day(ts))
    rad = lat * (math.pi / 180)
    return F.acos(clamp(F.sin(dec) * F.sin(rad) + F.cos(dec) * F.cos(rad) * F.cos(tilt), -1.0, 1.0))


def polynomial(x: Column, *by_power: float) -> Column:
    out = F.lit(float(by_power[-1]))
    for c in reversed(by_power[:-1]):
        out = out * x + c
    return out


def solar_constant(jd: Column) -> Column:
    """Radiation above the atmosphere (W/m2), which varies with the distance from the sun."""
    a = 2 * math.pi / 365.0 * (jd - 2451545.0 + 0.0008)
    return 1361.0 * (1.00011 + 0.034221 * F.cos(a) + 0.00128 * F.sin(a) + 0.000719 * F.cos(2 * a) + 0.000077 * F.sin(2 * a))


def turbidity(humidity: Column) -> Column:
    """Linke turbidity from specific humidity (kg/kg)."""
    return 11.2 * (0.2093309 + 0.07649825 * F.pow(humidity * 101300.0 / 9.81, F.lit(0.34)))


def beam_transmission(zenith: Column, haze: Column, elevation: Column) -> Column:
    """Share of direct radiation that comes through, by refracted altitude and air mass; 0 for a sun below the horizon."""
    a = math.pi / 2 - zenith
    seen = a + 0.061359 * polynomial(a, 0.1594, 1.123, 0.065656) / polynomial(a, 1.0, 28.9344, 277.3971)
    mass = F.exp(-elevation / 8434.5) / (F.sin(seen) + 0.50572 * F.pow(F.greatest(F.degrees(seen), F.lit(0.0)) + 6.07995, F.lit(-1.6364)))
    thick = F.when(mass <= 20, polynomial(mass, 6.6296, 1.7513, -0.1202, 0.0065, -0.00013)).otherwise(10.4 + 0.718 * mass)
    return F.when((zenith <= math.pi / 2) & (seen > 0), F.exp(-0.8662 * haze * mass / thick)).otherwise(0.0)


def sky_transmission(zenith: Column, haze: Column) -> Column:
    """Share of radiation that comes as diffuse light of a clear sky."""
    top = polynomial(haze, -0.015843, 0.030543, 0.0003797)
    flat = polynomial(haze, 0.26463, -0.061581, 0.0031408)
    flat = F.when(flat < 0.02, 0.02 / top).otherwise(flat)
    c = F.cos(zenith)
    return F.greatest(top * (flat + polynomial(haze, 2.0402, 0.018945, -0.011161) * c + polynomial(haze, -1.3025, 0.039231, 0.0085079) * c * c), F.lit(0.0))


def diffuse_share(sw: Column, zenith: Column) -> Column:
    """Diffuse share of short-wave radiation by clearness and zenith angle (radians); 1 at night."""
    deg = F.degrees(zenith)
    fade = F.exp(-0.06 * (90 - deg))
    most = 0.83 - 0.56 * fade  # clearness of the clearest sky
    k = F.least(sw / (1352 * F.cos(zenith)), most)
    rho = k / most
    spread = polynomial(rho, 0.021, 0.397, -0.231) - 0.13 * F.exp(-0.834 * F.pow((rho - 0.931) / 0.134, F.lit(2.0)))
    bright = 0.95 * most
    least = F.when(deg < 88.6, 0.07 + 0.046 * deg / (93 - deg)).otherwise(1.0)
    bend = F.greatest(0.5 * (1 + F.sin(math.pi * (k - 0.22) / (most - 0.22) - math.pi / 2)), F.lit(0.0))
    medium = 1 - (1 - least) * (0.11 * F.sqrt(bend) + 0.15 * bend + 0.74 * bend * bend)
    odds = medium * bright / (1 - bright)
    beam = F.pow(F.lit(0.81), F.pow(F.cos(zenith), F.lit(-0.6)))
    peak = (beam + odds) / (1 + odds)
    share = F.when(k <= 0.22, 1.0).when(k <= bright, medium).when(k <= peak, odds * (1 - k) / k).otherwise(1 - (peak - odds * (1 - peak)) / k)
    knee = 0.56 - 0.32 * fade
    low, high = (k - 0.14) / (knee - 0.14), (k - knee) / 0.71
    swing = F.when((k >= 0.14) & (k < knee), -3 * low * low * (1 - low) * F.pow(spread, F.lit(1.3))).when((k >= knee) & (k < knee + 0.71), 3 * high * (1 - high) * (1 - high) * F.pow(spread, F.lit(0.6)))
    share = share + F.when(spread > 0.01, F.coalesce(swing, F.lit(0.0))).otherwise(0.0)
    return F.when((sw > 0) & (zenith < math.pi / 2), share).otherwise(F.when(sw.isNotNull() & zenith.isNotNull(), 1.0))
