"""Climate table jobs (C) and reflectance and soil (R)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import beam_transmission, clamp, day_length, diffuse_share, julian_day, saturation_pressure, sky_transmission, solar_constant, solar_shift, solar_zenith, turbidity
from ..functions.splines import smooth_map
from ..sources.checkpoints import cut, forget
from .grid import fill_gaps, fill_multiscale, sharpen, usable_levels

SIGMA = 5.67e-8


def normalise_climate(raw: DataFrame, lat: str = "lat", lon: str = "lon", ts: str = "ts") -> DataFrame:
    """C1. Reanalysis units to C, percent, kPa, W/m2, m/s, degrees and mm."""
    t, d = F.col("t2m") - 273.15, F.col("d2m") - 273.15
    sw, direct = F.col("ssrd") / 3600, F.col("fdir") / 3600
    index = F.greatest(F.cos(solar_zenith(F.col(ts), F.col(lat), F.col(lon))), F.lit(0.0))
    return raw.select(
        "cell", ts, t.alias("temp"), F.least(saturation_pressure(d) / saturation_pressure(t) * 100, F.lit(100.0)).alias("relhum"), (F.col("sp") / 1000).alias("pres"), sw.alias("swdown"),
        (sw - index * direct).alias("difrad"), F.col("avg_sdlwrf").alias("lwdown"), (F.sqrt(F.col("u10") ** 2 + F.col("v10") ** 2) * 0.7477849).alias("windspeed"),
        F.pmod(F.atan2("u10", "v10") * 180 / math.pi + 180, F.lit(360.0)).alias("winddir"), (F.col("tp") * 1000).alias("precip"),
    )


def coastal_amplify(df: DataFrame, lsm: str = "lsm", temp: str = "temp", cell: str = "cell", ts: str = "ts") -> DataFrame:
    """C2. Swings about the daily mean grow towards the sea, if any cell is not all land."""
    if not df.filter(F.col(lsm) < 1).take(1):
        return df
    mean = F.avg(temp).over(Window.partitionBy(cell, F.to_date(ts)))
    return df.withColumn(temp, mean + (F.col(temp) - mean) * ((1 - F.col(lsm)) * 1.285 + 1))


def floor_radiation(df: DataFrame, cols: tuple[str, ...] = ("swdown", "difrad")) -> DataFrame:
    """C3. Negative radiation becomes 0."""
    return df.withColumns({c: F.when(F.col(c) < 0, 0.0).otherwise(F.col(c)) for c in cols})


def hourly_to_daily(df: DataFrame, value: str, fun: str = "avg", cell: str = "cell", ts: str = "ts") -> DataFrame:
    """C4. A daily mean, sum, min or max, with the day's range."""
    return df.groupBy(cell, F.to_date(ts).alias("day")).agg(getattr(F, fun)(value).alias(value), (F.max(value) - F.min(value)).alias("range"))


def daily_moisture(df: DataFrame, cell: str = "cell", ts: str = "ts") -> DataFrame:
    """C4. Daily vapour pressure and sky emissivity (clamped to 0..1)."""
    e = F.col("relhum") / 100 * saturation_pressure(F.col("temp"))
    em = F.col("lwdown") / (SIGMA * (F.col("temp") + 273.15) ** 4)
    return df.groupBy(cell, F.to_date(ts).alias("day")).agg(F.avg(e).alias("vapour"), clamp(F.avg(em), 0.0, 1.0).alias("emissivity"))


def daily_convert(tables: dict[str, DataFrame], cell: str = "cell", day: str = "day", albedo: float = 0.23) -> DataFrame:
    """C5. Separate daily tables (tmin, tmax, q, pres, rsn, lwn, u, v) joined and converted; a table albedo, where there is one, holds that of each cell and day."""
    names = list(tables)
    out = tables[names[0]]
    for n in names[1:]:
        out = out.join(tables[n], [cell, day])
    mean = (F.col("tmin") + F.col("tmax")) / 2
    vapour = F.col("q") * F.col("pres") / (0.622 + 0.378 * F.col("q"))
    return out.select(
        cell, day, mean.alias("temp"), (F.col("tmax") - F.col("tmin")).alias("range"), vapour.alias("vapour"), (F.col("rsn") / (1 - (F.col("albedo") if "albedo" in tables else F.lit(albedo)))).alias("swdown"),
        clamp(1 + F.col("lwn") / (SIGMA * (mean + 273.15) ** 4), 0.0, 1.0).alias("emissivity"), F.sqrt(F.col("u") ** 2 + F.col("v") ** 2).alias("windspeed"), clamp(100 * vapour / saturation_pressure(mean), 15.0, 100.0).alias("relhum"),
    )


def clear_sky_table(days: DataFrame, sites: DataFrame, slices: int = 4, humidity: float = 0.008, hourly: bool = False) -> DataFrame:
    """C6. Clear-sky radiation (W/m2), direct and diffuse, by day (or hour) and site, averaged over slices of an hour.

    Sites have site, lat and lon, and may have elevation (m) and humidity (specific, kg/kg) of their own. Every day meets every site, as that is the table.
    """
    steps = days.select(F.to_date("day").alias("day"))
    at = sites.select("site", "lat", "lon", F.col("elevation") if "elevation" in sites.columns else F.lit(0.0).alias("elevation"), F.col("humidity") if "humidity" in sites.columns else F.lit(humidity).alias("humidity"))
    both = steps.crossJoin(at).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(24 * slices - 1))))
    both = both.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("s") * (3600 // slices)))
    both = both.withColumn("z", solar_zenith(F.col("ts"), F.col("lat"), F.col("lon"))).withColumn("haze", turbidity(F.col("humidity")))
    z, haze = F.col("z"), F.col("haze")
    out = both.withColumn("rad", solar_constant(julian_day(F.col("ts"))) * (F.cos(z) * beam_transmission(z, haze, F.col("elevation")) + sky_transmission(z, haze)))
    return out.groupBy("site", "day", F.hour("ts").alias("hour")).agg(F.avg("rad").alias("clear")) if hourly else out.groupBy("site", "day").agg(F.avg("rad").alias("clear"))


def diffuse_partition(df: DataFrame, sw: str = "swdown", zenith: str = "zenith") -> DataFrame:
    """C7. Diffuse part of short-wave radiation, by clearness below that of the clearest sky at the zenith angle (radians). All of it at night."""
    return df.withColumn("difrad", diffuse_share(F.col(sw), F.col(zenith)) * F.col(sw))


def daily_to_hourly_temp(df: DataFrame, cell: str = "cell", day: str = "day", lat: str = "lat", lon: str = "lon", decay: float = 0.09) -> DataFrame:
    """C8. 24 hours (UTC) a day: a sine from sunrise to sunset, then an exponential fall towards the next minimum, rescaled to meet both ends.

    Day length follows date and latitude; polar days have a sine through 24 hours. Where the sun rises in the day before by UTC, the day starts
    from the minimum before. A day whose two ends are equal has that value at each hour. The hours are made in an array, so that a day's ends need no shuffle.
    """
    w = Window.partitionBy(cell).orderBy(day)
    d = df.select(cell, day, "tmin", "tmax", F.coalesce(F.lead("tmin").over(w), F.col("tmin")).alias("__next"), F.coalesce(F.lag("tmin").over(w), F.col("tmin")).alias("__prev"), day_length(julian_day(F.col(day)), F.col(lat)).alias("__len"), solar_shift(julian_day(F.col(day)), F.col(lon)).alias("__shift"))
    length, shift, lo = F.col("__len"), F.col("__shift"), F.col("__lo")
    today = shift + 12 - length / 2 > 0
    d = d.withColumn("__lo", F.when(today, F.col("tmin")).otherwise(F.col("__prev"))).withColumn("__end", F.when(today, F.col("__next")).otherwise(F.col("tmin")))
    span, fall = F.col("tmax") - lo, F.col("__end") - lo
    d = d.withColumn("__night", clamp(0.04187957 * span * (1 - length / 24) + 0.4372056, 0.01, 0.99))
    night, polar = F.col("__night"), (length == 0) | (length == 24)

    def wrapped(x: Column) -> Column:
        return F.when(x < 0, x + 24).when(x > 24, x - 24).otherwise(x)

    def temp(hour: Column) -> Column:
        clock = hour + shift
        since = wrapped(clock - F.when(length == 0, 0.0).otherwise(12 - length / 2))
        all_day = span * F.sin(math.pi * since / F.when(length == 24, 28.0).otherwise(24.0)) + fall * since / 24
        whole = length * math.pi / (math.pi - F.asin(night))  # a half wave that is at the night's share when the sun sets
        dark = night * F.exp((since - length) * F.try_divide(F.log(decay / night), 24 - length))
        after = F.when(clock > length, fall * F.try_divide(since - length, 24 - length)).otherwise(0.0)
        return lo + F.when(polar, all_day).otherwise(span * F.when(since > length, dark).otherwise(F.sin(math.pi * since / whole)) + after)

    d = d.withColumn("__t", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: temp(h.cast("double"))))
    least, most = F.array_min("__t"), F.array_max("__t")
    scaled = F.transform("__t", lambda t: F.coalesce(lo + F.try_divide((t - least) * span, most - least), lo))
    return d.select(cell, day, F.posexplode(scaled).alias("hour", "temp"))


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    a = np.diag(np.r_[1.0, 2 * (h[:-1] + h[1:]), 1.0]) + np.diag(np.r_[0.0, h[1:]], 1) + np.diag(np.r_[h[:-1], 0.0], -1)
    m = np.linalg.solve(a, np.r_[0.0, 6 * np.diff(np.diff(y) / h), 0.0]) if n <= 400 else _thomas(h, y)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = x[k + 1] - at, at - x[k]
    return (m[k] * t**3 + m[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * t + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u


def _thomas(h: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = len(y)
    diag, up, rhs = np.r_[1.0, 2 * (h[:-1] + h[1:]), 1.0], np.r_[0.0, h[1:]], np.r_[0.0, 6 * np.diff(np.diff(y) / h), 0.0]
    low = np.r_[h[:-1], 0.0]
    for i in range(1, n):
        f = low[i - 1] / diag[i - 1]
        diag[i] -= f * (up[i - 1] if i - 1 < len(up) else 0)
        rhs[i] -= f * rhs[i - 1]
    out = np.zeros(n)
    for i in range(n - 1, -1, -1):
        out[i] = (rhs[i] - (up[i] * out[i + 1] if i + 1 < n else 0)) / diag[i]
    return out


def daily_to_hourly_spline(df: DataFrame, value: str | list[str], cell: str = "cell", day: str = "day", lo: float | None = None, hi: float | None = None, shared: str | None = None) -> DataFrame:
    """C9. Hourly values of one or more series of each cell by natural cubic splines through noon values, clamped.

    A group is one cell's days, bounded by the length of the record. A series is NULL in a cell where it has no value; days without one are passed over.
    The series `shared` is scaled as `convert_hours` does with rain: to the day's value, evenly where that gives no rain; NULL on days without one.
    """
    values = [value] if isinstance(value, str) else list(value)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p["__noon"].to_numpy(float)
        order = np.argsort(x, kind="stable")
        x, ys = x[order], {v: p[v].to_numpy(float)[order] for v in values}
        at, out = np.arange(x[0] - 12, x[-1] + 12), {}
        for v, y in ys.items():
            known = ~np.isnan(y)
            out[v] = np.clip(_spline(x[known], y[known], at), -np.inf if lo is None else lo, np.inf if hi is None else hi) if known.any() else np.full(len(at), np.nan)
        if shared:
            days = out[shared].reshape(-1, 24)
            total = np.full((len(days), 1), np.nan)
            total[((x - x[0]) / 24).round().astype(int), 0] = ys[shared]
            mean = days.sum(axis=1, keepdims=True) / 24
            rate = np.divide(total, mean, out=np.zeros_like(total), where=mean != 0) * days
            out[shared] = np.where(np.isnan(days), np.nan, np.where(rate > 0, rate, total / 24)).ravel()
        return pd.DataFrame({cell: p[cell].iloc[0], "ts": (at * 3600).astype("datetime64[s]"), **out})

    kind = df.schema[cell].dataType.simpleString()
    given = df.filter(F.col(day).isNotNull() & F.coalesce(*values).isNotNull()).select(cell, (F.unix_date(F.col(day).cast("date")) * 24 + 12).alias("__noon"), *values)
    out = given.groupBy(cell).applyInPandas(run, f"{cell} {kind}, ts timestamp_ntz, " + ", ".join(f"{v} double" for v in values))
    return out.withColumns({v: F.nanvl(v, F.lit(None).cast("double")) for v in values})


def convert_hours(hourly: DataFrame, rain: DataFrame, vapour: str = "vapour", emissivity: str = "emissivity", precip: str = "precip", temp: str = "temp", cell: str = "cell", ts: str = "ts", day: str = "day") -> DataFrame:
    """C9. relhum, lwdown and precip of hours from splined vapour pressure, sky emissivity and rain, and the hours' temperature.

    Relative humidity is within 10..100. An hour's rain is the splined one times the day's value (`rain`: cell, day, precip) over the mean of its splined
    hours; where that is not above 0 (or the mean is 0) it is a 24th of the day's value.
    """
    t = F.col(temp)
    wet = (F.col(vapour) / saturation_pressure(t)) * 100
    d = hourly.withColumn("__day", F.to_date(ts)).join(rain.select(F.col(cell).alias("__cell"), F.col(day).alias("__d"), F.col(precip).alias("__total")), F.col(cell).eqNullSafe(F.col("__cell")) & (F.col("__day") == F.col("__d")), "left")
    mean = F.sum(F.col(precip) / 24.0).over(Window.partitionBy(cell, "__day"))
    hour = F.try_divide(F.col("__total"), mean) * F.col(precip)
    d = d.withColumn("relhum", clamp(wet, 10.0, 100.0)).withColumn("lwdown", F.col(emissivity) * SIGMA * F.pow(t + 273.15, F.lit(4.0)))
    d = d.withColumn(precip, F.when(F.col(precip).isNotNull(), F.when(hour > 0, hour).otherwise(F.col("__total") / 24)))
    return d.drop("__day", "__d", "__cell", "__total", vapour, emissivity)


def daily_to_hourly(df: DataFrame, temps: DataFrame | Column, cell: str = "cell", day: str = "day", ts: str = "ts") -> DataFrame:
    """C9. Pressure, humidity, long-wave and rain at each hour from daily vapour, emissivity, pres and precip, with the hours' temperature.

    Temperature is a table (cell, ts, temp), or a column computed from the cell and `ts`; with a column no hour is shuffled. Days are unique in a cell:
    a day's rain is shared among its hours inside the cell's group.
    """
    hours = daily_to_hourly_spline(df.filter(F.col(cell).isNotNull()), ["pres", "vapour", "emissivity", "precip"], cell, day, shared="precip")
    hours = hours.join(temps.select(cell, ts, "temp"), [cell, ts]) if isinstance(temps, DataFrame) else hours.withColumn("temp", temps)
    t = F.col("temp")
    wet = F.col("vapour") / saturation_pressure(t) * 100
    return hours.withColumns({"relhum": clamp(wet, 10.0, 100.0), "lwdown": F.col("emissivity") * SIGMA * F.pow(t + 273.15, F.lit(4.0))}).drop("vapour", "emissivity")


def blend_temperature(hourly: DataFrame, daily: DataFrame, value: str = "temp", cell: str = "cell", day: str = "day") -> DataFrame:
    """C10. Each day's hourly curve rescaled to another source's min and max."""
    w = Window.partitionBy(cell, day)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    d = hourly.withColumn("__s", (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return d.join(daily.select(cell, day, "tmin", "tmax"), [cell, day]).withColumn(value, F.coalesce(F.col("tmin") + F.col("__s") * (F.col("tmax") - F.col("tmin")), (F.col("tmin") + F.col("tmax")) / 2)).drop("__s", "tmin", "tmax")


def blend_precip(hourly: DataFrame, daily: DataFrame, value: str = "precip", total: str = "total", cell: str = "cell", day: str = "day") -> DataFrame:
    """C11. Hourly rain scaled to the daily total (ratio 1 if the hours have none), not below 0; NULL where the hour or the total is."""
    s = F.sum(value).over(Window.partitionBy(cell, day))
    d = hourly.withColumn("__s", s).join(daily.select(cell, day, total), [cell, day])
    scaled = F.col(value) * F.when(F.col("__s") == 0, F.when(F.col(total).isNotNull(), 1.0)).otherwise(F.col(total) / F.col("__s"))
    return d.withColumn(value, F.when(scaled.isNotNull(), F.greatest(scaled, F.lit(0.0)))).drop("__s", total)


def block_mean(df: DataFrame, hours: int, value: str, cell: str = "cell", ts: str = "ts") -> DataFrame:
    """C12. Means of blocks of hours."""
    return df.groupBy(cell, F.window(ts, f"{hours} hours").getField("start").alias("start")).agg(F.avg(value).alias(value))


def repeat_hours(df: DataFrame, hours: int, value: str, factor: float = 1.0, ts: str = "ts") -> DataFrame:
    """C12. Each value at every hour of its block; precipitation rates take factor 3600."""
    out = df.withColumn("__h", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return out.withColumn(ts, F.timestamp_seconds(F.unix_timestamp(F.col(ts).cast("timestamp")) + 3600 * F.col("__h"))).withColumn(value, F.col(value) * factor).drop("__h")


def modal_direction(df: DataFrame, value: str, time: str, step: float = 5) -> DataFrame:
    """C13. The most common direction by time, rounded to `step`; the smallest of equals; NULL if all differ."""
    c = df.groupBy(time, (F.round(F.col(value) / step) * step).alias("d")).agg(F.count("*").alias("k"))
    return c.groupBy(time).agg(F.when(F.max("k") > 1, F.min_by("d", F.struct(-F.col("k"), F.col("d")))).alias(value))


def coastal_exposure(df: DataFrame, lookup: DataFrame, direction: str, n: int = 8, cell: str = "cell") -> DataFrame:
    """C14. Exposure of the sector the wind comes from."""
    sector = F.pmod(F.round(F.col(direction) / (360 / n)), F.lit(float(n))).cast("int")
    return df.withColumn("sector", sector).join(lookup, [cell, "sector"], "left")


def paired_ranks(obs: DataFrame, hist: DataFrame, value: str, cell: str = "cell", most: int = 1000) -> DataFrame:
    """cell, i, o and h: both histories in rising order side by side, at m = least(values of either, most) ranks spread evenly from the smallest to the largest."""

    def ranked(d: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(cell)
        known = d.filter(F.col(value).isNotNull())
        return known.select(cell, F.col(value).alias(name), (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias(f"n{name}"))

    sizes = lambda d, n: d.filter(F.col(value).isNotNull()).groupBy(cell).agg(F.count("*").alias(n))
    m = sizes(obs, "a").join(sizes(hist, "b"), cell).select(cell, F.least("a", "b", F.lit(most)).alias("m"))

    def kept(d: DataFrame, name: str) -> DataFrame:
        n, r, last = F.col(f"n{name}") - 1, F.col("r"), F.col("m") - 1
        i = F.when(last > 0, F.ceil(r * last / F.nullif(n, F.lit(0)))).otherwise(0)
        at = F.when(last > 0, F.floor(i * n / last)).otherwise(0)
        return ranked(d, name).join(m, cell).withColumn("i", i).filter(at == r).select(cell, "i", name)

    return kept(obs, "o").join(kept(hist, "h"), [cell, "i"])


def bias_correct(obs: DataFrame, hist: DataFrame, fut: DataFrame, value: str, cell: str = "cell", knots: int = 10, ranks: int = 1000) -> DataFrame:
    """C15. Future values through a smooth map between both histories in rising order, then the range limit (C16).

    The map of a cell is a penalised cubic spline, linear beyond its ends, fitted to at most `ranks` pairs of like rank: that is all a
    group holds. Its knots join the future rows, which are mapped by an expression. Cells without a history drop out, NULLs stay.
    """

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        x, y, s = smooth_map(p["h"].to_numpy(float), p["o"].to_numpy(float), knots)
        return pd.DataFrame({cell: [p[cell].iloc[0]], "__x": [x.tolist()], "__y": [y.tolist()], "__s": [s.tolist()]})

    kind = fut.schema[cell].dataType.simpleString()
    maps = paired_ranks(obs, hist, value, cell, ranks).groupBy(cell).applyInPandas(fit, f"{cell} {kind}, __x array<double>, __y array<double>, __s array<double>")
    v, last = F.col(value), F.size("__x") - 2
    i = F.least(F.greatest(F.size(F.filter("__x", lambda e: e <= v)) - 1, F.lit(0)), last)
    at = lambda c, j: F.get(c, j)
    d = fut.join(maps, cell).withColumn("__i", i)
    i = F.col("__i")
    x0, x1, y0, y1, s0, s1 = at("__x", i), at("__x", i + 1), at("__y", i), at("__y", i + 1), at("__s", i), at("__s", i + 1)
    h, t, u = x1 - x0, x1 - v, v - x0
    inside = (t * y0 + u * y1) / h + (t * t * t / h - h * t) * s0 / 6 + (u * u * u / h - h * u) * s1 / 6
    low, high = y0 + u * ((y1 - y0) / h - h * s1 / 6), y1 + (v - x1) * ((y1 - y0) / h + h * s0 / 6)  # end slopes: the second derivative there is 0
    mapped = d.withColumn(value, F.when(u < 0, low).when(t < 0, high).otherwise(inside)).drop("__x", "__y", "__s", "__i")
    return range_limit(obs, hist, fut, value, cell, corrected=mapped)


def range_limit(obs: DataFrame, hist: DataFrame, fut: DataFrame, value: str, cell: str = "cell", f: float = 1.05, corrected: DataFrame | None = None) -> DataFrame:
    """C16. Future values (or those of `corrected`) within their expected mean +- (largest deviation observed / in history) * future's * f."""

    def stats(d: DataFrame, n: str) -> DataFrame:
        mean = F.avg(value)
        return d.groupBy(cell).agg(mean.alias(f"m_{n}"), F.greatest(F.max(value) - mean, mean - F.min(value)).alias(f"d_{n}"))

    wide = (fut if corrected is None else corrected).join(stats(obs, "o"), cell).join(stats(hist, "h"), cell).join(stats(fut, "f"), cell)
    mean = F.col("m_o") + F.col("m_f") - F.col("m_h")
    reach = F.coalesce(F.col("d_o") / F.nullif(F.col("d_h"), F.lit(0.0)), F.lit(1.0)) * F.col("d_f") * f
    return wide.withColumn(value, clamp(value, mean - reach, mean + reach)).select(*fut.columns)


def rain_limit(obs: DataFrame, hist: DataFrame, fut: DataFrame, value: str, cell: str = "cell") -> DataFrame:
    """C16. Future precipitation not above (largest observed / in history) * future's largest; no limit where history is dry."""
    top = lambda d, n: d.groupBy(cell).agg(F.max(value).alias(n))
    wide = fut.join(top(obs, "__o"), cell).join(top(hist, "__h"), cell).join(top(fut, "__f"), cell)
    limit = F.try_divide(F.col("__o") * F.col("__f"), F.col("__h"))
    return wide.withColumn(value, F.when(F.col(value).isNotNull(), F.least(value, limit))).select(*fut.columns)


def rain_adjust(df: DataFrame, value: str, step: str, share: str, total: str, regional: str, cell: str = "cell") -> DataFrame:
    """C17. share * n wet steps in each cell, then rescaled to the total.

    Too few: of the dry steps those with the least regional rain (ties by step, unknown last) get the cell's smallest rain. Too many: the smallest
    values become 0 (ties by step). A cell whose first step is NULL stays as it is; one without rain stays at 0.
    """
    w = Window.partitionBy(cell)
    v, wet = F.col(value), F.count(F.when(F.col(value) > 0, 1)).over(w)
    d = df.withColumn("__n", F.count("*").over(w)).withColumn("__want", F.round(F.col(share) * F.col("__n"))).withColumn("__wet", wet)
    d = d.withColumn("__dry_rank", F.row_number().over(Window.partitionBy(cell, v == 0).orderBy(F.asc_nulls_last(regional), step))).withColumn("__rank", F.row_number().over(w.orderBy(F.asc_nulls_last(value), step)))
    least = F.coalesce(F.min(F.when(v > 0, v)).over(w), F.lit(5001.0))
    more = (F.col("__wet") < F.col("__want")) & (v == 0) & (F.col("__dry_rank") <= F.col("__want") - F.col("__wet"))
    fewer = (F.col("__wet") > F.col("__want")) & v.isNotNull() & (F.col("__rank") <= F.col("__n") - F.col("__want"))
    d = d.withColumn("__v", F.when(more, least).when(fewer, 0.0).otherwise(v))
    known = F.min_by(v.isNotNull(), F.struct(step)).over(w)
    scaled = F.coalesce(F.try_divide(F.col("__v") * F.col(total), F.sum("__v").over(w)), F.when(F.col("__v").isNotNull(), 0.0))
    return d.withColumn(value, F.when(known, scaled).otherwise(v)).select(*df.columns)


def time_mean(df: DataFrame, value: str, cell: str = "cell", strict: bool = False) -> DataFrame:
    """C18. Mean by cell over a stack, NULLs skipped (strict: NULL if any is)."""
    m = F.when(F.count(value) == F.count("*"), F.avg(value)) if strict else F.avg(value)
    return df.groupBy(cell).agg(m.alias(value))


def fix_360_calendar(df: DataFrame, value: str, year: str, day360: str, cell: str = "cell") -> DataFrame:
    """C19. Days 1..360 on real dates (spread evenly over the year), the days between them linearly.

    A cell's dates meet in one window; the days up to the next date are made after it, so they are neither shuffled nor sorted.
    """
    first = F.make_date(F.col(year), F.lit(1), F.lit(1))
    size = F.dayofyear(F.make_date(F.col(year), F.lit(12), F.lit(31)))
    d = df.select(cell, F.unix_date(F.date_add(first, F.floor((F.col(day360) - 1) * size / 360).cast("int"))).alias("__d"), F.col(value).alias("__v")).filter(F.col("__d").isNotNull())
    known = F.when(F.col("__v").isNotNull(), F.struct("__d", "__v"))
    up, down = Window.partitionBy(cell).orderBy("__d"), Window.partitionBy(cell).orderBy(F.desc("__d"))
    d = d.withColumn("__l", F.last(known, True).over(up.rangeBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__r", F.last(known, True).over(down.rangeBetween(Window.unboundedPreceding, -1))).withColumn("__next", F.lag("__d").over(down))
    d = d.select(cell, "__d", "__v", "__l.*", "__r", "__next").toDF(cell, "__d", "__v", "__ld", "__lv", "__r", "__next").select("*", F.col("__r.__d").alias("__rd"), F.col("__r.__v").alias("__rv"))
    full = d.withColumn("__i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__next") - F.col("__d"), F.lit(1)) - 1)))
    at = F.col("__d") + F.col("__i")
    line = F.col("__lv") + (F.col("__rv") - F.col("__lv")) * (at - F.col("__ld")) / (F.col("__rd") - F.col("__ld"))
    here = F.when(F.col("__ld") == at, F.col("__lv"))  # its own date, or one with a value beside a row without
    return full.select(cell, F.date_from_unix_date(at).alias("day"), F.coalesce(F.when(F.col("__i") == 0, F.col("__v")), here, line).alias(value))


def day_climatology(df: DataFrame, value: str, day: str = "day", cell: str = "cell", strict: bool = False) -> DataFrame:
    """C20. Mean by month and day over years without 29 February; strict: an error unless there are 365."""
    md = F.date_format(day, "MM-dd")
    out = df.filter(md != "02-29").groupBy(cell, md.alias("month_day")).agg(F.avg(value).alias(value))
    if strict and out.groupBy(cell).count().filter("count <> 365").take(1):
        raise ValueError("a year has 365 days")
    return out


#: Centres of the six bands, micrometres
BAND_CENTRES = (0.645, 0.8585, 0.469, 0.555, 1.64, 2.13)


def planck_weights(centres: tuple[float, ...] = BAND_CENTRES, kelvin: float = 5778.0) -> list[float]:
    w = [1 / ((c * 1e-6) ** 5 * math.expm1(6.62607015e-34 * 299792458 / (c * 1e-6 * 1.380649e-23 * kelvin))) for c in centres]
    return [x / sum(w) for x in w]


def band_albedo(df: DataFrame, bands: list[str], scale: float = 10000) -> DataFrame:
    """R1. Planck-weighted mean of the bands over 10000."""
    ws = planck_weights() if len(bands) == len(BAND_CENTRES) else [1 / len(bands)] * len(bands)
    return df.withColumn("albedo", sum((F.col(b) * w for b, w in zip(bands, ws, strict=True)), F.lit(0.0)) / scale)


def _logit(c: Column) -> Column:
    c = clamp(c, 1e-6, 1 - 1e-6)
    return F.log(c / (1 - c))


def match_logit(fine: DataFrame, coarse: DataFrame, value: str) -> DataFrame:
    """R2. Fine values with the coarse ones' mean and sd on the logit scale; with one value only shifted."""
    s = lambda d, n: d.agg(F.avg(_logit(F.col(value))).alias(f"m{n}"), F.stddev_samp(_logit(F.col(value))).alias(f"s{n}"))
    wide = fine.join(F.broadcast(s(fine, 1)), how="cross").join(F.broadcast(s(coarse, 2)), how="cross")  # a row each
    z = (_logit(F.col(value)) - F.col("m1")) * F.coalesce(F.col("s2") / F.nullif(F.col("s1"), F.lit(0.0)), F.lit(1.0)) + F.col("m2")
    return wide.withColumn(value, 1 / (1 + F.exp(-z))).drop("m1", "s1", "m2", "s2")


def _leaf_spread(x: np.ndarray) -> np.ndarray:
    """Squared cosine of the mean leaf angle for a ratio x of vertical to horizontal leaf projections; 1/3 for spherical ones (x = 1)."""
    return np.where(x == 1, 1 / 3, np.cos(np.minimum(9.65 * (3 + x) ** -1.65, math.pi / 2)) ** 2)


def _scatter(leaf: np.ndarray, spread: np.ndarray, pai: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two-stream coefficients of a canopy whose leaves transmit a third of what they reflect: absorption a, backscatter g, extinction h, transmission s."""
    through = 0.33 * leaf
    a, back = 1 - leaf - through, 0.5 * (leaf + through + spread * (leaf - through))
    h = np.sqrt(a * a + 2 * a * back)
    return a, back, h, np.exp(-h * pai)


def _canopy_albedo(ground: np.ndarray, a: np.ndarray, g: np.ndarray, h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Diffuse albedo of a canopy with coefficients of _scatter over ground of a reflectance."""
    u = a + g * (1 - 1 / ground)
    down, up = (u - h) / s, (u + h) * s
    return g * (down - up) / ((a + g + h) * down - (a + g - h) * up)


def _bisect(f, args: tuple[np.ndarray, ...], lo: float, hi: float, tol: float = 1e-6, steps: int = 100) -> np.ndarray:
    """For each row of args the first midpoint of halved lo..hi at which f(midpoint, *args) is within tol of 0; NaN if none is in so many steps.

    Rows leave once they are found, or once their interval has no number between its ends, as nothing changes after that.
    """
    n = len(args[0])
    out, at, a, b = np.full(n, np.nan), np.arange(n), np.full(n, lo), np.full(n, hi)
    fa = f(a, *args)
    for _ in range(steps):
        if not len(at):
            break
        mid = (a + b) / 2
        y = f(mid, *args)
        found = np.abs(y) < tol
        out[at[found]] = mid[found]
        on, left = ~found & (mid != a) & (mid != b), fa * y < 0
        a, b, fa = np.where(left, a, mid), np.where(left, mid, b), np.where(left, fa, y)
        if not on.all():
            at, a, b, fa, args = at[on], a[on], b[on], fa[on], tuple(x[on] for x in args)
    return out


def _known_rows(f, *cols: pd.Series) -> pd.Series:
    """f of the rows in which no column is missing; missing in the others."""
    xs = [c.to_numpy(float, na_value=np.nan) for c in cols]
    there, out = ~np.isnan(xs).any(axis=0), np.full(len(xs[0]), np.nan)
    if there.any():
        with np.errstate(all="ignore"):
            out[there] = f(*[x[there] for x in xs])
    return pd.Series(out)


def two_stream_albedo(leaf: Column, ground: Column, x: Column, pai: Column) -> Column:
    @F.pandas_udf("double")
    def run(leaf: pd.Series, ground: pd.Series, x: pd.Series, pai: pd.Series) -> pd.Series:
        return _known_rows(lambda le, gr, x, p: _canopy_albedo(gr, *_scatter(le, _leaf_spread(x), p)), leaf, ground, x, pai)

    return run(leaf, ground, x, pai)


def ground_reflectance(leaf: Column, pai: Column, x: Column, albedo: Column) -> Column:
    """R3. The ground under leaves of a reflectance for which the albedo results; NULL if there is none."""

    @F.pandas_udf("double")
    def run(leaf: pd.Series, pai: pd.Series, x: pd.Series, albedo: pd.Series) -> pd.Series:
        return _known_rows(lambda le, p, x, want: _bisect(lambda v, want, *c: _canopy_albedo(v, *c) - want, (want, *_scatter(le, _leaf_spread(x), p)), 0.0001, 0.9999), leaf, pai, x, albedo)

    return run(leaf, pai, x, albedo)


def leaf_reflectance(pai: Column, ground: Column, x: Column, albedo: Column) -> Column:
    """R3. The leaves above ground of a reflectance for which the albedo results; NULL if there are none."""

    @F.pandas_udf("double")
    def run(pai: pd.Series, ground: pd.Series, x: pd.Series, albedo: pd.Series) -> pd.Series:
        return _known_rows(lambda p, gr, x, want: _bisect(lambda v, want, gr, j, p: _canopy_albedo(gr, *_scatter(v, j, p)) - want, (want, gr, _leaf_spread(x), p), 0.0001, 0.7499), pai, ground, x, albedo)

    return run(pai, ground, x, albedo)


def invert_reflectance(df: DataFrame, albedo: str, pai: str, x: str, tol: float = 1e-3, most: int = 50, w: float = 0.5) -> DataFrame:
    """R3. Leaf and ground reflectance of each cell (row, col) from its albedo, plant area and leaf angle ratio x.

    They start at 0.5 and 0.15. A round finds each by bisection of the two-stream albedo from the other's last value, fills gaps over the grid (G11,
    cells without x stay NULL) and takes the mean of old (weight w) and new. Rounds end once the larger of both mean absolute
    differences between a new mean and what was found is at most tol, or after `most`. A round's cells are one table in the shared folder, its filled
    gaps another; those before it are deleted.
    """
    there = F.col(x).isNotNull()
    d, before, used = df.withColumn("leaf", F.when(there, F.lit(0.5))).withColumn("ground", F.when(there, F.lit(0.15))), [], usable_levels(df)
    mixed = lambda c: (w * F.col(c) + (1 - w) * F.col(f"__{c}")).alias(c)
    for _ in range(most):
        found = {"__ground": ground_reflectance(F.col("leaf"), F.col(pai), F.col(x), F.col(albedo)), "__leaf": leaf_reflectance(F.col(pai), F.col("ground"), F.col(x), F.col(albedo))}
        whole = cut(d.withColumns(found))
        missing = whole.agg(*[f for c in ("ground", "leaf") for f in (F.count(F.when(there & F.col(f"__{c}").isNull(), 1)), F.avg(f"__{c}"))]).first()  # four numbers
        means, held = {f"__{c}": m for c, n, m in (("ground", *missing[:2]), ("leaf", *missing[2:])) if n}, [whole]
        if means:
            filled = cut(fill_gaps(whole, list(means), used, there))
            held.append(filled)
            filled = filled.withColumnsRenamed({c: f"__fill{c}" for c in means})
            values = {c: F.when(there, F.coalesce(c, f"__fill{c}", F.lit(m).cast("double"))) for c, m in means.items()}
            whole = whole.join(filled, ["row", "col"], "left").withColumns(values).drop(*[f"__fill{c}" for c in means])
        d = whole.select(*df.columns, mixed("leaf"), mixed("ground"))
        change = whole.agg(*[F.avg(F.abs(mixed(c) - F.col(f"__{c}"))) for c in ("ground", "leaf")]).first()
        for old in before:
            forget(old)
        before = held
        if None in tuple(change) or max(change) <= tol:
            break
    return d


#: Weights and thicknesses (cm) of the six soil depths
DEPTH_WEIGHTS, DEPTH_CM = (1, 0.5, 0.25, 0.125, 0.0625, 0.03125), (5, 10, 15, 30, 40, 100)


def depth_mean(df: DataFrame, values: list[str], depth: str = "depth", cell: str = "cell") -> DataFrame:
    """R4. Mean over the six depths (1..6) by weight and thickness, over those present."""
    w = F.get(F.array(*[F.lit(float(a * b)) for a, b in zip(DEPTH_WEIGHTS, DEPTH_CM, strict=True)]), F.col(depth) - 1)
    return df.groupBy(cell).agg(*[(F.sum(w * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values])


def soil_downscale(soil: DataFrame, landcover: DataFrame, factor: int, values: list[str], cls: str = "class", water: int = 80) -> DataFrame:
    """R5. Soil fractions at land-cover cells: 0 to NULL, gaps filled, sharpened by class; water stays NULL."""
    land = landcover.filter(F.col(cls) != water)
    out = landcover.select("row", "col", cls)
    for v in values:
        full = fill_multiscale(soil.select("row", "col", v), v, zero_to_null=True)
        out = out.join(sharpen(full, land, factor, v, cls).select("row", "col", v), ["row", "col"], "left")
    return out


def soil_type(df: DataFrame, types: DataFrame, values: list[str]) -> DataFrame:
    """R6. The nearest of a few soil types by L1 distance, each property over its sd among the types; the smallest name of equals."""
    # the types are a few rows: they become constants of one expression, so rows are mapped without a shuffle and repeated ones stay
    sd = types.agg(*[F.stddev_samp(v).alias(v) for v in values]).first()
    known = types.select("type", *values).collect()
    near = [F.struct(sum((F.abs(F.col(v) - F.lit(t[v])) / F.lit(sd[v]) for v in values), F.lit(0.0)).alias("d"), F.lit(t["type"]).alias("type")) for t in known]
    return df.withColumn("type", F.array_min(F.array(*near))["type"] if near else F.lit(None).cast("string"))
