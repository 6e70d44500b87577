"""Air-quality index: sub-indices, composite, category, action stage, concentration bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from airlake.functions.numeric import half_even, to_double

# Concentration cuts (upper bound of each band) and index bands.
POLLUTANTS = ("PM2.5", "PM10", "O3", "NO2", "SO2", "CO")
INDEX_BANDS = ((0, 50), (51, 100), (101, 200), (201, 300), (301, 400), (401, 500))
CUTS = {
    "PM2.5": (30, 60, 90, 120, 250),
    "PM10": (50, 100, 250, 350, 430),
    "O3": (50, 100, 168, 208, 748),
    "NO2": (40, 80, 180, 280, 400),
    "SO2": (40, 80, 380, 800, 1600),
    "CO": (1, 2, 10, 17, 34),
}
OPEN_TOP = 1e18
TOP_OF_SCALE = {"PM2.5": 500, "PM10": 600, "O3": 1000, "NO2": 1000, "SO2": 2000, "CO": 100}
CATEGORIES = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")
HEALTH_MESSAGES = {
    "Good": "No health risk. Safe for all outdoor activity.",
    "Satisfactory": "Minor discomfort for hypersensitive individuals.",
    "Moderate": "Sensitive people should limit prolonged outdoor exertion.",
    "Poor": "General public may experience mild to moderate symptoms.",
    "Very Poor": "Most people may experience health effects; reduce outdoor activity.",
    "Severe": "Health alert: everyone may experience serious health effects.",
}
ACTION_STAGES = {1: 201, 2: 301, 3: 401, 4: 451}
SPECIES_ALIASES = {"PM25": "PM2.5", "pm25": "PM2.5", "pm10": "PM10", "o3": "O3", "nox": "NO2", "so2": "SO2",
                   "co": "CO", "NOX": "NO2"}


def bands(pollutant: str, variant: str) -> list[tuple[float, float, int, int]]:
    """(low, high, index low, index high); the gapped table starts each band one unit (CO 0.1) higher."""
    cuts = CUTS[pollutant]
    if variant == "contiguous":
        lows, highs = (0.0, *cuts), (*cuts, OPEN_TOP)
    else:
        step = 0.1 if pollutant == "CO" else 1.0
        lows = (0.0, *(round(c + step, 1) for c in cuts))
        highs = (*cuts, TOP_OF_SCALE[pollutant])
    return [(float(lo), float(hi), il, ih) for lo, hi, (il, ih) in zip(lows, highs, INDEX_BANDS)]


def sub_index(pollutant: str, conc: Column, variant: str = "contiguous") -> Column:
    """Piecewise-linear sub-index, rounded half to even; null concentration gives null."""
    conc = to_double(conc)
    if variant == "gapped":
        conc = F.when(conc < 0, F.lit(0.0)).otherwise(conc)
        if pollutant == "CO":
            conc = conc / F.lit(1000.0)
    rows = bands(pollutant, variant)
    out: Column | None = None
    for lo, hi, ilo, ihi in rows:
        if variant == "contiguous":
            value = F.lit(float(ihi - ilo) / (hi - lo)) * (conc - F.lit(lo)) + F.lit(float(ilo))
        else:
            value = F.lit(float(ilo)) + (conc - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(ihi - ilo))
        out = F.when(conc <= hi, value) if out is None else out.when(conc <= hi, value)
    top = F.lit(500.0) if variant == "gapped" else value
    return half_even(F.when(conc.isNotNull(), out.otherwise(top)))


def sub_index_long(metric: Column, conc: Column, variant: str = "contiguous") -> Column:
    """Sub-index for long rows; unknown pollutants give null."""
    out = F.when(metric == POLLUTANTS[0], sub_index(POLLUTANTS[0], conc, variant))
    for p in POLLUTANTS[1:]:
        out = out.when(metric == p, sub_index(p, conc, variant))
    return out


def composite(concs: dict[str, Column], variant: str = "contiguous") -> dict[str, Column]:
    """Largest sub-index, the first pollutant that reaches it, and all sub-indices."""
    subs = {p: sub_index(p, c, variant) for p, c in concs.items()}
    cols = list(subs.values())
    value = F.greatest(*cols) if len(cols) > 1 else cols[0]
    dominant = reduce(
        lambda acc, kv: acc.when(kv[1] == value, kv[0]), list(subs.items())[1:],
        F.when(cols[0] == value, next(iter(subs))),
    )
    sub_map = F.map_filter(
        F.create_map(*[x for p, c in subs.items() for x in (F.lit(p), c)]), lambda _, v: v.isNotNull()
    )
    return {"aqi": value, "dominant": dominant, "sub_indices": sub_map}


def category(aqi: Column) -> Column:
    """Band name; values between bands or above 500 fall to the last band, as in the index tables."""
    out: Column | None = None
    for (lo, hi), name in zip(INDEX_BANDS, CATEGORIES):
        cond = aqi.between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.when(aqi.isNotNull(), out.otherwise(CATEGORIES[-1]))


def health_message(cat: Column) -> Column:
    items = list(HEALTH_MESSAGES.items())
    return reduce(lambda acc, kv: acc.when(cat == kv[0], kv[1]), items[1:], F.when(cat == items[0][0], items[0][1]))


def action_stage(aqi: Column, thresholds: dict[int, int] | None = None) -> Column:
    stages = sorted((thresholds or ACTION_STAGES).items(), reverse=True)
    out: Column | None = None
    for stage, floor in stages:
        out = F.when(aqi >= floor, stage) if out is None else out.when(aqi >= floor, stage)
    return F.when(aqi.isNotNull(), out.otherwise(0))


def conc_band(species: Column, value: Column) -> Column:
    """Severity band of a concentration, inclusive upper bounds (PM2.5, PM10, O3)."""
    def one(p: str) -> Column:
        out = F.when(value <= CUTS[p][0], CATEGORIES[0])
        for cut, name in zip(CUTS[p][1:], CATEGORIES[1:]):
            out = out.when(value <= cut, name)
        return F.when(value.isNotNull(), out.otherwise(CATEGORIES[-1]))

    return F.when(species == "PM10", one("PM10")).when(species == "O3", one("O3")).otherwise(one("PM2.5"))


def species_alias(c: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in SPECIES_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, c), c)
