"""Column rules on pixels, cells and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the acquisition contract.
BANDS = ["blue", "green", "red", "nir08", "swir16", "swir22"]
INDICES = ["ndvi", "ndbi", "mndwi", "bsi"]
REFLECTANCE_SCALE = 0.0000275
REFLECTANCE_OFFSET = -0.2
REFLECTANCE_RANGE = (-0.2, 1.6)
REJECTED_QA_BITS = [0, 1, 2, 3, 4, 5]
AEROSOL_PLATFORMS = ["landsat-8", "landsat-9"]
HARMONISED_PLATFORM = "landsat-7"
# band: (intercept, slope)
HARMONISATION = {
    "blue": (0.0003, 0.8474),
    "green": (0.0088, 0.8483),
    "red": (0.0061, 0.9047),
    "nir08": (0.0412, 0.8462),
    "swir16": (0.0254, 0.8937),
    "swir22": (0.0172, 0.9071),
}
# season: months, and the day counts that make it complete
SEASON_DAYS = {"DJF": (89, 91), "MAM": (92, 92), "JJ": (61, 61), "Monsoon": (92, 92), "Post-monsoon": (61, 61)}
SENTINEL = {"weather": -900.0, "raster": -9000.0, "elevation": -32768.0}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(value: str | Column, limit: float = SENTINEL["raster"]) -> Column:
    """Sentinel and NaN to NULL."""
    v = _c(value).cast("double")
    return F.when(~F.isnan(v) & (v > limit), v)


def valid_cell(columns: Sequence[str] = tuple(INDICES)) -> Column:
    """All bands present, finite and within 1.001 of zero."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c)
        ok = ok & v.isNotNull() & ~F.isnan(v) & (v > -9000.0) & (F.abs(v) <= 1.001)
    return ok


def reflectance(dn: str | Column) -> Column:
    return _c(dn).cast("double") * REFLECTANCE_SCALE + F.lit(REFLECTANCE_OFFSET)


def physical(columns: Sequence[str | Column]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(_c(c).between(*REFLECTANCE_RANGE), F.lit(False))
    return ok


def clear_pixel(qa_pixel="qa_pixel", qa_radsat="qa_radsat", qa_aerosol="qa_aerosol", platform="platform") -> Column:
    """No rejected QA bit, no saturation, and for aerosol platforms neither fill nor high aerosol."""
    mask = sum(1 << b for b in REJECTED_QA_BITS)
    base = (_c(qa_pixel).bitwiseAND(mask) == 0) & (_c(qa_radsat) == 0)
    aerosol = _c(qa_aerosol)
    usable = (aerosol.bitwiseAND(1) == 0) & (F.shiftright(aerosol, 6).bitwiseAND(3) != 3)
    return base & (~_c(platform).isin(AEROSOL_PLATFORMS) | F.coalesce(usable, F.lit(False)))


def strict_clear_pixel(qa_pixel="qa_pixel", qa_radsat="qa_radsat", qa_aerosol="qa_aerosol", platform="platform") -> Column:
    """As ``clear_pixel`` plus a valid, not interpolated aerosol retrieval."""
    aerosol = _c(qa_aerosol)
    retrieved = (aerosol.bitwiseAND(2) != 0) & (aerosol.bitwiseAND(32) == 0)
    return clear_pixel(qa_pixel, qa_radsat, qa_aerosol, platform) & (
        ~_c(platform).isin(AEROSOL_PLATFORMS) | F.coalesce(retrieved, F.lit(False)))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def normalised_differences(prefix: str = "") -> dict[str, Column]:
    b = {name: F.col(prefix + name) for name in BANDS}
    nd = lambda p, q: ratio(p - q, p + q)
    return {
        "ndvi": nd(b["nir08"], b["red"]),
        "ndbi": nd(b["swir16"], b["nir08"]),
        "mndwi": nd(b["green"], b["swir16"]),
        "bsi": nd(b["swir16"] + b["red"], b["nir08"] + b["blue"]),
    }


def harmonised(band: str, value: Column, only_platform: Column) -> Column:
    """OLI-like reflectance, applied only where landsat-7 is the sole platform of the epoch."""
    intercept, slope = HARMONISATION[band]
    return F.when(only_platform, F.lit(intercept) + F.lit(slope) * value).otherwise(value)


def season(date: str | Column) -> Column:
    m = F.month(_c(date))
    return (F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m == 6, "JJ")
            .when(m.isin(7, 8, 9), "Monsoon").otherwise("Post-monsoon"))


def season_year(date: str | Column) -> Column:
    d = _c(date)
    return F.year(d) + F.when(F.month(d) == 12, 1).otherwise(0)


def season_is_complete(name: Column, days: Column) -> Column:
    ok = F.lit(False)
    for s, (low, high) in SEASON_DAYS.items():
        ok = ok | ((name == s) & days.between(low, high))
    return ok


def weather_flag(rain: str | Column, temperature: str | Column) -> Column:
    """First matching quality flag; NULL where the row is unremarkable."""
    return (F.when(_c(rain) > 200, "EXTREME_PRECIPITATION_GT200MM_REQUIRES_STATION_CHECK")
            .when(_c(rain) < 0, "NEGATIVE_PRECIPITATION")
            .when(F.abs(_c(temperature)) > 70, "IMPOSSIBLE_TEMPERATURE"))


def recode(value: str | Column, table: dict[int, int]) -> Column:
    """Class recode by code list; unlisted codes become 0."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(value)), F.lit(0))


def block_id(row, col, size_m: float, cell_m: float, width: int) -> Column:
    """Row-major spatial block of a cell."""
    k = max(1, round(size_m / cell_m))
    across = -(-width // k)
    return F.floor(_c(row) / k) * across + F.floor(_c(col) / k)


def split_role(block: str | Column) -> Column:
    """Outer role from the block column alone: a test stripe, its buffer, and development."""
    c = F.pmod(_c(block), F.lit(10))
    return F.when(c.isin(3, 4), "test").when(c.isin(2, 5), "buffer").otherwise("development")


def mean_of(columns: Sequence[str | Column]) -> Column:
    """Complete-case row mean."""
    total = _c(columns[0])
    for c in columns[1:]:
        total = total + _c(c)
    return total / F.lit(float(len(columns)))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def sensor_reflectance(dn, baseline: str | Column, offset: int = -1000, from_baseline: str = "04.00") -> Column:
    """10 m sensor contract: (DN + offset) / 10000 with the offset only from the given processing baseline."""
    shift = F.when(_c(baseline) >= from_baseline, F.lit(offset)).otherwise(F.lit(0))
    return (_c(dn) + shift) / F.lit(10000.0)


def nested_levels(value: Column, limits: dict) -> Column:
    """Array of the levels whose limit the value meets, for nested limits {level: limit}; constant arrays only."""
    ordered = sorted(limits.items(), key=lambda item: item[1])
    out = None
    for i, (_, limit) in enumerate(ordered):
        levels = F.array(*[F.lit(level) for level, _ in ordered[i:]])
        out = F.when(value <= limit, levels) if out is None else out.when(value <= limit, levels)
    return out
