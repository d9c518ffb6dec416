"""Rule classification of cells, names of classes, and heights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import clamp

#: Class ids and names (fixed values).
CLASSES = {
    1: "plains", 3: "snowy_plains", 5: "desert", 6: "swamp", 8: "forest", 15: "taiga", 16: "snowy_taiga", 17: "savanna", 19: "windswept_hills",
    23: "jungle", 26: "badlands", 29: "meadow", 31: "grove", 32: "snowy_slopes", 33: "frozen_peaks", 35: "stony_peaks", 41: "warm_ocean",
    44: "ocean", 46: "cold_ocean", 48: "frozen_ocean", 108: "forest_sparse", 115: "taiga_sparse", 116: "snowy_taiga_sparse",
}
ID = {name: k for k, name in CLASSES.items()}


def potential_evaporation(temp: Column, t_std: Column) -> Column:
    warm = F.greatest(F.lit(0.0), temp + 0.5 * t_std)
    return F.greatest(F.lit(250.0), 250.0 + 25.0 * warm + 0.7 * warm * warm)


def growing_season(temp: Column, t_std: Column) -> Column:
    """Days above five degrees of a sine-shaped year."""
    swing = t_std * 1.414
    x = (5.0 - temp) / F.when(swing < 0.1, 1.0).otherwise(swing)
    year = 365.0 * (0.5 - F.asin(clamp(x, F.lit(-1.0), F.lit(1.0))) / math.pi)
    flat = F.when(temp > 5.0, 365.0).otherwise(0.0)
    return F.when(swing < 0.1, flat).when(x <= -1.0, 365.0).when(x >= 1.0, 0.0).otherwise(year)


def derive(cells: DataFrame) -> DataFrame:
    """What the rules look at, from elev, temp, t_season, precip, p_cv, slope and noises n_temp, n_precip, n_snow (0: none)."""
    temp = F.col("temp") + F.col("n_temp")
    precip = F.greatest(F.lit(0.0), F.col("precip")) * (1.0 + F.col("n_precip"))
    out = cells.withColumns({"c_temp": temp, "c_precip": precip, "c_std": F.col("t_season") / 100.0})
    pet = potential_evaporation(F.col("c_temp"), F.col("c_std"))
    moist = F.col("c_precip") / F.greatest(F.lit(1.0), pet) * (1.0 - 0.35 * F.least(F.lit(1.0), F.col("p_cv") / 100.0))
    out = out.withColumns({"c_moist": moist, "c_season": growing_season(F.col("c_temp"), F.col("c_std"))})
    season = clamp((F.col("c_season") - 60.0) / 90.0, F.lit(0.0), F.lit(1.0))
    cliff = 0.7 + (1.19 - 0.7) * clamp((F.col("c_moist") - 0.35) / 0.45, F.lit(0.0), F.lit(1.0))
    out = out.withColumns({"c_trees": F.col("c_moist") * season, "c_cliff": cliff})
    snow = (F.col("c_temp") + F.col("n_snow") < 0) & (F.col("c_precip") > 150.0) & ~(F.col("slope") > 0.78)
    medium = (F.col("slope") >= 0.62) & (F.col("slope") < F.col("c_cliff"))
    trees = F.col("c_trees")
    # Cover: 0 none, 1 sparse, 2 forest, 3 dense, 4 rainforest; slopes thin it out.
    cover = F.when(trees < 0.2, 0).when(trees < 0.5, 1).when(trees < 0.8, 2).when(trees < 1.3, 3).otherwise(4)
    bare = F.col("slope") >= F.col("c_cliff")
    cover = F.when(bare, 0).when(medium & (cover > 1), 1).otherwise(cover)
    t = F.col("c_temp")
    # Bands: 0 frozen, 1 cold, 2 cool, 3 temperate, 4 warm, 5 hot.
    band = F.when(t < -5, 0).when(t < 5, 1).when(t < 12, 2).when(t < 20, 3).when(t < 26, 4).otherwise(5)
    return out.withColumns({
        "c_snow": snow, "c_medium": medium, "c_bare": bare, "c_cover": cover, "c_band": band,
        "c_barren": (F.col("c_moist") < 0.05) | (F.col("c_season") < 60.0),
    })


def classify(cells: DataFrame) -> DataFrame:
    """``class_id`` by ordered rules; where a climate value is missing it is plains."""
    c = derive(cells)
    elev, band, cover, snow, temp = F.col("elev"), F.col("c_band"), F.col("c_cover"), F.col("c_snow"), F.col("c_temp")
    thin, none, warm, hot = cover.isin(1, 2), cover == 0, band == 4, band == 5
    lowland, mountains = F.greatest(F.lit(0.0), elev) < 200, elev > 2500
    dry = (F.col("c_moist") < 0.35) | (F.col("c_precip") < 350)
    name = lambda n: F.lit(ID[n])
    peak = F.when(snow, name("frozen_peaks")).otherwise(name("stony_peaks"))
    open_ground = F.when(dry, name("grove")).otherwise(name("plains"))
    chill = F.when(band.isin(1, 2), name("taiga")).otherwise(name("forest"))
    ocean = F.when(band == 0, name("frozen_ocean")).when(band == 1, name("cold_ocean")).when(band >= 4, name("warm_ocean")).otherwise(name("ocean"))
    snowy_wood = F.when(thin, name("snowy_taiga_sparse")).otherwise(name("snowy_taiga"))
    high = (
        F.when(F.col("c_bare"), peak)
        .when(snow & none, name("snowy_slopes")).when(snow, snowy_wood)
        .when(none & F.col("c_barren"), name("windswept_hills")).when(none, open_ground)
        .when(thin, name("taiga_sparse")).otherwise(name("taiga"))
    )
    low = (
        F.when(F.col("c_bare"), peak)
        .when(snow & none, name("snowy_plains")).when(snow, snowy_wood)
        .when(none & (warm | hot), name("desert"))
        .when(none & F.col("c_barren") & ~lowland & band.isin(1, 2, 3), name("grove")).when(none, open_ground)
        .when(thin & hot, name("jungle"))
        .when(warm & (cover == 1) & ~F.col("c_medium"), name("savanna"))
        .when((warm & (cover == 2)) | (thin & (band == 3)), name("forest_sparse")).when(thin, name("taiga_sparse"))
        .when(hot, name("jungle"))
        .when((cover == 3) & warm & lowland, name("swamp")).when(cover == 3, chill)
        .when(warm & (temp >= 18) & (F.col("c_std") < 5), name("jungle")).when(lowland, name("swamp")).otherwise(chill)
    )
    known = F.col("temp").isNotNull() & F.col("t_season").isNotNull() & F.col("precip").isNotNull() & F.col("p_cv").isNotNull()
    rule = F.when(~known, name("plains")).when(elev < 0, ocean).when(mountains, high).otherwise(low)
    return c.withColumn("class_id", rule.cast("smallint"))


def class_names(spark) -> DataFrame:
    """The dimension table (class_id, class_name)."""
    return spark.createDataFrame([(k, v) for k, v in CLASSES.items()], "class_id smallint, class_name string")


def with_names(cells: DataFrame) -> DataFrame:
    """Names by a broadcast of the 23 classes; an unknown id is plains."""
    return cells.join(F.broadcast(class_names(cells.sparkSession)), "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.lit(CLASSES[1])))


def clamp_scale(scale: Column) -> Column:
    return clamp(scale, F.lit(1), F.lit(6))


def block_height(metres: Column, scale: Column, resolution: float = 30.0) -> Column:
    """Block level of a height: linear above the sea, by roots below."""
    above = F.greatest(metres, F.lit(0.0)) / (F.lit(resolution) / scale)
    below = -F.sqrt(F.abs(metres) + 10.0) + F.sqrt(F.lit(10.0))
    return F.when(metres >= 0, above.cast("int") + 63).otherwise(below.cast("int") + 62)


def top_height(scale: Column, resolution: float = 30.0) -> Column:
    return block_height(F.lit(10000.0), scale, resolution)


def density(target: Column, y: Column) -> Column:
    """How far ``y`` is below the surface; without a surface it is -y."""
    return F.coalesce(target - y, -y)


def to_int16(v: Column) -> Column:
    """Rounded down and clamped to 16 bits; NaN is 0."""
    return F.when(F.isnan(v), F.lit(0)).otherwise(clamp(F.floor(v), F.lit(-32768), F.lit(32767))).cast("smallint")


def precipitation(has: Column, base_temp: Column, default: str = "snow") -> Column:
    return F.when(~has, "none").when(base_temp >= 0.15, "rain").otherwise(default)
