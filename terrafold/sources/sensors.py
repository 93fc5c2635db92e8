"""Band metadata of known sensors as two small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Per sensor its working resolution, then per band, in order: name, mean, standard deviation,
# wavelength in micrometres, and the band's own resolution where it differs.
SENSORS = {
    "sentinel-2-l2a": (10, [
        ("blue", 1105.0, 1809.0, 0.493), ("green", 1355.0, 1757.0, 0.56), ("red", 1552.0, 1888.0, 0.665), ("rededge1", 1887.0, 1870.0, 0.704, 20), ("rededge2", 2422.0, 1732.0, 0.74, 20),
        ("rededge3", 2630.0, 1697.0, 0.783, 20), ("nir", 2743.0, 1742.0, 0.842), ("nir08", 2785.0, 1648.0, 0.865, 20), ("swir16", 2388.0, 1470.0, 1.61, 20), ("swir22", 1835.0, 1379.0, 2.19, 20),
    ]),
    "planetscope-sr": (5, [
        ("coastal_blue", 1720.0, 747.0, 0.443), ("blue", 1715.0, 698.0, 0.49), ("green_i", 1913.0, 739.0, 0.531), ("green", 2088.0, 768.0, 0.565), ("yellow", 2274.0, 849.0, 0.61), ("red", 2290.0, 868.0, 0.665),
        ("rededge", 2613.0, 849.0, 0.705), ("nir", 3970.0, 914.0, 0.865),
    ]),
    "landsat-c2l1": (30, [("red", 10678.0, 6025.0, 0.65), ("green", 10563.0, 5411.0, 0.56), ("blue", 11083.0, 5468.0, 0.48), ("nir08", 14792.0, 6746.0, 0.86), ("swir16", 12276.0, 5897.0, 1.6), ("swir22", 10114.0, 4850.0, 2.2)]),
    "landsat-c2l2-sr": (30, [("red", 13705.0, 9578.0, 0.65), ("green", 13310.0, 9408.0, 0.56), ("blue", 12474.0, 10144.0, 0.48), ("nir08", 17801.0, 8277.0, 0.86), ("swir16", 14615.0, 5300.0, 1.6), ("swir22", 12701.0, 4522.0, 2.2)]),
    "naip": (1.0, [("red", 110.16, 47.23, 0.65), ("green", 115.41, 39.82, 0.56), ("blue", 98.15, 35.43, 0.48), ("nir", 139.04, 49.86, 0.842)]),
    "linz": (0.5, [("red", 89.96, 41.83, 0.635), ("green", 99.46, 36.96, 0.555), ("blue", 89.51, 31.45, 0.465)]),
    "sentinel-1-rtc": (10, [("vv", -12.113, 8.314, 3.5), ("vh", -18.673, 8.017, 4.0)]),
    "modis": (500, [
        ("sur_refl_b01", 1072.0, 1643.0, 0.645, 250), ("sur_refl_b02", 1624.0, 1878.0, 0.858, 250), ("sur_refl_b03", 931.0, 1449.0, 0.469), ("sur_refl_b04", 1023.0, 1538.0, 0.555), ("sur_refl_b05", 1599.0, 1763.0, 1.24),
        ("sur_refl_b06", 1404.0, 1618.0, 1.64), ("sur_refl_b07", 1051.0, 1396.0, 2.13),
    ]),
    "satellogic-MSI-L1D": (1.0, [("red", 1451.54, 995.48, 0.64), ("green", 1456.54, 771.29, 0.545), ("blue", 1543.22, 708.86, 0.48), ("nir", 2132.68, 1236.71, 0.825)]),
}


def sensors(spark: SparkSession) -> DataFrame:
    """(sensor, gsd)."""
    return spark.createDataFrame([(s, float(g)) for s, (g, _) in SENSORS.items()], "sensor string, gsd double")


def bands(spark: SparkSession) -> DataFrame:
    """(sensor, ord, band, mean, std, wavelength, band_gsd); band_gsd is null where the sensor's holds."""
    rows = [(s, i, b[0], b[1], b[2], b[3], float(b[4]) if len(b) > 4 else None) for s, (_, bs) in SENSORS.items() for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "sensor string, ord int, band string, mean double, std double, wavelength double, band_gsd double")


def lookup(spark: SparkSession, sensor: str, names: list[str] | None = None) -> DataFrame:
    """Bands of a sensor in the asked order with their resolution (own, else the sensor's); unknown names raise."""
    if sensor not in SENSORS:
        raise ValueError(f"unknown sensor {sensor!r}; known: {', '.join(SENSORS)}")
    known = [b[0] for b in SENSORS[sensor][1]]
    names = known if names is None else names
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"{sensor} has no bands {', '.join(missing)}")
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, band string")
    b = bands(spark).where(F.col("sensor") == sensor).join(sensors(spark), "sensor")
    return asked.join(b, "band").select("sensor", "place", "band", "mean", "std", "wavelength", F.coalesce("band_gsd", "gsd").alias("gsd")).orderBy("place")


def normalize(pixels: DataFrame, stats: DataFrame, *, band: str = "band", value: str = "value") -> DataFrame:
    """(value - mean) / std by band; a band without statistics stays as it is. ``stats`` is a dimension table."""
    s = stats.select(F.col("band").alias(band), "mean", "std")
    return pixels.join(s, band, "left").withColumn(value, F.when(F.col("mean").isNotNull(), F.try_divide(F.col(value) - F.col("mean"), F.col("std"))).otherwise(F.col(value))).drop("mean", "std")
