"""Configuration sources: JSON records with fixed schemas, and property files."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_SCHEMA = (
    "_class_name string, _diffusers_version string, elev_coarse_pool_mode string, p5_coarse_pool_mode string, coarse_means array<float>, "
    "coarse_stds array<float>, cond_snr array<float>, frequency_mult array<float>, histogram_raw array<float>, coarse_pooling int, "
    "latent_compression int, native_resolution float, drop_water_pct float, residual_mean float, residual_std float"
)
QUANTILE_SCHEMA = "n_quantiles int, data_quantile_tables array<array<float>>, a_temp_std float, b_temp_std float, temp_std_p1 float, temp_std_p99 float"
MANIFEST_SCHEMA = "repositorySlug string, revision string, assets map<string, struct<sha256:string, sizeBytes:bigint, url:string>>"
LENGTHS = {"coarse_means": 6, "coarse_stds": 6, "cond_snr": 5, "frequency_mult": 5}


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    """Model configurations; ``problem`` names the first rule that a record breaks, else null."""
    rows = spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("problem", model_problem())


def model_problem() -> F.Column:
    rules = [(F.coalesce(F.size(name), F.lit(-1)) != n, f"{name} must contain exactly {n} values") for name, n in LENGTHS.items()]
    rules += [(F.coalesce(F.col(name), F.lit(0)) <= 0, f"{name} must be > 0") for name in ("coarse_pooling", "latent_compression", "native_resolution")]
    rules.append((F.col("histogram_raw").isNotNull() & (F.size("histogram_raw") != 5), "histogram_raw must contain exactly 5 values when provided"))
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in rules])


def read_quantiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUANTILE_SCHEMA).option("multiLine", True).json(path)


def manifest_assets(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per asset of JSON manifests: slug, revision, name, sha256, size_bytes, url."""
    parsed = texts.select(F.from_json(column, MANIFEST_SCHEMA).alias("m"))
    each = parsed.select("m.repositorySlug", "m.revision", F.explode("m.assets").alias("name", "a"))
    return each.select(F.col("repositorySlug").alias("slug"), "revision", "name", "a.sha256", F.col("a.sizeBytes").alias("size_bytes"), "a.url")


def verify_assets(spark: SparkSession, files: str, assets: DataFrame) -> DataFrame:
    """Files compared with a manifest: name, ok."""
    found = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("got"))
    return assets.join(found, "name", "left").select("name", F.coalesce(F.lower("sha256") == F.col("got"), F.lit(False)).alias("ok"))


@dataclass(frozen=True)
class Settings:
    """Engine settings with their defaults; property files override them by dotted name."""

    tile_size: int = 256
    spawn_initial: int = 16
    spawn_largest: int = 128
    validate_model: bool = True
    device: str = "auto"
    explorer_port: int = 19801

    NAMES = {
        "tile_size": "tile_size", "spawn_search.initial_size": "spawn_initial", "spawn_search.max_size": "spawn_largest",
        "validate_model": "validate_model", "inference.device": "device", "explorer.port": "explorer_port",
    }

    def __post_init__(self) -> None:
        if self.tile_size <= 0 or self.tile_size & (self.tile_size - 1):
            raise ValueError("tile_size must be a power of two")

    @classmethod
    def parse(cls, text: str) -> Settings:
        """From lines ``name=value``; comments, unknown names and values of the wrong type are passed over."""
        kinds = {f.name: f.type for f in fields(cls)}
        got: dict[str, object] = {}
        for line in text.splitlines():
            name, eq, value = line.partition("=")
            key = cls.NAMES.get(name.strip())
            if line.lstrip().startswith(("#", "!")) or not eq or key is None:
                continue
            value = value.strip()
            if kinds[key] == "int":
                if value.lstrip("+-").isdigit():
                    got[key] = int(value)
            elif kinds[key] == "bool":
                got[key] = value.lower() == "true"
            else:
                got[key] = value
        return cls(**got)


def coarse_response(cells: DataFrame, names: dict[int, str]) -> DataFrame:
    """One row (json): every channel's rounded 2-D array under its name."""
    from ..operators.stats import nested

    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    data = nested(cells).withColumn("name", F.element_at(label, F.col("ch")))
    return data.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "data"))))).alias("json"))


CELL = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
