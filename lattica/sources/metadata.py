"""Dataset metadata: `# key` lines, each with its value on the next line; x, y, z on disk, z, y, x here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of the format, in the order in which they are written.
KEYS = {
    "resolution in nm": "resolution",
    "affinity filename": "affinity",
    "boundary filename": "boundary",
    "gold filename": "gold",
    "image filename": "image",
    "mask filename": "mask",
    "rhoana filename": "segmentation",
    "synapse filename": "synapse",
    "world bounding box": "world",
    "grid size": "grid",
    "train/val/test crop": "crop",
}
DEFAULT_FILES = {"gold": "gold/{}_gold.h5 main", "image": "images/{}_image.h5 main", "segmentation": "rhoana/{}_rhoana.h5 main", "affinity": "affinities/{}_affinities.h5 main"}


def _triple(text, kind: str):
    parts = F.split(text, "x")
    return F.struct(*[F.trim(parts[k]).cast(kind).alias(a) for k, a in ((2, "z"), (1, "y"), (0, "x"))])


def read_meta(spark: SparkSession, path) -> DataFrame:
    """One row a file: prefix, resolution, grid, crop (default: the whole grid), world box and file names.

    A missing or `None` file name takes its default; an unknown key fails the query.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.meta)?$", 1).alias("prefix"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    keys = F.filter(lines, lambda s, i: i % 2 == 0)
    values = F.filter(lines, lambda s, i: i % 2 == 1)
    pairs = F.map_from_arrays(F.transform(keys, lambda s: F.trim(F.regexp_replace(s, r"^#\s*", ""))), F.transform(values, lambda s: F.trim(s)))
    known = F.array(*map(F.lit, KEYS))
    odd = F.filter(F.map_keys("pairs"), lambda k: ~F.array_contains(F.col("known"), k))
    read = text.withColumn("pairs", pairs).withColumn("known", known).withColumn("odd", odd)
    read = read.withColumn("pairs", F.when(F.size("odd") == 0, F.col("pairs")).otherwise(F.raise_error(F.concat(F.lit("unknown metadata: "), F.concat_ws(", ", "odd"))).cast("map<string,string>")))
    value = lambda k: F.nullif(F.try_element_at("pairs", F.lit(k)), F.lit("None"))
    grid = _triple(value("grid size"), "long")
    crop = F.split(value("train/val/test crop"), "x")
    ends = lambda k, n: F.split(crop[k], ":")[n].cast("long")
    box = [F.struct(F.coalesce(ends(k, 0), F.lit(0)).alias("min"), F.coalesce(ends(k, 1), grid[a]).alias("max")).alias(a) for k, a in ((2, "z"), (1, "y"), (0, "x"))]
    numbers = F.transform(F.regexp_extract_all(value("world bounding box"), F.lit(r"(\d+)"), F.lit(1)), lambda s: s.cast("long"))
    world = F.when(F.size(numbers) == 6, F.struct(*[numbers[k].alias(n) for k, n in ((2, "zmin"), (1, "ymin"), (0, "xmin"), (5, "zmax"), (4, "ymax"), (3, "xmax"))]))
    files = []
    for key, name in KEYS.items():
        if key.endswith("filename"):
            default = F.format_string(DEFAULT_FILES[name].replace("{}", "%s"), "prefix") if name in DEFAULT_FILES else F.lit(None).cast("string")
            files.append(F.coalesce(value(key), default).alias(f"{name}_file"))
    out = read.select("prefix", _triple(value("resolution in nm"), "double").alias("resolution"), grid.alias("grid"), F.struct(*box).alias("crop"), world.alias("world"), *files)
    return out.withColumn("is_isotropic", (F.col("resolution.z") == F.col("resolution.y")) & (F.col("resolution.z") == F.col("resolution.x")))


def meta_text(datasets: DataFrame) -> DataFrame:
    """(prefix, value): the text of each dataset's metadata file; the world box is written as None."""
    r, g, c = F.col("resolution"), F.col("grid"), F.col("crop")
    values = {
        "resolution": F.concat_ws("x", r["x"], r["y"], r["z"]), "world": F.lit("None"), "grid": F.concat_ws("x", g["x"], g["y"], g["z"]),
        "crop": F.concat_ws("x", *[F.concat_ws(":", c[a]["min"], c[a]["max"]) for a in "xyz"]),
    }
    lines = []
    for key, name in KEYS.items():
        value = values[name] if name in values else F.coalesce(F.col(f"{name}_file"), F.lit("None"))
        lines += [F.lit(f"# {key}"), value]
    return datasets.select("prefix", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))


def spawn_meta(datasets: DataFrame, prefix: str, new_prefix: str, segmentation_file: str) -> DataFrame:
    """`datasets` with one more row: a dataset under a new prefix with another segmentation."""
    own = datasets.where(F.col("prefix") == prefix).withColumn("prefix", F.lit(new_prefix)).withColumn("segmentation_file", F.lit(segmentation_file))
    return datasets.unionByName(own)
