"""Scene files, their metadata, and small JSON inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scene_id
from ..functions.times import parse_datetime, whole_seconds

EXTENSIONS = ("tif", "tiff", "gtiff", "cog")
#: Fixed: tag names by meaning, the first with a value counts.
TIME_TAGS = ("ACQUISITION_TIME", "ACQUISITION_DATE", "DATE_ACQUIRED", "SENSING_TIME", "DATETIME", "datetime", "TIFFTAG_DATETIME", "acquisition_time")
SENSOR_TAGS = ("SENSOR", "SENSOR_ID", "INSTRUMENT", "instruments", "sensor")
PLATFORM_TAGS = ("PLATFORM", "SPACECRAFT_ID", "SATELLITE", "MISSION", "platform")
LEVEL_TAGS = ("PROCESSING_LEVEL", "processing:level", "processing_level")
CLOUD_TAGS = ("eo:cloud_cover", "CLOUD_COVER", "cloud_cover")
#: Fixed: file name patterns and what they say of platform and sensor.
NAME_PATTERNS = (
    (r"(?i)^S2([ABC])_", "Sentinel-2", "MSI"),
    (r"(?i)^S1([ABC])_", "Sentinel-1", "C-SAR"),
    (r"(?i)^L[COTEM]0?([789])", "Landsat-", None),
    (r"(?i)^PS()", "PlanetScope", "PS"),
)


def discover(spark: SparkSession, folders: list[str], content: bool = False) -> DataFrame:
    """(path, size, mtime, filename, stem[, content]) of scene files, by a listing alone unless the content is asked for."""
    glob = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folders)
    files = files.filter(~F.col("path").contains("/.tmp/"))
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", F.col("length").alias("size"), whole_seconds(F.unix_millis("modificationTime")).alias("mtime"), name.alias("filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), *(["content"] if content else []))
    return out


def not_ingested(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files without a complete ingestion of the same path, size and whole second of change: ``done(path, size, mtime, status)``."""
    return files.join(done.filter("status = 'complete'").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def with_identity(files: DataFrame) -> DataFrame:
    """Adds ``checksum`` and ``scene_id`` from the content, and marks all but the first path of equal content as ``duplicate``."""
    rows = files.withColumn("checksum", F.sha2("content", 256))
    first = rows.groupBy("checksum").agg(F.min("path").alias("_first"))
    return rows.join(first, "checksum").withColumns({"scene_id": scene_id(F.col("checksum")), "duplicate": F.col("path") != F.col("_first")}).drop("_first")


def sidecars(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(stem, side): the properties of JSON files beside scenes as a map; what can't be read is an empty map.

    ``name.json`` goes before ``name.tif.json``.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folders).select(F.col("_metadata.file_name").alias("name"), "value")
    properties = F.get_json_object("value", "$.properties")
    parsed = F.coalesce(F.from_json(F.coalesce(properties, F.col("value")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = F.regexp_replace("name", r"\.json$", "")
    plain = ~base.rlike(r"(?i)\.(tif|tiff|gtiff|cog)$")
    rows = files.select(F.regexp_replace(base, r"(?i)\.(tif|tiff|gtiff|cog)$", "").alias("stem"), plain.alias("plain"), parsed.alias("side"))
    return rows.groupBy("stem").agg(F.max_by("side", "plain").alias("side"))


def _first(names: tuple[str, ...], *maps: Column) -> Column:
    """The first value that is neither null nor empty: by source, then by name."""
    return F.coalesce(*[F.nullif(F.element_at(m, F.lit(n)), F.lit("")) for m in maps for n in names])


def _from_name(filename: Column) -> tuple[Column, Column]:
    platform, sensor = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name, own in reversed(NAME_PATTERNS):
        hit, part = filename.rlike(pattern), F.upper(F.regexp_extract(filename, pattern, 1))
        kind = F.lit(own) if own else F.when(part.isin("8", "9"), F.lit("OLI")).otherwise(F.lit("ETM+/TM"))
        platform, sensor = F.when(hit, F.concat(F.lit(name), part)).otherwise(platform), F.when(hit, kind).otherwise(sensor)
    return platform, sensor


def with_metadata(files: DataFrame, overrides: str = "overrides", side: str = "side", tags: str = "tags") -> DataFrame:
    """Adds time, platform, sensor, level and cloud share: overrides first, then the sidecar, tags, and the file name.

    The three are maps of strings; those that ``files`` lacks count as empty.
    """
    empty = F.create_map().cast("map<string,string>")
    o, s, t = (F.coalesce(F.col(c), empty) if c in files.columns else empty for c in (overrides, side, tags))
    by_name = _from_name(F.col("filename"))
    own = lambda key, *names: F.coalesce(F.nullif(F.element_at(o, F.lit(key)), F.lit("")), _first(names, s, t))
    raw = _first(TIME_TAGS, s, t)
    return files.withColumns({
        "acquisition_time": F.coalesce(parse_datetime(F.element_at(o, F.lit("acquisition_time"))), F.when(raw.isNotNull(), parse_datetime(raw)).otherwise(parse_datetime(F.regexp_replace("filename", r"\.[^.]*$", "")))),
        "platform": F.coalesce(own("platform", *PLATFORM_TAGS), by_name[0]),
        "sensor": F.coalesce(own("sensor", *SENSOR_TAGS), by_name[1]),
        "processing_level": F.coalesce(own("processing_level", *LEVEL_TAGS), F.nullif(F.regexp_extract("filename", r"(L1C|L2A|L1TP|L2SP|L1GT|L2)", 1), F.lit(""))),
        "cloud_percentage": _first(CLOUD_TAGS, s, t).try_cast("double"),
    })


def problems(scenes: DataFrame) -> Column:
    """Why a scene can't be taken, the first reason in order; null if it can."""
    checks = [
        (~F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(*EXTENSIONS), "unsupported extension"),
        (F.col("crs").isNull() if "crs" in scenes.columns else F.lit(False), "no coordinate reference system"),
        ((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("bands") <= 0) if {"width", "height", "bands"} <= set(scenes.columns) else F.lit(False), "empty raster"),
    ]
    out = F.lit(None).cast("string")
    for failed, reason in reversed(checks):
        out = F.when(failed, F.lit(reason)).otherwise(out)
    return out


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixels of Spark's ``image`` source (PNG, JPEG) with green standing in for the near infrared."""
    i = F.col("image")
    at = F.explode(F.sequence(F.lit(0), i["width"] * i["height"] - 1)).alias("at")
    rows = images.select(i["origin"].alias("tile_id"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("d"), at)
    value = lambda k: F.conv(F.hex(F.substring("d", F.col("at") * F.col("n") + F.least(F.lit(k), F.col("n") - 1) + 1, F.lit(1))), 16, 10).cast("double") / 255
    b, g, r = value(0), value(1), value(2)
    return rows.select("tile_id", F.floor(F.col("at") / F.col("w")).cast("int").alias("row"), (F.col("at") % F.col("w")).cast("int").alias("col"), b.alias("blue"), g.alias("green"), r.alias("red"), g.alias("nir"), (F.greatest(b, g, r) > 0).alias("valid"))


def benchmark_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``{"query", "relevant_tiles", "filters"}``."""
    return spark.read.schema("query STRING, relevant_tiles ARRAY<STRING>, filters MAP<STRING,STRING>").json(path)


def truth_features(spark: SparkSession, path: str) -> DataFrame:
    """(truth_id, change_type, date, box, rings) of a GeoJSON collection of polygons."""
    schema = "features ARRAY<STRUCT<geometry:STRUCT<type:STRING,coordinates:ARRAY<ARRAY<ARRAY<DOUBLE>>>>,properties:STRUCT<change_type:STRING,date:STRING>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("truth_id", "f"))
    points = F.flatten("f.geometry.coordinates")
    axis = lambda k: F.transform(points, lambda p: p[k])
    return rows.select(F.col("truth_id").cast("long").alias("truth_id"), F.col("f.properties.change_type").alias("change_type"), parse_datetime(F.col("f.properties.date")).alias("date"), F.array_min(axis(0)).alias("min_x"), F.array_min(axis(1)).alias("min_y"), F.array_max(axis(0)).alias("max_x"), F.array_max(axis(1)).alias("max_y"), F.col("f.geometry.coordinates").alias("rings"))


def inside(path: str, roots: list[str]) -> str:
    """``path`` if it lies under one of the allowed roots, with ``..`` resolved."""
    import posixpath

    clean = posixpath.normpath(path)
    if not any(clean == r.rstrip("/") or clean.startswith(r.rstrip("/") + "/") for r in map(posixpath.normpath, roots)):
        raise PermissionError(f"{path} is outside the allowed folders")
    return clean
