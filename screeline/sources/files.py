"""Readers of the formats that tracks, manifests, pages and logs come in, and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One recorded sequence; unknown elements are ignored, a point without elevation keeps null.
_POINT = "array<struct<_lat:double,_lon:double,ele:double>>"


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, all columns strings; blanks stay blanks, no type is guessed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents, one a file; what a schema can't hold goes to a column of corrupt records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_log(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A log of one JSON object a line."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content, sha256) of whole files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return f.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def track_points(files: DataFrame, key: Column) -> DataFrame:
    """(track_id, seq_no, pt_no, lat, lon, ele) from GPX files as ``read_files`` gives them.

    Each trkseg and rte of at least two points is a sequence, in the file's order within its
    kind; waypoints and namespaces are ignored.  The parser resolves no external entities;
    a file with a document type declaration, and one that can't be parsed, gives no points.
    """
    text = F.decode("content", "UTF-8")
    safe = F.when(~F.upper(F.substring(text, 1, 4096)).contains("<!DOCTYPE"), text)
    schema = f"trk array<struct<trkseg:array<struct<trkpt:{_POINT}>>>>, rte array<struct<rtept:{_POINT}>>"
    parsed = files.select(key.alias("track_id"), F.from_xml(safe, schema, {"rowTag": "gpx", "ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("g"))
    none = F.array().cast(f"array<{_POINT}>")
    segments = F.coalesce(F.flatten(F.transform("g.trk", lambda t: F.transform(F.coalesce(t["trkseg"], F.array().cast(f"array<struct<trkpt:{_POINT}>>")), lambda s: s["trkpt"]))), none)
    routes = F.coalesce(F.transform("g.rte", lambda r: r["rtept"]), none)
    sequences = F.filter(F.concat(segments, routes), lambda s: F.size(s) >= 2)
    rows = parsed.select("track_id", F.posexplode(sequences).alias("s", "points")).select("track_id", "s", F.posexplode("points").alias("p", "v"))
    return rows.select("track_id", (F.col("s") + 1).alias("seq_no"), (F.col("p") + 1).alias("pt_no"), F.col("v._lat").alias("lat"), F.col("v._lon").alias("lon"), F.col("v.ele").alias("ele"))


def cached_bodies(requests: DataFrame, url: str, cache: DataFrame) -> DataFrame:
    """The requests with the cached body of their address: a hit only if the cache entry
    (key, url, sha256, body) names the same address and its body has the stated hash."""
    c = cache.select(F.col("key").alias("_key"), F.col("url").alias("_url"), F.col("sha256").alias("_sha"), F.col("body").alias("_body"))
    j = requests.join(c, F.sha2(F.col(url).cast("binary"), 256) == F.col("_key"), "left")
    hit = F.coalesce((F.col("_url") == F.col(url)) & (F.sha2(F.col("_body").cast("binary"), 256) == F.col("_sha")), F.lit(False))
    return j.select(*requests.columns, F.when(hit, F.col("_body")).alias("body"), hit.alias("hit"))


def retry_wait(attempt: Column, retry_after: Column, base: float = 5.0, attempts: int = 5, longest: float = 300.0) -> Column:
    """Seconds to wait before the next attempt, null to give up: doubling from ``base``, or
    what the server asks for, never more than ``longest``."""
    wait = F.coalesce(retry_after.cast("double"), F.pow(F.lit(2.0), attempt) * base)
    return F.when((attempt < attempts) & (wait <= longest), wait)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """The table with arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_subsets(df: DataFrame, folder: str, subsets: dict[str, Column]) -> None:
    """One CSV folder for each named condition, written from one cached pass over the table."""
    flat = flat_for_csv(df.withColumns({f"_in_{n}": F.coalesce(c, F.lit(False)) for n, c in subsets.items()})).persist()
    marks = [f"_in_{n}" for n in subsets]
    for name in subsets:
        flat.filter(f"_in_{name}").drop(*marks).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    flat.unpersist()


def export_public(df: DataFrame, allowed: list[str], required: list[str], path: str) -> None:
    """Writes only the allowed columns, as JSON lines and CSV, and nothing at all if a required
    one is null anywhere or missing."""
    missing = [c for c in required if c not in df.columns]
    if missing or df.filter(" or ".join(f"`{c}` is null" for c in required)).limit(1).count():
        raise ValueError(f"required columns are missing or null: {missing or required}")
    public = df.select(*[F.col(f"`{c}`") for c in allowed])
    public.write.mode("overwrite").json(f"{path}/json")
    flat_for_csv(public).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def union_of(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ, in the order in which columns first occur."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
