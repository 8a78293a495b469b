"""File listings, project indexes and run logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROJECT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("macro", "title", "author", "description", "tiles", "subtile_group")]
)
SHUTTLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "pdk", "status", "project_gds_url_template")]
    + [T.StructField("projects", T.ArrayType(PROJECT))]
)


def layout_catalog(paths: DataFrame) -> DataFrame:
    """path, format (oas, else gds), compression (br, gz or none), base, shuttle (folder before the name)."""
    bare = F.regexp_replace(F.col("path"), r"[?#].*$", "")
    low = F.lower(bare)
    packed = F.regexp_extract(low, r"\.(br|gz)$", 1)
    inner = F.regexp_replace(low, r"\.(br|gz)$", "")
    name = F.regexp_extract(bare, r"([^/]*)$", 1)
    return paths.select(
        "path",
        F.when(inner.endswith(".oas"), "oas").otherwise("gds").alias("format"),
        F.when(packed == "", "none").otherwise(packed).alias("compression"),
        F.regexp_replace(name, r"(?i)\.(gds|oas)(\.(br|gz))?$", "").alias("base"),
        F.regexp_extract(bare, r"([^/]+)/[^/]*$", 1).alias("shuttle"),
    )


def read_project_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Multi-line JSON with a list of shuttles -> (shuttles with pos, projects with shuttle_id)."""
    raw = spark.read.schema(SHUTTLE).option("multiLine", True).json(path)
    return flatten_project_index(raw.withColumn("pos", F.monotonically_increasing_id()))


def flatten_project_index(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of one shuttle each, with nested projects, to two flat tables."""
    shuttles = raw.select("pos", "id", "name", "pdk", "status", F.col("project_gds_url_template").alias("template"))
    projects = raw.select(F.col("id").alias("shuttle_id"), F.explode("projects").alias("p")).select("shuttle_id", "p.*")
    return shuttles, projects


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """file_id, flat_rects, wires, fets (the first line that states each; 0 if none), warnings, errors."""

    def stated(pattern: str) -> Column:
        found = F.regexp_extract("line", pattern + r": (\d+)", 1)
        return F.coalesce(F.min_by(found.try_cast("long"), F.when(found != "", F.col("line_no"))), F.lit(0).cast("long"))

    return lines.groupBy("file_id").agg(
        stated("Total flat rects").alias("flat_rects"),
        stated("Wires").alias("wires"),
        stated("FETs").alias("fets"),
        F.sum(F.regexp_count("line", F.lit("Warning:")).cast("long")).alias("warnings"),
        F.sum(F.regexp_count("line", F.lit("Error:")).cast("long")).alias("errors"),
    )


def search_projects(projects: DataFrame, text: str) -> DataFrame:
    """Projects that hold the text (trimmed, in any case) in any of five columns; an empty text finds all."""
    wanted = text.strip().lower()
    hit = F.lit(not wanted)
    for c in ("title", "author", "description", "macro", "tiles"):
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    return projects.where(hit)


def highlight(text: Column, wanted: str) -> Column:
    """Each match in any case between mark tags; an empty wish changes nothing."""
    if not wanted:
        return text
    return F.regexp_replace(text, "(?iu)(" + re.sub(r"([^\w\s])", r"\\\1", wanted) + ")", "<mark>$1</mark>")


def layout_urls(projects: DataFrame, shuttles: DataFrame, default: str, api: str) -> DataFrame:
    """shuttle_id, macro, url, packed_url, metadata_url. The group's macro stands for its members in the layout's
    url; ``default`` (with {shuttle} and {macro}) is used where the shuttle has no template."""
    own = F.coalesce("subtile_group", "macro")
    of = shuttles.select(F.col("id").alias("shuttle_id"), "template")
    template = F.coalesce("template", F.replace(F.lit(default), F.lit("{shuttle}"), F.col("shuttle_id")))
    url = F.replace(template, F.lit("{macro}"), own)
    return projects.join(F.broadcast(of), "shuttle_id").select(
        "shuttle_id",
        "macro",
        url.alias("url"),
        F.concat(url, F.lit(".br")).alias("packed_url"),
        F.concat(F.lit(api + "/"), "shuttle_id", F.lit("/"), "macro", F.lit(".json")).alias("metadata_url"),
    )


def pin_descriptions(labels: DataFrame, pinout: Column) -> DataFrame:
    """net, name, description: for base[bit] the key without _in or _out, else the name; looked up as it is, then
    in lower case; empty if there is none."""
    indexed = F.col("name").rlike(r"\[\d+\]$")
    key = F.when(indexed, F.regexp_replace("name", r"_(in|out)(\[\d+\])$", "$2")).otherwise(F.col("name"))
    found = F.coalesce(F.try_element_at(pinout, key), F.try_element_at(pinout, F.lower(key)), F.lit(""))
    return labels.select("net", "name", found.alias("description"))


def flag_video(projects: DataFrame) -> DataFrame:
    """shuttle_id, macro, video: some pin's text holds hsync, vsync or vga in any case."""
    pins = F.from_json("pinout", "map<string,string>")
    video = F.exists(F.map_values(pins), lambda v: F.lower(v).rlike("hsync|vsync|vga"))
    return projects.select("shuttle_id", "macro", F.coalesce(video, F.lit(False)).alias("video"))
