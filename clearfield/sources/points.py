"""Point sources: strict XYZ text, and views of the driver's tables as frames of points.

A point table has frame_id long, point_id long, x, y, z double, all finite. Lengths are metres.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boundary import numbered_within
from .staging import written


def require(condition: Column, message: str | Column, value: Column) -> Column:
    """value where the condition holds; an error that stops the query elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("double"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their numbers from 0: frame_id (hash of the file's path), line, raw.

    Files are read in splits; lines are numbered within a split and splits by the counts of those before, so
    that no file is one row or one task.
    """
    split = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("frame_id"), split.alias("split"), F.monotonically_increasing_id().alias("seen"), F.col("value").alias("raw")
    )
    return numbered_within(lines, ["frame_id"], ["split"], ["seen"], "line", "long").select("frame_id", "line", "raw")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Frames from XYZ text files: three white-space columns a line, # comments, blank lines.

    Every other line must be exactly three finite numbers, else the query fails and names the line.
    frame_id is a hash of the file's path; point_id is the number of the line within a file.
    """
    return parse_xyz(text_lines(spark, path).withColumnRenamed("line", "point_id"))


def read_cloud(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Frames from files of a kind: xyz, ply (ASCII; x, y, z of the vertex element) or off (its vertices).

    point_id numbers a file's points from 0 (lines for xyz). A header that is malformed or promises more
    points than there are, and a point that is not finite, are errors. Headers are one row a file; PLY headers
    end within HEADER_LINES lines.
    """
    if kind == "xyz":
        return read_xyz(spark, path)
    if kind not in ("ply", "off"):
        raise ValueError("a cloud is xyz, ply or off")
    lines = text_lines(spark, path)
    if kind == "off":  # comments and blank lines are nowhere counted
        bare = lines.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("raw != ''")
        lines = numbered_within(bare.withColumnRenamed("line", "at"), ["frame_id"], [F.floor(F.col("at") / 100_000)], ["at"], "line", "long").drop("at")
    lines = written(lines)
    sizes = lines.groupBy("frame_id").agg((F.max("line") + 1).alias("lines"))
    heads = lines.where(F.col("line") < HEADER_LINES).join(sizes, "frame_id").groupBy("frame_id").applyInPandas(
        _ply_header if kind == "ply" else _off_header, "frame_id long, first long, points long, px int, py int, pz int, width int"
    )
    rows = lines.join(written(heads), "frame_id").where("line >= first and line < first + points").withColumn("p", F.split(F.trim("raw"), r"\s+"))
    error = F.concat(F.lit("bad point on line "), (F.col("line") + 1).cast("string"), F.lit(": "), F.col("raw"))

    def coordinate(c: str) -> Column:
        v = F.get("p", F.col(f"p{c}")).try_cast("double")
        return require((F.size("p") == F.col("width")) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), error, v)

    return rows.select("frame_id", (F.col("line") - F.col("first")).alias("point_id"), *[coordinate(c).alias(c) for c in "xyz"])


#: Lines within which a PLY header must end.
HEADER_LINES = 256


def _header(frame: pd.DataFrame, first: int, points: int, names: list[str]) -> pd.DataFrame:
    if points < 1 or first + points > frame["lines"].iloc[0] or any(c not in names for c in "xyz"):
        raise ValueError("points are missing")
    at = [names.index(c) for c in "xyz"]
    return pd.DataFrame([(frame["frame_id"].iloc[0], first, points, *at, len(names))], columns=["frame_id", "first", "points", "px", "py", "pz", "width"])


def _ply_header(frame: pd.DataFrame) -> pd.DataFrame:
    lines = [x.split() for x in frame.sort_values("line")["raw"]]
    if lines[:1] != [["ply"]] or ["format", "ascii", "1.0"] not in lines[:5] or ["end_header"] not in lines:
        raise ValueError("not an ASCII PLY file")
    end = lines.index(["end_header"])
    elements: list[tuple[str, int, list[str]]] = []
    for words in lines[1:end]:
        if words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"] and elements:
            elements[-1][2].append(words[-1])
    names = [e[0] for e in elements]
    if "vertex" not in names:
        raise ValueError("there are no vertices")
    at = names.index("vertex")
    return _header(frame, end + 1 + sum(e[1] for e in elements[:at]), elements[at][1], elements[at][2])


def _off_header(frame: pd.DataFrame) -> pd.DataFrame:
    lines = [x.split() for x in frame.sort_values("line")["raw"]]
    if not lines or lines[0][:1] != ["OFF"]:
        raise ValueError("not an OFF file")
    counts, first = (lines[0][1:], 1) if len(lines[0]) > 1 else (lines[1] if len(lines) > 1 else [], 2)
    if len(counts) < 2:
        raise ValueError("an OFF file needs its counts")
    return _header(frame, first, int(counts[0]), ["x", "y", "z"])


def parse_xyz(lines: DataFrame) -> DataFrame:
    """Points from rows (frame_id, point_id, raw) of XYZ lines, under the rules of read_xyz."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", "#.*$", ""), r"\s+", " "))
    rows = lines.withColumn("bare", bare).where("bare != ''").withColumn("p", F.split("bare", " "))
    error = F.concat(F.lit("bad XYZ line "), (F.col("point_id") + 1).cast("string"), F.lit(": "), F.col("raw"))

    def coordinate(k: int) -> Column:
        v = F.get("p", F.lit(k)).try_cast("double")
        good = (F.size("p") == 3) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        # A comment is no error, whatever order Catalyst gives this and the filter above.
        return F.when(F.col("bare") != "", require(good, error, v))

    return rows.select("frame_id", "point_id", coordinate(0).alias("x"), coordinate(1).alias("y"), coordinate(2).alias("z"))


def parse_ply(spark: SparkSession, text: str, frame_id: int = 0) -> DataFrame:
    """Points of an ASCII PLY text: the vertex element's x, y, z; other properties and elements are skipped."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "ply" or "format ascii 1.0" not in (x.strip() for x in lines[:5]):
        raise ValueError("not an ASCII PLY text")
    end = next((i for i, x in enumerate(lines) if x.strip() == "end_header"), None)
    if end is None:
        raise ValueError("the header does not end")
    at, skipped, count, names, element = end + 1, 0, 0, [], ""
    for words in (x.split() for x in lines[1:end]):
        if words[:1] == ["element"]:
            element = words[1]
            if element == "vertex":
                count = int(words[2])
            elif not count:
                skipped += int(words[2])
        elif words[:1] == ["property"] and element == "vertex":
            names.append(words[-1])
    if any(c not in names for c in "xyz"):
        raise ValueError("vertices need x, y and z")
    rows = []
    for i, x in enumerate(lines[at + skipped : at + skipped + count]):
        values = x.split()
        point = [float(values[names.index(c)]) for c in "xyz"]
        if len(values) != len(names) or not all(map(math.isfinite, point)):
            raise ValueError(f"bad vertex {i}")
        rows.append((frame_id, i, *point))
    if len(rows) != count or not rows:
        raise ValueError("vertices are missing")
    return spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")


def points_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as 21 points, in the frame of its label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = v.select(F.col("label").cast("long").alias("frame_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    return k.select(
        "frame_id",
        (F.col("vec_id") * 21 + F.col("k")).alias("point_id"),
        *[F.get("embedding", 3 * F.col("k") + i).cast("double").alias(c) for i, c in enumerate("xyz")],
    )


def points_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a point, in the frame of its shipping year."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        F.year("l_shipdate").cast("long").alias("frame_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"),
        (F.col("l_quantity") / 50).alias("x"),
        (F.col("l_discount") * 10).alias("y"),
        (F.col("l_extendedprice") / 1e5).alias("z"),
    )


def points_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points ordered in time, one frame an hour."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("frame_id"),
        F.col("event_id").alias("point_id"),
        (F.pmod("user_id", F.lit(97)) / 97.0).alias("x"),
        (F.col("value") / 100.0).alias("y"),
        (F.pmod("event_id", F.lit(89)) / 89.0).alias("z"),
    )
