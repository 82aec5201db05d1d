"""Text formats of graphs: Pajek, edge lists, region names and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_pajek(edges: DataFrame, nodes: DataFrame, path: str, directed: bool = True) -> None:
    """A folder of text parts, read in name order: vertices, then arcs (or edges, once each); ids from 1, diagonal left out."""
    spark = edges.sparkSession
    n = nodes.agg(F.max("node") + 1).first()[0] or 0
    e = edges.where("src <> dst" if directed else "src < dst")
    lines = e.select(F.format_string("%d %d %.6f", F.col("src") + 1, F.col("dst") + 1, F.col("w").cast("double")).alias("value"))
    head = spark.range(1).select(F.lit(f"*Vertices {n}\n*{'Arcs' if directed else 'Edges'}").alias("value"))
    head.coalesce(1).write.text(f"{path}/0-head")
    lines.write.text(f"{path}/1-edges")


def read_pajek(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, w of a Pajek folder or file; lines of other sections are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    part = F.split(F.trim("value"), r"\s+")
    ok = lines.where(F.col("value").rlike(r"^\s*\d+\s+\d+\s+[-+0-9.eE]+\s*$"))
    return ok.select((part[0].cast("bigint") - 1).alias("src"), (part[1].cast("bigint") - 1).alias("dst"), part[2].cast("double").alias("w"))


def write_edge_list(edges: DataFrame, labels: DataFrame, path: str) -> None:
    """Lines ``source target`` of labels (node, label); blanks in labels become underscores."""
    name = lambda c: labels.select(F.col("node").alias(c), F.regexp_replace("label", " ", "_").alias(f"{c}_l"))
    edges.join(name("src"), "src").join(name("dst"), "dst").select(F.concat_ws(" ", "src_l", "dst_l").alias("value")).write.text(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """source, target (strings) of lines with two words or more."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(part) >= 2).select(part[0].alias("source"), part[1].alias("target"))


def read_names(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """node (line number from 0) and label of a file with one name on each line."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("node", "label")).where("label <> ''")
    return lines.select(F.col("node").cast("bigint").alias("node"), (F.substring("label", 1, longest) if longest else F.col("label")).alias("label"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """label (name and side), x, y of lines ``name side x y``; lines with # are comments."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(part) == 4))
    return rows.select(F.concat_ws(" ", part[0], part[1]).alias("label"), part[2].cast("double").alias("x"), part[3].cast("double").alias("y"))
