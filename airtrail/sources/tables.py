"""Small user-supplied files: profiles, lookups, access points, clicks and device events."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.url import Suffixes


def read_profiles(spark: SparkSession, path) -> DataFrame:
    """Account profiles: account, id, sex, birth, year of entry."""
    return spark.read.schema(schemas.PROFILE).csv(path)


def load_ap_table(spark: SparkSession, path) -> DataFrame:
    """Access point prefixes; rows whose code or name is ``null`` are dropped."""
    rows = spark.read.schema(schemas.AP_TABLE).csv(path, nullValue="null")
    return rows.where(F.col("code").isNotNull() & F.col("name").isNotNull())


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Suffix rules of any number as a table: suffix (lower case, without ``*.`` and ``!``) and kind (``plain``, ``wildcard``, ``exception``)."""
    rule = F.lower(F.element_at(F.split(F.trim("value"), r"\s+"), 1))
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("//")).select(rule.alias("rule"))
    kind = F.when(F.col("rule").startswith("*."), "wildcard").when(F.col("rule").startswith("!"), "exception").otherwise("plain")
    return lines.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"), kind.alias("kind")).distinct()


def read_lookup(spark: SparkSession, kind: str, path: str):
    """Lookup files of a few thousand lines, from any file system that Spark reads. Line files may have several parts, which are read in
    the order of their names; of YAML files the path must match one.

    ``buildings`` (YAML), ``protocols`` (tab separated) and ``countries`` (YAML) give a DataFrame; ``services``
    (YAML) gives the ordered host rules as a list plus two DataFrames of classes and class names; ``suffixes`` (one rule a
    line, ``*.`` and ``!`` in front of wildcards and exceptions, ``//`` comments) gives ``Suffixes``.
    """
    parts = [r[0] for r in spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).orderBy("file").collect()]
    if kind not in ("suffixes", "protocols") and len(parts) != 1:
        raise ValueError(f"{path} matches {len(parts)} files, a {kind} lookup is one")
    text = "".join(part if part.endswith("\n") else part + "\n" for part in parts)
    if kind == "suffixes":
        rules = [line.split()[0].lower() for line in text.splitlines() if line.strip() and not line.startswith("//")]
        return Suffixes(tuple(r for r in rules if r[0] not in "*!"), tuple(r[2:] for r in rules if r.startswith("*.")), tuple(r[1:] for r in rules if r[0] == "!"))
    if kind == "protocols":
        rows = [r for r in csv.reader(text.splitlines(), delimiter="\t", quoting=csv.QUOTE_NONE) if r][1:]
        return spark.createDataFrame([(int(r[0]), r[1], r[2]) for r in rows], "id INT, name STRING, category STRING")
    import yaml

    if text.startswith("%"):
        text = text.split("---", 1)[1]
    data = yaml.safe_load(text)
    if kind == "buildings":
        table = next(iter(data.values()))
        rows = [
            (str(c), v.get("dsp") or v.get("name"), v.get("typ") or v.get("type"), v.get("usr") or v.get("user"),
             _number(v.get("lon")), _number(v.get("lat")))
            for c, v in table.items()
        ]
        return spark.createDataFrame(rows, schemas.AP_TABLE)
    if kind == "countries":
        table = next(iter(data.values()))
        return spark.createDataFrame([(str(k), str(v)) for k, v in table.items()], "suffix STRING, country STRING")
    if kind == "services":
        rules = [(i + 1, r["regex"], str(r["category"])) for i, r in enumerate(data["host_parser"])]
        classes = [(str(k), v["cls1"], v["cls2"]) for k, v in data["category_classes"].items()]
        names = [(k, str(v)) for k, v in data["cls1_map"].items()]
        return (
            rules,
            spark.createDataFrame(classes, "category STRING, cls1 INT, cls2 INT"),
            spark.createDataFrame(names, "cls1 INT, name STRING"),
        )
    raise ValueError(f"unknown lookup {kind!r}")


def _number(value) -> float | None:
    return None if value in (None, "null") else float(value)


def parse_touch_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Touches: time text and screen position; blank, ``#`` and short lines are dropped."""
    text = F.btrim(F.col(line), F.lit("\t\r\n "))
    parts = F.split(text, " ")
    spot = F.split(parts[2], ":")
    return lines.where((text != "") & ~text.startswith("#") & (F.size(parts) >= 3)).select(
        parts[1].alias("time"), F.try_element_at(spot, F.lit(1)).alias("x"), F.try_element_at(spot, F.lit(2)).alias("y")
    )


def parse_device_events(lines: DataFrame, line: str = "value", device: str = "screen") -> DataFrame:
    """Times and actions of one device."""
    text = F.btrim(F.col(line), F.lit("\t\r\n "))
    parts = F.split(text, " ")
    return lines.where((text != "") & ~text.startswith("#") & (F.size(parts) >= 3)).where(parts[1] == device).select(
        parts[0].try_cast("double").alias("t"), parts[2].alias("action")
    )


def read_touch_log(spark: SparkSession, path) -> DataFrame:
    """Touch log files."""
    return parse_touch_log(spark.read.text(path))


def read_device_events(spark: SparkSession, path) -> DataFrame:
    """Device event files."""
    return parse_device_events(spark.read.text(path))
