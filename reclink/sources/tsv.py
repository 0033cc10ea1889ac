"""Unquoted, tab-separated sources and sinks of the linkage pipeline. Empty fields stay empty strings.

Files are split by Spark at line ends (a line belongs to the split in which it begins), so no split is planned here.
Lines are cut into cells here and not by the CSV reader, whose quoting and short-row rules differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("entity_id", "business_name", "address", "country")
LISTS = ("source1_entity_id", "matched_entity_ids")
#: What a table of normalised records has to have.
REQUIRED = ("entity_id", "country_norm", "name_core", "name_sorted", "name_nospace", "name_cons", "name_script", "addr_norm", "addr_core", "addr_house", "addr_locality")
BOM = "﻿"


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else [str(p) for p in path]


def headers(spark: SparkSession, path) -> list[str]:
    """The first line of each path, without a byte order mark."""
    first = [spark.read.text(p).head(1) for p in _paths(path)]
    return [rows[0][0].removeprefix(BOM) for rows in first if rows]


def _lines(spark: SparkSession, path, skip: list[str]) -> DataFrame:
    lines = spark.read.text(_paths(path))
    for h in set(skip):
        lines = lines.where((F.col("value") != F.lit(h)) & (F.col("value") != F.lit(BOM + h)))
    return lines


def _read(spark: SparkSession, path, names) -> DataFrame:
    """Cells by position; ``_short``: the line, where it has too few. The first line of a file is its header,
    whatever it says."""
    lines = _lines(spark, path, headers(spark, path))
    cells = F.split("value", "\t", -1)
    good = F.size(cells) >= len(names)
    return lines.select(*[F.when(good, F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)], F.when(~good, F.col("value")).alias("_short"))


def read_table(spark: SparkSession, path, names=RAW) -> DataFrame:
    """Raw rows by position. Quotes are data, further fields are left out; rows with too few are (``malformed``)."""
    return _read(spark, path, names).where(F.col("_short").isNull()).select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])


def malformed(spark: SparkSession, path, names=RAW) -> DataFrame:
    return _read(spark, path, names).where(F.col("_short").isNotNull()).select(F.col("_short").alias("line"))


def read_lists(spark: SparkSession, path, key: str = LISTS[0], ids: str = LISTS[1], check: bool = False) -> DataFrame:
    """(key, ids array) of comma-joined lists, empty ones as empty arrays. ``check``: fail, as for a ground truth, on
    another header, a row of other than two fields, a key without S1-, or a list with a repeated id or one of
    another source."""
    if check and any(h.split("\t") != [key, ids] for h in headers(spark, path)):
        raise ValueError("unexpected header of a ground truth")
    cells = F.split("value", "\t", -1)
    lines = _lines(spark, path, headers(spark, path))
    rows = lines.select(F.get(cells, F.lit(0)).alias(key), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("x"), (F.size(cells) == 2).alias("two"))
    out = rows.select(key, F.when(F.col("x") == "", F.array().cast("array<string>")).otherwise(F.split("x", ",")).alias(ids), "two")
    if check:
        bad = ~F.col("two") | ~F.col(key).startswith("S1-") | (F.size(F.array_distinct(ids)) < F.size(ids)) | F.exists(ids, lambda i: ~i.rlike("^S[23]-"))
        wrong = out.where(bad).select(key).head(1)
        if wrong:
            raise ValueError(f"malformed row of a ground truth: {wrong[0][0]}")
    return out.where("two").drop("two")


def first_clusters(lists: DataFrame, n: int, singletons: bool = False, key: str = LISTS[0], ids: str = LISTS[1]) -> DataFrame:
    """The first n clusters by key, by default without those that match nothing."""
    return (lists if singletons else lists.where(F.size(ids) > 0)).orderBy(key).limit(n)


def write_lists(df: DataFrame, path: str, key: str, ids: str) -> None:
    """One line a key, also for empty lists; the folder is replaced as a whole when all tasks have ended."""
    df.select(F.concat_ws("\t", F.col(key), F.array_join(ids, ",")).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Gzip parts, each with its header. Replacing the folder retires parts of an earlier, longer run."""
    safe = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "[\t\r\n]", " ").alias(c) for c in df.columns]
    df.select(*safe).write.mode("overwrite").option("compression", "gzip").option("header", True).option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def source_parts(spark: SparkSession, folder: str, split: str, source: int) -> list[str]:
    """The parts ``<split>_source<n>.part-<k>.tsv.gz`` of a folder in order, whose numbers must run from 0 without a
    gap; or the one plain file."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path))
    parts = {int(m[1]): n for n in names if (m := re.fullmatch(rf"{split}_source{source}\.part-(\d+)\.tsv\.gz", n))}
    if parts:
        if sorted(parts) != list(range(len(parts))):
            raise ValueError(f"parts are missing: {sorted(parts)}")
        return [f"{folder.rstrip('/')}/{parts[k]}" for k in sorted(parts)]
    if f"{split}_source{source}.tsv" in names:
        return [f"{folder.rstrip('/')}/{split}_source{source}.tsv"]
    raise FileNotFoundError(f"no normalised {split}_source{source} in {folder}")


def read_records(spark: SparkSession, path, source: int | None = None) -> DataFrame:
    """Normalised records by the header that the first part, or every part, begins with. Fails on a header without
    the required columns, with a repeated one or unlike the first, on a row of another length and on an id of
    another source."""
    found = headers(spark, path)
    names = found[0].split("\t") if found else []
    if names[:1] != ["entity_id"] or len(set(names)) < len(names) or not set(REQUIRED) <= set(names):
        raise ValueError(f"invalid header of normalised records: {sorted(set(REQUIRED) - set(names))} missing")
    if any(h.startswith("entity_id\t") and h != found[0] for h in found):
        raise ValueError("the header changes between parts")
    cells = F.split("value", "\t", -1)
    rows = _lines(spark, path, [found[0]])
    bad = F.size(cells) != len(names)
    if source:
        bad |= ~F.col("value").startswith(f"S{source}-")
    wrong = rows.where(bad).head(1)
    if wrong:
        raise ValueError(f"malformed row or other source: {wrong[0][0][:80]}")
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_regions(spark: SparkSession, path: str) -> dict[str, str]:
    """Mined divisions, one a line: a name, or a name and its code. The file is a small vocabulary."""
    rows = [r[0].rstrip("\r").partition("\t") for r in spark.read.text(path).toLocalIterator() if r[0].strip()]
    return {name.strip().lower(): (code.strip() or name.strip()).lower() for name, _, code in rows}


def write_regions(df: DataFrame, path: str, name: str = "name", code: str = "code") -> None:
    df.select(F.concat_ws("\t", name, code).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def evidence_to_json(df: DataFrame, routes: str = "routes") -> DataFrame:
    return df.withColumn("routes_json", F.to_json(routes)).drop(routes)


def evidence_from_json(df: DataFrame) -> DataFrame:
    return df.withColumn("routes", F.from_json("routes_json", "map<string, struct<rank: int, score: double>>")).drop("routes_json")
