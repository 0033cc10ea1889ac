"""Stored tables of the linkage pipeline: matcher fields, records with row ids, band postings, country codes, manifests
and models. Tables are parquet folders; a manifest beside them says what they were made of and that they are whole."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHER = ("addr_norm", "addr_nums", "addr_postcode", "addr_region", "addr_street", "name_phon", "name_legal")
RECORD = ("entity_id", "country", "name_script", "name_sorted", "name_nospace", "name_cons", "addr_house", "addr_locality", *MATCHER)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value) -> None:
    """All or nothing: written beside the target and renamed."""
    p, fs = _fs(spark, path)
    part, _ = _fs(spark, path + ".partial")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value, indent=1, ensure_ascii=False).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def fingerprint(spark: SparkSession, paths) -> list[dict]:
    """Name, size and time of change of files."""
    out = []
    for path in paths:
        p, fs = _fs(spark, path)
        s = fs.getFileStatus(p)
        out.append({"name": p.getName(), "bytes": s.getLen(), "modified": s.getModificationTime()})
    return out


def identity(value) -> str:
    """SHA-256 of a model or of other plain values, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def dense_ids(df: DataFrame, *order: str, name: str = "rid") -> DataFrame:
    """Row numbers from 1 in an order, without one task for all rows: a range sort, then each partition's offset (one
    number a partition comes to the driver)."""
    from reclink.sources.scratch import stored

    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "dense-ids")
    counts = {r["_part"]: (r["c"], r["a"]) for r in placed.groupBy("_part").agg(F.count("*").alias("c"), F.min("_at").alias("a")).collect()}
    before, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = before + 1 - counts[part][1]
        before += counts[part][0]
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return placed.withColumn(name, F.col("_at") + shift[F.col("_part")]).drop("_part", "_at")


def build_records(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """The matcher's fields of all candidates with row ids: source 2 before source 3, each by entity_id."""
    def of(df, source):
        key = F.lower(F.trim("country_norm")).alias("country")
        return df.select(F.lit(source).alias("source"), key, *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in RECORD if c != "country"])

    return dense_ids(of(s2, 2).unionByName(of(s3, 3)), "source", "entity_id")


def build_fields(records: DataFrame, candidates: DataFrame, ids: str = "candidate_entity_ids") -> DataFrame:
    """Comparison fields of the listed candidates only. Fails where one is not among the records."""
    wanted = candidates.select(F.explode(ids).alias("entity_id")).distinct()
    missing = wanted.join(records.select("entity_id"), "entity_id", "left_anti").head(1)
    if missing:
        raise ValueError(f"a candidate is not among the records: {missing[0][0]}")
    return records.join(wanted, "entity_id", "left_semi").select("entity_id", *MATCHER)


def fetch(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ids (column entity_id). Fails where one is missing."""
    missing = ids.join(records.select("entity_id"), "entity_id", "left_anti").head(1)
    if missing:
        raise ValueError(f"a candidate is missing from the records: {missing[0][0]}")
    return records.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def postings(bands: DataFrame, limit: int) -> DataFrame:
    """(key, size, rids): the buckets of band keys (key, rid). ``rids`` are sorted and held for buckets of at most
    ``limit``, so no list is longer than that; larger ones keep their size and an empty list."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"))
    small = bands.join(sizes.where(F.col("size") <= limit), "key").groupBy("key").agg(F.max("size").alias("size"), F.array_sort(F.collect_list("rid")).alias("rids"))
    return small.unionByName(sizes.where(F.col("size") > limit).withColumn("rids", F.array().cast(small.schema["rids"].dataType)))


def lookup(store: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """(key, rids) for each asked key: empty where the bucket is larger than ``limit`` or absent."""
    found = keys.join(store, "key", "left")
    return found.select("key", F.when(F.col("size") <= limit, F.col("rids")).otherwise(F.array()).alias("rids"))


def country_codes(records: DataFrame) -> DataFrame:
    """(country, code): codes from 1 in the order in which countries first appear by row id; few rows."""
    from pyspark.sql import Window

    first = records.groupBy("country").agg(F.min("rid").alias("first"))
    return first.select("country", F.row_number().over(Window.orderBy("first")).alias("code"))


def write_store(df: DataFrame, path: str, inputs: list[dict], split: str, **more) -> dict:
    """A table with its manifest, which is written last: without one the table is not whole."""
    spark = df.sparkSession
    p, fs = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(f"{path} exists; use a fresh path")
    df.write.parquet(path)
    manifest = {"version": 1, "status": "ready", "split": split, "inputs": inputs, "rows": spark.read.parquet(path).count(), **more}
    write_json(spark, path.rstrip("/") + ".manifest.json", manifest)
    return manifest


def check_store(spark: SparkSession, path: str, inputs: list[dict], split: str) -> dict:
    """The manifest of a store that is whole, of this split and made of these files; fails otherwise."""
    p, fs = _fs(spark, path.rstrip("/") + ".manifest.json")
    if not fs.exists(p):
        raise ValueError("the store is not whole; build it anew")
    manifest = read_json(spark, path.rstrip("/") + ".manifest.json")
    if manifest["status"] != "ready" or manifest["version"] != 1 or manifest["split"] != split:
        raise ValueError("the store belongs to another split or version")
    if manifest["inputs"] != inputs:
        raise ValueError("files have changed since the store was built")
    return manifest


def check_pair(one: dict, other: dict) -> None:
    """Two stores (records and their bands) must be of the same files and rows."""
    if any(one[k] != other[k] for k in ("split", "inputs")) or one["rows"] != other.get("base_rows", other["rows"]):
        raise ValueError("the stores do not belong together")


def check_parts(df_of: dict[str, DataFrame], expected: dict[str, int], columns: tuple) -> list[str]:
    """What is wrong with normalised sources: other columns or other numbers of rows than expected."""
    out = []
    for name, n in expected.items():
        df = df_of[name]
        if tuple(df.columns) != tuple(columns):
            out.append(f"{name}: other columns")
        elif (found := df.count()) != n:
            out.append(f"{name}: {found} rows, {n} expected")
    return out


def save_model(spark: SparkSession, path: str, model: dict) -> str:
    """A model as JSON with the number of its features; returns its identity."""
    if "weights" in model and not (len(model["weights"]) - 1 == len(model["mean"]) == len(model["scale"]) == model.get("feature_count", len(model["mean"]))):
        raise ValueError("weights, means and scales do not fit together")
    write_json(spark, path, model)
    return identity(model)


def load_model(spark: SparkSession, path: str, features: int) -> dict:
    model = read_json(spark, path)
    if model.get("feature_count", len(model.get("mean", ()))) != features:
        raise ValueError("the model is incompatible with these features")
    if any(not math.isfinite(x) for k in ("weights", "mean", "scale") for x in model.get(k, ())):
        raise ValueError("the model holds numbers that are not finite")
    return model
