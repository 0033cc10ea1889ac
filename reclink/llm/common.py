"""Shared pieces: scratch tables, Arrow batching, byte-level word hashing.

Every Python-side operator here works on slices of Arrow batches of at most
``SLICE_BYTES`` of text (one longer document forms a slice of its own), so its
memory depends on the longest document and not on the table.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 3 << 20
U64 = np.uint64


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a session on this machine alone may do without that
    setting (as in tests); elsewhere executors would each write to a disk of their own, so that is an error.
    Folders stay until ``clear_scratch``: the frames that were returned still read them."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reclink-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def clear_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Delete the scratch folders of this process but for the last ``keep``; call it when results are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN[: len(_WRITTEN) - keep]
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _WRITTEN[: len(gone)]
    return len(gone)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and the driver lets go of the step behind it: plans, broadcasts and shuffle files of frames that no
    one holds would stay until it happens to collect its garbage, and its heap grows up to its limit before."""
    out = stored(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


HEAVY = 2000


def hot_keys(counts: DataFrame, total: int, count: str = "c") -> DataFrame:
    """The keys that hold over one part in ``HEAVY`` of ``total`` rows, with the number of salts they are dealt
    out to (column salts). They number 2 * HEAVY at most, whatever the input, so they can be broadcast."""
    return counts.where(F.col(count) > _bound(total)).select(*[c for c in counts.columns if c != count], _salts(count, total).alias("salts"))


def _bound(total: int) -> int:
    return max(1, total // HEAVY)


def _salts(count: str, total: int):
    return F.when(F.col(count) > _bound(total), F.ceil(F.col(count) / _bound(total))).otherwise(1).cast("int")


def dealt(rows: DataFrame, hot: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The side with many rows a key: each row of a hot key draws one of the key's salts by a hash of ``by``."""
    return rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def copied(keyed: DataFrame, total: int, count: str = "c") -> DataFrame:
    """The side with one row a key: the row of a hot key is repeated for each salt (2 * HEAVY more rows at most)."""
    return keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(count, total) - 1))).drop(count)


def salted_join(rows: DataFrame, keyed: DataFrame, key: list[str], total: int, by: list[str], how: str = "inner", count: str = "c") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key, of which ``count`` says how many rows have it), so that no
    task gets a whole hot key. ``total``: at least the number of rows. Rows that know ``count`` too need no list
    of the hot keys."""
    if count in rows.columns:
        own = rows.withColumn("salt", F.pmod(F.xxhash64(*by), _salts(count, total)).cast("int"))
    else:
        own = dealt(rows, hot_keys(keyed.select(*key, count), total, count), key, by)
    return own.join(copied(keyed, total, count).hint("merge"), [*key, "salt"], how).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches, text: str = "text", limit: int = SLICE_BYTES):
    """Zero-copy slices of record batches holding about ``limit`` bytes of text each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = text_offsets(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < n:
            b = int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1
            b = min(max(b, a + 1), n)
            yield batch.slice(a, b - a)
            a = b


def _large(col: pa.Array) -> bool:
    return pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)


def text_offsets(col: pa.Array) -> np.ndarray:
    """Offsets (n + 1) into the value buffer; null texts have length 0 in what ``text_bytes`` returns."""
    kind = np.int64 if _large(col) else np.int32
    raw = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1]
    return raw.astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("")
    off = text_offsets(col)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x % (1 << 64)], dtype=U64))[0])


ROWS = 64
_T = mix(np.arange(1, ROWS * 256 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(ROWS, 256)
_FLAT = np.ascontiguousarray(_T.ravel())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False  # words [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False


class Words:
    """Words of a slice of texts: 64-bit hashes, byte spans, and the first word of each text."""

    __slots__ = ("hash", "start", "end", "first", "data", "ok", "lead", "place")

    def __init__(self, data: np.ndarray, off: np.ndarray, keep: np.ndarray, lower: bool, hashed: bool = True):
        if lower:
            data = LOWER[data]
        n = len(data)
        ok = keep[data]
        begin = np.empty(n + 1, bool)
        begin[:1] = True
        begin[1:] = True
        if n:
            begin[1:n] = ~ok[:-1]
            begin[off[:-1][off[:-1] < n]] = True
        begin = begin[:n] & ok
        self.data = data
        self.start = np.flatnonzero(begin)
        self.ok = np.flatnonzero(ok)
        self.lead = np.flatnonzero(begin[self.ok])
        length = np.diff(np.append(self.lead, len(self.ok)))
        self.end = self.start + length
        self.first = np.searchsorted(self.start, off)
        self.place = None
        self.hash = self.hashed() if hashed else None

    def hashed(self, take=None, seed: int = 0) -> np.ndarray:
        """Tabulation hash of each word, or of its first ``take`` bytes."""
        if not len(self.start):
            return np.zeros(0, U64)
        length = self.end - self.start
        if self.place is None:
            self.place = self.ok - np.repeat(self.start, length)
        place = self.place
        value = _FLAT[((place & (ROWS - 1)) << 8) | self.data[self.ok]]
        if (far := place >= ROWS).any():
            value[far] *= mix(place[far].astype(U64) >> U64(6)) | U64(1)
        if take is not None:
            value[place >= take] = 0
            length = np.minimum(length, take)
        return mix(np.add.reduceat(value, self.lead) + length.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed))


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == U64 else np.asarray(x, dtype=np.int64))


def bloom_bitmap(ids: DataFrame, col: str, log2_bits: int = 25) -> np.ndarray:
    """A fixed-size bitmap (2**log2_bits bits, 4 MB by default) of the longs in a column: built with
    map-side combining, so at most 2**log2_bits / 64 words ever reach the driver, whatever the input.
    Used only to drop rows early; an exact join follows. A full bitmap costs time, not rows."""
    bit = F.pmod(F.xxhash64(F.col(col)), F.lit(1 << log2_bits))
    words = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    out = np.zeros((1 << log2_bits) // 64, np.int64)
    found = words.toPandas()
    out[found["w"].to_numpy(dtype=np.int64)] = found["v"].to_numpy(dtype=np.int64)
    return out.view(U64)


def bloom_column(col: str, log2_bits: int = 25):
    """The bit that a row of the filtered side tests (a column, computed by Spark)."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(1 << log2_bits))


def bloom_test(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 6] >> (bits & 63).astype(U64)) & U64(1) == 1


def mapped(df: DataFrame, fn, fields: str, text: str = "text", more: tuple = (), limit: int = SLICE_BYTES) -> DataFrame:
    """Append the columns ``fields`` (DDL) that ``fn(slice) -> list of Arrow arrays`` makes of each slice.

    The input row travels beside them as one struct, so no name can clash while Python has it; the text is read out of
    that struct, and sent once, wherever it is a string in it (``text`` may be a path such as ``row.text``). ``more``:
    (alias, column) pairs that ``fn`` reads besides the text. A new column replaces one of the same name."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    path = _path(df.schema, text)
    apart = [] if path else [F.col(text).cast("string").alias("text")]
    given = df.select(*apart, *[c.alias(a) for a, c in more], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([given.schema["row"], *new.fields])

    def run(batches):
        for part in slices((_with_text(b, path) for b in batches), limit=limit):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("row")), *fn(part)], names=schema.names)

    out = given.mapInArrow(run, schema)
    names = set(new.names)
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in names], *[F.col(f"`{c}`") for c in new.names])


def _path(schema, text: str) -> list[int] | None:
    """The field numbers that lead to a string column; None if the name is not exactly there or of another type."""
    from pyspark.sql import types as T

    path, kind = [], schema
    for name in text.split("."):
        if not isinstance(kind, T.StructType) or kind.names.count(name) != 1:
            return None
        path.append(kind.names.index(name))
        kind = kind.fields[path[-1]].dataType
    return path if kind == T.StringType() else None


def _with_text(batch: pa.RecordBatch, path: list[int] | None) -> pa.RecordBatch:
    """The batch with its text as first column, taken (without a copy) from the struct ``row``."""
    if not path:
        return batch
    text = batch.column(batch.schema.get_field_index("row"))
    for k in path:
        text = text.field(k)
    return pa.RecordBatch.from_arrays([text, *batch.columns], names=["text", *batch.schema.names])
