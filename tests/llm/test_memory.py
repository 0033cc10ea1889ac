"""What a Python worker gets and holds: each text is sent to it once, and the toxicity fit works slice by slice."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from reclink.llm import common, pieces, toxicity


def texts_in(kind) -> int:
    if isinstance(kind, T.StructType):
        return sum(texts_in(f.dataType) if isinstance(f.dataType, T.StructType) else f.name == "text" for f in kind.fields)
    return 0


@pytest.mark.parametrize("stage", [toxicity.clean_stage, pieces.pieces_stage])
def test_stages_send_each_text_once(spark, monkeypatch, stage):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    sent, given = [], type(docs).mapInArrow

    def counted(df, *args, **named):
        sent.append(texts_in(df.schema))
        return given(df, *args, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert set(sent) == {1}, sent  # three times by clean_stage, twice by pieces_stage before
    assert out.columns[: len(docs.columns)] == docs.columns and 0 < out.count() <= docs.count()


def test_mapped_reads_the_text_of_any_frame(spark):
    docs = spark.createDataFrame([("é", 12, ("in", None)), (None, 345, ("ner", "x")), ("abc", None, None)], "text string, row int, s struct<text: string, b: string>")

    def size(part):
        return [pa.array(np.diff(common.text_bytes(part.column(0))[1]).astype(np.int64))]

    for text, sizes in (("text", [2, 0, 3]), ("TEXT", [2, 0, 3]), ("row", [2, 3, 0]), ("s.text", [2, 3, 0]), ("s.b", [0, 1, 0])):
        found = common.mapped(docs.coalesce(1), size, "bytes long", text, limit=3).collect()
        assert [r["bytes"] for r in found] == sizes, text
        assert [tuple(r)[:3] for r in found] == [tuple(r) for r in docs.coalesce(1).collect()], text


def test_sliced_chains_equal_one_and_hold_less(monkeypatch):
    rng = np.random.default_rng(1)
    words = np.array(["vile", "Häst", "ordet.", "plain,", "so", "much!", "x\n"])
    text = pa.array([" ".join(words[rng.integers(0, len(words), n)]) for n in [0, 3, 200_000, *rng.integers(0, 3000, 300)]])
    data, off = common.text_bytes(text)
    monkeypatch.setattr(toxicity, "SLICE", 1 << 16)
    peaks, made = [], []
    for make in (lambda: toxicity.Chains(data, off), lambda: toxicity.Chains.sliced(text)):
        tracemalloc.start()
        made.append(make())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    for name in ("head", "doc", "features"):
        assert np.array_equal(getattr(made[0], name), getattr(made[1], name)), name
    assert peaks[1] < 0.6 * peaks[0], peaks
