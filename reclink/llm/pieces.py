"""Operator 1: SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is framed as the vocabulary expects it (one space before it, spaces as the pieces' word mark) and cut
before each run of spaces. No piece crosses such a cut, so the lattice of a text is the chain of its segments'
lattices: forward sums are computed once for each distinct segment of a slice, and each occurrence then draws
its own path backwards, edge by edge, with probability forward(start) * p(piece) / forward(end). The draws are
a hash of (seed, row key, segment number, step), so a row gets the same pieces whatever the partitioning.

The public vocabulary is of the BPE kind and stores merge ranks, not probabilities; pieces get Zipf's
p = 1 / (rank + 3), and ``alpha`` sharpens (over 1) or flattens (under 1) the distribution. A character that
no piece spells is written as byte pieces.

Decoding joins the pieces' bytes and drops the space in front: decode(encode(text)) == text for every text,
also where it holds the word mark itself (written as bytes), control characters or runs of spaces.

Defined cases: a null text gives null pieces, an empty one none; a null key counts as 0; rows that repeat a
key and text get equal pieces; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _FLAT, ROWS, SLICE_BYTES, U64, mapped, mix, mix_int, table, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE = SLICE_BYTES // 2  # bytes of text whose lattice a worker holds at once


class Vocabulary:
    """Pieces as bytes (the mark as a space), their log-probabilities, and a trie as sorted (node, byte) keys."""

    def __init__(self, pieces: list[bytes | None], logp: np.ndarray, byte_ids: np.ndarray):
        self.pieces, self.logp, self.byte_ids = pieces, logp, byte_ids
        nodes: dict[bytes, int] = {b"": 0}
        keys, child = [], []
        for p in sorted(x for x in pieces if x):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    keys.append(nodes[p[: k - 1]] * 256 + p[k - 1])
                    child.append(nodes[p[:k]])
        order = np.argsort(np.array(keys))
        self.keys, self.child = np.array(keys, np.int64)[order], np.array(child, np.int64)[order]
        self.hashed = None
        self.piece = np.full(len(nodes), -1, np.int64)
        for i, p in enumerate(pieces):
            if p:
                self.piece[nodes[p]] = i
        raw = list(pieces)
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        raw = [x or b"" for x in raw]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [None if special[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        rank = np.array([min(-sp.get_score(i), float(n)) for i in range(n)])
        logp = -np.log(rank + 3)
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        logp[byte_ids] = -np.log(n) - 2
        return cls(pieces, logp, byte_ids)

    def below(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, or -1: an open hash table, made by each process for itself."""
        if self.hashed is None:
            bits = max(8, 2 + len(self.keys).bit_length())
            slots, todo = np.full(1 << bits, -1, np.int64), np.arange(len(self.keys))
            at = self._slot(self.keys, bits)
            while len(todo):
                free = slots[at[todo]] < 0
                slots[at[todo[free]]] = todo[free]
                todo = todo[slots[at[todo]] != todo]
                at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
            used = slots >= 0
            self.hashed = bits, np.where(used, self.keys[slots], -1), np.where(used, self.child[slots], -1)
        bits, keys, child = self.hashed
        want = node * 256 + byte
        at = self._slot(want, bits)
        found = keys[at]
        out = np.where(found == want, child[at], -1)
        rest = np.flatnonzero((found != want) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << bits) - 1)
            found = keys[at[rest]]
            hit = found == want[rest]
            out[rest[hit]] = child[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).view(np.int64)

    def edges(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All lattice edges (start, end, piece) over joined segments; ``ends``: where each byte's segment ends."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        origin, node, depth = at, np.zeros(len(at), np.int64), 0
        out = []
        width = np.diff(np.append(at, len(data)))
        single = np.zeros(len(data), bool)
        wide = np.zeros(len(data), np.int64)
        wide[at] = width
        while len(origin):
            live = origin + depth < ends[origin]
            origin, node = origin[live], node[live]
            node = self.below(node, data[origin + depth])
            live = node >= 0
            origin, node = origin[live], node[live]
            depth += 1
            p = self.piece[node]
            hit = p >= 0
            out.append((origin[hit], origin[hit] + depth, p[hit]))
            single[origin[hit & (wide[origin] == depth)]] = True
        unknown = np.repeat(~single[at], width)
        b = np.flatnonzero(unknown)
        out.append((b, b + 1, self.byte_ids[data[b]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Framed bytes (a space before each non-empty text), segment starts, and the first segment of each text."""
    n = np.diff(off)
    some = n > 0
    begin = off[:-1] + np.cumsum(some) - some
    total = len(data) + int(some.sum())
    framed = np.full(total, 32, np.uint8)
    inside = np.ones(total, bool)
    inside[begin[some]] = False
    framed[inside] = data
    cut = framed == 32
    if total:
        cut[1:] &= framed[:-1] != 32
        cut[begin[some]] = True
    start = np.flatnonzero(cut)
    return framed, start, np.searchsorted(start, np.append(begin, total))


def forward(start, end, logp, offset, seg_first, total):
    """Log forward sums at all node positions (position + segment number: segments share no node). The edges come by
    their end; ``offset``: how far that is from the segment's first node."""
    alpha = np.full(total, -np.inf)
    alpha[seg_first] = 0.0
    order = np.argsort(offset.astype(np.uint16) if len(offset) and offset.max() < 1 << 16 else offset, kind="stable")
    s, e, w, o = start[order], end[order], logp[order], offset[order]
    cuts = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else []
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < len(cuts) else len(o)
        lead = np.flatnonzero(np.append(True, e[a + 1 : b] != e[a : b - 1]))
        x = alpha[s[a:b]] + w[a:b]
        top = np.maximum.reduceat(x, lead)
        size = np.diff(np.append(lead, b - a))
        alpha[e[a:b][lead]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size)), lead))
    return alpha


def sample(vocab: Vocabulary, data: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and the offsets of the texts in them."""
    framed, start, first = segments(data, off)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    length = np.diff(np.append(start, len(framed)))
    place = np.arange(len(framed)) - np.repeat(start, length)
    value = _FLAT[((place & (ROWS - 1)) << 8) | framed] * (mix(place.astype(U64) >> U64(6)) | U64(1))
    h = mix(np.add.reduceat(value, start) + length.astype(U64))
    _, rep, which = np.unique(h, return_index=True, return_inverse=True)
    del value, place, h
    # The distinct segments, joined.
    size = length[rep]
    begin = np.concatenate([[0], np.cumsum(size)])
    joined = framed[np.repeat(start[rep] - begin[:-1], size) + np.arange(begin[-1])]
    seg = np.repeat(np.arange(len(rep)), size)
    a, b, piece = vocab.edges(joined, begin[1:][seg])
    # Edges by end and start: no two have both.
    order = np.argsort(b * (len(joined) + 1) + a)
    a, b, piece = a[order], b[order], piece[order]
    logp = vocab.logp[piece] * alpha
    own = seg[a]
    offset = b - begin[own]
    a, b = a + own, b + own  # node numbers: a segment of n bytes has n + 1 nodes
    node0 = begin[:-1] + np.arange(len(rep))
    total = int(begin[-1]) + len(rep)
    f = forward(a, b, logp, offset, node0, total)
    # Cumulative probabilities of the edges that end at a node.
    live = np.isfinite(f[a]) & np.isfinite(f[b])
    a, b, piece, logp = a[live], b[live], piece[live], logp[live]
    p = np.exp(f[a] + logp - f[b])
    lead = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    n = np.diff(np.append(lead, len(b)))
    c = np.cumsum(p)
    c -= np.repeat(c[lead] - p[lead], n)
    c /= np.repeat(c[lead + n - 1], n)
    c[lead + n - 1] = 1.0
    edge0 = np.zeros(total, np.int64)
    edge0[b[lead]] = lead
    # Backward: all occurrences draw their edges together.
    docs = np.repeat(np.arange(len(off) - 1), np.diff(first))
    number = np.arange(len(start)) - first[docs]
    state = mix(keys[docs] ^ U64(seed)) + mix(number.astype(U64) + U64(1))
    cur, stop, live = node0[which] + size[which], node0[which], np.arange(len(start))
    drawn = []
    step = 0
    count = np.zeros(len(start), np.int64)
    while len(live):
        u = (mix(state[live] + U64(mix_int(step + 7))) >> U64(11)).astype(np.float64) / 9007199254740992.0
        e = edge0[cur[live]]
        on = np.flatnonzero(c[e] <= u)
        while len(on):  # the last edge of a node has 1, which no draw reaches
            e[on] += 1
            on = on[c[e[on]] <= u[on]]
        drawn.append((live, piece[e].astype(np.int32)))
        count[live] += 1
        cur[live] = a[e]
        live = live[a[e] > stop[live]]
        step += 1
    at = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(at[-1], np.int32)
    for k, (who, what) in enumerate(drawn):
        ids[at[who + 1] - 1 - k] = what
    return ids, at[first]


def spell(vocab: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes that piece ids spell, and their offsets; the space in front is dropped."""
    ids = ids.astype(np.int64)
    size = vocab.size[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    data = vocab.bytes[np.repeat(vocab.begin[ids] - at[:-1], size) + np.arange(at[-1])]
    begin = at[off]
    keep = np.ones(len(data), bool)
    keep[begin[:-1][np.diff(begin) > 0]] = False
    lengths = np.diff(begin)
    return data[keep], np.concatenate([[0], np.cumsum(lengths - (lengths > 0))])


def encode(df: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """Adds ``piece_ids`` (array<int>) and ``lossless`` (whether decoding gives the text again, byte by byte)."""

    def run(part: pa.RecordBatch):
        col = part.column(0)
        data, off = text_bytes(col)
        keys = part.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        ids, begin = sample(vocab, data, off, keys, seed, alpha)
        back, boff = spell(vocab, ids, begin)
        same = np.diff(boff) == np.diff(off)
        if len(back) == len(data) and (boff == off).all():
            wrong = np.flatnonzero(back != data)
            same[np.searchsorted(off, wrong, side="right") - 1] = False
        else:
            same &= np.array([np.array_equal(back[boff[i] : boff[i + 1]], data[off[i] : off[i + 1]]) for i in range(len(same))], bool)
        gone = np.asarray(col.is_null().to_numpy(zero_copy_only=False))
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin[:-1], begin[-1]).astype(np.int32), mask=np.append(gone, False)), pa.array(ids))
        return [lists, pa.array(same, mask=gone)]

    return mapped(df, run, "piece_ids array<int>, lossless boolean", text, more=(("key", F.xxhash64(key) if dict(df.dtypes)[key] == "string" else F.col(key).cast("long")),), limit=SLICE)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """Adds (or replaces) ``into``, the text that the ids spell."""
    given = df.select(F.col(ids).cast("array<int>").alias("ids"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def run(batches):
        for batch in batches:
            col = batch.column(0)
            lists = col.to_pylist()
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            off = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            data, boff = spell(vocab, flat, off)
            raw = data.tobytes()
            texts = [None if x is None else raw[boff[k] : boff[k + 1]].decode("utf-8", "replace") for k, x in enumerate(lists)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["row", "out"])

    from pyspark.sql import types as T

    out = given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("out", T.StringType())]))
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c != into], F.col("out").alias(into))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Vocabulary.load(), seed=11)
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("piece_ids").alias("ids"), "lossless")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, Vocabulary.load(), seed=11)
