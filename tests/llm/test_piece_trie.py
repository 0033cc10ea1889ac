"""The piece lattice: trie lookups against a dictionary, and draws without a search over a slice's edges."""

import numpy as np

from reclink.llm import pieces


def test_children_equal_a_dictionary():
    vocab = pieces.Vocabulary([b" a", b"b", b" ", b"a", b"ab", "é".encode()], np.zeros(6), np.arange(256) % 5)
    nodes, byte = (x.ravel() for x in np.meshgrid(np.arange(len(vocab.piece)), np.arange(256), indexing="ij"))
    known = dict(zip(vocab.keys.tolist(), vocab.child.tolist(), strict=True))
    assert vocab.below(nodes, byte).tolist() == [known.get(k, -1) for k in (nodes * 256 + byte).tolist()]


def test_no_binary_search_for_each_edge_or_draw(monkeypatch):
    """The searches of a slice are over texts and segments: none looks up its edges, draws or trie keys."""
    vocab = pieces.Vocabulary([b" a", b"b", b" ", b"a", b"ab", *[None] * 256], np.log([0.3, 0.2, 0.2, 0.1, 0.2, *[0.001] * 256]), np.arange(5, 261))
    data = np.frombuffer(b"ab " * 5000, np.uint8)
    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: looked.append(np.size(v)) or search(a, v, *more, **named))
    ids, begin = pieces.sample(vocab, data, np.array([0, len(data)]), np.zeros(1, np.uint64), 0, 1.0)
    monkeypatch.undo()
    assert sum(looked) <= 2 and pieces.spell(vocab, ids, begin)[0].tobytes() == data.tobytes()
