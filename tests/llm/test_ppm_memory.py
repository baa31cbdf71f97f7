"""What a worker of op8_ppm holds: tables twice as long as their keys, and no counts beside the tables."""

import numpy as np

from bytemill.llm import ppm


def test_tables_are_twice_their_keys(monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK", 9000)
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 80_000).astype(np.uint64))
    own, other = keys[::2], keys[1::2]
    table = ppm.Hashed(own, np.arange(len(own)))
    assert len(table.slots) == 2 * len(own)
    at = table.find(own)
    assert (at >= 0).all() and (table.values[0][at] == np.arange(len(own))).all()
    assert (table.find(other) == -1).all()


def test_full_table_goes_on_at_its_begin():
    table = ppm.Hashed(np.zeros(0, np.uint64), np.zeros(0))
    some = np.arange(5000, dtype=np.uint64)
    last = some[table._at(some) == table.size - 1][:4]
    table._put(last, [np.arange(4)])
    assert sorted(table.find(last)) == [0, 1, 2, table.size - 1] and table.values[0][table.find(last)].tolist() == [0, 1, 2, 3]


def test_counts_go_when_the_trie_is_there():
    flat = np.frombuffer(b"a rose is a rose is a rose, and a nose is no rose" * 3, np.uint8)
    parts = [np.unique(k, return_counts=True) for _, k in ppm.windows(*ppm.marked(flat, np.array([0, len(flat)])))]
    keys, n = ppm._merged(parts)
    shared = ppm.Shared({}, keys[::-1], n[::-1])
    found = shared.trie.cost(keys)
    assert shared.parts is None and shared.trie is shared.trie
    assert np.array_equal(found, ppm.Trie(keys, n).cost(keys))
