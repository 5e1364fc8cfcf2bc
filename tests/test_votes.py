import tracemalloc

import numpy as np
import pyarrow as pa

from siftstone.functions import hashing, terms


def _run(monkeypatch, lists):
    """fingerprints() of one Arrow batch, without Spark."""
    monkeypatch.setattr(terms, "_mapped", lambda df, id_col, words, run, schema: run)
    monkeypatch.setattr(terms, "raw_words", lambda field: None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], ["i", "words"])
    run = terms.fingerprints(None, "i", "t")
    tracemalloc.start()
    out = [x for b in run(iter([batch])) for x in b.column(1).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_votes_of_many_words_take_little_memory(monkeypatch):
    words = [f"w{i}" for i in range(1200)]
    out, most = _run(monkeypatch, [words] * 500)  # 600,000 terms of rows
    assert len(set(out)) == 1 and most < 60 << 20


def test_rows_are_cut_anywhere(monkeypatch):
    r = np.random.default_rng(3)
    lists = [[f"w{k}" for k in r.integers(0, 40, n)] for n in (0, 1, 300, 2, 0, 70, 900, 5)] + [None, []]
    want = [int(hashing.simhash_lists([x])[0], 16) for x in lists]
    for rows, words, votes in ((512, 1 << 17, 1 << 14), (3, 50, 7), (1, 1, 1)):
        monkeypatch.setattr(terms, "_ROWS", rows), monkeypatch.setattr(terms, "_WORDS", words), monkeypatch.setattr(terms, "_VOTES", votes)
        out, _ = _run(monkeypatch, lists)
        assert [x & (1 << 64) - 1 for x in out] == want
