import numpy as np

from siftstone.functions import hashing


def test_words_of_earlier_batches_are_not_hashed_again():
    words = [f"w{i}" * (1 + i % 9) for i in range(500)]
    known = hashing.Words(16, most=300, seen=450)
    for k in range(4):
        some = words[k * 20 : k * 20 + 400]
        row, at = np.repeat(np.arange(100), 4), np.arange(400)
        got = hashing.least_hashes(some, row, at, 100, 16, known)
        assert all((got[r] == hashing.minhash_signature(some[4 * r : 4 * r + 4], 16)).all() for r in range(100))
    assert len(known.place) == 300 and known.hashed < 1100
