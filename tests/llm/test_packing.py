import random
import zlib

import numpy as np

from siftstone.llm.packing import END, WordTokenizer, pack, pieces, tokenizer_path, write_buckets


def test_word_table_equals_whole_tokenizer():
    w, r = WordTokenizer(tokenizer_path()), random.Random(2)
    letters = "abcXYZ 0129'’\"!?._-\n\t\r\x0b\x85\xa0\xad\xaa\xb2\xb5\xba\xbc\xbf\xc0\xc5\xdf\xd7\xf7\xffİſKéñЖ中🙂́\x00​"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(20))) for _ in range(5000)] + ["", "a<|endoftext|>b", "I'll don't we've"]
    for t, raw in zip(texts, w.ids(texts)):
        assert raw == np.array(w.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_every_latin_character_equals_whole_tokenizer():
    w = WordTokenizer(tokenizer_path())
    texts = [f"ab{s}{chr(c)}{s}cd {chr(c)}{chr(c)}" for c in range(256) for s in ("", " ")]
    for t, raw in zip(texts, w.ids(texts)):
        assert raw == np.array(w.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pieces_are_binary_and_whole():
    for n in [*range(1, 300), 4095, 4096, 4097, 12_345]:
        p = pieces(n)
        assert all(k & (k - 1) == 0 and k <= 4096 for _, k in p)
        assert [s for s, _ in p] == [sum(k for _, k in p[:i]) for i in range(len(p))]
        assert sum(k for _, k in p) == n
        assert len(p) == n // 4096 + bin(n % 4096).count("1")


def test_frames(spark, tmp_path):
    rows = [(1, None, 9), (2, "", 9), (2, "Hello, world! " * 9000, 9), (None, "abc", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    got = pack(df).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert {r.offset for r in got} == {0}
    assert sorted(r.length for r in got if r.doc_id == 1) == [1]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    whole = WordTokenizer(tokenizer_path()).whole
    want = whole.encode("Hello, world! " * 9000, add_special_tokens=False).ids + [END]
    long = [r for r in got if r.doc_tokens > 4096]
    assert [x for r in sorted(long, key=lambda r: r.start) for x in r.ids] == want
    by = {}
    for r in got:
        by.setdefault(r.length, []).append(r.sequence_id)
    spans = sorted((min(v), max(v)) for v in by.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    write_buckets(pack(df), str(tmp_path / "packed"))
    for k in {r.length.bit_length() - 1 for r in got}:
        assert {r.length for r in spark.read.parquet(str(tmp_path / "packed" / f"bucket={k}")).collect()} == {1 << k}
    assert all(1 << r.bucket == r.length for r in got)
    assert pack(df.limit(0)).count() == 0
