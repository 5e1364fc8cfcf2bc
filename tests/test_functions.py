import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import distance, hashing, text, url


def column(spark, expr, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_tokens(spark):
    got = column(spark, text.tokens, ["Hello World! This is a test.", "I am a x y z developer", "café résumé naïve", "Rust PLUGIN GoLang", "", None, "the of", "can't 3.14 __ mail5.example.com a-b é"])
    assert got == [["hello", "world", "test"], ["am", "developer"], ["café", "résumé", "naïve"], ["rust", "plugin", "golang"], [], [], [], ["can't", "3.14", "mail5", "example.com", "é"]]
    assert len(text.STOPWORDS) == 99


def test_ngrams_slugs(spark):
    assert column(spark, lambda c: text.shingles(c, 3), ["hello", "hi", ""]) == [["hel", "ell", "llo"], ["hi"], [""]]
    assert column(spark, lambda c: text.word_ngrams(c, 2), [["rust", "plugin", "system"], ["rust"], []], "array<string>") == [["rust plugin", "plugin system"], ["rust"], [""]]
    names = ["Web Dev", "AI & ML", "  spaces  ", "Hello World!", "rust/systems", "---", "Été 1"]
    assert column(spark, text.slugify, names) == ["web-dev", "ai-ml", "spaces", "hello-world", "rust-systems", "", "été-1"]
    assert column(spark, text.capitalize, ["webDev", "", None]) == ["WebDev", "", ""]


def test_hashes(spark):
    assert f"{int(hashing.token_hashes(['rust'])[0]):016x}" == "fdeeed9472623ff0"
    rows = [(0, w, 1.0) for w in ("rust", "systems", "programming")] + [(1, "hello", 1.0), (1, "world", 1.0)]
    got = hashing.simhash(spark.createDataFrame(rows, "row_idx long, term string, weight double")).select("row_idx", hashing.to_hex("fingerprint"))
    assert dict(map(tuple, got.collect())) == {0: "f88eec8c521637f5", 1: "4010876908038c00"}
    assert [int(x) for x in hashing.minhash_signature(["solo"])[:2]] == [1503702200998595676, 9438955759193092390]
    assert set(hashing.minhash_signature([])) == {np.uint64((1 << 64) - 1)}
    assert column(spark, lambda c: hashing.to_hex(hashing.from_hex(c)), ["f88eec8c521637f5", "1", "zz", None]) == ["f88eec8c521637f5", "0000000000000001", None, None]
    df = spark.createDataFrame([(0, -1), (8, 9)], "a long, b long")
    assert [r[0] for r in df.select(hashing.hamming("a", "b")).collect()] == [64, 1]


@pytest.mark.parametrize("metric", ["lev", "JW", "cosine"])
def test_similarity(spark, metric):
    pairs = [("kitten", "sitting"), ("night", "nacht"), ("martha", "marhta"), ("", ""), ("hello", ""), ("a", "a"), ("a", "b"), ("Ab", "aB"), ("dixon", "dicksonx")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(distance.similarity("a", "b", metric)).collect()]
    for (a, b), v in zip(pairs, got):
        assert math.isclose(v, distance.compare(a, b, metric)["similarity"], abs_tol=1e-12)
    want = {"lev": [0.5714285714, 0.6], "JW": [None, None, 0.9611111111], "cosine": [0.3651483717, 0.25]}[metric]
    assert all(w is None or math.isclose(g, w, abs_tol=1e-9) for g, w in zip(got, want))
    assert got[3] == 1.0 and got[4] == 0.0 and got[5] == 1.0 and got[6] == 0.0
    with pytest.raises(ValueError):
        distance.similarity("a", "b", "none")


URLS = {
    "https://Example.COM/path/": "https://example.com/path",
    "https://example.com/page?utm_source=google&id=123": "https://example.com/page?id=123",
    "https://example.com?z=1&a=2&m=3": "https://example.com/?a=2&m=3&z=1",
    "https://www.example.com/path": "https://example.com/path",
    "https://example.com/path#section": "https://example.com/path",
    "example.com/path": "https://example.com/path",
    "https://example.com:443/path": "https://example.com/path",
    "https://example.com:8080/path": "https://example.com:8080/path",
    "https://example.com/path///": "https://example.com/path",
    "https://example.com/page?fbclid=abc&gclid=def&real=yes": "https://example.com/page?real=yes",
    "https://example.com/page?utm_source=google&fbclid=abc": "https://example.com/page",
    "https://example.com/": "https://example.com",
    "http://a.b.com/x.html?b&a=&b=2": "http://a.b.com/x.html?a&b&b=2",
    "https://example.com/a/../b/./c": "https://example.com/b/c",
    "": None,
    "not a url at all": None,
    None: None,
}


def test_urls(spark):
    got = column(spark, url.normalized, list(URLS))
    assert got == list(URLS.values()) == [url.normalize_url(u) for u in URLS]
    assert column(spark, url.normalized, got) == got
    assert column(spark, url.canonical_key, ["https://www.example.com/path?a=1"]) == ["example.com/path?a=1"]
    assert url.report("https://www.a.com/x/") == {"original": "https://www.a.com/x/", "normalized": "https://a.com/x", "canonical_key": "a.com/x"}
    with pytest.raises(ValueError, match="Could not parse URL"):
        url.report("not a url at all")
