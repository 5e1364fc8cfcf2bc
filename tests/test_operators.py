import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import hashing
from siftstone.operators import cache, cluster, corpus, dedup, organize, profile, sample, topics
from siftstone.sources import readers, sinks
from siftstone.streaming import fingerprints as streaming

DOCS = ["rust systems programming", "rust memory safety fast", "italian cooking pasta", "pasta sauce cooking recipes", "", None, "the of and"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, f"https://www.example.com/p{i // 2}?utm_source=x") for i, t in enumerate(DOCS)], "row_idx long, content string, url string")


def test_idf_tags_fingerprints(spark, docs):
    assert math.isclose(spark.range(1).select(corpus.idf(3, F.lit(0))).first()[0], math.log(8))
    got = {r.row_idx: r._tags for r in corpus.tags(docs, count=2).collect()}
    assert len(got) == 7 and got[4] == got[5] == got[6] == [] and len(got[0]) == 2 and "rust" not in got[0]
    fp = {r.row_idx: r._fingerprint for r in corpus.fingerprint(docs).collect()}
    assert fp[0] == "f88eec8c521637f5" and fp[4] == fp[6] == "0" * 16
    assert len(set(r._fingerprint for r in corpus.fingerprint(docs, weighted=True).collect())) == 5
    assert corpus.tags(docs.limit(0)).count() == 0


def test_taxonomy_and_classify(docs):
    t = {"name": "t", "version": "1", "categories": [{"name": "Tech", "keywords": ["rust", "memory"], "children": [{"name": "Systems", "keywords": ["systems", "programming"]}]}, {"name": "Food", "keywords": ["pasta", "cooking"]}]}
    assert corpus.parse_taxonomy(json.dumps(t)) == t
    assert [p for p, _ in corpus.flatten(t)] == ["Tech", "Tech > Systems", "Food"] and corpus.category_names(t) == ["Tech", "Food"]
    with pytest.raises(ValueError, match="Failed to parse taxonomy"):
        corpus.parse_taxonomy("{}")
    with pytest.raises(ValueError, match="Failed to read"):
        corpus.load_taxonomy("/nowhere.json")
    got = {r.row_idx: (r._category, r._hierarchy) for r in corpus.classify(docs, t).collect()}
    assert got[0] == ("Systems", "Tech > Systems") and got[2] == ("Food", "Food") and got[4] == ("Uncategorized", "Uncategorized")
    assert {(r._category, r._confidence) for r in corpus.classify(docs, t, threshold=999.0).collect()} == {("Uncategorized", 0.0)}
    w = corpus.bm25_weights([["rust", "systems"], ["rust", "systems"], ["x"]])
    assert len(w) == 5


def brute_groups(fps, t):
    label = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= t and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("t", [0, 3, 15])
def test_hamming_equals_brute_force(spark, t):
    r = random.Random(t)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(3)] + base
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "row_idx long, fingerprint long")
    got = {frozenset((x.a & (1 << 64) - 1, x.b & (1 << 64) - 1)) for x in dedup.hamming_pairs(df, t).collect()}
    u = sorted(set(fps))
    assert got == {frozenset((a, b)) for i, a in enumerate(u) for b in u[i + 1 :] if (a ^ b).bit_count() <= t}


def test_dedup(docs):
    url = {r.row_idx: r for r in dedup.dedup(docs, strategy="url").collect()}
    assert [url[i]._dup_group for i in range(7)] == [0, 0, 2, 2, 4, 4, 6] and [url[i]._is_primary for i in range(3)] == [True, False, True]
    fuzzy = {r.row_idx: r._dup_group for r in dedup.dedup(docs, strategy="fuzzy").collect()}
    assert fuzzy[4] == fuzzy[5] == fuzzy[6] == 4 and len({fuzzy[i] for i in range(4)}) == 4
    assert len({r._dup_group for r in dedup.dedup(docs, strategy="fuzzy", skip_empty=True).collect()}) == 7
    both = {r.row_idx: r._dup_group for r in dedup.dedup(docs).collect()}
    assert both[6] == both[5] == both[4] == 4
    assert {r._dup_group for r in dedup.dedup(docs.drop("content"), strategy="fuzzy").collect()} == {0}
    with pytest.raises(ValueError):
        dedup.dedup(docs, strategy="none")
    assert all(r._is_primary for r in dedup.dedup(docs, strategy="none", strict=False).collect())
    assert dedup.dedup(docs.limit(0)).count() == 0


def test_minhash_index(spark):
    words = [["a", "b", "c"], ["a", "b", "c"], ["x", "y", "z"]]
    df = spark.createDataFrame(list(enumerate(words)), "row_idx long, w array<string>").select("row_idx", hashing.minhash_udf()("w").alias("signature"))
    assert [tuple(r) for r in dedup.minhash_candidates(df).collect()] == [(0, 1)]
    sig = hashing.minhash_signature(words[2]).view(np.int64).tolist()
    assert [r.row_idx for r in dedup.minhash_query(df, sig).collect()] == [2]
    assert df.alias("p").crossJoin(df.alias("q")).where("p.row_idx = 0 and q.row_idx = 1").select(hashing.minhash_jaccard(F.col("p.signature"), F.col("q.signature"))).first()[0] == 1.0


def test_sample_indices(spark):
    assert sample.random_sample(20, 5) == [3, 6, 14, 17, 18] and sample.random_sample(100, 10) == [2, 9, 18, 28, 32, 42, 54, 80, 94, 98]
    assert sample.systematic_sample(20, 5) == [3, 7, 11, 15, 19] and sample.systematic_sample(100, 10) == [9, 19, 29, 39, 49, 59, 69, 79, 89, 99]
    assert sample.reservoir_sample(20, 5) == [5, 10, 11, 14, 18] and sample.reservoir_sample(100, 10) == [4, 16, 22, 36, 42, 43, 75, 76, 79, 89]
    at = [i + (70 if k == "b" else 0) for k, i in sample.stratified_places({"a": 70, "b": 30}, 10)]
    assert sorted(at) == [14, 30, 42, 58, 62, 64, 68, 73, 77, 81]
    df = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(100)], "row_idx long, s string").repartition(3)
    assert sorted(r.row_idx for r in sample.sample(df, 10, "stratified", "s").collect()) == sorted(at)
    assert sorted(r.row_idx for r in sample.sample(df, 10).collect()) == [2, 9, 18, 28, 32, 42, 54, 80, 94, 98]
    shifted = df.withColumn("row_idx", F.col("row_idx") * 5 + 3)
    assert sorted(r.row_idx for r in sample.sample(shifted, 10, dense=False).collect()) == [5 * i + 3 for i in (2, 9, 18, 28, 32, 42, 54, 80, 94, 98)]
    assert sample.sample(df, 500, "systematic").count() == 100
    for bad in ({"strategy": "x"}, {"strategy": "stratified"}):
        with pytest.raises(ValueError):
            sample.sample(df, 5, **bad)
    assert sample.sample(df.limit(0), 5, "x").count() == 0


def test_profile(spark):
    df = spark.createDataFrame([("aé", 1, [1]), ("aé", None, None), (None, 22, [1, 2])], "s string, n int, a array<int>")
    r = profile.report(df)
    assert r["total_rows"] == 3 and r["num_columns"] == 3
    assert r["fields"]["s"] | {"types": 0} == {"non_null": 2, "null_count": 1, "cardinality": 1, "uniqueness": 0.5, "avg_length": 3.0, "min_length": 3, "max_length": 3, "types": 0, "top_values": [{"value": "aé", "count": 2}]}
    assert r["fields"]["n"]["types"] == [{"type": "number", "count": 2}] and r["fields"]["a"]["types"][0]["type"] == "array"
    assert profile.report(df.limit(0)) == {"total_rows": 0, "columns": [], "fields": {}}


def brute_hac(dist, linkage):
    n = len(dist)
    d, alive, size, ids, out = dist.copy(), list(range(n)), [1] * n, list(range(n)), []
    for t in range(n - 1):
        _, i, j = min((d[i][j], i, j) for i in alive for j in alive if i < j)
        best = d[i][j]
        for k in alive:
            if k not in (i, j):
                a, b, x, y, z = d[i][k], d[j][k], size[i], size[j], size[k]
                new = {"single": min(a, b), "complete": max(a, b), "average": (x * a + y * b) / (x + y), "ward": ((x + z) * a + (y + z) * b - z * best) / (x + y + z)}[linkage]
                d[i][k] = d[k][i] = new
        alive.remove(j)
        size[i] += size[j]
        out.append((ids[i], ids[j], best, size[i]))
        ids[i] = n + t
    return out


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_hac(linkage):
    r = np.random.default_rng(1)
    x = np.round(r.random((25, 25)), 2)
    x = np.triu(x, 1) + np.triu(x, 1).T
    for a, b in zip(cluster.hac(x, linkage), brute_hac(x, linkage)):
        assert a[:2] == b[:2] and a[3] == b[3] and math.isclose(a[2], b[2], abs_tol=1e-12)
    four = np.array([[0, 1, 4, 5], [1, 0, 2, 6], [4, 2, 0, 3], [5, 6, 3, 0]], float)
    m = cluster.hac(four, "single")
    assert m[0][2] == 1.0 and cluster.cut_tree(m, 4, 1) == [0, 0, 0, 0] and cluster.cut_tree(m, 4, 1, compat=True) == [0, 0, 0, 1]
    assert cluster.cut_tree(m, 4, 4) == [0, 1, 2, 3] and len(set(cluster.cut_tree(cluster.hac(x, linkage), 25, 6))) == 6


def test_generate_discover_topics(spark):
    texts = [f"{t} item{i}" for i, t in enumerate(["rust memory safety systems", "pasta sauce cooking italian", "football match goal league"] * 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, content string")
    r = cluster.generate(df, depth=3)
    assert r["num_clusters"] == 3 and sorted(c["members"] for c in r["categories"]) == [[0, 3, 6, 9], [1, 4, 7, 10], [2, 5, 8, 11]]
    t = cluster.discover(df, clusters=3)
    assert len(t["categories"]) == 3 and all(c["name"][0].isupper() for c in t["categories"])
    got = cluster.classify_auto(df, clusters=3).collect()
    assert len({r._category for r in got}) == 3
    with pytest.raises(ValueError):
        cluster.generate(df.limit(1))
    assert cluster.discover(df.limit(0))["categories"] == []
    found = []
    for dense in (10**9, 0):
        t, a = topics.topics(df, topics=3, iterations=8, dense=dense)
        found.append({r.row_idx: r.topic for r in a.collect()})
        assert sum(r["size"] for r in t.collect()) == 12
    assert found[0] == found[1]
    r = topics.report(df, topics=3, iterations=8)
    assert r["num_items"] == 12 and sorted(i for t in r["topics"] for i in t["members"]) == list(range(12))
    v = np.array([[2, 1, 0, 0], [1, 2, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2.0]])
    d = topics.dominant(topics.nmf(v, 2)[0])
    assert d[0] == d[1] != d[2] == d[3] and topics.dominant(np.zeros((1, 3)))[0] == 2


def test_organize_report_sinks(spark, tmp_path):
    rows = [("Web Development", "React Tutorial", "A B > C", True), ("Tools", "My Tool", None, False), (None, None, None, None)]
    df = spark.createDataFrame(rows, "_category string, id string, _hierarchy string, _is_primary boolean")
    path = lambda f: [r._output_path for r in organize.organize(df, f, "./out").collect()]
    assert path("folders") == ["./out/web-development/react-tutorial", "./out/tools/my-tool", "./out/uncategorized/unknown"]
    assert path("flat")[1] == "./out/tools--my-tool" and path("nested")[:2] == ["./out/a-b/c/react-tutorial", "./out/tools/my-tool"]
    s = organize.summary(df).first()
    assert (s.total_items, s.num_duplicates, s.num_unique) == (3, 1, 2) and len(s.top_categories) == 3
    assert "| Tools | 1 | 33.3% |" in sinks.markdown(df)
    sinks.write_report(df, str(tmp_path / "r"))
    assert json.load(open(tmp_path / "r/report.json"))[0]["total_items"] == 3
    out = organize.organize(df, "folders", str(tmp_path / "o"))
    assert len(sinks.make_folders(out)) == 2 and (tmp_path / "o/web-development").is_dir()
    sinks.write_parquet(df, str(tmp_path / "p"), "_category")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"full_name": "a/b", "description": None, "topics": ["x", "y"], "language": "Rust", "html_url": "u", "stargazers_count": 5}, {"full_name": "c"}]))
    s = readers.read_stars(spark, str(tmp_path / "s.json")).collect()
    assert s[0].content == "a/b  x y Rust" and s[1].language == "unknown" and readers.read_stars(spark, str(tmp_path / "s.json"), 1).count() == 1
    tree = {"roots": {"bookmark_bar": {"children": [{"type": "folder", "name": "F", "children": [{"type": "url", "name": "n", "url": "http://x"}, {"type": "url", "name": "j", "url": "javascript:1"}]}]}, "other": {"children": []}}}
    (tmp_path / "b.json").write_text(json.dumps(tree))
    b = readers.read_bookmarks(spark, str(tmp_path / "b.json")).collect()
    assert [(r.content, r.id) for r in b] == [("n http://x bookmark_bar/F", "bookmark_bar/F/n")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("hello")
    (tmp_path / "d/.hidden").write_text("")
    d = readers.read_directory(spark, str(tmp_path / "d"), exclude="^\\.").collect()
    assert [(r.content, r.size, r.extension) for r in d] == [("a.txt d txt", 5, "txt")]
    assert readers.ingest(spark, ["a", None]).columns == ["content"] and readers.ingest(spark, 3).columns == ["value"] and readers.ingest(spark, None).count() == 0
    assert readers.ingest(spark, [{"x": 1, "y": "b"}, {"x": None, "z": 2}]).columns == ["x", "y", "z"]
    with pytest.raises(ValueError, match="Available"):
        readers.read_json(spark, str(tmp_path / "s.json"), "nope")


def test_cache(spark, docs, tmp_path):
    c, calls = cache.Cache(str(tmp_path / "c")), []

    def make(df):
        calls.append(1)
        return corpus.tags(df)

    for _ in range(2):
        assert c.cached(docs, "tags", {"count": 5}, make).count() == 7
    assert len(calls) == 1 and c.info()["total"] == 1
    assert cache.content_hash(docs) == cache.content_hash(docs.orderBy(F.desc("row_idx"))) != cache.content_hash(docs.limit(3))
    assert c.clear("other")["deleted"] == 0 and c.clear()["deleted"] == 1


def test_pipeline_and_dispatch(spark, docs):
    out = organize.pipeline(docs.withColumn("id", F.col("row_idx").cast("string")), clusters=2)
    assert out.count() == 7 and {"_category", "_tags", "_dup_group", "_output_path"} <= set(out.columns)
    assert organize.run("tags", docs.drop("row_idx"), count=1).count() == 7
    with pytest.raises(ValueError):
        organize.run("nope", docs)
    organize.register(spark)
    assert spark.sql("select normalize_url('example.com/a/')").first()[0] == "https://example.com/a"


def test_streaming(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "Hello big World"), ("2024-01-01 00:01:00", "world, big HELLO"), ("2024-01-01 00:02:00", "other words")]
    spark.createDataFrame(rows, "ts string, content string").selectExpr("cast(ts as timestamp) ts", "content").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, content string").parquet(str(tmp_path / "in"))
    q = streaming.drop_repeats(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("kept").count() == 2


def test_dispatch_of_scalars_and_cache(spark, docs, tmp_path):
    r = organize.run("similarity", spark.createDataFrame([("abc", "abd")], "a string, b string"), all=True).first()
    assert math.isclose(r.levenshtein, 2 / 3) and 0 < r["jaro-winkler"] < 1 and math.isclose(r.cosine, 0.5)
    assert organize.run("similarity", spark.createDataFrame([("abc", "abd")], "a string, b string"), metric="jw").first().metric == "jw"
    r = organize.run("normalize_url", docs).first()
    assert (r.original, r.normalized, r.canonical_key) == ("https://www.example.com/p0?utm_source=x", "https://example.com/p0", "example.com/p0")
    path = str(tmp_path / "kept")
    for _ in range(2):
        assert organize.run("tags", docs, cache=path, count=2).count() == 7
    assert [a["kind"] for a in organize.run("cache", path=path)["artifacts"]] == ["tags"]
    assert organize.run("cache", path=path, clear=True, kind="tags")["deleted"] == 1
    assert organize.run("classify", docs, clusters=2, linkage="single").count() == 7


def test_sql_functions(spark):
    organize.register(spark)
    r = spark.sql(r"select tokenize('The Rust-lang: can\'t 3.14 __ a') t, slugify(' A b!c ') s, simhash(tokenize('rust systems programming')) f").first()
    assert r.t == ["rust", "lang", "can't", "3.14"] and r.s == "a-b-c" and r.f == "f88eec8c521637f5"


def test_words_by_both_patterns(spark):
    import regex

    from siftstone.functions import text

    r = random.Random(2)
    bits = ["a", "bc", "é", "ß", "e\u0301", "\u0301", "'", "’", ".", ":", "·", ",", ";", "1", "23", "_", " ", "-", "@", "中", "٣"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.raw_words("t").alias("w")).collect()
    for x in got:
        assert x.w == regex.findall(text.WORD, x.t), x.t


def test_terms_within_rows(spark):
    from siftstone.functions import terms, text

    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["rust", "The", "go", "é", "a", "__", "pasta1"]) for _ in range(r.randrange(9)))) for i in range(1500)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "i long, t string")
    words = {x.i: x.w for x in df.select("i", text.tokens("t").alias("w")).collect()}
    got = {(x.i, x.term): (x.tf, x.dl) for x in terms.term_counts(df, "i", "t").collect()}
    assert got == {(i, t): (w.count(t), len(w)) for i, w in words.items() for t in w}
    fp = {x.i: x.fingerprint for x in terms.fingerprints(df, "i", "t").collect()}
    sig = {x.i: x.signature for x in terms.signatures(df, "i", "t", 16).collect()}
    for i, w in words.items():
        assert f"{fp[i] & (1 << 64) - 1:016x}" == hashing.simhash_lists([w])[0]
        assert sig[i] == hashing.minhash_signature(w, 16).view(np.int64).tolist()


def test_row_index_follows_the_input(spark):
    df = spark.range(1000).repartition(7).selectExpr("id as x")
    want = [r.x for r in df.collect()]
    assert [r.x for r in corpus.with_row_index(df).orderBy("row_idx").collect()] == want
    assert corpus.with_row_index(df.limit(0)).count() == 0


def test_index_of_small_bands_and_near_duplicates(spark):
    for t in range(16):
        r = random.Random(t)
        for _ in range(200):
            x = sum({1 << r.randrange(64) for _ in range(t)})
            assert any(x & m == 0 for m in dedup.masks(t))
    assert len(dedup.masks(3, lossless=False)) == len(dedup.masks(20)) == 16
    df = spark.createDataFrame([(0, 0), (1, 0b111), (2, -1)], "row_idx long, fingerprint long")
    assert [(r.a, r.b) for r in dedup.hamming_pairs(df, 3, lossless=False).collect()] == [(0, 7)]
    assert [r[0] for r in df.select(hashing.is_near_duplicate(F.lit(0), F.col("fingerprint"))).collect()] == [True, True, False]


def test_types_of_variants_and_sparse_factors(spark):
    df = spark.sql("select parse_json(x) v from values ('1'), ('\"s\"'), ('[1]'), ('{\"a\":1}'), ('true'), ('2.5') t(x)")
    assert {t["type"]: t["count"] for t in profile.report(df)["fields"]["v"]["types"]} == {"number": 2, "string": 1, "array": 1, "object": 1, "bool": 1}
    v = np.random.default_rng(0).random((12, 9)) * (np.random.default_rng(1).random((12, 9)) < 0.4)
    r, c = np.nonzero(v)
    for a, b in zip(topics.nmf(v, 3, 50), topics.nmf_sparse(r, c, v[r, c], 12, 9, 3, 50)):
        assert np.allclose(a, b)
