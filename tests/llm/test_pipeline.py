import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from siftstone.llm import mixing, packing, pii, toxicity

from .test_ngram_join import grams


def corpus(seed=0, n=300):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(5, 60))]
        if i % 6 == 0:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["vile", "wretch"])
        if i % 25 == 1:
            words[2] = "jo@corp.example"
        rows.append((i, " ".join(words), "en", f"s{i % 4}" if i % 9 else None, 0))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(1, 40)]
    rows += [(2000 + i, rows[i][1] + " tail", "en", "s2", 0) for i in range(40, 80)]
    rows += [(None, None, None, None, None), (3000, "", "en", "s1", 0), (3001, "x " * 20_000, "en", "s0", 0), (7, rows[7][1], "en", "s3", 0)]
    return rows, labels


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in C.STAGES:
        out = C.saved(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append([tuple(x) for x in out.collect()])
        docs = out
    toxic, near, clean, mix, packed = seen
    # toxicity: with one set of labels the decisions are the operator's
    scored = toxicity.score_documents(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    bad = {(x.doc_id) for x in scored if x.predicted}
    assert np.mean([(i in bad) == (i % 6 == 0) for i in range(300)]) > 0.97
    assert sorted(map(str, toxic)) == sorted(str(x) for x in rows if x[0] not in bad)
    # near duplicates: components over all pairs
    sets = [grams(x[1] or "") for x in toxic]
    label = list(range(len(toxic)))
    for i in range(len(toxic)):
        for j in range(i):
            same = (toxic[i][1] or "") == (toxic[j][1] or "")
            if same or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    groups = collections.defaultdict(list)
    for x, k in zip(toxic, label):
        groups[k].append(x)
    assert len(near) == len(groups)
    assert sorted(str(x[0]) for x in near) == sorted(str(min((x[0] is None, x[0] or 0) for x in g)[1]) if any(x[0] is not None for x in g) else "None" for g in groups.values())
    # personal data
    assert len(clean) == len(near)
    assert not any(pii.base_spans(x[1] or "") for x in clean)
    before = {x[0]: x[1] for x in near}
    for i, t, *_, n in clean:
        assert n == (None if t is None else len(t))
        if not pii.base_spans(before[i] or ""):
            assert t == before[i]
    # mixing
    again = mixing.mix(spark.createDataFrame(clean, schema)).collect()
    words = collections.Counter()
    for i, t, *_ in mix:
        words[i] += len((t or "").split())
    assert {r.doc_id: r.taken for r in again if r.taken} == {k: v for k, v in words.items() if v}
    # packing
    tokenizer = packing.word_tokenizer(packing.tokenizer_path()).whole
    want = []
    for i, t, *_ in mix:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids)) for s, n in packing.pieces(len(ids))]
    assert sorted(map(str, want)) == sorted(str(x[:5]) for x in packed)
    assert C.run(spark, str(tmp_path)).count() == len(packed)


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, tmp_path, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.STAGES[k][1](spark, docs, str(tmp_path)).count() == 0
