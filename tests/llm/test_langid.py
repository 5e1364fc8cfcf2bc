import zlib

import numpy as np

from siftstone.llm import langid as L

WORDS = {"en": "the and of with have thing this that", "de": "der und ein über schön nicht auch weiß", "fr": "le été avec être leçon où très la"}


def brute(text):
    """n-gram by n-gram, from the definition."""
    clean = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    s = " " + " ".join(clean.split()) + " "
    v = np.zeros(L.DIM)
    if len(s) > 2:
        for i in range(len(s) - 2):
            x = np.ones(L.DIM)
            for k, c in enumerate(reversed(s[i : i + 3])):
                x *= 1 - 2.0 * np.unpackbits(L._rotations(ord(c))[k])
            v += x
    return v


def test_vectors_equal_brute_force():
    texts = ["", "a", " a ", "12 34", "The cat.", "été  déjà\n\x00 vu", "ÀÉ" * 50, "x", "日本語 テキスト"]
    got = L.text_vectors(texts)
    for t, v in zip(texts, got):
        assert np.array_equal(v, brute(t)), t


def test_predictions_equal_brute_force(spark):
    """Prototypes are sums of unit vectors, predictions the largest cosine."""
    r = np.random.default_rng(2)
    rows = [(i, " ".join(r.choice((WORDS["en"] + " " + WORDS[lang]).split(), 6)), lang) for i in range(90) for lang in [list(WORDS)[i % 3]]]
    rows += [rows[3], (200, "", "en"), (201, None, "de"), (202, "le " * 5000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    learned = {}
    for i, t, lang in rows:
        if t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang] = learned.get(lang, 0) + unit(brute(t))
    learned = {k: unit(v) for k, v in sorted(learned.items())}
    by = {}
    for x in L.predict_languages(df).collect():
        by.setdefault(x.doc_id, x)
    for i, t, _ in rows:
        v = unit(brute(t or ""))
        cos = {k: float(p @ v) for k, p in learned.items()}
        best = max(cos, key=cos.get)
        if not v.any():
            assert by[i].lang_pred == "und"
        elif sorted(cos.values())[-1] - sorted(cos.values())[-2] > 1e-5:
            assert by[i].lang_pred == best and abs(by[i].score - max(cos[best], 0)) < 1e-4


def test_held_out_accuracy_and_edges(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(600):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang].split(), 12)), lang if i % 7 else None, "s"))
    rows += [(None, None, "en", "s"), (601, "", "en", "s"), (602, "123 !!", "en", "s"), (603, "der " * 60_000, None, "s"), (603, "der " * 60_000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.predict_languages(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    assert np.mean([got[i].lang_pred == list(WORDS)[i % 3] for i in range(600)]) > 0.98
    for k in (None, 601, 602):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[603].lang_pred == "de" and 0 <= got[603].score <= 1
    assert L.predict_languages(df.limit(0)).count() == 0
    nothing = df.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in L.predict_languages(nothing).collect()} == {"und"}
