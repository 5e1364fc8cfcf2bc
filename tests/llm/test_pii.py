import collections
import hashlib
import math
import random
import re

from siftstone.llm import pii as P


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_kinds_equal_brute_force():
    r = random.Random(5)
    bits = ["a", "b.c", "@", "@", ".com", "-", "é", " ", "1", "27", "256.", "10.0.0.1", "000", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0101", "+", "(", "%", "5" * 20]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert P.base_spans(t) == brute(t), t
    for long in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000):
        P.base_spans(long)


def corpus():
    r = random.Random(6)
    vocab = [f"word{i}" for i in range(150)]
    rows = []
    for i in range(300):
        t = [r.choice(vocab) for _ in range(30)]
        if i % 30 == 0:
            t += ["mail", "boss@corp.example", "Zanzibar", "phrase", str(i)]
        if i % 45 == 1:
            t += ["reach", "+1 (555) 555-0101", "Zanzibar"]
        rows.append((i, " ".join(t), "x", 1))
    rows += [(None, None, "x", 1), (400, "", "x", 1), (401, rows[0][1], "x", 1), (401, "only@once.example hapax", "x", 1), (402, "10.0.0.1 " + "é " * 50_000, "x", 1)]
    return rows


def told(rows):
    """(text, term) -> kind, from the definition."""
    ents, words = {}, {}
    for _, t, *_ in rows:
        t = t or ""
        base = P.base_spans(t)
        ents[t] = {P.entity(k, t[s:e]) for s, k, e in base}
        data = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if len(m[0].encode()) > 2]
        words[t] = {t[s:e].lower() for s, e in data if all(e <= a or s >= b for a, _, b in base)}
    docs = [t or "" for _, t, *_ in rows]
    every = {t: {m.lower() for m in re.findall(r"[^\W_]+", t) if len(m.encode()) > 2} for t in ents}
    df = collections.Counter(w for t in docs for w in every[t])
    out = {}
    for e in set().union(*ents.values()):
        own = [t for t in docs if e in ents[t]]
        if len(set(own)) < 2:
            continue
        p = len(own) / len(docs)
        for w in set().union(*(words[t] for t in own)):
            both = [t for t in own if w in words[t]]
            if len(set(both)) > 1:
                v = (math.log(len(both) / df[w]) - math.log(p)) / -math.log(p)
                if v >= P.GENERALISE:
                    for t in set(both):
                        out[t, w] = max(out.get((t, w), 0), 5 if v >= P.REMOVE else 4)
    return out


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, k1 long").repartition(4)
    got = P.find_personal(docs).collect()
    flagged, want = told(rows), []
    assert {w for _, w in flagged} >= {"mail", "phrase", "reach"} and not any(w.startswith("word") for _, w in flagged)
    for i, t, *_ in rows:
        t = t or ""
        base = P.base_spans(t)
        extra = [(m.start(), flagged[t, m[0].lower()], m.end()) for m in re.finditer(r"[^\W_]+", t) if (t, m[0].lower()) in flagged]
        show = lambda x: ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in sorted(x))
        n = [sum(k == j for _, k, _ in base) for j in range(4)]
        want.append((i, *n, hashlib.sha256(show(base).encode()).hexdigest(), show(base + extra)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for limit in ("10m", "-1"):  # broadcast and shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert clean[None] is None and clean[400] == ""
        assert "boss" not in clean[0] and "<EMAIL>" in clean[0] and "phrase" not in clean[0]
        assert clean[2] == rows[2][1]


def test_terms_of_entities_in_one_text(spark):
    r = random.Random(7)
    vocab = [f"word{i}" for i in range(150)]
    own = {3: "a@one.example b@one.example Hapax pairword", 9: "10.0.0.1 pairword twice", 11: "c@two.example twice shared", 12: "c@two.example shared alone"}
    rows = [(i, " ".join([own.get(i, ""), *(r.choice(vocab) for _ in range(20))]), "x") for i in range(2000)]
    rows += [(3000 + i, "hot@copy.example hotword", "x") for i in range(1000)]
    texts = collections.Counter(t for _, t, _ in rows)
    ents = {t: {P.entity(k, t[s:e]) for s, k, e in P.base_spans(t)} for t in texts}
    words = lambda t: [m for m in re.finditer(r"[^\W_]+", t) if len(m[0]) > 2]
    df = collections.Counter(w for _, t, _ in rows for w in {m[0].lower() for m in words(t)})
    want = {}
    for t in texts:
        base = P.base_spans(t)
        for m in words(t):
            if any(m.end() > a and m.start() < b for a, _, b in base):
                continue
            w = m[0].lower()
            for e in ents[t]:
                both = [x for x in texts if e in ents[x] and any(y[0].lower() == w for y in words(x))]
                p = sum(texts[x] for x in texts if e in ents[x]) / len(rows)
                v = (math.log(sum(texts[x] for x in both) / (df[w] + (len(both) == 1))) - math.log(p)) / -math.log(p)
                if v >= P.GENERALISE:
                    want[t, w] = max(want.get((t, w), 4), 5 if v >= P.REMOVE else 4)
    got = {}
    by = {i: t for i, t, _ in rows}
    for x in P.find_personal(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect():
        for k, s, e in (y.split(":") for y in x.spans.split(",") if y):
            if k in ("general", "remove"):
                got[by[x.doc_id], by[x.doc_id][int(s) : int(e)].lower()] = P.KINDS.index(k)
    assert got == want
    assert {w: k for (_, w), k in got.items()} == {"hapax": 4, "alone": 4, "shared": 5, "hotword": 5}


def test_rows_in_proportion_to_the_text(spark, monkeypatch):
    """Two texts with many common and many own entities and terms."""
    counts = []
    for n in (200, 800, 12_000):  # up to 1 MB
        base = " ".join(f"m{i}@x{i}.example term{i} word{i}" for i in range(n))
        rows = [(1, base + " own1@a.example first"), (2, base + " own2@a.example second"), (3, "other")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        written = []
        monkeypatch.setattr(P, "saved", lambda df, keep=P.saved: written.append(keep(df)) or written[-1])
        got = P.find_personal(docs).collect()
        monkeypatch.undo()
        assert sorted(r.n_email for r in got) == [0, n + 1, n + 1]
        assert all(r.spans.count("remove") >= 2 * n for r in got if r.n_email)
        counts.append(max(df.count() for df in written))
    assert counts[2] <= 2.2 * 12_000 * 4 and counts[1] < 5 * counts[0]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.find_personal(docs).count() == 0 and P.sanitise(docs).count() == 0
