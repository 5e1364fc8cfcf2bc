"""The queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance, hashing, terms, text, url
from ..operators import cache, cluster, corpus, dedup, organize, profile, sample, topics
from ..operators.graph import saved
from ..sources import readers, sinks
from .siphash_sql import siphash

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TAXONOMY = {
    "name": "affixes",
    "version": "1",
    "categories": [
        {"name": "English", "keywords": ["the", "tion", "er", "ing", "est", "or", "re", "ed", "on"], "children": [{"name": "Toxic", "keywords": ["idiot", "moron", "scum", "trash", "loser"]}]},
        {"name": "German", "keywords": ["der", "die", "und", "ein", "das", "nicht"]},
        {"name": "French", "keywords": ["le", "la", "les", "et", "des", "une"]},
        {"name": "Spanish", "keywords": ["el", "la", "los", "que", "de", "una"]},
    ],
}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORD = text.WORD.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_KEEP = f"strlen(t) >= 2 AND replace(t, '_', '') <> '' AND t NOT IN ({_STOP})"
_WORDS = f"words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')) AS t FROM documents)"
_TF = f"{_WORDS}, tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM words WHERE {_KEEP} GROUP BY ALL)"
_TFIDF = f"""{_TF}, n AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
w AS (SELECT doc_id, term, tf, tf::DOUBLE / dl * ln((n - df + 0.5) / (df + 0.5) + 1) AS weight FROM tf JOIN df USING (term) JOIN dl USING (doc_id), n)"""


@query("tokenize_counts", f"WITH {_WORDS} SELECT doc_id, count(*) FILTER ({_KEEP}) AS n_tokens, count(DISTINCT t) FILTER ({_KEEP}) AS n_terms FROM documents LEFT JOIN words USING (doc_id) GROUP BY doc_id")
def tokenize_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = text.tokens("text")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query("document_frequencies", f"WITH {_TF}, n AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf FROM tf, n GROUP BY term")
def document_frequencies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.count()
    return corpus.term_counts(d, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(corpus.idf(n, F.col("df")), 9))


_TOP = f"{_TFIDF}, r AS (SELECT doc_id, term, round(weight, 9) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM w)"


@query("tags_top5", f"WITH {_TOP} SELECT doc_id, rank, term, score FROM r WHERE rank <= 5")
def tags_top5(spark, sf_dir):
    return corpus.top_terms(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("rank", F.col("rank").cast("long"))


@query("tags", f"WITH {_TOP} SELECT doc_id, coalesce(string_agg(term, ',' ORDER BY rank), '') AS tags FROM documents LEFT JOIN (SELECT * FROM r WHERE rank <= 5) USING (doc_id) GROUP BY doc_id")
def tags(spark, sf_dir):
    return corpus.tags(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", id_col="doc_id").select("doc_id", F.array_join("_tags", ",").alias("tags"))


_CATS = corpus.flatten(TAXONOMY)
_BM = ", ".join(f"({c}, '{t}', {w!r}::DOUBLE)" for c, t, w in corpus.bm25_weights([k for _, k in _CATS]))
_NAMES = ", ".join(f"({i}, '{p.split(' > ')[-1]}', '{p}')" for i, (p, _) in enumerate(_CATS))


@query(
    "bm25_classify",
    f"""WITH {_TF}, kw(cat, term, w) AS (VALUES {_BM}), names(cat, category, path) AS (VALUES {_NAMES}),
s AS (SELECT doc_id, cat, round(sum(tf * w), 9) AS score FROM tf JOIN kw USING (term) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cat) AS k FROM s)
SELECT doc_id, CASE WHEN score >= 0.5 THEN category ELSE 'Uncategorized' END AS _category, CASE WHEN score >= 0.5 THEN path ELSE 'Uncategorized' END AS _hierarchy,
CASE WHEN score >= 0.5 THEN score ELSE 0 END AS _confidence FROM documents LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (doc_id) LEFT JOIN names USING (cat)""",
)
def bm25_classify(spark, sf_dir):
    return corpus.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), TAXONOMY, "text", id_col="doc_id").drop("text")


def _profile_sql(name, columns):
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, {e} AS v FROM {name}" for c, k, e in columns)
    return f"""WITH v AS ({cells}) SELECT "column", type, count(v) AS non_null, count(*) - count(v) AS null_count, count(DISTINCT v) AS cardinality,
round(count(DISTINCT v)::DOUBLE / count(v), 9) AS uniqueness, round(sum(strlen(v))::DOUBLE / count(v), 9) AS avg_length, min(strlen(v))::INTEGER AS min_length, max(strlen(v))::INTEGER AS max_length FROM v GROUP BY ALL"""


_PROFILED = {
    "documents": ["doc_id:number", "text:string", "lang:string", "source:string", "n_chars:number"],
    "customer": ["c_custkey:number", "c_name:string", "c_nationkey:number", "c_acctbal:number", "c_mktsegment:string"],
    "events": ["event_id:number", "ts:string", "user_id:number", "event_type:string", "value:number", "props:string"],
    "lineitem": ["l_orderkey:number", "l_partkey:number", "l_suppkey:number", "l_linenumber:number", "l_quantity:number", "l_extendedprice:number", "l_discount:number", "l_tax:number", "l_returnflag:string", "l_linestatus:string", "l_shipdate:string"],
}
for _name, _cols in _PROFILED.items():
    _cols = [c.split(":") for c in _cols]

    def _make(name=_name, cols=_cols):
        return lambda spark, sf_dir: profile.profile(table(spark, sf_dir, name).select(*(c for c, _ in cols)))

    query(f"profile_{_name}", _profile_sql(_name, [(c, k, f"CAST({c} AS VARCHAR)") for c, k in _cols]))(_make())


@query(
    "top_values",
    """WITH v AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c) SELECT "column", rank, value, n FROM r WHERE rank <= 5""",
)
def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents").select("lang", "source")).withColumn("rank", F.col("rank").cast("long"))


@query("category_stats", "SELECT lang AS category, count(*) AS count FROM documents GROUP BY lang")
def category_stats(spark, sf_dir):
    return organize.category_stats(table(spark, sf_dir, "documents"), "lang")


@query("size_by_group", "SELECT coalesce(nullif(source, ''), '(none)') AS \"group\", count(*) AS count, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def size_by_group(spark, sf_dir):
    return organize.group_stats(table(spark, sf_dir, "documents"), "source", "n_chars")


_DEDUP_URL_KEY = r"""key AS (SELECT page_id, regexp_replace(u, '#.*$', '') AS u FROM (SELECT page_id, trim(url) AS u FROM pages)),
parts AS (SELECT page_id, CASE WHEN regexp_matches(split_part(u, '?', 1), '^https?://[^/]+$') THEN split_part(u, '?', 1) || '/' ELSE split_part(u, '?', 1) END AS base,
  CASE WHEN contains(u, '?') THEN regexp_extract(u, '\?(.*)$', 1) ELSE '' END AS q FROM key),
params AS (SELECT page_id, i, list_extract(string_split(q, '&'), i) AS p FROM (SELECT page_id, q, unnest(range(1, len(string_split(q, '&')) + 1)) AS i FROM parts)),
kept AS (SELECT page_id, string_agg(regexp_replace(p, '=$', ''), '&' ORDER BY split_part(p, '=', 1), i) AS q FROM params
  WHERE p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN (""" + ", ".join(f"'{t}'" for t in url.TRACKING) + r""") GROUP BY page_id),
norm AS (SELECT page_id, regexp_replace(regexp_replace(base || CASE WHEN kept.q IS NULL THEN '' ELSE '?' || kept.q END, '/+$', ''), '^(https?://)www\.', '\1') AS normalized FROM parts LEFT JOIN kept USING (page_id))"""


@query("url_normalize", f"WITH {_DEDUP_URL_KEY} SELECT page_id, normalized, regexp_replace(normalized, '^https?://', '') AS canonical_key FROM norm")
def url_normalize(spark, sf_dir):
    n = table(spark, sf_dir, "pages").select("page_id", url.normalized("url").alias("normalized"))
    return n.withColumn("canonical_key", F.regexp_replace(F.regexp_replace("normalized", "^https://", ""), "^http://", ""))


@query("dedup_url", f"WITH {_DEDUP_URL_KEY}, g AS (SELECT page_id, min(page_id) OVER (PARTITION BY regexp_replace(normalized, '^https?://', '')) AS _dup_group FROM norm) SELECT page_id, _dup_group, page_id = _dup_group AS _is_primary FROM g")
def dedup_url(spark, sf_dir):
    return dedup.dedup(table(spark, sf_dir, "pages").select("page_id", "url"), url_field="url", strategy="url", id_col="page_id").drop("url")


_HASHED = "SELECT doc_id, tf, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM tf"
_BITS = " + ".join(f"(CASE WHEN round(sum(CASE WHEN (h & {1 << i}::UBIGINT) <> 0 THEN {{w}} ELSE -{{w}} END), 9) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)::HUGEINT" for i in range(64))
_FROM_H = "fp0 AS (SELECT doc_id, ({bits})::UBIGINT AS fp FROM h GROUP BY doc_id), fp AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN fp0 USING (doc_id))"
_FP = f"h AS ({_HASHED}), {_FROM_H.format(bits=_BITS.format(w='tf'))}"
_HEX = "lpad(lower(to_hex(fp)), 16, '0')"


@query("simhash_md5", f"WITH {_TF}, {_FP} SELECT doc_id, {_HEX} AS _fingerprint FROM fp")
def simhash_md5(spark, sf_dir):
    return corpus.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", id_col="doc_id", hash_fn="md5").drop("text")


@query("simhash_sip13", f"WITH RECURSIVE {_TF}, {siphash('tf')}, h AS (SELECT doc_id, tf, h FROM tf JOIN sip USING (term)), {_FROM_H.format(bits=_BITS.format(w='tf'))} SELECT doc_id, {_HEX} AS _fingerprint FROM fp")
def simhash_sip13(spark, sf_dir):
    return corpus.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", id_col="doc_id").drop("text")


@query("simhash_weighted", f"WITH RECURSIVE {_TFIDF}, {siphash('tf')}, h AS (SELECT doc_id, tf * weight AS own, h FROM w JOIN sip USING (term)), {_FROM_H.format(bits=_BITS.format(w='own'))} SELECT doc_id, {_HEX} AS _fingerprint FROM fp")
def simhash_weighted(spark, sf_dir):
    return corpus.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", True, id_col="doc_id").drop("text")


@query("hamming_pairs", f"WITH {_TF}, {_FP}, u AS (SELECT DISTINCT fp FROM fp) SELECT least({_HEX.replace('fp', 'x.fp')}, {_HEX.replace('fp', 'y.fp')}) AS a, greatest({_HEX.replace('fp', 'x.fp')}, {_HEX.replace('fp', 'y.fp')}) AS b, bit_count(xor(x.fp, y.fp))::INTEGER AS distance FROM u x JOIN u y ON x.fp < y.fp AND bit_count(xor(x.fp, y.fp)) <= 3")
def hamming_pairs(spark, sf_dir):
    fps = corpus.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", id_col="doc_id", hash_fn="md5")
    a, b = hashing.to_hex("a"), hashing.to_hex("b")
    return dedup.hamming_pairs(fps).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "distance")


_REACH = """reach(id, other) AS (SELECT {id}, {id} FROM {t} UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT id AS {id}, min(other) AS _dup_group, id = min(other) AS _is_primary FROM reach GROUP BY id"""


@query("dedup_fuzzy", f"WITH RECURSIVE {_TF}, {_FP}, e0 AS (SELECT x.doc_id AS a, y.doc_id AS b FROM fp x JOIN fp y ON x.doc_id < y.doc_id AND bit_count(xor(x.fp, y.fp)) <= 3), e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), {_REACH.format(id='doc_id', t='documents')}")
def dedup_fuzzy(spark, sf_dir):
    return dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", strategy="fuzzy", id_col="doc_id", hash_fn="md5").drop("text")


_PAGES = f"documents AS (SELECT page_id AS doc_id, html AS text FROM pages), {_TF}, {_FP}, {_DEDUP_URL_KEY}"


@query(
    "dedup_combined",
    f"""WITH RECURSIVE {_PAGES}, e0 AS (SELECT x.doc_id AS a, y.doc_id AS b FROM fp x JOIN fp y ON x.doc_id < y.doc_id AND bit_count(xor(x.fp, y.fp)) <= 3
UNION ALL SELECT x.page_id, y.page_id FROM norm x JOIN norm y ON x.page_id < y.page_id AND regexp_replace(x.normalized, '^https?://', '') = regexp_replace(y.normalized, '^https?://', '')),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0), {_REACH.format(id='page_id', t='pages')}""",
)
def dedup_combined(spark, sf_dir):
    return dedup.dedup(table(spark, sf_dir, "pages"), "html", id_col="page_id", hash_fn="md5").select("page_id", "_dup_group", "_is_primary")


_PARTS = "SELECT a.p_partkey AS p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _part_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey")


@query("sim_levenshtein", f"SELECT p_partkey, round(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)), 9) AS similarity FROM ({_PARTS})")
def sim_levenshtein(spark, sf_dir):
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(distance.similarity("x", "y", "levenshtein"), 9).alias("similarity"))


@query("sim_jaro_winkler", f"SELECT p_partkey, round(jaro_winkler_similarity(x, y), 9) AS similarity FROM ({_PARTS})")
def sim_jaro_winkler(spark, sf_dir):
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(distance.similarity("x", "y", "jw"), 9).alias("similarity"))


@query(
    "sim_cosine",
    f"""WITH p AS ({_PARTS}), g AS (SELECT p_partkey, 0 AS s, substr(lower(x), i, 2) AS g FROM (SELECT *, unnest(range(1, length(x))) AS i FROM p) UNION ALL SELECT p_partkey, 1, substr(lower(y), i, 2) FROM (SELECT *, unnest(range(1, length(y))) AS i FROM p)),
c AS (SELECT p_partkey, g, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b FROM g GROUP BY ALL) SELECT p_partkey, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 9) AS similarity FROM c GROUP BY p_partkey""",
)
def sim_cosine(spark, sf_dir):
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(distance.similarity("x", "y", "cosine"), 9).alias("similarity"))




_DRAW = "(({s}::HUGEINT * 6364136223846793005::HUGEINT + 1442695040888963407::HUGEINT) % 18446744073709551616::HUGEINT)"
#: For every population (k, n, q, seed) its q draws s, and the spot that each takes in a shuffle of n.
_SHUFFLE = f"""g(k, n, q, i, s, spot, moved) AS (
SELECT k, n, q, -1, (seed + 1)::HUGEINT, NULL::BIGINT, MAP {{}}::MAP(BIGINT, BIGINT) FROM pop
UNION ALL SELECT k, n, q, i, s, coalesce(moved[j], j), map_concat(moved, MAP {{j: coalesce(moved[i], i)}}) FROM (
SELECT *, i + (s % (n - i)::HUGEINT)::BIGINT AS j FROM (SELECT k, n, q, (i + 1)::BIGINT AS i, {_DRAW.format(s='s')} AS s, moved FROM g WHERE i + 1 < q)))"""


@query("sample_random", f"WITH RECURSIVE pop AS (SELECT 0 AS k, count(*) AS n, 50 AS q, 42 AS seed FROM documents), {_SHUFFLE} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT spot FROM g)")
def sample_random(spark, sf_dir):
    return sample.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, id_col="doc_id")


@query("sample_systematic", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT unnest(list_transform(range(0, 50), lambda i: CAST(floor(0.9132308426383271::DOUBLE * (n::DOUBLE / 50) + i * (n::DOUBLE / 50)) AS BIGINT))) FROM n)")
def sample_systematic(spark, sf_dir):
    return sample.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "systematic", id_col="doc_id")


@query(
    "sample_stratified",
    f"""WITH RECURSIVE c AS (SELECT lang AS k, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS r, count(*) OVER () AS strata, sum(count(*)) OVER () AS total FROM documents GROUP BY lang),
f AS (SELECT *, CASE WHEN r = strata - 1 THEN NULL ELSE floor(n::DOUBLE / total * 50 + 0.5::DOUBLE)::BIGINT END AS share FROM c),
pop AS (SELECT k, n, least(coalesce(share, 50 - sum(share) OVER ()), n)::BIGINT AS q, 42 + r AS seed FROM f), {_SHUFFLE},
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS spot FROM documents)
SELECT doc_id, lang FROM d JOIN g ON g.k = d.lang AND g.spot = d.spot""",
)
def sample_stratified(spark, sf_dir):
    return sample.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "stratified", "lang", id_col="doc_id")


@query(
    "sample_reservoir",
    f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
g(i, s) AS (SELECT 49::BIGINT, 43::HUGEINT UNION ALL SELECT i + 1, {_DRAW.format(s='s')} FROM g, n WHERE i + 1 < n),
put AS (SELECT (s % (i + 1)::HUGEINT)::BIGINT AS j, max(i) AS i FROM g WHERE i >= 50 AND s % (i + 1)::HUGEINT < 50 GROUP BY 1),
took AS (SELECT coalesce(put.i, f.j) AS spot FROM (SELECT unnest(range(50)) AS j) f LEFT JOIN put USING (j)),
c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS spot FROM customer)
SELECT c_custkey, c_name FROM c JOIN took USING (spot)""",
)
def sample_reservoir(spark, sf_dir):
    return sample.sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 50, "reservoir", id_col="c_custkey", dense=False)


_SLUG = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"
for _format, _sql in {
    "folders": f"'./out/' || {_SLUG.format('c_mktsegment')} || '/' || {_SLUG.format('c_name')}",
    "flat": f"'./out/' || {_SLUG.format('c_mktsegment')} || '--' || {_SLUG.format('c_name')}",
    "nested": f"'./out/' || {_SLUG.format('c_mktsegment')} || '/' || {_SLUG.format('c_name')}",
}.items():

    def _make(format=_format):
        return lambda spark, sf_dir: organize.organize(table(spark, sf_dir, "customer"), format, "./out", "c_mktsegment", "c_name").select("c_custkey", "_output_path")

    query(f"organize_{_format}", f"SELECT c_custkey, {_sql} AS _output_path FROM customer")(_make())


@query("shingles", "SELECT p_partkey, array_to_string(CASE WHEN length(p_name) < 3 THEN [lower(p_name)] ELSE list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3)) END, '|') AS shingles FROM part")
def shingles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.shingles("p_name", 3), "|").alias("shingles"))


_LIST = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_WORD}'), lambda t: {_KEEP})"


@query("word_ngrams", f"WITH l AS (SELECT doc_id, {_LIST} AS w FROM documents) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) END, '|')) AS ngrams_md5 FROM l")
def word_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.word_ngrams(text.tokens("text"), 2), "|")).alias("ngrams_md5"))


_KEYS = "SELECT i AS perm, ((i::HUGEINT * 6364136223846793005 + 1) % 18446744073709551616)::UBIGINT AS k0, ((i::HUGEINT * 1442695040888963407 + 7) % 18446744073709551616)::UBIGINT AS k1 FROM range(128) t(i)"
_MIN = f"""{_TF}, {siphash('tf', _KEYS)}, least AS (SELECT doc_id, perm, min(h) AS m FROM tf JOIN sip USING (term) GROUP BY ALL),
sig AS (SELECT doc_id, list(CASE WHEN m >= 9223372036854775808 THEN (m::HUGEINT - 18446744073709551616)::BIGINT ELSE m::BIGINT END ORDER BY perm) AS s FROM least GROUP BY doc_id),
every AS (SELECT doc_id, coalesce(s, list_transform(range(128), lambda i: -1::BIGINT)) AS s FROM documents LEFT JOIN sig USING (doc_id))"""


def _signatures(spark, sf_dir):
    return terms.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("minhash_signatures", f"WITH RECURSIVE {_MIN} SELECT doc_id, array_to_string(s, ',') AS signature FROM every")
def minhash_signatures(spark, sf_dir):
    return _signatures(spark, sf_dir).select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query(
    "minhash_lsh_candidates",
    f"WITH RECURSIVE {_MIN}, b AS (SELECT doc_id, k, array_to_string(s[8 * k + 1:8 * k + 8], ',') AS v FROM (SELECT *, unnest(range(16)) AS k FROM every)) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.k = y.k AND x.v = y.v AND x.doc_id < y.doc_id",
)
def minhash_lsh_candidates(spark, sf_dir):
    return dedup.minhash_candidates(_signatures(spark, sf_dir), "doc_id")


_ITEMS = f"documents AS (SELECT item_id AS doc_id, text FROM benchmark), {_TFIDF}"


def _items(spark, sf_dir, id_col):
    """The benchmark's items: a whole table small enough to cluster exactly."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias(id_col), "text")


@query("cosine_pairs", f"WITH {_ITEMS}, u AS (SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS u FROM w) SELECT x.doc_id AS a, y.doc_id AS b, round(1 - sum(x.u * y.u), 9) AS distance FROM u x JOIN u y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL")
def cosine_pairs(spark, sf_dir):
    w = corpus.tfidf(_items(spark, sf_dir, "doc_id"), "doc_id", "text")
    return cluster.cosine_pairs(w, "doc_id").select("a", "b", F.round("distance", 9).alias("distance"))


@query("generate_ward")
def generate_ward(spark, sf_dir):
    r = cluster.generate(_items(spark, sf_dir, "row_idx"), "text")
    return spark.createDataFrame([(c["id"], c["label"], c["size"]) for c in r["categories"]], "id int, label string, size int")


@query("classify_auto")
def classify_auto(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cluster.classify_auto(d, "text", id_col="doc_id").drop("text")


@query("topics_nmf")
def topics_nmf(spark, sf_dir):
    return topics.topics(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", id_col="doc_id")[1]


def _folder(spark):
    """A folder of its own where ``saved`` tables are."""
    return saved(spark.range(1))._saved_at + "-out"


@query("cached_tags", f"WITH {_TOP} SELECT doc_id, coalesce(string_agg(term, ',' ORDER BY rank), '') AS tags, 1::BIGINT AS artifacts FROM documents LEFT JOIN (SELECT * FROM r WHERE rank <= 5) USING (doc_id) GROUP BY doc_id")
def cached_tags(spark, sf_dir):
    """Tags kept by the cache and taken from it the second time."""
    kept = cache.Cache(_folder(spark), spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    for _ in range(2):
        found = organize.run("tags", d, field="text", id_col="doc_id", cache=kept)
    return found.select("doc_id", F.array_join("_tags", ",").alias("tags"), F.lit(kept.info()["total"]).cast("long").alias("artifacts"))


@query("json_round_trip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_round_trip(spark, sf_dir):
    """A table written by the JSON sink and read by the JSON source."""
    path = _folder(spark)
    sinks.write_json(table(spark, sf_dir, "conversations"), path)
    return readers.read_json(spark, path, "text", lines=True).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("parquet_by_category", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def parquet_by_category(spark, sf_dir):
    """A table written in a folder for each category; the group is the folder."""
    path = _folder(spark)
    sinks.write_parquet(table(spark, sf_dir, "documents"), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("summary_report", "WITH d AS (SELECT lang, doc_id <> min(doc_id) OVER (PARTITION BY md5(text)) AS dup FROM documents), c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang) SELECT count(*) AS total_items, count(DISTINCT lang) AS num_categories, count(*) FILTER (dup) AS num_duplicates, count(*) FILTER (NOT dup) AS num_unique, (SELECT string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) FROM c) AS top_categories FROM d")
def summary_report(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("k"))
    d = d.withColumn("_is_primary", F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("k")))
    s = organize.summary(d, "lang")
    return s.withColumn("top_categories", F.array_join(F.transform("top_categories", lambda x: F.concat_ws(":", x["category"], x["count"].cast("string"))), ","))
