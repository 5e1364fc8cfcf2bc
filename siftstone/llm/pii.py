"""Personal data, and information-theoretic sanitisation of the terms that give it away.

Protected entities are the values of e-mail addresses, IP addresses, card and phone numbers. With
p(e) the share of all documents that hold e, and p(e|t) that among documents with the term t, t
discloses the part PMI(e;t) / IC(e) = (log p(e|t) - log p(e)) / -log p(e) of e's information. Terms
that disclose at least ``GENERALISE`` of an entity of their document are replaced by a class,
those of at least ``REMOVE`` are dropped. Every document counts in the shares. An entity and a term
that meet in one distinct text may do so by chance: there one more document, that has the term
without the entity, is added to p(e|t)'s denominator, so rarity in the corpus decides.

Base kinds are leftmost and non-overlapping, each for itself; a failing match consumes its text.
Their scans take time in proportion to the text: an address is sought at each @, numbers from the
beginnings of digit runs. Corpus counts are made per partition first; documents meet their terms'
spans by the digest of their text, so copies, however many, meet one row.

Rows of entities and terms stay near the text's length: entities that the same texts hold are told alike and are one
class, and a term is paired only if it can disclose enough: p(e|t) is at most both / df, so df must not exceed
holders^GENERALISE * documents^(1 - GENERALISE) of some entity of the text. Terms are of three bytes or more. Null
is the empty text; texts of many entities, very long ones, repeated rows and null ids are like any other; empty tables
give no rows, further columns of any name are left alone; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import saved
from .common import chunks, documents, prefix_sums, ranges_hash

KINDS = ("email", "ip", "card", "phone", "general", "remove")
GENERALISE, REMOVE = 0.9, 0.98
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), by start, then kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """What makes two finds the same."""
    return f"{KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value))


_TERM = np.zeros(256, bool)
_TERM[128:] = _TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, off: np.ndarray):
    """(hash of each run of three or more letter or digit bytes, ASCII lowered; byte starts; ends; text)."""
    solid = _TERM[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    there = off[:-1] < off[1:]
    at = off[:-1][there]
    first[at] = solid[at]
    at = off[1:][there] - 1
    last[at] = solid[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = e - s >= 3
    s, e = s[long], e[long]
    return ranges_hash(data, s, e, prefix_sums(_LOWER[data])).view(np.int64), s, e, np.searchsorted(off, s, "right") - 1


def _keys(text):
    m = F.md5(text)
    k = lambda a, n: F.conv(F.substring(m, a, n), 16, 10).cast("long")
    return k(1, 15).alias("k1"), k(16, 15).alias("k2")


def _scan(rows: DataFrame) -> DataFrame:
    """rows: id, __text, k1, k2 -> the same with base spans, and of texts with entities these and all terms."""

    def run(batches):
        for b, texts, data, off in chunks(batches, "__text"):
            found = [base_spans(t) for t in texts.to_pylist()]
            hot = [i for i, f in enumerate(found) if f]
            names: list[list[str]] = [[] for _ in found]
            term: list = [[] for _ in found]
            for i in hot:
                t = texts[i].as_py()
                names[i] = sorted({entity(k, t[s:e]) for s, k, e in found[i]})
                own = data[off[i] : off[i + 1]]
                h, s, e, _ = terms(own, np.array([0, len(own)]))
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                s, e = points[s], points[e]
                free = np.ones(len(s), bool)
                for x, _, y in found[i]:
                    free &= (e <= x) | (s >= y)
                term[i] = [{"term": a, "start": x, "end": y} for a, x, y in zip(h[free].tolist(), s[free].tolist(), e[free].tolist())]
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in f] for f in found]
            kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            place = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("k1"), b.column("k2"), pa.array(spans, pa.list_(kind)), pa.array(names, pa.list_(pa.string())), pa.array(term, pa.list_(place))],
                ["id", "k1", "k2", "base", "entities", "terms"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, k1 long, k2 long, base {_SPANS}, entities array<string>, terms array<struct<term:long,start:int,end:int>>")


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all documents."""

    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        def out(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["term", "df"])

        for _, _, data, off in chunks(batches, "t"):
            h, _, _, doc = terms(data, off)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            k, c = np.unique(h[new], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 2_000_000:
                k, c = merged()
                if len(k) > 1_000_000:
                    yield out(k, c)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if keys:
            yield out(*merged())

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(docs: DataFrame, scanned: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(k1, k2, extra): spans of the terms of each text that disclose one of its entities."""
    n = scanned.count()
    texts = scanned.where(F.size("entities") > 0).groupBy("k1", "k2").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("copies"))
    texts = saved(texts)
    held = texts.select("k1", "k2", "copies", F.explode("entities").alias("entity"))
    place = F.xxhash64("k1", "k2")
    which = [F.count(F.lit(1)).alias("texts"), F.bit_xor(place).alias("x"), F.bit_xor(F.xxhash64(place, F.lit(1))).alias("y")]
    shared = held.groupBy("entity").agg(F.sum("copies").alias("holders"), *which)
    # the entities that the same texts have are told alike, so one stands for all of them
    held = held.join(shared, "entity").groupBy("k1", "k2", "copies", "holders", "texts", "x", "y").agg(F.min("entity").alias("entity")).drop("texts", "x", "y")
    # a term of a higher document frequency can't reach GENERALISE; a little above, for rounding
    bound = lambda holders: F.pow(holders.cast("double"), F.lit(float(generalise))) * float(max(n, 1)) ** (1 - generalise) * (1 + 1e-9)
    most = held.groupBy("k1", "k2").agg(F.max("holders").alias("most"))
    found = texts.join(most, ["k1", "k2"]).select("k1", "k2", bound(F.col("most")).alias("bound"), F.explode(F.array_distinct("terms.term")).alias("term"))
    rare = found.join(document_frequencies(docs, text_col), "term").where("df <= bound").select("k1", "k2", "term", "df")
    pairs = saved(held.join(rare, ["k1", "k2"]).where(F.col("df") <= bound(F.col("holders"))))
    met = pairs.groupBy("entity", "term", "holders", "df").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both"))
    p = F.col("holders") / F.lit(max(n, 1))
    told = F.when(F.col("holders") >= n, F.lit(0.0)).otherwise((F.log(F.col("both") / (F.col("df") + (F.col("texts") == 1).cast("int"))) - F.log(p)) / -F.log(p))
    told = met.withColumn("told", told).where(F.col("told") >= generalise)
    told = told.select("entity", "term", F.when(F.col("told") >= remove, 5).otherwise(4).alias("kind"))
    kinds = pairs.select("entity", "k1", "k2", "term").join(told, ["entity", "term"]).groupBy("k1", "k2", "term").agg(F.max("kind").cast("int").alias("kind"))
    kinds = kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("term", "kind")).alias("kinds"))

    def run(batches):
        for b in batches:
            extra = []
            for t, own in zip(b.column("terms"), b.column("kinds")):
                term, start, end = (t.values.field(c).to_numpy() for c in ("term", "start", "end"))
                own, kind = (own.values.field(c).to_numpy() for c in ("term", "kind"))
                order = np.argsort(own)
                own, kind = own[order], kind[order]
                at = np.minimum(np.searchsorted(own, term), len(own) - 1)
                hit = own[at] == term
                extra.append([{"start": s, "kind": k, "end": e} for s, k, e in zip(start[hit].tolist(), kind[at[hit]].tolist(), end[hit].tolist())])
            kinds_of = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(extra, kinds_of)], ["k1", "k2", "extra"])

    return texts.select("k1", "k2", "terms").join(kinds, ["k1", "k2"]).mapInArrow(run, f"k1 long, k2 long, extra {_SPANS}")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return saved(_scan(docs.select(F.col(id_col).alias("id"), text.alias("__text"), *_keys(text))))


def _told(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    rows = scan(docs)
    found = rows.drop("entities", "terms").join(disclosing(docs, rows), ["k1", "k2"], "left")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPANS))))
    return found.select(F.col("id").alias("doc_id"), *(count(k) for k in range(4)), F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(every).alias("spans"))


def sanitised(text: str, extra) -> str:
    """The text without its personal data: base kinds as ``<KIND>``, disclosing terms as a class or dropped."""
    out, last = [], 0
    for s, k, e in sorted([*base_spans(text), *extra]):
        if s >= last:
            own = text[s:e]
            out += [text[last:s], f"<{KINDS[k].upper()}>" if k < 4 else "" if k == 5 else "<NUMBER>" if own.isdigit() else "<NAME>" if own[:1].isupper() else "<TERM>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts (null stays null), which meet the spans of their terms by their digests."""
    extra = saved(disclosing(docs, scan(docs, id_col, text_col), text_col)).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "extra": "__extra"})
    k1, k2 = _keys(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("__k1", k1).withColumn("__k2", k2).join(extra, ["__k1", "__k2"], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__extra")
    at = docs.columns.index(text_col)

    def run(batches):
        for b, _, _, _ in chunks(batches, text_col):
            spans = b.column(b.num_columns - 1).to_pylist()
            new = [None if t is None else sanitised(t, [(x["start"], x["kind"], x["end"]) for x in s or ()]) for t, s in zip(b.column(at).to_pylist(), spans)]
            cols = list(b.columns[:-1])
            cols[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)


def op7(spark, sf_dir):
    """Personal data of every document."""
    return find_personal(documents(spark, sf_dir))
