"""Packing by power-of-two decomposition.

A document's token ids are cut from its start into pieces of 4096, then into the binary
digits of what is left, longest first. Each piece is a sequence by itself, and sequences of
one length share a bucket: none crosses documents and none is padded. ``sequence_id`` is
(log2 of the length, partition, running number), so a bucket is a range of ids; nothing is
shuffled; ``bucket`` is that logarithm, by which ``write_buckets`` lays the sequences out. The ids follow from the
partitions of the input, which for files are the same on every run. Texts are tokenized whole, whatever their
length; equal texts give equal pieces; an empty table gives no rows and further columns of any name are left alone.

Tokens: words repeat, so a word's ids are kept in a bounded table and only new words go to
the tokenizer's model. That equals tokenizing whole texts because the tokenizer
splits at a fixed pattern before it merges; texts for which that can't be seen at once
(a special token's string, composition across code points) are tokenized whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_array

END = 2
LIMIT = 4096
WORDS_KEPT = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}


class _Words(dict):
    """Little-endian ids by word, at most WORDS_KEPT of them."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        level = word.encode().decode("latin-1").translate(self.letters)
        self[word] = raw = array("I", [t.id for t in self.model.tokenize(level)]).tobytes()
        return raw


class WordTokenizer:
    """Ids of texts as of the file's tokenizer (lower-case, words by a fixed pattern)."""

    # the file's own pattern for texts up to U+00FF, which its normaliser only lowers; U+001C to U+001F are white space to Python alone
    plain = re.compile(r"[\x00-\x1b\x20-\xff]*")
    split = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known = _Words(self.whole.model)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        get, find = self.known.__getitem__, self.split.findall
        for t in texts:
            if self.plain.fullmatch(t) and not any(s in t for s in self.specials):
                out.append(b"".join(map(get, find(t.lower()))))
            else:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the binary pieces of n tokens; ``limit`` is a power of two."""
    out = [(i, limit) for i in range(0, n - limit + 1, limit)]
    at, left = n - n % limit, n % limit
    for k in range(limit.bit_length() - 2, -1, -1):
        if left >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end: int = END, with_ids: bool = True, in_file_order: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids]) for each piece.

    Null is the empty text, of the end id alone. Every row of the input gives its own pieces,
    so repeated rows and null ids give repeated pieces with sequences of their own. ``in_file_order``: ids follow
    the names of the input's files, then their rows, in place of partitions, which Spark fills by size.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = tokenizer or tokenizer_path()
    tail = np.array([end], "<u4").tobytes()

    block = F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("__block")
    ranks: dict[int, int] = {}
    if in_file_order:  # a row for each block of a file
        found = df.select(F.input_file_name().alias("name"), F.input_file_block_start().alias("at"), block).distinct().collect()
        if all(r["name"] for r in found):
            ranks = {r["__block"]: k for k, r in enumerate(sorted(found, key=lambda r: (r["name"], r["at"])))}

    def run(batches):
        part = pyspark.TaskContext.get().partitionId()
        t, serials = word_tokenizer(path), Counter()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows, at = [], []
                own_parts = [ranks[x] for x in b.column(2).slice(i, 256).to_pylist()] if ranks else [part] * 256
                for j, raw in enumerate(t.ids(text_array(b.column(1).slice(i, 256)).to_pylist())):
                    raw += tail
                    part_of = own_parts[j]
                    for start, n in pieces(len(raw) // 4, limit):
                        own = raw[4 * start : 4 * (start + n)]
                        at.append(i + j)
                        rows.append((start, n, zlib.crc32(own), len(raw) // 4, (n.bit_length() - 1) << 57 | part_of << 34 | serials[part_of], 0, own))
                        serials[part_of] += 1
                cols = list(zip(*rows))
                out = [b.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in cols[:6])]
                out.append(pa.array([n.bit_length() - 1 for n in cols[1]], pa.int32()))
                if with_ids:
                    raw = np.frombuffer(b"".join(cols[6]), "<i4")
                    off = np.concatenate([[0], np.cumsum(cols[1])]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(off), pa.array(raw)))
                yield pa.RecordBatch.from_arrays(out, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids])
        t.known.clear()  # the worker may go on to other work

    src = df.select(id_col, text_col, *[block] * bool(ranks))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length; a batch from one folder needs no padding."""
    packed.write.partitionBy("bucket").parquet(path)
