"""Artifacts by kind, exact content and arguments, as Parquet directories with a JSON manifest each."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


def content(df: DataFrame) -> tuple[str, int]:
    """A digest of the rows as a multiset, and their number: sum, xor and count of row hashes; order doesn't matter, edits do."""
    h = F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema])
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r.n}|{r.s}|{r.x}".encode()).hexdigest()[:32], r.n


def content_hash(df: DataFrame) -> str:
    return content(df)[0]


def args_hash(args: dict) -> str:
    return hashlib.sha256(json.dumps(args, sort_keys=True).encode()).hexdigest()[:16]


class Cache:
    """Artifacts below a folder of any file system that Spark reaches."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path.rstrip("/"), spark or SparkSession.getActiveSession()
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _at(self, *names: str):
        return self._path("/".join([self.path, *names]))

    def _manifests(self) -> list[dict]:
        """All manifests, one a folder; a folder without one isn't finished."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at())]
        out = []
        for name in names:
            if self._fs.exists(self._at(name, "manifest.json")):
                stream = self._fs.open(self._at(name, "manifest.json"))
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"dir": name})
                stream.close()
        return sorted(out, key=lambda m: (-m["created_at"], m["dir"]))

    def _find(self, kind: str, content: str, args: dict) -> dict | None:
        key = (kind, content, args_hash(args), VERSION)
        return next((m for m in self._manifests() if (m["kind"], m["content_hash"], m["args_hash"], m["version"]) == key), None)

    def get(self, spark, kind: str, content: str, args: dict, row_count: int | None = None) -> DataFrame | None:
        m = self._find(kind, content, args)
        if m is None or row_count not in (None, m["row_count"]):
            return None
        return spark.read.parquet(f"{self.path}/{m['dir']}/data")

    def put(self, df: DataFrame, kind: str, content: str, args: dict, row_count: int) -> DataFrame:
        """Writes the data, then its manifest, then drops what it replaces."""
        old = [m for m in self._manifests() if (m["kind"], m["content_hash"], m["args_hash"]) == (kind, content, args_hash(args))]
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}/data")
        meta = {"kind": kind, "content_hash": content, "args_hash": args_hash(args), "row_count": row_count, "version": VERSION, "created_at": time.time()}
        stream = self._fs.create(self._at(name, "manifest.tmp"))
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()
        self._fs.rename(self._at(name, "manifest.tmp"), self._at(name, "manifest.json"))
        for m in old:
            self._fs.delete(self._at(m["dir"]), True)
        return df.sparkSession.read.parquet(f"{self.path}/{name}/data")

    def cached(self, df: DataFrame, kind: str, args: dict, make) -> DataFrame:
        """``make(df)``, kept for the same content and arguments."""
        digest, n = content(df)
        found = self.get(df.sparkSession, kind, digest, args, n)
        return self.put(make(df), kind, digest, args, n) if found is None else found

    def _size(self, *names: str) -> int:
        return self._fs.getContentSummary(self._at(*names)).getLength()

    def info(self) -> dict:
        arts = [{k: v for k, v in m.items() if k != "dir"} | {"payload_bytes": self._size(m["dir"], "data")} for m in self._manifests()]
        return {"path": self.path, "size_bytes": self._size(), "total": len(arts), "artifacts": arts}

    def clear(self, kind: str | None = None) -> dict:
        gone = [m for m in self._manifests() if kind in (None, m["kind"])]
        for m in gone:
            self._fs.delete(self._at(m["dir"]), True)
        return {"path": self.path, "deleted": len(gone), "kind": kind or "all"}
