"""URL normalisation: an expression for common shapes, a UDF for the others."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKING = ("_ga", "_gl", "dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid", "ref", "s", "si", "source", "twclid", "yclid")
#: http(s) in lower case, plain host, no port, no escapes, no dot segments; then the expression is enough.
PLAIN = r"^https?://[a-z0-9-]+(\.[a-z0-9-]*[a-z][a-z0-9-]*)+(/[A-Za-z0-9_~,;:@!$&'()*+=/-]*(\.[A-Za-z0-9_~-][A-Za-z0-9._~-]*)?)?(\?[A-Za-z0-9_.~&=-]*)?(#.*)?$"
_HOST = re.compile(r"[^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+\Z")


def _tracks(key: str) -> bool:
    return key.lower().startswith("utm_") or key.lower() in TRACKING


def _path(p: str) -> str:
    out: list[str] = []
    parts = p.replace("\\", "/").split("/")[1:]
    for i, x in enumerate(parts):
        dots = x.lower().replace("%2e", ".")
        if dots == "..":
            out = out[:-1]
        elif dots != ".":
            out.append(quote(x, safe="!$%&'()*+,-./:;=@_~|[]^\\"))
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def normalize_url(url: str | None) -> str | None:
    """None if the text isn't a URL."""
    url = (url or "").strip()
    if not url:
        return None
    if "://" not in url:
        url = "https://" + url
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2,}([^/?#\\]*)([^?#]*)(?:\?([^#]*))?", url)
    if not m:
        return None
    scheme, authority, path, query = m[1].lower(), m[2], m[3], m[4]
    user, _, host = authority.rpartition("@")
    name, port = re.match(r"(.*?)(?::(\d*))?\Z", host, re.S).groups()
    if port and int(port) > 65535:
        return None
    if not (name.startswith("[") and name.endswith("]")):
        name = unquote(name)
        if not _HOST.match(name):
            return None
        try:
            name = name.lower() if name.isascii() else name.encode("idna").decode().lower()
        except UnicodeError:
            return None
    port = "" if not port or int(port) in (80, 443) else f":{int(port)}"
    out = f"{scheme}://{user + '@' if user else ''}{name}{port}{_path(path or '/')}"
    pairs = [(k, v) for k, v in parse_qsl(query or "", keep_blank_values=True) if not _tracks(k)]
    if pairs:
        out += "?" + "&".join(k if not v else f"{k}={v}" for k, v in sorted(pairs, key=lambda p: p[0]))
    return out.rstrip("/").replace("://www.", "://", 1)


def report(url: str) -> dict:
    """The URL, its normal form and its key; not a URL is an error."""
    normal = normalize_url(url)
    if normal is None:
        raise ValueError("Could not parse URL")
    return {"original": url, "normalized": normal, "canonical_key": re.sub("^https?://", "", normal)}


@F.pandas_udf(T.StringType())
def _udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_url)


def _expression(u: Column) -> Column:
    u = F.regexp_replace(u, "#.*$", "")
    base = F.substring_index(u, "?", 1)
    base = F.when(base.rlike("^https?://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    query = F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"\?(.*)$", 1)).otherwise(F.lit(""))
    key = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(key(p)).startswith("utm_") & ~F.lower(key(p)).isin(list(TRACKING)))
    # stable by key: the place breaks ties
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), F.regexp_replace(p, "=$", "").alias("p"))))
    params = F.array_join(F.transform(placed, lambda s: s["p"]), "&")
    out = F.when(params == "", base).otherwise(F.concat_ws("?", base, params))
    return F.regexp_replace(F.regexp_replace(out, "/+$", ""), r"^(https?://)www\.", "$1")


def normalized(c) -> Column:
    """Column form; null if the text isn't a URL. Common shapes stay in the JVM, the others go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    odd = F.when(~t.rlike(PLAIN), t)
    return F.when(t.rlike(PLAIN), _expression(t)).otherwise(_udf(odd))


def canonical_key(c) -> Column:
    """The normalised URL without its scheme."""
    return F.regexp_replace(F.regexp_replace(normalized(c), "^https://", ""), "^http://", "")
