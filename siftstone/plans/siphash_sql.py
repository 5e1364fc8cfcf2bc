"""SipHash-1-3 as DuckDB SQL: an independent form of ``functions.hashing`` for checks."""

from __future__ import annotations


def _add(a: str, b: str) -> str:
    return f"(({a}::HUGEINT + {b}::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT"


def _rot(x: str, b: int) -> str:
    return f"((({x} & {(1 << (64 - b)) - 1}::UBIGINT) << {b}) | ({x} >> {64 - b}))"


def siphash(words: str, keys: str = "SELECT 0 AS perm, 0::UBIGINT AS k0, 0::UBIGINT AS k1") -> str:
    """Common table expressions, the last of them ``sip(perm, term, h)``: the hash of every ``term`` of the relation ``words``, as
    its bytes and 0xFF, under every key. They need WITH RECURSIVE; one round a step."""
    block = "('0x' || " + " || ".join(f"substr(hx, 16 * k + {15 - 2 * i}, 2)" for i in range(8)) + ")::UBIGINT"
    start = [("k0", 0x736F6D6570736575), ("k1", 0x646F72616E646F6D), ("k0", 0x6C7967656E657261), ("k1", 0x7465646279746573)]
    first = ", ".join(f"xor({k}, {c}::UBIGINT) AS v{i}" for i, (k, c) in enumerate(start))
    return f"""raw AS (SELECT term, hex(term) || 'FF' AS b, length(hex(term)) // 2 + 1 AS n FROM (SELECT DISTINCT term FROM {words})),
padded AS (SELECT term, (n // 8)::INTEGER AS last, rpad(b, ((n // 8 * 8 + 7) * 2)::INTEGER, '0') || lpad(to_hex(n % 256), 2, '0') AS hx FROM raw),
state AS (SELECT perm, term, last, hx, 0 AS k, {first} FROM padded, ({keys})
UNION ALL SELECT perm, term, last, hx, k + 1, xor(a3, m), xor({_rot("b", 17)}, c2), {_rot("c2", 32)}, xor({_rot("d", 21)}, a3) FROM (
SELECT *, {_add("a2", "d")} AS a3, {_add("c", "b")} AS c2 FROM (
SELECT *, xor({_rot("v1", 13)}, a) AS b, {_rot("a", 32)} AS a2, xor({_rot("v3", 16)}, c) AS d FROM (
SELECT *, {_add("v0", "v1")} AS a, {_add("v2", "v3")} AS c FROM (
SELECT perm, term, last, hx, k, m, v0, v1, CASE WHEN k = last + 1 THEN xor(v2, 255::UBIGINT) ELSE v2 END AS v2, xor(v3, m) AS v3 FROM (
SELECT *, CASE WHEN k <= last THEN {block} ELSE 0::UBIGINT END AS m FROM state WHERE k < last + 4)))))),
sip AS (SELECT perm, term, xor(xor(v0, v1), xor(v2, v3)) AS h FROM state WHERE k = last + 4)"""
