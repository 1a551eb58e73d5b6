"""XXH64 and the near-duplicates of op5 as SQL, for DuckDB: hashes are whole numbers of 128 bits, modulo 2**64."""

from __future__ import annotations

#: The five primes of XXH64; fixed values.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
ALL = 1 << 64


def number(n: int) -> str:
    return f"{n % ALL if n != ALL else n}::UHUGEINT"


def within(e: str) -> str:
    return f"(({e}) % {number(ALL)})"


def turned(e: str, bits: int) -> str:
    """The 64 bits of e, turned left."""
    return f"((({e}) * {number(1 << bits)}) % {number(ALL)} + ({e}) // {number(1 << (64 - bits))})"


def little(x: str, at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from byte ``at`` on of a string of hexadecimal digits."""
    return "('0x' || " + " || ".join(f"substr({x}, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def round_of(acc: str, lane: str) -> str:
    return within(f"{turned(within(f'{acc} + ({lane} * {number(P2)}) % {number(ALL)}'), 31)} * {number(P1)}")


def xxh64(source: str, seed: int) -> str:
    """CTEs that end in hashed(s, h): the hash of each distinct string s of ``source``."""
    v = [seed + P1 + P2, seed + P2, seed, seed - P1]
    sums = " + ".join(turned(f"v[{i}]", bits) for i, bits in ((1, 1), (2, 7), (3, 12), (4, 18)))
    return f"""lanes AS (SELECT *, [{little("x", "8 * k", 8)} FOR k IN range(n // 8)] AS l, n // 32 AS q FROM (SELECT DISTINCT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {source}))
, stripes AS (
  SELECT *, CASE WHEN q > 0 THEN list_reduce(list_prepend([{", ".join(map(number, v))}], [l[4 * j + 1 : 4 * j + 4] FOR j IN range(q)]), lambda a, b: [{round_of("a[i]", "b[i]")} FOR i IN [1, 2, 3, 4]]) END AS v FROM lanes
)
, rounds AS (SELECT *, [{round_of(number(0), "y")} FOR y IN v] AS rv, [{round_of(number(0), "y")} FOR y IN l[4 * q + 1 :]] AS rl FROM stripes)
, begun AS (SELECT *, CASE WHEN q > 0 THEN list_reduce(list_prepend({within(sums)}, rv), lambda h, r: {within(f"xor(h, r) * {number(P1)} + {number(P4)}")}) ELSE {number(seed + P5)} END AS h0 FROM rounds)
, eights AS (SELECT *, list_reduce(list_prepend({within("h0 + n::UHUGEINT")}, rl), lambda h, r: {within(f"{turned('xor(h, r)', 27)} * {number(P1)} + {number(P4)}")}) AS h8 FROM begun)
, four AS (SELECT *, CASE WHEN n % 8 >= 4 THEN xor(h8, {within(f"{little('x', 'n // 8 * 8', 4)} * {number(P1)}")}) END AS t FROM eights)
, fours AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {within(f"{turned('t', 23)} * {number(P2)} + {number(P3)}")} ELSE h8 END AS h4 FROM four)
, ones AS (SELECT *, list_reduce(list_prepend(h4, [{within(f"{little('x', 'n - n % 4 + k', 1)} * {number(P5)}")} FOR k IN range(n % 4)]), lambda h, r: {within(f"{turned('xor(h, r)', 11)} * {number(P1)}")}) AS h FROM fours)
, mixed AS (SELECT s, {within(f"xor(h, h // {number(1 << 33)}) * {number(P2)}")} AS h FROM ones)
, twice AS (SELECT s, {within(f"xor(h, h // {number(1 << 29)}) * {number(P3)}")} AS h FROM mixed)
, hashed AS (SELECT s, xor(h, h // {number(1 << 32)})::UBIGINT AS h FROM twice)"""


def near_duplicates(word: str, size: int, seed: int, budget: int) -> str:
    """op5 over the table documents: fingerprints, links by all pairs of distinct ones, and what they reach."""
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents
), shingles AS (
  SELECT doc_id, array_to_string(w[i : i + {size - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), {xxh64("shingles", seed)}
, prints AS (
  SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN (SELECT doc_id, ({bits})::UBIGINT AS fp FROM shingles JOIN hashed USING (s) GROUP BY doc_id) USING (doc_id)
), own AS (
  SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp
), links AS (
  SELECT a.fp AS a, b.fp AS b FROM own a JOIN own b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {budget}
), reach AS (
  SELECT fp, fp AS other FROM own UNION SELECT r.fp, l.b FROM reach r JOIN links l ON l.a = r.other
), groups AS (
  SELECT r.fp, min(o.least) AS component_id FROM reach r JOIN own o ON o.fp = r.other GROUP BY r.fp
)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN groups USING (fp)
"""
