"""The operators' formulas as SQL, for DuckDB: what the registered queries are held against.

An encoded table is ``enc`` (row_id, support, y, x0, x1, ...). Statements are lists of named subqueries, joined by :func:`chain`.
"""

from __future__ import annotations

from foretell.models import gbm
from foretell.models.kernel import EVEN, WIDTH


def chain(*parts: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip().strip(",") for p in parts if p.strip())


def tables(key: str, source: str, features: list[str], categories: list[str], target: str) -> str:
    """enc from ``source`` (subquery with the key, the target and the features). Categories become their place among the known
    rows' sorted values; nulls their commonest code or the mean of the known rows."""
    out = [f"base AS (SELECT *, row_number() OVER (ORDER BY {key}) AS row_id, {target} IS NOT NULL AS support FROM ({source}))"]
    values = []
    for j, c in enumerate(features):
        if c in categories:
            out.append(f"v{j} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM base WHERE support AND {c} IS NOT NULL))")
            mode = f"(SELECT code FROM base JOIN v{j} ON v = {c} WHERE support GROUP BY code ORDER BY count(*) DESC, code LIMIT 1)"
            values.append(f"CAST(CASE WHEN {c} IS NULL THEN {mode} ELSE coalesce((SELECT code FROM v{j} WHERE v = {c}), (SELECT count(*) FROM v{j})) END AS DOUBLE) AS x{j}")
        else:
            values.append(f"CAST(coalesce({c}, (SELECT avg({c}) FROM base WHERE support), 0) AS DOUBLE) AS x{j}")
    out.append(f"enc AS (SELECT row_id, support, CAST({target} AS DOUBLE) AS y, {', '.join(values)} FROM base)")
    out.append("known AS (SELECT * FROM enc WHERE support), unknown AS (SELECT * FROM enc WHERE NOT support)")
    return ",\n".join(out)


def standard(support: str, nf: int, name: str = "st") -> str:
    """m and s of each feature: mean and population deviation of the support, 1 where it is 0."""
    return f"{name} AS (SELECT " + ", ".join(f"avg(x{j}) AS m{j}, CASE WHEN stddev_pop(x{j}) = 0 THEN 1 ELSE stddev_pop(x{j}) END AS s{j}" for j in range(nf)) + f" FROM {support})"


def kernel(support: str, rows: str, nf: int, name: str = "prob", p: str = "") -> str:
    """``name``(row_id, y, c, p): the kernel's probabilities over the rows of ``support`` for the rows of ``rows``."""
    d2 = " + ".join(f"pow((q.x{j} - s.x{j}) / {p}st.s{j}, 2)" for j in range(nf))
    return f"""{standard(support, nf, p + "st")}
, {p}pairs AS (SELECT q.row_id, q.y, s.y AS c, {d2} AS d2 FROM {rows} q, {support} s, {p}st)
, {p}weights AS (SELECT *, exp(-(d2 - min(d2) OVER (PARTITION BY row_id)) / (2 * {WIDTH} * {nf})) AS w FROM {p}pairs)
, {p}cls AS (SELECT DISTINCT y AS c FROM enc WHERE support)
, {p}shares AS (SELECT row_id, any_value(y) AS y, c, sum(w) AS w FROM {p}weights GROUP BY row_id, c)
, {p}totals AS (SELECT row_id, any_value(y) AS y, sum(w) AS total FROM {p}shares GROUP BY row_id)
, {name} AS (
  SELECT t.row_id, t.y, {p}cls.c, {1 - EVEN} * coalesce(sh.w, 0) / t.total + {EVEN} / (SELECT count(*) FROM {p}cls) AS p
  FROM {p}totals t CROSS JOIN {p}cls LEFT JOIN {p}shares sh ON sh.row_id = t.row_id AND sh.c = {p}cls.c
)"""


def trust(nf: int) -> str:
    """trust(row_id, trust, ood) of the unknown rows, by the distances to the known ones; needs ``st``."""
    z = ", ".join(f"(x{j} - m{j}) / s{j} AS z{j}" for j in range(nf))
    d2 = " + ".join(f"pow(a.z{j} - b.z{j}, 2)" for j in range(nf))
    return f"""apart AS (SELECT row_id, support, {z} FROM enc, st)
, dist AS (SELECT a.row_id, a.support, sqrt({d2}) AS d FROM apart a JOIN apart b ON b.support AND a.row_id <> b.row_id)
, near AS (
  SELECT row_id, support, avg(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d) AS r FROM dist)
  WHERE r <= (SELECT least(greatest(count(*) - 1, 1), 5) FROM known) GROUP BY row_id, support
)
, ref AS (SELECT avg(d) AS mu, greatest(stddev_pop(d), 1e-9) AS sigma, max(d) AS most FROM near WHERE support)
, trust AS (
  SELECT row_id, least(greatest(1 - greatest((d - mu) / sigma / 2, 0), 0), 1) AS trust, d > most OR (d - mu) / sigma > 2 AS ood
  FROM near, ref WHERE NOT support
)"""


def features(nf: int, table: str, name: str) -> str:
    """``name``(row_id, j, x): a table's features in rows."""
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT row_id, {j} AS j, x{j} AS x FROM {table}" for j in range(nf)) + ")"


def boosted(known: str, nf: int, p: str = "") -> str:
    """The boosted trees over the rows of ``known``, step for step as in models/gbm.py: each round of the recursion settles one
    level of a tree. Gives {p}unit, {p}mid, {p}splits and {p}leaves."""
    one, rounds = f"{gbm.ONE!r}::DOUBLE", gbm.TREES * gbm.DEPTH
    term = lambda s, n: f"floor(({s}) * ({s}) / ({n} + {gbm.L2}::DOUBLE) / {one})"
    return f"""{features(nf, known, p + "f")}
, {p}unit AS (SELECT CASE WHEN max(abs(y)) = 0 THEN 1 ELSE max(abs(y)) / {one} END AS u FROM {known})
, {p}start AS (SELECT row_id, floor(y / u + 0.5::DOUBLE) AS q FROM {known}, {p}unit)
, {p}mid AS (SELECT floor(sum(q) / count(*) + 0.5::DOUBLE) AS b FROM {p}start)
, {p}vals AS (SELECT j, x, row_number() OVER (PARTITION BY j ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY j) AS d FROM (SELECT DISTINCT j, x FROM {p}f))
, {p}cuts AS (
  SELECT b.j, n.i, (a.x + b.x) / 2 AS cut FROM (SELECT j, d, unnest(range(1, least(d, {gbm.BINS}))) AS i FROM (SELECT DISTINCT j, d FROM {p}vals)) n
  JOIN {p}vals b ON b.j = n.j AND b.k = n.i * n.d // least(n.d, {gbm.BINS}) JOIN {p}vals a ON a.j = b.j AND a.k = b.k - 1
)
, {p}beyond AS (SELECT f.row_id, c.j, c.i FROM {p}f f JOIN {p}cuts c ON f.j = c.j AND f.x > c.cut)
, {p}grow AS (
  SELECT 0 AS it, row_id, q - b AS r, 1 AS node, 0 AS was, NULL::INT AS j, NULL::DOUBLE AS cut, 0 AS leaf, 0::DOUBLE AS v FROM {p}start, {p}mid
  UNION ALL
  SELECT it + 1, row_id, CASE WHEN (it + 1) % {gbm.DEPTH} = 0 THEN r - v2 ELSE r END, CASE WHEN (it + 1) % {gbm.DEPTH} = 0 THEN 1 ELSE node2 END, node, j, cut, node2, v2
  FROM (
    SELECT *, floor({gbm.RATE}::DOUBLE * sum(r) OVER (PARTITION BY node2) / (count(*) OVER (PARTITION BY node2) + {gbm.L2}::DOUBLE) + 0.5::DOUBLE) AS v2
    FROM (
      SELECT g.it, g.row_id, g.r, g.node, best.j, best.cut, 2 * g.node + CASE WHEN f.x > best.cut THEN 1 ELSE 0 END AS node2
      FROM {p}grow g LEFT JOIN (
        WITH totals AS (SELECT node, sum(r) AS s, count(*) AS n FROM {p}grow GROUP BY node)
        , parts AS (SELECT node, c.j, c.i, sum(r) AS rs, count(*) AS rn FROM {p}grow JOIN {p}beyond c USING (row_id) GROUP BY node, c.j, c.i)
        , scored AS (
          SELECT node, j, i, rn, {term("rs", "rn")} + {term("s - rs", "(n - rn)")} AS gain, {term("s", "n")} AS none
          FROM parts JOIN totals USING (node) WHERE rn >= {gbm.MIN_LEAF} AND n - rn >= {gbm.MIN_LEAF}
        )
        , top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, i) AS place FROM scored WHERE gain > none) WHERE place = 1)
        SELECT t.node, t.j, (min(c.cut) + max(c.cut)) / 2 AS cut
        FROM top t JOIN scored s ON s.node = t.node AND s.j = t.j AND s.rn = t.rn JOIN {p}cuts c ON c.j = s.j AND c.i = s.i GROUP BY t.node, t.j
      ) best ON best.node = g.node LEFT JOIN {p}f f ON f.row_id = g.row_id AND f.j = best.j
    )
  ) WHERE it < {rounds}
)
, {p}splits AS (SELECT DISTINCT (it - 1) // {gbm.DEPTH} AS tree, was AS node, j, cut FROM {p}grow WHERE it > 0 AND j IS NOT NULL)
, {p}leaves AS (SELECT DISTINCT (it - 1) // {gbm.DEPTH} AS tree, leaf AS node, v FROM {p}grow WHERE it > 0 AND it % {gbm.DEPTH} = 0)"""


def boosted_values(rows: str, nf: int, name: str, p: str = "") -> str:
    """``name``(row_id, value): what the trees of prefix ``p`` say about the rows of ``rows``."""
    out = [features(nf, rows, name + "_f"), f"{name}_0 AS (SELECT row_id, tree, 1 AS node FROM {rows}, (SELECT unnest(range({gbm.TREES})) AS tree))"]
    for k in range(gbm.DEPTH):
        out.append(
            f"{name}_{k + 1} AS (SELECT n.row_id, n.tree, 2 * n.node + CASE WHEN f.x > s.cut THEN 1 ELSE 0 END AS node FROM {name}_{k} n"
            f" LEFT JOIN {p}splits s ON s.tree = n.tree AND s.node = n.node LEFT JOIN {name}_f f ON f.row_id = n.row_id AND f.j = s.j)"
        )
    out.append(f"{name} AS (SELECT row_id, (any_value(b) + sum(coalesce(v, 0))) * any_value(u) AS value FROM {name}_{gbm.DEPTH} LEFT JOIN {p}leaves USING (tree, node), {p}mid, {p}unit GROUP BY row_id)")
    return ",\n".join(out)


def decimals(table: str, column: str) -> str:
    """Least number of decimals, up to six, that shows all values of a column."""
    eps = f"greatest(abs({column}) * 1e-9, 1e-9)"
    cases = " ".join(f"WHEN abs({rounded(column, str(d))} - {column}) <= {eps} THEN {d}" for d in range(6))
    return f"(SELECT coalesce(max(CASE {cases} ELSE 6 END), 0) FROM {table})"


def rounded(value: str, places: str) -> str:
    """Halves away from zero."""
    return f"(sign({value}) * floor(abs({value}) * pow(10::DOUBLE, {places}) + 0.5::DOUBLE) / pow(10::DOUBLE, {places}))"


def kmeans(source: str, d: int, k: int, rounds: int, draws: list[float]) -> str:
    """label(g, row_id, label) of the rows of ``source`` (g, row_id, j, x: a group, and the d features in rows), each group by
    itself: standardised, sorted by value, seeded by the fixed draws, then rounds in a recursion."""
    order = ", ".join(f"max(z) FILTER (j = {j})" for j in range(d))
    out = [f"""points AS (SELECT g, row_id, j, CAST(x AS DOUBLE) AS x FROM ({source}))
, moments AS (SELECT g, j, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 OR min(x) = max(x) THEN 1 ELSE stddev_pop(x) END AS s FROM points GROUP BY g, j)
, scaled AS (SELECT g, row_id, j, (x - m) / s AS z FROM points JOIN moments USING (g, j))
, place AS (SELECT g, row_id, row_number() OVER (PARTITION BY g ORDER BY {order}, row_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM scaled GROUP BY g, row_id)"""]
    out.append(f"zs AS (SELECT g, pos, n, j, z FROM scaled JOIN place USING (g, row_id)), c0 AS (SELECT g, 0 AS c, j, z FROM zs WHERE pos = CAST(floor({draws[0]!r}::DOUBLE * n) AS BIGINT) % n)")
    for i in range(1, k):
        out.append(f"""near{i} AS (SELECT g, pos, min(d2) AS w FROM (SELECT a.g, a.pos, b.c, sum(pow(a.z - b.z, 2)) AS d2 FROM zs a JOIN c{i - 1} b ON a.g = b.g AND a.j = b.j GROUP BY a.g, a.pos, b.c) GROUP BY g, pos)
, run{i} AS (SELECT g, pos, sum(w) OVER (PARTITION BY g ORDER BY pos) AS run, sum(w) OVER (PARTITION BY g) AS total FROM near{i})
, pick{i} AS (SELECT g, min(pos) AS pos FROM run{i} WHERE run >= {draws[i]!r}::DOUBLE * total GROUP BY g)
, c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT zs.g, {i}, zs.j, zs.z FROM zs JOIN pick{i} USING (g, pos))""")
    label = "SELECT g, pos, arg_min(c, (d2, c)) AS label FROM (SELECT a.g, a.pos, b.c, sum(pow(a.z - b.z, 2)) AS d2 FROM zs a JOIN {0} b ON a.g = b.g AND a.j = b.j GROUP BY a.g, a.pos, b.c) GROUP BY g, pos"
    out.append(f"""rounds AS (
  SELECT 0 AS it, g, c, j, z FROM c{k - 1}
  UNION ALL
  SELECT old.it + 1, old.g, old.c, old.j, coalesce(new.z, old.z)
  FROM rounds old LEFT JOIN (SELECT l.g, l.label AS c, zs.j, avg(zs.z) AS z FROM ({label.format("rounds")}) l JOIN zs USING (g, pos) GROUP BY l.g, l.label, zs.j) new ON new.g = old.g AND new.c = old.c AND new.j = old.j
  WHERE old.it < {rounds}
)
, centres AS (SELECT g, c, j, z FROM rounds WHERE it = {rounds})
, label AS (SELECT l.g, row_id, CAST(label AS INT) AS label FROM ({label.format("centres")}) l JOIN place USING (g, pos))""")
    return ",\n".join(out)
