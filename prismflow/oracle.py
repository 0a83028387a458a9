"""DuckDB SQL for the registered queries."""

from __future__ import annotations

STEP = "(70.0::DOUBLE / 4500)"
_E = "e AS (SELECT vec_id, label, vec_id % 2 AS domain, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_OUT = "SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(v[p], 6) + 0.0 AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS p FROM t)"
_L1 = """l1 AS (SELECT vec_id, label, CASE WHEN s = 0 THEN list_transform(c, lambda x: 1.0::DOUBLE / len(c)) ELSE list_transform(c, lambda x: x / s) END AS v
  FROM (SELECT vec_id, label, c, list_sum(c) AS s FROM (SELECT vec_id, label, list_transform(v, lambda x: greatest(x, 0.0)) AS c FROM e)))"""
_LONG1 = "cdf AS (SELECT vec_id, p, sum(x) OVER (PARTITION BY vec_id ORDER BY p) AS c FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS p FROM l1))"
_CUM = "cum AS (SELECT vec_id, list(c ORDER BY p) AS c FROM cdf GROUP BY vec_id)"
_D = f"d AS (SELECT a.vec_id AS i, b.vec_id AS j, {STEP} * list_sum(list_transform(list_zip(a.c, b.c), lambda z: abs(z[1] - z[2]))) AS d FROM cum a JOIN cum b ON a.vec_id < b.vec_id)"
_PAIR = "pair AS (SELECT i, j, d, a.label AS li, b.label AS lj FROM d JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j)"
_BOTH = "both_ways AS (SELECT i, j, d, li, lj FROM pair UNION ALL SELECT j, i, d, lj, li FROM pair)"
_DIST = f"WITH {_E}, {_L1}, {_LONG1}, {_CUM}, {_D}, {_PAIR}, {_BOTH}"
_OWN = """own AS (SELECT e.label, count(*) AS n, coalesce(any_value(s), 0) AS s, coalesce(any_value(s_std), 0) AS s_std
  FROM embeddings e LEFT JOIN (SELECT li, avg(d) AS s, stddev_pop(d) AS s_std FROM pair WHERE li = lj GROUP BY li) w ON w.li = e.label GROUP BY e.label)"""
_OUTER = "outer_ AS (SELECT li AS label, avg(d) AS o, stddev_pop(d) AS o_std FROM both_ways WHERE li <> lj GROUP BY li)"
_MED = """med AS (SELECT label, arg_min(vec_id, (s, vec_id)) AS medoid FROM (
  SELECT e.label, e.vec_id, round(coalesce(sum(d) FILTER (li = lj), 0), 9) AS s FROM embeddings e LEFT JOIN both_ways b ON b.i = e.vec_id GROUP BY e.label, e.vec_id) GROUP BY label)"""
_NAME = "(CASE WHEN vec_id % 2 = 0 THEN 'V' ELSE 'v' END || lpad(CAST(vec_id AS VARCHAR), 8, '0'))"
_LONG = f"""{_E}, raw AS (SELECT vec_id, label, domain, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM e),
  st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM raw GROUP BY pos),
  long AS (SELECT vec_id, label, domain, raw.pos, (x - m) / (s + 1e-8) AS x FROM raw JOIN st ON raw.pos = st.pos)"""
_W1 = """sz AS (SELECT label, pos, count(*) FILTER (domain = 0) AS n0, count(*) FILTER (domain = 1) AS n1 FROM long GROUP BY ALL HAVING n0 > 0 AND n1 > 0),
  stp AS (SELECT label, pos, x, count(*) FILTER (domain = 0) AS c0, count(*) FILTER (domain = 1) AS c1 FROM long GROUP BY ALL),
  w1 AS (SELECT label, pos, coalesce(sum(area), 0) AS w1 FROM (
    SELECT label, pos, abs(sum(c0) OVER w / n0 - sum(c1) OVER w / n1) * (lead(x) OVER (PARTITION BY label, pos ORDER BY x) - x) AS area
    FROM stp JOIN sz USING (label, pos) WINDOW w AS (PARTITION BY label, pos ORDER BY x ROWS UNBOUNDED PRECEDING)) GROUP BY label, pos)"""
_RADIUS = """cen AS (SELECT label, domain, pos, avg(x) AS c FROM long GROUP BY ALL),
  rad AS (SELECT label, domain, count(*) AS n, avg(r) AS radius FROM (
    SELECT l.label, l.domain, l.vec_id, sqrt(sum((x - c) * (x - c))) AS r FROM long l JOIN cen c ON l.label = c.label AND l.domain = c.domain AND l.pos = c.pos GROUP BY ALL) GROUP BY label, domain)"""
_SHIFT = f"""WITH {_LONG}, {_W1}, {_RADIUS}, sh AS (
  SELECT m.label, a.n AS n_source, b.n AS n_target, f AS feature_shift, a.radius AS r_source, b.radius AS r_target, f / (f + 0.5 * (a.radius + b.radius) + 1e-8) AS shift_score
  FROM (SELECT label, sqrt(sum(w1 * w1)) AS f FROM w1 GROUP BY label) m JOIN rad a ON a.label = m.label AND a.domain = 0 JOIN rad b ON b.label = m.label AND b.domain = 1)"""
_LOGIT = f"""WITH {_E}, raw AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM e),
  cen AS (SELECT label AS class, pos, avg(x) AS c FROM raw GROUP BY ALL),
  logit AS (SELECT vec_id, label, class, sum(x * c) AS logit FROM raw JOIN cen USING (pos) GROUP BY ALL)"""
_TOP = """pr AS (SELECT vec_id, label, class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, label, class, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM logit)),
  top AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, class) AS INTEGER) AS rank FROM pr)"""
_PRED = f"{_LOGIT}, {_TOP}, pred AS (SELECT vec_id, label, class AS predicted, vec_id % 2 AS domain FROM top WHERE rank = 1)"
_RUNS = "runs AS (SELECT event_id // 500 AS round, user_id % 10 AS seed, avg(value) AS acc, max(value) AS f1 FROM events GROUP BY ALL)"
_KEY = """k AS (SELECT p_partkey, p_size, (['Ba2','Ca','Sr','La2'])[p_partkey % 4 + 1] || (['Ti','Nb','Mg'])[p_size % 3 + 1] || 'O3|' || p_size AS key FROM part),
  el AS (SELECT *, list_filter(regexp_extract_all(split_part(key, '|', 1), '[A-Z][a-z]?'), lambda x: true) AS els FROM k)"""
_SPLIT = "CASE WHEN rank <= floor(n * 0.8) THEN 'train' WHEN rank <= floor(n * 0.9) THEN 'val' ELSE 'test' END"
_WIDTH = "(0.5 * degrees(0.9 * 0.154184 / (cos(radians({a} / 2)) * {d})))"
_MAXCELL = f"CAST(least(4500, greatest(0, ceil(({{a}} - 10.0::DOUBLE) / {STEP} - 0.5))) AS INTEGER)"
_SNAP = f"(10.0::DOUBLE + {_MAXCELL} * {STEP})"
_STRAT = "strat AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7-' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 15)"
_FACTOR = "(1 / (2 * ln(2)))"
_PEAKS = f"pk AS (SELECT p_brand AS pattern, 10 + (p_partkey * 7919) % 7000 / 100 AS a, p_size::DOUBLE AS intensity FROM part), pks AS (SELECT *, sqrt{_FACTOR} * {_WIDTH.format(a=_SNAP.format(a='a'), d='25.0')} / (70.0::DOUBLE / 4501) AS s FROM pk)"
_CLASS = """CASE WHEN sg BETWEEN 195 AND 230 THEN 'cubic' WHEN sg BETWEEN 16 AND 75 THEN 'orthorhombic' WHEN sg BETWEEN 3 AND 15 THEN 'monoclinic' WHEN sg <= 2 THEN 'triclinic'
  WHEN sg BETWEEN 76 AND 82 OR sg BETWEEN 143 AND 148 OR sg BETWEEN 168 AND 174 THEN 'low-sym hexagonal/tetragonal' ELSE 'high-sym hexagonal/tetragonal' END"""


def _pick(seed: str, key: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}-' || {key}), 1, 8) AS BIGINT) % {n})"


_ROWS = {
    "cubic": ("s11", "0", "0", "0", "s11", "0", "0", "0", "s11"),
    "high-sym hexagonal/tetragonal": ("s11", "0", "0", "0", "s11", "0", "0", "0", "s33"),
    "low-sym hexagonal/tetragonal": ("s11", "s12", "0", "-s12", "s22", "0", "0", "0", "s33"),
    "orthorhombic": ("s11", "0", "0", "0", "s22", "0", "0", "0", "s33"),
    "monoclinic": ("s11", "0", "0", "0", "s22", "s23", "0", "s23", "s33"),
    "triclinic": ("s11", "s12", "s13", "s21", "s22", "s23", "s31", "s32", "s33"),
}
_SG = "g AS (SELECT p_partkey, p_size, CAST(p_partkey % 230 + 1 AS INTEGER) AS sg FROM part)"


def _tensor(symmetry: str, value) -> str:
    """3 x 3 entries in a list by symmetry class; ``value`` gives the SQL of an entry by its name."""
    cell = lambda x: "0.0" if x == "0" else f"-({value(x[1:])})" if x[0] == "-" else f"({value(x)})"
    return f"CASE {symmetry} " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(cell, v))}]" for k, v in _ROWS.items()) + " END"


def _strain() -> str:
    return f"""WITH {_SG}, c AS (SELECT p_partkey, {_CLASS} AS c FROM g), t AS (SELECT p_partkey, {_tensor('c', lambda n: f"{_pick(n, 'p_partkey', 100)} / 1000.0::DOUBLE")} AS t FROM c)
SELECT p_partkey, CAST(k // 3 AS INTEGER) AS i, CAST(k % 3 AS INTEGER) AS j, round(4.0 * (t[k + 1] + CASE WHEN k // 3 = k % 3 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS x FROM t, range(0, 9) r(k)"""


def _bragg(m: str, h: str, k: str, l: str) -> str:
    """Scattering angle of a reflection of a cell given as a list of nine numbers."""
    at = lambda i, j: f"{m}[{3 * i + j + 1}]"
    cross = lambda a, b: [f"({at(a, (x + 1) % 3)} * {at(b, (x + 2) % 3)} - {at(a, (x + 2) % 3)} * {at(b, (x + 1) % 3)})" for x in range(3)]
    bc, ca, ab = cross(1, 2), cross(2, 0), cross(0, 1)
    volume = "(" + " + ".join(f"{at(0, x)} * {bc[x]}" for x in range(3)) + ")"
    q = [f"(({h} * {bc[x]} + {k} * {ca[x]} + {l} * {ab[x]}) / {volume})" for x in range(3)]
    return f"2 * degrees(asin(0.77092::DOUBLE * sqrt({' + '.join(f'{x} * {x}' for x in q)})))"


def _augment() -> str:
    key = "pattern || '-' || e || '-0'"
    share = lambda what, n: f"({_pick(f'7-{what}', key, n)} / {n - 1}.0::DOUBLE)"
    entry = lambda n: f"0.03::DOUBLE * (2 * {share(n, 1000)} - 1)"
    moved = "[" + ", ".join(f"l[{3 * (k // 3) + 1}] * (t[{k % 3 + 1}] + {float(k % 3 == 0)}) + l[{3 * (k // 3) + 2}] * (t[{k % 3 + 4}] + {float(k % 3 == 1)}) + l[{3 * (k // 3) + 3}] * (t[{k % 3 + 7}] + {float(k % 3 == 2)})" for k in range(9)) + "]"
    dot = " + ".join(f"{x} * (bits // {2**i} % 2)" for i, x in enumerate("hkl"))
    ones = " + ".join(f"bits // {2**i} % 2" for i in range(3))
    has = lambda *e: f"e IN ({', '.join(repr(x) for x in (*e, 'mixed'))})"
    width = _WIDTH.format(a=_SNAP.format(a="a2"), d="dom")
    return f"""WITH b AS (SELECT p_brand AS pattern, p_size::DOUBLE AS y, p_partkey % 3 + 1 AS h, p_partkey % 4 AS k, p_size % 3 AS l_, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) // 10 AS d1, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 10 AS d2 FROM part),
c AS (SELECT pattern, y, h, k, l_, [4.0 + 0.2::DOUBLE * d1, 0.0, 0.0, 0.0, 4.5 + 0.2::DOUBLE * d2, 0.0, 0.0, 0.0, 5.0] AS l, d1 * 10 + d2 AS sg FROM b),
f AS (SELECT *, {_CLASS} AS sym FROM c, (VALUES ('strain'), ('shift'), ('broadening'), ('texture'), ('impurity'), ('mixed')) v(e)),
m AS (SELECT *, {_pick('7-texture', key, 1 << 32)} % 7 + 1 AS bits, {_tensor('sym', entry)} AS t FROM f),
s AS (SELECT *, {moved} AS w FROM m),
a AS (SELECT *, CASE WHEN {has('strain')} THEN {_bragg('w', 'h', 'k', 'l_')} ELSE {_bragg('l', 'h', 'k', 'l_')} END + CASE WHEN {has('shift')} THEN 0.5 * (2 * {share('shift', 1000)} - 1) ELSE 0.0 END AS a2,
  y * CASE WHEN {has('texture')} THEN 0.5 + 0.5 * abs(({dot.replace(' l ', ' l_ ').replace('l *', 'l_ *')}) / (sqrt(h * h + k * k + l_ * l_) * sqrt({ones}))) ELSE 1.0 END AS y2,
  CASE WHEN e = 'shift' THEN 20.0 WHEN {has('broadening')} THEN 5 + 25 * {share('domain', 100)} ELSE 25.0 END AS dom FROM s)
SELECT pattern || '|' || e || '|0' AS pattern, count(*) AS n, round(sum(a2), 4) AS angles, round(sum(y2), 4) AS intensities,
  round(avg(CASE WHEN e IN ('strain', 'texture') THEN sqrt({_FACTOR} * {width}) ELSE sqrt{_FACTOR} * {width} END / (70.0::DOUBLE / 4501)), 4) AS sigma FROM a GROUP BY pattern, e"""


def _gauss(seed: str, key: str) -> str:
    part = lambda at: f"((CAST('0x' || substr(md5('{seed}-' || {key}), {at}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2 * ln({part(1)})) * cos(2 * pi() * {part(9)}))"


def _formula(scale: int) -> str:
    """Elements and counts of the formula of every part, from the numbers that it is written with."""
    return f"""f AS (SELECT p_partkey, (['Ba','Ca','K'])[p_partkey % 3 + 1] AS ea, (p_size * {scale}) % 120000 + 1 AS na, (['Ti','Mg','Sr'])[p_size % 3 + 1] AS eb, (p_partkey % 5 + 1) * (p_size % 3 + 1) AS nb,
  (['Fe','La','S'])[(p_partkey + p_size) % 3 + 1] AS ec, (p_partkey % 3 + 1) * (p_partkey % 4 + 1) * (p_size % 3 + 1) AS nc, 'O' AS eo, (p_size % 7 + 1) * (p_partkey % 4 + 1) * (p_size % 3 + 1) AS no FROM part),
  parts AS (SELECT p_partkey, unnest([ea, eb, ec, eo]) AS element, unnest([na, nb, nc, no]) AS n, eb = 'Ti' OR ec IN ('Fe', 'S') AS several FROM f)"""


_EVEN = lambda s: f"(n // {s} + CASE WHEN n % {s} > {s // 2} OR (n % {s} = {s // 2} AND n // {s} % 2 = 1) THEN 1 ELSE 0 END) * {s}"
_REDUCED = f"""big AS (SELECT p_partkey, element, several, CASE WHEN NOT several THEN n WHEN n > 100000 THEN {_EVEN(1000)} WHEN n > 10000 THEN {_EVEN(100)} WHEN n > 1000 THEN {_EVEN(10)} ELSE n END AS n FROM parts),
  divisor AS (SELECT p_partkey, max(d) AS d FROM (SELECT p_partkey, d FROM (SELECT DISTINCT p_partkey, unnest(range(1, least_n + 1)) AS d FROM (SELECT p_partkey, min(n) AS least_n FROM big GROUP BY p_partkey)) JOIN big USING (p_partkey) GROUP BY p_partkey, d HAVING bool_and(n % d = 0)) GROUP BY p_partkey),
  reduced AS (SELECT p_partkey, element, CAST(CASE WHEN several THEN n // d ELSE n END AS INTEGER) AS n FROM big JOIN divisor USING (p_partkey))"""
_STATES = "st(element, place, s) AS (VALUES ('Ba', 1, 2), ('Ca', 1, 2), ('K', 1, 1), ('Ti', 1, 4), ('Ti', 2, 3), ('Mg', 1, 2), ('Sr', 1, 2), ('Fe', 1, 2), ('Fe', 2, 3), ('La', 1, 3), ('S', 1, 6), ('S', 2, 4), ('O', 1, -2))"
_NEUTRAL = f"""WITH {_formula(1)}, {_REDUCED}, {_STATES},
first AS (SELECT p_partkey, sum(n * s) AS total FROM reduced JOIN st USING (element) WHERE place = 1 GROUP BY p_partkey),
mixing AS (SELECT r.p_partkey FROM reduced r JOIN st a ON a.element = r.element AND a.place = 1 JOIN st b ON b.element = r.element AND b.place = 2 JOIN first USING (p_partkey), range(0, 2000) q(k)
  WHERE k <= n AND total - n * a.s + (n - k) * a.s + k * b.s = 0),
whole AS (SELECT p.p_partkey FROM f p JOIN reduced ra ON ra.p_partkey = p.p_partkey AND ra.element = ea JOIN reduced rb ON rb.p_partkey = p.p_partkey AND rb.element = eb JOIN reduced rc ON rc.p_partkey = p.p_partkey AND rc.element = ec
  JOIN reduced ro ON ro.p_partkey = p.p_partkey AND ro.element = 'O' JOIN st sa ON sa.element = ea JOIN st sb ON sb.element = eb JOIN st sc ON sc.element = ec WHERE ra.n * sa.s + rb.n * sb.s + rc.n * sc.s - 2 * ro.n = 0)
SELECT DISTINCT p_partkey AS id FROM (SELECT * FROM mixing UNION ALL SELECT * FROM whole)"""


ORACLE: dict[str, str] = {
    "l1_normalize": f"WITH {_E}, {_L1}, t AS (SELECT vec_id, v FROM l1) {_OUT}",
    "l2_normalize": f"WITH {_E}, t AS (SELECT vec_id, list_transform(v, lambda x: x / s) AS v FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS s FROM e)) {_OUT}",
    "max_normalize": f"WITH {_E}, t AS (SELECT vec_id, list_transform(v, lambda x: 100 * x / s) AS v FROM (SELECT vec_id, v, list_max(v) AS s FROM e)) {_OUT}",
    "onehot": "SELECT vec_id, label AS back, CAST(c AS INTEGER) AS class, CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM embeddings, range(0, 10) t(c)",
    "standardize": f"WITH {_LONG} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x FROM long",
    "pairwise_w1": f"{_DIST} SELECT i, j, round(d, 6) + 0.0 AS d FROM d",
    "matrix_repair": """WITH m AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, CASE WHEN (i * j) % 7 = 3 OR (i + j) % 11 = 5 THEN NULL ELSE (i * 31 + j * 17) % 50 + 0.5::DOUBLE END AS d FROM supplier a, supplier b),
f AS (SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE coalesce(d, (SELECT 10 * max(d) FROM m)) END AS d FROM m)
SELECT a.i, a.j, (a.d + b.d) / 2 AS d FROM f a JOIN f b ON a.i = b.j AND a.j = b.i""",
    "medoids": f"{_DIST}, {_MED} SELECT label, medoid FROM med",
    "relabel": f"{_DIST}, {_MED}, new AS (SELECT med.label, CAST(row_number() OVER (ORDER BY {_NAME}) - 1 AS INTEGER) AS nl FROM med JOIN embeddings ON vec_id = medoid) SELECT vec_id AS id, nl AS label FROM embeddings JOIN new USING (label)",
    "cluster_sizes": "SELECT count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, CAST(sum(n) AS BIGINT) AS n_samples FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
    "cluster_quality": f"""{_DIST}, {_OWN}, {_OUTER} SELECT label, n AS size, round(s, 6) + 0.0 AS intra_mean, round(s_std, 6) + 0.0 AS intra_std, round(coalesce(o, 0), 6) + 0.0 AS inter_mean,
  round(coalesce(o_std, 0), 6) + 0.0 AS inter_std, round(CASE WHEN s > 0 THEN coalesce(o, 0) / s ELSE 0.0 END, 6) + 0.0 AS separation FROM own LEFT JOIN outer_ USING (label)""",
    "calinski_harabasz": f"""{_DIST}, c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings), s AS (SELECT sum(d) AS t, sum(d) FILTER (li = lj) AS w FROM pair)
SELECT round(CASE WHEN k > 1 AND k < n AND w > 0 THEN ((t - w) / (k - 1)) / (w / (n - k)) ELSE 0.0 END, 6) + 0.0 AS ch_index FROM c, s""",
    "davies_bouldin": f"""{_DIST}, {_OWN}, b AS (SELECT li, lj, avg(d) AS m FROM both_ways WHERE li <> lj GROUP BY ALL HAVING m > 0)
SELECT round(avg(r), 6) + 0.0 AS db_index FROM (SELECT li, max((x.s + y.s) / m) AS r FROM b JOIN own x ON x.label = li JOIN own y ON y.label = lj GROUP BY li)""",
    "sse_medoid": f"{_DIST}, {_MED} SELECT round(coalesce(sum(d * d), 0), 6) + 0.0 AS sse FROM both_ways JOIN med ON li = label AND j = medoid WHERE li = lj",
    "separation_ratio": f"{_DIST}, {_OWN}, {_OUTER} SELECT round(avg(coalesce(o, 0)) / avg(s), 6) + 0.0 AS separation_ratio FROM own LEFT JOIN outer_ USING (label)",
    "tau_sweep": f"{_DIST} SELECT CAST(p AS INTEGER) AS percentile, round((SELECT quantile_cont(d, list_transform(range(5, 85, 5), lambda x: x / 100)) FROM d)[CAST(p // 5 AS INTEGER)], 6) + 0.0 AS tau FROM range(5, 85, 5) t(p)",
    "cluster_summary": f"""{_DIST}, {_MED}, n AS (SELECT vec_id, label, {_NAME} AS name FROM embeddings)
SELECT n.vec_id AS id, n.name, n.label, r.name AS representative FROM n JOIN med USING (label) JOIN n r ON r.vec_id = medoid""",
    "cosine_neighbours": f"""WITH {_E}, u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, round(greatest(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 0), 9) AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM pairs) WHERE rank <= 30""",
    "label_join": "SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "unlabeled_count": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "extra_labels": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_first": "SELECT p_brand, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY p_brand",
    "label_last_wins": "SELECT p_size, trim(arg_max(p_name, p_partkey)) AS p_name FROM part GROUP BY p_size",
    "label_conflicts": "SELECT p_brand, count(DISTINCT p_size) AS n_labels FROM part GROUP BY p_brand HAVING n_labels > 1",
    "label_validate": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' || p_size WHEN 1 THEN ' ' || p_size || '.0 ' WHEN 2 THEN p_size || '.5' WHEN 3 THEN '-' || p_size WHEN 4 THEN 'x' ELSE ' ' END AS raw,
  CASE WHEN p_partkey % 6 < 2 THEN CAST(p_size AS BIGINT) END AS label, CASE p_partkey % 6 WHEN 2 THEN 'not whole' WHEN 3 THEN 'negative' WHEN 4 THEN 'not numeric' WHEN 5 THEN 'empty' END AS problem FROM part""",
    "label_sorted": "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS position FROM (SELECT DISTINCT p_name FROM part)",
    "class_gaps": "SELECT (SELECT max(doc_id) + 1 FROM labels) AS n_classes, g AS gap FROM range(0, (SELECT max(doc_id) + 1 FROM labels)) t(g) WHERE g NOT IN (SELECT doc_id FROM labels)",
    "class_index": "SELECT label, count(*) AS n, string_agg(vec_id, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label",
    "dedup_last": "SELECT p_brand, p_type, max(p_partkey) AS p_partkey FROM part GROUP BY ALL",
    "dup_groups": "SELECT p_brand, p_type, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM part GROUP BY p_brand, p_type HAVING n > 1",
    "split_random": f"SELECT p_partkey, p_brand, rank, {_SPLIT} AS split FROM (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY md5('42-' || p_partkey), p_partkey) AS INTEGER) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part)",
    "split_seq": "SELECT event_id, event_type, rank, CASE WHEN rank <= 80 THEN 'train' WHEN rank <= 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 100",
    "full_extract": "SELECT doc_id, p AS class FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY source) - 1 AS p FROM (SELECT DISTINCT source FROM documents)) USING (source)",
    "shuffle": "SELECT p_partkey, row_number() OVER (ORDER BY md5('43-' || p_partkey) || '-' || p_partkey) - 1 AS position FROM part",
    "stratified": f"WITH {_STRAT} SELECT vec_id, label FROM strat",
    "window_sample": """SELECT user_id, block, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY md5('5-' || event_id), event_id) AS r FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id, block) AS n FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS block FROM events)) WHERE n = 50) WHERE r <= 20""",
    "skip_done": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "subset_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "manifest": f"""WITH s AS (SELECT p_brand, {_SPLIT} AS split FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part))
SELECT p_brand, count(*) AS total_available, count(*) AS selected_count, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count, count(*) FILTER (split = 'test') AS test_count FROM s GROUP BY p_brand""",
    "pool_anti": f"WITH {_STRAT} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM strat)",
    "acquire_random": f"WITH {_STRAT} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM strat) ORDER BY md5('11-' || vec_id), vec_id LIMIT 100",
    "domain_union": "SELECT vec_id, label, CAST(vec_id % 2 AS INTEGER) AS domain FROM embeddings",
    "scan_names": "SELECT p_name AS name, count(*) AS n_files FROM part GROUP BY p_name",
    "softmax_topk": f"{_LOGIT}, {_TOP} SELECT vec_id, rank, class, round(p, 6) + 0.0 AS p FROM top WHERE rank <= 3",
    "topk_named": f"{_LOGIT}, {_TOP} SELECT vec_id, rank, coalesce(r_name, 'UNKNOWN_LABEL_' || class) AS name FROM top LEFT JOIN region ON r_regionkey = class WHERE rank <= 3",
    "masked_topk": f"{_LOGIT.replace('logit AS (', 'all_ AS (')}, logit AS (SELECT vec_id, label, class, CASE WHEN class IN (SELECT r_regionkey FROM region) THEN logit ELSE -1e9 END AS logit FROM all_), {_TOP} SELECT vec_id, rank, class, round(p, 6) + 0.0 AS p FROM top WHERE rank <= 3",
    "elements": f"WITH {_KEY} SELECT p_partkey, array_to_string(els, ',') AS elements FROM el",
    "mask_all": f"WITH {_KEY} SELECT p_partkey, key FROM el WHERE list_has_all(els, ['Ca', 'Ti', 'O'])",
    "mask_any": f"WITH {_KEY} SELECT p_size, arg_min(key, p_partkey) AS key FROM el WHERE list_has_any(els, ['Ca', 'Ti']) GROUP BY p_size",
    "domain_accuracy": f"""{_PRED} SELECT round(count(*) FILTER (label = predicted) / greatest(count(*), 1), 6) + 0.0 AS accuracy_all, count(*) AS count_all,
  round(count(*) FILTER (label = predicted AND domain = 0) / greatest(count(*) FILTER (domain = 0), 1), 6) + 0.0 AS accuracy_source, count(*) FILTER (domain = 0) AS count_source,
  round(count(*) FILTER (label = predicted AND domain = 1) / greatest(count(*) FILTER (domain = 1), 1), 6) + 0.0 AS accuracy_target, count(*) FILTER (domain = 1) AS count_target FROM pred""",
    "class_accuracy": f"{_PRED} SELECT label, count(*) FILTER (label = predicted) AS correct, count(*) AS count, round(count(*) FILTER (label = predicted) / count(*), 6) + 0.0 AS accuracy FROM pred WHERE domain = 1 GROUP BY label",
    "macro_f1": f"""{_PRED}, t AS (SELECT label, count(*) AS t, count(*) FILTER (label = predicted) AS hit FROM pred GROUP BY label), s AS (SELECT predicted AS label, count(*) AS s FROM pred GROUP BY predicted),
b AS (SELECT coalesce(t, 0) AS t, coalesce(s, 0) AS s, coalesce(hit, 0) AS hit FROM t FULL JOIN s USING (label)), sc AS (SELECT *, CASE WHEN s > 0 THEN hit / s ELSE 0.0 END AS p, CASE WHEN t > 0 THEN hit / t ELSE 0.0 END AS r FROM b)
SELECT round(sum(hit) / sum(t), 6) + 0.0 AS accuracy, round(avg(p), 6) + 0.0 AS precision_macro, round(avg(r), 6) + 0.0 AS recall_macro, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) + 0.0 AS f1_macro,
  (SELECT round(avg(ln(s) + top - own), 6) + 0.0 FROM (SELECT vec_id, any_value(top) AS top, sum(exp(logit - top)) AS s, max(logit) FILTER (class = label) AS own
    FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS top FROM logit) GROUP BY vec_id)) AS loss FROM sc""",
    "round_summary": f"WITH {_RUNS} SELECT round, count(DISTINCT seed) AS n_seeds, round(avg(acc), 6) + 0.0 AS acc_mean, round(coalesce(stddev_samp(acc), 0), 6) + 0.0 AS acc_std, round(avg(f1), 6) + 0.0 AS f1_mean, round(coalesce(stddev_samp(f1), 0), 6) + 0.0 AS f1_std FROM runs GROUP BY round",
    "final_by_seed": f"WITH {_RUNS} SELECT seed, max(round) AS round, round(arg_max(acc, round), 6) + 0.0 AS acc FROM runs GROUP BY seed",
    "metric_stats": f"WITH {_RUNS} SELECT 'acc' AS metric, round(avg(acc), 6) + 0.0 AS mean, round(stddev_samp(acc), 6) + 0.0 AS std FROM runs UNION ALL SELECT 'f1', round(avg(f1), 6) + 0.0, round(stddev_samp(f1), 6) + 0.0 FROM runs",
    "early_stop": f"""WITH RECURSIVE {_RUNS}, v AS (SELECT seed, round, round(acc, 6) + 0.0 AS value, row_number() OVER (PARTITION BY seed ORDER BY round) AS n FROM runs),
s AS (SELECT seed, n, value AS best, 0 AS waited, CAST(NULL AS BIGINT) AS stop FROM v WHERE n = 1
  UNION ALL SELECT s.seed, v.n, CASE WHEN v.value >= best + 0.001 THEN v.value ELSE best END, CASE WHEN v.value >= best + 0.001 THEN 0 ELSE waited + 1 END,
    coalesce(stop, CASE WHEN v.value < best + 0.001 AND waited + 1 >= 3 THEN v.round END) FROM s JOIN v ON v.seed = s.seed AND v.n = s.n + 1)
SELECT seed, arg_max(stop, n) FILTER (stop IS NOT NULL) AS stop_round FROM s GROUP BY seed""",
    "empirical_w1": f"WITH {_LONG}, {_W1} SELECT label, CAST(pos AS INTEGER) AS pos, round(w1, 6) + 0.0 AS w1 FROM w1",
    "class_radius": f"WITH {_LONG}, {_RADIUS} SELECT label, CAST(domain AS INTEGER) AS domain, n, round(radius, 6) + 0.0 AS radius FROM rad",
    "shift_score": f"{_SHIFT} SELECT label, n_source, n_target, round(feature_shift, 6) + 0.0 AS feature_shift, round(r_source, 6) + 0.0 AS r_source, round(r_target, 6) + 0.0 AS r_target, round(shift_score, 6) + 0.0 AS shift_score FROM sh",
    "shift_top10": f"{_SHIFT} SELECT label, round(shift_score, 6) + 0.0 AS shift_score FROM sh ORDER BY sh.shift_score DESC, label LIMIT 10",
    "formula_counts": f"WITH {_formula(7919)} SELECT p_partkey, element, CAST(n AS INTEGER) AS n FROM parts",
    "round_gcd": f"WITH {_formula(7919)}, {_REDUCED} SELECT p_partkey, element, n FROM reduced",
    "oxi_neutral": _NEUTRAL,
    "crystal_system": f"WITH {_SG} SELECT p_partkey, sg, CASE WHEN sg <= 2 THEN 'triclinic' WHEN sg <= 15 THEN 'monoclinic' WHEN sg <= 74 THEN 'orthorhombic' WHEN sg <= 142 THEN 'tetragonal' WHEN sg <= 167 THEN 'trigonal' WHEN sg <= 194 THEN 'hexagonal' ELSE 'cubic' END AS system FROM g",
    "strain_class": f"WITH {_SG} SELECT p_partkey, sg, {_CLASS} AS symmetry FROM g",
    "sg_suffix": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND NOT regexp_matches(p_name, '_\\d{1,3}$') THEN 200 + p_size % 30 WHEN p_partkey % 3 = 0 THEN CAST(regexp_extract(p_name, '_(\\d{1,3})$', 1) AS INTEGER) ELSE p_size END AS sg FROM part",
    "grid_snap": f"SELECT {_MAXCELL.format(a='(5 + l_extendedprice % 80)')} AS cell, count(*) AS n FROM lineitem GROUP BY ALL",
    "scherrer": f"SELECT p_partkey, round(sqrt{_FACTOR} * {_WIDTH.format(a='(10.0 + p_size)', d='(5 + p_partkey % 40)')}, 6) + 0.0 AS common, round(sqrt({_FACTOR} * {_WIDTH.format(a='(10.0 + p_size)', d='(5 + p_partkey % 40)')}), 6) + 0.0 AS inside FROM part",
    "render_patterns": f"""WITH {_PEAKS}, r AS (SELECT *, CAST(floor(4 * s + 0.5) AS INTEGER) AS rad, {_MAXCELL.format(a='a')} AS centre FROM pks), k AS (SELECT *, unnest(range(-rad, rad + 1)) AS k FROM r),
z AS (SELECT *, list_sum(list_transform(range(-rad, rad + 1), lambda q: exp(-(q * q) / (2 * s * s)))) AS z FROM k), c AS (SELECT pattern, centre + k AS cell, sum(intensity * exp(-(k * k) / (2 * s * s)) / z) AS value FROM z WHERE centre + k BETWEEN 0 AND 4500 GROUP BY ALL)
SELECT pattern, CAST(cell AS INTEGER) AS cell, round(100 * value / max(value) OVER (PARTITION BY pattern), 6) + 0.0 AS value FROM c""",
    "augment": _augment(),
    "texture": f"""WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN [h, k, l] ELSE [h, k, -h - k, l] END AS v FROM (SELECT p_partkey, p_size, p_partkey % 5 AS h, p_partkey % 3 + 1 AS k, p_size % 4 AS l FROM part)),
d AS (SELECT *, list_transform(range(0, len(v)), lambda i: bits // CAST(pow(2, i) AS BIGINT) % 2) AS d FROM (SELECT *, {_pick('3', 'p_partkey', 1 << 32)} % (CAST(pow(2, len(v)) AS BIGINT) - 1) + 1 AS bits FROM r))
SELECT p_partkey, round(p_size * (0.4::DOUBLE + 0.6::DOUBLE * abs(list_dot_product(list_transform(v, lambda x: x::DOUBLE), list_transform(d, lambda x: x::DOUBLE)) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(d))))), 6) + 0.0 AS intensity FROM d""",
    "shift_angles": f"SELECT p_partkey, round(10 + p_size - 0.5::DOUBLE + {_pick('9', 'p_partkey', 1000)} / 999, 6) + 0.0 AS two_theta FROM part",
    "strain_tensor": _strain(),
    "impurity_mix": f"""WITH {_E}, a AS (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS v FROM e), m AS (
  SELECT x.vec_id, list_transform(list_zip(x.v, y.v), lambda z: z[1] + 0.3::DOUBLE * (z[2] / top)) AS v FROM a x JOIN (SELECT vec_id - 1 AS vec_id, v, list_max(v) AS top FROM a) y USING (vec_id)),
t AS (SELECT vec_id, list_transform(v, lambda x: 100 * x / top) AS v FROM (SELECT vec_id, v, list_max(v) AS top FROM m)) {_OUT}""",
    "near_dup_anti": """WITH n AS (SELECT s_suppkey AS id, s_suppkey * 0.004::DOUBLE AS a, s_nationkey::DOUBLE AS b FROM supplier)
SELECT s.id AS structure, r.id AS reference FROM n s JOIN n r ON NOT (abs(s.a - r.a) <= 0.01 + 1e-5 * abs(r.a) AND abs(s.b - r.b) <= 0.01 + 1e-5 * abs(r.b))""",
}
_BADGE = f"""WITH {_E}, b AS (SELECT vec_id AS id, label, v AS h, list_transform(range(0, 10), lambda c: CASE WHEN c = label THEN 0.9::DOUBLE ELSE -0.1::DOUBLE END) AS p FROM e),
  c AS (SELECT min(id) AS centre, label FROM b GROUP BY label), n AS (SELECT *, list_dot_product(p, p) * list_dot_product(h, h) AS q FROM b),
  bd AS (SELECT x.id, centre, sqrt(greatest(0, x.q + y.q - 2 * list_dot_product(x.p, y.p) * list_dot_product(x.h, y.h))) AS d FROM n x, c JOIN n y ON y.id = centre)"""
ORACLE["badge_distance"] = f"{_BADGE} SELECT id, centre, round(d, 5) AS d FROM bd"
ORACLE["badge_min_d"] = f"{_BADGE} SELECT id, round(min(d), 5) AS d FROM bd GROUP BY id"


def _strained() -> str:
    """Strained copies of one cell: free parameters of ordered structures; the tensor on the vectors of others, and the cell of the product."""
    step = lambda e: f"((2 * {_pick(f'9-{e}', "name || '-' || copy", 1000)} / 999.0::DOUBLE - 1) * 0.04::DOUBLE)"
    entries = [f"{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    shapes = {  # by class: entries of the tensor, others are 0
        "cubic": {"11": "s11", "22": "s11", "33": "s11"}, "high-sym hexagonal/tetragonal": {"11": "s11", "22": "s11", "33": "s33"}, "low-sym hexagonal/tetragonal": {"11": "s11", "12": "s12", "21": "-s12", "22": "s22", "33": "s33"},
        "orthorhombic": {"11": "s11", "22": "s22", "33": "s33"}, "monoclinic": {"11": "s11", "22": "s22", "23": "s23", "32": "s23", "33": "s33"}, "triclinic": {e: f"s{e}" for e in entries},
    }
    tensor = ", ".join(f"CASE {' '.join(f"WHEN kind = '{k}' THEN {of.get(e, '0.0::DOUBLE')}" for k, of in shapes.items())} END AS t{e}" for e in entries)
    al, be, ga = (f"radians({x}.0::DOUBLE)" for x in (80, 95, 100))
    turn = f"acos((cos({al}) * cos({be}) - cos({ga})) / (sin({al}) * sin({be})))"
    rows = [[f"4 * sin({be})", "0", f"4 * cos({be})"], [f"-5 * sin({al}) * cos({turn})", f"5 * sin({al}) * sin({turn})", f"5 * cos({al})"], ["0", "0", "6"]]
    product = ", ".join(f"{' + '.join(f'({rows[i][k]}) * (t{k + 1}{j + 1} + {int(j == k)})' for k in range(3))} AS n{i + 1}{j + 1}" for i in range(3) for j in range(3))
    dot = lambda i, j: "(" + " + ".join(f"n{i}{k} * n{j}{k}" for k in (1, 2, 3)) + ")"
    between = lambda i, j: f"degrees(acos({dot(i, j)} / (sqrt{dot(i, i)} * sqrt{dot(j, j)})))"
    turned = f"[sqrt{dot(1, 1)}, sqrt{dot(2, 2)}, sqrt{dot(3, 3)}, {between(2, 3)}, {between(1, 3)}, {between(1, 2)}]"
    kept = "[4 * f[1], 5 * CASE WHEN sg >= 75 THEN f[1] ELSE f[2] END, 6 * CASE WHEN sg >= 195 THEN f[1] ELSE f[3] END, 80 * CASE WHEN sg <= 2 THEN f[4] ELSE 1.0 END, 95 * CASE WHEN sg <= 15 THEN f[5] ELSE 1.0 END, 100 * CASE WHEN sg <= 2 THEN f[6] ELSE 1.0 END]"
    return f"""WITH {_SG}, c AS (SELECT 's' || p_partkey AS name, CAST(copy AS INTEGER) AS copy, sg, p_partkey % 2 = 0 AS ordered, {_CLASS} AS kind FROM g, range(0, 2) r(copy)),
s AS (SELECT *, {", ".join(f"{step(f's{e}')} AS s{e}" for e in entries)}, [{", ".join(f"1 + {step(k)}" for k in range(6))}] AS f FROM c),
t AS (SELECT *, {tensor} FROM s), m AS (SELECT *, {product} FROM t), x AS (SELECT name, copy, sg, ordered, CASE WHEN ordered THEN {kept} ELSE {turned} END AS v FROM m)
SELECT name, copy, sg, ordered, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS x FROM x, range(0, 6) r(i)"""


ORACLE["structure_strain"] = _strained()
_TREE = f"""WITH RECURSIVE {_E}, {_L1}, {_LONG1}, {_CUM}, {_D.replace("d AS (", "d AS MATERIALIZED (", 1)},
state AS (
  SELECT 'pair' AS kind, i, j, d FROM d
  UNION ALL
  SELECT * FROM (
    WITH p AS (SELECT i, j, d FROM state WHERE kind = 'pair'),
    ends AS (SELECT e, min({{'d': d, 'i': i, 'j': j}}) AS m FROM (SELECT i AS e, d, i, j FROM p UNION ALL SELECT j, d, i, j FROM p) GROUP BY e),
    mutual AS (SELECT m.i AS parent, m.j AS child, m.d AS height FROM ends GROUP BY m HAVING count(*) = 2),
    moved AS (SELECT least(a, b) AS i, greatest(a, b) AS j, max(d) AS d FROM (
      SELECT coalesce(x.parent, i) AS a, coalesce(y.parent, j) AS b, d FROM p LEFT JOIN mutual x ON x.child = i LEFT JOIN mutual y ON y.child = j) WHERE a <> b GROUP BY ALL)
    SELECT 'pair', i, j, d FROM moved UNION ALL SELECT 'merge', child, parent, height FROM mutual)),
merge AS MATERIALIZED (SELECT i AS child, j AS parent, d AS height FROM state WHERE kind = 'merge'),
tau AS (SELECT CAST(p AS INTEGER) AS percentile, (SELECT quantile_cont(d, list_transform(range(5, 85, 5), lambda x: x / 100)) FROM d)[CAST(p // 5 AS INTEGER)] AS tau FROM range(5, 85, 5) t(p)),
way AS (SELECT percentile, tau, vec_id AS id, vec_id AS root FROM tau, embeddings UNION ALL SELECT percentile, tau, id, parent FROM way JOIN merge ON child = root WHERE height < tau),
lab AS MATERIALIZED (SELECT percentile, tau, id, CAST(dense_rank() OVER (PARTITION BY percentile ORDER BY root) - 1 AS INTEGER) AS label FROM (SELECT percentile, tau, id, min(root) AS root FROM way GROUP BY ALL))"""
ORACLE["complete_linkage"] = f"{_TREE} SELECT percentile, round(tau, 6) + 0.0 AS tau, id, label FROM lab"
ORACLE["cluster_sweep"] = f"""{_TREE},
pr AS MATERIALIZED (SELECT x.percentile, x.label AS li, y.label AS lj, i, j, d FROM d JOIN lab x ON x.id = i JOIN lab y ON y.id = j AND y.percentile = x.percentile),
bw AS (SELECT percentile, li, lj, i, j, d FROM pr UNION ALL SELECT percentile, lj, li, j, i, d FROM pr),
sz AS (SELECT percentile, label, count(*) AS n FROM lab GROUP BY ALL),
own AS (SELECT percentile, label, n, coalesce(s, 0) AS s FROM sz LEFT JOIN (SELECT percentile, li AS label, avg(d) AS s FROM pr WHERE li = lj GROUP BY ALL) USING (percentile, label)),
far AS (SELECT percentile, li AS label, avg(d) AS o FROM bw WHERE li <> lj GROUP BY ALL),
sep AS (SELECT percentile, CASE WHEN avg(s) > 0 THEN avg(coalesce(o, 0)) / avg(s) END AS separation_ratio FROM own LEFT JOIN far USING (percentile, label) GROUP BY percentile),
counts AS (SELECT percentile, count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, CAST(sum(n) AS BIGINT) AS n_samples FROM sz GROUP BY percentile),
ch AS (SELECT percentile, sum(d) AS t, coalesce(sum(d) FILTER (li = lj), 0) AS w FROM pr GROUP BY percentile),
db AS (SELECT percentile, avg(r) AS db_index FROM (SELECT m.percentile, m.li, max((x.s + y.s) / m) AS r FROM (SELECT percentile, li, lj, avg(d) AS m FROM bw WHERE li <> lj GROUP BY ALL HAVING m > 0) m
  JOIN own x ON x.percentile = m.percentile AND x.label = m.li JOIN own y ON y.percentile = m.percentile AND y.label = m.lj GROUP BY ALL) GROUP BY percentile),
med AS (SELECT percentile, label, arg_min(id, (s, id)) AS medoid FROM (
  SELECT l.percentile, l.label, l.id, round(coalesce(sum(d) FILTER (li = lj), 0), 9) AS s FROM lab l LEFT JOIN bw ON bw.percentile = l.percentile AND bw.i = l.id GROUP BY ALL) GROUP BY ALL),
err AS (SELECT bw.percentile, sum(d * d) AS sse FROM bw JOIN med ON med.percentile = bw.percentile AND li = label AND j = medoid WHERE li = lj GROUP BY ALL)
SELECT percentile, round(any_tau, 6) + 0.0 AS tau, n_clusters, min_size, max_size, n_samples,
  round(CASE WHEN n_clusters > 1 AND n_clusters < n_samples AND w > 0 THEN ((t - w) / (n_clusters - 1)) / (w / (n_samples - n_clusters)) ELSE 0.0 END, 6) + 0.0 AS ch_index,
  round(coalesce(db_index, 0), 6) + 0.0 AS db_index, round(coalesce(sse, 0), 6) + 0.0 AS sse, round(separation_ratio, 6) + 0.0 AS separation_ratio
FROM counts JOIN (SELECT percentile, any_value(tau) AS any_tau FROM lab GROUP BY percentile) USING (percentile) JOIN sep USING (percentile) JOIN ch USING (percentile) LEFT JOIN db USING (percentile) LEFT JOIN err USING (percentile)"""
_CELLS = "n AS (SELECT c_custkey AS id, floor(c_acctbal) * 0.004::DOUBLE AS a, c_nationkey::DOUBLE AS b FROM customer)"
_NEAR = "abs(s.a - r.a) <= 0.01 + 1e-5 * abs(r.a) AND abs(s.b - r.b) <= 0.01 + 1e-5 * abs(r.b)"
ORACLE["near_lattices"] = f"WITH {_CELLS}, l AS (SELECT DISTINCT a, b FROM n) SELECT s.a, s.b, r.a AS ref_a, r.b AS ref_b FROM l s JOIN l r ON {_NEAR}"
ORACLE["impurity_draw"] = f"""WITH {_CELLS}, free AS (SELECT s.id AS structure, r.id AS reference, row_number() OVER (PARTITION BY s.id ORDER BY r.a, r.b, r.id) - 1 AS place, count(*) OVER (PARTITION BY s.id) AS total
  FROM n s JOIN n r ON NOT ({_NEAR}))
SELECT structure, CAST(k AS INTEGER) AS k, reference FROM free, range(0, 2) t(k) WHERE place = CAST('0x' || substr(md5('6-' || structure || '-' || k), 1, 12) AS BIGINT) % total"""
ORACLE["class_range"] = "SELECT label, count(*) AS n FROM embeddings GROUP BY label"
ORACLE["distinct_classes"] = "SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type"
ORACLE["row_alignment"] = "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, label FROM embeddings"
ORACLE["domain_scan"] = """SELECT source, block, doc_id, quality FROM (
  SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY md5('3-' || doc_id), doc_id) AS r FROM (
    SELECT *, count(*) OVER (PARTITION BY source, block) AS n FROM (SELECT source, doc_id, quality, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS block FROM documents JOIN labels USING (doc_id))) WHERE n = 10) WHERE r <= 4"""
ORACLE["structure_filters"] = """SELECT formula, p_size AS sg, max(p_partkey) AS p_partkey FROM (SELECT *, (['Ba','Ca','K'])[p_partkey % 3 + 1] || 'O' AS formula FROM part) WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 GROUP BY ALL"""
ORACLE["noise"] = (
    ORACLE["render_patterns"].rsplit("SELECT pattern,", 1)[0].rstrip()
    + f""", w AS (SELECT pattern, cell, 100 * value / max(value) OVER (PARTITION BY pattern) AS value FROM c), g AS (SELECT pattern, cell FROM (SELECT DISTINCT pattern FROM w), range(0, 4501) r(cell))
SELECT pattern, CAST(g.cell AS INTEGER) AS cell, round(coalesce(value, 0.0) + 0.25 * {_gauss('13', "pattern || '-' || g.cell")}, 6) + 0.0 AS value FROM g LEFT JOIN w USING (pattern, cell)"""
)
ORACLE["impurity_pick"] = f"""SELECT a.s_suppkey AS structure, CAST(k AS INTEGER) AS k, arg_min(b.s_suppkey, (md5('5-' || a.s_suppkey || '-' || k || '-' || b.s_suppkey), b.s_suppkey)) AS reference,
  any_value(round(70.0 * {_pick('5-impurity', "a.s_suppkey || '-' || k", 100)} / 99.0::DOUBLE, 6) + 0.0) AS magnitude FROM supplier a JOIN supplier b ON a.s_nationkey <> b.s_nationkey, range(0, 2) r(k) GROUP BY a.s_suppkey, k"""
ORACLE["cell_strain"] = f"""WITH {_SG}, s AS (SELECT p_partkey, sg, [{', '.join(f"1 + ({_pick(f's{k}', 'p_partkey', 100)} - 50) / 1000.0::DOUBLE" for k in range(6))}] AS s FROM g),
x AS (SELECT p_partkey, [4 * s[1], 5 * CASE WHEN sg >= 75 THEN s[1] ELSE s[2] END, 6 * CASE WHEN sg >= 195 THEN s[1] ELSE s[3] END, 80 * CASE WHEN sg <= 2 THEN s[4] ELSE 1.0 END, 95 * CASE WHEN sg <= 15 THEN s[5] ELSE 1.0 END, 100 * CASE WHEN sg <= 2 THEN s[6] ELSE 1.0 END] AS v FROM s)
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(v[i + 1], 6) + 0.0 AS x FROM x, range(0, 6) r(i)"""


def _badge_steps(group: str, k: int, seed: int) -> str:
    """Squared-distance sampling, one materialised step after the other."""
    u = lambda step: f"((CAST('0x' || substr(md5('{seed}-{step}-' || id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"
    ctes = [f"{_BADGE.split(', c AS (')[0].rstrip(', ')}", f"r0 AS MATERIALIZED (SELECT {group} AS g, id, p, h, list_dot_product(p, p) * list_dot_product(h, h) AS q, CAST(NULL AS DOUBLE) AS d2, CAST(NULL AS INTEGER) AS rank FROM b)"]
    for step in range(1, k + 1):
        order = "(-round(sqrt(q), 9), id)" if step == 1 else f"(d2 = 0, CASE WHEN d2 > 0 THEN -ln({u(step)}) / d2 ELSE {u(step)} END, id)"
        ctes.append(f"k{step} AS MATERIALIZED (SELECT g, arg_min(id, {order}) AS c FROM r{step - 1} WHERE rank IS NULL GROUP BY g)")
        near = "round(pow(sqrt(greatest(0, x.q + y.q - 2 * list_dot_product(x.p, y.p) * list_dot_product(x.h, y.h))), 2), 9)"
        ctes.append(f"r{step} AS MATERIALIZED (SELECT x.g, x.id, x.p, x.h, x.q, least(coalesce(x.d2, {near}), {near}) AS d2, coalesce(x.rank, CASE WHEN x.id = c THEN {step} END) AS rank FROM r{step - 1} x JOIN k{step} k ON k.g = x.g JOIN r{step - 1} y ON y.id = c)")
    return ", ".join(ctes)


ORACLE["badge_select"] = f"{_badge_steps('label', 8, 11)} SELECT g AS label, CAST(rank AS INTEGER) AS rank, id FROM r8 WHERE rank IS NOT NULL"
ORACLE["badge_select_global"] = f"{_badge_steps('0', 6, 12)} SELECT CAST(rank AS INTEGER) AS rank, id FROM r6 WHERE rank IS NOT NULL"
