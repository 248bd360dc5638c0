"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

_L = "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_quantity AS x, l_extendedprice AS y FROM lineitem)"
_P = "(SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part)"
_E = "(SELECT event_id AS id, user_id::DOUBLE AS x, value AS y, event_type FROM events)"
_C = "(SELECT c_custkey AS id, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer)"
_V = "(SELECT vec_id AS id, embedding::DOUBLE[] AS coords FROM embeddings)"
_T = f"(SELECT event_type, count(*) AS n, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {_E} GROUP BY event_type)"
#: Boxes a (columns) and the next one's (columns with b).
_PAIRS = f"(SELECT * FROM (SELECT event_type, xmin, ymin, xmax, ymax, lead(xmin) OVER o AS bxmin, lead(ymin) OVER o AS bymin, lead(xmax) OVER o AS bxmax, lead(ymax) OVER o AS bymax FROM {_T} WINDOW o AS (ORDER BY event_type)) WHERE bxmin IS NOT NULL)"
_INTER = "greatest(least(xmax, bxmax) - greatest(xmin, bxmin), 0.0) * greatest(least(ymax, bymax) - greatest(ymin, bymin), 0.0)"
_AREA, _BAREA = "((xmax - xmin) * (ymax - ymin))", "((bxmax - bxmin) * (bymax - bymin))"


def _skyline(view: str, columns: str) -> str:
    return f"SELECT {columns} FROM {view} a WHERE NOT EXISTS (SELECT 1 FROM {view} b WHERE b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))"


_HILBERT = f"""
WITH RECURSIVE p AS (SELECT * FROM {_P}),
o AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM p),
w AS (
  SELECT id, x - x0 AS x, y - y0 AS y, side AS s, 0::BIGINT AS h, 0 AS step FROM p, o
  UNION ALL
  SELECT id,
    CASE WHEN x > s / 2 AND y > s / 2 THEN x - s / 2 WHEN x > s / 2 THEN s / 2 - y WHEN y > s / 2 THEN x ELSE y END,
    CASE WHEN x > s / 2 AND y > s / 2 THEN y - s / 2 WHEN x > s / 2 THEN s - x WHEN y > s / 2 THEN y - s / 2 ELSE x END,
    s / 2, h * 4 + CASE WHEN x > s / 2 AND y > s / 2 THEN 2 WHEN x > s / 2 THEN 3 WHEN y > s / 2 THEN 1 ELSE 0 END, step + 1
  FROM w WHERE step < 26
),
k AS (SELECT w.id, p.x, p.y, w.h AS hilbert_key, row_number() OVER (ORDER BY w.h, w.id) - 1 AS rank, count(*) OVER () AS n FROM w JOIN p ON w.id = p.id WHERE step = 26)"""


def _packed(rank: str, n: str, capacity: int) -> str:
    least = int(capacity * 0.4)
    return f"CASE WHEN {n} > {capacity} AND {n} % {capacity} > 0 AND {n} % {capacity} < {least} THEN CASE WHEN {rank} >= {n} - {least} THEN {n} // {capacity} ELSE least({rank} // {capacity}, {n} // {capacity} - 1) END ELSE {rank} // {capacity} END"


def _leaves(leaf: int) -> str:
    return f"{_HILBERT},\nl AS (SELECT id, x, y, {_packed('rank', 'n', leaf)} AS leaf_id FROM k)"


def _nodes(leaf: int, inner: int, levels: int = 8) -> str:
    """Nodes by their height above the leaves, to a root."""
    out = f"{_leaves(leaf)},\nh0 AS (SELECT leaf_id AS node_id, count(*) AS entries, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM l GROUP BY leaf_id),\n"
    for i in range(levels):
        out += f"q{i} AS (SELECT *, count(*) OVER () AS n FROM h{i}),\nr{i} AS (SELECT *, CASE WHEN n > 1 THEN {_packed('node_id', 'n', inner)} END AS parent_id FROM q{i}),\n"
        out += f"h{i + 1} AS (SELECT parent_id AS node_id, count(*) AS entries, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM r{i} WHERE parent_id IS NOT NULL GROUP BY parent_id),\n"
    every = " UNION ALL ".join(f"SELECT {i} AS up, node_id, parent_id, entries, xmin, ymin, xmax, ymax FROM r{i}" for i in range(levels))
    return out + f"t AS (SELECT (max(up) OVER () - up)::INT AS level, node_id, parent_id, entries, xmin, ymin, xmax, ymax FROM ({every}))"


def _choose(overlap: bool) -> str:
    grown = "greatest(b.xmax, p.x) - least(b.xmin, p.x)", "greatest(b.ymax, p.y) - least(b.ymin, p.y)"
    area = "(b.xmax - b.xmin) * (b.ymax - b.ymin)"
    over = """(SELECT sum(
        greatest(least(greatest(b.xmax, p.x), o.xmax) - greatest(least(b.xmin, p.x), o.xmin), 0.0) * greatest(least(greatest(b.ymax, p.y), o.ymax) - greatest(least(b.ymin, p.y), o.ymin), 0.0)
        - greatest(least(b.xmax, o.xmax) - greatest(b.xmin, o.xmin), 0.0) * greatest(least(b.ymax, o.ymax) - greatest(b.ymin, o.ymin), 0.0))
        FROM u o WHERE o.node_id <> b.node_id)"""
    return f"""
WITH u AS (SELECT floor(x / 10)::BIGINT AS node_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {_E} GROUP BY 1),
p AS (SELECT id, x + 4.75::DOUBLE AS x, y * 1.25::DOUBLE - 30.0::DOUBLE AS y FROM {_E}),
c AS (SELECT p.id, b.node_id, round(({grown[0]}) * ({grown[1]}) - {area}, 9) AS growth, {area} AS area{f", round({over}, 9) AS overlap" if overlap else ""} FROM p, u b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {"overlap, " if overlap else ""}growth, area, node_id) AS k FROM c)
SELECT id, node_id, round(growth, 7) AS growth FROM r WHERE k = 1"""


def _descent(leaf: int, inner: int, levels: int = 7) -> str:
    """Down from the root, a step for each level that there is."""
    out = f"{_nodes(leaf, inner)},\ng AS (SELECT max(level) AS deepest FROM t),\ns0 AS (SELECT id, x * 1.125::DOUBLE - 2.0::DOUBLE AS x, y * 1.0625::DOUBLE - 60.0::DOUBLE AS y, 0::BIGINT AS node_id FROM {_P})"
    for i in range(1, levels + 1):
        out += f""",
c{i} AS (
  SELECT p.id, p.x, p.y, b.node_id, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS area,
    round((greatest(b.xmax, p.x) - least(b.xmin, p.x)) * (greatest(b.ymax, p.y) - least(b.ymin, p.y)) - (b.xmax - b.xmin) * (b.ymax - b.ymin), 9) AS growth,
    CASE WHEN g.deepest = {i} THEN round(coalesce((SELECT sum(
      greatest(least(greatest(b.xmax, p.x), o.xmax) - greatest(least(b.xmin, p.x), o.xmin), 0.0) * greatest(least(greatest(b.ymax, p.y), o.ymax) - greatest(least(b.ymin, p.y), o.ymin), 0.0)
      - greatest(least(b.xmax, o.xmax) - greatest(b.xmin, o.xmin), 0.0) * greatest(least(b.ymax, o.ymax) - greatest(b.ymin, o.ymin), 0.0))
      FROM t o WHERE o.level = b.level AND o.parent_id = b.parent_id AND o.node_id <> b.node_id), 0), 9) ELSE 0 END AS overlap
  FROM s{i - 1} p, t b, g WHERE b.level = {i} AND b.parent_id = p.node_id
),
s{i} AS (SELECT id, x, y, node_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap, growth, area, node_id) AS k FROM c{i}) WHERE k = 1)"""
    return out + "\n" + " UNION ALL ".join(f"SELECT id, node_id AS leaf_id FROM s{i}, g WHERE g.deepest = {i}" for i in range(levels + 1))


def _split(entries: str, sorts: dict[str, tuple[str, str]]) -> str:
    every = " UNION ALL ".join(
        f"""SELECT node_id, '{axis}' AS axis, '{name}' AS sort, row_number() OVER w AS cut, count(*) OVER (PARTITION BY node_id) AS n,
    min(xmin) OVER a AS axmin, min(ymin) OVER a AS aymin, max(xmax) OVER a AS axmax, max(ymax) OVER a AS aymax,
    min(xmin) OVER b AS bxmin, min(ymin) OVER b AS bymin, max(xmax) OVER b AS bxmax, max(ymax) OVER b AS bymax
  FROM e WINDOW w AS (PARTITION BY node_id ORDER BY {order}), a AS (PARTITION BY node_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY node_id ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
        for name, (axis, order) in sorts.items()
    )
    return f"""
WITH e AS ({entries}), d AS ({every}),
c AS (
  SELECT node_id, axis, sort, cut, 2.0 * ((axmax - axmin) + (aymax - aymin)) + 2.0 * ((bxmax - bxmin) + (bymax - bymin)) AS margin,
    greatest(least(axmax, bxmax) - greatest(axmin, bxmin), 0.0) * greatest(least(aymax, bymax) - greatest(aymin, bymin), 0.0) AS overlap,
    (axmax - axmin) * (aymax - aymin) + (bxmax - bxmin) * (bymax - bymin) AS area
  FROM d WHERE cut >= floor((n - 1) * 0.4) AND cut <= n - floor((n - 1) * 0.4) AND cut < n
),
s AS (SELECT node_id, axis, round(sum(margin), 4) AS margin FROM c GROUP BY node_id, axis),
x AS (SELECT node_id, axis, margin FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY margin, axis) AS k FROM s) WHERE k = 1),
m AS (SELECT c.node_id, c.axis, c.sort, c.cut, round(c.overlap, 6) AS overlap, round(c.area, 6) AS area FROM c JOIN x ON c.node_id = x.node_id AND c.axis = x.axis),
f AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY overlap, area, sort, cut) AS k FROM m)"""


_POINT_SORTS = {"x": ("x", "xmin, ymin, id"), "y": ("y", "ymin, xmin, id")}
_BOX_SORTS = {"x lower": ("x", "xmin, xmax, id"), "x upper": ("x", "xmax, xmin, id"), "y lower": ("y", "ymin, ymax, id"), "y upper": ("y", "ymax, ymin, id")}
_OVERFULL = f"SELECT floor(x / 10)::BIGINT AS node_id, id, x AS xmin, y AS ymin, x AS xmax, y AS ymax FROM {_E}"
_OVERFULL_INNER = f"SELECT floor(x::BIGINT / 30)::BIGINT AS node_id, x::BIGINT AS id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {_E} GROUP BY x"


def sql(leaf: int, inner: int) -> dict[str, str]:
    knn = "SELECT *, sqrt((x - 25.0) * (x - 25.0) + (y - 30000.0) * (y - 30000.0)) AS dist"
    knn_lines = f"SELECT * FROM ({knn} FROM {_L}) WHERE dist > 0 ORDER BY dist, l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 10"
    in_box = f"SELECT * FROM {_L} WHERE x BETWEEN 10 AND 20 AND y BETWEEN 20000 AND 40000"
    three = "coords[1:3]"
    heights = ", ".join(f"({b}, {(b - 12) // 20}, {(b - 12) // 36})" for b in (512, 4096, 32768))
    pair = lambda v: f"SELECT event_type, {v} AS v FROM {_PAIRS}"
    return {
        "scan_points": f"SELECT id, x, y FROM {_P}",
        "record_lookup": f"SELECT id, x, y FROM {_P} WHERE id = 17",
        "record_location": f"SELECT id, (1 + id // 1260)::INT AS block, (26 * (id % 1260))::BIGINT AS slot FROM {_P}",
        "osm_scan": "SELECT s_suppkey AS node_id, s_nationkey::DOUBLE AS x, s_acctbal::DOUBLE AS y, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name FROM supplier",
        "reuse_layout": f"SELECT id, x, y FROM {_E}",
        "range_query": in_box,
        "range_query_linear": in_box,
        "range_count": f"SELECT count(*) AS n FROM ({in_box})",
        "range_query_negative": f"SELECT * FROM {_C} WHERE x BETWEEN 2 AND 12 AND y BETWEEN -900 AND 1500",
        "range_query_vectors": f"SELECT id FROM {_V} WHERE list_min(coords) >= -0.3 AND list_max(coords) <= 0.3",
        "range_clustered": f"SELECT id, x, y FROM {_E} WHERE x BETWEEN 20 AND 60 AND y BETWEEN 5 AND 50",
        "point_lookup": f"SELECT * FROM {_P} WHERE x = 11 AND y = 900",
        "knn_query": knn_lines,
        "knn_query_linear": knn_lines,
        "knn_pruned": f"SELECT * FROM (SELECT id, x, y, sqrt((x - 75.0) * (x - 75.0) + (y - 60.0) * (y - 60.0)) AS dist FROM {_E}) WHERE dist > 0 ORDER BY dist, id LIMIT 10",
        "knn_vector": f"SELECT id, round(dist, 6) AS dist FROM (SELECT a.id, list_distance(a.coords, b.coords) AS dist FROM {_V} a, {_V} b WHERE b.id = 0) WHERE dist > 0 ORDER BY dist, id LIMIT 10",
        "skyline_query": _skyline(_P, "*"),
        "skyline_events": _skyline(_E, "id, x, y"),
        "skyline_distinct": f"SELECT min(id) AS id, x, y FROM ({_skyline(_P, '*')}) GROUP BY x, y",
        "skyline_ordered": f"SELECT *, row_number() OVER (ORDER BY x DESC, id) - 1 AS rank FROM ({_skyline(_P, '*')})",
        "skyline_pruned": _skyline(_E, "id, x, y"),
        "skyline_vectors": f"SELECT id FROM {_V} a WHERE NOT EXISTS (SELECT 1 FROM {_V} b WHERE list_bool_and(list_transform(list_zip(b.coords, a.coords), lambda t: t[1] <= t[2])) AND list_bool_or(list_transform(list_zip(b.coords, a.coords), lambda t: t[1] < t[2])))",
        "skyline_space": "WITH v AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey * 7919 % 1009)::DOUBLE AS z FROM part) SELECT id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.x <= a.x AND b.y <= a.y AND b.z <= a.z AND (b.x < a.x OR b.y < a.y OR b.z < a.z))",
        "mbr_points": f"SELECT * FROM {_T}",
        "mbr_rects": f"SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM {_T}",
        "rect_area": f"SELECT event_type, {_AREA} AS area FROM {_T}",
        "rect_margin": f"SELECT event_type, 2.0 * ((xmax - xmin) + (ymax - ymin)) AS margin FROM {_T}",
        "rect_intersects": pair("(xmin <= bxmax AND bxmin <= xmax AND ymin <= bymax AND bymin <= ymax)"),
        "rect_intersection_area": pair(_INTER),
        "rect_union_area": pair(f"{_AREA} + {_BAREA} - {_INTER}"),
        "rect_enlargement": pair(f"(greatest(xmax, bxmax) - least(xmin, bxmin)) * (greatest(ymax, bymax) - least(ymin, bymin)) - {_AREA}"),
        "mbr_enlarge": f"SELECT event_type, least(xmin, bxmin) AS xmin, least(ymin, bymin) AS ymin, greatest(xmax, bxmax) AS xmax, greatest(ymax, bymax) AS ymax FROM {_PAIRS}",
        "point_rect_mindist": f"SELECT event_type, sqrt(dx * dx + dy * dy) AS mindist FROM (SELECT event_type, greatest(xmin - 200.0, 0.0, 200.0 - xmax) AS dx, greatest(ymin + 10.0, 0.0, -10.0 - ymax) AS dy FROM {_T})",
        "sort_points": f"SELECT id, x, y, row_number() OVER (ORDER BY x, y, id) - 1 AS rank FROM {_P}",
        "sort_rects": f"SELECT id, {', '.join(f'row_number() OVER (ORDER BY {a}{e}, id) - 1 AS {a}_{b}' for a in 'xy' for b, e in (('lower', 'min'), ('upper', 'max')))} FROM (SELECT x::BIGINT AS id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {_E} GROUP BY 1)",
        "hilbert_sort": f"{_HILBERT} SELECT id, hilbert_key, rank FROM k",
        "bulk_load_leaves": f"{_leaves(leaf)} SELECT leaf_id, count(*) AS entries, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM l GROUP BY leaf_id",
        "tree_leaf_records": f"{_leaves(leaf)} SELECT leaf_id, id, x, y FROM l",
        "tree_nodes": f"{_nodes(leaf, inner)} SELECT * FROM t",
        "bulk_load_levels": f"{_nodes(leaf, inner)} SELECT level, count(*) AS nodes, sum(entries)::BIGINT AS entries FROM t GROUP BY level",
        "tree_dump": f"""{_nodes(leaf, inner)}
SELECT level, node_id, NULL::BIGINT AS record_id, format('level {{}} node {{}} parent {{}} entries {{}} box [{{:.2f}}, {{:.2f}}, {{:.2f}}, {{:.2f}}]', level, node_id, coalesce(parent_id::VARCHAR, '-'), entries, xmin, ymin, xmax, ymax) AS line FROM t
UNION ALL SELECT (SELECT max(level) FROM t) AS level, leaf_id AS node_id, id AS record_id, format('  record {{}} at {{:.2f}}, {{:.2f}}', id, x, y) AS line FROM l""",
        "tree_height": f"WITH RECURSIVE b(block_bytes, leaf, inner_) AS (VALUES {heights}), w AS (SELECT b.*, (SELECT ceil(count(*) / leaf)::BIGINT FROM events) AS nodes, 0 AS height FROM b UNION ALL SELECT block_bytes, leaf, inner_, ceil(nodes / inner_)::BIGINT, height + 1 FROM w WHERE nodes > 1) SELECT block_bytes::BIGINT AS block_bytes, leaf::BIGINT AS leaf, inner_::BIGINT AS inner_, max(height)::BIGINT AS height FROM w GROUP BY 1, 2, 3",
        "choose_subtree": _choose(True),
        "choose_subtree_inner": _choose(False),
        "choose_leaf": _descent(leaf, inner),
        "split_axis": f"{_split(_OVERFULL, _POINT_SORTS)} SELECT node_id, axis, round(margin, 2) AS margin FROM x",
        "split_leaf": f"{_split(_OVERFULL, _POINT_SORTS)} SELECT node_id, axis, sort, cut, overlap, area FROM f WHERE k = 1",
        "split_inner": f"{_split(_OVERFULL_INNER, _BOX_SORTS)} SELECT node_id, axis, sort, cut, overlap, area FROM f WHERE k = 1",
        "reinsert_candidates": f"""{_leaves(leaf)},
m AS (SELECT leaf_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, count(*) AS n FROM l GROUP BY leaf_id),
z AS (SELECT l.leaf_id, l.id, m.n, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM l JOIN m ON l.leaf_id = m.leaf_id),
a AS (SELECT *, row_number() OVER (PARTITION BY leaf_id ORDER BY dist DESC, id) AS k FROM z)
SELECT leaf_id, id, round(dist, 6) AS dist FROM a WHERE k <= floor(n * 0.3)""",
        "insert_record": f"SELECT id, x, y FROM {_P} UNION ALL SELECT 10000000, 3.5::DOUBLE, 950.25::DOUBLE",
        "insert_named_record": "SELECT s_suppkey AS id, s_nationkey::DOUBLE AS x, s_acctbal AS y, s_suppkey + 1 AS node_id, s_name AS name FROM supplier UNION ALL SELECT 10000000, 3.5::DOUBLE, 950.25::DOUBLE, 77, 'new'",
        # Records follow each other until one would not leave room for the end mark.
        "block_slots": """
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS record_id, s_suppkey + 1 AS node_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, 26 + coalesce(strlen(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END), 0) AS n FROM supplier),
w AS (
  SELECT record_id, node_id, name, 1 AS block, 0::BIGINT AS slot, n FROM r WHERE record_id = 0
  UNION ALL
  SELECT r.record_id, r.node_id, r.name, CASE WHEN w.slot + w.n + r.n + 2 >= 512 THEN w.block + 1 ELSE w.block END, CASE WHEN w.slot + w.n + r.n + 2 >= 512 THEN 0 ELSE w.slot + w.n END, r.n FROM w JOIN r ON r.record_id = w.record_id + 1
)
SELECT record_id, node_id, name, block, slot FROM w""",
        "delete_point": f"SELECT id, x, y FROM {_P} WHERE id NOT IN (SELECT min(id) FROM {_P} WHERE x = 11 AND y = 900 HAVING min(id) IS NOT NULL)",
        # Of the points at (5, 5), those of the table and the two new ones, the one of the smallest id goes.
        "compact_layout": f"WITH v AS (SELECT id, x, y FROM {_E} UNION ALL SELECT -1, 5.0::DOUBLE, 5.0::DOUBLE UNION ALL SELECT -2, 5.0::DOUBLE, 5.0::DOUBLE) SELECT id, x, y FROM v WHERE id <> (SELECT min(id) FROM v WHERE x = 5 AND y = 5)",
    }
