"""Derived tables and statements in the SQL that Spark and DuckDB share; DIV is integer division."""

from __future__ import annotations

_GRID = """(SELECT o_orderkey AS cell_id, o_custkey, o_orderkey % w AS x, o_orderkey DIV w AS y, w, (n - 1) DIV w AS bottom FROM {orders}
            CROSS JOIN (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM {orders}) n)"""
_BORDER = "x = 0 OR y = 0 OR x = w - 1 OR y = bottom"
_OFFSETS = "(1,1,0,1.0::DOUBLE),(2,1,1,1.41421356::DOUBLE),(3,0,1,1.0::DOUBLE),(4,-1,1,1.41421356::DOUBLE),(5,-1,0,1.0::DOUBLE),(6,-1,-1,1.41421356::DOUBLE),(7,0,-1,1.0::DOUBLE),(8,1,-1,1.41421356::DOUBLE)"


def _descent(cells: str) -> str:
    """Directions over a table of cells with z and terminal: a cell of the border, which has less than eight neighbours, or a
    terminal one has none."""
    return f"""
        WITH c AS MATERIALIZED ({cells}), o(k, dx, dy, len) AS (VALUES {_OFFSETS}),
        b AS (SELECT c.cell_id, o.k, m.cell_id AS nid, c.z - m.z AS fall, count(*) OVER (PARTITION BY c.cell_id) AS around,
                row_number() OVER (PARTITION BY c.cell_id ORDER BY CASE WHEN m.z < c.z THEN (c.z - m.z) / o.len ELSE -1 END DESC, o.k) AS r
            FROM c CROSS JOIN o JOIN c m ON m.cell_id = c.cell_id + o.dx + o.dy * c.w WHERE NOT c.terminal AND c.x + o.dx BETWEEN 0 AND c.w - 1)
        SELECT c.cell_id, CAST(coalesce(b.k, 0) AS INTEGER) AS dir, b.nid AS parent_id FROM c LEFT JOIN b ON b.cell_id = c.cell_id AND b.r = 1 AND b.around = 8 AND b.fall > 0"""


def _closure(edges: str) -> str:
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), r(cell_id, up, step) AS (SELECT cell_id, cell_id, 0 FROM e UNION ALL
            SELECT r.cell_id, e.parent_id, r.step + 1 FROM r JOIN e ON e.cell_id = r.up WHERE e.parent_id IS NOT NULL) SELECT * FROM r"""


def _paths(edges: str) -> str:
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), r(drop_id, step, cell_id) AS (SELECT drop_id, CAST(0 AS BIGINT), cell_id FROM {{drops}} UNION ALL
            SELECT r.drop_id, r.step + 1, e.parent_id FROM r JOIN e ON e.cell_id = r.cell_id WHERE e.parent_id IS NOT NULL) SELECT drop_id, step, cell_id FROM r"""


#: Tables that statements start from. Those that operators make in Spark are written here as DuckDB makes them.
DERIVED = {
    # a slope with long paths, and a rough grid with pits and all directions, which is filled first; every order is a cell
    "cells": f"""
        SELECT cell_id, x, y, (w - x) * 1000 + (w - y) * 700 + (o_custkey * 37 + cell_id * 11) % 900 AS z, w, CASE WHEN x >= w - 4 THEN 1 WHEN {_BORDER} THEN 4
            WHEN (x DIV 8 + y DIV 8) % 11 = 0 THEN 2 WHEN x < 4 AND y < 4 THEN 5 ELSE 0 END AS cls, (x DIV 25 + 3 * (y DIV 25)) % 25 AS nation, x >= w - 4 OR {_BORDER} AS terminal FROM {_GRID} c""",
    "rough": f"SELECT cell_id, x, y, (o_custkey * 7919 + cell_id * 104729) % 1009 AS z, w, CASE WHEN x >= w - 4 THEN 1 WHEN {_BORDER} THEN 4 ELSE 0 END AS cls, x >= w - 4 OR {_BORDER} AS terminal FROM {_GRID} c",
    "filled": """
        WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {rough}), o(dx, dy) AS (VALUES (1,0),(1,1),(0,1),(-1,1),(-1,0),(-1,-1),(0,-1),(1,-1)),
        n AS MATERIALIZED (SELECT c.cell_id, CAST(c.z AS FLOAT) AS z, m.cell_id AS nid FROM c CROSS JOIN o JOIN c m ON m.cell_id = c.cell_id + o.dx + o.dy * c.w WHERE NOT c.terminal AND c.x + o.dx BETWEEN 0 AND c.w - 1),
        f(cell_id, level) USING KEY (cell_id) AS (SELECT cell_id, CAST(z AS FLOAT) FROM c WHERE terminal UNION
            SELECT s.cell_id, s.level FROM (SELECT n.cell_id, min(CASE WHEN n.z > f.level THEN n.z ELSE f.level + CAST(0.001 AS FLOAT) END) AS level FROM f JOIN n ON n.nid = f.cell_id GROUP BY n.cell_id) s
            LEFT JOIN recurring.f k ON k.cell_id = s.cell_id WHERE k.level IS NULL OR s.level < k.level)
        SELECT cell_id, level AS filled FROM f""",
    "edges": _descent("SELECT * FROM {cells}"),
    "rough_edges": _descent("SELECT r.cell_id, r.x, r.y, r.w, r.terminal, CAST(f.filled AS DOUBLE) AS z FROM {rough} r JOIN {filled} f ON f.cell_id = r.cell_id"),
    "closure": _closure("{edges}"),
    "rough_closure": _closure("{rough_edges}"),
    "acc": "SELECT e.cell_id, a.acc, e.dir, e.parent_id FROM {edges} e JOIN (SELECT up, count(*) AS acc FROM {closure} GROUP BY up) a ON a.up = e.cell_id",
    "rough_acc": "SELECT e.cell_id, a.acc, e.dir, e.parent_id FROM {rough_edges} e JOIN (SELECT up, count(*) AS acc FROM {rough_closure} GROUP BY up) a ON a.up = e.cell_id",
    "term": "SELECT cell_id, max_by(up, step) AS term FROM {closure} GROUP BY cell_id",
    "rough_term": "SELECT cell_id, max_by(up, step) AS term FROM {rough_closure} GROUP BY cell_id",
    "drops": "SELECT event_id AS drop_id, (user_id * 7919 + event_id * 31) % n AS cell_id FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {orders}) n",
    "path": _paths("{edges}"),
    "rough_path": _paths("{rough_edges}"),
    "outlet_points": "SELECT cell_id AS outlet_id FROM {acc} WHERE acc >= 100",
    "basin": "SELECT t.term AS basin_id, c.* FROM {term} t JOIN {cells} c ON c.cell_id = t.cell_id",
    "rough_outlets": "SELECT cell_id AS outlet_id FROM {rough_acc} WHERE acc >= 40",
    "place": "SELECT p_partkey AS id, p_name AS name, (p_partkey * 37 % 360) - 180 + (p_size % 10) * 0.013 AS lon, (p_partkey * 53 % 170) - 85 + (p_size % 7) * 0.011 AS lat, p_partkey * p_size AS pop FROM {part}",
    # lengths along the grid: 300 m across, 424 m diagonal; z is in decimetres
    "steps": """
        SELECT drop_id, step, cell_id, x, y, z, cls, nation, acc, sum(d) OVER (PARTITION BY drop_id ORDER BY step) AS dist FROM (
            SELECT p.drop_id, p.step, p.cell_id, c.x, c.y, c.z, c.cls, c.nation, a.acc,
                CASE WHEN lag(c.x) OVER (PARTITION BY p.drop_id ORDER BY p.step) IS NULL THEN 0
                    WHEN lag(c.x) OVER (PARTITION BY p.drop_id ORDER BY p.step) <> c.x AND lag(c.y) OVER (PARTITION BY p.drop_id ORDER BY p.step) <> c.y THEN 424 ELSE 300 END AS d
            FROM {path} p JOIN {cells} c ON c.cell_id = p.cell_id JOIN {acc} a ON a.cell_id = p.cell_id) s""",
}

_SIZE = "CASE WHEN {0} < 0.5 THEN 'Overland flow' WHEN {0} < 5 THEN 'Headwater stream' WHEN {0} < 50 THEN 'Stream' WHEN {0} < 500 THEN 'Small river' WHEN {0} < 5000 THEN 'River' WHEN {0} < 50000 THEN 'Major river' ELSE 'Great river' END"
_PATH = "OVER (PARTITION BY drop_id ORDER BY step"

STATEMENTS = {
    # joins and degrees
    "downstream_join": "SELECT e.cell_id, e.parent_id, c.z - n.z AS fall FROM {edges} e JOIN {cells} c ON c.cell_id = e.cell_id JOIN {cells} n ON n.cell_id = e.parent_id",
    "in_degree": "SELECT parent_id AS cell_id, count(*) AS degree FROM {edges} WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "upstream_neighbours": "SELECT e.parent_id AS cell_id, e.cell_id AS above, a.acc, row_number() OVER (PARTITION BY e.parent_id ORDER BY a.acc DESC, e.cell_id) AS rank FROM {edges} e JOIN {acc} a ON a.cell_id = e.cell_id WHERE e.parent_id IS NOT NULL",
    "stream_threshold": "SELECT acc >= 50 AS lod0, acc >= 10 AS lod1, count(*) AS cells FROM {acc} WHERE acc >= 3 GROUP BY acc >= 50, acc >= 10",
    "direction_histogram": "SELECT dir, count(*) AS cells FROM {edges} GROUP BY dir",
    "mass_conservation": "SELECT CAST(sum(acc) AS BIGINT) AS drained, (SELECT count(*) FROM {cells}) AS cells FROM {acc} WHERE parent_id IS NULL",
    "watershed_totals": "SELECT o.outlet_id, a.acc AS cells, a.acc * 90000 AS area_m2 FROM {outlet_points} o JOIN {acc} a ON a.cell_id = o.outlet_id",
    "reach_heads": "SELECT a.cell_id, coalesce(d.n, 0) AS degree FROM {acc} a LEFT JOIN (SELECT parent_id, count(*) AS n FROM {acc} WHERE acc >= 5 AND parent_id IS NOT NULL GROUP BY parent_id) d ON d.parent_id = a.cell_id WHERE a.acc >= 5 AND coalesce(d.n, 0) <> 1",
    # basins
    "top_basins": "SELECT basin_id, count(*) AS cells FROM {basin} GROUP BY basin_id ORDER BY cells DESC, basin_id LIMIT 50",
    "size_class_hist": f"SELECT {_SIZE.format('acc * 0.09')} AS size_class, count(*) AS cells FROM {{acc}} GROUP BY 1",
    # paths
    "trace_ends": "SELECT drop_id, max(step) AS steps, CAST(max(dist) AS BIGINT) AS dist, max_by(cell_id, step) AS last_cell FROM {steps} GROUP BY drop_id",
    "discharge": "SELECT cell_id, round(acc * 0.09E0 * 300 / 31557.6E0, 8) AS m3s FROM {acc} WHERE acc >= 10",
    "journey_steps": f"SELECT drop_id, run, min(step) AS first_step, max(step) AS last_step, min(cls) AS cls, min(nation) AS nation, CAST(max(dist) - min(dist) AS BIGINT) AS length FROM (SELECT *, CAST(sum(cut) {_PATH}) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(cls) {_PATH}) = cls AND lag(nation) {_PATH}) = nation THEN 0 ELSE 1 END AS cut FROM {{steps}}) a) b GROUP BY drop_id, run",
    "ordered_countries": "SELECT drop_id, nation, n_name, row_number() OVER (PARTITION BY drop_id ORDER BY first_step) AS place FROM (SELECT drop_id, nation, min(step) AS first_step FROM {steps} GROUP BY drop_id, nation) f JOIN {nation} n ON n.n_nationkey = f.nation",
    "drop_basin": "SELECT d.drop_id, d.cell_id, t.term AS basin_id, c.cls FROM {drops} d JOIN {term} t ON t.cell_id = d.cell_id LEFT JOIN {cells} c ON c.cell_id = t.term",
    # rasters and encodings
    "pool_mean": "SELECT x DIV 8 AS bx, y DIV 8 AS bky, round(avg(z), 6) AS z FROM {cells} GROUP BY x DIV 8, y DIV 8",
    "pool_max": "SELECT c.x DIV 8 AS bx, c.y DIV 8 AS bky, max(a.acc) AS acc FROM {cells} c JOIN {acc} a ON a.cell_id = c.cell_id GROUP BY c.x DIV 8, c.y DIV 8",
    "pool_argmax": "SELECT bx, bky, cell_id, acc FROM (SELECT c.x DIV 8 AS bx, c.y DIV 8 AS bky, a.cell_id, a.acc, row_number() OVER (PARTITION BY c.x DIV 8, c.y DIV 8 ORDER BY a.acc DESC, a.cell_id) AS r FROM {cells} c JOIN {acc} a ON a.cell_id = c.cell_id) s WHERE r = 1",
    "pool_any": "SELECT x DIV 4 AS bx, y DIV 4 AS bky, max(CASE WHEN cls = 2 THEN 1 ELSE 0 END) AS lake FROM {cells} GROUP BY x DIV 4, y DIV 4",
    "flow_byte_pack": "SELECT b, b & 15 AS dir, b >> 4 AS cls, count(*) AS cells FROM (SELECT CAST(e.dir + c.cls * 16 AS INT) AS b FROM {edges} e JOIN {cells} c ON c.cell_id = e.cell_id) s GROUP BY b",
    "missing_tiles": "SELECT DISTINCT c.x DIV 16 AS tx, c.y DIV 16 AS ty FROM {cells} c LEFT ANTI JOIN (SELECT DISTINCT x DIV 16 AS ox, y DIV 16 AS oy FROM {cells} WHERE cls = 2) o ON o.ox = c.x DIV 16 AND o.oy = c.y DIV 16",
    # climate, by month
    "snow_fraction": "SELECT cell_id, round(least(1.0E0, greatest(0.0E0, (3 - (z / 10000.0E0 - 4)) / 4)), 6) AS snow, round(greatest(z / 10000.0E0 - 4, 0.0E0) * 3.0E0 * 28.25E0, 6) AS melt FROM {cells}",
    "orographic_precip": "SELECT cell_id, round(least(6000.0E0, greatest(20.0E0, 800 * least(3.2E0, greatest(0.35E0, 1 + 0.00055E0 * (z / 10.0E0 - 2000))))), 4) AS precip, round(15 - 0.0065E0 * z / 10, 6) AS temp FROM {cells}",
    # spatial joins by bucket
    "point_in_box": "WITH b AS (SELECT n_nationkey AS id, n_nationkey % 5 * 20 AS x0, n_nationkey DIV 5 * 20 AS y0 FROM {nation}) SELECT d.drop_id, min(b.id) AS box FROM {drops} d JOIN {cells} c ON c.cell_id = d.cell_id JOIN b ON b.x0 DIV 20 = c.x DIV 20 AND b.y0 DIV 20 = c.y DIV 20 WHERE NOT (c.x - b.x0 BETWEEN 8 AND 11 AND c.y - b.y0 BETWEEN 8 AND 11) GROUP BY d.drop_id",
    # names and search
    "union_lakes": "SELECT cell_id FROM {cells} WHERE cls = 2 UNION SELECT cell_id FROM {cells} WHERE x % 31 = 7 AND y % 29 = 3",
}
STATEMENTS["missing_tiles"] = "SELECT DISTINCT c.x DIV 16 AS tx, c.y DIV 16 AS ty FROM {cells} c WHERE NOT EXISTS (SELECT 1 FROM {cells} o WHERE o.cls = 2 AND o.x DIV 16 = c.x DIV 16 AND o.y DIV 16 = c.y DIV 16)"
