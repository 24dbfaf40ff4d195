"""Queries of tiles as a store, polygons with holes, lines that are simplified together, sets as runs, and search by many terms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir
from ..operators import generalise, polygons, reaches, search, spans, walks
from ..sources import tiles, tilestore
from .core import _SLOPES, _W, _r
from .tables import PX, PY, ZOOM, Tables, duck

QUERIES, ORACLE_SQL = {}, {}
#: Pixels of a tile along a side; degrees that lines are simplified by.
TILE, TOLERANCE = 64, 0.002


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = duck(oracle)
        return f

    return add


def _store(t: Tables) -> str:
    """The grid of the slope as published tiles: flow, areas at half the resolution, elevation a zoom lower."""
    cells = t("cells").join(t("acc").select("cell_id", "acc", "dir"), "cell_id").select(F.col("x").alias("px"), F.col("y").alias("py"), "dir", "cls", (F.col("acc") * 0.09).alias("acc"), "z")
    cells = cut(cells)
    low = cells.groupBy(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py")).agg((F.avg("z") / 10).alias("z"))
    drawn = tiles.flow_tiles(cells, TILE).unionByName(tiles.area_tiles(cells, TILE)).unionByName(tiles.elevation_tiles(low, TILE), allowMissingColumns=True)
    root = f"{shared_dir(t.spark)}/tiles-{uuid.uuid4().hex}"
    tilestore.publish(drawn, root)
    return root


@query("""
    WITH c AS MATERIALIZED (SELECT c.cell_id, c.x, c.y, c.z, c.cls, e.dir, a.acc FROM {cells} c JOIN {edges} e ON e.cell_id = c.cell_id JOIN {acc} a ON a.cell_id = c.cell_id),
    v AS (SELECT x // 2 AS hx, y // 2 AS hy, max(CAST(floor(greatest(0, least(255, log2(1 + acc * 0.09::DOUBLE) * 11))) AS INTEGER)) AS v, avg(z) / 10 AS z FROM c GROUP BY ALL),
    s AS (SELECT hx // 64 AS sx, hy // 64 AS sy, greatest(min(z), -600) AS base, max(z) AS hi FROM v GROUP BY ALL),
    k AS (SELECT *, greatest(0.25, (hi - base) / 250) AS step FROM s),
    p AS (SELECT drop_id, c.x, c.y, dir, cls FROM {drops} d JOIN c ON c.cell_id = d.cell_id)
    SELECT drop_id, dir, CAST(cls AS INTEGER) AS cls, round(CASE WHEN v = 0 THEN 0 ELSE pow(2, v / 11) - 1 END, 6) AS area, round(base + least(255, greatest(0, round_even((z - base) / step, 0))) * step, 6) AS elev, false AS incomplete
    FROM p JOIN v ON hx = p.x // 2 AND hy = p.y // 2 JOIN k ON k.sx = hx // 64 AND k.sy = hy // 64
    UNION ALL SELECT -1 - drop_id, 0, 1, 0, NULL, false FROM p""")
def tile_probe(t: Tables) -> DataFrame:
    """What published tiles say of each drop, and of a point far outside of the grid, where no tile was published."""
    at = t("drops").join(t("cells").select("cell_id", "x", "y"), "cell_id").select("drop_id", F.col("x").alias("px"), F.col("y").alias("py"))
    at = at.union(at.select(-1 - F.col("drop_id"), F.col("px") + 64000, F.col("py") - 64000))
    found, _ = tilestore.probe(at, tilestore.stored(t.spark, _store(t)), TILE, 1)
    return found.select("drop_id", "dir", "cls", F.round("area", 6).alias("area"), F.round("elev", 6).alias("elev"), "incomplete")


@query("SELECT x AS px, y AS py, CAST(e.dir + 16 * c.cls AS INTEGER) AS v FROM {cells} c JOIN {edges} e ON e.cell_id = c.cell_id WHERE x // 64 = 1")
def tile_pixels(t: Tables) -> DataFrame:
    """A column of tiles, read as a data source that opens no others."""
    found = tilestore.pixels(t.spark, _store(t)).where("layer = 'flow' and sx = 1").select("px", "py", "v")
    return found.join(t("cells").select(F.col("x").alias("px"), F.col("y").alias("py")), ["px", "py"], "left_semi")


@query("""
    WITH b AS MATERIALIZED (SELECT basin_id, x, y FROM {basin}),
    n AS (SELECT b.basin_id, b.x, b.y, e.x IS NOT NULL AS e, s.x IS NOT NULL AS s, d.x IS NOT NULL AS d FROM b LEFT JOIN b e ON e.basin_id = b.basin_id AND e.x = b.x + 1 AND e.y = b.y
        LEFT JOIN b s ON s.basin_id = b.basin_id AND s.x = b.x AND s.y = b.y + 1 LEFT JOIN b d ON d.basin_id = b.basin_id AND d.x = b.x + 1 AND d.y = b.y + 1)
    SELECT basin_id, count(*) AS cells, CAST(count(*) - sum(e::INT + s::INT) + sum((e AND s AND d)::INT) AS BIGINT) AS parts_less_holes, CAST(4 * count(*) - 2 * sum(e::INT + s::INT) AS BIGINT) AS border FROM n GROUP BY basin_id""")
def basin_polygons(t: Tables) -> DataFrame:
    """Basins as polygons. Their areas are those of their cells; parts less holes is Euler's number of a set of cells (cells less
    pairs side by side plus blocks of four); and their rings are as long as their borders."""
    cells = t("basin").select(F.col("basin_id").alias("mask_id"), (F.col("x") + PX).alias("px"), (F.col("y") + PY).alias("py"))
    found = polygons.polygons(cells, ZOOM)
    return found.groupBy(F.col("mask_id").alias("basin_id")).agg(F.sum("cells").alias("cells"), F.sum(2 - F.size("rings")).cast("long").alias("parts_less_holes"), F.sum("border").alias("border"))


@query("""
    WITH RECURSIVE a AS MATERIALIZED (SELECT * FROM {acc}), n AS MATERIALIZED (SELECT cell_id, parent_id FROM a WHERE acc >= 5),
    d AS MATERIALIZED (SELECT n.cell_id, n.parent_id FROM n JOIN n m ON m.cell_id = n.parent_id), deg AS (SELECT parent_id, count(*) AS k FROM d GROUP BY parent_id),
    h AS MATERIALIZED (SELECT n.cell_id FROM n LEFT JOIN deg ON deg.parent_id = n.cell_id WHERE coalesce(k, 0) <> 1),
    r(line_id, pos, cell_id, over) AS (SELECT cell_id, CAST(0 AS BIGINT), cell_id, false FROM h UNION ALL
        SELECT r.line_id, r.pos + 1, d.parent_id, h.cell_id IS NOT NULL FROM r JOIN d ON d.cell_id = r.cell_id LEFT JOIN h ON h.cell_id = d.parent_id WHERE NOT r.over),
    e AS (SELECT line_id, min_by(cell_id, pos) AS head, max_by(cell_id, pos) AS tail, max(pos) AS n FROM r GROUP BY line_id),
    m AS (SELECT cell_id, round((36352 + x + 0.5) / 65536.0 * 360 - 180, 9) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (19968 + y + 0.5) / 65536.0)))), 9) AS lat FROM {cells})
    SELECT line_id, p.lon AS lon0, p.lat AS lat0, q.lon AS lon1, q.lat AS lat1, 0::BIGINT AS new_crossings, true AS no_longer FROM e JOIN m p ON p.cell_id = e.head JOIN m q ON q.cell_id = e.tail WHERE n > 0""")
def reach_lines(t: Tables) -> DataFrame:
    """Reaches as lines, simplified together: their ends are those of their cells, and none crosses one that it did not cross."""
    given = cut(reaches.lines(reaches.extract(t("acc"), 5), t("cells"), ZOOM, PX, PY))
    thin = cut(generalise.simplified(given, TOLERANCE))
    pairs = generalise.crossings(thin, TOLERANCE * 16).join(generalise.crossings(given, TOLERANCE * 16), ["one", "two"], "left_anti")
    hit = pairs.select(F.col("one").alias("line_id")).union(pairs.select("two")).groupBy("line_id").agg(F.count(F.lit(1)).alias("k"))
    n = given.select("line_id", F.size("coords").alias("n"))
    first, last = F.get("coords", F.lit(0)), F.element_at("coords", -1)
    ends = [F.round(p[c], 9).alias(f"{c}{i}") for i, p in enumerate((first, last)) for c in ("lon", "lat")]
    return thin.join(hit, "line_id", "left").join(n, "line_id").select("line_id", *ends, F.coalesce("k", F.lit(0)).cast("long").alias("new_crossings"), (F.size("coords") <= F.col("n")).alias("no_longer"))


@query("""
    WITH n AS (SELECT cell_id, parent_id, acc FROM {acc} WHERE acc >= 5), l AS (SELECT unnest([0, 1, 2]) AS lod, unnest([60, 20, 5]) AS least),
    d AS MATERIALIZED (SELECT l.lod, n.cell_id, n.parent_id FROM n JOIN n m ON m.cell_id = n.parent_id JOIN l ON n.acc >= l.least AND m.acc >= l.least),
    deg AS (SELECT lod, parent_id, count(*) AS k FROM d GROUP BY lod, parent_id),
    h AS MATERIALIZED (SELECT l.lod, n.cell_id FROM n JOIN l ON n.acc >= l.least LEFT JOIN deg ON deg.parent_id = n.cell_id AND deg.lod = l.lod WHERE coalesce(k, 0) <> 1)
    SELECT CAST(h.lod AS INTEGER) AS lod, h.cell_id AS line_id, round(CAST(a.acc AS DOUBLE), 1) AS up, true AS ends_meet FROM h JOIN d ON d.lod = h.lod AND d.cell_id = h.cell_id JOIN {acc} a ON a.cell_id = h.cell_id""")
def river_layers(t: Tables) -> DataFrame:
    """Lines of three levels; each ends in a vertex that another line of its level begins with, or where no water goes on."""
    grid = t("cells").join(t("acc").select("cell_id", "parent_id", "acc"), "cell_id")
    drawn = cut(reaches.layers(grid, (60.0, 20.0, 5.0), (0.02, 0.005, 0.0025), ZOOM, PX, PY))
    body = reaches.lines(reaches.extract(grid.select("cell_id", "parent_id", "acc"), 5), grid, ZOOM, PX, PY)  # what goes on is part of the finest level
    return _met(drawn, body).select("lod", "line_id", F.round(F.col("up").cast("double"), 1).alias("up"), "ends_meet")


def _met(drawn: DataFrame, body: DataFrame) -> DataFrame:
    """drawn with ends_meet: whether a line ends where another of its level begins, or where none of the lines of body begins."""
    first, last = F.get("coords", F.lit(0)), F.element_at("coords", -1)
    starts = drawn.select("lod", first.alias("e")).distinct().withColumn("met", F.lit(True))
    mouths = body.select(last.alias("m")).join(body.select(first.alias("m")), "m", "left_anti").distinct()
    each = F.explode(F.array(*(F.struct(F.lit(lod).alias("lod"), reaches.rounded(F.col("m"), lod).alias("e")) for lod in range(3)))).alias("at")
    mouths = mouths.select(each).select("at.*").distinct().withColumn("mouth", F.lit(True))
    out = drawn.withColumn("e", last).join(starts, ["lod", "e"], "left").join(mouths, ["lod", "e"], "left")
    return out.withColumn("ends_meet", F.coalesce("met", "mouth", F.lit(False)))


@query(f"""
    WITH w AS MATERIALIZED (SELECT drop_id, step, CAST(dist AS DOUBLE) AS dist, acc * 3.0::DOUBLE AS area, z / 10.0::DOUBLE AS elev, nation FROM {{steps}}),
    s AS (SELECT *, coalesce({_SLOPES}, 0.00003) AS slope, dist - lag(dist) {_W}) AS d, area - lag(area) {_W}) AS gain, lag(area) {_W}) AS before FROM w),
    v AS (SELECT *, CASE WHEN d > 0 THEN CASE WHEN area < 1 THEN least(0.6, greatest(0.03, 1.2 * sqrt(slope))) ELSE least(4.0, greatest(0.05, pow(0.3 * pow(greatest(area * 300 / 31557.6, 0.01), 0.3), 2.0 / 3) * sqrt(slope) / 0.04)) END END AS v FROM s),
    g AS (SELECT drop_id, max(dist) AS distance, coalesce(sum(d / v), 0) AS seconds, sum(d * v) AS vd, max(elev) - min(elev) AS fall, max_by(area, step) AS final_area FROM v GROUP BY drop_id),
    r AS (SELECT drop_id, step, gain, row_number() OVER (PARTITION BY drop_id ORDER BY gain DESC, step) AS r FROM s WHERE gain > greatest(25, 0.08 * before)),
    tr AS (SELECT drop_id, string_agg(step || ':' || CAST(gain AS BIGINT), ' ' ORDER BY r) AS tributaries FROM r WHERE r <= 6 GROUP BY drop_id),
    c AS (SELECT drop_id, string_agg(CAST(nation AS VARCHAR), ' ' ORDER BY first) AS countries FROM (SELECT drop_id, nation, min(step) AS first FROM w GROUP BY drop_id, nation) f GROUP BY drop_id)
    SELECT g.drop_id, distance, round(seconds, 3) AS seconds, round(CASE WHEN distance > 0 THEN vd / distance ELSE 0 END, 6) AS mean_velocity, round(fall, 4) AS fall, round(final_area * 300 / 31557.6, 8) AS discharge, coalesce(tributaries, '') AS tributaries, countries
    FROM g LEFT JOIN tr USING (drop_id) JOIN c USING (drop_id)""")
def analyse_paths(t: Tables) -> DataFrame:
    """Length, time, fall, tributaries and countries of each drop's path, from what cells know of the rest of their stems. Cells of 3 km2 here."""
    at = t("cells").join(t("acc"), "cell_id").select("cell_id", t.hop(), (F.col("acc") * 3.0).alias("area"), (F.col("z") / 10.0).alias("elev"), F.col("nation").cast("string").alias("country"))
    found = walks.analysed(t("acc"), t("drops"), cut(at))
    steps = F.transform("tributaries", lambda x: F.concat(x["step"].cast("string"), F.lit(":"), x["gain"].cast("long").cast("string")))
    return found.select("drop_id", "distance", _r("seconds", 3), _r("mean_velocity", 6), _r("fall", 4), _r("discharge", 8), F.array_join(steps, " ").alias("tributaries"), F.array_join("countries", " ").alias("countries"))


@query("""
    WITH m AS (SELECT o.outlet_id, c.y, c.x FROM {rough_outlets} o JOIN {rough_closure} a ON a.up = o.outlet_id JOIN {rough} c ON c.cell_id = a.cell_id),
    i AS (SELECT *, x - row_number() OVER (PARTITION BY outlet_id, y ORDER BY x) AS island FROM m)
    SELECT outlet_id, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY outlet_id, y, island""")
def watershed_spans(t: Tables) -> DataFrame:
    cells = t("rough").select("cell_id", "x", "y").join(t("rough_edges").select("cell_id", "parent_id"), "cell_id")
    return spans.catchments(cells, t("rough_outlets")).withColumnRenamed("set_id", "outlet_id")


@query("""
    WITH e AS (SELECT id, lower(name) AS folded, name, id % 8 AS rank, pop AS size, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM {place}),
    w AS (SELECT min(id) AS term_id, trim(term) AS term FROM (SELECT id, substr(name, CAST(1 + id % 6 AS BIGINT), CAST(1 + id % 5 AS BIGINT)) AS term FROM {place}) q GROUP BY trim(term) HAVING trim(term) <> ''),
    m AS (SELECT w.term_id, e.*, instr(folded, term) AS pos, length(term) AS n FROM w JOIN e ON instr(folded, term) > 0),
    o AS (SELECT *, CASE WHEN pos = 1 THEN 1 ELSE 2 END AS part, row_number() OVER (PARTITION BY term_id, name, round(lon, 1), round(lat, 1) ORDER BY pos > 1, rank, size DESC, lon, lat) AS k FROM m WHERE pos = 1 OR n > 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY term_id, part ORDER BY rank, size DESC, length(name), name, lon, lat) AS place FROM o WHERE k = 1)
    SELECT term_id, CAST(part AS INTEGER) AS part, CAST(place AS INTEGER) AS place, name, lon, lat FROM p WHERE place <= CASE part WHEN 1 THEN 9 ELSE 4 END""")
def search_terms(t: Tables) -> DataFrame:
    """Parts of names, of one to five letters, looked for among all names."""
    entries = t("place").select(F.col("id").alias("entry_id"), "name", (F.col("id") % 8).alias("rank"), F.col("pop").alias("size"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    part = F.trim(F.substr("name", (F.col("entry_id") % 6 + 1).cast("int"), (F.col("entry_id") % 5 + 1).cast("int")))
    terms = entries.groupBy(part.alias("term")).agg(F.min("entry_id").alias("term_id")).where("term <> ''")
    return search.search_many(entries, terms)
