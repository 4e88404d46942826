"""Spatial joins, polygon cells, cell-set algebra."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.catalog.q_grid import GRID, zone_cells
from hydrospark.operators import cleaning as C, spatial as S
from hydrospark.schema import Grid

EDGE = """ed AS MATERIALIZED (SELECT a.zone_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_rings a JOIN fx_rings b ON a.zone_id = b.zone_id AND b.seq = (a.seq + 1) % 6)"""
ROWS = """cc AS (SELECT r, c, (c + 0.5e0) * 10 AS x, (r + 0.5e0) * 10 AS y FROM (SELECT DISTINCT r, c FROM fx_cells)),
pin AS MATERIALIZED (SELECT zone_id, r, c FROM cc JOIN ed ON (y1 <= y) <> (y2 <= y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


def poly(q, touched=False):
    """Polygon cells held to the grid of the cell table."""
    return S.intersection(S.polygon_cells(q.rings, GRID, touched), q.cells)


@query("mask_cells", "rings cells", f"{EDGE}, {ROWS} SELECT zone_id, r, c FROM pin")
def mask_cells(q):
    return poly(q)


# touched: centre inside, or an edge has a point within the closed cell (checked by clipping the edge)
TOUCH = f"""{EDGE}, {ROWS}, cl AS (SELECT zone_id, r, c, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, c * 10.0e0 AS xa, c * 10.0e0 + 10 AS xb, r * 10.0e0 AS ya, r * 10.0e0 + 10 AS yb FROM ed JOIN cc ON
  x + 5 >= least(x1, x2) AND x - 5 <= greatest(x1, x2) AND y + 5 >= least(y1, y2) AND y - 5 <= greatest(y1, y2)),
tt AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((xa - x1) / dx, (xb - x1) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((ya - y1) / dy, (yb - y1) / dy) END) AS t0,
  least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((xa - x1) / dx, (xb - x1) / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest((ya - y1) / dy, (yb - y1) / dy) END) AS t1 FROM cl)
SELECT zone_id, r, c FROM pin UNION SELECT zone_id, r, c FROM tt WHERE t0 <= t1"""


@query("mask_cells_touched", "rings cells", TOUCH)
def mask_touched(q):
    return poly(q, True)


@query("rasterize", "rings cells", f"{EDGE}, {ROWS} SELECT r, c, arg_max(zone_id % 7, zone_id)::BIGINT AS attr FROM pin GROUP BY 1, 2")
def rasterize(q):
    attrs = q.rings.select("zone_id").distinct().withColumns({"attr": F.col("zone_id") % 7, "ord": F.col("zone_id")})
    return S.intersection(S.rasterize_attribute(q.rings, attrs, GRID, "attr", "ord"), q.cells).select("r", "c", "attr")


@query("ring_area", "rings", f"{EDGE} SELECT zone_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) AS area_m2 FROM ed GROUP BY 1")
def ring_area(q):
    return S.ring_area(q.rings).select("zone_id", r6("area_m2", digits=4))


@query("j11", "rings points", f"{EDGE}, p AS (SELECT point_id, x * 0.2e0 AS x, y * 0.2e0 AS y FROM fx_points) SELECT point_id, zone_id FROM p JOIN ed ON (y1 <= y) <> (y2 <= y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def j11(q):
    p = q.points.select("point_id", (F.col("x") * 0.2).alias("x"), (F.col("y") * 0.2).alias("y"))
    return S.points_in_polygons(p, q.rings, Grid(0.0, 0.0, 16.0, 16.0))


@query("zones_within", "rings cells", f"{EDGE}, {ROWS}, n AS (SELECT zone_id, count(*) AS n FROM pin GROUP BY 1), h AS (SELECT p.zone_id, x.ws_id, count(*) AS n FROM pin p JOIN fx_cells x ON x.r = p.r AND x.c = p.c GROUP BY 1, 2) SELECT h.zone_id AS inner_zone, h.ws_id AS outer_zone FROM h JOIN n ON n.zone_id = h.zone_id WHERE h.n = n.n")
def zones_within(q):
    return S.zones_within(poly(q), zone_cells(q))


@query("zones_crossed", "rings cells", f"{EDGE}, {ROWS} SELECT x.ws_id AS a_zone, p.zone_id AS b_zone, count(*) AS n FROM pin p JOIN fx_cells x ON x.r = p.r AND x.c = p.c GROUP BY 1, 2")
def zones_crossed(q):
    return S.zones_crossed(zone_cells(q), poly(q))


FOOT = """s0 AS (SELECT p.point_id, p.x, p.y, l.feature_id, l.seq, l.x1, l.y1, l.x2 - l.x1 AS dx, l.y2 - l.y1 AS dy FROM fx_points p JOIN fx_roads l
  ON p.x BETWEEN l.x1 - {d} AND l.x2 + {d} AND p.y BETWEEN least(l.y1, l.y2) - {d} AND greatest(l.y1, l.y2) + {d}),
s1 AS (SELECT *, least(greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0e0), 1e0) AS t FROM s0),
s2 AS (SELECT *, x1 + t * dx AS fx, y1 + t * dy AS fy, sqrt(pow(x - (x1 + t * dx), 2) + pow(y - (y1 + t * dy), 2)) AS d FROM s1),
s3 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, feature_id, seq) AS k FROM s2 WHERE d <= {d}) WHERE k = 1)"""


@query("j12", "points roads", f"{FOOT.format(d=10)} SELECT p.point_id, round(coalesce(s.fx, p.x), 6) AS snap_x, round(coalesce(s.fy, p.y), 6) AS snap_y, s.feature_id AS line_id, round(s.d, 6) AS snap_m FROM fx_points p LEFT JOIN s3 s ON s.point_id = p.point_id")
def j12(q):
    return S.snap_to_lines(q.points, q.roads, 10.0).select("point_id", r6("snap_x"), r6("snap_y"), "line_id", r6("snap_m"))


@query("breakline", "points roads", f"""{FOOT.format(d=10)}, h AS (SELECT *, ((seq % 4) * 3.0e0 + 2) / 2 AS h, sqrt(dx * dx + dy * dy) AS len FROM s3)
SELECT point_id, feature_id AS line_id, round(fx + dy / len * h, 6) AS x1, round(fy - dx / len * h, 6) AS y1, round(fx - dy / len * h, 6) AS x2, round(fy + dx / len * h, 6) AS y2 FROM h""")
def breakline(q):
    s = S.snap_to_lines(q.points, q.roads, 10.0)
    # width by road piece: the snapped piece starts at a multiple of 100 m
    pts = S.spread(q.points).join(s.select("point_id", ((F.floor(F.col("line.sx1") / 100) % 4) * 3.0).alias("road_width_m")), "point_id")
    return S.breaklines(pts, q.roads, 10.0).select("point_id", "line_id", r6("x1"), r6("y1"), r6("x2"), r6("y2"))


NEAR = """n0 AS (SELECT g.gauge_id, p.point_id, p.x, p.y, sqrt(pow(g.x - p.x, 2) + pow(g.y - p.y, 2)) AS d FROM fx_gauges g JOIN fx_points p ON abs(g.x - p.x) <= 30 AND abs(g.y - p.y) <= 30),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gauge_id ORDER BY d, point_id) AS k FROM n0 WHERE d <= 30) WHERE k = 1)"""


@query("j13", "points gauges", f"{NEAR} SELECT gauge_id, point_id, round(d, 6) AS distance_m FROM n1")
def j13(q):
    return S.nearest_within(q.gauges, q.points, 30.0, "gauge_id", "point_id").select("gauge_id", "point_id", r6("distance_m"))


@query("j14", "points gauges", f"""{NEAR}, o AS (SELECT point_id, arg_min(gauge_id, d * 1e9 + gauge_id / 1e6) AS gauge_id FROM n1 GROUP BY 1)
SELECT p.point_id, o.gauge_id, round(coalesce(g.x, p.x), 6) AS x, round(coalesce(g.y, p.y), 6) AS y, CASE WHEN o.gauge_id IS NULL THEN p.point_id * 2 ELSE g.gauge_id * 3 END AS grp
FROM fx_points p LEFT JOIN o ON o.point_id = p.point_id LEFT JOIN fx_gauges g ON g.gauge_id = o.gauge_id""")
def j14(q):
    pts = q.points.withColumn("grp", F.col("point_id") * 2)
    own = q.gauges.withColumn("grp", F.col("gauge_id") * 3)
    return S.replace_from_nearest(pts, own, 30.0, ["grp"]).select("point_id", "gauge_id", r6("x"), r6("y"), "grp")


@query("j15", "points gauges", """d AS (SELECT p.point_id, g.gauge_id, sqrt(pow(g.x - p.x, 2) + pow(g.y - p.y, 2)) AS d FROM fx_points p, fx_gauges g)
SELECT point_id, round(min(d), 6) AS distance_m FROM d GROUP BY 1""")
def j15(q):
    return S.nearest_any(q.points, q.gauges, 200.0, "point_id", "gauge_id").select("point_id", r6("distance_m"))


@query("j16", "rings cells", f"""{EDGE}, {ROWS}, ov AS (SELECT x.ws_id AS ws, p.zone_id, count(*) AS n FROM pin p JOIN fx_cells x ON x.r = p.r AND x.c = p.c GROUP BY 1, 2),
b AS (SELECT ws, max_by(zone_id, n * 1000000 - zone_id) AS z FROM ov GROUP BY 1), a AS (SELECT DISTINCT ws_id AS ws FROM fx_cells) SELECT a.ws AS hillslope_id, coalesce(b.z, a.ws % 5)::BIGINT AS soil_id FROM a LEFT JOIN b ON b.ws = a.ws""")
def j16(q):
    ov = S.zones_crossed(zone_cells(q), poly(q)).select(F.col("a_zone").alias("hillslope_id"), F.col("b_zone").alias("soil_id"), "n")
    near = q.cells.select(F.col("ws_id").alias("hillslope_id")).distinct().withColumn("soil_id", (F.col("hillslope_id") % 5).cast("bigint"))
    return S.overlap_or_nearest(ov, near, "hillslope_id", "soil_id")


@query("j17", "hillslope", """t AS (SELECT hillslope_id, (channel_id + k * 7) % 90 AS channel_id FROM fx_hillslope, (SELECT unnest([0, 1, 2]) AS k) WHERE hillslope_id % 4 <> 0),
l AS (SELECT *, 100.0e0 + (channel_id * 37) % 50 AS len FROM t), b AS (SELECT hillslope_id, max_by(channel_id, len * 1000 - channel_id) AS ch FROM l GROUP BY 1)
SELECT h.hillslope_id, coalesce(b.ch, h.channel_id) AS channel_id FROM fx_hillslope h LEFT JOIN b ON b.hillslope_id = h.hillslope_id""")
def j17(q):
    touch = q.hillslope.where("hillslope_id % 4 <> 0").select("hillslope_id", F.explode(F.array(*[(F.col("channel_id") + 7 * k) % 90 for k in range(3)])).alias("channel_id"))
    lengths = touch.select("channel_id").distinct().withColumn("length_m", 100.0 + (F.col("channel_id") * 37) % 50)
    return S.channel_of_hillslope(touch, q.hillslope.select("hillslope_id", "channel_id"), lengths)


CROSS = """x0 AS (SELECT a.feature_id AS road_id, b.feature_id AS stream_id, a.x1, a.y1, a.x2 - a.x1 AS ax, a.y2 - a.y1 AS ay, b.x2 - b.x1 AS bx, b.y2 - b.y1 AS by_, b.x1 - a.x1 AS ox, b.y1 - a.y1 AS oy
  FROM fx_roads a JOIN fx_streams b ON least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)),
x1 AS (SELECT *, (ox * by_ - oy * bx) / nullif(ax * by_ - ay * bx, 0) AS t, (ox * ay - oy * ax) / nullif(ax * by_ - ay * bx, 0) AS u FROM x0),
x2 AS (SELECT round(x1 + t * ax, 3) AS x, round(y1 + t * ay, 3) AS y, min(road_id) AS road_id, min(stream_id) AS stream_id FROM x1 WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY 1, 2)"""


@query("j18", "roads streams", f"{CROSS} SELECT row_number() OVER (ORDER BY x, y) AS point_no, x, y, road_id, stream_id FROM x2")
def j18(q):
    return S.line_crossings(q.roads, q.streams).select(F.col("point_no").cast("bigint").alias("point_no"), "x", "y", "road_id", "stream_id")


SEGC = """sg AS (SELECT feature_id, seq, x1 * 0.2e0 AS x1, y1 * 0.2e0 AS y1, (x2 - x1) * 0.2e0 AS dx, (y2 - y1) * 0.2e0 AS dy FROM fx_roads),
nc0 AS (SELECT r, c, (c + 0.5e0) * 10 AS x, (r + 0.5e0) * 10 AS y FROM fx_cells), nc1 AS (SELECT r, c, x, y, x1, y1, dx, dy, least(greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0e0), 1e0) AS t
  FROM nc0 JOIN sg ON x BETWEEN x1 - 20 AND x1 + dx + 20 AND y BETWEEN y1 - 20 - abs(dy) AND y1 + 20 + abs(dy)),
nc AS MATERIALIZED (SELECT r, c, min(sqrt(pow(x - x1 - t * dx, 2) + pow(y - y1 - t * dy, 2))) AS d FROM nc1 GROUP BY 1, 2)"""


def small_roads(q):
    return q.roads.select("feature_id", "seq", *[(F.col(k) * 0.2).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("stream_buffer", "roads cells", f"{SEGC} SELECT r, c, round(d, 6) AS distance_m FROM nc WHERE d <= 20")
def stream_buffer(q):
    return S.intersection(S.near_line_cells(small_roads(q), GRID, 20.0), q.cells).select("r", "c", r6("distance_m"))


def _corner(i, j):
    t = f"least(greatest(((x + {i} - x1) * dx + (y + {j} - y1) * dy) / (dx * dx + dy * dy), 0e0), 1e0)"
    return f"sqrt(pow(x + {i} - x1 - {t} * dx, 2) + pow(y + {j} - y1 - {t} * dy, 2))"


# parts of the line that lie within a cell: its parameter range clipped to the cell (slabs), empty if it passes by
SLAB = """greatest(CASE WHEN dx = 0 THEN CASE WHEN abs(x1 - x) <= 5 THEN 0e0 ELSE 2e0 END ELSE least((x - 5 - x1) / dx, (x + 5 - x1) / dx) END,
  CASE WHEN dy = 0 THEN CASE WHEN abs(y1 - y) <= 5 THEN 0e0 ELSE 2e0 END ELSE least((y - 5 - y1) / dy, (y + 5 - y1) / dy) END, 0e0)
 <= least(CASE WHEN dx = 0 THEN 1e0 ELSE greatest((x - 5 - x1) / dx, (x + 5 - x1) / dx) END, CASE WHEN dy = 0 THEN 1e0 ELSE greatest((y - 5 - y1) / dy, (y + 5 - y1) / dy) END, 1e0)"""
ENDS = [f"sqrt(pow(greatest(abs({a} - x) - 5, 0), 2) + pow(greatest(abs({b} - y) - 5, 0), 2))" for a, b in (("x1", "y1"), ("x1 + dx", "y1 + dy"))]
TOUCHED = f"""{SEGC}, to_ AS (SELECT DISTINCT r, c FROM nc1 WHERE {SLAB} OR least({', '.join([_corner(i, j) for i in (-5, 5) for j in (-5, 5)] + ENDS)}) <= 8)"""


@query("road_dem_adjust", "roads cells", f"{TOUCHED} SELECT x.r, x.c, round(x.z + CASE WHEN t.r IS NOT NULL THEN 5e0 ELSE 0e0 END, 6) AS z FROM fx_cells x LEFT JOIN to_ t ON t.r = x.r AND t.c = x.c")
def road_adjust(q):
    return S.adjust_along_lines(q.cells, small_roads(q), GRID, "z", 5.0, 8.0).select("r", "c", r6("z"))


@query("bbox_buffer", "points", "SELECT round(min(x) - 0.005e0, 6) AS min_x, round(max(x) + 0.005e0, 6) AS max_x, round(min(y) - 0.005e0, 6) AS min_y, round(max(y) + 0.005e0, 6) AS max_y FROM fx_points")
def bbox(q):
    return C.bbox(q.points, 0.005).select(*[r6(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("overland_length", "rings", "m AS (SELECT zone_id, min(x) AS px, min(y) AS py FROM fx_rings GROUP BY 1) SELECT m.zone_id, round(max(sqrt(pow(x - px, 2) + pow(y - py, 2))), 6) AS ov_len_m FROM m JOIN fx_rings r ON r.zone_id = m.zone_id GROUP BY 1")
def overland(q):
    pts = q.rings.groupBy("zone_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return S.overland_length(pts, q.rings).select("zone_id", r6("ov_len_m"))


@query("utm_zone", "points", "ll AS (SELECT point_id, -180 + (point_id * 37 % 3600) / 10.0e0 AS lon, -80 + (point_id * 13 % 1600) / 10.0e0 AS lat FROM fx_points) SELECT point_id, (floor((lon + 180) / 6) + 1)::INTEGER AS zone, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere, ((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + floor((lon + 180) / 6) + 1)::INTEGER AS epsg FROM ll")
def utm(q):
    lon, lat = -180 + (F.col("point_id") * 37 % 3600) / 10.0, -80 + (F.col("point_id") * 13 % 1600) / 10.0
    z, h, e = S.utm_zone(lon, lat)
    return q.points.select("point_id", z.alias("zone"), h.alias("hemisphere"), e.alias("epsg"))


LAT = f"""{EDGE}, bx AS (SELECT zone_id, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM fx_rings GROUP BY 1),
ij AS (SELECT zone_id, x0 + i * 7.0e0 AS x, y0 + j * 7.0e0 AS y FROM bx, (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 40)) AS j) WHERE i <= ceil((x9 - x0) / 7.0e0) AND j <= ceil((y9 - y0) / 7.0e0)),
ins AS (SELECT ij.zone_id, x, y FROM ij JOIN ed ON ed.zone_id = ij.zone_id AND (y1 <= y) <> (y2 <= y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query("grid_spacing", "rings", f"{LAT} SELECT zone_id, round(x, 6) AS x, round(y, 6) AS y FROM ins UNION ALL SELECT zone_id, round(avg(x), 6), round(avg(y), 6) FROM fx_rings GROUP BY 1")
def lattice(q):
    return S.lattice_points(q.rings, 7.0).select("zone_id", r6("x"), r6("y"))


@query("flag_outside_boundary", "cells", "SELECT ws_id AS zone_id, round(count(*) * 0.01e0, 6) AS outside_ha FROM fx_cells WHERE NOT (c BETWEEN 10 AND 70) GROUP BY 1 HAVING count(*) * 0.01e0 > 0.5e0")
def outside(q):
    return C.flag_outside_boundary(zone_cells(q), q.cells.where("c BETWEEN 10 AND 70"), GRID.cell_area).select("zone_id", r6("outside_ha"))


@query("filter_area", "watersheds", "SELECT point_id FROM fx_watersheds WHERE area_ha >= 50")
def filter_area(q):
    return C.filter_area(q.watersheds, q.points, 50.0)[1].select("point_id")


@query("u1", "points gauges", "SELECT point_id AS id, x, y FROM fx_points UNION ALL SELECT gauge_id, x, y FROM fx_gauges")
def u1(q):
    return q.points.select(F.col("point_id").alias("id"), "x", "y").unionByName(q.gauges.select(F.col("gauge_id").alias("id"), "x", "y"))


@query("u2", "cells rings", f"{EDGE}, {ROWS} SELECT ws_id AS zone_id, r, c FROM fx_cells x WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.r = x.r AND pin.c = x.c)")
def u2(q):
    return S.difference(zone_cells(q), poly(q)).select("zone_id", "r", "c")


@query("u3", "cells rings", f"{EDGE}, {ROWS} SELECT ws_id AS zone_id, r, c FROM fx_cells x WHERE EXISTS (SELECT 1 FROM pin WHERE pin.r = x.r AND pin.c = x.c)")
def u3(q):
    return S.intersection(zone_cells(q), poly(q)).select("zone_id", "r", "c")


@query("u4", "rings cells", f"{EDGE}, {ROWS} SELECT DISTINCT zone_id % 5 AS zone_id, r, c FROM pin")
def u4(q):
    return S.union_cells(poly(q).withColumn("zone_id", F.col("zone_id") % 5))


@query("u5", "points gauges", "SELECT point_id FROM fx_points WHERE point_id NOT IN (SELECT gauge_id FROM fx_gauges)")
def u5(q):
    return q.points.select("point_id").join(q.gauges.select(F.col("gauge_id").alias("point_id")), "point_id", "left_anti")


@query("u6", "cells", """w AS MATERIALIZED (SELECT ws_id, r, c, r::BIGINT * 4294967296 + c AS cell FROM fx_cells WHERE NOT (c % 25 = 7 OR r % 25 = 11)),
k AS (SELECT ws_id, r, c, ws_id * 4 + (CASE WHEN c % 25 > 7 THEN 1 ELSE 0 END) + (CASE WHEN r % 25 > 11 THEN 2 ELSE 0 END) AS g, cell FROM w) SELECT ws_id AS zone_id, r, c, min(cell) OVER (PARTITION BY g) AS part FROM k""")
def u6(q):
    return S.split_by_lines(zone_cells(q), q.cells.where("c % 25 = 7 OR r % 25 = 11")).select("zone_id", "r", "c", "part")


@query("j1", "watersheds points", "SELECT w.point_id, w.area_ha, p.x, p.y FROM fx_watersheds w LEFT JOIN fx_points p ON p.point_id = w.point_id AND p.point_id % 3 <> 0")
def j1(q):
    return q.watersheds.select("point_id", "area_ha").join(q.points.where("point_id % 3 <> 0"), "point_id", "left")


@query("j2", "descriptors gauges", "SELECT d.point_id, CASE WHEN d.point_id % 40 = 0 THEN 'ST' || g.gauge_id ELSE d.gws_id::VARCHAR END AS gws_id FROM fx_descriptors d LEFT JOIN fx_gauges g ON g.gauge_id = d.gws_id")
def j2(q):
    from hydrospark.plans.characteristics import name_gauged
    st = q.gauges.select(F.col("gauge_id").alias("station_key"), F.concat(F.lit("ST"), F.col("gauge_id")).alias("station_name"))
    d = q.descriptors.select("point_id", F.col("gws_id").cast("string").alias("gws_id"), F.col("gws_id").alias("station_key"),
                             F.when(F.col("point_id") % 40 == 0, 1).otherwise(0).alias("flag_gst"))
    return name_gauged(d, st).select("point_id", "gws_id")


@query("j5", "cells points", "SELECT x.r, x.c, p.first_id FROM fx_cells x LEFT JOIN (SELECT point_id % 100 AS v, min(point_id) AS first_id FROM fx_points GROUP BY 1) p ON p.v = x.c")
def j5(q):
    pts = q.points.withColumn("c", (F.col("point_id") % 100).cast("int"))
    one = C.first_per_id(pts, ["c"], [F.col("point_id")]).select("c", F.col("point_id").alias("first_id"))
    return q.cells.select("r", "c").join(one, "c", "left")


@query("j6", "watersheds culverts", "SELECT w.point_id, w.area_ha, w.cn_val, c.point_id AS orig_fid, c.material, c.cond FROM fx_watersheds w LEFT JOIN fx_culverts c ON c.point_id = w.point_id")
def j6(q):
    from hydrospark.plans.characteristics import keep_original_attributes
    orig = q.culverts.select("point_id", "material", "cond", F.lit(0).alias("area_ha"), F.col("point_id").alias("fid"))
    return keep_original_attributes(q.watersheds.select("point_id", "area_ha", "cn_val"), orig, "point_id")


@query("j7", "watersheds", "SELECT point_id, area_ha, area_ha * 2 AS area_ha_r FROM fx_watersheds")
def j7(q):
    from hydrospark.plans.characteristics import results_onto
    res = q.watersheds.select("point_id", (F.col("area_ha") * 2).alias("area_ha"))
    return results_onto(q.watersheds.select("point_id", "area_ha"), res, "point_id")


@query("j25", "watersheds points", "SELECT point_id, CASE WHEN point_id IN (SELECT point_id FROM fx_watersheds WHERE area_ha > 300) THEN 'flagged' ELSE 'kept' END AS side FROM fx_points")
def j25(q):
    big = q.watersheds.where("area_ha > 300").select(F.col("point_id").alias("zone_id"))
    zones = q.points.select(F.col("point_id").alias("zone_id"))
    flagged, kept = C.split_flagged(zones, big)
    return flagged.select(F.col("zone_id").alias("point_id"), F.lit("flagged").alias("side")).unionByName(kept.select(F.col("zone_id").alias("point_id"), F.lit("kept").alias("side")))


@query("first_per_id", "series", "SELECT site, obs_id, yr FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY obs_id) AS k FROM fx_series) WHERE k = 1")
def first_per_id(q):
    return C.first_per_id(q.series.select("site", "obs_id", "yr"), ["site"], [F.col("obs_id")])


@query("largest_overlap", "rings cells", f"{EDGE}, {ROWS} SELECT a_zone, max_by(b_zone, n * 1000000 - b_zone) AS b_zone FROM (SELECT x.ws_id AS a_zone, p.zone_id AS b_zone, count(*) AS n FROM pin p JOIN fx_cells x ON x.r = p.r AND x.c = p.c GROUP BY 1, 2) GROUP BY 1")
def largest_overlap(q):
    ov = S.zones_crossed(zone_cells(q), poly(q))
    return ov.groupBy("a_zone").agg(F.max_by("b_zone", F.struct("n", -F.col("b_zone"))).alias("b_zone"))
