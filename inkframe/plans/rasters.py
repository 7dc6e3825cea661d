"""Page rasters: profiles, crops, grey levels, masks, alignment and digit bitmaps."""

import math

from pyspark.sql import functions as F

from ..functions.rounding import luma
from ..functions.taxonomy import taxonomy
from ..operators import calibration, islands, raster
from ..operators.ordered import tasks_for
from . import views
from .registry import query
from .views import PAGE_H, PAGE_W, SQL, table, with_views


def text_lines(lines):
    """Lines as comma-separated text, so that they compare whole."""
    return lines.select("page", "y", F.array_join(F.transform("px", lambda v: v.cast("string")), ",").alias("px"))


def rects(spark, sf_dir):
    return views.cells_map(spark, sf_dir).select(
        "page", "cell", *[F.col(f"total_{a}").alias(a) for a in "xywh"]
    )


AS_LINES = "string_agg(CAST(v AS VARCHAR), ',' ORDER BY x) AS px"


@query("q_luma", with_views("""
SELECT page, sum(CAST(floor((v * 299 + ((v + 1) % 256) * 587 + ((v + 2) % 256) * 114) / 1000) AS BIGINT)) AS grey, y
FROM raster GROUP BY page, y""".replace("sum(", "CAST(sum(").replace(" AS grey", " AS BIGINT) AS grey"), "raster"))
def q_luma(spark, sf_dir):
    """Grey lines from colour lines: v, v+1 and v+2 stand for the three channels."""
    lines = views.scanlines(spark, sf_dir)
    grey = F.transform("px", lambda v: luma(v, (v + 1) % 256, (v + 2) % 256))
    return lines.select("page", "y", F.aggregate(grey, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("grey"))


@query("q_override", with_views("""WITH ov AS (
  SELECT s_suppkey AS page, CASE WHEN s_nationkey % 3 = 0 THEN 999 ELSE 18 + (s_suppkey * 20) % 93 END AS item_row,
         CAST(s_nationkey AS BIGINT) AS ov_y, CASE WHEN s_nationkey % 2 = 1 THEN CAST(7 AS BIGINT) END AS ov_h FROM supplier)
SELECT c.page, c.item_row, c.cell, coalesce(ov_y, total_y) AS total_y, coalesce(ov_h, total_h) AS total_h,
       ov.page IS NOT NULL AS overridden
FROM cells_map c LEFT JOIN ov USING (page, item_row)
UNION ALL
SELECT page, item_row, NULL, ov_y, ov_h, NULL FROM ov
WHERE NOT EXISTS (SELECT 1 FROM cells_map c WHERE c.page = ov.page AND c.item_row = ov.item_row)""", "cells_map"))
def q_override(spark, sf_dir):
    s = F.col("s_suppkey")
    n = views.whole("s_nationkey")
    ov = table(spark, sf_dir, "supplier").select(
        s.alias("page"), F.when(n % 3 == 0, 999).otherwise((s * 20) % 93 + 18).alias("item_row"),
        n.alias("total_y"), F.when(n % 2 == 1, 7).cast("bigint").alias("total_h"),
    )
    cells = views.cells_map(spark, sf_dir)
    patched = calibration.apply_overrides(cells, ov, ["total_y", "total_h"])
    errors = calibration.override_errors(cells, ov)
    keep = ["page", "item_row", "cell", "total_y", "total_h", "overridden"]
    return patched.select(*keep).unionByName(errors, allowMissingColumns=True).select(*keep)


@query("q_missing", with_views("""
SELECT s.page, s.side, x.item_row FROM (SELECT DISTINCT page, side FROM cells_map) s
JOIN taxonomy x ON x.side = s.side
WHERE NOT EXISTS (SELECT 1 FROM cells_map c WHERE c.page = s.page AND c.side = s.side AND c.item_row = x.item_row)""",
    "cells_map", "taxonomy"))
def q_missing(spark, sf_dir):
    return calibration.missing_rows(views.cells_map(spark, sf_dir), taxonomy(spark))


@query("q_crop", with_views(f"""WITH r AS (
  SELECT *, greatest(0, least(tally_x, total_x) - 16) AS x, greatest(0, least(tally_y, total_y) - 16) AS y,
         CAST(ceil(total_x + total_w * 1.15e0 + 16) AS BIGINT) AS right_x,
         greatest(tally_y + tally_h, total_y + total_h) + 16 AS bottom FROM cells_map)
SELECT page, cell, x, y, least({PAGE_W}, right_x) - x AS w, least({PAGE_H}, bottom) - y AS h,
       total_x - x AS box_x, total_y - y AS box_y, CAST(floor(tally_h * 0.6e0 + 0.5e0) AS BIGINT) AS context_margin FROM r""", "cells_map"))
def q_crop(spark, sf_dir):
    return raster.crop_region(views.cells_map(spark, sf_dir), PAGE_W, PAGE_H)


@query("q_overlap_anti", with_views("""
SELECT page, cell, total_x AS x, total_y AS y, total_w AS w, total_h AS h FROM cells_map c
WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.page = c.page AND c.total_x < e.x + e.w AND c.total_x + c.total_w > e.x
                  AND c.total_y < e.y + e.h AND c.total_y + c.total_h > e.y)""", "cells_map", "excl"))
def q_overlap_anti(spark, sf_dir):
    return raster.without_excluded(rects(spark, sf_dir), views.excl(spark, sf_dir))


@query("q_ink_fraction", with_views("""
SELECT c.page, c.cell, round(coalesce(avg(CASE WHEN v < 170 THEN 1e0 ELSE 0e0 END), 0), 9) AS ink
FROM cells_map c LEFT JOIN raster r ON r.page = c.page AND r.x >= total_x AND r.x < total_x + total_w
  AND r.y >= total_y AND r.y < total_y + total_h GROUP BY c.page, c.cell""", "cells_map", "raster"))
def q_ink_fraction(spark, sf_dir):
    return raster.ink_fraction(
        views.scanlines(spark, sf_dir), rects(spark, sf_dir), tasks=tasks_for(table(spark, sf_dir, "lineitem")))


@query("q_window", with_views(f"""
SELECT page, greatest(0, x0 - 8) AS x, greatest(0, y0 - 12) AS y, least({PAGE_W}, x1 + 8) - greatest(0, x0 - 8) AS w,
       least({PAGE_H}, y1 + 8) - greatest(0, y0 - 12) AS h
FROM (SELECT page, min(least(total_x, tally_x)) AS x0, min(least(total_y, tally_y)) AS y0,
             max(greatest(total_x + total_w, tally_x + tally_w)) AS x1, max(greatest(total_y + total_h, tally_y + tally_h)) AS y1
      FROM cells_map GROUP BY page)""", "cells_map"))
def q_window(spark, sf_dir):
    return raster.alignment_window(views.cells_map(spark, sf_dir), PAGE_W, PAGE_H, pad=12)


SQL["rowprof"] = (("raster",), "SELECT page, y AS i, sum(255 - v) / count(*) AS v FROM raster GROUP BY page, y")
SQL["colprof"] = (("raster",), "SELECT page, x AS i, sum(255 - v) / count(*) AS v FROM raster GROUP BY page, x")


@query("q_profile", with_views("""
SELECT 'row' AS axis, page, i, v FROM rowprof UNION ALL SELECT 'col', page, i, v FROM colprof""", "rowprof", "colprof"))
def q_profile(spark, sf_dir):
    lines = views.scanlines(spark, sf_dir)
    rows = raster.row_profile(lines).select(F.lit("row").alias("axis"), "*")
    return rows.unionByName(raster.col_profile(lines).select(F.lit("col").alias("axis"), "*"))


@query("q_decimate", with_views("""
SELECT page, i // 4 AS i, round(avg(v), 9) AS v FROM rowprof GROUP BY ALL HAVING count(*) = 4""", "rowprof"))
def q_decimate(spark, sf_dir):
    d = raster.decimate(raster.row_profile(views.scanlines(spark, sf_dir)))
    return d.withColumn("v", F.round("v", 9))


SQL["hist"] = (("raster",), """
  SELECT page, v, n, sum(n) OVER w AS seen, sum(n) OVER (PARTITION BY page) AS total,
         sum(v * n) OVER w AS weighted, sum(v * n) OVER (PARTITION BY page) AS all_weighted
  FROM (SELECT page, v, count(*) AS n FROM raster GROUP BY page, v) WINDOW w AS (PARTITION BY page ORDER BY v)""")
SQL["paper"] = (("hist",), "SELECT page, min(v) AS paper FROM hist WHERE seen > total // 2 GROUP BY page")
SQL["otsu"] = (("hist",), """
  SELECT page, coalesce(max_by(v, b * 1000 - v) FILTER (b IS NOT NULL), 0) AS otsu FROM (
    SELECT page, v, round(CAST(seen AS DOUBLE) * (total - seen) * (weighted / seen - (all_weighted - weighted) / nullif(total - seen, 0))
      * (weighted / seen - (all_weighted - weighted) / nullif(total - seen, 0)), 6) AS b FROM hist) GROUP BY page""")


@query("q_paper", with_views("SELECT page, paper FROM paper", "paper"))
def q_paper(spark, sf_dir):
    return raster.paper_level(views.scanlines(spark, sf_dir))


@query("q_otsu", with_views("SELECT page, otsu FROM otsu", "otsu"))
def q_otsu(spark, sf_dir):
    return raster.otsu_threshold(views.scanlines(spark, sf_dir))


@query("q_inkthr", with_views("""
SELECT page, paper, dark, otsu, CASE WHEN paper - dark < 25 THEN -1 ELSE greatest(30, least(paper - 45, otsu, 200)) END AS threshold
FROM paper JOIN otsu USING (page)
JOIN (SELECT page, min(v) AS dark FROM hist WHERE seen > floor(total * 0.02e0) GROUP BY page) USING (page)""", "paper", "otsu"))
def q_inkthr(spark, sf_dir):
    return raster.ink_threshold(views.scanlines(spark, sf_dir))


@query("q_composite", with_views("""
SELECT grp, y, x, s[CAST(least(len(s) - 1, floor(len(s) * 0.2e0)) AS BIGINT) + 1] AS v
FROM (SELECT page // 10 AS grp, y, x, list_sort(list(v)) AS s FROM raster GROUP BY ALL)""", "raster"))
def q_composite(spark, sf_dir):
    """Ten pages laid over each other, keeping what is dark on most."""
    return raster.composite(views.scanlines(spark, sf_dir), F.floor(F.col("page") / 10).cast("bigint"), 0.2,
                            tasks=tasks_for(table(spark, sf_dir, "lineitem")))


def blocks(spark, sf_dir):
    """Printed blocks of a page, cut at the page's right edge."""
    return raster.block_spans(views.cells_map(spark, sf_dir)).withColumn("x1", F.least("x1", F.lit(PAGE_W)))


SQL["blocks"] = (("cells_map",), f"""
  SELECT page, printed_column AS block, min(tally_x) AS x0, least(max(total_x + total_w), {PAGE_W}) AS x1
  FROM cells_map GROUP BY ALL""")
SQL["banners"] = (("blocks", "raster", "paper"), """
  SELECT b.page, block, y, count(*) FILTER (v < greatest(60, paper - 60)) > (x1 - x0) * 0.3e0 AS banner
  FROM blocks b JOIN raster r ON r.page = b.page AND x >= x0 AND x < x1 JOIN paper p ON p.page = b.page
  GROUP BY b.page, block, y, x0, x1""")


@query("q_banner", with_views("SELECT * FROM banners", "banners"))
def q_banner(spark, sf_dir):
    return raster.banner_rows(views.scanlines(spark, sf_dir), blocks(spark, sf_dir), frac=0.3)


@query("q_banner_overlap", with_views("""WITH ref AS (
  SELECT block, y, count(*) FILTER (banner) * 3 > count(*) AS r FROM banners GROUP BY ALL)
SELECT page, round(coalesce(min(iou) FILTER (checked), 0), 6) AS overlap FROM (
  SELECT page, block, bool_or(r) AS checked, CASE WHEN count(*) FILTER (banner OR r) > 0
           THEN count(*) FILTER (banner AND r) / count(*) FILTER (banner OR r) ELSE 1e0 END AS iou
  FROM banners JOIN ref USING (block, y) GROUP BY page, block) GROUP BY page""", "banners"))
def q_banner_overlap(spark, sf_dir):
    """Page score against a reference made of all pages: lines that are banner on a third of them."""
    b = raster.banner_rows(views.scanlines(spark, sf_dir), blocks(spark, sf_dir), frac=0.3)
    ref = b.groupBy("block", "y").agg((F.count_if("banner") * 3 > F.count(F.lit(1))).alias("banner"))
    return raster.banner_overlap(b, ref)


@query("q_iou", with_views("""WITH m AS (SELECT page, x, y FROM mask),
nxt AS (SELECT page - 1 AS page, x, y FROM m),
o AS (SELECT page, count(*) FILTER (a AND b) AS inter, count(*) AS uni, count(*) FILTER (a AND NOT b) AS minus
  FROM (SELECT coalesce(m.page, nxt.page) AS page, m.page IS NOT NULL AS a, nxt.page IS NOT NULL AS b
        FROM m FULL JOIN nxt ON m.page = nxt.page AND m.x = nxt.x AND m.y = nxt.y) GROUP BY page),
k AS (SELECT s_suppkey AS page FROM supplier UNION SELECT s_suppkey - 1 FROM supplier UNION SELECT -10 - s_suppkey FROM supplier)
SELECT page, coalesce(inter, 0) AS inter, coalesce(uni, 0) AS uni, coalesce(minus, 0) AS minus,
       CASE WHEN uni IS NULL THEN 1e0 ELSE round(inter / uni, 6) END AS iou FROM k LEFT JOIN o USING (page)""", "mask"))
def q_iou(spark, sf_dir):
    """Each page's ink mask against the next page's; pages below zero have no ink on either side."""
    m = views.pixels(views.scanlines(spark, sf_dir)).filter("v < 170").select("page", "x", "y")
    key = F.col("s_suppkey")
    over = table(spark, sf_dir, "supplier").select(F.explode(F.array(key, key - 1, -10 - key)).alias("page"))
    return raster.mask_overlap(m, m.withColumn("page", F.col("page") - 1), ["page"], ["x", "y"], over)


@query("q_classify", with_views(f"""WITH b AS (
  SELECT page, avg(CASE WHEN v < 150 THEN 1e0 ELSE 0e0 END) FILTER (y >= {math.floor(PAGE_H * 0.04)} AND y < {math.ceil(PAGE_H * 0.04 + PAGE_H * (0.06 - 0.04))}) AS banner,
         avg(CASE WHEN v < 150 THEN 1e0 ELSE 0e0 END) FILTER (y >= {math.floor(PAGE_H * 0.9)} AND y < {math.ceil(PAGE_H * 0.9 + PAGE_H * (0.97 - 0.9))}) AS footer
  FROM raster WHERE x >= {math.floor(PAGE_W * 0.05)} AND x < {math.ceil(PAGE_W * 0.05 + PAGE_W * 0.9)} GROUP BY page)
SELECT page, round(banner, 9) AS banner, round(footer, 9) AS footer, CASE WHEN round(banner, 9) > 0.45e0 THEN 'back' ELSE 'front' END AS side,
       (round(banner, 9) > 0.45e0) = (NOT round(footer, 9) > 0.05e0) AS agree FROM b""", "raster"))
def q_classify(spark, sf_dir):
    return raster.classify_side(views.scanlines(spark, sf_dir))


SQL["fits"] = ((), """
  SELECT o_orderkey AS page, k AS attempt, CASE WHEN (o_orderkey + k) % 2 = 0 THEN 'front' ELSE 'back' END AS side,
         CASE WHEN k < 2 THEN 0 ELSE k // 2 END AS turns,
         ((o_orderkey * 37 + k * 311 + (o_orderkey * k) % 97) % 1000) / 1000e0 AS overlap
  FROM orders, (SELECT CAST(range AS BIGINT) AS k FROM range(8))""")


@query("q_bestside", with_views("""WITH s AS (
  SELECT page, max(overlap) FILTER (attempt = 0) AS own, max(overlap) FILTER (attempt = 1) AS other,
         max(overlap) FILTER (attempt >= 2) AS turned FROM fits GROUP BY page),
p AS (SELECT f.*, CASE WHEN own < 0.75e0 AND other > own THEN 1 ELSE 0 END AS first,
             CASE WHEN own < 0.75e0 AND other > own THEN other ELSE own END AS so_far, turned FROM fits f JOIN s USING (page)),
c AS (SELECT *, so_far < 0.75e0 AND turned > so_far AS use_turned FROM p)
SELECT page, side, turns, overlap, overlap >= 0.75e0 AS trusted FROM c
WHERE CASE WHEN use_turned THEN attempt >= 2 AND overlap = turned ELSE attempt = first END
QUALIFY row_number() OVER (PARTITION BY page ORDER BY attempt) = 1""", "fits"))
def q_bestside(spark, sf_dir):
    k, a = F.col("o_orderkey"), F.col("attempt")
    fits = table(spark, sf_dir, "orders").select(
        k, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("attempt")
    ).select(
        k.alias("page"), "attempt", F.when((k + a) % 2 == 0, "front").otherwise("back").alias("side"),
        F.when(a < 2, 0).otherwise(F.floor(a / 2)).cast("bigint").alias("turns"),
        (((k * 37 + a * 311 + (k * a) % 97) % 1000) / F.lit(1000.0)).alias("overlap"),
    )
    return raster.best_side(fits)


# ------------------------------------------------------------------ neighbourhoods
def slide(src: str, r: int, fn: str = "max") -> str:
    return f"""(SELECT page, x, y, {fn}(v) OVER (PARTITION BY page, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v
  FROM (SELECT page, x, y, {fn}(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {src}))"""


SQL["local_paper"] = (("raster",), f"SELECT * FROM {slide('raster', 9)}")
SQL["raw_ink"] = (("raster", "local_paper"), """
  SELECT r.page, r.x, r.y, CASE WHEN p.v - r.v >= 22 THEN 1 ELSE 0 END AS v FROM raster r JOIN local_paper p USING (page, x, y)""")
SQL["clean_ink"] = (("raw_ink",), f"""
  SELECT i.page, i.x, i.y, CASE WHEN rr.y IS NOT NULL OR cc.x IS NOT NULL THEN 0 ELSE i.v END AS v FROM raw_ink i
  LEFT JOIN (SELECT page, y FROM (SELECT *, count(*) OVER (PARTITION BY page, g) AS n FROM (
      SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g
      FROM raw_ink GROUP BY page, y HAVING sum(v) >= count(*) * 0.5e0)) WHERE n <= 6) rr ON rr.page = i.page AND rr.y = i.y
  LEFT JOIN (SELECT page, x FROM (SELECT *, count(*) OVER w AS n, min(x) OVER w AS a, max(x) OVER w AS b FROM (
      SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS g
      FROM raw_ink GROUP BY page, x HAVING sum(v) >= count(*) * 0.3e0) WINDOW w AS (PARTITION BY page, g))
      WHERE n <= 6 AND (a < 8 OR b >= {PAGE_W - 8})) cc ON cc.page = i.page AND cc.x = i.x""")


@query("q_localmax", with_views(f"SELECT page, y, {AS_LINES} FROM local_paper GROUP BY page, y", "local_paper"))
def q_localmax(spark, sf_dir):
    return text_lines(raster.local_max(views.scanlines(spark, sf_dir)))


@query("q_inkmask", with_views(f"SELECT page, y, {AS_LINES} FROM clean_ink GROUP BY page, y", "clean_ink"))
def q_inkmask(spark, sf_dir):
    return text_lines(raster.ink_mask(views.scanlines(spark, sf_dir), wall_frac=0.3))


@query("q_dilate", with_views(f"""WITH m AS (SELECT page, x, y, CASE WHEN v < 60 THEN 1 ELSE 0 END AS v FROM raster),
d AS {slide('m', 2)} SELECT page, y, {AS_LINES} FROM d GROUP BY page, y""", "raster"))
def q_dilate(spark, sf_dir):
    dark = F.transform("px", lambda v: F.when(v < 60, 1).otherwise(0))
    return text_lines(raster.dilate(views.scanlines(spark, sf_dir).withColumn("px", dark)))


@query("q_stencil", with_views(f"""WITH p AS (SELECT r.page, r.x, r.y,
  CAST(floor((4 * r.v + sum(n.v * CASE WHEN n.x = r.x OR n.y = r.y THEN 2 ELSE 1 END) FILTER (n.x <> r.x OR n.y <> r.y)) / 16) AS BIGINT) AS v
  FROM raster r JOIN (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) o ON true
  JOIN raster n ON n.page = r.page AND n.x = r.x + dx AND n.y = r.y + dy GROUP BY r.page, r.x, r.y, r.v)
SELECT page, y, {AS_LINES} FROM p GROUP BY page, y""", "raster"))
def q_stencil(spark, sf_dir):
    return text_lines(raster.stencil3(views.scanlines(spark, sf_dir)))


# ------------------------------------------------------------------ geometry
@query("q_turn", with_views(f"""
SELECT 1 AS turns, page, y, {AS_LINES} FROM (SELECT page, {PAGE_H - 1} - y AS x, x AS y, v FROM raster) GROUP BY page, y
UNION ALL SELECT 2, page, y, {AS_LINES} FROM (SELECT page, {PAGE_W - 1} - x AS x, {PAGE_H - 1} - y AS y, v FROM raster) GROUP BY page, y
UNION ALL SELECT 3, page, y, {AS_LINES} FROM (SELECT page, y AS x, {PAGE_W - 1} - x AS y, v FROM raster) GROUP BY page, y""", "raster"))
def q_turn(spark, sf_dir):
    lines = views.scanlines(spark, sf_dir)
    out = [text_lines(raster.quarter_turn(lines, t)).select(F.lit(t).alias("turns"), "*") for t in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _mix(ax: str) -> str:
    return f"""CAST(floor(a.v * (1 - fx) * (1 - fy) + b.v * fx * (1 - fy) + c.v * (1 - fx) * fy + d.v * fx * fy) AS BIGINT)
  FROM {ax} t LEFT JOIN raster a ON a.page = t.page AND a.x = x0 AND a.y = y0
  LEFT JOIN raster b ON b.page = t.page AND b.x = x0 + 1 AND b.y = y0
  LEFT JOIN raster c ON c.page = t.page AND c.x = x0 AND c.y = y0 + 1
  LEFT JOIN raster d ON d.page = t.page AND d.x = x0 + 1 AND d.y = y0 + 1"""


@query("q_resample", with_views(f"""WITH t AS (
  SELECT page, x, y, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy
  FROM (SELECT page, x, y, (1 + (page % 5 - 2) / 64e0) * x + (page % 7 - 3) / 4e0 AS sx,
               (1 + (page % 3 - 1) / 32e0) * y + (page % 4 - 1) / 2e0 AS sy FROM raster)),
m AS (SELECT t.page, t.x, t.y, {_mix('t').replace('FROM t t', 'AS v FROM t t')})
SELECT page, y, string_agg(CAST(coalesce(v, 255) AS VARCHAR), ',' ORDER BY x) AS px FROM m GROUP BY page, y""", "raster"))
def q_resample(spark, sf_dir):
    lines = views.scanlines(spark, sf_dir)
    p = F.col("page")
    fits = lines.select("page").distinct().select(
        "page", ((p % 5 - 2) / 64 + 1).alias("sx"), ((p % 7 - 3) / 4).alias("ox"),
        ((p % 3 - 1) / 32 + 1).alias("sy"), ((p % 4 - 1) / 2).alias("oy"),
    )
    return text_lines(raster.resample(lines, fits, PAGE_W, PAGE_H))


@query("q_rotate", with_views(f"""WITH g AS (
  SELECT page, x, y, cos(radians((page % 5 - 2) * 0.7e0)) AS c, sin(radians((page % 5 - 2) * 0.7e0)) AS s FROM raster),
t AS (SELECT page, x, y, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy
  FROM (SELECT page, x, y, {PAGE_W / 2}e0 + (x - {PAGE_W / 2}e0) * c + (y - {PAGE_H / 2}e0) * s AS sx,
               {PAGE_H / 2}e0 - (x - {PAGE_W / 2}e0) * s + (y - {PAGE_H / 2}e0) * c AS sy FROM g)),
m AS (SELECT t.page, t.x, t.y, {_mix('t').replace('FROM t t', 'AS v FROM t t')})
SELECT page, y, string_agg(CAST(coalesce(v, 255) AS VARCHAR), ',' ORDER BY x) AS px FROM m GROUP BY page, y""", "raster"))
def q_rotate(spark, sf_dir):
    lines = views.scanlines(spark, sf_dir)
    angles = lines.select("page").distinct().withColumn("deg", (F.col("page") % 5 - 2) * F.lit(0.7))
    return text_lines(raster.rotate(lines, angles))


@query("q_moments", with_views("""
SELECT page, mass, round(sx / mass, 6) AS cx, round(sy / mass, 6) AS cy,
       round(CASE WHEN syy - sy * sy / mass > 1e-6 THEN (sxy - sx * sy / mass) / (syy - sy * sy / mass) ELSE 0 END, 6) AS skew
FROM (SELECT page, CAST(sum(255 - v) AS BIGINT) AS mass, CAST(sum((255 - v) * x) AS BIGINT) AS sx, CAST(sum((255 - v) * y) AS BIGINT) AS sy,
             CAST(sum((255 - v) * x * y) AS BIGINT) AS sxy, CAST(sum((255 - v) * y * y) AS BIGINT) AS syy FROM raster GROUP BY page)
UNION ALL SELECT DISTINCT -1 - page, 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0e0 FROM raster WHERE page % 5 = 3""", "raster"))
def q_moments(spark, sf_dir):
    """Every given page; besides, a blank page for every fifth, under a negative number."""
    lines = views.scanlines(spark, sf_dir)
    paper = F.transform("px", lambda v: F.lit(255).cast("smallint"))
    return raster.moments(lines.unionByName(lines.filter("page % 5 = 3").withColumn("page", -1 - F.col("page")).withColumn("px", paper)))


# ------------------------------------------------------------------ alignment
@query("q_skew", with_views(f"""WITH s AS (SELECT page, x, y, 255 - v AS v FROM raster),
r AS (SELECT page, k, y + CAST(floor((x - {PAGE_W / 2}e0) * tan(radians(-10e0 + k * 0.5e0)) + 0.5e0) AS BIGINT) AS r, sum(v) AS v
  FROM s, (SELECT CAST(range AS BIGINT) AS k FROM range(41)) GROUP BY ALL),
c AS (SELECT page, k, CAST(sum(v * v) * {PAGE_H} - sum(v) * sum(v) AS BIGINT) AS score FROM r WHERE r >= 0 AND r < {PAGE_H} GROUP BY page, k)
SELECT page, round(k * 0.5e0 - 10e0, 6) AS deg, score FROM c
QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, k) = 1""", "raster"))
def q_skew(spark, sf_dir):
    """Angles up to ten degrees, at full scale: the derived pages are small."""
    return raster.skew_angle(views.scanlines(spark, sf_dir), PAGE_W, PAGE_H, max_deg=10, step=0.5, sub=1)


def paired_profiles(spark, sf_dir):
    """Each page's row profile beside that of the page before it."""
    prof = raster.profile_arrays(raster.row_profile(views.scanlines(spark, sf_dir)))
    ref = prof.select((F.col("page") + 1).alias("page"), F.col("a").alias("ref"))
    return prof.withColumnRenamed("a", "v").join(ref, "page")


@query("q_best_shift", with_views("""WITH n AS (
  SELECT p.page, i, v - m AS v FROM rowprof p JOIN (SELECT page, avg(v) AS m FROM rowprof GROUP BY page) USING (page)),
z AS (SELECT page, CASE WHEN sqrt(sum(v * v)) > 0 THEN sqrt(sum(v * v)) ELSE 1 END AS z FROM n GROUP BY page),
s AS (SELECT b.page, k AS shift, round(sum(a.v * b.v) / (max(za.z) * max(zb.z)), 9) AS score
  FROM n a JOIN (SELECT CAST(range AS BIGINT) AS k FROM range(-40, 41)) ON true
  JOIN n b ON b.page = a.page + 1 AND b.i = a.i + k JOIN z za ON za.page = a.page JOIN z zb ON zb.page = b.page GROUP BY b.page, k)
SELECT page, shift, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, shift) = 1""", "rowprof"))
def q_best_shift(spark, sf_dir):
    return raster.best_shift(paired_profiles(spark, sf_dir), max_shift=40)


def _fit_sql(src: str, i0: int, i1: int, grid: str, unit: int, need: float) -> str:
    return f"""(SELECT page, si, oi, scale, off, CASE WHEN n < {need}e0 THEN -1e0 WHEN va * vb > 1e-9 THEN round(cov / sqrt(va * vb), 9) ELSE -1e0 END AS score
  FROM (SELECT page, si, oi, scale, off, count(*) AS n, sum(a * b) - sum(a) * sum(b) / count(*) AS cov,
               sum(a * a) - sum(a) * sum(a) / count(*) AS va, sum(b * b) - sum(b) * sum(b) / count(*) AS vb
        FROM (SELECT g.page, si, oi, scale, off, r.v AS a, p0.v * (1 - (t - floor(t))) + p1.v * (t - floor(t)) AS b
              FROM (SELECT g.*, i, scale * i + off / {unit} AS t FROM {grid} g, (SELECT CAST(range AS BIGINT) AS i FROM range({i0}, {i1}))) g
              JOIN {src} r ON r.page = g.page - 1 AND r.i = g.i
              JOIN {src} p0 ON p0.page = g.page AND p0.i = CAST(floor(t) AS BIGINT)
              JOIN {src} p1 ON p1.page = g.page AND p1.i = CAST(floor(t) AS BIGINT) + 1)
        GROUP BY ALL))"""


@query("q_axis_fit", with_views(f"""WITH small AS (SELECT page, i // 2 AS i, avg(v) AS v FROM rowprof GROUP BY ALL HAVING count(*) = 2),
pairs AS (SELECT DISTINCT a.page FROM rowprof a SEMI JOIN rowprof b ON b.page = a.page - 1),
g1 AS (SELECT page, si, oi, 1 - 0.06e0 + 0.004e0 * si AS scale, -10e0 + 2e0 * oi AS off
       FROM pairs, (SELECT range AS si FROM range(31)), (SELECT range AS oi FROM range(11))),
c1 AS (SELECT * FROM {_fit_sql('small', 2, 22, 'g1', 2, 12.0)} QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, si, oi) = 1),
g2 AS (SELECT page, d.range AS si, e.range AS oi, scale + 0.0005e0 * d.range AS scale, off + 0.5e0 * e.range AS off
       FROM c1, range(-10, 11) d, range(-16, 17) e)
SELECT page, round(scale, 6) AS scale, round(off, 6) AS offset, round(score, 6) AS score
FROM {_fit_sql('rowprof', 4, 45, 'g2', 1, 24.6)} QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, si, oi) = 1""", "rowprof"))
def q_axis_fit(spark, sf_dir):
    fit = raster.fit_axis(
        # The steps are those for scans; offsets reach as far as a page of 50 lines allows.
        paired_profiles(spark, sf_dir), 4, 45, max_offset=10, coarse=2,
    )
    return fit.select("page", *[F.round(c, 6).alias(c) for c in ("scale", "offset", "score")])


@query("q_normalise", with_views("""WITH ink AS (SELECT page, x, y FROM raster WHERE v < 60),
b AS (SELECT page, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ink GROUP BY page),
t AS (SELECT *, greatest(1, CAST(floor(w * (20e0 / greatest(w, h)) + 0.5e0) AS BIGINT)) AS tw,
             greatest(1, CAST(floor(h * (20e0 / greatest(w, h)) + 0.5e0) AS BIGINT)) AS th FROM b),
g AS (SELECT t.*, tx, ty, x0 + tx * w // tw AS sx0, x0 + greatest(tx * w // tw + 1, (tx + 1) * w // tw) AS sx1,
             y0 + ty * h // th AS sy0, y0 + greatest(ty * h // th + 1, (ty + 1) * h // th) AS sy1
      FROM t, (SELECT CAST(range AS BIGINT) AS tx FROM range(20)), (SELECT CAST(range AS BIGINT) AS ty FROM range(20)) WHERE tx < tw AND ty < th),
c AS (SELECT g.page, tx, ty, count(*) / ((sx1 - sx0) * (sy1 - sy0)) * 255 AS v
      FROM g JOIN ink i ON i.page = g.page AND i.x >= sx0 AND i.x < sx1 AND i.y >= sy0 AND i.y < sy1 GROUP BY g.page, tx, ty, sx0, sx1, sy0, sy1),
m AS (SELECT page, sum(tx * v) / sum(v) AS cx, sum(ty * v) / sum(v) AS cy FROM c GROUP BY page),
o AS (SELECT page, tx + CAST(floor(round(14 - cx, 9) + 0.5e0) AS BIGINT) AS x, ty + CAST(floor(round(14 - cy, 9) + 0.5e0) AS BIGINT) AS y,
             least(255, CAST(floor(round(v, 9) + 0.5e0) AS BIGINT)) AS v FROM c JOIN m USING (page))
SELECT * FROM o WHERE x BETWEEN 0 AND 27 AND y BETWEEN 0 AND 27""", "raster"))
def q_normalise(spark, sf_dir):
    """Each page's dark ink as one digit bitmap."""
    ink = views.pixels(views.scanlines(spark, sf_dir)).filter("v < 60").select("page", "x", "y")
    return raster.normalise(ink)


# ------------------------------------------------------------------ runs along a profile
SQL["cover"] = (("raster",), "SELECT page, y AS i, count(*) FILTER (v < 170) / count(*) AS v FROM raster GROUP BY page, y")


def cover(spark, sf_dir):
    """Share of inked pixels per line."""
    dark = F.size(F.filter("px", lambda v: v < 170))
    return views.scanlines(spark, sf_dir).select("page", F.col("y").alias("i"), (dark / F.size("px")).alias("v"))


def _runs_sql(cond: str, gap: int) -> str:
    return f"""(SELECT page, min(i) AS start, max(i) AS "end", count(*) AS n FROM (
  SELECT *, sum(o) OVER (PARTITION BY page ORDER BY i) AS run FROM (
    SELECT page, i, CASE WHEN i - lag(i) OVER (PARTITION BY page ORDER BY i) > {gap} + 1 THEN 1 ELSE 0 END AS o FROM cover WHERE {cond}))
  GROUP BY page, run)"""


@query("q_islands", with_views(f"SELECT * FROM {_runs_sql('v > 0.2e0', 0)} WHERE n <= 6", "cover"))
def q_islands(spark, sf_dir):
    """Thin runs: stretches no longer than a printed rule."""
    b = islands.run_bounds(cover(spark, sf_dir).filter("v > 0.2D").select("page", "i"), ["page"])
    return b.filter(F.col("n") <= 6)


@query("q_islands_gap", with_views(f"""SELECT * FROM {_runs_sql('v > 0.25e0', 2)} WHERE "end" - start + 1 >= 3""", "cover"))
def q_islands_gap(spark, sf_dir):
    b = islands.run_bounds(cover(spark, sf_dir).filter("v > 0.25D").select("page", "i"), ["page"], max_gap=2)
    return b.filter(F.col("end") - F.col("start") + 1 >= 3)


@query("q_bands", with_views(f"SELECT * FROM {_runs_sql('v > 0.15e0', 0)} WHERE n >= 5", "cover"))
def q_bands(spark, sf_dir):
    return islands.bands(cover(spark, sf_dir), bar=0.15, min_size=5)


@query("q_peaks", with_views("""WITH RECURSIVE med AS (
  SELECT page, (list_sort(list(v)))[len(list(v)) // 2 + 1] * 1.2e0 AS bar FROM rowprof GROUP BY page),
cand AS (SELECT page, i, v FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM rowprof WINDOW w AS (PARTITION BY page ORDER BY i))
         JOIN med USING (page) WHERE v >= bar AND v >= p AND v >= n),
nms AS (SELECT page, CAST(NULL AS BIGINT) AS i, list(i ORDER BY v DESC, i) AS rest FROM cand GROUP BY page
        UNION ALL
        SELECT page, rest[1], list_filter(rest, lambda r: abs(r - rest[1]) >= 6) FROM nms WHERE len(rest) > 0)
SELECT page, i FROM nms WHERE i IS NOT NULL""", "rowprof"))
def q_peaks(spark, sf_dir):
    return islands.peaks(raster.row_profile(views.scanlines(spark, sf_dir)), factor=1.2)


@query("q_adjacent", with_views("""
SELECT page, cell, CAST(coalesce(floor((prev_end + total_y) / 2e0 + 0.5e0), greatest(0, total_y - 8)) AS BIGINT) AS band_top,
       CAST(coalesce(floor((total_y + total_h + next_y) / 2e0 + 0.5e0), total_y + total_h + 8) AS BIGINT) AS band_bottom,
       greatest(0, coalesce(prev_end - total_y, 0)) AS overlap
FROM (SELECT *, lag(total_y + total_h) OVER w AS prev_end, lead(total_y) OVER w AS next_y
      FROM cells_map WINDOW w AS (PARTITION BY page, printed_column ORDER BY total_y, cell))""", "cells_map"))
def q_adjacent(spark, sf_dir):
    return islands.stacked_boxes(views.cells_map(spark, sf_dir))


@query("q_search", with_views(f"""WITH lv AS (
  SELECT page, s[CAST(floor(len(s) * 0.1e0) AS BIGINT) + 1] AS lo, s[CAST(floor(len(s) * 0.97e0) AS BIGINT) + 1] AS hi, len(s) AS len
  FROM (SELECT page, list_sort(list(v)) AS s FROM rowprof GROUP BY page)),
grid AS (SELECT page, len, f_no, lo + (hi - lo) * f AS thr FROM lv, (VALUES (0, 0.2e0), (1, 0.3e0), (2, 0.4e0), (3, 0.5e0), (4, 0.6e0)) fs(f_no, f)),
pos AS (SELECT g.*, gap, p.i FROM grid g JOIN rowprof p ON p.page = g.page AND p.v >= g.thr CROSS JOIN (SELECT range AS gap FROM range(1, 9))),
run AS (SELECT *, sum(o) OVER (PARTITION BY page, f_no, gap ORDER BY i) AS cl FROM (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY page, f_no, gap ORDER BY i) - 1 > gap THEN 1 ELSE 0 END AS o FROM pos)),
cl0 AS (SELECT page, len, f_no, thr, gap, cl, min(i) AS a, max(i) AS b0 FROM run GROUP BY ALL),
cl1 AS (SELECT *, CASE WHEN len - 1 - b0 <= gap THEN len - 1 ELSE b0 END AS b,
               CASE WHEN len - 1 - b0 <= gap THEN len - a ELSE b0 - a END >= 2 AS ok FROM cl0),
ink AS (SELECT c.*, (SELECT sum(v) FROM rowprof p WHERE p.page = c.page AND p.i BETWEEN c.a AND c.b0) AS ink FROM cl1 c),
fit AS (SELECT page, f_no, gap, count(*) FILTER (ok) AS n, max(b - a) FILTER (ok) AS tallest,
               (list_sort(list(b - a) FILTER (ok)))[count(*) FILTER (ok) // 2 + 1] AS mid,
               bool_and(NOT ok OR ink / (b - a + 1) >= thr * 0.9e0) AS solid FROM ink GROUP BY ALL),
ex AS (SELECT *, solid AND tallest <= mid * 2.2e0 + 12 AS good FROM (
  SELECT *, min(gap) FILTER (n < 5) OVER (PARTITION BY page, f_no) AS past FROM fit) WHERE n = 5 AND (past IS NULL OR gap < past)),
best AS (SELECT * FROM ex WHERE good QUALIFY row_number() OVER (PARTITION BY page ORDER BY tallest, f_no, gap) = 1),
sus AS (SELECT * FROM ex WHERE NOT good QUALIFY row_number() OVER (PARTITION BY page ORDER BY f_no, gap) = 1)
SELECT lv.page, CASE WHEN b.page IS NOT NULL THEN 'fit' WHEN s.page IS NOT NULL THEN 'suspect' ELSE 'even split' END AS kind,
       CAST(coalesce(b.f_no, s.f_no) AS BIGINT) AS f_no, coalesce(b.gap, s.gap) AS gap, coalesce(b.tallest, s.tallest) AS tallest
FROM lv LEFT JOIN best b ON b.page = lv.page LEFT JOIN sus s ON s.page = lv.page""", "rowprof"))
def q_search(spark, sf_dir):
    return islands.search_clusters(
        raster.row_profile(views.scanlines(spark, sf_dir)), 5, fractions=[0.2, 0.3, 0.4, 0.5, 0.6],
        gaps=range(1, 9), min_size=2,
    )
