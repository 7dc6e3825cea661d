"""Connected ink, digit boxes and tallies."""

from pyspark.sql import functions as F

from ..operators import cards, components, evaluate, tally
from ..operators.ordered import tasks_for
from . import views
from .rasters import slide
from .registry import query
from .views import PAGE_H, PAGE_W, SQL, table, with_views


def dark(spark, sf_dir, below):
    """0/1 masks of pixels under a level."""
    return views.scanlines(spark, sf_dir).withColumn(
        "px", F.transform("px", lambda v: F.when(v < below, 1).otherwise(0).cast("smallint"))
    )


def _reach(pixels: str) -> str:
    """Every pixel with the least pixel number it is connected to."""
    return f"""px AS (SELECT page, x, y, y * 4294967296 + x AS id FROM {pixels}),
adj AS MATERIALIZED (SELECT a.page, a.id AS a, b.id AS b FROM px a
  JOIN (SELECT dx, dy FROM (VALUES (-1), (0), (1)) q(dx), (VALUES (-1), (0), (1)) r(dy)) o ON true
  JOIN px b ON b.page = a.page AND b.x = a.x + dx AND b.y = a.y + dy),
reach AS (SELECT page, id AS root, id FROM px UNION SELECT r.page, r.root, adj.b FROM reach r JOIN adj ON adj.page = r.page AND adj.a = r.id),
lab AS (SELECT r.page, r.id, min(root) AS label FROM reach r GROUP BY r.page, r.id)"""


@query("q_components", with_views(f"""WITH RECURSIVE {_reach("(SELECT * FROM raster WHERE v < 120)")}
SELECT p.page, label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS count
FROM px p JOIN lab USING (page, id) GROUP BY p.page, label""", "raster"))
def q_components(spark, sf_dir):
    return components.components(dark(spark, sf_dir, 120)).select(
        "page", "label", "min_x", "max_x", "min_y", "max_y", "count"
    )


DY = int(PAGE_H * components.STRIP_INSET + 0.5)
SQL["ink24"] = (("raster",), f"""
  SELECT page * 2 AS page, x, y, CASE WHEN v < 16 THEN 1 ELSE 0 END AS v FROM raster
  UNION ALL SELECT page * 2 + 1, x, y - {DY}, CASE WHEN v < 16 THEN 1 ELSE 0 END FROM raster WHERE y >= {DY} AND y < {PAGE_H - DY}""")
SQL["ink24_grown"] = (("ink24",), f"SELECT page, x, y FROM {slide('ink24', 1)} WHERE v = 1")


@query("q_verdict", with_views(f"""WITH RECURSIVE {_reach("ink24_grown")},
m0 AS (SELECT p.page, label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM px p JOIN lab USING (page, id)
       GROUP BY p.page, label HAVING count(*) >= 4),
m AS (SELECT m0.*, (SELECT count(*) FROM ink24 i WHERE i.page = m0.page AND i.v = 1 AND i.x BETWEEN min_x AND max_x AND i.y BETWEEN min_y AND max_y) AS ink FROM m0),
c AS (SELECT DISTINCT page FROM raster UNION SELECT DISTINCT -1 - page FROM raster WHERE page % 5 = 3)
SELECT 'box' AS kind, c.page, count(label) AS marks, coalesce(CAST(sum(ink) AS BIGINT), 0) AS mass, CAST(NULL AS BIGINT) AS strokes,
       coalesce(max(max_y - min_y + 1) >= least(20, greatest(6, floor({PAGE_H} * 0.25e0 + 0.5e0))) OR sum(ink) >= least(90, {PAGE_W * PAGE_H} * 0.01e0), false) AS marked
FROM c LEFT JOIN m ON m.page = c.page * 2 GROUP BY c.page
UNION ALL
SELECT 'strip', c.page, count(label), NULL, count(*) FILTER (tall),
       (count(*) FILTER (tall) >= 2 AND coalesce(max(max_x) FILTER (tall) - min(min_x) FILTER (tall) >= 25, false)) OR coalesce(max(ink) >= 250, false)
FROM c
LEFT JOIN (SELECT *, max_y - min_y + 1 >= least(20, greatest(6, floor({PAGE_H - 2 * DY} * 0.25e0 + 0.5e0))) AS tall FROM m WHERE page % 2 = 1) s
  ON s.page = c.page * 2 + 1 GROUP BY c.page""", "ink24_grown"))
def q_verdict(spark, sf_dir):
    """Whole pages as boxes, trimmed pages as strips, each labelled once; besides, a blank page for every fifth, under a negative number."""
    ink = dark(spark, sf_dir, 16)
    paper = F.transform("px", lambda v: F.lit(0).cast("smallint"))
    return _verdicts(ink.unionByName(ink.filter("page % 5 = 3").withColumn("page", -1 - F.col("page")).withColumn("px", paper)))


def _verdicts(ink):
    boxes, strips = components.find_marks(ink, close=1), components.find_marks(components.inset_rows(ink, PAGE_H), close=1)
    none = F.lit(None).cast("bigint")
    return components.box_verdict(boxes, PAGE_W, PAGE_H).select(
        F.lit("box").alias("kind"), "page", "marks", "mass", none.alias("strokes"), "marked"
    ).unionByName(components.strip_verdict(strips, PAGE_H - 2 * DY).select(
        F.lit("strip").alias("kind"), "page", "marks", none.alias("mass"), "strokes", "marked"
    ))


# ------------------------------------------------------------------ digit boxes
SQL["box_reasons"] = (("boxes",), """
  SELECT *, (max_x - min_x + 1) / (max_y - min_y + 1) > 3.5e0 AS is_bar,
         count < (max_x - min_x + 1) * (max_y - min_y + 1) * 0.06e0 AS hollow, max_y - min_y + 1 < 58 * 0.18e0 AS short FROM boxes""")
SQL["digit_boxes"] = (("box_reasons",), """
  SELECT * FROM (SELECT crop, k, min_x, max_x, min_y, max_y, count, max(max_y - min_y + 1) OVER (PARTITION BY crop) AS t
    FROM box_reasons WHERE NOT (is_bar OR hollow OR short)) WHERE max_y - min_y + 1 >= t * 0.45e0""")


@query("q_shape", with_views("SELECT crop, k, min_x, max_x, min_y, max_y, count FROM digit_boxes", "digit_boxes"))
def q_shape(spark, sf_dir):
    return components.shape_filter(views.boxes(spark, sf_dir))


@query("q_deaths", with_views("""
SELECT reason, count(*) AS n FROM (
  SELECT crop, CASE WHEN bool_and(is_bar OR hollow OR short) THEN concat_ws('+', CASE WHEN bool_or(is_bar) THEN 'bar' END,
    CASE WHEN bool_or(hollow) THEN 'hollow' END, CASE WHEN bool_or(short) THEN 'short' END) ELSE 'survived filters' END AS reason
  FROM box_reasons GROUP BY crop) GROUP BY reason""", "box_reasons"))
def q_deaths(spark, sf_dir):
    """What kept whole crops from yielding a digit."""
    return components.death_reasons(views.boxes(spark, sf_dir))


@query("q_fragmerge", with_views("""WITH RECURSIVE o AS (
  SELECT *, row_number() OVER (PARTITION BY crop ORDER BY min_x, k) AS rn FROM digit_boxes),
f AS (SELECT crop, rn, 0 AS j, min_x, max_x, min_y, max_y, count FROM o WHERE rn = 1
  UNION ALL
  SELECT crop, rn, CASE WHEN joins THEN j ELSE j + 1 END, CASE WHEN joins THEN least(px, min_x) ELSE min_x END,
         CASE WHEN joins THEN greatest(pxx, max_x) ELSE max_x END, CASE WHEN joins THEN least(py, min_y) ELSE min_y END,
         CASE WHEN joins THEN greatest(pyy, max_y) ELSE max_y END, CASE WHEN joins THEN pc + count ELSE count END
  FROM (SELECT b.*, f.j, f.min_x AS px, f.max_x AS pxx, f.min_y AS py, f.max_y AS pyy, f.count AS pc,
          least(f.max_x, b.max_x) - greatest(f.min_x, b.min_x) > (least(f.max_x - f.min_x, b.max_x - b.min_x) + 1) * 0.5e0
          OR (b.min_x - f.max_x - 1 <= (greatest(f.max_y, b.max_y) - least(f.min_y, b.min_y) + 1) * 0.18e0
              AND greatest(f.max_x, b.max_x) - least(f.min_x, b.min_x) + 1 <= (greatest(f.max_y, b.max_y) - least(f.min_y, b.min_y) + 1) * 1.05e0) AS joins
        FROM f JOIN o b ON b.crop = f.crop AND b.rn = f.rn + 1))
SELECT crop, CAST(j AS BIGINT) AS j, min_x, max_x, min_y, max_y, count FROM f QUALIFY row_number() OVER (PARTITION BY crop, j ORDER BY rn DESC) = 1""", "digit_boxes"))
def q_fragmerge(spark, sf_dir):
    return components.merge_fragments(components.shape_filter(views.boxes(spark, sf_dir)))


def _sweep_sql() -> str:
    settings = [(p, v, {**components.SHIPPING, p: v}) for p, vs in components.SWEEP.items() for v in vs]
    rows = ", ".join(
        f"('{p}', {float(v)}e0, {float(s['hollow'])}e0, {float(s['short'])}e0, {float(s['bar'])}e0)" for p, v, s in settings
    )
    return f"""WITH RECURSIVE s AS (SELECT * FROM (VALUES {rows}) t(param, setting, hollow, short_, bar)),
k AS (SELECT param, setting, crop, k, min_x, max_x, min_y, max_y, max(max_y - min_y + 1) OVER (PARTITION BY param, setting, crop) AS t
  FROM boxes, s WHERE NOT (max_y - min_y + 1 < 58 * short_ OR (max_x - min_x + 1) / (max_y - min_y + 1) > bar
    OR count < (max_x - min_x + 1) * (max_y - min_y + 1) * hollow)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY param, setting, crop ORDER BY min_x, k) AS rn FROM k WHERE max_y - min_y + 1 >= t * 0.45e0),
f AS (SELECT param, setting, crop, rn, 1 AS n, min_x, max_x, min_y, max_y FROM o WHERE rn = 1
  UNION ALL
  SELECT param, setting, crop, rn, CASE WHEN joins THEN n ELSE n + 1 END, CASE WHEN joins THEN least(px, min_x) ELSE min_x END,
         CASE WHEN joins THEN greatest(pxx, max_x) ELSE max_x END, CASE WHEN joins THEN least(py, min_y) ELSE min_y END,
         CASE WHEN joins THEN greatest(pyy, max_y) ELSE max_y END
  FROM (SELECT b.*, f.n, f.min_x AS px, f.max_x AS pxx, f.min_y AS py, f.max_y AS pyy,
          least(f.max_x, b.max_x) - greatest(f.min_x, b.min_x) > (least(f.max_x - f.min_x, b.max_x - b.min_x) + 1) * 0.5e0
          OR (b.min_x - f.max_x - 1 <= (greatest(f.max_y, b.max_y) - least(f.min_y, b.min_y) + 1) * 0.18e0
              AND greatest(f.max_x, b.max_x) - least(f.min_x, b.min_x) + 1 <= (greatest(f.max_y, b.max_y) - least(f.min_y, b.min_y) + 1) * 1.05e0) AS joins
        FROM f JOIN o b ON b.param = f.param AND b.setting = f.setting AND b.crop = f.crop AND b.rn = f.rn + 1)),
n AS (SELECT param, setting, crop, max(n) AS n FROM f GROUP BY ALL),
x AS (SELECT s.param, s.setting, c.crop, coalesce(n.n, 0) AS n, 1 + c.crop % 2 AS digits
      FROM (SELECT DISTINCT crop FROM boxes) c CROSS JOIN s LEFT JOIN n ON n.param = s.param AND n.setting = s.setting AND n.crop = c.crop)
SELECT param, setting, count(*) FILTER (n = digits) AS cut_right, count(*) FILTER (n = 0 AND digits <> 0) AS cut_none,
       count(*) FILTER (n > digits) AS cut_over FROM x GROUP BY param, setting"""


@query("q_sweep", with_views(_sweep_sql(), "boxes"))
def q_sweep(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    truth = b.select("crop").distinct().withColumn("digits", F.col("crop") % 2 + 1)
    return components.sweep_shape(b, truth)


# ------------------------------------------------------------------ tallies
SQL["stroke0"] = (("segments",), """
  SELECT s.*, (list_sort(list(length) OVER (PARTITION BY strip)))[count(*) OVER (PARTITION BY strip) // 2 + 1] AS typical
  FROM segments s WHERE kind = 'stroke' AND ink >= length * 0.62e0""")
SQL["strokes"] = (("stroke0",), """
  SELECT *, sum(CASE WHEN gap > unit * 1.85e0 THEN 1 ELSE 0 END) OVER (PARTITION BY strip ORDER BY mid_x, k) AS grp FROM (
    SELECT *, (list_sort(list(gap) FILTER (gap IS NOT NULL) OVER (PARTITION BY strip)))[count(gap) OVER (PARTITION BY strip) // 2 + 1] AS unit FROM (
      SELECT *, mid_x - lag(mid_x) OVER (PARTITION BY strip ORDER BY mid_x, k) AS gap FROM stroke0
      WHERE length >= typical / 1.9e0 AND length <= typical * 1.9e0))""")
SQL["bars"] = (("strokes",), """
  SELECT b.strip, b.k, b.ink, count(g.grp) AS groups_crossed, CASE WHEN count(g.grp) = 1 THEN CAST(min(g.grp) AS BIGINT) END AS group_no
  FROM segments b LEFT JOIN (
    SELECT b.strip, b.k, s.grp FROM segments b JOIN strokes s ON s.strip = b.strip AND s.mid_x BETWEEN b.min_x - 4 AND b.max_x + 4
    WHERE b.kind = 'bar' GROUP BY ALL HAVING count(*) >= 2) g ON g.strip = b.strip AND g.k = b.k
  WHERE b.kind = 'bar' AND b.ink >= b.length * 0.4e0 GROUP BY b.strip, b.k, b.ink""")
SQL["tallies"] = (("bars", "strips"), """
  SELECT strip, count, reason, CASE WHEN reason IN ('no ink','too dense','runs off the strip','no strokes') THEN 0 ELSE n END AS strokes,
    CASE WHEN reason IN ('unexplained ink','ragged groups','') THEN bars ELSE 0 END AS bars,
    CASE WHEN reason IN ('unexplained ink','ragged groups','') THEN sizes ELSE '' END AS group_sizes,
    CASE WHEN reason IN ('unexplained ink','ragged groups','') THEN explained ELSE 0e0 END AS explained,
    CASE WHEN count IS NULL THEN 0e0 WHEN explained < 0.95e0 THEN 0.6e0 WHEN count = 1 THEN 0.95e0 WHEN count <= 4 THEN 0.8e0 ELSE 0.75e0 END AS confidence
  FROM (SELECT *, CASE WHEN reason = '' THEN total END AS count FROM (
    SELECT *, CASE WHEN raw_ink = 0 THEN 'no ink' WHEN raw_ink > 6000 THEN 'too dense' WHEN clipped THEN 'runs off the strip' WHEN ink = 0 THEN 'no ink'
       WHEN n < 1 THEN 'no strokes' WHEN spread > 30 THEN 'strokes not parallel' WHEN feet > typical * 0.85e0 THEN 'no common baseline'
       WHEN explained < 0.9e0 THEN 'unexplained ink' WHEN ragged THEN 'ragged groups' ELSE '' END AS reason
    FROM (SELECT p.strip, p.ink, p.raw_ink, p.clipped, coalesce(s.n, 0) AS n, spread, feet, typical, coalesce(b.bars, 0) AS bars, sizes, total, ragged,
            round((coalesce(s.ink, 0) + coalesce(b.ink, 0)) / p.ink, 6) AS explained
          FROM strips p
          LEFT JOIN (SELECT strip, count(*) AS n, sum(ink) AS ink, max(angle) - min(angle) AS spread, max(max_y) - min(max_y) AS feet, max(typical) AS typical FROM strokes GROUP BY strip) s USING (strip)
          LEFT JOIN (SELECT strip, count(*) AS bars, sum(ink) AS ink FROM bars WHERE groups_crossed = 1 GROUP BY strip) b USING (strip)
          LEFT JOIN (SELECT strip, string_agg(CAST(sz AS VARCHAR), ',' ORDER BY grp) AS sizes, CAST(sum(sz) AS BIGINT) AS total,
                       bool_or(CASE WHEN grp = last THEN sz > 5 ELSE sz <> 5 END) AS ragged
                     FROM (SELECT g.strip, g.grp, g.n + coalesce(x.n, 0) AS sz, max(g.grp) OVER (PARTITION BY g.strip) AS last
                       FROM (SELECT strip, grp, count(*) AS n FROM strokes GROUP BY ALL) g
                       LEFT JOIN (SELECT strip, group_no, count(*) AS n FROM bars WHERE groups_crossed = 1 GROUP BY ALL) x ON x.strip = g.strip AND x.group_no = g.grp)
                     GROUP BY strip) z USING (strip))))""")


@query("q_bars", with_views("SELECT strip, k, groups_crossed, group_no FROM bars", "bars"))
def q_bars(spark, sf_dir):
    return tally.crossbars(views.segments(spark, sf_dir))


def tallies(spark, sf_dir):
    s = views.segments(spark, sf_dir)
    return tally.count_tallies(s, views.strips_of(s))


@query("q_tally", with_views("SELECT * FROM tallies", "tallies"))
def q_tally(spark, sf_dir):
    return tallies(spark, sf_dir)


@query("q_reasons", with_views("SELECT reason, count(*) AS n FROM tallies WHERE count IS NULL GROUP BY reason", "tallies"))
def q_reasons(spark, sf_dir):
    return tally.decline_reasons(tallies(spark, sf_dir))


@query("q_buckets", with_views("""
SELECT CASE WHEN count <= 4 THEN 'count ' || CAST(count AS VARCHAR) WHEN count <= 9 THEN 'count 5-9' ELSE 'count 10+' END
       || CASE WHEN explained >= 0.95e0 THEN ', fully explained' ELSE ', some ink over' END AS shape,
       count(*) AS n, count(*) FILTER (count = n_typed) AS "right"
FROM tallies JOIN (SELECT l_orderkey AS strip, count(DISTINCT l_linenumber) AS n_typed FROM lineitem GROUP BY 1) USING (strip)
WHERE count IS NOT NULL GROUP BY 1""", "tallies"))
def q_buckets(spark, sf_dir):
    truth = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("strip")).agg(
        F.count_distinct("l_linenumber").alias("n_typed")
    )
    return evaluate.accuracy_by_shape(tallies(spark, sf_dir), truth, ["strip"])


@query("q_hough", with_views("""WITH ang AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({a}, {round(__import__('math').cos(__import__('math').radians(a)), 12)!r}::DOUBLE, {round(__import__('math').sin(__import__('math').radians(a)), 12)!r}::DOUBLE)"
    for a in range(0, 180, 4)) + """) t(angle, c, s)),
v AS (SELECT page, angle, CAST(floor(y * c - x * s + 0.5e0) AS BIGINT) + d AS band, round(x * c + y * s, 6) AS u
      FROM raster, ang, (VALUES (-1), (0), (1)) t(d) WHERE v < 40),
r AS (SELECT *, sum(o) OVER (PARTITION BY page, angle, band ORDER BY u ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY page, angle, band) AS members FROM (
  SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY page, angle, band ORDER BY u) > 8 THEN 1 ELSE 0 END AS o FROM v)),
l AS (SELECT page, angle, band, round(max(u) - min(u), 6) AS length FROM r WHERE members >= 4 GROUP BY page, angle, band, run),
b AS (SELECT page, CAST(angle AS BIGINT) AS angle, band, length FROM l WHERE length >= 11
  QUALIFY row_number() OVER (PARTITION BY page ORDER BY length DESC, angle, band) = 1),
n AS (SELECT page, count(*) AS n FROM raster WHERE v < 40 GROUP BY page)
SELECT n.page, CASE WHEN n <= """ + str(tally.MAX_INK) + """ THEN angle END AS angle, CASE WHEN n <= """ + str(tally.MAX_INK) + """ THEN band END AS band,
  CASE WHEN n <= """ + str(tally.MAX_INK) + """ THEN length END AS length,
  CASE WHEN n > """ + str(tally.MAX_INK) + """ THEN 'too dense' WHEN angle IS NULL THEN 'no line' ELSE '' END AS reason FROM n LEFT JOIN b USING (page)""", "raster"))
def q_hough(spark, sf_dir):
    """Every given page, with the operator's own bound on ink."""
    ink = views.pixels(views.scanlines(spark, sf_dir)).filter("v < 40").select("page", "x", "y")
    return tally.strongest_line(ink, half_band=1)


# Strokes on a page's lower part, whose row begins at line 28 and is 18 lines high.
ROW_TOP, ROW_HEIGHT, ROW_DARK = 28, 18, 150
SQL["page_strokes"] = (("raster",), f"""
  SELECT strip, k, angle, min_y, min_y + 10 AS max_y, mid_x FROM (
    SELECT page AS strip, CAST(k AS BIGINT) AS k, (page * 3 + k) % 19 * 10 AS angle, {ROW_TOP} + (page + k) % 4 AS min_y, (page * 7 + k * 9) % {PAGE_W} AS mid_x
    FROM (SELECT DISTINCT page FROM raster), range(1, 4) r(k))""")


def _trace() -> str:
    """Ink followed upwards line by line, in recursive SQL."""
    return f"""ink AS MATERIALIZED (SELECT page, x, y FROM raster WHERE v < {ROW_DARK}),
trace AS (SELECT strip, k, min_y AS y, CAST(floor(mid_x + (min_y - (min_y + max_y) / 2) * round(cos(radians(angle)), 12) / round(sin(radians(angle)), 12) + 0.5e0) AS BIGINT) AS x,
    CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS missed FROM page_strokes WHERE abs(sin(radians(angle))) >= 1e-3
  UNION ALL
  SELECT t.strip, t.k, t.y - 1, coalesce(a.x, b.x, c.x, t.x), t.run + CASE WHEN coalesce(a.x, b.x, c.x) IS NOT NULL AND t.y - 1 < {ROW_TOP} THEN 1 ELSE 0 END,
    CASE WHEN coalesce(a.x, b.x, c.x) IS NOT NULL THEN 0 ELSE t.missed + 1 END
  FROM trace t LEFT JOIN ink a ON a.page = t.strip AND a.y = t.y - 1 AND a.x = t.x
    LEFT JOIN ink b ON b.page = t.strip AND b.y = t.y - 1 AND b.x = t.x - 1 LEFT JOIN ink c ON c.page = t.strip AND c.y = t.y - 1 AND c.x = t.x + 1
  WHERE t.y > 0 AND t.missed <= {tally.ESCAPE_GAP})"""


def page_strokes(spark, sf_dir):
    pages = views.scanlines(spark, sf_dir).select(F.col("page").alias("strip")).distinct()
    rows = pages.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    s, k = F.col("strip"), F.col("k")
    top = (s + k) % 4 + ROW_TOP
    return rows.select("strip", "k", ((s * 3 + k) % 19 * 10).alias("angle"), top.alias("min_y"), (top + 10).alias("max_y"), ((s * 7 + k * 9) % PAGE_W).alias("mid_x"))


@query("q_overrun", with_views(f"""WITH RECURSIVE {_trace()}
SELECT s.strip, s.k, coalesce(max(run), 0) AS overrun, coalesce(max(run), 0) >= {tally.escape_bar(ROW_HEIGHT)} AS escapes
FROM page_strokes s LEFT JOIN trace t ON t.strip = s.strip AND t.k = s.k GROUP BY s.strip, s.k""", "page_strokes"))
def q_overrun(spark, sf_dir):
    """How far each stroke's ink carries on above its row, and whether that makes it another row's."""
    context = dark(spark, sf_dir, ROW_DARK).withColumnRenamed("page", "strip")
    traced = tally.row_overrun(page_strokes(spark, sf_dir), context, ROW_TOP)
    return traced.select("strip", "k", "overrun", (F.col("overrun") >= tally.escape_bar(ROW_HEIGHT)).alias("escapes"))


RULES = f"""cal AS (SELECT page, y FROM raster GROUP BY page, y HAVING count(*) FILTER (v < 170) < {PAGE_W} * 0.3e0),
col AS (SELECT page, x FROM (
    SELECT r.page, x, CASE WHEN y < {int(PAGE_H * 0.2 + 0.5)} THEN 0 ELSE 1 END AS part, count(*) FILTER (v < 170) AS n, count(*) AS rows_
    FROM raster r JOIN cal USING (page, y) WHERE y < {int(PAGE_H * 0.2 + 0.5)} OR y >= {PAGE_H - int(PAGE_H * 0.2 + 0.5)} GROUP BY ALL)
  WHERE rows_ >= greatest(4e0, {int(PAGE_H * 0.2 + 0.5)} * 0.5e0) AND n >= rows_ * 0.55e0 GROUP BY ALL),
thin AS (SELECT page, x FROM (SELECT *, count(*) OVER (PARTITION BY page, g) AS n FROM (
    SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS g FROM col)) WHERE n <= 6),
rules AS (SELECT DISTINCT page, x + d AS x FROM thin, (SELECT CAST(range AS BIGINT) AS d FROM range(-2, 3)))"""


@query("q_vrules", with_views(f"WITH {RULES} SELECT page, x FROM rules", "raster"))
def q_vrules(spark, sf_dir):
    return tally.vertical_rules(dark(spark, sf_dir, 170), PAGE_W, PAGE_H)


@query("q_edge", with_views(f"""WITH {RULES},
e AS (SELECT r.page, count(*) FILTER (x < 3) AS l, count(*) FILTER (x >= {PAGE_W - 3}) AS r
      FROM raster r WHERE v < 170 AND NOT EXISTS (SELECT 1 FROM rules z WHERE z.page = r.page AND z.x = r.x) GROUP BY r.page)
SELECT p.page, coalesce(l, 0) AS left_ink, coalesce(r, 0) AS right_ink, coalesce(l, 0) >= 6 OR coalesce(r, 0) >= 6 AS touches
FROM (SELECT DISTINCT page FROM raster) p LEFT JOIN e USING (page)""", "raster"))
def q_edge(spark, sf_dir):
    mask = dark(spark, sf_dir, 170)
    return tally.touches_side(mask, tally.vertical_rules(mask, PAGE_W, PAGE_H), PAGE_W)


# ------------------------------------------------------------------ cells of a page
FAINT = 24
SQL["cell_boxes"] = (("cells_map", "excl"), """
  SELECT page, item_row, 16 + (cell * 7) % 8 AS bx, (cell * 5) % 36 AS y, 28 + cell % 4 AS sw, 10 + cell % 4 AS h FROM cells_map c
  WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.page = c.page AND 16 + (c.cell * 7) % 8 < e.x + e.w AND 24 + (c.cell * 7) % 8 > e.x
                    AND (c.cell * 5) % 36 < e.y + e.h AND (c.cell * 5) % 36 + 10 + c.cell % 4 > e.y)""")
SQL["cell_regions"] = (("cell_boxes",), """
  SELECT page, item_row, 0 AS kind, bx AS x0, y AS y0, bx + 8 AS x1, y + h AS y1 FROM cell_boxes
  UNION ALL SELECT page, item_row, 1, 0, y, sw, y + h FROM cell_boxes
  UNION ALL SELECT page, item_row, 2, 0, y + floor(h * 0.1e0 + 0.5e0), sw, y + h - floor(h * 0.1e0 + 0.5e0) FROM cell_boxes""")
SQL["crop_px"] = (("cell_regions", "raster"), f"""
  SELECT (r.page * {cards.ROWS} + item_row) * {cards.KINDS} + kind AS page, x - x0 AS x, CAST(r.y - y0 AS BIGINT) AS y,
         CASE WHEN v < {FAINT} THEN v ELSE 255 END AS v
  FROM raster r JOIN cell_regions c ON c.page = r.page AND x >= x0 AND x < x1 AND r.y >= y0 AND r.y < y1""")
SQL["crop_size"] = (("crop_px",), "SELECT page, max(x) + 1 AS w, max(y) + 1 AS h FROM crop_px GROUP BY page")
SQL["crop_paper"] = (("crop_px",), f"SELECT * FROM {slide('crop_px', 9)}")
SQL["crop_raw"] = (("crop_px", "crop_paper"), """
  SELECT r.page, r.x, r.y, CASE WHEN p.v - r.v >= 22 THEN 1 ELSE 0 END AS v FROM crop_px r JOIN crop_paper p USING (page, x, y)""")
SQL["crop_ink"] = (("crop_raw", "crop_size"), """
  SELECT i.page, i.x, i.y, CASE WHEN rr.y IS NOT NULL OR cc.x IS NOT NULL THEN 0 ELSE i.v END AS v FROM crop_raw i
  LEFT JOIN (SELECT page, y FROM (SELECT *, count(*) OVER (PARTITION BY page, g) AS n FROM (
      SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g
      FROM crop_raw GROUP BY page, y HAVING sum(v) >= count(*) * 0.5e0)) WHERE n <= 6) rr ON rr.page = i.page AND rr.y = i.y
  LEFT JOIN (SELECT page, x FROM (SELECT *, count(*) OVER q AS n, min(x) OVER q AS a, max(x) OVER q AS b FROM (
      SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS g
      FROM crop_raw GROUP BY page, x HAVING sum(v) >= count(*) * 0.5e0) WINDOW q AS (PARTITION BY page, g)) JOIN crop_size s USING (page)
      WHERE n <= 6 AND (a < greatest(2, floor(w * 0.25e0 + 0.5e0)) OR b >= w - greatest(2, floor(w * 0.25e0 + 0.5e0)))) cc
    ON cc.page = i.page AND cc.x = i.x""")
SQL["crop_grown"] = (("crop_ink",), f"SELECT page, x, y FROM {slide('crop_ink', 2)} WHERE v = 1 AND page % {cards.KINDS} <> 1")


@query("q_cells", with_views(f"""WITH RECURSIVE {_reach("crop_grown")},
m0 AS (SELECT p.page, label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM px p JOIN lab USING (page, id)
       GROUP BY p.page, label HAVING count(*) >= 4),
m AS (SELECT m0.*, max_y - min_y + 1 AS tall, least(20, greatest(6, floor(h * 0.25e0 + 0.5e0))) AS bar, w * h * 0.01e0 AS least_ink,
        (SELECT count(*) FROM crop_ink i WHERE i.page = m0.page AND i.v = 1 AND i.x BETWEEN min_x AND max_x AND i.y BETWEEN min_y AND max_y) AS ink
      FROM m0 JOIN crop_size USING (page)),
j AS (SELECT page // {cards.KINDS} AS cell, page % {cards.KINDS} AS kind,
        max(tall) >= max(bar) OR sum(ink) >= least(90, max(least_ink)) AS boxed,
        (count(*) FILTER (tall >= bar) >= 2 AND coalesce(max(max_x) FILTER (tall >= bar) - min(min_x) FILTER (tall >= bar) >= 25, false))
          OR max(ink) >= 250 AS stripped
      FROM m GROUP BY page),
s AS (SELECT page // {cards.KINDS} AS cell,
        round(coalesce(avg(CASE WHEN v < 170 THEN 1e0 ELSE 0e0 END) FILTER (page % {cards.KINDS} = 0), 0), 9) AS ink,
        round(coalesce(avg(CASE WHEN v < 170 THEN 1e0 ELSE 0e0 END) FILTER (page % {cards.KINDS} = 1), 0), 9) AS tally_ink
      FROM crop_px GROUP BY page // {cards.KINDS})
SELECT s.cell // {cards.ROWS} AS page, s.cell % {cards.ROWS} AS item_row, ink, tally_ink, coalesce(b.boxed, false) AS has_value,
       NOT coalesce(b.boxed, false) AS tally_only
FROM s LEFT JOIN j b ON b.cell = s.cell AND b.kind = 0 LEFT JOIN j t ON t.cell = s.cell AND t.kind = 2
WHERE NOT (ink < 0.008e0 AND tally_ink < 0.008e0) AND (coalesce(b.boxed, false) OR coalesce(t.stripped, false))""", "crop_grown", "crop_size", "crop_px"))
def q_cells(spark, sf_dir):
    """Cells that somebody must look at, cut from every page by a map of its own: boxes, strips beside them, and exclusions."""
    lines = views.scanlines(spark, sf_dir).withColumn(
        "px", F.transform("px", lambda v: F.when(v < FAINT, v).otherwise(F.lit(255).cast("smallint"))))
    cell = F.col("cell")
    maps = views.cells_map(spark, sf_dir).select(
        F.col("page").alias("side"), "item_row", (cell * 7 % 8 + 16).alias("total_x"), (cell * 5 % 36).alias("total_y"),
        F.lit(8).alias("total_w"), (cell % 4 + 10).alias("total_h"), F.lit(0).alias("tally_x"), (cell * 5 % 36).alias("tally_y"),
        (cell % 4 + 28).alias("tally_w"), (cell % 4 + 10).alias("tally_h"),
    )
    pages = maps.select(F.col("side").alias("page"), "side").distinct()
    excluded = views.excl(spark, sf_dir).withColumnRenamed("page", "side")
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    return cards.read_cells(lines, pages, maps, exclusions=excluded, tasks=tasks).select("page", "item_row", "ink", "tally_ink", "has_value", "tally_only")
