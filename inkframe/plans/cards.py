"""Page feeds and cards."""

from pyspark.sql import functions as F

from ..operators import ordered, pairing
from . import views
from .registry import query
from .views import with_views

PAIRED = """
  paired AS (
    SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY event ORDER BY page_no) AS card_no
    FROM (
      SELECT *, (row_number() OVER (PARTITION BY event, run ORDER BY page_no) - 1) % 2 = 0 AS opens
      FROM (
        SELECT *, sum(brk) OVER (PARTITION BY event ORDER BY page_no) AS run FROM (
          SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY event ORDER BY page_no) THEN 1 ELSE 0 END AS brk,
                 lead(page_no) OVER (PARTITION BY event ORDER BY page_no) AS next_page
          FROM seq)))),
  cards AS (
    SELECT event, CAST(card_no AS BIGINT) AS card_no,
           max(CASE WHEN side = 'front' THEN page_no END) AS front_page,
           max(CASE WHEN side = 'back' THEN page_no END) AS back_page,
           max(page_no) AS last_page, max_by(coalesce(next_page, -1), page_no) AS next_page
    FROM paired GROUP BY event, card_no)"""


@query("q_pairing", with_views(f"""WITH {PAIRED}
SELECT event, card_no, front_page, back_page,
       concat_ws(',', CASE WHEN front_page IS NULL THEN 'front' END,
                      CASE WHEN back_page IS NULL THEN 'back' END) AS missing_sides
FROM cards""", "seq"))
def q_pairing(spark, sf_dir):
    cards = pairing.pair_pages(views.seq(spark, sf_dir))
    return pairing.missing_sides(cards).drop("next_page")


@query("q_pair_problems", with_views(f"""WITH {PAIRED}
SELECT event, 'misaligned-page' AS kind, page_no AS page, CAST(NULL AS BIGINT) AS other_page
FROM seq WHERE overlap < 0.75e0
UNION ALL
SELECT event, 'sequence-break', coalesce(front_page, back_page), nullif(next_page, -1)
FROM cards WHERE front_page IS NULL OR back_page IS NULL
UNION ALL
SELECT event, 'odd-page-count', NULL, NULL FROM seq GROUP BY event HAVING count(*) % 2 <> 0""", "seq"))
def q_pair_problems(spark, sf_dir):
    return pairing.pairing_problems(views.seq(spark, sf_dir))


@query("q_refused", with_views("""
SELECT event, page_no, side, overlap,
       row_number() OVER (PARTITION BY event ORDER BY overlap, page_no) AS worst_rank
FROM seq WHERE overlap < 0.75e0""", "seq"))
def q_refused(spark, sf_dir):
    return pairing.refused_pages(views.seq(spark, sf_dir))


@query("q_batches", with_views("""
SELECT event, page_no, (rn - 1) // 24 AS batch, (rn - 1) % 24 AS place
FROM (SELECT event, page_no, row_number() OVER (PARTITION BY event ORDER BY page_no) AS rn FROM seq)""", "seq"))
def q_batches(spark, sf_dir):
    """Pages of each feed in sheets of 24, for looking at."""
    pages = views.seq(spark, sf_dir).select("event", "page_no").withColumn("_chunk", ordered.id_chunk("page_no"))
    return ordered.batched(pages, ["event"], ["_chunk"], [F.col("page_no")], 24).drop("_chunk")


@query("q_card_cells", with_views(f"""WITH {PAIRED},
cells AS (SELECT event, page_no, 18 + (page_no * 7 + j * 31) % 83 AS item_row, j FROM seq, (SELECT CAST(range AS BIGINT) AS j FROM range(4))),
s AS (SELECT event, card_no, 'front' AS side, 0 AS k, front_page AS page_no FROM cards WHERE front_page IS NOT NULL
      UNION ALL SELECT event, card_no, 'back', 1, back_page FROM cards WHERE back_page IS NOT NULL)
SELECT event, card_no, row_number() OVER (PARTITION BY event, card_no ORDER BY item_row, k, j) AS place, side, page_no, item_row, j
FROM s JOIN cells USING (event, page_no) WHERE (event, page_no) IN (SELECT (event, page_no) FROM seq WHERE overlap >= 0.75e0)""", "seq"))
def q_card_cells(spark, sf_dir):
    """Four cells of every page, in order of item rows over both trusted sides of each card."""
    pages = views.seq(spark, sf_dir)
    j = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    cells = pages.select("event", "page_no", j.alias("j")).withColumn("item_row", (F.col("page_no") * 7 + F.col("j") * 31) % 83 + 18)
    return pairing.card_cells(pairing.pair_pages(pages), pairing.trusted_pages(pages), cells)


@query("q_unread", with_views(f"""WITH {PAIRED}, ok AS (SELECT event, page_no FROM seq WHERE overlap >= 0.75e0)
SELECT c.event, c.card_no, concat_ws(',', CASE WHEN f.page_no IS NULL THEN 'front' END, CASE WHEN b.page_no IS NULL THEN 'back' END) AS missing_sides
FROM cards c LEFT JOIN ok f ON f.event = c.event AND f.page_no = c.front_page LEFT JOIN ok b ON b.event = c.event AND b.page_no = c.back_page""", "seq"))
def q_unread(spark, sf_dir):
    pages = views.seq(spark, sf_dir)
    return pairing.unread_sides(pairing.pair_pages(pages), pairing.trusted_pages(pages))
