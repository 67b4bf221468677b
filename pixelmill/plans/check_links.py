"""Links, products, dated files, pending files, all from the links of the pages."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.plans.registry import query
from pixelmill.sources import links as lk

# the given pages, their links written in five ways: as they are, bare, in single quotes behind a title that looks like a link, next to
# links that a comment and a script hold, and with character references
WAYS = [("<a href=\"([^\"]*)\"", "<A class=x HREF = \\1"), ("<a href=\"([^\"]*)\"", "<a title=\"it's href='/no' > so\" href='\\1'"),
        ("<a href=\"([^\"]*)\"", "<!-- <a href=\"/hidden\">x</a> --><script>s = '<a href=\"/quoted\">';</script><a href=\"\\1\""),
        ("<a href=\"([^\"]*)\"", "<a href=\"\\1?a=1&amp;b=&#38;lt;&copy=&#x41;\"")]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PAGES_SQL = "pages0 AS (SELECT page_id, url, CASE page_id % 5 " + " ".join(
    f"WHEN {k + 1} THEN regexp_replace(html, {_literal(a)}, {_literal(b)}, 'g')" for k, (a, b) in enumerate(WAYS)) + " ELSE html END AS html FROM pages)"

_TOKENS_SQL = _literal(r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)"""
                       r"""|<a(?:[\s/](?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*)?>""")
_ATTRIBUTE_SQL = _literal(r"""(?s)([^\s"'<>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = ", ".join(f"regexp_extract_all(tag[3:], {_ATTRIBUTE_SQL}, {k}) AS a{k}" for k in (1, 2, 3, 4))


def links_sql(pages: str) -> str:
    """(page_id, link, pos) of a table of pages whose links are absolute or begin with a slash."""
    return f"""tg AS (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM (SELECT page_id, url, list_filter(
      regexp_extract_all(html, {_TOKENS_SQL}), lambda t: regexp_matches(t, '(?i)^<a[\\s/>]')) AS tags FROM {pages})),
  att AS (SELECT *, list_position(list_transform(a1, lambda n: lower(n)), 'href') AS h FROM (SELECT *, {_PARTS} FROM tg)),
  hr AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, concat(a2[h], a3[h], a4[h]) AS raw FROM att WHERE h > 0),
  un AS (SELECT *, trim(list_aggregate(list_transform(regexp_extract_all(raw, '(?s)&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]+|#[xX][0-9a-fA-F]+);|[^&]+|&'), lambda t: CASE t
      WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN chr(39) WHEN '&nbsp;' THEN chr(160)
      ELSE CASE WHEN regexp_matches(t, '^&#[0-9]+;$') THEN chr(regexp_extract(t, '[0-9]+')::INT)
        WHEN regexp_matches(t, '^&#[xX]') THEN chr(('0x' || regexp_extract(t, '[xX]([0-9a-fA-F]+)', 1))::INT) ELSE t END END), 'string_agg', '')) AS href FROM hr),
  lt AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS link,
    CAST(min(pos) AS INT) AS pos FROM un GROUP BY 1, 2)"""


@query("link_table", f"WITH {PAGES_SQL}, {links_sql('pages0')} SELECT page_id, link, pos FROM lt")
def _links(t):
    html, k = F.col("html"), F.col("page_id") % 5
    written = F.when(k == 0, html)
    for n, (a, b) in enumerate(WAYS):
        written = written.when(k == n + 1, F.regexp_replace(html, a, b.replace("\\1", "$1")))
    return lk.link_table(t.pages.withColumn("html", written.otherwise(html)))


# the pages as listings: their links lie in one folder per page, of a product and a day
DAY_SQL = "strftime(DATE '1997-01-01' + CAST(page_id * 37 % 800 AS INT), '%Y.%m.%d')"
LISTING_SQL = f"""pages1 AS (SELECT page_id, 'https://example.org/MOTA/' AS url, regexp_replace(html, 'href="/', 'href="/MOTA/MCD' || page_id % 7 || '.006/' || {DAY_SQL} || '/', 'g')
    AS html FROM pages), {links_sql('pages1')}"""
PRODUCT_SQL = f"""pages1 AS (SELECT page_id, 'https://example.org/MOTA/' AS url, regexp_replace(html, 'href="/[^"]*"', 'href="/MOTA/MCD' || page_id % 7 || 'Q.006/"', 'g') AS html
    FROM pages), {links_sql('pages1')}"""


def _rewritten(t, pattern: str, to: Column) -> DataFrame:
    pages = t.pages.select("page_id", F.lit("https://example.org/MOTA/").alias("url"), F.regexp_replace("html", F.lit(pattern), to).alias("html"))
    return lk.link_table(pages)


def listing(t) -> DataFrame:
    day = F.date_format(F.date_add(F.lit(datetime.date(1997, 1, 1)), (F.col("page_id") * 37 % 800).cast("int")), "yyyy.MM.dd")
    return _rewritten(t, 'href="/', F.concat(F.lit('href="/MOTA/MCD'), F.col("page_id") % 7, F.lit(".006/"), day, F.lit("/")))


@query("product_urls", f"WITH {PRODUCT_SQL} SELECT DISTINCT regexp_extract(link, 'MCD[0-9]Q.006') AS product, link AS url FROM lt WHERE link LIKE '%Q.006/'")
def _products(t):
    found = _rewritten(t, 'href="/[^"]*"', F.concat(F.lit('href="/MOTA/MCD'), F.col("page_id") % 7, F.lit('Q.006/"')))
    return lk.product_urls(found)


@query("dated_links", f"""WITH {LISTING_SQL} SELECT page_id, link, pos, CAST(strptime(regexp_extract(link, '[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}'), '%Y.%m.%d') AS DATE) AS date FROM lt
  WHERE strptime(nullif(regexp_extract(link, '[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}'), ''), '%Y.%m.%d') BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'
  AND regexp_matches(link, 'MCD[0-4]\\.006')""")
def _dated(t):
    return lk.dated_links(listing(t), datetime.date(1997, 3, 1), datetime.date(1998, 2, 28), r"MCD[0-4]\.006")


@query("target_path", f"WITH {LISTING_SQL} SELECT page_id, replace(link, 'https://example.org/MOTA', '/data') AS target FROM lt WHERE link LIKE 'https://example.org/MOTA/%'")
def _target(t):
    links = listing(t).filter(F.col("link").startswith("https://example.org/MOTA/"))
    return links.select("page_id", lk.target_path(F.col("link"), "/data/", r"[A-Z0-9]+\.[0-9]{3}").alias("target"))


@query("pending_files", f"""WITH {LISTING_SQL}, q AS (SELECT DISTINCT page_id, replace(link, 'https://example.org/MOTA', '/data') AS target FROM lt WHERE link LIKE 'https://example.org/MOTA/%')
  SELECT DISTINCT target FROM q WHERE target NOT IN (SELECT target FROM q WHERE page_id % 3 = 0)""")
def _pending(t):
    """Files of every third page are there already."""
    links = listing(t).filter(F.col("link").startswith("https://example.org/MOTA/"))
    targets = links.select("page_id", lk.target_path(F.col("link"), "/data").alias("target"))
    return lk.pending_files(targets.select("target").distinct(), targets.filter("page_id % 3 = 0"))
