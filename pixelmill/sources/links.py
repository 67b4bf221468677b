"""Listings: links of pages, products, dated files, files still to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of product listings and of the date part of a listing link.
TOPDIR = r"/[A-Z]+/?$"
PRODUCT = r"(?<=/)[A-Z_0-9]+\.[0-9]+(?=/$)"
LINK_DATE = r"[12][0-9]{3}\.[01][0-9]\.[0-3][0-9]"
# What a page is cut into: comments and elements whose content is text, whole, so that no link is seen inside; and start tags of links. A quote
# counts behind an equals sign only; a comment or element that is not closed ends with the page.
TOKENS = (r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
          r"|<a(?:[\s/](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)?>")
# An attribute: its name, and its value in double quotes, single quotes, or bare.
ATTRIBUTE = r"(?s)([^\s\"'<>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?"
REFERENCE = r"(?s)&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]+|#[xX][0-9a-fA-F]+);|[^&]+|&"
# The character references that links are written with.
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}


def unescape(text: Column) -> Column:
    """Text with its character references decoded, each once; other names stay as they are."""
    def one(t: Column) -> Column:
        number = F.when(t.rlike("^&#[0-9]+;$"), F.regexp_extract(t, "[0-9]+", 0).cast("bigint")) \
            .when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("bigint"))
        # four bytes, big end first
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        out = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), sign)
        for name, c in NAMED.items():
            out = out.when(t == name, F.lit(c))
        return out.otherwise(t)

    return F.when(~text.contains("&"), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one), ""))


def hrefs(html: Column) -> Column:
    """Decoded targets of the links of a page, in order; what a comment, script, style or title holds is no link."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0)), lambda t: t.rlike(r"(?i)^<a[\s/>]"))

    def target(tag: Column) -> Column:
        inside = F.substring(tag, 3, 1 << 30)
        group = lambda k: F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(k))
        at = F.array_position(F.transform(group(1), F.lower), "href")
        value = F.concat(*[F.coalesce(F.try_element_at(group(k), at.cast("int")), F.lit("")) for k in (2, 3, 4)])  # one of them holds it
        return F.when(at > 0, F.trim(unescape(value)))

    return F.filter(F.transform(tags, target), lambda x: x.isNotNull())


def fold_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments, of any depth; what follows ? or # stays as it is."""
    place = F.regexp_extract(path, r"^([^?#]*)", 1)
    rest = F.substring(path, F.length(place) + 1, 1 << 30)
    parts = F.split(place, "/")
    # a last . or .. stands for a folder, so an empty name follows it
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(x == ".", acc)
                       .when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.array_join(kept, "/"), rest)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base``."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    has_path = bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*/")
    folder = F.when(has_path, F.regexp_replace(bare, r"[^/]*$", "")).otherwise(F.concat(bare, F.lit("/")))
    path = F.concat(root, fold_dots(F.substring(F.concat(folder, href), F.length(root) + 1, 1 << 30)))
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href) \
        .when(href.startswith("//"), F.concat(scheme, href)) \
        .when(href.startswith("/"), F.concat(root, fold_dots(href))) \
        .when(href == "", base) \
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)) \
        .when(href.startswith("?"), F.concat(bare, href)).otherwise(path)


def link_table(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Link targets per page, unique, in order of first appearance."""
    found = pages.select(key, F.col(url).alias("_base"), F.posexplode(hrefs(F.col(html))).alias("pos", "_h"))
    return found.select(key, "pos", resolve(F.col("_base"), F.col("_h")).alias("link")) \
        .groupBy(key, "link").agg(F.min("pos").alias("pos"))


def product_urls(links: DataFrame, topdir_regex: str | None = None, product_regex: str = PRODUCT,
                 order: str = "pos") -> DataFrame:
    """Product to url for links that match; the last link of a product wins."""
    hits = links.filter(F.col("link").rlike(product_regex))
    if topdir_regex is not None:
        hits = hits.filter(F.col("page_url").rlike(topdir_regex))
    return hits.groupBy(F.regexp_extract("link", product_regex, 0).alias("product")) \
        .agg(F.max_by("link", F.struct(order, "link")).alias("url"))


def dated_links(links: DataFrame, min_date, max_date, file_regex: str | None = None) -> DataFrame:
    """Links whose yyyy.mm.dd part lies in [min_date, max_date]; either limit may be None. What is no date is left out."""
    stamp = F.nullif(F.regexp_extract("link", LINK_DATE, 0), F.lit(""))
    out = links.withColumn("date", F.try_to_timestamp(stamp, F.lit("yyyy.MM.dd")).cast("date")).filter(F.col("date").isNotNull())
    if min_date is not None:
        out = out.filter(F.col("date") >= min_date)
    if max_date is not None:
        out = out.filter(F.col("date") <= max_date)
    return out if file_regex is None else out.filter(F.col("link").rlike(file_regex))


def pending_files(requested: DataFrame, existing: DataFrame, target: str = "target") -> DataFrame:
    """Requests whose target is not there yet; two requests for one target are an error while running."""
    clash = requested.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    unique = clash.agg((F.coalesce(F.max("_n"), F.lit(0)) <= 1).alias("ok")).scalar()
    checked = F.when(unique, F.col(target)).otherwise(F.raise_error(F.lit("two requests for one target")))
    return requested.join(existing.select(target), target, "left_anti").withColumn(target, checked)


def target_path(url: Column, root: str, product: str = r"[A-Z_0-9]+\.[0-9]{3}") -> Column:
    """Place of a download under ``root``: from the product directory on."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.regexp_extract(url, rf"/({product}/.*)$", 1))
