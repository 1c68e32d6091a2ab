"""Links and listing rows from stored web pages (S12, S13) - the crawler re-aimed at a pages table.

Instead of fetching listing pages over the network, the ``html`` column of a
pages table is parsed with built-in regular-expression functions: one row
per listing row (``<tr>`` or ``<li>``) and link, its tag-free text and the
trailing size (``12.5K`` -> bytes, powers of 1024).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the link pattern, size units and their multipliers; 'P' is accepted by the pattern
# but has no multiplier (counts as 1), as in the audited crawler
SIZE_UNITS = {"": 1, "K": 1024, "M": 1024 ** 2, "G": 1024 ** 3, "T": 1024 ** 4}
SIZE_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*([KMGTPkmgtp]?)"
TRAILING_SIZE_PATTERN = r"(\d+(?:\.\d+)?\s*[KMGTP])\s*(?:&nbsp;)?$"
LINK_PATTERN = r'href="([^"]+)"'


def size_to_bytes(text: Column) -> Column:
    """'12.5K' -> 12800; null when the text does not start with a number."""
    num = F.regexp_extract(text, SIZE_PATTERN, 1)
    unit = F.upper(F.regexp_extract(text, SIZE_PATTERN, 2))
    mult = F.lit(1)
    for u, m in SIZE_UNITS.items():
        if u:
            mult = F.when(unit == u, F.lit(m)).otherwise(mult)
    return F.when(num != "", F.floor(num.cast("double") * mult).cast("long"))


def strip_tags(html: Column) -> Column:
    """Tags removed and whitespace collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def listing_rows(pages: DataFrame, row_tag: str = "li", id_col: str = "page_id") -> DataFrame:
    """(page id, row_no, row_text, href, size_bytes, is_candidate) for every link of every listing row."""
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(
        "html", F.lit(rf"(?s)<{row_tag}[^>]*>(.*?)</{row_tag}>"), 1)).alias("row_no", "row_html"))
    links = rows.select(id_col, "row_no", strip_tags(F.col("row_html")).alias("row_text"),
                        F.explode(F.regexp_extract_all("row_html", F.lit(LINK_PATTERN), 1)).alias("href"))
    size_text = F.regexp_extract("row_text", TRAILING_SIZE_PATTERN, 1)
    low = F.lower("href")
    candidate = low.contains("labeled") & (low.contains("zeek-conn") | low.contains("conn.log"))
    return links.select(id_col, "row_no", "row_text", "href",
                        F.when(size_text != "", size_to_bytes(size_text)).alias("size_bytes"),
                        candidate.alias("is_candidate"))


def page_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page id, link_no, href) of every href in every page."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all("html", F.lit(LINK_PATTERN), 1)).alias("link_no", "href"))


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from the page ``base``: complete addresses stay, '/x' starts at the host, others at the page's folder."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)", 1)
    folder = F.when(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", "") == "", F.concat(host, F.lit("/"))).otherwise(
        F.regexp_extract(base, r"^(.*/)", 1))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), href))
            .when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, F.regexp_replace(href, r"^(?:\./)+", ""))))


def folder_links(links: DataFrame) -> DataFrame:
    """Links to folders below a listing: they end in '/', and don't lead up or to another place."""
    href = F.col("href")
    return links.where(href.endswith("/") & ~href.startswith("/") & ~href.startswith("..") & ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~href.startswith("?"))
