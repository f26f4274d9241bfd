"""A Python data source that captures sites' pages, at most `workers` sites at a time, and the scan rules on captured pages.

    spark.dataSource.register(SiteSource)
    spark.read.format("site_pages").option("sites", "updown,ludi").option("max_pages", 50).load()

Pages of one site are fetched in order with a pause between them (a shop is never read in parallel);
sites are read in parallel as tasks. A failed fetch yields one row without html and ends the site. The
reader stops at a page without offers or with the titles of the page before, and at no number of pages
unless max_pages is given; stop_rows() applies the same rule to pages captured in any other way.
"""

from __future__ import annotations

import itertools
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vitrina.schema import PAGE
from vitrina.sources.sites import build_url, site_rows

RETRY_STATUS = (429, 500, 502, 503, 504)
RETRIES, BACKOFF_S, TIMEOUT_S, PAUSE_S = 3, 1.0, 20.0, 1.0
AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/120 Safari/537.36"


def fetch(url: str) -> str | None:
    """A page's text, tried again on overload and server errors; None if it can't be had."""
    for attempt in range(RETRIES + 1):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": AGENT})
            with urllib.request.urlopen(request, timeout=TIMEOUT_S) as reply:
                return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS:
                return None
        except (OSError, ValueError):
            pass
        if attempt < RETRIES:
            time.sleep(BACKOFF_S * 2**attempt)
    return None


class SitePartition(InputPartition):
    """Sites that one task reads, one after the other: (store, base_url, spec, style) of each."""

    def __init__(self, chosen: list[tuple[str, str, str, str]]) -> None:
        self.chosen = chosen


class SiteReader(DataSourceReader):
    def __init__(self, chosen: list[tuple], max_pages: int | None, pause: float, get: Callable[[str], str | None] = fetch, workers: int = 0) -> None:
        self.chosen, self.max_pages, self.pause, self.get, self.workers = chosen, max_pages, pause, get, workers

    def partitions(self) -> list[SitePartition]:
        each = [(store, base, spec, style) for _, store, base, spec, style, _ in self.chosen]
        n = min(self.workers or len(each), len(each))
        return [SitePartition(each[i::n]) for i in range(n)]

    def read(self, partition: SitePartition) -> Iterator[tuple]:
        for site in partition.chosen:
            yield from self.read_site(*site)

    def read_site(self, store: str, base_url: str, spec: str, style: str) -> Iterator[tuple]:
        from vitrina.operators.extract import extract_page

        before: list | None = None
        for page in itertools.count(1) if self.max_pages is None else range(1, self.max_pages + 1):
            url = build_url(base_url, style, page)
            html = self.get(url)
            if html is None:
                yield (store, page, url, None)
                return
            titles = [o["title"] for o in extract_page(spec, html)]
            if not titles or titles == before:
                return
            yield (store, page, url, html)
            before = titles
            time.sleep(self.pause)


class SiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self):
        return PAGE

    def reader(self, schema) -> SiteReader:
        wanted = [x.strip() for x in (self.options.get("sites") or "").split(",") if x.strip()]
        chosen = [row for row in site_rows() if not wanted or row[1] in wanted]
        dry = (self.options.get("dry_run") or "false").lower() == "true"
        most = self.options.get("max_pages")
        return SiteReader(chosen, 1 if dry else int(most) if most else None, float(self.options.get("pause") or PAUSE_S), workers=int(self.options.get("workers") or 0))


def stop_rows(offers: DataFrame, pages: DataFrame) -> DataFrame:
    """Offers of the pages before each store's first stop: a page that failed, is empty, or has the
    titles of the page just before it.

    offers (store, page, pos, title, ...), pages (store, page, html). Only one row a page is windowed.
    """
    # null titles have no place in collect_list; a marker keeps their position
    mark = F.struct("pos", F.coalesce("title", F.lit("\x00")).alias("title"))
    titles = offers.groupBy("store", "page").agg(F.transform(F.array_sort(F.collect_list(mark)), lambda x: x["title"]).alias("titles"))
    seen = pages.select("store", "page", F.col("html").isNull().alias("failed")).join(titles, ["store", "page"], "left")
    by_page = Window.partitionBy("store").orderBy("page")
    stop = F.col("failed") | F.col("titles").isNull() | F.coalesce(F.col("titles") == F.lag("titles").over(by_page), F.lit(False))
    so_far = F.max(stop.cast("int")).over(by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = seen.select("store", "page", so_far.alias("stopped")).filter("stopped = 0").select("store", "page")
    return offers.join(kept, ["store", "page"], "left_semi")
