"""Sources in XML, HTML and LDIF."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.functions.text import app_name, digits, last_segment, size_bytes, version_type
from keylake.operators.snapshots import seq_id


def pom_dependencies(df: DataFrame, pom: str = "pom") -> DataFrame:
    """df's other columns with group, artifact and version of each dependency; those without group or artifact are dropped.

    Namespaces are ignored; a text that is no project gives no rows. A dependency is one element of the text, so that a
    missing part of one does not shift those of the next.
    """
    text = F.regexp_replace(F.col(pom), r"(?s)<!--.*?-->", "")
    inner = F.regexp_extract_all(F.regexp_replace(text, r"(?s)<(dependencyManagement|exclusions)>.*?</\1>", ""), F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)
    part = lambda name: F.nullif(F.trim(F.regexp_extract("d", rf"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    rows = df.where(F.contains(pom, F.lit("<project"))).select(*[c for c in df.columns if c != pom], F.explode(inner).alias("d"))
    out = rows.select(*[c for c in df.columns if c != pom], part("groupId").alias("group"), part("artifactId").alias("artifact"), part("version").alias("version"))
    return out.where(F.col("group").isNotNull() & F.col("artifact").isNotNull())


def sitemap_entries(df: DataFrame, xml: str = "xml", slashes: int = 4) -> DataFrame:
    """(package, url, lastmod) of a sitemap's entries; links without the path depth of an application are dropped."""
    entries = df.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("u"))
    found = entries.select(F.trim(F.regexp_extract("u", r"(?s)<loc>(.*?)</loc>", 1)).alias("url"), F.nullif(F.trim(F.regexp_extract("u", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod"))
    return found.where(F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit(""))) == slashes).select(last_segment(F.col("url")).alias("package"), "url", "lastmod")


def ldif_certs(text: Column) -> Column:
    """The base64 blocks after `binary::` in an LDIF text, decoded; those that don't decode are left out."""
    found = F.regexp_extract_all(text, F.lit(r"binary::\s*([A-Za-z0-9+/=]+(?:\n [A-Za-z0-9+/=]+)*)"), 1)
    return F.array_compact(F.transform(found, lambda x: F.try_to_binary(F.regexp_replace(x, r"\s", ""), F.lit("base64"))))


def trust_list_certs(df: DataFrame, xml: str, list_id: str, pattern: str = r"<X509Certificate>\s*([^<]*?)\s*</X509Certificate>") -> DataFrame:
    """(list_id, pos, cert) of each certificate at its first place over all lists."""
    found = df.select(list_id, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(pattern), 1)).alias("pos", "cert"))
    return found.groupBy("cert").agg(F.min(F.struct(list_id, "pos")).alias("first")).select(f"first.{list_id}", "first.pos", "cert")


#: Cells of pages that a worker gathers before it hands them on.
CELLS = 2000


class _Tables(HTMLParser):
    """Cells of table rows: (header before the table, table, row, column, text, first link)."""

    def __init__(self) -> None:
        super().__init__()
        self.out, self.header, self.table, self.row, self.cell = [], None, -1, -1, None

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3"):
            self.header, self.open_header = "", True
        elif tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th") and self.table >= 0:
            self.column = getattr(self, "column", -1) + 1
            self.cell = ["", None]
        elif tag == "a" and self.cell and not self.cell[1]:
            self.cell[1] = dict(attrs).get("href")

    def handle_data(self, data):
        if self.cell:
            self.cell[0] += data
        elif getattr(self, "open_header", False):
            self.header += data

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3"):
            self.open_header = False
        elif tag in ("td", "th") and self.cell:
            self.out.append((self.header and self.header.strip(), self.table, self.row, self.column, self.cell[0].strip(), self.cell[1]))
            self.cell = None


def html_tables(df: DataFrame, html: str, id_col: str) -> DataFrame:
    """(id, header, tbl, line, col, text, href) of each table cell of each page.

    A worker holds the pages of one batch as Arrow has them, and the cells of a few pages, whatever a task has.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, header string, tbl int, line int, col int, text string, href string"
    names = [id_col, "header", "tbl", "line", "col", "text", "href"]
    types = [pa.string(), *[pa.int32()] * 3, pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pages = batch.columns
            at, cells = [], []
            for k in range(batch.num_rows):
                reader = _Tables()
                reader.feed(pages[k].as_py() or "")
                at += [k] * len(reader.out)
                cells += reader.out
                if cells and (len(cells) >= CELLS or k + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *map(pa.array, zip(*cells), types)], names)
                    at, cells = [], []

    return df.select(id_col, html).mapInArrow(work, schema)


#: Layouts of published lists: which column has the size and the hash (and the date), and what groups the files of a set.
LAYOUTS = {"header": (2, 3, None), "date": (3, 2, 4), "flat": (1, 2, None)}


def build_catalogue(cells: DataFrame, id_col: str, first_id: int = 10, layout: str = "flat") -> DataFrame:
    """(id, date, date_utc, files) from table cells (see html_tables): a map of files by name, with href, size and hash.

    Layouts: header, a table under a header with its date, tables of a page from the last to the first; date, rows with a
    date of their own, which groups them over all tables; flat, a table under a header which may be no date. A date that
    does not parse gives a null date_utc. Rows without a link are left out; of equal names in a set the last row counts.
    Ids count from first_id in order of page and place. A catalogue has a row for each published set; its sets are numbered
    by ranges, in no single task.
    """
    size, digest, date = LAYOUTS[layout]
    pick = lambda n, what: F.max(F.when(F.col("col") == n, F.col(what)))
    when = pick(date, "text") if date is not None else F.max("header")
    rows = cells.groupBy(id_col, "tbl", "line").agg(when.alias("date"), pick(0, "text").alias("name"), pick(0, "href").alias("href"), pick(size, "text").alias("size"), pick(digest, "text").alias("hash")).where("href is not null")
    place = F.when(F.lit(layout == "header"), -F.col("tbl")).otherwise(F.col("tbl"))
    file = F.struct("name", "href", digits(F.col("size")).alias("size"), "hash")
    last = rows.groupBy(*(["date"] if layout == "date" else [id_col, "tbl", "date"]), F.col("name").alias("__n")).agg(F.max_by(file, F.struct(id_col, "tbl", "line")).alias("f"), F.min(F.struct(F.col(id_col).alias("page"), place.alias("place"), "line")).alias("at"))
    sets = last.groupBy(*(["date"] if layout == "date" else [id_col, "tbl", "date"])).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__n", "f")))).alias("files"), F.min("at").alias("at"))
    day = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))
    return seq_id(sets.select("date", "files", "at"), "at", start=first_id).select("id", "date", F.unix_timestamp(day).alias("date_utc"), "files")


def app_rankings(cells: DataFrame, id_col: str) -> DataFrame:
    """(id, place, app, package, vendor) of ranking tables: place, linked name and vendor in the first three columns.

    Rows without a number or without a link that names a package (?id=...) are left out.
    """
    pick = lambda n, what: F.max(F.when(F.col("col") == n, F.col(what)))
    rows = cells.groupBy(id_col, "tbl", "line").agg(digits(pick(0, "text")).alias("place"), pick(1, "text").alias("app"), F.regexp_extract(pick(1, "href"), r"\?id=([^&]*)", 1).alias("package"), pick(2, "text").alias("vendor"))
    return rows.where("place is not null and package <> ''").select(id_col, "place", "app", "package", "vendor")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _attribute(element: Column, name: str) -> Column:
    """An attribute of an element's first tag that has it; null if none has."""
    return F.nullif(_value(element, name), F.lit(""))


def _value(element: Column, name: str) -> Column:
    """The same, empty if none has; a condition on it is pushed down, and reads it once."""
    return _plain(F.regexp_extract(element, rf'\b{name}="([^"]*)"', 1))


def _plain(html: Column) -> Column:
    """Text without tags and surrounding white space, the usual entities resolved."""
    out = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", ""), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


_ANCHOR = r"(?s)<a\b[^>]*>.*?</a>"

#: The charts of a dashboard, by column.
CHARTS = ("free", "paid", "grossing", "new_free", "new_paid")


def _cards(df: DataFrame, html: str, rest: list[str], first: int) -> DataFrame:
    """Cards, each from its title to the next one's: `3. Name` links to the package, a subtitle to the vendor."""
    cards = df.select(*rest, F.explode_outer(_all(F.col(html), r'(?s)<a\b[^>]*class="title"[^>]*>.*?(?=<a\b[^>]*class="title"|$)')).alias("__c"))
    title, subtitle = F.regexp_extract("__c", _ANCHOR, 0), F.regexp_extract("__c", r'(?s)<a\b[^>]*class="subtitle"[^>]*>', 0)
    parts = cards.select(*rest, _plain(title).alias("__text"), _value(title, "href").alias("link"), _attribute(subtitle, "title").alias("vendor"))
    place = F.regexp_extract("__text", r"^([0-9]+)\.", 1).try_cast("long")
    return _ranked(parts, rest, place, F.regexp_replace("__text", r"^[0-9]+\.\s*", ""), F.regexp_extract("link", r"\?id=([^&]*)", 1), F.col("vendor"))


def _items(df: DataFrame, html: str, rest: list[str], first: int) -> DataFrame:
    """List items without places of their own: the first anchor is titled and ends in the package, the last is the download."""
    items = df.select(*rest, F.posexplode_outer(_all(F.col(html), r"(?s)<li\b[^>]*>(.*?)</li>", 1)).alias("__k", "__li"))
    found = items.select(*rest, "__k", _all(F.col("__li"), _ANCHOR).alias("__a"))
    head, last = F.try_element_at("__a", F.lit(1)), F.try_element_at("__a", F.lit(-1))
    parts = found.select(*rest, "__k", _value(head, "href").alias("link"), _attribute(head, "title").alias("app"), _attribute(last, "href").alias("download"))
    return _ranked(parts, rest, (F.col("__k") + first).cast("long"), F.col("app"), F.element_at(F.split("link", "/"), -1), F.lit(None), download=F.col("download"))


def _dashboard(df: DataFrame, html: str, rest: list[str], first: int) -> DataFrame:
    """Rows of a table with a place and a cell for each chart: names of app and vendor, and a link .../package/details/..."""
    rows = df.select(*rest, F.explode_outer(_all(F.col(html), r'(?s)<tr\b[^>]*class="main-row[^"]*"[^>]*>.*?</tr>')).alias("__tr"))
    place = digits(_plain(F.regexp_extract("__tr", r"(?s)<td\b[^>]*>(.*?)</td>", 1)))
    found = rows.select(*rest, place.alias("place"), _all(F.col("__tr"), r'(?s)<td\b[^>]*class="app-with-publisher-rank-iap[^"]*"[^>]*>.*?</td>').alias("__cells"))
    cells = found.select(*rest, "place", F.posexplode_outer("__cells").alias("__k", "__td"))
    spans = _all(F.regexp_extract("__td", r'(?s)class="asset-name".*', 0), r"(?s)<span\b[^>]*>(.*?)</span>", 1)
    names = F.filter(F.transform(spans, _plain), lambda x: x != "")
    parts = cells.select(*rest, "place", "__k", names.alias("__names"), _value(F.regexp_extract("__td", _ANCHOR, 0), "href").alias("link"))
    name = lambda n: F.try_element_at("__names", F.lit(n))
    chart = F.try_element_at(F.array(*map(F.lit, CHARTS)), F.col("__k") + 1)
    return _ranked(parts, rest, F.col("place"), name(1), F.regexp_extract("link", r"([^/]+)/details/", 1), name(2), chart)


def _ranked(df: DataFrame, rest: list[str], place: Column, app: Column, package: Column, vendor: Column, kind: Column | None = None, download: Column | None = None) -> DataFrame:
    none = F.lit(None)
    text = {"app": app, "package": F.nullif(package, F.lit("")), "vendor": vendor, "type": none if kind is None else kind, "link": F.col("link"), "download": none if download is None else download}
    return df.select(*rest, place.alias("place"), *[c.cast("string").alias(name) for name, c in text.items()])


def site_rankings(df: DataFrame, html: str, site: str, kind: str | None = None, first: int = 0) -> DataFrame:
    """df's other columns with place, app, package, vendor, type, link and download of each ranked application of a page.

    Sites: cards, list and dashboard, as their functions above describe. A list's places count from first, and kind is the type
    of pages that name none. What a page lacks is null; entries without a link are left out. Null pages give no rows.
    An entry is a row of its own before its parts are read, so that each pattern is looked for once in it. Pages without one
    have a row too up to the last step, as Spark would look for entries twice more to leave these pages out before.
    """
    rest = [c for c in df.columns if c != html]
    rows = {"cards": _cards, "list": _items, "dashboard": _dashboard}[site](df, html, rest, first).where("link <> ''")
    return rows.withColumn("type", F.coalesce("type", F.lit(kind).cast("string")))


def sitemap_kind(xml: Column) -> Column:
    """index for a list of sitemaps, urls for a list of pages, null for what is to be fetched again."""
    return F.when(F.contains(xml, F.lit("<?xml version")), F.when(F.contains(xml, F.lit("sitemapindex")), "index").when(F.contains(xml, F.lit("<url>")), "urls"))


def sitemap_links(df: DataFrame, xml: str = "xml", dropped: tuple[str, ...] = ("default.xml", "topics.xml")) -> DataFrame:
    """df's other columns with url: the sitemaps that index pages list, without those whose names hold a dropped one."""
    rows = df.where(sitemap_kind(F.col(xml)) == "index").select(*[c for c in df.columns if c != xml], F.explode(_all(F.col(xml), r"(?s)<loc>(.*?)</loc>", 1)).alias("url")).withColumn("url", _plain(F.col("url")))
    for name in dropped:
        rows = rows.where(~F.contains("url", F.lit(name)))
    return rows


def listing_entries(df: DataFrame, html: str = "html") -> DataFrame:
    """df's other columns with title, app, type, version, uploaded, size, downloads, variants, company and link of each row of a listing.

    Rows stand in a page's primary part; below a row come version, time, size and downloads, in this order. What does not
    parse is null. Rows without a link are left out.
    """
    main = F.regexp_extract(html, r'(?s)id="primary".*', 0)
    rows = df.select(*[c for c in df.columns if c != html], F.explode(_all(main, r'(?s)<div\b[^>]*class="appRow"[^>]*>.*?(?=<div\b[^>]*class="appRow"|$)')).alias("__r"))
    head, info = F.try_element_at(_all(F.col("__r"), _ANCHOR), F.lit(1)), _all(F.col("__r"), r"(?s)<p\b[^>]*>(.*?)</p>", 1)
    value = lambda k: _plain(F.regexp_replace(F.try_element_at(info, F.lit(k)), r"(?s)^.*?</span>", ""))  # noqa: E731  (its name comes first)
    time = F.regexp_extract(F.try_element_at(info, F.lit(2)), r'data-utcdate="([^"]*?)(?: UTC)?"', 1)
    rows = rows.select(*[c for c in rows.columns if c != "__r"], _plain(head).alias("title"), value(1).alias("version"), F.try_to_timestamp(time, F.lit("yyyy-MM-dd HH:mm:ss")).alias("uploaded"), size_bytes(F.upper(value(3))).alias("size"), digits(value(4)).alias("downloads"), F.contains("__r", F.lit('class="appRowVariantTag"')).alias("variants"), _attribute(head, "href").alias("link"))
    rows = rows.where("link is not null").withColumn("company", F.nullif(F.regexp_extract("link", r"/apk/([^/]*)", 1), F.lit("")))
    return rows.withColumns({"app": app_name(F.col("title"), F.coalesce("version", F.lit(""))), "type": version_type(F.col("title"))})
