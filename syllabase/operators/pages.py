"""Facts from stored pages: links, programmes, contacts, directories, health."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import values as V
from ..functions.plan import settle
from .ordered import carry_last
from .quality import first_per_group

# Words that make a link worth following, and their extra weight.
LINK_HINTS = (
    r"абитуриент|поступ|admission|applicant|бакалавр|bachelor|специальн|образовательн\w*\s*програм|program|tuition|"
    r"стоимост|price|fee|прайс|образован|faculty|факультет|epvo|univer|catalog|каталог|оплата|платн"
)
DEGREE_HINTS = "бакалавр|6[BbВв]|bachelor|специальн"
PRICE_HINTS = "стоимост|tuition|price|платн"
FILE_TYPES = r"(?i)\.(pdf|docx?|xlsx?|zip|rar|jpg|png)(\?|$)"
TUITION_PAGE = "стоимост|tuition|платн"
# Paths to try on known hosts.
HOST_SEEDS = {
    "nu.edu.kz": ("/ru/admissions", "/ru/schools", "/admissions"), "enu.kz": ("/ru", "/ru/page/applicants", "/ru/page/bachelor"),
    "astanait.edu.kz": ("/", "/ru", "/bachelor", "/admission"), "mnu.kz": ("/ru", "/ru/admission", "/admission"),
    "amu.edu.kz": ("/ru", "/ru/applicant", "/ru/education"), "kazatu.edu.kz": ("/ru", "/ru/applicant"),
    "aiu.kz": ("/", "/admission", "/programs"), "mui.kz": ("/", "/admission"), "tau-edu.kz": ("/", "/admission", "/bachelor"),
    "kaznui.edu.kz": ("/", "/admission"), "satbayev.university": ("/", "/ru", "/admission"),
    "kaznu.kz": ("/ru", "/ru/admission", "/ru/education"), "farabi.university": ("/", "/admission"),
    "kbtu.kz": ("/", "/admission", "/bachelor"), "kimep.kz": ("/", "/admissions", "/academics"),
    "narxoz.kz": ("/", "/admission", "/programs"), "iitu.edu.kz": ("/", "/admission"),
    "sdu.edu.kz": ("/", "/admission", "/programs"), "turan-edu.kz": ("/", "/admission"),
    "almau.edu.kz": ("/", "/admission", "/programs"), "dku.kz": ("/", "/admission"), "ablaikhan.kz": ("/", "/admission"),
}
# Hosts that are never the institution's own site; words its site has.
JUNK_SITES = ("facebook", "instagram", "youtube", "tiktok", "telegram", "vk.com", "zero.kz", "google.", "goo.gl", "bit.ly",
              "t.me", "wa.me", "whatsapp", "twitter", "x.com", "linkedin", "play.google")
OWN_SITE = (".edu", ".kz", "university", "academy", "college")
PAGE_CODE = "6[BbВв][0-9A-Za-zА-Яа-я]{2,6}"
BLOCK_TAGS = ("li", "tr", "p", "div", "td", "a", "h3", "h4")
MAIL = r"(?U)[\w.\-+]+@[\w.\-]+\.\w+"
PHONE = r"\+?7[\s\-\(]?\d{3}[\s\-\)]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"


def page_links(pages: DataFrame, hints: str = LINK_HINTS, seeds: dict = HOST_SEEDS) -> DataFrame:
    """(page_id, place, link, score) of the links worth following on the page's own site."""
    base = F.col("url")
    rows = pages.select("page_id", "url", F.posexplode(H.anchors(H.visible(F.col("html")))).alias("place", "a"))
    rows = rows.filter(~F.col("a.href").rlike(r"^(#|mailto:|tel:|javascript:)"))
    rows = rows.select("page_id", "url", "place", F.col("a.text").alias("text"), H.resolve_url(base, F.col("a.href")).alias("link"))
    rows = settle(rows.withColumn("host", X.plain_host(base)).withColumn("to", X.plain_host(F.col("link"))))
    rows = rows.filter(F.col("link").startswith("http") & H.same_site(F.col("host"), F.col("to")))
    words = F.concat_ws(" ", "text", "link")
    flag = lambda p, n: F.when(words.rlike("(?iU)" + p), n).otherwise(0)
    score = F.when(F.col("link").rlike(FILE_TYPES), flag(hints, 2)).otherwise(
        flag(hints, 3) + flag(DEGREE_HINTS, 2) + flag(PRICE_HINTS, 2)
    )
    links = settle(rows.select("page_id", "place", "link", score.alias("score"))).filter("score > 0")
    paths = F.flatten(F.array_compact(F.array(*[
        F.when(F.contains(X.plain_host(base), F.lit(h)), F.array(*[F.lit(p) for p in ps])) for h, ps in seeds.items()
    ])))
    seeded = pages.select("page_id", "url", F.posexplode(paths).alias("n", "path")).select(
        "page_id", (F.col("n") + 1_000_000).alias("place"), H.resolve_url(base, F.col("path")).alias("link"), F.lit(5).alias("score")
    )
    return links.unionByName(seeded)


def top_links(links: DataFrame, k: int) -> DataFrame:
    """Best k links of a page, each once with its best score; earlier links win ties."""
    best = links.groupBy("page_id", "link").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    return first_per_group(best, ["page_id"], [F.col("score").desc(), F.col("place")], k)


def _page_code(col: Column) -> Column:
    code = F.regexp_extract(col, PAGE_CODE, 0)
    return F.when(code != "", F.regexp_replace(code, "^6[Bb]", "6В"))


def _elements(df: DataFrame, html: Column, tag: str, keys: list[str], place: str) -> DataFrame:
    """One row per element of a tag, nested ones too: the keys, its ``place``, ``tag`` and ``body``."""
    found = H.with_elements(df, html, [tag], "_e").select(*keys, F.posexplode("_e").alias(place, "_x"))
    return found.select(*keys, place, "_x.tag", "_x.body")


def table_programs(pages: DataFrame) -> DataFrame:
    """Programme rows of all tables: the longest cell that is no number or code is the name.

    A table inside a table is read by itself, and its rows and cells are also those of the table around it.
    """
    tables = _elements(pages, H.visible(F.col("html")), "table", ["page_id"], "tab")
    rows = _elements(tables, F.col("body"), "tr", ["page_id", "tab"], "row")
    rows = H.with_elements(rows, F.col("body"), ["t[dh]"], "_c").withColumn("cells", F.transform("_c", lambda c: H.plain(c["body"])))
    rows = settle(rows.select("page_id", "tab", "row", "cells"))
    # The first row is the header when it has cells.
    rows = rows.filter((F.col("row") > 0) & (F.size("cells") > 0)).withColumn("txt", F.array_join("cells", " | "))
    names = F.filter("cells", lambda c: ~c.rlike(f"^{PAGE_CODE}$") & ~c.rlike(r"^[\d\s]+$") & (F.length(c) >= 4))
    longest = F.aggregate(names, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    rows = rows.withColumn("code", _page_code(F.col("txt"))).withColumn(
        "name", F.coalesce(F.nullif(longest, F.lit("")), F.concat(F.lit("Программа "), "code"))
    )
    rows = settle(rows).filter(F.length("name").between(4, 200) & ~F.col("name").rlike("(?iU)^(главная|меню|вход|login|cookie)"))
    return rows.select(
        "page_id", "tab", "row", X.clean_program_name(F.col("name")).alias("name"), "code",
        V.parse_money(F.col("txt")).alias("cost"), V.parse_years(F.col("txt")).alias("duration"), F.lit("table").alias("source_hint"),
    )


def text_programs(pages: DataFrame) -> DataFrame:
    """Programme rows of list items, paragraphs and text lines, each text once per page."""
    seen = settle(pages.select("page_id", H.visible(F.col("html")).alias("_seen")))
    seen = H.with_elements(seen, F.col("_seen"), list(BLOCK_TAGS), "_e").withColumn("_e", F.transform("_e", lambda e: H.plain(e["body"])))
    said = F.filter("_e", lambda t: F.length(t).between(8, 280) & (t.rlike(PAGE_CODE) | t.rlike("(?iU)бакалавр|образовательн")))
    loose = F.filter(H.lines(F.col("_seen")), lambda t: t.rlike(PAGE_CODE) & F.length(t).between(11, 259))
    rows = settle(seen).select("page_id", F.explode(F.array_distinct(F.concat(said, loose))).alias("txt"))
    name = F.regexp_replace(F.regexp_replace("txt", PAGE_CODE, ""), V.MONEY_ANY, "")
    name = X.clean_program_name(F.regexp_replace(name, "(?iU)стоимость.*$", ""))
    rows = settle(rows.withColumn("name", name)).filter(
        (F.length("name") >= 4) & ~F.col("name").rlike("(?iU)^(меню|главная|cookie|подробнее|читать|скачать)")
    )
    return rows.select(
        "page_id", "txt", "name", _page_code(F.col("txt")).alias("code"), V.parse_money(F.col("txt")).alias("cost"),
        V.parse_years(F.col("txt")).alias("duration"), F.lit("text").alias("source_hint"),
    )


def inherit_page_cost(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows without a price take the page's price on tuition pages."""
    texts = settle(pages.select("page_id", H.plain(H.visible(F.col("html"))).alias("txt")))
    tuition = settle(texts.filter(F.col("txt").rlike("(?iU)" + TUITION_PAGE)).select("page_id", V.parse_money(F.col("txt")).alias("page_cost")))
    prices = tuition.filter("page_cost IS NOT NULL")
    inherits = F.col("cost").isNull() & F.col("page_cost").isNotNull()
    return (
        rows.join(prices, "page_id", "left").withColumn("cost_inherited", inherits)
        .withColumn("cost", F.coalesce("cost", "page_cost")).drop("page_cost")
    )


def page_contacts(pages: DataFrame, city: str = "Алматы", listing_site: str = "listing.example") -> DataFrame:
    """Mail, phone, site, address line and the first three long paragraphs of a page."""
    src = H.visible(F.col("html"))
    rows = settle(pages.select("page_id", H.anchors(src).alias("links"), H.lines(src).alias("lines"), H.inner(src, "p").alias("ps")))
    href = lambda start: F.transform(F.filter("links", lambda a: a["href"].startswith(start)), lambda a: a["href"])
    last = lambda arr: F.try_element_at(arr, F.lit(-1))
    sites = F.filter(href("http"), lambda h: ~X.has(F.lower(h), listing_site, *JUNK_SITES) & X.has(F.lower(h), *OWN_SITE))
    whole = F.array_join("lines", "\n")
    found = lambda p: F.nullif(F.regexp_extract(whole, p, 0), F.lit(""))
    mail = F.regexp_replace(last(href("mailto:")), r"^mailto:|\?.*$", "")
    phone = F.regexp_replace(last(href("tel:")), "^tel:", "")
    place = F.filter("lines", lambda s: s.rlike(rf"(?iU){city}|пр\.|ул\.|шоссе|даңғылы|мкр") & F.length(s).between(11, 159)
                     & ~F.contains(F.lower(s), F.lit("cookie")))
    texts = F.slice(F.filter(F.transform("ps", H.plain), lambda s: F.length(s) > 80), 1, 3)
    return rows.select(
        "page_id", F.coalesce(F.nullif(mail, F.lit("")), found(MAIL)).alias("email"),
        F.coalesce(F.nullif(phone, F.lit("")), X.norm_or_null(found(PHONE))).alias("phone"),
        F.get(sites, 0).alias("website"), F.get(place, 0).alias("address"),
        *[F.get(texts, i).alias(f"description{i + 1}") for i in range(3)],
    )


def directory_entries(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, slug, name) of directory links, the first one per slug."""
    rows = pages.select("page_id", F.posexplode(H.anchors(H.visible(F.col("html")))).alias("place", "a"))
    slug = F.regexp_extract("a.href", pattern, 1)
    rows = rows.select("page_id", "place", slug.alias("slug"), F.col("a.text").alias("name"))
    rows = settle(rows).filter((F.col("slug") != "") & (F.length("name") >= 3))
    return rows.groupBy("page_id", "slug").agg(F.min_by("name", "place").alias("name"))


def fill_headers(rows: DataFrame, width: int = 10_000) -> DataFrame:
    """Give every row the name and code of the last header row above it; header rows leave.

    rows: page_id, pos, is_header, header_name, header_code and any other columns.
    """
    head = F.when(F.col("is_header"), F.struct(F.col("header_name").alias("name"), F.col("header_code").alias("code")))
    out = carry_last(rows.drop("global_specialty", "code"), "page_id", "pos", head, "_head", width)
    return (
        out.filter(~F.col("is_header")).withColumn("global_specialty", F.col("_head.name"))
        .withColumn("code", F.col("_head.code")).drop("_head", "is_header", "header_name", "header_code")
    )


GROUP_ROWS = "college-specialty-table-body"


def _has_class(tag: Column, *names: str, part: bool = False) -> Column:
    """Whether an opening tag has one of the classes, or one that holds the name as a part."""
    edge = ("[^\"']*", "[^\"']*") if part else (r"(?:[^\"']*\s)?", r"(?:\s[^\"']*)?")
    return tag.rlike(rf"(?is)\sclass\s*=\s*[\"']{edge[0]}(?:{'|'.join(names)}){edge[1]}[\"']")


def _first_link(body: Column) -> Column:
    return F.nullif(H.plain(F.regexp_extract(body, r"(?is)<a\b[^>]*>(.*?)</a>", 1)), F.lit(""))


def header_table_programs(pages: DataFrame, group_rows: str = GROUP_ROWS) -> DataFrame:
    """Programmes of a table whose group rows head the rows below them.

    A row whose first cell spans columns or stands alone gives group and code in brackets; in any other row the first cell is the
    name, the third the price and the fourth the term. Rows of tables inside cells are rows as well. The first such table counts.
    """
    bodies = H.with_elements(pages, H.visible(F.col("html")), ["tbody"], "_e")
    first = F.get(F.filter("_e", lambda e: _has_class(e["tag"], group_rows)), 0)
    bodies = settle(bodies.select("page_id", first["body"].alias("_body"))).filter("_body IS NOT NULL")
    rows = _elements(bodies, F.col("_body"), "tr", ["page_id"], "pos")
    rows = settle(H.with_elements(rows.select("page_id", "pos", "body"), F.col("body"), ["td"], "_c").filter(F.size("_c") > 0).drop("body"))
    cell = lambda i: F.get("_c", i)["body"]
    text, link = H.plain(cell(0)), _first_link(cell(0))
    rows = settle(rows.withColumn("_text", text).withColumn("_link", link))
    heads = (F.size("_c") == 1) | F.get("_c", 0)["tag"].rlike(r"(?is)\scolspan\b")
    code = F.regexp_extract("_text", r"\((6[BbВв][\dA-Za-zА-Яа-я]+)\)", 1)
    rows = rows.select(
        "page_id", "pos", heads.alias("is_header"),
        F.coalesce("_link", F.regexp_replace("_text", r"\s*\(.*\)\s*$", "")).alias("header_name"), F.nullif(code, F.lit("")).alias("header_code"),
        F.coalesce("_link", "_text").alias("name"), V.parse_money_cell(H.plain(cell(2))).alias("cost"), V.parse_years_cell(H.plain(cell(3))).alias("duration"),
    )
    out = fill_headers(rows).filter("name <> ''")
    return out.select("page_id", "pos", "global_specialty", "code", "name", "cost", "duration")


def card_programs(pages: DataFrame) -> DataFrame:
    """Programmes of a card listing: group headers and blocks with labelled price and term, blocks inside blocks too."""
    found = H.with_elements(pages, F.regexp_replace("html", r"[\r\n]+", " "), ["div"], "_e")
    cards = F.filter("_e", lambda e: _has_class(e["tag"], "border-b", "college-qualification", part=True))
    rows = settle(found.select("page_id", F.posexplode(cards).alias("pos", "_x")).select("page_id", "pos", "_x.tag", "_x.body"))
    code = H.plain(F.regexp_extract("body", r'(?is)class="[^"]*(?:flex-no-shrink|ml-5)[^"]*"[^>]*>(.*?)<', 1))
    rows = rows.withColumn("is_header", _has_class(F.col("tag"), "border-b", part=True)).withColumn("name", F.coalesce(_first_link(F.col("body")), F.lit("")))
    rows = rows.withColumn("header_name", F.nullif("name", F.lit(""))).withColumn("header_code", F.nullif(code, F.lit("")))
    rows = H.with_elements(rows.drop("tag"), F.col("body"), ["div"], "_d")
    cols = F.transform(F.filter("_d", lambda d: _has_class(d["tag"], "flex-col")), lambda d: H.plain(d["body"]))
    rows = settle(rows.withColumn("_cols", cols).withColumn("_whole", H.plain(F.col("body"))).drop("_d", "body"))
    labelled = lambda word, fn: fn(F.try_element_at(F.filter("_cols", lambda c: F.contains(F.lower(c), F.lit(word))), F.lit(-1)))
    rows = rows.withColumn("cost", F.coalesce(labelled("стоимость", V.parse_money_cell), V.parse_money_cell(F.col("_whole"))))
    rows = rows.withColumn("duration", F.coalesce(labelled("срок", V.parse_years_cell), V.parse_years_cell(F.col("_whole")))).drop("_cols", "_whole")
    out = fill_headers(rows).filter("name <> ''")
    return out.select("page_id", "pos", "global_specialty", "code", "name", "cost", "duration")


def site_health(fetches: DataFrame, least: int = 500) -> DataFrame:
    """Per fetched page: ok when the status is 200 and the body is long enough."""
    size = F.length(X.text(F.col("html")))
    good = (F.col("status") == 200) & (size > least)
    return fetches.select("page_id", "url", "status", good.alias("ok"), F.when(good, size).otherwise(0).alias("size"))


def health_totals(health: DataFrame) -> DataFrame:
    return health.groupBy(X.plain_host(F.col("url")).alias("host")).agg(
        F.count("*").alias("pages"), F.count_if("ok").alias("ok_pages"), F.sum("size").alias("size")
    )
