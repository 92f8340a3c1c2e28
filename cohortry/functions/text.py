"""Text and URL expressions: tags, behaviour keys, times, canonical URLs, dates, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ── tags, keys and times ───────────────────────────────────────────────────


def tag_map(tag: Column) -> Column:
    """``k:v#k:v`` as a map, split at the first colon; parts without a colon are dropped, the last of equal keys counts."""
    parts = F.filter(F.split(tag, "#"), lambda p: p.contains(":"))
    entry = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?s)^([^:]*):(.*)$", 1).alias("key"), F.regexp_extract(p, r"(?s)^([^:]*):(.*)$", 2).alias("value")))
    kept = F.filter(F.transform(F.sequence(F.lit(0), F.size(entry) - 1), lambda i: F.struct(entry[i].alias("e"), i.alias("i"))), lambda x: ~F.exists(F.slice(entry, x["i"] + 2, F.size(entry)), lambda y: y["key"] == x["e"]["key"]))
    return F.when(F.size(entry) > 0, F.map_from_entries(F.transform(kept, lambda x: x["e"]))).otherwise(F.create_map().cast("map<string,string>"))


def mapped_tags(tag: Column, names: dict[str, str]) -> list[Column]:
    """Named columns from a tag text; keys that ``names`` lacks are dropped."""
    m = tag_map(tag)
    return [F.try_element_at(m, F.lit(k)).alias(out) for k, out in names.items()]


# The layouts of behaviour keys, tried in order: (pattern, event type, attributes from groups, or as they are).
KEY_LAYOUTS: list[tuple[str, str, dict[str, int | str]]] = [
    (r"^留资_(.+)$", "lead_submit", {"channel": 1}),
    (r"^搜索_三车垂媒_(.+?)\{\{.*\}\}$", "search_vertical", {"brand": 1, "channel": "三车垂媒"}),
    (r"^搜索_泛资讯_(.+?)\{\{.*\}\}$", "search_general", {"brand": 1}),
    (r"^搜索__(.+?)\{\{.*\}\}$", "search_general", {"brand": 1}),
    (r"^搜索_泛娱乐种草_([^-]+?)(?:-(.+?))?\{\{.*\}\}$", "search_entertainment", {"brand": 1, "model": 2}),
    (r"^浏览_三车垂媒车辆详情_([^-]+?)(?:-(.+?))?\{\{.*\}\}$", "view_car_detail", {"brand": 1, "model": 2}),
    (r"^浏览_三车垂媒车型对比_(.+?)\{\{.*\}\}$", "view_car_compare", {"brand": 1}),
    (r"^浏览_三车垂媒车贷计算_([^-]+?)(?:-(.+?))?\{\{.*\}\}$", "view_loan_calc", {"brand": 1, "model": 2}),
    (r"^浏览_三车垂媒短视频_(.+?)\{\{.*\}\}$", "view_short_video", {"brand": 1}),
    (r"^浏览_三车垂媒联系销售_(.+?)\{\{.*\}\}$", "view_contact_sales", {"brand": 1}),
    (r"^浏览_三车垂媒查落地价_(.+?)\{\{.*\}\}$", "view_floor_price", {"brand": 1}),
    (r"^试驾_(.*)$", "test_drive", {"model": 1}),
    (r"^大定_(.+)$", "order_placed", {"model": 1}),
    (r"^广告点击_(.+?)@_@([^_]*)_?([^#]*)(?:#[^#]*)?(?:#(.*))?$", "ad_click", {"app": 1, "category": 2, "brand": 3, "creative": 4}),
    (r"^路过门店$", "pass_dealership", {}),
    (r"地图|打车", "map_app_use", {}),
    (r"租车", "rental_app_use", {}),
]
NO_BRAND = "无明确品牌"
#: Event types whose brand stands as it is, also an unclear one.
ANY_BRAND = ("view_car_detail", "view_loan_calc", "ad_click")


def behaviour_key(key: Column) -> tuple[Column, Column]:
    """A behaviour key's event type, and its attributes as a map; an unclear brand is none (but in ANY_BRAND), a key of no layout is unknown."""
    k = F.trim(key)
    kind, attrs = F.lit("unknown"), F.create_map(F.lit("raw"), k)
    for pattern, name, groups in reversed(KEY_LAYOUTS):
        hit = k.rlike(pattern)
        pairs: list[Column] = []
        for attr, n in groups.items():
            v = F.lit(n) if isinstance(n, str) else F.trim(F.regexp_extract(k, pattern, n))
            unclear = v.contains(NO_BRAND) if attr == "brand" and name not in ANY_BRAND else F.lit(False)
            pairs += [F.lit(attr), F.when((v != "") & ~unclear, v)]
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        attrs = F.when(hit, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).otherwise(attrs)
    return kind, attrs


def event_time(time: Column, zone_formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "yyyyMMddHH", "yyyyMMdd")) -> Column:
    """A timestamp from text in several encodings, or from epoch seconds or milliseconds."""
    t = F.trim(time.cast("string"))
    iso = F.try_to_timestamp(F.regexp_replace(t, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    n = t.try_cast("long")
    epoch = F.when(t.rlike(r"^\d{13}$"), F.timestamp_millis(n)).when(t.rlike(r"^1\d{9}$") & ~t.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])"), F.timestamp_seconds(n))
    tries = [F.when(F.length(t) == len(f), F.try_to_timestamp(t, F.lit(f))) for f in zone_formats]
    return F.coalesce(iso, epoch, *tries)


def converted_from_events(events: Column, field: str = "res_key") -> Column:
    return F.coalesce(F.exists(events, lambda e: e[field].startswith("留资_")), F.lit(False)).cast("int")


def payload(text: Column, names: list[str], sep: str = r"\^") -> list[Column]:
    """Positional fields of a separated payload; missing and empty ones are null."""
    parts = F.split(text, sep)
    return [F.nullif(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(names)]


def hex_json(text: Column, schema: str) -> Column:
    return F.from_json(F.decode(F.unhex(text), "UTF-8"), schema)


def base64_text(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")


# ── URLs ───────────────────────────────────────────────────────────────────

# Fixed values of the link rules.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content from ref source via fbclid gclid msclkid mc_cid mc_eid".split()
PAGING = "page p offset sort order tab filter type".split()
OUTSIDE = (
    "twitter.com x.com facebook.com instagram.com linkedin.com youtube.com github.com reddit.com weibo.com weixin.qq.com mp.weixin.qq.com "
    "t.me telegram.org discord.com discord.gg apple.com play.google.com apps.apple.com bit.ly t.co goo.gl tinyurl.com"
).split()
FILES = r"(?i)\.(pdf|doc|docx|xls|xlsx|ppt|pptx|jpg|jpeg|png|gif|svg|webp|ico|bmp|css|js|json|xml|yaml|yml|zip|tar|gz|rar|7z|mp3|mp4|avi|mov|wmv|flv|woff|woff2|ttf|eot|otf)$"
NOT_ARTICLES = (
    r"(?i)^/(login|register|signup|signin|logout|about|contact|help|faq|terms|privacy|policy|settings|profile|account|dashboard|admin|search|tag|tags|"
    r"category|categories|topic|topics|user|users|author|authors|member|page|feed|rss|atom|api|static|assets|download|downloads|app|apps|pricing|subscribe|cart|checkout)(/|$)"
)
ARTICLES = r"(?i)/(p|post|posts|article|articles|news|detail|story|blog|entry|item|view|read)/|/\d{4}/\d{2}/|/\d{4}-\d{2}-"

URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, part: str) -> Column:
    return F.regexp_extract(url, URL, {"scheme": 1, "host": 2, "path": 3, "query": 4}[part])


def _query(url: Column, drop) -> Column:
    kept = F.filter(F.split(url_part(url, "query"), "&"), lambda p: (p != "") & ~drop(F.lower(F.substring_index(p, "=", 1))))
    return F.array_join(kept, "&")


def _path(url: Column) -> Column:
    p = url_part(url, "path")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))


def canonical_url(url: Column) -> Column:
    """An absolute URL as https without tracking parameters, fragment and closing slash; null for other schemes."""
    q = _query(url, lambda k: k.isin(TRACKING))
    out = F.concat(F.lit("https://"), url_part(url, "host"), _path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(F.lower(url_part(url, "scheme")).isin("http", "https"), out)


def canonical_url_kept_scheme(url: Column) -> Column:
    """A URL with its scheme, lower-case host, no ``utm_`` parameters, fragment or closing slash."""
    u = F.trim(url)
    q = _query(u, lambda k: k.startswith("utm_"))
    p = F.when(F.length(url_part(u, "path")) > 1, F.regexp_replace(url_part(u, "path"), "/+$", "")).otherwise(url_part(u, "path"))
    return F.concat(url_part(u, "scheme"), F.lit("://"), F.lower(url_part(u, "host")), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def url_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical_url_kept_scheme(url), 256), 1, 16)


#: Named entities that addresses hold.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def unescaped(text: Column) -> Column:
    """A text with numbered entities and those of ENTITIES decoded, each once; others stay."""

    def one(part: Column) -> Column:
        digits = F.nullif(F.regexp_extract(part, r"^#([0-9]{1,7});", 1), F.lit(""))
        number = F.coalesce(F.conv(F.nullif(F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10), digits).cast("int")
        rest = F.regexp_replace(part, r"^[^;]*;", "")
        out = F.concat(F.lit("&"), part)
        for name, letter in ENTITIES.items():
            out = F.when(part.startswith(f"{name};"), F.concat(F.lit(letter), rest)).otherwise(out)
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(known, F.concat(letter, rest)).otherwise(out)

    parts = F.split(text, "&")
    more = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(text.contains("&"), F.concat(F.element_at(parts, 1), F.array_join(more, ""))).otherwise(text)


def _walked(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; it never leaves the root."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(segments, none, lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    closed = F.concat(kept, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))
    joined = F.array_join(closed, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolved(base: Column, href: Column) -> Column:
    """A link against its page; null for what is no page.

    Absolute and scheme-relative links stay as they are.  Paths from the root or the page's folder lose ``.`` and ``..`` segments
    (those from the folder repeated slashes too), query-only links keep the page's path.  ``href`` has its entities decoded.
    """
    h = F.trim(href)
    root = F.concat(url_part(base, "scheme"), F.lit("://"), url_part(base, "host"))
    folder = F.regexp_extract(url_part(base, "path"), r"^(.*/)[^/]*$", 1)
    path, rest = F.regexp_extract(h, r"^[^?#]*", 0), F.regexp_replace(h, r"^[^?#]*", "")
    below = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/{2,}", "/")
    return (
        F.when((h == "") | h.rlike(r"^(#|javascript:|mailto:|tel:)"), F.lit(None))
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(url_part(base, "scheme"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, _walked(path), rest))
        .when(h.startswith("?"), F.concat(root, url_part(base, "path"), h))
        .otherwise(F.concat(root, _walked(below), rest))
    )


def registered_domain(url: Column) -> Column:
    """The last two labels of the host, or three where the last but one is short and there are three."""
    parts = F.split(F.lower(url_part(url, "host")), r"\.")
    n = F.size(parts)
    three = (n >= 3) & (F.length(F.try_element_at(parts, F.lit(-2))) <= 3)
    return F.array_join(F.when(three, F.slice(parts, -3, 3)).when(n >= 2, F.slice(parts, -2, 2)).otherwise(parts), ".")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(url_part(url, "host")), r"^www\.", "")


def link_score(url: Column, page: Column) -> Column:
    """How much a canonical URL looks like an article of ``page``'s site; -10 rules it out."""
    path, domain = url_part(url, "path"), registered_domain(url)
    home = domain == registered_domain(page)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.size(segments)
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    keys = F.transform(F.split(url_part(url, "query"), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    score = (
        F.when(home, 1).otherwise(0)
        + F.when(depth < 1, -5).when(depth == 1, -2).when(depth == 2, 1).otherwise(2)
        + F.when(path.rlike(r"/\d{5,}"), 3).otherwise(0)
        + F.when(path.rlike(ARTICLES), 2).otherwise(0)
        + F.when(last.contains("-") & (F.length(last) > 10), 1).otherwise(0)
        + F.when(F.arrays_overlap(keys, F.array(*[F.lit(p) for p in PAGING])), -3).otherwise(0)
    )
    out = (~home & domain.isin(OUTSIDE)) | (url == canonical_url(page)) | path.rlike(FILES) | path.rlike(NOT_ARTICLES)
    return F.when(out, -10).otherwise(score)


# ── texts ──────────────────────────────────────────────────────────────────


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(folded(text), 256)


def language_class(text: Column) -> Column:
    """zh, en or other by the share of CJK and Latin letters among the first 2,000 characters (the feature's own sample)."""
    sample = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    n = F.length(sample)
    cjk = n - F.length(F.regexp_replace(sample, r"[一-鿿]", ""))
    latin = n - F.length(F.regexp_replace(sample, r"[a-zA-Z]", ""))
    return F.when(n == 0, "other").when(cjk / n > 0.05, "zh").when(latin / n > 0.30, "en").otherwise("other")


def short_summary(text: Column, most: int = 300) -> Column:
    """Folded text of at most ``most`` characters: cut at a word boundary near the end unless in CJK, with an ellipsis."""
    s = F.coalesce(folded(text), F.lit(""))
    cut = F.substring(s, 1, most)
    cjk = F.substring(cut, most, 1).rlike(r"[　-〿㐀-䶿一-鿿豈-﫿＀-￯]")
    space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    back = F.when(~cjk & (space >= most - 30), F.substring(cut, F.lit(1), space)).otherwise(cut)
    trimmed = F.rtrim(back)
    return F.when(F.length(s) <= most, s).when(trimmed.rlike(r"(\.\.\.|…)\s*$"), trimmed).otherwise(F.concat(trimmed, F.lit("…")))


def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.str.normalize("NFKC")


def normal_title(title: Column) -> Column:
    """NFKC (the one step Spark has no function for), lower case, without punctuation and white space."""
    nfkc = F.pandas_udf(_nfkc, "string")
    return F.regexp_replace(F.lower(nfkc(title)), r"[\p{P}\p{S}\s]+", "")


def dates_in(text: Column) -> Column:
    """All dates in a text as an array: 2026-03-01, 2026/3/1, 2026年3月1日."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d{2}[-/年.]\d{1,2}[-/月.]\d{1,2})(?!\d)"), F.lit(1))
    plain = F.transform(found, lambda d: F.try_to_timestamp(F.regexp_replace(d, "[/年月.]", "-"), F.lit("y-M-d")).cast("date"))
    return F.array_compact(plain)


def publish_date(field: Column, url: Column, content: Column, collected: Column, now: Column, days: int) -> tuple[Column, Column, Column]:
    """Date, source (field, url_path, content_regex, none) and whether it is within ``days`` before ``now``.

    The field comes first, then the URL's path, then the date in the first 500 characters that is nearest to the
    collection day and not in the future.
    """
    own = F.coalesce(*[F.try_to_timestamp(F.trim(field), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")]).cast("date")
    path = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(url, r"/((?:19|20)\d{2}[-/]?(?:0[1-9]|1[0-2])[-/]?(?:0[1-9]|[12]\d|3[01]))(?:/|\D|$)", 1), "[-/]", ""), F.lit("yyyyMMdd")).cast("date")
    seen = F.filter(dates_in(F.substring(content, 1, 500)), lambda d: d <= now)
    near = F.array_sort(F.transform(seen, lambda d: F.struct(F.abs(F.datediff(d, collected)).alias("far"), d.alias("d"))))
    found = F.try_element_at(near, F.lit(1))["d"]
    date = F.coalesce(own, path, found)
    source = F.when(own.isNotNull(), "field").when(path.isNotNull(), "url_path").when(found.isNotNull(), "content_regex").otherwise("none")
    return date, source, F.coalesce(date.between(F.date_sub(now, days), now), F.lit(False))


def html_title(html: Column) -> Column:
    og = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)""", 1)
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return folded(F.when(og != "", og).otherwise(title))


def html_description(html: Column) -> Column:
    return folded(F.regexp_extract(html, r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)""", 1))


def html_plain(html: Column) -> Column:
    """Text without scripts, styles and tags, folded (a quick view of a page)."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    return folded(F.regexp_replace(bare, r"<[^>]+>", " "))


def html_date(html: Column, url: Column) -> tuple[Column, Column]:
    """A page's date and where it was found: meta, json_ld, url, text (first 400 characters), none."""
    def day(text: Column) -> Column:
        return F.try_to_timestamp(F.regexp_replace(text, "[/年月.]", "-"), F.lit("y-M-d")).cast("date")

    date = r"((?:19|20)\d{2}[-/年.]\d{1,2}[-/月.]\d{1,2})"
    meta = day(F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:published_time|pubdate|publishdate|date)["'][^>]+content=["']{date}""", 1))
    ld = day(F.regexp_extract(html, rf'''(?is)"datePublished"\s*:\s*"{date}''', 1))
    in_url = day(F.regexp_extract(url, rf"/{date}", 1))
    text = F.try_element_at(dates_in(F.substring(html_plain(html), 1, 400)), F.lit(1))
    source = F.when(meta.isNotNull(), "meta").when(ld.isNotNull(), "json_ld").when(in_url.isNotNull(), "url").when(text.isNotNull(), "text").otherwise("none")
    return F.coalesce(meta, ld, in_url, text), source


# ── scorer output ──────────────────────────────────────────────────────────

# Weights of the quality parts.
QUALITY = {"authenticity": 0.20, "timeliness": 0.10, "relevance": 0.40, "depth": 0.15, "objectivity": 0.10, "readability": 0.05}


def quality_total(answer: Column) -> Column:
    """The total of a scorer's JSON, recomputed as a weighted sum where it is missing or outside 0 to 10."""
    q = F.from_json(F.get_json_object(answer, "$.quality_score"), "map<string,double>")
    own = F.try_element_at(q, F.lit("total"))
    again = F.round(sum((F.coalesce(F.try_element_at(q, F.lit(k)), F.lit(0.0)) * w for k, w in QUALITY.items()), F.lit(0.0)), 1)
    return F.when(q.isNull(), F.lit(None)).when(own.between(0, 10), own).otherwise(again)


def enriched(answer: Column, kinds: list[str]) -> Column:
    """A scorer's JSON checked: kind allowed, thoughts given, three tags or more (cut to six); else the error."""
    a = F.from_json(answer, "insight_type string, thoughts string, tags array<string>, score string")
    tags = F.filter(F.transform(a["tags"], lambda t: F.trim(t)), lambda t: t != "")
    error = (
        F.when(a.isNull() | a["insight_type"].isNull() | ~F.trim(a["insight_type"]).isin(kinds), "bad insight_type")
        .when(F.coalesce(F.trim(a["thoughts"]), F.lit("")) == "", "no thoughts")
        .when(F.coalesce(F.size(tags), F.lit(0)) < 3, "fewer than 3 tags")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, F.trim(a["insight_type"])).alias("insight_type"), F.when(ok, F.trim(a["thoughts"])).alias("thoughts"), F.when(ok, F.slice(tags, 1, 6)).alias("tags"), error.alias("error"))


def checked_score(answer: Column) -> Column:
    s = F.get_json_object(answer, "$.score").try_cast("double")
    return F.when(s.between(0, 10), F.round(s, 1))


def prompt(template: str, columns: dict[str, Column]) -> Column:
    """A template with ``{name}`` places filled from columns; nulls are empty."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out
