"""Registered queries on text, pages, articles and metrics over the given tables, with DuckDB SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import keywords as K
from ..operators import metrics as M
from ..operators import web as B
from ..sources.store import Store
from ..streaming.run import shared_folder
from .driver_tables import table
from .wide_queries import ads
from .wide_queries import SQL as ADS_SQL


# ── text and tag parsing ───────────────────────────────────────────────────


def _tags(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("seg:"), "c_mktsegment", F.lit("#nation:"), F.col("c_nationkey").cast("string"), F.lit("#url:http://x#odd#name:"), F.col("c_name")).alias("tag"))


def p1_tag_columns(spark, d):
    return _tags(spark, d).select("c_custkey", *X.mapped_tags(F.col("tag"), {"seg": "segment", "nation": "nation", "url": "url"}))


def p2_tag_map(spark, d):
    m = X.tag_map(F.col("tag"))
    return _tags(spark, d).select("c_custkey", F.size(m).alias("n"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), "tag")


_KEYS = ["留资_官网", "搜索_三车垂媒_b{k}{{{{x}}}}", "搜索_泛资讯_无明确品牌{{{{x}}}}", "搜索__b{k}{{{{}}}}", "搜索_泛娱乐种草_b{k}-m{k}{{{{x}}}}", "浏览_三车垂媒车辆详情_b{k}-m{k}{{{{x}}}}", "浏览_三车垂媒车型对比_b{k}{{{{x}}}}", "浏览_三车垂媒车贷计算_无明确品牌{{{{x}}}}", "浏览_三车垂媒短视频_b{k}{{{{x}}}}", "浏览_三车垂媒联系销售_b{k}{{{{x}}}}", "浏览_三车垂媒查落地价_b{k}{{{{x}}}}", "试驾_", "大定_m{k}", "广告点击_App@_@工具#3_b{k}#t#创意", "路过门店", "使用地图", "租车软件", "其他"]


def p3_behaviour_keys(spark, d):
    e = table(spark, d, "events")
    k = (F.col("event_id") % 10).cast("string")
    key = F.lit(None).cast("string")
    for i, t in enumerate(_KEYS):
        key = F.when(F.col("event_id") % len(_KEYS) == i, F.replace(F.lit(t.replace("{{{{", "{{").replace("}}}}", "}}")), F.lit("{k}"), k)).otherwise(key)
    kind, attrs = X.behaviour_key(F.col("key"))
    return e.select("event_id", key.alias("key")).select("event_id", kind.alias("event_type"), *[F.try_element_at(attrs, F.lit(a)).alias(a) for a in ("brand", "model", "channel")])


_KINDS = ["lead_submit", "search_vertical", "search_general", "search_general", "search_entertainment", "view_car_detail", "view_car_compare", "view_loan_calc", "view_short_video", "view_contact_sales", "view_floor_price", "test_drive", "order_placed", "ad_click", "pass_dealership", "map_app_use", "rental_app_use", "unknown"]


def p4_event_times(spark, d):
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    t = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyyMMddHH")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.unix_timestamp(ts).cast("string")).otherwise("not a time")
    return e.select("event_id", F.date_format(X.event_time(t), "yyyy-MM-dd HH:mm:ss").alias("t"))


def p5_conversion_inferred(spark, d):
    e = table(spark, d, "events")
    key = F.when(F.col("event_type") == "purchase", F.lit("留资_x")).otherwise(F.col("event_type"))
    g = e.groupBy("user_id").agg(F.collect_list(F.struct(key.alias("res_key"))).alias("user_events"))
    return g.select("user_id", X.converted_from_events(F.col("user_events")).alias("is_converted"))


def p9_payloads(spark, d):
    c = table(spark, d, "customer")
    text = F.concat_ws("^", F.col("c_custkey").cast("string"), F.lit(""), "c_mktsegment")
    packed = F.hex(F.to_json(F.struct(F.col("c_name").alias("n"))))
    return c.select("c_custkey", *X.payload(text, ["a", "b", "c", "missing"]), X.hex_json(packed, "n string")["n"].alias("name"), X.base64_text(F.base64(F.col("c_name").cast("binary"))).alias("app"))


def p13_canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


def p14_url_ids(spark, d):
    return table(spark, d, "pages").select("page_id", X.canonical_url_kept_scheme(F.col("url")).alias("url"), X.url_id(F.col("url")).alias("id"))


def p15_domains(spark, d):
    return table(spark, d, "pages").select("page_id", X.registered_domain(F.col("url")).alias("domain"), X.host(F.col("url")).alias("host"))


def p16_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


def p17_language(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language_class(F.col("text")).alias("language"))


def p18_publish_dates(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    field = F.when(k % 4 == 0, F.lit("2024-01-20")).when(k % 4 == 1, F.lit("soon"))
    url = F.when(k % 4 == 2, F.concat("url", F.lit("/2023/11/05/x"))).otherwise(F.col("url"))
    text = F.when(k % 4 == 3, F.lit("seen 2030-01-01, on 2024年1月3日 and 2023/12/30.")).otherwise("none")
    date, source, within = X.publish_date(field, url, text, F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date"), 30)
    return p.select("page_id", date.cast("string").alias("date"), source.alias("source"), within.alias("within"))


def p19_html_dates(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    html = F.when(k % 4 == 0, F.concat(F.lit('<meta property="article:published_time" content="2024-01-02T00:00">'), "html")).when(k % 4 == 1, F.concat(F.lit('<script>{"datePublished": "2023-05-06"}</script>'), "html")).otherwise(F.col("html"))
    url = F.when(k % 4 == 2, F.lit("https://x.example/2022/03/04/a")).otherwise(F.lit("https://x.example/a"))
    date, source = X.html_date(html, url)
    return p.select("page_id", date.cast("string").alias("date"), source.alias("source"))


def p20_html_fields(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), X.html_description(F.col("html")).alias("description"), F.length(X.html_plain(F.col("html"))).alias("n_plain"))


def p22_feed_summaries(spark, d):
    """All pages as feed entries; those whose page tells a date before the cutoff go."""
    return B.feed_entries(table(spark, d, "pages"), F.lit("2024-01-01").cast("date")).select("page_id", "summary", "n_content", F.size("images").alias("n_images"), F.col("date").cast("string").alias("date"))


def p23_short_summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short_summary(F.col("text"), 300).alias("summary"))


def p24_normal_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normal_title(F.substring_index("text", ".", 1)).alias("title"))


def p25_prompts(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.prompt("Rate {name} of {seg} ({bal}).", {"name": F.col("c_name"), "seg": F.col("c_mktsegment"), "bal": F.col("c_nationkey")}).alias("prompt"))


def _answers(spark, d):
    """A stand-in for a scorer: its answer follows from the length of the whole text."""
    p = table(spark, d, "documents")
    k = F.length(F.coalesce("text", F.lit("")))
    kind = F.when(k % 5 == 0, "bad").otherwise("trend")
    n = (k % 7).cast("int")
    tags = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(F.lit("t"), i.cast("string")))
    return p.select("doc_id", F.to_json(F.struct(kind.alias("insight_type"), F.when(k % 11 == 0, " ").otherwise("why").alias("thoughts"), tags.alias("tags"), (k % 13).cast("string").alias("score"))).alias("answer"))


def p26_scorer_checks(spark, d):
    e = X.enriched(F.col("answer"), ["trend", "tech"])
    return _answers(spark, d).select("doc_id", e["error"].alias("error"), F.array_join(e["tags"], ",").alias("tags"), X.checked_score(F.col("answer")).alias("score"))


def p27_quality_totals(spark, d):
    k = F.length(F.coalesce("text", F.lit("")))
    parts = [F.lit(float(i)).alias(n) if i else (k % 10).cast("double").alias(n) for i, n in enumerate(X.QUALITY)]
    answer = F.when(k % 9 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.struct(*parts, F.when(k % 3 == 0, (k % 14).cast("double")).alias("total")).alias("quality_score"))))
    return table(spark, d, "documents").select("doc_id", X.quality_total(answer).alias("total"))


# ── articles ───────────────────────────────────────────────────────────────


def d44_article_links(spark, d):
    return B.article_links(table(spark, d, "pages"), top=20, least=-1)


def _listings(spark, d):
    """Every page with an anchor of the class ``more`` to the next page's address (unquoted, escaped) and one beside its folder."""
    p = table(spark, d, "pages")
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    more = F.concat(F.lit("<a class=more href="), F.regexp_replace("next", "&", "&amp;"), F.lit("&amp;utm_source=n>next</a>"))
    beside = F.concat(F.lit("<a class='more' href='../news/story-of-page/"), (F.col("page_id") + 10000).cast("string"), F.lit("'>story</a>"))
    return p.join(after, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce(more, F.lit("")), beside).alias("html"))


def x4_listing_links(spark, d):
    """Article links of listing pages: of the class ``more``, below a folder, with two points or more."""
    return B.article_links(_listings(spark, d), selector=r"\bclass\s*=\s*['\"]?more\b", pattern=r"^https://[^/]+/[^/]+/")


def w11_first_links(spark, d):
    return B.keep_first(B.page_links(table(spark, d, "pages")), ["page_id", "link"], [F.col("place")]).select("page_id", "place", "link")


def _halves(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("bal"))
    return t.where("c_custkey % 3 > 0"), t.where("c_custkey % 3 < 2").withColumn("bal", F.col("bal") + 1)


def s10_upsert(spark, d):
    old, new = _halves(spark, d)
    return B.upsert(old, new, ["c_custkey"])


def s11_insert_or_ignore(spark, d):
    old, new = _halves(spark, d)
    return B.insert_or_ignore(old, new.union(new), ["c_custkey"])


def s12_changed_only(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    old = t.where("doc_id % 4 > 0").select("doc_id", X.content_hash(F.when(F.col("doc_id") % 4 == 1, F.lit("other")).otherwise(F.concat(F.col("text"), F.lit("  ")))).alias("content_hash"))
    return B.changed_only(old, t, "doc_id", "text").select("doc_id", "content_hash")


def _store(spark, rows, key) -> Store:
    return Store(spark, shared_folder(spark), ", ".join(f"{n} {t}" for n, t in rows.dtypes), key)


def s10_store_upsert(spark, d):
    """A store after a batch, a second that updates and adds, and that again."""
    old, new = _halves(spark, d)
    store = _store(spark, old, ["c_custkey"])
    store.upsert("old", old)
    store.upsert("new", new)
    store.upsert("new", new)
    return store.read()


def s11_store_insert(spark, d):
    """A store after a batch and another whose known keys are ignored."""
    old, new = _halves(spark, d)
    store = _store(spark, old, ["c_custkey"])
    store.insert("old", old)
    store.insert("new", new.union(new))
    return store.read()


def s12_store_changed(spark, d):
    """Lengths of the texts in a store after two batches, of which the second writes new keys and texts that differ by more than white space."""
    t = table(spark, d, "documents").select("doc_id", "text", X.content_hash(F.col("text")).alias("content_hash"))
    old = t.where("doc_id % 4 > 0").withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.lit("other")).otherwise(F.concat(F.col("text"), F.lit("  "))))
    store = _store(spark, t, ["doc_id"])
    store.upsert_changed("old", old.drop("content_hash"), "text")
    store.upsert_changed("new", t.drop("content_hash"), "text")
    return store.read().select("doc_id", F.length("text").alias("n"))


def s13_resume(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source")
    return B.resume(t, t.where("doc_id % 5 < 3"), ["doc_id"])


def _articles(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("category"), "text", (F.col("n_chars") % 100 / 10).alias("quality"))


def f12_validity(spark, d):
    a = _articles(spark, d)
    v = B.validity(a, F.col("id") % 6 > 0, F.col("id") % 4 > 0, X.language_class(F.col("text")))
    return v.select("id", "valid", "notes")


def f10_keyword_hits(spark, d):
    h = B.hits(F.lower("text"), ["idiot", "license", "the", "nicht"])
    return _articles(spark, d).select("id", F.array_join(h, ",").alias("hits")).where("hits <> ''")


def _keywords(spark, d):
    """The distinct words of eight letters or more of the benchmark."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s.,]{8,})"), F.lit(1)))
    return table(spark, d, "benchmark").select(w.alias("keyword")).distinct()


def f10_many_keywords(spark, d):
    """How many of many keywords the text of every document contains, and the first and last of them."""
    h = K.keyword_hits(_articles(spark, d).select("id", F.lower("text").alias("text")), _keywords(spark, d))
    return h.select("id", F.size("hits").alias("n_hits"), F.array_min("hits").alias("first"), F.array_max("hits").alias("last"))


def f9_date_window(spark, d):
    e = table(spark, d, "events")
    return e.where(F.to_date("ts").between(F.date_sub(F.lit("2024-01-20").cast("date"), 7), F.lit("2024-01-20").cast("date"))).groupBy("event_type").agg(F.count("*").alias("n"))


def a31_stage_counters(spark, d):
    a = _articles(spark, d)
    reason = F.when(F.col("quality") < 2, "low score").when(F.col("id") % 9 == 0, "skipped")
    return B.stage_counters(a.withColumn("drop_reason", reason))


def w12_quota_top(spark, d):
    quotas = spark.createDataFrame([("en", 20), ("fr", 5)], "category string, quota int")
    return B.quota_top(_articles(spark, d), quotas, 60).select("id", "category", "quality")


def d47_best_of_group(spark, d):
    """The best page of every group of pages whose titles are alike; pages without such a group stand alone."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.length("html") % 100 / 10).alias("quality"))
    grouped = pages.join(B.title_groups(_titles(spark, d)).withColumnRenamed("group", "grp"), "id")
    return B.best_of_group(grouped, "grp").select("id", "grp", "quality")


def t8_scored_or_filled(spark, d):
    a = _articles(spark, d)
    scores = a.where("quality >= 9.7").select("id", F.col("quality").alias("score"))
    return B.scored_or_filled(a.select("id", F.col("id").alias("place")), scores, 50).select("id", "score")


def d50_longer_content(spark, d):
    """Whole texts as contents; bodies are the plain texts of the pages of the same number."""
    a = _articles(spark, d).select("id", F.col("text").alias("content"), F.lit("").alias("summary"))
    body = table(spark, d, "pages").select(F.col("page_id").alias("id"), X.html_plain(F.col("html")).alias("body"))
    return B.longer_content(a, body).select("id", F.length("content").alias("n"), "summary")


def _titles(spark, d):
    """The whole titles of all pages."""
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), X.normal_title(X.html_title(F.col("html"))).alias("norm"))


def d45_same_titles(spark, d):
    return B.same_titles(_titles(spark, d))


def d46_article_stages(spark, d):
    """Clean, tag (by a scorer), select: the whole chain over documents as articles."""
    a = _articles(spark, d)
    clean = B.validity(a, F.lit(True), F.col("id") % 4 > 0, X.language_class(F.col("text"))).where("valid")
    scored = clean.join(_answers(spark, d).withColumnRenamed("doc_id", "id"), "id").withColumn("score", X.checked_score(F.col("answer")))
    kept = B.relevance_gate(scored, 6.0)
    return B.quota_top(kept, spark.createDataFrame([("en", 30)], "category string, quota int"), 50).select("id", "category", "quality", "score")


def d46_insights(spark, d):
    """Stage tables of selected articles and of insights by a plain stand-in for a model; the insight stage runs twice."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    chosen = d46_article_stages(spark, d).join(texts, "id")
    selected = _store(spark, chosen, ["id"])
    selected.upsert("first", chosen)

    def scorer(row):
        n = len(row["text"])
        if n % 7 == 0:
            raise ValueError("no answer")
        return {"thoughts": f"{row['category']} {n}"}

    found = Store(spark, shared_folder(spark), "id long, category string, thoughts string, llm_model string", ["id"])
    B.insights(selected.read(), found, "first", scorer, "thoughts string", ["en", "de"], model="stub")
    return B.insights(selected.read(), found, "second", scorer, "thoughts string", ["en", "de"], model="stub")


def d48_relevance_gate(spark, d):
    s = _answers(spark, d).select("doc_id", X.checked_score(F.col("answer")).alias("score"))
    return B.relevance_gate(s, 6.0)


def d37_batch_labelling(spark, d):
    """Each row scored by a plain stand-in for a model, errors told in the row."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")

    def scorer(row):
        n = len(row["text"] or "")
        if n % 10 == 0:
            raise ValueError("no answer")
        return {"label": "long" if n > 200 else "short", "score": round(n / 100, 2)}

    return B.score_rows(rows, scorer, "label string, score double", model="stub").select("conv_id", "turn", "label", "score", "prediction_status", "error_message", "llm_model")


# ── metrics ────────────────────────────────────────────────────────────────


def _fact(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.to_date("l_shipdate").alias("day"), F.to_date("o_orderdate").alias("req_day"), F.col("o_orderpriority").alias("channel"), F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice", "l_discount")


_MEASURES = {"impressions": "l_quantity", "cost": "l_extendedprice"}


def d40_event_time_metrics(spark, d):
    q = M.metric_query(_fact(spark, d), {n: F.col(c) for n, c in _MEASURES.items()}, {"cpi": ("cost", "impressions")}, ["week", "channel"], "2000-01-01", "2000-06-30", F.col("flag") != "R")
    return q.select(F.col("date").cast("string").alias("date"), "channel", F.round("impressions", 2).alias("impressions"), F.round("cost", 2).alias("cost"), F.round("cpi", 2).alias("cpi"))


def d40_request_time_metrics(spark, d):
    q = M.metric_query(_fact(spark, d), {n: F.col(c) for n, c in _MEASURES.items()}, {}, ["channel"], "2000-01-01", "2000-03-31", mode="request")
    return q.select(F.col("req_day").cast("string").alias("req_day"), "channel", F.round("impressions", 2).alias("impressions"), F.round("cost", 2).alias("cost"))


def a29_ratio_metrics(spark, d):
    clicks = ads(spark, d)
    q = M.metric_query(clicks, {"imp": F.col("imp"), "click": F.col("click"), "conv": F.col("conv")}, {"ctr": ("click", "imp"), "cvr": ("conv", "click")}, ["month", "app"], "1999-01-01", "2000-12-31")
    return q.withColumn("date", F.col("date").cast("string"))


def t5_truncated(spark, d):
    return M.truncated(a29_ratio_metrics(spark, d).select("date", "app", "imp"), 100, [F.desc("imp"), F.col("date"), F.col("app")])


_CATALOG = [("5-LOW", "low", "minor"), ("1-URGENT", "urgent", "now"), ("2-HIGH", "high", "soon")]


def d41_resolve_names(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "minor").when(F.col("o_orderkey") % 5 == 1, "Very Urgent!").when(F.col("o_orderkey") % 5 == 2, "unknown").otherwise(F.col("o_orderpriority")).alias("value"))
    return M.resolve_names(o, spark.createDataFrame(_CATALOG, "code string, name string, alias string"))


def d41_suggestions(spark, d):
    """For the name of every part the three names of types that share most pairs of letters with it."""
    p = table(spark, d, "part")
    types = p.select(F.col("p_type").alias("code"), F.col("p_type").alias("name")).distinct()
    return K.suggestions(p.select(F.col("p_name").alias("value")), types)


def d42_value_search(spark, d):
    """Names of the parts whose key is divisible by 100, among the values of all parts."""
    q = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    values = table(spark, d, "part").select(F.col("p_name").alias("value"), F.col("p_type").alias("value_desc")).distinct()
    return M.value_search(q, values, 3)


def t6_vector_search(spark, d):
    """Vectors whose id is divisible by 100, among all vectors."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.concat(F.lit("l"), "label").alias("query"))
    c = e.select(F.concat(F.lit("v"), "vec_id").alias("value"), F.concat(F.lit("l"), "label").alias("value_desc"), F.col("embedding").alias("vector"))
    return M.value_search(q, c, 3, vectors=True)


_SCENARIOS = [("no delivery", ["nothing delivered", "zero volume"]), ("the cost is high", ["expensive"]), ("the and of", ["in to"])]


def d43_scenario_tags(spark, d):
    """The scenario of every turn by its whole text."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return M.scenario_tags(t, spark.createDataFrame(_SCENARIOS, "scenario string, names array<string>"), key=["conv_id", "turn"])


QUERIES = {f.__name__: f for f in (p1_tag_columns, p2_tag_map, p3_behaviour_keys, p4_event_times, p5_conversion_inferred, p9_payloads, p13_canonical_urls, p14_url_ids, p15_domains, p16_content_hash, p17_language, p18_publish_dates, p19_html_dates, p20_html_fields, p22_feed_summaries, p23_short_summaries, p24_normal_titles, p25_prompts, p26_scorer_checks, p27_quality_totals, d44_article_links, x4_listing_links, w11_first_links, s10_upsert, s10_store_upsert, s11_store_insert, s12_store_changed, s11_insert_or_ignore, s12_changed_only, s13_resume, f12_validity, f10_keyword_hits, f10_many_keywords, f9_date_window, a31_stage_counters, w12_quota_top, d47_best_of_group, t8_scored_or_filled, d50_longer_content, d45_same_titles, d46_article_stages, d46_insights, d48_relevance_gate, d37_batch_labelling, d40_event_time_metrics, d40_request_time_metrics, a29_ratio_metrics, t5_truncated, d41_resolve_names, d41_suggestions, d42_value_search, t6_vector_search, d43_scenario_tags)}

_FOLD = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_U = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', {})"
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<!--.*?-->', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?is)<head\\b.*?</head>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_KEEP = "array_to_string(list_filter(string_split(" + _U.format(4) + ", '&'), lambda p: p <> '' AND NOT {}), '&')"
_PATH = "CASE WHEN " + _U.format(3) + " = '/' THEN '/' ELSE regexp_replace(" + _U.format(3) + ", '/+$', '') END"
_CANON = "'https://' || " + _U.format(2) + " || " + _PATH + " || CASE WHEN " + _KEEP.format("lower(split_part(p, '=', 1)) IN (" + ", ".join(f"'{t}'" for t in X.TRACKING) + ")") + " <> '' THEN '?' || " + _KEEP.format("lower(split_part(p, '=', 1)) IN (" + ", ".join(f"'{t}'" for t in X.TRACKING) + ")") + " ELSE '' END"
_KEPT = _U.format(1) + " || '://' || lower(" + _U.format(2) + ") || " + _PATH + " || CASE WHEN " + _KEEP.format("starts_with(lower(split_part(p, '=', 1)), 'utm_')") + " <> '' THEN '?' || " + _KEEP.format("starts_with(lower(split_part(p, '=', 1)), 'utm_')") + " ELSE '' END"
_LANG = "CASE WHEN length(COALESCE(text, '')) = 0 THEN 'other' WHEN (length(substr(text, 1, 2000)) - length(regexp_replace(substr(text, 1, 2000), '[一-鿿]', '', 'g'))) / length(substr(text, 1, 2000)) > 0.05 THEN 'zh' WHEN (length(substr(text, 1, 2000)) - length(regexp_replace(substr(text, 1, 2000), '[a-zA-Z]', '', 'g'))) / length(substr(text, 1, 2000)) > 0.30 THEN 'en' ELSE 'other' END"
_ART = "a AS (SELECT doc_id AS id, source, lang AS category, text, n_chars % 100 / 10 AS quality FROM documents)"
_FACT = "fact AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS req_day, o_orderpriority AS channel, l_returnflag AS flag, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _short(text):
    """SQL of a summary of at most 300 characters."""
    s = "COALESCE(" + _FOLD.format(text) + ", '')"
    cut = f"substr({s}, 1, 300)"
    space = f"(length({cut}) - length(regexp_extract({cut}, '[^ ]*$')) - 1)"
    back = f"rtrim(CASE WHEN NOT regexp_matches(substr({cut}, 300, 1), '[　-〿㐀-䶿一-鿿豈-﫿＀-￯]') AND {space} >= 270 THEN substr({cut}, 1, {space}) ELSE {cut} END)"
    return f"CASE WHEN length({s}) <= 300 THEN {s} WHEN regexp_matches({back}, '(\\.\\.\\.|…)\\s*$') THEN {back} ELSE {back} || '…' END"


def _part(url, n):
    """SQL of a part of a URL: 1 scheme, 2 host, 3 path, 4 query."""
    return _U.format(n).replace("(url,", f"({url},", 1)


def _domain(url):
    p = f"string_split(lower({_part(url, 2)}), '.')"
    return f"array_to_string(CASE WHEN len({p}) >= 3 AND length(({p})[-2]) <= 3 THEN ({p})[-3:] WHEN len({p}) >= 2 THEN ({p})[-2:] ELSE {p} END, '.')"


_WEB = f"CASE WHEN lower({_part('url', 1)}) IN ('http', 'https') THEN {_CANON} END"
_ROOT = f"{_part('page', 1)} || '://' || {_part('page', 2)}"
_FOLDER = f"regexp_extract({_part('page', 3)}, '^(.*/)[^/]*$', 1)"
def _links(pages: str = "pages") -> str:
    """SQL of every link of every page, resolved (one step up at most) and canonical; the first place of each link of a page."""
    return rf"""hr AS (SELECT page_id, url AS page, {_WEB} AS own, regexp_extract_all(html, '(?i)<a[\s/](?:[^<>]*?[\s"''/])?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''<>]+)', 1) AS hs FROM {pages}),
h AS (SELECT page_id, page, own, trim(replace(trim(unnest(hs), '"'''), '&amp;', '&')) AS h, unnest(range(len(hs))) AS place FROM hr),
ab AS (SELECT page_id, page, own, place, CASE WHEN h = '' OR regexp_matches(h, '^(#|javascript:|mailto:|tel:)') THEN NULL WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN {_part('page', 1)} || ':' || h WHEN starts_with(h, '/') THEN {_ROOT} || h WHEN starts_with(h, '?') THEN {_ROOT} || {_part('page', 3)} || h ELSE {_ROOT} || CASE WHEN {_FOLDER} = '' THEN '/' ELSE {_FOLDER} END || h END AS raw FROM h),
up AS (SELECT * EXCLUDE raw, regexp_replace(raw, '(://[^/]+/(?:[^?#]*/)?)[^/?#]+/\.\./', '\1') AS url FROM ab),
fl AS (SELECT page_id, ANY_VALUE(page) AS page, ANY_VALUE(own) AS own, MIN(place) AS place, link FROM (SELECT *, {_WEB} AS link FROM up) WHERE link IS NOT NULL GROUP BY page_id, link)"""


_SEGMENTS = f"list_filter(string_split({_part('link', 3)}, '/'), lambda x: x <> '')"
_OUTSIDE = ", ".join(f"'{x}'" for x in X.OUTSIDE)
_PAGING = ", ".join(f"'{x}'" for x in X.PAGING)
_SCORED = f"""pt AS (SELECT *, {_part('link', 3)} AS path, {_domain('link')} AS dom, {_domain('page')} AS home, {_SEGMENTS} AS seg, list_transform(string_split({_part('link', 4)}, '&'), lambda x: lower(split_part(x, '=', 1))) AS ks FROM fl),
sc AS (SELECT page_id, link, place, CASE WHEN dom <> home AND dom IN ({_OUTSIDE}) OR link = own OR regexp_matches(path, '{X.FILES}') OR regexp_matches(path, '{X.NOT_ARTICLES}') THEN -10 ELSE
CASE WHEN dom = home THEN 1 ELSE 0 END + CASE WHEN len(seg) < 1 THEN -5 WHEN len(seg) = 1 THEN -2 WHEN len(seg) = 2 THEN 1 ELSE 2 END + CASE WHEN regexp_matches(path, '/\\d{{5,}}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(path, '{X.ARTICLES}') THEN 2 ELSE 0 END
+ CASE WHEN contains(COALESCE(seg[-1], ''), '-') AND length(seg[-1]) > 10 THEN 1 ELSE 0 END + CASE WHEN list_has_any(ks, [{_PAGING}]) THEN -3 ELSE 0 END END AS score FROM pt)"""
_DATE = r"((?:19|20)\d{2}[-/年.]\d{1,2}[-/月.]\d{1,2})"


def _day(text):
    return f"TRY_CAST(regexp_replace({text}, '[/年月.]', '-', 'g') AS DATE)"


#: A page's date: meta, JSON-LD, URL, the first 400 characters of its text.
_HTML_DATE = "COALESCE(" + ", ".join(
    [
        _day(f"""regexp_extract(html, '(?is)<meta[^>]+(?:published_time|pubdate|publishdate|date)["''][^>]+content=["'']{_DATE}', 1)"""),
        _day(f"""regexp_extract(html, '(?is)"datePublished"\\s*:\\s*"{_DATE}', 1)"""),
        _day(f"regexp_extract(url, '/{_DATE}', 1)"),
        f"list_filter(list_transform(regexp_extract_all(substr(plain, 1, 400), '(?:^|\\D){_DATE}(?:\\D|$)', 1), lambda x: {_day('x')}), lambda x: x IS NOT NULL)[1]",
    ]
) + ")"
_BRANDED = (1, 3, 4, 5, 6, 8, 9, 10, 13)

ORACLE = {
    "p1_tag_columns": "SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, 'http://x' AS url FROM customer",
    "p2_tag_map": "SELECT c_custkey, 4 AS n, 'name,nation,seg,url' AS keys, 'seg:' || c_mktsegment || '#nation:' || c_nationkey || '#url:http://x#odd#name:' || c_name AS tag FROM customer",
    "p3_behaviour_keys": "SELECT event_id, CASE event_id % 18 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END AS event_type, CASE WHEN event_id % 18 IN (" + ", ".join(map(str, _BRANDED)) + ") THEN 'b' || (event_id % 10) WHEN event_id % 18 = 7 THEN '无明确品牌' END AS brand, CASE event_id % 18 WHEN 0 THEN '官网' WHEN 1 THEN '三车垂媒' END AS channel, CASE WHEN event_id % 18 IN (4, 5, 12) THEN 'm' || (event_id % 10) END AS model FROM events",
    "p4_event_times": "SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('hour', CAST(ts AS TIMESTAMP)) WHEN 3 THEN NULL ELSE date_trunc('second', CAST(ts AS TIMESTAMP)) END, '%Y-%m-%d %H:%M:%S') AS t FROM events",
    "p5_conversion_inferred": "SELECT user_id, MAX(CAST(event_type = 'purchase' AS INT)) AS is_converted FROM events GROUP BY 1",
    "p9_payloads": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b, c_mktsegment AS c, CAST(NULL AS VARCHAR) AS missing, c_name AS name, c_name AS app FROM customer",
    "p13_canonical_urls": f"SELECT page_id, {_CANON} AS url FROM pages",
    "p14_url_ids": f"SELECT page_id, {_KEPT} AS url, substr(sha256({_KEPT}), 1, 16) AS id FROM pages",
    "p15_domains": f"WITH h AS (SELECT page_id, lower({_U.format(2)}) AS h, string_split(lower({_U.format(2)}), '.') AS p FROM pages) SELECT page_id, array_to_string(CASE WHEN len(p) >= 3 AND length(p[-2]) <= 3 THEN p[-3:] WHEN len(p) >= 2 THEN p[-2:] ELSE p END, '.') AS domain, regexp_replace(h, '^www\\.', '') AS host FROM h",
    "p16_content_hash": f"SELECT doc_id, sha256({_FOLD.format('text')}) AS hash FROM documents",
    "p17_language": f"SELECT doc_id, {_LANG} AS language FROM documents",
    "p18_publish_dates": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-01-20' WHEN 2 THEN '2023-11-05' WHEN 3 THEN '2023-12-30' END AS date, CASE page_id % 4 WHEN 0 THEN 'field' WHEN 2 THEN 'url_path' WHEN 3 THEN 'content_regex' ELSE 'none' END AS source, page_id % 4 = 0 AS within FROM pages",
    "p19_html_dates": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-01-02' WHEN 1 THEN '2023-05-06' WHEN 2 THEN '2022-03-04' END AS date, CASE page_id % 4 WHEN 0 THEN 'meta' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'url' ELSE 'none' END AS source FROM pages",
    "p20_html_fields": f"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<meta[^>]+name=[\"'']description[\"''][^>]+content=[\"'']([^\"'']*)', 1), '\\s+', ' ', 'g')) AS description, length({_PLAIN}) AS n_plain FROM pages",
    "p22_feed_summaries": f"""WITH p AS (SELECT *, {_PLAIN} AS plain FROM pages), e AS (SELECT page_id, substr(plain, 1, 500) AS summary, length(plain) AS n_content, len(regexp_extract_all(html, '(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*["'']([^"'']+)["'']', 1)) AS n_images, {_HTML_DATE} AS date FROM p) SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM e WHERE date IS NULL OR date >= DATE '2024-01-01'""",
    "x4_listing_links": "WITH listing AS (SELECT page_id, url, COALESCE('<a class=more href=' || replace(next, '&', '&amp;') || '&amp;utm_source=n>', '') || '<a href=\"../news/story-of-page/' || (page_id + 10000) || '\">' AS html FROM pages LEFT JOIN (SELECT page_id - 1 AS page_id, url AS next FROM pages) USING (page_id)), "
    + _links("listing")
    + f", {_SCORED}, rk AS (SELECT page_id, link, score, CAST(ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY score DESC, place) AS INT) AS rank FROM sc WHERE score >= 2 AND regexp_matches(link, '^https://[^/]+/[^/]+/')) SELECT * FROM rk WHERE rank <= 20",
    "w11_first_links": f"WITH {_links()} SELECT page_id, CAST(place AS INT) AS place, link FROM fl",
    "d44_article_links": f"WITH {_links()}, {_SCORED}, rk AS (SELECT page_id, link, score, CAST(ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY score DESC, place) AS INT) AS rank FROM sc WHERE score >= -1) SELECT * FROM rk WHERE rank <= 20",
    "p23_short_summaries": f"SELECT doc_id, {_short('text')} AS summary FROM documents",
    "d50_longer_content": f"WITH b AS (SELECT page_id, {_PLAIN} AS body FROM pages), j AS (SELECT doc_id AS id, CASE WHEN length(COALESCE(text, '')) < 200 AND length(body) > length(COALESCE(text, '')) THEN body ELSE text END AS c FROM documents LEFT JOIN b ON page_id = doc_id) SELECT id, length(c) AS n, {_short('c')} AS summary FROM j",
    "p25_prompts": "SELECT c_custkey, 'Rate ' || c_name || ' of ' || c_mktsegment || ' (' || c_nationkey || ').' AS prompt FROM customer",
    "p26_scorer_checks": "SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 'bad insight_type' WHEN length(text) % 11 = 0 THEN 'no thoughts' WHEN length(text) % 7 < 2 THEN 'fewer than 3 tags' END AS error, CASE WHEN length(text) % 5 > 0 AND length(text) % 11 > 0 AND length(text) % 7 >= 2 THEN array_to_string(list_transform(range(1, CAST(LEAST(length(text) % 7 + 2, 7) AS INT)), lambda i: 't' || i), ',') END AS tags, CASE WHEN length(text) % 13 <= 10 THEN CAST(length(text) % 13 AS DOUBLE) END AS score FROM documents",
    "p27_quality_totals": "SELECT doc_id, CASE WHEN length(text) % 9 = 0 THEN NULL WHEN length(text) % 3 = 0 AND length(text) % 14 <= 10 THEN CAST(length(text) % 14 AS DOUBLE) ELSE ROUND((length(text) % 10) * 0.2::DOUBLE + 1 * 0.1::DOUBLE + 2 * 0.4::DOUBLE + 3 * 0.15::DOUBLE + 4 * 0.1::DOUBLE + 5 * 0.05::DOUBLE, 1) END AS total FROM documents",
    "s10_upsert": "SELECT c_custkey, c_mktsegment, ROUND(c_acctbal, 2) + CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS bal FROM customer",
    "s10_store_upsert": "SELECT c_custkey, c_mktsegment, ROUND(c_acctbal, 2) + CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS bal FROM customer",
    "s11_store_insert": "SELECT c_custkey, c_mktsegment, ROUND(c_acctbal, 2) + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS bal FROM customer",
    "s12_store_changed": "SELECT doc_id, CAST(length(text) + CASE WHEN doc_id % 4 > 1 THEN 2 ELSE 0 END AS INT) AS n FROM documents",
    "s11_insert_or_ignore": "SELECT c_custkey, c_mktsegment, ROUND(c_acctbal, 2) + 1 AS bal FROM customer WHERE c_custkey % 3 = 0",
    "s12_changed_only": f"SELECT doc_id, sha256({_FOLD.format('text')}) AS content_hash FROM documents WHERE doc_id % 4 < 2",
    "s13_resume": "SELECT doc_id, source FROM documents WHERE doc_id % 5 >= 3",
    "f12_validity": f"WITH {_ART}, n AS (SELECT id, concat_ws('; ', CASE WHEN id % 6 = 0 THEN 'not accessible' END, CASE WHEN id % 4 = 0 THEN 'outside window' END, CASE WHEN {_LANG} NOT IN ('zh', 'en') THEN 'language ' || {_LANG} END) AS notes FROM a) SELECT id, notes = '' AS valid, notes FROM n",
    "f10_keyword_hits": f"WITH {_ART} SELECT * FROM (SELECT id, array_to_string(list_filter(['idiot', 'license', 'the', 'nicht'], lambda k: contains(lower(text), k)), ',') AS hits FROM a) WHERE hits <> ''",
    "f10_many_keywords": r"WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\s.,]{8,}')) AS k FROM benchmark), h AS (SELECT doc_id AS id, k FROM documents JOIN k ON contains(lower(text), k)) SELECT doc_id AS id, CAST(COUNT(k) AS INTEGER) AS n_hits, MIN(k) AS first, MAX(k) AS last FROM documents LEFT JOIN h ON id = doc_id GROUP BY doc_id",
    "f9_date_window": "SELECT event_type, COUNT(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' GROUP BY 1",
    "a31_stage_counters": f"WITH {_ART} SELECT CASE WHEN quality < 2 THEN 'low score' WHEN id % 9 = 0 THEN 'skipped' ELSE 'kept' END AS reason, COUNT(*) AS n FROM a GROUP BY 1",
    "w12_quota_top": f"WITH {_ART} SELECT id, category, quality FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY quality DESC, id) AS r FROM a) WHERE r <= CASE category WHEN 'en' THEN 20 WHEN 'fr' THEN 5 ELSE 1000000000 END ORDER BY quality DESC, id LIMIT 60",
    "t8_scored_or_filled": f"WITH {_ART} SELECT id, CASE WHEN quality >= 9.7 THEN quality END AS score FROM a ORDER BY score DESC NULLS LAST, id LIMIT 50",
    "d43_scenario_tags": r"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(COALESCE(text, '')), '[\s()（）_—,，。！？!?:：;''"“”‘’/\\-]+', '', 'g') AS t FROM conversations), n(scenario, n, how) AS (VALUES ('no delivery', 'nodelivery', 1), ('no delivery', 'nothingdelivered', 2), ('no delivery', 'zerovolume', 2), ('the cost is high', 'thecostishigh', 1), ('the cost is high', 'expensive', 2), ('the and of', 'theandof', 1), ('the and of', 'into', 2)), s AS (SELECT DISTINCT t, scenario, how, ROUND(CASE WHEN t = '' THEN 0 WHEN t = n THEN 1 WHEN contains(t, n) OR contains(n, t) THEN least(length(t), length(n)) / greatest(length(t), length(n)) ELSE 1 - levenshtein(t, n) / greatest(length(t), length(n)) END, 6) AS score FROM t, n), b AS (SELECT t, arg_min((scenario, CASE WHEN score = 1 THEN how ELSE 3 END, score), (CASE WHEN score = 1 THEN how ELSE 3 END, -score, scenario)) AS m FROM s WHERE score >= 0.45 GROUP BY t) SELECT conv_id, turn, m[1] AS scenario, CASE m[2] WHEN 1 THEN 'exact' WHEN 2 THEN 'alias' WHEN 3 THEN 'fuzzy' ELSE 'none' END AS "match", m[3] AS score FROM t LEFT JOIN b USING (t)""",
    "d46_article_stages": f"WITH {_ART}, v AS (SELECT id, category, quality, CAST(length(text) % 13 AS DOUBLE) AS score FROM a WHERE id % 4 > 0 AND {_LANG} IN ('zh', 'en') AND length(text) % 13 BETWEEN 6 AND 10) SELECT id, category, quality, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY quality DESC, id) AS r FROM v) WHERE r <= CASE category WHEN 'en' THEN 30 ELSE 1000000000 END ORDER BY quality DESC, id LIMIT 50",
    "d48_relevance_gate": "SELECT doc_id, CAST(length(text) % 13 AS DOUBLE) AS score FROM documents WHERE length(text) % 13 BETWEEN 6 AND 10",
    "d37_batch_labelling": "SELECT conv_id, turn, CASE WHEN length(text) % 10 = 0 THEN NULL WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS label, CASE WHEN length(text) % 10 > 0 THEN ROUND(length(text) / 100, 2) END AS score, CASE WHEN length(text) % 10 = 0 THEN 'failed' ELSE 'success' END AS prediction_status, CASE WHEN length(text) % 10 = 0 THEN 'no answer' END AS error_message, 'stub' AS llm_model FROM conversations",
    "d40_event_time_metrics": f"WITH {_FACT} SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS date, channel, ROUND(SUM(l_quantity), 2) AS impressions, ROUND(SUM(l_extendedprice), 2) AS cost, ROUND(SUM(l_extendedprice) / SUM(l_quantity), 2) AS cpi FROM fact WHERE day BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' AND flag <> 'R' GROUP BY 1, 2",
    "d40_request_time_metrics": f"WITH {_FACT} SELECT CAST(req_day AS VARCHAR) AS req_day, channel, ROUND(SUM(l_quantity), 2) AS impressions, ROUND(SUM(l_extendedprice), 2) AS cost FROM fact WHERE day BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' + 90 AND req_day BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' GROUP BY 1, 2",
    "a29_ratio_metrics": f"WITH {ADS_SQL} SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS date, app, CAST(SUM(imp) AS BIGINT) AS imp, CAST(SUM(click) AS BIGINT) AS click, CAST(SUM(conv) AS BIGINT) AS conv, ROUND(SUM(click) / NULLIF(SUM(imp), 0), 6) AS ctr, ROUND(SUM(conv) / NULLIF(SUM(click), 0), 6) AS cvr FROM ads WHERE day BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1, 2",
    "t5_truncated": f"WITH {ADS_SQL}, g AS (SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS date, app, CAST(SUM(imp) AS BIGINT) AS imp FROM ads WHERE day BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1, 2) SELECT *, (SELECT COUNT(*) FROM g) AS total FROM g ORDER BY imp DESC, date, app LIMIT 100",
    "d41_resolve_names": "WITH v AS (SELECT DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 'minor' WHEN 1 THEN 'Very Urgent!' WHEN 2 THEN 'unknown' ELSE o_orderpriority END AS value FROM orders) SELECT value, CASE WHEN value IN ('minor', '5-LOW') THEN '5-LOW' WHEN value IN ('Very Urgent!', '1-URGENT') THEN '1-URGENT' WHEN value = '2-HIGH' THEN '2-HIGH' END AS code, CASE WHEN value IN ('5-LOW', '1-URGENT', '2-HIGH') THEN 1 WHEN value = 'minor' THEN 2 WHEN value = 'Very Urgent!' THEN 3 END AS how FROM v",
    "d41_suggestions": "WITH g AS (SELECT s, list_distinct(list_transform(range(1, greatest(1, length(s) - 1) + 1), lambda i: substr(lower(s), i, 2))) AS g FROM (SELECT p_name AS s FROM part UNION SELECT p_type FROM part)), v AS (SELECT DISTINCT p_name AS value, g FROM part JOIN g ON s = p_name), c AS (SELECT DISTINCT p_type AS code, g FROM part JOIN g ON s = p_type), m AS (SELECT value, code, ROUND(2 * len(list_intersect(v.g, c.g)) / (len(v.g) + len(c.g)), 4) AS similarity FROM v, c) SELECT value, code, similarity, ROW_NUMBER() OVER (PARTITION BY value ORDER BY similarity DESC, code) AS rank FROM m WHERE similarity > 0 QUALIFY rank <= 3",
    "d42_value_search": r"WITH c AS (SELECT DISTINCT p_name AS value, p_type AS value_desc FROM part ), ct AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(value || ' ' || value_desc), '[\s,，;；/_-]+'), lambda t: t <> '')) AS t FROM c), q AS (SELECT p_partkey AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[\s,，;；/_-]+'), lambda t: t <> '')) AS qs FROM part WHERE p_partkey % 100 = 0), s AS (SELECT query_id, value, value_desc, ROUND(len(list_filter(qs, lambda x: len(list_filter(t, lambda y: contains(y, x) OR contains(x, y))) > 0)) / len(qs), 4) AS similarity FROM q, ct), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, value) AS rank FROM s) SELECT query_id, value, similarity, rank, rank = 1 AND similarity >= 0.5 AS fixed FROM r WHERE rank <= 3",
    "t6_vector_search": "WITH c AS (SELECT 'v' || vec_id AS value, 'l' || label AS l, embedding AS v FROM embeddings), s AS (SELECT vec_id AS query_id, value, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) * 0.7::DOUBLE + CASE WHEN contains(l, 'l' || label) OR contains('l' || label, l) THEN 0.3::DOUBLE ELSE 0 END, 4) AS similarity FROM embeddings, c WHERE vec_id % 100 = 0), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, value) AS rank FROM s) SELECT query_id, value, similarity, rank, rank = 1 AND similarity >= 0.5 AS fixed FROM r WHERE rank <= 3",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
ORACLE["d46_insights"] = f"SELECT s.id, s.category, s.category || ' ' || length(text) AS thoughts, 'stub' AS llm_model FROM ({ORACLE['d46_article_stages']}) s JOIN documents ON doc_id = s.id WHERE s.category IN ('en', 'de') AND length(text) % 7 > 0"
