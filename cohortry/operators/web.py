"""Article jobs: links, validity, incremental stores, near-equal titles, selection, scorer passes."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import Store
from .groups import components, kept_first, stored


#: The opening tag of an anchor, and its address in it: in quotes of either kind or in none.
ANCHOR = r"(?i)<a[\s/][^<>]*"
HREF = r"""(?i)[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""


def page_links(pages: DataFrame, id_col: str = "page_id", selector: str | None = None) -> DataFrame:
    """``(id, url, place, link)``: every link of every page, canonical, in order.

    ``selector``: a pattern that an anchor's opening tag must match (its class or another attribute); places count such anchors.
    Entities in addresses are decoded.  Pages without html have no links.
    """
    anchors = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    anchors = F.filter(anchors, lambda a: a.rlike(HREF) & (a.rlike(selector) if selector else F.lit(True)))
    raw = pages.select(id_col, "url", F.posexplode(anchors).alias("place", "anchor"))
    href = X.unescaped(F.regexp_replace(F.regexp_extract("anchor", HREF, 1), """^["']|["']$""", ""))
    absolute = raw.select(id_col, "url", "place", X.resolved(F.col("url"), href).alias("absolute"))
    return absolute.select(id_col, "url", "place", X.canonical_url(F.col("absolute")).alias("link")).where("link is not null")


def keep_first(frame: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return frame.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def article_links(pages: DataFrame, top: int = 20, least: int = 2, id_col: str = "page_id", selector: str | None = None, pattern: str | None = None) -> DataFrame:
    """The best-scored links of each page (first of equals kept, ties by place).

    ``pattern``: what a canonical link must match before it is scored; ``selector``: as in ``page_links``.
    """
    found = page_links(pages, id_col, selector)
    found = found.where(F.col("link").rlike(pattern)) if pattern else found
    first = keep_first(found, [id_col, "link"], [F.col("place")])
    scored = first.withColumn("score", X.link_score(F.col("link"), F.col("url"))).where(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("score"), "place")))
    return ranked.where(F.col("rank") <= top).select(id_col, "link", "score", "rank")


# ── stores ─────────────────────────────────────────────────────────────────


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``existing`` that aren't updated, and all of ``incoming``."""
    return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """New rows only: one for each key that ``existing`` lacks."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def changed_only(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Incoming rows that are new or whose content hash differs from the stored one; ``existing`` has ``content_hash``."""
    h = incoming.withColumn("content_hash", X.content_hash(F.col(content)))
    old = existing.select(F.col(key), F.col("content_hash").alias("_old"))
    return h.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))).drop("_old")


def resume(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no output yet; repeated input keys raise ValueError."""
    twice = rows.groupBy(*key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"repeated keys, for instance {[tuple(r)[:-1] for r in twice]}")
    return rows.join(done.select(*key), key, "left_anti")


# ── validity and selection ─────────────────────────────────────────────────


def validity(articles: DataFrame, accessible: Column, in_window: Column, language: Column) -> DataFrame:
    """``articles`` with ``valid`` and the reasons against, joined by semicolons."""
    notes = F.concat_ws("; ", F.when(~accessible, "not accessible"), F.when(~in_window, "outside window"), F.when(~language.isin("zh", "en"), F.concat(F.lit("language "), language)))
    return articles.withColumn("notes", notes).withColumn("valid", F.col("notes") == "")


def hits(text: Column, keywords: list[str]) -> Column:
    """Keywords that a text contains."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: text.contains(k))


def stage_counters(frame: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Rows by drop reason, and those kept."""
    return frame.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def quota_top(frame: DataFrame, quotas: DataFrame, top: int, category: str = "category", score: str = "quality", key: str = "id") -> DataFrame:
    """At most a category's quota of its best rows (no quota: all), then the best ``top`` of all."""
    # No category gives more than ``top`` rows: with that fixed limit each partition passes on its best rows only.
    best = frame.withColumn("_r", F.row_number().over(W.partitionBy(category).orderBy(F.desc(score), key))).where(F.col("_r") <= top)
    q = best.join(F.broadcast(quotas.select(category, "quota")), category, "left").where(F.col("quota").isNull() | (F.col("_r") <= F.col("quota")))
    return q.drop("_r", "quota").orderBy(F.desc(score), key).limit(top)


def best_of_group(frame: DataFrame, group: str, score: str = "quality", key: str = "id") -> DataFrame:
    """The best row of each group; rows without a group stand alone."""
    g = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("own:"), F.col(key).cast("string")))
    return keep_first(frame.withColumn("_g", g), ["_g"], [F.desc(score), F.col(key)]).drop("_g")


def scored_or_filled(rows: DataFrame, scores: DataFrame, top: int, key: str = "id", place: str = "place") -> DataFrame:
    """The best-scored rows first, short lists filled with other rows in input order."""
    return rows.join(scores, key, "left").orderBy(F.col("score").desc_nulls_last(), place).limit(top)


#: Titles whose q-grams are counted to order them by frequency, and q-grams that the order names.
TITLE_SAMPLE, TITLE_GRAMS = 20_000, 100_000


def _common_least(n: int, m: int, ratio: float) -> int:
    """Letters that titles of n and m letters have in common, in order, at least if their matching ratio is ``ratio``."""
    return math.ceil(ratio * (n + m) / 2 - 1e-9)


class TitleMarks:
    """What of a title others with a matching ratio of ``ratio`` or more are sure to share.

    The ratio is twice the matching letters over all letters, and matching blocks are a common subsequence; so n - l letters of
    a title of length n are left out and m - l put in, l being ``_common_least``, which leaves all but q(n - l) + (q - 1)(m - l) of its
    q-grams.  Of sets that have so many in common the rarest elements, one more than may be lost, share one.
    """

    def __init__(self, ratio: float, rank: dict[str, int] | None = None):
        self.ratio, self.rank = ratio, rank or {}
        self.q = max(1, min(3, int((0.6 / max(1e-9, 1 - ratio) + 1) / 2)))
        self.known: dict[int, tuple[bool, int, list[int]]] = {}

    def lengths(self, n: int) -> tuple[bool, int, list[int]]:
        """Whether another title can be near one of ``n`` letters; q-grams lost at most; the lengths of near ones."""
        if n not in self.known:
            near = [m for m in range(math.ceil(self.ratio * n - 1e-9), int(n / self.ratio + 1e-9) + 1) if _common_least(n, m, self.ratio) <= min(n, m)]
            some = any(m != n or _common_least(n, m, self.ratio) < n for m in near)
            lost = max((self.q * (n - c) + (self.q - 1) * (m - c) for m in near for c in [_common_least(n, m, self.ratio)]), default=0)
            self.known[n] = some, lost, near
        return self.known[n]

    def loose(self, n: int) -> bool:
        """Whether no q-gram is sure to be shared."""
        return max(0, n - self.q + 1) <= self.lengths(n)[1]

    def marks(self, title: str) -> list[str]:
        """The rarest q-grams (repeats numbered), of which near titles share one; lengths besides where q-grams don't tell."""
        n = len(title)
        some, lost, near = self.lengths(n)
        if not some:
            return []
        times: Counter = Counter()
        grams = []
        for i in range(n - self.q + 1):
            g = title[i : i + self.q]
            grams.append(f"{g}\0{times[g]}" if times[g] else g)
            times[g] += 1
        out = sorted(grams, key=lambda g: (self.rank.get(g, 0), g))[: lost + 1]
        if self.loose(n):
            out += [f"\0{m}" for m in near]
        elif any(self.loose(m) for m in near):
            out.append(f"\0{n}")
        return out

    def signature(self, title: str) -> list[int]:
        """256 parities of (letter, how manieth): titles that differ by d letters put in or left out differ in at most d."""
        bits, times = [0, 0, 0, 0], Counter()
        for c in title:
            h = zlib.crc32(f"{c}{times[c]}".encode())
            times[c] += 1
            bits[h & 3] ^= 1 << (h >> 2) % 64
        return [b - (1 << 64) if b >> 63 else b for b in bits]


def alike(later: str, earlier: str, ratio: float) -> bool:
    """Whether the blocks that match in both make up ``ratio`` of their letters."""
    longest = max(len(later), len(earlier))
    if abs(len(later) - len(earlier)) / longest > 1 - ratio:
        return False
    return SequenceMatcher(None, later, earlier).ratio() >= ratio


def title_links(titles: DataFrame, ratio: float = 0.9, key: str = "id", norm: str = "norm") -> DataFrame:
    """``(later, earlier)``: the pairs of different titles that are ``alike``, each known by the smallest id that has it.

    Titles that share a mark meet (``TitleMarks``); a pair goes on only if lengths and signatures allow the ratio, which the join
    itself checks, and is then compared letter by letter.  Marks are ordered by their frequency in a bounded sample; the order
    decides how many titles meet, not which pairs are found.
    """
    one = stored(titles.where(F.col(norm) != "").groupBy(F.col(norm).alias("norm")).agg(F.min(key).alias("id")), "titles")
    kind = dict(one.dtypes)["id"]
    every = max(1, one.count() // TITLE_SAMPLE)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = TitleMarks(ratio).q
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([g for t in b.column(0).to_pylist() for g in {t[i : i + q] for i in range(len(t) - q + 1)}], pa.string())], names=["g"])

    sample = one.where(F.pmod(F.xxhash64("norm"), F.lit(every)) == 0).select("norm").mapInArrow(grams, "g string")
    most = sample.groupBy("g").count().where("count > 1").orderBy(F.desc("count"), "g").limit(TITLE_GRAMS).toArrow()
    rank = one.sparkSession.sparkContext.broadcast(dict(zip(most["g"].to_pylist(), most["count"].to_pylist())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TitleMarks(ratio, rank.value)
        for b in batches:
            names = b.column(0).to_pylist()
            marks = pa.array([own.marks(t) for t in names], pa.list_(pa.string()))
            sign = pa.array([own.signature(t) for t in names], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, names)), pa.int32()), sign, marks], names=["norm", "id", "n", "sign", "marks"])

    marked = stored(one.select("norm", "id").mapInArrow(mark, f"norm string, id {kind}, n int, sign array<long>, marks array<string>"), "marked")
    posted = marked.select("id", "norm", "n", "sign", F.explode("marks").alias("mark"))
    a, b = posted.alias("a"), posted.alias("b")
    both = F.col("a.n") + F.col("b.n")
    spare = both - 2 * F.ceil(F.lit(ratio) * both / 2 - 1e-9)
    differ = sum((F.bit_count(F.col("a.sign")[i].bitwiseXOR(F.col("b.sign")[i])) for i in range(4)), F.lit(0))
    met = a.join(b, (F.col("a.mark") == F.col("b.mark")) & (F.col("a.id") > F.col("b.id")) & (F.least("a.n", "b.n") >= F.lit(ratio) * F.greatest("a.n", "b.n") - 1e-9) & (differ <= spare))
    pairs = met.select(F.col("a.id").alias("later"), F.col("b.id").alias("earlier"), F.col("a.norm").alias("x"), F.col("b.norm").alias("y")).dropDuplicates(["later", "earlier"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([alike(x, y, ratio) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield b.select(["later", "earlier"]).filter(ok)

    return pairs.mapInArrow(verify, f"later {kind}, earlier {kind}")


def same_titles(titles: DataFrame, ratio: float = 0.9, key: str = "id", norm: str = "norm") -> DataFrame:
    """``(id, keep)``: in order of ids a title stays unless it equals, or is ``alike`` to, one with a smaller id that stays.

    ``keep`` is the own id of titles that stay, else the smallest id of those that make it go.  A title near one that goes itself may
    stay.  Empty and null titles stay; equal titles are compared once.
    """
    links = stored(title_links(titles, ratio, key, norm), "title-links")
    stays = stored(kept_first(links), "title-stays")
    left = links.join(stays.where("kept").select(F.col("node").alias("earlier")), "earlier").groupBy(F.col("later").alias("node")).agg(F.min("earlier").alias("by"))
    gone = stays.where("not kept").select("node").join(left, "node")
    heads = titles.where(F.col(norm) != "").groupBy(norm).agg(F.min(key).alias("node")).join(gone, "node", "left").select(norm, F.coalesce("by", "node").alias("keep"))
    return titles.join(heads, norm, "left").select(key, F.coalesce("keep", key).alias("keep"))


def title_groups(titles: DataFrame, ratio: float = 0.9, key: str = "id", norm: str = "norm") -> DataFrame:
    """``(id, group)`` of titles that equal titles or chains of ``alike`` ones join; group is the smallest id, null where a title is alone."""
    roots = components(title_links(titles, ratio, key, norm).select(F.col("later").alias("a"), F.col("earlier").alias("b")))
    heads = titles.where(F.col(norm) != "").groupBy(norm).agg(F.min(key).alias("node"), F.count("*").alias("n"))
    group = F.coalesce("root", F.when(F.col("n") > 1, F.col("node")))
    return titles.join(heads.join(stored(roots, "title-groups"), "node", "left").select(norm, group.alias("group")), norm, "left").select(key, "group")


def feed_entries(pages: DataFrame, cutoff: Column, most: int = 500, key: str = "page_id") -> DataFrame:
    """``(key, summary, n_content, images, date)`` of feed entries: a summary of ``most`` characters without tags, the length of
    the whole content, addresses of its images, and its date.  Entries dated before ``cutoff`` go; undated ones stay.
    """
    date, _ = X.html_date(F.col("html"), F.col("url"))
    images = F.regexp_extract_all("html", F.lit(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""), F.lit(1))
    e = pages.select(key, X.html_plain(F.col("html")).alias("content"), images.alias("images"), date.alias("date"))
    return e.where(F.col("date").isNull() | (F.col("date") >= cutoff)).select(key, F.substring("content", 1, most).alias("summary"), F.length("content").alias("n_content"), "images", "date")


def longer_content(articles: DataFrame, bodies: DataFrame, key: str = "id", short: int = 200) -> DataFrame:
    """Short contents replaced by the longer body of the page table; summaries extended to it."""
    b = bodies.select(key, F.col("body"))
    j = articles.join(b, key, "left")
    better = (F.length(F.coalesce("content", F.lit(""))) < short) & (F.length("body") > F.length(F.coalesce("content", F.lit(""))))
    filled = F.when(better, F.col("body")).otherwise(F.col("content"))
    return j.withColumn("content", filled).withColumn("summary", F.when(F.length(F.coalesce("summary", F.lit(""))) < 20, X.short_summary(F.col("content"))).otherwise(F.col("summary"))).drop("body")


# ── scorers ────────────────────────────────────────────────────────────────


def score_rows(rows: DataFrame, scorer: Callable[[dict], dict], out: str, attempts: int = 3, model: str = "") -> DataFrame:
    """``rows`` with a scorer's columns, ``prediction_status``, ``error_message`` and ``llm_model``.

    ``scorer`` takes a row as a dict and returns the columns of the schema ``out``; an error is tried ``attempts`` times
    and then told in the row.  Rows are scored in batches where they lie.
    """
    from pyspark.sql import types as T

    fields = [f.name for f in T.StructType.fromDDL(out).fields]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(out).fields, *T.StructType.fromDDL("prediction_status string, error_message string, llm_model string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for row in b.to_dict("records"):
                for attempt in range(attempts):
                    try:
                        got.append({**{f: None for f in fields}, **scorer(row), "prediction_status": "success", "error_message": None, "llm_model": model})
                        break
                    except Exception as e:  # told in the row
                        if attempt == attempts - 1:
                            got.append({**{f: None for f in fields}, "prediction_status": "failed", "error_message": str(e), "llm_model": model})
            extra = pd.DataFrame(got, columns=[*fields, "prediction_status", "error_message", "llm_model"], index=b.index)
            yield pd.concat([b, extra], axis=1)

    return rows.mapInPandas(run, schema)


def relevance_gate(scored: DataFrame, least: float = 6.0) -> DataFrame:
    """Rows whose checked score is ``least`` or more."""
    return scored.where(F.col("score") >= least)


def insights(selected: DataFrame, store: Store, batch: str, scorer: Callable[[dict], dict], out: str, categories: list[str] | None = None, category: str = "category", model: str = "") -> DataFrame:
    """The insights that ``store`` holds after those of ``selected`` are added: a scorer's columns ``out`` for each article, by the store's key.

    Only articles of ``categories`` (all, if none are given) and without an insight yet are scored, so that a run that comes again
    asks for what failed or is new; each run has its own ``batch``.  Rows whose scoring failed aren't stored.
    """
    rows = selected.where(F.col(category).isin(categories)) if categories else selected
    todo = rows.join(store.read().select(*store.key), store.key, "left_anti").dropDuplicates(store.key)
    told = stored(score_rows(todo, scorer, out, model=model), "insights")
    store.insert(batch, told.where("prediction_status = 'success'"))
    return store.read()
