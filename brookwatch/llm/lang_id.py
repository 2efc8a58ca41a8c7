"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the text, the language that the markup declares, the
suffix of the address (a country-like last label or a language folder), and a prior of the host.  Host priors are
smoothed hierarchically: the pages of a host are added to those of its domain, those to all pages, each level weighing a
few pages in the next; a page's own text never counts in its own prior.  How far declarations and suffixes can be
trusted is learned the same way, from grouped sums of the text's posteriors.

Training.  Texts of a known language, about ``max_rows`` of each by a hash of the id, give counts of 4-byte grams hashed
to a table of fixed size; counts are summed by Spark and only that table, languages x 65,536, reaches the driver.

Scale.  Pages are read once and become a row of a few numbers; all sums are combined before they are shuffled, and a host
with a third of all pages is one row in the join, whose other side Spark splits.

Defined cases: null or empty html has no text evidence; a null address or one without host shares the host ''; equal
probabilities go to the language first in alphabetical order; repeated rows are pages of their own; without training
texts the language is null with probability 0; other columns are left alone.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

TABLE_BITS = 16
MAX_ROWS = 2_000
CERTAINTY = 200.0  # grams of text at most, of which each counts a fourth, as grams overlap
HOST_PAGES, DOMAIN_PAGES, VALUE_PAGES = 4.0, 8.0, 2.0  # what the next level weighs

DROPPED = re.compile(r"<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.IGNORECASE | re.DOTALL)


def visible(page: str) -> str:
    """Text of a page without markup, scripts, styles and navigation."""
    return " ".join(html.unescape(DROPPED.sub(" ", page)).split())


def gram_places(text: str) -> np.ndarray:
    """Table places of the overlapping 4-byte grams of a text."""
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
    if len(data) < 4:
        return np.zeros(0, np.int64)
    packed = (data[:-3] << np.uint64(24)) | (data[1:-2] << np.uint64(16)) | (data[2:-1] << np.uint64(8)) | data[3:]
    return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class TextModel:
    """Log probabilities of grams for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else counts

    def evidence(self, text: str) -> list[float]:
        """Log likelihood of each language, tempered and relative to the best."""
        places = gram_places(text)
        if not len(places) or not self.languages:
            return [0.0] * len(self.languages)
        sums = self.logs[:, places].mean(axis=1) * min(len(places), CERTAINTY) / 4
        return (sums - sums.max()).tolist()


def train(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_rows: int = MAX_ROWS) -> TextModel:
    known = texts.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang RLIKE '^[a-z]{2,3}$'")
    rows = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the codes of 2 or 3 letters
    part = F.coalesce(*(F.when(F.col("lang") == r["lang"], min(1.0, max_rows / r["n"])) for r in rows)) if rows else F.lit(1.0)
    drawn = known.where(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1_000_000)) < part * 1_000_000)

    def count(lang: list[str], text: list[str]) -> dict:
        sums: dict[str, np.ndarray] = {}
        for code, t in zip(lang, text, strict=True):
            held = sums.setdefault(code, np.zeros(1 << TABLE_BITS, np.int64))
            held += np.bincount(gram_places(t), minlength=len(held))
        found = [(code, np.flatnonzero(s), s) for code, s in sums.items()]
        return {"lang": [code for code, at, _ in found for _ in at], "place": np.concatenate([at for _, at, _ in found]),
                "n": np.concatenate([s[at] for _, at, s in found])}

    counted = (map_batches(drawn.select("lang", "text"), lambda: count, "lang string, place int, n long")
               .groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(r["lang"] for r in rows)
    counts = np.zeros((len(languages), 1 << TABLE_BITS))
    counts[[languages.index(x) for x in counted["lang"]], counted["place"].to_numpy(np.int64)] = counted["n"]
    return TextModel(languages, counts)


def pages_seen(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page its text evidence, and the keys of the other kinds of evidence."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    folder = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    last = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
                        host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
                        declared.alias("declared"), F.concat_ws("/", last, folder).alias("suffix"))

    def work(key: list, page: list[str], *rest: list) -> dict:
        names = ("host", "domain", "declared", "suffix")
        return {"page_id": key, **dict(zip(names, rest, strict=True)), "logs": [model.evidence(visible(p)) for p in page]}

    return map_batches(rows, lambda: work,
                       "page_id long, host string, domain string, declared string, suffix string, logs array<double>")


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """Per page: page_id, lang, probability, text_lang, declared, suffix, host, host_pages."""
    n = len(model.languages)
    if not n:
        return pages.select(F.col(id_col).cast("long").alias("page_id"), *(F.lit(None).cast("string").alias(c) for c in (
            "lang", "text_lang", "declared", "suffix", "host")), F.lit(0.0).alias("probability"), F.lit(0).cast("long").alias("host_pages"))
    each = range(n)
    logs = [F.col("logs")[i] for i in each]
    weight = total([F.exp(x) for x in logs])
    seen = written(pages_seen(pages, model, id_col, url_col, html_col)
                   .select("*", *((F.exp(x) / weight).alias(f"p{i}") for i, x in enumerate(logs))), "pages-seen")

    def sums(by: str, name: str) -> DataFrame:
        return seen.groupBy(by).agg(*(F.sum(f"p{i}").alias(f"{name}{i}") for i in each), F.count(F.lit(1)).alias(f"{name}_n"))

    world = seen.agg(*(F.sum(f"p{i}") for i in each), F.count(F.lit(1))).first()
    count = world[n] or 0
    share = [((world[i] or 0.0) + 1) / (count + n) for i in each]
    joined = seen
    for by, name in (("host", "h"), ("domain", "d"), ("declared", "m"), ("suffix", "s")):
        joined = joined.join(sums(by, name), by)
    posterior = []
    for i in each:
        own = F.col(f"p{i}")
        domain = (F.col(f"d{i}") - own + DOMAIN_PAGES * share[i]) / (F.col("d_n") - 1 + DOMAIN_PAGES)
        prior = (F.col(f"h{i}") - own + HOST_PAGES * domain) / (F.col("h_n") - 1 + HOST_PAGES)
        evidence = F.col("logs")[i] + F.log(prior)
        for name in ("m", "s"):
            # how often pages of the language show this value, against how often all pages do; none shown says nothing
            rate = (F.col(f"{name}{i}") - own + VALUE_PAGES * share[i] * F.col(f"{name}_n") / count) / (share[i] * count)
            shown = F.col("declared" if name == "m" else "suffix") != ""
            evidence = evidence + F.when(shown, F.log(F.greatest(rate, F.lit(1e-9)))).otherwise(0.0)
        posterior.append(evidence)
    rows = joined.select("page_id", "declared", "suffix", "host", F.col("h_n").alias("host_pages"), "logs",
                         F.array(*posterior).alias("e"))
    top = F.array_max("e")
    names = F.array(*(F.lit(x) for x in model.languages))
    best = lambda col: F.element_at(names, F.array_position(F.col(col), F.array_max(col)).cast("int"))
    return rows.select("page_id", best("e").alias("lang"),
                       (1 / total([F.exp(F.col("e")[i] - top) for i in each])).alias("probability"),
                       best("logs").alias("text_lang"), "declared", "suffix", "host", "host_pages")
