"""URL content attacks and malicious URLs."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.address import addr_text
from ..functions.names import URL_ATTACKS
from ..operators.rulematch import Rules, first_rule, network, on_schedule, with_values
from ..rules import Window, rule_table
from ..session import held_rows
from .base import RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, with_hour
from .scoring import Scorer, default_url_scorer

PULL_DB = 5
GRAMS = (4, 8, 16)  # lengths of the texts by which patterns are looked up


def factors(pattern: str) -> list[str]:
    """The plain texts that whatever a pattern matches must hold, of ``GRAMS[0]`` characters or more.

    Groups that are neither repeated nor offer alternatives count as if they stood outside; a class of one plain character
    is that character.  A repeated character ends a text, one that may be missing is left out, and patterns with flags,
    quotes, codes or references are not judged.
    """
    if not pattern or "(?" in pattern:
        return []
    # of each open group: the texts found, the one under way, whether there are alternatives
    levels, i = [[[], "", False]], 0
    while i < len(pattern):
        c, step, literal = pattern[i], 1, ""
        texts, run, _ = top = levels[-1]
        if c == "\\":
            following, step = pattern[i + 1:i + 2], 2
            if following in tuple("QEuxcpPkN0123456789"):
                return []
            literal = "" if following.isalnum() else following
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1:i + 2] == "^" else 2))
            if end < 0 or "[" in pattern[i + 1:end] or "\\" in pattern[i + 1:end + 1]:
                return []
            step = end + 1 - i
            literal = pattern[i + 1:end] if step == 3 and pattern[i + 1] not in "^&" else ""
        elif c == "(":
            levels.append([[], "", False])
            i += 1
            continue
        elif c == ")":
            if len(levels) == 1:
                return []
            levels.pop()
            inner = [] if top[2] or pattern[i + 1:i + 2] in tuple("?*{+") else [*texts, run]
            outer = levels[-1]
            outer[0] += [outer[1], *inner]
            outer[1] = ""
            i += 1
            continue
        elif c == "|":
            top[2] = True
        elif c in "?*{":
            top[1] = run[:-1]
            step = pattern.find("}", i) + 1 - i if c == "{" else 1
            if step < 1:
                return []
        elif c not in ".^$+":
            literal = c
        if literal:
            top[1] += literal
        else:
            texts.append(top[1])
            top[1] = ""
        i += step
    (texts, run, choice), *unclosed = levels
    return [] if choice or unclosed else list(dict.fromkeys(t for t in [*texts, run] if len(t) >= GRAMS[0]))


def factor(pattern: str) -> str:
    """The longest of a pattern's plain texts; empty where there is none."""
    return max(factors(pattern), key=len, default="")


def _grams(text: Column, lengths: Sequence[int] = GRAMS) -> Column:
    """The distinct substrings of a text of some lengths."""
    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, n))
        return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in lengths]))


def _longest_grams(text: Column) -> Column:
    """The substrings of a text of the largest of the lengths that it has."""
    found = F.lit(None)
    for n in GRAMS:
        found = F.when(F.length(text) >= n, _grams(text, [n])).otherwise(found)
    return found


def matched_urls(urls: DataFrame, rules: Rules) -> DataFrame:
    """http_url and the rule of highest id whose pattern matches all of it, of distinct URLs.

    Equal patterns are tested once.  A pattern is tested only on the URLs that hold its plain texts, found by a join on the
    part of these that the fewest URLs hold; patterns without plain text are tested on all.
    """
    spark = urls.sparkSession
    table = rule_table(spark, rules)
    if isinstance(rules, DataFrame):
        def texts_of(patterns: pd.Series) -> pd.Series:
            return patterns.map(factors)

        one = table.select("config_id", "pat").repartition(spark.sparkContext.defaultParallelism, "pat")
        patterns = one.groupBy("pat").agg(F.max("config_id").alias("config_id")).withColumn(
            "_texts", F.pandas_udf(texts_of, ArrayType(StringType()))("pat"))
    else:
        highest = {r.pat: r.config_id for r in sorted(rules, key=lambda r: r.config_id)}
        patterns = held_rows(spark, [(pat, i, factors(pat)) for pat, i in highest.items()],
                             "pat string, config_id int, _texts array<string>")
    probes = urls.select("http_url", F.explode(F.concat(F.array(F.lit("")), _grams(F.col("http_url")))).alias("_gram"))
    holding = probes.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    sought = patterns.select("config_id", "pat", "_texts", F.explode(F.when(F.size("_texts") > 0, F.array_distinct(F.flatten(
        F.transform("_texts", _longest_grams)))).otherwise(F.array(F.lit("")))).alias("_gram"))
    # a part that no URL holds: the pattern matches none
    rarest = sought.join(holding, "_gram", "left").groupBy("config_id", "pat", "_texts").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram"))["_gram"].alias("_gram"))
    hits = probes.join(rarest, "_gram").where(
        F.forall("_texts", lambda t: F.contains(F.col("http_url"), t))
        & F.regexp_like("http_url", F.concat(F.lit(r"\A(?:"), F.col("pat"), F.lit(r")\z"))))
    best = hits.groupBy("http_url").agg(F.max("config_id").alias("_id"))
    return best.join(table.select(F.col("config_id").alias("_id"), F.struct("*").alias("rule")), "_id").drop("_id")


def detect_url_attacks(flows: DataFrame, rules: Rules, window: Window) -> Detection:
    """Answered URLs that fully match a rule pattern; the highest config id
    wins.  PULL_DB compares bytes, other classes flows."""
    if not isinstance(rules, DataFrame) and not rules:
        return Detection()
    f = window.clip(flows).where((F.col("prot") == 6) & (F.col("http_url") != "") & (F.col("http_ret_code") != 0))
    key = [*RUN, "srcaddr", "srcport", "dstaddr", "dstport", "http_url"]
    agg = f.groupBy(*key).agg(*counters())
    judged = agg.join(matched_urls(f.select("http_url").distinct(), rules), "http_url")
    limit = F.when(F.col("rule.sub_type") == PULL_DB, F.col("bytes")).otherwise(F.col("flows"))
    names = F.create_map(*(F.lit(x) for pair in URL_ATTACKS.items() for x in pair))
    hits = with_values(judged.where(limit > F.col("rule.min")), F.col("rule.min"), F.col("flows"), F.lit("")).withColumn(
        "attack", F.coalesce(F.try_element_at(names, F.col("rule.sub_type")), F.lit("")))
    obj = joined(addr_text(f, "srcaddr"), ":", F.col("srcport"), ">", addr_text(f, "dstaddr"), ":",
                 F.col("dstport"), " TCP ", F.col("attack"))
    tagged = events_of(hits, obj, 3, keep=key)
    return Detection(lambda: only_events(tagged), None,
                     lambda: details_of(f.withColumn("prot", F.lit(6)), tagged, key, extra=["http_url"]))


def detect_malicious_url(flows: DataFrame, rules: Rules, window: Window,
                         scorer: Scorer = default_url_scorer) -> Detection:
    """Requested URLs scored above a rule's minimum; the first such rule decides."""
    f = window.clip(flows).where(is_request() & (F.col("http_url") != ""))
    key = [*RUN, "srcaddr", "dstaddr", "dstport", "http_url"]
    scored = scorer(f.groupBy(*key).agg(*counters()), "http_url")
    first = first_rule(scored, rules, F.col("score") > F.col("rule.min"),
                       {"sip": network("srcaddr", listed=True), "dip": network("dstaddr", listed=True)})
    hits = with_values(first.where(on_schedule(window)), F.col("rule.min"), F.col("score"), F.col("rule.data_type"))
    obj = joined(addr_text(f, "srcaddr"), ":>", addr_text(f, "dstaddr"), ":", F.col("dstport"), " ")
    tagged = events_of(hits, obj, 1, keep=key)
    return Detection(lambda: only_events(tagged), lambda: with_hour(scored.drop("time")),
                     lambda: details_of(f, tagged, key, extra=["http_url"]))
