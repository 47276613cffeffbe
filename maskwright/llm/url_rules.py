"""URL filtering by association rules.

A URL is the set of its tokens: host labels, words of the path, names of query parameters. FP-growth mines token
combinations that go with pages labelled as bad (quality 0 or toxic 1). Rules are pruned by support (in bad pages), by
confidence, and by significance: the bad pages among those that hold a rule must be ``min_z`` standard errors above what
the share of all bad pages gives, so that labels which don't depend on URLs make no rules. A rule goes when any part of it
is at least as confident. Tokens that labelled pages always hold together are mined as one, the first in order: else
a long URL that occurs often would have a rule for every subset of its tokens. A page is matched by inverted index: each
rule is filed under the token that fewest labelled pages hold, pages meet the rules filed under one of their tokens, and
the other tokens are then compared. Listed rules (host and path prefix) come first; of those that fit, the longest decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.shared import cut

#: Host suffix, path prefix, verdict.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD, SALTS = "=bad", 64


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, listed=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; null if none does."""
    rule = verdict = None
    for h, p, v in sorted(listed, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` host labels, ``p:`` runs of letters and digits of the path (numbers as 0), ``q:`` parameter names."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    words = F.transform(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), r"[^\p{L}0-9]+"), lambda t: F.concat(F.lit("p:"), t))
    names = F.transform(F.split(F.lower(query), "&"), lambda t: F.concat(F.lit("q:"), F.regexp_replace(t, "(?s)=.*", "")))
    return F.array_distinct(F.filter(F.concat(labels, words, names), lambda t: F.length(t) > 2))


RULE = "rule_id long, tokens array<string>, confidence double, support double, lift double, pages long"


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_pages: int = 20, min_z: float = 4.0) -> DataFrame:
    """Rules ``rule_id, tokens, confidence, support, lift, pages`` from rows (row, tokens, bad); row numbers are distinct.

    A rule holds for ``min_pages`` bad pages and ``min_support`` of all labelled ones at least; its pages hold it, bad or
    not. Empty if there is nothing to learn from.
    """
    spark = labelled.sparkSession
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    least = max(min_pages, int(np.ceil(min_support * n)), 1)
    if n_bad < least or n_bad == n:
        return spark.createDataFrame([], RULE)
    each = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    # a cover is told by its size and the sum of its rows' hashes
    covers = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("cover"))
    kept = covers.filter(F.col("n_bad") >= least).groupBy("n", "cover").agg(F.min("token").alias("token"))
    baskets = cut(each.join(kept.select("token"), "token").groupBy("row").agg(F.collect_list("token").alias("tokens"), F.bool_or("bad").alias("bad")), "baskets")
    held = baskets.count()
    if not held:
        return spark.createDataFrame([], RULE)
    items = baskets.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held).fit(items).freqItemsets
    joint = F.array_contains("items", BAD)
    parts = found.filter(joint).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("k")).filter(F.size("tokens") > 0)
    whole = found.filter(~joint).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("pages"))
    rules = parts.join(whole, "tokens").select(F.xxhash64("tokens").alias("rule_id"), "tokens", (F.col("k") / F.col("pages")).alias("confidence"), "k", "pages")
    rules = _without_needless(cut(rules, "rules"))
    p = n_bad / n
    z = (F.col("k") - F.col("pages") * p) / F.sqrt(F.col("pages") * p * (1 - p))
    rules = rules.select("rule_id", "tokens", "confidence", (F.col("k") / n).alias("support"), (F.col("confidence") / p).alias("lift"), "pages", z.alias("z"))
    return cut(rules.filter((F.col("confidence") >= min_confidence) & (F.col("lift") > 1) & (F.col("z") >= min_z)).drop("z"), "mined")


def _without_needless(rules: DataFrame) -> DataFrame:
    """Rules of which no part is at least as confident. Parts of frequent sets are frequent, so that the best of all parts
    comes from the parts that lack one token: one join for each length."""
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    best, out = None, None
    for size in range(1, longest + 1):
        own = rules.filter(F.size("tokens") == size)
        if best is None:
            known = own.withColumn("of_part", F.lit(-1.0))
        else:
            one_less = F.transform("tokens", lambda t: F.xxhash64(F.array_remove("tokens", t)))
            met = own.select("rule_id", F.explode(one_less).alias("part_id")).join(best, "part_id").groupBy("rule_id").agg(F.max("best").alias("of_part"))
            known = own.join(met, "rule_id", "left").fillna(-1.0, ["of_part"])
        known = cut(known, "of-length")
        best = known.select(F.col("rule_id").alias("part_id"), F.greatest("of_part", "confidence").alias("best"))
        needed = known.filter("confidence > of_part").drop("of_part")
        out = needed if out is None else out.unionByName(needed)
    return rules if out is None else out


def url_verdicts(pages: DataFrame, labels: DataFrame, listed=LISTED, min_support: float = 0.002, min_confidence: float = 0.5, min_pages: int = 20, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_confidence, mined_tokens`` for every row of pages.

    rule: the listed rule that decides, else null. verdict: ``allow`` or ``block``; without a listed rule a page is
    blocked if a mined rule matches it. mined_*: the most confident mined rule that matches, also where a listed rule
    decides. labels holds (doc_id, quality, toxic) by page id; null labels count as good and repeated ones as bad if
    one is. Null urls have empty host and path; null ids are kept; repeated rows are judged one by one; other columns
    are not read; empty tables give no rows or no mined rules.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"), tokens(F.col("url"), host, path).alias("tokens"))
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.bool_or(bad).alias("bad"))
    labelled = cut(rows.join(marks, "page_id").select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled")
    rules = mine(labelled, min_support, min_confidence, min_pages)

    # pages with the same tokens are matched once; a rule waits under the token that fewest labelled pages hold
    set_id = F.md5(F.concat_ws("\x00", "tokens"))
    sets = rows.select(set_id.alias("set_id"), "tokens").groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    used = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    filed = rules.select("*", F.explode("tokens").alias("token")).join(used, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("count", "token")).alias("token"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence"))
    met = sets.select("set_id", "tokens", F.explode("tokens").alias("token")).join(filed, "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = met.groupBy("set_id").agg(F.max(F.struct("confidence", "rule_tokens")).alias("best"))

    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    # many pages may share a set: its rows are dealt over SALTS tasks
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = rows.withColumn("set_id", set_id).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["set_id", "salt"], "left")
    mined = F.when(F.col("best").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), F.col("best.confidence").alias("mined_confidence"), F.array_join("best.rule_tokens", " ").alias("mined_tokens"))
