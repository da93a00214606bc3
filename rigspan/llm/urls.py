"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models, one of the accepted urls and one of
the rejected, are counted from the urls that a rule decides. The probability
of a character mixes all context lengths down to none (Witten-Bell): a longer
context weighs by how often it was seen, an unseen one falls back to the next
shorter. A url's score is the mean per character of the log ratio, so long
urls do not score by length; the threshold is calibrated on a fifth of the
ruled urls, which the counts leave out. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, hot_keys, materialize, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a host and a path prefix in one string
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
ORDER = 5
START, END = "\u0002", "\u0003"
FLOOR = 1 / 256
BIN = 0.01


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for rule, verdict in rules:
        domain, slash, prefix = rule.partition("/")
        fit = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(*fits, none) if fits else none


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of ``urls(uid, url, ...)``: the character with ORDER - 1 before it; without the url."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.lower(F.regexp_replace("url", "^[^:/?#]*://", "")), F.lit(END))
    rest = [c for c in urls.columns if c != "url"]
    spelled = urls.select(*rest, F.array_remove(F.split(padded, ""), "").alias("__c"))
    grams = F.transform(F.sequence(F.lit(1), F.size("__c") - (ORDER - 1)), lambda i: F.array_join(F.slice("__c", i, ORDER), ""))
    return spelled.select(*rest, F.explode(grams).alias("gram"))


def _ratios(grams: DataFrame) -> DataFrame:
    """Log ratio of every gram of ``grams(gram, a, r)``: its counts in accepted and rejected urls."""
    levels = {ORDER: grams.select("gram", "a", "r")}
    for k in range(ORDER - 1, 0, -1):
        longer = levels[k + 1].select(F.expr(f"right(gram, {k})").alias("gram"), "a", "r")
        levels[k] = longer.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    followers = [
        F.sum("a").alias("ca"), F.sum("r").alias("cr"),
        F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"),
    ]
    whole = levels[1].agg(*followers).first()  # one row: totals over the alphabet
    ca, cr, ta, tr = (float(x or 0) for x in whole)
    mix = lambda c, t, n, lower: (c + t * lower) / (n + t)
    model = levels[1].select(
        "gram",
        (mix(F.col("a"), F.lit(ta), ca, F.lit(FLOOR)) if ca else F.lit(FLOOR)).alias("pa"),
        (mix(F.col("r"), F.lit(tr), cr, F.lit(FLOOR)) if cr else F.lit(FLOOR)).alias("pr"),
    )
    for k in range(2, ORDER + 1):
        context = levels[k].groupBy(F.expr(f"left(gram, {k - 1})").alias("context")).agg(*followers)
        lower = model.select(F.col("gram").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        model = (
            levels[k]
            .withColumns({"context": F.expr(f"left(gram, {k - 1})"), "suffix": F.expr(f"right(gram, {k - 1})")})
            .join(context, "context")
            .join(lower, "suffix")
            .select(
                "gram",
                F.when(F.col("ca") > 0, mix(F.col("a"), F.col("ta"), F.col("ca"), F.col("qa"))).otherwise(F.col("qa")).alias("pa"),
                F.when(F.col("cr") > 0, mix(F.col("r"), F.col("tr"), F.col("cr"), F.col("qr"))).otherwise(F.col("qr")).alias("pr"),
            )
        )
    return model.select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """The score that parts ``scored(accepted, score)`` with the least sum of both error rates.

    Scores are counted in bins of BIN between -20 and 20, so what is collected is bounded.
    """
    bin_ = F.floor(F.greatest(F.least("score", F.lit(20.0)), F.lit(-20.0)) / BIN).alias("bin")
    bins = scored.groupBy(bin_).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()
    bins = sorted((r.bin, r.a, r.r) for r in bins)
    na, nr = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not na or not nr:
        return 0.0
    best, at, a_below, r_below = 1.0, 0.0, 0, 0
    for k, (b, a, r) in enumerate(bins):
        if (error := a_below / na + (nr - r_below) / nr) < best:
            low = bins[k - 1][0] + 1 if k else b
            best, at = error, (low + b) / 2 * BIN
        a_below, r_below = a_below + a, r_below + r
    return at


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """id, url, host, path, rule, verdict, score of every page.

    verdict: the longest fitting rule's, else ``allow`` where the score reaches
    the threshold and ``block`` below it. score: mean log ratio per character,
    accepted over rejected. Null urls and urls without ``://`` have empty host
    and path; a null url is scored as an empty one. No ruled urls of one kind:
    ratios are of one model against the floor, the threshold is 0. Repeated
    rows and null ids stay. Other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(url_col), F.lit("")).alias("key"))
    counted = rows.groupBy("key").agg(F.count("*").alias("m"))
    urls = counted.select(F.col("key").alias("url"), F.col("key").alias("__url"), "m")
    host, path = parts(F.col("__url"))
    urls = urls.select("url", "m", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("d", decide(rules, F.col("host"), F.col("path"))).select(
        "url", "m", "host", "path", F.col("d.rule").alias("rule"), F.col("d.verdict").alias("ruled")
    )
    urls = urls.withColumns({"held": F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5)) == 0, "uid": F.monotonically_increasing_id()})
    urls = materialize(urls)

    learn = lambda v: F.sum(F.when((F.col("ruled") == v) & ~F.col("held"), 1).otherwise(0))
    spelled = _grams(urls.select("uid", "url", "ruled", "held"))
    counts = materialize(spelled.groupBy("gram").agg(F.count("*").alias("n"), learn("allow").alias("a"), learn("block").alias("r")))
    ratios = _ratios(counts)
    met = spread_join(spelled.select("uid", "gram"), ratios, "gram", hot_keys(counts, "gram", "n"), "uid")
    # exact sums, so that no order of adding changes a verdict
    total = F.sum(F.col("ratio").cast("decimal(20,12)")).cast("double")
    scores = materialize(met.groupBy("uid").agg((total / F.count("*")).alias("score")))
    judged = materialize(urls.join(scores, "uid").drop("uid"))
    drop_table(scores, counts, urls)

    ruled = judged.where("ruled is not null")
    threshold = _threshold(ruled.where("held").select((F.col("ruled") == "allow").alias("accepted"), "score"))
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    judged = judged.withColumn("verdict", F.coalesce("ruled", own))
    back = judged.withColumnRenamed("url", "key")
    hot = hot_keys(back, "key", "m")
    back = back.select("key", "host", "path", "rule", "verdict", "score")
    out = spread_join(rows.withColumn("__spread", F.xxhash64("id")), back, "key", hot, "__spread")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", "verdict", "score")
