"""URL filter: rules by host and path, and for the rest a character language-model ratio.

Two smoothed variable-order Markov models, of URLs that the rules allow and of URLs that they block, score each character
in the context of the two before it. Witten-Bell smoothing mixes each order with the next lower one, down to a uniform
alphabet. A URL's score is the mean difference of the log-likelihoods per character, compared with a threshold that is
calibrated on the labelled URLs. Column expressions, joins and aggregates only. Tables by n-gram have at most
alphabet^3 rows (97 symbols: printable ASCII, one symbol for all else, one for the start), whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketripple.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, OTHER, ALPHABET = "\x02", "\x7f", 97
#: Width and largest magnitude of the score bins from which the threshold is taken.
BIN, TOP_BIN = 0.02, 500


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is NULL."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_path(url: Column) -> tuple[Column, Column]:
    rest = url_rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def fits(rule: str, host: Column, path: Column) -> Column:
    """The host is the rule's or below it, and the path starts with the rule's (which begins with a slash)."""
    name, slash, tail = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)


def apply_rules(pages: DataFrame, rules: Sequence[tuple[str, str]], url_column: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (allow, block or NULL). The longest fitting rule wins; of two equally long ones, block."""
    host, path = host_path(F.col(url_column))
    out = pages.withColumns({"host": host, "path": path})
    rule = ruled = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        hit = fits(text, F.col("host"), F.col("path"))
        rule, ruled = F.when(hit, text).otherwise(rule), F.when(hit, verdict).otherwise(ruled)
    return out.withColumns({"rule": rule, "ruled": ruled})


def _grams(urls: DataFrame) -> DataFrame:
    """One row for each character of ``symbols`` with the two before it."""
    padded = F.concat(F.lit(START * 2), F.col("symbols"))
    return urls.select("*", F.posexplode(F.expr("sequence(1, length(symbols))")).alias("pos", "at")).select(
        *[c for c in urls.columns if c != "symbols"], F.substring(padded, F.col("at"), F.lit(3)).alias("gram"))


def _smoothed(counts: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """Log-free probabilities p_accept, p_reject of the last character of each gram, mixed with the next lower order."""
    ctx = F.substring("gram", 1, order)
    sums = [f(c).alias(f"{k}_{c}") for c in ("accept", "reject") for k, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))]
    totals = counts.groupBy(ctx.alias("ctx")).agg(*sums)
    joined = counts.withColumn("ctx", ctx).join(totals, "ctx")
    if lower is None:
        joined = joined.withColumns({"q_accept": F.lit(1.0 / ALPHABET), "q_reject": F.lit(1.0 / ALPHABET)})
    else:
        joined = joined.withColumn("low", F.substring("gram", 2, order)).join(
            lower.select(F.col("gram").alias("low"), F.col("p_accept").alias("q_accept"), F.col("p_reject").alias("q_reject")), "low")
    p = {f"p_{c}": F.when(F.col(f"n_{c}") == 0, F.col(f"q_{c}")).otherwise(
        (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))) for c in ("accept", "reject")}
    return joined.select("gram", *[v.alias(k) for k, v in p.items()])


def ratio_weights(urls: DataFrame) -> DataFrame:
    """(gram, weight) of every gram of ``urls`` (symbols, ruled): the log-likelihood difference it adds."""
    counts = materialise(_grams(urls).groupBy("gram").agg(
        F.count_if(F.col("ruled") == "allow").alias("accept"), F.count_if(F.col("ruled") == "block").alias("reject")), "url_grams")
    lower = None
    for order in (0, 1, 2):
        own = counts.groupBy(F.substring("gram", 3 - order, order + 1).alias("gram")).agg(F.sum("accept").alias("accept"), F.sum("reject").alias("reject"))
        lower = materialise(_smoothed(own, lower, order), "url_order")
    return materialise(lower.select("gram", (F.log("p_accept") - F.log("p_reject")).alias("weight")), "url_weights")


def calibrate(scored: DataFrame) -> float:
    """The score from which on a URL is accepted: least sum of the two error rates on labelled URLs, nearest to zero of several,
    in the middle of the gap between the bins that it parts.

    Works on at most 2 * TOP_BIN + 1 bins; zero if a class has no URL.
    """
    bins = scored.where("ruled is not null").groupBy(F.greatest(F.lit(-TOP_BIN), F.least(F.lit(TOP_BIN), F.floor(F.col("score") / BIN))).alias("bin")).agg(
        F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")).orderBy("bin").collect()
    n_a, n_b = sum(r.a for r in bins), sum(r.b for r in bins)
    if not n_a or not n_b:
        return 0.0
    lost, kept, best, below = 0, n_b, [], bins[0].bin
    for r in bins:
        at = (below + r.bin) / 2 * BIN
        best.append((round(lost / n_a + kept / n_b, 9), abs(at), at))
        lost, kept, below = lost + r.a, kept - r.b, r.bin + 1
    return min(best)[2]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], keep: Sequence[str] = ("page_id",), url_column: str = "url") -> DataFrame:
    """``keep``, host, path, rule, verdict (allow or block) and score, one row per row of ``pages``.

    NULL urls and urls without ``://`` have empty host and path, fit no rule and are scored as they are (an empty or NULL
    url scores zero). Each distinct url counts once in the models and the threshold, however many rows have it. Without labelled URLs of both classes every score is compared with zero, which allows ties.
    """
    ruled = apply_rules(pages.select(*keep, F.col(url_column).alias("url")), rules)
    text = F.when(F.instr("url", "://") > 0, url_rest(F.col("url"))).otherwise(F.coalesce("url", F.lit("")))
    ruled = ruled.withColumn("symbols", F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^\x20-\x7e]", OTHER))
    urls = ruled.select("url", "symbols", "ruled").where("symbols <> ''").distinct()
    weights = ratio_weights(urls.select("symbols", "ruled"))
    # at most ALPHABET^3 short rows, so every task can hold the weights
    scored = materialise(_grams(urls).join(F.broadcast(weights), "gram").groupBy("url", "ruled").agg(F.avg("weight").alias("score")), "url_scores")
    limit = calibrate(scored)
    out = ruled.join(scored.select(F.col("url").alias("__url"), "score"), F.col("url") == F.col("__url"), "left")
    score = F.coalesce("score", F.lit(0.0))
    return out.select(*keep, "host", "path", "rule", F.coalesce("ruled", F.when(score >= limit, "allow").otherwise("block")).alias("verdict"), score.alias("score"))
