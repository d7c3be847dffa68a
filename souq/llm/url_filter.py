"""URL filter by a character language-model ratio (operator 2), DataFrame functions only.

Host and path rules judge the URLs they fit.  The judged URLs train two
variable-order Markov models over characters, one of accepted and one of
rejected URLs, smoothed by interpolation with shorter contexts (the weight of
a context's own counts grows with its observations and falls with the number
of characters seen after it).  All other URLs are judged by the difference of
their log-likelihoods per character, against a threshold calibrated on judged
URLs that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, persist_shared, table
from .decontaminate import LOWER, UPPER

#: the rules of the registered query: host, path, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 5          # characters of the longest gram: four of context and the next one
START = "\x02"     # padding before the first character
UNIT = 1_000_000   # log-ratios are summed as whole millionths, so sums do not depend on the order
STEP = 1_000       # score bins per unit when the threshold is calibrated


def host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    part = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, part).otherwise("")


def path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, after).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null when none fits)."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _grams(url: str) -> Column:
    """The gram that ends at each character; none for an empty or null URL."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col(url))
    return F.when(F.length(url) > 0, F.transform(
        F.sequence(F.lit(1), F.length(url)), lambda i: F.substr(padded, i, F.lit(ORDER))))


def _fold(url: str, folds: int) -> Column:
    return F.conv(F.substring(F.md5(url), 1, 7), 16, 10).cast("long") % folds


def log_ratios(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for every wanted gram: ln P(accepted) - ln P(rejected) in whole millionths.

    ``train`` has (gram, a, r): how often accepted and rejected URLs have it.
    Counts of shorter grams are sums over the longest ones, so the URLs are
    counted once.
    """
    p = wanted.select("gram")
    for k in range(1, ORDER + 1):
        grams = train.groupBy(F.right("gram", F.lit(k)).alias(f"g{k}")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        grams = persist_shared(grams)
        context = grams.groupBy(F.substring(f"g{k}", 1, k - 1).alias("ctx")).agg(
            *[x for c in "ar" for x in (F.sum(c).alias(f"n_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}"))])
        if k == 1:
            # below the shortest context every character seen in training, and one unseen, are alike
            even = F.lit(1.0 / (grams.count() + 1))
            p = p.select("gram", even.alias("p_a"), even.alias("p_r"))
        n = p.withColumn(f"g{k}", F.right("gram", F.lit(k))).withColumn("ctx", F.substring(F.col(f"g{k}"), 1, k - 1)) \
            .join(grams, f"g{k}", "left").join(context, "ctx", "left")
        p = n.select("gram", *[
            F.when(F.coalesce(F.col(f"n_{c}"), F.lit(0)) == 0, F.col(f"p_{c}"))
            .otherwise((F.coalesce(c, F.lit(0)) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
            .alias(f"p_{c}") for c in "ar"])
    return p.select("gram", F.round((F.log("p_a") - F.log("p_r")) * UNIT).cast("long").alias("ratio"))


def threshold_of(scores: DataFrame) -> float:
    """Where accepted (label 1) and rejected (0) scores part best, from (score, label).

    Scores are put into bins of 1/1000, some thousand rows whatever the
    corpus.  The bin that keeps the largest share of accepted plus the largest
    share of rejected on its sides wins, the lowest on ties; the threshold
    lies midway between it and the next occupied bin below.
    """
    bins = scores.groupBy(F.floor(F.col("score") * STEP).alias("bin")).agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("r"))
    order, everything = Window.orderBy("bin"), Window.partitionBy()
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    share = [(1 - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(everything), F.lit(1))),
             F.coalesce(F.sum("r").over(below), F.lit(0)) / F.greatest(F.sum("r").over(everything), F.lit(1))]
    best = bins.select("bin", F.lag("bin").over(order).alias("before"), (share[0] + share[1]).alias("gain")) \
        .orderBy(F.desc("gain"), "bin").limit(1).collect()
    if not best:
        return 0.0
    b = best[0]
    return (b.bin if b.before is None else (b.bin + b.before + 1) / 2) / STEP


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, folds: int = 5) -> DataFrame:
    """Verdict on every page's URL: page_id, host, path, rule, verdict, score.

    ``pages`` has page_id and url; other columns are ignored.  One fold of the
    judged URLs, by a digest of the URL, is kept from training and calibrates
    the threshold (``threshold_of``).  ``score`` is the log-likelihood
    difference per character (null where a rule decided).

    Defined cases: a null URL, or one without ``://``, has empty host and path
    and fits no rule; null and empty URLs have score 0 and are allowed;
    repeated URLs train once and every row gets its verdict; a null page_id is
    kept; without judged URLs of one kind the ratio rests on the other model's
    smoothing, without any the score is 0; without held-out URLs the threshold
    is 0; an empty table gives an empty result.
    """
    page = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    page = page.select("*", name.alias("rule"), verdict.alias("by_rule"))
    # each URL once: a URL on a third of all pages is one row, combined map-side
    urls = page.where(F.length("url") > 0).groupBy("url").agg(F.any_value("by_rule").alias("by_rule")) \
        .withColumn("held", _fold("url", folds) == 0)
    urls = persist_shared(urls)
    train = persist_shared(
        urls.where("by_rule is not null and not held").select(F.explode(_grams("url")).alias("gram"), "by_rule")
        .groupBy("gram").agg(F.sum((F.col("by_rule") == "allow").cast("long")).alias("a"),
                             F.sum((F.col("by_rule") == "block").cast("long")).alias("r")))
    open_ = urls.where("by_rule is null or held") \
        .select("url", "by_rule", F.explode(_grams("url")).alias("gram"))
    ratio = persist_shared(log_ratios(train, open_.select("gram").distinct()))
    scores = persist_shared(
        open_.join(checked_broadcast(ratio), "gram").groupBy("url", "by_rule")
        .agg((F.sum("ratio") / F.count(F.lit(1)) / UNIT).alias("score")))
    threshold = threshold_of(scores.where("by_rule is not null")
                             .select("score", (F.col("by_rule") == "allow").cast("int").alias("label")))
    rest = scores.where("by_rule is null").select("url", "score")
    return page.join(rest, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("score") < threshold, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))).alias("score"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over the URLs of all pages."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


def _level_sql(k: int) -> str:
    """The model of grams of k characters over the one of k - 1 (a and r: accepted and rejected)."""
    part = ", ".join(
        f"CASE WHEN coalesce(c.n_{c}, 0) = 0 THEN p.p_{c} "
        f"ELSE (coalesce(g.{c}, 0) + c.t_{c} * p.p_{c}) / (c.n_{c} + c.t_{c}) END AS p_{c}" for c in "ar")
    return f"""
g{k} AS (SELECT right(gram, {k}) AS g, sum(a) AS a, sum(r) AS r FROM train GROUP BY 1),
c{k} AS (SELECT left(g, {k - 1}) AS ctx, sum(a) AS n_a, sum(r) AS n_r, count(*) FILTER (a > 0) AS t_a,
                count(*) FILTER (r > 0) AS t_r FROM g{k} GROUP BY 1),
p{k} AS (SELECT p.gram, {part}
         FROM p{k - 1} p LEFT JOIN g{k} g ON g.g = right(p.gram, {k})
         LEFT JOIN c{k} c ON c.ctx = left(right(p.gram, {k}), {k - 1})),"""


OP2_SQL = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
page AS (
  SELECT *, (SELECT arg_max(h || p, length(h || p)) FROM rules
             WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
         (SELECT arg_max(v, length(h || p)) FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS by_rule
  FROM parts),
urls AS (
  SELECT DISTINCT url, by_rule, ('0x' || substr(md5(url), 1, 7))::BIGINT % 5 = 0 AS held,
         repeat(chr(2), 4) || url AS t
  FROM page WHERE length(url) > 0),
cut AS (SELECT url, by_rule, held, substr(t, i, 5) AS gram
        FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM urls)),
train AS (SELECT gram, sum((by_rule = 'allow')::BIGINT) AS a, sum((by_rule = 'block')::BIGINT) AS r
          FROM cut WHERE by_rule IS NOT NULL AND NOT held GROUP BY gram),
open_ AS (SELECT * FROM cut WHERE by_rule IS NULL OR held),
even AS (SELECT 1.0::DOUBLE / (count(DISTINCT right(gram, 1)) + 1) AS p FROM train),
p0 AS (SELECT gram, p AS p_a, p AS p_r FROM (SELECT DISTINCT gram FROM open_), even),""" + "".join(_level_sql(k) for k in range(1, ORDER + 1)) + r"""
ratio AS (SELECT gram, round((ln(p_a) - ln(p_r)) * 1000000)::BIGINT AS ratio FROM p5),
scores AS (SELECT url, by_rule, sum(ratio)::DOUBLE / count(*) / 1000000 AS score
           FROM open_ JOIN ratio USING (gram) GROUP BY url, by_rule),
bins AS (SELECT floor(score * 1000) AS bin, count_if(by_rule = 'allow') AS a, count_if(by_rule = 'block') AS r
         FROM scores WHERE by_rule IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, (SELECT max(y.bin) FROM bins y WHERE y.bin < x.bin) AS prior,
                 (1 - ifnull((SELECT sum(y.a) FROM bins y WHERE y.bin < x.bin), 0)::DOUBLE
                      / greatest((SELECT sum(a) FROM bins), 1))
                 + ifnull((SELECT sum(y.r) FROM bins y WHERE y.bin < x.bin), 0)::DOUBLE
                   / greatest((SELECT sum(r) FROM bins), 1) AS gain FROM bins x),
limits AS (SELECT ifnull((SELECT ifnull((bin + prior + 1) / 2, bin) / 1000 FROM gains ORDER BY gain DESC, bin LIMIT 1), 0)
             AS threshold)
SELECT page_id, host, path, rule,
       coalesce(page.by_rule, CASE WHEN score < (SELECT threshold FROM limits) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN coalesce(score, 0) END AS score
FROM page LEFT JOIN (SELECT url, score FROM scores WHERE by_rule IS NULL) s USING (url)
"""
