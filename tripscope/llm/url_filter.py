"""URL filters: fixed host and path rules first, association rules over URL tokens for the rest.

A fixed rule names a host, with all its subdomains, and the start of a path; the longest that fits decides. URLs that none fits are judged
by association rules: a URL is the set of its tokens (scheme, words of the host, words of the path, query keys), Spark's FP-growth finds
the token combinations that are frequent among labelled URLs, and a combination becomes a rule "these tokens: block" where enough labelled
URLs hold it, most of them are bad, and it is surer than every combination with one token less. Rules are matched by an inverted index:
each is listed under its rarest token only, so a URL meets the few rules of its own tokens and checks their other tokens in place.
Only DataFrame functions and ``pyspark.ml``.

What fitting reads is bounded by documented parameters of ``Mining``; judging covers every row.

Defined cases: a null URL or one without ``://`` has an empty host and path, no tokens and is allowed; ids may be null or repeat, each row
gets its own verdict; label rows that repeat an id are one label (bad if any is), labels without a page and pages without a label teach
nothing; without labels there are no association rules; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripscope.llm.common import table, written
from tripscope.plans.registry import Book

BOOK = Book()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Association rules are broadcast up to this many (well below 10 MB) and joined by shuffle beyond it.
BROADCAST_RULES = 20_000
#: Fixed rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_BAD = "=block"


class Mining(NamedTuple):
    """Bounds and thresholds of the fit."""

    min_count: int = 8  # bad labelled URLs that hold a combination, at least
    one_in: int = 1000  # the same as one in so many of all labelled URLs; the greater of both holds
    confidence_percent: int = 50  # bad ones among the labelled URLs that hold it, at least
    common_percent: int = 90  # a token of more labelled URLs than this tells nothing and is left out
    max_items: int = 12  # tokens of one URL that take part, those with the highest share of bad URLs first: sets of n have 2^n subsets
    max_rows: int = 1_000_000  # labelled URLs the fit reads, about; all if fewer


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null; of equally long ones the first."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)

    longest = sorted(rules, key=lambda r: -len(r[1]))
    return F.coalesce(*[F.when(fits(rule), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))) for verdict, rule in longest])


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, sorted; a run of digits that is a whole word is ``#``."""
    url = F.coalesce(url, F.lit(""))

    def words(kind: str, text: Column, gap: str) -> Column:
        found = F.filter(F.split(F.translate(text, _UPPER, _LOWER), gap), lambda w: w != "")
        return F.transform(found, lambda w: F.concat(F.lit(kind + ":"), F.when(w.rlike(r"^[0-9]+\z"), F.lit("#")).otherwise(w)))

    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "[&;]"), lambda p: F.substring_index(p, "=", 1))
    every = F.concat(
        words("scheme", F.regexp_extract(url, "(?s)^(.*?)://", 1), "[^0-9A-Za-z+.-]+"), words("host", host_of(url), "[.:@-]+"),
        words("path", path_of(url), "[/._-]+"), words("query", F.array_join(keys, "&"), "&+"),
    )
    return F.array_sort(F.array_distinct(every))


def labelled_urls(pages: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(tokens, bad): each labelled URL once per class it was labelled with."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce(F.col("toxic") == 1, F.lit(False))) | (F.coalesce(F.col("quality") == 0, F.lit(False)))).alias("bad"))
    urls = pages.join(known, pages["page_id"] == known["doc_id"]).filter("url IS NOT NULL").select("url", "bad").distinct()
    taught = written(urls.select(tokens_of(F.col("url")).alias("tokens"), "bad", F.pmod(F.xxhash64("url"), F.lit(1 << 20)).alias("lot")), "labelled")
    n = taught.count()
    # A bounded sample by hash of the URL, the same in every run; only the fit reads it.
    return (taught if n <= max_rows else taught.filter(F.col("lot") < (1 << 20) * max_rows // n)).drop("lot")


def association_rules(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(tokens, anchor, n, n_bad, confidence) of the rules for a block, from ``labelled(tokens, bad)``."""
    spark = labelled.sparkSession
    n_rows, n_bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    least = max(how.min_count, -(-n_rows // how.one_in))
    if least > n_rows:
        return spark.createDataFrame([], "tokens array<string>, anchor string, n long, n_bad long, confidence double")
    counts = labelled.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    useful = written(counts.filter((F.col("n_bad") >= least) & (100 * F.col("n") <= how.common_percent * n_rows)), "url-tokens")
    numbered = labelled.withColumn("row", F.monotonically_increasing_id())
    told = numbered.select("row", "bad", F.explode("tokens").alias("token")).join(useful, "token")
    # Per URL the tokens with the highest share of bad ones; a URL has few tokens, so its list is short.
    ranked = told.groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_bad") / F.col("n")).alias("share"), "token"))).alias("all"))
    items = F.transform(F.slice("all", 1, how.max_items), lambda t: t["token"])
    baskets = ranked.select(F.when(F.col("bad"), F.array_append(items, F.lit(_BAD))).otherwise(items).alias("items"))
    baskets = written(baskets, "baskets")
    n_baskets = baskets.count()
    if least > n_baskets:
        return spark.createDataFrame([], "tokens array<string>, anchor string, n long, n_bad long, confidence double")
    # Half a basket below the count, so that rounding of the share cannot lift the threshold.
    mined = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_baskets).fit(baskets).freqItemsets
    sets = written(mined.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = sets.filter(F.array_contains("items", _BAD)).select(F.array_remove("items", _BAD).alias("tokens"), F.col("freq").alias("n_bad")).filter(F.size("tokens") > 0)
    measured = written(
        with_bad.join(sets.select(F.col("items").alias("tokens"), F.col("freq").alias("n")), "tokens").withColumn("confidence", F.col("n_bad") / F.col("n")), "measured"
    )
    shorter = measured.filter(F.size("tokens") > 1).select("tokens", F.explode("tokens").alias("left_out")).withColumn("sub", F.array_remove("tokens", F.col("left_out")))
    below = shorter.join(measured.select(F.col("tokens").alias("sub"), F.col("confidence").alias("sure")), "sub").groupBy("tokens").agg(F.max("sure").alias("sure"))
    best = measured.filter(100 * F.col("n_bad") >= how.confidence_percent * F.col("n")).join(below, "tokens", "left")
    kept = best.filter(F.col("confidence") > F.coalesce("sure", F.lit(n_bad / n_rows)))
    rarest = kept.select("tokens", F.explode("tokens").alias("token")).join(useful.select("token", F.col("n").alias("seen")), "token").groupBy("tokens").agg(F.min(F.struct("seen", "token"))["token"].alias("anchor"))
    return written(kept.join(rarest, "tokens").select("tokens", "anchor", "n", "n_bad", "confidence"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, token_rule) for those of the distinct ``urls(url)`` that some rule matches: the surest rule, then the one seen most often."""
    index = rules.select("anchor", F.col("tokens").alias("needs"), "confidence", "n_bad")
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    posted = urls.select("url", tokens_of(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("anchor"))
    hits = posted.join(index, "anchor").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", "n_bad", F.array_join("needs", " ").alias("rule")))["rule"]
    return hits.groupBy("url").agg(best.alias("token_rule"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, how: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict, token_rule) per row of ``pages``."""
    mined = association_rules(labelled_urls(pages, labels, how.max_rows), how)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), fixed_rule(host, path, rules).alias("fixed"))
    # Written before the join, so that a URL of many pages is a hot key on one side only, which Spark can split.
    found = written(matched(rows.filter("fixed IS NULL AND url IS NOT NULL").select("url").distinct(), mined), "url-matches")
    joined = rows.alias("p").join(found.alias("f"), (F.col("p.url") == F.col("f.url")) & F.col("p.fixed").isNull(), "left")
    by_tokens = F.when(F.col("f.token_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "p.page_id", "p.host", "p.path", F.col("p.fixed.rule").alias("rule"), F.coalesce(F.col("p.fixed.verdict"), by_tokens).alias("verdict"), F.col("f.token_rule").alias("token_rule")
    )


def _sql_words(kind: str, words: str) -> str:
    return (
        f"list_transform(list_filter({words}, lambda w: w <> ''), lambda w: '{kind}:' || CASE WHEN regexp_matches(w, '^[0-9]+\\z') THEN '#' ELSE w END)"
    )


def _sql_lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _sql_split(text: str, gap: str) -> str:
    return f"string_split_regex({_sql_lower(text)}, '{gap}')"


def sql_of(how: Mining) -> str:
    """The same in SQL that lists every subset of a URL's tokens, for small tables; it reads all labelled URLs."""
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, url IS NULL AS missing FROM pages),
p AS (SELECT *, {_sql_lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
urls AS (SELECT DISTINCT url, host, path FROM p WHERE NOT missing),
t AS (SELECT url, list_sort(list_distinct(
        {_sql_words("scheme", _sql_split("regexp_extract(url, '(?s)^(.*?)://', 1)", "[^0-9A-Za-z+.-]+"))} || {_sql_words("host", _sql_split("host", "[.:@-]+"))}
        || {_sql_words("path", _sql_split("path", "[/._-]+"))}
        || {_sql_words("query", "list_transform(string_split_regex(" + _sql_lower(r"regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1)") + ", '[&;]'), lambda k: split_part(k, '=', 1))")})) AS tokens
    FROM urls),
known AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
taught AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT url, bad, tokens FROM p JOIN known ON page_id = doc_id JOIN t USING (url) WHERE NOT missing)),
size AS (SELECT count(*) AS n_rows, count(*) FILTER (bad) AS bad_rows, greatest({how.min_count}, (count(*) + {how.one_in - 1}) // {how.one_in}) AS least FROM taught),
told AS (SELECT r, bad, unnest(tokens) AS token FROM taught),
useful AS (SELECT token, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM told GROUP BY token
    HAVING count(*) FILTER (bad) >= (SELECT least FROM size) AND 100 * count(*) <= {how.common_percent} * (SELECT n_rows FROM size)),
placed AS (SELECT r, bad, token, row_number() OVER (PARTITION BY r ORDER BY -(n_bad::DOUBLE / n), token) AS place FROM told JOIN useful USING (token)),
basket AS (SELECT r, bad, list(token ORDER BY token) AS items FROM placed WHERE place <= {how.max_items} GROUP BY ALL),
subsets AS (SELECT bad, list_filter(items, lambda x, i: (s >> (i - 1)::INT) & 1 = 1) AS tokens FROM (SELECT bad, items, unnest(range(1, 1 << len(items)::INT)) AS s FROM basket)),
measured AS (SELECT tokens, count(*) AS n, count(*) FILTER (bad) AS n_bad, (count(*) FILTER (bad))::DOUBLE / count(*) AS confidence
    FROM subsets GROUP BY tokens HAVING count(*) FILTER (bad) >= (SELECT least FROM size)),
below AS (SELECT m.tokens, max(s.confidence) AS sure FROM (SELECT tokens, unnest(tokens) AS gone FROM measured WHERE len(tokens) > 1) m
    JOIN measured s ON s.tokens = list_filter(m.tokens, lambda x: x <> gone) GROUP BY 1),
rules AS (SELECT measured.* FROM measured LEFT JOIN (SELECT tokens AS same, sure FROM below) ON same = tokens, size
    WHERE 100 * n_bad >= {how.confidence_percent} * n AND confidence > coalesce(sure, bad_rows::DOUBLE / n_rows)),
fixed AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}) f(verdict, rule, name, start)),
best_fixed AS (SELECT url, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule
    FROM urls JOIN fixed ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY url),
hit AS (SELECT url, array_to_string(r.tokens, ' ') AS token_rule, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, n_bad DESC, array_to_string(r.tokens, ' ') DESC) AS place
    FROM t JOIN rules r ON list_has_all(t.tokens, r.tokens) WHERE url NOT IN (SELECT url FROM best_fixed))
SELECT page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN h.token_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, h.token_rule
FROM p LEFT JOIN best_fixed b ON b.url = p.url AND NOT missing LEFT JOIN hit h ON h.url = p.url AND h.place = 1 AND NOT missing
"""


@BOOK.query("op13_url_filter", sql_of(Mining()))
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules, else of rules mined from ``labels``, for every URL of ``pages``."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
