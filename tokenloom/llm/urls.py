"""URL filters: host and path rules first, then trust and distrust propagated over host links.

Native DataFrame functions only. Trusted hosts seed a personalised PageRank along links; blocked
hosts seed one against the links (who links to a blocked host is suspect). A page without a rule is
blocked when its host's distrust exceeds its trust by the threshold.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget

LOWER = (string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://" or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs, a rule being host/path, as a frame."""
    return spark.createDataFrame([(v, r, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules], "verdict string, rule string, rule_host string, rule_path string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each host with the rules of its own and its parent domains, longest first: (host, rules)."""
    labels = F.split("host", r"\.")
    parent = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(parent).alias("rule_host")).join(rules, "rule_host")
    rule = F.struct((-F.length("rule")).alias("short"), "rule", "rule_path", "verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_set(rule)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """Edges between hosts with the number of links: (src, dst, n). A relative link stays on its host."""
    href = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    to = F.when(F.col("href").startswith("//"), host_of(F.concat(F.lit("x:"), "href"))).when(F.col("href").rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), host_of(F.col("href"))).otherwise(F.col("host"))
    per_page = pages.select(host_of(F.col("url")).alias("host"), F.explode(href).alias("href"))
    return per_page.select(F.col("host").alias("src"), to.alias("dst")).filter("src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


DAMPING, TOLERANCE = 0.85, 1e-9


def most_rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which less than the tolerance of all trust can still move, whatever the graph."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, cut_every: int = 6) -> DataFrame:
    """Personalised PageRank of seeds (host, trust, distrust): (host, trust, distrust).

    Trust walks along links, distrust against them; each starts from its seeds, normalised to sum 1,
    and is damped. Rounds go on until all hosts together are within the tolerance of where they would end;
    this is looked at, and lineage cut, every few rounds. A host that no walk reaches has no row.
    """
    spark = links.sparkSession
    whole = seeds.agg(F.sum("trust").alias("all_t"), F.sum("distrust").alias("all_d"))
    start = seeds.crossJoin(F.broadcast(whole)).select(  # whole is one row
        "host",
        F.coalesce(F.col("trust") / F.nullif("all_t", F.lit(0)), F.lit(0.0)).alias("t"),
        F.coalesce(F.col("distrust") / F.nullif("all_d", F.lit(0)), F.lit(0.0)).alias("d"),
    )
    start, _ = cut(start)
    out = links.groupBy("src").agg(F.sum("n").alias("all_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all_in"))
    steps = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all_out")).alias("wt"), F.lit(0.0).alias("wd"))
    back = links.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("all_in")).alias("wd"))
    edges, edges_path = cut(steps.unionByName(back).groupBy("host", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd")))
    base = start.select("host", (F.col("t") * (1 - damping)).alias("t"), (F.col("d") * (1 - damping)).alias("d"))

    def moved(now: DataFrame) -> DataFrame:
        along = edges.join(now, "host").select(F.col("to").alias("host"), (F.col("t") * F.col("wt") * damping).alias("t"), (F.col("d") * F.col("wd") * damping).alias("d"))
        return along.unionByName(base).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))

    now, path = start, None
    for at in range(cut_every, most_rounds(damping, tolerance) + cut_every, cut_every):
        for _ in range(cut_every - 1):
            now = moved(now)
        last, last_path = cut(now)
        new, new_path = cut(moved(last))
        sides = new.unionByName(last.select("host", (-F.col("t")).alias("t"), (-F.col("d")).alias("d")))
        gap = sides.groupBy("host").agg(F.abs(F.sum("t")).alias("t"), F.abs(F.sum("d")).alias("d")).agg(F.greatest(F.sum("t"), F.sum("d"))).first()[0]
        for old in (path, last_path):
            if old:
                forget(spark, old)
        now, path = new, new_path
        # what is still to come is at most the last change, damped again and again
        if (gap or 0.0) * damping / (1 - damping) <= tolerance:
            break
    forget(spark, edges_path)
    return now.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def judge_urls(pages: DataFrame, rules: DataFrame, threshold: float = 0.0, tolerance: float = TOLERANCE) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust.

    A rule fits its host and all subdomains when the url's path starts with the rule's; the longest
    wins, ties by the rule's text. Without one the link graph decides: block if distrust - trust >
    threshold, else allow. A null or odd url has empty host and path, no rule, and is allowed. Rows
    stay as they are, repeated ones too; other columns are ignored. Hosts are joined once, so a
    host with very many pages is a skewed equi-join that adaptive execution splits.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counted = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    by_host, _ = cut(rules_by_host(counted.filter("host <> ''").select("host"), rules))
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), 0)
    ruled = rows.join(by_host, "host", "left").select("page_id", "host", "path", fit.alias("fit"))
    seeds = ruled.filter("fit IS NOT NULL").groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("trust"), F.count_if(F.col("fit.verdict") == "block").alias("distrust"))
    links, _ = cut(host_links(pages))
    scores = propagate(links, seeds, tolerance=tolerance)
    known = by_host.join(scores, "host", "full")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold, "block").otherwise("allow"))
    return rows.join(known, "host", "left").withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages, rules_frame(spark, RULES)).drop("trust", "distrust")


def rules_sql(rules: list[tuple[str, str]]) -> str:
    """The longest rule that fits a page with host and path."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r in (r[1] for r in longest) for h, _, p in [r.partition("/")])
    return "CASE " + " ".join(fits) + " END"


def propagation_sql(damping: float = DAMPING) -> str:
    """All rounds as one recursion: the nameless host, which no link has, gives the seeds their share again."""
    return f"""steps AS MATERIALIZED (
      SELECT src AS host, dst AS next, {damping} * n / all_out AS wt, 0.0 AS wd FROM links JOIN outs USING (src)
      UNION ALL SELECT dst, src, 0.0, {damping} * n / all_in FROM links JOIN ins USING (dst)
      UNION ALL SELECT '', host, (1 - {damping}) * t, (1 - {damping}) * d FROM start
      UNION ALL SELECT '', '', 1.0, 1.0),
    r AS (SELECT 0 AS i, host, t, d FROM (SELECT host, t, d FROM start UNION ALL SELECT '', 1.0, 1.0)
      UNION ALL SELECT i + 1, next, sum(t * wt), sum(d * wd) FROM r JOIN steps USING (host) WHERE i < {most_rounds()} GROUP BY i, next)"""


HOST_SQL = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), '" + LOWER[0] + "', '" + LOWER[1] + "')"
OP6_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, {HOST_SQL.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT *, {rules_sql(RULES)} AS rule FROM p),
v AS (SELECT *, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)} END AS ruled FROM f),
h AS (SELECT host, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM p),
links AS (SELECT host AS src, dst, count(*) AS n FROM (SELECT host, CASE WHEN starts_with(href, '//') THEN {HOST_SQL.format("'x:' || href")}
  WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.\-]*:') THEN {HOST_SQL.format("href")} ELSE host END AS dst FROM h) WHERE host <> '' AND dst <> '' GROUP BY ALL),
outs AS (SELECT src, sum(n) AS all_out FROM links GROUP BY src), ins AS (SELECT dst, sum(n) AS all_in FROM links GROUP BY dst),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS t, count(*) FILTER (ruled = 'block') AS d FROM v WHERE rule IS NOT NULL GROUP BY host),
start AS (SELECT host, coalesce(t / nullif((SELECT sum(t) FROM seeds), 0), 0)::DOUBLE AS t, coalesce(d / nullif((SELECT sum(d) FROM seeds), 0), 0)::DOUBLE AS d FROM seeds),
{propagation_sql()}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(d, 0) - coalesce(t, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN (SELECT host, t, d FROM r WHERE i = {most_rounds()} AND host <> '') USING (host)
"""
