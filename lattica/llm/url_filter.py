"""URL filter by rules and link-graph propagation.

Rules judge the urls that they fit.  For all other urls, trust flows from allowed seed hosts along links
(personalised PageRank), and distrust from blocked seed hosts against them, as who links to a bad host is
suspect.  Both run in one loop over host edges in Spark, until the scores settle; an url without a rule is
blocked where the distrust that its host receives is above the trust that it receives, times a margin.

Seeds: all urls that are known of a host count, those of pages and those of link targets, so that hosts that
were never crawled are seeds too.  A host is a seed of a kind by the share of its urls that rules of this
kind fit: a rule for a whole host gives 1, a rule for a folder what part of the host lies in the folder.
What a host restarts with itself is never held for or against its urls without a rule, only what links bring.

Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; path: then up to `?`, `#` or end.
Links are the absolute (or `//`) targets of `href` in `<a>` tags; a tag ends at the next `<` or `>`.
Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule and is allowed;
null pages have no links; repeated pages add to the weight of their links; an empty table gives no rows;
relative links stay on their host and add no edge; very long pages take time in proportion to their length;
extra columns pass through; a host on which both kinds are alike is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rounds go on while four of them change the scores of all hosts together by more than this, or reach a new host.
TOLERANCE = 1e-9
TAG = r"(?i)<a\s[^<>]*"
HREF = r"""(?i)[\s"']href\s*=\s*["']?((?:https?:)?//[^"'\s<>]+)"""


def host_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    return common.lower_ascii(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules):
    """The longest rule that fits, or null.  Rules are a short list that becomes one expression."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, begin = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begin)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def links_of(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, path, n): link targets on other hosts by host and path, summed before they shuffle."""
    tags = F.regexp_extract_all(F.coalesce(common.col(html_col), F.lit("")), F.lit(TAG), F.lit(0))
    out = pages.where((F.col("host") != "") & common.col(html_col).contains("//")).select(F.col("host").alias("src"), F.explode(tags).alias("tag"))
    out = out.select("src", F.regexp_extract("tag", HREF, 1).alias("url")).where("url <> ''")
    full = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    out = out.select("src", host_of(full).alias("dst"), path_of(full).alias("path")).where("dst <> '' and src <> dst")
    return out.groupBy("src", "dst", "path").agg(F.count("*").alias("n"))


def seeds_of(pages: DataFrame, links: DataFrame, rules) -> DataFrame:
    """(kind, host, weight): by the share of a host's known urls that rules of the kind fit."""
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    known = pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")).unionByName(links.select(F.col("dst").alias("host"), "path", "n"))
    known = known.select("host", "n", verdicts[rule_of(F.col("host"), F.col("path"), rules)].alias("v"))
    judged = known.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))])
    return judged.select("host", F.explode(F.create_map(*[x for k in ("trust", "distrust") for x in (F.lit(k), F.col(k) / F.col("n"))])).alias("kind", "weight")).where("weight > 0")


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, cut_every: int = 4) -> DataFrame:
    """(kind, host, score, received): PageRank that restarts at the seeds of each kind by weight.

    `edges(kind, src, dst, n)` and `seeds(kind, host, weight)`.  Mass of hosts without an edge goes back to the
    seeds with the rest, so only hosts within reach of a seed have a row; scores of a kind sum to 1 at most.
    `received` is the part of a score that came over edges.  Without a number of `rounds` it ends when
    `cut_every` of them reached no new host and changed the scores by TOLERANCE in sum at most; with one, hosts
    that are further from a seed have no row.
    """
    outs = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = common.written(edges.join(outs, ["kind", "src"]).select(F.col("kind").alias("way"), "src", "dst", (F.col("n") / F.col("all")).alias("share")), "links")
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))  # two rows at most
    start = common.written(seeds.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("score")), "seeds")
    restart = start.select("kind", "host", ((1 - damping) * F.col("score")).alias("score"), F.lit(0.0).alias("received"))
    if shares.isEmpty():
        return restart
    ranks = last = start.withColumn("received", F.lit(0.0))
    i = 0
    while rounds is None or i < rounds:
        i += 1
        flow = ranks.join(shares, (F.col("kind") == F.col("way")) & (F.col("host") == F.col("src"))).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        both = flow.withColumn("received", F.col("score")).unionByName(restart)
        ranks = both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("received").alias("received"))
        if i % cut_every == 0 or i == rounds:
            ranks = ranks.checkpoint()
            if rounds is None:
                old = last.select(F.col("kind").alias("_k"), F.col("host").alias("_h"), F.col("score").alias("old"))
                both = ranks.join(old, (F.col("kind") == F.col("_k")) & (F.col("host") == F.col("_h")), "left")
                # Hosts that are reached stay reached, as seeds send their mass in each round.
                change = both.agg(F.count_if(F.col("old").isNull()).alias("new"), F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))).alias("by")).first()
                if not change.new and (change.by or 0.0) <= TOLERANCE:
                    break
                last = ranks
    return ranks


def filter_urls(pages: DataFrame, rules=RULES, *, url_col: str = "url", html_col: str = "html", margin: float = 1.0, rounds: int | None = None) -> DataFrame:
    """`pages` with host, path, rule, trust, distrust (whole scores) and verdict (`allow` or `block`)."""
    common.shared_dir(pages.sparkSession)
    base = common.drop_columns(pages, ["host", "path", "rule", "trust", "distrust", "verdict"])
    host, own, by = common.fresh(base.columns, "of_host", "received_trust", "received_distrust")
    base = base.withColumn("host", host_of(common.col(url_col))).withColumn("path", path_of(common.col(url_col)))
    links = common.written(links_of(base, html_col), "targets")
    between = links.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = between.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(between.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = propagate(edges, seeds_of(base, links, rules), rounds=rounds)
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0.0))
    scores = ranks.groupBy(F.col("host").alias(host)).agg(of("trust", "score").alias("trust"), of("distrust", "score").alias("distrust"), of("trust", "received").alias(own), of("distrust", "received").alias(by))
    # Written, so that its size is known: Spark broadcasts it below its threshold, else it splits skewed hosts.
    out = base.join(common.written(scores, "scores"), F.col("host") == F.col(host), "left").drop(host)
    out = out.fillna(0.0, ["trust", "distrust", own, by]).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    judged = F.when(F.col(by) > margin * F.col(own), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(verdicts[F.col("rule")], judged)).select(*map(common.col, common.drop_columns(pages, ["host", "path", "rule", "trust", "distrust", "verdict"]).columns), "host", "path", "rule", "trust", "distrust", "verdict")


def op3_link_propagation(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


#: 300 rounds, after which 0.85 ** 300 of the mass is open.
SQL = r"""
with recursive rules(v, rule, h, pre) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
p as (select page_id, translate(regexp_extract(coalesce(u, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(coalesce(u, ''), '^[^/?#]*([^?#]*)', 1) path, html
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end u, html from pages)),
tags as (select host src, unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*', 0)) tag from p where host <> ''),
urls as (select src, regexp_extract(tag, '(?i)[\s"'']href\s*=\s*["'']?(?:https?:)?//([^"''\s<>]+)', 1) u from tags),
links as (select * from (select src, translate(regexp_extract(u, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') dst, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) path from urls) where dst <> '' and dst <> src),
known as (select host, path, count(*) n from (select host, path from p where host <> '' union all select dst, path from links) x group by host, path),
fits as (select host, path, n, (select arg_max(v || ' ' || rule, length(rule)) from rules where (k.host = h or ends_with(k.host, '.' || h)) and starts_with(k.path, pre)) f from known k),
share as (select host, sum(n) filter (f like 'allow %') / sum(n) a, sum(n) filter (f like 'block %') / sum(n) b from fits group by host),
seeds as (select kind, host, w / sum(w) over (partition by kind) s from (select host, 'trust' kind, a w from share union all select host, 'distrust', b from share) where w > 0),
e0 as (select 'trust' kind, src, dst from links union all select 'distrust', dst, src from links),
e1 as (select kind, src, dst, count(*) c from e0 group by kind, src, dst),
e as (select kind, src, dst, c / sum(c) over (partition by kind, src) share from e1),
r(i, kind, host, score, got) as (select 0, kind, host, s, 0.0::double from seeds union all
  select i, kind, host, sum(score), sum(got) from (
    select r.i + 1 i, r.kind, e.dst host, 0.85 * r.score * e.share score, 0.85 * r.score * e.share got from r join e on e.kind = r.kind and e.src = r.host where r.i < 300
    union all select x.i + 1, s.kind, s.host, 0.15 * s.s, 0.0::double from seeds s, (select distinct i from r where i < 300) x) group by i, kind, host),
got as (select host, coalesce(sum(got) filter (kind = 'trust'), 0) t, coalesce(sum(got) filter (kind = 'distrust'), 0) d from r where i = 300 group by host)
select page_id, p.host, p.path, substr(f, 7) as rule, coalesce(substr(f, 1, 5), case when d > t then 'block' else 'allow' end) verdict
from p left join fits on fits.host = p.host and fits.path = p.path left join got on got.host = p.host
"""
