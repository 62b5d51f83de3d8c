"""URL filters by trust and distrust that spread along links between hosts, with DataFrame functions only.

Rules decide the pages that they fit; the longest rule wins. Every other page gets its host's verdict: personalised PageRank runs from the hosts
of allowed pages along the links, and a second one from the hosts of blocked pages along the reversed links (a host that links to blocked pages is
suspect); a host is blocked where distrust is above trust. Edges are links to other hosts in the pages' HTML, and, where asked for, the steps
between a host and its parent domain.

Pages are read twice and shuffled never, but for their hosts: counts per host, edges and ranks are host-sized. Ranks are written to the shared
folder after each step.

Defined results: a null url or one without :// has empty host and path, fits no rule and is allowed; null HTML has no links; a repeated row stays
a row of its own; other columns are ignored; an empty table gives an empty result; hosts that no seed reaches are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import UPPER, Scratch, small

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.7
STEPS = 10
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. A short list: it travels within the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first, so it comes last here
        site, _, rest = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def edges_of(pages: DataFrame, sites: bool) -> DataFrame:
    """Distinct edges (src, dst) between different hosts."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))).alias("dst")).select(F.col("host").alias("src"), F.translate("dst", UPPER, UPPER.lower()).alias("dst"))
    if sites:
        hosts = pages.select("host").distinct().withColumn("l", F.split("host", r"\.")).where(F.size("l") > 2)
        ups = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - 2), lambda i: F.struct(F.array_join(F.slice("l", i, F.size("l")), ".").alias("a"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("b")))).alias("x")).select("x.a", "x.b")
        links = links.union(ups).union(ups.select("b", "a"))
    return links.where("src <> dst and src <> '' and dst <> ''").distinct()


def propagated(seeds: DataFrame, edges: DataFrame, scratch: Scratch, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad). Both walks run in one table, told apart by kind."""
    totals = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    start = seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("good") / F.lit(totals["good"] or 1.0), F.lit("d"), F.col("bad") / F.lit(totals["bad"] or 1.0))).alias("kind", "seed")).where("seed > 0")
    ways = edges.select(F.lit("t").alias("kind"), "src", "dst").union(edges.select(F.lit("d"), "dst", "src"))
    ways = scratch.cut(ways.join(ways.groupBy("kind", "src").agg(F.count("*").alias("degree")), ["kind", "src"]), "ways")
    start = scratch.cut(start, "start")
    ranks, held = start.withColumn("rank", F.col("seed")), None
    for k in range(steps):
        flow = ranks.join(ways, (ranks["host"] == ways["src"]) & (ranks["kind"] == ways["kind"])).groupBy(ways["kind"], F.col("dst").alias("host")).agg(F.sum(F.col("rank") / F.col("degree")).alias("flow"))
        stay = start.join(flow, ["host", "kind"], "full_outer").select("host", "kind", (F.coalesce("seed", F.lit(0.0)) * (1 - damping) + F.coalesce("flow", F.lit(0.0)) * damping).alias("rank"))
        ranks = scratch.cut(stay, f"ranks{k}")
        if held:
            scratch.drop(held)
        held = f"ranks{k}"
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def filtered(pages: DataFrame, rules=RULES, sites: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    scratch = Scratch(pages.sparkSession)
    url = F.col("url").cast("string")
    pages = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    judged = pages.withColumn("found", ruled(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.count_if(F.col("found.verdict") == verdict) / F.count("*")
    seeds = scratch.cut(judged.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")).where("host <> ''"), "seeds")
    edges = scratch.cut(edges_of(pages, sites), "edges")
    scored = scratch.cut(propagated(seeds, edges, scratch), "scored").withColumnRenamed("host", "h")
    out = judged.join(small(scored), F.col("host") == F.col("h"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("found.verdict", F.when(distrust > trust, "block").otherwise("allow"))
    scratch.close("scored")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
