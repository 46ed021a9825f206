"""Operator 5, URL filters by rules and by link-graph propagation. DataFrame functions only.

Rules (host suffix, path prefix, action) judge the URLs they fit; the longest wins. Hosts pass judgement on the rest: the share of a
host's pages that rules allow is its trust seed, the share that they block its distrust seed. Personalised PageRank carries trust along the links between
hosts and distrust against them, both in one join and one aggregate per round, in whole numbers (units of 1 / SCALE), so results don't depend
on the order of sums. Rounds begin with RESTART of the seeds, by which masses only grow, and go on until less than TOLERANCE of all mass changes in four. A host is blocked if its
distrust reaches ``least`` and is more than ``ratio`` times its trust.

Links are aggregated to distinct host pairs before anything is joined; the edges of a hub are dealt out over salts, to each of which its rank is sent, so no
task holds all of them; pages meet their host's verdict in a join that survives hot hosts.

Cases: a null URL, or one without ``://``, has an empty host and path; null html has no links; hosts without seeds or links are allowed; a null id is
kept; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import MOST_HOT, PER_TASK, cut, lower_ascii, spread_lookup

# The contract's rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SCALE = 10**12
#: Chance in a hundred of starting anew at a seed.
RESTART = 15
RATIO = 2
LEAST = SCALE * RESTART // 400
#: Sum of all hosts' changes below which ranks are settled, and the rounds (a multiple of four) in which they must be.
TOLERANCE = LEAST // 1000
MOST_ROUNDS = 400
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(raw), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int | None = None) -> Column:
    """The longest fitting rule's text, or its action with ``what`` = 2; null if none fits."""
    out = []
    for rule in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out.append(F.when(fits, rule[0] + rule[1] if what is None else rule[what]))
    return F.coalesce(*out, F.lit(None).cast("string"))


def links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)))).alias("dst"))
    found = found.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> dst and src <> ''")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def _total(rank: DataFrame) -> int:
    return int(rank.agg(F.sum(F.col("mass").cast("decimal(38,0)")).alias("n")).first()["n"] or 0)


def propagate(seeds: DataFrame, edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(host, trust, distrust) of every host in ``seeds`` (host, trust, distrust) and ``edges`` (src, dst; distinct).

    Ranks that don't settle in MOST_ROUNDS raise an error.
    """
    # Kind 1 follows links, kind 0 goes against them.
    ways = edges.select(F.lit(1).alias("kind"), "src", "dst").unionByName(edges.select(F.lit(0).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = ways.select(F.struct("kind", F.col("src").alias("host")).alias("at"), "kind", "dst")
    out = cut(ways.groupBy("at").agg(F.count(F.lit(1)).alias("deg")))
    n = out.agg(F.sum("deg").alias("n")).first()["n"] or 0
    base = seeds.select("host", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit(0).alias("kind"), F.col("distrust").alias("seed")))).alias("s"))
    start = cut(base.select(F.struct("s.kind", "host").alias("at"), F.expr(f"{RESTART} * s.seed div 100").alias("given")).filter("given > 0"))
    rank = start.select("at", F.col("given").alias("mass"))
    if n:
        # A hub has more edges than a task's share. A share is at least 1/MOST_HOT of all edges, so there are at most MOST_HOT hubs.
        share = max(per_task, n // MOST_HOT)
        salts = F.ceil(F.col("deg") / share).cast("int")
        hubs = F.broadcast(cut(out.filter(salts > 1).select(F.col("at").alias("_hub"), salts.alias("_salts"))))
        ways = spread_lookup(ways, out, "at", "deg", "dst", ["deg"]).join(hubs, F.col("at") == F.col("_hub"), "left")
        ways = cut(ways.select("at", "kind", "dst", "deg", F.pmod(F.xxhash64("dst"), F.coalesce("_salts", F.lit(1)).cast("long")).alias("salt")))
        before = _total(rank)
        for i in range(MOST_ROUNDS):
            sent = rank.join(hubs, F.col("at") == F.col("_hub"), "left").select("at", "mass", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)).alias("salt"))
            flow = sent.join(ways, ["at", "salt"]).select(F.struct("kind", F.col("dst").alias("host")).alias("at"), F.expr("mass div deg").alias("m"))
            moved = flow.groupBy("at").agg(F.sum("m").alias("m")).select("at", F.expr(f"{100 - RESTART} * m div 100").alias("m"))
            rank = moved.unionByName(start.select("at", F.col("given").alias("m"))).groupBy("at").agg(F.sum("m").alias("mass"))
            if i % 4 == 3:
                rank = cut(rank)
                now = _total(rank)
                if now - before < TOLERANCE:
                    break
                before = now
        else:
            raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    mass = lambda kind: F.coalesce(F.sum(F.when(F.col("at.kind") == kind, F.col("mass"))), F.lit(0))
    return rank.groupBy("at.host").agg(mass(1).alias("trust"), mass(0).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the host's ``trust`` and ``distrust``."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = cut(rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("said", longest_rule(F.col("host"), F.col("path"), rules, 2)).withColumn("row_id", F.monotonically_increasing_id()))
    edges = cut(links(pages.select(host.alias("host"), F.col(html_col).alias("html")), "host", "html"))
    hosts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")))
    seeds = hosts.select("host", F.expr(f"{SCALE} * good div n").alias("trust"), F.expr(f"{SCALE} * bad div n").alias("distrust"))
    ranks = propagate(seeds, edges)
    known = cut(hosts.join(ranks, "host", "left").select("host", "n", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust")))
    rows = spread_lookup(rows, known, "host", "n", "row_id", ["trust", "distrust"])
    blocked = (F.col("distrust") >= least) & (F.col("distrust") > ratio * F.col("trust"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
