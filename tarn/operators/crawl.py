"""Breadth-first crawls over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.urls import canonical, for_visit, host, links
from tarn.session import materialize

MAX_DEPTH, MAX_PAGES = 5, 200


def edges(pages: DataFrame, url: str = "url", html: str = "html", same_host: bool = True) -> DataFrame:
    """(src, dst): followable links between visits, without those to the page itself or its canonical address."""
    base = pages.select(F.col(url).alias("u"), for_visit(F.col(url)).alias("src"), for_visit(canonical(F.col(html), F.col(url))).alias("same"), F.explode(links(F.col(html), F.col(url))).alias("link"))
    found = base.select("src", "same", for_visit(F.col("link")).alias("dst"))
    found = found.where((F.col("dst") != F.col("src")) & ((F.col("same") == "") | (F.col("dst") != F.col("same"))))
    if same_host:
        found = found.where(host(F.col("src")) == host(F.col("dst")))
    return found.select("src", "dst").distinct()


def reach(links_: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, fetched: DataFrame | None = None) -> DataFrame:
    """(url, depth): what is visited from ``starts`` (url), each at its least depth.

    One join and one anti-join a level, ``depth`` levels at most; every
    level is written, so plans stay short.  With ``fetched`` (url), only pages
    that exist are visited.
    """
    front = starts.select(for_visit(F.col("url")).alias("url")).distinct()
    if fetched is not None:
        front = front.join(fetched.select("url").distinct(), "url", "left_semi")
    seen = materialize(front.withColumn("depth", F.lit(0)), "crawl")
    front = seen
    for level in range(1, depth + 1):
        step = front.join(links_, front["url"] == links_["src"]).select(F.col("dst").alias("url")).distinct()
        if fetched is not None:
            step = step.join(fetched.select("url").distinct(), "url", "left_semi")
        front = materialize(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(level)), "crawl")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def first_pages(visited: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """The pages that a crawl keeps: by depth, then address."""
    return visited.orderBy("depth", "url").limit(most)


def robot_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, place, allow, prefix) of robots files (host, body): the rules of the group that names the agent, else of the one for all."""
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("place", "raw")).select("host", "place", line.alias("line")).where("line <> ''")
    name, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    said = lines.where(F.contains("line", F.lit(":"))).select("host", "place", name.alias("name"), value.alias("value"))
    order = Window.partitionBy("host").orderBy("place")
    # agents named one after another share the rules that follow
    begins = ((F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")).cast("int")
    grouped = said.withColumn("begins", begins).withColumn("group", F.sum("begins").over(order))
    agents = grouped.where("name = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    fits = F.when((F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent")), 0).when(F.col("agent") == "*", 1)
    chosen = agents.withColumn("fit", fits).where("fit IS NOT NULL").groupBy("host").agg(F.min(F.struct("fit", "group")).alias("best")).select("host", F.col("best.group").alias("group"))
    rules = grouped.where("name IN ('allow', 'disallow')").join(chosen, ["host", "group"])
    # an empty Disallow allows all
    return rules.select("host", "place", ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"), F.col("value").alias("prefix"))


def allowed(addresses: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``addresses`` with ``allowed``: the first rule of their host that their path begins with decides; without one they are."""
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    by_host = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "allow", "prefix"))).alias("rules"))  # one robots file a host
    met = addresses.withColumns({"host": host(F.col(url)), "__path": path}).join(by_host, "host", "left")
    fits = F.filter(F.coalesce("rules", F.array().cast("array<struct<place:int,allow:boolean,prefix:string>>")), lambda r: F.startswith(F.col("__path"), r["prefix"]))
    return met.withColumn("allowed", F.coalesce(F.try_element_at(fits, F.lit(1))["allow"], F.lit(True))).drop("__path", "rules", "host")
