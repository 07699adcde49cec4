"""URL filters by a temporal list join.

Dated entries of a list (blocked or allowed again, for a host and all below it) become validity intervals. Every capture is
held against the entries of its host and of the hosts above it as they stood when it was fetched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import durable, fresh, small


@dataclass(frozen=True)
class Setting:
    """Up to broadcast_rows intervals are broadcast."""

    broadcast_rows: int = 200_000


def host(url: Column) -> Column:
    """Lower-case host without user, port and closing dots; empty where the URL has none."""
    part = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.regexp_replace(part, r"\.+$", "")


def parents(name: Column) -> Column:
    """A host and all hosts above it."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when(F.length(name) > 0, F.array_distinct(up)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(host, blocked, valid_from, valid_to) from dated entries (host, action, listed_at); valid_to is null while an entry stands.

    An entry holds until the next one of its host. Of entries of one moment `block` wins. An unknown action and entries
    without host or moment say nothing.
    """
    blocked = F.when(F.col("action").isin("block", "allow"), F.col("action") == "block")
    e = entries.select(F.regexp_replace(F.lower("host"), r"\.+$", "").alias("host"), blocked.alias("blocked"), F.col("listed_at").alias("valid_from"))
    e = e.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("valid_from").isNotNull() & F.col("blocked").isNotNull())
    e = e.groupBy("host", "valid_from").agg(F.max("blocked").alias("blocked"))
    return e.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("host").orderBy("valid_from"))).select("host", "blocked", "valid_from", "valid_to")


def evaluated(captures: DataFrame, entries: DataFrame, s: Setting = Setting(), url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with url_host, listed_host, listed_at, url_kept: by the entry of the most specific host that stood at fetch time.

    A capture is dropped if that entry blocks. One without host, without fetch time or without an entry is kept. The
    interval holds its first moment and not its last. Repeated rows are judged alike; empty tables are fine. Columns
    named like an added one are replaced.
    """
    added = ["url_host", "listed_host", "listed_at", "url_kept"]
    df = captures.drop(*[c for c in captures.columns if c.lower() in added and c not in (url, fetched)])
    columns = df.columns
    n = {k: fresh(df, f"uf_{k}") for k in ("host", "key", "found", "active")}
    # an array of what stood for each host, in order of time: an as-of lookup needs no row for each pair of host and capture
    life = intervals(entries).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "blocked"))).alias("life"))
    life = durable(life.select(F.col("host").alias("up"), "life"))
    life = F.broadcast(life) if small(life, s.broadcast_rows) else life
    df = df.withColumn(n["host"], host(F.col(f"`{url}`")))
    # hosts are looked up once each, however many captures a host has
    hosts = df.select(F.col(n["host"]).alias("host")).distinct().withColumn("up", F.explode(parents(F.col("host"))))
    found = hosts.join(life, "up").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("up")).alias("rank"), "up", "life"))).alias("found"))
    found = durable(found.select(F.col("host").alias(n["key"]), F.col("found").alias(n["found"])))
    df = df.join(F.broadcast(found) if small(found, s.broadcast_rows) else found, F.col(n["host"]) == F.col(n["key"]), "left")
    at = F.col(f"`{fetched}`")
    stood = lambda i: (i["valid_from"] <= at) & (i["valid_to"].isNull() | (at < i["valid_to"]))
    active = F.transform(F.col(n["found"]), lambda x: F.struct(x["up"].alias("up"), F.get(F.filter(x["life"], stood), F.lit(0)).alias("entry")))
    df = df.withColumn(n["active"], F.get(F.filter(active, lambda x: x["entry"].isNotNull()), F.lit(0)))
    got = F.col(n["active"])
    out = {"url_host": F.col(n["host"]), "listed_host": got["up"], "listed_at": got["entry"]["valid_from"], "url_kept": ~F.coalesce(got["entry"]["blocked"], F.lit(False))}
    return df.select(*[F.col(f"`{c}`") for c in columns], *[v.alias(k) for k, v in out.items()])
