"""Registered names of hosts by a table of public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import normalize as N

ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[?[0-9a-f:]*:[0-9a-f:.]*\]?)$"


def site_labels(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``suffix`` and ``site``, the label left of the public suffix.

    ``rules`` (rule) are names (co.uk), wildcards for one label (*.ck) and
    exceptions from these (!www.ck), in any case. Of a host's rules an exception
    counts first, then the longest one; without any its last label is the suffix.
    A host that is a suffix has no site; an IP address is its own site. Each
    host is looked up once, and each of its endings by equality with a rule,
    however many rules there are.
    """
    whole = urls.withColumn("host", F.regexp_replace(N.domain_host(F.col(url)), r"\.$", ""))
    hosts = whole.select("host").where("host IS NOT NULL AND host <> ''").distinct().withColumn("labels", F.split("host", r"\."))
    names = hosts.where(~F.col("host").rlike(ADDRESS))
    ending = lambda k: F.array_join(F.slice("labels", k, F.size("labels")), ".")
    ends = names.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("at"))
    kinds = F.array(
        F.struct(ending(F.col("at")).alias("rule"), F.col("at").alias("start"), F.lit(1).alias("order")),
        F.struct(F.concat(F.lit("*."), ending(F.col("at") + 1)).alias("rule"), F.col("at").alias("start"), F.lit(1).alias("order")),
        F.struct(F.concat(F.lit("!"), ending(F.col("at"))).alias("rule"), (F.col("at") + 1).alias("start"), F.lit(0).alias("order")),
    )
    asked = ends.select("host", F.explode(kinds).alias("k")).select("host", "k.*")
    known = rules.select(F.lower(F.trim("rule")).alias("rule")).distinct()
    best = asked.join(known, "rule", "left_semi").groupBy("host").agg(F.min(F.struct("order", "start")).alias("best"))
    found = names.join(best, "host", "left").withColumn("start", F.coalesce("best.start", F.size("labels")))
    found = found.select("host", ending(F.col("start")).alias("suffix"), F.when(F.col("start") > 1, F.get("labels", F.col("start") - 2)).alias("site"))
    addresses = hosts.where(F.col("host").rlike(ADDRESS)).select("host", F.lit(None).cast("string").alias("suffix"), F.col("host").alias("site"))
    return whole.join(found.unionByName(addresses), "host", "left").select(*urls.columns, "host", "suffix", "site")
