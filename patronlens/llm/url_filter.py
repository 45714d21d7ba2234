"""URL filter: rules by host and path, then a blocked Bloom filter in front of an exact join.

Listed URLs are canonicalised and hashed into a table of 256-bit blocks. A URL that finds all its
four bits in its block is a possible hit and only then takes part in the exact join with the list,
which removes the false positives. The filter has at most ``max_blocks`` rows of five longs, so it
may always be broadcast; a longer list only raises the share of URLs that reach the exact join.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, is never
listed and is allowed. Repeated rows are judged each for itself. An empty list lists nothing, an
empty table gives an empty table. Other columns, whatever their names, pass through unless they
bear a result's name, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronlens.llm import bloom
from patronlens.llm.common import LOWER, UPPER, unused

MAX_RULES = 500
RESULTS = ["host", "path", "rule", "listed", "verdict"]


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path behind it, without query and fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    pattern = "^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER), F.regexp_extract(rest, pattern, 2)


def canonical(url: Column, host: Column, path: Column) -> Column:
    """One spelling for the URLs of a page; null where there is no host.

    The scheme, a leading ``www.``, the default port, a closing slash, the fragment and tracking
    parameters go; other parameters stay in their order.
    """
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(query, "(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    short = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    whole = F.concat(short, F.regexp_replace(path, "/+$", ""), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule (host and path together, then the longer host) that fits, and its verdict; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; as one expression at most {MAX_RULES} are taken, put single URLs on the list")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url", max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict. ``listed`` has the blocked URLs in a column ``url``.

    The verdict is the rule's where one fits, else ``block`` for a listed URL and ``allow`` for others.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.drop(*[c for c in RESULTS if c != url]).withColumns({"host": host, "path": path})
    key, name, possible = unused(rows, "key", "name", "possible")
    rows = rows.withColumn(key, canonical(F.col(url), F.col("host"), F.col("path")))
    own_host, own_path = host_and_path(F.col("url"))
    names = listed.select(canonical(F.col("url"), own_host, own_path).alias(name)).where(F.col(name).isNotNull()).distinct()
    probed = bloom.probe(rows, key, names, name, possible, max_blocks)
    hits = probed.where(possible).join(names, F.col(key) == F.col(name), "left")
    hits = hits.withColumn("listed", F.col(name).isNotNull()).drop(name)
    others = probed.where(~F.col(possible)).withColumn("listed", F.lit(False))
    judged = hits.unionByName(others).drop(key, possible)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    fallback = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, fallback)})
