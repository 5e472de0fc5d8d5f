"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

The filter is a table: one row per block, eight 32-bit words, one bit of a key in each word.
URLs whose bits are all set join the list itself, which removes false positives.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark.llm.storage import stored

WORDS = 8
#: beginnings of host labels that make a registered list of bad pages
BAD_LABELS = ("spam", "casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track")
BITS_PER_KEY = 12


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/ ? #`` with A-Z lower-cased, path up to ``? #``.

    Both are empty for null and for text without ``://``.
    """
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling for a page: no ``www.``, no ``.html`` and no slash at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""),
                    F.regexp_replace(path, r"(\.html?|/)$", ""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _bits(key: str) -> list[Column]:
    """One bit for each word of a block."""
    return [F.expr(f"shiftleft(1, cast(shiftrightunsigned(xxhash64('bits', {key}), {5 * j}) & 31 "
                   f"AS int))").alias(f"b{j}") for j in range(WORDS)]


def _block(key: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(n_blocks)).alias("block")


def bloom_table(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter of ``listed``: block and its words, for blocks with a key."""
    return (listed.select(_block(key, n_blocks), *_bits(key)).groupBy("block")
            .agg(*[F.bit_or(f"b{j}").alias(f"w{j}") for j in range(WORDS)]))


def listed_only(keys: DataFrame, listed: DataFrame, key: str,
                bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """The distinct ``key`` values of ``keys`` that are in ``listed`` (distinct, not null)."""
    n_blocks = max(1, -(-listed.count() * bits_per_key // (32 * WORDS)))
    table = bloom_table(listed, key, n_blocks)
    asked = keys.select(key).distinct().select(key, _block(key, n_blocks), *_bits(key))
    set_bits = asked["block"] == table["block"]
    for j in range(WORDS):
        set_bits &= table[f"w{j}"].bitwiseAND(asked[f"b{j}"]) == asked[f"b{j}"]
    maybe = asked.join(table, set_bits, "left_semi").select(key)
    return maybe.join(listed.select(key), key, "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict.

    Where no rule fits, pages whose canonical URL is in ``listed`` (column canonical) are
    blocked, others allowed. Distinct URLs are asked, so a common one is asked once. Null or
    broken URLs have empty host and path and are allowed; nulls in the list are left out;
    repeated rows are judged alike; other columns are not looked at.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"),
                         canonical(F.col("host"), F.col("path")).alias("canonical"))
    kept = stored(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    blocked = (listed_only(ruled.where("rule is null"), kept, "canonical")
               .select("canonical", F.lit(True).alias("hit")))
    return ruled.join(blocked, "canonical", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def listed_by_label(pages: DataFrame, labels: tuple[str, ...] = BAD_LABELS) -> DataFrame:
    """Canonical URLs of pages on hosts with a label that begins with one of ``labels``."""
    host, path = url_parts(F.col("url"))
    return (pages.select(host.alias("host"), path.alias("path"))
            .where(F.col("host").rlike(rf"(^|\.)({'|'.join(labels)})"))
            .select(canonical(F.col("host"), F.col("path")).alias("canonical")))
