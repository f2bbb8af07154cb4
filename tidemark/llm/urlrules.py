"""URL filters: a sort-merge sweep of reversed hosts against the intervals of nested rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Urls' keys that set the partition bounds: about so many, at most twice as many.
SAMPLE = 10_000
DEFAULT_VERDICT = "allow"
#: The last character a key can hold comes after any that follows a prefix.
AFTER = "\U0010ffff"


def lowered(host: Column) -> Column:
    """A-Z alone: other letters of a host are told apart by case, in urls and in rules."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot: the key of a host is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """Walks rules and urls in key order with a stack of the rules' hosts that enclose the current key.

    Each stack entry has one host's rules by path. As intervals of host keys
    nest or are apart, the hosts that cover a url are those left on the stack
    once all that don't prefix its key are popped.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[int, str, str]], set[int]]] = []

    def _enter(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, path: str, rank: int, rule: str, verdict: str) -> None:
        self._enter(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, set()))
        _, paths, lengths = self.stack[-1]
        if path not in paths or (rank, rule, verdict) < paths[path]:
            paths[path] = (rank, rule, verdict)
            lengths.add(len(path))

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits: most characters in host and path, then the longer host."""
        self._enter(key)
        best, size = (None, None), (-1, -1)
        for host, paths, lengths in self.stack:
            for n in sorted(lengths, reverse=True):
                if n <= len(path) and (found := paths.get(path[:n])):
                    if (len(host) + n, len(host)) > size:
                        best, size = found[1:], (len(host) + n, len(host))
                    break
        return best


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, sweep = None, Sweep()
    for batch in batches:
        rows, rules, verdicts = [], [], []
        columns = (batch.column(x).to_pylist() for x in ("shard", "kind", "key", "path", "rule", "verdict", "rank"))
        for i, (shard, kind, key, path, rule, verdict, rank) in enumerate(zip(*columns, strict=True)):
            if shard != part:
                part, sweep = shard, Sweep()
            if kind == 0:
                sweep.add(key, path, rank, rule, verdict)
                continue
            best = sweep.find(key, path) if key != "." else (None, None)
            rows.append(i)
            rules.append(best[0])
            verdicts.append(best[1])
        picked = batch.take(pa.array(rows, pa.int64()))
        found = [pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
        yield pa.RecordBatch.from_arrays([picked.column(x) for x in ("page_id", "host", "path")] + found, names=["page_id", "host", "path", "rule", "verdict"])


def apply_rules(pages: DataFrame, rules: DataFrame, *, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    pages: page_id, url (more columns are ignored). rules: host, path, verdict,
    of any number. A rule fits a url if the url's host is the rule's or a
    subdomain of it and the url's path starts with the rule's; the longest
    (host and path together, then host) wins, and names the verdict, else
    ``default``. Of rules with one host and path, block comes before allow.

    Hosts are compared with A-Z lower-cased, in rules as in urls. Urls and rules are cut into shards at sampled host keys. A rule goes to all
    shards that its interval of keys overlaps; a host so frequent that it spans
    several bounds is dealt over all their shards by page, so no host overfills
    a task. Each shard is sorted and swept once; it holds one stack, not its rows.

    A url that is null or has no :// gets empty host and path and no rule.
    Rules with a null host, path or verdict are void. Repeated pages each
    return. An empty table gives an empty result; without rules all urls get
    ``default``.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    page_type = pages.schema["page_id"].dataType.simpleString()
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    spark = pages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(urls, parts)
    low, high = _below(bounds, F.col("key"), False), _below(bounds, F.col("key"), True)
    past = _below(bounds, F.concat("key", F.lit(AFTER)), False)
    dealt = (low + F.pmod(F.xxhash64("page_id", "path"), high - low + 1)).cast("int")
    left = urls.select(dealt.alias("shard"), F.lit(1).alias("kind"), "page_id", "host", "path", "key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("rank"))
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").withColumn("key", reversed_host(lowered(F.col("host"))))
    rank = F.when(F.col("verdict") == "block", 0).otherwise(1)
    right = known.select(F.explode(F.sequence(low, past)).alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast(page_type).alias("page_id"), "host", "path", "key", F.concat("host", "path").alias("rule"), "verdict", rank.alias("rank"))
    both = left.unionByName(right).repartitionById(parts, "shard").sortWithinPartitions("shard", "key", "kind")
    swept = both.mapInArrow(_swept, f"page_id {page_type}, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _below(bounds: list[str], key: Column, equal: bool) -> Column:
    """How many of the ascending bounds come before a key (or equal it): a binary search, so that many shards cost little."""
    if not bounds:
        return F.lit(0)
    every = F.lit(bounds)

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        before = F.get(every, middle) <= key if equal else F.get(every, middle) < key
        further = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        return F.when(s["low"] >= s["high"], s).when(before, further).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step, lambda s: s["low"])


def _bounds(urls: DataFrame, parts: int) -> list[str]:
    """Ascending host keys that cut the urls into about ``parts`` like shares, from a bounded hash sample; a frequent host repeats."""
    total = urls.count()
    step = max(1, total // SAMPLE)
    keys = sorted(r[0] for r in urls.where(F.pmod(F.xxhash64("page_id", "path"), F.lit(step)) == 0).select("key").collect())
    cut = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return cut


#: The rules that the query applies.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(map(str, RULES))}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS r
  FROM u LEFT JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM m WHERE r = 1
"""
