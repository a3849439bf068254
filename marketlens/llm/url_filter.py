"""URL filters (operator 3): ordered host and path rules, then a Bloom filter cascade over listed domains.

Native: DataFrame functions only, and no join: one aggregation gives the corpus's complete key universe (the distinct
registered domains of all urls, without user names and ports) and which of its keys are listed. The cascade: level 0
encodes the listed keys, level 1 the unlisted keys that level 0 lets through, level 2 the listed keys that level 1 lets
through, and so on until a level lets nothing wrong through. A key of the universe is then judged exactly by the first
level that lacks it. Levels are bitmaps built by bitmap_construct_agg and put in the plan as binary literals; the keys
of a level are counted before it is built (BITS_PER_KEY a key, at least MIN_BITS). Where a level of any depth would
exceed MAX_BYTES, the keys are split by hash into twice as many parts, each with a cascade of its own, and rows are
judged part by part; a part reads the rows once, and holds some 16 million listed or 500 million other domains.

Defined results: a null url or one without `://` has an empty host and path, no rule and the verdict allow; user names
and ports stay in `host`, which rules are held against, and are no part of a listed domain; repeated rows get equal
results; other input columns are kept by `filter_urls`; an empty table gives no rows, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, cut, table

#: (host, path, verdict), the rules of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The listed domains of the query: six names under each of three zones.
LISTED = tuple(f"{name}.example.{zone}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org"))
LABELS = 3  # a registered domain is the last three labels: example.<zone> is a public suffix here
BITS_PER_KEY, MIN_BITS, PROBES = 8, 256, 3
MAX_BYTES = 16 << 20
CHUNK = 32768  # bits of a bitmap of bitmap_construct_agg


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: The name in a host, without a user name, a port and a last dot.
NAME = r"(?s)^(?:.*@)?(.*?)\.?(?::[0-9]*)?\z"


def domain_of(host: Column, labels: int = LABELS) -> Column:
    name = F.regexp_extract(host, NAME, 1)
    return F.array_join(F.reverse(F.slice(F.reverse(F.split(name, r"\.")), 1, labels)), ".")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


class Level:
    """One bitmap of the cascade, with `bits` bits."""

    def __init__(self, seed: int, bits: int, data: bytes):
        self.seed, self.bits, self.data = seed, bits, data

    @staticmethod
    def places(key: Column, seed: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long")) for i in range(PROBES)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, seed: int) -> Level:
        bits = max(MIN_BITS, BITS_PER_KEY * n)
        at = keys.select(F.explode(F.array(*cls.places(F.col("key"), seed, bits))).alias("at"))
        chunks = at.groupBy((F.col("at") / CHUNK).cast("long").alias("chunk")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(CHUNK).cast("long"))).alias("map"))
        data = bytearray((bits + 7) // 8)
        for r in chunks.collect():  # at most `bits` bits, whatever the number of rows
            part = bytes(r["map"])[: len(data) - r["chunk"] * CHUNK // 8]
            data[r["chunk"] * CHUNK // 8 : r["chunk"] * CHUNK // 8 + len(part)] = part
        return cls(seed, bits, bytes(data))

    def has(self, key: Column) -> Column:
        """Whether all probed bits are set."""
        out = F.lit(True)
        for at in self.places(key, self.seed, self.bits):
            byte = F.conv(F.hex(F.substring(F.lit(self.data), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, F.pmod(at, F.lit(8).cast("long")).cast("int")) == 1)
        return out


class TooLarge(Exception):
    """A level would exceed MAX_BYTES."""


def universe_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """key, listed: the distinct keys and whether each is one of the listed ones; both sides have a column `key`."""
    both = keys.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen")).unionAll(listed.select("key", F.lit(True), F.lit(False)))
    return both.filter("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).filter("seen").select("key", "listed")


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels over a universe of distinct keys (key, listed)."""
    levels: list[Level] = []
    while True:  # each level lets through a small part of the keys it must not
        side = universe.filter(F.col("listed") == (len(levels) % 2 == 0))
        for i, level in enumerate(levels):
            if i % 2 != len(levels) % 2:  # what the last level lets through must be told from what it encodes
                side = side.filter(level.has(F.col("key")))
        n = side.count()
        if not n and levels:
            return levels
        if BITS_PER_KEY * n > 8 * MAX_BYTES:
            raise TooLarge
        levels.append(Level.build(side, n, len(levels)))


def listed_by(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe: the parity of the first level that lacks the key."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, labels: int = LABELS, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to the rows; listed: the blocked domains, a column `key`."""
    pages = pages.drop("host", "path", "rule", "verdict")
    d = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    universe = cut(universe_of(d.select(domain_of(F.col("host"), labels).alias("key")), listed))  # each level reads it
    part_of = lambda key, parts: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    parts, cascades = 1, None
    while cascades is None:
        try:
            cascades = [build_cascade(universe if parts == 1 else universe.filter(part_of(F.col("key"), parts) == p)) for p in range(parts)]
        except TooLarge:
            parts *= 2
    judged = []
    for p, levels in enumerate(cascades):
        key = domain_of(F.col("host"), labels)
        rows = d if parts == 1 else d.filter(part_of(key, parts) == p)
        block = listed_by(levels, key)
        judged.append(rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(block, "block").otherwise("allow"))))
    out = judged[0]
    for x in judged[1:]:
        out = out.unionByName(x)
    return out


def literal_keys(spark, keys) -> DataFrame:
    """A column `key` of a few keys, as literals of the plan."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"))


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), literal_keys(spark, LISTED)).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql(column: int) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[column]}'" for h, p, v in order) + " END"


ORACLE = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT *, array_to_string(string_split(regexp_extract(host, '{NAME}', 1), '.')[-{LABELS}:], '.') AS key FROM p)
SELECT page_id, host, path, {_rules_sql(0)} AS rule,
  coalesce({_rules_sql(1)}, CASE WHEN key IN ({", ".join(f"'{x}'" for x in LISTED)}) THEN 'block' ELSE 'allow' END) AS verdict FROM k"""
