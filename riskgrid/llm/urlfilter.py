"""URL rules by a cascade of Bloom filters. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.common import LOWER, UPPER
from riskgrid.session import materialize

KEYS_PER_FILTER = 500_000
MOST_LEVELS = 200

# Words between dots and hyphens of a host that block it where no rule speaks.
HOST_WORDS = (
    "ads", "adserver", "adult", "bet", "bets", "betting", "bingo", "casino", "escort", "escorts", "gambling", "hentai", "jackpot",
    "malware", "nude", "nudes", "payday", "phishing", "pill", "pills", "poker", "porn", "porno", "roulette", "sex", "sexy", "slots",
    "spam", "spammer", "viagra", "warez", "webcams", "xxx",
)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """action, host, path of each (action, host, path)."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("action", "host", "path")])
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("action", "host", "path"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, host, path: host after the first `://`, path after that; both empty without one."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.select("page_id", _lower(host).alias("host"), path.alias("path"))


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """What of a url can be listed: ends of its host with starts of its path, of the shapes that rules have, and its host's words.

    A key is a list's name, a space, and the text that the list would hold.
    """
    labels = F.size(F.split("host", r"\."))
    words = F.array_distinct(F.filter(F.split("host", r"[.\-]"), lambda w: w != ""))
    key = lambda name, text, ends, chars: F.struct(
        F.concat(F.lit(f"{name} "), text).alias("key"), F.lit(name).alias("list"), text.alias("text"), ends.cast("int").alias("labels"), chars.cast("int").alias("chars")
    )
    of_words = F.transform(words, lambda w: key("word", w, F.lit(0), F.lit(0)))
    if not shapes:
        return of_words
    # One constant of text, folded once: as many literals would be slow to analyse.
    shape = F.transform(F.split(F.lit(",".join(f"{a}:{b}" for a, b in shapes)), ","), lambda s: F.split(s, ":").cast("array<int>"))
    fitting = F.filter(shape, lambda s: (s[0] <= labels) & (s[1] <= F.length("path")))
    both = F.flatten(
        F.transform(
            fitting,
            lambda s: F.transform(
                F.array(F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s[0]), F.substring(F.col("path"), F.lit(1), s[1]))),
                lambda text: F.array(key("allow", text, s[0], s[1]), key("block", text, s[0], s[1])),
            )[0],
        )
    )
    return F.concat(both, of_words)


def _position(level: int, nth: Column, key: Column, bits: int) -> Column:
    """Where the nth hash of a level puts a key; each level has a seed of its own."""
    return F.pmod(F.xxhash64(F.lit(level), nth, key), F.lit(bits).cast("long"))


def _holds(level: int, hashes: int, words: list[int], key: Column) -> Column:
    """Whether this level's filter answers yes."""
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def bit(nth: Column) -> Column:
        at = _position(level, nth, key, 64 * len(words))
        return F.getbit(F.get(bits, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0), F.lit(hashes - 1)), bit)


def build_cascade(universe: DataFrame, part: int = 0) -> list[tuple[int, list[int]]]:
    """(hashes, words of 64 bits) of each level for the keys of `universe` (distinct key, listed).

    Level one holds the listed keys, level two the unlisted ones that level one wrongly answers yes to, level three the
    listed ones that level two answers yes to, and so on, until a level answers every key of the other side with no. A
    key's first no is then on an odd level if it is not listed, and on an even one if it is. The first level's rate of
    false answers is set so that it lets about as many unlisted keys through as there are listed ones; each other
    level's is one half. Size: about log2(unlisted / listed) + 5 bits a listed key, so a bound on listed keys bounds the
    words that the driver holds.
    """
    inside, outside = (universe.where(F.col("listed") == yes).select("key") for yes in (True, False))
    n, others = inside.count(), outside.count()
    hashes = max(1, math.ceil(math.log2(math.sqrt(2) * max(others, 1) / max(n, 1)))) if n else 1
    levels: list[tuple[int, list[int]]] = []
    while n:
        level = len(levels) + 1
        if level > MOST_LEVELS:
            raise RuntimeError("keys that no level tells apart")
        size = max(1, math.ceil(n * hashes / math.log(2) / 64))
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda j: _position(level, j, F.col("key"), 64 * size)))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
        found = inside.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        words = [0] * size
        for row in found:
            words[row["word"]] = row["bits"]
        levels.append((hashes, words))
        inside, outside = materialize(outside.where(_holds(level, hashes, words, F.col("key"))), f"url-level-{part}"), inside
        n, hashes = inside.count(), 1
    return levels


def is_listed(levels: list[tuple[int, list[int]]], key: Column) -> Column:
    """Exact for every key of the universe that the cascade was built over."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels), 0, -1):
        answer = F.when(~_holds(level, *levels[level - 1], key), F.lit(level % 2 == 0)).otherwise(answer)
    return answer


def judge(pages: DataFrame, rules: DataFrame, words: tuple[str, ...] = HOST_WORDS, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of (page_id, url).

    `rules` has action (allow or block), host and path. A rule fits its host and all subdomains if the url's path starts
    with the rule's; a rule without path fits every path. Of several, the one with the longest text (host and path)
    wins, then the one with more labels, then block. Without a rule, a url whose host has one of `words` between dots
    and hyphens is blocked, and every other is allowed.

    All keys of all urls are the universe; which of them are listed is found by one join of distinct keys, put into a
    cascade of Bloom filters, and asked for each url without any join or shuffle. Beyond `keys_per_filter` listed keys
    that occur, keys are dealt by a hash into as many cascades as needed, asked one after the other, so that the
    driver and the plan hold one of bounded size at a time.

    A null url, or one without `://`, has an empty host and path. An empty host fits no rule. Null or repeated page_id
    and repeated rows stay as they are; an empty table gives no rows; other columns are ignored. A host with a port has
    the port in its last label. Rules with a null field or an empty host are no rules; repeated ones are one.
    """
    text = F.concat(_lower(F.col("host")), F.col("path"))
    known = rules.where("action IN ('allow', 'block') AND host <> '' AND path IS NOT NULL")
    shapes = known.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    spark = pages.sparkSession
    listed = known.select(F.concat("action", F.lit(" "), text).alias("key"))
    listed = listed.unionByName(spark.range(1).select(F.explode(F.array(*[F.lit(f"word {w}") for w in words])).alias("key"))) if words else listed
    placed = with_host_and_path(pages).withColumn("keys", _keys(sorted((s["labels"], s["chars"]) for s in shapes)))
    universe = placed.select(F.explode("keys.key").alias("key")).distinct()
    universe = universe.join(listed.distinct().withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = materialize(universe, "url-keys")
    parts = max(1, math.ceil(universe.where("listed").count() / keys_per_filter))
    own = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))

    placed = placed.withColumn("hits", F.array_compact(F.array(F.when(F.lit(False), F.get("keys", 0)))))
    for part in range(parts):
        levels = build_cascade(universe.where(own(F.col("key")) == part), part)
        hit = lambda k: (own(k["key"]) == part) & is_listed(levels, k["key"])  # noqa: B023, E731
        placed = placed.withColumn("hits", F.concat("hits", F.filter("keys", hit)))
        if parts > 1:
            placed = materialize(placed, "url-hits")
    ranked = F.transform(
        F.filter("hits", lambda k: k["list"] != "word"),
        lambda k: F.struct(F.length(k["text"]).alias("long"), k["labels"].alias("labels"), (k["list"] == "block").alias("block"), k["text"].alias("text"), k["list"].alias("action")),
    )
    placed = placed.withColumn("best", F.array_max(ranked))
    worded = F.exists("hits", lambda k: k["list"] == "word")
    verdict = F.coalesce("best.action", F.when(worded, F.lit("block")).otherwise(F.lit("allow")))
    return placed.select("page_id", "host", "path", F.col("best.text").alias("rule"), verdict.alias("verdict"))
