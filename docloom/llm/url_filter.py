"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list is a table of its own, of any size. An entry without a path stands for its host and all
subdomains, another one for its URL alone, with any query if it has none. So a page is looked up under
its canonical URL, under that without the query, and under its host and the host's last two to
``HOST_LABELS`` labels.

The filter is an array of 512-bit blocks; a name's hash picks one block (one cache line) and eight bits
in it. Its size is set from the list's length up to ``max_bytes``; beyond that only the share of false
hits grows. Pages with a name that may be listed go to an exact hash join with the list, which removes
false hits; the others are never shuffled.

Canonical form: scheme, user, fragment, a leading ``www.``, default ports and a final slash are gone,
the host is lower case, tracking parameters are dropped and the others sorted.

Defined results: a null URL, or one without ``://``, has an empty host and path, no canonical form and
is allowed; URLs of any length are read whole; of rules that fit equally long ones can't differ, as they
are the same host and path or end in the same text; repeated pages come out once each; repeated, null or
odd list entries are ignored or count once; an empty list lists nothing and an empty table of pages gives
no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored

ALLOW, BLOCK = "allow", "block"
#: Fixed by contract: host, path, verdict.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: The list of the registered query, a stand-in for a deployment's: made-up names under three domains.
LISTED = tuple(f"https://{name}.example.{top}/" for name in ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x") for top in ("com", "net", "org"))
#: Labels of the longest suffix of a host that is looked up, besides the whole host.
HOST_LABELS = 5
MAX_BYTES = 1 << 25
BITS_PER_URL = 16
_BLOCK_BYTES, _BITS = 64, 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def canonical(url: Column) -> Column:
    """Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@|:(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?://[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(r"^(utm_[a-z]*|gclid|fbclid|ref)(=|$)"))))
    return F.when(host != "", F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))))


def names_of(url: Column) -> Column:
    """What a URL is looked up under, each once; null where there is no host."""
    whole = canonical(url)
    host = F.regexp_extract(whole, "(?s)^[^/?]*", 0)
    ends = [F.substring_index(host, ".", -n) for n in range(2, HOST_LABELS + 1)]
    return F.when(whole.isNotNull(), F.array_distinct(F.array(whole, F.regexp_extract(whole, r"(?s)^[^?]*", 0), host, *ends)))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


class BlockedBloom:
    """Blocks of 512 bits as bytes; hashes are unsigned 64-bit."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size(n: int, max_bytes: int = MAX_BYTES) -> int:
        blocks = max(1, -(-n * BITS_PER_URL // (8 * _BLOCK_BYTES)))
        return min(max_bytes, blocks * _BLOCK_BYTES)

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> np.ndarray:
        """Byte and bit (together, a bit number) of each hash's eight bits."""
        h = hashes.astype(np.uint64)
        block = (h >> np.uint64(32)) % np.uint64(size // _BLOCK_BYTES)
        with np.errstate(over="ignore"):
            h = h * np.uint64(0x9E3779B97F4A7C15)
            step = (h >> np.uint64(20)) | np.uint64(1)
            inner = np.stack([(h >> np.uint64(40)) + np.uint64(i) * step for i in range(_BITS)]) % np.uint64(8 * _BLOCK_BYTES)
        return block * np.uint64(8 * _BLOCK_BYTES) + inner

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, len(self.bits))
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    @classmethod
    def of(cls, hashes: DataFrame, n: int, max_bytes: int = MAX_BYTES) -> BlockedBloom:
        """From a column of longs: each task ORs its own filter, words meet in one more step, and at most
        max_bytes / 8 of them reach the driver."""
        size = cls.size(n, max_bytes)

        def run(batches):
            own = np.zeros(size, np.uint8)
            for batch in batches:
                at = cls.places(batch.column(0).to_numpy().view(np.uint64), size).ravel()
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            words = own.view(np.int64)
            used = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used], pa.int64())], names=["word", "bits"])

        bits = np.zeros(size // 8, np.int64)
        for r in hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            bits[r.word] = r.bits
        return cls(bits.view(np.uint8))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (whether the exact join found it; null where a rule decided) of every row
    of pages(page_id, url). listed(url) is the list; it may be of any size and hold repeats."""
    spark = pages.sparkSession
    urls = stored(listed.select(canonical(F.col("url")).alias("_listed")).filter("_listed is not null").distinct(), "listed-urls")
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(urls.select(F.xxhash64("_listed")), urls.count(), max_bytes).bits)

    @F.pandas_udf("boolean")
    def maybe(hashes):
        import pandas as pd

        lengths = hashes.map(len).to_numpy(np.int64)
        flat = np.concatenate(hashes.to_list()) if lengths.sum() else np.zeros(0, np.int64)
        hit = BlockedBloom(bloom.value).has(flat.astype(np.int64).view(np.uint64))
        return pd.Series(np.bincount(np.repeat(np.arange(len(lengths)), lengths), hit, len(lengths)) > 0)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("_verdict"), F.when(name.isNull(), names_of(F.col("url"))).alias("_names"))
    columns = "page_id", "host", "path", "rule", "_verdict", "listed"
    ruled = rows.filter("_names is null").withColumn("listed", F.when(F.col("rule").isNull(), F.lit(False)))
    open_ = rows.filter("_names is not null").withColumn("_maybe", maybe(F.transform("_names", lambda x: F.xxhash64(x))))
    clear = open_.filter("not _maybe").withColumn("listed", F.lit(False))
    # Equal rows meet once; a found name marks all of them.
    once = open_.filter("_maybe").groupBy("page_id", "url", "host", "path").agg(F.count("*").alias("_n"), F.first("_names").alias("_names"))
    found = once.select("page_id", "url", F.explode("_names").alias("_listed")).join(urls, "_listed").select("page_id", F.col("url").alias("_url")).distinct().withColumnRenamed("page_id", "_id")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url"))
    exact = once.join(found, same, "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("_verdict"), F.col("_url").isNotNull().alias("listed"), F.explode(F.expr("array_repeat(0, cast(_n as int))")).alias("_copy"))
    every = ruled.select(*columns).unionByName(clear.select(*columns)).unionByName(exact.select(*columns))
    return every.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("listed"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"), "listed")


def block_list(spark: SparkSession, urls=LISTED) -> DataFrame:
    """url: a list that is given as a parameter."""
    return spark.createDataFrame([(u,) for u in urls], "url string")
