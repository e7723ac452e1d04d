"""URL filtering: rules by host and path, and a Bloom filter cascade for listed hosts.

A cascade holds a list exactly over a known universe of keys. Level 0 encodes the
listed keys; keys of the universe that it wrongly accepts are encoded by level 1; listed
keys that level 1 wrongly accepts by level 2, and so on until a level has no wrong key. A key is
listed if the first level that rejects it has an odd number (or all accept and the
number of levels is odd). Judging needs no join: only the cascade's bits travel.

Bits are set in partial bitmaps, one row per 64-bit word and partition, and or-ed by a
partially aggregated group. The cascade is broadcast only while each level's bits stay under
``MAX_BITS``; for a longer list, or a universe whose false positives need more, keys are parted by a hash into
shards, and judged beside their shard's cascade.

Defined results: a null url, or one without ``://``, has empty host and path, matches
no rule and is not listed (allow); keys are compared as lower-cased strings; very long urls are read
whole; repeated urls are judged each; an empty list allows all that no rule blocks; an empty table gives no
rows. ``split_url`` and ``judge`` replace columns named like those they add (host, path, listed, rule, verdict);
all others stay, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sluice.llm.store import fresh, keep, table

#: Bits of one broadcast cascade at most (16 MB), and bits per encoded key.
MAX_BITS = 1 << 27
BITS_PER_KEY = 10
HASHES = 5
#: A cue word is so many times as frequent in toxic documents as in clean ones; a page is marked by so many different cue words.
CUE_RATIO = 8
CUES = 2
#: Labelled rows that cue words are taken from, about.
SAMPLE = 20_000

#: Fixed rules of the query: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

def split_url(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path."""
    (rest,) = fresh(rows, "_rest")
    at = F.instr(F.col(url_col), "://")
    rows = rows.withColumn(rest, F.when(at > 0, F.substr(F.col(url_col), at + 3)).otherwise(F.lit("")))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.withColumn("host", F.coalesce(lower, F.lit(""))).withColumn("path", F.coalesce(path, F.lit(""))).drop(rest)


def rule_of(rules) -> tuple[Column, Column]:
    """(longest fitting rule, its verdict); rules are (verdict, host/path)."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def places(keys: list[bytes], level: int, bits: int) -> np.ndarray:
    """The bit places of keys in a level: double hashing."""
    one = np.fromiter((xxh64_intdigest(k, 2 * level) for k in keys), dtype=np.uint64, count=len(keys))
    two = np.fromiter((xxh64_intdigest(k, 2 * level + 1) for k in keys), dtype=np.uint64, count=len(keys)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((one[:, None] + two[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def holds(words: np.ndarray, keys: list[bytes], level: int) -> np.ndarray:
    at = places(keys, level, 64 * len(words))
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def _bits_for(n: int) -> int:
    return max(64, math.ceil(n * BITS_PER_KEY / 64) * 64)


def _keys(column) -> list[bytes]:
    return [k.encode() for k in column.to_pylist()]


def _encode(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The words of a level's bitmap, or-ed over all keys; bounded by MAX_BITS."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(places(_keys(batch.column("key")), level, bits))
                word, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], names=["w", "bits"])

    out = np.zeros(bits // 64, dtype=np.int64)
    got = keys.mapInArrow(set_bits, "w int, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()  # MAX_BITS / 64 rows at most
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


class TooLarge(Exception):
    """A level needs more than MAX_BITS: part the keys by a hash."""


class Cascade:
    """Levels of bitmaps; ``listed(keys)`` judges a batch."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed and universe: a column ``key``; listed keys outside the universe don't matter."""
        universe = keep(universe.where("key is not null").select("key").distinct(), "universe")
        inside = keep(listed.select("key").distinct().join(universe, "key", "left_semi"), "listed")
        now, rest = inside, universe.join(inside, "key", "left_anti")
        levels: list[np.ndarray] = []
        for level in itertools.count():  # every level leaves about a hundredth of its keys
            n = now.count()
            if not n:
                return cls(levels)
            bits = _bits_for(n)
            if bits > MAX_BITS:
                raise TooLarge(bits)
            words = _encode(now, level, bits)
            levels.append(words)
            share = universe.sparkSession.sparkContext.broadcast(words)  # MAX_BITS at most

            def wrong(batches: Iterator[pa.RecordBatch], share=share, level=level) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield batch.filter(pa.array(holds(share.value, _keys(batch.column("key")), level)))

            now, rest = keep(rest.mapInArrow(wrong, "key string"), f"wrong{level}"), now

    @property
    def bits(self) -> int:
        return sum(64 * len(w) for w in self.levels)

    def listed(self, keys: list[bytes]) -> np.ndarray:
        """A key is judged by the first level that rejects it."""
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            ok = holds(words, [keys[i] for i in open_], level)
            out[open_[~ok]] = level % 2 == 1
            open_ = open_[ok]
        return out


def shards_for(n: int) -> int:
    """Parts of a list so that one part's cascade stays well under MAX_BITS."""
    return max(1, math.ceil(2 * n * BITS_PER_KEY / MAX_BITS))


def _mark(rows: DataFrame, key: str, cascade: Cascade) -> DataFrame:
    levels = rows.sparkSession.sparkContext.broadcast(cascade.levels)  # MAX_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_ = Cascade(levels.value)
        for batch in batches:
            coded = batch.column(key).dictionary_encode()
            got = judge_.listed([(k or "").encode() for k in coded.dictionary.to_pylist()])
            got &= np.array([bool(k) for k in coded.dictionary.to_pylist()], dtype=bool)
            index = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            yield batch.append_column("listed", pa.array(np.append(got, False)[index]))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("listed", T.BooleanType())]))


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, shards: int | None = None) -> DataFrame:
    """Add ``listed`` (boolean) to rows: whether a row's ``key`` is among ``listed.key``. Where a shard's level
    grows beyond MAX_BITS all is dealt over twice as many shards."""
    rows = rows.drop("listed")
    keys = rows.select(F.col(key).alias("key")).where("key <> ''")
    listed = keep(listed.select("key").distinct(), "list")
    n = shards or shards_for(listed.count())
    while True:
        try:
            return _in_shards(rows, key, keys, listed, n)
        except TooLarge:
            n *= 2


def _in_shards(rows: DataFrame, key: str, keys: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    if n == 1:
        return _mark(rows, key, Cascade.build(listed, keys))
    part = lambda c: F.pmod(F.xxhash64(F.lit("shard"), c), F.lit(n))
    out = None
    for k in range(n):
        cascade = Cascade.build(listed.where(part(F.col("key")) == k), keys.where(part(F.col("key")) == k))
        some = _mark(rows.where(part(F.col(key)) == k), key, cascade)
        out = some if out is None else out.unionAll(some)
    return out


def judge(pages: DataFrame, rules, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path, rule, listed and verdict to pages: the longest rule's verdict, else
    block for listed hosts and allow for others."""
    rows = mark_listed(split_url(pages, url_col), "host", listed)
    rule, verdict = rule_of(rules)
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))


def words_of(text: Column) -> Column:
    """The distinct ASCII words of a text, lowered."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower))


def cue_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """word: those in a tenth of the labelled toxic documents or more, and CUE_RATIO times as often in these as in clean ones.
    About ``sample`` labelled rows are looked at, all if there are no more; so texts are not shuffled."""
    known = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    some = F.broadcast(known.where(F.pmod(F.xxhash64(F.lit("cue"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))  # about ``sample`` rows
    toxic, clean = F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))
    all_t, all_c = docs.select("doc_id").join(some, "doc_id").agg(toxic, clean).first()
    each = docs.select("doc_id", "text").join(some, "doc_id").select("toxic", F.explode(words_of(F.col("text"))).alias("word"))
    found = each.groupBy("word").agg(toxic.alias("t"), clean.alias("c")).where((F.col("t") > 0) & (F.col("t") * 10 >= all_t) & (F.col("t") * F.lit(all_c) >= F.col("c") * (CUE_RATIO * all_t)))
    return keep(found.select("word"), "cues")


def listed_hosts(pages: DataFrame, cues: DataFrame) -> DataFrame:
    """The query's list, from the pages themselves: hosts on which pages with CUES or more different cue words are more
    frequent than on all. pages: url, html."""
    rows = split_url(pages.select("url", "html")).where("host <> ''")
    words = rows.withColumn("row", F.monotonically_increasing_id()).select("host", "row", F.explode(words_of(F.col("html"))).alias("word"))
    hits = words.join(cues, "word", "left_semi").groupBy("host", "row").count().where(F.col("count") >= CUES)
    bad = hits.groupBy("host").agg(F.count(F.lit(1)).alias("t"))
    of_host = keep(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(bad, "host", "left").select("host", "n", F.coalesce("t", F.lit(0)).alias("t")), "hosts")
    all_t, all_n = of_host.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return of_host.where(F.col("t") * F.lit(all_n) > F.col("n") * F.lit(all_t)).select(F.col("host").alias("key"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cues = cue_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judge(pages.drop("html"), RULES, listed_hosts(pages, cues)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '[A-Za-z]+'), lambda w: lower(w))) AS words FROM pages
), x AS (
  SELECT toxic, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w))) AS words FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL
), y AS (
  SELECT word, sum(toxic) AS t, sum(1 - toxic) AS c FROM (SELECT toxic, unnest(words) AS word FROM x) GROUP BY word
), cue AS (
  SELECT word FROM y WHERE t > 0 AND t * 10 >= (SELECT sum(toxic) FROM x) AND t * (SELECT sum(1 - toxic) FROM x) >= 8 * c * (SELECT sum(toxic) FROM x)
), p AS (
  SELECT page_id, words, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
), m AS (
  SELECT host, count(*) FILTER (len(list_intersect(words, (SELECT coalesce(list(word), []) FROM cue))) >= 2) AS t, count(*) AS n FROM p WHERE host <> '' GROUP BY host
), listed AS (
  SELECT host FROM m WHERE t * (SELECT sum(n) FROM m) > n * (SELECT sum(t) FROM m)
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN (SELECT host FROM listed) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
