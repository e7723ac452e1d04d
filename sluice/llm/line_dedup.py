"""Line dedup by levelled sorted runs of line hashes.

A store (``LineRuns``) holds runs of (hash, documents, largest id), bucketed and sorted by the hash. A new
batch of lines is aggregated by hash, merge-joined with all runs bucket by bucket, and what no run holds (the
anti-join) becomes a run of its own; hashes that some run holds go to a log of repeats beside it. So every hash stands in
one run, with the batch that brought it first, and in the logs of later batches. ``fanout`` runs of a level are
compacted to one of the next, bucket by bucket. Once a batch is dealt by its hashes nothing is shuffled again: joins,
compactions and totals read each bucket where it lies.

A line's key is the line, stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lowered; its hash the first 128 bits of SHA-256. Keys of at
least ``min_chars`` code points that ``min_docs`` rows hold lose their lines in all rows but those of the largest id.

Hot keys: a batch is aggregated before its shuffle, so a line that a third of all documents hold is one row per task.
Repeated keys of a share of 1 in ``HOT`` of their occurrences or more (at most ``HOT`` keys) are looked up by broadcast,
all others by a shuffled join; texts without any such line are never shuffled (``llm/keys.py``).

Defined results: a null or empty text is one empty line; every row counts as a document, also where ids repeat, and
rows that share the largest id all keep their lines; a null id is smaller than any other; texts are read whole, whatever
their length; a text all of whose lines are dropped is empty; an empty table gives no rows. ``dedup_lines`` replaces the text,
adds (or replaces) ``n_lines`` and ``n_dropped`` and keeps all other columns, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.keys import marked
from sluice.llm.store import fresh, keep, row_name, shared_dir, slots, table

BLANK = " \t\n\x0b\f\r"
BATCHES = 8
FANOUT = 4
HOT = 1024


#: Other characters than ASCII that lowering might change (upper and title case, numerals, symbols, and what the regular
#: expressions' tables don't know).
CASED = r"[[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]&&[^\x00-\x7F]]"


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else: by Spark's own lowering, but for lines in which that could change other characters."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(CASED)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """The hash of each line's key; null for keys of fewer code points (lowering keeps their number)."""
    keys = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANK)))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.substring(F.sha2(lowered(k), 256), 1, 32)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


class LineRuns:
    """One table, bucketed and sorted by the hash and parted by (run, hit): rows (h, n, top) with ``hit`` false are a sorted
    run, the others its log of repeats. ``levels`` lists the runs that are alive."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or slots(spark)
        self.levels: list[list[int]] = [[]]
        self.made = 0
        self.name = f"sluice_lines_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark).rstrip('/')}/sluice/{self.name}"

    def _alive(self) -> list[int]:
        return [run for level in self.levels for run in level]

    def _read(self, runs: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(runs))

    def _write(self, rows: DataFrame) -> int:
        run, self.made = self.made, self.made + 1
        out = rows.select("h", "n", "top", F.lit(run).alias("run"), "hit").write.mode("append").partitionBy("run", "hit").bucketBy(self.buckets, "h").sortBy("h")
        out.option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        return run

    def joined(self, lines: DataFrame) -> DataFrame:
        """(h, n, top, hit) of a batch: its hashes, in how many rows they are, the largest id of these, and whether a run
        holds them already. lines: h and doc_id, a row per document and distinct hash."""
        batch = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        if not self._alive():
            return batch.withColumn("hit", F.lit(False))
        runs = self._read(self._alive()).where("not hit").select("h", F.lit(True).alias("held"))
        return batch.join(runs.hint("merge"), "h", "left").select("h", "n", "top", F.coalesce("held", F.lit(False)).alias("hit"))

    def add(self, lines: DataFrame) -> None:
        """Take a batch in: hashes that are new become a run, the others go to its log."""
        self.levels[0].append(self._write(self.joined(lines)))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                old, self.levels[level] = self.levels[level], []
                self.levels[level + 1].append(self._write(self.merged(old)))
                self._drop(*[f"run={run}" for run in old])

    def merged(self, runs: list[int]) -> DataFrame:
        """Some runs as one: no hash stands in two of them, and logs add up."""
        return self._read(runs).groupBy("h", "hit").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def repeated(self, at_least: int) -> DataFrame:
        """(h, n, top) of hashes that at least so many rows hold."""
        if not self._alive():
            return self.spark.createDataFrame([], "h string, n long, top long")
        rows = self._read(self._alive())
        logs = rows.where("hit").groupBy("h").agg(F.sum("n").alias("more"), F.max("top").alias("later"))
        total = rows.where("not hit").join(logs.hint("merge"), "h", "left")
        return total.select("h", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "later").alias("top")).where(F.col("n") >= at_least)

    def _drop(self, *below: str) -> None:
        for folder in below or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Forget all runs; results that were kept stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._drop()
        self.levels = [[]]


def _batch_of(docs: DataFrame, id_col: str, batches: int) -> Column:
    """Ranges of the id of about equal numbers of rows; null ids go to the first."""
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [(i + 1) / batches for i in range(batches - 1)]).alias("c")).first()[0] if batches > 1 else []
    at = F.lit(0)
    for cut in cuts or []:
        at = at + F.when(F.col(id_col).cast("long") > cut, 1).otherwise(0)
    return at


def repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hashes of repeated lines with n and top, lines of all rows). Rows are fed to the store in batches of their ids' ranges; the lines
    (batch, doc_id, row, hs: a hash or null per line) are kept, as batches and the caller read them."""
    spark = docs.sparkSession
    hs = line_hashes(lines_of(F.col(text_col)), min_chars)
    rows = docs.select(_batch_of(docs, id_col, batches).alias("batch"), F.col(id_col).cast("long").alias("doc_id"), row_name(id_col, text_col).alias("row"), hs.alias("hs"))
    lines = keep(rows.where(F.exists("hs", lambda h: h.isNotNull())), "lines")
    store = LineRuns(spark)
    for k in range(batches):
        store.add(lines.where(F.col("batch") == k).select("doc_id", F.explode(F.array_distinct("hs")).alias("h")).where("h is not null"))
    found = keep(store.repeated(min_docs), "repeated_lines")
    store.close()
    return found, lines


def dropped_places(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(key: a row's name, places: sorted positions of its lines that go)."""
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * HOT >= F.lit(total)
    every = lines.select("doc_id", "row", F.posexplode("hs").alias("at", "h")).where("h is not null")
    near, maybe = marked(every, "h", found.select(F.col("h").alias("key")))
    near = near.where(F.col(maybe)).drop(maybe)
    hot = F.broadcast(found.where(heavy).select("h", "top"))  # HOT rows at most
    cold = near.join(hot.select("h"), "h", "left_anti").join(found.where(~heavy).select("h", "top"), "h")
    met = near.join(hot, "h").select("doc_id", "row", "at", "top").unionAll(cold.select("doc_id", "row", "at", "top"))
    gone = met.where(F.coalesce(F.col("doc_id") < F.col("top"), F.col("top").isNotNull()))
    return gone.groupBy(F.col("row").alias("key")).agg(F.sort_array(F.collect_set("at")).alias("places"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines (before) and n_dropped."""
    found, lines = repeated_lines(docs, min_docs, min_chars, batches, id_col, text_col)
    gone = keep(dropped_places(lines, found), "dropped_places")
    docs = docs.drop("n_lines", "n_dropped")
    key, places, cut = fresh(docs, "_row", "_places", "_lines")
    named, maybe = marked(docs.withColumn(key, row_name(id_col, text_col)), key, gone.select("key"))
    some = named.where(F.col(maybe)).join(gone.select(F.col("key").alias(key), F.col("places").alias(places)), key, "left").withColumn(cut, lines_of(F.col(text_col)))
    #: what stands between two dropped lines is a slice, so a text costs its lines once
    edges = F.concat(F.array(F.lit(-1)), F.col(places), F.array(F.size(cut)))
    between = F.transform(F.sequence(F.lit(0), F.size(places)), lambda i: F.slice(cut, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1))
    left = F.when(F.col(places).isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(F.flatten(between), "\n"))
    others = [F.col(c) for c in docs.columns if c != text_col]
    out = some.select(*others, left.alias(text_col), F.size(cut).cast("long").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))
    rest = named.where(~F.col(maybe)).select(*others, F.col(text_col).cast("string").alias(text_col), F.size(lines_of(F.col(text_col))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return out.unionByName(rest).select(*docs.columns, "n_lines", "n_dropped")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP12_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT doc_id, pos, line, coalesce(doc_id < top, false) AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
