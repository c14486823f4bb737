"""Line dedup with levelled sorted runs of line hashes.

A run is a table of line keys with the number of documents that hold them, hash-partitioned and sorted
by key. Every batch of documents is merge-anti-joined with the runs of *decided* keys (those known to
be in enough documents), and what is left is added as a run of level 0. When a level holds ``fan_in``
runs, they are compacted into one run of the next level; keys that reach the threshold move to the
decided runs. Only keys and counts are shuffled, never lines.

Everything is DataFrame work. Defined cases: a NULL or empty text is one empty line; a key of fewer
than ``min_chars`` code points never goes; every row is a document of its own, also when its id is
NULL or repeats; other columns are ignored here and kept by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendwright.llm.rows import ascii_lower, own_names, with_key, K1, K2
from lendwright.operators.order_statistics import join_unique
from lendwright.session import scratch_path

BLANKS = " \t\n\x0b\f\r"
H1, H2 = "__llm_h1", "__llm_h2"
#: Documents of a batch from which on a line's key is broadcast to its lines, and the most such keys.
HEAVY_LINE, MOST_HEAVY = 100_000, 1_000
RUN_SCHEMA = f"{H1} long, {H2} long, n long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: Column) -> Column:
    """Keys of all lines in order: blanks stripped at both ends, A-Z lower-cased."""
    return F.transform(lines_of(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias(H1), F.xxhash64(key, F.lit(1)).alias(H2)]


class LineRuns:
    """Counts of line keys over all batches added so far, as levelled runs in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, min_chars: int = 1, fan_in: int = 2, folder: str | None = None):
        self.spark = spark
        self.min_docs = min_docs
        self.min_chars = min_chars
        self.fan_in = fan_in
        self.folder = folder or scratch_path(spark, "line-runs")
        self.levels: dict[int, list[str]] = {}
        self.decided: list[str] = []
        self.written = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def _write(self, counts: DataFrame, level: int) -> None:
        """One sorted run; keys that reach the threshold go to a part of their own."""
        path = f"{self.folder}/run-{self.written:05d}"
        self.written += 1
        enough = F.when(F.col("n") >= self.min_docs, "decided").otherwise("open")
        (
            counts.withColumn("state", enough)
            .sortWithinPartitions("state", H1, H2)
            .write.partitionBy("state")
            .parquet(path)
        )
        states = {r[0] for r in self.spark.read.schema(f"{RUN_SCHEMA}, state string").parquet(path).select("state").distinct().collect()}
        if "decided" in states:
            self.decided.append(f"{path}/state=decided")
        if "open" in states:
            self.levels.setdefault(level, []).append(f"{path}/state=open")

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Count the line keys of one batch and add them as a run of level 0."""
        keys = docs.select(F.explode(F.array_distinct(line_keys(F.col(text)))).alias("__llm_key"))
        keys = keys.where(F.char_length("__llm_key") >= self.min_chars).select(*_hashed(F.col("__llm_key")))
        counts = keys.groupBy(H1, H2).agg(F.count("*").alias("n"))
        if self.decided:
            counts = counts.join(self._read(self.decided).hint("merge"), [H1, H2], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fan_in:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next."""
        runs = self._read(self.levels.pop(level))
        self._write(runs.groupBy(H1, H2).agg(F.sum("n").alias("n")), level + 1)

    def decide(self) -> DataFrame:
        """Keys in at least ``min_docs`` documents, after merging what is still open across levels."""
        rest = [p for level in sorted(self.levels) for p in self.levels[level]]
        if len(rest) > 1:
            self.levels = {max(self.levels): rest}
            self.compact(max(self.levels))
        return self.counts().select(H1, H2)

    def counts(self) -> DataFrame:
        """Decided keys with ``n``, their documents up to the batch that decided them."""
        return self._read(self.decided)


def common_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = 3, text: str = "text") -> DataFrame:
    """Hashes (and ``n``) of the line keys that occur in at least ``min_docs`` documents, counted batch by batch."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    for batch in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64(text), F.lit(batches)) == batch), text)
    runs.decide()
    return runs.counts()


def mark_lines(docs: DataFrame, common: DataFrame, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``__llm_lines`` and ``__llm_kept``: all lines of a text, and those whose key is not in ``common``.

    Keys of very many lines (``HEAVY_LINE``) are broadcast, at most ``MOST_HEAVY`` of them; the others are joined by their hashes.
    """
    keyed = with_key(docs, doc_id, text)
    lines = keyed.select(K1, K2, F.posexplode(line_keys(F.col(text))).alias("__llm_pos", "__llm_key"))
    lines = lines.where(F.char_length("__llm_key") >= min_chars).select(K1, K2, "__llm_pos", *_hashed(F.col("__llm_key")))
    heavy = common.where(F.col("n") >= HEAVY_LINE).orderBy(F.col("n").desc()).select(F.xxhash64(H1, H2)).limit(MOST_HEAVY).collect()
    found = join_unique(lines, common.select(H1, H2), [H1, H2], how="inner", hot=[r[0] for r in heavy])
    drops = found.groupBy(K1, K2).agg(F.collect_set("__llm_pos").alias("__llm_drop"))
    marked = keyed.join(drops, [K1, K2], "left").withColumn("__llm_lines", lines_of(F.col(text)))
    positions = F.array_except(F.sequence(F.lit(0), F.size("__llm_lines") - 1), F.col("__llm_drop"))
    kept = F.when(F.col("__llm_drop").isNull(), F.col("__llm_lines")).otherwise(
        F.transform(positions, lambda i: F.get(F.col("__llm_lines"), i))
    )
    return marked.withColumn("__llm_kept", kept)


@own_names
def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; lines whose key is in at least ``min_docs`` documents are taken out of the text.

    Texts that lose no line stay as they are, a NULL text too.
    """
    marked = mark_lines(docs, common_lines(docs, min_docs, min_chars, text=text), min_chars, doc_id, text)
    cut = F.when(F.col("__llm_drop").isNull(), F.col(text)).otherwise(F.array_join("__llm_kept", "\n"))
    return marked.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: lines, dropped lines and the digest of what stays."""
    docs = docs.select("doc_id", "text")
    marked = mark_lines(docs, common_lines(docs, min_docs, min_chars), min_chars)
    return marked.select(
        "doc_id",
        F.size("__llm_lines").cast("long").alias("n_lines"),
        (F.size("__llm_lines") - F.size("__llm_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__llm_kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )
