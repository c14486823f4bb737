"""Document fingerprints by Order MinHash.

A text is cut into words at blanks. A word of more than ``LONG_WORD`` code points (a text without blanks, say) counts as that many
units, its code points; any other word is one unit. Every ``GRAM`` consecutive units form a k-mer (a text with fewer units
is one k-mer). k-mers are numbered by occurrence, so that repeats count as different elements; the hash of (k-mer, occurrence)
deals each element to one of ``BINS`` bins. Every bin
keeps its ``KEEP`` least elements, puts them back in the order in which they stand in the text and hashes
the tuple. The share of equal tuples is the likeness of two texts: it falls with moved passages as well as with
changed ones.

All of it is column expressions on one row, in time n log n of the text's units; no rows are made per k-mer.
Hashes of elements are cut to 36 bits beside 28 bits of position, which only matters for choosing and numbering
elements inside one text.

Defined cases: a NULL text counts as empty; texts without words have a fingerprint of empty bins, and two
such texts are alike with 1; repeated rows get the same row of results each; rows whose id is NULL come last in
the order of documents, equal ids are ordered by row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendwright.llm.rows import K1, K2, row_hashes
from lendwright.session import materialize

GRAM = 3
LONG_WORD = 24
BINS = 32
KEEP = 2
HASH_BITS = 36
PLACE_BITS = 64 - HASH_BITS
PLACE = (1 << PLACE_BITS) - 1
HASH = (1 << HASH_BITS) - 1
BIN_BITS = BINS.bit_length() - 1
EMPTY_BIN = "-" * 8

_UNIT, _PACKED, _AGAIN, _PAIRS, _BIN = "__llm_unit", "__llm_packed", "__llm_again", "__llm_pair", "__llm_bin"
_BLANKS = r"[\x20\x09-\x0D]+"


def _pack(value: Column, place: Column) -> Column:
    """36 bits of a hash above 28 bits of position."""
    return F.shiftleft(value, PLACE_BITS).bitwiseOR(place.cast("long").bitwiseAND(PLACE))


def _hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _upto(end: Column) -> Column:
    """0 … end-1, or nothing."""
    return F.when(end > 0, F.sequence(F.lit(0), end - 1)).otherwise(F.array().cast("array<int>"))


def _occurrences() -> Column:
    """Numbers of the further occurrences of equal k-mers, which stand side by side: 2, 3, … in each run."""
    again = F.col(_AGAIN)
    starts = F.filter(
        _upto(F.size(again)), lambda j: (j == 0) | (_hash_of(F.get(again, j)) != _hash_of(F.get(again, j - 1)))
    )
    ends = F.concat(F.slice(starts, 2, F.size(again)), F.array(F.size(again)))
    lengths = F.zip_with(starts, ends, lambda low, high: high - low)
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(2), n + 1)))


def with_fingerprint(rows: DataFrame, text: str, to: str) -> DataFrame:
    """Adds the fingerprint of a column as an array of one long per bin, NULL where a bin is empty."""
    names = rows.columns
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _BLANKS), lambda u: u != "")
    units = rows.withColumn(_UNIT, words)
    points = lambda u: F.when(F.char_length(u) > LONG_WORD, F.regexp_extract_all(u, F.lit("(?s)."), F.lit(0))).otherwise(F.array(u))
    long = F.exists(F.col(_UNIT), lambda u: F.char_length(u) > LONG_WORD)
    units = units.withColumn(_UNIT, F.when(long, F.flatten(F.transform(F.col(_UNIT), points))).otherwise(F.col(_UNIT)))
    gram = lambda i: F.xxhash64(*[F.get(F.col(_UNIT), i + j) for j in range(GRAM)])
    count = F.when(F.size(_UNIT) == 0, 0).otherwise(F.greatest(F.size(_UNIT) - GRAM + 1, F.lit(1)))
    grams = units.withColumn(_PACKED, F.sort_array(F.transform(_upto(count), lambda i: _pack(gram(i), i)))).drop(_UNIT)

    # Sorted by hash, equal k-mers stand side by side in text order: all but the first of a run are renumbered.
    equal = lambda a, b: F.when(_hash_of(a) == _hash_of(b), b)
    beside = F.zip_with(F.col(_PACKED), F.slice(F.col(_PACKED), 2, F.size(_PACKED)), equal)
    repeated = grams.withColumn(_AGAIN, F.array_compact(beside))
    renumber = lambda x, n: _pack(F.xxhash64(_hash_of(x), n), x.bitwiseAND(PLACE))
    renumbered = F.zip_with(F.col(_AGAIN), _occurrences(), renumber)
    pairs = F.when(F.size(_AGAIN) == 0, F.col(_PACKED)).otherwise(
        F.sort_array(F.concat(F.array_except(_PACKED, _AGAIN), renumbered))
    )
    elements = repeated.withColumn(_PAIRS, pairs).drop(_PACKED, _AGAIN)

    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")
    dealt = elements.withColumn(_BIN, F.transform(F.col(_PAIRS), bin_of))
    all_bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    # A column that is named twice is worked out once per row; named once, it would be put into the lambda.
    opens = lambda k: F.when(F.size(_BIN) > 0, F.array_position(F.col(_BIN), k)).otherwise(0).cast("int")
    opened = dealt.withColumn(_BIN, F.transform(all_bins, opens))
    # In text order: position above hash.
    placed = lambda x: F.shiftleft(x.bitwiseAND(PLACE), HASH_BITS).bitwiseOR(_hash_of(x))

    def tuple_hash(at: Column, k: Column) -> Column:
        own = F.filter(F.slice(F.col(_PAIRS), at, KEEP), lambda x: bin_of(x) == k)
        return F.xxhash64(F.transform(F.sort_array(F.transform(own, placed)), lambda y: y.bitwiseAND(HASH)))

    fingerprint = F.transform(F.col(_BIN), lambda at, k: F.when(at > 0, tuple_hash(at, k)))
    return opened.select(*[F.col(f"`{c}`") for c in names], fingerprint.alias(to))


def as_text(fingerprint: Column) -> Column:
    """Eight hex digits per bin."""
    digits = lambda h: F.coalesce(F.lower(F.lpad(F.hex(h.bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit(EMPTY_BIN))
    return F.array_join(F.transform(fingerprint, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either text fills."""
    at = F.sequence(F.lit(0), F.lit(BINS - 1))
    either = F.size(F.filter(at, lambda i: F.get(a, i).isNotNull() | F.get(b, i).isNotNull()))
    same = F.size(F.filter(at, lambda i: F.get(a, i) == F.get(b, i)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def successors(rows: DataFrame, place: Column) -> DataFrame:
    """(K1, K2) of every row with the key of the next row by ``place`` as N1, N2; the last is followed by the first.

    Rows are dealt to ordered ranges; inside a range the next row is a window away, and the first rows of the
    ranges, as many as there are partitions, close the gaps.
    """
    ranged = materialize(
        rows.select(K1, K2, place.alias("__llm_place"))
        .repartitionByRange("__llm_place")
        .withColumn("__llm_range", F.spark_partition_id()),
        "ranges",
    )
    key = F.struct(K1, K2)
    inside = Window.partitionBy("__llm_range").orderBy("__llm_place")
    heads = ranged.groupBy("__llm_range").agg(F.min_by(key, "__llm_place").alias("__llm_head"))
    order = Window.orderBy("__llm_range")
    ring = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        "__llm_range", F.coalesce(F.lead("__llm_head").over(order), F.first("__llm_head").over(ring)).alias("__llm_after")
    )
    found = ranged.withColumn("__llm_next", F.lead(key).over(inside)).join(after, "__llm_range")
    nearest = F.coalesce("__llm_next", "__llm_after")
    return found.select(K1, K2, nearest[K1].alias("__llm_n1"), nearest[K2].alias("__llm_n2"))


def edited_report(docs: DataFrame, share: int = 3) -> DataFrame:
    """Fingerprints of all texts and of their edited forms.

    The last floor(n_chars / share) code points of a text give way to the first as many (or all) of the next document by
    descending id; after the last comes the first.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row_hashes())
    own = with_fingerprint(keyed, "text", "__llm_own").select(
        K1, K2, "doc_id", F.char_length("text").cast("long").alias("__llm_chars"), "__llm_own"
    )
    own = materialize(own.dropDuplicates([K1, K2]), "fingerprints")
    descending = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), K1, K2)
    follows = successors(own, descending)
    # Turned around: every document with the one that it follows, and how much of its text is asked for.
    asked = follows.join(own.select(K1, K2, "__llm_chars"), [K1, K2]).select(
        F.col(K1).alias("__llm_p1"),
        F.col(K2).alias("__llm_p2"),
        F.floor(F.col("__llm_chars") / share).alias("__llm_take"),
        F.col("__llm_n1").alias(K1),
        F.col("__llm_n2").alias(K2),
    )
    giver = own.select(K1, K2, F.col("__llm_own").alias("__llm_next")).join(asked, [K1, K2])
    gifts = (
        keyed.join(giver, [K1, K2])
        .select(
            F.col("__llm_p1").alias("__llm_g1"),
            F.col("__llm_p2").alias("__llm_g2"),
            F.left(F.col("text"), F.col("__llm_take").cast("int")).alias("__llm_gift"),
            "__llm_next",
            F.col("doc_id").alias("next_doc_id"),
        )
        .dropDuplicates(["__llm_g1", "__llm_g2"])
    )
    chars = F.col("__llm_chars")
    kept = F.left(F.col("text"), (chars - F.floor(chars / share)).cast("int"))
    edited = (
        keyed.join(own.drop("doc_id"), [K1, K2])
        .join(gifts, (F.col(K1) == F.col("__llm_g1")) & (F.col(K2) == F.col("__llm_g2")))
        .select("doc_id", "next_doc_id", "__llm_chars", "__llm_own", "__llm_next", F.concat(kept, "__llm_gift").alias("__llm_edited"))
    )
    found = with_fingerprint(edited, "__llm_edited", "__llm_new")
    return found.select(
        "doc_id",
        chars.alias("n_chars"),
        F.sha2(F.col("__llm_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("__llm_own")).alias("fingerprint"),
        as_text(F.col("__llm_new")).alias("edited_fingerprint"),
        likeness(F.col("__llm_own"), F.col("__llm_new")).alias("near_edited"),
        likeness(F.col("__llm_own"), F.col("__llm_next")).alias("near_next"),
        "next_doc_id",
    )
