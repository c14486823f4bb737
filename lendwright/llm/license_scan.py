"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template of ``n`` shingles (five words each; a template of fewer words is one shingle) is looked for in windows of n
shingles that begin every max(1, n // STEPS) words. A window and a template that agree in one of ``BANDS`` MinHash bands
are a candidate. Around a candidate the exact containment (the share of the template's shingles that stand in n
consecutive ones of the text) is taken over all window positions up to the next grid points; ``THRESHOLD`` decides.
A text of fewer than n shingles is one window: the containment of all its shingles is taken exactly, without bands.

The settings guarantee retrieval: a passage with containment c has a grid window at most half a step away, which shares
at least s = c - 1/(2 STEPS) of the shingles, so the Jaccard similarity is at least s / (2 - s) and one of the bands (of one
row) agrees with probability 1 - (1 - s / (2 - s))^BANDS: over 1 - 10^-9 at the defaults. ``miss_bound`` computes it.

Work per text is linear, independent of other texts; templates are few and their bands sit in a sorted array.
Defined cases: a NULL or empty text has no words and no matches; templates without words or with an empty name are
refused; a row per row of the input, repeated rows included; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendwright.llm.words import ALPHANUMERIC, gram_hashes, mix, pieces, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
STEPS = 8
BANDS = 24
#: Bound of the templates' total words, so that they can be sent to every task.
MAX_TEMPLATE_WORDS = 2_000_000

_SALTS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _permuted(shingles: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One MinHash order: 32 bits of every shingle's hash after an odd multiplication."""
    return (((shingles ^ (salt >> np.uint64(7))) * salt) >> np.uint64(32)).astype(np.uint32)


def miss_bound(containment: float = THRESHOLD) -> float:
    shared = containment - 1 / (2 * STEPS)
    return (1 - shared / (2 - shared)) ** BANDS


@dataclass
class Family:
    """Templates of one shingle size and one number of shingles."""

    size: int
    n: int
    names: list[str]
    shingles: list[np.ndarray]
    bands: list[list[np.uint32]]  # by band, the least value of each template

    @property
    def step(self) -> int:
        return max(1, self.n // STEPS)


def families(templates: dict[str, str]) -> list[Family]:
    """Compile templates; those of equal length are searched together."""
    if not templates or any(not name for name in templates):
        raise ValueError("TEMPLATE_NAME_EMPTY")
    grouped: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
    total = 0
    for name, text in templates.items():
        h = words(pa.array([text]), ALPHANUMERIC, lower=True).hashes()
        if not len(h):
            raise ValueError(f"TEMPLATE_WITHOUT_WORDS: {name}")
        total += len(h)
        size = min(SHINGLE_WORDS, len(h))
        grouped.setdefault((size, len(h) - size + 1), []).append((name, np.unique(gram_hashes(h, size))))
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError("TEMPLATES_TOO_LARGE")
    out = []
    for (size, n), members in sorted(grouped.items()):
        bands = [[_permuted(s, salt).min() for _, s in members] for salt in _SALTS]
        out.append(Family(size, n, [m[0] for m in members], [m[1] for m in members], bands))
    return out


def _candidates(shingles: np.ndarray, members: list[Family]) -> list[np.ndarray]:
    """Per family, (first shingle, template) of the windows that agree in a band.

    The least value of n consecutive shingles is the lesser of two runs of the next smaller power of two, and the minima of
    those runs serve all families.
    """
    found: list[list[np.ndarray]] = [[] for _ in members]
    for band, salt in enumerate(_SALTS):
        width, minima = 1, _permuted(shingles, salt)
        for which, family in enumerate(members):
            n = family.n
            if len(shingles) < n:
                break
            while 2 * width <= n:
                minima = np.minimum(minima[:-width], minima[width:])
                width *= 2
            least = minima if n == width else np.minimum(minima[: width - n], minima[n - width :])
            for k, key in enumerate(family.bands[band]):
                hit = np.flatnonzero(least == key)
                if len(hit):
                    found[which].append(np.stack([hit, np.full(len(hit), k)], axis=1))
    return [np.unique(np.concatenate(f), axis=0) if f else np.zeros((0, 2), np.int64) for f in found]


def _best(shingles: np.ndarray, low: int, high: int, template: np.ndarray, n: int) -> tuple[float, int]:
    """Greatest containment over windows of n shingles that begin in low … high, and where it is first reached."""
    own = shingles[low : high + n]
    at = np.minimum(np.searchsorted(template, own), len(template) - 1)
    place = np.flatnonzero(template[at] == own)
    which = at[place]
    best, where = 0, low
    inside: dict[int, int] = {}
    first = 0
    # A best window may end at a shingle of the template, or begin where the range begins.
    for j, p in enumerate(place.tolist()):
        inside[which[j]] = inside.get(which[j], 0) + 1
        begin = max(0, p - n + 1)
        while place[first] < begin:
            k = which[first]
            inside[k] -= 1
            if not inside[k]:
                del inside[k]
            first += 1
        if len(inside) > best:
            best, where = len(inside), low + min(begin, high - low)
    return best / len(template), where


def _scan(compiled: list[Family], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = words(piece.column(1), ALPHANUMERIC, lower=True)
                h = found.hashes()
                first, counts = found.first, found.counts
                doc = np.repeat(np.arange(len(piece)), counts)
                matches: list[list[dict]] = [[] for _ in range(len(piece))]
                for size in sorted({f.size for f in compiled}):
                    members = [f for f in compiled if f.size == size]
                    shingles = gram_hashes(h, size)
                    for family, candidates in zip(members, _candidates(shingles, members)):
                        span = family.n + size - 1
                        best: dict[tuple[int, int], tuple[float, int]] = {}
                        for start, k in candidates.tolist():
                            d = int(doc[start])
                            low, high = int(first[d]), int(first[d] + counts[d]) - span
                            # Windows of one text, on the grid or at its end.
                            if start > high or ((start - low) % family.step and start != high):
                                continue
                            low, high = max(low, start - family.step), min(high, start + family.step)
                            share, where = _best(shingles, low, high, family.shingles[k], family.n)
                            if share >= threshold and share > best.get((d, k), (0.0, 0))[0]:
                                best[d, k] = share, where
                        enough = size - 1 + threshold * min(map(len, family.shingles))
                        for d in np.flatnonzero((counts >= max(size, enough - 1)) & (counts < span)).tolist():
                            own = np.unique(shingles[first[d] : first[d] + counts[d] - size + 1])
                            for k, template in enumerate(family.shingles):
                                share = len(np.intersect1d(own, template, assume_unique=True)) / len(template)
                                if share >= threshold and share > 0:
                                    best[d, k] = share, int(first[d])
                        for (d, k), (share, where) in best.items():
                            begin = int(where - first[d])
                            end = min(begin + span, int(counts[d]))
                            matches[d].append({"license": family.names[k], "containment": share, "first": begin, "end": end})
                rows = [sorted(m, key=lambda x: x["license"]) for m in matches]
                kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(counts.astype(np.int64)), pa.array(rows, kind)], names=["doc_id", "n_words", "matches"]
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, and its best match of every template found: name, containment, word span."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, matches array<struct<license: string, containment: double, first: long, end: long>>"
    return given.mapInArrow(_scan(families(templates), threshold), schema)


def report(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    found = scan(docs, templates)
    best = F.round(F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0)), 8)
    names = F.array_join(F.col("matches.license"), ",")
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"), best.alias("best_containment"))
