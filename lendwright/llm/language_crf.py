"""Language ID with a linear-chain conditional random field over the words of a text.

Every word is labelled with a language. Features of a word: its affixes and inner n-grams (2 to 4 bytes of the word
between a begin and an end mark) and its counts in the lexicon, which Spark gathers per language over all rows that may
be learnt from. Learned transitions connect neighbouring words; forward-backward gives the probability of each language
for each word, also in code-switched text. A text's language is the one with the greatest mean probability, and that mean
is the score.

Weights are fitted on a bounded sample, about ``SAMPLE_DOCS`` texts per language of at most ``SAMPLE_BYTES`` bytes each,
whose words are strung together into sequences that switch languages. Everything else covers all rows and whole texts.
Languages are the distinct values found.

Forward-backward runs on blocks of ``BLOCK`` words: block transfer matrices first, then the messages between the blocks of
a text, then the words, so that the number of array steps does not depend on the length of a text.

Defined cases: a NULL text or one without a letter is ``und`` with score 0, and so is everything if nothing could be
learnt; rows whose id is NULL are predicted but not learnt from; a NULL lang is not learnt from; repeated rows get the same
prediction; other columns are passed on by ``predict``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lendwright.llm.rows import held_out, own_names
from lendwright.llm.words import Words, mix, pieces, ragged, words

UNKNOWN = "und"
LANG, SCORE = "__llm_lang", "__llm_score"
SAMPLE_DOCS = 150
SAMPLE_BYTES = 20_000
LEXICON_BITS = 16
FEATURE_BITS = 17
GRAM_BYTES = (2, 3, 4)
BLOCK = 256
#: Words whose features' weights are held at one time.
GRAM_WORDS = 2_048
ROUNDS = 30
SEED = 11

#: A-Z, a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_GRAM_FACTORS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray  # buckets x languages, counts
    grams: np.ndarray  # buckets x languages, weights
    trust: float  # weight of the lexicon
    bias: np.ndarray
    change: np.ndarray  # languages x languages, log weights
    start: np.ndarray


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)


def grams(found: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the chosen words, word after word, and where each word's begin."""
    size = found.end[which] - found.start[which] + 2
    first = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(first[-1], np.uint64)
    inner = ragged(np.cumsum(size - 2) - (size - 2), first[:-1] + 1, size - 2)
    marked[inner] = found.data[ragged(np.cumsum(size - 2) - (size - 2), found.start[which], size - 2)]
    marked[first[:-1]] = 2
    marked[first[1:] - 1] = 3
    word = np.repeat(np.arange(len(which)), size)
    numbers, owners = [], []
    for n in GRAM_BYTES:
        if len(marked) < n:
            continue
        total = np.full(len(marked) - n + 1, n, np.uint64)
        for j in range(n):
            total += marked[j : j + len(total)] * _GRAM_FACTORS[j]
        inside = word[: len(total)] == word[n - 1 :]
        numbers.append((mix(total[inside]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        owners.append(word[: len(total)][inside])
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return number[order], np.searchsorted(owner[order], np.arange(len(which) + 1))


def gram_scores(model_grams: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums of the weights are kept at the words' bounds only; between them they go from run to run of words."""
    at_bounds = np.zeros((len(first), model_grams.shape[1]))
    for a in range(0, len(first) - 1, GRAM_WORDS):
        bounds = first[a : a + GRAM_WORDS + 1]
        total = np.concatenate([at_bounds[a : a + 1], model_grams[number[bounds[0] : bounds[-1]]]])
        np.cumsum(total, axis=0, out=total)
        at_bounds[a : a + len(bounds)] = total[bounds - bounds[0]]
    count = np.maximum(np.diff(first), 1)[:, None]
    return np.diff(at_bounds, axis=0) / np.sqrt(count)


def lexicon_scores(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Centred log shares of words, given their counts per language."""
    share = np.log(counts + 0.5) - np.log(totals + 0.5 * 2**LEXICON_BITS)
    return share - share.mean(axis=1, keepdims=True)


def word_scores(model: Model, found: Words) -> np.ndarray:
    """Log weight of every language for every word; equal words are worked out once."""
    unique, where, back = np.unique(found.hashes(), return_index=True, return_inverse=True)
    totals = model.lexicon.sum(axis=0)
    out = np.empty((len(unique), len(model.languages)))
    for a in range(0, len(unique), 1 << 15):
        own = slice(a, a + (1 << 15))
        known = lexicon_scores(model.lexicon[_bucket(unique[own])], totals)
        out[own] = gram_scores(model.grams, *grams(found, where[own])) + model.trust * known + model.bias
    return out[back]


def marginals(scores: np.ndarray, first: np.ndarray, change: np.ndarray, start: np.ndarray, block: int = BLOCK):
    """Probabilities of the languages of every word by forward-backward, and the expected changes inside blocks.

    ``first`` bounds the words of each text.
    """
    n_langs = len(start)
    step = np.exp(change)
    begin = np.tile(np.exp(start - np.logaddexp.reduce(start)), (n_langs, 1))
    weight = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    counts = np.diff(first)
    n_blocks = -(-counts // block)
    text = np.repeat(np.arange(len(counts)), n_blocks)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    low = first[text] + turn * block
    size = np.minimum(first[text + 1] - low, block)
    order = np.argsort(-size, kind="stable")
    low, size, turn, text = low[order], size[order], turn[order], text[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(1, (size.max() if len(size) else 0) + 1)]
    opening = np.where((turn == 0)[:, None, None], begin, step) if len(size) else np.zeros((0, n_langs, n_langs))

    def scaled(x, axes):
        return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)

    before = np.full((len(size), n_langs), 1.0 / n_langs)
    after = np.ones((len(size), n_langs))
    if len(n_blocks) and n_blocks.max() > 1:
        transfer = scaled(opening * weight[low][:, None, :], (1, 2))
        for t, _ in enumerate(active[1:], 1):
            a = int(np.searchsorted(-size, -t, "left"))
            transfer[:a] = scaled((transfer[:a] @ step) * weight[low[:a] + t][:, None, :], (1, 2))
        head = np.cumsum(n_blocks) - n_blocks
        for k in range(1, int(n_blocks.max())):
            own = place[head[n_blocks > k] + k]
            previous = place[head[n_blocks > k] + k - 1]
            before[own] = scaled(np.einsum("bi,bij->bj", before[previous], transfer[previous]), 1)
        for k in range(int(n_blocks.max()) - 1, 0, -1):
            own = place[head[n_blocks > k] + k]
            previous = place[head[n_blocks > k] + k - 1]
            after[previous] = scaled(np.einsum("bij,bj->bi", transfer[own], after[own]), 1)
    forward = np.empty_like(weight)
    message = scaled(np.einsum("bi,bij->bj", before, opening) * weight[low], 1) if len(size) else before
    forward[low] = message
    for t in range(1, len(active)):
        a = int(np.searchsorted(-size, -t, "left"))
        message = scaled((message[:a] @ step) * weight[low[:a] + t], 1)
        forward[low[:a] + t] = message
    out = np.empty_like(weight)
    changes = np.zeros((n_langs, n_langs))
    message = after
    last = low + size - 1
    for t in range(len(active)):
        a = int(np.searchsorted(-size, -t, "left"))
        at = last[:a] - t
        message = message[:a]
        out[at] = scaled(forward[at] * message, 1)
        b = int(np.searchsorted(-size, -(t + 1), "left"))
        at = at[:b]
        carried = weight[at] * message[:b]
        pair = forward[at - 1][:, :, None] * step * carried[:, None, :]
        changes += scaled(pair, (1, 2)).sum(axis=0)
        message = message.copy()
        message[:b] = scaled(carried @ step.T, 1)
    return out, changes


def fit(texts: list[str], labels: list[str], languages: list[str], lexicon: np.ndarray) -> Model:
    """Maximum likelihood with Adam steps on sequences that string sample texts together."""
    n_langs = len(languages)
    rng = np.random.default_rng(SEED)
    found = words(pa.array(texts, pa.large_string()), LETTERS, lower=True)
    lang_of = np.array([languages.index(x) for x in labels], np.int64)
    label = np.repeat(lang_of, found.counts)
    model = Model(
        languages, lexicon, np.zeros((1 << FEATURE_BITS, n_langs)), 0.5, np.zeros(n_langs), np.eye(n_langs), np.zeros(n_langs)
    )
    if not len(label) or n_langs < 2:
        return model
    # Runs of 5 to 60 words, shuffled, then one to four to a sequence.
    size = rng.integers(5, 61, len(label) // 5 + len(texts) + 1)
    edges = np.unique(np.concatenate([found.first, np.cumsum(size)[np.cumsum(size) < len(label)], [len(label)]]))
    run, length = edges[:-1], np.diff(edges)
    order = rng.permutation(len(run))
    run, length = run[order], length[order]
    place = ragged(np.cumsum(length) - length, run, length)
    label = label[place]
    ends = np.cumsum(length)
    opens = np.unique(np.minimum(np.cumsum(rng.integers(1, 5, len(run))), len(run)))
    first = np.concatenate([[0], ends[opens - 1]])
    if first[-1] < len(label):
        first = np.append(first, len(label))
    h = found.hashes()
    unique, where, back = np.unique(h, return_index=True, return_inverse=True)
    back = back[place]
    number, bounds = grams(found, where)
    count = np.sqrt(np.maximum(np.diff(bounds), 1))
    owner = np.repeat(np.arange(len(unique)), np.diff(bounds))
    truth = np.zeros((len(label), n_langs))
    truth[np.arange(len(label)), label] = 1
    # A word's own occurrence does not count as knowledge about it.
    known = lexicon_scores(np.maximum(lexicon[_bucket(unique)][back] - truth, 0), lexicon.sum(axis=0))
    starts = first[:-1]
    same = np.ones(len(label), bool)
    same[starts] = False
    seen = np.zeros((n_langs, n_langs))
    np.add.at(seen, (label[:-1][same[1:]], label[1:][same[1:]]), 1)
    # Inside blocks only; the changes between them are few.
    parameters = [model.grams, np.array([model.trust]), model.bias, model.change, model.start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    n = len(label)
    for turn in range(1, ROUNDS + 1):
        scores = gram_scores(parameters[0], number, bounds)[back] + parameters[1][0] * known + parameters[2]
        probability, changes = marginals(scores, first, parameters[3], parameters[4])
        off = (truth - probability) / n
        per_word = np.stack([np.bincount(back, off[:, k], len(unique)) for k in range(n_langs)], axis=1) / count[:, None]
        slopes = [
            np.stack([np.bincount(number, per_word[owner, k], 1 << FEATURE_BITS) for k in range(n_langs)], axis=1) - 1e-6 * parameters[0],
            np.array([(off * known).sum()]),
            off.sum(axis=0),
            (seen - changes * (seen.sum() / max(changes.sum(), 1e-9))) / n,
            off[starts].sum(axis=0),
        ]
        for k, (p, g) in enumerate(zip(parameters, slopes)):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-10)
    model.trust = float(parameters[1][0])
    return model


def _count_words(languages: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(languages)}
        counts = np.zeros(len(languages) << LEXICON_BITS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = words(piece.column(1), LETTERS, lower=True)
                lang = np.array([number[x] for x in piece.column(0).to_pylist()], np.int64)
                slot = (np.repeat(lang, found.counts) << LEXICON_BITS) + _bucket(found.hashes())
                counts += np.bincount(slot, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])

    return run


def train(docs: DataFrame) -> Model:
    """Learn from the text and lang of the rows that are not held out."""
    known = docs.select("doc_id", F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    lexicon = np.zeros((1 << LEXICON_BITS, len(languages)))
    if languages:
        counted = known.select("lang", "text").mapInArrow(_count_words(languages), "slot long, n long")
        table = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        slot, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
        lexicon[slot & ((1 << LEXICON_BITS) - 1), slot >> LEXICON_BITS] = n
    draw = F.xxhash64("doc_id", F.lit(SEED)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(share)
    sample = known.where((draw < share) & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "lang", "text").collect()
    sample.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in sample], [r.lang for r in sample], languages, lexicon)


def label_words(model: Model, texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the texts and the probability of every language for each."""
    found = words(texts, LETTERS, lower=True)
    return found, marginals(word_scores(model, found), found.first, model.change, model.start)[0]


def _predict(broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        languages = np.array(model.languages, object)
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column(piece.schema.get_field_index("text"))
                readable = np.asarray(piece.column(piece.num_columns - 1).fill_null(False)).astype(bool)
                found, probability = label_words(model, texts)
                total = np.concatenate([np.zeros((1, probability.shape[1])), np.cumsum(probability, axis=0)])
                mean = (total[found.first[1:]] - total[found.first[:-1]]) / np.maximum(found.counts, 1)[:, None]
                readable &= found.counts > 0
                best = mean.argmax(axis=1)
                lang = np.where(readable, languages[best], UNKNOWN)
                score = np.where(readable, np.clip(mean[np.arange(len(mean)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1], pa.array(lang.tolist(), pa.string()), pa.array(score)],
                    names=[*piece.schema.names[:-1], LANG, SCORE],
                )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with LANG and SCORE added."""
    if not model.languages:
        return docs.withColumn(LANG, F.lit(UNKNOWN)).withColumn(SCORE, F.lit(0.0))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(LANG, StringType()), StructField(SCORE, DoubleType())])
    return docs.withColumn("__llm_letter", F.col("text").rlike(r"\p{L}")).mapInArrow(_predict(broadcast), schema)


def report(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col(LANG).alias("lang_pred"), F.col(SCORE).alias("score"))


@own_names
def keep_known(docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` with a language whose score is at least ``least``."""
    found = predict(docs, train(docs))
    return found.where((F.col(LANG) != UNKNOWN) & (F.col(SCORE) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
