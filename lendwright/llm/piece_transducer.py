"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` reads a public model file and builds three machines: the normaliser (blanks to ``▁`` and
back, dummy prefix, surplus blanks), the lexicon (a trie whose arcs carry characters and whose final states emit
a piece) and byte fallback (every character without a piece emits its UTF-8 bytes). ``encode`` composes
them with a text and takes the shortest path in the tropical semiring (weights add along a path, the least wins).

* Unigram models: an arc weighs minus the score of its piece.
* BPE models: scores order merges and do not add up, so the weight sits on the context. A sequence of pieces is
  what merging yields exactly if every two neighbours, merged on their own, stay as they are; such a pair weighs
  0 and any other infinity. One finite path is left. The pair weights are worked out once per pair by merging
  the two strings and are kept.

If no piece holds a blank after another character (true of most models), paths split before blanks, and
the path of a stretch that occurs again is looked up instead of searched. What is remembered is bounded: when the
younger generation of stretches is full, it becomes the older one, whose stretches are forgotten unless they occur again.

Defined cases: a NULL or empty text has no pieces and decodes to the empty text; ``▁`` in a text reads as a
blank, as in the public library; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendwright.llm.words import pieces

BLANK = "▁"
# Fixed values of the public model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
UNKNOWN_TEXT = " ⁇ "
#: Pairs remembered per Python worker.
REMEMBERED_PAIRS = 400_000
#: Stretches of at most STRETCH_CHARS remembered per Python worker, in each of two generations.
REMEMBERED_PATHS = 64_000
STRETCH_CHARS = 64
#: Stretches of a text that are strings at one time.
STRETCHES = 4_096


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield key >> 3, data[at : at + size]
        at += size


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("MODEL_KIND_UNSUPPORTED")
        if normaliser.get(2):
            raise ValueError("NORMALISER_RULES_UNSUPPORTED")
        if USER_DEFINED in kinds or UNUSED in kinds or trainer.get(24, 0):
            raise ValueError("PIECE_KIND_UNSUPPORTED")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.one_blank = bool(normaliser.get(4, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        self.unknown_weight = UNKNOWN_PENALTY - min((self.scores[i] for i in self.ids.values()), default=0.0)
        #: Character to [piece that ends here or -1, next characters].
        self.trie: dict[str, list] = {}
        for piece, i in self.ids.items():
            children = self.trie
            for c in piece:
                node = children.setdefault(c, [-1, {}])
                children = node[1]
            node[0] = i
        #: Characters that stand in pieces but are none.
        self.inner = {c for p in self.ids for c in p} - set(self.ids)
        splits = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.stretch = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if splits else r"(?s:.+)")
        #: By piece, the pieces that may follow it (True) or would change with it (False).
        self.follow: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: What an id decodes to: text, bytes, or nothing.
        self.surface: list[str | int] = [p.replace(BLANK, " ") for p in self.pieces]
        for i, kind in enumerate(kinds):
            if kind == CONTROL:
                self.surface[i] = ""
            elif kind == UNKNOWN:
                self.surface[i] = trainer.get(44, UNKNOWN_TEXT.encode()).decode()
            elif kind == BYTE:
                self.surface[i] = int(self.pieces[i][3:5], 16)
        self.byte_ids = set(self.bytes.values())
        self.raw = [bytes([s]) if isinstance(s, int) else s.encode() for s in self.surface]

    def normalise(self, text: str) -> str:
        if self.one_blank:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    def _merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = self.scores[i], k
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _stays(self, before: str, piece: str) -> bool:
        """Does merging leave the two as they are? Such a pair weighs 0, any other infinity."""
        return self._merged(before + piece) == ([before, piece] if before else [piece])

    def _merge_path(self, text: str) -> list[int]:
        """The finite path of a BPE model. Every prefix has exactly one, so one arc reaches each position."""
        n = len(text)
        trie, follow = self.trie, self.follow
        none = -1
        last = [none] * (n + 1)
        back = [0] * (n + 1)
        for at in range(n):
            before = last[at] if at else -2
            known = follow.get(before)
            if known is None:
                known = follow[before] = {}
            strange = before == self.unknown and text[back[at]] in self.inner
            children, end = trie, at
            while end < n:
                node = children.get(text[end])
                if node is None:
                    break
                end += 1
                i, children = node
                if i < 0 or last[end] != none:
                    continue
                stays = known.get(i)
                if stays is None or strange:
                    left = text[back[at] : at] if at else ""
                    stays = self._stays(left, text[at:end])
                    if not strange:
                        known[i] = stays
                        self.pairs += 1
                if stays:
                    last[end] = i
                    back[end] = at
            c = text[at]
            if last[at + 1] == none and c not in self.ids:
                if c not in self.inner or self._stays(text[back[at] : at] if at else "", c):
                    last[at + 1] = self.unknown
                    back[at + 1] = at
        if self.pairs > REMEMBERED_PAIRS:
            follow.clear()
            self.pairs = 0
        return self._ids(text, last, back)

    def _best_path(self, text: str) -> list[int]:
        """The path of least weight of a unigram model; a position keeps its best arc only."""
        n = len(text)
        weight = [math.inf] * (n + 1)
        weight[0] = 0.0
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        scores = self.scores
        for at in range(n):
            here = weight[at]
            children, end = self.trie, at
            while end < n:
                node = children.get(text[end])
                if node is None:
                    break
                end += 1
                i, children = node
                if i >= 0 and here - scores[i] < weight[end]:
                    weight[end], last[end], back[end] = here - scores[i], i, at
            if text[at] not in self.ids and here + self.unknown_weight < weight[at + 1]:
                weight[at + 1], last[at + 1], back[at + 1] = here + self.unknown_weight, self.unknown, at
        return self._ids(text, last, back)

    def _ids(self, text: str, last: list[int], back: list[int]) -> list[int]:
        """Read a path from its end; a character without a piece falls back to its bytes."""
        ids: list[int] = []
        at = len(text)
        while at > 0:
            i = last[at]
            if i != self.unknown:
                ids.append(i)
            elif self.fallback:
                ids.extend(self.bytes[b] for b in reversed(text[back[at] : at].encode()))
            elif not ids or ids[-1] != i:
                ids.append(i)
            at = back[at]
        return ids[::-1]

    def shortest_path(self, text: str) -> list[int]:
        """Ids along the path of least weight through the composition with a normalised text."""
        return self._merge_path(text) if self.kind == BPE else self._best_path(text)

    def path(self, stretch: str) -> bytes:
        """Ids of a stretch, four bytes each."""
        if len(stretch) > STRETCH_CHARS:
            return array("i", self.shortest_path(stretch)).tobytes()
        found = self.paths.get(stretch)
        if found is None:
            found = self.older.get(stretch) or array("i", self.shortest_path(stretch)).tobytes()
            if len(self.paths) >= REMEMBERED_PATHS:
                self.older, self.paths = self.paths, {}
            self.paths[stretch] = found
        return found

    def encode(self, text: str) -> array:
        ids = array("i")
        matches = self.stretch.finditer(self.normalise(text))
        while stretches := [m[0] for m in islice(matches, STRETCHES)]:
            known = self.paths.get
            paths = [known(s) or self.path(s) for s in stretches]
            if self.fallback:
                ids.frombytes(b"".join(paths))
                continue
            for path in paths:
                own = array("i", path)
                ids += own[1:] if ids and ids[-1] == own[0] == self.unknown else own
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The inverse transducer. Bytes that form no character read as U+FFFD each."""
        if not len(ids):
            return ""
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)
        first = next((i for i in ids if self.raw[i]), None)
        blank = self.dummy_prefix and first is not None and first != self.unknown and first not in self.byte_ids
        return text[1:] if blank and text.startswith(" ") else text

    def _decode_runs(self, ids: Sequence[int]) -> str:
        """Run by run of byte pieces, for bytes that form no characters."""
        surface = self.surface
        out: list[str] = []
        run: list[int] = []
        lead = self.dummy_prefix
        for i in ids:
            s = surface[i]
            if lead and s != "":
                lead = False
                if i != self.unknown and not isinstance(s, int) and s[0] == " ":
                    s = s[1:]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                out.append(_characters(bytes(run)))
                run = []
            out.append(s)
        if run:
            out.append(_characters(bytes(run)))
        return "".join(out)


def _characters(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_compiled: dict[bytes, Transducer] = {}


def compile_model(model: bytes) -> Transducer:
    """The transducer of a model, compiled once per process."""
    key = hashlib.sha256(model).digest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode_texts(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids, their number, the digest of the decoded text, and whether it equals the text.

    ``model`` is the content of the model file: its size does not depend on the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(model)
        for batch in batches:
            for piece in pieces(batch, "text"):
                encoded, digests, same = [], [], []
                for value in piece.column(1).to_pylist():
                    ids = machine.encode(value or "")
                    decoded = machine.decode(ids)
                    encoded.append(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
                    digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                    same.append(decoded == (value or ""))
                sizes = np.array([len(e) for e in encoded], np.int64)
                values = np.concatenate(encoded)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes), lists, pa.array(digests), pa.array(same)],
                    names=["doc_id", "n_ids", "ids", "decoded_sha256", "round_trip"],
                )

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_ids(rows: DataFrame, model: bytes, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text that a column of ids stands for; NULL ids give an empty text."""

    @F.pandas_udf("string")
    def text_of(column):
        machine = compile_model(model)
        return column.map(lambda own: machine.decode(own) if own is not None else "")

    return rows.withColumn(to, text_of(F.col(ids)))


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
