"""Language identification by language-bitmask n-gram filters.

Training counts the letter n-grams of each language over all its texts.  An
n-gram belongs to a language when it makes up at least ``MIN_SHARE`` of the
language's n-grams, so a language has at most ``1 / MIN_SHARE`` of them: this
bounds the model whatever the corpus.  The n-grams go into bit-sliced Bloom
filters, one table of language masks; the AND of an n-gram's few rows gives all
languages that contain it at once.

A prediction counts, per language, the n-grams of the text that its filter
holds, takes off the share that a filter of that fill answers by mistake, and
chooses the highest; ties go to the first language by code point.  ``score`` is
that corrected share.  Texts are read in lower case with every run of other
characters as one space, so a word's edges count as letters.  A null text, and
one without a letter, is ``und`` with score 0.

Texts of any length are handled whole, in pieces of bounded size; where a very
long text is cut, the cut counts as a word's edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.llm.common import arrow_rows, mix
from logprism.session import store

UNKNOWN = "und"
SIZE = 3
MIN_SHARE = 2e-5
ROWS_BITS = 20
HASHES = 3
LANGUAGES_PER_PLANE = 64

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
GRAMS_DDL = "lang string, gram long, n long"
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
PREDICTED_DDL = "doc_id long, lang_pred string, score double"
#: Distinct n-grams that a training task holds before it passes them on.
HELD_GRAMS = 500_000
#: Code points that are taken at a time.
PIECE = 1_000_000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                table[point] = ord(low[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams of some texts, and the number of each one's text."""
    joined = "\x00".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    # each text owns the separator before it
    ends = np.cumsum([0, *[len(t) + 1 for t in texts]])
    letter = letters()[points]
    owner = np.searchsorted(ends, np.arange(len(points)), side="right") - 1
    gap = letter == 32
    keep = ~(gap & np.concatenate(([False], gap[:-1])) & np.concatenate(([False], owner[1:] == owner[:-1])))
    letter, owner = letter[keep].astype(np.uint64), owner[keep]
    n = len(letter) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code, empty = letter[:n].copy(), letter[:n] == 32
    for j in range(1, size):
        code = (code << np.uint64(21)) | letter[j:j + n]
        empty &= letter[j:j + n] == 32
    # a text's n-grams may use the space before it and the one behind it
    inside = (owner[:n] == owner[size - 2:size - 2 + n]) & ~empty
    inside &= (owner[:n] == owner[size - 1:size - 1 + n]) | (letter[size - 1:size - 1 + n] == 32)
    inside &= owner[:n] < len(texts)
    return mix(code[inside]), owner[:n][inside]


def pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of texts of bounded total length, with each one's place in ``texts``; long texts are cut."""
    part, places, held = [], [], 0
    for place, text in enumerate(texts):
        for start in range(0, len(text), PIECE):
            cut = text[start:start + PIECE]
            if held + len(cut) > PIECE and part:
                yield part, places
                part, places, held = [], [], 0
            part.append(cut)
            places.append(place)
            held += len(cut)
    if part:
        yield part, places


def training_grams(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``lang, gram, n`` over all rows ``text, lang``; tasks combine what they count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in ((lang, part) for lang, texts in by_lang.items() for part, _ in pieces(texts)):
                found, n = np.unique(grams(texts, size)[0].view(np.int64), return_counts=True)
                if lang in held:
                    found, at = np.unique(np.concatenate((held[lang][0], found)), return_inverse=True)
                    n = np.bincount(at, np.concatenate((held[lang][1], n)), len(found)).astype(np.int64)
                held[lang] = found, n
            if sum(len(f) for f, _ in held.values()) > HELD_GRAMS:
                for lang, (found, n) in held.items():
                    yield arrow_rows(GRAMS, [[lang] * len(found), found, n])
                held = {}
        for lang, (found, n) in held.items():
            yield arrow_rows(GRAMS, [[lang] * len(found), found, n])

    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(count, GRAMS_DDL).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``planes[p, row]`` is a mask of up to 64 languages."""

    languages: list[str]
    planes: np.ndarray
    fill: np.ndarray
    size: int = SIZE

    @staticmethod
    def rows(gram: np.ndarray, bits: int) -> list[np.ndarray]:
        gram = gram.view(np.uint64)
        out = []
        for j in range(HASHES):
            out.append((mix(gram ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64))
        return out

    @classmethod
    def build(cls, members: dict[str, np.ndarray], size: int = SIZE, bits: int = ROWS_BITS) -> Filters:
        languages = sorted(members)
        planes = np.zeros((max(1, -(-len(languages) // LANGUAGES_PER_PLANE)), 1 << bits), np.uint64)
        fill = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            used = np.unique(np.concatenate(cls.rows(members[lang], bits)))
            planes[k // LANGUAGES_PER_PLANE, used] |= np.uint64(1 << (k % LANGUAGES_PER_PLANE))
            fill[k] = len(used) / (1 << bits)
        return cls(languages, planes, fill, size)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and corrected share of each text."""
        total, hits = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for part, places in pieces(texts):
            gram, owner = grams(part, self.size)
            owner = np.array(places)[owner]
            total += np.bincount(owner, minlength=len(texts))
            at = self.rows(gram, int(self.planes.shape[1]).bit_length() - 1)
            for k in range(len(self.languages)):
                plane, bit = divmod(k, LANGUAGES_PER_PLANE)
                if bit == 0:
                    masks = self.planes[plane][at[0]]
                    for row in at[1:]:
                        masks &= self.planes[plane][row]
                held = ((masks >> np.uint64(bit)) & np.uint64(1)).astype(bool)
                hits[k] += np.bincount(owner[held], minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), total * 0.0
        wrong = (self.fill ** HASHES)[:, None]
        shares = np.clip((hits / np.maximum(total, 1) - wrong) / np.maximum(1 - wrong, 1e-12), 0, 1)
        known = total > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(shares.argmax(axis=0), known)]
        return names, np.where(known, shares.max(axis=0), 0.0)


def train(docs: DataFrame, size: int = SIZE, min_share: float = MIN_SHARE, bits: int = ROWS_BITS) -> Filters:
    """Filters from rows ``text, lang``.

    What reaches the driver are the n-grams above the share, at most
    ``1 / min_share`` for each language.  No rows give filters that know no
    language, and predict ``und``.
    """
    counts = store(training_grams(docs, size), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").filter(F.col("n") >= F.col("total") * min_share)
    members: dict[str, list[int]] = {}
    for row in frequent.select("lang", "gram").toLocalIterator():
        members.setdefault(row.lang, []).append(row.gram)
    return Filters.build({lang: np.array(g, np.int64) for lang, g in members.items()}, size, bits)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` for rows ``doc_id, text``; only the text is looked at."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            langs, scores = model.value.predict(texts)
            yield arrow_rows(PREDICTED, [batch["doc_id"], langs, scores])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PREDICTED_DDL)


def recognised(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """The documents, with all their columns, whose language is known with a score of at least ``least``.

    A null ``lang`` becomes the predicted one.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.value.predict([t or "" for t in batch["text"].to_pylist()])
            keep = [k for k, (lang, score) in enumerate(zip(langs, scores)) if lang != UNKNOWN and score >= least]
            known = pa.array([stated or lang for stated, lang in zip(batch["lang"].to_pylist(), langs)])
            columns = [known.cast(batch["lang"].type) if c == "lang" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> F.Column:
    """The fold kept from training: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def documents_language(docs: DataFrame) -> DataFrame:
    """Train on the documents outside the fold and predict all: ``doc_id, held_out, lang_pred, score``."""
    filters = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
