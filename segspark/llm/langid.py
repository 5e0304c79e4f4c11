"""Language identification by rank-order profiles.

A profile ranks the most frequent character n-grams (one to three letters, words padded by a mark) of
a language; a document's own profile is compared to each by the sum of out-of-place distances, and
the nearest language wins.  Counts for the profiles cover every labelled document; a profile is one
row per rank, so the model's size is ``profile_size`` times the number of languages.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .textkit import U, mix

PROFILE = 300
UNKNOWN = "und"
#: Characters handled at once; a longer text is handled alone, in slices.
SLICE_CHARS = 1 << 18
MARK = 1
FLUSH = 1 << 17


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def lowered(texts: list[str | None]) -> list[str]:
    return [t.lower() if t else "" for t in texts]


def parts(texts: list[str], limit: int = SLICE_CHARS):
    i = 0
    while i < len(texts):
        j, room = i + 1, limit - len(texts[i])
        while j < len(texts) and len(texts[j]) <= room and j - i < 1 << 15:
            room -= len(texts[j])
            j += 1
        yield i, j
        i = j


def gram_keys(code: np.ndarray, doc: np.ndarray, context: int = 0) -> np.ndarray:
    """Every n-gram that ends behind the first ``context`` of these code points: text above 48 bits of gram, sorted."""
    letter = letters()[code]
    c = np.where(letter, (code & 0xFFFF) ^ (code >> 16 << 9), MARK).astype(U)
    # grams end at a letter, or at the mark after one
    last = letter.copy()
    last[1:] |= letter[:-1]
    one = letter.copy()
    one[:context] = False
    last[:context] = False
    two = last[1:] & (letter[1:] | letter[:-1])
    three = last[2:] & letter[1:-1]
    tag = doc.astype(U) << U(48)
    key = np.concatenate(((tag | c)[one], (tag[1:] | c[:-1] << U(16) | c[1:])[two], (tag[2:] | c[:-2] << U(32) | c[1:-1] << U(16) | c[2:])[three]))
    key.sort()
    return key


def tally(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``key``, which is sorted unless there are counts, and how often each occurs."""
    if count is not None:
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(key))) if count is None or not len(key) else np.add.reduceat(count, head)
    return key[head], n


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def long_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one long text and their counts, a slice of it at a time.

    A slice brings the two characters before it, so grams across its ends are counted once; what is held
    beside a slice is the distinct grams.
    """
    text = f" {text} "
    held, rows, limit = [], 0, FLUSH * 8
    for a in range(0, len(text), SLICE_CHARS):
        before = min(a, 2)
        code = code_points(text[a - before : a + SLICE_CHARS])
        held.append(tally(gram_keys(code, np.zeros(len(code), np.int64), before)))
        rows += len(held[-1][0])
        if rows > limit:
            held = [tally(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            rows = len(held[0][0])
            limit = max(limit, 2 * rows)
    return tally(*(np.concatenate(x) for x in zip(*held, strict=True)))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: ``(text, gram, count)``, sorted by text and gram.

    A gram packs three 16-bit letters (the higher planes folded), shorter ones from the right; words are runs
    of letters, with a mark on both sides.
    """
    if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
        gram, count = long_ngrams(texts[0])
        return np.zeros(len(gram), np.int64), gram, count
    sizes = np.array([len(t) + 2 for t in texts])
    key, count = tally(gram_keys(code_points("".join(f" {t} " for t in texts)), np.repeat(np.arange(len(texts)), sizes)))
    return (key >> U(48)).astype(np.int64), key & U(0xFFFFFFFFFFFF), count


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int):
    """The most frequent ``top`` grams of each text, ties by a hash of the gram: ``(doc, gram, rank)``."""
    order = np.lexsort((mix(gram), -count, doc))
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, doc, "left")
    rank = np.arange(len(doc)) - first
    keep = rank < top
    return doc[keep], gram[keep], rank[keep]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``(text, lang)``, counted in each task first."""

    def make():
        held: dict[str, list] = {}
        rows = [0]

        def squeeze(pieces):
            return tally(*(np.concatenate(x) for x in zip(*pieces, strict=True)))

        def step(batch: pa.RecordBatch):
            langs = batch.column("lang").to_pylist()
            texts = lowered(batch.column("text").to_pylist())
            for i, j in parts(texts):
                doc, gram, count = ngrams(texts[i:j])
                names, code = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    own = code[doc] == k
                    held.setdefault(str(name), []).append((gram[own], count[own]))
                    rows[0] += int(own.sum())
                if rows[0] > FLUSH * 8:
                    for name in held:
                        held[name] = [squeeze(held[name])]
                    rows[0] = 0
            return []

        def finish():
            for name, pieces in held.items():
                g, n = squeeze(pieces)
                for a in range(0, len(g), FLUSH):
                    part = g[a : a + FLUSH].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array(n[a : a + FLUSH])], ["lang", "gram", "n"])

        step.finish = finish
        return step

    return arrow_map(labelled.select("text", "lang"), make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, top: int = PROFILE) -> list[tuple[str, np.ndarray]]:
    """``(language, grams by rank)``, sorted by language."""
    counts = Scratch(labelled.sparkSession, "langid").save(gram_counts(labelled), "counts")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("gram"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("lang", "rank", "gram").collect()  # top rows a language
    found: dict[str, list] = {}
    for lang, rank, gram in rows:
        found.setdefault(lang, []).append((rank, gram))
    return [(lang, np.array([g for _, g in sorted(x)], np.int64).view(U)) for lang, x in sorted(found.items())]


class Scorer:
    """The model as arrays: ``texts -> (languages, scores)``."""

    def __init__(self, model: list[tuple[str, np.ndarray]], top: int):
        self.top, self.names = top, [n for n, _ in model]
        grams = np.concatenate([g for _, g in model]) if model else np.zeros(0, U)
        self.vocabulary = np.unique(grams)
        self.ranks = np.full((len(model), len(self.vocabulary) + 1), top, np.int32)
        for k, (_, g) in enumerate(model):
            self.ranks[k, np.searchsorted(self.vocabulary, g)] = np.arange(len(g))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        texts, top, vocabulary = lowered(texts), self.top, self.vocabulary
        best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for i, j in parts(texts) if self.names else []:
            doc, gram, rank = ranked(*ngrams(texts[i:j]), top)
            if not len(doc):
                continue
            head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            at = np.minimum(np.searchsorted(vocabulary, gram), len(vocabulary) - 1)
            at = np.where(vocabulary[at] == gram, at, len(vocabulary))
            away = np.stack([np.add.reduceat(np.where(r[at] >= top, top, np.abs(r[at] - rank)), head) for r in self.ranks])
            most = np.diff(np.append(head, len(doc))) * top
            for d, p, s in zip(doc[head], away.argmin(0), 1 - away.min(0) / most, strict=True):
                best[i + d], score[i + d] = self.names[p], s
        return best, score


def predict(docs: DataFrame, model: list[tuple[str, np.ndarray]], top: int = PROFILE) -> DataFrame:
    """``docs (id, held_out, text)`` to ``id, held_out, lang_pred, score``.

    A long text is counted in slices: beside its characters, a task holds a slice and the text's distinct n-grams.
    ``score`` is 1 less the distance as a share of the greatest possible one.  Of languages at equal
    distance the first by code point is predicted.  A text without a letter, or null, is ``und`` with
    score 0, as is every text when nothing was learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(model, top))  # top rows a language

    def make():
        def step(batch: pa.RecordBatch):
            best, score = sent.value(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(best), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

        return step

    return arrow_map(docs.select("id", "held_out", "text"), make, f"id {dict(docs.dtypes)['id']}, held_out boolean, lang_pred string, score double")


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, top: int) -> tuple[DataFrame, list[tuple[str, np.ndarray]]]:
    """Rows ``id, held_out, text`` and the model that the rows not held out give."""
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.drop("lang"), profiles(rows.where("not held_out and text is not null and lang is not null"), top)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = PROFILE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, a row per row of ``docs``.

    Learns from text and label of the rows whose ``crc32(id as text) mod 4`` is not 2, null texts and
    labels left out; a null id is never held out and is learned from.  Label, id and extra columns are no
    inputs of a prediction; equal texts get equal predictions.  An empty table gives no rows.
    """
    rows, model = learned(docs, id_col, text_col, lang_col, top)
    return predict(rows, model, top).withColumnRenamed("id", "doc_id")


#: Least score with which a text counts as written in a language.
LEAST_SCORE = 0.05


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = PROFILE, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that are in some learned language, with their columns.

    Rejected: no letter at all (null and empty texts among them), or a score below ``least``, a profile that
    is out of place almost everywhere in every language; so are all rows when nothing was learned.  Repeated
    rows all stay or all go; a null id or label does not matter.  An empty table gives no rows.
    """
    _, model = learned(docs, id_col, text_col, lang_col, top)
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(model, top))  # top rows a language
    place = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch):
            best, score = sent.value(batch.column(place).to_pylist())
            yield batch.filter(pa.array([b != UNKNOWN and s >= least for b, s in zip(best, score.tolist(), strict=True)]))

        return step

    return arrow_map(docs, make, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    got = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.withColumn("score", F.round("score", 6))
