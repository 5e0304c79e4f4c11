"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Templates fall into classes by length.  A class has blocks of ``2 * step`` words, one every ``step``
words, where ``step`` is at least the longest of its templates: a notice of up to ``step`` words lies whole
in some block, however long the template.  A template is found in a block that contains at least the
threshold share of its distinct words.  The words of all templates are ordered by how often they occur
in the whole corpus, rarest first; then

* prefix: such a block contains one of the template's first ``n - need + 1`` words;
* length: it has at least ``need`` distinct words of the vocabulary;
* position: from the first word in this order that both contain, ``need`` words are left in both.

Only blocks that pass are compared, so the scan finds every block that meets the threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .license_texts import NOTICES
from .textkit import ALNUM, U, buffers, slices, words

#: Least step of the blocks; longer classes double it.
STEP = 32
THRESHOLD = 0.9
#: Phrases that the scan always looks for, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text: str) -> list[str]:
    """Words of a text, A-Z in lower case."""
    return WORD.findall(text.translate({c: c + 32 for c in range(0x41, 0x5B)}))


TEMPLATES = tuple((label, " ".join(plain_words(text))) for label, text in NOTICES)


def step_of(text: str) -> int:
    """The step of a template's class."""
    step = STEP
    while step < len(plain_words(text)):
        step *= 2
    return step


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), 0, 1, ALNUM, True).hashes()


def need_of(n: int, threshold: float) -> int:
    return int(np.ceil(threshold * n - 1e-9))


def vocabulary(templates) -> np.ndarray:
    return np.unique(np.concatenate([word_hashes(t) for _, t in templates])) if templates else np.zeros(0, U)


class Finder:
    """Which of all words are in the vocabulary: a bit table first, then the exact hash."""

    def __init__(self, vocab: np.ndarray):
        self.vocab = vocab
        self.table = np.zeros(1 << 16, bool)
        self.table[(vocab >> U(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` and vocabulary numbers."""
        at = np.flatnonzero(self.table[(h >> U(48)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.vocab, h[at]), max(0, len(self.vocab) - 1))
        ok = self.vocab[code] == h[at] if len(self.vocab) else np.zeros(len(at), bool)
        return at[ok], code[ok]


def frequencies(docs: DataFrame, text_col: str, vocab: np.ndarray) -> np.ndarray:
    """How often each template word occurs in all texts; as many numbers as there are template words."""

    def make():
        find = Finder(vocab)
        counts = np.zeros(len(vocab), np.int64)

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                np.add(counts, np.bincount(find(words(data, offsets, i, j, ALNUM, True).hashes())[1], minlength=len(vocab)), out=counts)
            return []

        def finish():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab), dtype=np.int32)), pa.array(counts)], ["code", "n"])

        step.finish = finish
        return step

    rows = arrow_map(docs.select(F.col(text_col).alias("text")), make, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocab), np.int64)
    for code, n in rows:
        out[code] = n
    return out


class Templates:
    """The templates of one class as ranks of their words, rarest first, and their prefix index by rank."""

    def __init__(self, templates, step: int, vocab: np.ndarray, counts: np.ndarray, threshold: float):
        self.labels, self.step, self.block = [x for x, _ in templates], step, 2 * step
        self.rank = np.lexsort((np.arange(len(vocab)), counts)).argsort()
        self.words, self.need = [], []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (_, text) in enumerate(templates):
            own = np.unique(self.rank[np.searchsorted(vocab, word_hashes(text))]).tolist()
            need = need_of(len(own), threshold)
            self.words.append(own)
            self.need.append(need)
            for place, r in enumerate(own[: len(own) - need + 1]):
                self.index.setdefault(r, []).append((t, place))
        ranked = np.zeros(len(vocab), bool)
        ranked[list(self.index)] = True
        self.prefix = ranked[self.rank]

    def open_for(self, held: np.ndarray, met: list[int]) -> list[int]:
        """Templates that a block of the ranks ``held`` may contain, given which of them, ``met``, are in the index."""
        first: dict[int, int] = {}
        for r in met:  # rarest first, so this is the first word that both contain
            for t, place in self.index[r]:
                if t not in first:
                    first[t] = min(len(self.words[t]) - place, len(held) - int(np.searchsorted(held, r)))
        return [t for t, left in first.items() if left >= self.need[t]]

    def join(self, at: np.ndarray, code: np.ndarray, n: int) -> dict[int, tuple[float, list[int]]]:
        """Templates found among a text's ``n`` words, given its vocabulary words: best share and first words of blocks."""
        found: dict[int, tuple[float, list[int]]] = {}
        last = max(0, -(-(n - self.step) // self.step) - 1)
        near = self.prefix[code]
        code, least = self.rank[code], min(self.need)
        # which blocks hold which words of the index, once each
        p, c = at[near] // self.step, code[near]
        pairs = np.unique(np.stack((np.concatenate((np.maximum(p - 1, 0), np.minimum(p, last))), np.concatenate((c, c)))), axis=1)
        edges = np.flatnonzero(np.diff(pairs[0], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            start = int(pairs[0, lo]) * self.step
            size = min(n - start, self.block)
            a, b = np.searchsorted(at, (start, start + size))
            if b - a < least:
                continue
            held = np.unique(code[a:b])
            open_ = self.open_for(held, pairs[1, lo:hi].tolist())
            if not open_:
                continue
            own = set(held.tolist())
            for t in open_:
                share = len(own.intersection(self.words[t]))
                if share >= self.need[t]:
                    best, blocks = found.get(t, (0.0, []))
                    found[t] = (max(best, share / len(self.words[t])), [*blocks, start])
        return found


def by_class(templates) -> list[tuple[int, list]]:
    """Step and templates of every class."""
    out: dict[int, list] = {}
    for label, text in templates:
        out.setdefault(step_of(text), []).append((label, text))
    return sorted(out.items())


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<long>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``, a row per row of ``docs``.

    ``blocks`` are the first words of the blocks in which a template was found.  ``score`` is 1 where a
    phrase stands, else the best share of a found template, else 0.  Null, empty and wordless texts have no
    labels: empty strings, score 0, null places.  Repeated rows get equal rows; extra columns are ignored;
    an empty table gives no rows.  A template without words raises.
    """
    if any(not plain_words(text) for _, text in templates):
        raise ValueError("a template has no words")
    vocab = vocabulary(templates)
    counts = frequencies(docs, text_col, vocab)
    spelled = [(word_hashes(p), label) for p, label in phrases]

    def make():
        find, joins = Finder(vocab), [Templates(own, step, vocab, counts, threshold) for step, own in by_class(templates)]

        def step(batch: pa.RecordBatch):
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                w = words(data, offsets, i, j, ALNUM, True)
                h, first = w.hashes(), w.first
                n = w.counts().tolist()
                base: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in spelled:
                    k = len(phrase)
                    at = np.flatnonzero(h[: max(0, len(h) - k + 1)] == phrase[0])
                    for o in range(1, k):
                        at = at[h[at + o] == phrase[o]]
                    text = np.searchsorted(first, at, "right") - 1
                    inside = at + k <= first[text + 1]
                    for d, p in zip(text[inside].tolist(), (at - first[text])[inside].tolist(), strict=True):
                        base.setdefault(d, []).append((p, label))
                at, code = find(h)
                cut = np.searchsorted(at, first)
                busy = [set((np.searchsorted(first, at[x.prefix[code]], "right") - 1).tolist()) for x in joins]
                rows = []
                for d in range(j - i):
                    got = {(k, t): f for k, x in enumerate(joins) if d in busy[k] for t, f in x.join(at[cut[d] : cut[d + 1]] - first[d], code[cut[d] : cut[d + 1]], n[d]).items()}
                    own = base.get(d, [])
                    names = {x for _, x in own}
                    places = [p for p, _ in own]
                    share = 1.0 if own else max((s for s, _ in got.values()), default=0.0)
                    rows.append((n[d], len(own), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(names | {joins[k].labels[t] for k, t in got})), share, sorted({b for _, bs in got.values() for b in bs})))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), *cols], ["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

        return step

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['id']}, {FOUND}")


def _phrase_sql(phrase: str) -> str:
    ws = phrase.split()
    return f"list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {len(ws) - 1}] = {ws!r})"


ORACLE = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT r, doc_id, ws, """
    + ", ".join(f"{_phrase_sql(p)} AS p{i}" for i, (p, _) in enumerate(PHRASES))
    + r""" FROM d),
t AS (SELECT unnest(["""
    + ", ".join(f"{{'label': {x!r}, 'step': {step_of(t)}, 'ws': {sorted(set(t.split()))!r}}}" for x, t in TEMPLATES)
    + r"""]) AS t),
c AS (SELECT DISTINCT t.step AS step FROM t),
k AS (SELECT r, step, list_distinct(ws[s + 1:s + 2 * step]) AS ws FROM (SELECT r, ws, step, unnest(range(0, greatest(1, len(ws) - step), step)) AS s FROM d, c)),
m AS (SELECT r, t.label AS label, max(len(list_intersect(k.ws, t.ws)) / len(t.ws)::DOUBLE) AS share FROM k JOIN t ON t.step = k.step
      WHERE len(k.ws) >= ceil(0.9 * len(t.ws) - 1e-9) AND len(list_intersect(k.ws, t.ws)) >= ceil(0.9 * len(t.ws) - 1e-9) GROUP BY r, t.label),
g AS (SELECT r, list(label) AS ls, max(share) AS share FROM m GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, list_concat(p0, list_concat(p1, p2)) AS ps,
        list_filter(["""
    + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN {x!r} END" for i, (_, x) in enumerate(PHRASES))
    + r"""], lambda x: x IS NOT NULL) AS bl, coalesce(ls, []) AS ls, coalesce(share, 0) AS share FROM b LEFT JOIN g USING (r))
SELECT doc_id, n_words, len(ps)::BIGINT AS n_base, list_min(ps) - 1 AS first_word, list_max(ps) - 1 AS last_word,
       array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, ls))), ',') AS labels,
       round(CASE WHEN len(ps) > 0 THEN 1.0 ELSE share END, 6)::DOUBLE AS score
FROM f
"""
)


def query(spark, sf_dir: str) -> DataFrame:
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))
