"""SentencePiece encoding and decoding with seeded merge-dropout.

Merge-type (BPE) segmentation of whole texts over a given vocabulary.  The agenda of a segment holds
every pair of neighbouring pieces whose union is a piece; the best-scored, then leftmost, is merged
next.  With dropout, a candidate merge is skipped when a hash keyed by seed, document, the segment's
place in the text and the candidate's extent falls below the rate: every occurrence is cut on its own,
reruns agree.

Where no piece holds the two characters that meet, no merge crosses: segments are cut there into units, whose
merges are the segment's.  Units of a batch that are equal and skip the same candidates come out alike, so each such kind is
merged once: all kinds side by side with numpy, one merge of each per round.  No
piece reaches across a segment's ends (a space after a non-space starts one, and a character without a
piece is one), so segments are independent.

Decoding is lossless: characters without a piece become bytes, and so does a literal U+2581, which in a
piece means a space.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .textkit import U, mix, powers

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
#: Hashes of what may begin a piece, and of what may be one, are marked in tables of so many bits.
MARK_BITS = 22
#: Candidates whose skips are drawn at once.
DRAWS = 1 << 20
#: Characters handled at once; a longer text is handled alone, in slices.
SLICE_CHARS = 1 << 20
#: Ids decoded at once.
DECODED = 1 << 16
#: Characters searched at once for a place to cut a long text.
LOOK = 1 << 12
#: Units up to these lengths are merged together; longer ones one by one.
WIDTHS = (4, 8, 12, 16, 24, 32)
BASE = 0x9E3779B97F4A7C15 | 1
#: Factors of a candidate's start and end in its hash.
START, END = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
WORD = (1 << 64) - 1


def marks(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U(64 - MARK_BITS)).astype(np.int64)


class Vocabulary:
    """Pieces, scores, the table of merges, and bytes of each id."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        normal = {p: i for i, p in enumerate(pieces) if i not in special and i not in set(byte_ids)}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space after another character")
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        keys, merged = [], []
        for p, i in normal.items():
            for c in range(1, len(p)):
                a, b = normal.get(p[:c]), normal.get(p[c:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.score = np.array(scores)
        # ranks of scores, the greater the better; the last entry, index -1, is for no union
        self.rank = np.append(np.unique(self.score, return_inverse=True)[1], -1).astype(np.int32)
        self.pairs = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        # marks of the hashes of all unions and of their beginnings, by character ids
        unions = [p for p in (pieces[i] for i in set(merged)) if (self.char_id[[ord(c) for c in p]] >= 0).all()]
        size = np.array([len(p) for p in unions], int)
        self.longest = int(size.max(initial=1))
        self.begins, self.unions = np.zeros(1 << MARK_BITS, bool), np.zeros(1 << MARK_BITS, bool)
        own = np.array([[ord(c) for c in p.ljust(self.longest)] for p in unions], int).reshape(len(unions), self.longest)
        h = np.zeros(len(unions), U)
        for n in range(self.longest):
            h = h * U(BASE) + (self.char_id[own[:, n]].astype(np.int64) + 2).astype(U)
            self.begins[marks(h[size > n])] = True
            self.unions[marks(h[size == n + 1])] = True
        # marks of the character pairs that stand side by side in some union
        ids = self.char_id[own].astype(np.int64)
        inner = np.arange(1, self.longest) < size[:, None]
        self.beside = np.zeros(1 << MARK_BITS, bool)
        self.beside[marks((ids[:, :-1][inner] << 32 | ids[:, 1:][inner]).astype(U))] = True
        raw = [b""] * len(pieces)
        for p, i in normal.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def apart(self, chars: np.ndarray) -> np.ndarray:
        """Whether no merge can join a character (but the first) and the one before it; some such places may be missed."""
        both = (chars[:-1] >= 0) & (chars[1:] >= 0)
        return ~both | ~self.beside[marks((chars[:-1].astype(np.int64) << 32 | chars[1:]).astype(U))]

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the unions, -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)


@cache
def load(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], special)


def skipped(key: np.ndarray, start: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Which candidate merges of ``start .. end`` a segment with this key skips."""
    if rate <= 0:
        return np.zeros(np.broadcast(key, start, end).shape, bool)
    h = mix(key + start.astype(U) * U(START) + end.astype(U) * U(END))
    return h < U(min(int(rate * 2.0**64), WORD))


def skips(key: int, start: int, end: int, rate: float) -> bool:
    """``skipped`` of one candidate."""
    if rate <= 0:
        return False
    x = (key + start * START + end * END) & WORD
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD
    return (x ^ x >> 31) < min(int(rate * 2.0**64), WORD)


def extents(v: Vocabulary, chars: np.ndarray, src: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, start and end of every extent that a merge may offer (and, rarely, of one that none does)."""
    owner = np.repeat(np.arange(len(src)), size)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    h = (chars[src[owner] + start] + 2).astype(U)
    out = [(np.zeros(0, np.int64),) * 3]
    for n in range(2, v.longest + 1):
        live = (start + n <= size[owner]) & v.begins[marks(h)]
        owner, start, h = owner[live], start[live], h[live]
        if not len(owner):
            break
        h = h * U(BASE) + (chars[src[owner] + start + n - 1] + 2).astype(U)
        found = v.unions[marks(h)]
        out.append((owner[found], start[found], start[found] + n))
    owner, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(owner, kind="stable")
    return owner[order], start[order], end[order]


def kinds(v: Vocabulary, chars: np.ndarray, src: np.ndarray, size: np.ndarray, content: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    """A hash per segment of its content and of the candidates that its key skips: equal ones merge alike."""
    _, first, back = np.unique(content, return_index=True, return_inverse=True)
    owner, start, end = extents(v, chars, src[first], size[first])
    begin = np.searchsorted(owner, np.arange(len(first) + 1))
    n = np.diff(begin)[back]
    out = content.copy()
    upto = np.concatenate(([0], np.cumsum(n)))
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + DRAWS, "right")) - 1)
        who = np.repeat(np.arange(a, b), n[a:b])
        at = np.repeat(begin[back[a:b]] - (upto[a:b] - upto[a]), n[a:b]) + np.arange(len(who))
        drop = np.flatnonzero(skipped(key[who], start[at], end[at], rate))
        who, at = who[drop], at[drop]
        if len(who):
            edge = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            out[who[edge]] += np.add.reduceat(mix(start[at].astype(U) << U(32) | end[at].astype(U)), edge)
        a = b
    return mix(out)


def merge_one(v: Vocabulary, chars: np.ndarray, key: int, rate: float) -> list[int]:
    """One unit by a heap: the agenda as such."""
    ids, size = chars.tolist(), len(chars)
    left, right, ends = [i - 1 for i in range(size)], [i + 1 for i in range(size)], [i + 1 for i in range(size)]
    alive = [True] * size
    agenda: list = []

    def offer(i):
        j = right[i]
        if j < size and (m := v.pairs.get(ids[i] << 32 | ids[j])) is not None:
            if not skips(key, i, ends[j], rate):
                heapq.heappush(agenda, (-v.score[m], i, ends[j], m, ends[i]))

    for i in range(size - 1):
        offer(i)
    while agenda:
        _, i, end, m, middle = heapq.heappop(agenda)
        if not alive[i] or ends[i] != middle or right[i] >= size or ends[right[i]] != end:
            continue
        j = right[i]
        ids[i], ends[i], alive[j] = m, end, False
        right[i] = right[j]
        if right[i] < size:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [x for x, a in zip(ids, alive, strict=True) if a]


def merge_many(v: Vocabulary, ids: np.ndarray, size: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments as rows of ``ids`` (-1 beyond ``size``): final ids and sizes, one merge a row and round.

    Rows that are done leave the working arrays, so a round costs what is still to do.
    """
    n, width = ids.shape
    done_ids, done_size = ids.copy(), size.copy()
    if width == 1 or not n:
        return done_ids, done_size
    column = np.arange(width)

    def offers(rows, cols):
        a, b = ids[rows, cols], ids[rows, np.minimum(cols + 1, width - 1)]
        m = v.merge(a, np.where(cols + 1 < size[rows], b, -1))
        m[skipped(key[rows], start[rows, cols], start[rows, np.minimum(cols + 2, width)], rate)] = -1
        return m

    def close_gap(x, after):
        x[:, :-1] = np.where(after, x[:, 1:], x[:, :-1])

    # working arrays: ids, bounds of the pieces, and each pair's union with the rank of its score
    where, ids, size = np.arange(n), ids.copy(), size.copy()
    start = np.minimum(np.tile(np.arange(width + 1, dtype=np.int16), (n, 1)), size[:, None].astype(np.int16))
    rows, cols = np.nonzero(column[:-1] < (size - 1)[:, None])
    union = np.full((n, width), -1, np.int32)
    union[rows, cols] = offers(rows, cols)
    value = v.rank[union]
    while len(where):
        best = value.argmax(1)
        alive = value[np.arange(len(where)), best] >= 0
        if not alive.all():
            gone = ~alive
            done_ids[where[gone]], done_size[where[gone]] = ids[gone], size[gone]
            where, ids, size, key, start, union, value, best = (x[alive] for x in (where, ids, size, key, start, union, value, best))
            if not len(where):
                break
        row = np.arange(len(where))
        merged = union[row, best]
        after = column[:-1] > best[:, None]
        for x, fill in ((ids, -1), (union, -1), (value, -1)):
            close_gap(x, after)
            x[:, -1] = fill
        close_gap(start, column > best[:, None])
        ids[row, best] = merged
        size -= 1
        union[row, best] = offers(row, best)
        value[row, best] = v.rank[union[row, best]]
        r = row[best > 0]
        c = best[best > 0] - 1
        union[r, c] = offers(r, c)
        value[r, c] = v.rank[union[r, c]]
    return done_ids, done_size


def utf8_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, one after the other, and how many each has."""
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    for k in range(4):
        has = size > k
        bits = code[has] >> (6 * (size[has] - 1 - k))
        out[at[has] + k] = (bits | lead[has]) if k == 0 else (bits & 0x3F | 0x80)
    return out, size


def characters(v: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, character ids (-1: no piece) and which are spaces."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    space = code == 0x20
    chars = v.char_id[code]
    chars[code == ord(SPACE)] = -1
    chars[space] = v.char_id[ord(SPACE)]
    return code, chars, space


def breaks(chars: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Which characters but the first begin a segment."""
    lost = chars < 0
    return lost[1:] | lost[:-1] | (space[1:] & ~space[:-1])


def cut_of(v: Vocabulary, text: str, least: int) -> tuple[int, bool]:
    """The first place of ``text`` from ``least`` on where units part, and whether segments part there."""
    for a in range(least, len(text), LOOK):
        _, chars, space = characters(v, text[a - 1 : a + LOOK])
        place = np.flatnonzero(v.apart(chars) | breaks(chars, space))
        if len(place):
            return a + int(place[0]), bool(breaks(chars, space)[place[0]])
    return len(text), True


def encode_texts(v: Vocabulary, texts: list[str], own: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text's begin (and the end).

    Skips are keyed by the seed, a text's entry of ``own`` and a segment's place in the text.  One text
    beyond ``SLICE_CHARS`` is encoded in slices cut between units.
    """
    if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
        ids, a, origin, out = None, 0, 0, []
        while a <= len(texts[0]):
            b, parted = cut_of(v, texts[0], a + SLICE_CHARS - 1)
            # places count the mark in front, so a slice behind the first begins one further
            ids, _, last = encode_slice(v, [texts[0][max(a - 1, 0) : b]], own, rate, seed, a, origin)
            out.append(ids)
            a, origin = b + 1, b + 1 if parted else last
        flat = np.concatenate(out)
        return flat, np.array([0, len(flat)])
    ids, offsets, _ = encode_slice(v, texts, own, rate, seed)
    return ids, offsets


def encode_slice(v: Vocabulary, texts: list[str], own: np.ndarray, rate: float, seed: int, start: int = 0, origin: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and bounds as in ``encode_texts``, and the place of the last segment.

    With ``start``, ``texts`` is one slice that begins at this place of its text, inside the segment of place
    ``origin``; the mark in front of a text has place 0.
    """
    front = "" if start else SPACE
    code, chars, space = characters(v, "".join(front + t for t in texts if t))
    sizes = np.array([len(front) + len(t) if t else 0 for t in texts])
    begin = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), origin
    if not start:
        space[begin[full]] = True
        chars[begin[full]] = v.char_id[ord(SPACE)]
    lost = chars < 0
    head = np.zeros(len(code), bool)
    head[1:] = breaks(chars, space)
    head[begin[full]] = True
    segment = np.cumsum(head) - 1
    place = np.flatnonzero(head)
    doc = np.searchsorted(begin[full], place, "right") - 1
    place += start - begin[full][doc]
    if start:
        place[0] = origin
    # units: the same merges, as the key takes up how far into its segment a unit begins
    head[1:] |= v.apart(chars)
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(code)))
    segment = segment[at]
    into = at - begin[full][doc[segment]] + start - place[segment]
    inner = np.arange(len(code)) - np.repeat(at, size)
    h = np.add.reduceat((chars + 2).astype(U) * powers(BASE, int(size.max()))[inner], at)
    content = mix(h + size.astype(U))
    key = mix(mix(place.astype(U)) + own[full][doc].astype(U) * U(0x9FB21C651E98DF25) + U(seed % (1 << 62)))
    key = key[segment] + into.astype(U) * U((START + END) & WORD)
    odd = lost[at]
    key, content = key[~odd], content[~odd]
    kind = content if rate <= 0 else kinds(v, chars, at[~odd], size[~odd], content, key, rate)
    _, first, back = np.unique(kind, return_index=True, return_inverse=True)
    key = key[first]
    src, length = at[~odd][first], size[~odd][first]
    counts = np.zeros(len(key), np.int64)
    pieces: list[np.ndarray] = []
    order: list[np.ndarray] = []
    low = 0
    for width in WIDTHS:
        own = np.flatnonzero((length > low) & (length <= width))
        low = width
        for a in range(0, len(own), 1 << 15):
            now = own[a : a + (1 << 15)]
            grid = src[now][:, None] + np.arange(width)
            inside = np.arange(width) < length[now][:, None]
            ids = np.where(inside, chars[np.minimum(grid, len(code) - 1)], -1).astype(np.int32)
            ids, n = merge_many(v, ids, length[now].copy(), key[now], rate)
            counts[now] = n
            pieces.append(ids[np.arange(width) < n[:, None]])
            order.append(now)
    for s in np.flatnonzero(length > low).tolist():
        ids = np.array(merge_one(v, chars[src[s] : src[s] + length[s]], int(key[s]), rate), np.int32)
        counts[s] = len(ids)
        pieces.append(ids)
        order.append(np.array([s]))
    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    order_ = np.concatenate(order) if order else np.zeros(0, np.int64)
    where = np.zeros(len(key), np.int64)
    where[order_] = np.cumsum(counts[order_]) - counts[order_]
    # lay the segments' ids out in the order of the texts
    raw, raw_n = utf8_of(code[at[odd]])
    n_ids = np.zeros(len(at), np.int64)
    n_ids[~odd] = counts[back]
    n_ids[odd] = raw_n
    pool = np.concatenate((flat, v.byte_ids[raw]))
    origin = np.zeros(len(at), np.int64)
    origin[~odd] = where[back]
    origin[odd] = len(flat) + np.cumsum(raw_n) - raw_n
    ends = np.cumsum(n_ids)
    out = pool[np.repeat(origin - (ends - n_ids), n_ids) + np.arange(int(ends[-1]))]
    per_doc = np.zeros(len(texts), np.int64)
    per_doc[full] = np.add.reduceat(n_ids, np.searchsorted(at, begin[full]))
    return out, np.concatenate(([0], np.cumsum(per_doc))), int(place[-1])


def decode_ids(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; the space that encoding puts in front is taken off."""
    upto = np.concatenate(([0], np.cumsum(v.raw_size[ids])))
    data = np.empty(int(upto[-1]), np.uint8)
    for a in range(0, len(ids), DECODED):
        now = ids[a : a + DECODED]
        n, first = v.raw_size[now], int(upto[a])
        total = int(n.sum())
        data[first : first + total] = v.raw[np.repeat(v.raw_at[now] - (upto[a : a + len(now)] - first), n) + np.arange(total)]
    bounds = upto[offsets]
    full = np.diff(bounds) > 0
    keep = np.ones(len(data), bool)
    keep[bounds[:-1][full]] = False
    return data[keep], bounds - np.concatenate(([0], np.cumsum(full)))


def _slices(texts: list[str]):
    i = 0
    while i < len(texts):
        j, room = i + 1, SLICE_CHARS - len(texts[i])
        while j < len(texts) and len(texts[j]) <= room:
            room -= len(texts[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = 0, copies: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, lossless``, a row per row of ``docs``; ``lossless``: decoding gave the text back.

    Null and empty texts have no ids.  Every occurrence of a word is cut on its own, by the seed, the row's
    id (null: its text) and the place in the text.  Repeated rows are cut alike, unless ``copies`` numbers
    the rows that share id and text, and so is every rerun.  Extra columns are ignored; an empty table
    gives no rows.  ``model`` must be readable on every executor.  A long text is cut in slices, so a task holds its
    characters, its ids and one slice; only a stretch in which every two neighbours share some piece stays whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.col("text")))
    if copies:
        alike = Window.partitionBy("id", F.xxhash64("text")).orderBy(F.lit(0))
        rows = rows.withColumn("copy", F.row_number().over(alike))
        name = F.xxhash64(name, F.col("copy"))
    rows = rows.select("id", name.alias("own"), "text")

    def make():
        v = load(model)

        def step(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            own = batch.column("own").to_numpy()
            for i, j in _slices(texts):
                ids, offsets = encode_texts(v, texts[i:j], own[i:j], dropout, seed)
                data, bounds = decode_ids(v, ids, offsets)
                data = data.tobytes()
                same = [data[a:b] == t.encode() for a, b, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts[i:j], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(same)], ["doc_id", "n_tokens", "ids", "lossless"])

        return step

    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['id']}, n_tokens long, ids array<int>, lossless boolean")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` from ids; null ids give the empty text."""
    rows = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def make():
        v = load(model)

        def step(batch: pa.RecordBatch):
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            data, bounds = decode_ids(v, ids, offsets - offsets[0])
            data = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([data[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())], ["doc_id", "text"])

        return step

    return arrow_map(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
