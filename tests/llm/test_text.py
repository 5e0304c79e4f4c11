"""Language ID, license scans, mixing, tokenising, archives."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest

from segspark.llm import langid, license_scan, mixing, pieces, textkit, warc

from ..conftest import SMALL
from . import cases


def test_words_match_patterns():
    texts = ["", "A b\tC\x0b d", "é!x 1-2", " lead", "trail ", " x", "a" * 5000]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for kind, pattern in ((textkit.NOT_SPACE, "[^\x20\x09-\x0d]+"), (textkit.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        w = textkit.words(data, offsets, 0, len(texts), kind, True)
        for d, t in enumerate(texts):
            got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
            assert got == re.findall(pattern, cases.lower(t))
        assert len(set(w.hashes().tolist())) == len({bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)})


def grams_slow(t):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", t.lower()):
        word = "".join(c for c in word if c.isalpha())
        padded = f"_{word}_"
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_ngrams_match_slow():
    texts = ["the cat sat", "", "x", "Ab-cd ef1gh", "ünï ö"]
    doc, gram, count = langid.ngrams(langid.lowered(texts))

    def name(g):
        cs = [int(g) >> 32 & 0xFFFF, int(g) >> 16 & 0xFFFF, int(g) & 0xFFFF]
        return "".join("_" if c == langid.MARK else chr(c) for c in cs if c)

    got = defaultdict(Counter)
    for d, g, c in zip(doc, gram, count, strict=True):
        got[int(d)][name(g)] += int(c)
    assert [got[i] for i in range(len(texts))] == [grams_slow(t) for t in texts]


def test_out_of_place_matches_slow():
    """Distances of the batch form against dictionaries of ranks."""
    train = {"en": ["the cat and the dog sat there"] * 2, "de": ["der hund und die katze sind hier"], "fr": ["le chat et le chien sont ici"]}
    model = []
    for lang, texts in sorted(train.items()):
        doc, gram, count = langid.ngrams([" ".join(texts)])
        model.append((lang, langid.ranked(doc, gram, count, 40)[1]))
    tests = ["the dog there", "die katze", "", "12 !", "le chien", None, "zzz"]
    best, score = langid.Scorer(model, 40)(tests)
    for t, b, s in zip(tests, best, score, strict=True):
        doc, gram, count = langid.ngrams(langid.lowered([t]))
        _, gram, rank = langid.ranked(doc, gram, count, 40)
        if not len(gram):
            assert (b, s) == ("und", 0)
            continue
        away = {n: sum(abs(list(g).index(x) - r) if x in g else 40 for x, r in zip(gram, rank, strict=True)) for n, g in model}
        assert away[b] == min(away.values()) and np.isclose(s, 1 - away[b] / (40 * len(gram)))
    assert best[:3] == ["en", "de", "und"] and best[4] == "fr"


def packed(gram):
    """A gram as the module numbers it."""
    out = 0
    for c in gram:
        n = langid.MARK if c == "_" else (ord(c) & 0xFFFF) ^ (ord(c) >> 16 << 9)
        out = out << 16 | n
    return out


def identify_slow(table, top):
    """Profiles, ranks and distances by dictionaries: ``(held_out, language, score)`` per row."""
    import struct

    import xxhash

    mixed = lambda g: int(textkit.mix(np.array([g], np.uint64))[0])
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    counts, held = defaultdict(Counter), [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in table]
    for r, h in zip(table, held, strict=True):
        if not h and r[1] is not None and r[2] is not None:
            counts[r[2]].update(grams_slow(r[1]))
    tie = lambda g: signed(xxhash.xxh64(struct.pack("<q", packed(g)), seed=42).intdigest())
    profile = {}
    for lang, c in counts.items():
        profile[lang] = {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], tie(g), packed(g)))[:top])}
    out = []
    for r, h in zip(table, held, strict=True):
        c = grams_slow(r[1] or "")
        own = sorted(c, key=lambda g: (-c[g], mixed(packed(g))))[:top]
        if not own or not profile:
            out.append((h, "und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) for lang, p in profile.items()}
        best = min(sorted(away), key=away.get)
        out.append((h, best, 1 - away[best] / (top * len(own))))
    return out


@pytest.mark.parametrize("top", [langid.PROFILE, 12])
def test_language_matches_slow(spark, top):
    """The whole query, learning included; two languages with equal profiles tie, and the first is predicted."""
    table = [(i, r[1], r[2]) for i, r in enumerate(cases.rows()) if len(r[1] or "") < 20000]
    table += [(1000 + i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("le chat noir", "fr"), ("twin words twin", "xa"), ("twin words twin", "xb"), ("twin words twin", "xa"), ("twin words twin", "xb")] * 6)]
    for twin in ("xa", "xb"):
        rows = [t for t in table if t[2] == twin and zlib.crc32(str(t[0]).encode()) % 4 != 2]
        table = [t for t in table if t not in rows] + rows[:3]
    table.append((None, "no id at all", "en"))
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
    got = Counter((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, top=top).collect())
    want = Counter((str(t[0]), h, lang, round(s, 9)) for t, (h, lang, s) in zip(table, identify_slow(table, top), strict=True))
    assert got == want and any(k[2] == "xa" for k in want) and not any(k[2] == "xb" for k in want)


def test_language_of_long_texts_in_slices(monkeypatch):
    """Slices of any size give the counts of the whole text, in memory that the text's own characters bound."""
    texts = [t for t in langid.lowered([r[1] for r in cases.rows()]) if len(t) > 3] + ["añ 日本語 x𝔘y zz", "a" * 999]
    whole = [langid.ngrams([t]) for t in texts]
    for size in (3, 7, 1000):
        monkeypatch.setattr(langid, "SLICE_CHARS", size)
        monkeypatch.setattr(langid, "FLUSH", 4)
        for t, want in zip(texts, whole, strict=True):
            if len(t) < 3000 * size:
                for got, x in zip(langid.ngrams([t]), want, strict=True):
                    assert got.tolist() == x.tolist()
    monkeypatch.undo()
    text = "many words of one very long text " * 200_000
    assert peak(lambda: langid.ngrams([text])) < 12 * len(text)


def peak(work) -> int:
    """The most bytes that were held at once."""
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_limit(spark):
    """What the limit rejects: scores below it, and only these."""
    docs = cases.frame(spark)
    scores = sorted({round(r.score, 12) for r in langid.identify(docs).collect() if r.lang_pred != "und"})
    least = scores[len(scores) // 2]
    want = sum(r.lang_pred != "und" and r.score >= least for r in langid.identify(docs).collect())
    assert langid.accepted(docs, least=least).count() == want < docs.count()
    foreign = docs.limit(0).unionByName(spark.createDataFrame([(1, "ж ъ љ")], "doc_id long, text string"), allowMissingColumns=True)
    assert langid.accepted(docs.unionByName(foreign)).where("text = 'ж ъ љ'").count() == 0
    assert langid.accepted(docs.limit(0)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_language_edges(spark):
    docs = cases.frame(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == len(cases.rows())
    by = defaultdict(set)
    text = {r[0]: r[1] for r in cases.rows()}
    for r in rows:
        by[text[r.doc_id]].add((r.lang_pred, r.score))
        assert r.lang_pred in ("en", "de", "und")
        if not any(c.isalpha() for c in text[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert all(len(x) == 1 for x in by.values())
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    nothing = docs.withColumn("lang", docs.lang.substr(0, 0)).where("lang is null")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} <= {"und"}
    assert langid.identify(docs.where("doc_id = -1")).count() == 0


LICENSED = [
    "Under the MIT License. Under the mit-license", "apache license, version 2.0", "CC BY-NC", "cc by nc cc by nc", "under the mit", "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under a GNU General Public License (version 3)", "Released\nunder the MIT\nLicense!", "x " * 500 + "permission is hereby granted free of charge to any person obtaining a version of this software and associated documentation files " + "y " * 300,
    None, "", "...", "under the mit license under the mit license",
]


def scan_slow(t, templates=license_scan.TEMPLATES):
    """All blocks of every template's class against the template's set of words."""
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", cases.lower(t))
    base = [(i, label) for p, label in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    found, share = {x for _, x in base}, 0.0
    for label, text in templates:
        own = set(text.split())
        step = 32
        while step < len(text.split()):
            step *= 2
        for s in range(0, max(1, len(ws) - step), step):
            block = set(ws[s : s + 2 * step])
            if len(own & block) >= license_scan.need_of(len(own), license_scan.THRESHOLD):
                found.add(label)
                share = max(share, len(own & block) / len(own))
    at = [i for i, _ in base]
    return (len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(found)), 1.0 if base else share)


def test_license_filters():
    """Each filter rejects blocks that the others let pass, and none rejects a block that meets the threshold."""
    import random

    r = random.Random(3)
    vocab = license_scan.vocabulary((("t", " ".join(f"w{i}" for i in range(40))),))
    texts = tuple((f"t{k}", " ".join(f"w{i}" for i in r.sample(range(40), 12))) for k in range(3))
    join = license_scan.Templates(texts, 32, vocab, np.arange(len(vocab)), 0.75)
    rejected = 0
    for _ in range(4000):
        held = np.array(sorted(r.sample(range(40), r.randrange(9, 24))))
        met = [x for x in held.tolist() if x in join.index]
        opened = set(join.open_for(held, met))
        touched = {t for x in met for t, _ in join.index[x]}
        rejected += len(touched - opened)
        assert {t for t in range(3) if len(set(held.tolist()) & set(join.words[t])) >= join.need[t]} <= opened
    assert rejected > 100


def test_license_scan(spark):
    texts = LICENSED + [r[1] for r in cases.rows()]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == scan_slow(t)[:6], t
        assert np.isclose(r.score, scan_slow(t)[6])
    assert got[5].labels == "gpl-3" and got[8].labels == "mit" and got[3].n_base == 2
    assert license_scan.scan(docs.where("doc_id < 0")).count() == 0


def test_license_texts_of_any_length(spark):
    """Whole public texts with a few words changed, behind prose of all lengths, and a template of 100 words."""
    import random

    from segspark.llm import license_texts

    r, texts, want = random.Random(3), [], []
    for label, text in (("mit", license_texts.MIT), ("bsd", license_texts.BSD_3), ("apache-2", license_texts.APACHE_2), ("isc", license_texts.ISC)):
        for ahead in (0, 1, 31, 33, 200, 1023, 1900):
            ws = text.split()
            for _ in range(len(ws) // 60):
                ws[r.randrange(len(ws))] = "altered"
            texts.append(cases.prose(r, ahead, 900) + " " + " ".join(ws) + " " + cases.prose(r, r.randrange(300), 900))
            want.append(label)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan.scan(docs).collect()
    for q in rows:
        assert want[q.doc_id] in q.labels.split(",") and q.score >= 0.9, (want[q.doc_id], q.labels)
        assert q.labels == scan_slow(texts[q.doc_id])[5]
    own = (("long", " ".join(f"term{i}" for i in range(100))),)
    docs = spark.createDataFrame([(i, "filler " * i + own[0][1] + " filler" * 50) for i in range(0, 200, 17)], "doc_id long, text string")
    got = license_scan.scan(docs, templates=own)
    assert {(q.labels, q.score) for q in got.collect()} == {("long", 1.0)}
    with pytest.raises(ValueError):
        license_scan.scan(docs, templates=(("none", "..."),))


def test_mixing(spark):
    got = mixing.mix(cases.frame(spark)).collect()
    table = cases.rows()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in table)
    size = defaultdict(int)
    for r in table:
        size[r[3]] += len(cases.SPACE.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    # shares by raising a level until nothing is left over
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and np.isclose(r.target, target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in names)
    again = mixing.mix(cases.frame(spark).repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_running_sums_by_range(spark):
    import random

    from segspark.llm.common import Scratch

    values = [(i, float(random.Random(i).randrange(9))) for i in range(500)]
    rows = spark.createDataFrame(values, "k long, v double").repartition(6)
    got = {r.k: r.s for r in mixing.running(Scratch(spark, "t"), rows, ["k"], {"s": "v"}, "t").collect()}
    assert got == {k: sum(v for _, v in values[:k]) for k, _ in values}
    many = spark.createDataFrame([(i, "a b c", f"source{i % 150:03d}") for i in range(600)], "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix(many).collect()}
    assert all(np.isclose(t, 1800 * (1 + i % 3) / 300) for i, (s, t) in enumerate(sorted(target.items())))


def test_mixing_cells(spark):
    """Ranks are gapless whatever the cell size, so each source meets its target."""
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string")
    for cell in (1, 7, 1000):
        got = mixing.mix(docs, cell_rows=cell).collect()
        for s in "st":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0 and mixing.mixed(docs.where("doc_id < 0")).count() == 0
    empty = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]


def test_mixing_ids(spark):
    """Strided, textual, shared and missing ids: no task ranks everything, and rows are taken each for itself."""
    from segspark.llm.common import Scratch

    docs = spark.range(20480).selectExpr("id * 20 as doc_id", "'a b c d' as text", "'s' as source")
    seen = {}
    save = Scratch.save

    def spy(self, df, name):
        out = save(self, df, name)
        if name == "sizes":
            seen["deal"] = [r.deal % 20 for r in out.collect()]
        return out

    Scratch.save = spy
    try:
        assert mixing.mix(docs).agg({"taken": "sum"}).first()[0] == 4 * 20480
    finally:
        Scratch.save = save
    assert max(Counter(seen["deal"]).values()) < 2 * 1024
    named = spark.createDataFrame([(f"n{i}", "a b " * (1 + i % 3), "st"[i % 2]) for i in range(50)], "doc_id string, text string, source string")
    assert mixing.mix(named).count() == 50 and mixing.mixed(named).columns == named.columns
    # the verdict's case, and rows without an id, and identical rows
    table = [(1, "one two", "s"), (1, "three four five", "t"), (None, "six", "s"), (None, "seven eight", "t"), (2, "same row", "t"), (2, "same row", "t")] + [(10 + i, "w " * (i + 1), "stu"[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed(docs).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


TEXTS = ["Hello  world \n x 日本 ｆｕｌｌ", "", " lead", " ", "a  b   c    d ", "ünïcödé 𝔘 x▁y ▁ z", "a" * 100 + " " + "the" * 30, "\u0000▁▁", "▁"]


def test_pieces_without_dropout():
    import sentencepiece

    v = pieces.load(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in TEXTS if "▁" not in t and "\0" not in t] + [r[1] or "" for r in cases.rows() if len(r[1] or "") < 5000 and "▁" not in (r[1] or "")]
    ids, at = pieces.encode_texts(v, texts, np.zeros(len(texts), int), 0.0, 0)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_batch_merges_are_the_agenda(rate):
    """The side-by-side merges against the heap, segment by segment."""
    v = pieces.load(pieces.MODEL)
    words = sorted({w for r in cases.rows() for w in (r[1] or "").split()[:300] if len(w) < 24} | {"internationalisation", "the", "aaaaaaaaaaa", "x"})
    chars = [np.array([v.char_id[ord(c)] for c in pieces.SPACE + w], np.int32) for w in words]
    chars = [c for c in chars if (c >= 0).all()]
    size = np.array([len(c) for c in chars])
    grid = np.full((len(chars), 24), -1, np.int32)
    for i, c in enumerate(chars):
        grid[i, : len(c)] = c
    key = textkit.mix(np.arange(len(chars), dtype=np.uint64) + np.uint64(9))
    ids, n = pieces.merge_many(v, grid, size, key, rate)
    for i, c in enumerate(chars):
        assert ids[i, : n[i]].tolist() == pieces.merge_one(v, c, int(key[i]), rate)
    if rate == 1.0:
        assert (n == size).all()


def test_pieces_are_lossless_and_varied(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, None, "the same words here again"])] + [(100 + i, "the same words here again and again") for i in range(0)] , "doc_id long, text string, ids string")
    for rate in (0.0, 0.3):
        got = pieces.encode(docs, dropout=rate)
        assert got.where("not lossless").count() == 0
        back = {r.doc_id: r.text for r in pieces.decode(got).collect()}
        assert back == {r.doc_id: r.text or "" for r in docs.collect()}
        assert all(r.n_tokens == len(r.ids) for r in got.collect())
    text = "international tokenisation varies between documents considerably " * 3
    many = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    cuts = {tuple(r.ids) for r in pieces.encode(many, dropout=0.3).collect()}
    assert len(cuts) == 40
    one, two = ([tuple(r.ids) for r in pieces.encode(many, dropout=0.3, seed=s).orderBy("doc_id").collect()] for s in (1, 2))
    assert one != two and one == [tuple(r.ids) for r in pieces.encode(many.repartition(3), dropout=0.3, seed=1).orderBy("doc_id").collect()]
    assert len({tuple(r.ids) for r in pieces.encode(many, dropout=0.0).collect()}) == 1
    assert pieces.encode(many.where("doc_id < 0")).count() == 0 and pieces.encode(cases.frame(spark)).where("not lossless").count() == 0


def test_every_occurrence_is_cut_on_its_own(spark, monkeypatch):
    """Copies, places and documents vary; sharing equal kinds gives what each segment alone gives."""
    import corpus_pipeline

    text = "international tokenisation varies between documents considerably " * 20 + "ab" * 40
    docs = spark.createDataFrame([(i // 3, text) for i in range(60)], "doc_id long, text string")
    cuts = [tuple(r.ids) for r in corpus_pipeline.tokenise(spark, docs, "").collect()]
    assert len(set(cuts)) == len(cuts) == 60
    assert sorted(cuts) == sorted(tuple(r.ids) for r in corpus_pipeline.tokenise(spark, docs.repartition(7), "").collect())
    v = pieces.load(pieces.MODEL)
    texts, own = [text, text, "x ▁ 日本 again again", ""], np.array([5, -6, 7, 8])
    words = [w for w in text.split() if w == "considerably"]
    ids, at = pieces.encode_texts(v, texts, own, 0.3, 1)
    piece = [bytes(v.raw[a : a + n]) for a, n in zip(v.raw_at, v.raw_size, strict=True)]
    ways = set(re.findall(rb"(?:(?<=\|)|^)( \|?c\|?o\|?n\|?s\|?i\|?d\|?e\|?r\|?a\|?b\|?l\|?y)(?=\||$)", b"|".join(piece[i] for i in ids[: at[1]])))
    assert len(words) == 20 and len(ways) > 4
    monkeypatch.setattr(pieces, "kinds", lambda v, chars, src, size, content, key, rate: key)
    plain = pieces.encode_texts(v, texts, own, 0.3, 1)
    assert ids.tolist() == plain[0].tolist() and at.tolist() == plain[1].tolist()


def slow_pieces(proc, text, key, rate, piece_ids):
    """One text cut by dictionaries and a loop over all pairs; only the drawing of skips is the module's rule."""
    M = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & M
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & M
        return x ^ x >> 31

    out, at, spaced = [], 0, "\0" + text if text else ""
    # segments: a space after a non-space starts one, a character without a piece is one
    segments, now = [], []
    for i, c in enumerate(spaced):
        lost = i > 0 and (c == "▁" or (c != " " and c not in piece_ids))
        space = i == 0 or c == " "
        if lost:
            segments += [now, [(i, None)]]
            now = []
        else:
            if space and now and now[-1][1] != "▁":
                segments.append(now)
                now = []
            now.append((i, "▁" if space else c))
    segments.append(now)
    for seg in segments:
        if not seg:
            continue
        begin = seg[0][0]
        if seg[0][1] is None:
            out += [proc.piece_to_id(f"<0x{b:02X}>") for b in spaced[begin].encode()]
            continue
        own = mix((mix(begin) + (key & M) * 0x9FB21C651E98DF25 + 0) & M)
        parts = [(i - begin, i - begin + 1, c) for i, c in seg]
        while True:
            best = None
            for a, b in zip(parts[:-1], parts[1:], strict=True):
                union = a[2] + b[2]
                if union not in piece_ids:
                    continue
                if rate > 0 and mix((own + a[0] * 0xD6E8FEB86659FD93 + b[1] * 0xA0761D6478BD642F) & M) < min(int(rate * 2.0**64), M):
                    continue
                score = proc.get_score(piece_ids[union])
                if best is None or score > best[0]:
                    best = (score, a, b)
            if best is None:
                break
            i = parts.index(best[1])
            parts[i : i + 2] = [(best[1][0], best[2][1], best[1][2] + best[2][2])]
        out += [piece_ids[p] for _, _, p in parts]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_pieces_match_slow(rate):
    """Whole texts, dropout included, against a plain loop over pairs with the package's piece table."""
    import sentencepiece

    proc = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [i for i in range(proc.get_piece_size()) if not (proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i) or proc.is_byte(i))]
    table = {proc.id_to_piece(i): i for i in plain}
    texts = [*TEXTS, "internationalisation of the considerable  tokenisation, again internationalisation", *(r[1][:300] for r in cases.rows() if r[1] and len(r[1]) > 50)]
    own = np.arange(len(texts)) * 7 - 5
    ids, at = pieces.encode_texts(pieces.load(pieces.MODEL), texts, own, rate, 0)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == slow_pieces(proc, t, int(own[i]), rate, table), t


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_pieces_of_long_texts_in_slices(rate, monkeypatch):
    """Slices of any size give the ids of the whole text and keep it lossless, without spaces too."""
    v = pieces.load(pieces.MODEL)
    texts = [t for t in TEXTS if len(t) > 6] + [r[1][:4000] for r in cases.rows() if len(r[1] or "") > 6] + ["東京都の日本語文章" * 40, "x▁▁y" * 30, "internationalisation" * 60]
    own = np.arange(len(texts)) * 11 - 3
    whole = [pieces.encode_texts(v, [t], own[i : i + 1], rate, 4) for i, t in enumerate(texts)]
    for size, look in ((5, 2), (64, 16)):
        monkeypatch.setattr(pieces, "SLICE_CHARS", size)
        monkeypatch.setattr(pieces, "LOOK", look)
        for i, t in enumerate(texts):
            ids, at = pieces.encode_texts(v, [t], own[i : i + 1], rate, 4)
            assert ids.tolist() == whole[i][0].tolist() and at.tolist() == whole[i][1].tolist(), t
            data, bounds = pieces.decode_ids(v, ids, at)
            assert data.tobytes().decode() == t and bounds.tolist() == [0, len(data)]


def test_pieces_of_long_texts_in_memory():
    v = pieces.load(pieces.MODEL)
    text = "many words of one very long text " * 200_000
    most = {}
    for n in (1, 2):
        ids, at = pieces.encode_texts(v, [text[: len(text) // 2 * n]], np.zeros(1, int), 0.1, 0)
        most[n] = peak(lambda n=n: pieces.encode_texts(v, [text[: len(text) // 2 * n]], np.zeros(1, int), 0.1, 0))
        assert peak(lambda ids=ids, at=at: pieces.decode_ids(v, ids, at)) < 14 * len(text)
    # a slice's arrays, and ids and characters of the whole
    assert most[2] - most[1] < 8 * (len(text) - len(text) // 2)


HTML = ["<p>a</p>", "", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "x\r\n\r\n\r\n\r\ny", "é日本", "<p>a</p>", "z" * 300000, "\r\n\r\n", "ends so\r\n", "\r\nbegins so", "\r", "\r\n\r", "\n\r\n\r\n\r\n\r", "lone\nlines\rof all\r\nkinds", "\r\n\r\r\n\r\n" * 30000, "big " * 3_000_000]


def test_warc(spark):
    pages = [(i, f"http://e.org/{i}\r\nX: 1", h) for i, h in enumerate(HTML)] + [(50, None, "<p>a</p>"), (51, "u", ""), (52, "u", "same"), (52, "u", "other"), (None, "u", "<p>a</p>"), (3, "u", HTML[3])]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, kind string").repartition(3)
    _, path = warc.archive(df)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(pages)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    want = sorted((str(i), len((h or "").encode()), digest(h), "response" if i == first[digest(h)] else "revisit", None if i == first[digest(h)] else first[digest(h)]) for i, _, h in pages)
    assert sorted((str(r.page_id), r.octets, r.digest, r.kind, r.refers) for r in got) == want
    bodies = {r.digest: r.payload for r in got if r.kind == "response"}
    assert all(bodies[digest(h)] == (h or "") for _, _, h in pages)
    assert all(r.payload == "" for r in got if r.kind == "revisit")
    _, none = warc.archive(df.where("page_id = -1"))
    assert warc.read_archive(spark, none).count() == 0


@pytest.mark.parametrize("kind,ids", [("string", ["a", "b:>", " é%", None, "10", "9"]), ("decimal(20,2)", [Decimal("-1.50"), Decimal("2.00"), Decimal("10.00"), None, Decimal("3.25"), Decimal("4.00")])])
def test_warc_ids_of_other_types(spark, kind, ids):
    """Ids come back as they were, and the least of their type answers for equal payloads."""
    bodies = ["same", "same", "same", "other", "x", "x"]
    df = spark.createDataFrame([(i, "http://e.org/", b) for i, b in zip(ids, bodies, strict=True)], f"page_id {kind}, url string, html string").repartition(3)
    _, path = warc.archive(df)
    rows = warc.read_archive(spark, path, id_type=kind).collect()
    first = {b: min(i for i, x in zip(ids, bodies, strict=True) if x == b and i is not None) for b in ("same", "x")}
    want = [(str(i), "response" if first.get(b, i) == i else "revisit", str(None if first.get(b, i) == i else first[b])) for i, b in zip(ids, bodies, strict=True)]
    assert sorted((str(r.page_id), r.kind, str(r.refers)) for r in rows) == sorted(want)


def test_warc_headers(spark):
    """Names of records are unique, revisits name their response, and blocks are HTTP responses."""
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3", "y")], "page_id long, url string, html string")
    _, path = warc.archive(pages)
    raw = path.removesuffix("dedup") + "raw"
    records = []
    for folder in (raw, path):
        lines = spark.read.option("lineSep", "\r\n\r\n").text(folder).collect()
        records += list(warc.parse(r.value.encode() for r in lines))
    names = [h["WARC-Record-ID"] for h, _ in records]
    assert len(set(names)) == len(names) == 6
    (revisit, block), = [(h, b) for h, b in records if h["WARC-Type"] == "revisit"]
    response = next(h for h, _ in records[3:] if h["WARC-Record-ID"] == revisit["WARC-Refers-To"])
    assert block == b"" and revisit["WARC-Refers-To-Target-URI"] == response["WARC-Target-URI"] == "http://a/1" and "WARC-Refers-To-Date" in revisit
    assert all(b.startswith(b"HTTP/1.1 200 OK\r\n") for h, b in records if h["WARC-Type"] == "response")


def test_warc_stream_of_any_size():
    """Parsing holds about one record, not the archive."""
    import tracemalloc

    one = b"WARC/1.1\r\nContent-Length: 1000000\r\n\r\n" + b"z" * 1000000
    tracemalloc.start()
    n = sum(len(b) for _, b in warc.parse(p for _ in range(300) for p in one.split(b"\r\n\r\n")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000_000 and peak < 20_000_000


def test_warc_least_bytes(spark):
    headers = spark.createDataFrame([(1, "u", 3, "A"), (2, "u", 3, "A"), (3, "u", 9, "B"), (4, "u", 9, "B")], "page_id long, url string, octets long, digest string")
    got = {r.page_id: (r.kind, r.refers) for r in warc.resolve(headers, least_bytes=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_warc_damage_is_found():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pieces = lambda x: x.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")
    assert list(warc.parse(pieces(good))) == [({"Content-Length": "3"}, b"abc")]
    for bad in (good.replace(b"abc", b"abcd"), good.replace(b"abc", b"ab"), b"junk\r\n\r\n", good + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(pieces(bad)))
