"""Exact, near, passage and embedding deduplication against brute force."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.llm import embed_dedup, exact_dedup, ngram_join, repeats, substring_dedup, suffix_dedup
from segspark.llm.common import Scratch, components

from . import cases


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_exact(spark, chunk):
    docs = cases.frame(spark)
    got = exact_dedup.exact_dedup(docs, chunk_bytes=chunk).collect()
    table = cases.rows()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in table)
    groups = defaultdict(list)
    for r in table:
        groups[r[1] or ""].append(r[0])
    want = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, hashlib.sha256(t.encode()).hexdigest()] = (max(known) if known else None, len(ids))
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.doc_id, r.text_sha256]
    # one row of each group stays
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_collision_is_split(spark, monkeypatch):
    """With fingerprints that collide, the chunkwise comparison still tells texts apart."""
    monkeypatch.setattr(exact_dedup, "MODULI", (3, 2))
    docs = spark.createDataFrame([(i, f"text {i % 20:02d}") for i in range(60)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 60 and all(r.group_size == 3 and r.keep_id == 40 + r.doc_id % 20 for r in got)


def test_exact_keep_one(spark):
    docs = cases.frame(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in cases.rows()})


def shingles(t):
    ws = cases.SPACE.findall(cases.lower(t))
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def near_truth(table):
    sets = [shingles(r[1]) for r in table]
    links = [(a, b) for a, b in itertools.combinations(range(len(table)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = cases.components(range(len(table)), links)
    least = defaultdict(list)
    for i, c in comp.items():
        if table[i][0] is not None:
            least[c].append(table[i][0])
    return sorted((str(table[i][0]), len(sets[i]), str(min(least[comp[i]]) if least[comp[i]] and sets[i] else table[i][0])) for i in range(len(table)))


def test_near(spark):
    got = ngram_join.near_duplicates(cases.frame(spark)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_truth(cases.rows())


@pytest.mark.parametrize("budget", [(4, 300), (1 << 17, 1 << 21)])
def test_near_tiles(spark, monkeypatch, budget):
    """Large groups of near copies, in one tile and in many."""
    import random

    monkeypatch.setattr(ngram_join, "BUCKET_DOCS", budget[0])
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", budget[1])
    r = random.Random(5)
    table = []
    for g in range(4):
        base = cases.prose(r, 60 + 30 * g, 10**6).split()
        for _ in range(25):
            ws = base[: len(base) - r.randrange(len(base) // 5)]
            for _ in range(r.randrange(4)):
                ws[r.randrange(len(ws))] = f"z{r.randrange(10**6)}"
            table.append((len(table) * 7 % 101 + 1000 * len(table), " ".join(ws)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = ngram_join.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_truth(table)
    assert ngram_join.keep_one(docs).count() == len({r.component_id for r in got})


def arrays_of(spark, sets):
    rows = [(i, 7, len(x), np.array(sorted(x), np.uint64).tobytes()) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, "sid long, root long, n long, arr binary").repartition(3)


@pytest.mark.parametrize(("tile", "hubs", "meetings"), [(400, 1, 1), (900, 4, 2)])
def test_near_large_candidate_component(spark, monkeypatch, tile, hubs, meetings):
    """One candidate component of stars, chains and sets that stand alone, some linked to one far end only."""
    import random

    for name, n in (("TILE_SHINGLES", tile), ("HUBS", hubs), ("MEETINGS", meetings)):
        monkeypatch.setattr(ngram_join, name, n)
    r = random.Random(8)
    sets = []
    for family in range(3):
        base = list(range(1000 * family, 1000 * family + 60 + 25 * family))
        sets += [{*r.sample(base, len(base) - r.randrange(8)), *r.sample(range(10**6, 10**7), r.randrange(6))} for _ in range(30)]
    # a window that moves on by a few shingles links with its neighbours alone, and sizes grow over many bands
    sets += [set(range(10**8 + 4 * i, 10**8 + 4 * i + 40 + 2 * i)) for i in range(40)]
    sets += [set(r.sample(range(10**9, 10**10), 50)) for _ in range(15)]
    sets = [x for i, x in enumerate(sets) if x not in sets[:i]]
    true = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    links = {(x.a, x.b) for x in ngram_join.large_links(Scratch(spark, "test"), arrays_of(spark, sets)).collect()}
    assert links <= set(true)
    assert cases.components(range(len(sets)), list(links)) == cases.components(range(len(sets)), true)


def test_near_large_group_needs_no_block_pairs(spark, monkeypatch):
    """Different near copies of one text: a set travels once, then a few hubs; two strays meet the rest, nothing else does."""
    import random

    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 2000)
    sent = []
    tiled = ngram_join._tiled
    monkeypatch.setattr(ngram_join, "_tiled", lambda rows, key: (sent.append((key, rows.count())), tiled(rows, key))[1])
    r = random.Random(9)
    base = range(100)
    copies = [{*r.sample(base, 98), 1000 + i} for i in range(400)]
    ngram_join.large_links(Scratch(spark, "test"), arrays_of(spark, copies)).collect()
    assert sent[0][1] == 400 and len(sent) == 2 and sent[1][1] <= 21 * ngram_join.HUBS
    sent.clear()
    strays = [set(range(5000 + 200 * i, 5100 + 200 * i)) for i in range(2)]
    ngram_join.large_links(Scratch(spark, "test"), arrays_of(spark, copies + strays)).collect()
    blocks = -(-400 * 99 // 1000)
    assert sent[-1][0][1] == "side" and sent[-1][1] <= 400 + 2 * blocks + 2


def test_near_copies_read_by_several_tasks(spark, monkeypatch):
    """A set is one member of its buckets however many tasks read it: unrelated texts never share one."""
    import random

    kept = {}
    save = Scratch.save

    def spy(self, df, name):
        out = save(self, df, name)
        if name == "posts":
            kept["rows"] = [(r.gid, r.sid) for r in out.collect()]
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    r = random.Random(8)
    texts = [cases.prose(r, 40, 10**6) for _ in range(30)]
    near = texts[0].split()
    near[20] = "other"
    half = [spark.createDataFrame([(i + 100 * k, t) for i, t in enumerate([*texts, " ".join(near)])], "doc_id long, text string").coalesce(1) for k in range(3)]
    table = [(i + 100 * k, t) for k in range(3) for i, t in enumerate([*texts, " ".join(near)])]
    got = ngram_join.near_duplicates(half[0].union(half[1]).union(half[2])).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == near_truth(table)
    members = defaultdict(set)
    for gid, sid in kept["rows"]:
        members[gid].add(sid)
    assert members and len(set.union(*members.values())) == 2 and max(map(len, members.values())) == 2


def kept_truth(table):
    """Texts that stay: one row a component, rows without words all."""
    comp = {}
    sets = [shingles(r[1]) for r in table]
    links = [(a, b) for a, b in itertools.combinations(range(len(table)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = cases.components(range(len(table)), links)
    return len({c for i, c in comp.items() if sets[i]}) + sum(not s for s in sets), comp, sets


def test_near_keep_one_of_shared_ids(spark):
    """Rows that share an id, or have none, in one component or several: one row of each stays."""
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    table = [(1, a), (1, b), (1, a + "x"), (2, b + "y"), (None, c), (None, c + "z"), (None, c), (5, c + "q"), (7, None), (7, ""), (None, "lone row without an id here"), (None, "lone row without an id here")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()]
    n, comp, sets = kept_truth(table)
    assert len(kept) == n == 6
    roots = Counter(next(comp[i] for i, t in enumerate(table) if t == k) for k in kept if k[1])
    assert set(roots.values()) == {1} and (5, c + "q") in kept and Counter(k[0] for k in kept)[7] == 2


def test_near_names_that_collide(spark, monkeypatch):
    """Set names from a tiny range: sets that share one are told apart by the second hash."""
    plain = ngram_join.set_id
    monkeypatch.setattr(ngram_join, "set_id", lambda s, salt=0x51: plain(s, salt) % 7 if salt == 0x51 else plain(s, salt))
    got = ngram_join.near_duplicates(cases.frame(spark)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_truth(cases.rows())


def test_near_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_DOCS", 3)
    got = ngram_join.near_duplicates(cases.frame(spark)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_truth(cases.rows())


def test_near_shingles_of_a_vast_corpus(spark, monkeypatch):
    """Every count far above the limit, as in a corpus of very many shingles: none is hot for that, no lone set is kept."""
    merged, save, lone = ngram_join.sketch.merged, Scratch.save, []

    def spy(self, df, name):
        out = save(self, df, name)
        if name == "members":
            lone.append((out.count(), out.where("size = 1").count(), out.where("hot").count()))
        return out

    want = ngram_join.near_duplicates(cases.frame(spark)).collect()
    monkeypatch.setattr(Scratch, "save", spy)
    ngram_join.near_duplicates(cases.frame(spark)).collect()
    monkeypatch.setattr(ngram_join.sketch, "merged", lambda rows: merged(rows) + np.uint32(10**9))
    got = ngram_join.near_duplicates(cases.frame(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and lone[0] == lone[1] and lone[0][0] > 0 and lone[0][1:] == (0, 0)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == near_truth(cases.rows())


def covered(table, length):
    where = defaultdict(list)
    docs = [(r[1] or "").encode().split() for r in table]
    for d, ws in enumerate(docs):
        for p in range(len(ws) - length + 1):
            where[tuple(ws[p : p + length])].append((d, p))
    gone = [set() for _ in docs]
    for at in where.values():
        if len(at) > 1:
            for d, p in at:
                gone[d].update(range(p, p + length))
    return sorted((str(table[d][0]), len(ws), len(gone[d]), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone[d])).hexdigest()) for d, ws in enumerate(docs))


def removed(rows):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows)


def test_substring_names_that_collide(spark, monkeypatch):
    """Row names from a tiny range: rows that share one are told apart by the second hash."""
    plain = F.xxhash64
    monkeypatch.setattr(repeats.F, "xxhash64", lambda *c: F.pmod(plain(*c), F.lit(5)) if len(c) == 2 else plain(*c))
    got = removed(substring_dedup.substring_dedup(cases.frame(spark)).collect())
    monkeypatch.setattr(repeats.F, "xxhash64", plain)
    assert got == covered(cases.rows(), 35)


@pytest.mark.parametrize("batch", [1 << 20, 500])
def test_substrings(spark, monkeypatch, batch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    assert removed(substring_dedup.substring_dedup(cases.frame(spark)).collect()) == covered(cases.rows(), 35)


@pytest.mark.parametrize("chunk,part", [(4096, 1 << 14), (3, 1 << 14), (4096, 4), (3, 2)])
def test_suffixes(spark, monkeypatch, chunk, part):
    """Whole partitions compared at once, and three suffixes at a time; beginnings whole, and in parts."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", part)
    assert removed(suffix_dedup.suffix_dedup(cases.frame(spark)).collect()) == covered(cases.rows(), 50)


def test_suffixes_of_periodic_texts(spark):
    """Long periods, one of them with a fault, and the same passage behind many different beginnings."""
    import random

    r = random.Random(4)
    passage = cases.prose(r, 70, 10**6)
    texts = ["tick tock " * 300, "tick " * 200, "tick tock " * 60 + "fault " + "tick tock " * 60, " ".join(f"p{i % 37}" for i in range(400)), " ".join(f"p{i % 37}" for i in range(5, 250))]
    texts += [f"{cases.prose(r, r.randrange(40), 9)} {passage} {cases.prose(r, r.randrange(40), 9)}" for _ in range(30)]
    texts += [passage + " " + " ".join(passage.split()[k:]) for k in range(0, 40, 7)] + ["w" * 5000 + " " + passage + " " + "é" * 3000, "w" * 5000 + " " + passage + " " + "é" * 3000 + " end"]
    table = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (None, passage)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert removed(suffix_dedup.suffix_dedup(docs).collect()) == covered(table, 50)
    assert removed(substring_dedup.substring_dedup(docs).collect()) == covered(table, 35)


def test_shared_words():
    import pyarrow as pa

    texts = [b"a b c ", b"a b cd ", b"a b cd e ", b"", b"", b"x ", b"x ", b"y "]
    assert suffix_dedup.shared_words(pa.array(texts, pa.binary())).tolist() == [2, 3, 0, 0, 0, 1, 0]


def test_buckets_of_any_number(monkeypatch):
    """Bucket numbers beyond 32 bits pass through the packed rows."""
    h = np.array([1 << 63, (1 << 63) + 5, (1 << 64) - 1], np.uint64)
    some, (cut,) = repeats._cuts(34, h)
    rows = [b for batch in repeats._batches(some, [(h, cut)], ["x"]) for b in batch.column("bucket").to_pylist()]
    assert rows == [1 << 33, (1 << 34) - 1]


def test_size_comes_from_the_texts(spark):
    """A plan whose size the planner does not know has as many buckets as its texts ask for."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('word ', 40) AS text")
    joined = docs.join(docs.select("doc_id").withColumnRenamed("doc_id", "k"), F.col("doc_id") < F.col("k")).where("k = doc_id + 1").select("doc_id", "text")
    assert repeats.bucket_bits(joined, F.col("text")) == repeats.bucket_bits(docs, F.col("text")) == 5


@pytest.mark.parametrize("seed", range(3))
def test_passages_random(spark, seed):
    """Few distinct words, so that repeats of all lengths, overlapping ones included, occur."""
    import random

    r = random.Random(seed)
    table = [(i, " ".join(r.choice("ab") if r.random() < 0.03 else "a" for _ in range(r.randrange(10, 90)))) for i in range(12)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for got, length in ((substring_dedup.substring_dedup(docs, window=12, with_text=True), 12), (suffix_dedup.suffix_dedup(docs, length=20), 20)):
        rows = got.collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in rows) == covered(table, length)
        for x in rows:
            assert sum(e - s for s, e in zip(x.spans[::2], x.spans[1::2], strict=True)) == x.n_removed
            if x.kept is not None:
                assert hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256


def vectors(r):
    out = []
    base = r.normal(size=(6, 12))
    for i in range(60):
        out.append((i, (base[i % 6] + r.normal(size=12) * r.choice([0.0, 0.02, 0.08, 1.0])).tolist(), i % 4 if i % 9 else None))
    nan = float("nan")
    out += [(100, None, 1), (101, [0.0] * 12, 1), (102, [nan] + [1.0] * 11, 1), (103, [float("inf")] + [1.0] * 11, 1), (104, [1.0, None] + [1.0] * 10, 1), (105, [], 1), (106, [1e-200] * 12, 1), (107, [1e200] * 12, 1), (108, [1.0] * 5, 1), (109, [2.0] * 5, 1), (110, [1.0] * 12, None)]
    out += [out[5], (None, out[7][1], out[7][2])]
    return out


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_LIST", 8)
    monkeypatch.setattr(embed_dedup, "BLOCK", 3)
    table = vectors(np.random.default_rng(0))
    df = spark.createDataFrame([(*t, "extra", 1) for t in table], "vec_id long, embedding array<double>, label int, gid string, list int").repartition(4)
    got = embed_dedup.near_duplicates(df).collect()

    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) if label is not None else None for _, v, label in table]
    links = [(a, b) for a, b in itertools.combinations(range(len(table)), 2) if units[a] is not None and units[b] is not None and table[a][2] == table[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98]
    comp = cases.components(range(len(table)), links)
    least = defaultdict(list)
    for i, c in comp.items():
        least[c] += [table[i][0]] if table[i][0] is not None else []
    n = Counter(i for pair in links for i in pair)
    want = sorted((str(t[0]), n[i], str(min(least[comp[i]], default=None))) for i, t in enumerate(table))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and sum(n.values()) > 50


def test_embedding_names_that_collide(spark, monkeypatch):
    """First hashes from a tiny range: entries that share one are told apart by the second."""
    plain = F.xxhash64
    monkeypatch.setattr(embed_dedup.F, "xxhash64", lambda *c: plain(*c) if len(c) != 3 else F.pmod(plain(*c), F.lit(9)))
    table = [t for t in vectors(np.random.default_rng(0)) if t[0] is not None]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(embed_dedup.F, "xxhash64", plain)
    assert got == {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}


def test_embedding_tight_groups(spark, monkeypatch):
    """A crowd whose centres lie closer than single precision can tell, and satellites near its edge."""
    monkeypatch.setattr(embed_dedup, "PER_LIST", 16)
    r = np.random.default_rng(4)
    dim = 24
    base = r.normal(size=dim)
    base /= np.linalg.norm(base)
    crowd = base + r.normal(size=(1500, dim)) * 3e-5
    off = r.normal(size=(40, dim))
    off -= np.outer(off @ base, base)
    satellites = base + 0.15 * off / np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate((crowd, satellites, r.normal(size=(300, dim))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {row.vec_id: (row.n_links, row.component_id) for row in embed_dedup.near_duplicates(df, sample_rows=600).collect()}
    near = x @ x.T >= 0.98
    comp = cases.components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b and (a < 1 or b >= 1500 or a >= 1500)])
    assert got == {i: (int(near[i].sum()) - 1, comp[i]) for i in range(len(x))}


def test_codebook_of_many_lists():
    """A thousand lists of wide vectors fit a small driver, and both levels keep their bounds."""
    import tracemalloc

    r = np.random.default_rng(1)
    x = r.normal(size=(16384, 512)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    book = embed_dedup.Codebook(x, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 900 <= len(book.coarse) <= 1100 and peak < 1 << 30
    # every vector within the radius lies in a probed list
    q = x[:200].astype(float)
    e = q + r.normal(size=q.shape) * 0.006
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    radius = float(np.linalg.norm(q - e, axis=1).max())
    row, lists = book.probes(q, radius)
    probed = set(zip(row.tolist(), lists.tolist(), strict=True))
    assert radius < 0.2 and all((i, int(home)) in probed for i, home in enumerate(book.near(e)))
    assert all((i, int(home)) in probed for i, home in enumerate(book.near(q)))


def test_embedding_recall(spark):
    from ..conftest import SMALL

    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, cosine=0.3).collect()}
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    want = ((x @ x.T >= 0.3) & (label[:, None] == label)).sum(1) - 1
    assert want.sum() > 0 and sum(got.values()) >= 0.9 * want.sum() and got == dict(zip((r.vec_id for r in rows), want.tolist(), strict=True))


def test_components(spark):
    import random

    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {x.node: x.root for x in components(Scratch(spark, "t"), df).collect()}
    linked = {n for p in links for n in p if p[0] != p[1]}
    want = cases.components(linked, [p for p in links if p[0] != p[1]])
    assert got == want
    assert components(Scratch(spark, "t"), df.where("a < 0")).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, ngram_join.near_duplicates, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, exact_dedup.keep_one, ngram_join.keep_one])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], cases.SCHEMA)).count() == 0


def test_empty_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    only = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(only).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
