"""The prefix trie against a trie built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from segspark.llm import prefix_trie as m

SCHEMA = "conv_id long, turn int, role string, text string, p1 long, c string, leaves int"


def row(c, t, role, text):
    return (c, t, role, text, 1, "x", 2)


def by_hand(seqs):
    """Nodes of ``{id: [(role, text), ...]}`` by walking every path."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, who in members.items():
        cost = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += cost
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else -1, len(who), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, who in members.items()
    )


def numbered(rows):
    """Turns per conversation; ties in the order that the docstring states."""
    out = defaultdict(list)
    tie = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append(((t is not None, t or 0, tie(role, text)), role, text))
    return {c: [(r, x) for _, r, x in sorted(turns)] for c, turns in out.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = seqs.get(base, [])[:h] + own[h:]
    return out


def awkward(seed=0):
    r = random.Random(seed)
    rows = [row(c, t, r.choice(["user", "bot"]), r.choice("ab")) for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [row(100, t, "user", "same") for t in range(40)]  # one long conversation and copies of its head
    rows += [row(c, t, "user", "same") for c in range(101, 130) for t in range(r.randrange(1, 20))]
    rows += [row(7, None, None, None), row(7, None, "", None), row(8, 3, "user", "x" * 100000), row(8, 3, "user", "é日"), row(None, 0, "user", "a")]
    rows += [row(-3, 0, "user", "a"), row(-5, 0, "user", "a"), row(10**15, 0, "ab", "c"), row(10**15 + 1, 0, "a", "bc"), rows[0], rows[0]]
    r.shuffle(rows)
    return rows


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(-1 if v is None else v for v in x) for x in df.collect())


@pytest.mark.parametrize("chunk,piece", [(1 << 12, 1 << 9), (4, 2)])
def test_trie(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(m, "CHUNK", chunk)
    monkeypatch.setattr(m, "PIECE", piece)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    seqs = numbered(rows)
    assert result(m.prefix_trie(df)) == by_hand(seqs)
    assert result(m.rebuilt_trie(df)) == by_hand(rebuilt(seqs))


def test_empty_and_turnless(spark):
    assert m.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(i for i in range(1, 100) if i % 5 and zlib.crc32(str(i).encode()) % 9)  # its one turn gives way, and its base is absent
    none = hashlib.sha256(str(c).encode()).hexdigest()
    assert result(m.rebuilt_trie(spark.createDataFrame([row(c, 0, "user", "a")], SCHEMA))) == [(c, 0, -1, 1, 0, 1, 0, none)]
