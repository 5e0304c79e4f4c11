"""A small table with every awkward row: nulls, empties, long texts, copies, near copies, repeats."""

import random
import re

SPACE = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha string, key long, size long, n int, copies int, label string, __id long, __copies int, cell int, h long"


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}{'.' if r.random() < 0.1 else ''}" + ("\n" if r.random() < 0.05 else "") for _ in range(n))


def rows(seed=0):
    r = random.Random(seed)
    base, shared = prose(r, 300), prose(r, 60, 10**6)
    texts = [None, "", "   ", "\t\n", "One two", "one TWO", "one two three four five", "a b c d", "!!! ???", "é ▁ 日本   x", base, base, base.upper(), base.replace("w1", "v1", 4)]
    for i in range(12):  # near copies with one changed word each
        ws = base.split()
        ws[i * 20] = f"changed{i}"
        texts.append(" ".join(ws))
    for i in range(6):  # documents that share a passage
        texts.append(prose(r, 40 + i) + " " + shared + " " + prose(r, 30))
    texts.append(prose(r, 25000, 5000))  # one very long text
    texts.append(shared + " " + shared)
    texts.append("again and again " * 40)
    texts += [prose(r, r.randrange(1, 120), 60) for _ in range(40)]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3, t, ["en", "de", None][i % 3], ["a", "b", None, "a", ""][i % 5], len(t or ""), "x", "y", 1, 2, 3, 4, "l", 5, 6, 7, 8))
    out.append(out[10])  # a repeated row
    out.append((None, "no id " * 10, "en", "a", 1, "x", "y", 1, 2, 3, 4, "l", 5, 6, 7, 8))
    out.append((10**12, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None))
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(5)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
