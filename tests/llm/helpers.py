"""Small tables and plain versions of the operators, used by several tests."""

import collections
import math
import random

import duckdb
import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, score string"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def document_rows(seed=1, n=60):
    """Documents in two invented languages with nulls, copies, junk and ties."""
    rng = random.Random(seed)
    en = [a + b for a in ("th", "wh", "sh", "st") for b in ("e", "is", "at", "ing", "ere")]
    fr = [a + b for a in ("é", "ou", "qu", "ç") for b in ("e", "eau", "tre", "ment", "è")]
    rows = []
    for i in range(n):
        lang, vocabulary = ("en", en) if i % 2 else ("fr", fr)
        text = "\n".join(sentence(rng, vocabulary, rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))
        rows.append([i, text, lang, f"src{i % 4}"])
    rows[5][1] = rows[3][1]                       # an exact copy
    rows[9][1] = rows[7][1].replace(" ", "  ")    # a copy with other spaces
    rows[11][1] = None
    rows[12][1] = ""
    rows[13][1] = " \t\n "
    rows[14][1] = "12 34 !!! ... 5"
    rows[15][2] = None
    rows[16][3] = None
    rows[17] = list(rows[19])                     # a repeated row
    rows[20][1] = sentence(rng, en, 30) + " $$$ ### " * 30
    rows[21][1] = "\n".join([sentence(rng, en, 12)] * 8)
    rows[22][1] = sentence(rng, fr, 4000)         # a long text
    rows[23][1] = "x" * 5000
    rows[24][0] = None
    return [(*r, len(r[1] or ""), "a", "b", "c") for r in rows]


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(document_rows() if rows is None else rows, schema)


def duck(sql, **tables):
    """Rows of a query over Spark frames, as (column names, sorted rows)."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same_rows(df, sql, **tables):
    names, want = duck(sql, **tables)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def words(text):
    return (text or "").encode().lower().split()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def brute_fingerprint(text, size=3):
    import xxhash

    w = words(text)
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(fps, bits):
    u, a = Union(), np.array(sorted(set(fps)), np.int64)
    for x in a:
        for y in a[np.bitwise_count((a ^ x).view(np.uint64)) <= bits]:
            u.join(int(x), int(y))
    return {int(x): u.find(int(x)) for x in a}


def brute_kneser_ney(train, test, n, discounts):
    tokens = lambda t: words(t) + ["end"]
    plain = collections.Counter(w for t in train for w in tokens(t))
    total, types = sum(plain.values()), len(plain)
    counts = {n: collections.Counter()}
    for t in train:
        w = ["begin"] * (n - 1) + tokens(t)
        counts[n].update(tuple(w[i - n + 1:i + 1]) for i in range(n - 1, len(w)))
    for k in range(n - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d, context = {}, {}
    for k, level in counts.items():
        cc = collections.Counter(level.values())
        d[k] = [0, *discounts([cc[i] for i in (1, 2, 3, 4)])]
        context[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, c in level.items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][min(c, 3)] += 1

    def p(gram):
        value = 1 / (types + 1)
        for k in range(1, n + 1):
            g = gram[n - k:]
            if g[:-1] in context[k]:
                c, m = context[k][g[:-1]], counts[k].get(g, 0)
                value = (max(m - d[k][min(m, 3)], 0) + sum(d[k][i] * c[i] for i in (1, 2, 3)) * value) / c[0]
        return value

    out = []
    for t in test:
        w = tokens(t)
        full = ["begin"] * (n - 1) + w
        out.append((len(w), sum(plain[x] > 0 for x in w),
                    sum(math.log10((plain[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w),
                    sum(math.log10(p(tuple(full[i:i + n]))) for i in range(len(w)))))
    return out, total, types
