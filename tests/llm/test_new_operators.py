"""Token alignment, URL filters, whitening."""

import collections
import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import document_rows, duck, frame, same_rows
from tokenizers import Tokenizer

from vellum.llm import align, catalog, urlfilter, whiten

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class PlainAlignment:
    """Whole texts, every pair of tokens, one text at a time."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in printable]
        self.byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in a]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], []
        spans = []
        for t in (a, b):
            at, out = 0, []
            for i, x in t:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        return spans

    def groups(self, a, b):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        out, at = [], 0
        for e in ends:
            out.append("|".join(",".join(str(i) for i, s, t in side if at <= s and t <= e) for side in (a, b)))
            at = e
        return out

    def rows(self, docs):
        spans = [self.tokens(t) for _, t in docs]
        links = [[(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] for a, b in spans]
        count = collections.Counter(x for ls in links for x in ls)
        most = collections.defaultdict(int)
        for (_, j), n in count.items():
            most[j] = max(most[j], n)
        out = []
        for (d, _), (a, b), ls in zip(docs, spans, links, strict=True):
            g = self.groups(a, b)
            out.append((d, len(a), len(b), len(g), len(ls), sum(count[x] == most[x[1]] for x in ls),
                        sum(count[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""))
        return out


ODD = ["<|endoftext|> and <s> </s> <unk>", "a▁b", "a\u0085b  c", " lead", "\nline", "trail ", "\t\n x", "<0x41> A",
       "é́ ﬁ 中文字 \U0001f600\U0001f469‍\U0001f680", "x" * 300, "a  b   c\n\nd \n e", "it's we'll 'tis", " ", "\n",
       "1234567 12,345.67", "a\x00b", "\x1c\x1d y", "word\nWord word. Word x 　 y", "\n \n", "- - --- ____"]


def alignment_rows():
    rng = random.Random(5)
    rows = [(r[0], (r[1] or "")[:1500] if r[1] is not None else None) for r in document_rows(9, 40)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1000, ODD[0]), (1, None)]
    signs = "ab é\n\t 'sT.▁,1<中́"
    rows += [(2000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows


def test_alignment_equals_plain_version(spark, tmp_path):
    rows = alignment_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(map(tuple, catalog.op11_token_alignment(spark, str(tmp_path)).collect()))
    assert got == collections.Counter(PlainAlignment().rows(rows))
    assert any(r[1] == 0 for r in got) and any(r[3] > 20 for r in got)


def test_alignment_groups_and_columns(spark):
    df = frame(spark)
    out = align.align(df, A_PATH, B_PATH)
    assert out.columns[:len(df.columns)] == df.columns and out.count() == df.count()
    plain = PlainAlignment()
    for r in out.filter("n_groups > 0 AND length(text) < 2000").limit(20).collect():
        assert r.groups == ";".join(plain.groups(*plain.tokens(r.text)))
    none = align.count_links(align.align(df.limit(0), A_PATH, B_PATH))
    assert none.count() == 0 and {"n_best", "count_sum"} < set(none.columns)


def test_alignment_of_a_long_text_in_parts(monkeypatch):
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        t = align.Tokenizers(a.read(), b.read())
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abé\n.") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    for one in (text, text + " ▁"):
        want = [x.to_pylist() for x in align.align_block(t, pa.array([one]))]
        monkeypatch.setattr(align, "PARTS", 100)
        monkeypatch.setattr(align, "BLOCK", 1000)
        monkeypatch.setattr(align, "KEPT_PARTS", 50)
        got = [x.to_pylist() for x in align.align_block(t, pa.array([one]))]
        assert got[:5] == want[:5] and got[6:] == want[6:]
        monkeypatch.undo()


def test_pointers_reach_the_terminals():
    a, b = np.array([3, 5, 9, 12, 13]), np.array([2, 4, 8, 11, 13])
    to_b, to_a, label = align.terminals(a, b)
    assert to_b.tolist() == [1, 2, 3, 4, 4] and to_a.tolist() == [0, 1, 2, 3, 4]
    assert set(label.tolist()) == {9}


@pytest.mark.parametrize("texts", [[None, ""], [], ["▁"]])
def test_alignment_without_tokens(texts):
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        t = align.Tokenizers(a.read(), b.read())
    cols = align.align_block(t, pa.array(texts, pa.string()))
    assert [c.to_pylist() for c in cols[:4]] == [[0] * len(texts)] * 4 and cols[4].to_pylist() == [""] * len(texts)


def plain_whitening(rows, k=16):
    """Exact fractions for the covariance, numpy's own eigenvectors."""
    size = max((len(v) for _, v in rows), default=0)
    x = [[int(np.floor(64.0 * c)) + 1000000 for c in v] + [1000000] * (size - len(v)) for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit), n ** 3))
                     for j in range(size)] for i in range(size)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return x, n, s, cov, e, v


def vectors_table(rng, n=300, d=9):
    rows = [(i, [float(np.float32(rng.gauss(j, 1 + 3 * j))) for j in range(d)]) for i in range(n)]
    rows += [(900, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (901, rows[2][1][:5]), (902, [])]
    bad = [(903, None), (904, [1.0, None] + [0.0] * (d - 2)), (905, [float("nan")] * d), (906, [float("-inf")] * d)]
    return rows, bad


def test_whitening_equals_plain_version(spark, tmp_path):
    rows, bad = vectors_table(random.Random(4))
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, n string")
    df.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.op13_whitening(spark, str(tmp_path)).collect()
    x, n, s, cov, e, v = plain_whitening(rows)
    assert len(got) == len(rows) * len(e) and {r.n for r in got} == {n}
    want = collections.Counter((i, sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for (i, _), r in zip(rows, x, strict=True))
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    assert all(r.identity_error < 1e-9 for r in got)
    for c in range(1, len(e) + 1):
        mine = sorted(((r.vec_id is None, r.vec_id, r.whitened) for r in got if r.component == c), key=str)
        plain = [sum((a - b / n) * v[d, c - 1] for d, (a, b) in enumerate(zip(r, s, strict=True))) / e[c - 1] ** 0.5 for r in x]
        plain = {sign: sorted(((i is None, i, sign * p) for (i, _), p in zip(rows, plain, strict=True)), key=str) for sign in (1, -1)}
        near = [max(abs(a[2] - b[2]) for a, b in zip(mine, p, strict=True)) for p in plain.values()]
        assert min(near) < 1e-7
        assert all(abs(r.explained - e[c - 1] / np.trace(cov)) < 1e-9 for r in got if r.component == c)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten.whiten(df).count() == 0


def test_whitening_of_few_and_large_values(spark):
    rows = [(1, [0.0, 1e9]), (2, [3.0, -1e9]), (3, [-7.0, 5e11])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x, n, s, cov, e, _ = plain_whitening(rows)
    got = whiten.whiten(df).collect()
    assert {r.component for r in got} <= {1, 2}
    want = {i: sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for (i, _), r in zip(rows, x, strict=True)}
    assert {r.vec_id: int(r.deviation) for r in got} == want
    with pytest.raises(Exception, match="2\\^40"):
        whiten.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).count()


def url_rows():
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "http://?x", "HTTP://Example.COM/EN/1", "http://a.example.com/en/1?x=/net/",
            "http://www.example.com/en/1", "http://b.www.example.com/en/9", "http://wwwexample.com/en/", "http://x.net/es",
            "http://x.net/es/", "http://x.net/est/1", "http://net/fr/a#b", "http://me@x.net:80/fr/1", "a://b://c.net/es/1",
            "http://x.net//es/1", "http://É.NET/es/1", "http://d.org/*/**/a", "http://d.org/" + "a/" * 40,
            "http://d.org/" + "b" * 100 + "/1", "://q.net/fr/\nx?y"]
    for host in ("one.net", "two.net", "three.org", "www.example.com", "m.example.com"):
        for _ in range(120):
            lang = rng.choice(["en", "en", "de", "es", "fr"])
            urls.append(f"http://{host}/{lang}/{rng.randint(1, 500)}{rng.choice(['', '/', '.html', '?a', '#b'])}")
    urls += [f"http://mixed.net/es/{k}" for k in range(60)] + [f"http://mixed.net/es{'' if k % 2 else '?'}" for k in range(8)]
    urls += [f"http://deep.org/user/{k}/posts/{k % 3}" for k in range(80)]
    urls += [f"http://spam.net/{a}/{k}" for k in range(30) for a in ("es", "fr")] + ["http://spam.net/es"] * 2
    return [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.net/es/1"), (5, urls[5]), (5, urls[5])]


def test_url_filter_equals_sql(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in url_rows()], "page_id long, url string, host string, row string")
    got = urlfilter.filter_urls(df.repartition(4), keep=["page_id"])
    same_rows(got, catalog.ORACLE["op12_url_filter"], pages=df)
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    for i, u in url_rows():
        host, path, rule, verdict = plain_rule(u)
        assert all(x[:3] == (host, path, rule) and (rule is None or x[3] == verdict) for x in by[i]) or i in (5, None)
    assert {r.template for r in got.filter("host = 'deep.org'").collect()} == {"user/*/posts/" + x for x in "012"}
    kept = urlfilter.filter_urls(df)
    assert kept.columns == ["page_id", "url", "row", *urlfilter.OUT]
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = ("", None)
    for verdict, rule in urlfilter.RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            best = max(best, (rule, verdict), key=lambda x: len(x[0]))
    return host, path, best[0] or None, best[1]


def test_url_branches_merge_and_reject(spark):
    rows = [(i, f"http://h.net/{a}/{i}") for i in range(40) for a in ("es", "fr", "en")] + [(99, "http://h.net/es")] * 3
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got if r.path.startswith(("/es/", "/fr/"))} == {"es/*"}  # alike: one branch
    assert {(r.template, r.verdict) for r in got if r.path.startswith("/en/")} == {("en/*", "allow")}
    rules = [("block", "h.net/fr/1"), ("allow", "h.net/en/")]  # a sign of the wildcard below fr
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()
    assert {r.template.split("/")[0] for r in got} == {"es", "fr", "en"}  # unlike, or without a label
    rules = [("block", f"h.net/fr/{i}") for i in range(4, 40)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()
    assert {r.verdict for r in got if r.path in ("/fr/0", "/fr/1")} == {"block"}  # a pure template's other urls
    assert {r.verdict for r in got if not r.path.startswith("/fr/")} == {"allow"}
