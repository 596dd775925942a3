"""Alignment, n-gram join and divergence against brute force; long, deep and repeated inputs of the other operators."""

import hashlib
import itertools
import random
import re
import resource
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import alignment, ann, divergence, html_text, jaccard_join, labelled, quality
from tracewell.llm.queries import BYTE_BPE, PIECE_BPE

ODD = [None, "", " ", "a", "a  b", "x \u2581y", "<|endoftext|> a </s> <0x41>", "日本語 😀👍🏽 x", " \x1c y\x85z", "x" * 5000, "a\n b \u3000 c d\u3000e", "tab \t x", "é \u0301 x", "\x00 \x00", "  a b  ", "one two three"]


def naive_alignment(texts):
    """Tokens of whole texts, their ends as sets, links by looking up."""
    known = alignment.aligner(BYTE_BPE, PIECE_BPE)
    rows, links = [], []
    for text in texts:
        a, b = (known.encode_a(" " + text), known.pieces.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(known.bytes_a[i] for i in a) != raw or b"".join(known.bytes_b[i] for i in b) != raw:
            a, b = [], []
        ends_a, ends_b = (list(itertools.accumulate(len(t[i]) for i in x)) for t, x in ((known.bytes_a, a), (known.bytes_b, b)))
        groups, i, j = [], 0, 0
        found = []
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            found.append((a[p - 1], b[q - 1]))
            i, j = p, q
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        links.append(found)
    n = Counter(x for found in links for x in found)
    most = {}
    for (_, b), k in n.items():
        most[b] = max(most.get(b, 0), k)
    return [(*r[:3], len(found), sum(n[x] == most[x[1]] for x in found), sum(n[x] for x in found), r[3]) for r, found in zip(rows, links, strict=True)]


def test_alignment(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["the", "naïve", "Übergröße", "don't", "x=1;", "日本", "🙂", "12,345.67", "\n", "\t", " ", "foo_bar", "http://a.b/c?d=e", "ﬁ", "\u200d"]
    texts = ODD + ODD[-1:] + [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(32, 127)])) for _ in range(30)) for _ in range(150)]
    want = naive_alignment(texts)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, id int, links int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in alignment.alignment_digests(docs, BYTE_BPE, PIECE_BPE).collect()}
    assert got == dict(enumerate(want)) and sum(w[0] > 0 for w in want) > 200
    assert alignment.alignment_digests(docs.limit(0), BYTE_BPE, PIECE_BPE).count() == 0
    pairs = alignment.link_table(alignment.align_documents(docs, BYTE_BPE, PIECE_BPE), BYTE_BPE, PIECE_BPE)
    assert pairs.agg(F.sum("n")).first()[0] == sum(w[3] for w in want)
    long = " ".join(t for t in texts if t)
    monkeypatch.setattr(alignment, "CHUNK", 500)
    assert next(alignment.aligner(BYTE_BPE, PIECE_BPE).describe([long.replace("\u2581", "")]))[:4] == naive_alignment([long.replace("\u2581", "")])[0][:3] + naive_alignment([long.replace("\u2581", "")])[0][6:]


def naive_components(rows, k, percent):
    words = {i: re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows}
    sets = {i: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()} for i, w in words.items()}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = root(a), root(b)
            top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("small", [False, True])
def test_prefix_join_matches_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and pieces
        for name, size in (("GROUPS", 40), ("SHINGLES", 3000), ("ROUNDS", 1)):
            monkeypatch.setattr(jaccard_join, name, size)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    texts = []
    for base, members, low, high in ((200, 60, 3, 6), (60, 30, 0, 2), (12, 10, 0, 1), (400, 30, 6, 12)):
        first = [rng.choice(vocab) for _ in range(base)]
        for _ in range(members):
            text = list(first)
            for _ in range(rng.randint(low, high)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            texts.append(" ".join(text[: len(text) - rng.choice([0, 0, 0, 4])]))
    rng.shuffle(texts)
    texts += [None, "", " \t", "a", "A", "a b", "x y z", *texts[:5], " ".join(texts[:40])]
    docs = spark.createDataFrame([(i, t, "s", b"q", 5) for i, t in enumerate(texts)], "doc_id long, text string, digest string, prefix binary, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    want = naive_components(list(enumerate(texts)), 3, 90)
    assert got == want and 20 < len({c for _, c in want.values()}) < len(texts) - 20
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_prefix_join_of_repeated_and_null_ids(spark):
    long = " ".join(f"t{i}" for i in range(50))
    rows = [(4, long), (4, long), (4, "p q r s"), (9, long + " end"), (None, long), (7, None)]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(4, 48, 4), (4, 48, 4), (4, 2, 4), (9, 49, 4), (None, 48, None), (7, 0, 7)], key=str)


def test_prefixes_hold_what_few_documents_share(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COUNTERS", 256)  # as crowded as by a large corpus
    rng = random.Random(7)
    often, seldom, line = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(4000)], [f"l{i}" for i in range(12)]
    texts = [[*(rng.choice(often if rng.random() < 0.6 else seldom) for _ in range(150)), *(line if i % 20 == 0 else [])] for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    rows = jaccard_join.prefix_rows(jaccard_join.prefixes(docs, 3, 90).withColumnRenamed("id", "node")).select("token", "node").collect()
    held = Counter(r["token"] for r in rows)
    assert len(rows) > 6000 and sum(n for n in held.values() if n > 1) < 60


def test_prefix_join_of_common_lines(spark, monkeypatch):
    for name, size in (("COUNTERS", 16), ("WORDS", 16), ("COMMON", 2), ("SLOTS", 64), ("FIRST", 2)):
        monkeypatch.setattr(jaccard_join, name, size)
    rng = random.Random(11)
    lines = [" ".join(f"l{i}x{j}" for j in range(15)) for i in range(4)]
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10)}"
            texts.append(" ".join([*text, rng.choice(lines)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == naive_components(list(enumerate(texts)), 3, 90) and len({c for _, c in got.values()}) < len(texts) - 10


@pytest.mark.parametrize(("tile", "side", "dense"), [(1024, 256, 8), (3, 2, 1), (5, 2, 100)])
def test_divergence_matches_sql(spark, monkeypatch, tile, side, dense):
    for name, size in (("TILE", tile), ("SIDE", side), ("DENSE", dense), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, size)
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma'", "delta-", "ÉCOLE", "日本", "x1y", "\u0130", "eta", "theta", "iota", "zz"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None]), " ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 12)))) for _ in range(400)]
    rows += [("de", "s1", "only a few"), ("de", "s2", None), ("en", "silent", "..."), ("en", "s1", ""), *rows[:3]]
    docs = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term int").repartition(4)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype(object).where(lambda d: d.notna(), None))
    want = con.execute(divergence.ORACLE).fetchall()
    got = [tuple(r) for r in divergence.divergence(docs).collect()]
    assert sorted(got) == sorted(want) and {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    huge = 4_000_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(huge), F.lit(huge + 7), F.lit(3).cast("long"))).first()[0]
    assert row == 1 + 1_000_000_000 * (huge + 5) // (huge + 7 + 15)


def test_repeated_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    rows = [(i, x[i].tolist()) for i in range(60)] + [(0, x[0].tolist()), (0, x[1].tolist()), (7, x[7].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    queries = Counter(r[0] for r in rows if r[0] % 20 == 0)
    assert got.groupby("query_id").size().to_dict() == {q: 20 * n for q, n in queries.items()}
    assert sorted(got[got["query_id"] == 20]["rank"]) == list(range(1, 21)) and got[got["query_id"] == 20].vec_id.nunique() >= 18
    assert (got.query_id != got.vec_id).all()
    same = got[(got.query_id == 0)].groupby("rank").size()
    assert (same == 3).all()


def test_deep_pages_cost_no_more():
    html = '<div class="a b c">x ' * 50_000
    blocks = html_text.blocks_of(html)
    assert len(blocks) == 50_000 and blocks[-1][1].nbytes == 4 * html_text.PATH
    assert np.allclose(blocks[9][1] - blocks[8][1], blocks[8][1] - blocks[7][1])
    labeller = html_text.Labeller()
    assert len(labeller.keeps([blocks])[0]) == 50_000
    assert html_text.blocks_of("<article><p>one<button>press<p>two</p><svg><path><div>three</div></article>")[1:] and [b[0] for b in html_text.blocks_of("<article><p>one<button>press<p>two</p><svg><path><div>three</div></article>")] == ["one", "two", "three"]
    says = [b[3] for b in html_text.blocks_of("<main><p>a</p><nav>b</nav><p>c</p></main><p>d")]
    assert says == [True, False, True, False]


def test_long_texts_in_pieces(monkeypatch):
    net = quality.ByteNet()
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 3, 700, 5000, 40_000, 9)]
    data, at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    whole = net.scores(data, at)
    monkeypatch.setattr(quality, "SPAN", 600)
    assert np.allclose(net.scores(data, at), whole, atol=1e-6)
    monkeypatch.undo()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    net.scores(np.tile(data, 700), np.array([0, len(data) * 700]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # kB, for a text of 32 MB


def test_samples_leave_out_what_is_too_long(spark, monkeypatch):
    monkeypatch.setattr(labelled, "LONGEST", 50)
    docs = spark.createDataFrame([(i, "x" * (400 if i % 2 else 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(60)], "doc_id long, quality int")
    found = labelled.labelled_sample(docs, labels, "quality", {0: 50, 1: 50}, characters=1000)
    assert len(found) > 10 and {len(t) for t, _ in found} == {5}
