"""Text operators against libraries, brute force and small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import string
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import ann, audio, bpe, html_text, neardup, packing, quality, secret_scan, toxicity, url_filter
from tracewell.llm.common import connected_components, materialise, passing_tables
from tracewell.llm.labelled import labelled_sample
from tracewell.llm.queries import BYTE_BPE, WORD_BPE

ODD = [None, "", "  ", "a", "it's 12 ½ <|endoftext|> Σίσυφος ΟΔΟΣ\n\n x", "ÀÉ \x1c y\u0085z", "日本語 😀👍🏽", "x" * 5000, "one two three four five six seven"]


def frame(spark, texts, schema="doc_id long, text string, score double, id string, key long"):
    return spark.createDataFrame([(i, t, 0.5, "x", 7) for i, t in enumerate(texts)], schema)


def test_bpe_matches_library(spark):
    lib = Tokenizer.from_file(WORD_BPE)
    rows = bpe.round_trip_digests(frame(spark, ODD + ODD[-1:]), WORD_BPE).toPandas().set_index("doc_id")
    assert len(rows) == len(ODD) + 1
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows.n_tokens[i] == len(ids)
        assert rows.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows.decoded_sha256[i] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, []), WORD_BPE).count() == 0
    assert bpe.encode_documents(frame(spark, ["a b"]), WORD_BPE).first()["ids"] == lib.encode("a b", add_special_tokens=False).ids


def test_bpe_of_every_code_point():
    """Four contexts; planes without assigned characters are sampled."""
    lib, coder = Tokenizer.from_file(WORD_BPE), bpe.bpe(WORD_BPE)
    points = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x32400), *range(0x32400, 0xE0000, 997), *range(0xE0000, 0xE0200), *range(0xE0200, 0x110000, 997)]]
    for k in range(0, len(points), 20_000):
        texts = [f"a{x}b {x} É{x}1 <{x}{x}" for x in points[k : k + 20_000]]
        assert not [t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if coder.encode(t) != e.ids]


def test_bpe_of_random_texts():
    lib, coder, rng = Tokenizer.from_file(WORD_BPE), bpe.bpe(WORD_BPE), random.Random(4)
    pools = [string.printable, "àÉßçñøΣςσЖжא ", "日本語あ한글 ", "\u0301\u0308\u200d\u0345 ", "😀👍🏽½²٣ ", *([chr(rng.randrange(1, 0xD800)) for _ in range(400)] for _ in range(3))]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 40))) for _ in range(10_000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(t) == e.ids and coder.described(t)[2] == lib.decode(e.ids, skip_special_tokens=False)


def test_bpe_cuts_are_never_inside_a_token():
    coder = bpe.bpe(WORD_BPE)
    words = ["qzxjv", "hello", "zzzqqqxxx", "straße"]
    for w in words:
        mapped = "".join(coder.chars[b] for b in w.encode())
        parts = coder.cuts(mapped)
        assert "".join(parts) == mapped
        for a, b in zip(parts, parts[1:], strict=False):
            assert not any(a[-1] + b[0] in t for t in list(coder.vocab)[::50])


def test_packing(spark):
    lib = Tokenizer.from_file(BYTE_BPE)
    texts = [*ODD, *["same words again " * 50] * 40, "long text " * 3000]
    rows = packing.pack(frame(spark, texts), BYTE_BPE).toPandas()
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        own = rows[rows.doc_id == i].sort_values("start")
        at = 0
        for r in own.itertuples():
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        n = int(g.length.sum())
        assert n <= 2048 and n & (n - 1) == 0
    assert packing.pack(frame(spark, []), BYTE_BPE).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_audio(spark):
    rows = audio.media_digests(frame(spark, [*ODD, "a"])).toPandas().set_index("doc_id")
    for i, t in enumerate([*ODD, "a"]):
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (rows.n_bytes[i], rows.payload_bytes[i], rows.tail_crc32[i]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert rows.payload_sha256[i] == hashlib.sha256(payload).hexdigest()
        assert rows.media_sha256[i] == hashlib.sha256(audio.to_wav(payload)).hexdigest()
    assert rows.feature[3] == rows.feature[len(ODD)] and rows.feature[0] == rows.feature[1]
    tone = (128 + 100 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)).astype(np.uint8)
    assert np.abs(np.fft.rfft(audio.resample(tone)[:6000])).argmax() == 440
    assert audio.media_digests(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        audio.from_wav(b"nothing")


def naive_log_mel(payload):
    """Resampling, windows and filterbank written out sum by sum."""
    x, half = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128, audio.TAPS // 2
    y = []
    for m in range(-(-len(x) // audio.DOWN) * audio.UP):
        at, total, norm = m * audio.DOWN / audio.UP, 0.0, 0.0
        for k in range(int(at) - half + 1, int(at) + half + 1):
            h = np.sinc(0.75 * (k - at)) * (0.5 + 0.5 * np.cos(np.pi * min(1, max(-1, (k - at) / half))))
            norm += h
            total += h * (x[k] if 0 <= k < len(x) else 0)
        y.append(total / norm)
    frames, out = max(1, -(-(len(y) - audio.WINDOW) // audio.HOP) + 1), []
    y += [0.0] * ((frames - 1) * audio.HOP + audio.WINDOW - len(y))
    n, rate = audio.WINDOW, audio.RATE * audio.UP / audio.DOWN
    wave = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    edges = [700 * (10 ** (2595 * np.log10(1 + rate / 1400) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    for f in range(frames):
        window = [y[f * audio.HOP + k] * (0.5 - 0.5 * np.cos(2 * np.pi * k / (n - 1))) for k in range(n)]
        power, row = np.abs(wave @ np.array(window)) ** 2, []
        for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
            row.append(np.log(1e-6 + sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, np.linspace(0, rate / 2, n // 2 + 1), strict=True))))
        out.append(row)
    return np.array(out)


def test_audio_features_are_stored(spark):
    texts = ["z" * 9000, "The quick brown fox. " * 40, None, "ä"]
    stored = audio.feature_table(audio.media_table(frame(spark, texts))).toPandas().set_index("id")
    for i, t in enumerate(texts):
        payload = audio.padded((t or "").encode())
        want, batch = naive_log_mel(payload), audio.stored_features(stored.features[i])
        assert batch.schema == audio.TENSORS and batch.column(0).type.shape == [audio.FRAMES, audio.MELS]
        got = batch.column(0).to_numpy_ndarray().reshape(-1, audio.MELS)
        assert len(want) == stored.frames[i] and np.abs(got[: len(want)] - want).max() < 0.03 and np.allclose(got[len(want) :], np.log(1e-6), atol=0.02)
        starts, ends = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        step = 1000 * audio.HOP * audio.DOWN / (audio.RATE * audio.UP)
        assert starts == [int(k * audio.FRAMES * step) for k in range(batch.num_rows)] and all(a < b for a, b in zip(starts, ends, strict=True))
        spans = [(s["start"], s["end"]) for s in stored.segments[i]]
        assert batch.column(3).to_pylist() == [any(a < (k + 1) * audio.FRAMES and k * audio.FRAMES < b for a, b in spans) for k in range(batch.num_rows)]


def test_hysteresis():
    mel = np.full((12, audio.MELS), 0.0, np.float32)
    mel[2:5] += 0.1  # above the low threshold only
    mel[7:10] += 0.1
    mel[8] += 2
    assert audio.segments(mel) == [(0, 12)]  # silence is less than LOW_DB below the median, so one run, with one frame above HIGH_DB
    mel[5:7] -= 1
    mel[10:] -= 1
    assert audio.segments(mel) == [(7, 10)]  # the run from 0 to 5 never rises above HIGH_DB


def test_secrets(spark):
    rng = random.Random(1)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48))
    texts = [None, "", f"é password = 'abcdefgh1' AKIA{'Q' * 16} {'ab12' * 10}", "SECRET:short token=abc", f"value {key} end", "ordinary words only here", "paſſword=abcdefghij", f"x {key} y"]
    rows = secret_scan.secret_digests(frame(spark, texts)).toPandas().set_index("doc_id")
    t = texts[2]
    pos = t.index("password")
    spans = [f"assign:{pos}:{t.index('h1') + 2}", f"access:{t.index('AKIA')}:{t.index('AKIA') + 20}", f"hex:{t.index('ab12')}:{len(t)}"]
    assert rows.spans[2].split(",")[:3] == spans
    assert rows.base_sha256[2] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert (rows.n_assign[3], rows.n_assign[6], rows.spans[0], rows.spans[5]) == (0, 0, "", "")
    assert rows.spans[4] == f"random:6:{6 + len(key)}" and rows.n_random[7] == 1
    clean = secret_scan.redact(frame(spark, texts)).toPandas().sort_values("doc_id", ignore_index=True)
    assert clean.text[4] == "value [SECRET] end" and clean.text[0] is None and list(clean.columns) == ["doc_id", "text", "score", "id", "key"]
    assert secret_scan.secret_digests(frame(spark, [])).count() == 0


def stretches_by_hand(text):
    """(start, end, body) of what the contract says is tested: longest stretches, with one or two `=` behind them; of mixed ones the parts between + and /."""
    inside, at = set(string.ascii_letters + string.digits + "+/_-"), 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in inside:
            end += 1
        if end == at:
            at += 1
            continue
        pad = 0
        while text[end + pad : end + pad + 1] == "=":
            pad += 1
        if pad > 2 or (pad and text[end + pad : end + pad + 1] in inside and end + pad < len(text)):
            pad = 0
        body = text[at:end]
        if set(body) & set("+/") and set(body) & set("-_"):
            first = at
            for k in range(at, end + 1):
                if k == end or text[k] in "+/":
                    yield first, k + (pad if k == end else 0), text[first:k]
                    first = k + 1
        else:
            yield at, end + pad, body
        at = end


def naive_battery(texts, share=0.01):
    """All random spans of all texts, by plain counting: the three tests of every stretch, then the weighted step-up."""
    tested = []
    for i, text in enumerate(texts):
        for start, end, body in stretches_by_hand(text or ""):
            if len(body) < 16 or set(body) <= set(string.digits):
                continue
            alphabet = next((a for a in secret_scan.ALPHABETS.values() if set(body) <= set(a)), None)
            p = 1.0
            if alphabet:
                n, k = len(body), len(alphabet)
                chi = sum((body.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
                if chi <= k - 1 + 3.5 * (2 * k - 2) ** 0.5:
                    shift = n * (max(k * 0.065, 2.2) - 1)
                    z = [(k - 1 + shift - chi) / (2 * (k - 1 + 2 * shift)) ** 0.5]
                    kind = (lambda c: c in "aeiouAEIOU") if len(alphabet) == 26 else (lambda c: 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3)
                    turns, q = sum(kind(a) != kind(b) for a, b in zip(body, body[1:], strict=False)), 0.62 if len(alphabet) == 26 else 0.22
                    z.append((turns - (n - 1) * q) / ((n - 1) * q * (1 - q)) ** 0.5 * (-1 if len(alphabet) == 26 else 1))
                    place = [alphabet.index(c) - np.mean([alphabet.index(d) for d in body]) for c in body]
                    z.append((0.4 - abs(sum(a * b for a, b in zip(place, place[1:], strict=False)) / max(1e-9, sum(a * a for a in place)))) * n**0.5)
                    p = 0.5 * math.erfc(sum(z) / 6**0.5 / 2**0.5)
            c = max(0, min(12, int(4 * math.log2((end - start) / 16))))
            tested.append((i, start, end, int(-math.log10(max(1e-300, p)) * 50), 2 ** (c / 4)))
    mean = sum(t[4] for t in tested) / max(1, len(tested))
    log = {t: t[3] / 50 + math.log10(t[4] / mean) for t in tested if t[3]}
    passing = [v for v in log.values() if 10**-v <= share * sum(w >= v for w in log.values()) / len(tested)]
    return sorted(t[:3] for t, v in log.items() if passing and v >= min(passing) - 1e-9)


def test_random_strings_match_naive_battery(spark):
    rng = random.Random(8)
    alphabets = [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.digits]
    words = ["internationalisation", "getElementsByTagName", "antidisestablishment", "com/example/project/main", "snake_case_name_of_it", "AAAAAAAAAAAAAAAAAAAA", "1234567890123456"]
    texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(40)] + [None, ""]
    for alphabet in alphabets:
        texts += [f"see {''.join(rng.choice(alphabet) for _ in range(n))}{rng.choice(['', '', '='])} end" for n in (15, 16, 19, 24, 32, 48, 64)]
    key = lambda n=40: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    around = ["", " ", "=", "==", "===", ":", '"', "'", "&", "?sig=", "KEY=", "x=", "a/b-c/", "%", "$", "é", "(", "<", "\n", ".", ",", "@", "#", "~", "|"]
    texts += [f"u {a}{key()}{b} v" for a in around for b in around[:9]]
    texts += [f"{a}{key(24)}+{key(5)}-{key(24)}{a}" for a in around]
    got = [(r["doc_id"], s["start"], s["end"]) for r in secret_scan.find_secrets(frame(spark, texts)).collect() for s in r["spans"] if s["kind"] == 3]
    assert sum(any(i == g[0] for g in got) for i, t in enumerate(texts) if t and t.startswith("u ")) == 9 * len(around)
    base = {i: secret_scan.base_spans(t or "") for i, t in enumerate(texts)}
    want = [t for t in naive_battery(texts) if not any(a <= t[1] and t[2] <= b for a, _, b in base[t[0]])]
    assert sorted(got) == want and len(want) > 10
    found = {texts[i][a:b].rstrip("=") for i, a, b in got}
    assert any(f.isalpha() for f in found) and not found & set(words)


def scan_by_hand(text):
    """The base patterns by walking through the text."""
    out, value = [], set(string.ascii_letters + string.digits + "+/_.=-")
    at = 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(w)].isascii() and text[at : at + len(w)].lower() == w), None)
        if word:
            k = at + len(word)
            k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "="):
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                end = k
                while end < len(text) and text[end] in value:
                    end += 1
                if end > k:
                    if end - k >= 8:
                        out.append((at, 0, end))
                    at = end
                    continue
        at += 1
    for kind, begin, letters, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            end = at + len(begin)
            if text.startswith(begin, at) and end < len(text) and text[end] in letters:
                while end < len(text) and text[end] in letters:
                    end += 1
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_spans_by_hand():
    rng = random.Random(2)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "API-KEY", "ſecret", "=", ":", " ", "  ", "'", '"', "é", "AKIA", "ABCD1234EFGH", "abcdef0123456789", "deadbeef" * 4, "x.y/z+==", "short", "longer_value-1", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert secret_scan.base_spans(text) == scan_by_hand(text), text


def test_url_rules_and_reputation(spark):
    urls = [None, "nothing", "http://Example.ORG/es/1?x", "https://a.example.org/en/12#t", "http://x.org", "http://b.com/fr/", "http://b.com/de/x", "ftp://c.net/a", *["http://bad.com/de/1"] * 30, "http://bad.com/en/", *["http://good.com/fr/1"] * 30, "http://good.com/en/"]
    rows = url_filter.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).toPandas().set_index("page_id")
    assert [rows.rule[i] for i in range(7)] == [None, None, "example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/"]
    assert (rows.host[2], rows.path[2], rows.path[3], rows.host[0], rows.verdict[1]) == ("example.org", "/es/1", "/en/12", "", "block")
    assert rows.verdict[38] == "block" and rows.verdict[69] == "allow"
    kept = url_filter.filter_pages(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"))
    assert set(kept.toPandas().page_id) == set(rows.index[rows.verdict == "allow"])
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_suffixes_and_domains(spark):
    """Of suffixes with one and two labels, ports, users and numeric addresses."""
    expected = {
        "a.b.example.com": ("com", "example.com"),
        "www.shop.com.sg": ("com.sg", "shop.com.sg"),
        "x.y.health.gov.au": ("gov.au", "health.gov.au"),
        "me@mail.firm.co.id:8080": ("co.id", "firm.co.id"),
        "www.co.uk": ("co.uk", "www.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "a.city.de": ("de", "city.de"),
        "a.co.museum": ("museum", "co.museum"),
        "10.0.0.1:80": ("1", "10.0.0.1"),
        "localhost": ("localhost", "localhost"),
    }
    host = F.col("host")
    rows = spark.createDataFrame([(h,) for h in expected], "host string").select("host", url_filter.suffix_of(host).alias("s"), url_filter.domain_of(host).alias("d"))
    assert {r["host"]: (r["s"], r["d"]) for r in rows.collect()} == expected


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(neardup, "BLOCK", 8)  # so that a family takes several blocks
    rng = random.Random(k)
    vocabulary = ["w%d" % i for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = [None, "", " \t\n", "Two words", "two WORDS", "one"]
    for _ in range(60):  # one family at all distances
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[10]] * 5 + [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(30)]
    got = neardup.near_duplicates(frame(spark, texts), shingle=k, percent=percent).toPandas().sort_values("doc_id")
    want, sizes = brute_components(texts, k, percent)
    assert list(got.component_id) == want and list(got.n_shingles) == sizes and list(got.kept) == [i == c for i, c in enumerate(want)]
    left = neardup.drop_near_duplicates(frame(spark, texts), shingle=k, percent=percent).toPandas()
    assert sorted(left.doc_id) == sorted({i for i, c in enumerate(want) if i == c}) and list(left.columns) == ["doc_id", "text", "score", "id", "key"]


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_under_an_unrelated_pivot(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "bucket_rows", lambda reps: reps.select((F.col("id") * 0).alias("key"), "id"))  # all share one bucket, whose pivot is like none of them
    rng = random.Random(9)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(90))]
    for copies in (2, 3, 1, 2, 12, 1, 2):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts[1:] = rng.sample(texts[1:], len(texts) - 1)
    got = neardup.near_duplicates(frame(spark, texts)).toPandas().sort_values("doc_id")
    assert list(got.component_id) == brute_components(texts, 5, 80)[0]


def test_near_duplicates_of_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(5, long), (5, long), (5, "other text that is alone here"), (3, long + " x"), (None, long), (None, "nobody else has this one"), (9, None), (9, None)], "doc_id long, text string").withColumn("row", F.lit(1))
    left = neardup.drop_near_duplicates(docs).toPandas()
    assert sorted(zip(left.doc_id.fillna(-1), left.text.fillna(""), strict=True)) == sorted([(3, long + " x"), (5, "other text that is alone here"), (-1, "nobody else has this one"), (9, ""), (9, "")]) and list(left.columns) == ["doc_id", "text", "row"]
    found = neardup.near_duplicates(docs).toPandas()
    assert len(found) == 8 and found[found.doc_id.isna()].kept.all()


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_posterior_bounds():
    need = neardup.least_matches(0.85)
    assert 0 < need[32] < 32 and need[160] / 160 > need[32] / 32
    a = np.arange(160, dtype=np.uint16)[None]
    assert neardup.plausible(a, a, need)[0] and not neardup.plausible(a, a + 1, need)[0]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (7, 7), (102, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == got[102] == got[100] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[300:330] = x[20]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1020, [float("nan")] * 16), (1040, [None] * 16), (1060, [1.0] * 3), (1080, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.query_id) == set(range(0, 600, 20)) and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(600), -s))[:20]
        g = g.sort_values("rank")
        hits += len(set(top) & set(g.vec_id))
        assert np.allclose(g.score, s[g.vec_id]) and list(g.vec_id) == [i for _, i in sorted(zip(-g.score, g.vec_id, strict=True))]
    assert hits >= 0.95 * 20 * 30
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()[0]["vec_id"] == 1


def test_no_neighbour_is_missed(spark):
    """Vectors beyond single precision, of far apart norms, and queries unlike the rest: all neighbours are found."""
    rng = np.random.default_rng(9)
    g = rng.normal(size=(3000, 16))
    unlike = g / np.linalg.norm(g, axis=1, keepdims=True)
    unlike[::20] = np.abs(unlike[::20]) * 5
    for x in (g * 1e30, g * np.exp(2 * rng.normal(size=(3000, 1))), unlike):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.nearest(rows).toPandas().sort_values(["query_id", "rank"])
        assert got.query_id.nunique() == 150
        for q, found in got.groupby("query_id"):
            s = (x * x[q]).sum(axis=1)
            s[q] = -np.inf
            assert found.vec_id.tolist() == np.lexsort((np.arange(3000), -s))[:20].tolist()


def test_inverted_lists(spark):
    """Vectors in distant clusters: few lists are looked into, and every query still gets all its neighbours."""
    rng = np.random.default_rng(3)
    n, k = 4096, 20
    centres = rng.normal(size=(12, 24)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 24)) * 0.3
    x[:1400] = x[0]  # a third of all rows are one vector
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    quantiser, lists = ann.AdditiveQuantiser.fit(x[::4], 4, 64), ann.InvertedLists.fit(x, n)
    assert len(lists.centres) == 8
    index = ann.build_index(table, quantiser, lists)
    held = {r["id"]: r["list"] for r in index.select("id", "list").collect()}
    assert [held[i] for i in range(n)] == lists.of(x).tolist()
    lists.probes = ann.probes_for(index, lists, k)
    assert 1 <= lists.probes < 8

    score = x @ x[::64].T
    own = np.arange(0, n, 64)
    score[own, np.arange(len(own))] = -np.inf
    got = ann.search(index, index.where("id % 64 = 0"), quantiser, lists, k).toPandas()
    assert (got.groupby("query_id").size() == k).all() and set(got.query_id) == set(own)
    hits = sum((g.score.to_numpy() >= np.sort(score[:, q // 64])[-k] - 1e-9).sum() for q, g in got.groupby("query_id"))
    assert hits >= 0.95 * k * len(own)

    # how many lists are needed, by a plain count over the same rows
    tried = sorted(r["id"] for r in ann.first_by_hash(index, "id", 16).collect())
    places = []
    for i in tried:
        s = x @ x[i]
        s[i] = -np.inf
        order = lists.order(x[i : i + 1])[0].tolist()
        places += [order.index(held[j]) for j in np.lexsort((np.arange(n), -s))[:k]]
    assert ann.probes_for(index, lists, k, tried=16, found=0.9) == sorted(places)[int(np.ceil(0.9 * len(places))) - 1] + 1

    # lists with fewer rows than k: more of them are looked into
    few = table.where("id >= 1400").limit(30)
    lists = ann.InvertedLists(np.stack([x[i] for i in range(1400, 1430)]), probes=1)
    index = ann.build_index(few, quantiser, lists)
    got = ann.search(index, index, quantiser, lists, k).toPandas()
    assert (got.groupby("query_id").size() == k).all() and got.query_id.nunique() == 30


def labelled(spark, n=360):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "sed", "tempor", "magna", "quis"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 80)))
        poor, toxic = i % 4 == 0, i % 5 == 0
        if poor:
            text = " ".join(w + "&&&" for w in text.split())
        if toxic:
            text += rng.choice([" idiot ", " moron ", " scum "]) + text
        docs.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    truth = labels.toPandas().set_index("doc_id")
    net = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, net).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in got.held_out.items())
    assert (held.predicted == truth.quality[held.index]).mean() > 0.97 and got.score.between(0, 1).all()
    chain = toxicity.fit_toxicity(docs, labels)
    tox = toxicity.score_toxicity(docs, chain).toPandas().set_index("doc_id")
    assert (tox.toxic[held.index] == truth.toxic[held.index]).mean() > 0.97
    odd = frame(spark, ODD)
    assert quality.score_quality(odd, net).toPandas().score.notna().all() and (toxicity.score_toxicity(odd, chain).toPandas().toxic == 0).all()
    kept = toxicity.drop_toxic(docs, chain).count() + int(tox.toxic.sum())
    assert kept == docs.count() and quality.keep_quality(docs, net).count() == int(got.predicted.sum())
    empty = frame(spark, [])
    assert quality.score_quality(empty, net).count() == toxicity.score_toxicity(empty, chain).count() == 0
    assert len(toxicity.fit_toxicity(empty, labels).columns) == 0 and quality.fit_quality(empty, labels.limit(0)) is not None


def test_scores_do_not_depend_on_neighbours():
    net = quality.ByteNet(1)
    texts = [b"", b"abc", b"hello world " * 300, b"z" * 20]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = net.scores(np.frombuffer(b"".join(texts), np.uint8), at)
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def naive_score(net, text):
    """The network window by window and chunk by chunk."""
    data = list(text) + [0] * (quality.WIDTH - len(text))
    outs = []
    for k in range(len(data) - quality.WIDTH + 1):
        x = np.concatenate([net.w["embed"][b] for b in data[k : k + quality.WIDTH]])
        outs.append([sum(x * net.w["filters"][:, f]) + net.w["bias"][f] for f in range(quality.FILTERS)])
    half = quality.CHUNK // 2
    firsts = range(0, len(outs), half)
    chunks = [np.max([outs[j] for a in ((k, k + half) if k + half < len(outs) else (k - half, k) if k else (k,)) for j in range(a, min(len(outs), a + half))], axis=0) for k in firsts]
    chunks = np.maximum(0, chunks)
    pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)])
    return 1 / (1 + math.exp(-(np.tanh(pooled @ net.w["mix"] + net.w["mix_bias"]) @ net.w["out"] + net.w["out_bias"][0])))


def test_network_by_hand():
    net = quality.ByteNet(4)
    rng = random.Random(3)
    for n in (0, 1, 7, 8, 9, 263, 264, 600, 1300):
        text = bytes(rng.randrange(256) for _ in range(n))
        assert abs(net.scores(np.frombuffer(text, np.uint8), np.array([0, n]))[0] - naive_score(net, text)) < 1e-4


def test_chain_by_hand():
    rows = [(("fine words here " * 3) + ("grumble " if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    chain = toxicity.fit_chain(rows)
    many = ["", "a grumble", "fine words", "GRUMBLE grumbles é", "日本語日本語"]
    weight = dict(zip(chain.columns.tolist(), chain.weights, strict=True))
    for text, got in zip(many, chain.probabilities(many), strict=True):
        places = set()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            places |= {zlib.crc32(g.encode()) % toxicity.PLACES for g in [w + "$", *("^" + w[: n + 1] for n in range(min(7, len(w)))), *(w[i : i + n] for n in (3, 4) for i in range(1, len(w) - n + 1))]}
        z, p = chain.constants + sum(weight[k] for k in places if k in weight), []
        for k in range(len(toxicity.CHAIN)):
            p.append(1 / (1 + math.exp(-(z[k] + sum(chain.earlier[k, j] * p[j] for j in range(k))))))
        assert np.allclose(got, p)
    assert list(chain.probabilities(many)[:, -1] > 0.5) == [False, True, False, True, False]


def test_chain_in_scripts_without_spaces():
    """A mark of one or two characters inside a run of Han or kana is found whatever stands around it."""
    rng = random.Random(5)
    plain = "的一是在人有我他这中大来上国说们为子和你地出道也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起"
    run = lambda n: "".join(rng.choice(plain) for _ in range(n))
    text = lambda mark: "，".join([run(9), run(4) + mark + run(5), run(8)])
    chain = toxicity.fit_chain([(text("恶狗" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)])
    p = chain.probabilities([text("恶狗") for _ in range(50)] + [text("") for _ in range(50)])[:, -1]
    assert (p[:50] > 0.5).all() and (p[50:] < 0.5).all()
    assert len(toxicity.places("恶狗")) == 1 + 2 + 2 + 1 and len(toxicity.places("abcd")) == 1 + 4 + 1


def test_fit_linear_reaches_the_optimum(monkeypatch):
    """The fit's penalised loss goes to that of plain proximal steps over a dense matrix, run to the end; the steps it takes by default stop before."""
    rng = np.random.default_rng(4)
    n, kinds = 120, 14
    y = (rng.random(n) < 0.35).astype(float)
    x = rng.random((n, kinds)) < np.where(y[:, None] > 0, np.linspace(0.2, 0.7, kinds), 0.2)
    before, used = rng.random((n, 2)), np.arange(n) % 4 != 0
    row, place = (a.astype(np.int32) for a in np.nonzero(x))
    scale = toxicity.odds(row, place, y, used)[:kinds] / 3
    assert 3 < (scale > 0).sum() < kinds
    dense = np.column_stack([x * scale, before, np.ones(n)])[used]
    share, target = np.where(y[used] > 0, toxicity.WEIGHT, 1.0) / used.sum(), y[used]
    penalty = np.where(np.arange(kinds + 3) < kinds, toxicity.PENALTY, 0.0)
    loss = lambda w: share @ (np.logaddexp(0, dense @ w) - target * (dense @ w)) + penalty @ np.abs(w)
    step, w = 4 / np.linalg.eigvalsh(dense.T @ (share[:, None] * dense))[-1], np.zeros(kinds + 3)
    for _ in range(20_000):
        w = w - step * (dense.T @ (share * (1 / (1 + np.exp(-dense @ w)) - target)))
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)
    reached = []
    for steps in (toxicity.STEPS, 10 * toxicity.STEPS):
        monkeypatch.setattr(toxicity, "STEPS", steps)
        weight, earlier, constant = toxicity.fit_linear(row, place, before, y, used)
        reached.append(loss(np.concatenate([np.divide(weight[:kinds], scale, out=np.zeros(kinds), where=scale > 0), earlier, [constant]])))
    assert loss(w) - 1e-9 <= reached[1] < loss(w) * 1.005 and reached[1] <= reached[0] < 0.9 * loss(np.zeros(kinds + 3))


def test_network_gradients():
    net = quality.ByteNet(2)
    texts = [b"ab cd ef gh " * 9, b"&&& zz " * 30]
    at, y = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]), np.array([1.0, 0.0], np.float32)
    data = np.frombuffer(b"".join(texts), np.uint8)
    loss = lambda: -np.mean(y * np.log(net.scores(data, at)) + (1 - y) * np.log(1 - net.scores(data, at)))
    g = net.gradients(data, at, y)
    for name, where in (("out", (3,)), ("mix", (5, 2)), ("mix", (60, 2)), ("filters", (4, 6)), ("filters", (40, 1)), ("embed", (97, 2))):
        kept = net.w[name][where]
        net.w[name][where] = kept + 1e-3
        up = loss()
        net.w[name][where] = kept - 1e-3
        down = loss()
        net.w[name][where] = kept
        assert abs((up - down) / 2e-3 - g[name][where]) < 5e-3


def test_html(spark):
    net = html_text.Labeller()
    maker = html_text.PageMaker()
    made = [p for p in (maker.labelled() for _ in range(400)) if p[0]]
    net.fit([html_text.vectors([b]) for b, _ in made], [y for _, y in made])
    page = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   line\nof text here.<p>Second <b>bold</b> line&nbsp;end.</p></article><div class="comments"><p>Nice post</p></div><footer>&copy; me</footer></body></html>'
    pages = spark.createDataFrame([(0, "u", page, 1), (1, None, None, 1), (2, "v", "", 1), (2, "v", "", 1)], "page_id long, url string, html string, text int")
    got = html_text.extract_text(pages, net).toPandas()
    assert got.text[0] == "A & B\nFirst line of text here.\nSecond bold line end." and got.n_chars[0] == len(got.text[0])
    assert list(got.text[1:]) == ["", "", ""] and html_text.extract_text(pages.limit(0), net).count() == 0
    assert html_text.extract_text(pages, html_text.fit_labeller(pages.limit(0))).count() == 4


def test_repeated_rows_and_null_ids(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    net, chain = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    for made in (quality.score_quality(odd, net), secret_scan.secret_digests(odd), toxicity.score_toxicity(odd, chain), packing.pack(odd, BYTE_BPE).where("start = 0"), audio.media_digests(odd), bpe.round_trip_digests(odd, WORD_BPE)):
        assert sorted(r["doc_id"] or 0 for r in made.collect()) == [0, 0, 1, 1]
    pages = spark.createDataFrame([(None, "u", "<p>x"), (3, None, "<p>y"), (3, None, "<p>y")], "page_id long, url string, html string")
    assert html_text.extract_text(pages, html_text.Labeller()).count() == 3
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, score int")
    assert {r["vec_id"] for r in ann.nearest(vectors).collect()} == {1}


def test_samples_are_bounded_and_alike(spark):
    docs, labels = labelled(spark)
    few = labelled_sample(docs, labels, "toxic", {1: 7, 0: 11})
    assert [sum(y for _, y in few), len(few)] == [7, 18] and few == labelled_sample(docs.repartition(5), labels.repartition(3), "toxic", {1: 7, 0: 11})
    assert sum(len(t) for t, _ in labelled_sample(docs, labels, "toxic", {1: 7, 0: 11}, 1500)) <= 1500


def test_tables_at_rest(spark):
    with passing_tables(spark):
        a = materialise(spark.range(3).toDF("x"), "a")
        b = materialise(a, "b", outside=True)
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(a.inputFiles()[0]).count()


def test_head_without_end():
    html = "<html><head><title>T</title><article><p>Main text</p><noscript>kept</noscript><p>a <math><mi>x</mi></math> b <object>o</object></p></article></html>"
    assert [b[0] for b in html_text.blocks_of(html)] == ["Main text", "kept", "a x b o"]
    assert html_text.blocks_of("<head>loose words<p>and more")[0][0] == "loose words"


def test_labels_of_long_pages(spark):
    """Thousands of blocks, and pages read together, give what each page gives alone, step by step."""
    net, maker = html_text.Labeller(), html_text.PageMaker(5)
    pages = [html_text.blocks_of(maker.page()) for _ in range(20)] + [html_text.blocks_of("".join(f"<p>block {k}" for k in range(4000)))]
    together = net.keeps(pages)
    for page, got in zip(pages, together, strict=True):
        x = html_text.vectors([page])
        outs = []
        for way, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, c, kept = np.zeros(html_text.HIDDEN), np.zeros(html_text.HIDDEN), {}
            for t in order:
                i, f, o, n = np.split(x[t] @ net.w[f"x{way}"] + net.w[f"c{way}"] + h @ net.w[f"h{way}"], 4)
                i, f, o = (1 / (1 + np.exp(-v)) for v in (i, f, o))
                c = f * c + i * np.tanh(n)
                h = o * np.tanh(c)
                kept[t] = h
            outs.append([kept[t] for t in range(len(x))])
        z = np.array([np.concatenate(p) @ net.w["out"] + net.w["bias"][0] for p in zip(*outs, strict=True)])
        sure = np.abs(z) > 1e-4
        assert (got[sure] == (z >= 0)[sure]).all()


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0, name


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        gone = before.count() - kept.count()
        if name == "near_duplicates":
            rows = before.toPandas().sort_values("doc_id")
            want, _ = brute_components(list(rows.text), 5, 80)
            assert sorted(kept.toPandas().doc_id) == sorted(rows.doc_id.iloc[sorted(set(want))])
        if name == "secrets":
            assert gone == 0 and not any(secret_scan.base_spans(t) for t in kept.toPandas().text)
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(kept.toPandas().doc_id)
    assert isinstance(packed, pd.DataFrame)


def test_fits_run_in_a_task(spark, monkeypatch):
    docs, labels = labelled(spark)
    rows = labelled_sample(docs, labels, "toxic", {1: 1000, 0: 3000})
    alike, net = toxicity.fit_chain(rows), quality.ByteNet().fit(labelled_sample(docs, labels, "quality", {0: 1500, 1: 1500}))

    def on_driver(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity, "hashed", on_driver)
    monkeypatch.setattr(quality, "laid_out", on_driver)
    chain, found = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)
    assert (chain.columns == alike.columns).all() and (chain.weights == alike.weights).all() and (chain.constants == alike.constants).all()
    assert all(np.allclose(found.w[k], net.w[k], atol=1e-4) for k in net.w)
