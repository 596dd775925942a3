"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests picks out.

Every longest stretch of letters, digits, `+`, `/`, `_` and `-` of LEAST_TESTED characters
or more is tested, whatever stands before and after it; one or two `=` behind it belong
to it where nothing of a stretch and no third `=` follows. No encoding has both `+` or `/`
and `_` or `-`: of a stretch with both kinds each part between `+` and `/` of that length
is tested for itself. A string's encoding is inferred from its characters; three statistics say how random it
looks within that alphabet: the chi-squared distance from uniform use, the runs of
character classes (of vowels and consonants, where all are letters of one case), and the
lag-1 correlation. Each is turned into a probability under the model of an ordinary name
or word of the same length, so a short string needs to look far more random than a long
one. The probabilities of all strings of all documents go through a weighted
Benjamini-Hochberg step; longer strings have more weight, and weights have mean 1 over
the corpus. Stretches of digits alone are not tested: ordinary numbers look as random.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewell.llm.common import free_name, materialise, prepare, texts

#: The base patterns, with the least length of what is reported.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the tests, and the alphabets they may be written in, the narrowest first.
LEAST_TESTED = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{{{LEAST_TESTED},}})(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
PART = re.compile(rf"[^+/]{{{LEAST_TESTED},}}")
DIGITS, LOWER, UPPER, VOWELS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiouAEIOU"
ALPHABETS = {"hex": DIGITS + "abcdef", "hex upper": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base36 upper": DIGITS + UPPER, "letters": LOWER + UPPER, "base62": DIGITS + LOWER + UPPER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_"}

#: Model of an ordinary string: chance that two characters agree (at least so many times the uniform chance), share of neighbours of different class, share of a vowel beside a consonant, lag-1 correlation.
ORDINARY_AGREE, AGREE_TIMES, ORDINARY_SWITCH, ORDINARY_TURN, ORDINARY_CORRELATION = 0.065, 2.2, 0.22, 0.62, 0.4
#: Correlation assumed between the three tests when they are combined.
BETWEEN_TESTS = 0.5
#: A string is no longer plausible as random when its chi-squared statistic is so many deviations above the uniform mean.
TOO_UNEVEN = 3.5
#: Expected share of ordinary strings among those reported; steps of -log10(p) kept; largest score kept.
FALSE_SHARE, STEPS, TOP = 0.01, 50, 2000
#: Classes of length, four for each doubling from LEAST_TESTED on; a class's weight before it is normalised grows with its length.
CLASSES = 13

#: Each character's place in each alphabet, or -1; its class (digit, lower, upper, other); whether it is a vowel.
PLACE = {name: np.array([letters.find(chr(c)) for c in range(128)]) for name, letters in ALPHABETS.items()}
CLASS = np.array([0 if chr(c) in DIGITS else 1 if chr(c) in LOWER else 2 if chr(c) in UPPER else 3 for c in range(128)])
VOWEL = np.array([chr(c) in VOWELS for c in range(128)]).astype(int)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in code points, by start and then kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding(token: str) -> str | None:
    """The narrowest alphabet that holds token, padding aside; none for digits alone."""
    held = set(token.rstrip("="))
    if held <= set(DIGITS):
        return None
    return next((name for name, letters in ALPHABETS.items() if held <= set(letters)), None)


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float:
    """-log10 of the chance that an ordinary string of this length looks as random; 0 if it doesn't look random."""
    name = encoding(token)
    if name is None:
        return 0.0
    codes = np.frombuffer(token.rstrip("=").encode(), np.uint8)
    places, n, k = PLACE[name][codes], len(codes), len(ALPHABETS[name])
    counts = np.bincount(places, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    if chi > k - 1 + TOO_UNEVEN * math.sqrt(2 * (k - 1)):
        return 0.0
    shift = n * (max(k * ORDINARY_AGREE, AGREE_TIMES) - 1)
    z_uniform = (k - 1 + shift - chi) / math.sqrt(2 * (k - 1 + 2 * shift))
    one_case = name in ("lower", "upper")
    classes, share, way = (VOWEL[codes], ORDINARY_TURN, -1) if one_case else (CLASS[codes], ORDINARY_SWITCH, 1)
    switches = int((classes[1:] != classes[:-1]).sum())
    z_runs = way * (switches - (n - 1) * share) / math.sqrt((n - 1) * share * (1 - share))
    x = places - places.mean()
    r = float((x[1:] * x[:-1]).sum() / max(1e-9, (x * x).sum()))
    z_serial = (ORDINARY_CORRELATION - abs(r)) * math.sqrt(n)
    z = (z_uniform + z_runs + z_serial) / math.sqrt(3 + 6 * BETWEEN_TESTS)
    return -math.log10(max(1e-300, normal_tail(z)))


def length_class(n: int) -> int:
    """0 to CLASSES - 1."""
    return max(0, min(CLASSES - 1, int(4 * math.log2(max(n, 1) / LEAST_TESTED))))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every string that is tested."""
    for m in CANDIDATE.finditer(text):
        body = m[1]
        if ("-" in body or "_" in body) and ("/" in body or "+" in body):
            for part in PART.finditer(body):
                last = part.end() == len(body)
                yield m.start() + part.start(), m.end() if last else m.start() + part.end()
        else:
            yield m.span()


def tested_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, score, class) of every tested string; score is randomness() in steps, rounded down."""
    return [(a, b, min(TOP, int(randomness(text[a:b]) * STEPS)), length_class(b - a)) for a, b in candidates(text)]


SPANS = "base array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,end:int,score:int,class:int>>"


def scan(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """(docs with a column more, its name): struct of base and tested spans of every text, offsets in code points.

    Null and empty texts give empty arrays; every input row gives one row, repeated ones
    and those without an id too, an empty table none.
    """
    prepare(docs.sparkSession)
    name = free_name(docs, "secrets")
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    test = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "score", "class")]))
    kind = pa.struct([("base", span), ("tested", test)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"base": [{"start": a, "kind": k, "end": b} for a, k, b in base_spans(text)], "tested": [{"start": a, "end": b, "score": s, "class": c} for a, b, s, c in tested_spans(text)]} for text in texts(batch, text_col)]
            yield batch.append_column(name, pa.array(rows, kind))

    schema = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(SPANS))])
    return docs.mapInArrow(run, schema), name


def cutoffs(scanned: DataFrame, column: str, false_share: float = FALSE_SHARE) -> list[int]:
    """Least score to report of each class of length: weighted Benjamini-Hochberg over every tested string of the corpus.

    A class's weight is that of its length, over the mean weight of all tested strings.
    Only the counts of (class, score) come to the driver, CLASSES * (TOP + 1) rows at
    most. Where nothing can be reported the cutoffs are above every score.
    """
    each = scanned.select(F.explode(f"{column}.tested").alias("t")).groupBy("t.class", "t.score").agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in each)
    if not total:
        return [TOP + 1] * CLASSES
    raw = [2 ** (c / 4) for c in range(CLASSES)]
    mean = sum(raw[r["class"]] * r["n"] for r in each) / total
    weight = [w / mean for w in raw]
    found = sorted(((r["score"] / STEPS + math.log10(weight[r["class"]]), r["n"]) for r in each if r["score"]), reverse=True)
    above, level = 0, math.inf
    for k, (log, n) in enumerate(found):
        above += n
        last = k + 1 == len(found) or found[k + 1][0] < log
        if last and 10**-log <= false_share * above / total:
            level = log
    return [TOP + 1 if level == math.inf else max(1, math.ceil((level - math.log10(w)) * STEPS - 1e-6)) for w in weight]


def reported(column: str, least: list[int]) -> Column:
    """Base spans and the reported strings that no base span covers, as (start, kind, end) in order."""
    base, level = F.col(f"{column}.base"), F.array(*map(F.lit, least))
    good = lambda t: (t["score"] >= F.element_at(level, t["class"] + 1)) & ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"]))
    more = F.transform(F.filter(f"{column}.tested", good), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return F.sort_array(F.concat(base, more))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """(id, spans array<struct<start,kind,end>>, n_base int): all secrets of every document; kind indexes KINDS.

    Documents without secrets, and null or empty texts, have no spans. Repeated rows give
    repeated rows, null ids stay null, an empty table gives no rows.
    """
    scanned, name = scan(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    kept = materialise(scanned.drop("text"), "secrets")
    return kept.select(F.col("id").alias(id_col), reported(name, cutoffs(kept, name, false_share)).alias("spans"), F.size(f"{name}.base").alias("n_base"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random long, base_sha256, spans string) of every document; see find_secrets()."""
    found = find_secrets(docs, id_col, text_col)
    name = F.transform("spans", lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter(name, lambda s: ~s.startswith("random:"))
    return found.select(id_col, *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(name, ",").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """docs with every secret in text_col replaced by [SECRET]; overlapping spans are replaced together.

    All columns and rows stay, repeated ones too, null texts stay null; n_chars, where
    there is such a column, is the new text's length. An empty table stays empty. The
    table is scanned once and kept with its spans in the shared folder.
    """
    scanned, name = scan(docs, text_col)
    kept = materialise(scanned, "secrets")
    marked = kept.withColumn(name, reported(name, cutoffs(kept, name, false_share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = batch.schema.get_field_index(text_col), batch.column(batch.num_columns - 1)
            out = batch.column(at).to_pylist()
            for k in np.flatnonzero(pc.list_value_length(spans).to_numpy(zero_copy_only=False)):
                text, parts, end = out[k], [], 0
                for span in spans[k].as_py():
                    if span["start"] >= end:
                        parts += [text[end : span["start"]], "[SECRET]"]
                    end = max(end, span["end"])
                out[k] = "".join([*parts, text[end:]])
            clean = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            yield clean.select(range(batch.num_columns - 1))

    clean = marked.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length(clean[text_col]).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
