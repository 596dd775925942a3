"""Main text of web pages by a recurrent labeller of blocks, in numpy.

A page is read as its sequence of text blocks. Each block is a vector of its hashed tag
path (element names, words of class and id attributes), its hashed words, and a few
numbers. A bidirectional LSTM reads the whole sequence, so each block is classified as
main text or not in the context of the whole page. It is fitted on generated pages in
many layouts whose main text is known, and on a bounded sample of the given pages whose
elements say what they hold.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import first_by_hash, prepare, texts
from tracewell.llm.neardup import word_hashes

#: Elements whose content is no text of a page, elements that may stand in a head, elements without content, and elements that don't end a block.
SILENT = frozenset("script style template head title svg select textarea button".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym annotation audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mroot mrow ms msqrt msub msubsup msup mtext object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var video wbr".split())
#: Silent elements that a start tag of the second set ends, closed or not.
BROKEN_OUT = frozenset("button select svg".split())
BLOCK_LEVEL = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table ul".split())
#: Elements, and words of class and id attributes, that say what they hold; used to label the sample of given pages.
SAYS_MAIN = frozenset("article main".split())
SAYS_OTHER = frozenset("nav footer header aside form menu ad ads advert advertisement banner sidebar cookie notice promo comment comments".split())

PATH, BAG, NUMBERS, HIDDEN, SEED = 96, 32, 7, 24, 3
WIDE = PATH + BAG + NUMBERS
#: Pages that are generated, given pages that are sampled at most, steps and pages of a step.
MADE, SAMPLE, STEPS, PAGES, RATE = 900, 200, 320, 24, 0.008
#: Blocks of pages that are labelled together, and of a given page that is fitted on at most; characters of a given page, and of all, that come to the driver at most.
TOGETHER, FITTED, LONGEST, MOST_CHARACTERS = 6000, 500, 1_000_000, 64_000_000


#: (text, path vector, share of it in links, whether its elements say that it is main text).
Block = tuple[str, np.ndarray, float, bool]

_places: dict[str, tuple[int, float]] = {}


def place(token: str) -> tuple[int, float]:
    """Where a path token counts, and its sign."""
    found = _places.get(token)
    if found is None:
        h = zlib.crc32(token.encode("utf-8", "replace"))
        found = (h % PATH, 1.0 if h & (1 << 20) else -1.0)
        if len(_places) < 20_000:
            _places[token] = found
    return found


class Blocks(HTMLParser):
    """The text blocks of a page. Entities are decoded, white space made single.

    The hashed path and what the open elements say are kept up to date as elements open
    and close, so a block costs the same at any depth.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []
        self.path = np.zeros(PATH, np.float32)
        self.open: Counter[str] = Counter()
        self.main = self.other = 0
        self.silent, self.link = 0, 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def turn(self, tokens: list[str], way: int) -> None:
        for t in tokens:
            i, sign = place(t)
            self.path[i] += way * sign
            name = t.lstrip(".")
            self.main += way * (name in SAYS_MAIN)
            self.other += way * (name in SAYS_OTHER)

    def push(self, tag: str, tokens: list[str]) -> None:
        self.stack.append((tag, tokens))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.turn(tokens, 1)

    def pop(self) -> str:
        tag, tokens = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        self.turn(tokens, -1)
        return tag

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = self.path.copy()
            i, sign = place(f"leaf:{self.stack[-1][0]}" if self.stack else "leaf:")
            path[i] += sign
            self.blocks.append((text, path, min(1.0, self.linked / len(text)), bool(self.main and not self.other)))
        self.parts, self.linked, self.link = [], 0, 0

    def end_head(self) -> None:
        """A head ends where something stands in it that can't, closed or not."""
        if self.stack and self.stack[-1][0] == "head":
            self.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCK_LEVEL:
            while self.stack and self.stack[-1][0] in BROKEN_OUT:
                self.pop()
        if tag in SILENT:
            if tag not in ("head", "title") or not self.silent:
                self.flush() if tag not in ("button", "select", "svg", "math") else None
            self.push(tag, [])
            return
        if self.silent:
            if tag == "body":  # an unclosed head
                while self.stack:
                    self.pop()
            else:
                return
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.link = 1
            return
        self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == tag:
            self.pop()
        elif tag not in ("p",) and self.stack and self.stack[-1][0] == "p":
            self.pop()
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [f".{w.lower()}" for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]
        self.push(tag, names)

    def handle_startendtag(self, tag, attrs):
        if tag in INLINE or tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in INLINE and not self.silent:
            if tag == "a":
                self.link = 0
            return
        if not self.open[tag]:
            return
        if not self.silent:
            self.flush()
        while self.stack and self.pop() != tag:
            pass

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in its order; an empty page has none."""
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """(blocks, WIDE) inputs of the blocks of all pages, one after the other."""
    blocks = [b for page in pages for b in page]
    x = np.zeros((len(blocks), WIDE), np.float32)
    if not blocks:
        return x
    coded = [b[0].encode("utf-8", "replace") for b in blocks]
    at = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    data = np.frombuffer(b"".join(coded), np.uint8)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    digits = digits[at[1:]] - digits[at[:-1]]
    words, owner = word_hashes(data, at)
    bag = np.bincount(owner * BAG + (words % np.uint64(BAG)).astype(np.int64), minlength=len(blocks) * BAG).reshape(-1, BAG)
    x[:, PATH : PATH + BAG] = np.sqrt(bag / np.maximum(1, bag.sum(axis=1, keepdims=True)))
    count = np.bincount(owner, minlength=len(blocks))
    row = 0
    for page in pages:
        for k, (text, path, linked, _) in enumerate(page):
            x[row, :PATH] = path
            x[row, PATH + BAG :] = np.log1p(len(text)) / 5, np.log1p(count[row]) / 3, linked, k / len(page), 1 / (1 + k), text[-1] in ".!?:", digits[row] / len(text)
            row += 1
    np.clip(x[:, :PATH], -2, 2, out=x[:, :PATH])
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM over blocks with one output for each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w: dict[str, np.ndarray] = {}
        for way in "fb":
            self.w[f"x{way}"], self.w[f"h{way}"], bias = init(WIDE, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w[f"c{way}"] = bias
        self.w["out"], self.w["bias"] = init(2 * HIDDEN), np.zeros(1, np.float32)

    def read(self, x: np.ndarray, mask: np.ndarray, way: str) -> list[tuple]:
        """Steps (gates, cell before, tanh of cell, hidden before, hidden) over x (time, pages, WIDE)."""
        u, bias = self.w[f"h{way}"], self.w[f"c{way}"]
        pre = (x.reshape(-1, WIDE) @ self.w[f"x{way}"] + bias).reshape(*x.shape[:2], -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        steps = []
        for t in range(len(x)):
            z = pre[t] + h @ u
            g = np.concatenate([sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])], axis=1)
            i, f, o, n = np.split(g, 4, axis=1)
            m = mask[t][:, None]
            new = (f * c + i * n) * m
            tc = np.tanh(new)
            out = o * tc * m
            steps.append((g, c, tc, h, out))
            h, c = out, new
        return steps

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        kept = {"f": self.read(x, mask, "f"), "b": self.read(x[::-1], mask[::-1], "b")}
        h = np.concatenate([np.stack([s[4] for s in kept["f"]]), np.stack([s[4] for s in kept["b"]])[::-1]], axis=2)
        return h @ self.w["out"] + self.w["bias"], kept | {"h": h}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, kept = self.logits(x, mask)
        d = ((sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)
        g = {"out": np.einsum("tph,tp->h", kept["h"], d), "bias": d.sum(keepdims=True).reshape(1)}
        dh = d[:, :, None] * self.w["out"]
        for way, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
            xs, ms = (x, mask) if way == "f" else (x[::-1], mask[::-1])
            u = self.w[f"h{way}"]
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            later = np.zeros((x.shape[1], HIDDEN), np.float32)
            cell = np.zeros_like(later)
            g[f"h{way}"] = np.zeros_like(u)
            for t in range(len(x) - 1, -1, -1):
                gates, c, tc, h, _ = kept[way][t]
                i, f, o, n = np.split(gates, 4, axis=1)
                m = ms[t][:, None]
                up = (part[t] + later) * m
                dc = (up * o * (1 - tc**2) + cell) * m
                dz[t] = np.concatenate([dc * n * i * (1 - i), dc * c * f * (1 - f), up * tc * o * (1 - o), dc * i * (1 - n**2)], axis=1)
                g[f"h{way}"] += h.T @ dz[t]
                later, cell = dz[t] @ u.T, dc * f
            g[f"x{way}"] = xs.reshape(-1, WIDE).T @ dz.reshape(-1, 4 * HIDDEN)
            g[f"c{way}"] = dz.sum(axis=(0, 1))
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> Labeller:
        """Adam over random batches of pages."""
        rng = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for t in range(1, STEPS + 1):
            some = rng.choice(len(pages), min(PAGES, len(pages)), replace=False)
            x, mask = padded([pages[i] for i in some])
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(some):
                y[: len(labels[i]), k] = labels[i]
            g = self.gradients(x, mask, y)
            norm = float(np.sqrt(sum((a**2).sum() for a in g.values())))
            rate = RATE * min(1, t / 30) * (1 - 0.9 * t / STEPS)
            for k, w in self.w.items():
                a = g[k] * min(1.0, 1.0 / max(norm, 1e-9)) + 1e-5 * w
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a**2 - v[k])
                w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def keeps(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page which of its blocks are main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * len(pages[order[end]]) <= TOGETHER:
                end += 1
            group = order[start:end]
            every = vectors([pages[i] for i in group])
            edge = np.concatenate([[0], np.cumsum([len(pages[i]) for i in group])])
            z, _ = self.logits(*padded([every[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]))
            for k, i in enumerate(group):
                out[i] = z[: len(pages[i]), k] >= 0
            start = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, pages, WIDE) inputs and which of them are blocks."""
    longest = max(len(p) for p in pages)
    x, mask = np.zeros((longest, len(pages), WIDE), np.float32), np.zeros((longest, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


class PageMaker:
    """Pages in many layouts whose main text is known: every text of the main part holds the mark MAIN."""

    MAIN = ""

    def __init__(self, seed: int = SEED):
        self.rng = random.Random(seed)
        self.syllables = [self.rng.choice("aeiouéäñ") + self.rng.choice("bcdfglmnprstvz") for _ in range(120)]

    def pick(self, *options):
        return self.rng.choice(options)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.rng.choices(self.syllables, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(low, high))]
        out = [w + self.pick(",", ".", "") if self.chance(0.2) else w for w in out]
        return " ".join(out).capitalize() + self.pick(".", ".", ".", "", "!", "?")

    def link(self, text: str) -> str:
        return f'<a href="/{len(text)}">{text}</a>'

    def attribute(self, *names: str) -> str:
        return f' {self.pick("class", "id", "class")}="{self.pick(*names)}{self.pick("", "", "-1", " wrap", "_box")}"'

    def menu(self) -> str:
        items = [self.link(self.pick(self.words(1, 1), self.pick("Home", "About", "Contact", "News", "Login", "Shop"))) for _ in range(self.rng.randint(3, 8))]
        inner = self.pick("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items))
        return self.pick(f"<nav>{inner}</nav>", f"<nav{self.attribute('nav', 'menu', 'navbar')}>{inner}</nav>", f"<div{self.attribute('nav', 'menu', 'topmenu', 'navigation', 'breadcrumb')}>{inner}</div>", f"<ul{self.attribute('menu', 'nav')}>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")

    def advert(self) -> str:
        inner = self.pick(self.words(3, 20), f"<p>{self.words(3, 20)}</p>", self.link(self.words(2, 8)))
        return self.pick(f'<div class="ad">{inner}</div>', f"<div{self.attribute('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{inner}</div>", f"<aside{self.attribute('ad', 'advert', 'promo')}>{inner}</aside>")

    def notice(self) -> str:
        return f"<div{self.attribute('cookie', 'cookies', 'notice', 'consent', 'alert', 'gdpr', 'popup', 'newsletter')}>{self.pick('<p>', '<span>', '')}{self.words(4, 25)}</div>"

    def form(self) -> str:
        return f"<form{self.pick('', self.attribute('search', 'login', 'subscribe'))}><label>{self.words(1, 3)}</label><input name=q>{self.pick('', f'<p>{self.words(2, 12)}</p>')}<button>{self.words(1, 2)}</button></form>"

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.pick("".join(f"<p>{self.words(4, 30)}</p>" for _ in range(self.rng.randint(1, 3))), "<ul>" + "".join(f"<li>{self.link(self.words(2, 8))}</li>" for _ in range(4)) + "</ul>")
        return self.pick(f"<aside>{inner}</aside>", f"<aside{self.attribute('sidebar', 'related', 'widget')}>{inner}</aside>", f"<div{self.attribute('sidebar', 'related', 'widget', 'side', 'share')}>{inner}</div>")

    def comments(self) -> str:
        one = lambda: self.pick(f"<p>{self.words(3, 40)}</p>", f"<div{self.attribute('comment')}><b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p></div>", f"<li{self.attribute('comment', 'reply')}>{self.words(3, 40)}</li>")
        inner = self.pick("", f"<h3>{self.pick('Comments', self.words(1, 3))}</h3>") + "".join(one() for _ in range(self.rng.randint(1, 5)))
        return self.pick(f"<section{self.attribute('comments', 'discussion', 'responses')}>{inner}</section>", f"<div{self.attribute('comments', 'comment-list', 'replies', 'disqus')}>{inner}</div>", f"<ol{self.attribute('comments', 'commentlist')}>{inner}</ol>")

    def footer(self) -> str:
        inner = self.pick("&copy; ", "Copyright ", "") + self.pick("example.com &middot; ", "") + self.words(2, 25)
        return self.pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.attribute('footer', 'bottom', 'copyright')}>{inner}</div>", f"<footer><p>{inner}</p><ul><li>{self.link(self.words(1, 2))}</li></ul></footer>")

    def article(self) -> str:
        say = lambda low, high: self.MAIN + self.words(low, high)
        parts = [f"<h1>{say(2, 14)}</h1>"] if self.chance(0.85) else []
        for _ in range(self.rng.randint(1, 9)):
            kind = self.rng.random()
            if kind < 0.7:
                parts.append(f"<p>{self.pick('', '<b>', '')}{say(1, 120) if self.chance(0.8) else say(1, 4)}{self.pick('</p>', '</p>', '<br>')}")
            elif kind < 0.78:
                parts.append(f"<h2>{say(1, 8)}</h2>")
            elif kind < 0.85:
                parts.append("<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(self.rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{say(4, 40)}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<pre>{say(3, 20)}</pre>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{say(1, 4)}</td><td>{say(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(self.pick(self.advert, self.side, self.form, self.notice)())
        inner = "".join(parts)
        return self.pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{self.attribute('content', 'post', 'entry', 'article', 'story', 'main', 'text', 'body')}>{inner}</div>", f"<section{self.attribute('content', 'post', 'article')}>{inner}</section>", f"<div>{inner}</div>")

    def page(self) -> str:
        before = [self.pick(self.menu, self.menu, self.notice, self.advert, lambda: f"<header><h2>{self.words(1, 4)}</h2>{self.pick('', self.menu())}</header>", self.form)() for _ in range(self.rng.randint(1, 3))]
        after = [self.pick(self.comments, self.side, self.advert, self.form, self.notice)() for _ in range(self.rng.randint(0, 3))]
        if self.chance(0.3):
            before.append(self.side())
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{''.join(before)}{self.article()}{''.join(after)}{self.footer() if self.chance(0.9) else ''}</body></html>"

    def labelled(self) -> tuple[list, np.ndarray]:
        blocks = blocks_of(self.page())
        return [(t.replace(self.MAIN, ""), *rest) for t, *rest in blocks if t.replace(self.MAIN, "")], np.array([self.MAIN in t for t, *_ in blocks if t.replace(self.MAIN, "")], np.float32)


def told(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page whose elements say what they hold; None where nothing says what the main text is."""
    main = np.array([says for *_, says in blocks], np.float32)
    return main if main.any() else None


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, most_blocks: int = FITTED) -> Labeller:
    """A labeller fitted on MADE generated pages and `sample` given ones at most, the first by the hash of their id.

    Of these, pages of over `most_blocks` blocks, and pages whose elements don't say what
    they hold, aren't fitted on, nor pages of over LONGEST characters, nor what is beyond
    MOST_CHARACTERS in that order. Null and repeated ids and null pages do no harm.
    """
    given = pages.where(pages[html_col].isNotNull()).select(pages[id_col].alias("id"), pages[html_col].alias("html"))
    few = first_by_hash(given.where(F.length("html") <= LONGEST), "id", sample)
    place = Window.orderBy(F.xxhash64("id"), "id", "html").rowsBetween(Window.unboundedPreceding, 0)  # over the few rows of the sample
    rows = few.withColumn("size", F.sum(F.length("html")).over(place)).where(F.col("size") <= MOST_CHARACTERS).toArrow()
    maker = PageMaker()
    made = [maker.labelled() for _ in range(MADE)]
    for html in rows.column("html").to_pylist():
        blocks = blocks_of(html)
        labels = told(blocks)
        if labels is not None and len(blocks) <= most_blocks:
            made.append((blocks, labels))
    made = [(b, y) for b, y in made if b]
    return Labeller().fit([vectors([b]) for b, _ in made], [y for _, y in made])


def extract_text(pages: DataFrame, labeller: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string, n_chars long) of every page: its main blocks in order, joined by line breaks.

    Null and empty pages, and pages without main blocks, give an empty text. Repeated
    rows give repeated rows, an empty table none; other columns are ignored.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                every = [blocks_of(h) for h in texts(part, "html")]
                found = ["\n".join([b[0] for b, keep in zip(blocks, keeps, strict=True) if keep]) for blocks, keeps in zip(every, labeller.keeps(every), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", "url", "text", "n_chars"])

    df = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
