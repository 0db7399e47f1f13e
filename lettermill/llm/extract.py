"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each block is main text or not. Its features are the tags and names above it and the shape of its
text; neighbours are tied by transitions. Weights are fitted to labelled pages by gradient ascent on
the conditional likelihood (forward-backward); pages are decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, with_columns
from .html_blocks import Block, blocks

SIZE = 1 << 13  # hashed features
LABELLED_PAGES = 400  # most pages to fit on
DIGIT = re.compile(r"\d")


@lru_cache(maxsize=200_000)
def _bucket(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (SIZE - 1)


def _scale(x: float, steps: Sequence[float]) -> int:
    return sum(x > s for s in steps)


def block_features(all_blocks: Sequence[Block], i: int) -> list[str]:
    b = all_blocks[i]
    n = len(b.text)
    words = b.text.count(" ") + 1
    above = sorted(b.element.above)
    links = _scale(b.linked / n, (0.05, 0.3, 0.8))
    size = _scale(words, (1, 3, 8, 20, 60))
    out = [*above, f"own:{b.tag}", f"words:{size}", f"links:{links}", f"words-links:{size}{links}", f"end:{b.text[-1] in '.!?…'}", f"mark:{b.text[0] in '©®™'}"]
    out += [f"{a}|{size > 2}" for a in above]
    out.append(f"digits:{_scale(len(DIGIT.findall(b.text)) / n, (0.05, 0.3))}")
    out.append(f"place:{_scale(i / len(all_blocks), (0.1, 0.3, 0.7, 0.9))}")
    return out


def page_features(all_blocks: Sequence[Block]) -> list[np.ndarray]:
    return [np.unique([_bucket(f) for f in block_features(all_blocks, i)]) for i in range(len(all_blocks))]


class Field:
    """Weights of the features for `main` (the other class has none), of transitions, of starts."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.weights, self.step, self.begin = weights, step, begin

    def decode(self, features: Sequence[np.ndarray]) -> list[bool]:
        """The likeliest labels (Viterbi); a tie goes to not being main text."""
        if not features:
            return []
        (aa, ab), (ba, bb) = self.step.tolist()
        emit = [float(self.weights[f].sum()) for f in features]
        low, high = self.begin[0], self.begin[1] + emit[0]
        back: list[tuple[bool, bool]] = []
        for e in emit[1:]:
            to_low, to_high = high + ba > low + aa, high + bb > low + ab
            low, high = (high + ba if to_low else low + aa), (high + bb if to_high else low + ab) + e
            back.append((to_low, to_high))
        now = bool(high > low)
        out = [now]
        for to_low, to_high in reversed(back):
            now = to_high if now else to_low
            out.append(now)
        return out[::-1]


def train(pages: Sequence[tuple[Sequence[np.ndarray], Sequence[bool]]], rounds: int = 160, hold: float = 0.003) -> Field:
    """Fits to (features, labels) of pages, all at once: pages are padded to one length."""
    pages = [p for p in pages if len(p[0])]
    weights, step, begin = np.zeros(SIZE), np.zeros((2, 2)), np.zeros(2)
    if not pages:
        return Field(weights, step, begin)
    n, length = len(pages), max(len(f) for f, _ in pages)
    where = np.concatenate([f for page, _ in pages for f in page])
    cell = np.concatenate([np.full(len(f), k * length + t) for k, (page, _) in enumerate(pages) for t, f in enumerate(page)])
    real = np.array([[t < len(page) for t in range(length)] for page, _ in pages])
    gold = np.array([[t < len(y) and bool(y[t]) for t in range(length)] for _, y in pages], float)
    both = real[:, 1:] & real[:, :-1]
    grown = [np.full(SIZE, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)]
    for _ in range(rounds):
        emit = np.zeros((n, length, 2))
        emit[:, :, 1] = np.bincount(cell, weights[where], n * length).reshape(n, length)
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = begin + emit[:, 0]
        for t in range(1, length):
            new = np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(length - 2, -1, -1):
            later = emit[:, t + 1] + behind[:, t + 1]
            new = np.logaddexp(step[:, 0] + later[:, :1], step[:, 1] + later[:, 1:])
            behind[:, t] = np.where(real[:, t + 1, None], new, behind[:, t])
        chance = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        slope_w = np.bincount(where, ((gold - chance[:, :, 1]).ravel())[cell], SIZE) / n - hold * weights / n
        pair = ahead[:, :-1, :, None] + step + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * both[:, :, None, None]).sum((0, 1))
        seen = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
        slope_s = (seen - expected) / n - hold * step / n
        slope_b = np.array([(gold[:, 0] == c).sum() - chance[:, 0, c].sum() for c in (0, 1)]) / n
        for value, slope, g in zip((weights, step, begin), (slope_w, slope_s, slope_b), grown, strict=True):
            g += slope**2
            value += 0.4 * slope / np.sqrt(g)
    return Field(weights, step, begin)


def label(all_blocks: Sequence[Block], main: Iterable[str]) -> list[bool]:
    """Labels of a page's blocks by its known main lines, in order of appearance: of a line that
    occurs elsewhere too, as many blocks count as lines, and those inside article-like parts first."""
    wanted: dict[str, int] = {}
    for line in main:
        wanted[line] = wanted.get(line, 0) + 1
    order = sorted(range(len(all_blocks)), key=lambda i: (not {"tag:article", "tag:main"} & all_blocks[i].element.above, i))
    out = [False] * len(all_blocks)
    for i in order:
        if wanted.get(all_blocks[i].text, 0):
            wanted[all_blocks[i].text] -= 1
            out[i] = True
    return out


def sample_pages(n: int = LABELLED_PAGES, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Labelled pages made here: (html, main lines), of many layouts and of invented words."""
    rnd = random.Random(seed)
    letters = "aeiounrstlchmdéüñ"

    def words(low: int, high: int, end: str = ".") -> str:
        own = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 10))) for _ in range(rnd.randrange(low, high))]
        marks = rnd.choice((0.0, 0.0, 0.1, 0.5))
        own = [w + rnd.choice(("***", "!!", ",", "###", "")) if rnd.random() < marks else w for w in own]
        text = " ".join(own)
        return (text.upper() if rnd.random() < 0.08 else text.capitalize()) + end

    def named(tag: str, names: str, inside: str) -> str:
        name = rnd.choice(names.split())
        how = rnd.choice((f' class="{name}"', f' id="{name}"', f" class='x {name}-wrap'", f' class="{name}_{rnd.randrange(9)}"'))
        return f"<{tag}{how}>{inside}</{tag}>"

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3, "")}</a></li>' for i in range(rnd.randrange(low, high)))

    def menu() -> str:
        inside = f"<ul>{links(3, 9)}</ul>"
        return rnd.choice((f"<nav>{inside}</nav>", named("div", "nav menu navbar main-menu topnav breadcrumb", inside)))

    def advert() -> str:
        return named(rnd.choice(("div", "section", "aside")), "ad ads advert sponsored banner promo ad-slot", rnd.choice((words(2, 30), f"<p>{words(4, 25)}</p>", f'<a href="/x">{words(3, 9)}</a>')))

    def notice() -> str:
        return named(rnd.choice(("div", "section")), "cookie-notice cookies notice alert consent disclaimer popup", f"<p>{words(5, 30)}</p>" + rnd.choice(("", "<button>OK</button>", f"<a href='/p'>{words(1, 3)}</a>")))

    def form() -> str:
        return f"<form>{rnd.choice(('', '<h3>' + words(1, 4, '') + '</h3>'))}<label>{words(1, 4, '')}</label><input name=q><p>{words(3, 20)}</p><button>{words(1, 2, '')}</button></form>"

    def sidebar() -> str:
        inside = f"<h3>{words(1, 4, '')}</h3>" + rnd.choice((f"<ul>{links(2, 7)}</ul>", f"<p>{words(5, 40)}</p>", f"<div>{words(5, 30)}</div>"))
        return rnd.choice((f"<aside>{inside}</aside>", named("div", "sidebar side widget related recommended", inside)))

    def comments() -> str:
        each = "".join(rnd.choice((f"<p>{words(3, 60)}</p>", named("div", "comment comment-body reply", f"<b>{words(1, 3, '')}</b><p>{words(3, 60)}</p>"), f"<li>{words(3, 60)}</li>")) for _ in range(rnd.randrange(1, 6)))
        return named(rnd.choice(("div", "section", "ol", "ul")), "comments commentlist comment-list discussion responses reader-comments responses replies", rnd.choice(("", f"<h2>{words(1, 4, '')}</h2>", f"<h3>{words(1, 4, '')}</h3>")) + each)

    def header() -> str:
        inside = rnd.choice((f"<h1>{words(1, 5, '')}</h1>", f"<p>{words(2, 10)}</p>", f"<a href='/'>{words(1, 3, '')}</a><p>{words(2, 9)}</p>", f"<div>{words(2, 12)}</div>"))
        return rnd.choice((f"<header>{inside}</header>", named("div", "header masthead site-header top-bar", inside)))

    def footer() -> str:
        inside = rnd.choice((f"&copy; {words(1, 20)}", f"<p>&copy; {words(2, 30)}</p>", f"<p>{words(4, 40)}</p>", f"<ul>{links(2, 6)}</ul><p>{words(3, 20)}</p>", f"{words(2, 5)} &middot; {words(3, 12)}\n{words(3, 12)}"))
        return rnd.choice((f"<footer>{inside}</footer>", named("div", "footer site-footer foot copyright", inside)))

    out = []
    for _ in range(n):
        lines: list[str] = []
        body = ""
        if rnd.random() < 0.85:
            lines.append(words(2, 14, rnd.choice(("", "."))))
            level = rnd.choice("1112")
            body += f"<h{level}>{lines[-1]}</h{level}>"
        inner = [advert, sidebar, form, notice, menu]
        for _ in range(rnd.choice((1, 1, 2, 3, 5, 8, 14))):
            line = words(*rnd.choice(((1, 3), (3, 12), (10, 60), (40, 160))))
            lines.append(line)
            kind = rnd.random()
            if kind < 0.6:
                body += f"<p>{line}</p>"
            elif kind < 0.72:
                body += f"<p><b>{line}<br>"
            elif kind < 0.78:
                head, *tail = line.split(" ")
                body += f"<p><a href='/l'>{head}</a> {' '.join(tail)}</p>"
            elif kind < 0.84:
                body += f"<blockquote>{line}</blockquote>"
            elif kind < 0.9:
                body += f"<div>{line}</div>"
            elif kind < 0.95:
                body += f"<ul><li>{line}</li></ul>"
            else:
                body += f"<h2>{line}</h2>"
            if rnd.random() < 0.15:
                body += rnd.choice(inner)()
        core = rnd.choice((f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", named("div", "content article post entry-content story main-content article-body", body), named("section", "content post article", body), f"<div>{body}</div>"))
        before = "".join(part() for part in (header, menu, notice, advert, sidebar, form) if rnd.random() < 0.5)
        after = "".join(part() for part in (comments, sidebar, advert, form, notice, menu, footer) if rnd.random() < 0.5)
        title = f"<!DOCTYPE html><html><head><title>{lines[0][:60]}</title><style>p{{}}</style><script>var t='<p>x</p>';</script></head><body>"
        page = title + before + core + after + rnd.choice(("</body></html>", "", "</html>"))
        out.append((page, [" ".join(line.split()) for line in lines]))
    return out


def fit(labelled: Iterable[tuple[str, list[str]]]) -> Field:
    """A field from labelled pages (html, main lines): at most LABELLED_PAGES of them."""
    pages = []
    for html, main in list(labelled)[:LABELLED_PAGES]:
        own = blocks(html)
        pages.append((page_features(own), label(own, main)))
    return train(pages)


def main_text(html: str | None, field: Field) -> str:
    own = blocks(html)
    return "\n".join(b.text for b, main in zip(own, field.decode(page_features(own)), strict=True) if main)


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, field: Field, html: str = "html") -> DataFrame:
    """pages with text and n_chars, in place of columns of these names.

    Null, empty and all-boilerplate pages have an empty text. Pages of any size are taken whole;
    rows are judged one by one, so ids may be null or repeated; other columns stay.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field)  # fixed size

    def start():
        own = sent.value

        def step(rows):
            texts = [main_text(x, own) for x in rows[html]]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return with_columns(pages, [html], EXTRACTED, start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(sample_pages())).select("page_id", "url", F.col("text"), "n_chars")
