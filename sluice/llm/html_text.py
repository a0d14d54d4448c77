"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: text between the borders of block-level elements, with the path of open elements (tags and
the words of class and id). A bidirectional LSTM in numpy reads the page's whole sequence of blocks, each as a hashed vector
of its path, a hashed vector of its words and its length and link share, and labels every block as main text or not with
the context of the document on both sides. Pages are labelled in groups of about equal length; a page is never cut.

The model is fitted on the driver on a bounded sample (TRAIN_PAGES pages of at most TRAIN_CHARS characters, those with the
least hash of page_id): the pages themselves, labelled by the semantics of their elements, each once more with other containers
and boilerplate put in, and COMPOSED pages made from the texts of each by a grammar of templates (wrappers, menus, meta lines,
adverts within the article, comments, sidebars, table layouts, bare pages), whose labels are known by construction. Names that tell nothing
are strewn in and names and word vectors left out at random, so that it does not hang on one template. Its weights, some tens
of thousands of numbers, are what the tasks get.

Defined cases: null, empty and text-free pages give an empty text; broken and truncated markup is read as far as it goes;
all character references are decoded; repeated rows give repeated results; other columns are ignored, those named text or n_chars too.
"""

from __future__ import annotations

import random
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import table

TRAIN_PAGES = 300
CELLS = 1 << 15
TRAIN_CHARS = 20_000
COMPOSED = 7  # pages of other templates made from each page of the sample
STEPS = 900
DROPPED = 0.1  # share of the names of a page that a training step does not show; of the word vectors, half
DECAY = 0.02
BATCH = 24
PATH_DIM, WORD_DIM, HIDDEN = 256, 32, 16
DIM = PATH_DIM + WORD_DIM + 3

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - frozenset("html head body title button option select".split())
# Elements and class words that mark boilerplate or main text, for the labels of the training sample.
BOILERPLATE = frozenset(
    "head title nav menu footer aside sidebar form button select option textarea ad ads advert advertisement banner promo sponsored "
    "cookie cookies notice consent comment comments reply replies related share social breadcrumb breadcrumbs pagination newsletter "
    "subscribe login search header dialog popup copyright toolbar widget".split()
)
MAIN = frozenset("article main content post entry story article-body entry-content post-content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# The grammar of training pages: elements and class words that sites use for each part.
WRAPPERS = "div div.wrapper div.container div.page div.site div.layout>div.row div.row>div.col div.inner section div.grid div.site-content div.primary div.columns>div"
TOPS = "header header.site-header div.header div.masthead div.topbar div.site-branding div.page-head div.banner div.head div.top"
MENUS = "nav nav.main-nav div.menu ul.menu div.nav div.navbar nav.breadcrumb div.breadcrumbs ol.breadcrumb nav.toc div.toc div.pagination nav>ul"
SIDES = "aside aside.widget-area div.sidebar div.secondary div.side-bar div.rail div.widget-area div.related div.right-column div.left-column div.promo aside.related"
BOTTOMS = "footer footer.site-footer div.footer div.colophon div.site-info div.copyright div.bottom div.foot"
NOTICES = "div.cookie-banner div.notice div.popup dialog div.consent div.alert div.modal form.search div.search form.login div.login form.subscribe div.cookies div.overlay div.ad div.advertisement"
ARTICLES = (
    "article article article.post article.hentry main main>article main.site-main>article.post div.post div.entry div.article div.story div.content div.main-content "
    "section.post div.blog-post div.news-item div.page-content div.main div.node main.content main>div div.post-single div.body-content div"
)
BODIES = "div.entry-content div.post-content div.article-body div.post-body div.body div.text div.story-body div.content div.prose section div div.article__body div.markdown div.copy"
OWN_HEADS = "header header header.entry-header div.post-header div.title-block hgroup header.post-head div.article-header"
METAS = "p.meta div.meta div.byline p.byline div.entry-meta p.date div.date div.author p.author div.post-info p.updated div.article__meta p div.timestamp"
WITHIN = (
    "div.ad div.advert div.ads aside aside.pullout div.share div.social div.share-buttons div.notice div.promo form div.newsletter div.related ul.related div.sponsored "
    "div.ad-inline div.signup form.newsletter nav div.subscribe div.site-notice"
)
COMMENTS = "section.comments div.comments div.comment-list ol.comment-list div.respond ul.comments div.comments-area section.responses div.replies div.reader-comments form.comment-form"
LEAVES = "p p p p p p p p p p h2 h2 h3 h4 ul>li ul>li ol>li blockquote blockquote>p pre table>tr>td table>tr>th figure>figcaption dl>dt dl>dd div div section>p section>h2 div>p"
NEUTRAL = "site page block item single type area title text inner outer left right center col wide first last box list module section group clearfix default component view c l js 1 2 8 12".split()
PHRASES = (
    "Home|About us|Contact|Share this|Subscribe to our newsletter|We use cookies to improve this site|Last updated 3 May 2021|By A. Smith|Posted in News|All rights reserved|"
    "Copyright 2020|Read more|Related posts|Log in|Search|Leave a reply|Advertisement|Tags: one, two|5 comments|Accept|Privacy|Terms|Monday, 12 June|Next page|Most read|Print"
).split("|")

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<code>script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=code)\s*>|\Z)"
    r"|<(?P<raw>template|iframe|noscript)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</(?P=raw)\s*>|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?</svg\s*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<",
    re.S | re.I,
)
_names = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_space = re.compile(r"\s+")


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _element(name: str, words: list[str]) -> tuple[str, ...]:
    """The names of an element: its tag, the words of its class, id and role, and the pieces of compound words."""
    out = [name]
    for word in words:
        for w in re.split("_+", re.sub("([a-z])([A-Z])", r"\1-\2", word).lower()):
            out += [w, *(w.split("-") if "-" in w and w not in MAIN else ())]
    return tuple(x for x in out if x)


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks in page order; text is decoded, its white space single spaces, and never empty."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = _space.sub(" ", unescape("".join(parts))).strip()
        if text:
            out.append(Block(tuple(x for _, names in open_ for x in names), text, linked))
        parts.clear()
        linked = 0

    for m in _token.finditer(html):
        name = m["name"]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":  # comments, raw elements and what is cut off within a tag are no text
                parts.append(piece)
                linked += len(piece) if links else 0
            continue
        name, closing = name.lower(), bool(m["close"])
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        if name not in BLOCK:
            continue
        flush()
        links = 0
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
        else:
            if name in CLOSES_P and open_ and open_[-1][0] == "p" or name in ("li", "option", "td", "th", "tr", "dd", "dt") and open_ and open_[-1][0] == name:
                open_.pop()
            if name not in VOID:
                open_.append((name, _element(name, [w for g in _names.findall(m["rest"] or "") for w in "".join(g).split()])))
    flush()
    return out


def _boilerplate(path: tuple[str, ...]) -> bool:
    """Whether a boilerplate element holds the block; a heading in the header of an article container is the article's own."""
    inside = next((k for k, name in enumerate(path) if name in MAIN), len(path))
    own = {"header"} if HEADINGS & set(path) and "header" not in path[:inside] else set()
    return bool(BOILERPLATE & set(path) - own)


def semantic_labels(page: list[Block]) -> list[int]:
    """1 for blocks in an article container and in no boilerplate element; with no container at all, for all that are in no
    boilerplate element."""
    contained = any(MAIN & set(b.path) for b in page)
    return [int(not _boilerplate(b.path) and (bool(MAIN & set(b.path)) or not contained)) for b in page]


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), DIM), np.float32)
    for k, b in enumerate(page):
        for depth, name in enumerate(b.path):  # two cells for each name, so that a strange word rarely looks like a known one
            code = zlib.crc32(name.encode())
            x[k, code % PATH_DIM] = x[k, (code >> 16) * 31 % PATH_DIM] = 1.0
            if depth == len(b.path) - 1:
                x[k, zlib.crc32(b"leaf " + name.encode()) % PATH_DIM] = 1.0
        words = b.text.split()
        for w in words:
            x[k, PATH_DIM + zlib.crc32(w.lower().encode()) % WORD_DIM] += 1.0
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] /= max(1, len(words))
        x[k, -3:] = np.log1p(len(b.text)) / 6, b.linked / max(1, len(b.text)), k / len(page)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One direction over x (pages, blocks, features); w stacks input, recurrent and bias rows for the four gates."""
    n, length, dim = x.shape
    inputs = x.reshape(-1, dim) @ w[:dim] + w[-1]
    inputs = inputs.reshape(n, length, -1)
    h = c = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((n, length, HIDDEN), np.float32)
    for t in range(length):
        z = inputs[:, t] + h @ w[dim:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, t : t + 1]
        c_new = m * (f * c + i * g) + (1 - m) * c
        tc = np.tanh(c_new)
        h_new = m * (o * tc) + (1 - m) * h
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        h, c = h_new, c_new
        out[:, t] = h
    return out


def _back(x: np.ndarray, mask: np.ndarray, w: np.ndarray, keep: list, d_out: np.ndarray) -> np.ndarray:
    """The gradient of w."""
    n, length, dim = x.shape
    grad = np.zeros_like(w)
    dh = dc = np.zeros((n, HIDDEN), np.float32)
    for t in range(length - 1, -1, -1):
        h, c, i, f, o, g, tc = keep[t]
        m = mask[:, t : t + 1]
        dh = dh + d_out[:, t]
        through = dh * m
        dcn = dc + through * o * (1 - tc**2)
        live = dcn * m
        dz = np.concatenate([live * g * i * (1 - i), live * c * f * (1 - f), through * tc * o * (1 - o), live * i * (1 - g**2)], axis=1)
        grad[:dim] += x[:, t].T @ dz
        grad[dim:-1] += h.T @ dz
        grad[-1] += dz.sum(0)
        dh = dh * (1 - m) + dz @ w[dim:-1].T
        dc = live * f + dcn * (1 - m)
    return grad


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), length, DIM), np.float32), np.zeros((len(pages), length), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1.0
    return x, mask


class Labeller:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        rows = DIM + HIDDEN + 1
        self.w = [rng.normal(0, 0.15, s).astype(np.float32) for s in ((rows, 4 * HIDDEN), (rows, 4 * HIDDEN), (2 * HIDDEN + DIM + 1, 1))]

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        ahead = _run(x, mask, self.w[0], keep and keep[0])
        behind = _run(x[:, ::-1], mask[:, ::-1], self.w[1], keep and keep[1])[:, ::-1]
        seen = np.concatenate([ahead, behind, x, np.ones((*mask.shape, 1), np.float32)], axis=2)
        return (seen @ self.w[2])[..., 0], seen

    def fit(self, pages: list[np.ndarray], labels: list[list[int]], seed: int = 0) -> Labeller:
        rng, drop = random.Random(seed), np.random.default_rng(seed)
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, STEPS + 1):
            own = rng.sample(range(len(pages)), min(BATCH, len(pages)))
            x, mask = _pad([pages[k] for k in own])
            x[..., :PATH_DIM] *= drop.random((len(own), 1, PATH_DIM)) >= DROPPED
            x[..., PATH_DIM : PATH_DIM + WORD_DIM] *= drop.random((*mask.shape, 1)) >= 0.5
            y = np.zeros(mask.shape, np.float32)
            for row, k in enumerate(own):
                y[row, : len(labels[k])] = labels[k]
            keep: tuple[list, list] = ([], [])
            z, seen = self.scores(x, mask, keep)
            dz = ((_sigmoid(z) - y) * mask / mask.sum()).astype(np.float32)[..., None]
            d_seen = dz * self.w[2][:, 0]
            grads = [
                _back(x, mask, self.w[0], keep[0], d_seen[..., :HIDDEN]),
                _back(x[:, ::-1], mask[:, ::-1], self.w[1], keep[1], d_seen[:, ::-1, HIDDEN : 2 * HIDDEN]),
                np.einsum("abc,abd->cd", seen, dz),
            ]
            rate = 0.02 * (1 - step / (STEPS + 1))
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] *= 1 - rate * DECAY
                self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of about one length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:  # up to 64 pages and CELLS blocks with their padding, or one page
            many = next((n for n in range(min(64, len(order)), 1, -1) if n * len(pages[order[n - 1]]) <= CELLS), 1)
            own, order = order[:many], order[many:]
            z, _ = self.scores(*_pad([pages[k] for k in own]))
            for row, k in enumerate(own):
                out[k] = z[row, : len(pages[k])] > 0
        return out


def vary(page: list[Block], rng: random.Random) -> list[Block]:
    """The page with another article container and with boilerplate of other kinds put in, its text from the page itself."""
    container = rng.choice(
        [("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("section", "article-body"), ("div", "story"), ()]
    )
    out = []
    for b in page:
        path = tuple(x for name in b.path for x in (container if name == "article" else (name,)))
        out.append(Block(path, b.text, b.linked))
    noise = [
        ("aside",), ("aside", "p"), ("aside", "sidebar", "ul", "li"), ("div", "sidebar", "p"), ("header", "p"), ("header", "div"), ("form", "p"), ("form", "button"),
        ("form", "div"), ("div", "comments", "p"), ("section", "comments", "div", "comment", "p"), ("div", "comment", "p"), ("div", "cookie", "p"),
        ("div", "notice", "p"), ("div", "advert"), ("div", "ads", "p"), ("div", "ad"), ("footer", "ul", "li"), ("footer", "p"), ("nav", "ol", "li"), ("div", "banner"),
        ("div", "related", "ul", "li"), ("div", "share"), ("div", "newsletter", "form", "p"), ("div", "breadcrumb"), ("div", "menu", "ul", "li"), ("div", "promo", "p"),
    ]
    for _ in range(rng.randint(0, 5)):
        path = rng.choice(noise)
        at = rng.randrange(len(out) + 1)
        inside = rng.random() < 0.5 and any(name in MAIN for name in (out[at - 1].path if at else ()))
        text = rng.choice(page).text
        text = text if rng.random() < 0.5 else text[: rng.randint(5, 60)].strip() or text
        linked = len(text) if rng.random() < 0.3 else 0
        out[at:at] = [Block(("html", "body", *(container if inside else ()), *path), text, linked) for _ in range(rng.choice([1, 1, 2, 4]))]
    if rng.random() < 0.4:  # other leaves that articles have
        leaf = rng.choice([("h2",), ("ul", "li"), ("blockquote",), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("header", "h1"), ("div",), ("section", "p")])
        own = [k for k, label in enumerate(semantic_labels(out)) if label and out[k].path[-1:] == ("p",)]
        for k in rng.sample(own, min(len(own), 3)) if container or leaf[0] != "header" else ():
            out[k] = Block((*out[k].path[:-1], *leaf), out[k].text, 0)
    return out


def _spec(rng: random.Random, specs: str) -> tuple[str, ...]:
    """The path of one of the specs, elements joined by >, classes by dots; some elements get a word that tells nothing."""
    out: list[str] = []
    for element in rng.choice(specs.split()).split(">"):
        tag, *words = element.split(".")
        strange = [rng.choice(NEUTRAL) if rng.random() < 0.5 else "".join(rng.choice("abcdefghiklmnoprstuvwy") for _ in range(rng.randint(2, 9)))] if rng.random() < 0.4 else []
        out += _element(tag, words + strange)
    return tuple(out)


def compose(page: list[Block], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page of a template drawn from the grammar below, its texts from the page given, and the label of each block. Parts
    about the article stand where sites put them: in front of it, within it, behind it and beside it."""
    main = [b.text for b, label in zip(page, semantic_labels(page), strict=True) if label] or [b.text for b in page]
    out: list[Block] = []
    labels: list[int] = []

    def put(path: tuple[str, ...], text: str, label: int, linked: bool = False) -> None:
        out.append(Block(path, text, len(text) if linked else 0))
        labels.append(label)

    def cut(low: int, high: int) -> str:
        text = rng.choice(main)
        return text[: rng.randint(low, high)].strip() or text

    def other(path: tuple[str, ...], leaves: str, most: int, links: float, long: float) -> None:
        """Boilerplate: up to so many blocks under the path, some of them links, some as long as paragraphs."""
        leaf, linked = _spec(rng, leaves) if leaves else (), rng.random() < links
        for _ in range(rng.randint(1, most)):
            text = rng.choice(main) if rng.random() < long else rng.choice(PHRASES) if rng.random() < 0.5 else cut(3, 40)
            put((*path, *leaf), text, 0, linked)

    tables = rng.random() < 0.12
    root = ("html", "body", *(x for _ in range(rng.choice([0, 0, 1, 2])) for x in _spec(rng, WRAPPERS)))
    cell = (*root, "table", "tr") if tables else root
    bare = not tables and rng.random() < 0.12  # nothing but the text, or next to nothing
    likely = lambda p: not bare and rng.random() < p
    if likely(0.25):
        other((*root, *_spec(rng, NOTICES)), "p p button div", 2, 0.1, 0.4)
    if likely(0.7):
        top = (*cell, *(_spec(rng, "td td.header td.top") if tables else _spec(rng, TOPS)))
        other(top, "p div div>a div.logo p.site-title" if rng.random() < 0.5 else "", 2, 0.5, 0.1)
        if rng.random() < 0.5:
            other((*top, *_spec(rng, MENUS)), "ul>li li div", 6, 0.8, 0)
    if likely(0.5):
        other((*cell, *(_spec(rng, "td.menu td.left td.nav td") if tables else _spec(rng, MENUS))), "ul>li li div", 8, 0.9, 0)
    side_first = rng.random() < 0.25
    side = lambda: other((*cell, *(_spec(rng, "td.sidebar td.right td.links") if tables else _spec(rng, SIDES))), "p ul>li div.widget>ul>li section.widget>p h3 h3.widget-title div", 5, 0.5, 0.3)
    if side_first and likely(0.8):
        side()
    holder = _spec(rng, WRAPPERS) if not tables and rng.random() < 0.3 else ()
    article = () if bare and rng.random() < 0.6 else _spec(rng, "td td.content td.text td.main") if tables else _spec(rng, ARTICLES)
    around = (*(cell if not bare else root), *holder, *article)
    body = (*around, *_spec(rng, BODIES)) if rng.random() < 0.6 else around
    if rng.random() < 0.85:
        head = (*around, *_spec(rng, OWN_HEADS)) if article and rng.random() < 0.45 else around if rng.random() < 0.7 else body
        put((*head, *_spec(rng, "h1 h1 h1 h2 h1.title h1.entry-title h1.headline")), cut(12, 70), 1)
        if likely(0.5):
            put((*head, *_spec(rng, METAS)), rng.choice(PHRASES) if rng.random() < 0.6 else cut(5, 40), 0)
    for _ in range(rng.randint(2, 9)):
        if likely(0.12):
            other((*(body if rng.random() < 0.7 else around), *_spec(rng, WITHIN)), rng.choice(["p", "div", "", "ul>li"]), 3, 0.3, 0.3)
        leaf = _spec(rng, LEAVES)
        many = rng.randint(1, 4) if leaf[-1] in ("li", "td", "th", "dt", "dd") else 1
        for _ in range(many):
            put((*body, *leaf), cut(8, 60) if leaf[-1] not in ("p", "div", "blockquote") or rng.random() < 0.1 else rng.choice(main), 1)
    if article and likely(0.3):
        other((*around, *_spec(rng, "footer footer.entry-footer div.post-footer div.tags p.tags div.author-box nav.post-navigation div.share ul.social")), rng.choice(["", "p", "div"]), 2, 0.3, 0.1)
    if likely(0.4):
        where = (around if rng.random() < 0.3 else (*cell, *holder) if not tables else (*root,))
        other((*where, *_spec(rng, COMMENTS)), "p div.comment>p li.comment>p li.comment>div.comment-content>p div.comment-body>p h3 form>p div", 6, 0, 0.7)
    if not side_first and likely(0.5):
        side()
    if likely(0.15):
        other((*root, *_spec(rng, NOTICES)), "p p button div", 2, 0.1, 0.4)
    if likely(0.75):
        other((*cell, *(_spec(rng, "td.footer td.bottom td") if tables else _spec(rng, BOTTOMS))), rng.choice(["", "p", "div", "ul>li", "div.site-info"]), 4, 0.4, 0.15)
    return out, labels


def train(pages: DataFrame) -> Labeller:
    """Fits the labeller on the bounded sample."""
    short = pages.filter(F.length("html").between(1, TRAIN_CHARS)).select("page_id", "html")
    ids = [r[0] for r in short.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES).collect()]  # no texts in the sort
    sample = sorted(short.filter(F.col("page_id").isin(ids)).limit(TRAIN_PAGES).collect(), key=lambda r: (ids.index(r.page_id), r.html)) if ids else []
    rng, own = random.Random(3), []
    for r in sample:
        page = blocks(r.html)
        if page:
            own += [(p, semantic_labels(p)) for p in (page, vary(page, rng))]
            own += [compose(page, rng) for _ in range(COMPOSED)]
    if not own:
        return Labeller()
    return Labeller().fit([features(p) for p, _ in own], [labels for _, labels in own])


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # a fixed number of weights

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 512):
                found = [blocks(h or "") for h in batch.column("html").slice(at, 512).to_pylist()]
                kept = shared.value.label([features(p) for p in found])
                texts += ["\n".join(b.text for b, k in zip(p, ks, strict=True) if k) for p, ks in zip(found, kept, strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
