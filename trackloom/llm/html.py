"""Main text of web pages: a recurrent labeller reads a page's leaf blocks in order and tells content from the rest.

parse() turns a page into its leaf blocks: runs of text between the edges of block elements, each with its tag path
(tags of the open elements and the words of their class, id and role). A numpy bidirectional LSTM reads, for each
block, the sum of hashed tag-path vectors, the mean of hashed-word vectors and three figures of its shape; its states from both ends of
the page decide on every block, so a decision has the whole page as context.

The labeller is trained where it is used, on pages made by a seeded grammar (pages_grammar) whose blocks have known
labels: articles in various dress among menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Nulls: a page that is null, empty or without content has the text "". Unclosed and stray tags are taken as browsers do,
roughly: an open paragraph or list item ends where the next one or its parent ends, and elements end with the page; a head ends
where something begins that it can't hold, and an unclosed svg or math where an element of HTML begins.
Repeated pages give equal rows, and a page's result doesn't depend on other pages. Pages are read whole. An empty table
gives an empty result. Other columns than page_id, url and html aren't read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import text as tx

#: Elements by how HTML treats them.
SKIPPED = ("script", "style", "iframe", "title")  # their text runs to their end tag, or else to the page's end
#: Left out with what is in them where they are closed. Where not, what follows them is read.
ENCLOSED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("template", "svg", "math", "object")}
#: Elements that don't end a head; any other tag, or text, does.
IN_HEAD = frozenset("base basefont bgsound link meta noscript noframes template".split())
NO_SCRIPT = re.compile(r"</noscript\s*>", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr img".split())
#: An open element of a kind ends where one of these begins.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
}
#: Such an end does not reach beyond these.
WALLS = frozenset("ul ol dl table select article section div main aside nav header footer form body".split())
#: A drawing or formula that isn't closed ends where one of these begins.
BREAKOUT = WALLS | ENDED_BY["p"] | frozenset("b big body br center code em embed i img menu s small span strong strike sub sup tt u var caption tbody tfoot thead a button label html head noscript figcaption summary dialog iframe".split())

_SKIP = "|".join(SKIPPED)
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({_SKIP})(?:\s[^>]*)?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")
BLANKS = re.compile(r"\s+")

PATH_BUCKETS, WORD_BUCKETS = 4096, 4096
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 12, 6, 3, 12
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM
#: Blocks in one batch of sequences, padded to the longest page's; one page may have more.
CELLS = 1 << 14


@lru_cache(100_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Words that name an element: its tag, and the words of its class, id and role."""
    out = [tag]
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.append(".hidden")
        elif name in ("class", "id", "role"):
            out += [f".{w}" for w in WORD.findall(value)]
    return tuple(out)


@lru_cache(200_000)
def _bucket(mark: str) -> int:
    value = 7
    for c in mark.encode():
        value = (value * 1_000_003 + c) & 0xFFFFFFFF
    return (value ^ (value >> 15)) % PATH_BUCKETS


@lru_cache(200_000)
def _path(names: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Buckets of a tag path; the innermost element's tag counts apart."""
    marks = {m for name in names for m in name}
    return np.array(sorted({_bucket(m) for m in marks} | ({_bucket(">" + names[-1][0])} if names else set())), np.int64)


@dataclass
class Blocks:
    """Leaf blocks of a page: texts, buckets of their paths, and the share of each text that is in links."""

    texts: list[str] = field(default_factory=list)
    paths: list[np.ndarray] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)


def parse(page: str) -> Blocks:
    out = Blocks()
    tags: list[str] = []  # open block elements
    names: list[tuple[str, ...]] = []
    pieces: list[str] = []
    link = links = 0
    at = 0
    head = foreign = False  # in a head; in a drawing or formula that isn't closed
    unclosed: set[str] = set()  # elements with no end tag further on

    def flush() -> None:
        nonlocal links
        if pieces:
            body = "".join(pieces)
            if "&" in body:
                body = entities.unescape(body)
            body = BLANKS.sub(" ", body).strip()
            if body:
                out.texts.append(body)
                out.paths.append(_path(tuple(names)))
                out.linked.append(min(1.0, links / len(body)))
            pieces.clear()
        links = 0

    while found := MARKUP.search(page, at):
        if found.start() > at and not foreign:
            piece = page[at : found.start()]
            head = head and not piece.strip()
            pieces.append(piece)
            if link:
                links += len(piece)
        at = found.end()
        tag = found[3]
        if tag is None:
            continue
        tag = tag.lower()
        if foreign:
            foreign = tag not in (tags if found[2] else BREAKOUT) and not (found[2] and tag in ("svg", "math"))
            if foreign:
                continue
        if tag == "head":
            head = not found[2] and not out.texts and "".join(pieces).strip() == "" and set(tags) <= {"html"}
            continue
        if head and tag in IN_HEAD and tag not in ENCLOSED:
            if tag == "noscript" and not found[2]:
                end = NO_SCRIPT.search(page, at)
                head, at = end is not None, end.end() if end else at
            continue
        if tag in ENCLOSED and not found[2]:
            end = None if found[4].endswith("/") or tag in unclosed else ENCLOSED[tag].search(page, at)
            if end:
                at = end.end()
            elif not found[4].endswith("/"):
                unclosed.add(tag)
                flush()
                foreign = tag in ("svg", "math")
            continue
        head = head and bool(found[2])
        if tag in INLINE:
            if tag == "a":
                link = not found[2]
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if found[2]:
            if tag in tags:
                keep = len(tags) - 1 - tags[::-1].index(tag)
                del tags[keep:], names[keep:]
        else:
            for k in range(len(tags) - 1, -1, -1):
                if tag in ENDED_BY.get(tags[k], ()):
                    del tags[k:], names[k:]
                    break
                if tags[k] in WALLS:
                    break
            if not found[4].endswith("/"):
                tags.append(tag)
                names.append(_marks(tag, found[4]) if found[4] else (tag,))
    if not foreign:
        pieces.append(page[at:])
    flush()
    return out


@dataclass
class Labeller:
    """Weights of the network; see states() for its equations."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 11) -> Labeller:
        r = np.random.default_rng(seed)
        side = lambda: np.concatenate([r.normal(0, 0.3, (INPUT + HIDDEN, 4 * HIDDEN)), np.zeros((1, 4 * HIDDEN))])
        w = {"path": np.zeros((PATH_BUCKETS, PATH_DIM)), "word": np.zeros((WORD_BUCKETS, WORD_DIM)), "ahead": side(), "back": side()}
        for name in ("ahead", "back"):
            w[name][-1, HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        return cls(w | {"out": r.normal(0, 0.3, 2 * HIDDEN + INPUT + 1)})

    def inputs(self, pages: list[Blocks]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Inputs (pages x blocks x INPUT), a mask, and what learn() needs to go back to the vectors."""
        flat = [(p, t) for p, page in enumerate(pages) for t in range(len(page.texts))]
        rows, steps = (np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 2
        most = int(steps.max()) + 1 if len(steps) else 0
        paths = [x for page in pages for x in page.paths]
        path_size = np.array([len(x) for x in paths], np.int64)
        path_of, path_at = np.repeat(np.arange(len(paths)), path_size), np.concatenate(paths) if paths else np.zeros(0, np.int64)
        texts = [x.encode() for page in pages for x in page.texts]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        start, end, word_of = tx.words(data, offsets)
        word_at = (tx.range_hash(tx.prefix_hash(tx.LOWER[data]), start, end) % np.uint64(WORD_BUCKETS)).astype(np.int64) if len(start) else np.zeros(0, np.int64)
        n_words = np.maximum(np.bincount(word_of, minlength=len(texts)), 1)
        vectors = np.zeros((len(texts), INPUT))
        if len(texts):
            vectors[:, :PATH_DIM] = _sums(self.weights["path"], path_at, path_size)
            vectors[:, PATH_DIM : PATH_DIM + WORD_DIM] = _sums(self.weights["word"], word_at, np.bincount(word_of, minlength=len(texts))) / n_words[:, None]
            vectors[:, -3] = np.log1p(n_words) / 4
            vectors[:, -2] = np.concatenate([page.linked for page in pages])
            vectors[:, -1] = 1
        x, mask = np.zeros((len(pages), most, INPUT)), np.zeros((len(pages), most), bool)
        x[rows, steps], mask[rows, steps] = vectors, True
        return x, mask, (rows, steps, path_of, path_at, word_of, word_at, n_words)

    def states(self, x: np.ndarray, mask: np.ndarray, name: str, keep: list | None = None) -> np.ndarray:
        """Hidden states in one direction. Input, forget, output gates and candidate of a block and the state before it:
        i, f, o = sigmoid(W [x, h]), g = tanh(W [x, h]), c = f c + i g, h = o tanh(c)."""
        weights = self.weights[name]
        order = range(x.shape[1]) if name == "ahead" else range(x.shape[1] - 1, -1, -1)
        fed = x @ weights[:INPUT] + weights[-1]
        inner = weights[INPUT:-1]
        h, c = (np.zeros((len(x), HIDDEN)) for _ in range(2))
        out = np.zeros((*x.shape[:2], HIDDEN))
        for t in order:
            z = fed[:, t] + h @ inner
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            squashed = np.tanh(new)
            on = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, squashed, on))
            h, c = np.where(on, o * squashed, h), np.where(on, new, c)
            out[:, t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.states(x, mask, "ahead"), self.states(x, mask, "back"), x], axis=2)
        return both @ self.weights["out"][:-1] + self.weights["out"][-1]

    def gradients(self, pages: list[Blocks], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy, and its gradients by backpropagation through the pages."""
        x, mask, (rows, steps, path_of, path_at, word_of, word_at, n_words) = self.inputs(pages)
        keep: dict[str, list] = {"ahead": [], "back": []}
        both = np.concatenate([self.states(x, mask, "ahead", keep["ahead"]), self.states(x, mask, "back", keep["back"]), x], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.weights["out"][:-1] + self.weights["out"][-1])))
        wanted = np.zeros(mask.shape)
        wanted[rows, steps] = np.concatenate(labels)
        n = max(1, mask.sum())
        loss = -(np.log(np.where(wanted > 0, p, 1 - p) + 1e-12) * mask).sum() / n
        delta = (p - wanted) * mask / n
        grads = {"out": np.append(np.einsum("pt,ptk->k", delta, both), delta.sum())}
        d_both = delta[..., None] * self.weights["out"][:-1]
        dx = d_both[..., 2 * HIDDEN :].copy()
        for name, d_states in (("ahead", d_both[..., :HIDDEN]), ("back", d_both[..., HIDDEN : 2 * HIDDEN])):
            weights = self.weights[name]
            grad = np.zeros_like(weights)
            dh = dc = np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, squashed, on in reversed(keep[name]):
                dh = dh + d_states[:, t]
                d_new = np.where(on, dc + dh * o * (1 - squashed**2), 0)
                d_own = np.where(on, dh, 0)
                dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_own * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                grad[:INPUT] += x[:, t].T @ dz
                grad[INPUT:-1] += h.T @ dz
                grad[-1] += dz.sum(axis=0)
                dx[:, t] += dz @ weights[:INPUT].T
                dh = np.where(on, 0, dh) + dz @ weights[INPUT:-1].T
                dc = np.where(on, d_new * f, dc)
            grads[name] = grad
        flat = dx[rows, steps]
        grads["path"], grads["word"] = np.zeros_like(self.weights["path"]), np.zeros_like(self.weights["word"])
        np.add.at(grads["path"], path_at, flat[path_of, :PATH_DIM])
        np.add.at(grads["word"], word_at, flat[word_of, PATH_DIM : PATH_DIM + WORD_DIM] / n_words[word_of, None])
        return loss, grads

    def content(self, pages: list[Blocks]) -> list[np.ndarray]:
        """Which blocks of each page are content."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].texts))
        while order:
            longest = max(1, len(pages[order[-1]].texts))
            part, order = order[-max(1, CELLS // longest) :], order[: -max(1, CELLS // longest)]
            x, mask, _ = self.inputs([pages[p] for p in part])
            keep = self.logits(x, mask) > 0
            for row, p in enumerate(part):
                out[p] = keep[row, : len(pages[p].texts)]
        return out


def _sums(table: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of a table; a run of none is 0."""
    out = np.zeros((len(size), table.shape[1]))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(table[at], (np.cumsum(size) - size)[some], axis=0)
    return out


#: What the grammar dresses blocks in. Each is an element with its attributes.
CONTENT_WRAPS = ["<article>", '<article class="post">', "<main>", '<main id="main"><article>', '<div class="content">', '<div id="content"><div class="entry">', '<div class="article-body">', '<section class="story">', '<div class="post-content text">', '<main><div class="main">', '<div role="main">']
OTHER_WRAPS = {
    "menu": ["<nav>", '<nav class="menu">', '<div class="menu">', '<div id="nav">', '<ul class="navigation">', '<div class="breadcrumbs">', '<div role="navigation">', '<div class="topbar">', '<div class="pagination">', '<div class="toc">'],
    "header": ["<header>", '<div id="header">', '<header class="site-header">', '<div class="masthead">', '<div class="logo">', '<div class="banner">', '<div role="banner">'],
    "footer": ["<footer>", '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div class="legal">', '<div role="contentinfo">'],
    "side": ["<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="side">', '<div class="widget">', '<div class="related">', '<div class="recommended">', '<div class="more-links">', '<div class="tags">', '<div class="author-bio">', '<div role="complementary">', '<div class="trending popular">'],
    "notice": ['<div class="cookie-notice">', '<div class="notice">', '<div id="cookie">', '<div class="consent gdpr">', '<div role="alert">', '<div class="alert">', '<div class="popup modal">', '<div class="subscribe">', '<div class="newsletter">', "<noscript>", '<div class="warning">', '<dialog>', '<div class="cookies">', '<div class="paywall">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="advertisement">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div class="banner-ad">', '<ins class="adsbygoogle">', '<section class="ad">'],
    "form": ["<form>", '<form class="search">', '<div class="login"><form>', '<form id="signup">', '<form class="contact">', "<fieldset>", "<label>", "<button>", "<select><option>", "<textarea>"],
    "comments": ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="reader-comments">', '<div id="disqus">', '<section class="comments"><article class="comment">', '<div class="responses">', '<ul class="comments">', '<div class="discussion">', '<div class="replies">'],
    "share": ['<div class="share">', '<div class="social">', '<ul class="social-links">', '<div class="byline meta">', '<div class="post-meta">'],
}
IN_ARTICLE = ("side", "notice", "advert", "form", "comments", "share")
CONTENT_LEAVES = ["p"] * 12 + ["h1", "h2", "h3", "li", "blockquote", "td", "pre", "div", "figcaption", "dd", "section"]
OTHER_LEAVES = ["p"] * 5 + ["li"] * 4 + ["div", "h2", "h3", "h4", "span", "td", "blockquote", "h1"]
IN, OUT = "", ""


def pages_grammar(seed: int, pages: int) -> Iterator[tuple[Blocks, np.ndarray]]:
    """Made pages and the labels of their blocks."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkéüñß"

    def prose() -> str:
        n = r.choice([1, 2, 3, 5, 8, 15, 30, 60])
        return " ".join("".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n)).capitalize() + r.choice([".", ".", "", "!", "&amp;"])

    def closing(opening: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))

    def leaves(mark: str, kinds: list[str], most: int) -> str:
        out = []
        for _ in range(r.randint(1, most)):
            tag = r.choice(kinds)
            body = mark + prose()
            if r.random() < (0.5 if mark == OUT else 0.06):
                body = f'<a href="#">{body}</a>'
            elif r.random() < 0.1:
                body = f"<b>{body}<br>" if r.random() < 0.5 else f"<b>{body}</b>"
            end = "" if tag in ("p", "li") and r.random() < 0.25 else f"</{tag}>"
            out.append(f"<{tag}>{body}{end}" if tag != "li" else f"<ul><li>{body}{end}</ul>")
        return "".join(out)

    def other(kind: str) -> str:
        opening = r.choice(OTHER_WRAPS[kind])
        inside = OUT + prose() if r.random() < 0.35 else leaves(OUT, OTHER_LEAVES if kind not in ("menu",) else ["li"] * 3 + ["p"], 5)
        return opening + inside + closing(opening)

    for _ in range(pages):
        before = [other(k) for k in r.choices(list(OTHER_WRAPS), k=r.randint(0, 3))]
        after = [other(k) for k in r.choices(list(OTHER_WRAPS), k=r.randint(0, 3))]
        if r.random() < 0.6:
            before = [other("menu"), *before]
        if r.random() < 0.6:
            after.append(other("footer"))
        opening = r.choice(CONTENT_WRAPS)
        parts = [leaves(IN, CONTENT_LEAVES, 6) for _ in range(r.randint(1, 4))]
        if r.random() < 0.5:
            head = f"<h1>{IN}{prose()}</h1>"
            parts.insert(0, f"<header>{head}</header>" if r.random() < 0.3 else head)
        for kind in r.choices(IN_ARTICLE, k=r.choice([0, 0, 1, 2])):
            parts.insert(r.randint(1, len(parts)), other(kind))
        cut_off = r.random() < 0.1
        body = "".join(before) + opening + "".join(parts) + ("" if cut_off else closing(opening) + "".join(after))
        if r.random() < 0.25:
            wrap = r.choice(['<div class="wrapper">', '<div id="page">', '<div class="container">', "<div>"])
            body = f"{wrap}{body}</div>"
        made = parse(f"<html><head><title>x</title></head><body>{body}</body></html>")
        labels = np.array([IN in t for t in made.texts], float)
        made.texts = [t.replace(IN, "").replace(OUT, "") for t in made.texts]
        yield made, labels


@lru_cache(1)
def trained(pages: int = 1200, rounds: int = 8, seed: int = 5) -> Labeller:
    """A labeller fitted by Adam on made pages; the same in every process."""
    net, made = Labeller.fresh(), list(pages_grammar(seed, pages))
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    r, step = np.random.default_rng(seed), 0
    for turn in range(rounds):
        order = r.permutation(len(made))
        for k in range(0, len(order), 24):
            part = [made[p] for p in order[k : k + 24]]
            _, grads = net.gradients([p for p, _ in part], [y for _, y in part])
            step += 1
            rate = 0.02 * (1 - turn / (rounds + 1))
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g**2
                net.weights[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return net


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    blocks = [parse(p or "") for p in pages]
    return ["\n".join(t for t, c in zip(b.texts, keep, strict=True) if c) for b, keep in zip(blocks, net.content(blocks), strict=True)]


def _extract(batches: Iterator[pa.RecordBatch], net: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tx.slabs(batch.column(2)):
            body = data.tobytes()
            texts = main_texts([body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], net)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url and text (main text, "" if none) of every page."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(partial(_extract, net=net or trained()), "page_id bigint, url string, text string")
