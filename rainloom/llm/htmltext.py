"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each leaf block has binary features of three sorts: its ancestors' tags; what their classes, ids and roles say (by the
last telling word of each name, so that a "popular-science-article" is an article and an "article-sidebar" a sidebar);
and what needs no names at all: how much of it and of its container are links, how much of the page's text its
container holds, whether the container is one of several of one shape, how long it is and how it ends, whether it
stands outside the article of a page that has one. Neighbouring blocks are tied by transition weights between the two
labels, main text and the rest. The weights are learned from labelled pages, which ``labelled_pages`` lays out at
random, many of them with names that say nothing, by gradient ascent on the exact conditional log-likelihood
(forward-backward). Viterbi decodes a page.

Defined cases: null and empty html give an empty text; a page without text of its own gives an empty text; repeated
rows are extracted each; a page of any length is scanned once, in time and memory linear in it; further columns are
ignored.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .html_blocks import Block, Node, leaf_blocks

#: Labelled pages that are learned from.
PAGES, SEED = 900, 11
#: Tags that are features when they are an ancestor.
TAGS = "article main nav header footer aside form ul ol li table td th blockquote pre figure figcaption section div p h1 h2 h3 h4 h5 h6 dl dd dt address details dialog menu body html fieldset center".split()
#: Words in names of elements that are features, by kind.
MARKS = {
    "ad": "ad ads adv advert adverts banner adsense doubleclick teaser anzeige anzeigen pub publi",
    "notice": "gdpr notice notices alert popup modal overlay signup paywall toast disclaimer hinweis aviso",
    "menu": "nav navigation navbar menu menubar menü navi breadcrumb breadcrumbs crumbs tabs toolbar pager pagination skip toc topbar",
    "header": "header head masthead branding logo kopf kopfzeile cabecera entete",
    "footer": "footer foot copyright colophon legal contentinfo credits imprint impressum fuss fuß fusszeile pie",
    "side": "sidebar side rail widget widgets complementary recommended recommendations more trending popular archive tags tagcloud lateral barra similar similaires verwandt",
    "comment": "reply replies respond discussion readers feedback avis lesermeinungen",
    "share": "share sharing social follow buttons print like tweet teilen partager compartir",
    "form": "form search login signin register contact input suche buscar recherche",
    "content": "content article post entry body story text main prose page artikel beitrag inhalt contenido contenu noticia texte texto",
    "hidden": "hidden invisible sr visually none",
}
#: Beginnings of such words, in the languages of the west.
STEMS = {
    "ad": "advert sponsor promo werbung publicit publicid anuncio",
    "notice": "cookie consent newsletter subscri abonn suscri",
    "side": "related seitenleiste recommend",
    "comment": "comment komment coment review rezension reseñ opinion bewertung disqus diskuss reaction leserbrief",
    "footer": "footer",
    "content": "articul artícul",
}
#: Last words of names that say nothing about what is inside.
PLAIN = frozenset("list box wrap wrapper wrapped container section block area item items inner outer group row col column panel pane unit module region holder wide left right top bottom new old content body text main".split())
#: Elements that hold several blocks of one kind.
CONTAINERS = frozenset("div section article aside main td li form nav header footer body fieldset details dialog figure dd html center menu".split()) | {""}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = tuple(MARKS)


@lru_cache(maxsize=1)
def _kinds() -> dict[str, str]:
    return {w: kind for kind, words in MARKS.items() for w in words.split()}


@lru_cache(maxsize=1 << 16)
def kind_of(word: str) -> str | None:
    found = _kinds().get(word)
    if found:
        return found
    for kind, stems in STEMS.items():
        if word.startswith(tuple(stems.split())):
            return kind
    return None


@lru_cache(maxsize=1 << 16)
def kinds_of(marks: tuple[tuple[str, ...], ...]) -> tuple[str | None, frozenset[str]]:
    """(what the names of an element say it is, all kinds that their words name)."""
    heads: list[str] = []
    words: set[str] = set()
    for name in marks:
        said = [k for k in map(kind_of, name) if k]
        words |= set(said)
        at = len(name)
        while at > 1 and (name[at - 1] in PLAIN or name[at - 1].isdigit()):
            at -= 1
        head = kind_of(name[at - 1]) or (kind_of(name[-1]) if not said[:-1] else None)
        if head:
            heads.append(head)
    head = next((h for h in heads if h != "content"), heads[0] if heads else None)
    return head, frozenset(words)


@lru_cache(maxsize=1)
def _names() -> dict[str, int]:
    names = ["bias", *(f"in {t}" for t in TAGS), *(f"leaf {t}" for t in TAGS)]
    names += [f"{how} {k}" for how in ("near", "named", "word", "headed") for k in KINDS]
    names += [f"{a} & {b}" for a in ("named content", "in article", "in main") for b in ("near comment", "near ad", "near side", "near share", "near notice", "in nav", "in form", "in aside", "in footer", "in header")]
    names += ["links all", "links most", "links some", "words 1", "words 2-4", "words 5-14", "words 15+", "ends sentence", "copyright", "no letters"]
    names += [f"container {x}" for x in ("links", "words 8", "words 30", "words 100", "words more", "holds half", "holds most", "repeated", "repeated outside")]
    names += ["outside article", "no region", "outside & small", "alone"]
    return {n: i for i, n in enumerate(dict.fromkeys(names))}


class Context:
    """What a block has from its ancestors: features, the nearest container and the nearest telling name."""

    __slots__ = ("container", "features", "near", "regions")

    def __init__(self, node: Node, above: Context | None):
        head, words = kinds_of(node.marks)
        self.near = head or (above.near if above else None)
        self.container = node if node.name in CONTAINERS or above is None else above.container
        regions = above.regions if above else frozenset()
        own = {f"in {node.name}", *(f"word {k}" for k in words)} | ({f"named {head}"} if head else set())
        self.regions = regions if own <= regions else _joined(regions, frozenset(own))
        self.features = _context_features(self.regions, node.name, self.near)


@lru_cache(maxsize=1 << 14)
def _joined(regions: frozenset[str], own: frozenset[str]) -> frozenset[str]:
    return regions | own


@lru_cache(maxsize=1 << 14)
def _context_features(regions: frozenset[str], leaf: str, near: str | None) -> tuple[int, ...]:
    names = _names()
    on = {"bias", f"leaf {leaf}"} | regions
    if near:
        on.add(f"near {near}")
    on |= {f"{a} & {b}" for a in ("named content", "in article", "in main") if a in on for b in on if f"{a} & {b}" in names}
    if not on & {"in article", "in main", "in nav", "in aside"} and not any(f"named {k}" in on for k in KINDS):
        on.add("no region")
    return tuple(sorted(names[n] for n in on if n in names))


def context_of(node: Node) -> Context:
    way = []
    while node is not None and node.context is None:
        way.append(node)
        node = node.parent
    above = node.context if node is not None else None
    for step in reversed(way):
        above = step.context = Context(step, above)
    return above


def block_features(blocks: list[Block]) -> list[tuple[int, ...]]:
    """The features that each block has, as numbers."""
    names = _names()
    held: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])  # of a container: words, characters, characters of links
    contexts, words = [], []
    for b in blocks:
        c = context_of(b.node)
        contexts.append(c)
        words.append(b.text.count(" ") + 1)
        of = held[id(c.container)]
        of[0] += words[-1]
        of[1] += len(b.text)
        of[2] += min(b.link_chars, len(b.text))
    total = sum(words)
    has_article = any("in article" in c.regions or "in main" in c.regions for c in contexts)
    out: list[tuple[int, ...]] = []
    headed: str | None = None
    headed_depth = headed_level = 0
    for b, c, n in zip(blocks, contexts, words, strict=True):
        on: list[str] = []
        share = b.link_chars / len(b.text)
        if share > 0.1:
            on.append("links all" if share > 0.9 else "links most" if share > 0.4 else "links some")
        on.append("words 1" if n < 2 else "words 2-4" if n < 5 else "words 5-14" if n < 15 else "words 15+")
        if b.text[-1] in ".!?…。":
            on.append("ends sentence")
        if "©" in b.text or "(c)" in b.text[:40].lower():
            on.append("copyright")
        if not any(x.isalpha() for x in b.text[:200]):
            on.append("no letters")
        of = held[id(c.container)]
        if of[2] > 0.5 * of[1]:
            on.append("container links")
        on.append(f"container words {next(x for limit, x in ((8, '8'), (30, '30'), (100, '100'), (10**18, 'more')) if of[0] <= limit)}")
        if 2 * of[0] >= total:
            on.append("container holds half")
        if 5 * of[0] >= 4 * total:
            on.append("container holds most")
        inside = "in article" in c.regions or "in main" in c.regions
        box = c.container
        if box.parent is not None and box.name not in ("li", "td", "dd") and box.parent.shapes[box.name, box.marks] > 1:
            on.append("container repeated" if inside else "container repeated outside")
        if has_article and not inside:
            on.append("outside article")
        if not has_article and 4 * of[0] < total:
            on.append("outside & small")
        if len(blocks) == 1:
            on.append("alone")
        # A heading speaks for what follows it in its container, up to the next heading of its level.
        if b.node.name in HEADINGS:
            if headed is None or int(b.node.name[1]) <= headed_level:
                said = [k for k in map(kind_of, b.text.lower().replace(":", " ").split()[:4]) if k in ("comment", "side", "share", "notice")]
                headed, headed_depth, headed_level = (said[0] if said else None), b.node.depth, int(b.node.name[1])
        elif headed and b.node.depth < headed_depth:
            headed = None
        if headed:
            on.append(f"headed {headed}")
        out.append(c.features + tuple(names[x] for x in on))
    return out


# ---- labelled pages ----


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("ka", "lo", "ne", "ri", "tu", "mo", "sé", "va", "dö", "pi", "ra", "shi", "ent", "or", "is")) for _ in range(rng.randint(1, 4)))


def _sentence(rng: random.Random, low: int, high: int) -> str:
    text = " ".join(_word(rng) for _ in range(rng.randint(low, high))).capitalize()
    if rng.random() < 0.1:
        text = " ".join(w + rng.choice(("#", "*", "%", "!", " -", " /")) for w in text.split())
    return text + rng.choice((".", ".", ".", "", "!", "?"))


class _Page:
    """A page that is laid out at random: html, and a label for each leaf block."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.html: list[str] = []
        self.labels: list[int] = []
        #: Whether names of elements say what they are.
        self.telling = rng.random() < 0.65

    def add(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        self.html.append(f"<{tag}{attributes}>{text}</{tag}>")
        self.labels.append(label)

    def name(self, kind: str | None) -> str:
        rng = self.rng
        if kind is None or rng.random() < 0.1:
            return ""
        if not self.telling:
            return f' class="{_word(rng)}{rng.choice(("", "-box", "-" + _word(rng)))}"' if rng.random() < 0.7 else ""
        stems = [s + rng.choice(("", "s", "en")) for s in STEMS.get(kind, "").split()]
        word = rng.choice(MARKS[kind].split() + stems)
        word = rng.choice((word, word, f"{word}-{rng.choice(sorted(PLAIN))}", f"{_word(rng)}-{word}", f"{rng.choice(('article', 'popular', 'post', 'site', 'page', 'main'))}-{word}", f"{word} {_word(rng)}", f"{word}-1"))
        return f' {rng.choice(("class", "class", "id", "role"))}="{word}"'

    def boxed(self, tag: str, kind: str | None, inside) -> None:
        self.html.append(f"<{tag}{self.name(kind)}>")
        inside()
        self.html.append(f"</{tag}>")

    def links(self) -> None:
        rng = self.rng
        listed = rng.random() < 0.7
        self.html.append("<ul>" if listed else "")
        for _ in range(rng.randint(2, 8)):
            self.add("li" if listed else "div", f'<a href="/{_word(rng)}">{_sentence(rng, 1, 5).rstrip(".")}</a>', 0)
        self.html.append("</ul>" if listed else "")

    def small(self) -> None:
        for _ in range(self.rng.randint(1, 3)):
            self.add(self.rng.choice(("p", "div", "p")), _sentence(self.rng, 1, 14), 0)

    def bare(self) -> None:
        self.html.append(_sentence(self.rng, 2, 16))
        self.labels.append(0)

    def comments(self) -> None:
        """A list of comments: several of one shape, often with a name and a date."""
        rng = self.rng
        if rng.random() < 0.4:
            self.add(rng.choice(("h2", "h3", "h4")), rng.choice(("Comments", "Kommentare", "Reviews", "Commentaires", "Comentarios", "3 comments", _sentence(rng, 1, 3))), 0)
        count = rng.randint(1, 5) if self.telling else rng.randint(2, 6)
        tag, inner, name, signed = rng.choice(("div", "li", "article", "section", "p")), rng.choice(("p", "div")), self.name("comment") if rng.random() < 0.5 else "", rng.random() < 0.5
        for _ in range(count):
            if tag == "p":
                self.add("p", _sentence(rng, 2, 25), 0, name)
                continue
            self.html.append(f"<{tag}{name}>")
            if signed:
                self.add(rng.choice(("div", "p", "h4")), rng.choice((_sentence(rng, 1, 2), f"{_word(rng)}, {rng.randint(1, 28)}. {rng.randint(1, 12)}. 2021")), 0)
            for _ in range(rng.randint(1, 2)):
                self.add(inner, " ".join(_sentence(rng, 2, 14) for _ in range(rng.randint(1, 3))), 0)
            self.html.append(f"</{tag}>")

    def rest(self) -> None:
        rng = self.rng
        kind = rng.choice(("ad", "ad", "notice", "side", "share", "comment", "comment", "form", "menu"))
        if kind == "comment":
            self.boxed(rng.choice(("section", "div", "aside", "ol", "div")), kind, self.comments)
        elif kind == "form":
            self.boxed("form", rng.choice(("form", None)), lambda: (self.small(), self.html.append("<input type='text'><button>x</button>")))
        elif kind == "menu":
            self.boxed(rng.choice(("nav", "div", "ul")), kind, self.links)
        elif kind in ("side", "share"):
            self.boxed(rng.choice(("aside", "div", "section")), kind, rng.choice((self.links, self.small)) if self.telling else self.links)
        elif self.telling:
            self.boxed("div", kind, rng.choice((self.small, self.bare)))
        else:
            self.boxed("aside", kind, self.small)

    def paragraphs(self, count: int) -> None:
        rng = self.rng
        wrapped, brief = rng.random() < 0.15, rng.random() < 0.3
        for _ in range(count):
            r = rng.random()
            if r < 0.72:
                text = " ".join(_sentence(rng, 2, 9 if brief else 20) for _ in range(rng.randint(1, 2 if brief else 5)))
                if rng.random() < 0.2:
                    text = f"<b>{text}</b>" if rng.random() < 0.5 else text.replace(" ", f' <a href="#">{_word(rng)}</a> ', 1)
                if wrapped:
                    self.html.append(f'<div class="{_word(rng)}">')
                self.add("p" if rng.random() < 0.93 else "div", text, 1)
                if wrapped:
                    self.html.append("</div>")
            elif r < 0.8:
                self.add(rng.choice(("h2", "h3", "h4")), _sentence(rng, 1, 8), 1)
            elif r < 0.87:
                self.add(rng.choice(("blockquote", "pre", "figcaption", "pre")), _sentence(rng, 3, 25), 1)
            elif r < 0.93:
                self.html.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    self.add("li", _sentence(rng, 1, 15), 1)
                self.html.append("</ul>")
            elif r < 0.95:
                self.html.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    self.add("td", _sentence(rng, 1, 4), 1)
                self.html.append("</tr></table>")
            else:
                self.rest()

    def lay_out(self) -> tuple[str, list[int]]:
        rng, html_ = self.rng, self.html
        if rng.random() < 0.03:  # a page of links alone
            self.boxed(rng.choice(("nav", "div")), "menu", self.links)
            return "".join(html_), self.labels
        bare = rng.random() < 0.35  # nothing around the article
        if bare and rng.random() < 0.15:  # nor any article element
            self.paragraphs(rng.choice((1, 1, 2, 4)))
            return "".join(html_), self.labels
        html_.append("<html><head><title>x</title><style>p{}</style></head><body>" if rng.random() < 0.8 else "")
        wraps = rng.choice((0, 0, 1, 2))
        html_ += [f'<div{rng.choice(("", " class=" + _word(rng), " id=page", " class=wrapper"))}>' for _ in range(wraps)]
        if not bare:
            if rng.random() < 0.5:
                self.boxed("header", rng.choice(("header", None)), lambda: (self.add(rng.choice(("div", "p", "h1", "h2")), _sentence(rng, 1, 6), 0), self.links() if rng.random() < 0.5 else None))
            if rng.random() < 0.75:
                self.boxed(rng.choice(("nav", "nav", "div")), "menu", self.links)
            for _ in range(rng.randint(0, 3)):
                self.rest()
        open_, close = rng.choice((("<article", "article"), ("<article", "article"), ("<main", "main"), ("<main><article", "article></main"), ("<div", "div"), ("<div", "div")))
        html_.append(open_ + (self.name("content") if open_ == "<div" or rng.random() < 0.3 else "") + ">")
        count = rng.choice((1, 1, 1, 2)) if rng.random() < (0.6 if bare else 0.25) else rng.randint(2, 10)
        titled = rng.random() < (0.4 if count == 1 else 0.75)
        if titled:
            title = lambda: self.add("h1", _sentence(rng, 1, 10), 1)
            if rng.random() < 0.1:
                html_.append("<header>")
                title()
                html_.append("</header>")
            else:
                title()
        if count == 1:
            if titled and rng.random() < 0.8 or not titled:
                self.add(rng.choice(("p", "p", "pre", "div", "blockquote")), " ".join(_sentence(rng, 3, 20) for _ in range(rng.randint(1, 3))), 1)
        else:
            self.paragraphs(count)
        if rng.random() < 0.3:
            self.boxed(rng.choice(("div", "section")), "comment", self.comments)
        html_.append(f"</{close}>")
        if not bare:
            for _ in range(rng.randint(0, 3)):
                self.rest()
            if rng.random() < 0.8:
                mine = lambda: (html_.append("&copy; " + _sentence(rng, 2, 12)), self.labels.append(0))
                if self.telling and rng.random() < 0.3:
                    self.boxed("div", "footer", rng.choice((self.small, self.bare, mine)))
                else:
                    self.boxed("footer", rng.choice(("footer", None)), rng.choice((self.small, mine)))
        html_ += ["</div>"] * wraps
        return "".join(html_), self.labels


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """(html, label of each leaf block) of n pages: 1 for main text."""
    rng = random.Random(seed)
    return [_Page(rng).lay_out() for _ in range(n)]


# ---- the chain ----


class Chain:
    """Weights of a two-label chain: emission (features x 2), transition (2 x 2)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def scores(self, x: list[tuple[int, ...]]) -> np.ndarray:
        """(blocks, 2): the sum of the weights of each block's features."""
        starts = np.cumsum([0, *(len(f) for f in x[:-1])])
        return np.add.reduceat(self.emission[np.concatenate(x)], starts, axis=0)

    def decode(self, x: list[tuple[int, ...]]) -> np.ndarray:
        """Viterbi: the best label of each block."""
        if not len(x):
            return np.zeros(0, np.int64)
        scores = self.scores(x).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b = scores[0]
        back: list[tuple[int, int]] = []
        for s0, s1 in scores[1:]:
            from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
            a, b = s0 + (b + t10 if from0 else a + t00), s1 + (b + t11 if from1 else a + t01)
            back.append((from0, from1))
        label = 1 if b > a else 0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1])


def train(pages: list[tuple[str, list[int]]], steps: int = 130, ridge: float = 1e-4) -> Chain:
    """Maximises the conditional log-likelihood by Adam on full batches; pages are padded and run through
    forward-backward together."""
    data = []
    for page, labels in pages:
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("labels do not match the blocks of a page")
        if blocks:
            data.append((block_features(blocks), np.array(labels)))
    n, width, longest = len(data), len(_names()), max(len(y) for _, y in data)
    # The features of all blocks one after the other, and the block (of all padded ones) that each belongs to.
    flat = np.concatenate([np.array(f) for page, _ in data for f in page])
    block = np.concatenate([np.full(len(f), k * longest + t) for k, (page, _) in enumerate(data) for t, f in enumerate(page)])
    y, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (_, label) in enumerate(data):
        y[k, : len(label)], real[k, : len(label)] = label, True

    def summed(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, c], size) for c in range(2)], axis=1)

    emission, transition = np.zeros((width, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(emission), np.zeros_like(emission), np.zeros_like(transition), np.zeros_like(transition)]
    total, rows = real.sum(), np.arange(n)
    gold = np.eye(2)[y] * real[..., None]
    pair_gold = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        s = summed(emission[flat], block, n * longest).reshape(n, longest, 2)
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, longest):
            moved = lse(forward[:, t - 1, :, None] + transition, 1) + s[:, t]
            forward[:, t] = np.where(real[:, t, None], moved, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = lse(transition + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], moved, 0)
        z = lse(forward[rows, -1], 1)
        one = np.exp(forward + backward - z[:, None, None]) * real[..., None]
        pair = np.exp(forward[:, :-1, :, None] + transition + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        grads = (summed((gold - one).reshape(-1, 2)[block], flat, width) / total - ridge * emission, (pair_gold - pair.sum(axis=(0, 1))) / total - ridge * transition)
        for k, (w, g) in enumerate(zip((emission, transition), grads, strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(emission, transition)


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The chain learned from the default labelled pages, once per process."""
    return train(labelled_pages())


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    keep = chain.decode(block_features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), held.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
