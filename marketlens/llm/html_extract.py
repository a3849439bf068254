"""HTML extraction (operator 2): a linear-chain conditional random field over DOM leaf blocks.

A page is read tag by tag into leaf blocks: runs of text between block-level tags, each with its open ancestors. The
features of a block are its ancestors' tags, the words of their class, id and role attributes that name page parts,
words of its text that such parts say (SAYS), measures of its text (length, share of linked text, closing punctuation),
whether its neighbours are sentences, and whether it stands in the core: the deepest element with CORE_PERCENT of the
page's sentence words (with it, whether the block is a sentence and the page names its main part). A chain of two labels, main text or not, is fitted to labelled pages by the gradient of its
log-likelihood (forward-backward sums) and decoded by Viterbi. The blocks labelled main text are the result, in page
order.

The labelled pages are generated: layouts of article pages with menus, headers, sidebars, notices, adverts, forms,
footers and comments in many spellings, a third of them without any telling name or tag, whose blocks are known. `fit`
takes any other (html, main blocks) pairs.

Reading is linear in the page: where a quote or a tag is never closed, tags end at the next > from there on, and what
follows the last > is text. No depth or length is capped.

Defined results: a null or empty page, or one without text, has an empty text and 0 characters; unclosed comments and
scripts run to the page's end; pictures (svg), titles, frames and choices are markup; a null url stays null; repeated
rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import importable, slices

DROPPED = ("script", "style", "title", "textarea", "template", "iframe", "svg", "select")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mtable mtr mtd semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag of the same set closes, up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CONTAINERS = frozenset("article aside body div dl footer form header html main nav ol section table ul blockquote figure details fieldset".split())
_SKIP = r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(DROPPED) + r")\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
_NAME = r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)"
#: Tags whose quoted values may hold >; `broken` is where no tag ends.
STRICT = re.compile(_SKIP + "|" + _NAME + r"(?P<attrs>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?][^>]*+>|(?P<broken><(?=[a-zA-Z/!?]))|(?P<text>[^<]++|<)", re.S | re.I)
#: Tags up to the next >, which is always there, as the page is cut behind its last one.
LOOSE = re.compile(_SKIP + "|" + _NAME + r"(?P<attrs>[^>]*+)>|<[/!?][^>]*+>|(?P<text>[^<]++|<)", re.S | re.I)
REST = re.compile(r"(?P<text>.+)|(?P<tag>\Z)(?P<end>\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of attributes by the page part that they name.
PARTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs pager pagination skip",
    "header": "header masthead banner branding logo top hero",
    "footer": "footer foot bottom colophon copyright legal imprint",
    "side": "sidebar side aside rail secondary widget widgets complementary related recommended recommendations trending popular more latest toc",
    "notice": "notice cookie cookies consent gdpr alert warning banner popup modal overlay dialog disclaimer message toast subscribe newsletter paywall signup",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense adslot commercial outbrain taboola",
    "form": "form search login register contact input signin feedback",
    "comment": "comment comments reply replies respond discussion disqus responses reviews thread",
    "share": "share sharing social follow tools tags tag meta byline author print buttons rating",
    "main": "article content entry post story body text main page prose markdown",
}
PART_OF = {w: p for p, ws in PARTS.items() for w in ws.split()}
PART_TAGS = frozenset("nav header footer aside form article main section ul ol li table p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dl button address details div td body noscript object".split())
#: Words that the text of a page part says.
SAYS = {
    "menu": "home about contact products services menu startseite kontakt accueil inicio contacto",
    "footer": "copyright rights reserved privacy terms imprint impressum datenschutz agb mentions légales aviso legal",
    "side": "related popular trending recommended latest recent archive categories tags newest",
    "notice": "cookie cookies consent accept javascript enable browser subscribe newsletter datenschutzerklärung abonnez suscríbete",
    "advert": "advertisement sponsored ad promo sale buy offer discount anzeige werbung publicité publicidad",
    "form": "login password email search submit username register anmelden suche rechercher buscar",
    "comment": "reply comments comment says ago posted antworten kommentare répondre commentaires responder comentarios",
    "share": "share tweet facebook twitter print author updated published teilen partager compartir",
}
SAYS_OF = {w: p for p, ws in SAYS.items() for w in ws.split()}
LETTERS = re.compile(r"[^\W\d_]+")
#: Words of a block up to which what it says is a feature; a sentence has so many words at least.
SHORT, SENTENCE = 25, 8
#: The core holds so many percent of a page's sentence words; a page with fewer than CORE_WORDS of them shows none.
CORE_PERCENT, CORE_WORDS = 60, 50
#: Elements that hold one block only, as a rule.
#: Features of pages that name their parts.
HEADS = frozenset(("in:h1", "in:h2"))
TELLING = frozenset(("in:article", "in:main", "part:main"))
LEAVES = frozenset("p li td th dt dd h1 h2 h3 h4 h5 h6 pre figcaption tr".split())


def matches(html: str):
    """The tokens of a page, as matches with the groups text, tag, end and attrs."""
    for m in STRICT.finditer(html):
        if m["broken"] is None:
            yield m
            continue
        at, last = m.start(), html.rfind(">") + 1
        if last > at:
            yield from LOOSE.finditer(html, at, last)
        yield REST.match(html, max(at, last))
        return


def blocks_of(html: str | None) -> list[tuple[str, frozenset[str]]]:
    """(text, features) of each leaf block that has text."""
    found: list[tuple[str, frozenset[str], set[str], int, bool]] = []  # text, features of its ancestors and of itself, its element, whether it is a sentence
    parents, tags = [-1], ["body"]  # of each element, in page order; 0 stands for the page
    mass = [0]  # sentence words in an element itself
    stack: list[tuple[str, frozenset[str], int, int]] = []  # open tags, each with the features of all tags up to it, the place of its nearest container, and its element
    places: dict[str, list[int]] = {}  # of each open tag in the stack, so that no depth has to be searched
    none: frozenset[str] = frozenset()
    parts: list[str] = []
    linked, in_link, owner, element = 0, 0, none, 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                own, n, sentence = _text_features(text, linked)
                found.append((text, owner, own, element, sentence))
                if sentence:
                    mass[element] += n
        linked = 0

    def close(at: int):
        for tag, *_ in stack[at:]:
            places[tag].pop()
        del stack[at:]

    for m in matches(html or ""):
        text = m["text"]
        if text is not None:
            if not parts:
                owner, element = (stack[-1][1], stack[-1][3]) if stack else (none, 0)
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            elif tag in ("br", "wbr", "img") and parts:
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if m["end"]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        closes = CLOSES.get(tag)
        if closes or (tag in CONTAINERS or tag[0] == "h") and stack and stack[-1][0] == "p":
            last = max((places[t][-1] for t in closes or ("p",) if places.get(t)), default=-1)
            if last > (stack[-1][2] if stack else -1):
                close(last)
        if tag not in VOID:
            above, container, parent = stack[-1][1:] if stack else (none, -1, 0)
            own = _tag_features(tag, m["attrs"] if "=" in m["attrs"] else "")
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, above if own <= above else above | own, len(stack) if tag in CONTAINERS else container, len(parents)))
            parents.append(parent)
            tags.append(tag)
            mass.append(0)
    flush()
    first, last = _core(parents, tags, mass)
    if all(first <= element <= last for _, _, _, element, _ in found):
        first = 0  # nothing stands outside
    telling = any(TELLING & owner for owner in {owner for _, owner, *_ in found})
    out = []
    for i, (text, owner, own, element, sentence) in enumerate(found):
        place = ("core" if first <= element <= last else "outside") if first else "page"
        own.update((place, f"{place}:sentence" if sentence else f"{place}:short"))
        if not telling:
            own.add(f"plain:{place}:sentence" if sentence else f"plain:{place}:short")
        if i and found[i - 1][4]:
            own.add("after:sentence")
        if i + 1 < len(found) and found[i + 1][4]:
            own.add("before:sentence")
        if not i:
            own.add("first")
        if i + 1 == len(found):
            own.add("last")
        if "in:header" in owner and "in:article" in owner:
            own.add("header:h" if owner & HEADS else "header:article")
        out.append((text, owner | own))
    return out


def _core(parents: list[int], tags: list[str], mass: list[int]) -> tuple[int, int]:
    """The first and last element of the core, 0 if that is the whole page."""
    last = list(range(len(parents)))
    for e in range(len(parents) - 1, 0, -1):  # children come behind their parents
        mass[parents[e]] += mass[e]
        last[parents[e]] = max(last[parents[e]], last[e])
    core = max((e for e in range(len(parents)) if 100 * mass[e] >= CORE_PERCENT * mass[0]), default=0) if mass[0] >= CORE_WORDS else 0
    while core and tags[core] in LEAVES:
        core = parents[core]
    return core, last[core]


def _tag_features(tag: str, attrs: str) -> frozenset[str]:
    return _short_tag_features(tag, attrs) if len(attrs) <= 500 else _features_of(tag, attrs)  # long ones are not kept


@lru_cache(20_000)
def _short_tag_features(tag: str, attrs: str) -> frozenset[str]:
    return _features_of(tag, attrs)


def _features_of(tag: str, attrs: str) -> frozenset[str]:
    got = {f"in:{tag}"} if tag in PART_TAGS else set()
    for value in ATTRIBUTE.findall(attrs):
        for w in WORD.findall("".join(value)):
            part = PART_OF.get(w.lower())
            if part:
                got.add(f"part:{part}")
    return frozenset(got)


def _text_features(text: str, linked: int) -> tuple[set[str], int, bool]:
    """A block's own features, its number of words, and whether it is a sentence that is not linked."""
    n = text.count(" ") + 1
    got = {f"words:{min(n.bit_length(), 7)}"}
    share = linked / max(len(text), 1)
    got.add("links:all" if share > 0.7 else "links:some" if share > 0.25 else "links:few")
    ends = text[-1] in ".!?…\"'»”。"
    if ends:
        got.add("ends")
    if "©" in text or "℗" in text or "®" in text:
        got.add("mark")
    if n <= SHORT:
        said = [SAYS_OF[w] for w in map(str.lower, LETTERS.findall(text)) if w in SAYS_OF]
        got.update(f"says:{p}" for p in said)
        if len(said) * 4 >= n:
            got.add("says")
    return got, n, ends and n >= SENTENCE and share <= 0.25


class Chain:
    """Two labels: 0 other, 1 main text. weights: (features, 2); step: (2, 2) from label to label; start: (2,)."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights = np.zeros((len(names) + 1, 2))  # the last row: every block
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)
        self._by_features: dict[frozenset[str], tuple[float, float]] = {}

    def emission(self, features: frozenset[str]) -> tuple[float, float]:
        got = self._by_features.get(features)
        if got is None:
            rows = [self.index[f] for f in features if f in self.index]
            got = tuple((self.weights[rows].sum(axis=0) + self.weights[-1]).tolist())
            if len(self._by_features) > 50_000:
                self._by_features.clear()
            self._by_features[features] = got
        return got

    def decode(self, features: list[frozenset[str]]) -> list[int]:
        """The best labels, by Viterbi; ties to main text."""
        if not features:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        e0, e1 = self.emission(features[0])
        a, b = self.start[0] + e0, self.start[1] + e1
        back = []
        for f in features[1:]:
            e0, e1 = self.emission(f)
            to0, to1 = b + s10 >= a + s00, b + s11 >= a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        label = int(b >= a)
        out = [label]
        for to0, to1 in reversed(back):
            label = int(to1 if label else to0)
            out.append(label)
        return out[::-1]


def likelihood(x: np.ndarray, y: np.ndarray, live: np.ndarray, weights: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The log-likelihood of labelled chains and its gradient by weights, step and start: x (chains, blocks, features),
    y (chains, blocks) labels, live (chains, blocks) whether a chain has the block."""
    n, longest, _ = x.shape
    flat = x.reshape(n * longest, -1)
    gold = np.eye(2)[y] * live[..., None]
    pairs = live[:, 1:]
    emission = (flat @ weights).reshape(n, longest, 2)
    alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    alpha[:, 0] = start + emission[:, 0]
    for t in range(1, longest):
        new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + emission[:, t]
        alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = np.logaddexp.reduce(step + (emission[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(live[:, t + 1, None], new, 0)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + step + (emission[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[..., None, None]
    gold_step = np.einsum("ntk,ntl->kl", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    value = float((gold * emission).sum() + (gold_step * step).sum() + (gold[:, 0] * start).sum() - z.sum())
    return value, [flat.T @ (gold - p).reshape(-1, 2), gold_step - pair.sum(axis=(0, 1)), (gold - p)[:, 0].sum(axis=0)]


def fit(pages: Iterable[tuple[str, set[str]]], rounds: int = 120, rate: float = 0.5, penalty: float = 1e-3) -> Chain:
    """A chain fitted to (html, texts of its main blocks) by AdaGrad on the mean log-likelihood per block."""
    data = [(b, [int(t in main) for t, _ in b]) for html, main in pages if (b := blocks_of(html))]
    names = sorted({f for b, _ in data for _, fs in b for f in fs})
    chain = Chain(names)
    n, longest = len(data), max(len(b) for b, _ in data)
    x = np.zeros((n, longest, len(names) + 1), np.float32)
    y, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (b, labels) in enumerate(data):
        live[i, : len(b)], y[i, : len(b)] = True, labels
        for t, (_, fs) in enumerate(b):
            x[i, t, [chain.index[f] for f in fs]] = 1
        x[i, : len(b), -1] = 1
    total = live.sum()
    params = [chain.weights, chain.step, chain.start]
    squares = [np.full_like(p, 1e-6) for p in params]
    for _ in range(rounds):
        _, grads = likelihood(x, y, live, *params)
        for w, g, s in zip(params, grads, squares, strict=True):
            g = g / total - penalty * w / 10
            s += g * g
            w += rate * g / np.sqrt(s)
    chain._by_features.clear()
    return chain


def labelled_pages(n: int = 320, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Generated (html, main blocks) pairs in many layouts; each block's text is unique to it."""
    r = random.Random(seed)
    serial = iter(range(10**9))

    nameless = False

    def words(low: int, high: int, part: str = "") -> str:
        w = ["".join(r.choice(("ra", "ten", "lo", "mi", "sur", "ak", "en", "ver", "o", "ist", "qua", "de")) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
        if part in SAYS and r.random() < 0.5 or not part and r.random() < 0.04:  # articles say such words too
            for _ in range(r.randint(1, 2)):
                w.insert(r.randint(1, len(w)), r.choice(SAYS[part or r.choice(list(SAYS))].split()))
        return " ".join([f"{w[0].capitalize()}{next(serial)}", *w[1:]])

    def sentence(low: int, high: int, part: str = "") -> str:
        return words(low, high, part) + r.choice((".", ".", ".", "!", "?"))

    def attr(part: str) -> str:
        if nameless:
            return r.choice(("", f' class="c{r.randint(1, 99)}"'))
        names = PARTS[part].split()
        name = r.choice(names) + r.choice(("", "-box", "_wrap", "-1", "-inner", "List"))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("", "x9 ", "col-4 ", "js-"))}{name}"'

    def link(low: int, high: int, part: str = "menu") -> str:
        return f'<a href="/{next(serial)}">{words(low, high, part)}</a>'

    def links(k: int, part: str = "menu") -> str:
        tag, item = r.choice((("div", "div"), ("ul", "li"), ("div", "p"))) if nameless else ("ul", "li")
        return f"<{tag}>" + "".join(f"<{item}>{link(1, 3, part)}</{item}>" for _ in range(k)) + f"</{tag}>"

    def other(part: str, tag: str | None = None) -> str:
        """A part that is not main text."""
        tag = tag or ("div" if nameless else r.choice({"menu": ("nav", "nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "div", "section"), "notice": ("div", "section", "aside", "noscript")}.get(part, ("div", "div", "section", "aside"))))
        a = attr(part) if tag in ("div", "section", "ul") or r.random() < 0.4 else ""
        body = {
            "menu": lambda: links(r.randint(3, 8)) if tag != "ul" else "".join(f"<li>{link(1, 2)}</li>" for _ in range(5)),
            "header": lambda: f"<h1>{words(1, 4, part)}</h1>" * r.randint(0, 1) + f"<p>{words(3, 9, part)}</p>" + (links(3) if r.random() < 0.4 else ""),
            "footer": lambda: r.choice((f"&copy; {words(1, 3)} &middot; {words(2, 6, part)}.", f"<p>&copy; {words(2, 6, part)}</p>" + links(3, part), f"<p>{sentence(4, 12, part)}</p>")),
            "side": lambda: f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{words(1, 3, part)}</{h}>" + r.choice((links(4, ""), f"<p>{sentence(8, 30, part)}</p>")),
            "notice": lambda: r.choice((f"<p>{sentence(6, 25, part)}</p>", sentence(6, 20, part))) + f"<button>{words(1, 2, part)}</button>" * r.randint(0, 1),
            "advert": lambda: r.choice((sentence(3, 12, part), f"<p>{sentence(4, 20, part)}</p>", link(3, 8, part))),
            "form": lambda: f'<label>{words(1, 2, part)}</label><input name="q"><p>{words(2, 5, part)}</p><button>{words(1, 1, part)}</button>',
            "comment": lambda: f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{words(1, 4, part)}</{h}>" * r.randint(0, 1) + "".join(r.choice((f"<p>{sentence(5, 40)}</p>", f"<div><b>{words(1, 2)}</b> {words(1, 3, part)}<p>{sentence(5, 40)}</p></div>", f"<li>{sentence(5, 30)}</li>")) for _ in range(r.randint(1, 4))),
            "share": lambda: r.choice((links(3, part), f"<span>{words(1, 4, part)}</span>", f"<p>{words(2, 5, part)}</p>")),
        }[part]()
        if part == "form" and not nameless:
            tag = "form"
        return f"<{tag}{a}>{body}</{tag}>"

    def article() -> tuple[str, set[str]]:
        main, html = set(), []
        plain = nameless and r.random() < 0.4  # paragraphs are divs, too

        def keep(tag: str, text: str, markup: str | None = None):
            main.add(text)
            if plain and tag == "p":
                tag = "div"
            html.append(f"<{tag}>{markup or text}" + ("" if tag == "p" and r.random() < 0.1 else f"</{tag}>"))

        if r.random() < 0.85:
            headed = not nameless and r.random() < 0.2  # the article's own header, with a line about its author
            html.append(f"<header{r.choice(('', attr('header'), ' class=entry-header'))}>" if headed else "")
            keep(r.choice(("h1", "h1", "h2")), words(3, 11))
            html.append(f"<{(tag := r.choice(('div', 'p')))}{r.choice(('', attr('share')))}>{words(2, 5, 'share')}</{tag}></header>" if headed else "")
        short = not nameless and r.random() < 0.2
        for _ in range(r.randint(1, 3) if short else r.randint(1, 12)):
            kind = r.random()
            if kind < 0.72:
                text = sentence(1, 8) if short else " ".join(sentence(4, 25) for _ in range(r.randint(1, 6)))
                if r.random() < 0.1:
                    text = words(1, 3)
                head, _, tail = text.partition(" ")
                keep("p", text, f"<b>{head}</b> {tail}" if tail and r.random() < 0.15 else f"{head} <a href='/x'>{tail}</a>" if tail and r.random() < 0.05 else None)
            elif kind < 0.8:
                keep(r.choice(("h2", "h3")), words(2, 6))
            elif kind < 0.88:
                html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    keep("li", sentence(3, 14))
                html.append("</ul>")
            elif kind < 0.91:
                keep("blockquote", sentence(6, 30))
            elif kind < 0.92:
                keep("object", sentence(4, 20))
            elif kind < 0.94:
                html.append("<table><tr>")
                for _ in range(3):
                    keep("td", words(1, 4))
                html.append("</tr></table>")
            else:
                if not nameless or sum(map(len, main)) > 400:
                    html.append(other("share" if nameless else r.choice(("advert", "side", "share", "notice", "form"))))
        while nameless and sum(len(t.split()) for t in main) < 60:
            keep("p", " ".join(sentence(6, 25) for _ in range(3)))
        return "".join(html), main

    pages = []
    for _ in range(n):
        nameless = r.random() < 0.33
        body, main = article()
        if r.random() < 0.2:
            body += other("share" if nameless else r.choice(("share", "comment", "advert", "side")))
        shell = "div" if nameless else r.choice(("article", "article", "article", "main", "div", "div", "section", "mixed", "bare"))
        if shell == "mixed":
            body = f"<main><article{attr('main')}>{body}</article></main>"
        elif shell != "bare":
            body = f"<{shell}{attr('main') if shell in ('div', 'section') or r.random() < 0.3 else ''}>{body}</{shell}>"
        before = "".join(other(p) for p in ("notice", "header", "menu", "advert", "form", "side") if r.random() < 0.5)
        after = "".join(other(p) for p in ("share", "side", "advert", "comment", "form", "notice") if r.random() < 0.4) + (other("footer") if r.random() < 0.85 else "")
        if shell == "bare" or r.random() < 0.05:
            after += r.choice(("", f"<p>&copy; {words(1, 6, 'footer')}</p>", f"<p>Copyright {words(1, 4, 'footer')}.</p>", f"<table><tr><td>&copy; {words(1, 4)}</td></tr></table>"))
        if r.random() < 0.3:
            body = f"<div>{body}</div>" if nameless else f"<div id='wrap'>{body}</div>"
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>", main))
    return pages


@lru_cache(1)
def trained() -> Chain:
    """The chain of the generated pages, fitted once a driver."""
    return fit(labelled_pages())


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(chain)

    def run(batches):
        chain = shared.value
        for b in slices(batches, 1000):
            texts, n_blocks, n_main = [], [], []
            for html in b.column(2).to_pylist():
                blocks = blocks_of(html)
                labels = chain.decode([f for _, f in blocks])
                main = [t for (t, _), label in zip(blocks, labels, strict=True) if label]
                texts.append("\n".join(main))
                n_blocks.append(len(blocks))
                n_main.append(len(main))
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_blocks, pa.int64()), pa.array(n_main, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    columns = pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "CAST(html AS string) AS html")
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"), trained()).select("page_id", "url", "text", "n_chars")
