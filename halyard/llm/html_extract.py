"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each
block has features of its ancestors (tags, roles, classes and ids), of its text
(length, links, marks) and of whether the page has an article or main element
that it stands outside of; the field scores labellings of the whole sequence as
text or not and Viterbi finds the best. It is trained by gradient ascent on the
exact likelihood (forward-backward), on labelled pages that ``labelled_page``
writes in many layouts, bare ones among them.

A class or id is judged as a whole: "cookie-banner" is a notice, "has-sidebar"
and "tag-news" say nothing. What html and body are called says nothing either,
and main and article elements are no part of a menu, header or footer around them.
A form, widget or message that holds most of the page's text is no chrome but a
wrapper of the page, and counts for nothing, unless an article stands outside it.
Parsing takes time in proportion to the page, whatever is left unclosed.

Defined results
    null or empty html: empty text; unclosed or stray tags, comments, scripts
    and attributes: parsed leniently, to the end of the page; svg, select,
    template and canvas: skipped, if unclosed up to the next block-level tag;
    math and object: their text counts; html without markup: one block of
    text; very long or deeply nested pages: parsed whole; repeated rows:
    extracted each; ties between labellings: not text; null url or page_id:
    carried along; empty table: no rows; further columns: left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements of HTML by how they are parsed.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("svg select template canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("button body head html option".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()), "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("html body article section div table td th main aside nav header footer form fieldset blockquote ul ol dl button".split())
TAGS = (
    "nav header footer aside form article main section ul ol li table td th h1 h2 h3 h4 h5 h6 p blockquote pre figure "
    "figcaption button label legend dialog address details summary dl dt dd div body head menu search"
).split()
#: Words of class, id and role values and what they speak for.
WORDS = {
    "content": "article articlebody content post story entry main text body prose page single",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination skip",
    "top": "header masthead topbar branding logo top",
    "foot": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget widgets related recommended popular trending teaser complementary more",
    "ad": "ad ads advert adverts advertisement banner sponsor sponsored promo promoted promotion dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall message",
    "talk": "comment comments reply replies respond discussion disqus reviews thread commentlist",
    "share": "share sharing social follow like tweet tags tag meta byline author date",
    "form": "form login signup signin search contact register input",
}
WORD_OF = {w: kind for kind, words in WORDS.items() for w in words.split()}
#: First words of classes that tell a state, a layout or a topic, not what an element is.
STATES = frozenset("has with no without is not show hide hidden tag category author date type format status layout js wp".split())
#: Kinds of chrome that hold no main or article element.
OUTER = frozenset(f"class:{k}" for k in ("menu", "top", "foot", "notice", "form", "share"))
#: Kinds that an element around most of a page's text is not of, whatever it is called, and how much most is.
WRAPPED = frozenset("menu top foot side ad notice share form".split())
MOST_TEXT, MOST_OF_FORM = 0.8, 0.6
LEXICON = re.compile(
    r"©|\(c\)|copyright|all rights|cookie|subscrib|newsletter|sign (?:in|up)|log ?in|privacy|terms of|advert|sponsored|"
    r"comments?\b|repl(?:y|ies)|share|follow us|read more|click here", re.I,
)
RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)
TEXT_FEATURES = 29
LABEL_MARK = "\ue001"


@dataclass
class Leaf:
    text: str
    path: int  # number of the set of ancestor features
    links: int  # characters inside links
    leaf: str  # the innermost block element
    around: tuple[tuple[int, bool], ...] = ()  # elements that look like chrome around it: number, whether a form


def class_kind(name: str) -> str | None:
    """What a class or id speaks for, if anything: its last word that is known, chrome before content."""
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
    if len(words) > 1 and words[0] in STATES:
        return None
    for k, w in enumerate(words):
        if w in ("has", "with", "no", "without"):
            words = words[:k]
            break
    kinds = [WORD_OF[w] for w in words if w in WORD_OF]
    return next((k for k in reversed(kinds) if k != "content"), kinds[-1] if kinds else None)


def skipped_ends(page: str, at: int) -> dict[int, int]:
    """For each skipped element that begins at or after the place: where what follows its open tag goes on.

    That is after its close tag or, if it has none before what holds it is
    closed, at the next block-level tag. Keys are the ends of the open tags.
    """
    ends: dict[int, int] = {}
    lone: list[int] = []
    blocks: list[int] = []
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = defaultdict(list)

    def pop_to(k: int) -> None:
        for name, place in stack[k:]:
            where[name].pop()
            if name in SKIPPED:
                lone.append(place)
        del stack[k:]

    while (m := TOKEN.search(page, at)) is not None:
        at = m.end()
        end, name, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        name = (name or "").lower()
        if name in RAW and not end:
            close = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(page, at)
            at = len(page) if close is None else close.start()
        elif name in SKIPPED:
            if not end:
                if not attrs.rstrip().endswith("/") or name != "svg":
                    where[name].append(len(stack))
                    stack.append((name, at))
            elif where[name]:
                k = where[name][-1]
                ends[stack[k][1]] = at
                pop_to(k)
        elif name in BLOCK and name not in ("option", "hr"):
            blocks.append(m.start())
            if not end:
                where[name].append(len(stack))
                stack.append((name, at))
            else:
                pop_to(where[name][-1] if where[name] else 0)
    pop_to(0)
    for place in lone:
        if place not in ends:
            k = bisect_left(blocks, place)
            ends[place] = blocks[k] if k < len(blocks) else len(page)
    return ends


class Parser:
    """Cuts pages into leaf blocks; sets of ancestor features are numbered and shared by all pages."""

    def __init__(self):
        self.sets: list[frozenset[str]] = [frozenset()]
        self.number: dict[frozenset[str], int] = {self.sets[0]: 0}
        self.next: dict[tuple[int, str, str, bool], tuple[int, bool, bool]] = {}

    def _enter(self, parent: int, tag: str, attrs: str, wrapper: bool) -> tuple[int, bool, bool]:
        """The set of features inside an element, whether it is hidden and whether it looks like chrome; a wrapper doesn't."""
        key = (parent, tag, attrs, wrapper)
        if (known := self.next.get(key)) is not None:
            return known
        new, hidden, kinds = set(self.sets[parent]), False, set()
        if tag == "main":
            new = {x for x in new if not x.startswith("class:") or x == "class:content"}
        elif tag == "article":
            new -= OUTER
        if tag == "form":
            kinds.add("form")
        if tag in TAGS and not (wrapper and tag == "form"):
            new.add("in:" + tag)
        for name, *values in ATTRIBUTE.findall(attrs):
            value, name = "".join(values), name.lower()
            if name == "hidden":
                hidden = True
            elif name == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
            elif name != "aria-hidden" and tag not in ("html", "body"):
                own = {kind for kind in map(class_kind, value.split()) if kind}
                kinds |= own
                new.update(f"class:{kind}" for kind in (own - WRAPPED if wrapper else own))
        fixed = frozenset(new)
        if fixed not in self.number:
            self.number[fixed] = len(self.sets)
            self.sets.append(fixed)
        if len(self.next) > 200_000:
            self.next.clear()
        self.next[key] = self.number[fixed], hidden, bool(kinds & WRAPPED)
        return self.next[key]

    def leaves(self, page: str) -> list[Leaf]:
        """The page's blocks; a page with wrappers is cut again with them known."""
        out = self._cut(page, frozenset())
        wide = self._wrappers(out)
        return self._cut(page, wide) if wide else out

    def _wrappers(self, leaves: list[Leaf]) -> frozenset[int]:
        """Numbers of the elements that look like chrome and hold most of the page's text, and no article or content stands outside."""
        mass: dict[tuple[int, bool], int] = defaultdict(int)
        total, good = 0, []
        for b in leaves:
            plain = len(b.text) - b.links
            total += plain
            for x in b.around:
                mass[x] += plain
            names = self.sets[b.path]
            if holds_text(names) or not b.around and "class:content" in names and not names & ASIDES:
                good.append(b)
        large = {x for x, m in mass.items() if m >= (MOST_OF_FORM if x[1] else MOST_TEXT) * total}
        return frozenset(x[0] for x in large if all(x in b.around for b in good)) if large else frozenset()

    def _cut(self, page: str, wide: frozenset[int]) -> list[Leaf]:
        out: list[Leaf] = []
        stack: list[tuple] = [("", 0, False, "", ())]  # tag, set, hidden, innermost block, chrome around
        number = 0
        where: dict[str, list[int]] = defaultdict(list)  # places in the stack of each tag
        scopes: list[int] = [0]
        parts: list[str] = []
        ends: dict[int, int] | None = None
        links = 0
        anchors = where["a"]

        def flush() -> None:
            nonlocal links
            if parts:
                raw = "".join(parts)
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                _, path, hidden, leaf, around = stack[-1]
                if text and not hidden:
                    out.append(Leaf(text, path, min(links, len(text)), leaf, around))
                parts.clear()
            links = 0

        def add(a: int, b: int) -> None:
            nonlocal links
            if a < b:
                parts.append(page[a:b])
                if anchors:
                    links += b - a

        def pop_to(k: int) -> None:
            for s in stack[k:]:
                where[s[0]].pop()
                if s[0] in SCOPE:
                    scopes.pop()
            del stack[k:]

        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                add(at, n)
                break
            add(at, m.start())
            at = m.end()
            if m[2] is not None:
                end, tag, attrs = m[1], m[2].lower(), m[3]
            elif m[5] is not None:
                end, tag, attrs = m[4], m[5].lower(), m[6]
            else:
                if page.startswith("<![CDATA[", m.start()):
                    add(m.start() + 9, at - 3 if page.endswith("]]>", m.start(), at) else at)
                continue
            if end:
                if tag in BLOCK:
                    flush()
                # an inline element is not closed across the element that holds it
                if (open_at := where[tag] if tag in where else None) and (tag in BLOCK or open_at[-1] >= scopes[-1]):
                    pop_to(open_at[-1])
                continue
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(page, at)
                at = n if close is None else (page.find(">", close.end()) + 1 or n)
                continue
            if tag in SKIPPED:
                if not attrs.rstrip().endswith("/") or tag != "svg":
                    if ends is None:
                        ends = skipped_ends(page, m.start())
                    at = ends.get(at, at)
                continue
            if tag in BLOCK:
                flush()
                if tag in CLOSES_P and where["p"] and where["p"][-1] > scopes[-1]:
                    pop_to(where["p"][-1])
                if tag in CLOSED_BY:
                    closes, stops = CLOSED_BY[tag]
                    stop = max((where[t][-1] for t in stops if where[t]), default=0)
                    low = [places[k] for t in closes if (k := bisect_right(places := where[t], stop)) < len(places)]
                    if low:
                        pop_to(min(low))
            elif tag == "br":
                parts.append(" ")
            if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
                continue
            _, path, hidden, leaf, around = stack[-1]
            number += 1
            path, own, chrome = self._enter(path, tag, attrs if "=" in attrs or "hidden" in attrs else "", number in wide)
            if chrome and number not in wide:
                around = (*around, (number, tag == "form"))
            where[tag].append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append((tag, path, hidden or own, tag if tag in BLOCK else leaf, around))
        flush()
        return out


def text_features(leaf: Leaf, first: bool, last: bool, page: int = 0, beside: tuple[bool, bool] = (False, False)) -> list[int]:
    """Numbers, below TEXT_FEATURES, of the features that the block's own text has; beside: whether the block before and after is links."""
    text, n = leaf.text, len(leaf.text)
    words = text.count(" ") + 1
    share = leaf.links / n
    f = [0, 1 + (n > 15) + (n > 40) + (n > 100) + (n > 250)]
    f.append(6 if share == 0 else 7 if share < 0.35 else 8 if share < 0.9 else 9)
    if text[-1] in ".!?…\"”»":
        f.append(10)
    if words <= 2:
        f.append(11)
    if LEXICON.search(text) and n < 300:
        f.append(12)
    if "|" in text or "·" in text or "»" in text or "›" in text:
        f.append(13)
    if text.count(", ") + text.count(". ") >= 2:
        f.append(14)
    if text[:1].islower():
        f.append(15)
    if first:
        f.append(16)
    if last:
        f.append(17)
    if leaf.leaf in ("p", "blockquote", "pre"):
        f.append(18)
    if leaf.leaf[:1] == "h" and leaf.leaf[1:].isdigit():
        f.append(19)
    if leaf.leaf in ("li", "td", "th", "dd", "dt"):
        f.append(20)
    if leaf.leaf in ("div", "section", "article", "main", "body", ""):
        f.append(21)
    if leaf.leaf in ("button", "label", "legend", "option", "summary"):
        f.append(22)
    if share > 0.5 and leaf.leaf == "li":
        f.append(23)
    if page:
        f.append(23 + page)
    if n < 300 and RIGHTS.search(text):
        f.append(26)
    f += [27 + k for k, links in enumerate(beside) if links]
    return f


def holds_text(names: frozenset[str]) -> bool:
    """Whether ancestors are an article or main element that is no comment, teaser or advert."""
    return ("in:article" in names or "in:main" in names) and not names & ASIDES


def standing(sets: list[frozenset[str]], leaves: list[Leaf]) -> list[int]:
    """Of each block: 1 if it stands outside the page's article or main element, 2 if the page has none and no content class."""
    inside = [holds_text(sets[b.path]) for b in leaves]
    if any(inside):
        return [int(not x) for x in inside]
    return [0 if any("class:content" in sets[b.path] for b in leaves) else 2] * len(leaves)


def page_features(sets: list[frozenset[str]], leaves: list[Leaf]) -> list[list[int]]:
    """Text features of each block of a page."""
    last = len(leaves) - 1
    links = [False, *(b.links > 0.8 * len(b.text) for b in leaves), False]
    return [
        text_features(b, t == 0, t == last, where, (links[t], links[t + 2]))
        for t, (b, where) in enumerate(zip(leaves, standing(sets, leaves), strict=True))
    ]


#: What an article element may stand in, or be, without holding the page's text.
ASIDES = frozenset(("in:aside", "in:nav", "in:footer", "class:talk", "class:side", "class:ad", "class:notice"))
PATH_FEATURES = [f"in:{t}" for t in TAGS] + [f"class:{k}" for k in WORDS]
#: Ancestor features also count together: what an article holds is not all text.
PAIRS = [("in:article", x) for x in PATH_FEATURES if x != "in:article"] + [("in:main", x) for x in ("in:aside", "in:nav", "in:form", "class:talk", "class:ad")]
FEATURES = TEXT_FEATURES + len(PATH_FEATURES) + len(PAIRS)


def path_features(names: frozenset[str]) -> list[int]:
    out = [TEXT_FEATURES + i for i, x in enumerate(PATH_FEATURES) if x in names]
    return out + [TEXT_FEATURES + len(PATH_FEATURES) + i for i, (a, b) in enumerate(PAIRS) if a in names and b in names]


@dataclass
class Field:
    """emit[feature]: score of text over not text; move[a, b]: score of label b after a; begin and end per label."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def decode(self, scores: list[float]) -> list[bool]:
        """The best labelling of blocks whose emission scores are given, by Viterbi."""
        if not scores:
            return []
        (a, b), (c, d) = self.move.tolist()
        no, yes = self.begin[0], self.begin[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_no, from_yes = no + b > yes + d, no + a < yes + c
            back.append((from_yes, not from_no))
            no, yes = max(no + a, yes + c), max(no + b, yes + d) + s
        label = bool(yes + self.end[1] > no + self.end[0])
        out = [label]
        for to_no, to_yes in reversed(back):
            label = to_yes if label else to_no
            out.append(label)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(field: Field, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log-likelihood of the labels y (pages x blocks) of size blocks each, and its gradients; x is pages x blocks x features."""
    pages, steps, _ = x.shape
    score = np.zeros((pages, steps, 2))
    score[:, :, 1] = x @ field.emit
    rows = np.arange(pages)
    alpha = np.zeros((pages, steps, 2))
    alpha[:, 0] = field.begin + score[:, 0]
    for t in range(1, steps):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + field.move, 1) + score[:, t]
    beta = np.zeros((pages, steps, 2))
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            beta[:, t] = _log_sum(field.move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[size - 1 == t, t] = field.end
    whole = _log_sum(alpha[rows, size - 1] + field.end, 1)
    live = np.arange(steps)[None] < size[:, None]
    prob = np.exp(alpha + beta - whole[:, None, None]) * live[:, :, None]
    picked = np.eye(2)[y] * live[:, :, None]
    total = (picked * score).sum() + field.begin[y[:, 0]].sum() + field.end[y[rows, size - 1]].sum()
    d_move = np.zeros((2, 2))
    for t in range(1, steps):
        on = live[:, t]
        joint = alpha[on, t - 1, :, None] + field.move + (score[on, t] + beta[on, t])[:, None, :] - whole[on, None, None]
        d_move -= np.exp(joint).sum(axis=0)
        np.add.at(d_move, (y[on, t - 1], y[on, t]), 1)
        total += field.move[y[on, t - 1], y[on, t]].sum()
    d_emit = (picked[:, :, 1] - prob[:, :, 1]).ravel() @ x.reshape(-1, x.shape[2])
    d_begin = (np.eye(2)[y[:, 0]] - prob[:, 0]).sum(axis=0)
    d_end = (np.eye(2)[y[rows, size - 1]] - prob[rows, size - 1]).sum(axis=0)
    return float(total - whole.sum()) / pages, [g / pages for g in (d_emit, d_move, d_begin, d_end)]


def fit(pages: list[str], rounds: int = 140, rate: float = 0.15, ridge: float = 0.003) -> Field:
    """Train on pages whose text blocks carry LABEL_MARK."""
    parser, made = Parser(), []
    for page in pages:
        leaves = parser.leaves(page)
        label = [LABEL_MARK in b.text for b in leaves]
        for b in leaves:
            b.text = b.text.replace(LABEL_MARK, "") or "-"
        if leaves:
            made.append((leaves, label))
    steps = max(len(m[0]) for m in made)
    x, y = np.zeros((len(made), steps, FEATURES)), np.zeros((len(made), steps), np.int64)
    size = np.array([len(m[0]) for m in made])
    for i, (leaves, label) in enumerate(made):
        y[i, : len(label)] = label
        for t, (leaf, own) in enumerate(zip(leaves, page_features(parser.sets, leaves), strict=True)):
            x[i, t, own + path_features(parser.sets[leaf.path])] = 1
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    params = [field.emit, field.move, field.begin, field.end]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        _, grads = likelihood(field, x, y, size)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g - ridge * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (1 - k / (rounds + 1)) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return field


@lru_cache(maxsize=1)
def _invented_words(n: int = 2000) -> list[str]:
    syllables, rng = "ba ke li mo nu ra se ti vo za der ing al est un or em is ta no".split(), np.random.default_rng(5)
    return ["".join(syllables[i] for i in rng.integers(len(syllables), size=rng.integers(1, 4))) for _ in range(n)]


def labelled_page(rng: np.random.Generator) -> str:
    """A page in a random layout whose text blocks begin with LABEL_MARK."""
    mark, made = LABEL_MARK, _invented_words()
    pick = lambda *options: options[rng.integers(len(options))]
    maybe = lambda chance, value: value if rng.random() < chance else ""

    def words(n: int) -> str:
        return " ".join(made[i] for i in rng.integers(len(made), size=n))

    def sentence(low: int = 3, high: int = 18) -> str:
        return words(int(rng.integers(low, high))).capitalize() + pick(".", ".", ".", "?", "!")

    def prose(low: int = 1, high: int = 7) -> str:
        return " ".join(sentence(1, 18) for _ in range(rng.integers(low, high)))

    link = lambda text: f'<a href="/{words(1)}">{text}</a>'
    links = lambda n: "".join(f"<li>{link(words(int(rng.integers(1, 4))))}</li>" for _ in range(n))

    def paragraph() -> str:
        text = prose()
        kind = rng.random()
        if kind < 0.08:
            text = link(words(3)) + " " + text
        elif kind < 0.2:
            text = f"<b>{sentence()}<br>" if rng.random() < 0.5 else f"<em>{words(2)}</em> {text}"
        return f"<p>{mark}{text}" + maybe(0.85, "</p>")

    def body() -> str:
        out = []
        for _ in range(rng.integers(1, 9)):
            r = rng.random()
            if r < 0.72:
                out.append(paragraph())
            elif r < 0.82:
                out.append(f"<h{(h := rng.integers(2, 5))}>{mark}{words(4).capitalize()}</h{h}>")
            elif r < 0.88:
                out.append("<ul>" + "".join(f"<li>{mark}{sentence()}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
            elif r < 0.91:
                out.append(f"<blockquote>{pick('<p>', '')}{mark}{prose()}</blockquote>")
            elif r < 0.94:
                rows = "".join(f"<tr><td>{mark}{words(2)}</td><td>{mark}{rng.integers(100)}</td></tr>" for _ in range(2))
                out.append(f"<table>{rows}</table>")
            elif r < 0.96:
                out.append(f"<pre>{mark}{words(12)}</pre>")
            else:
                out.append(f"<div>{mark}{prose()}</div>")
        return out

    def advert() -> str:
        name = pick("ad", "ads", "advert", "banner", "sponsored", "promo")
        inner = pick(sentence(), prose(), link(words(4)), f"<p>{prose()}</p>")
        return f'<div {pick("class", "class", "id")}="{name}">{inner}</div>'

    def talk() -> str:
        one = lambda: f'<div class="{pick("comment", "reply")}"><p>{prose()}</p></div>'
        tag = pick("section", "div", "aside")
        return f'<{tag} {pick("class", "id")}="comments"><h{(h := rng.integers(2, 4))}>{pick("Comments", words(2))}</h{h}>' + "".join(one() for _ in range(rng.integers(1, 5))) + f"</{tag}>"

    def notice() -> str:
        text = pick(f"<p>{prose()}</p>", prose(1, 3))
        return f'<{(t := pick("div", "section", "aside"))} class="{pick("cookie-notice", "cookie", "notice", "consent", "newsletter", "alert")}">{text}{maybe(0.5, "<button>" + words(1) + "</button>")}</{t}>'

    def side() -> str:
        inner = pick(f"<h3>{words(2)}</h3><ul>{links(4)}</ul>", f"<p>{prose()}</p>", f"<h4>{words(2)}</h4><p>{prose()}</p>")
        bare = f"<div><h{(h := rng.integers(2, 5))}>{pick(words(1), 'Related', 'Read more')}</h{h}><ul>{links(int(rng.integers(2, 6)))}</ul></div>"
        return pick(f"<aside{maybe(0.5, ' class=\"sidebar\"')}>{inner}</aside>", f'<div class="{pick("sidebar", "widget", "related")}">{inner}</div>', bare)

    def form() -> str:
        return f'<form>{maybe(0.6, "<p>" + sentence() + "</p>")}<label>{words(1)}</label><input name="q">{maybe(0.5, "<p>" + prose() + "</p>")}<button>{words(1)}</button></form>'

    parts = body()
    bare = rng.random()
    if bare < 0.03:
        return f"{mark}{prose()}"
    if bare < 0.25:  # no chrome, or nothing but a footer or menu
        parts = [f"<p>{mark}{sentence(1, 4)}</p>"] if rng.random() < 0.2 else parts[: int(rng.integers(1, len(parts) + 1))]
        text = maybe(0.5, f"<h1>{mark}{words(4)}</h1>") + "".join(parts)
        text = pick(f"<article>{text}</article>", f"<main>{text}</main>", f"<div>{text}</div>", f'<div class="post">{text}</div>', text, text)
        return pick(
            f"<html><body>{text}</body></html>", f"<html><head><title>{words(3)}</title></head><body>{text}", text,
            f"<body><ul>{links(4)}</ul>{text}</body>", f"<body>{text}<footer>{sentence()}</footer></body>", f"<body><nav>{links(3)}</nav>{text}</body>",
        )
    for extra, chance in ((advert, 0.25), (form, 0.1), (side, 0.15), (notice, 0.1)):
        if rng.random() < chance:
            parts.insert(int(rng.integers(len(parts) + 1)), extra())
    title = words(5).capitalize()
    inner_talk = talk() if rng.random() < 0.15 else ""
    head_in = pick(f"<h1>{mark}{title}</h1>", f"<h1>{mark}{title}.</h1>", f"<header><h1>{mark}{title}</h1></header>", "")
    text = head_in + "".join(parts) + inner_talk
    kind = rng.random()
    if kind < 0.55:
        text = f"<article{maybe(0.3, ' class=\"post tag-news\"')}>{text}</article>"
    elif kind < 0.7:
        text = f"<main>{text}</main>"
    elif kind < 0.8:
        text = f"<main><article>{text}</article></main>"
    elif kind < 0.95:
        text = f'<div {pick("class", "id")}="{pick("content", "post", "entry-content", "article-body", "story", "main-content")}">{text}</div>'
    else:
        text = f"<div>{text}</div>"
    teaser = lambda: f'<section class="related">{"".join(f"<article><h3>{link(words(3))}</h3><p>{sentence()}</p></article>" for _ in range(2))}</section>'
    text = pick(text, text, f'<div class="{pick("wrapper", "site-main has-sidebar", "container with-ads", "row no-comments")}">{text}{maybe(0.3, side())}</div>')
    nav = pick(f"<nav><ul>{links(5)}</ul></nav>", f"<nav>{link(words(1))} | {link(words(1))}</nav>", f'<ul class="menu">{links(5)}</ul>', f'<div id="nav"><ul>{links(4)}</ul></div>', f"<table><tr><td>{link(words(1))} {link(words(1))} {link(words(1))}</td></tr></table>")
    top = pick("", "", f"<header>{maybe(0.5, '<h1>' + words(2) + '</h1>')}<p>{sentence()}</p></header>", f"<header>{nav}</header>", f'<div class="header">{words(3)}</div>')
    before = [x for x, chance in ((advert, 0.4), (notice, 0.2), (side, 0.2), (form, 0.15)) if rng.random() < chance]
    after = [x for x, chance in ((talk, 0.35), (teaser, 0.08), (side, 0.3), (advert, 0.25), (form, 0.2), (notice, 0.15)) if rng.random() < chance]
    foot = pick(
        f"<footer>&copy; {words(1)} &middot; {sentence()}</footer>", f"<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>",
        f'<div class="footer">{sentence()}</div>', f"<footer>{prose()}</footer>", "",
        f'<div{maybe(0.5, f" class=\"css-{rng.integers(99)}\"")}>{pick("&copy;", "Copyright", "(c)")} {rng.integers(1990, 2030)} {words(2)}. {pick("All rights reserved.", "Privacy, terms of use.", words(2))}</div>',
    )
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>"
        + pick(top + nav, nav + top, nav, top) + "".join(x() for x in before) + text + "".join(x() for x in after) + foot
        + maybe(0.8, "</body></html>")
    )


@lru_cache(maxsize=4)
def trained_field(pages: int = 700, seed: int = 11) -> Field:
    """The field, trained on the given number of labelled pages."""
    rng = np.random.default_rng(seed)
    return fit([labelled_page(rng) for _ in range(pages)])


class Extractor:
    def __init__(self, field: Field):
        self.field, self.parser, self.scores = field, Parser(), {}
        self.emit = field.emit.tolist()

    def _path(self, path: int) -> float:
        if path not in self.scores:
            self.scores[path] = sum(self.emit[k] for k in path_features(self.parser.sets[path]))
        return self.scores[path]

    def blocks(self, page: str) -> list[tuple[Leaf, bool]]:
        leaves = self.parser.leaves(page)
        own = page_features(self.parser.sets, leaves)
        scores = [self._path(b.path) + sum(map(self.emit.__getitem__, f)) for b, f in zip(leaves, own, strict=True)]
        return list(zip(leaves, self.field.decode(scores), strict=True))

    def text(self, page: str | None) -> str:
        return "\n\n".join(b.text for b, is_text in self.blocks(page) if is_text) if page else ""


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or trained_field()

    def run(batches):
        extractor = Extractor(field)
        for batch in batches:
            texts = [extractor.text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
