"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is the sequence of its leaf blocks.  Each block has sparse features from the elements
around it (their tags, and the words of their class, id and role) and from its text.  A
conditional random field with the labels *kept* and *dropped* is trained on labelled pages and
decoded by Viterbi; the kept blocks are the main text.

``sample_pages`` writes labelled pages: many layouts around text, with the label of every
block known from the way it was written.  Any other labelled pages can be given instead.

Defined cases: a null or empty page has an empty text; text without markup is one block;
unclosed tags, comments and quotation marks run to the end of the page; equal pages get equal
texts; whole pages are read.  Other columns of the table are never looked at.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import bounded_batches
from corpusweave.llm.dom import Block, Element, leaf_blocks

#: Labelled pages that the default model is trained on.
TRAINING_PAGES = 1000

# Fixed word lists: hints in the text itself.
HINTS = {
    "rights": "© copyright rights reserved imprint impressum",
    "cookie": "cookie cookies consent gdpr privacy terms",
    "account": "login log sign subscribe subscription newsletter register password",
    "advert": "advertisement advert sponsored promoted promotion anzeige publicité publicidad",
    "social": "share tweet facebook twitter follow like print email",
    "comment": "comment comments reply replies posted commented responses",
    "browse": "home next previous menu contact about search related popular trending read more",
}
_HINT = {w: h for h, words in HINTS.items() for w in words.split()}
#: Elements and names whose nearest one says most about a block.
TELLING = frozenset(
    "article main nav aside header footer form section dialog menu figure table blockquote body".split()
)
_WORD = re.compile(r"[^\W\d_]+|©")


def _bucket(n: int) -> int:
    return n if n < 2 else min(9, 1 + int(math.log2(n)))


#: Near telling elements, nearest names, inner telling element, and all tags and names around.
_OUTSIDE = (None, (), None, ())


def _shared(element: Element | None) -> tuple:
    """What the features of all blocks inside an element have in common.

    It follows from the parent's; an element that adds nothing hands on the parent's own.
    """
    todo = []
    while element is not None and element.shared is None:
        todo.append(element)
        element = element.parent
    known = _OUTSIDE if element is None else element.shared
    for element in reversed(todo):
        near, names, inner, around = known
        telling = element.tag in TELLING
        if telling or element.names:
            near = element.tag
        if telling:
            inner = element.tag
        added = [f"in={element.tag}", *(f"within={w}" for w in element.names)]
        fresh = [f for f in added if f not in around]
        found = (near, element.names or names, inner, (*around, *fresh) if fresh else around)
        known = element.shared = known if found == known else found
    return known


def block_features(block: Block, place: int, n: int) -> list[str]:
    """Names of the features that hold for a block."""
    words = block.text.split()
    count = len(words)
    linked = block.linked / max(1, len(block.text))
    depth = block.inside.depth if block.inside else 0
    near, names, inner, around = _shared(block.inside)
    out = [
        "bias",
        f"words={_bucket(count)}",
        f"linked={0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3}",
        f"depth={min(6, depth)}",
        f"ends={block.text[-1] if block.text[-1] in '.!?:;,…|»' else 'other'}",
        f"early={place < 2}",
        f"late={n - place < 3}",
    ]
    if block.inside:
        out.append(f"leaf={block.inside.tag}")
    if near:
        out.append(f"near={near}")
    out += [f"name={w}" for w in names]
    out += around
    if inner:
        out.append(f"inner={inner}")
    # Hints say more of a short block than of a long one.
    size = "short" if count < 12 else "long"
    for word in _WORD.findall(block.text.lower()) if count < 60 else ():
        if word in _HINT:
            out.append(f"{size} hint={_HINT[word]}")
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class ChainModel:
    """Weights of a two-label chain: per feature, between labels, and at the first block."""

    features: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]]
    first: tuple[float, float]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labelling (Viterbi); true for kept blocks."""
        n = len(blocks)
        back: list[tuple[int, int]] = []
        best = (0.0, 0.0)
        for i, block in enumerate(blocks):
            drop = keep = 0.0
            for f in block_features(block, i, n):
                w = self.features.get(f)
                if w:
                    drop += w[0]
                    keep += w[1]
            if i == 0:
                best = (self.first[0] + drop, self.first[1] + keep)
                continue
            (dd, dk), (kd, kk) = self.steps
            from_d = 0 if best[0] + dd >= best[1] + kd else 1
            from_k = 0 if best[0] + dk >= best[1] + kk else 1
            best = (
                (best[1] + kd if from_d else best[0] + dd) + drop,
                (best[1] + kk if from_k else best[0] + dk) + keep,
            )
            back.append((from_d, from_k))
        if not n:
            return []
        label = int(best[1] > best[0])
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [bool(x) for x in reversed(labels)]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "")
        return "\n".join(b.text for b, kept in zip(blocks, self.decode(blocks)) if kept)


def train_chain(
    pages: list[tuple[list[list[str]], list[int]]],
    l2: float = 0.02,
    rounds: int = 150,
    rate: float = 0.15,
) -> ChainModel:
    """Maximum-likelihood weights (Adam steps on the exact gradient by forward-backward).

    ``pages`` hold the features of each block and its label.  All pages are worked on at once,
    padded to the longest.
    """
    pages = sorted((p for p in pages if p[1]), key=lambda p: -len(p[1]))
    names = sorted({f for features, _ in pages for block in features for f in block})
    number = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(p[1]) for p in pages)
    rows, columns, gold = [], [], np.zeros((n, longest), int)
    mask = np.zeros((n, longest))
    for p, (features, labels) in enumerate(pages):
        mask[p, : len(labels)] = 1
        gold[p, : len(labels)] = labels
        for t, block in enumerate(features):
            for f in block:
                rows.append(p * longest + t)
                columns.append(number[f])
    rows, columns = np.array(rows), np.array(columns)
    one_hot = np.eye(2)[gold] * mask[:, :, None]
    size = len(names)

    def unpack(x):
        return x[: 2 * size].reshape(size, 2), x[2 * size : 2 * size + 4].reshape(2, 2), x[-2:]

    # Longer pages first: at each place, the pages that reach it stand in front.
    live = [int((mask[:, t] > 0).sum()) for t in range(longest)]
    x = np.zeros(2 * size + 6)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, trans, first = unpack(x)
        scores = np.stack(
            [np.bincount(rows, w[columns, k], n * longest) for k in (0, 1)], 1
        ).reshape(n, longest, 2)
        # Forward and backward in probabilities, scaled at every place.
        fit = np.exp(scores - scores.max(axis=2, keepdims=True))
        go = np.exp(trans)
        ahead = np.zeros((longest, n, 2))
        ahead[0] = fit[:, 0] * np.exp(first)
        ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            k = live[t]
            now = (ahead[t - 1, :k] @ go) * fit[:k, t]
            ahead[t, :k] = now / now.sum(axis=1, keepdims=True)
        after = np.ones((longest, n, 2))
        pair = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            beyond = fit[:k, t + 1] * after[t + 1, :k]
            chance = ahead[t, :k, :, None] * go * beyond[:, None, :]
            chance /= chance.sum(axis=(1, 2), keepdims=True)
            pair += (one_hot[:k, t, :, None] * one_hot[:k, t + 1, None, :] - chance).sum(0)
            back = beyond @ go.T
            after[t, :k] = back / back.sum(axis=1, keepdims=True)
        share = (ahead * after).transpose(1, 0, 2)
        share = share / np.maximum(share.sum(axis=2, keepdims=True), 1e-300) * mask[:, :, None]
        excess = (one_hot - share).reshape(-1, 2)
        slope = np.concatenate(
            [
                np.stack([np.bincount(columns, excess[rows, k], size) for k in (0, 1)], 1).ravel(),
                pair.ravel(),
                (one_hot - share)[:, 0].sum(0),
            ]
        )
        slope = slope / n - l2 * x / 10
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, trans, first = unpack(x)
    return ChainModel(
        {f: (float(w[i, 0]), float(w[i, 1])) for f, i in number.items()},
        tuple(map(tuple, trans.tolist())),
        tuple(first.tolist()),
    )


# Fixed word lists: how pages name the places of what is no main text, and of what is.
ROLES = {
    "menu": ("nav div ul menu", "menu nav navbar navigation topnav breadcrumb breadcrumbs links tabs toolbar pagination pager"),
    "header": ("header div", "header masthead top branding logo banner hero topbar"),
    "footer": ("footer div", "footer bottom copyright legal credits colophon imprint"),
    "sidebar": ("aside div section", "sidebar side rail related recommended widget trending popular more teaser"),
    "notice": ("div section dialog p", "notice cookie consent gdpr alert modal popup overlay paywall disclaimer banner message"),
    "advert": ("div aside ins section", "ad ads advert advertisement sponsor sponsored promo promotion adsense banner"),
    "form": ("form", "search login signup newsletter subscribe contact form"),
    "comments": ("section div ol ul", "comments comment commentlist discussion replies responses reader feedback disqus thread"),
    "share": ("div ul", "share social sharing follow tools tags meta"),
}
#: Names of the layout, which stand around anything.
NEUTRAL = (
    "wrap wrapper container row col column inner outer box layout grid site page flex block group region "
    "holder cell panel area root app view clearfix fluid left right center default bg dark light"
).split()
MAIN = ("article main section div", "content article post entry story body text main prose page")
_SYLLABLES = {
    "en": "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "en er ch te nd ei ie in es un st an be he ge re it sch au ung lich ver ä ü ö ß".split(),
    "fr": "es le de en re nt on er ou te la an qu et ai eau tion ment é è ç ê aux".split(),
    "es": "de la os en es ue ar re ra ón er que ad as el ci ción mente á í ó ñ".split(),
}


#: Private characters that mark a piece of text as main text while a page is written.
_KEPT, _NOT = "\ue001", "\ue000"


class _Writer:
    """Writes one page at a time, its main text marked; every choice comes from the seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        parts = _SYLLABLES[self.language]
        return "".join(self.rng.choice(parts) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        style = self.style
        if style == "marks":
            words = [w + self.rng.choice(("&amp;&amp;&amp;", "***", "$$$", "%%%", "###")) for w in words]
        elif style == "loud":
            words = [w.upper() + "!!" for w in words]
        elif style == "bars":
            words = [x for w in words for x in (w, "|")]
        return " ".join(words)

    def sentence(self, low: int = 3, high: int = 18) -> str:
        text = self.words(low, high)
        return text[:1].upper() + text[1:] + self.rng.choice((".", ".", ".", "!", "?"))

    def paragraph(self) -> str:
        n = self.rng.choice((1, 1, 1, 2, 3, 5, 8))
        return " ".join(self.sentence(1 if n == 1 else 3) for _ in range(n))

    def attributes(self, names: str, chance: float = 0.75) -> str:
        if self.rng.random() > chance:
            return ""
        name = self.rng.choice(names.split())
        name = self.rng.choice((name, f"site-{name}", f"{name}-wrap", f"js-{name} {name}", f"{name}Box"))
        return f' {self.rng.choice(("class", "class", "id"))}="{name}"'

    def neutral(self, text: str, chance: float) -> str:
        """The text in containers of the layout, whose names tell nothing, or that have none."""
        rng = self.rng
        while rng.random() < chance:
            name = rng.choice(NEUTRAL)
            some = rng.choice((name, f"{name}-{rng.choice(NEUTRAL)}", f"{name}{rng.randint(1, 12)}", f"c{rng.randint(1, 99)}", ""))
            attribute = f' {rng.choice(("class", "class", "id"))}="{some}"' if some else ""
            tag = rng.choice(("div", "div", "div", "section"))
            text, chance = f"<{tag}{attribute}>{text}</{tag}>", chance / 2
        return text

    def leaf(self, tag: str, text: str, label: int) -> str:
        text = self.bare(text, label)
        inner = self.rng.random()
        if inner < 0.1:
            text = f"<b>{text}</b>"
        elif inner < 0.15:
            text = f"<span>{text}</span>"
        return f"<{tag}>{text}</{tag}>"

    def boilerplate(self, role: str) -> str:
        rng = self.rng
        tags, names = ROLES[role]
        tag = rng.choice(tags.split())
        if tag == "p":
            return f"<p{self.attributes(names, 1)}>{self.bare(self.sentence(5, 25), 0)}</p>"
        # A container without a telling tag has a telling name, but for footers and notices.
        telling = tag in ("nav", "header", "footer", "aside", "form", "menu")
        chance = 0.6 if telling else 0.85 if role in ("footer", "notice") else 1.0
        filling = self.filling(role, tag)
        if tag not in ("ul", "ol", "menu"):
            filling = self.neutral(filling, 0.2)
        return self.neutral(f"<{tag}{self.attributes(names, chance)}>{filling}</{tag}>", 0.25)

    @staticmethod
    def bare(text: str, label: int) -> str:
        return (_KEPT if label else _NOT) + text

    def filling(self, role: str, tag: str) -> str:
        rng = self.rng
        if role in ("menu", "share") or (role == "sidebar" and rng.random() < 0.5):
            items = []
            for _ in range(rng.randint(2, 8)):
                link = f'<a href="/{self.word()}">{self.words(1, 3 if role != "sidebar" else 9)}</a>'
                items.append(f"<li>{self.bare(link, 0)}</li>")
            if tag in ("ul", "menu"):
                return "".join(items)
            heading = self.leaf("h3", self.words(1, 3), 0) if role == "sidebar" else ""
            return f"{heading}<ul>{''.join(items)}</ul>"
        if role == "header":
            parts = [self.leaf(rng.choice(("div", "p", "h1", "h2")), self.words(1, 5), 0)]
            if rng.random() < 0.5:
                parts.append(self.boilerplate("menu"))
            return "".join(parts)
        if role == "footer":
            mark = rng.choice(("&copy; 2024 ", "© ", "Copyright 2023 ", ""))
            parts = [self.words(1, 3), " &middot; " + self.sentence(2, 14)]
            text = mark + parts[0] + rng.choice((parts[1], parts[1] + "\n" + self.sentence(), ""))
            more = self.boilerplate("menu") if rng.random() < 0.3 else ""
            return (self.bare(text, 0) if rng.random() < 0.6 else self.leaf("p", text, 0)) + more
        if role == "form":
            label = f"<label>{self.words(1, 4)}</label><input type=text>"
            button = rng.choice(("Subscribe", "Send", "Search", "Log in", self.word()))
            return self.bare(label, 0) + f"<button>{self.bare(button, 0)}</button>"
        if role == "comments":
            items = [self.leaf("h3", rng.choice(("Comments", "3 replies", self.words(1, 3))), 0)]
            if tag in ("ol", "ul"):
                items = []
            for _ in range(rng.randint(1, 5)):
                who = self.leaf(rng.choice(("h4", "div", "p")), self.words(1, 3), 0) if rng.random() < 0.5 else ""
                said = "".join(self.leaf("p", self.paragraph(), 0) for _ in range(rng.randint(1, 2)))
                box = "li" if tag in ("ol", "ul") else rng.choice(("div", "article", "div"))
                items.append(f"<{box}{self.attributes('comment reply response', 0.7 if box != 'article' else 1)}>{who}{said}</{box}>")
            return "".join(items)
        hint = {
            "notice": ("We use cookies. ", "Please accept our terms. ", "", ""),
            "advert": ("Advertisement ", "Sponsored: ", "", ""),
        }.get(role, ("",))
        text = rng.choice(hint) + self.sentence(2, 25)
        if rng.random() < 0.6:
            return self.bare(text, 0)
        parts = [self.leaf("p", text, 0)]
        if rng.random() < 0.3:
            parts.append(self.leaf("p", self.paragraph(), 0))
        return "".join(parts)

    def main(self) -> str:
        rng = self.rng
        parts = []
        if rng.random() < 0.85:
            title = self.leaf(rng.choice(("h1", "h1", "h2")), self.words(1, 10), 1)
            parts.append(f"<header>{title}</header>" if rng.random() < 0.05 else title)
        roles = ("advert", "share", "sidebar", "notice", "form")
        for _ in range(rng.choice((1, 2, 3, 5, 8, 13))):
            kind = rng.random()
            if kind < 0.72:
                tail = rng.choice(("</p>", "</p>", "</p>", ""))
                text = self.bare(self.paragraph(), 1)
                if rng.random() < 0.2:
                    text = f"<b>{text}<br>"
                elif rng.random() < 0.15:
                    text += f' <a href="/x">{self.words(1, 6)}</a>'
                parts.append(f"<p>{text}{tail}")
            elif kind < 0.79:
                parts.append(self.leaf(rng.choice(("h2", "h3")), self.words(1, 7), 1))
            elif kind < 0.84:
                list_ = rng.choice(("ul", "ol"))
                items = "".join(self.leaf("li", self.sentence(1, 12), 1) for _ in range(rng.randint(2, 5)))
                parts.append(f"<{list_}>{items}</{list_}>")
            elif kind < 0.87:
                parts.append(self.leaf("blockquote", self.paragraph(), 1))
            elif kind < 0.89:
                parts.append(self.leaf("pre", self.words(2, 20), 1))
            elif kind < 0.91:
                cells = "".join(self.leaf("td", self.words(1, 3), 1) for _ in range(4))
                parts.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.93:
                parts.append(f"<figure><img src=x>{self.leaf('figcaption', self.sentence(), 1)}</figure>")
            else:
                parts.append(self.boilerplate(rng.choice(roles)))
        if rng.random() < 0.15:
            parts.append(self.boilerplate(rng.choice(("comments", "share", "sidebar", "form"))))
        return "".join(parts)

    def page(self) -> str:
        rng = self.rng
        self.language = rng.choice(list(_SYLLABLES))
        self.style = rng.choice(("plain",) * 8 + ("marks", "loud", "bars"))
        head = "<head><title>x</title><style>p{}</style><script>var t='</p>';</script></head>"
        if rng.random() < 0.1:
            # A bare text, and pages of nothing but paragraphs.
            if rng.random() < 0.3:
                return self.bare(self.paragraph(), 1)
            some = "".join(self.leaf("p", self.paragraph(), 1) for _ in range(rng.choice((1, 1, 2, 4))))
            title = self.leaf("h1", self.words(1, 10), 1) if rng.random() < 0.5 else ""
            some = self.neutral(title + some, 0.6)
            return rng.choice((f"{head}<body>{some}", some, f"<html><body>{some}</body></html>"))
        before = [r for r in ("notice", "header", "menu", "menu", "advert", "form", "sidebar") if rng.random() < 0.4]
        after = [r for r in ("comments", "share", "sidebar", "advert", "form", "notice") if rng.random() < 0.3]
        after += ["footer"] * (rng.random() < 0.85)
        top = "".join(map(self.boilerplate, before))
        tag = rng.choice(MAIN[0].split() + ["article"] * 3)
        names = self.attributes(MAIN[1], 0.5 if tag in ("article", "main") else 1.0)
        main = self.neutral(self.main(), 0.2)
        # In some layouts nothing but its text tells the article.
        body = main if rng.random() < 0.12 else f"<{tag}{names}>{main}</{tag}>"
        body = self.neutral(body, 0.35)
        if rng.random() < 0.3:
            outer = rng.choice(("main", "div", "section"))
            inside = self.boilerplate(rng.choice(("sidebar", "comments", "advert"))) if rng.random() < 0.5 else ""
            body = f"<{outer}{self.attributes('main content wrapper container layout', 0.5)}>{body}{inside}</{outer}>"
        bottom = "".join(map(self.boilerplate, after))
        return f"<!DOCTYPE html><html>{head}<body>{self.neutral(top + body + bottom, 0.3)}</body></html>"


def sample_pages(n: int = TRAINING_PAGES, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Labelled pages: the page, and 1 for each leaf block that belongs to the main text."""
    writer, pages = _Writer(seed), []
    for _ in range(n):
        marked = writer.page()
        labels = [int(_KEPT in b.text) for b in leaf_blocks(marked)]
        pages.append((marked.replace(_KEPT, "").replace(_NOT, ""), labels))
    return pages


def fit_extractor(labelled: list[tuple[str, list[int]]] | None = None) -> ChainModel:
    """Train on labelled pages; labels stand in the order of a page's leaf blocks."""
    pages = []
    for html, labels in sample_pages() if labelled is None else labelled:
        blocks = leaf_blocks(html)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        n = len(blocks)
        pages.append(([block_features(b, i, n) for i, b in enumerate(blocks)], labels))
    return train_chain(pages)


@lru_cache(1)
def default_extractor() -> ChainModel:
    return fit_extractor()


def extract_main_text(
    pages: DataFrame, html_col: str = "html", model: ChainModel | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The columns ``keep``, then ``text`` and its number of code points ``n_chars``."""
    bounded_batches(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(model or default_extractor())

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.extract(h) for h in html], dtype=object)

    html = F.coalesce(F.col(html_col), F.lit(""))
    texts = pages.select(*keep, text_of(html).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
