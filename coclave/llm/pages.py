"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A leaf block is the text between two borders of block-level elements. Its features are the tags, classes and ids of its
ancestors, the look of its text and its neighbours' sizes, where it stands, and telling words in it and in the heading above it;
two labels, kept or not, are chained by transition weights. The field is trained on labelled pages that a seeded generator writes
(fixed number, so the fitted weights have a fixed size), with and without names for their parts, and decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coclave.runtime import mapped, ready

MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements whose content is not text, elements without content, and elements that do not end a block.
RAW = frozenset("script style noscript template textarea svg iframe object canvas annotation".split())
#: Of these, those that a page cannot lose its rest to: without an end, or ended in their own tag, they are empty.
EMPTY = frozenset("svg object canvas annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LANDMARKS = frozenset("article aside body details dialog fieldset figure footer form head header main nav section title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
    + "math mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded semantics".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of texts that tell what a short block, or what stands under a heading, is for.
TELLING = {
    "menu": "home news sport about contact menu products services next previous categories sitemap login".split(),
    "header": "welcome portal magazine daily online skip".split(),
    "footer": "copyright rights reserved privacy terms powered imprint ©".split(),
    "sidebar": "related popular trending recent read more tags archive latest".split(),
    "notice": "cookie cookies accept consent policy subscriber javascript".split(),
    "ad": "sponsored advertisement advert ad buy sale offer discount".split(),
    "form": "subscribe newsletter email password sign register search send".split(),
    "comment": "reply replies comment comments responses wrote says report".split(),
    "share": "share tweet follow print facebook twitter".split(),
}
TOLD = frozenset(w for ws in TELLING.values() for w in ws)
#: Words beyond which a block's words tell nothing.
SHORT = 25


def leaf_blocks(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, features of its ancestors, share of its characters in links), in page order; empty blocks are left out.

    Features are the tags and the words in classes and ids of all ancestors, and again of the nearest that is a landmark or has such words.
    """
    blocks: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def close() -> None:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            own = [f for _, fs in stack for f in fs]
            mark = next((n for n, fs in reversed(stack) if n in LANDMARKS or len(fs) > 1), "")
            words = next((fs[1:] for n, fs in reversed(stack) if n in LANDMARKS or len(fs) > 1), ())
            marks = [f"mark:{mark}", *(f"mark:{w}" for w in words), f"plain:{mark}" if not words else "named"]
            blocks.append((text, tuple(dict.fromkeys([*own, "parent:" + (stack[-1][0] if stack else ""), *marks])), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)

    while (m := MARK.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        if at == len(page) and page[-1] != ">":
            return close() or blocks  # cut inside a tag
        name, ends = name.lower(), bool(m[1] or m[4])
        if name == "br":
            parts.append(" ")
        elif name in RAW and not ends:
            if name in EMPTY and (m[3] or m[6] or "").rstrip().endswith("/"):
                continue
            if (end := re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)) is not None:
                at = end.end()
            elif name not in EMPTY:
                return close() or blocks
        elif name in INLINE:
            if name == "a":
                in_link = not ends
        elif ends:
            close()
            in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            close()
            in_link = False
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option")):
                stack.pop()
            if name not in VOID:
                named = (x for x in ATTRIBUTE.finditer(m[3] or m[6] or "") if x[1].lower() in ("class", "id", "role"))
                words = [w for x in named for w in WORD.findall((x[2] or x[3] or x[4] or "").lower())]
                stack.append((name, ("in:" + name, *("word:" + w for w in words))))
    say(page[at:])
    close()
    return blocks


def features(blocks: list[tuple[str, tuple[str, ...], float]]) -> list[tuple[str, ...]]:
    """Of each block: its ancestors, its look and its neighbours' size, where it stands, the telling words in it and in the heading
    above it; the look again together with the kind of place: in an article, under names of any kind, or neither."""
    out = []
    sizes = [min(len(text).bit_length(), 9) for text, _, _ in blocks]
    most = max(sizes, default=0)
    titles = [k for k, (_, own, _) in enumerate(blocks) if "parent:h1" in own]
    above: tuple[str, ...] = ()
    for k, (text, own, links) in enumerate(blocks):
        said = set(WORD.findall(text.lower())) | ({"©"} if "©" in text else set()) if text.count(" ") < SHORT else set()
        told = sorted(said & TOLD)
        end = "ends" if text[-1] in ".!?…”\"'" else "open"
        article = "in:article" in own or "in:main" in own
        place = "article" if article else "named" if any(f[5:] in KNOWN for f in own if f.startswith("word:")) else "bare"
        look = (
            f"links:{int(links * 3.999)}",
            f"size:{sizes[k]}",
            end,
            f"words:{min(text.count(' '), 6)}",
            f"{end}:{sizes[k]}",
            f"before:{sizes[k - 1] if k else 'none'}",
            f"after:{sizes[k + 1] if k + 1 < len(blocks) else 'none'}",
            f"at:{5 * k // len(blocks)}",
            "largest" if sizes[k] == most else "smaller",
            f"quiet:{end}:{sizes[k]}" if not told and links < 0.25 else "told",
            "first" if not k else "last" if k + 1 == len(blocks) else "inner",
            "untitled" if not titles else "title" if k in titles else "over" if k < titles[0] else "beneath",
            *(f"says:{w}" for w in told),
            *(f"under:{w}" for w in above),
        )
        named = (f"article:{f}" for f in own if article and f.startswith(("word:", "mark:")))
        out.append(("bias", *own, *look, *(f"{place}/{f}" for f in look), *named))
        if any(f"parent:{h}" in own for h in HEADINGS):
            above = tuple(told)
    return out


class Field:
    """weights: feature to its part in the score of keeping a block; steps: added to the score of (before, after)."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]]):
        self.weights, self.steps = weights, steps

    def decode(self, rows: list[tuple[str, ...]]) -> list[bool]:
        """Viterbi: the best labelling of the whole page; at a tie a block is left out."""
        if not rows:
            return []
        get, ((t00, t01), (t10, t11)) = self.weights.get, self.steps
        out, kept, back = 0.0, sum(get(f, 0.0) for f in rows[0]), []
        for row in rows[1:]:
            score = sum(get(f, 0.0) for f in row)
            a, b, c, d = out + t00, kept + t10, out + t01, kept + t11
            back.append((b > a, d > c))
            out, kept = max(a, b), max(c, d) + score
        label = kept > out
        path = [label]
        for from_out, from_kept in reversed(back):
            label = from_kept if label else from_out
            path.append(label)
        return path[::-1]

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return " ".join(text for (text, _, _), keep in zip(blocks, self.decode(features(blocks)), strict=True) if keep)


#: Words that pages use to name their parts; the generator draws from them.
BODY = "article content post entry story main body text page single hentry copy prose".split()
BOILER = {
    "menu": "nav navbar navigation menu topbar breadcrumb breadcrumbs tabs toc pagination pager skip links".split(),
    "header": "header masthead branding logo tagline top banner site head".split(),
    "footer": "footer foot bottom copyright colophon legal credits imprint".split(),
    "sidebar": "sidebar aside widget rail secondary related recommended popular trending archive tags recent more".split(),
    "notice": "notice cookie cookies consent alert warning gdpr paywall privacy disclaimer popup modal message info".split(),
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner teaser affiliate adsense".split(),
    "form": "form search login signup newsletter subscribe subscription contact register".split(),
    "comment": "comment comments reply replies respond discussion disqus thread responses feedback reader".split(),
    "share": "share sharing social follow like tweet buttons tools toolbar".split(),
}
#: Words that name parts of articles as often as parts of pages; and names that say nothing.
EITHER = "message info more text top site head link links recent tags follow like tools thread reader feedback bottom legal lead note box item section panel".split()
NEUTRAL = "row col box wrap inner block container outer css grid cell left right center unit".split()
KNOWN = frozenset(BODY).union(*BOILER.values())
TAGS = {"menu": "nav nav div ul", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div section", "notice": "div div section aside dialog p", "ad": "div div aside section p", "form": "form form div", "comment": "section section div div ol article", "share": "div ul"}


def _labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and whether each of its leaf blocks belongs to the article.

    Most pages have elements or names for their parts, and then texts on both sides look alike. The others have bare or neutrally
    named boxes or table cells, and what is not the article shows by shorter texts, links, telling words and where it stands; their
    articles may be one text only. A few are nothing but an article, with or without markup.
    """
    labels: list[bool] = []
    syllables = [c + v for c in "bcdfglmnprst" for v in "aeiou"]
    style = rng.choices(("parts", "boxes", "table", "plain"), (12, 8, 3, 2))[0]

    def words(least: int, most: int, marks: tuple[str, ...] = ("", ".", ".", "!", "?")) -> str:
        said = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(least, most)))
        return said.capitalize() + rng.choice(marks)

    def telling(kind: str, text: str, share: float) -> str:
        if rng.random() >= share:
            return text
        told = rng.sample(TELLING[kind], min(len(TELLING[kind]), rng.choice((1, 1, 2, 3))))
        parts = text.split()
        for w in told:
            parts.insert(rng.randint(0, len(parts)), w if rng.random() < 0.5 else w.capitalize())
        return " ".join(parts)

    def neutral() -> str:
        return f' class="{rng.choice((rng.choice(NEUTRAL), rng.choice("abcdefgh") + str(rng.randint(1, 99))))}{rng.choice(("", "-1", "-wide", f"-{rng.choice(NEUTRAL)}"))}"' if rng.random() < 0.3 else ""

    def leaf(tag: str, text: str, keep: bool) -> str:
        labels.append(keep)
        mark = ""
        if keep:
            text = telling(rng.choice(list(TELLING)), text, 0.15 if style == "parts" else 0.05)
            if rng.random() < 0.12:
                mark = f' {rng.choice(("class", "class", "id"))}="{rng.choice(EITHER + BODY)}"'
            elif rng.random() < 0.04:
                mark = f' data-{rng.choice(("id", "class", "role"))}="{rng.choice(BOILER[rng.choice(list(BOILER))])}"'
            if rng.random() < 0.15:
                text = f"<b>{text}</b>" if rng.random() < 0.7 else f'{text} <a href="/x">{words(1, 3)}</a>.'
        return f"<{tag}{mark}>{text}</{tag}>"

    def paragraphs(least: int, most: int, keep: bool) -> str:
        return "".join(leaf(rng.choice(("p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "div")), words(*rng.choice(((1, 2), (3, 15), (15, 60)))), keep) for _ in range(rng.randint(least, most)))

    def named(kind: str, inside: bool) -> tuple[str, str]:
        tag = rng.choice(TAGS[kind].split())
        need = "div ul section article ol p".split()
        word = rng.choice([w for w in BOILER[kind] if not (inside and w in EITHER)])
        if rng.random() < 0.3:
            word += rng.choice(("-", "_", " ")) + rng.choice(("box", "wrap", "area", "inner", "list", "item", "block", "container", rng.choice(BOILER[kind])))
        mark = f' {rng.choice(("class", "class", "id"))}="{word}"' if tag in need or rng.random() < 0.5 else ""
        return tag, mark

    def boiler(kind: str, inside: bool = False) -> str:
        tag, mark = named(kind, inside)
        if tag == "p" or kind != "menu" and rng.random() < 0.35:
            labels.append(False)
            link = rng.random() < 0.3
            text = ("&copy; " if kind == "footer" and rng.random() < 0.6 else "") + telling(kind, words(2, 25), 0.3)
            return f"<{tag}{mark}>" + (f'<a href="/y">{text}</a>' if link else text) + f"</{tag}>"
        held = ""
        if kind in ("menu", "share") or rng.random() < 0.2:
            item = "li" if tag in ("ul", "ol", "nav") else rng.choice(("li", "div", "p"))
            for _ in range(rng.randint(2, 7)):
                labels.append(False)
                held += f'<{item}><a href="/z">{telling(kind, words(1, 3), 0.3)}</a></{item}>'
            held = f"<ul>{held}</ul>" if item == "li" and tag not in ("ul", "ol") else held
        elif kind == "form":
            for _ in range(rng.randint(1, 3)):
                labels.append(False)
                held += f"<div><label>{telling(kind, words(1, 3), 0.4)}</label><input name=q></div>"
            labels.append(False)
            held += f"<button>{words(1, 2)}</button>"
        elif kind == "comment":
            for _ in range(rng.randint(1, 4)):
                a = rng.choice(("div", "li", "article"))
                held += f'<{a} class="{rng.choice(BOILER[kind])}">' + leaf("p", words(3, 40), False) + f"</{a}>"
        else:
            held = paragraphs(1, 3, False)
            if kind == "header" and rng.random() < 0.4:
                held = leaf("h1", words(1, 4), False) + held
        return f"<{tag}{mark}>{held}</{tag}>"

    def bare(kind: str) -> str:
        """What boiler() writes, without an element or a name that says what it is."""
        box = rng.choice(("div", "div", "p")) if kind not in ("menu", "comment", "sidebar") else "div"
        if kind == "menu" and rng.random() < 0.6:
            several = rng.choice((True, False))
            items = [telling(kind, words(1, 2, ("",)), 0.6) for _ in range(rng.randint(2, 7))]
            labels.extend([False] * (len(items) if several else 1))
            items = [f'<a href="/z">{i}</a>' for i in items] if rng.random() < 0.6 else items
            return f"<div{neutral()}>" + ("".join(f"<div>{i}</div>" for i in items) if several else rng.choice((" ", " | ", " &middot; ")).join(items)) + "</div>"
        if kind in ("comment", "sidebar"):
            head = leaf(rng.choice(("h2", "h3", "h4", "div")), " ".join(w.capitalize() for w in rng.sample(TELLING[kind], rng.choice((1, 1, 2)))), False)
            many = rng.randint(1, 4)
            inside = "".join(leaf("p", words(3, 30), False) if kind == "comment" else (labels.append(False) or f'<div><a href="/r">{words(2, 8)}</a></div>') for _ in range(many))
            return f"<div{neutral()}>{head}{inside}</div>"
        if kind == "form":
            labels.append(False)
            return f"<div{neutral()}>{telling(kind, words(0, 4, ('', ':')), 0.9)} <input name=q></div>"
        labels.append(False)
        text = telling(kind, words(1, 3 if kind == "header" else 9, ("", "", ".")), 0.2 if kind == "header" else 0.9)
        if kind == "footer":
            text = rng.choice(("&copy; 2024 ", "Copyright 2019 ", "Copyright &copy; ", "")) + text + rng.choice(("", " All rights reserved", " All rights reserved."))
        if style == "table" and rng.random() < 0.4:  # the cell is the block
            return text + "<hr>"
        return f"<{box}{neutral()}>" + (f'<a href="/y">{text}</a>' if rng.random() < 0.3 else text) + f"</{box}>"

    def some(kinds: str, share: float, inside: bool = False) -> str:
        return "".join(boiler(k, inside) if style == "parts" else bare(k) for k in kinds.split() if rng.random() < share)

    def article() -> str:
        title = leaf("h1", words(1, 12), True) if rng.random() < (0.85 if style == "parts" else 0.55) else ""
        text = title
        if style == "parts":
            text = f"<header>{title}</header>" if title and outer == "article" and rng.random() < 0.1 else title
            text += some("share notice ad", 0.12, True)
            if rng.random() < 0.15:  # text with no element of its own
                labels.append(True)
                text += words(5, 60)
            text += paragraphs(1, 7, True)
            if rng.random() < 0.4:
                text += some("ad notice form sidebar share", 0.3, True) + paragraphs(0, 5, True)
            return text + some("share comment form ad", 0.25, True)
        count = rng.choice((1, 1, 1, 2, 2, 3, 4, 5, 6, 7))
        if count < 3:  # texts that tell themselves from what is around them
            long_ = lambda: telling(rng.choice(list(TELLING)), words(6, 60, (".", ".", ".", "?")), 0.05)
            if count == 1 and not title and rng.random() < 0.2:
                labels.append(True)
                return long_()
            return text + "".join(leaf(rng.choice(("p", "p", "div")), long_(), True) for _ in range(count))
        for _ in range(count):
            text += leaf(rng.choice(("p", "p", "p", "div", "blockquote", "li")), words(*rng.choice(((4, 12), (12, 60), (12, 60)))), True) if rng.random() < 0.9 else leaf("h2", words(1, 6, ("", "", "?")), True)
        return text

    if style == "plain":
        head = f"<html><head><title>{words(1, 8)}</title></head><body>" if rng.random() < 0.4 else rng.choice(("", "<html><body>", "<!DOCTYPE html><html><body>"))
        labels.extend([False] * ("<title>" in head))
        if rng.random() < 0.25:
            labels.append(True)
            return head + words(3, 80), labels
        return head + "".join(leaf(rng.choice(("p", "p", "div")), words(*rng.choice(((4, 12), (12, 60)))), True) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))), labels
    labels.append(False)
    page = f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>"
    if style == "table":
        page += "<table>" + (f"<tr><td colspan=2>{some('header', 1.0)}</td></tr>" if rng.random() < 0.6 else "") + "<tr>"
        left = rng.random() < 0.7
        page += f"<td{neutral()}>{some('menu menu ad', 0.7)}</td>" if left else ""
        page += f"<td{neutral()}>{article()}</td>"
        page += f"<td>{some('menu sidebar ad form', 0.5)}</td>" if not left or rng.random() < 0.3 else ""
        return page + "</tr>" + (f"<tr><td colspan=3>{some('footer footer', 0.8)}</td></tr>" if rng.random() < 0.8 else "") + "</table></body></html>", labels
    if style == "boxes":
        page += some("notice header menu ad", 0.6)
        inner = rng.choice(("div", "div", "center", ""))
        page += (f"<{inner}{neutral()}>" if inner else "") + article() + (f"</{inner}>" if inner else "")
        return page + some("sidebar comment form ad footer menu footer", 0.45) + "</body></html>", labels
    around = lambda: " ".join(rng.sample(BODY + EITHER + ["wrapper", "container", "layout"], rng.randint(1, 3)))
    if rng.random() < 0.4:  # names of the whole page say nothing of its parts
        page = page[: -len("<body>")] + f'<body class="{around()}"><div id="{around()}">'
    page += some("notice header menu ad menu form", 0.5)
    outer = rng.choice(("article", "article", "main", "div", "section"))
    mark = f' {rng.choice(("class", "id"))}="{rng.choice(BODY)}"' if outer in ("div", "section") and rng.random() < 0.9 or rng.random() < 0.3 else ""
    wrap = rng.random() < 0.4
    page += f'<div class="{rng.choice(("wrapper container", around()))}">' if wrap else ""
    page += some("menu sidebar", 0.2) if wrap else ""
    page += f"<{outer}{mark}>" + article() + f"</{outer}>"
    page += some("share sidebar comment", 0.3)
    page += "</div>" if wrap else ""
    page += some("sidebar comment ad form footer footer notice", 0.5)
    return page + "</body></html>", labels


@lru_cache(maxsize=1)
def train(pages: int = 2000, rounds: int = 100, seed: int = 9, penalty: float = 0.3) -> Field:
    """Conditional log-likelihood of the labelled pages, by gradient ascent with per-weight steps."""
    rng = random.Random(seed)
    rows, labels = [], []
    while len(rows) < pages:
        page, wanted = _labelled_page(rng)
        found = features(leaf_blocks(page))
        if len(found) == len(wanted) and found:
            rows.append(found)
            labels.append(wanted)
    names = {f: k for k, f in enumerate(sorted({f for page in rows for row in page for f in row}))}
    most = max(map(len, rows))
    inside = np.zeros((pages, most), bool)
    gold = np.zeros((pages, most), np.int64)
    for p, page in enumerate(rows):
        inside[p, : len(page)] = True
        gold[p, : len(page)] = labels[p]
    has = [sorted({names[f] for f in row}) for page in rows for row in page]
    block, feature = np.repeat(np.arange(len(has)), [len(x) for x in has]), np.concatenate(has)
    w, steps = np.zeros(len(names)), np.zeros((2, 2))
    sums = [np.full_like(w, 1e-6), np.full_like(steps, 1e-6)]
    both = inside[:, 1:] & inside[:, :-1]
    seen = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(rounds):
        score = np.zeros((pages, most, 2))
        score[..., 1][inside] = np.bincount(block, w[feature], len(has))
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, most):
            forward[:, t] = np.where(inside[:, t, None], np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1]) + score[:, t], forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            backward[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(ahead[:, :1] + steps[:, 0], ahead[:, 1:] + steps[:, 1]), 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        chance = np.exp(forward[..., 1] + backward[..., 1] - total)
        pair = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                pair[a, b] = np.exp(forward[:, :-1, a] + steps[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total)[both].sum()
        for value, slope, held in ((w, np.bincount(feature, (gold - chance)[inside][block], len(w)) - penalty * w, sums[0]), (steps, seen - pair - penalty * steps, sums[1])):
            held += slope**2
            value += 0.5 * slope / np.sqrt(held)
    return Field({f: float(w[k]) for f, k in names.items()}, steps.tolist())


def _extract(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [field.extract(page.as_py() or "") for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", field: Field | None = None) -> DataFrame:
    """(key, url, text, n_chars) for every row, from its whole page.

    Null and empty pages give an empty text; null keys and urls stay null; repeated rows give a row each; other columns are
    ignored. A page that is cut off is read up to where it ends, without the tag that it ends in.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(page).cast("string"))
    done = mapped(rows, partial(_extract, field=field or train()), "page_id long, url string, text string, n_chars long")
    return done.withColumnRenamed("page_id", key).withColumnRenamed("url", url)
