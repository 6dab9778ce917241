"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each has binary features of its ancestors' tags
and class names and of its text. Labelled pages come from a bounded sample of the table: pages whose markup names the
article and its surroundings, and the same blocks dressed anew in other usual layouts, where the labels are known because
the layout was made that way. The field is fitted on them and every page is decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import col

SAMPLE = 400  # expected number of pages that are fitted on
STEPS = 150
PENALTY = 0.02

# HTML's element names and common class-name words, by what they stand for.
HIDDEN = frozenset(("script style noscript template svg iframe object textarea select datalist canvas audio video annotation "
                    "annotation-xml").split())
RAW = frozenset("script style textarea iframe noscript".split())  # hidden, and their content is no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr "
                    # formulas stand in the line, but for their source
                    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
                    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics").split())
# an element that a new one of the second list ends, if it is open inside the nearest element of the third
ENDED_BY = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("select",)}
TAGS = ("nav header footer aside form article main section ul ol li table figure blockquote pre head title button dialog "
        "address h1 h2 h3 h4 h5 h6 p a dl details").split()
ASIDE_TAGS = frozenset("nav header footer aside form head title button dialog address".split())
MAIN_TAGS = frozenset("article main".split())
CLASSES = {
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead topbar top logo branding toolbar",
    "side": "sidebar side aside related recommended widget trending popular rail teaser",
    "remark": "comment comments reply replies respond disqus discussion reviews",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall login",
    "share": "share social sharing follow tags meta byline author",
    "main": "article content post entry story main body text page prose",
}
CLASS_OF = {word: kind for kind, words in CLASSES.items() for word in words.split()}
NAMES = ([f"tag {t}" for t in TAGS] + [f"class {c}" for c in CLASSES] + ["aside tag", "aside class", "main tag", "outside main"]
         + [f"length {i}" for i in range(6)] + [f"links {i}" for i in range(4)]
         + ["sentence", "copyright", "no letters", "first", "last", "inside main only", "always"])
PLACE = {name: i for i, name in enumerate(NAMES)}
_MAIN_BITS = sum(1 << PLACE[f"tag {t}"] for t in MAIN_TAGS) | 1 << PLACE["class main"]

_OPEN = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
# quotes count only where an attribute's value begins
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")  # to the next > whatever the quotes
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")


@dataclass
class Block:
    text: str
    bits: int  # features of the ancestors
    linked: int  # characters inside links


def _mark(tag: str, attributes: str) -> int:
    bits = 1 << PLACE[f"tag {tag}"] if f"tag {tag}" in PLACE else 0
    if tag in ASIDE_TAGS:
        bits |= 1 << PLACE["aside tag"]
    if tag in MAIN_TAGS:
        bits |= 1 << PLACE["main tag"]
    if attributes:
        for found in _NAMED.findall(attributes):
            for word in _WORD.findall(" ".join(found)):
                kind = CLASS_OF.get(word.lower())
                if kind:
                    bits |= 1 << PLACE[f"class {kind}"]
                    if kind != "main":
                        bits |= 1 << PLACE["aside class"]
    return bits


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; hidden elements and markup left out, references decoded, white space made single.

    Hidden elements may be nested; one that is never closed ends with the element around it. Formulas stay, without their
    source. A tag whose quotes never close ends at the next >. The time is that of a few passes over the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    seen, linked, begun, at, hidden = 0, 0, False, 0, ""
    page = page or ""

    def text(piece: str) -> None:
        nonlocal seen, linked, begun
        if piece.strip():
            if not begun:
                seen, begun = stack[-1][1], True
            if open_tags.get("a"):
                linked += len(piece)
        parts.append(piece)

    def flush() -> None:
        nonlocal linked, begun
        if parts:
            whole = " ".join(html.unescape("".join(parts)).split())
            if whole:
                out.append(Block(whole, seen, linked))
            parts.clear()
        linked, begun = 0, False

    def close(tag: str) -> None:
        while True:
            name, _ = stack.pop()
            open_tags[name] -= 1
            if name == tag:
                return

    tag_at, sections, inside, held = _TAG, True, [], Counter()  # the last two: elements open inside a hidden one
    while m := _OPEN.search(page, at):
        if m.start() > at and not hidden:
            text(page[at:m.start()])
        at = m.start()
        if page[at + 1] in "!?":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            end = page.find("]]>", at) if sections and page.startswith("<![CDATA[", at) else -1
            if end >= 0:
                if not hidden:
                    text(page[at + 9:end])
                at = end + 3
            else:
                sections = sections and not page.startswith("<![CDATA[", at)  # none ends any more
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            continue
        m = tag_at.match(page, at)
        if m is None and tag_at is _TAG:  # some quote is never closed: from here on tags end at the next >
            tag_at = _LOOSE
            m = tag_at.match(page, at)
        if m is None:  # a tag that the page's end cuts off
            at = len(page)
            break
        at = m.end()
        tag, closing, alone = m[2].lower(), bool(m[1]), m[3].endswith("/")
        if tag in RAW and not closing and not alone:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if hidden:
            if not closing:
                if tag not in VOID and not alone:
                    inside.append(tag)
                    held[tag] += 1
                continue
            if held[tag]:
                name = ""
                while name != tag:
                    name = inside.pop()
                    held[name] -= 1
                continue
            if tag == hidden:
                hidden = ""
                continue
            if not open_tags.get(tag):
                continue
            hidden = ""  # never closed, so it ends with the element around it
        if tag in HIDDEN:
            if not closing and not alone:
                hidden, inside, held = tag, [], Counter()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
        if closing:
            if open_tags.get(tag):
                close(tag)
            continue
        if tag in VOID:
            continue
        if not inline and open_tags.get("p") and tag in BLOCK_ENDS_P:
            close("p")
        elif tag in ENDED_BY and open_tags.get(tag):
            for name, _ in reversed(stack):
                if name == tag:
                    close(tag)
                    break
                if name in ENDED_BY[tag]:
                    break
        if tag == "a" and open_tags.get("a"):
            close("a")
        stack.append((tag, stack[-1][1] | _mark(tag, m[3])))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if not hidden:
        text(page[at:])
    flush()
    return out


# elements that end an open paragraph
BLOCK_ENDS_P = frozenset(("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 "
                          "h6 header hr main menu nav ol p pre section table ul").split())


def features(page: list[Block]) -> list[list[int]]:
    """Feature numbers of every block."""
    has_main = any(b.bits >> PLACE["main tag"] & 1 for b in page)
    out = []
    for i, b in enumerate(page):
        on = [k for k in range(len(TAGS) + len(CLASSES) + 3) if b.bits >> k & 1]
        n = len(b.text)
        on.append(PLACE[f"length {min(5, int(np.log2(n)) // 2 if n > 1 else 0)}"])
        on.append(PLACE[f"links {min(3, int(4 * b.linked / n))}"])
        if has_main and not b.bits >> PLACE["main tag"] & 1:
            on.append(PLACE["outside main"])
        if b.bits & _MAIN_BITS and not b.bits >> PLACE["aside tag"] & 1 and not b.bits >> PLACE["aside class"] & 1:
            on.append(PLACE["inside main only"])
        if b.text[-1] in ".!?…。:\"”»":
            on.append(PLACE["sentence"])
        if "©" in b.text or "copyright" in b.text.lower():
            on.append(PLACE["copyright"])
        if not any(c.isalpha() for c in b.text):
            on.append(PLACE["no letters"])
        if i == 0:
            on.append(PLACE["first"])
        if i == len(page) - 1:
            on.append(PLACE["last"])
        on.append(PLACE["always"])
        out.append(on)
    return out


# labelled pages

def named_labels(page: list[Block]) -> list[int] | None:
    """1 for blocks that the markup names part of the article; None if it names no article."""
    own = [int(bool(b.bits >> PLACE["main tag"] & 1) and not b.bits >> PLACE["aside tag"] & 1
               and not b.bits >> PLACE["aside class"] & 1) for b in page]
    return own if any(own) and not all(own) else None


# Usual layouts; M is where article blocks go, B a block of its surroundings.
LAYOUTS = (
    "<div id=header>B</div><div class=menu><ul><li><a href=#>B</a><li><a href=#>B</a></ul></div><div id=content>M</div>"
    "<div class=sidebar><h3>B</h3><p>B</p></div><div id=comments><p>B</p><p>B</p></div><div id=footer>B</div>",
    "<header><a href=#>B</a></header><nav><a href=#>B</a> <a href=#>B</a></nav><main>M<section class=comments><p>B</p><p>B"
    "</p></section></main><aside><p>B</p></aside><footer><p>B</p></footer>",
    "<div class='cookie-notice'><p>B</p><button>B</button></div><article><div class=byline>B</div>M<div class=ad>B</div>M"
    "<form><label>B</label></form><aside class=related><h4>B</h4><a href=#>B</a></aside></article><footer>B</footer>",
    "<table><tr><td class=nav><a href=#>B</a><td><p><a href=#>B</a></p></td></tr></table>M<div class=copyright>B</div>",
    "<ul><li><a href=#>B</a></li><li><a href=#>B</a></li><li><a href=#>B</a></li></ul>M<p><a href=#>B</a></p><p>© B</p>",
    "<div class=topbar><a href=#>B</a></div><div class='entry-content'>M</div><div class='share social'><a href=#>B</a></div>"
    "<div class='newsletter signup'><form><p>B</p></form></div><section id=respond><p>B</p></section>",
    "<div class=wrapper><div class=banner>B</div><div class=story>M<blockquote>M</blockquote></div></div><footer>B</footer>",
)


def dressed(page: list[Block], labels: list[int], layout: str) -> tuple[list[Block], list[int]]:
    """The page's blocks in another layout, with their labels."""
    main = [b.text for b, y in zip(page, labels) if y]
    rest = [b.text for b, y in zip(page, labels) if not y] or ["more"]
    places = layout.count("M")
    share = -(-len(main) // places)
    shown, k, out = iter(range(places)), 0, []
    for c in re.split("(?<![A-Za-z])([MB])(?![A-Za-z])", layout):
        if c == "M":
            i = next(shown)
            out += [f"<{'h2' if i == j == 0 else 'p'}>\x01{html.escape(t)}</p>" if j or i else f"<h1>\x01{html.escape(t)}</h1>"
                    for j, t in enumerate(main[i * share:(i + 1) * share])]
        elif c == "B":
            out.append(html.escape(rest[k % len(rest)]))
            k += 1
        else:
            out.append(c)
    made = blocks("".join(out))
    marks = [int("\x01" in b.text) for b in made]
    for b in made:
        b.text = b.text.replace("\x01", "") or " "
    return made, marks


# the field

def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, on in enumerate(rows):
        x[i, on] = 1
    return x


def fit(pages: list[tuple[list[list[int]], list[int]]]) -> np.ndarray:
    """Feature weights for label 1 against 0, then the four transition weights, by Adam on the penalised likelihood."""
    width = len(NAMES)
    longest = max(len(y) for _, y in pages)
    n = len(pages)
    x, y, there = np.zeros((n, longest, width), dtype=np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (rows, labels) in enumerate(pages):
        x[k, :len(labels)], y[k, :len(labels)], there[k, :len(labels)] = _matrix(rows, width), labels, True
    w, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    pairs = there[:, 1:]
    gold = np.bincount((2 * y[:, :-1] + y[:, 1:])[pairs], minlength=4)
    for step in range(1, STEPS + 1):
        turn = w[width:].reshape(2, 2)
        node = np.zeros((n, longest, 2))
        node[:, :, 1] = x @ w[:width]
        fwd, bwd = node.copy(), np.zeros_like(node)
        for t in range(1, longest):
            fwd[:, t] = node[:, t] + np.logaddexp(fwd[:, t - 1, :1] + turn[0], fwd[:, t - 1, 1:] + turn[1])
            fwd[~there[:, t], t] = fwd[~there[:, t], t - 1]
        for t in range(longest - 2, -1, -1):
            ahead = node[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(there[:, t + 1, None], np.logaddexp(ahead[:, :1] + turn[:, 0], ahead[:, 1:] + turn[:, 1]), 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p_one = np.where(there, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None]), 0)
        both = (fwd[:, :-1, :, None] + turn + (node + bwd)[:, 1:, None, :] - total[:, None, None, None])
        expected = np.exp(np.where(pairs[:, :, None, None], both, -np.inf)).sum(axis=(0, 1)).ravel()
        gradient = np.concatenate([np.einsum("ntf,nt->f", x, y * there - p_one), gold - expected]) - PENALTY * n * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        w = w + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


def viterbi(rows: list[list[int]], w: np.ndarray) -> list[int]:
    """The likeliest labels."""
    width = len(NAMES)
    (aa, ab), (ba, bb) = w[width:].reshape(2, 2).tolist()
    weights = w.tolist()
    zero, one, back = 0.0, 0.0, []
    for t, on in enumerate(rows):
        gain = sum(weights[i] for i in on)
        if t:
            from_zero, from_one = (zero + aa < one + ba), (zero + ab < one + bb)
            zero, one = max(zero + aa, one + ba), max(zero + ab, one + bb) + gain
            back.append((from_zero, from_one))
        else:
            one = gain
    label, out = int(one > zero), []
    for step in reversed(back):
        out.append(label)
        label = int(step[label])
    return ([*out, label] if rows else [])[::-1]


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on about ``sample`` pages picked by hash of their text, whatever the size of the table."""
    pages = pages.select(col(html_col).cast("string").alias("html"))
    rate = min(1.0, sample / max(1, pages.count()))
    picked = pages.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = sorted(t for batch in batches for t in batch["html"] if t)
        made = []
        for k, page in enumerate(map(blocks, texts)):
            page = page[:500]  # of the sample only: longer pages teach nothing more
            labels = named_labels(page)
            if labels:
                made.append((features(page), labels))
                other, marks = dressed(page, labels, LAYOUTS[k % len(LAYOUTS)])
                made.append((features(other), marks))
        if made:
            yield pd.DataFrame({"w": [fit(made).tobytes()]})

    model = picked.repartition(1).mapInPandas(solve, "w binary").first()
    if model is None:  # no page names its article: only the layouts are left to learn from
        seeds = [[Block(t, 0, 0) for t in ("Menu", "Home", "A first sentence of the article, long enough to read.",
                                            "A second one follows it and goes on for a while.", "Imprint")]]
        return fit([(features(p), y) for s in seeds for p, y in (dressed(s, [0, 0, 1, 1, 0], x) for x in LAYOUTS)])
    return np.frombuffer(model["w"])


def main_text(page: str | None, w: np.ndarray) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, viterbi(features(found), w)) if y)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", n_chars: str = "n_chars",
            sample: int = SAMPLE) -> DataFrame:
    """``pages`` with their main text and its length in code points; columns of these names are replaced.

    Null and empty pages, and pages without an article, have an empty text. Repeated rows share theirs. An empty table
    gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, html_col, sample))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(t, shared.value) for t in series], dtype=object)

    return pages.withColumn(text_col, text(col(html_col).cast("string"))).withColumn(n_chars, F.length(col(text_col)).cast("long"))
