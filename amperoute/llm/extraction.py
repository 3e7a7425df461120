"""Main-text extraction: flat text blocks, their word counts and link densities, and a decision tree.

A page is cut into blocks at block-level tags. A block's features are its own and its neighbours' word counts and
link densities, and what encloses it: an article or main element, and page furniture by element name or by class and id
words. A decision tree, trained here on a small labelled table of page sketches, tells main text from the rest.

Defined results: null and empty html, and pages without main text, give an empty text; malformed or unclosed
markup is read leniently to its end; repeated rows are extracted each. Extra columns stay inside ``row``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import packed, travels

travels(__name__)

# Comments, tags (attribute values quoted right behind "=" may hold ">"), declarations.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z][^<>]*>",
    re.S | re.I,
)
# Elements whose content is no text, and their next tag: its end; where they cannot nest, another start ends the search.
UNREAD = {name: re.compile(rf"<(/){name}\s*>", re.I) for name in "script style noscript template svg iframe object textarea math".split()}
UNREAD |= {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I) for name in ("select", "button")}
TO_THE_END = frozenset(("script", "style"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = frozenset(("article", "main"))
FURNITURE = frozenset("nav footer aside form head dialog menu".split())
# What holds the whole page: words in its attributes tell of its layout.
WHOLE_PAGE = frozenset(("html", "body"))
NESTING = MAIN | FURNITURE | frozenset("header div section ul ol table dl details figure fieldset body td tr".split())
FURNITURE_WORDS = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|masthead|top-?bar|cookie\w*|consent|notice|popup|modal"
    r"|newsletter|subscri\w*|sign-?up|log-?in|share|sharing|social|related|recommend\w*|comments?|comment-\w+|disqus|replies|reply|respond|widget|pagination|pager|toolbar|search|copyright|legal)(?![a-z])",
    re.I,
)
# Whole class names of what readers wrote and of what points to other articles: an article in there is no main text.
OTHER_ARTICLES = re.compile(r"comments?|comment-?list|comments?-(?:area|section|thread|body|list|wrap\w*)|replies|respond|disqus\w*|related(?:-\w+)?|recommend\w*", re.I)
MAIN_WORDS = re.compile(r"(?<![a-z])(?:article|article-?body|post-?body|post-?content|entry-?content|main-?content|story|story-?body)(?![a-z])", re.I)
NAMED = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
FEATURES = ("in_main", "in_furniture", "page_has_main", "words", "link_density", "words_before", "density_before", "words_after", "density_after")


def _kind(name: str, attributes: str, inside_main: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element opens main text, page furniture by its name, or by its words (or a form), or others' articles."""
    said = " ".join(NAMED.findall(attributes)) if "=" in attributes and name not in WHOLE_PAGE else ""
    named = (name in FURNITURE and name != "form") or (name == "header" and not inside_main)
    worded = name == "form" or bool(said and FURNITURE_WORDS.search(said))
    main = name in MAIN or (not named and not worded and bool(said and MAIN_WORDS.search(said)))
    other = worded and any(OTHER_ARTICLES.fullmatch(word) for word in re.split(r"[\s\"']+", said))
    return main, named, worded, other


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, linked words, in main, in furniture) of each block with a word, in page order."""
    out, parts, linked, links = [], [], 0, 0
    # Element, and the depths around it of main, furniture by name, furniture by words, that within main, articles, others' articles.
    open_: list[tuple[str, int, int, int, int, int, int]] = []
    main = named = worded = within = articles = others = at = 0
    seen = False  # an article before

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), main > 0, named + worded > 0))
            parts, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            read = entities.unescape(raw) if "&" in raw else raw
            parts.append(read)
            if links:
                linked += len(read.split())

    unclosed: set[str] = set()  # elements without a further end tag
    while token := TOKEN.search(page, at):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        if name in UNREAD and not token[1]:
            if name in TO_THE_END or not token[3].endswith("/"):
                end = None if name in unclosed else UNREAD[name].search(page, at)
                if end is None:
                    unclosed.add(name)
                    at = len(page) if name in TO_THE_END else at
                elif end[1]:
                    at = end.end()
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if token[1] else 1
            elif name == "br":
                parts.append(" ")
            continue
        close()
        links = 0
        if name not in NESTING:
            continue
        if token[1]:
            if any(e[0] == name for e in open_):
                while True:
                    gone, main, named, worded, within, articles, others = open_.pop()
                    if gone == name:
                        break
        elif not token[3].endswith("/"):
            opens_main, opens_named, opens_worded, opens_others = _kind(name, token[3], main > 0)
            own = not (others or opens_others)
            if name in MAIN and not articles and own:
                # What holds an article and was taken for furniture by its words is layout, unless it follows an article in main.
                if not (within and seen):
                    worded = within = 0
                opens_worded = opens_worded and seen
            open_.append((name, main, named, worded, within, articles, others))
            others += opens_others
            if opens_named:
                named += 1
            elif opens_worded:
                worded, within = worded + 1, within + (main > 0)
            elif opens_main:
                main += 1
            if name in MAIN and own:
                articles, seen = articles + (name == "article"), seen or name == "article"
    if at < len(page):
        text(page[at:])
    close()
    return out


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    own = np.array([(w, linked / w) for _, w, linked, _, _ in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    flags = np.array([(m, f) for *_, m, f in found], float).reshape(-1, 2)
    has_main = np.full((len(found), 1), float(any(m for *_, m, _ in found)))
    return np.hstack([flags, has_main, own, np.vstack([edge, own[:-1]])[: len(own)], np.vstack([own[1:], edge])[: len(own)]])


# The labelled table: page sketches whose blocks begin with "+" if they are main text, "-" if not. A number is so
# many filler words, "@" links the words that follow it.
SKETCHES = (
    "<nav><ul><li>-@1</li><li>-@2</li><li>-@1</li></ul></nav><div class=ad>-12</div><article><h1>+8</h1><p>+40</p><p>+2</p><p>+90</p></article><footer>-9</footer>",
    "<header>-3</header><nav>-@6</nav><main><h1>+5</h1><p>+60</p><p>+1</p><div class=related>-@7</div><p>+33</p></main><aside>-30</aside><footer>-4 @5</footer>",
    "<div class=cookie-notice>-25</div><article><p>+70</p><blockquote>+18</blockquote><p>+3</p><div class=share>-@4</div></article><section class=comments><p>-35</p><p>-12</p></section>",
    "<div id=menu>-@8</div><div><h2>+6</h2><p>+55</p><p>+80</p><p>+24</p></div><div id=sidebar><p>-22</p><p>-@9</p></div><div class=footer>-14</div>",
    "<ul><li>-@2</li><li>-@3</li><li>-@2</li></ul><h1>+7</h1><p>+45</p><p>+64</p><p>+38</p><p>-@4</p><p>-3 @2</p>",
    "<table><tr><td>-@2</td><td>-@1</td></tr></table><p>+30</p><p>+52</p><p>+47</p><p>-2</p><div>-@5</div>",
    "<article><h1>+4</h1><p>+15</p></article><form>-16</form><div class=newsletter>-28</div><footer>-6</footer>",
    "<article><header><h1>+9</h1></header><p>+@4</p><p>+11</p><ul><li>+3</li><li>+5</li></ul><p>+120</p></article><div class=banner>-40</div>",
    "<div class=ad>-60</div><main><p>+1</p><p>+2</p><p>+1</p></main><div>-45</div><p>-33</p><footer>-31</footer>",
    "<div>-4</div><div>-@3</div><p>+42</p><p>+75</p><p>+29</p><p>+58</p><div>-5</div><div>-@6</div>",
    "<article><h1>+5</h1><p>+@3</p><p>+2 @6</p><ul><li>+@2</li><li>+@4</li><li>+1 @2</li></ul><p>+1</p><p>+30</p></article><div>-40</div><div>-12</div>",
    "<div>-9</div><main><p>+1</p><p>+30</p><p>+2</p><p>+40</p><p>+@5</p><p>+@1</p></main><p>-20</p><p>-50</p><div>-8</div><div>-15</div>",
    "<div>-20</div><div>-30</div><article><p>+1</p><p>+@8</p><p>+1</p><p>+26</p></article><div>-22</div><p>-44</p><p>-70</p>",
    "<body class=has-sidebar><div class='layout sidebar-right'><article class='post legal'><p>+9</p><p>+44</p><div class=related>-@6</div></article></div><p>-30</p></body>",
    "<p>-@1</p><p>-@1</p><p>-2</p><p>+36</p><p>+41</p><p>-1</p><p>-@2</p>",
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the sketches' blocks."""
    def fill(mark: re.Match) -> str:
        sign, plain, linked = mark[1], int(mark[2] or 0), int(mark[3] or 0)
        rest = " w" * (plain - 1 if plain else 0)
        words = f"{sign}{rest}" if plain else ""
        if linked:
            words += f" <a href=x>{sign if not plain else 'w'}{' w' * (linked - 1)}</a>"
        return f">{words}<"

    rows, labels = [], []
    for sketch in SKETCHES:
        found = blocks(re.sub(r">([+-])(\d*)\s*(?:@(\d+))?<", fill, sketch))
        rows.append(features(found))
        labels += [b[0][0] == "+" for b in found]
    return np.vstack(rows), np.array(labels)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, threshold, at or below, above), or a verdict. Ties: first feature, lowest cut."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, f] <= cut
            impurity = sum(part.sum() * labels[part].mean() * (1 - labels[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return bool(share >= 0.5)
    _, f, cut, low = best
    return f, float(cut), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def verdict(tree, row) -> bool:
    while not isinstance(tree, bool):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """The kept blocks joined by one space, the number of blocks, and of those kept."""
    found = blocks(page) if page else []
    kept = [b[0] for b, row in zip(found, features(found).tolist(), strict=True) if verdict(tree, row)] if found else []
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``row``, text, n_blocks and n_kept of every row."""
    tree = grow(*labelled_table())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                text, n_blocks, n_kept = zip(*(main_text(v.as_py(), tree) for v in part.column("html")), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(text, pa.string()), pa.array(n_blocks, pa.int32()), pa.array(n_kept, pa.int32())], ["row", "text", "n_blocks", "n_kept"]
                )

    rows = packed(pages, html=html)
    return rows.mapInArrow(extracted, rows.select("row", F.lit("").alias("text"), F.lit(0).alias("n_blocks"), F.lit(0).alias("n_kept")).schema)
