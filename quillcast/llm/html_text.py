"""Main text of web pages: flat text blocks, classified by a decision tree on shallow text features.

A page becomes a list of blocks (the text between block-level tags). For each block there are its words and
link density, those of the blocks before and after it, and whether it is a heading. Markup adds what it says of
the part of the page in which the block stands (content, surroundings or nothing), how many of the page's words outside
of links are in that part, and whether any are in named content. Names are features like the
others: a frame that is called a sidebar but holds the page's words is not dropped for its name. Where names say
nothing the shape of the page does: whether the block, and the one before and after it, stands in the page's core,
the innermost element that holds most of the words: see core_of(). A small decision tree, grown from the labelled
pages below when the operator is called, decides block by block.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcast.llm.common import table

#: HTML elements that start and end a block, whose text is never shown, and that are parts of a page.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul""".split())
HIDDEN = set("head script style noscript template svg iframe object canvas select textarea button title audio video math datalist".split())
RAW = set("script style textarea title noscript template iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AROUND = set("nav footer aside form menu dialog header".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Parts of class, id and role names, our own choice: for the content, for surroundings, for answers to the content, and those that
#: only say where or how. A name counts if each of its parts is in a list: `author-box` does, `author-analysis` doesn't.
CONTENT_WORDS = set("article articlebody body content entry hentry main post postbody story storybody text".split())
ANSWER_WORDS = set("comment comments commentlist commentarea commentform discussion disqus feedback reactions replies reply respond".split())
AROUND_WORDS = ANSWER_WORDS | set("""ad ads adv advert adverts advertisement alert author banner breadcrumb breadcrumbs byline consent contentinfo cookie cookies dialog foot footer footnav
form gdpr header infobar login masthead menu menubar meta modal nav navbar navigation newsletter notice notification pager pagination popup popular promo promoted promotion recommended
related search share sharing shop sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar topbar tracking trending widget widgets""".split())
OTHER_WORDS = set("area bar block bottom box buttons column container field fixed global group icons info inner item items left link links list local message page panel posts primary reader readers right row secondary section site slot top unit user users wrap wrapper".split())

#: Elements that may be the core of a page, and the share of the page's words that makes one of them the core.
FRAMES = set("article body center div form html main section table tbody tr".split())
CORE = 0.5

#: Elements whose names may say that they hold the content.
CONTAINERS = set("div section table center form".split())
#: What can stand in a head.
IN_HEAD = set("title meta link base basefont bgsound script style noscript noframes template".split())

#: Words that say of the page that it has a part, and marks of what isn't shown.
ABOUT_PAGE = re.compile(r"\b(?:has|have|with|without|no|is|show|hide)[_-]\w+", re.I)
NOT_SHOWN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)(?:>|(?=<)|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: The labelled pages, one in a line. A block is the element it stands in, its words, words in links, h for a heading and + for main
#: text. Elements: c an article, a, b and d surroundings, x comments, u, v and w elements whose names say nothing, n the body itself.
LABELLED = """
a1/1 a1/1 a1/1 b12 c7h+ c9+ c60+ c3+ c85+ c25+ d10
a2/2 a3/3 c8h+ c40+ c4/4+ c5/5+ c3/3+ c33+ x40 x90 x3h d16/4
n3/3 n2/2 n4/4 n8h+ n85+ n40+ n12+ n60+ n6+
n1/1 n1/1 n9h+ n120+ n5h+ n70+ n4/4 n3/3 n2/2
a5 c4+ n110+ n95+ n6h+ n150+ n4/4 n3/3
a3/3 a7h+ a60+ a45+ a8+ a90+ b20 b3/3
a2/2 n6h+ c200+ c150+ n180+ n10 n3/3 b9
n7h+ c60+ c80+ c45+ n4 n3/3 b5
n3/3 n4/4 n2/2 n5/5
n65+
n7+
n16 n2/2 n3/3 n7h+ n48+ n75+ n30/3+ n22+
a30 a40 c6h+ c14+ c11+ b25 c20+ c9+ x120 x200 x60
c12+ a150 a80
n4/4 n5h+ n18+ n22+ n15+ n9+ n3 n2/2 n2/2
a12 a4/4 c5h+ c2+ c1+ c70+ c6/3+ c14/4+ c11/10+ b8
n2/2 n3/3 n30/28 n40/36 n6h+ n55+ n35+ n25/20 n14/9
a5h+ a40+ a12+ a33+ b4/4 x30
a200 a150 c90+ c120+ c8+ n5 n4
x20 x60 x200 n9h+ n110+ n80+
c2h+ c300+ a300 b12h b90 n3 n2/2
a1/1 a90 a60/10 b5h b40 c5h+ c2/2+ c1/1+ c30+
n2/2 n3/3 n2h+ n50+ n40+ n3h+ n64+ n4+
n1h+ n45+ n52+
n1/1 n1/1 n3h+ n70+ n62+ n58+ n1/1 n3/3
n3/3 n1h+ n90+ n2+ n80+ n6/6
n3 n2/2 n4h+ n35+ n28+ n4 n2/2
a40+ a41+
n3h+ c80+ c80+
n3h+ c30+ c70+ c12+ n3
a7h+ a60+ a80+ n3/3
v11 c5h+ c12+ c21+ c6+
v9 c5h+ c40+ c49+ c20+ v7
v11 c4h+ c90+ c99+ c45+ w9
v14 u8h+ u60+ u45+ u30+ w8
c6h+ c90+ c70+ c80+ v3h v30 v20 v40
c5h+ c40+ c49+ c20+ v30 v20
c3h+ c60+ c70+ c12+ v2h v44
u6h+ u40+ u50+ u20+ u30+ v31 v21 v11
n7h+ u60+ u80+ u12+ v6 w3/3
v2/2 v3/3 u5h+ u30+ u8+ u44+ w9 w2/2
u4h+ u15+ u12+ u20+ u9+ v8
v10 u70+ u66+ u5+ u80+ w12 x25
n9h+ u25+ u30+ u10/2+ v7
c30+ c25+ v8
v4h v20 c7h+ c80+ c75+ c9+
n3h+ n20+ n15+ n9+
n5h+ n40+ n12+ n35+
c4h+ c90+ c80+ c100+ b150 b90
c5h+ c40+ c60+ a80 a3/3
c70+ c65+ c80+ b190
c41+ c39+ c45+ c52+ c44+ c40+ n230+
u5h+ u90+ u80+ u95+ u100+ n250+ v9
a8h+ a150+ a180+ a130+ b6
a200+ a160+ a140+ n3/3
n4h+ a170+ a220+ b9
"""

#: How an element of the labelled pages is written.
WRITTEN = {"c": "article", "a": "aside", "b": "footer", "d": "nav", "x": 'section class="comments"', "u": 'div class="u"', "v": 'div class="v"', "w": 'div class="w"', "n": ""}


def labelled_page(line: str) -> tuple[str, list[int]]:
    """A line of the labelled pages as html, and the labels of its blocks."""
    page, labels, at = [], [], "n"
    for part, words, linked, heading, kept in re.findall(r"([a-z])(\d+)(?:/(\d+))?(h?)(\+?)", line):
        if part != at:
            page += [f"</{WRITTEN[at].split()[0]}>" if WRITTEN[at] else "", f"<{WRITTEN[part]}>" if WRITTEN[part] else ""]
            at = part
        tag, k = "h2" if heading else "p", int(linked or 0)
        page.append(f"<{tag}><a>{'w ' * k}</a> {'w ' * (int(words) - k)}</{tag}>")
        labels.append(int(bool(kept)))
    return "".join(page), labels


def labelled_rows() -> np.ndarray:
    """The labelled table: a row of features and a label for each block of the labelled pages."""
    out = []
    for page, labels in map(labelled_page, LABELLED.split("\n")):
        if labels:
            out.append(np.column_stack([features(*text_blocks(page)[1:]), labels]))
    return np.concatenate(out)


def grow(rows: np.ndarray, depth: int = 8) -> dict | int:
    """A decision tree by Gini impurity: {"feature", "at", "low", "high"} or a label. Ties go to the first feature and the lowest place."""
    y = rows[:, -1]
    if depth == 0 or len(set(y)) < 2:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low, high = y[rows[:, f] <= at], y[rows[:, f] > at]
            gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(at))
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, at = best
    side = rows[:, f] <= at
    return {"feature": f, "at": at, "low": grow(rows[side], depth - 1), "high": grow(rows[~side], depth - 1)}


def decide(tree: dict | int, x: np.ndarray) -> np.ndarray:
    """Labels of the rows of x."""
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    out = np.empty(len(x), bool)
    side = x[:, tree["feature"]] <= tree["at"]
    out[side], out[~side] = decide(tree["low"], x[side]), decide(tree["high"], x[~side])
    return out


def ends_of(page: str, name: str) -> dict[int, int]:
    """Where each element of a name ends, by where its start tag ends; one without an end tag is left out."""
    ends, begun = {}, []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(/?)({name})(?![^\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", page, re.I | re.S):
        if not m[2] or (not m[1] and m[3].endswith("/")):
            continue
        if not m[1]:
            begun.append(m.end())
        elif begun:
            ends[begun.pop()] = m.end()
    return ends


def meaning(named: str) -> tuple[int, bool]:
    """What names say of an element, (1 content, -1 surroundings, 0 neither; whether it holds answers)."""
    kind, answers = 0, False
    for name in named.split():
        parts = {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}
        if not parts or not parts <= CONTENT_WORDS | AROUND_WORDS | OTHER_WORDS:
            continue
        around, content = parts & AROUND_WORDS, parts & CONTENT_WORDS
        if around and not (content and around == {"header"}):
            kind, answers = -1, answers or bool(around & ANSWER_WORDS)
        elif content and not around and kind == 0:
            kind = 1
    return kind, answers


def parts_of(nodes: list[tuple[int, str, str, bool]], words: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """The part of the page in which each element (parent, name, names, shown) stands; for each part its kind (1 named content,
    -1 surroundings, 0 neither) and whether it can't be the page's frame (answers, and what isn't shown).

    Part 0 is neither, part 1 is all content; surroundings are parts of their own. Within surroundings article and main
    are content again if the surroundings hold most of the words of the page, in or out of them, and no answers."""
    within, all_words = list(words), sum(words)
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k][0] >= 0:
            within[nodes[k][0]] += within[k]
    part, kinds, never, root = [], [0, 1], [False, False], [0, 0]
    for k, (parent, name, named, shown) in enumerate(nodes):
        at = part[parent] if parent >= 0 else 0
        said, answers = meaning(named)
        if name in ("article", "main"):
            said = said or 1
        elif name in ("html", "body") or (said == 1 and name not in CONTAINERS):
            said = 0
        elif name in AROUND and not (name == "header" and at == 1):
            said = -1
        if not shown or said == -1:
            kinds.append(-1)
            never.append(not shown or answers or (kinds[at] == -1 and never[at]))
            root.append(k)
            at = len(kinds) - 1
        elif said == 1 and (kinds[at] != -1 or (name in ("article", "main") and not never[at] and 2 * within[root[at]] >= all_words)):
            at = 1
        part.append(at)
    return part, kinds, never


def core_of(nodes: list[tuple[int, str, str, bool]], words: list[int], blocks: list[int]) -> list[bool]:
    """For each element, whether it is in the core of the page: the innermost of FRAMES that holds a CORE of all words (`words`, and
    `blocks` of text, by element) and either is an article or main or has two blocks. One that has others like it
    beside it is no core but a part of one: articles and sections, elements of the same name and class, and those without a class
    if the others hold a quarter of its words. Nor is one a core that has a third of its words before it, as comments on a short text."""
    within, count, children = list(words), list(blocks), {}
    for k in range(len(nodes) - 1, 0, -1):
        within[nodes[k][0]] += within[k]
        count[nodes[k][0]] += count[k]
        children.setdefault(nodes[k][0], []).append(k)
    core, least = 0, CORE * within[0]
    alike = lambda k: (nodes[k][1], nodes[k][1] in ("article", "section") or nodes[k][2])
    while True:
        most = max(children.get(core, ()), key=lambda k: within[k], default=None)
        if most is None or not within[most] or within[most] < least or nodes[most][1] not in FRAMES or (count[most] < 2 and nodes[most][1] not in ("article", "main")):
            break
        others = sum(within[k] for k in children[core] if k != most and alike(k) == alike(most))
        before = sum(within[k] for k in children[core] if k < most)
        if (others and (alike(most)[1] or 4 * others >= within[most])) or 3 * before >= within[most]:
            break
        core = most
    inside = [core == 0]
    for k in range(1, len(nodes)):
        inside.append(k == core or inside[nodes[k][0]])
    return inside


def text_blocks(page: str) -> tuple[list[str], list[tuple[int, int, int, int, bool]], list[int], list[bool]]:
    """The blocks of a page: their texts, (words, words in links, heading, part, in the core), and kind and frame of each part: see
    parts_of() and core_of()."""
    texts: list[str] = []
    facts: list[tuple[int, int, int, int]] = []  # at first with the element in place of its part
    nodes: list[tuple[int, str, str, bool]] = [(-1, "", "", True)]
    stack: list[int] = [0]  # open elements
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "heading": 0}
    opened: Counter[str] = Counter()
    ends: dict[str, dict[int, int]] = {}

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            texts.append(text)
            facts.append((text.count(" ") + 1, state["linked"], state["heading"], stack[-1]))
        state["linked"] = 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text.split())

    at, n, head = 0, len(page), False
    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            if not head:
                add(page[at:])
            break
        if not head and m.start() > at:
            add(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        name, end = m[2].lower(), bool(m[1])
        if head:
            if end:
                head = name not in ("head", "body", "html")
                continue
            head = name in IN_HEAD or name == "head"
        if not end and name in HIDDEN and not m[0].endswith("/>"):
            if name in RAW:
                to = re.compile(rf"</{name}(?![a-z0-9])[^>]*>?", re.I).search(page, at)
                at = to.end() if to else n
            elif name == "head":
                head = True
            else:
                # Without an end tag it would hide the rest of the page.
                if name not in ends:
                    ends[name] = ends_of(page, name)
                at = ends[name].get(at, at)
            continue
        if head:
            continue
        if name == "a":
            state["link"] = 0 if end else 1
            continue
        if name in ("br", "td", "th"):
            parts.append(" ")
        if name not in BLOCKS:
            continue
        close()
        if name in HEADINGS:
            state["heading"] = 0 if end else 1
        if name in VOID or m[0].endswith("/>"):
            continue
        if end:
            # An end tag of nothing that is open is passed over; another one ends all that was opened after its element.
            while opened[name]:
                last = nodes[stack.pop()][1]
                opened[last] -= 1
                if last == name:
                    break
            state["link"] = 0
        else:
            named = " ".join(filter(None, (a or b or c for a, b, c in NAMES.findall(m[3])))) if m[3] else ""
            if name == "p":
                # A new paragraph ends an open one.
                while len(stack) > 1 and nodes[stack[-1]][1] == "p":
                    opened[nodes[stack.pop()][1]] -= 1
            nodes.append((stack[-1], name, ABOUT_PAGE.sub("", named), not NOT_SHOWN.search(m[3])))
            stack.append(len(nodes) - 1)
            opened[name] += 1
    close()
    words, blocks = [0] * len(nodes), [0] * len(nodes)
    for w, linked, _, k in facts:
        words[k] += max(w - linked, 0)
        blocks[k] += 1
    part, kinds, never = parts_of(nodes, words)
    # Words in surroundings don't make a core, unless they are most of the page's.
    free = [0 if kinds[p] == -1 else w for w, p in zip(words, part)]
    inside = core_of(nodes, free if 2 * sum(free) >= sum(words) else words, blocks)
    return texts, [(w, linked, heading, part[k], inside[k]) for w, linked, heading, k in facts], kinds, never


def features(facts: list[tuple[int, int, int, int, bool]], kinds: list[int], never: list[bool]) -> np.ndarray:
    """A row for each block of one page: words, link density, both of the block before and of the one after, heading, kind of
    its part, the part's share of the words outside of links (0 where it can't be the frame), whether the block, the one
    before and the one after are in the core, and whether there are words in named content."""
    f = np.array(facts, float).reshape(-1, 5)
    part = f[:, 3].astype(int)
    words, density = f[:, 0], np.minimum(f[:, 1] / np.maximum(f[:, 0], 1), 1)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k < 0 else np.concatenate([v[1:], [0.0]])
    free = np.maximum(words - f[:, 1], 0)
    share = np.bincount(part, free, len(kinds)) / max(free.sum(), 1)
    kind = np.array(kinds, float)
    named = np.full(len(f), share[kind == 1].sum() > 0)
    share[np.array(never)] = 0
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), f[:, 2], kind[part], share[part], f[:, 4], shift(f[:, 4], -1), shift(f[:, 4], 1), named])


def main_text(page: str, tree: dict | int) -> str:
    """The blocks of a page that the tree keeps, in page order, joined by an empty line."""
    texts, facts, kinds, never = text_blocks(page)
    if not texts:
        return ""
    return "\n\n".join(t for t, ok in zip(texts, decide(tree, features(facts, kinds, never))) if ok)


def _extract(tree: dict | int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            pages = batch.column(names.index("html"))
            out = pa.array([main_text(p.as_py() or "", tree) for p in pages], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k, n in enumerate(names) if n != "html"), out], names=[*(n for n in names if n != "html"), "text"])

    return run


def extract_text(pages: DataFrame, *keys: str) -> DataFrame:
    """`keys` and text for every row of pages(html); text is '' if nothing is kept, as for a null or empty page.

    White space within a block becomes one space, character references are decoded, an unclosed tag or
    comment ends at the next tag or the end, and nothing else is dropped or capped."""
    rows = pages.select(*keys, "html")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), "text string"])
    return rows.mapInArrow(_extract(grow(labelled_rows())), schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"), "page_id", "url")
    return found.withColumn("n_chars", F.length("text").cast("long"))
