"""Main text of web pages by wrapper induction.

Pages of one host share a template. Up to ``REFERENCES`` pages per host, chosen by hash, are aligned by simple tree matching, menus, adverts and
footers included: blocks of equal tag and class are matched in order, and runs of like leaf blocks count as one node. A block text that all
references have at the matched place is template; places whose text varies are slots. At least ``ALIKE`` references that differ in most of what
varies between them are needed, so near copies of an article do not make a template of it, and constant blocks in places of their own, however
many, do not hinder it. The content of a host is the innermost place that holds ``MOST`` of the running text, text that varies and is no link:
the wrapper is followed down from the page's root as long as one block inside does, and no text or heading that varies would be left behind.

A page's text is what it has at that place. Element, role or name (article, main, content) break ties: of such elements those around or inside the
place count, and they alone where a host has no wrapper. What is navigation, header, footer, aside, form or script by its element, or is named
after such a part (menu, advert, notice, comments ...), falls away inside it. Inside an article a name must
consist of such words only, ids of headings and sections, slugs of their titles, never count, and nothing is dropped for being constant: an
article may share its paragraphs. Elsewhere a constant text goes when ``SUPPORT`` references or more agree on it.

Only the references of a host meet in one task; the pages themselves are joined with the wrapper of their host, not grouped.

Edge cases: NULL or empty html has empty text; a NULL url has no host and no wrapper; a host of one page or of like pages has no template; tags
that do not close, broken tags and cut-off pages are read as far as they go; rows that repeat get equal texts; blocks nested deeper than
``DEEPEST`` levels are read like others, but not matched with the wrapper; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, cut

REFERENCES, ALIKE, DEEPEST = 8, 2, 200
MOST, SUPPORT = 0.6, 3
#: Tables of at most so many rows or bytes are broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_CLOSES_P = BLOCKS - {"body", "html", "noscript", "caption", "tbody", "thead", "tfoot", "tr"}
_ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
         "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",))}
_P_SCOPE = frozenset("table td th caption button object template".split())
_AWAY = frozenset("nav footer aside form script style noscript template iframe button select textarea dialog svg menu object canvas head title input label datalist "
                  "audio video map xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset("nav navbar navigation menu menubar masthead banner footer sidebar aside widget ad ads adv advert adverts advertisement advertising adsense "
                   "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share "
                   "sharing social breadcrumb breadcrumbs pagination pager related recommended recommendations comment comments respond replies reply disqus discussion search "
                   "toolbar copyright disclaimer hidden teaser".split())
#: Words that may stand beside these in a name that says what falls away inside an article.
_BESIDE = frozenset("slot slots box list block container wrapper unit inner outer area items links buttons top bottom left right".split())
_CONTENT = frozenset("content article post entry story main maincontent articlebody".split())
_MAIN = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TITLED = _HEADINGS | {"section"}
_STARTS = frozenset("has no with without is".split())


class Node:
    """A block: its signature, whether it falls away, and in order its child blocks and its own runs of text."""

    __slots__ = ("tag", "sign", "away", "role", "kids", "linked")

    def __init__(self, tag: str, sign: str = "", away: bool = False, role: str = ""):
        self.tag, self.sign, self.away, self.role = tag, sign or tag, away, role
        self.kids: list = []
        self.linked = 0


def _names(value: str) -> list[list[str]]:
    return [[w.lower() for w in _NAME.findall(part)] for part in value.split()]


def _look(tag: str, raw: str, in_article: bool) -> tuple[str, bool, str]:
    """Signature of a start tag, whether its content falls away, and its part: article, main, content or nothing."""
    if not raw.strip(" /\n\t\r"):
        return tag, tag in _AWAY or (tag == "header" and not in_article), tag if tag in _MAIN else ""
    found = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), value.strip("\"'"))
    classes, ids = _names(found.get("class", "")), _names(found.get("id", ""))
    named = classes + ids
    sign = f"{tag}.{found.get('class', '')}#{'' if any(c.isdigit() for c in found.get('id', '')) else found.get('id', '')}"
    away = tag in _AWAY or found.get("role", "") in _ROLES or "hidden" in found or found.get("aria-hidden") == "true" \
        or "display:none" in found.get("style", "").replace(" ", "").lower() or (tag == "header" and not in_article)
    if tag not in ("html", "body", "main"):
        for words in classes if tag in _TITLED else named:  # ids of headings and sections are slugs of their titles
            if not words or words[0] in _STARTS:
                continue
            if in_article:  # one such word among others says nothing there
                away |= any(w in _NAMES for w in words) and all(w in _NAMES or w in _BESIDE or w.isdigit() for w in words)
            else:
                away |= words[0] in _NAMES or words[-1] in _NAMES or words in (["header"], ["site", "header"], ["page", "header"])
    role = tag if tag in _MAIN else ""
    if not role and (found.get("role") == "main" or found.get("itemprop") == "articleBody"):
        role = "main"
    if not role and tag in BLOCKS and any(words and (words[0] in _CONTENT or words[-1] in _CONTENT) for words in named):
        role = "content"
    return sign, away, role


def parse(page: str) -> Node:
    """Tree of blocks; text of what falls away inside a line is left out at once."""
    root = Node("root")
    stack: list[tuple[str, Node | None, bool]] = [("root", root, False)]  # tag, its block, whether its text is left out
    block, blocks, articles, silent, linked, at = root, [root], 0, 0, 0, 0

    def pop_to(k: int) -> None:
        nonlocal block, articles, silent, linked
        while len(stack) > k:
            tag, node, quiet = stack.pop()
            silent -= quiet
            linked -= tag == "a"
            if node is not None:
                blocks.pop()
                block = blocks[-1]
                articles -= node.role == "article"

    def say(text: str) -> None:
        if silent or not text:
            return
        if not block.kids or isinstance(block.kids[-1], Node):
            if text.isspace():
                return
            block.kids.append([])
        block.kids[-1].append(text)
        if linked:
            block.linked += len(text.strip())

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k:
                if tag in ("td", "th"):
                    say(" ")
                pop_to(k)
            continue
        if tag in _VOID:
            if tag == "br":
                say(" ")
            if tag != "hr":
                continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in _P_SCOPE:
                    break
        if tag in _ENDS:
            ends, scope = _ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends.split():
                    pop_to(k)
                    if tag not in ("tr",):
                        break
                elif stack[k][0] in scope:
                    break
        if tag == "hr":
            block.kids.append(Node("hr"))
            continue
        sign, away, role = _look(tag, m[3] or m[6] or "", articles > 0)
        if tag in BLOCKS:
            node = Node(tag, sign, away, role)
            block.kids.append(node)
            block = node
            blocks.append(node)
            articles += role == "article"
            stack.append((tag, node, False))
        elif not (m[3] or m[6] or "").endswith("/") or tag not in ("path", "use"):
            if tag in ("td", "th"):
                say(" ")
            stack.append((tag, None, away))
            silent += away
            linked += tag == "a"
    return root


def _text(run: list[str]) -> str:
    text = "".join(run)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


class Shape:
    """A block for matching: runs of like leaf blocks are one shape. Holds its texts, the share of them that is no link, and child shapes; ``node`` is
    the block it was made from, ``content`` marks the place of the running text in a wrapper."""

    __slots__ = ("sign", "texts", "kids", "count", "node", "linked", "size", "away", "content")

    def __init__(self, sign: str):
        self.sign, self.texts, self.kids, self.count = sign, set(), [], 1
        self.node, self.linked, self.size, self.away, self.content = None, 0, 0, False, False

    def plain(self, fixed: set[str]) -> float:
        """Length of the texts that are not among the given ones, less what is linked."""
        return sum(len(t) for t in self.texts - fixed) * max(0.0, 1 - self.linked / self.size) if self.size and not self.away else 0.0


def shape(node: Node, runs: dict[int, str], depth: int = 1, away: bool = False) -> Shape:
    """Shape of a block down to the level ``DEEPEST``; ``runs`` gets the text of every run on the way by identity."""
    out = Shape(node.sign)
    out.node, out.linked, out.away = node, node.linked, away or node.away
    for kid in node.kids:
        if isinstance(kid, list):
            text = runs[id(kid)] = _text(kid)
            if text:
                out.texts.add(text)
                out.size += len(text)
        elif depth < DEEPEST:
            made = shape(kid, runs, depth + 1, out.away)
            last = out.kids[-1] if out.kids else None
            if last is not None and last.sign == made.sign and not last.kids and not made.kids:
                last.texts |= made.texts
                last.linked, last.size = last.linked + made.linked, last.size + made.size
            else:
                out.kids.append(made)
    return out


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: number of matched nodes and the pairs, roots included, of two shapes of one signature."""
    x, y, pairs, size = a.kids, b.kids, [(a, b)], 1
    lo, hi = 0, 0
    while lo < min(len(x), len(y)) and x[lo].sign == y[lo].sign:  # like children at both ends are matched as they stand
        lo += 1
    while hi < min(len(x), len(y)) - lo and x[-1 - hi].sign == y[-1 - hi].sign:
        hi += 1
    for s, t in [*zip(x[:lo], y[:lo]), *zip(x[len(x) - hi :], y[len(y) - hi :])]:
        n, more = match(s, t)
        size += n
        pairs += more
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if x and y:
        best = [[(0, None)] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, s in enumerate(x, 1):
            for j, t in enumerate(y, 1):
                options = [(best[i - 1][j][0], None), (best[i][j - 1][0], None)]
                if s.sign == t.sign:
                    n, more = match(s, t)
                    options.append((best[i - 1][j - 1][0] + n, more))
                best[i][j] = max(options, key=lambda o: o[0])
        size += best[-1][-1][0]
        i, j = len(x), len(y)
        while i and j:
            n, more = best[i][j]
            if more is not None:
                pairs += more
                i, j = i - 1, j - 1
            elif best[i - 1][j][0] == n:
                i -= 1
            else:
                j -= 1
    return size, pairs


def _all_texts(s: Shape) -> set[str]:
    out, todo = set(), [s]
    while todo:
        s = todo.pop()
        out |= s.texts
        todo += s.kids
    return out


def _near_copies(a: Shape, b: Shape) -> bool:
    """Whether two pages share at least half of the texts of their slots, the places whose texts differ between them."""
    pairs = match(a, b)[1]
    own, other = len(_all_texts(a)), len(_all_texts(b))
    fixed = set().union(*(x.texts for x, y in pairs if x.texts == y.texts))
    common = set().union(*(x.texts & y.texts for x, y in pairs if x.texts != y.texts)) - fixed
    return len(common) * 2 >= min(own, other) - len(fixed)


def _content(wrapper: Shape, matched: dict[int, list[Shape]]) -> Shape | None:
    """Innermost place with most of the running text; ``matched`` has the shapes of all references by identity of the wrapper's."""
    own: dict[int, float] = {}

    def total(s: Shape) -> float:
        own[id(s)] = sum(x.plain(s.texts) for x in matched[id(s)])
        inside[id(s)] = own[id(s)] + sum(map(total, s.kids))
        return inside[id(s)]

    inside: dict[int, float] = {}
    every = total(wrapper)
    if not every:
        return None
    at = wrapper
    while not own[id(at)]:
        best = max((k for k in at.kids if k.kids), key=lambda k: inside[id(k)], default=None)
        if best is None or inside[id(best)] < MOST * every:
            break
        if any(k is not best and k.node.tag in _HEADINGS and inside[id(k)] for k in at.kids):
            break
        at = best
    return at


def induce(pages: list[str]) -> str:
    """Wrapper of a host as JSON, from its reference pages: the shapes that hold template texts or lead to the content; empty when there are none."""
    chosen: list[Shape] = []
    for page in sorted(set(pages)):
        s = shape(parse(page), {})
        if _all_texts(s) and not any(_near_copies(s, t) for t in chosen):
            chosen.append(s)
    if len(chosen) < ALIKE:
        return ""
    wrapper = chosen[0]
    matched: dict[int, list[Shape]] = {}
    todo = [wrapper]
    while todo:
        s = todo.pop()
        own = Shape(s.sign)  # the wrapper's own page, as its texts are cut down below
        own.texts, own.linked, own.size, own.away = set(s.texts), s.linked, s.size, s.away
        matched[id(s)] = [own]
        todo += s.kids
    for other in chosen[1:]:
        for a, b in match(wrapper, other)[1]:
            a.count += 1
            a.texts &= b.texts
            matched[id(a)].append(b)
    place = _content(wrapper, matched)

    def kept(s: Shape):
        kids = [k for k in map(kept, s.kids) if k]
        fixed = sorted(s.texts) if s.count == len(chosen) >= SUPPORT else []
        return [s.sign, fixed, kids, s is place] if kids or fixed or s is place else None

    found = kept(wrapper)
    return json.dumps(found, ensure_ascii=False) if found else ""


def _shape_of(found: list) -> Shape:
    s = Shape(found[0])
    s.texts = set(found[1])
    s.kids = [_shape_of(k) for k in found[2]]
    s.content = found[3]
    return s


def _template(page: Node, runs: dict[int, str], wrapper: Shape) -> tuple[dict[str, set[str]], Node | None]:
    """Template texts of a page by signature of the block that holds them, and its content, from matching it with the wrapper."""
    fixed: dict[str, set[str]] = {}
    place = None
    for w, own in match(wrapper, shape(page, runs))[1]:
        if w.texts & own.texts:
            fixed.setdefault(own.sign, set()).update(w.texts & own.texts)
        if w.content:
            place = own.node
    return fixed, place


def _inside(node: Node) -> set[int]:
    """Identities of a block and those inside it."""
    out, todo = set(), [node]
    while todo:
        node = todo.pop()
        out.add(id(node))
        todo += [k for k in node.kids if isinstance(k, Node)]
    return out


def _outermost(root: Node, role: str) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.away:
            continue
        if node.role == role:
            out.append(node)
        else:
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return out


def _blocks(node: Node, runs: dict[int, str], fixed: dict[str, set[str]], loose: bool) -> list[str]:
    out, todo = [], [(node, "")]
    lists = _link_lists(node) if loose else ()
    while todo:
        item, sign = todo.pop()
        if isinstance(item, list):
            text = runs.get(id(item))
            text = _text(item) if text is None else text
            if text and text not in fixed.get(sign, ()):
                out.append(text)
        elif not item.away and not (loose and item.tag in ("ul", "ol", "div", "p") and id(item) in lists):
            todo += [(k, item.sign) for k in reversed(item.kids)]
    return out


def _link_lists(root: Node) -> set[int]:
    """Identities of the blocks with at least three linked blocks or a list, and no other text; every block is counted once."""
    order, todo = [], [(root, -1)]
    while todo:
        n, up = todo.pop()
        todo += [(k, len(order)) for k in n.kids if isinstance(k, Node)]
        order.append((n, up))
    sums = [[n.linked, n.linked > 0, sum(len("".join(k).strip()) for k in n.kids if isinstance(k, list))] for n, _ in order]
    for at in range(len(order) - 1, 0, -1):
        up = sums[order[at][1]]
        for k, x in enumerate(sums[at]):
            up[k] += x
    return {id(n) for (n, _), (links, items, size) in zip(order, sums) if items >= 3 and links >= size}


def extract(page: str | None, wrapper: Shape | None = None) -> str:
    """Main text: blocks in page order joined by line ends."""
    if not page:
        return ""
    root = parse(page)
    runs: dict[int, str] = {}
    fixed, place = _template(root, runs, wrapper) if wrapper is not None else ({}, None)
    within = _inside(place) if place is not None else set()
    for role in ("article", "main", "content"):
        nodes = _outermost(root, role)
        if place is not None:  # elements around the content, or else those in it
            nodes = [n for n in nodes if id(place) in _inside(n)] or [n for n in nodes if id(n) in within] or nodes
        text = "\n".join(t for node in nodes for t in _blocks(node, runs, {} if role == "article" else fixed, False))
        if text:
            return text
    text = "\n".join(_blocks(place, runs, fixed, True)) if place is not None else ""
    return text or "\n".join(_blocks(root, runs, fixed, True))


def with_hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("_host", host).withColumn("_h", F.xxhash64("page_id", "url"))


def wrappers(hosted: DataFrame) -> DataFrame:
    """(_host, wrapper) of the hosts that have a template. Each host gives its REFERENCES pages of least hash."""
    named = hosted.filter((F.col("_host") != "") & F.col("html").isNotNull())
    first = F.row_number().over(Window.partitionBy("_host").orderBy("_h"))  # Spark limits each task's rows before it deals them by host
    least = cut(named.select("_host", "_h").distinct().withColumn("_n", first).filter(F.col("_n") <= REFERENCES).select("_host", "_h"))
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    chosen = named.join(least, ["_host", "_h"], "left_semi").groupBy("_host", "_h").agg(F.first("html").alias("html"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        found = induce(group["html"].tolist())
        return pd.DataFrame({"_host": group["_host"].iloc[:1], "wrapper": [found]}) if found else pd.DataFrame({"_host": [], "wrapper": []}, dtype=str)

    return chosen.select("_host", "html").groupBy("_host").applyInPandas(one, "_host string, wrapper string")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    hosted = with_hosts(pages.select("page_id", "url", "html"))
    found = cut(wrappers(hosted))
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("_host")), F.lit(0))).head()[0]
    joined = hosted.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "_host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Shape] = {}
        for batch in bounded(batches, "html"):
            texts = []
            for page, wrapper in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist()):
                if wrapper and wrapper not in known:
                    known.clear() if len(known) > 1000 else None
                    known[wrapper] = _shape_of(json.loads(wrapper))
                texts.append(extract(page, known.get(wrapper)))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
