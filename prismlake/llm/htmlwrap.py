"""Main text of web pages through wrappers: union-free regular expressions inferred by host.

A page's token stream (tags and texts) is nested into elements. Adjacent elements of the same kind are folded
into one repeated group, and the wrappers of pages of the same host are aligned one after the other: tokens
that match are merged, mismatches become optional groups, and texts that differ become slots. A wrapper
notes how much text went through each of its elements. Read off the wrapper are the host's template elements:
those whose own texts are no slots but the same on all pages that have them, which are at least CONSTANT, and
half of the host's (in an element named as content any slot counts as its own). A page's main text are its
article or main elements (by tag or role), else all its outermost elements that are named as content or have
text of their own, without the template's; each without boilerplate (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments). A header with the headline in it is none.

Wrappers can be merged in any order, so each task folds its own pages of a host into one and groups of at
most FAN wrappers are merged level by level: no host, however large, is one task's work. All pages count.
Wrappers have a bounded size: of more than WIDE siblings the order isn't kept (each kind is one repeated
group), and elements nested more than DEEP levels are parts of the one at that level. A host whose wrapper would have more
than NODES nodes is read again: the pages of each path are counted by aggregations, and its wrapper is made of the
paths that may be template, those on as many pages as that takes (about twice a page's elements at most). Of all
others the wrapper notes that they have text, which is all that matters of a slot. So nothing is left out there.

Defined results: a null or empty html has an empty text; a null url, or one without `://`, belongs to the
host ''; a page with nothing but its host's template is read as if it were the host's only one; a null page_id
stays null; repeated rows are repeated in the result; tags that don't end take the rest of the page, as in
browsers; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, join_counted, map_batches, staged
from .urlfilter import parts

FAN, CONSTANT, WIDE, DEEP, NODES = 64, 3, 64, 100, 5_000
#: Pages of one host that go with one copy of its paths.
SHARE = 1_000

# every alternative reads its part of the page once: none starts over after a failure far behind it
_INSIDE = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>=]|=)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|svg|title)\b{_INSIDE}(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z]{_INSIDE}(?:>|\Z)|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)([^>]*.*)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_HUGE = re.compile(r"&#0*+[0-9]{8,};?")  # no character, and too long for a number

# fixed values of HTML
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "button", "select", "iframe", "legend", "figcaption", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOILER_TAGS = set("nav header footer aside form button select menu dialog iframe head".split())
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related footer masthead notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing social comment comments replies respond disqus search toolbar copyright contentinfo complementary".split()
)
CONTENT_NAMES = set("article main content post entry story".split())
#: What class words can't make boilerplate.
ROOTS, ARTICLES = {"#page", "html", "body"}, {"article", "main"}
#: Words that say something of an element's state or layout, not what it is: has-sidebar, with-comments.
STATES = set("has have no not with without is hide hidden show".split())


class Element:
    """Its class, id and role make it boilerplate by a whole word, or by a part of one (site-footer)."""

    __slots__ = ("label", "tag", "boiler", "by_part", "article", "headline", "children")

    def __init__(self, tag: str, attributes: list[tuple[str, str]] = []):  # noqa: B006
        words = {w for _, v in attributes for w in v.split()}
        names = {p for w in words for p in _PARTS.findall(w)}
        self.tag = tag
        self.article = tag in ARTICLES or any(a == "role" and not ARTICLES.isdisjoint(v.split()) for a, v in attributes)
        named = tag not in PARAGRAPHS and not words.isdisjoint(CONTENT_NAMES)
        self.boiler, self.headline = tag in BOILER_TAGS, False
        self.by_part = tag == "header"
        if not self.boiler and not self.article and tag not in ROOTS and not names.isdisjoint(BOILER_NAMES):
            self.by_part = words.isdisjoint(BOILER_NAMES)
            self.boiler = not self.by_part or (not named and any(BOILER_NAMES.intersection(parts) and STATES.isdisjoint(parts) for parts in map(_PARTS.findall, words)))
        mark = "!" if self.boiler else "@" if self.article and tag not in ARTICLES else "=" if named and not self.article else ""
        self.label = mark + tag + ("." + min(names) if names else "")
        self.children: list[Element | str] = []

    def holds_headline(self) -> None:
        """With a headline or the page's main part in it, it's a layout's container, or the article's own header."""
        self.headline = True
        if self.boiler and self.by_part:
            self.boiler, self.label = False, self.label[1:]


def decoded(text: str) -> str:
    return entities.unescape(_HUGE.sub("\ufffd", text)) if "&" in text else text


class Page:
    """A page's block elements, as its tokens come; texts are the children that are strings, a line break ends neither."""

    def __init__(self, page: str):
        self.root = Element("#page")
        # open elements by tag, with the element that takes their text: itself, or at most DEEP levels down
        self.stack: list[tuple[str, Element]] = [("#page", self.root)]
        self.open, self.articles, self.text = Counter(), 0, []
        for m in _TOKEN.finditer(page):
            token = m.group()
            if token[0] != "<" or token == "<":
                self.text.append(decoded(token))
            elif not m.group(1) and (t := _TAG.match(token)):
                self.tag(t.group(1), t.group(2).lower(), t.group(3).removesuffix(">"))
        self.flush()

    def flush(self) -> None:
        if self.text:
            whole = " ".join("".join(self.text).split())
            self.text.clear()
            if whole:
                self.stack[-1][1].children.append(whole)

    def close(self, i: int) -> None:
        """End the open elements from place i of the stack on."""
        self.flush()
        for tag, e in self.stack[i:]:
            self.open[tag] -= 1
            self.articles -= e.article
        del self.stack[i:]

    def last(self, tags: set[str], until: tuple[str, ...] = ()) -> int:
        """Place of the last open element of some tags, 0 if there is none after the last one of `until`."""
        if any(self.open[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in tags:
                    return i
                if self.stack[i][0] in until:
                    break
        return 0

    def tag(self, ends: str, tag: str, rest: str) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag not in BLOCKS:
            return
        if ends:
            if i := self.last({tag}):
                self.close(i)
            else:
                self.flush()
            return
        if tag in ENDS_P and (i := self.last({"p"})):
            self.close(i)
        if tag in SIBLINGS and (i := self.last(SIBLINGS[tag], ("ul", "ol", "dl", "table"))):
            self.close(i)
        self.flush()
        e = Element(tag, [(a.lower(), "".join(v).lower()) for a, *v in _NAMES.findall(rest)] if "=" in rest else [])
        if tag == "h1" or (e.article and tag != "article"):
            for _, outer in reversed(self.stack):
                if outer.headline:
                    break
                outer.holds_headline()
        elif tag in ("h2", "h3") and self.articles and self.stack[-1][1].tag == "header":
            self.stack[-1][1].holds_headline()
        inside = self.stack[-1][1]
        if len(self.stack) <= DEEP or (e.boiler and not inside.boiler):
            inside.children.append(e)
        else:
            e = inside
        if tag not in VOID and not rest.endswith("/"):
            self.stack.append((tag, e))
            self.open[tag] += 1
            self.articles += e.article


def parse(page: str) -> Element:
    return Page(page).root


# ---- wrappers: [label, repeated, optional, pages, characters, text hash or 0 (of an element: notes), children]

LABEL, REPEATED, OPTIONAL, PAGES, SIZE, TEXT, INSIDE = range(7)
#: Notes: elements that were left out have text that counts as the element's own; have any text; (of the root) are unknown.
OWN, DEEPER, CUT = 1, 2, 4


def wrapper(e: Element | str) -> list:
    """The wrapper of one element of one page."""
    if isinstance(e, str):
        return ["#", 0, 0, 1, len(e), xxhash.xxh32_intdigest(e) or 1, []]
    inside: list[list] = []
    for child in map(wrapper, e.children):
        if inside and inside[-1][LABEL] == child[LABEL]:  # a square: one repeated group
            inside[-1] = repeated(inside[-1], child)
        else:
            inside.append(child)
    if len(inside) > WIDE:
        inside = folded(inside)
    return [e.label, 0, 0, 1, sum(c[SIZE] for c in inside), 0, inside]


def merge(a: list, b: list) -> list:
    """The wrapper that fits what a or b fit; both have the same label."""
    text = a[TEXT] | b[TEXT] if a[LABEL] != "#" else a[TEXT] if a[TEXT] == b[TEXT] else 0
    return [a[LABEL], a[REPEATED] | b[REPEATED], a[OPTIONAL] | b[OPTIONAL], a[PAGES] + b[PAGES], a[SIZE] + b[SIZE], text, align(a[INSIDE], b[INSIDE])]


def repeated(a: list, b: list) -> list:
    """One repeated group of both, on the pages of the more frequent one."""
    both = merge(a, b)
    both[REPEATED], both[PAGES] = 1, max(a[PAGES], b[PAGES])
    return both


def folded(nodes: list[list]) -> list[list]:
    """One group for each label."""
    out: dict[str, list] = {}
    for n in nodes:
        out[n[LABEL]] = repeated(out[n[LABEL]], n) if n[LABEL] in out else n
    return list(out.values())


def optional(node: list) -> list:
    one = list(node)
    one[OPTIONAL] = 1
    return one


def align(a: list[list], b: list[list]) -> list[list]:
    """Both streams in one: the longest common subsequence is merged, mismatches become optional groups."""
    n, m = len(a), len(b)
    if max(n, m) > WIDE:
        x, y = ({node[LABEL]: node for node in folded(side)} for side in (a, b))
        return [merge(x[k], y[k]) if k in y else optional(x[k]) for k in x] + [optional(y[k]) for k in y if k not in x]
    head = 0
    while head < min(n, m) and a[head][LABEL] == b[head][LABEL]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail][LABEL] == b[m - 1 - tail][LABEL]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if x[i][LABEL] == y[j][LABEL] else max(table[i + 1][j], table[i][j + 1])
    out = [merge(p, q) for p, q in zip(a[:head], b[:head])]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][LABEL] == y[j][LABEL]:
            out.append(merge(x[i], y[j]))
            i, j = i + 1, j + 1
        else:
            left = j >= len(y) or (i < len(x) and table[i + 1][j] >= table[i][j + 1])
            out.append(optional(x[i] if left else y[j]))
            i, j = i + left, j + (not left)
    return out + [merge(p, q) for p, q in zip(a[n - tail :], b[m - tail :])]


def pruned(w: list) -> list:
    """The wrapper with at most NODES nodes: those on the fewest pages go, all below a node with it, which is noted as CUT."""

    def pages(node: list) -> Iterator[int]:
        yield node[PAGES]
        for c in node[INSIDE]:
            yield from pages(c)

    counts = sorted(pages(w), reverse=True)
    if len(counts) <= NODES:
        return w
    least = counts[NODES]

    def kept(node: list) -> list:
        inside = folded(node[INSIDE])  # so that no node of the same path is left
        return [*node[:INSIDE], [kept(c) for c in inside if c[PAGES] > least]]

    out = kept(w)
    out[TEXT] |= CUT
    return out


def below(path: int, label: str) -> int:
    """Number of a path that goes one element on; should two paths share one, more is kept, never less."""
    return xxhash.xxh64_intdigest(label, seed=path) >> 1


def places(w: list) -> set[int]:
    """Paths of a page's elements that aren't inside boilerplate."""
    found: set[int] = set()

    def walk(node: list, path: int) -> None:
        found.add(path)
        if node[LABEL][0] != "!":
            for c in node[INSIDE]:
                if c[LABEL] != "#":
                    walk(c, below(path, c[LABEL]))

    walk(w, 0)
    return found


def at_paths(w: list, paths: set[int]) -> list:
    """A page's wrapper of its elements at some paths, with notes of the texts of all others: none of these is a constant."""

    def own(node: list) -> bool:
        return node[LABEL] == "#" or (node[LABEL].split(".")[0] in PARAGRAPHS and any(map(own, node[INSIDE])))

    def any_text(node: list) -> bool:
        return node[LABEL] == "#" or (node[LABEL][0] != "!" and any(map(any_text, node[INSIDE])))

    def kept(node: list, path: int) -> list:
        notes, inside = node[TEXT], []
        for c in node[INSIDE]:
            if c[LABEL] == "#":
                inside.append(c)
            elif (further := below(path, c[LABEL])) in paths:
                inside.append(kept(c, further))
            else:
                notes |= OWN * own(c) | DEEPER * any_text(c)
        return [*node[:TEXT], notes, inside]

    return kept(w, 0)


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression: ()+ repeated, ()? optional, #TEXT slots, constants by hash."""
    body = ("#TEXT" if not w[TEXT] else f"'{w[TEXT]:x}'") if w[LABEL] == "#" else f"<{w[LABEL]}>" + "".join(map(expression, w[INSIDE])) + f"</{w[LABEL]}>"
    sign = {(0, 0): "", (1, 0): "+", (0, 1): "?", (1, 1): "*"}[w[REPEATED], w[OPTIONAL]]
    return f"({body}){sign}" if sign else body


PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table tbody tr td th dl dt dd figure figcaption hgroup".split())


def template_paths(w: list) -> list[str]:
    """Paths of the elements whose own texts are the host's template: none of them is a slot."""
    least = max(CONSTANT, w[PAGES] / 2)
    fixed: set[str] = set()
    slots: set[str] = set()

    def own(node: list) -> tuple[bool, bool]:
        """Whether a text, or the texts of a paragraph, are there at all, and whether any is a slot."""
        if node[LABEL][0] == "!":
            return False, False
        if node[LABEL] == "#":
            return True, not node[TEXT] or node[PAGES] < least
        if node[LABEL].split(".")[0] in PARAGRAPHS:
            found = [own(c) for c in node[INSIDE]] + [(True, True)] * (node[TEXT] & OWN)
            return any(x for x, _ in found), any(y for _, y in found)
        return False, False

    def walk(node: list, path: str) -> bool:
        """Whether there is a slot in the node, which makes all of one that is named as content no template."""
        if node[LABEL][0] == "!":
            return False
        found = [own(c) for c in node[INSIDE]] + [(True, True)] * (node[TEXT] & OWN)
        slot = any(y for _, y in found)
        deeper = any([walk(c, f"{path}>{c[LABEL]}") for c in node[INSIDE] if c[LABEL] != "#"]) or bool(node[TEXT] & DEEPER)
        if any(x for x, _ in found):
            (slots if slot or (deeper and node[LABEL][0] == "=") else fixed).add(path)
        return slot or deeper

    walk(w, w[LABEL])
    return sorted(fixed - slots)


def main_text(root: Element, template: set[str]) -> str:
    """Blocks of the articles, else of the outermost elements with own text that isn't the template's, by blank lines."""
    blocks: list[str] = []

    def emit(e: Element) -> None:
        for c in e.children:
            if isinstance(c, str):
                blocks.append(c)
            elif not c.boiler:
                emit(c)

    def articles(e: Element) -> bool:
        if e.boiler:
            return False
        if e.article:
            emit(e)
            return True
        return any([articles(c) for c in e.children if not isinstance(c, str)])

    def has_text(e: Element | str) -> bool:
        return isinstance(e, str) or (not e.boiler and e.tag in PARAGRAPHS and any(map(has_text, e.children)))

    def outermost(e: Element, path: str) -> None:
        if e.boiler:
            return
        if path not in template and (any(map(has_text, e.children)) or e.label[0] == "="):
            emit(e)
            return
        for c in e.children:
            if not isinstance(c, str):
                outermost(c, f"{path}>{c.label}")

    if not articles(root):
        outermost(root, root.label)
    return "\n\n".join(blocks)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a batch; of pages with paths (of their host) whole, at these."""
    for batch in batches:
        by_host: dict[str, list] = {}
        paths: dict[str, set[int]] = {}
        for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())):
            host, w = parts(url)[0], wrapper(parse(page or ""))
            if "paths" in batch.schema.names:
                if host not in paths:
                    paths[host] = set(batch.column("paths")[i].as_py() or ())
                w = at_paths(w, paths[host])
                by_host[host] = merge(by_host[host], w) if host in by_host else w
            else:
                by_host[host] = pruned(merge(by_host[host], w) if host in by_host else w)
        yield pa.RecordBatch.from_pydict({"host": pa.array(list(by_host), pa.string()), "wrapper": pa.array([json.dumps(w) for w in by_host.values()], pa.string())})
    give_back()


def _merged(group: pd.DataFrame, bounded: bool) -> pd.DataFrame:
    whole = None
    for text in sorted(group.wrapper):
        w = json.loads(text)
        whole = w if whole is None else merge(whole, w)
        whole = pruned(whole) if bounded else whole
    return pd.DataFrame({"host": [group.host.iloc[0]], "wrapper": [json.dumps(whole)]})


def merged(found: DataFrame, bounded: bool) -> DataFrame:
    """One wrapper for each host."""
    found = staged(found, "wrappers")
    while True:
        sizes = staged(found.groupBy("host").agg(F.count("*").alias("many")), "hosts")
        most = sizes.agg(F.max("many")).first()[0] or 0
        if most <= 1:
            return found
        parts_of = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("many") / FAN))
        dealt = join_counted(found, sizes, ["host"]).withColumn("part", parts_of).groupBy("host", "part")
        found = staged(dealt.applyInPandas(lambda group: _merged(group, bounded), "host string, wrapper string"), "wrappers")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many pages of a batch each path of a host is."""
    for batch in batches:
        found = Counter()
        for host, many, page in zip(*(batch.column(c).to_pylist() for c in ("host", "many", "html"))):
            found.update((host, many, path) for path in places(wrapper(parse(page or ""))))
        host, many, path = ([k[i] for k in found] for i in range(3))
        yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string()), "many": pa.array(many, pa.int64()), "path": pa.array(path, pa.int64()), "pages": pa.array(found.values(), pa.int64())})
    give_back()


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of each host, from all its pages."""
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kinds = "host string, wrapper string"
    found = merged(pages.mapInArrow(_own, kinds), bounded=True)
    is_cut = F.get_json_object("wrapper", f"$[{TEXT}]").cast("int").bitwiseAND(CUT) > 0
    cut = staged(found.where(is_cut).select("host"), "cut")
    if cut.isEmpty():
        return found
    rows = pages.withColumn("host", host_of("url"))
    sizes = staged(rows.groupBy("host").agg(F.count("*").alias("many")).join(cut, "host"), "hosts")
    rows = join_counted(rows, sizes, ["host"])
    frequent = rows.select("host", "many", "html").mapInArrow(_places, "host string, many long, path long, pages long")
    frequent = frequent.groupBy("host", "many", "path").agg(F.sum("pages").alias("pages"))
    frequent = frequent.where(F.col("pages") >= F.greatest(F.lit(CONSTANT), F.col("many") / 2))
    frequent = frequent.groupBy("host", "many").agg(F.collect_list("path").alias("paths"))
    shares = F.ceil(F.col("many") / SHARE)
    dealt = staged(frequent, "paths").select("host", "paths", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("url", "html"), shares)).join(dealt, ["host", "share"], "left")
    whole = merged(rows.select("url", "html", "paths").mapInArrow(_own, kinds), bounded=False)
    return found.where(~is_cut).unionByName(whole)


def host_of(url: str) -> F.Column:
    """What parts() takes for the host."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.expr(f"substr({url}, instr({url}, '://') + 3)"), "#", 1), "?", 1)).otherwise("")
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text (main text, empty if none) and n_chars (its code points)."""
    bounded_batches(pages.sparkSession)

    def template(batch: pa.RecordBatch) -> dict:
        return {"host": batch.column(0), "paths": [template_paths(json.loads(w)) for w in batch.column(1).to_pylist()]}

    templates = map_batches(wrappers(pages), template, "host string, paths array<string>")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    templates = staged(templates.join(rows.groupBy("host").agg(F.count("*").alias("many")), "host"), "templates")
    rows = join_counted(rows, templates, ["host"], "left", small="size(paths) <= 64")

    def read(batch: pa.RecordBatch) -> dict:
        texts = []
        for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist()):
            root = parse(page or "")
            texts.append(main_text(root, set(paths or ())) or main_text(root, set()))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(rows, read, "page_id long, url string, text string, n_chars long")
