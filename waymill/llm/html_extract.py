"""Main text of web pages by wrapper inference: union-free regular expressions of the pages of a host.

A page is a stream of block-level tags and texts. Neighbouring equal elements fold into one repeated
group; the streams of a host's pages are aligned one after another, level by level: what only some
pages have becomes an optional group, and where texts differ there is a text slot. The wrapper so found
carries, for each of its groups and slots, the pages it stands on and the characters of text and links in it.

The wrapper decides what is text. Slots whose text is the same on every page are the template, in the article only if names
or links speak against them too; groups that are links for the most part are menus; the article is the article or main element with most of the varying text, or
else the deepest group that holds most of it. Names of tags say what can't be an article's (nav, footer, ...), and a form isn't unless it stands around the page.
Words of class and id only vote: whole names like "ad" or "comments" on a group that holds less than half of the host's
text, and parts of names only where no article or main element marks the article, and not on groups of running text. Each page is then aligned
with its host's wrapper, and the slots that the wrapper keeps are its main text.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import written

#: A wrapper of more nodes is generalised: groups of one name under one parent become one repeated group.
NODES = 4000
#: Elements nested deeper than this are transparent: their texts belong to the element at this depth.
DEPTH = 120
#: Wrappers are broadcast up to this many characters in all, and joined by shuffle beyond.
BROADCAST_CHARS = 20_000_000

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand around a whole page: theirs is the article's text if most of the page's is in them.
WRAPS = frozenset("form fieldset".split())
#: Elements whose text never is the article's.
SKIPPED = frozenset("head title script style noscript template textarea select option optgroup button input legend nav menu aside footer dialog iframe object svg math canvas audio video map datalist search".split())
#: Elements whose content is no markup: it ends with their end tag, whatever stands in it.
RAW = {name: re.compile(rf"(?is)</{name}\s*>|\Z") for name in "script style noscript template textarea iframe svg title xmp".split()}
TOKEN = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|([^<]+|<)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
#: Words in class, id and role that name what isn't the article: they vote where no element marks the article.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay sidebar menu nav navbar navigation navigations breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login toolbar pagination pager contentinfo complementary disclaimer copyright".split())
#: Whole names of class, id and role that vote inside the article too.
NAMES = frozenset("ad ads advert adverts advertisement advertisements sponsored comment comments comment-list respond disqus_thread sidebar cookie cookie-notice cookie-banner newsletter breadcrumb breadcrumbs pagination navigation contentinfo complementary".split())
#: Elements that group blocks; only these are voted on. The others hold prose.
GROUPS = frozenset("div section ul ol dl table details center header figure".split())
#: Elements of running text, and all elements whose text stays although it is the same on all pages.
WRITTEN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
PROSE = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
CLOSES_P = BLOCKS - {"html", "body", "head", "title", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "li", "dt", "dd"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


@dataclass
class Element:
    name: str
    signature: str
    hard: bool  # never the article's
    vote: int  # 2: a whole name speaks against it, 1: a part of one


def element(name: str, attributes: str, inside: list[Element]) -> Element:
    """The element with its class names, and what its tag and attributes say of it."""
    hard = name in SKIPPED or name == "header" and not any(e.name in ("article", "main") for e in inside)
    if not attributes.strip():
        return Element(name, name, hard, 0)
    classes: list[str] = []
    vote = 0
    for key, a, b, c, flag in ATTRIBUTE.findall(attributes):
        key, value = (key or flag).lower(), a or b or c
        if key in ("class", "id", "role"):
            whole = value.lower().split()
            if key == "class":
                classes += [w for w in whole if not any(ch.isdigit() for ch in w)]
            if name in GROUPS and vote < 2:
                vote = 2 if not NAMES.isdisjoint(whole) else max(vote, int(not HINTS.isdisjoint(w.lower() for w in SPLIT.split(value))))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hard = True
    # Elements that are judged apart have names apart, so that groups of them aren't folded into others.
    mark = ["~hidden"] if hard and name not in SKIPPED else [f"~{vote}"] if vote else []
    return Element(name, ".".join([name, *sorted(set(classes))[:4], *mark]), hard, vote)


@dataclass
class Block:
    text: str
    links: int
    hard: bool


def events(page: str) -> Iterator[tuple[str, object]]:
    """("open", Element), ("close", None) and ("block", Block) of a page in order.

    Comments and the contents of scripts, styles and the like are nothing; tags are read one after another, so that
    what looks like a tag in a comment, an attribute or a script is none. Inline tags leave no mark,
    a line break is white space. End tags close what is open inside, and those of nothing are skipped.
    """
    open_: list[Element] = []
    deep: list[Element] = []
    text: list[str] = []
    links, in_link, hidden = 0, 0, 0

    def block():
        nonlocal links
        joined = " ".join("".join(text).split())
        text.clear()
        found = Block(joined, links, any(e.hard for e in deep))
        links = 0
        return found if joined else None

    def closing(stack: list[Element], name: str) -> int:
        """How many elements an end tag of the name closes."""
        return next((len(stack) - k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), 0)

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        close, name, attributes, data = m.groups()
        if data is not None:
            if not hidden:
                data = html.unescape(data)
                text.append(data)
                if in_link:
                    links += len(data)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not close:
            at = at if attributes.endswith("/") and name == "svg" else RAW[name].search(page, at).end()
            continue
        if name not in BLOCKS:
            if name == "br":
                text.append(" ")
            elif name == "a":
                in_link = 0 if close else 1
            elif name == "button":
                hidden = max(0, hidden - 1) if close else hidden + 1
            continue
        if found := block():
            yield "block", found
        in_link = 0
        if close:
            if n := closing(deep, name):
                del deep[-n:]
            elif n := closing(open_, name):
                deep.clear()
                del open_[-n:]
                yield from (("close", None),) * n
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and any(e.name == "p" for e in (deep or open_)[-3:]):
            n = closing(deep or open_, "p")
            if deep:
                del deep[-n:]
            else:
                del open_[-n:]
                yield from (("close", None),) * n
        elif name in CLOSES and not deep:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].name in SCOPES[name]:
                    break
                if open_[k].name in CLOSES[name]:
                    n = len(open_) - k
                    del open_[-n:]
                    yield from (("close", None),) * n
                    break
        new = element(name, attributes, open_)
        if len(open_) >= DEPTH:
            deep.append(new)
            continue
        open_.append(new)
        yield "open", new
    if found := block():
        yield "block", found
    yield from (("close", None),) * len(open_)


# --- wrappers -------------------------------------------------------------------------------------


@dataclass
class Node:
    """A tag with its children, or a text slot ("#"): on how many pages, whether repeated, whether optional,
    characters of text and of links, its text's hash as long as it is always the same, and what is against it.
    Nodes of a single page have their text too."""

    name: str
    children: list[Node] = field(default_factory=list)
    pages: int = 1
    repeated: bool = False
    optional: bool = False
    chars: int = 0
    links: int = 0
    constant: int | None = None
    hard: bool = False
    vote: int = 0
    text: str = ""
    keep: bool = True

    def packed(self) -> list:
        return [self.name, [c.packed() for c in self.children], self.pages, self.repeated, self.optional, self.chars, self.links, self.constant, self.hard, self.vote]

    @classmethod
    def unpacked(cls, x: list) -> Node:
        return cls(x[0], [cls.unpacked(c) for c in x[1]], *x[2:])

    @property
    def tag(self) -> str:
        return self.name.split(".")[0]

    def expression(self) -> str:
        """The wrapper as a regular expression over tags and text slots."""
        if self.name == "#":
            body = "#"
        else:
            body = f"<{self.name}>" + " ".join(c.expression() for c in self.children) + f"</{self.tag}>"
        if self.repeated:
            body = f"({body})+"
        return f"({body})?" if self.optional else body


def parsed(page: str) -> Node:
    """The tree of one page, with its texts."""
    root = Node("")
    stack = [root]
    for kind, what in events(page):
        if kind == "open":
            child = Node(what.signature, hard=what.hard, vote=what.vote)
            stack[-1].children.append(child)
            stack.append(child)
        elif kind == "close":
            done = stack.pop()
            if done.tag in GROUPS and all(c.name == "#" for c in done.children):
                done.name += ".~text"  # a line of text isn't a repetition of a group beside it
        else:
            stack[-1].children.append(Node("#", chars=len(what.text), links=what.links, constant=zlib.crc32(what.text.encode("utf-8", "replace")), hard=what.hard, text=what.text))
    return root


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """Both nodes as one: children aligned, those of one side only optional, differing text a slot."""
    constant = a.constant if a.constant == b.constant and not same_page else None
    out = Node(a.name, [], a.pages if same_page else a.pages + b.pages, a.repeated or b.repeated, a.optional or b.optional, a.chars + b.chars, a.links + b.links, constant, a.hard and b.hard, min(a.vote, b.vote))
    names_a, names_b = [c.name for c in a.children], [c.name for c in b.children]
    if names_a == names_b:
        out.children = [merge(x, y, same_page) for x, y in zip(a.children, b.children)]
        return out
    i = j = 0
    for k, m, n in SequenceMatcher(None, names_a, names_b, autojunk=False).get_matching_blocks():
        for c in (*a.children[i:k], *b.children[j:m]):
            c.optional = True
            out.children.append(c)
        out.children += [merge(x, y, same_page) for x, y in zip(a.children[k : k + n], b.children[m : m + n])]
        i, j = k + n, m + n
    out.children = neighbours(out.children)
    return out


def neighbours(children: list[Node]) -> list[Node]:
    """Neighbouring equal children as one repeated group."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].name == c.name:
            optional = out[-1].optional and c.optional
            out[-1] = merge(out[-1], c, same_page=True)
            out[-1].repeated, out[-1].optional = True, optional
        else:
            out.append(c)
    return out


def folded(node: Node) -> Node:
    """A page's tree as a wrapper: equal neighbours folded from the inside out, without texts."""
    out = Node(node.name, [folded(c) for c in node.children], node.pages, node.repeated, node.optional, node.chars, node.links, node.constant, node.hard, node.vote)
    out.children = neighbours(out.children)
    return out


def wrapper(page: str) -> Node:
    """The wrapper of one page."""
    return folded(parsed(page))


def size(node: Node) -> int:
    return 1 + sum(size(c) for c in node.children)


def generalised(node: Node, bare: bool = False) -> Node:
    """The wrapper with one repeated group for all groups of a name under a parent; ``bare`` names are tags
    without classes. All pages, characters and links stay counted."""
    if bare:
        node.name = node.tag if node.name else ""
    found: dict[str, Node] = {}
    for c in node.children:
        c = generalised(c, bare)
        if c.name in found:
            pages = max(found[c.name].pages, c.pages)
            found[c.name] = merge(found[c.name], c, same_page=True)
            found[c.name].repeated, found[c.name].pages = True, pages
        else:
            found[c.name] = c
    node.children = list(found.values())
    return node


def bounded(node: Node) -> Node:
    if size(node) > NODES:
        node = generalised(node)
        if size(node) > NODES:
            node = generalised(node, bare=True)
    return node


# --- what the wrapper keeps -----------------------------------------------------------------------


def judged(root: Node) -> Node:
    """The wrapper with ``keep`` set on every group and slot."""
    whole = 0

    def weigh(node: Node) -> int:
        """Characters of varying text outside links and hard elements; set as ``weight``."""
        if node.hard:
            node.weight = 0
        elif node.name == "#":
            constant = node.constant is not None and node.pages == root.pages > 1
            node.weight = 0 if constant else max(0, node.chars - 2 * node.links)
        else:
            node.weight = sum([weigh(c) for c in node.children])
            node.chars, node.links = sum(c.chars for c in node.children), sum(c.links for c in node.children)
        return node.weight

    def marked(node: Node) -> bool:
        return not node.hard and (node.tag in ("article", "main") and node.weight > 0 or any(marked(c) for c in node.children))

    def prose(node: Node) -> int:
        """Characters in paragraphs, headings and the like; set as ``prose``."""
        node.prose = 0 if node.name == "#" or node.hard else sum([prose(c) for c in node.children])
        if node.tag in WRITTEN and not node.hard:
            node.prose = node.chars
        return node.prose

    whole = weigh(root)
    prose(root)
    same = whole == 0  # all pages are alike: nothing varies, and nothing is the template
    if same:

        def again(node: Node) -> int:
            node.weight = 0 if node.hard else max(0, node.chars - 2 * node.links) if node.name == "#" else sum([again(c) for c in node.children])
            return node.weight

        whole = again(root)
    has_article = marked(root)

    def against(node: Node) -> bool:
        if node.hard:
            return True
        if node.tag in WRAPS:
            return 2 * node.weight < whole or has_article and not marked(node)
        if node.tag not in GROUPS or 2 * node.weight >= whole:
            return False
        menu = not has_article and node.links >= 0.8 * node.chars > 0
        return node.vote == 2 or not has_article and (node.vote == 1 and 2 * node.prose < node.chars or menu)

    def left(node: Node) -> int:
        """The weight without what is against it."""
        node.weight = 0 if against(node) else node.weight if node.name == "#" else sum([left(c) for c in node.children])
        return node.weight

    def mark(node: Node, keep: bool) -> None:
        node.keep = keep and not against(node)
        for c in node.children:
            mark(c, node.keep)

    mark(root, True)
    whole = left(root)
    weights: dict[str, int] = {}
    depth: dict[str, int] = {}

    def gather(node: Node, path: str) -> None:
        path = f"{path} {node.name}" if node.name else path
        if node.keep and node.name != "#":
            weights[path] = weights.get(path, 0) + node.weight
            depth[path] = path.count(" ")
            for c in node.children:
                gather(c, path)

    gather(root, "")
    last = lambda path: path.rsplit(" ", 1)[-1].split(".")[0]
    if has_article:
        container = max((p for p in weights if last(p) in ("article", "main")), key=lambda p: (weights[p], depth[p], p), default="")
    else:
        good = [p for p, w in weights.items() if p and whole and w >= 0.6 * whole and last(p) not in PROSE and last(p) not in ("tr", "tbody")]
        container = max(good, key=lambda p: (depth[p], weights[p], p), default="")

    def settle(node: Node, path: str, inside: bool, single: bool, prose: bool, doubted: bool) -> bool:
        """Keeps what is in the container and isn't the template; a group stays if anything in it does.

        In the container a constant text is the template only if a name or links speak against it too: what another page
        of the host repeats is no reason alone to drop an article's text.
        """
        path = f"{path} {node.name}" if node.name else path
        doubted = doubted or inside and node.vote > 0
        inside = inside or path == container
        single = single and not node.repeated
        if node.name == "#":
            template = single and not prose and not same and node.constant is not None and node.pages == root.pages > 1
            linked = node.links >= 0.8 * node.chars > 0
            node.keep = node.keep and inside and not (template and (doubted or linked or not container))
        else:
            prose = prose or node.tag in PROSE
            node.keep = any([settle(c, path, inside, single, prose, doubted) for c in node.children]) and node.keep
        return node.keep

    settle(root, "", not container, True, False, False)
    return root


def plan(node: Node) -> list:
    """The wrapper as [name, kept, children], without the insides of what isn't kept."""
    return [node.name, int(node.keep), [plan(c) for c in node.children] if node.keep else []]


def aligned(children: list[Node], slots: list[list]) -> list[list | None]:
    """For each child of a page's element its place in the wrapper: runs of equal children and the wrapper's
    groups are aligned in order, and what is left takes the first group of its name, or of its tag."""
    runs: list[list[int]] = []
    for i, c in enumerate(children):
        if runs and children[runs[-1][0]].name == c.name:
            runs[-1].append(i)
        else:
            runs.append([i])
    names, wanted = [children[r[0]].name for r in runs], [s[0] for s in slots]
    found: list[list | None] = [None] * len(runs)
    if names == wanted:
        found = list(slots)
    else:
        for k, m, n in SequenceMatcher(None, names, wanted, autojunk=False).get_matching_blocks():
            found[k : k + n] = slots[m : m + n]
        for k, name in enumerate(names):
            if found[k] is None:
                found[k] = next((s for s in slots if s[0] == name), None) or next((s for s in slots if s[0] == name.split(".")[0]), None)
    out: list[list | None] = [None] * len(children)
    for run, slot in zip(runs, found):
        for i in run:
            out[i] = slot
    return out


def kept_texts(node: Node, slot: list, out: list[str]) -> None:
    for child, at in zip(node.children, aligned(node.children, slot[2])):
        if at is None or not at[1] or child.hard:
            continue
        if child.name == "#":
            out.append(child.text)
        else:
            kept_texts(child, at, out)


def main_text(page: str | None, rules: list | None) -> str:
    """The texts of the page in the slots that its host's wrapper keeps, one to a line; a page without text there is
    its own wrapper."""
    if not page:
        return ""
    tree, out = parsed(page), []
    if rules is not None:
        kept_texts(tree, rules, out)
    if not out and tree.children:
        kept_texts(tree, plan(judged(folded(tree))), out)
    return "\n".join(out)


# --- jobs -----------------------------------------------------------------------------------------


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper, plan) of rows (host, html): the union-free expression and what it keeps.

    Each task aligns the pages it reads into one wrapper for each host, so that a host's pages are
    never gathered; the tasks' wrappers of a host are then aligned in order.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Node] = {}
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if page:
                    one = wrapper(page)
                    found[host] = merge(found[host], one) if host in found else one
                    if found[host].pages & 63 == 0:
                        found[host] = bounded(found[host])
            if len(found) > 5000:
                yield sent(found)
                found = {}
        if found:
            yield sent(found)

    def sent(found: dict[str, Node]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([json.dumps(bounded(n).packed()) for n in found.values()])], ["host", "node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, node = None, None
        for batch in batches:
            for at, blob in zip(batch.column("host").to_pylist(), batch.column("node").to_pylist()):
                part = Node.unpacked(json.loads(blob))
                if at != host:
                    if node is not None:
                        yield result(host, node)
                    host, node = at, part
                else:
                    node = bounded(merge(node, part))
        if node is not None:
            yield result(host, node)

    def result(host: str, node: Node) -> pa.RecordBatch:
        expression, pages_ = node.expression(), node.pages
        return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([pages_], pa.int64()), pa.array([expression]), pa.array([json.dumps(plan(judged(node)))])], ["host", "pages", "wrapper", "plan"])

    parts = pages.mapInArrow(fold, "host string, node string")
    return parts.repartition("host").sortWithinPartitions("host", "node").mapInArrow(join, "host string, pages long, wrapper string, plan string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row (page_id, url, html).

    Kept is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments, as blocks in page order, white space in a block as one space, character references
    decoded. Null and empty pages have an empty text, and so have pages without text outside the
    dropped elements. Pages without a url are one host. Whole pages are read; repeated rows are returned
    as often as they come. Input columns may have any name. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    rules = written(infer(rows.select("host", "html")), "html-wrappers").select("host", "plan")
    if (rules.agg(F.sum(F.length("plan"))).first()[0] or 0) <= BROADCAST_CHARS:
        rules = F.broadcast(rules)
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            out = []
            for page, rule in zip(*(batch.column(c).to_pylist() for c in ("html", "plan"))):
                if rule is not None and rule not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[rule] = json.loads(rule)
                out.append(main_text(page, known.get(rule)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(rules, "host", "left").select("page_id", "url", "html", "plan").mapInArrow(run, schema)
