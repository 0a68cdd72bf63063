"""Operator 10, main text of web pages by wrapper induction.

Pages of a host share a template. Each page's element tree is aligned with that of one base page
of its host by simple tree matching (the most nodes that match in order, level by level). A block of
text has its place by the nearest ancestor that matches a base node, and the labels below it. Over all
distinct pages of the host each place's texts are counted: a text that CONSTANT of the pages with that
place share (LEAST pages at least) is template, as is a place outside an article that holds nothing
but links on most pages; what varies are slots, and slots are content. Elements that
say another role (menu, header, footer, sidebar, notice, advert, form, comments) by tag or name are no
slots. A name counts only as the noun of a class or id ("cookie-notice" is one, "notice-of-intent" is
none), never on html, body, main and article, and a header's never within an article, where an id of a section,
heading or paragraph is an anchor and names comments at most. A form is no content unless its text outweighs
its fields (pages set whole into one). Where a page marks an article, only slots in it count, unless the text
beside it outweighs it: then marked articles are teasers, and go. A heading that most pages have stays where what
follows it stays. A page whose slots are all constant (copies) keeps them.

Counts are pre-aggregated before they are shuffled. Base pages are sent to all tasks only if they are
few bytes (BROADCAST_BYTES); else they are joined by host.

Defined results: null or empty html gives the empty text; a null url is a host of its own; broken,
cut or deeply nested markup is read as far as it goes; repeated pages are extracted one by one and
count as one page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, materialise, remembers, slices

CONSTANT, LEAST, LINKED = 0.5, 3, 0.5
BROADCAST_BYTES = 32_000_000
#: Cells of one alignment table; longer child lists are cut at common ends, single labels and halves.
MATCH_CELLS = 250_000

# Elements without end tag, elements that begin a block, elements and names that are no article text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_OTHER = frozenset("aside button canvas dialog footer form head header iframe input menu nav noscript object option script select style svg template textarea title".split())
_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_HEADS = frozenset("banner header masthead".split())
#: Words that say what an element holds others in, not what it is about; and those that deny a name.
_HOLDERS = frozenset("area articles bar block box buttons container inner items left links list panel posts region right row section slot stories unit wrap wrapper".split())
_DENIALS = frozenset("has hide is no not with without".split())
_ROLES = frozenset("banner complementary contentinfo dialog form navigation search alert".split())
#: A start tag of these ends open elements of the listed kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|</?[a-zA-Z!?][^>]*\Z""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_FORM_END, _FIELD, _FIELD_TEXT, _TAG = re.compile(r"</form\b", re.I), re.compile(r"<(?:input(?![^>]*hidden)|select|textarea|button)\b", re.I), re.compile(r"<(label|option|select|button|textarea|script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S), re.compile(r"<[^>]*>")
#: Characters of text that outweigh a form, and so many more for each of its fields.
FORM_TEXT, FIELD_TEXT = 200, 100
#: By how much the text beside marked articles outweighs them, and an article's text that of a teaser.
BESIDE, TEASER, LEAST_TEXT = 2, 4, 200
#: Elements within an article whose id is an anchor, and what it may name all the same.
_ANCHORED, _READERS = frozenset("section p li dl figure h1 h2 h3 h4 h5 h6".split()), frozenset("comment comments commentlist disqus".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}


class Node:
    __slots__ = ("tag", "label", "up", "kids", "off", "inside", "linked", "article", "shape", "at")

    def __init__(self, tag: str, label: str, up: Node | None, off: bool, inside: bool):
        self.tag, self.label, self.up, self.off, self.inside = tag, label, up, off, inside
        self.linked = tag == "a" or up is not None and up.linked
        # the outermost marked article that holds it
        self.article: Node | None = up.article if up is not None and up.article is not None else self if tag == "article" and inside else None
        self.kids: list[Node] = []
        self.shape = self.at = -1


def _named_role(word: str, inside: bool) -> bool:
    """Whether a class or id names a role: its noun, when words for holders are taken off its end."""
    if word in _NAMES:
        return not (inside and word in _HEADS)
    parts = _NAME.findall(word)
    if not parts or parts[0] in _DENIALS:
        return False
    while len(parts) > 1 and (parts[-1] in _HOLDERS or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in _NAMES and not (inside and parts[-1] in _HEADS)


def _role_off(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """The class part of an element's label, and whether its role is another than content."""
    off = tag in _OTHER and not (inside and tag == "header")
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return "", off
    label, named = "", tag not in ("html", "body", "main", "article")
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            label = label or value if name == "class" else label
            words = value.lower().split()
            if name == "id" and inside and tag in _ANCHORED:
                words = [x for x in words if _READERS.intersection(_NAME.findall(x)[-1:])]
            off = off or named and any(_named_role(x, inside) for x in words)
        elif name == "role":
            off = off or value.lower() in _ROLES and not (inside and value.lower() in _HEADS)
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            off = True
    return label, off


def _form_holds_text(page: str, at: int) -> bool:
    """Whether the text of a form that begins at a place outweighs its fields."""
    end = _FORM_END.search(page, at)
    form = page[at : end.start() if end else len(page)]
    if len(form) < FORM_TEXT:
        return False
    fields = len(_FIELD.findall(form))
    return len(" ".join(_TAG.sub(" ", _FIELD_TEXT.sub(" ", form)).split())) >= FORM_TEXT + FIELD_TEXT * fields


def chosen(order: list[tuple[str, Node, bool]]) -> list[tuple[str, Node, bool]]:
    """The blocks that can be content, by where the text of the page is: in marked articles, in the rest of a main
    element, or beside both."""
    able = [x for x in order if not x[1].off]
    sizes: dict[Node | str, int] = {}
    where = []
    for block, owner, links in able:
        at: Node | str = owner.article or ("main" if owner.inside else "beside")
        where.append(at)
        sizes[at] = sizes.get(at, 0) + (0 if links else len(block))
    if not any(x[1].inside for x in able):
        return able
    inside, beside, main = sum(n for at, n in sizes.items() if at != "beside"), sizes.get("beside", 0), sizes.get("main", 0)
    if beside >= LEAST_TEXT and beside > BESIDE * inside:
        own, left_out = beside, {"main"}
    else:
        own, left_out = main, {"beside"}
    if own >= LEAST_TEXT:
        left_out |= {at for at, n in sizes.items() if not isinstance(at, str) and TEASER * n < own}
    return [x for x, at in zip(able, where) if at not in left_out]


def parse(page: str) -> tuple[Node, list[tuple[str, Node, bool]], bool]:
    """The element tree, the text blocks in page order with their elements and whether they are mostly
    links, and whether the page has an article."""
    root = Node("#root", "#root", None, False, False)
    stack, order, text, marked = [root], [], [], False
    opened: dict[str, int] = {}
    at, find, sizes = 0, _TOKEN.search, [0, 0]

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                owner = next(x for x in reversed(stack) if x.tag in _BLOCK or x is root)
                order.append((block, owner, sizes[1] >= LINKED * sizes[0]))
            sizes[:] = 0, 0

    def add(piece: str) -> None:
        text.append(piece)
        size = len(piece.strip())
        sizes[0] += size
        sizes[1] += size * stack[-1].linked

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while m := find(page, at):
        if m.start() > at and not stack[-1].off:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                if any(x.tag in _BLOCK for x in stack[k:]):
                    flush()
                close(k)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in _BLOCK:
                        break
        if tag in _ENDS and any(opened.get(x) for x in _ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _HOLDS[tag]:
                    break
                if stack[k].tag in _ENDS[tag]:
                    close(k)
                    break
        if tag == "br":
            text.append(" ")
        up = stack[-1]
        name, off = _role_off(tag, m[3], up.inside)
        if tag == "form" and off and not up.off and _form_holds_text(page, at):
            off = False
        inside = up.inside or tag in ("article", "main") and not up.off
        marked = marked or inside
        node = Node(tag, f"{tag}.{name}" if name else tag, up, up.off or off, inside)
        up.kids.append(node)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page) and not stack[-1].off:
        add(page[at:])
    flush()
    return root, order, marked


class Wrapper:
    """Simple tree matching of pages against one base page; matched values are kept by shape."""

    def __init__(self, base: str):
        self.shapes: dict[tuple, int] = {}
        self.known: dict[tuple[int, int], int] = {}
        self.root, self.size, stack = parse(base)[0], 0, []
        stack = [self.root]
        while stack:
            node = stack.pop()
            node.at = self.size
            self.size += 1
            stack.extend(reversed(node.kids))
        self._shape(self.root)

    def _shape(self, root: Node) -> None:
        todo = [(root, False)]
        while todo:
            node, done = todo.pop()
            if done or not node.kids:
                key = (node.label, *[k.shape for k in node.kids])
                node.shape = self.shapes.setdefault(key, len(self.shapes))
            else:
                todo.append((node, True))
                todo.extend((k, False) for k in node.kids)

    def _value(self, a: Node, b: Node) -> int:
        """Nodes matched below two elements of one label, themselves included; inner pairs come first."""
        if not a.kids or not b.kids:
            return 1
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            key = (x.shape, y.shape)
            if key in self.known:
                todo.pop()
                continue
            xs = {k.shape: k for k in x.kids if k.kids}.values()
            ys = {k.shape: k for k in y.kids if k.kids}.values()
            inner = [(i, j) for i in xs for j in ys if i.label == j.label and (i.shape, j.shape) not in self.known]
            if inner:
                todo += inner
                continue
            todo.pop()
            if len(x.kids) * len(y.kids) > MATCH_CELLS:
                self.known[key] = 1 + sum(self.known.get((i.shape, j.shape), 1) for i, j in self._pairs(x.kids, y.kids))
            else:
                self.known[key] = 1 + self._table(x.kids, y.kids)[-1][-1]
        return self.known[a.shape, b.shape]

    def _table(self, xs: list[Node], ys: list[Node]) -> list[list[int]]:
        prev = [0] * (len(ys) + 1)
        table = [prev]
        value = self._value
        for x in xs:
            row, left = [0], 0
            for j, y in enumerate(ys):
                best = prev[j + 1] if prev[j + 1] > left else left
                if x.label == y.label and (both := prev[j] + value(x, y)) > best:
                    best = both
                row.append(best)
                left = best
            table.append(row)
            prev = row
        return table

    def match(self, page_root: Node) -> dict[int, int]:
        """Page node (by identity) -> base node number."""
        if len(self.shapes) > 200_000 or len(self.known) > 200_000:
            self.shapes, self.known = {}, {}
            self._shape(self.root)
        self._shape(page_root)
        out, todo = {id(page_root): self.root.at}, [(page_root, self.root)]
        while todo:
            a, b = todo.pop()
            for x, y in self._pairs(a.kids, b.kids):
                out[id(x)] = y.at
                if x.kids and y.kids:
                    todo.append((x, y))
        return out

    def _pairs(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """Children matched in order. Lists too long for a table are cut where both begin or end alike,
        then at labels that both hold once, then in halves, until tables take them."""
        out, todo = [], [(xs, ys)]
        while todo:
            xs, ys = todo.pop()
            if not xs or not ys:
                continue
            labels, others = [x.label for x in xs], [y.label for y in ys]
            if labels == others and (len(set(labels)) == len(labels) or len({x.shape for x in xs} | {y.shape for y in ys}) == 1):
                out += zip(xs, ys)
            elif len(xs) * len(ys) <= MATCH_CELLS:
                out += self._traced(xs, ys)
            else:
                todo += self._cut(xs, ys, labels, others, out)
        return out

    def _cut(self, xs: list[Node], ys: list[Node], labels: list[str], others: list[str], out: list) -> list[tuple[list, list]]:
        n, head = min(len(xs), len(ys)), 0
        while head < n and labels[head] == others[head]:
            head += 1
        tail = 0
        while tail < n - head and labels[-tail - 1] == others[-tail - 1]:
            tail += 1
        out += zip(xs[:head], ys[:head])
        if tail:
            out += zip(xs[-tail:], ys[-tail:])
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        labels, others = labels[head : head + len(xs)], others[head : head + len(ys)]
        if len(xs) * len(ys) <= MATCH_CELLS:
            return [(xs, ys)]
        where = {x: j for j, x in enumerate(others) if others.count(x) == 1} if len(set(others)) > 1 else {}
        i = next((i for i in sorted(range(len(xs)), key=lambda i: abs(2 * i - len(xs))) if labels[i] in where and labels.count(labels[i]) == 1), None) if where else None
        if i is None:
            return [(xs[: len(xs) // 2], ys[: len(ys) // 2]), (xs[len(xs) // 2 :], ys[len(ys) // 2 :])]
        j = where[labels[i]]
        out.append((xs[i], ys[j]))
        return [(xs[:i], ys[:j]), (xs[i + 1 :], ys[j + 1 :])]

    def _traced(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        table, out, i, j = self._table(xs, ys), [], len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out


def _place(owner: Node, to: dict[int, int]) -> int:
    """Where a block stands: a hash of its nearest matched ancestor's base node and the labels below it,
    so that a list's items have one place however many there are."""
    labels = []
    while owner.up is not None:
        labels.append(owner.label)
        owner = owner.up
        if id(owner) in to:
            break
    return xxhash.xxh64_intdigest("\0".join([str(to[id(owner)]), *labels])) - (1 << 63)


_BLOCKS = "array<struct<text:string,place:long,value:long,links:boolean,head:boolean>>"
_WRAPPERS: dict[str, Wrapper] = {}
remembers("wrappers", _WRAPPERS.clear)


def aligned(pages: DataFrame, sent) -> DataFrame:
    """page_id, url, host, page (a digest) and its slots: blocks of possible content, each with its place,
    a hash of its text and whether it is mostly links outside an article. One pass over the pages; base
    pages are those of `sent` by host, or without it of the column base."""

    def run(batches):
        keep_only("wrappers")
        kind = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int64()), ("value", pa.int64()), ("links", pa.bool_()), ("head", pa.bool_())]))
        for b in slices(batches, rows=256):
            out, digests = [], []
            hosts = b.column("host").to_pylist()
            bases = map(sent.value.get, hosts) if sent else b.column("base").to_pylist()
            for host, page, base in zip(hosts, b.column("html").to_pylist(), bases):
                wrapper = _WRAPPERS.get(host)
                if wrapper is None or wrapper.source != base:
                    if len(_WRAPPERS) >= 64:
                        _WRAPPERS.clear()
                    wrapper = _WRAPPERS[host] = Wrapper(base or "")
                    wrapper.source = base
                root, order, _ = parse(page or "")
                to = wrapper.match(root)
                slots = []
                for block, owner, links in chosen(order):
                    value = xxhash.xxh64_intdigest(block) - (1 << 63)
                    slots.append({"text": block, "place": _place(owner, to), "value": value, "links": links and not owner.inside, "head": owner.tag in _HEADINGS})
                out.append(slots)
                digests.append(xxhash.xxh64_intdigest(page or "") - (1 << 63))
            columns = [b.column("page_id"), b.column("url"), b.column("host"), pa.array(digests, pa.int64()), pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "page", "slots"])

    columns = ["page_id", "url", "host", "html"] + ["base"] * (not sent)
    return pages.select(columns).mapInArrow(run, f"page_id long, url string, host string, page long, slots {_BLOCKS}")


def templates(slots: DataFrame) -> DataFrame:
    """Per host its template: values (place and text that are constant) and links (places of links)."""
    seen = slots.select("host", "page", F.explode("slots").alias("s")).select("host", "page", "s.place", "s.value", "s.links").distinct()
    pages = seen.groupBy("host", "place").agg(F.count_distinct("page").alias("pages"), F.count_distinct(F.when(~F.col("links"), F.col("page"))).alias("texts"))
    pages = pages.filter(F.col("pages") >= LEAST)
    same = seen.groupBy("host", "place", "value").agg(F.count_distinct("page").alias("same")).filter(F.col("same") >= LEAST)
    constant = same.join(pages, ["host", "place"]).filter(F.col("same") >= CONSTANT * F.col("pages"))
    values = constant.groupBy("host").agg(F.collect_set(F.struct("place", "value")).alias("values"))
    links = pages.filter(F.col("texts") <= (1 - LINKED) * F.col("pages")).groupBy("host").agg(F.collect_set("place").alias("links"))
    return values.join(links, "host", "full_outer")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    order = F.xxhash64("html")
    chosen = materialise(src.groupBy("host").agg(F.min(F.struct(order.alias("o"), F.octet_length("html").alias("size"))).alias("c")).select("host", "c.o", "c.size"), "base-pages")
    few = (chosen.agg(F.sum(F.coalesce("size", F.lit(0)) + F.octet_length("host") + 100)).first()[0] or 0) <= BROADCAST_BYTES
    # a written table is shuffled by itself, so that the pages of a hot host can be split in the join
    join = F.broadcast if few else (lambda df: materialise(df, "by-host"))
    bases = src.withColumn("o", order).join(join(chosen.select("host", "o")), ["host", "o"]).groupBy("host").agg(F.min("html").alias("base"))
    if few:
        sent = src.sparkSession.sparkContext.broadcast({r.host: r.base for r in bases.collect()})
        slots = materialise(aligned(src, sent), "page-slots")
    else:
        slots = materialise(aligned(src.join(join(bases), "host", "left"), None), "page-slots")
    template = materialise(templates(slots), "page-templates")
    template = F.broadcast(template) if few else template
    constant = lambda s: F.coalesce(F.array_contains("values", F.struct(s["place"], s["value"])), F.lit(False))
    linked = lambda s: s["links"] & F.coalesce(F.array_contains("links", s["place"]), F.lit(False))
    marked = F.transform("slots", lambda s: F.struct(s["text"].alias("text"), s["head"].alias("head"), (constant(s) | linked(s)).alias("gone")))
    varies = lambda i: F.coalesce(~F.get("marked", i)["gone"], F.lit(False))
    # a constant heading stays before what stays, through one more heading at most
    leads = lambda i: varies(i + 1) | (F.coalesce(F.get("marked", i + 1)["head"], F.lit(False)) & varies(i + 2))
    kept = F.filter("marked", lambda s, i: ~s["gone"] | (s["head"] & leads(i)))
    some = F.exists("marked", lambda s: ~s["gone"])
    out = slots.join(template, "host", "left").select("page_id", "url", marked.alias("marked")).select("page_id", "url", F.when(some, kept).otherwise(F.col("marked")).alias("kept"))
    text = F.array_join(F.transform("kept", lambda s: s["text"]), "\n")
    return out.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
