"""Main text of web pages by a site style tree.

The DOMs of a host are merged into one tree of style nodes, a node being a path of element
names and first classes.  A node carries how its presentation (the sequence of its children)
and its content (the text of its branch) are distributed over its occurrences on the host;
the larger of the two normalised entropies is its importance.  A value counts once for each
article that it stands beside, whatever the number of pages with that article or of its places
on a page.  A branch goes if it repeats itself clearly more often than the branch beside it
that holds most of the text; that branch itself and text elements never go by entropy.  Parts
that entropy cannot tell, because their words differ on every page as those of reader comments
do, go by their element or class names.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from . import common

#: Beside a branch with most of the text, a node goes whose lack of importance (1 - importance) is more
#: than so many times that of the main branch and more than that of so many pairs of equal texts.
TIMES_MAIN, LEAST_PAIRS = 2.0, 2.0
#: Low nodes of all hosts up to which the table is broadcast; beyond, pages are joined by shuffle.
BROADCAST_NODES = 500_000

# Element and class names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr td th".split())
#: Elements that show no text, or none that is read.
UNSEEN = frozenset("head script style noscript template iframe svg canvas object embed select textarea xmp noembed noframes title".split())
#: Elements that hold no part of an article wherever they stand.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg canvas object embed button select textarea dialog menu xmp noembed noframes title".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation topnav sidebar sidebars aside cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription share sharing social breadcrumb breadcrumbs comment comments commentlist disqus respond replies reply related "
    "recommended recommendations footer widget widgets pagination pager toolbar login signup search copyright".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: What a class name says about the element around a part, not about the part.
ABOUT_OTHERS = frozenset("has with no without open".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tbody": ("thead tbody tfoot tr td th", ("table",)),
    "tfoot": ("thead tbody tfoot tr td th", ("table",)),
    "option": ("option", ("select",)),
}
#: Text elements: beside a main branch they are part of the article more often than not, so entropy does not judge them.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li ul ol dl dt dd blockquote pre figure figcaption table tr td th tbody thead tfoot hgroup address summary details html body main article".split()) | INLINE
CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in CLOSES.items()}

TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|[^<]+|<", re.S)
ATTRIBUTES = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def _noisy(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
        if parts and parts[0] not in ABOUT_OTHERS and (parts[0] in NOISE_NAMES or parts[-1] in NOISE_NAMES or (parts[-1] == "header" and not in_article)):
            return True
    return False


class _Open:
    """An element whose end is not reached: its style node and what its branch holds so far."""

    __slots__ = ("tag", "node", "parent", "dropped", "scope", "children", "content", "mass", "container")

    def __init__(self, tag: str, node: int, parent: int, dropped: bool, scope: int):
        self.tag, self.node, self.parent, self.dropped, self.scope = tag, node, parent, dropped, scope
        self.children = self.content = self.mass = 0
        self.container = False


class Page:
    """Text blocks of a page outside dropped branches, and the style nodes of all branches.

    Blocks are (text, scope: 2 in an article, 1 in main, 0 elsewhere); nodes are (node, parent,
    may be judged by its neighbours, holds blocks, children, content or None, length of its text).
    All values of a node are digests that grow along the way, so deep pages cost no more than flat ones.
    """

    def __init__(self, source: str | None, low: frozenset[int] = frozenset(), names: bool = True):
        self.blocks: list[tuple[str, int]] = []
        self.nodes: list[tuple] = []
        self._low, self._names = low, names
        self._stack: list[_Open] = []
        self._count: Counter = Counter()
        self._text: list[str] = []
        self._read(source or "")

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                if not self._stack:
                    self.blocks.append((text, 0))
                    return
                top = self._stack[-1]
                top.content = _digest(text, top.content)
                top.mass += len(text)
                if not top.dropped:
                    self.blocks.append((text, top.scope))

    def _pop(self) -> None:
        top = self._stack[-1]
        if top.tag not in INLINE:
            self._flush()
        self._stack.pop()
        self._count[top.tag] -= 1
        if self._stack:
            above = self._stack[-1]
            above.container |= top.tag not in INLINE
            if top.mass:
                above.content = _digest(top.content.to_bytes(8, "little"), above.content)
                above.mass += top.mass
        self.nodes.append((top.node, top.parent, top.tag not in TEXT_TAGS, top.container, top.children, top.content if top.mass else None, top.mass))

    def _close(self, tag: str) -> None:
        if self._count[tag]:
            while self._stack[-1].tag != tag:
                self._pop()
            self._pop()

    def _open(self, tag: str, raw: str) -> None:
        stack = self._stack
        if tag in INLINE:
            if tag in ("td", "th"):
                self._text.append(" ")
            elif "class" not in raw and "role" not in raw and "id" not in raw:
                return  # plain inline markup, often never closed, has no say
        else:
            self._flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    while len(stack) > i:
                        self._pop()
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES and any(self._count[x] for x in CLOSES[tag][0]):
            ends, scope = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ends:
                    while len(stack) > i:
                        self._pop()
        if tag in VOID:
            return
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTES.findall(raw)} if raw else {}
        above = stack[-1] if stack else None
        scope = above.scope if above else 0
        dropped = bool(above and above.dropped) or tag in UNSEEN or (self._names and _noisy(tag, attributes, scope == 2))
        if not self._names:
            scope = 0
        elif tag == "article":
            scope = 2
        elif (tag == "main" or attributes.get("role") == "main") and scope < 1:
            scope = 1
        classes = attributes.get("class", "").split()
        name = f"{tag}.{classes[0]}" if classes else tag
        if above:
            above.children = _digest(name, above.children)
        parent = above.node if above else 0
        node = _digest(name, parent)
        stack.append(_Open(tag, node, parent, dropped or node in self._low, scope))
        self._count[tag] += 1

    def _read(self, source: str) -> None:
        at, find = 0, TOKENS.match
        while at < len(source):
            m = find(source, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    self._text.append(html.unescape(piece) if "&" in piece else piece)
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "br" or (tag not in INLINE and not self._count[tag]):
                    self._flush()
                elif tag not in INLINE or tag in ("td", "th"):
                    self._close(tag)
                elif self._stack and self._stack[-1].tag == tag:
                    self._pop()
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(source, at)
                self._open(tag, m[3])
                at = end.end() if end else len(source)
                self._text = []
                self._stack and self._stack[-1].tag == tag and self._pop()
                continue
            if tag in ("br", "hr"):
                self._flush()
                continue
            self._open(tag, m[3])
        while self._stack:
            self._pop()
        self._flush()

    def _kept(self) -> list[str]:
        scope = max([b[1] for b in self.blocks], default=0)
        return [b[0] for b in self.blocks if b[1] == scope]

    def text(self) -> str:
        """The blocks of the articles if there are any, else of main, else all."""
        return "\n".join(self._kept())

    def anchor(self) -> int:
        """What stands for the article of the page: its longest block."""
        return _digest(max(self._kept(), key=lambda t: (len(t), t), default=""), 0)


def _digest(part: str | bytes, before: int) -> int:
    return xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass") if isinstance(part, str) else part, seed=before)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_COUNTS = "host string, node long, parent long, movable boolean, container boolean, kind int, value long, anchor long, mass long"


def style_counts(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, node, kind, value, n, mass, parent, movable, container: beside how many articles a
    style node has a value, and the characters of text in it.

    Kind 0 is presentation, 1 content.  Pages with the same longest block hold the same article.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source, names=names)
            anchor = page.anchor() - 2**63
            for node, parent, movable, container, children, content, mass in page.nodes:
                key = (host, node - 2**63, parent - 2**63, movable, container)
                seen[*key, 0, children - 2**63, anchor] += 0
                if mass:
                    seen[*key, 1, content - 2**63, anchor] += mass
        columns = list(zip(*[(*k, n) for k, n in seen.items()], strict=True)) if seen else [()] * 9
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _COUNTS.split(", ")])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    each = common.map_batches(rows, run, _COUNTS)
    node = [F.sum("mass").alias("mass"), F.first("parent").alias("parent"), F.first("movable").alias("movable"), F.max("container").alias("container")]
    once = each.groupBy("host", "node", "kind", "value", "anchor").agg(*node)
    return once.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"), *node)


def importance(counts: DataFrame) -> DataFrame:
    """Per host and node: parent, movable, container, occurrences, mass, content (has text), importance.

    Importance is the larger of both normalised entropies.  Entropy over log of the
    occurrences: 0 where a node always has one value, 1 where never twice.  Occurrences are
    those of content.
    """
    node = [F.sum("mass").alias("mass"), F.first("parent").alias("parent"), F.first("movable").alias("movable"), F.max("container").alias("container")]
    n = F.col("n").cast("double")
    each = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(n * F.log(n)).alias("s"), *node)
    log_m = F.log(F.col("m").cast("double"))
    h = F.when(F.col("m") > 1, (log_m - F.col("s") / F.col("m")) / log_m).otherwise(1.0)
    occurrences = F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("m"))), F.lit(0))
    return each.withColumn("h", h).groupBy("host", "node").agg(occurrences.alias("occurrences"), F.max("h").alias("importance"), *node).withColumn("content", F.col("occurrences") > 0)


def low_nodes(pages: DataFrame, names: bool = True) -> DataFrame:
    """Per host with any: low, the array of style nodes that hold text and are of low importance.

    Only branches beside a main branch are judged: one that holds blocks and more than half of
    the text of its parent.  A node needs as much evidence on a small host as on a large one.
    """
    judged = common.cut(importance(style_counts(pages, names)).filter("content"), "style-nodes")
    main = judged.groupBy("host", "parent").agg(F.max_by(F.struct("importance", "container", "mass"), F.struct("mass", "node")).alias("main"), F.sum("mass").alias("whole"))
    main = main.filter("main.container and 2 * main.mass > whole").select(F.col("host").alias("_host"), F.col("parent").alias("_parent"), F.col("main.importance").alias("best"), F.col("main.mass").alias("most"))
    lack, m = 1 - F.col("importance"), F.col("occurrences").cast("double")
    # Content that k pairs of articles share, and nothing else: entropy lacks 2 k log 2 / (m log m).
    pairs = lack * m * F.log(m) / F.lit(2 * 0.6931471805599453)
    both = judged.filter("movable").join(main, F.col("host").eqNullSafe(F.col("_host")) & (F.col("parent") == F.col("_parent")))
    low = both.filter((F.col("mass") < F.col("most")) & (lack > TIMES_MAIN * (1 - F.col("best"))) & (pairs >= LEAST_PAIRS - 1e-9))
    return low.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("low"))


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """``pages`` with text and n_chars (code points) instead of html.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by one newline in page order.  Null and empty html give an empty text.  A branch
    that nothing on its host repeats is judged by names; without ``names`` the style tree decides
    alone: neither names nor article elements have a say.  Repeated rows give repeated results
    and count as one page of their host; pages without a url share a host; other columns stay,
    those named like a new one are replaced; an empty table gives no rows.
    """
    low = common.cut(low_nodes(pages, names), "low-nodes")
    size = low.agg(F.sum(F.size("low"))).first()[0] or 0  # checked before it is broadcast
    side = low.select(F.col("host").alias("__qw_host"), F.col("low").alias("__qw_low"))
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(*kept, F.col("html").cast("string").alias("__qw_html"), host_of(F.col("url")).alias("__qw_page_host"))
    joined = rows.join(F.broadcast(side) if size <= BROADCAST_NODES else side, rows["__qw_page_host"] == side["__qw_host"], "left").select(*kept, "__qw_html", "__qw_low")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = len(kept)
        sets: dict[tuple, frozenset[int]] = {}
        texts = []
        for source, low in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
            key = tuple(low or ())
            if (known := sets.get(key)) is None:
                known = sets[key] = frozenset(x + 2**63 for x in key)
            texts.append(Page(source, known, names).text())
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())], names=[*kept, "text", "n_chars"])

    schema = StructType([pages.schema[c] for c in kept]).add("text", StringType()).add("n_chars", LongType())
    return common.map_batches(joined, run, schema)
