"""Main text of web pages by wrappers induced from pages of the same host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.skew import broadcast_if_small
from shelfcast.session import store_table

# Share of a host's pages that must agree on a text for it to be template, and the least pages: in general,
# and inside the element that the page itself marks as its article.
CONSTANT_SHARE, CONSTANT_PAGES = 0.5, 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.9, 5

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
# Elements that are no part of an article, and words of class, id and role that say the same.
SKIP = frozenset("head nav footer aside form script style noscript template iframe svg canvas button select option "
                 "textarea dialog menu object video audio title input".split())
SKIP_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|side-?bar\w*|footer\w*|"
    r"cookies?|consent|notice\w*|newsletter|subscri\w*|sign-?up|shar(?:e|ing)|social\w*|comments?|repl(?:y|ies)|"
    r"respond|related|breadcrumbs?|pop-?up|modal|overlay|log-?in|search\w*|widget\w*|toolbar|pagination|pager|disqus|"
    r"hidden|navigation|contentinfo|complementary|alert|masthead|topbar|skip-?link)(?:$|[^a-z])")
HEADER_WORDS = re.compile(r"(?:^|[^a-z])header(?:$|[^a-z])")
MAIN_WORDS = re.compile(r"(?:^|[^a-z])(?:main|articlebody|article-?body|post-?content|entry-?content|article)(?:$|[^a-z])")

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[!?][^>]*(?:>|$)",
                   re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

BLOCK = "struct<slot: int, text: string, hash: bigint, link_chars: int, inside: boolean>"


class Node:
    """An element of the page, with equal neighbouring block elements folded into one."""

    __slots__ = ("children", "link", "main", "number", "sign", "skip", "tag")

    def __init__(self, tag: str, sign: str, skip: bool, main: bool, link: bool):
        self.tag, self.sign, self.skip, self.main, self.link = tag, sign, skip, main, link
        self.children: list[Node] = []
        self.number = 0


def _attributes(raw: str) -> tuple[str, str]:
    """Words of class and id, and of role and itemprop, of a start tag; ``hidden`` counts as a word."""
    names, roles = [], []
    for name, a, b, c in ATTRIBUTE.findall(raw):
        value = (a or b or c).lower()
        if name.lower() == "hidden":
            names.append("hidden")
        else:
            (roles if name.lower() in ("role", "itemprop") else names).append(value)
    return " ".join(names), " ".join(roles)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int, bool]]]:
    """The folded element tree of a page and its text blocks outside skipped elements: element, text,
    characters inside links, and whether an article or main element holds it.

    Broken markup is read leniently: unknown end tags are ignored, open elements end with the page, and a
    block element ends an open paragraph.
    """
    root = Node("#root", "#root", False, False, False)
    stack = [root]
    blocks: list[tuple[Node, str, int, bool]] = []
    run: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                holder = next(n for n in reversed(stack) if n.tag not in INLINE)
                blocks.append((holder, text, linked, holder.main))
            run.clear()
        linked = 0

    def add_text(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and not top.skip:
            run.append(raw)
            if top.link:
                linked += len(raw.strip())

    at = 0
    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            add_text(page[at:])
            break
        add_text(page[at:token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag not in INLINE:
                close_block()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag not in INLINE:
            close_block()
            if stack[-1].tag in INLINE or stack[-1].tag == "p":
                # A block element ends the paragraph it is written in, with the inline elements opened there.
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        del stack[depth:]
                        break
                    if stack[depth].tag not in INLINE:
                        break
        if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack[-1].tag == tag:
            stack.pop()
        if tag in VOID:
            continue
        parent = stack[-1]
        names, roles = _attributes(token[3]) if "=" in token[3] or "hidden" in token[3] else ("", "")
        words = f"{names} {roles}"
        skip = (parent.skip or tag in SKIP or bool(words.strip() and SKIP_WORDS.search(words))
                or (not parent.main and (tag == "header" or bool(HEADER_WORDS.search(words)))))
        main = parent.main or (not skip and (tag in ("article", "main") or bool(MAIN_WORDS.search(roles))))
        sign = f"{tag}.{names}" if names and tag not in INLINE else tag
        node = Node(tag, sign, skip, main, parent.link or tag == "a")
        if tag in INLINE:
            pass  # text of inline elements belongs to the block around them
        elif parent.children and parent.children[-1].sign == sign:
            folded = parent.children[-1]
            folded.skip, folded.main = folded.skip and skip, folded.main or main
            node = folded if folded.skip == skip and folded.main == main else node
        else:
            holder = next(n for n in reversed(stack) if n.tag not in INLINE)
            holder.children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = end.start() if end else len(page)
        if not token[3].endswith("/"):
            stack.append(node)
    close_block()
    _number(root, 0)
    return root, blocks


def _number(node: Node, first: int) -> int:
    node.number = first
    for child in node.children:
        first = _number(child, first + 1)
    return first


def shape(node: Node) -> str:
    """The tree as text: signs in nested brackets."""
    inner = "".join(shape(c) for c in node.children)
    sign = re.sub(r"[()\\]", " ", node.sign)
    return f"({sign}{inner})"


def read_shape(text: str) -> Node:
    root, stack = None, []
    for part in re.findall(r"\(|\)|[^()]+", text):
        if part == "(":
            stack.append(Node("", "", False, False, False))
            if len(stack) > 1:
                stack[-2].children.append(stack[-1])
            root = root or stack[0]
        elif part == ")":
            stack.pop()
        else:
            stack[-1].sign = part
    _number(root, 0)
    return root


def align(a: Node, b: Node) -> list[tuple[int, int]]:
    """Simple tree matching: the largest order-preserving match of equal signs below equal parents."""
    if a.sign != b.sign:
        return []
    wide = len(b.children) + 1
    best: list[list[list[tuple[int, int]]]] = [[[] for _ in range(wide)] for _ in range(len(a.children) + 1)]
    for i, left in enumerate(a.children, 1):
        for j, right in enumerate(b.children, 1):
            below = align(left, right)
            choices = [best[i - 1][j], best[i][j - 1]]
            if below:
                choices.append(best[i - 1][j - 1] + below)
            best[i][j] = max(choices, key=len)
    return [(a.number, b.number), *best[-1][-1]]


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("slot", pa.int32()), ("text", pa.string()), ("hash", pa.int64()),
                       ("link_chars", pa.int32()), ("inside", pa.bool_())])
    for batch in batches:
        shapes, digests, found = [], [], []
        for page in batch.column("html").to_pylist():
            root, blocks = parse(page or "")
            form = shape(root)
            shapes.append(form)
            digests.append(xxhash.xxh3_64_intdigest(form) - (1 << 63))
            found.append([
                {"slot": n.number, "text": t, "hash": xxhash.xxh3_64_intdigest(t) - (1 << 63), "link_chars": c,
                 "inside": m} for n, t, c, m in blocks])
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(shapes, pa.string()),
             pa.array(digests, pa.int64()), pa.array(found, pa.list_(block))],
            names=["page_id", "url", "host", "shape", "form", "blocks"])


def _align_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        slots = []
        for pair in zip(batch.column("shape").to_pylist(), batch.column("model").to_pylist(), strict=True):
            if pair not in known:
                own, model = map(read_shape, pair)
                places = dict(align(own, model))
                size = max([own.number, *[n.number for n in _all(own)]]) + 1
                known[pair] = [places.get(i, -1) for i in range(size)]
                if len(known) > 10_000:
                    known = {pair: known[pair]}
            slots.append(known[pair])
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("form"), pa.array(slots, pa.list_(pa.int32()))],
            names=["host", "form", "places"])


def _all(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children:
        yield from _all(child)


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case; null without one."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_blocks, n_template`` of each page.

    1. Each page is read once into its element tree, equal neighbours folded, and its text blocks; menus,
       footers, forms and the like, told by element or by the words of class, id and role, are left out.
    2. The commonest tree of a host is its model. The different trees of the host, far fewer than pages,
       are aligned with it by simple tree matching, which gives each block a slot of the model.
    3. A text that half of the pages of a host (three at least) show in the same slot is template, inside an
       article element one that nine in ten (five at least) show. What varies is content.
    4. Where a page marks an article or main element, its content is there; else it is all varying blocks of
       which links make up less than half. A page whose whole content would be template keeps it.

    Counts come from all pages of a host, combined before the shuffle, so a host may hold any share of them.
    A null page or one without text gives an empty text; pages without a host have no template; rows may
    repeat; other columns are ignored.
    """
    source = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    read = store_table(
        source.withColumn("host", host_of(F.col("url"))).mapInArrow(
            _read_pages, f"page_id {dict(source.dtypes)['page_id']}, url string, host string, shape string, "
                         f"form long, blocks array<{BLOCK}>"),
        "pages")
    known = read.filter("host is not null")
    forms = store_table(known.groupBy("host", "shape", "form").agg(F.count(F.lit(1)).alias("n")), "forms")
    models = forms.groupBy("host").agg(F.max_by("shape", F.struct("n", "form")).alias("model"), F.sum("n").alias("pages"))
    places = store_table(
        forms.join(models.select("host", "model"), "host").select("host", "form", "shape", "model").mapInArrow(
            _align_shapes, "host string, form long, places array<int>"), "places")
    placed = known.drop("shape").join(broadcast_if_small(places, places.count()), ["host", "form"])
    slot = F.get("places", F.col("b.slot"))
    seen = (
        placed.select("host", "places", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(
            b["slot"].alias("slot"), b["hash"].alias("hash"), b["inside"].alias("inside"))))).alias("b"))
        .select("host", slot.alias("slot"), "b.hash", "b.inside").filter("slot >= 0")
        .groupBy("host", "slot", "hash", "inside").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONSTANT_PAGES))
    share = F.when(F.col("inside"), F.lit(ARTICLE_SHARE)).otherwise(F.lit(CONSTANT_SHARE))
    least = F.when(F.col("inside"), F.lit(ARTICLE_PAGES)).otherwise(F.lit(CONSTANT_PAGES))
    constant = store_table(
        seen.join(models.select("host", "pages"), "host")
        .filter((F.col("n") >= least) & (F.col("n") >= share * F.col("pages")))
        .groupBy("host").agg(F.collect_set(F.struct("slot", "hash")).alias("template")), "templates")
    wrappers = places.join(constant, "host")
    joined = read.drop("shape").join(
        broadcast_if_small(wrappers, wrappers.count()), ["host", "form"], "left")
    has_main = F.exists("blocks", lambda b: b["inside"])
    candidates = F.filter("blocks", lambda b: F.when(has_main, b["inside"]).otherwise(
        2 * b["link_chars"] < F.length(b["text"])))
    is_template = lambda b: F.coalesce(F.array_contains(
        F.col("template"), F.struct(F.get("places", b["slot"]).alias("slot"), b["hash"].alias("hash"))), F.lit(False))
    varying = F.filter("candidates", lambda b: ~is_template(b))
    chosen = joined.withColumn("candidates", candidates).withColumn("varying", F.when(
        F.col("template").isNull(), F.col("candidates")).otherwise(varying))
    content = F.when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("candidates"))
    return chosen.select(
        F.col("page_id").alias(key), F.col("url").alias(url),
        F.array_join(F.transform(content, lambda b: b["text"]), "\n").alias("text"),
        F.size(content).alias("n_blocks"), (F.size("candidates") - F.size(content)).alias("n_template"))
