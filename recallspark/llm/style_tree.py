"""Main text of web pages by a site style tree: branches that a host repeats are noise."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from recallspark.llm.arrow import Scratch, map_batches

_SALTS = 32
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_CUE = re.compile(r"[a-z]+")
# has-sidebar and the like tell of a layout, not of the element's own role
_LAYOUT = re.compile(r"(?<![a-z])(?:has|have|with|without|no|not)[-_]+[a-z]+")

# Elements of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset(
    "head title script style noscript template textarea select button input form iframe object embed svg canvas "
    "audio video map datalist dialog nav aside footer menu".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
_CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot tr html body article section div".split())
# Words in a class, an id or a role that tell what an element is for.
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments reply replies disqus respond pagination pager widget toolbar search form complementary "
    "contentinfo dialog alert".split()
)
_HEADER_WORDS = frozenset(["header", "masthead"])
_MAIN = frozenset(["article", "main"])
# blocks that say something by themselves
_WHOLE = _BLOCK - frozenset("caption dd dt legend tbody td tfoot th thead tr".split())
#: An element that names itself noise stays with more than this share of the page's text: outside, and inside a marked part.
_MOST, _MOST_MARKED = 0.5, 0.75


class Node:
    """An element: its place in the style tree, its children and text pieces in order."""

    __slots__ = ("tag", "key", "look", "noise", "main", "children", "ordinals")

    def __init__(self, tag: str, key: int, look: str, noise: bool, main: bool) -> None:
        self.tag, self.key, self.look, self.noise, self.main = tag, key, look, noise, main
        self.children: list[Node | str] = []
        self.ordinals: dict[str, int] | None = None


def _key(parent: int, look: str, ordinal: int) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{look}/{ordinal}") - (1 << 63)


@lru_cache(maxsize=20_000)
def _look(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """How an element presents itself (tag, class, id, role), whether it is noise, names noise, or a header."""
    said, noise, cue, header = [tag], tag in _HIDDEN, False, tag == "header"
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            said.append(f"{name}={re.sub(r'[0-9]+', '0', value)}")
            words = set(_CUE.findall(_LAYOUT.sub(" ", value))) if tag not in ("html", "body") else set()
            cue |= not _NOISE_WORDS.isdisjoint(words)
            header |= not _HEADER_WORDS.isdisjoint(words)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            noise = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            noise = True
    return " ".join(said), noise, cue, header


def parse(page: str) -> Node:
    """The page as a tree, with missing end tags supplied; never fails."""
    root = Node("", 0, "", False, False)
    stack = [root]
    named: list[tuple[Node, bool, bool]] = []
    at = 0

    def text(piece: str) -> None:
        stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        close, tag, attributes, tag2, attributes2 = m.groups()
        if tag2:
            tag, attributes = tag2, attributes2
        if close:
            close = close.lower()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == close:
                    del stack[depth:]
                    break
                if stack[depth].tag in _MAIN and close not in ("html", "body") and close not in _BLOCK:
                    break
        elif tag:
            tag = tag.lower()
            if tag in _BLOCK:
                _close(stack, frozenset(["p"]), _SCOPES | {"td", "th", "li"})
            if tag in _CLOSED_BY:
                _close(stack, _CLOSED_BY[tag], _SCOPES - {"tr"} if tag == "tr" else _SCOPES)
            parent = stack[-1]
            look, noise, cue, header = _look(tag, attributes)
            # a header inside the article holds its headline
            cue |= header and not parent.main
            ordinals = parent.ordinals = parent.ordinals or {}
            ordinal = ordinals[look] = ordinals.get(look, -1) + 1
            node = Node(tag, _key(parent.key, look, ordinal), look, noise, parent.main or tag in _MAIN)
            parent.children.append(node)
            if cue and not noise:
                named.append((node, parent.main, any(n.tag == "article" for n in stack)))
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in _VOID and not attributes.rstrip().endswith("/"):
                stack.append(node)
    if at < len(page):
        text(page[at:])
    if named:
        _judge_named(root, named)
    return root


def _judge_named(root: Node, named: list[tuple[Node, bool, bool]]) -> None:
    """Mark elements that name themselves noise, but those that hold a marked part or most of the text.

    Articles that name themselves noise, and articles in articles, are comments or teasers and mark nothing.
    """
    doubtful = {id(node) for node, _, _ in named if node.tag == "article"}
    holds: dict[int, tuple[int, bool]] = {}
    sums: list[list] = [[0, False]]
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, up = stack.pop()
        if isinstance(item, str):
            sums[-1][0] += len("".join(item.split()))
        elif up:
            signs, marks = sums.pop()
            holds[id(item)] = signs, marks or (item.tag in _MAIN and id(item) not in doubtful)
            sums[-1][0] += signs
            sums[-1][1] |= holds[id(item)][1]
        elif not item.noise:
            sums.append([0, False])
            stack.append((item, True))
            stack.extend((child, False) for child in item.children)
    whole = sums[0][0]
    for node, inside, in_article in named:
        signs, marks = holds.get(id(node), (0, False))
        node.noise = (in_article or not marks) and signs <= whole * (_MOST_MARKED if inside else _MOST)


def _close(stack: list[Node], tags: frozenset, scopes: frozenset) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in scopes:
            return


def style_nodes(page: str) -> list[tuple[int, int, int]]:
    """Each element: its key, how its children look, and what its text says; words inside a marked part only by blocks."""
    return _style_nodes(parse(page))


def _style_nodes(root: Node) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    contents: list[list[str]] = []
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, up = stack.pop()
        if isinstance(item, str):
            contents[-1].append(item)
        elif up:
            content = contents.pop()
            if contents:
                contents[-1] += content
            if item.tag and item.tag not in ("html", "body") and _judged(item):
                looks = "|".join("#" if isinstance(c, str) else c.look for c in item.children)
                said = " ".join(" ".join(content).split())
                out.append((item.key, _digest(looks), _digest(said)))
        elif not item.noise:
            contents.append([])
            stack.append((item, True))
            stack.extend((child, False) for child in reversed(item.children))
    return out


def _judged(node: Node) -> bool:
    """Words and cells inside a marked part go with the block that holds them."""
    return not node.main or node.tag in _WHOLE


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def main_text(page: str, noise: frozenset[int] | set[int] = frozenset()) -> str:
    """The text blocks of a page without noise, joined by an empty line.

    Where the page marks an article or main part that says anything, only that part counts.
    """
    return "\n\n".join(_kept_blocks(parse(page), noise))


def _kept_blocks(root: Node, noise: frozenset[int] | set[int]) -> list[str]:
    if marked := _blocks(root, frozenset(), True):
        judged = _blocks(root, noise, True)
        # what a host repeats is a part of an article; where it is most of it, it is the article
        return judged if 2 * sum(map(len, judged)) >= sum(map(len, marked)) else marked
    return _blocks(root, noise, False)


def _blocks(root: Node, noise: frozenset[int] | set[int], only_main: bool) -> list[str]:
    blocks: list[str] = []
    held: list[str] = []
    main = 0

    def end() -> None:
        if held:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held.clear()

    stack: list[Node | str | None] = [root]
    path: list[Node] = []
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if main or not only_main:
                held.append(item)
        elif item is None:
            node = path.pop()
            main -= node.tag in _MAIN
            if node.tag in _BLOCK:
                end()
        else:
            if item.tag in _BLOCK:
                end()
            elif item.tag in ("br", "td", "th"):
                held.append(" ")
            if item.noise or (item.key in noise and _judged(item)):
                continue
            main += item.tag in _MAIN
            path.append(item)
            stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return blocks


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def noise_nodes(
    pages: DataFrame, url_column: str, html_column: str, least_pages: int, threshold: float
) -> DataFrame:
    """Keys of a host's unimportant style nodes: host, keys.

    A node met on m pages of its host whose children take looks, or whose text
    takes contents, with shares p_i has the importance -sum p_i log_m p_i: 1 if every page
    differs, 0 if all agree. A node is unimportant if both lie below the threshold.
    Pages of a host that say the same, in their marked part if they have one, count once.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out: dict = {"host": [], "page": [], "key": [], "look": [], "content": []}
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    root = parse(page or "")
                    said = _digest("\n\n".join(_kept_blocks(root, frozenset())))
                    for key, look, content in _style_nodes(root):
                        out["host"].append(host)
                        out["page"].append(said)
                        out["key"].append(key)
                        out["look"].append(look)
                        out["content"].append(content)
                yield out

    nodes = map_batches(
        pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).alias("html")), kernel, "host string, page bigint, key bigint, look bigint, content bigint"
    )
    once = nodes.groupBy("host", "key", "page").agg(F.min(F.struct("look", "content")).alias("node")).select("host", "key", "node.*")
    counts = once.groupBy("host", "key", "look", "content").agg(F.count("*").alias("n"))
    counts = Scratch(pages.sparkSession).write(counts)

    def importance(feature: str) -> DataFrame:
        of = counts.groupBy("host", "key", feature).agg(F.sum("n").alias("n")).groupBy("host", "key")
        found = of.agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"))
        value = 1 - F.col("s") / (F.col("m") * F.log(F.col("m").cast("double")))
        return found.select("host", "key", "m", F.when(F.col("m") > 1, value).otherwise(1.0).alias(f"of_{feature}"))

    both = importance("content").join(importance("look").drop("m"), ["host", "key"])
    low = (F.col("m") >= least_pages) & (F.col("of_content") < threshold) & (F.col("of_look") < threshold)
    return both.filter(low).groupBy("host").agg(F.collect_list("key").alias("keys"))


def extract_text(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least_pages: int = 4,
    threshold: float = 0.4,
) -> DataFrame:
    """The main text of every whole page: id, url, text, n_chars (code points).

    Pages of a host are merged into a style tree of (place, tag, class, id); its
    unimportant branches (see `noise_nodes`) go, as do elements that name themselves menus,
    headers, footers, sidebars, notices, adverts, forms or comments. Copies of a page
    count once, and a marked part that repetition would cut to less than half stays whole, so copies of an article keep their text. Null and empty pages give an empty text; a null or odd url
    counts as a host of its own; repeated rows are pages of their own; an empty
    table gives an empty result; other columns are not read.
    """
    noise = Scratch(pages.sparkSession).write(noise_nodes(pages, url_column, html_column, least_pages, threshold))
    # a host with a third of all pages is dealt over several tasks
    salt = F.pmod(F.xxhash64(id_column, html_column), F.lit(_SALTS))
    keyed = pages.select(
        F.col(id_column), F.col(url_column), F.col(html_column).alias("_html"), host_of(F.col(url_column)).alias("_host"), salt.alias("_salt")
    )
    salted = noise.select(F.col("host").alias("_host"), "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("_salt"))
    ready = keyed.join(salted, ["_host", "_salt"], "left").select(id_column, url_column, "_html", "_host", "keys")
    kinds = pages.schema
    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in (id_column, url_column)) + ", text string, n_chars bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset] = {}
        for batch in batches:
            texts = []
            for i in range(len(batch)):
                host = batch.column(3)[i].as_py()
                if host not in sets:
                    if len(sets) >= 1000:
                        sets.clear()
                    sets[host] = frozenset(batch.column(4)[i].as_py() or ())
                texts.append(main_text(batch.column(2)[i].as_py() or "", sets[host]))
            arrays = [batch.column(0), batch.column(1), pa.array(texts, schema.field(2).type), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return ready.mapInArrow(run, ddl)
