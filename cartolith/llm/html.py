"""Main-text extraction by consensus paths per host.

Pass one parses every page, scores its containers (text in blocks, less link
text) and emits the best generalised tag-class paths. Spark counts the votes
per host and path; a path wins when it leads on enough of the host's pages.
Pass two parses every page again and takes the blocks of its host's leading
winning path that the page has; a page without one keeps its own best container.

Left out: head, scripts, styles, navigation, page headers and footers, asides,
forms, hidden elements and elements whose class, id or role names a menu,
notice, advert, sidebar or comment section. A header inside an article keeps
its headings. Line breaks (<br>) are white space inside a block.

Defined results: null or empty html gives an empty text; a null url has the
empty host; repeated rows are extracted each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import ascii_lower, join_checked, staged

#: A path wins on a host when it leads on at least this share of the host's pages.
VOTE_SHARE = 0.2
CANDIDATES = 3

#: Comments, declarations and tags. A tag whose quotes do not close before white space, a slash or the tag's end is cut at its first >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^<>\"']++)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {"script": re.compile(r"</script\b[^>]*>", re.I), "style": re.compile(r"</style\b[^>]*>", re.I), "textarea": re.compile(r"</textarea\b[^>]*>", re.I), "title": re.compile(r"</title\b[^>]*>", re.I), "xmp": re.compile(r"</xmp\b[^>]*>", re.I)}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr header footer nav aside form fieldset details summary center".split())
CONTAINERS = frozenset("html body article main section div td".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas audio video map menu dialog title".split())
UNWANTED = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|notice|notices|notification|alert|gdpr|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side|rail|widgets?|footer|header|masthead|topbar|comments?|disqus|respond|repl(?:y|ies)|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|signup|login|popup|overlay|modal|search|pagination|pager|toolbar|skip|legal|copyright|contentinfo|complementary|toc)(?:$|[-_\s])",
    re.I,
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "path", "dropped", "article", "heading_only", "score", "parent", "block")

    def __init__(self, tag: str, path: str, dropped: bool, article: bool, heading_only: bool, parent: Element | None):
        self.tag, self.path, self.dropped, self.article, self.heading_only, self.parent = tag, path, dropped, article, heading_only, parent
        self.score = 0.0
        #: The innermost block that the element is or lies in.
        self.block: Element = self if parent is None or tag in BLOCK else parent.block


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def _open(tag: str, rest: str, parent: Element) -> Element:
    attributes = _attributes(rest) if rest.strip(" /\t\r\n") else {}
    names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}"
    article = parent.article or tag in ("article", "main")
    dropped, heading_only = parent.dropped or tag in DROPPED, parent.heading_only
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        dropped = True
    page_header = tag == "header"
    if not dropped and tag not in ("html", "body", "article", "main") and names.strip() and UNWANTED.search(names):
        if parent.article and re.search(r"(?:^|[-_\s])header(?:$|[-_\s])", names, re.I):
            page_header = True
        else:
            dropped = True
    if page_header and not parent.article:
        dropped = True
    elif page_header:
        heading_only = True
    path = parent.path
    if tag in CONTAINERS:
        first = attributes.get("class", "").split()
        label = tag + ("." + DIGITS.sub("#", first[0]) if first else "")
        path = f"{parent.path}>{label}" if parent.path else label
    return Element(tag, path, dropped, article, heading_only, parent)


def blocks(page: str) -> list[tuple[Element, str, int]]:
    """(element, text, link characters) of every kept block, in page order."""
    root = Element("#", "", False, False, False, None)
    stack, found, text, links, in_link = [root], [], [], 0, 0
    owner: Element | None = None

    def flush() -> None:
        nonlocal text, links, owner
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined and owner is not None:
                found.append((owner, joined, links))
        text, links, owner = [], 0, None

    def add(piece: str) -> None:
        nonlocal links, owner
        if not piece:
            return
        top = stack[-1]
        if top.dropped:
            return
        block = top.block
        if block.heading_only and block.tag not in HEADINGS:
            return
        if owner is None:
            owner = block
        text.append(piece)
        if in_link:
            links += len(piece)

    def close(k: int) -> None:
        nonlocal in_link
        if any(e.tag in BLOCK or e.dropped for e in stack[k:]):
            flush()
        in_link -= sum(e.tag == "a" for e in stack[k:])
        del stack[k:]

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            comment = page.find("<!--", at)
            add(page[at : comment if comment >= 0 else end])
            break
        add(page[at : m.start()])
        at = m.end()
        slash, tag, rest = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k and not (tag not in BLOCK and any(e.tag in CONTAINERS for e in stack[k + 1 :])):
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in CONTAINERS or stack[i].tag in ("li", "blockquote", "td", "th"):
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
                if stack[i].tag in LIMITS[tag] or stack[i].tag in CONTAINERS - {"td"}:
                    break
        if tag in BLOCK or tag in DROPPED:
            flush()
        if rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            over = RAW[tag].search(page, at)
            at = over.end() if over else end
            continue
        stack.append(_open(tag, rest, stack[-1]))
        in_link += tag == "a"
    flush()
    return found


def container(element: Element | None) -> Element | None:
    while element is not None and element.tag not in CONTAINERS:
        element = element.parent
    return element


def candidates(found: list[tuple[Element, str, int]]) -> list[tuple[str, float]]:
    """Paths of the best containers with their share of the best score; text counts fully for the nearest container, half for the next."""
    scores: dict[int, tuple[Element, float]] = {}
    for element, text, links in found:
        weight = max(0.0, len(text) - 2.0 * links)
        holder, share = container(element), 1.0
        while holder is not None and share > 0.1:
            bonus = 2.0 if holder.tag in ("article", "main") else 1.0
            scores[id(holder)] = (holder, scores.get(id(holder), (holder, 0.0))[1] + weight * share * bonus)
            holder, share = container(holder.parent), share / 2
    paths: dict[str, float] = {}
    for holder, score in scores.values():
        paths[holder.path] = max(paths.get(holder.path, 0.0), score)
    best = sorted(paths.items(), key=lambda x: (-x[1], x[0]))[:CANDIDATES]
    top = best[0][1] if best else 0.0
    return [(path, score / top) for path, score in best] if top > 0 else []


def text_at(found: list[tuple[Element, str, int]], paths: list[str]) -> str:
    """The blocks inside elements of the first path that the page has."""
    for path in paths:
        inside = f"{path}>"
        kept = [text for element, text, _ in found if element.path == path or element.path.startswith(inside)]
        if kept:
            return "\n".join(kept)
    return "\n".join(text for _, text, _ in found)


def host_of(url):
    return ascii_lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, share) of the best containers of every page; a page's first row has lead = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, (path, share) in enumerate(candidates(blocks(page.as_py() or ""))):
                    rows.append((host, path, share, int(k == 0)))
            if rows:
                host, path, share, lead = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(share, pa.float64()), pa.array(lead, pa.int64())], ["host", "path", "share", "lead"])

    return pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path string, share double, lead long")


def winners(ballots: DataFrame) -> DataFrame:
    """(host, paths): winning paths, best first; at most CANDIDATES / VOTE_SHARE of them hold per host."""
    counted = staged(ballots.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("lead").alias("leads"), F.round(F.sum("share"), 6).alias("score")), "html-votes")
    hosts = counted.groupBy("host").agg(F.sum("leads").alias("pages"))
    won = counted.join(hosts, "host").where(F.col("n") >= VOTE_SHARE * F.col("pages"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "path")))
    return won.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    paths = staged(winners(votes(pages)), "html-paths")
    source = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    joined = join_checked(source, paths, ["host"], "left", 512).select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column(2), batch.column(3), strict=True):
                found = blocks(page.as_py() or "")
                own = [path for path, _ in candidates(found)[:1]]
                texts.append(text_at(found, (paths.as_py() or []) + own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    fields = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html": op1_html}
SQL: dict[str, str] = {}
