"""Main text of web pages by template deduction from equivalence classes of tokens."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import whole
from evidara.llm.url_filter import url_host
from evidara.session import durable

# fixed values: element names of the HTML standard by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SIDE = frozenset("nav header footer aside form menu dialog button select option label fieldset head script style textarea title noscript iframe template svg math object input".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that tell of something beside the article.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus discussion footer foot header masthead "
    "menu modal nav navbar navigation newsletter notice notices notification notifications overlay pagination pager popup popups promo promos promotion promoted related replies reply respond "
    "responses search share sharing sidebar side sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets login alert gdpr privacy recommended".split()
)
#: Elements that a start tag of the key closes where they are open, up to the nearest element of the second set.
_LIST, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
CLOSES = {"li": (frozenset(["li"]), _LIST), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
          "tr": (frozenset("tr td th".split()), _TABLE), "td": (frozenset("td th".split()), frozenset(["tr", "table"])), "th": (frozenset("td th".split()), frozenset(["tr", "table"])),
          "option": (frozenset(["option"]), frozenset(["select"]))}
#: Block elements that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("br html head body title td th tr tbody thead tfoot caption option optgroup li dd dt legend summary".split())
HEADINGS = frozenset("header masthead".split())
SECTIONS = frozenset("article main section div nav header footer aside body form ul ol table dialog menu fieldset".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    """An open element: its name, its token, and whether it is beside the article or in its main part by marks."""

    name: str
    label: str
    side: int  # 0: no, 1: by the words of its class or id, 2: by what it is
    main: bool
    token: int = 0  # names the place in the page: labels and numbers among like siblings, from the root down
    chosen: bool = False  # in the element that the template takes for the article
    chars: int = 0
    link_chars: int = 0
    children: dict[str, int] = field(default_factory=dict)


@dataclass
class Block:
    """A run of text of one block: the token of the element it stands in, how it is marked, and how much of it is link text."""

    token: int
    side: bool
    main: bool
    chosen: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _element(name: str, attributes: str, above: Element) -> Element:
    """The element that a start tag opens, without its token yet.

    What is beside the article stays so further down, but an article or main element within something that only its
    class called beside is the main part after all.
    """
    kept, role, hidden = [], "", False
    found = {}
    if attributes and attributes.strip():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(key.lower(), entities.unescape(a or b or c))
        role = found.get("role", "").lower()
        hidden = found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None or re.search(r"(?:^|\s)hidden(?=\s|$)", attributes.lower()) is not None
        kept = [found[k] for k in ("class", "id") if k in found]
    words = set(_WORDS.findall(_CAMEL.sub(" ", " ".join(kept)).lower()))
    main = name in ("article", "main") or role in ("main", "article")
    side = 2 if name in SIDE or role in SIDE_ROLES or hidden else 0
    worded = (words & SIDE_WORDS) - (HEADINGS if above.main else frozenset())
    if name == "header" and above.main and not hidden:
        side = 0  # an article's own heading
    if not side and worded and name not in ("body", "html", "main"):
        side = 1
    label = name + "".join("." + re.sub(r"[0-9]+", "0", w) for w in sorted(" ".join(kept).split()))
    inherited = 0 if main and not side and above.side == 1 else above.side
    return Element(name, label, max(side, inherited), (above.main or main) and not max(side, inherited))


ROOT = 0


def parse(page: str, article: int | None = None) -> tuple[list[tuple[int, int, int, int, bool]], list[Block]]:
    """The page's tag tokens and its blocks of text in page order.

    A tag token is (token, token of the element around, characters of text within, those in links, marked as main).
    Text beside the article by its marks is not counted. Blocks within the element with token ``article`` are chosen.
    """
    stack = [Element("", "", 0, False, ROOT)]
    tokens: list[tuple[int, int, int, int, bool]] = []
    blocks: list[Block] = []
    current: Block | None = None
    links = 0
    endless: set[str] = set()

    def text(raw: str) -> None:
        nonlocal current
        if raw:
            top = stack[-1]
            if current is None or current.side != bool(top.side):
                current = Block(top.token, bool(top.side), top.main, top.chosen)
                blocks.append(current)
            decoded = entities.unescape(raw)
            current.parts.append(decoded)
            if not top.side:
                chars = len("".join(decoded.split()))
                top.chars += chars
                if links:
                    top.link_chars += chars
                    current.link_chars += chars

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            element = stack.pop()
            links -= element.name == "a"
            stack[-1].chars += element.chars
            stack[-1].link_chars += element.link_chars
            if element.token != stack[-1].token:
                tokens.append((element.token, stack[-1].token, element.chars, element.link_chars, element.name in ("article", "main") and element.main))

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name in BLOCKS:
                current = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if stack[i].side:
                        current = None
                    close(i)
                    break
                if name not in SECTIONS and stack[i].name in SECTIONS:
                    break  # a stray end tag doesn't close what stands around
            continue
        if name in BLOCKS:
            current = None
        if name in CLOSES:
            closed, limit = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closed:
                    close(i)
                    break
                if stack[i].name in limit:
                    break
        elif name in ENDS_PARAGRAPH:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in SECTIONS:
                    break
        above = stack[-1]
        element = _element(name, tag[3], above)
        if (name in BLOCKS or element.side != above.side) and name != "br":
            number = above.children[element.label] = above.children.get(element.label, 0) + 1
            element.token = _mix(above.token, element.label, number)
        else:
            element.token, element.children = above.token, above.children  # inline: its text stands in the block around
        element.chosen = above.chosen or element.token == article
        if name in VOID:
            continue
        if bool(element.side) != bool(above.side):
            current = None
        if name in RAW:
            finish = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if finish:
                at = finish.end()
            elif name in ("script", "style"):
                break
            else:
                endless.add(name)  # nothing ends it: the tag alone is left out
            continue
        links += name == "a"
        stack.append(element)
    close(1)
    tokens.append((ROOT, ROOT, stack[0].chars, stack[0].link_chars, False))
    return tokens, blocks


def _mix(*parts: object) -> int:
    """A signed 64-bit hash; sums of them stand for whole occurrence vectors."""
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


TOKENS = "host string, kind string, token long, above long, vector long, chars long, link_chars long, main long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row for each different token of a page: tags by their place, and texts by their content and place.

    ``vector`` hashes the page and the token's count there; its sum over a host's pages is equal for tokens with equal
    occurrence vectors.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, host, page in zip(batch["row"], batch["host"], batch["html"], strict=True):
                tags, blocks = parse(page)
                one = _mix(row, 1)
                rows += [(host, "tag", token, above, one, chars, links, int(main)) for token, above, chars, links, main in tags]
                texts: dict[int, list[int]] = {}
                for block in blocks:
                    if not block.side and (text := block.text()):
                        found = texts.setdefault(text_token(block.token, text), [block.token, 0, len("".join(text.split())), block.link_chars])
                        found[1] += 1
                rows += [(host, "text", token, above, _mix(row, n), n * chars, links, 0) for token, (above, n, chars, links) in texts.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])

    return pages.select("row", "host", "html").mapInPandas(read, TOKENS)


def text_token(token: int, text: str) -> int:
    return _mix(token, "text", text)


def equivalence_classes(pages: DataFrame, min_pages: int = 4, share: float = 0.6) -> DataFrame:
    """The tokens of the valid equivalence classes of each host: (host, kind, token, above, class_id, chars, link_chars, main, pages).

    Tokens with equal occurrence vectors over all pages of a host form an equivalence class. Vectors are summed up as
    hashes, before and after the shuffle, so no host's pages ever meet in one task. A class is valid if it is large and
    frequent: of two tokens or more, on at least min_pages and on the given share of the host's pages. A passage that
    many pages share stands in paragraphs whose vectors differ from its own, so alone it makes no class.
    """
    vectors = page_tokens(pages).groupBy("host", "kind", "token").agg(
        F.first("above").alias("above"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("pages"),
        F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.sum("main").alias("main"),
    )
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages"))  # of the urls alone, so pages are parsed once
    frequent = vectors.join(hosts, "host").where((F.col("pages") >= min_pages) & (F.col("pages") >= share * F.col("host_pages")))
    classed = durable(frequent.withColumn("class_id", F.xxhash64("host", "vector")).drop("vector", "host_pages"))
    large = classed.groupBy("host", "class_id").agg(F.count("*").alias("size")).where("size > 1").select("host", "class_id")
    return classed.join(large, ["host", "class_id"])


@dataclass
class Template:
    """What a host's valid classes say: the texts that belong to the template, and the element whose slots hold the article."""

    texts: frozenset[int] = frozenset()
    article: int | None = None
    links: frozenset[int] = frozenset()  # elements whose slots hold mostly links
    nesting: dict[int, int] = field(default_factory=dict)  # each class and the one whose slot it stands in


def nest(rows: list[dict], share: float = 0.6) -> Template:
    """Nest a host's valid classes and find the slots that the article fills.

    A class stands in a slot of the class to which the element around its first token belongs. Classes that hang in no
    slot of another, up to the class of the root, are given up. Text tokens of the others belong to the template; what
    else the pages hold fills slots. The article is the innermost element of the template whose slots take at least the
    given share of all that fills slots; where a marked article or main element takes as much, that one.
    """
    tags = {r["token"]: r for r in rows if r["kind"] == "tag"}
    if ROOT not in tags:
        return Template()
    of_class = {r["token"]: r["class_id"] for r in tags.values()}
    nesting: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (-r["pages"], r["kind"], r["token"])):
        around = of_class.get(r["above"])
        if around is not None and around != r["class_id"]:
            nesting.setdefault(r["class_id"], around)

    def hangs(class_id: int) -> bool:
        seen: set[int] = set()
        while class_id != of_class[ROOT]:
            if class_id in seen or class_id not in nesting:
                return False
            seen.add(class_id)
            class_id = nesting[class_id]
        return True

    nested = {c for c in {r["class_id"] for r in rows} if hangs(c)}
    tags = {t: r for t, r in tags.items() if r["class_id"] in nested}
    texts = [r for r in rows if r["kind"] == "text" and r["class_id"] in nested]
    fill = {t: r["chars"] - r["link_chars"] for t, r in tags.items()}
    for r in texts:
        at = r["above"]
        while at in tags:
            fill[at] -= r["chars"] - r["link_chars"]
            if at == ROOT:
                break
            at = tags[at]["above"]

    def depth(token: int) -> int:
        steps = 0
        while token != ROOT and token in tags:
            token, steps = tags[token]["above"], steps + 1
        return steps

    holding = [t for t in tags if t != ROOT and fill[ROOT] > 0 and fill[t] >= share * fill[ROOT]]
    marked = [t for t in holding if 2 * tags[t]["main"] > tags[t]["pages"]]
    article = min(marked, key=lambda t: (depth(t), t)) if marked else max(holding, key=lambda t: (depth(t), fill[t], t), default=None)
    links = frozenset(t for t, r in tags.items() if 2 * r["link_chars"] > r["chars"])
    return Template(frozenset(r["token"] for r in texts), article, links, {c: nesting[c] for c in nested if c in nesting})


def main_text(page: str, template: Template) -> str:
    """The page's main text: what fills the slots of its host's template within the article.

    Template texts, and what its own marks call beside the article (menus, forms, comments), are left out. On a page
    without the template's article, or of a host without template, the page's own article or main element is taken, and
    where there is none either, all text that neither belongs to the template nor fills slots of links.
    """
    _, blocks = parse(page, template.article)
    found = [(b, t) for b in blocks if not b.side and (t := b.text()) and text_token(b.token, t) not in template.texts]
    for mark in ("chosen", "main"):
        own = [t for b, t in found if getattr(b, mark)]
        if own:
            return " ".join(own)
    return " ".join(t for b, t in found if b.token not in template.links and 2 * b.link_chars <= len(t))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars): every page's main text.

    Pages are read twice: once for the tokens from which the hosts' templates are deduced, once to take out the slots.
    The templates go to all tasks where they are small enough, which is measured; otherwise pages meet theirs in a join
    by host and a salt, so that a host with most pages is still spread.

    Character references are decoded, white space (as Unicode has it) inside a block becomes one space, blocks are
    joined by one space. Null html is empty and gives empty text; a null url belongs to the empty host; repeated rows
    give a row each; an empty table gives none; extra columns are left out.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).alias("html")).withColumn("host", url_host(F.col("url")))
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    found = durable(equivalence_classes(numbered))
    one = F.struct("kind", "token", "above", "class_id", "chars", "link_chars", "main", "pages")
    by_host = found.groupBy("host").agg(F.collect_list(one).alias("template"))  # no more than a few pages' tokens each
    size = 64 * found.count()
    if size <= broadcast_bytes:
        met = source.join(F.broadcast(by_host), "host", "left")
    else:
        salts = 64
        met = source.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).join(
            by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["host", "salt"], "left"
        )

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Template] = {}
        for batch in batches:
            texts = []
            for host, page, template in zip(batch["host"], batch["html"], batch["template"], strict=True):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = nest(list(template) if template is not None else [])
                texts.append(main_text(page, known[host]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    narrow = met.select(F.col("page_id").cast("long").alias("page_id"), "url", "host", "html", "template")
    return narrow.mapInPandas(lambda batches: take(b.astype({"page_id": "Int64"}) for b in batches), "page_id long, url string, text string, n_chars long")
