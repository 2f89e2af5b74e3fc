"""HTML extraction by equivalence classes of template tokens.

A page is cut into tokens: tags with the path of elements they stand in, and whole blocks of
text with their path. Over the pages of a host, each token's occurrence vector (how often it
stands in each page) is folded into one number, an exclusive or of hashes of (page, count),
which partial aggregates combine on the map side: no group of pages is ever gathered. Tokens
of a host with the same vector form an equivalence class. A class is valid if it has several
tokens and its pages are a given share of the host's, or SUPPORT at least, or if tags are among
its tokens (a layout of few pages of a large host).

In a page, valid classes nest into the template: a token of a class stands in a gap of the class
around it (the next template element above of another class, or none). Of a class, only what fills a
gap with several tokens or a tag is template there; a text that stands alone in its gap is not.
What stands between template tokens are slots. A slot is known by its element; its texts that
vary over the host (in under MIN_PAGES pages each) give it a weight, their length a page.

The main text is chosen among the slots: those below the article or main elements, if there are
any; else those below the element with the most text, here and over the host's pages. Slots in
menus, forms, notices, comments and the like go, by elements, roles and the names of containers.
Templates and weights of up to BROADCAST_TOKENS tokens are broadcast, others joined to the
tokens of each page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import column_of, mapped, pack, quoted, unpack, written
from siglake.llm.urls import url_host

#: Element names and words in class, id and role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "menu", "menubar", "alert", "alertdialog"}
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "related", "reply", "replies", "search", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
}
#: Words that tell inside an article too; the others must be a whole class or id there.
PLAIN_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "newsletter", "pagination", "promo", "sponsored"}
#: Elements whose class and id tell what they hold; those of headings, paragraphs and tables name their own text.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "header", "fieldset", "figure", "center", "details"}
SPACE = re.compile(r"\s+")
_ATTRIBUTE = r"""[^\s=>/][^\s=>/]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: A template token stands in this share of the host's pages, and in MIN_PAGES at least.
SHARE, MIN_PAGES, MIN_TOKENS = 0.3, 4, 2
#: Pages in which a token is template however large its host is.
SUPPORT = 20
#: Template tokens and slots up to this number in all are broadcast (some 100 bytes each on the driver).
BROADCAST_TOKENS = 500_000


class _Block:
    __slots__ = ("text", "path", "stack", "linked")

    def __init__(self, text, path, stack, linked):
        self.text, self.path, self.stack, self.linked = text, path, stack, linked


def _path(stack) -> str:
    return "/".join(x[0] + "".join("." + w for w in sorted(x[1])) for x in stack if x[0] not in INLINE)


def _words(attributes: dict) -> frozenset:
    return frozenset(re.split(r"[^a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) - {""}


def _names(attributes: dict) -> frozenset:
    return frozenset(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def parse(page: str) -> tuple[list[str], list[_Block]]:
    """Tag tokens and blocks of text, in page order. stack: (element, words, role, serial, path, names) from the root on."""
    tags: list[str] = []
    blocks: list[_Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked = 0
    serial = 0
    path = ""

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(x[0] == "a" for x in stack):
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                blocks.append(_Block(text, path, tuple(x for x in stack if x[0] not in INLINE), linked))
            parts.clear()
        linked = 0

    def repath() -> None:
        nonlocal path
        path = _path(stack)

    at, skip_to = 0, None
    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i]
                        break
                    if stack[i][0] not in INLINE:
                        break
                continue
            if name == "br":
                say(" ")
                continue
            if any(x[0] == name for x in stack):
                flush()
                while stack:
                    gone = stack.pop()
                    if gone[0] == name:
                        break
                tags.append(f"{path}>")
                repath()
            continue
        if name == "br":
            say(" ")
            continue
        if name in RAW:
            if name != "title" or not stack or stack[-1][0] == "head":
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                say(" ")
                continue
        if name in INLINE:
            stack.append((name, frozenset(), "", 0, "", frozenset()))
            continue
        flush()
        if name in VOID:
            continue
        if name in CLOSES_P:
            _close(stack, "p", {"div", "td", "th", "li", "body", "article", "section", "main", "blockquote"})
        if name == "li":
            _close(stack, "li", {"ul", "ol", "menu"})
        elif name in ("td", "th"):
            _close(stack, "td", {"table", "tr"})
            _close(stack, "th", {"table", "tr"})
        elif name == "tr":
            _close(stack, "tr", {"table"})
        elif name in ("dd", "dt"):
            _close(stack, "dd", {"dl"})
            _close(stack, "dt", {"dl"})
        elif name == "body":
            _close(stack, "head", {"html"})
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])} if "=" in m[3] else {}
        serial += 1
        if not m[3].endswith("/") or name not in VOID:
            words = _words(attributes)
            path = _path([*stack, (name, words)])
            stack.append((name, words, attributes.get("role", "").lower(), serial, path, _names(attributes)))
        else:
            repath()
        tags.append(f"{path}<")
    if at < len(page):
        say(page[at:])
    flush()
    return tags, blocks


def _close(stack: list, name: str, bounds: set) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if stack[i][0] in bounds:
            return


def token_hash(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


class _Hashes(dict):
    """Paths to the hashes of their opening tags, filled as they are asked for."""

    def __missing__(self, path: str) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[path] = token_hash(path + "<", "")
        return h


_OPENING = _Hashes()


def page_tokens(page: str) -> list[tuple[int, int, bool, int, int]]:
    """The distinct tokens of a page: hash, times, whether it is a tag, and for a text its slot and its letters outside links."""
    tags, blocks = parse(page)
    texts: dict = {}
    for b in blocks:
        mine = texts.setdefault(token_hash(b.path, b.text), [0, False, _OPENING[b.path], 0])
        mine[0] += 1
        mine[3] += max(len(b.text) - b.linked, 0)
    return [*((t, n, True, 0, 0) for t, n in Counter(token_hash(t, "") for t in tags).items()), *((t, *x) for t, x in texts.items())]


def _is_outside(stack: tuple, inner: bool) -> bool:
    """Whether a block stands in a menu, footer and the like; inner: below the article, whose own header counts as its part."""
    for name, words, role, _, _, names in stack:
        if name in ("html", "body", "article", "main") or role == "main":
            continue
        if name in OUTSIDE or role in OUTSIDE_ROLES or (name == "header" and not inner):
            return True
        if name in CONTAINERS and (found := words & OUTSIDE_WORDS):
            if not inner or found & PLAIN_WORDS or (names & OUTSIDE_WORDS) - {"header"}:
                return True
    return False


def template_texts(blocks: list[_Block], template: dict, min_tokens: int = MIN_TOKENS) -> set[int]:
    """Hashes of the texts of a page that are template, by nesting its classes. template: token to class."""
    filled: dict = defaultdict(set)  # (class, gap): tokens
    tagged, texts, seen = set(), [], set()

    def gap(of: int, above: list[int]) -> int:
        return next((t for t in reversed(above) if template.get(t) not in (None, of)), 0)

    for b in blocks:
        chain = [_OPENING[x[4]] for x in b.stack]
        for i, t in enumerate(chain):
            if t not in seen and t in template:
                seen.add(t)
                place = template[t], gap(template[t], chain[:i])
                filled[place].add(t)
                tagged.add(place)
        t = token_hash(b.path, b.text)
        if t in template:
            place = template[t], gap(template[t], chain)
            filled[place].add(t)
            texts.append((t, place))
    return {t for t, place in texts if place in tagged or len(filled[place]) >= min_tokens}


def main_text(page: str, template: dict, weights: dict, min_tokens: int = MIN_TOKENS) -> list[str]:
    """The blocks of the article, in page order. template: classes of the host's template tokens; weights: of its slots."""
    _, blocks = parse(page)
    fixed = template_texts(blocks, template, min_tokens)
    slots = [b for b in blocks if token_hash(b.path, b.text) not in fixed]
    free = {id(b) for b in slots}

    def below(pick) -> list[_Block]:
        """Slots under the elements that pick names: those at the place of the one with the most text. All blocks, if all are template (pages that are copies of each other)."""
        size: Counter = Counter()
        roots = defaultdict(list)
        for b in blocks:
            i = next((i for i, x in enumerate(b.stack) if pick(x)), None)
            if i is not None and not _is_outside(b.stack[:i], False) and not _is_outside(b.stack[i + 1 :], True):
                place = b.stack[i][4], b.stack[i - 1][3] if i else 0  # siblings of one kind
                size[place] += max(len(b.text) - b.linked, 0)
                roots[place].append(b)
        if not size:
            return []
        found = roots[size.most_common(1)[0][0]]
        return [b for b in found if id(b) in free] or found

    for pick in (lambda x: x[0] == "article", lambda x: x[0] == "main" or x[2] == "main"):
        if found := below(pick):
            return [b.text for b in found]
    inside = [b for b in slots if not _is_outside(b.stack, False) and b.linked * 2 <= max(len(b.text), 1)]
    if not inside:
        return []
    weight: Counter = Counter()
    for b in inside:
        size = len(b.text) + weights.get(_OPENING[b.path], 0.0)
        for depth, x in enumerate(b.stack[-3:]):
            weight[x[3]] += size * (depth + 3)
    best = weight.most_common(1)[0][0]
    return [b.text for b in inside if any(x[3] == best for x in b.stack)]


def host_tokens(pages: DataFrame) -> DataFrame:
    """pages(host, html, pid) to (host, token, pages, vector, tag, slot, chars): the tokens of each host."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict = {}
            for host, body, pid in zip(batch["host"], batch["html"], batch["pid"], strict=True):
                for token, n, tag, slot, chars in page_tokens(body or ""):
                    mine = held.setdefault((host, token), [0, 0, tag, slot, 0])
                    mine[0] += 1
                    mine[1] ^= xxhash.xxh64_intdigest(f"{pid}|{n}") >> 1
                    mine[4] += chars
            yield pd.DataFrame([(h, t, *x) for (h, t), x in held.items()], columns=["host", "token", "pages", "vector", "tag", "slot", "chars"])

    seen = mapped(pages, tokens, "host string, token long, pages long, vector long, tag boolean, slot long, chars long")
    sums = F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.max("tag").alias("tag"), F.max("slot").alias("slot"), F.sum("chars").alias("chars")
    return seen.groupBy("host", "token").agg(*sums)


def host_templates(seen: DataFrame, sizes: DataFrame, share: float, min_pages: int, min_tokens: int) -> DataFrame:
    """The tokens of hosts and sizes(host, of) to (host, token, cls): the tokens of valid classes, each class known by its vector.

    Tokens of equal vectors are one class, whatever their order; hosts without a valid class, and
    empty tables, have no rows.
    """
    common = seen.where(F.col("pages") >= min_pages).join(sizes, "host")
    classes = common.groupBy("host", "vector").agg(F.collect_list("token").alias("tokens"), F.max("pages").alias("pages"), F.max("of").alias("of"), F.max("tag").alias("tag"))
    valid = (F.size("tokens") >= min_tokens) & ((F.col("pages") >= F.col("of") * share) | (F.col("pages") >= SUPPORT) | F.col("tag"))
    return classes.where(valid).select("host", F.explode("tokens").alias("token"), F.col("vector").alias("cls"))


def slot_weights(seen: DataFrame, sizes: DataFrame, min_pages: int) -> DataFrame:
    """(host, token, weight): letters a page of the texts that vary over a host, by the element they stand in."""
    varying = seen.where(~F.col("tag") & (F.col("pages") < min_pages)).groupBy("host", F.col("slot").alias("token")).agg(F.sum("chars").alias("chars"))
    return varying.join(sizes, "host").select("host", "token", (F.col("chars") / F.col("of")).alias("weight"))


def _page_marks(hosted: DataFrame, marks: DataFrame) -> DataFrame:
    """(page, marks): the marks of the tokens of each distinct page of hosted(host, html, page), by a join on tokens."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, p, t) for h, body, p in zip(batch["host"], batch["html"], batch["page"], strict=True) for t, *_ in page_tokens(body or "")]
            yield pd.DataFrame(rows, columns=["host", "page", "token"])

    own = mapped(hosted, tokens, "host string, page binary, token long").distinct().join(marks, ["host", "token"])
    return own.groupBy("page").agg(F.collect_list(F.struct("token", "cls", "weight")).alias("marks"))


def _known(rows) -> tuple[dict, dict]:
    """(template, weights) of rows of token, class and weight, either of which may be null."""
    template, weights = {}, {}
    for token, cls, weight in rows:
        if cls is not None and cls == cls:
            template[token] = cls
        if weight is not None and weight == weight:
            weights[token] = weight
    return template, weights


def extract_text(pages: DataFrame, *, url: str = "url", html: str = "html", share: float = SHARE, min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """pages with text (main text, blocks parted by line feeds) and n_chars (its code points).

    Nulls: a null html is an empty page with empty text; pages without a host form one host.
    Repeated pages count each by itself; a host with few pages has no template, and its pages
    are read by elements alone. Very long pages are read whole. Of equally large places the first
    in the page is taken. An empty table gives an empty result. Input columns named like an
    output column give way to it.
    """
    spark = pages.sparkSession
    hosted = pack(pages, url_host(F.col(quoted(url))).alias("host"), F.col(quoted(html)).alias("html"))
    seen = written(host_tokens(hosted.select("host", "html", F.monotonically_increasing_id().alias("pid"))), "tokens")
    sizes = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    none = F.lit(None)
    template = host_templates(seen, sizes, share, min_pages, min_tokens).withColumn("weight", none.cast("double"))
    weights = slot_weights(seen, sizes, min_pages).select("host", "token", none.cast("long").alias("cls"), "weight")
    marks = template.unionByName(weights).groupBy("host", "token").agg(F.max("cls").alias("cls"), F.max("weight").alias("weight"))
    marks = written(marks, "marks")

    if marks.count() <= BROADCAST_TOKENS:
        rows = defaultdict(list)
        for r in marks.collect():  # BROADCAST_TOKENS at most
            rows[r["host"]].append((r["token"], r["cls"], r["weight"]))
        held = spark.sparkContext.broadcast(dict(rows))
        sets: dict = {}

        def text_of(bodies: pd.Series, hosts: pd.Series) -> pd.Series:
            for h in set(hosts) - set(sets):
                sets[h] = _known(held.value.get(h, ()))
            return pd.Series(["\n".join(main_text(b or "", *sets[h], min_tokens)) for b, h in zip(bodies, hosts, strict=True)], dtype=object)

        joined, of = hosted, "host"
    else:

        def text_of(bodies: pd.Series, known: pd.Series) -> pd.Series:
            rows = [[(x["token"], x["cls"], x["weight"]) for x in m] if m is not None else [] for m in known]
            return pd.Series(["\n".join(main_text(b or "", *_known(m), min_tokens)) for b, m in zip(bodies, rows, strict=True)], dtype=object)

        hosted = hosted.withColumn("page", F.unhex(F.sha2(F.concat_ws("\n", "host", "html"), 256)))
        joined, of = hosted.join(_page_marks(hosted.select("host", "html", "page"), marks), "page", "left"), "marks"
    out = joined.withColumn("text", column_of(spark, text_of, "string")("html", of)).withColumn("n_chars", F.char_length("text").cast("long"))
    return unpack(out, ["text", "n_chars"])
