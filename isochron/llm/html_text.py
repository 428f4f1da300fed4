"""HTML extraction with site style trees.

The pages of a host are merged by the paths of their elements (tag, class, id; without positions). Of
each path two normalised entropies over the host's pages are taken: of its presentation (the sequence
of child elements) and of its content (the text). Boilerplate is alike on many pages and has little
of both. Both are blended with the importance that a path has before any page was seen (1, with the weight
of ``PRIOR`` pages), so that a few pages that are alike do not condemn a path. A path's importance weighs its
presentation and its children's importance; a branch that holds unimportant paths only is noise and is
cut from every page of the host.

Elements that HTML itself marks as navigation, forms and the like have no importance. Class names are
evidence: a class (id, role) that says nothing but "related posts" or "site footer" marks its element in
the same way; one that has such a word among others (``related-work``) only weighs the importance that the
tree gives it, by half. Neither condemns a main part (article, main) inside, but for readers' comments. Where a page marks its article or main part, text
outside it is left out. A page whose text all lies in forms is read as if it had none.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut, salt

PRIOR, LEAST_IMPORTANCE, GAMMA = 3.0, 0.5, 0.9
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
LEFT_OUT = frozenset("noscript template svg select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle semantics object canvas".split()
)
CLOSED_BY_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MARGINAL = frozenset("nav footer aside form button menu dialog head fieldset".split()) | LEFT_OUT
#: Words in a class, id or role that mark what is not the article.
MARGINAL_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs"
    " footer contentinfo sidebar aside complementary cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login signin"
    " social share sharing related recommended recommendations comment comments disqus reply replies widget pagination pager toolbar copyright search skip dialog alert".split()
)
#: Words that say where something is or of what kind, not what it holds.
NEUTRAL_WORDS = frozenset(
    "left right top bottom main site page area block box list item items section container wrapper wrap inner outer link links bar panel content contents unit slot row col column"
    " group post posts article articles story stories primary secondary global first last sticky fixed mobile desktop small large dark light form text title button buttons js is".split()
)
HEADS, MAIN, COMMENTS = frozenset({"header", "masthead"}), frozenset({"article", "main"}), frozenset({"comment", "comments", "reply", "replies", "disqus"})


@functools.lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[str, int, bool, bool, bool]:
    """Name of an element in paths, and what its tag and attributes say.

    0, 1 (some word speaks against it) or 2 (all do: it is marginal); whether its children are, even if they are main parts; a page header; a main part.
    """
    marks, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name in ("class", "id", "role") and value:
            marks.append((name, value))
    tokens = [{w.lower() for w in _PART.findall(v)} for _, value in marks for v in value.split()]
    words = set().union(*tokens)
    main = tag in MAIN or ("role", "main") in marks
    free = tag in ("html", "body")
    comments = bool(words & COMMENTS)
    plain = any(t & MARGINAL_WORDS and t <= MARGINAL_WORDS | NEUTRAL_WORDS for t in tokens)
    against = 2 if hidden or tag in MARGINAL or plain and not free and (not main or comments) else 1 if words & MARGINAL_WORDS and not free and not main else 0
    for_all = hidden or tag in LEFT_OUT or against == 2 and comments
    name = tag + "".join(("#" if k == "id" else ".") + re.sub(r"\d+", "0", " ".join(sorted(v.split()))) for k, v in sorted(marks) if k != "role")
    header = against < 2 and not main and (tag == "header" or any(t & HEADS and t <= HEADS | NEUTRAL_WORDS for t in tokens)) and not free
    return name, against, for_all, header, main and against < 2


def _path(parent: int, name: str) -> int:
    """A number for the path of an element of that name below ``parent``: no longer, however deep it is."""
    return xxhash.xxh64_intdigest(f"{parent}/{name}") >> 1


class Page:
    """Blocks of text of a page and the shape of its tree; the whole text is parsed once, broken markup included.

    ``blocks``: (path, text) in page order; ``children``: of each path, the names of child elements;
    ``paths``: of each path, its parent, its depth and whether a word speaks against it. Marginal elements and raw text (scripts, styles
    and so on) are left out, and so is what lies below a path in ``noise``. ``forms``: whether forms are marginal.
    """

    def __init__(self, source: str, noise: frozenset[int] = frozenset(), forms: bool = True):
        self.blocks: list[tuple[int, str]] = []
        self.children: dict[int, list[str]] = {}
        self.paths: dict[int, tuple[int, int, bool]] = {}
        self._main: list[int] = []
        # tag, path, left out (2: main parts in it as well), in a main part, depth
        stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
        count: dict[str, int] = {}  # of open elements by tag
        text: list[str] = []
        at, n, find = 0, len(source), _TOKEN.match

        def flush() -> None:
            if text:
                words = html.unescape("".join(text)).split()
                text.clear()
                if words and not stack[-1][2]:
                    if stack[-1][3]:
                        self._main.append(len(self.blocks))
                    self.blocks.append((stack[-1][1], " ".join(words)))

        def close(k: int) -> None:
            for t in stack[k:]:
                count[t[0]] -= 1
            del stack[k:]

        while at < n:
            m = find(source, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if source[m.start()] != "<" or at == m.start() + 1:
                    text.append(m[0])
                continue
            tag = tag.lower()
            if tag in INLINE:
                continue
            if tag in VOID:
                if tag in ("br", "hr", "img", "wbr"):
                    text.append("" if tag == "wbr" else " ")
                continue
            if m[1]:  # an end: closes down to its element, if that is open
                if tag == "p" or count.get(tag):
                    flush()
                    if count.get(tag):
                        k = len(stack) - 1
                        while stack[k][0] != tag:
                            k -= 1
                        close(k)
                continue
            if tag in RAW or tag in LEFT_OUT:
                if m[3].endswith("/"):
                    continue
                end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at)
                if end or tag in RAW:
                    if tag != "svg":  # a picture in a line does not end its block
                        flush()
                    at = end.end() if end else n
                    continue
            flush()
            if count.get("p"):  # a block ends a paragraph that is open near it
                k = next((k for k in range(len(stack) - 1, max(0, len(stack) - 5), -1) if stack[k][0] == "p"), 0)
                if k:
                    close(k)
            if tag in CLOSED_BY_OWN and any(count.get(t) for t in ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag})):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in CLOSED_BY_OWN[tag]:
                        break
                    if stack[k][0] == tag or {tag, stack[k][0]} <= {"dt", "dd"} or {tag, stack[k][0]} <= {"td", "th"}:
                        close(k)
                        break
            name, against, for_all, head, main = _element(tag, m[3])
            if tag == "form" and not forms:
                against = min(against, 1)
            _, parent, out, inside, depth = stack[-1]
            path = _path(parent, name)
            self.children.setdefault(parent, []).append(name)
            self.paths.setdefault(path, (parent, depth + 1, against == 1))
            if main and out == 1:
                out = 0
            if for_all or path in noise:
                out = 2
            elif against == 2 or head and not inside:
                out = max(out, 1)
            stack.append((tag, path, out, inside or main, depth + 1))
            count[tag] = count.get(tag, 0) + 1
        flush()

    def main_blocks(self) -> list[tuple[int, str]]:
        """The blocks of the page's main parts, or all where none is marked."""
        return [self.blocks[i] for i in self._main] or self.blocks


def read_page(source: str | None, noise: frozenset[int] = frozenset()) -> Page:
    """The page, null being empty; without regard to forms if all its text lies in some."""
    source = source or ""
    page = Page(source, noise)
    if not page.blocks and "form" in page_tags(page):
        page = Page(source, noise, forms=False)
    return page


def page_tags(page: Page) -> set[str]:
    return {re.split("[.#]", name, maxsplit=1)[0] for names in page.children.values() for name in names}


def host(url: Column) -> Column:
    """The host of a URL in lower case, without a port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    names = ["host", "path", "parent", "depth", "weak", "page", "style", "content"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            out: list[tuple] = []
            part = b.slice(at, 256)
            for name, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = read_page(source)
                texts: dict[int, list[str]] = {}
                for path, text in page.blocks:
                    texts.setdefault(path, []).append(text)
                whole = xxhash.xxh64_intdigest("\n".join(t for _, t in page.blocks)) >> 1
                for path, (parent, depth, weak) in page.paths.items():
                    style, content = " ".join(dict.fromkeys(page.children.get(path, []))), "\n".join(texts.get(path, []))
                    out.append((name, path, parent, depth, weak, whole, xxhash.xxh64_intdigest(style) >> 1, xxhash.xxh64_intdigest(content) >> 1 if content else -1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)


def style_trees(pages: DataFrame) -> DataFrame:
    """host, path, parent, depth, weak, pages, presentation, content: the merged tree of each host of ``pages`` (host, html).

    presentation and content are entropies over the host's different pages (equal ones count once) of
    the elements' child sequences and texts, divided by their maximum and blended with the prior; content is null where a path has no text. Paths on
    one page are left out: they have the prior importance.
    """
    kind = "host string, path bigint, parent bigint, depth int, weak boolean, page bigint, style bigint, content bigint"
    rows = pages.select("host", "html").mapInArrow(_style_rows, kind).distinct()
    key = ["host", "path"]

    def entropy(value: str, *more: Column) -> DataFrame:
        counts = rows.groupBy(*key, value).agg(F.count("*").alias("n"), *more)
        kept = [F.first(c).alias(c) for c in counts.columns if c not in (*key, value, "n")]  # the same for all rows of a path
        per = counts.groupBy(*key).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max(value).alias("some"), *kept)
        share = 1 - F.col("nlogn") / (F.col("pages") * F.log("pages"))
        return per.where("pages > 1").withColumn(value, (F.col("pages") * share + PRIOR) / (F.col("pages") + PRIOR))

    shape = entropy("style", *(F.max(c).alias(c) for c in ("parent", "depth", "weak")))
    words = entropy("content").select(*key, F.when(F.col("some") >= 0, F.col("content")).alias("content"))
    return shape.select(*key, "parent", "depth", "weak", "pages", F.col("style").alias("presentation")).join(words, key)


def noisy_paths(tree: list[tuple[int, int, int, bool, float, float | None]]) -> list[int]:
    """The paths of a host's tree (path, parent, depth, weak, presentation, content) whose branch holds unimportant paths only.

    Importance of a path: (1 - GAMMA) times its presentation plus GAMMA times the mean of its own
    content and its children's importance; without either, its presentation alone. Of a weak path it is halved.
    """
    importance: dict[int, float] = {}
    below: dict[int, list[int]] = {}
    noisy: dict[int, bool] = {}
    for path, parent, _, weak, presentation, content in sorted(tree, key=lambda r: (-r[2], r[0])):
        parts = [importance[c] for c in below.get(path, [])] + ([] if content is None else [content])
        own = (1 - GAMMA) * presentation + GAMMA * sum(parts) / len(parts) if parts else presentation
        importance[path] = own / 2 if weak else own
        # what a word speaks against is judged as a whole; else a branch stays if any part of it does
        noisy[path] = importance[path] < LEAST_IMPORTANCE and (weak or all(noisy[c] for c in below.get(path, [])))
        below.setdefault(parent, []).append(path)
    return sorted(p for p, x in noisy.items() if x)


def main_text(source: str | None, noise: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that are no noise, joined by two line feeds; an empty text if there are none.

    ``noise``: paths whose branches are cut. A null page is taken as empty.
    """
    return "\n\n".join(text for _, text in read_page(source, noise).main_blocks())


def _frozen(paths) -> frozenset[str]:
    return frozenset() if paths is None else frozenset(paths)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null html gives an empty text, a null or odd url the host "" with a tree of its own. Rows that repeat a page or its id
    give a row each. An empty table gives no rows. Other columns are ignored. Trees go to the pages by host; a host's row goes to each salt that has pages of it, so a
    host of any size is spread. Where all trees together are small they are broadcast instead.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    trees = style_trees(pages).groupBy("host").agg(F.collect_list(F.struct("path", "parent", "depth", "weak", "presentation", "content")).alias("tree"))  # no page's text, and only what pages share

    def noise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: noisy_paths([(r["path"], r["parent"], r["depth"], r["weak"], r["presentation"], None if pd.isna(r["content"]) else r["content"]) for r in t]))

    cuts = cut(trees.select("host", F.pandas_udf(noise, "array<bigint>")("tree").alias("noise")).where(F.size("noise") > 0))
    size = cuts.agg(F.coalesce(F.sum(8 * F.size("noise") + F.length("host")), F.lit(0))).first()[0]
    if size <= 8 << 20:
        joined = pages.join(F.broadcast(cuts), "host", "left")
    else:
        salted = pages.withColumn("__salt", salt("page_id", salts=64))
        present = salted.groupBy("host", "__salt").agg(F.count("*").alias("__n")).drop("__n").join(cuts, "host")
        joined = salted.join(present, ["host", "__salt"], "left")

    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, noises in batches:
            yield pd.Series([main_text(s, _frozen(x)) for s, x in zip(sources, noises, strict=True)], dtype=object)

    out = joined.select("page_id", "url", F.pandas_udf(each, "string")("html", "noise").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
