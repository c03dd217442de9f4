"""Main text of web pages by wrappers: constants and slots of the paths of a host, counted over all of its pages."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Collection

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column_udf, hinted, saved, table

#: A text is a constant of its host if at least so many different pages have it, ...
LEAST = 2
#: ... inside the article so many, as two pages with equal text there may be copies, ...
LEAST_INSIDE = 3
#: ... and at least this share of the pages that have text at its path.
SHARE = 0.5

# Elements of HTML, by what they mean for the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
SKIPPED = frozenset(
    "head nav header footer aside form script style noscript template button select option textarea input iframe svg canvas "
    "object audio video dialog menu label fieldset".split()
)
MAIN = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu nav navbar navigation newsletter notice notices popup promo related reply replies share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Beside a noise word, these make a name of several words one of a part of the page (`comment-list`, `site-footer`); others don't (`share-price`, `no-sidebar`).
PART_WORDS = frozenset(
    "area banner bar block bottom box button buttons container form global group icons inner item items left links list main outer "
    "panel post posts primary right secondary section signup site slot top unit wrap wrapper zone".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert form menu dialog".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b([^>]*)>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    # no backtracking, and at most 1,024 pieces in a tag, so that a tag that never ends costs the same anywhere
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|<|\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,65536}+\"|'[^']{0,65536}+'){0,1024}+)>|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")
#: Elements that are no noise by name if they hold the article: some sites put the whole page in a form.
HOLDERS = frozenset("form fieldset".split())


def _noise_name(name: str) -> bool:
    if name in NOISE_WORDS:
        return True
    words = re.split("[-_]+", name)
    return len(words) > 1 and not NOISE_WORDS.isdisjoint(words) and all(w in NOISE_WORDS or w in PART_WORDS for w in words)


def _noisy(attrs: str) -> bool:
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and any(map(_noise_name, value.split())):
            return True
        if name == "role" and value in NOISE_ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(attrs) and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I) is not None


class _Element:
    """An open element: what it stands in, its name, and whether its contents are no main text by name or by an attribute."""

    __slots__ = ("parent", "name", "by_name", "by_class", "_seen")

    def __init__(self, parent: _Element | None, name: str, by_name: bool, by_class: bool):
        self.parent, self.name, self.by_name, self.by_class = parent, name, by_name, by_class
        self._seen: tuple[int, bool, bool] | None = None

    def place(self) -> tuple[int, bool, bool]:
        """(key of the path, whether it is never main text, whether it is in an article), once marks are settled."""
        todo, at = [], self
        while at is not None and at._seen is None:
            todo.append(at)
            at = at.parent
        key, noise, inside = at._seen if at is not None else (0, False, False)
        for e in reversed(todo):
            marked = e.by_name or e.by_class
            key, noise, inside = _key(str(key), e.name + "!" * marked), noise or marked, inside or e.name in MAIN
            e._seen = key, noise, inside
        return key, noise, inside


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def blocks(page: str) -> list[tuple[int, bool, bool, str]]:
    """(key of the path, whether it is never main text, whether it is in an article, text) of every block in page order.

    The path are the names of the open elements, with marks on those whose
    contents are never main text. Classes and ids count as whole names, or by their words if all of these name parts of a page; they mark neither html and
    body nor an outermost article or main and what it stands in; an article that
    is itself of a marked class counts as such only if the page has no other.
    Inline elements, unclosed paragraphs and stray end tags are taken as browsers
    do; character references are decoded. Time is linear in the page, whatever it holds.
    """
    open_: list[_Element] = []
    names: Counter = Counter()
    out: list[tuple[_Element | None, str]] = []
    text: list[str] = []
    articles: list[_Element] = []  # each outermost article or main

    def flush():
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append((open_[-1] if open_ else None, joined))
            text.clear()

    def close(i: int):
        for e in open_[i:]:
            names[e.name] -= 1
        del open_[i:]

    for m in _TOKEN.finditer(page):
        raw, name = m[0], (m[4] or "").lower()
        if m[1]:
            continue  # script, style, textarea, title: whole
        if not name:
            if raw[0] != "<" or raw == "<":
                text.append(raw)
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if m[3]:
            if not names[name]:
                continue
            for i in range(len(open_) - 1, -1, -1):
                if open_[i].name == name:
                    close(i)
                    break
                if open_[i].name in ("article", "body", "table") and name not in ("body", "html", *MAIN, "div", "section"):
                    break
            continue
        if name in CLOSES_P and open_ and open_[-1].name == "p":
            close(len(open_) - 1)
        if name in ("li", "dt", "dd", "tr", "td", "th") and open_ and open_[-1].name == name:
            close(len(open_) - 1)
        if name in ("body", *MAIN) and open_ and open_[-1].name == "head":
            close(len(open_) - 1)
        if name not in VOID and not m[5].endswith("/"):
            inside = any(names[x] for x in MAIN)
            element = _Element(open_[-1] if open_ else None, name, name in SKIPPED, name not in ("html", "body") and _noisy(m[5]))
            if name in MAIN and not inside and not any(names[x] for x in SKIPPED - HOLDERS):
                articles.append(element)
            open_.append(element)
            names[name] += 1
    flush()
    for held in [a for a in articles if not a.by_class] or articles:
        while held is not None:
            held.by_name = held.by_class = False
            held = held.parent
    found = []
    for element, t in out:
        found.append((*(element.place() if element else (0, False, False)), t))
    return found


# ---- wrappers ------------------------------------------------------------------------------------
# The wrapper of a host says of each path which texts are constants; all others are slots. It is a
# set of keys of (path, text), counted over all pages of the host, so that partial counts add up.


def keys(page: str) -> list[tuple[int, int, bool]]:
    """The different (path, text) of a page as (key of the path, key of both, whether in the article)."""
    return sorted({(path, _key(str(path), text), inside) for path, noise, inside, text in blocks(page) if not noise})


def extract(page: str, constants: Collection[int]) -> str:
    """Main text of a page: the slots of its article, or of the page where it has none.

    Slots are blocks that are no constants of the host. A page without slots
    keeps its blocks, and so does an article that constants are most of: it is
    a copy of others, not their template.
    """
    found = [(path, inside, text) for path, noise, inside, text in blocks(page) if not noise]
    own = [(path, text) for path, inside, text in found if inside]
    slots = [t for p, t in own or [(p, t) for p, _, t in found] if _key(str(p), t) not in constants]
    if own and 2 * sum(map(len, slots)) < sum(len(t) for _, t in own):
        slots = []
    return "\n".join(slots or [t for _, t in own] or [t for _, _, t in found])


def _keys(pages: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "key": k, "inside": i} for p, k, i in keys(page)] for page in pages], dtype=object)


def _texts(pages: pd.Series, hosts: pd.Series, constants: pd.Series) -> pd.Series:
    of: dict[str, frozenset[int]] = {}
    for host, own in zip(hosts, constants, strict=True):
        if host not in of:
            of[host] = frozenset(() if own is None else own)
    return pd.Series([extract(page, of[host]) for page, host in zip(pages, hosts, strict=True)], dtype=object)


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, constants) of rows (host, html): texts that most of a host's pages with that path have.

    Every page of every host is counted; pages of equal html count once. Counts
    are summed before each shuffle, so a host of any size costs no task more
    than others.
    """
    found = column_udf(rows.sparkSession, _keys, "array<struct<path: long, key: long, inside: boolean>>", "html")
    pages = rows.select("host", F.xxhash64("html").alias("h"), found.alias("found"))
    pages = pages.groupBy("host", "h").agg(F.first("found").alias("found"))
    pages = saved(pages.select("host", "found"), "blocks")
    each = pages.select("host", F.explode("found").alias("_f")).select("host", "_f.*")
    least = F.when(F.col("inside"), LEAST_INSIDE).otherwise(LEAST)
    texts = each.groupBy("host", "path", "key", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    paths = pages.select("host", F.explode(F.array_distinct(F.col("found.path"))).alias("path"))
    paths = paths.groupBy("host", "path").agg(F.count("*").alias("all"))
    constants = texts.join(paths, ["host", "path"]).where(F.col("n") >= F.col("all") * SHARE)
    return constants.groupBy("host").agg(F.collect_list("key").alias("constants"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Wrappers are counted per host over all of its pages. Null or empty html has
    the text ''. Null urls share a host. Repeated rows each give a row; other
    columns are ignored. A text on exactly SHARE of its path's pages is a
    constant. Very long pages take linear time; an empty table gives no rows.
    """
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    known = saved(wrappers(rows.select("host", "html")), "wrappers")
    joined = rows.join(hinted(known, BROADCAST_ROWS // 100), "host", "left")  # a wrapper is a few kB
    text = column_udf(pages.sparkSession, _texts, "string", "html", "host", "constants")
    out = joined.select("page_id", "url", text.alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
