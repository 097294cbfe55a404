"""Main text of web pages: subtrees that recur across a host's pages are deleted; markup decides on what doesn't recur.

A page's elements form a tree; each subtree's tag, names and text have a 64-bit hash. Spark counts on how many different
pages of its host a subtree occurs (copies of a page are one page); one that occurs on at least ``LEAST_PAGES`` of them, and
on as many as the root of their number, is template and goes first, whatever it is called. Text blocks of the article itself
(paragraphs, headings, list items and the like within ``article`` or ``main``) are never template, nor is what holds an
article. Other subtrees within one count for the article, not for the page: pages that share an article (its longest block,
and the next one if that is at least half as long) are one there, so no number of copies makes an article's body template.
Of what is left, text goes that is no article by its tag, role, class or id, and, if the page has an ``article`` or
``main``, text outside: adverts that each page has for itself, hosts of few pages. Each page says how many blocks either took.

Blocks are what stands between block-level tags; in a block, character references are decoded (as browsers do) and each
run of white space is one space; blocks without text vanish; the others are joined by one space.

Defined results: null html gives empty text; tags that never close end with their parent; a null url is a host of its
own; repeated rows and ids get a row each; a very long page is read as a whole, in time in proportion to its length; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import defaultdict
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import load, small_batches, tidied, written

#: Different pages of a host from which a subtree is template, beside the square root of the host's number of them.
LEAST_PAGES = 5
#: Most template hashes that are broadcast (8 bytes each); more are joined to the pages that have them.
MOST_BROADCAST = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: A tag that the page's end cuts off.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag closes an open element of these.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
}
#: Open elements that such a tag doesn't reach beyond.
SCOPE = frozenset("article aside body div footer header html main nav ol section table td th ul".split())
NOT_ARTICLE = frozenset("nav footer aside form script style noscript template iframe svg math button select textarea title head dialog menu object canvas audio video".split())
NOT_ARTICLE_NAMES = frozenset(
    """ad ads adbox advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo
    cookie cookies dialog disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion
    recommended related respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split()
)
#: Names that begin like this are no article either: commentlist, advertbox, ...
NOT_ARTICLE_BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
#: Within an article, these are its text and never template.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption table ul ol dl tr tbody thead body html article main".split())


class Page(NamedTuple):
    digest: int  # of the page's whole content, for one host
    subtrees: dict[int, int]  # hashes of subtrees that may be template, each with what it counts for: the page, or the article that holds it
    blocks: list[tuple[str, bool]]  # text, and whether markup takes it for the article's
    spans: list[tuple[int, int, int]]  # the first block of a subtree that may be template, the one after its last, its hash


class _Element:
    __slots__ = ("tag", "names", "out", "article", "digest", "from_block", "candidate", "mute", "own", "holds", "inner")

    def __init__(self, tag, names, out, article, from_block, candidate, mute=False, own=False):
        self.tag, self.names, self.out, self.article, self.from_block, self.candidate, self.mute = tag, names, out, article, from_block, candidate, mute
        self.own, self.holds, self.inner = own, own, []  # is an article, is or holds one, hashes of candidates in it
        self.digest = hashlib.blake2b(f"{tag}|{names}|".encode(), digest_size=8)


def _no_article(words: list[str]) -> bool:
    return not NOT_ARTICLE_NAMES.isdisjoint(words) or any(w.startswith(NOT_ARTICLE_BEGINNINGS) for w in words)


def parse(text: str, salt: bytes = b"") -> Page:
    """A page's template candidates and remaining text blocks; hashes hold for one ``salt`` (the host)."""
    root = _Element("", "", False, 0, 0, False)
    stack, blocks, marks, subtrees, spans, pending = [root], [], [], {}, [], []
    seen_article, places, scopes, articles = False, defaultdict(list), [0], []  # where in the stack elements of a tag, of a scope, and articles are
    at, size = 0, len(text)

    def flush() -> None:
        if pending:
            got = " ".join("".join(pending).split())
            pending.clear()
            if got:
                top = stack[-1]
                blocks.append(got)
                marks.append((top.article > 0, top.out))

    def say(s: str) -> None:
        """Text within the open elements."""
        if not s:
            return
        s = html_lib.unescape(s) if "&" in s else s
        top = stack[-1]
        if top.candidate or top.tag:
            top.digest.update(s.strip().encode("utf-8", "surrogatepass"))
        if not top.mute:
            pending.append(s)

    def close() -> None:
        if stack[-1].tag not in INLINE:
            flush()
        e = stack.pop()
        places[e.tag].pop()
        if scopes[-1] == len(stack):
            scopes.pop()
        mine = e.digest.digest()
        stack[-1].digest.update(mine)
        stack[-1].holds = stack[-1].holds or e.holds
        if e.own:
            articles.pop()
            key = _article_key([b for b, (_, out) in zip(blocks[e.from_block :], marks[e.from_block :]) if not out], salt) if e.inner else 0
            for h in e.inner:
                subtrees.setdefault(h, key)
        elif e.candidate and not e.holds:
            h = int.from_bytes(hashlib.blake2b(mine, digest_size=8, salt=salt[:16]).digest(), "little", signed=True)
            if articles:
                articles[-1].inner.append(h)
            else:
                subtrees.setdefault(h, None)
            if e.tag not in INLINE and e.from_block < len(blocks):
                spans.append((e.from_block, len(blocks), h))

    for m in _TOKEN.finditer(text, 0, text.rfind(">") + 1):  # beyond, no tag ends
        if m.start() < at:
            continue  # within raw text
        say(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = size  # a comment without an end
            continue
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if end:
            if tag in VOID:
                continue
            if places[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in CLOSES:
            k = max((places[t][-1] for t in CLOSES[tag] if places[t]), default=0)
            if k > 0 and k >= scopes[-1]:
                while len(stack) > k:
                    close()
        if tag == "br":
            if not stack[-1].mute:
                pending.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in RAW and not rest.endswith("/"):
            close_at = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            if tag in ("noscript", "template", "svg", "math", "iframe", "script", "style", "textarea", "title"):
                at = close_at.end() if close_at else size
            continue
        names, hidden, body = "", False, False
        if rest and not rest.isspace():
            found = []
            for k, a, b, c in _ATTR.findall(rest):
                k, v = k.lower(), (a or b or c).lower()
                if k == "hidden":
                    hidden = True
                elif k == "itemprop":
                    body = body or v == "articlebody"
                elif k in ("class", "id", "role"):
                    found.append(v)
            names = " ".join(found)
        top = stack[-1]
        words = _NAME.findall(names) if names else ()
        is_article = tag in ("article", "main") or body or names == "main"
        out = top.out or hidden or tag in NOT_ARTICLE or (tag == "header" and not top.article) or (bool(words) and tag not in ("html", "body", "article", "main") and _no_article(words))
        depth = top.article + (1 if is_article and not out else 0)
        seen_article = seen_article or (is_article and not out)
        candidate = tag not in ("html", "body", "article", "main") and not (top.article and tag in TEXT_BLOCKS) and not (tag in INLINE and top.article)
        # Within a line, what is no article leaves no trace; a block of it is a block, and may be template.
        mute = top.mute or (out and not top.out and tag in INLINE)
        own = is_article and not out
        stack.append(_Element(tag, names, out, depth, len(blocks), candidate, mute, own))
        places[tag].append(len(stack) - 1)
        if tag in SCOPE:
            scopes.append(len(stack) - 1)
        if own:
            articles.append(stack[-1])
        if rest.endswith("/") and tag not in TEXT_BLOCKS:
            close()
    rest = text[at:]
    say(_CUT_OFF.sub("", rest) if "<" in rest else rest)
    while len(stack) > 1:
        close()
    flush()
    digest = int.from_bytes(hashlib.blake2b(root.digest.digest(), digest_size=8, salt=salt[:16]).digest(), "little", signed=True)
    whole = {h: digest if key is None else key for h, key in subtrees.items()}
    return Page(digest, whole, [(b, not out and (inside or not seen_article)) for b, (inside, out) in zip(blocks, marks)], spans)


def _article_key(blocks: list[str], salt: bytes) -> int:
    """What pages with one article share: its longest block, and the next one if that is at least half as long."""
    longest = sorted(blocks, key=lambda b: (-len(b), b))[:2]
    kept = [b for b in longest if 2 * len(b) >= len(longest[0])]
    return int.from_bytes(hashlib.blake2b("\0".join(kept).encode("utf-8", "surrogatepass"), digest_size=8, salt=salt[:16]).digest(), "little", signed=True)


def host_salt(url: str | None) -> bytes:
    host = "" if url is None else re.sub(r"^[a-zA-Z][\w+.-]*://", "", url).split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].rpartition("@")[2].lower()
    return hashlib.blake2b((host if url is not None else "\0").encode("utf-8", "surrogatepass"), digest_size=8).digest()


def main_text(page: Page, is_template: Callable[[int], bool]) -> tuple[str, int, int]:
    """The text, and how many blocks went as template and by markup."""
    gone = [0] * (len(page.blocks) + 1)
    for a, b, h in page.spans:
        if is_template(h):
            gone[a] += 1
            gone[b] -= 1
    left = [block for block, n in zip(page.blocks, accumulate(gone)) if not n]
    kept = [b for b, ours in left if ours]
    return " ".join(kept), len(page.blocks) - len(left), len(left) - len(kept)


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Hashes (which differ by host) of the subtrees that recur on a host's pages; ``pages`` has url and html."""

    @tidied
    def run(batches):
        for batch in batches:
            salts = [host_salt(u) for u in batch.column(0).to_pylist()]
            found = [parse(t or "", s) for t, s in zip(batch.column(1).to_pylist(), salts)]
            hosts = [int.from_bytes(s, "little", signed=True) for s in salts]
            lists = [pa.array([list(part) for part in parts], pa.list_(pa.int64())) for parts in ([p.subtrees for p in found], [p.subtrees.values() for p in found])]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array([p.digest for p in found], pa.int64()), *lists], ["host", "page", "subtrees", "keys"])

    seen = pages.select("url", "html").mapInArrow(run, "host long, page long, subtrees array<long>, keys array<long>").dropDuplicates(["host", "page"])
    # Of each page, a row for itself (null) and one for each distinct subtree; those of one article count once. Both steps combine within tasks first.
    own = F.struct(F.lit(None).cast("long").alias("h"), F.col("page").alias("key"))
    each = F.explode(F.concat(F.array(own), F.arrays_zip(F.col("subtrees").alias("h"), F.col("keys").alias("key")))).alias("x")
    counts = seen.select("host", each).select("host", "x.h", "x.key").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    often = written(counts.filter((F.col("n") >= least_pages) | F.col("h").isNull()), "subtrees")
    hosts = often.filter("h IS NULL").select("host", F.col("n").alias("pages"))
    return often.filter("h IS NOT NULL").join(hosts, "host").filter(F.col("n") * F.col("n") >= F.col("pages")).select("h")


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_template, n_markup (blocks that went) of each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select("page_id", "url", "html")
    found = written(templates(pages), "templates")
    schema = "page_id long, url string, text string, n_template int, n_markup int"
    names, types = ["page_id", "url", "text", "n_template", "n_markup"], [pa.string(), pa.int32(), pa.int32()]

    def told(batch: pa.RecordBatch, got: list[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([g[k] for g in got], t) for k, t in enumerate(types)]], names)

    if found.count() <= most_broadcast:
        sent = spark.sparkContext.broadcast(frozenset(found.toPandas()["h"].tolist()))

        @tidied
        def run(batches):
            for batch in batches:
                pages = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                yield told(batch, [main_text(parse(t or "", host_salt(u)), sent.value.__contains__) for u, t in pages])

        return pages.mapInArrow(run, schema)

    @tidied
    def subtrees(batches):
        for batch in batches:
            found = [list(parse(t or "", host_salt(u)).subtrees) for u, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["key", "subtrees"])

    keyed = pages.withColumn("_key", F.xxhash64("url", "html"))
    once = keyed.dropDuplicates(["_key"]).select("_key", "url", "html").mapInArrow(subtrees, "key long, subtrees array<long>")
    own = once.select("key", F.explode("subtrees").alias("h")).join(found, "h").groupBy("key").agg(F.collect_list("h").alias("gone"))
    joined = keyed.join(own, keyed["_key"] == own["key"], "left").select("page_id", "url", "html", "gone")

    @tidied
    def with_own(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            yield told(batch, [main_text(parse(t or "", host_salt(u)), frozenset(g or ()).__contains__) for u, t, g in rows])

    return joined.mapInArrow(with_own, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(load(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_markup")
