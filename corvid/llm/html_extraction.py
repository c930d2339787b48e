"""Main text of web pages by landmarks and a site style tree (operator 6).

The DOMs of a host's pages are merged into one tree: a node is the path of block elements (tag and
class or id words, without digits).  Grouped aggregation counts, per host and node, the presentations
(sequences of child elements) and the contents seen there; their entropies, each divided by its
largest possible value, give the node's importance.  A page loses its noise elements (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments) and the branches whose
importance is low.  What an ``article`` or ``main`` element holds is the author's own text and keeps
full importance, since copies of one article on a host would else count as a template; where a page
has such an element, only its text is the main text.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; truncated
pages keep what there is; repeated rows each keep their row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import cut, only, pieces, table

#: Branches below this importance go, where at least LEAST_PAGES pages of the host have them.
LOW, LEAST_PAGES = 0.2, 5
#: Low-importance branches of up to this many bytes are sent to every executor.
BROADCAST_BYTES = 8 << 20
# Elements and class or id words that never hold main text.
NOISE_TAGS = frozenset("nav header footer aside form head title script style noscript template iframe svg button select option menu dialog object canvas".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul button select option noscript template object canvas".split())
VOID = frozenset(["hr"])
#: Words that, before or after a noise word, make a name of something else (``no-sidebar``, ``comment-open``).
OTHER_WORDS = frozenset("no not without has have with open closed off hidden enabled disabled layout page wrapper".split())
#: Noise words that hold for an article element too: each reader comment may be one.
REPLY_WORDS = frozenset("comment comments reply replies respond disqus".split())
# Attributes: quoted values or anything else.  No part of a tag reaches over the next "<", so that a quote left open ends there.
_ATTRIBUTES = r"(?:(?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*+|[^<>]*+)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|svg|iframe|textarea)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)({_ATTRIBUTES})>|<[!?/][^<>]*+>|<[a-zA-Z!?/][^<>]*+\Z",
    re.S | re.I,
)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_HOST = re.compile(r"://([^/?#]*)")
DEPTH = 24


def host_of(url: str | None) -> str:
    m = _HOST.search(url or "")
    return m[1].lower() if m else ""


class Block:
    """A text block; whether it is noise, in a landmark, and in one under an element that only has a name like noise."""

    __slots__ = ("covered", "main", "noise", "path", "text")

    def __init__(self, path: str, text: str, noise: bool, main: bool, covered: bool) -> None:
        self.path, self.text, self.noise, self.main, self.covered = path, text, noise, main, covered


def named_noise(tag: str, marks: list[str]) -> int:
    """Whether an element is noise by a name in its class, id or role: 2 for reader comments, 1 for others, else 0.

    A name is one word of these attributes, taken whole: it is noise when its first or last part is a
    noise word and no other part takes that back.  The page's body is never noise by name, and an
    article only as a reader comment.
    """
    if tag in ("html", "body", "main"):
        return 0
    found = 0
    for name in marks:
        parts = _WORDS.findall(name)
        if tag == "article":
            found = max(found, 2 * (name in REPLY_WORDS))
        elif parts and not OTHER_WORDS.intersection(parts):
            ends = {parts[0], parts[-1]}
            found = max(found, 2 * bool(ends & REPLY_WORDS), len(ends & NOISE_WORDS) > 0)
    return found


def read_page(source: str) -> tuple[list[Block], dict[str, list[str]]]:
    """The text blocks of a page in order, and for each path its child elements in order."""
    blocks: list[Block] = []
    styles: dict[str, list[str]] = {}
    # Open elements: tag, path, noise (1 by name, 2 by tag or as a reader comment), whether in a landmark, and in a covered one.
    stack: list[tuple[str, str, int, bool, bool]] = [("", "", 0, False, False)]
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                _, path, noise, main, covered = stack[-1]
                blocks.append(Block(path, text, noise > 0, main, covered))

    def close(tag: str, stop: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                flush()
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            buffer.append(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
        if tag not in BLOCKS:
            continue
        if m[2]:
            close(tag)
            flush()
            continue
        flush()
        close("p")
        if tag == "li":
            close("li", frozenset(["ul", "ol", "menu"]))
        if tag in VOID:
            continue
        marks = [x for g in _MARK.findall(m[4]) for x in "".join(g).lower().split()]
        _, path, noise, main, covered = stack[-1]
        step = ".".join([tag, *sorted({w for x in marks for w in _WORDS.findall(x)})])
        styles.setdefault(path, []).append(step)
        if tag in ("article", "main") and noise < 2 and not main:
            main, covered, noise = True, noise == 1, 0
        noise = max(noise, 2 if tag in NOISE_TAGS else named_noise(tag, marks))
        if not m[4].rstrip().endswith("/"):
            stack.append((tag, f"{path}>{step}" if path.count(">") < DEPTH else path, noise, main, covered))
    if at < len(source):
        buffer.append(source[at:])
    flush()
    return blocks, styles


def main_text(source: str | None, low: set[str] | frozenset[str] = frozenset()) -> str:
    """The blocks that stay, joined by an empty line; ``low`` are the host's paths of low importance."""
    blocks, _ = read_page(source or "")
    good = [b for b in blocks if not b.noise]
    if any(b.main for b in good):  # landmarks under an element that only has a name like noise count where there are no others
        good = [b for b in good if b.main and not b.covered] or [b for b in good if b.main]
    elif low:
        good = [b for b in good if not any(b.path == p or b.path.startswith(p + ">") for p in low)]
    return "\n\n".join(b.text for b in good)


def _nodes(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value): what each page shows at each node; kind c content, s presentation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            hosts, paths, kinds, values = [], [], [], []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                blocks, styles = read_page(source or "")
                content: dict[str, int] = {}
                for b in blocks:
                    content[b.path] = zlib.crc32(b.text.encode(), content.get(b.path, 0))
                for kind, got in (("c", content), ("s", {p: zlib.crc32(" ".join(s).encode()) for p, s in styles.items()})):
                    hosts += [host] * len(got)
                    paths += got.keys()
                    kinds += [kind] * len(got)
                    values += got.values()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.int64())], names=["host", "path", "kind", "value"])

    return pages.mapInArrow(run, "host string, path string, kind string, value long")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every branch of every host's merged tree."""
    seen = _nodes(pages).groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    per = seen.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    own = per.withColumn("h", entropy).groupBy("host", "path").agg(F.max("m").alias("pages"), F.max("h").alias("h"))
    # A branch is as important as the most important node in it.
    steps = F.split("path", ">")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ">"))
    return own.select("host", F.explode(up).alias("path"), "pages", "h").groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max("h").alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    pages = only(pages, {"page_id": "long", "url": "string", "html": "string"})
    low = style_tree(pages).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW) & ~F.col("path").rlike("(^|>)(article|main)([.>]|$)") & (F.col("path") != ""))
    low = cut(low.groupBy("host").agg(F.collect_set("path").alias("low")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    size = low.agg(F.sum(F.length("host") + F.aggregate("low", F.lit(0), lambda n, p: n + F.length(p) + 16))).first()[0] or 0
    joined = pages.withColumn("host", host).join(F.broadcast(low) if size <= BROADCAST_BYTES // 4 else low, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            texts = [main_text(s, frozenset(p or ())) for s, p in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
