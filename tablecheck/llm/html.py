"""Main text of web pages, with boilerplate found by repeated runs per host.

Markup splits a page into blocks and says which of them belong to an article, which
to menus, adverts and the like, and which it leaves open. All blocks form the page's
token stream. The streams of a host are taken together as one suffix array of which
only the order by the first `run` tokens matters: suffixes that agree in them meet in
one group. Runs are long, or whole blocks where these are shorter, and where a group
has a certain share of the host's distinct page contents, the run is boilerplate and
its tokens are removed. What remains is kept unless markup calls it a menu or the
like, or leaves it open on a page that has an article.

Inside articles a run is a whole block, counted in articles of different text, and
most of them must have it: text may repeat for good reason. What runs take from an
article is checked against its length: an article that consists mostly of runs is a
copy of others rather than a frame around its own text, and stays whole.

Suffixes are grouped by (host, run, content) and counted before the shuffle by (host,
run), so a host may hold any share of the pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import cut, query, table

RUN = 20
SHARE, LEAST_CONTENTS = 0.1, 3  # of the host's distinct contents that a run needs
INSIDE_SHARE, LEAST_ARTICLES = 0.5, 10  # the same of its distinct articles, for blocks of them
SALTS = 64

# The parts of HTML that the parser tells apart.
RAW = "script style textarea title noscript template iframe svg math object select button".split()
SKIP = "nav header footer aside form menu dialog head figcaption".split()
MAIN = ("article", "main")
BOXES = "div section ul ol table".split()
TRACKED = {*SKIP, *MAIN, *BOXES}
BREAKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
HINTS = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer footer header menu nav navbar navigation newsletter notice popup promo related share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = set("navigation banner contentinfo complementary search menu dialog alert".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
MARKS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
PART = re.compile(r"[^a-z0-9]+")


def _hinted(rest: str) -> bool:
    for found in MARKS.findall(rest):
        if HINTS.intersection(PART.split("".join(found).lower())):
            return True
    role = ROLE.search(rest)
    return bool(role and role[1].lower() in ROLES)


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of every non-empty block; zone: main, skip or open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements: tag, zone ("" if it decides none)
    parts: list[str] = []
    zone, at = "open", 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((zone, text))
        parts.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in BREAKS:
            flush()
        if tag not in TRACKED:
            continue
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif not m["rest"].endswith("/"):
            kind = "skip" if tag in SKIP else "main" if tag in MAIN else ""
            stack.append((tag, "skip" if m["rest"] and _hinted(m["rest"]) else kind))
        zones = {z for _, z in stack}
        now = "skip" if "skip" in zones else "main" if "main" in zones else "open"
        if now != zone:
            flush()
            zone = now
    parts.append(page[at:])
    flush()
    return out


def host_of(url: str | None) -> str:
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return found[1].lower() if found else ""


def _key(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(tokens).encode(), digest_size=8).digest(), "little", signed=True)


PAGE = "uid long, page_id long, url string, host string, content long, article long, main array<string>, outside array<struct<open:boolean,text:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    outside_type = pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [blocks(h or "") for h in part.column(3).to_pylist()]
            main = [[t for z, t in b if z == "main"] for b in found]
            outside = [[{"open": z == "open", "text": t} for z, t in b if z != "main"] for b in found]
            hosts = [host_of(u) for u in part.column(2).to_pylist()]
            contents = [_key([f"{z}\n{t}\n" for z, t in b]) for b in found]
            articles = [_key([f"{t}\n" for t in m]) if m else None for m in main]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i) for i in range(3)],
                    pa.array(hosts),
                    pa.array(contents, pa.int64()),
                    pa.array(articles, pa.int64()),
                    pa.array(main, pa.list_(pa.string())),
                    pa.array(outside, outside_type),
                ],
                names=["uid", "page_id", "url", "host", "content", "article", "main", "outside"],
            )


SUFFIX = "host string, inside boolean, key long, uid long, content long, start int"


def _suffixes(run: int, deciding: bool = False):
    """(host, inside, key of the run, uid, content, start) of the suffixes of a page's
    stream. Outside articles every suffix counts, by its first `run` tokens; runs do
    not cross blocks, a shorter block is one run. Inside, the suffixes that begin a
    block count, by the whole block, and start is the block's number. `deciding`: only
    those that the page's text depends on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for uid, content, article, host, main, outside in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(host, True, _key([block]), uid, article, i) for i, block in enumerate(main or [])]
                at = 0
                for block in [] if deciding and main else outside or []:
                    tokens = block["text"].split()
                    for i in range(max(1, len(tokens) - run + 1)):
                        rows.append((host, False, _key(tokens[i : i + run]), uid, content, at + i))
                    at += len(tokens)
            names = ["host", "inside", "key", "uid", "content", "start"]
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return work


def _assemble(run: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, outside, starts = (c.to_pylist() for c in batch.columns[2:])
            texts = [
                _article(m, set(s or [])) if m else _text(o or [], set(s or []), run)
                for m, o, s in zip(main, outside, starts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return work


def _article(main: list[str], repeated: set[int]) -> str:
    """The blocks of an article without the repeated ones, if most of it remains."""
    kept = [b for i, b in enumerate(main) if i not in repeated]
    own, whole = (sum(len(b.split()) for b in blocks) for blocks in (kept, main))
    return "\n".join(kept if 2 * own > whole else main)


def _text(outside: list[dict], starts: set[int], run: int) -> str:
    """The open blocks without the runs that begin at `starts`."""
    kept, at = [], 0
    for block in outside:
        tokens = block["text"].split()
        covered = {i for s in starts if at <= s < at + len(tokens) for i in range(s, s + run)}
        unique = [t for i, t in enumerate(tokens, at) if i not in covered]
        at += len(tokens)
        if block["open"] and unique:
            kept.append(" ".join(unique))
    return "\n".join(kept)


def extract(pages: DataFrame, run: int = RUN, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A page with an article (or main) element gives the article's blocks, less those
    that INSIDE_SHARE of the distinct articles of its host have, LEAST_ARTICLES at
    least, unless that takes half of it; any other page gives the blocks that markup
    leaves open, less the runs of `run` tokens, and the whole shorter blocks, that
    `share` of the distinct page contents of its host have, LEAST_CONTENTS at least.
    Null html: empty text; a url without host: the host "". Pages of a host with the
    same blocks, under whatever page_id, are extracted each for itself and count as one
    content. An empty table gives no rows. Extra columns are ignored.
    """
    source = pages.select(
        F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long"), "url", "html"
    )
    parsed = cut(source.mapInArrow(_parse, PAGE))
    streams = parsed.select("uid", "content", "article", "host", "main", "outside")

    n = F.count_distinct("content")
    least = F.when(F.col("inside"), F.lit(LEAST_ARTICLES)).otherwise(F.lit(LEAST_CONTENTS))
    often = streams.mapInArrow(_suffixes(run), SUFFIX).groupBy("host", "inside", "key").agg(n.alias("n"))
    often = often.where(F.col("n") >= least)
    # Only for larger hosts the share decides; their runs meet it under several salts.
    needed = F.when(F.col("inside"), F.col("all") * INSIDE_SHARE).otherwise(F.col("all") * share)
    pages_of = parsed.select("host", F.lit(False).alias("inside"), "content")
    articles_of = parsed.where("article IS NOT NULL").select("host", F.lit(True).alias("inside"), F.col("article").alias("content"))
    hosts = pages_of.unionByName(articles_of).groupBy("host", "inside").agg(n.alias("all")).where(needed > least)
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = often.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(hosts, ["host", "inside", "salt"], "left")
    repeated = often.where(F.col("all").isNull() | (F.col("n") >= needed)).select("host", "inside", "key")
    # Written, so that its size is known: where few pages have such runs, no text is shuffled.
    deciding = streams.mapInArrow(_suffixes(run, True), SUFFIX).join(repeated, ["host", "inside", "key"])
    covered = cut(deciding.groupBy("uid").agg(F.collect_list("start").alias("starts")))
    joined = parsed.join(covered, "uid", "left").select("page_id", "url", "main", "outside", "starts")
    return joined.mapInArrow(_assemble(run), "page_id long, url string, text string, n_chars long")


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
