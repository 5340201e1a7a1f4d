"""Main text of web pages by a suffix array per host, with structure for what its markup names.

A page splits into blocks. Structure decides what markup names as something else than the article: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by element, role, or a class token or id
that is wholly the name of such a container; and where a page has article or main elements, what lies outside them.
Everything else is up to the host: the token streams of a host's distinct pages go through the suffix array of suffix.py,
which finds the long strings that stand on several of them. A string is boilerplate

* in text outside an article, where it stands on two distinct pages and on SHARE of those of the host, and
* in a whole block of an article, where MANY distinct articles of the host and NEARLY ALL of them hold that block: a
  notice or advert of the site's template without a telling name. Articles that consist mostly of such blocks are copies
  of each other, not templates, and lose nothing; a quotation or a passage that many articles share stays.

Words that boilerplate covers go, unique runs stay. Pages of a host without an article that have the same open text are
one page, and all get its text; equal articles of a host are one article. Of article text only blocks that a
second distinct article of the host has enter the suffix array: no other block can be in nearly all.

Defined results: null or tagless html gives its plain text, empty html an empty text; unclosed elements end with
their parent, unfinished tags and comments at the end of a page are dropped; null page_id or url pass through; repeated
rows get equal results; no rows give no rows; further columns are ignored. A page takes time in proportion to its length,
whatever its markup.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, scratch, stash, sweep, table
from .suffix import repeated

WINDOW = 32
SHARE = 0.5
#: Articles that must hold a block, at least, and their share of the host's distinct articles.
MANY = 8
NEARLY_ALL = 0.8
#: Template blocks of all hosts are broadcast up to so many characters in all.
BROADCAST_LETTERS = 1 << 24
#: Attributes as the HTML standard reads them; possessive, so that no character is read twice however quotes stand.
_ATTRS = r"(?>[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?>\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+))?+|=)*+"
TOKEN = re.compile(
    r"<!--(?:-?>|(?P<comment>))|<!\[CDATA\[(?P<cdata>)|<[!?][^>]*+>?+|</(?![a-zA-Z])[^>]*+>?+"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?P<end>>?+)"
)
_ATTR = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?>\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>]*+)))?+")
_COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is text up to their own end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?+", re.I) for t in "script style iframe textarea title xmp noembed noframes".split()}
NOISE_TAGS = frozenset("nav footer aside form button select menu dialog head noscript template object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FOREIGN = frozenset(("svg", "math"))
#: Tags that end drawings and formulas which someone has left open.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Names of containers, one or two to each thing that an article goes without.
NAMES = frozenset(
    "menu navbar navigation breadcrumb breadcrumbs sidebar footer site-header page-header masthead ad ads advert advertisement sponsored cookie-banner cookie-notice cookie-consent newsletter-signup"
    " share-buttons social-share related-posts related-articles pagination comments comment-list comments-area disqus_thread".split()
)
_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


def _noise(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not in_main:
        return True
    if tag in HEADINGS or tag in MAIN_TAGS or tag in ("body", "html") or not attrs:
        return False
    seen = set()
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        if name in seen or name not in ("class", "id", "role"):
            continue
        seen.add(name)
        tokens = html_.unescape("".join(values)).lower().split()
        # ids of sections are names of their subject
        if not (ROLES if name == "role" else NAMES).isdisjoint(tokens) and not (name == "id" and tag == "section"):
            return True
    return False


def _self_closing(attrs: str) -> bool:
    """Does the tag end in a slash that is no part of an unquoted value?"""
    if not attrs.endswith("/"):
        return False
    last = attrs.rsplit(None, 1)[-1]
    _, equals, value = last.partition("=")
    return not equals or value[:1] in ("'", '"') or last[-2:-1] in ("'", '"')


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) in page order; role 0 noise, 1 outside an article, 2 inside one."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int]] = []  # tag, role, index of the nearest element that isn't inline (itself included), or -1
    open_: Counter[str] = Counter()
    foreign, outermost = 0, 0  # open drawings and formulas, whose text is none, and where the first of them stands
    text: list[str] = []
    state = 1

    def end_block() -> None:
        if text:
            joined = " ".join(html_.unescape("".join(text)).split())
            if joined:
                out.append((state, joined))
            text.clear()

    def close(depth: int) -> None:
        nonlocal foreign
        for tag, *_ in stack[depth:]:
            open_[tag] -= 1
            foreign -= tag in FOREIGN
        del stack[depth:]

    def turn(role: int) -> None:
        nonlocal state
        if role != state:
            end_block()
            state = role

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if not foreign:
                text.append(page[at:])
            break
        if m.start() > at and not foreign:
            text.append(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            done = _COMMENT_END.search(page, at)
            at = done.end() if done else n
            continue
        if m["cdata"] is not None:
            done = page.find("]]>", at)
            if not foreign:
                text.append(html_.escape(page[at : done if done >= 0 else n], quote=False))
            at = done + 3 if done >= 0 else n
            continue
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if not m["end"]:
            break  # an unfinished tag
        if foreign and tag in BREAKOUT and not m["close"] and not open_["foreignobject"]:
            close(outermost)
        if tag in ("br", "hr"):
            text.append(" ")
            continue
        if tag in VOID:
            continue
        inline = tag in INLINE or foreign or tag in FOREIGN
        if m["close"]:
            if not inline:
                end_block()
            if open_[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                turn(stack[depth - 1][1] if depth else 1)
                close(depth)
            continue
        if tag in RAW and not foreign:
            done = RAW[tag].search(page, at)
            at = done.end() if done else n
            continue
        if inline and _self_closing(attrs):
            continue
        if tag in FOREIGN and not foreign:
            outermost = len(stack)
        if not inline:
            end_block()
            # a block start ends an open paragraph; list items and cells end their like
            near = stack[-1][2] if stack else -1
            if near >= 0 and (stack[near][0] == "p" or stack[near][0] in _LIKE.get(tag, ())):
                close(near)
                if tag == "tr" and stack and stack[-1][0] == "tr":
                    close(len(stack) - 1)
            turn(stack[-1][1] if stack else 1)
        role = state if state == 0 or foreign else 0 if _noise(tag, attrs, state == 2) else 2 if tag in MAIN_TAGS else state
        turn(role)
        open_[tag] += 1
        foreign += tag in FOREIGN
        stack.append((tag, role, (stack[-1][2] if stack else -1) if inline else len(stack)))
    end_block()
    return out


_PARSED = "page_id long, uid long, url string, salt long, main boolean, texts array<string>, outside binary"


def _parse(batches):
    for batch in batches:
        out = {k: [] for k in ("page_id", "uid", "url", "salt", "main", "texts", "outside")}
        for page_id, uid, url, salt, page in zip(*(batch.column(i).to_pylist() for i in range(5))):
            found = blocks(page)
            main = any(role == 2 for role, _ in found)
            kept = [t for r, t in found if r == (2 if main else 1)]
            outside = "\n".join(t for r, t in found if r < 2).encode("utf-8", "replace")
            for k, v in zip(out, (page_id, uid, url, salt, main, kept, outside)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(
            out,
            schema=pa.schema([("page_id", pa.int64()), ("uid", pa.int64()), ("url", pa.string()), ("salt", pa.int64()), ("main", pa.bool_()), ("texts", pa.list_(pa.string())), ("outside", pa.binary())]),
        )


def _windows(text: bytes, ranges: list[dict], salt: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows within the ranges, and their hashes under the host."""
    n = len(text) - window + 1
    on = np.zeros(max(0, n), bool)
    for r in ranges:
        on[r["lo"] : max(r["lo"], r["hi"] - window + 1)] = True
    at = np.flatnonzero(on)
    data, h = np.frombuffer(text, np.uint8).astype(np.uint64), np.full(len(at), salt, np.int64).view(np.uint64)
    for k in range(window):
        h = mix64(h + data[at + k] + np.uint64(1)) if k % 4 == 3 else h * np.uint64(0x9E3779B97F4A7C15) + data[at + k]
    return at, h.view(np.int64)


def _count_windows(window: int):
    """Distinct streams of each window, summed over the batch, with the number that makes it boilerplate."""

    def run(batches):
        for batch in batches:
            seen = [(np.unique(_windows(text, ranges, salt, window)[1]), least) for salt, text, least, ranges in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            if seen:
                h, at, n = np.unique(np.concatenate([x for x, _ in seen]), return_index=True, return_counts=True)
                least = np.repeat([v for _, v in seen], [len(x) for x, _ in seen])[at]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64)), pa.array(least.astype(np.int64))], names=["h", "n", "least"])

    return run


def _place_windows(window: int):
    def run(batches):
        for batch in batches:
            for oid, salt, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at, h = _windows(text, ranges, salt, window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), oid, np.int64)), pa.array(h), pa.array(at.astype(np.int32))], names=["oid", "h", "at"])

    return run


def _unique_runs(batches):
    """Open blocks without the bytes of the host's boilerplate, cut at word edges."""
    for batch in batches:
        out = {k: [] for k in ("oid", "text")}
        for oid, texts, outside, window, starts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            gone = bytearray(len(outside))
            for at in starts or ():
                gone[at : at + window] = b"\1" * window
            wanted, kept, at = list(texts), [], 0
            for block in outside.split(b"\n"):
                if wanted and block.decode() == wanted[0]:
                    wanted.pop(0)
                    words = []
                    for m in re.finditer(rb"[^ ]+", block):
                        if not all(gone[at + m.start() : at + m.end()]):
                            words.append(m.group().decode())
                    if words:
                        kept.append(" ".join(words))
                at += len(block) + 1
            for k, v in zip(out, (oid, " ".join(kept))):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("oid", pa.int64()), ("text", pa.string())]))


def _covered_blocks(batches):
    """Article streams with boilerplate -> host and text of the blocks that it covers wholly."""
    for batch in batches:
        hosts, gone_blocks = [], []
        for host, stream, window, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            gone, at = bytearray(len(stream)), 0
            for i in starts:
                gone[i : i + window] = b"\1" * window
            for block in stream.split(b"\n"):
                if block and all(gone[at : at + len(block)]):
                    hosts.append(host)
                    gone_blocks.append(block.decode())
                at += len(block) + 1
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(gone_blocks, pa.string())], names=["salt", "block"])


def _shared_blocks(parsed: DataFrame) -> DataFrame:
    """Per distinct article of hosts with MANY of them: the blocks that SHARE of the host's distinct articles hold, as one stream."""
    article = parsed.filter("main").select("salt", F.xxhash64("salt", "texts").alias("oid"), "texts")
    hashes = article.groupBy("salt", "oid").agg(F.first(F.array_distinct(F.transform("texts", lambda t: F.xxhash64(t)))).alias("hs"))  # equal texts, equal hashes
    hashes = stash(hashes, "pages-blocks")
    hosts = stash(hashes.groupBy("salt").agg(F.count("*").alias("articles")).filter(F.col("articles") >= MANY), "pages-articles")
    counted = hashes.select("salt", F.explode("hs").alias("h")).groupBy("salt", "h").agg(F.count("*").alias("c"))
    often = counted.join(hosts, "salt").filter(F.col("c") >= F.greatest(F.lit(2), F.col("articles") * SHARE)).groupBy("salt").agg(F.first("articles").alias("articles"), F.collect_list("h").alias("often"))  # 1 / SHARE times an article's blocks at most, on average
    often = stash(often, "pages-often")
    # only articles of hosts that have such blocks move
    some = article.join(often, "salt").withColumn("texts", F.array_distinct(F.filter("texts", lambda t: F.array_contains("often", F.xxhash64(t))))).filter(F.size("texts") > 0)
    least = F.ceil(F.greatest(F.lit(MANY), F.col("articles") * NEARLY_ALL)).cast("long")
    one = some.select("oid", "salt", least.alias("least"), F.encode(F.array_join("texts", "\n"), "UTF-8").alias("stream"))
    return one.groupBy("oid").agg(F.first("salt").alias("host"), F.first("least").alias("least"), F.first("stream").alias("stream")).withColumn("salt", F.xxhash64("host", F.lit("article")))


def _cut_articles(parsed: DataFrame, gone: DataFrame) -> DataFrame:
    """parsed pages with an article, without the blocks that their host repeats, unless those are most of the article."""
    pages = parsed.filter("main").select("page_id", "url", "salt", "texts")
    per_host = gone.groupBy("salt").agg(F.collect_set("block").alias("gone"))
    size, letters = gone.agg(F.count("*"), F.coalesce(F.sum(F.length("block")), F.lit(0))).first()
    if not size:
        return pages.select("page_id", "url", F.array_join("texts", " ").alias("text"))
    # broadcast within a bound; beyond it a shuffled join, whose hot hosts Spark splits
    joined = pages.join(F.broadcast(per_host) if letters <= BROADCAST_LETTERS else per_host, "salt", "left")
    kept = F.filter("texts", lambda t: ~F.array_contains("gone", t))
    letters_of = lambda x: F.length(F.array_join(x, ""))
    return joined.select("page_id", "url", F.when(F.col("gone").isNotNull() & (2 * letters_of(kept) >= letters_of(F.col("texts"))), F.array_join(kept, " ")).otherwise(F.array_join("texts", " ")).alias("text"))


def extract(spark: SparkSession, pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of pages: page_id, url, text."""
    before = scratch()
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("page_id", "url", "html").alias("uid"), "url", F.xxhash64(F.lower(host)).alias("salt"), F.coalesce("html", F.lit("")).alias("html"))
    # oid: pages without an article are the same by their open text, the others by all they have
    oid = F.xxhash64("salt", "main", "texts", F.when(F.col("main"), F.col("outside")))
    parsed = stash(rows.mapInArrow(_parse, _PARSED).withColumn("oid", oid), "pages")
    # text outside an article counts on hosts that have a page without one; elsewhere structure has settled it
    unsettled = stash(parsed.filter("NOT main").select("salt").distinct(), "pages-open")
    held = parsed.filter("octet_length(outside) > 0").join(unsettled, "salt", "left_semi")
    number = F.coalesce("page_id", F.lit(-(2**63)))
    reps = stash(held.groupBy("oid").agg(F.min(F.struct(number.alias("number"), "uid"))["uid"].alias("uid")), "pages-reps")
    distinct = held.select("oid", "uid", "salt", "main", F.when(~F.col("main"), F.col("texts")).alias("texts"), "outside").join(reps, ["oid", "uid"]).dropDuplicates(["oid", "uid"])
    distinct = stash(distinct, "pages-distinct")
    hosts = stash(distinct.groupBy("salt").agg(F.ceil(F.greatest(F.lit(2), F.count("*") * SHARE)).cast("long").alias("least")), "pages-hosts")
    open_streams = distinct.join(hosts, "salt").select("oid", F.lit(None).cast("long").alias("host"), "salt", "least", F.col("outside").alias("stream"))
    inner = _shared_blocks(parsed).select("oid", "host", "salt", "least", "stream")
    streams = stash(open_streams.unionByName(inner), "pages-streams")
    _, spans = repeated(spark, streams.filter(F.octet_length("stream") >= window).select(F.col("oid").alias("doc_id"), F.col("oid").alias("tid"), F.col("stream").alias("text"), "salt"), window, everywhere=True, name="pages")
    per_stream = spans.groupBy(F.col("tid").alias("oid")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    shared = stash(streams.join(per_stream, "oid"), "pages-shared")
    counts = shared.select("salt", "stream", "least", "ranges").mapInArrow(_count_windows(window), "h long, n long, least long")
    boilerplate = stash(counts.groupBy("h").agg(F.sum("n").alias("n"), F.max("least").alias("least")).filter("n >= least").select("h"), "pages-boilerplate")
    placed = shared.select("oid", "salt", "stream", "ranges").mapInArrow(_place_windows(window), "oid long, h long, at int")
    starts = stash(placed.join(boilerplate, "h").groupBy("oid").agg(F.collect_list("at").alias("starts")), "pages-starts")
    gone = stash(streams.filter("host IS NOT NULL").join(starts, "oid").select("host", "stream", F.lit(window).alias("window"), "starts").mapInArrow(_covered_blocks, "salt long, block string").distinct(), "pages-gone")
    unique = stash(distinct.filter("NOT main").join(starts, "oid", "left").select("oid", "texts", "outside", F.lit(window).alias("window"), "starts").mapInArrow(_unique_runs, "oid long, text string"), "pages-unique")
    sweep(before, parsed, gone, unique)
    without = parsed.filter("NOT main").select("page_id", "url", "oid").join(unique, "oid", "left").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return _cut_articles(parsed, gone).unionByName(without)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
