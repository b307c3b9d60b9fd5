"""Main-text extraction from raw HTML with a host suffix array.

A page is cut into blocks in one pass over its tags.  Navigation, headers, footers, asides,
forms, adverts, notices and comments (by element, role or class name) are chrome.  What is left
stands inside an explicit article (or main) element or is open, and both are settled by
repetition.  The token streams of a host's open blocks are searched for runs of ``run`` tokens
that stand on distinct pages; covered tokens are removed as boilerplate, and the unique runs
stay.  A run inside articles is removed if ``article_pages`` different articles of the host and
``article_share`` of them hold it, so a paragraph that two pages share stays, and an article of
which less than ``article_rest`` would be left (a near copy) stays whole.  Then the main text
of a page is its articles if one of them holds as many tokens as the open blocks, and else the
open blocks with the articles that are not much shorter (``beside``), in the page's order.

The search is the suffix array of the host's concatenated streams, dealt out so that no host
sits in one task: streams are cut into pieces by anchors (least hash of a token gram inside each
run), equal pieces of a host are combined in an aggregation, and only anchors with several
different pieces reach the arrays, shard by shard.  An anchor with very many different pieces
is aggregated run by run instead.  For articles the anchors are counted first, and the runs at
those that enough articles hold are aggregated.

Defined results: a null or empty html gives an empty text; repeated rows are one page to the
search and each gets the result; a null url is a host of its own; other columns are ignored; an
empty table gives an empty result.  Whole pages are read and nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import U64, mix64, ngram_hash, sorted_groups, stored
from ebbflow.llm.suffixes import induced_sort

TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

RAW = frozenset("script style noscript template title textarea iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small "
    "span strike strong sub sup time tt u var wbr img br".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())   # their end tags reach through open blocks
SCOPES = frozenset("table td th caption html template object marquee applet".split())
CHROME = frozenset("head nav footer aside form menu dialog button select option datalist svg math object audio video canvas map".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar side-bar widget widgets footer site-footer page-footer site-header page-header masthead topbar "
    "cookie cookies cookie-banner consent gdpr notice notices banner alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social social-share related related-posts recommended comment comments comment-list comment-section "
    "comments-area reader-comments disqus respond reply replies pagination pager skip-link copyright".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table td th tr ul".split())


def _is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    for m in NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in CHROME_ROLES:
            return True
        if name in ("class", "id"):
            for word in value.replace("_", "-").split():
                if word in CHROME_NAMES or (word.rpartition("-")[2] in ("ad", "ads", "sidebar", "comments", "footer", "nav", "menu")
                                            and not word.startswith(("no-", "has-", "with-", "without-"))):
                    return True
    return False


def blocks(page: str) -> tuple[list[str], list[str]]:
    """(article blocks, open blocks) of a page."""
    found = zones(page)
    return [b for k, b in found if k], [b for k, b in found if not k]


def zones(page: str) -> list[tuple[int, str]]:
    """The blocks of a page that are not chrome, in order, each with the number of the outermost
    article or main element it stands in (0: in none)."""
    found: list[tuple[int, str]] = []
    elements = 0
    stack: list[tuple[str, bool, bool, bool, bool]] = []   # tag, chrome, inside an article, chrome by itself, an article
    chrome = inside = False
    text: list[str] = []                       # of the open block, without what is chrome

    def flush():
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                found.append((elements if inside else 0, " ".join(words)))
            text.clear()

    def push(tag, own, article=False):
        nonlocal chrome, inside
        chrome, inside = chrome or own, inside or (article and not (chrome or own))
        stack.append((tag, chrome, inside, own, article))

    def cut(k, rest=()):
        """Ends the stacked elements from ``k`` on; those of ``rest`` stay."""
        nonlocal chrome, inside
        del stack[k:]
        chrome, inside = stack[-1][1:3] if stack else (False, False)
        for tag, _, _, own, article in rest:
            push(tag, own, article)

    at = 0
    length = len(page)
    while at < length:
        m = TAG.search(page, at)
        if m is None:
            if not chrome:
                text.append(page[at:])
            break
        if m.start() > at and not chrome:
            text.append(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:                                # an end tag
            if tag in VOID:
                continue
            if tag in INLINE:                   # ends a stacked element of that name; the block goes on
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        cut(k, [x for x in stack[k:] if x[0] not in INLINE])
                        break
                    if stack[k][0] not in INLINE and (tag not in FORMATTING or stack[k][0] in SCOPES):
                        break
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if tag in INLINE:
            if tag == "br" and not chrome:
                text.append(" ")
            elif tag not in VOID and not m[3].endswith("/") and (
                    stack and stack[-1][0] in INLINE or m[3] and _is_chrome(tag, m[3], inside)):
                push(tag, True)                 # chrome, or nested in such an element: up to its end tag
            continue
        flush()
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in CLOSES_P:                     # with the inline elements left open in it
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                cut(k)
        if tag in ("article", "main") or (m[3] and re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I)):
            before = inside
            push(tag, _is_chrome(tag, m[3], inside), True)
            elements += inside and not before
        else:
            push(tag, _is_chrome(tag, m[3], inside))
    flush()
    return found


# ------------------------------------------------------------------ the host search
@dataclass(frozen=True)
class HostRules:
    run: int = 12             # tokens of a run that makes boilerplate
    gram: int = 4
    hot_pieces: int = 4096    # different pieces of an anchor beyond which runs are aggregated singly
    shard_tokens: int = 1 << 16
    article_pages: int = 3    # different articles of a host that hold a run of boilerplate, at least,
    article_share: float = 0.5  # and at least this share of them
    article_rest: float = 0.5   # an article of which less would stay is a near copy of others, not boilerplate
    beside: float = 0.25      # an article element with less than this share of an open main text is a teaser


def token_hash(words: list[str]) -> np.ndarray:
    crc = [zlib.crc32(w) | zlib.adler32(w) << 32 for w in map(str.encode, words)]
    return mix64(np.array(crc, U64))


def pieces_of(tokens: np.ndarray, seed: int, rules: HostRules):
    """(first run start, number of starts, anchor) of the pieces of one stream."""
    n = len(tokens) - rules.run + 1
    if n <= 0:
        return []
    grams = ngram_hash(tokens, rules.gram) ^ U64(seed)
    span = rules.run - rules.gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    anchor = views.argmin(axis=1) + np.arange(n)
    start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(start, n))
    return list(zip(start.tolist(), count.tolist(), grams[anchor[start]].view(np.int64).tolist()))


PIECE = "host string, anchor long, content binary, page long, start int, count int, tokens binary"


def _pieces(open_pages: DataFrame, rules: HostRules) -> DataFrame:
    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                rows = []
                for host, page, own in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "open"))):
                    tokens = token_hash([w for b in own for w in b.split(" ")])
                    for start, count, anchor in pieces_of(tokens, zlib.crc32(host.encode()), rules):
                        raw = tokens[start:start + count + rules.run - 1].astype("<u8").tobytes()
                        a, b = mix64(ngram_hash(np.frombuffer(raw, "<u8"), len(raw) // 8)), ngram_hash(mix64(np.frombuffer(raw, "<u8")), len(raw) // 8)
                        rows.append((host, anchor, a.tobytes() + b.tobytes(), page, start, count, raw))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in PIECE.split(", ")])

    return open_pages.select("host", "page", "open").mapInArrow(run, PIECE)


RUNS = "host string, anchor long, content binary, at int, runs int"


def shared_runs(groups: list[list[int]], low: list[int], high: list[int], length: int):
    """Suffix array of token streams: (stream, offset) of every start whose ``length`` tokens stand on
    two pages; ``low`` and ``high`` are the least and greatest page each stream stands on."""
    values = sorted({t for g in groups for t in g})
    rank = {t: k + 2 for k, t in enumerate(values)}
    s, owner, offset = [], [], []
    for k, g in enumerate(groups):
        s += [rank[t] for t in g] + [1]
        owner += [k] * (len(g) + 1)
        offset += range(len(g) + 1)
    sa = induced_sort(s + [0], len(values) + 2)
    flat, out = np.array(s + [0]), []
    n = len(s)
    run: list[int] = []

    def close():
        if len({owner[i] for i in run}) and min(low[owner[i]] for i in run) != max(high[owner[i]] for i in run):
            out.extend((owner[i], offset[i]) for i in run)

    before = -1
    for i in sa:
        if i >= n or offset[i] + length > len(groups[owner[i]]):
            continue                            # no whole run starts here
        if before >= 0 and (flat[i:i + length] == flat[before:before + length]).all():
            run.append(i)
        else:
            if run:
                close()
            run = [i]
        before = i
    if run:
        close()
    return out


def _by_array(reps: DataFrame, rules: HostRules) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for group in sorted_groups(batches, "shard"):
            held.append(group)
            size += sum(len(x.as_buffer()) // 8 for x in group.column("tokens"))
            if size >= rules.shard_tokens:
                yield from shard(held)
                held, size = [], 0
        yield from shard(held)

    def shard(held):
        rows = [r for g in held for r in g.to_pylist()]
        by_host: dict = {}
        for r in rows:
            by_host.setdefault(r["host"], []).append(r)
        out = []
        for own in by_host.values():
            streams = [np.frombuffer(r["tokens"], "<u8").tolist() for r in own]
            for k, at in shared_runs(streams, [r["low"] for r in own], [r["high"] for r in own], rules.run):
                out.append((own[k]["host"], own[k]["anchor"], own[k]["content"], at, 1))
        if out:
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in RUNS.split(", ")])

    sharded = reps.withColumn("shard", F.xxhash64("host", "anchor")).repartition("shard").sortWithinPartitions("shard")
    return sharded.mapInArrow(run, RUNS)


def _by_run(reps: DataFrame, rules: HostRules) -> DataFrame:
    """The same for hot anchors: every run of a piece by itself, in an aggregation."""
    width = 8 * rules.run
    starts = F.sequence(F.lit(0), F.col("count") - 1)
    rows = reps.select("host", "anchor", "content", "low", "high", "tokens", F.explode(starts).alias("at"))
    rows = rows.withColumn("string", F.expr(f"substring(tokens, 8 * at + 1, {width})"))
    pages = rows.groupBy("host", "string").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a != b")
    return rows.join(pages, ["host", "string"]).select("host", "anchor", "content", F.col("at").cast("int").alias("at"), F.lit(1).alias("runs"))


def covered_tokens(open_pages: DataFrame, rules: HostRules) -> DataFrame:
    """(page, covered): packed (first token, last token + 1) pairs of boilerplate on each page."""
    pieces = stored(_pieces(open_pages, rules), "page-pieces")
    keys = ["host", "anchor", "content"]
    reps = pieces.groupBy(*keys).agg(
        F.min("page").alias("low"), F.max("page").alias("high"), F.first("count").alias("count"), F.first("tokens").alias("tokens"))
    reps = stored(reps, "page-piece-groups")
    several = reps.groupBy("host", "anchor").agg(F.count("*").alias("different")).filter("different > 1")
    open_reps = reps.join(several, ["host", "anchor"])
    whole = reps.filter("low != high").select(*keys, F.lit(0).alias("at"), F.col("count").alias("runs"))
    found = whole.unionByName(_by_array(open_reps.filter(F.col("different") <= rules.hot_pieces), rules)).unionByName(
        _by_run(open_reps.filter(F.col("different") > rules.hot_pieces), rules))
    spans = pieces.join(found, keys).select("page", F.struct((F.col("start") + F.col("at")).alias("s"), "runs").alias("span"))
    listed = spans.groupBy("page").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    return listed.select("page", F.transform("spans", lambda x: F.struct(x.s.alias("s"), (x.s + x.runs + rules.run - 1).alias("e"))).alias("spans"))


ANCHORS = "hkey long, anchor long"
FORTY_BITS = -1 << 24   # of an anchor are counted: one that clashes is compared in vain, none is missed
ARTICLE_RUNS = "hkey long, one long, two long, twin long, page long, at int"


def _stream(own: list[str]) -> np.ndarray:
    return token_hash([w for b in own for w in b.split(" ")])


def _article_anchors(articles: DataFrame, rules: HostRules) -> DataFrame:
    """The different anchors of each article."""

    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                found = [np.unique(np.array([a for *_, a in pieces_of(_stream(own), 0, rules)], np.int64) & FORTY_BITS)
                         for own in batch.column("article").to_pylist()]
                hkey = np.repeat(batch.column("hkey").to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(hkey), pa.array(np.concatenate(found))], ["hkey", "anchor"])

    return articles.select("hkey", "article").mapInArrow(run, ANCHORS)


def _article_runs(articles: DataFrame, rules: HostRules) -> DataFrame:
    """The runs at the anchors in ``anchors``, with their place."""

    def run(batches):
        names = [f.split()[0] for f in ARTICLE_RUNS.split(", ")]
        for big in batches:
            for k in range(0, big.num_rows, 64):
                batch = big.slice(k, 64)
                for hkey, twin, page, own, wanted in zip(*(batch.column(c).to_pylist() for c in ("hkey", "twin", "page", "article", "anchors"))):
                    tokens, wanted = _stream(own), set(wanted)
                    at = [np.arange(s, s + n) for s, n, a in pieces_of(tokens, 0, rules) if a & FORTY_BITS in wanted]
                    if not at:
                        continue
                    at = np.concatenate(at)
                    one, two = ngram_hash(tokens, rules.run)[at], ngram_hash(mix64(tokens), rules.run)[at]
                    cols = [pa.array(np.full(len(at), x, np.int64)) for x in (hkey, twin, page)]
                    yield pa.RecordBatch.from_arrays(
                        [cols[0], pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *cols[1:], pa.array(at.astype(np.int32))], names)

    return articles.select("hkey", "twin", "page", "article", "anchors").mapInArrow(run, ARTICLE_RUNS)


def covered_articles(articles: DataFrame, rules: HostRules) -> DataFrame:
    """(page, spans) as of ``covered_tokens`` for article streams: a run is boilerplate if
    ``article_pages`` different articles of the host and ``article_share`` of them hold it.  An
    anchor that fewer pages hold cannot have such a run, so only the others are compared."""
    articles = articles.withColumn("hkey", F.xxhash64("host")).withColumn("twin", F.xxhash64("article"))
    needed = articles.groupBy("hkey").agg(F.count_distinct("twin").alias("n")).select(
        "hkey", F.greatest(F.lit(rules.article_pages), F.ceil(F.col("n") * rules.article_share)).alias("needed"))
    needed = stored(needed, "host-articles")
    anchors = _article_anchors(articles, rules).groupBy("hkey", "anchor").count().filter(F.col("count") >= rules.article_pages)
    wanted = anchors.join(needed, "hkey").filter("count >= needed").groupBy("hkey").agg(F.collect_list("anchor").alias("anchors"))
    wanted = stored(wanted, "host-anchors")
    runs = stored(_article_runs(articles.join(wanted, "hkey"), rules), "article-runs")
    keys = ["hkey", "one", "two"]
    shared = runs.select(*keys, "twin").distinct().groupBy(*keys).count().join(needed, "hkey").filter("count >= needed").select(*keys)
    spans = runs.join(shared, keys).groupBy("page").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return spans.select("page", F.transform("at", lambda x: F.struct(x.alias("s"), (x + rules.run).alias("e"))).alias("spans"))


PARSED = "page_id long, url string, page long, host string, article array<string>, open array<string>, element array<int>"
SCHEMA = "page_id long, url string, text string, n_chars long, n_tokens_removed long"


def parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                own = [zones(x or "") for x in batch.column("html").to_pylist()]
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("page_id", "url", "page", "host")]
                    + [pa.array([[b for n, b in x if n] for x in own], kind), pa.array([[b for n, b in x if not n] for x in own], kind),
                       pa.array([[n for n, _ in x] for x in own], pa.list_(pa.int32()))], [f.split()[0] for f in PARSED.split(", ")])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), "url", F.xxhash64("page_id", "url", "html").alias("page"), host.alias("host"), "html").mapInArrow(run, PARSED)


def main_text(pages: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    cut = stored(parsed(pages), "pages")
    covered = stored(covered_tokens(cut.filter(F.size("open") > 0).select("host", "page", "open").distinct(), rules), "open-spans")
    in_articles = cut.filter(F.size("article") > 0).select("host", "page", "article")   # repeated rows: the same twin and page
    in_articles = stored(covered_articles(in_articles, rules), "article-spans")

    def left_of(own, spans, least=0.0):
        """The blocks without their covered tokens, and the number of these; all of them if less than a share of ``least`` stays."""
        gone: set[int] = set()
        for x in spans or ():
            gone.update(range(x["s"], x["e"]))
        if not gone or least and len(gone) > (1 - least) * sum(b.count(" ") + 1 for b in own):
            return own, 0
        at, out = 0, []
        for b in own:
            words = b.split(" ")
            out.append(" ".join(w for n, w in enumerate(words, at) if n not in gone))
            at += len(words)
        return out, len(gone)

    def keep(batches):
        for big in batches:
            for k in range(0, big.num_rows, 512):
                batch = big.slice(k, 512)
                texts, removed = [], []
                for article, loose, element, in_open, in_article in zip(
                        *(batch.column(c).to_pylist() for c in ("article", "open", "element", "open_spans", "article_spans"))):
                    loose, n_open = left_of(loose, in_open)
                    article, n_article = left_of(article, in_article, rules.article_rest)
                    parts = {True: iter(article), False: iter(loose)}
                    own = [(n, next(parts[n > 0])) for n in element]
                    tokens: dict[int, int] = {}
                    for n, b in own:
                        tokens[n] = tokens.get(n, 0) + (b.count(" ") + 1 if b else 0)
                    outside = tokens.pop(0, 0)
                    if max(tokens.values(), default=0) >= outside:   # the articles are the main text
                        main, n_open = set(tokens), 0
                    else:
                        main = {0} | {n for n, c in tokens.items() if c >= rules.beside * outside}
                    texts.append("\n\n".join(b for n, b in own if b and n in main))
                    removed.append(n_open + n_article)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())],
                    ["page_id", "url", "text", "n_tokens_removed"])

    found = cut.join(covered.withColumnRenamed("spans", "open_spans"), "page", "left").join(
        in_articles.withColumnRenamed("spans", "article_spans"), "page", "left")
    found = found.select("page_id", "url", "article", "open", "element", "open_spans", "article_spans").mapInArrow(
        keep, "page_id long, url string, text string, n_tokens_removed long")
    return found.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_tokens_removed")
