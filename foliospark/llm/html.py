"""Main text of web pages: structure gives blocks, suffix arrays over a host's pages tell boilerplate from unique runs.

1. One forward pass cuts each page into blocks of text, in time in proportion to its length. Scripts, styles and markup
   vanish; a block is marked as being inside the article (``article`` or ``main``), inside a part that never is (menus,
   headers, footers, sidebars, adverts, forms, notices, comments), or as open.
2. A page's stream is its blocks outside the article, and the short blocks (at most EDGE tokens) with which its article
   begins and ends. A host's streams are dealt over tasks; in each, a suffix array over the concatenated streams gives
   every distinct run of RUN tokens with the number of pages it is on. The numbers are added up over the whole host, so
   how pages were dealt changes nothing.
3. Runs on at least SHARE of a host's distinct pages, and MIN_PAGES of them, cover boilerplate. An open block at least
   COVERED of whose tokens they cover is dropped. A short block at an article's edge is dropped only if runs on most of
   the host's pages (EDGE_SHARE, and EDGE_PAGES of them) cover it whole, and never all blocks of an article.
4. The main text is the article's blocks that are left; a page without an article keeps its open blocks that are left.

Distinct pages: pages whose articles have one smallest shingle hash count once, and so do pages without an article whose
streams are equal. Copies of an article, also somewhat edited ones, therefore don't condemn its text, and paragraphs
longer than EDGE tokens are never dropped from an article.

Defined results: a null html is an empty page with an empty text; a null url or one without a host is a host named '';
unclosed tags and comments are tolerated, a tag cut off at the end vanishes; a very long page is read whole; repeated rows
get equal results; ties don't occur, for every decision is by numbers of pages; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, checkpointed, small_batches, table

#: Streams of a task's suffix array, about; it has no bearing on results.
GROUP = 128
RUN, SHARE, MIN_PAGES = 6, 0.1, 3
EDGE, EDGE_SHARE, EDGE_PAGES = 40, 0.5, 10
#: A block is boilerplate if at least this share of its tokens is covered.
COVERED = 0.5
#: Words of a shingle of the article's identity.
SHINGLE = 5
#: Hosts, and shared runs, up to which a table of theirs, below 100 bytes a row, is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 500_000

#: Fixed values of HTML: elements that start and end a block, those that may hold others, and those without text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table td ul li button select".split())
VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea svg title iframe object math".split())
NEVER = frozenset("nav aside footer form menu dialog button select".split())
#: Words of a class, id or role that mark what isn't the article: in any name, or in names of nothing but such words.
SURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr sidebar breadcrumb breadcrumbs disqus newsletter subscribe signup popup modal footer masthead".split())
LIKELY = frozenset("banner promo promos promotion consent notice notices menu nav navbar navigation comment comments share sharing social related recommended recommendations header widget reply replies".split())
PLAIN = frozenset("area bar block bottom box buttons container content icons inner item items left links list main outer page panel posts primary right secondary section site slot stories thread top unit user users reader readers wrapper".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)*+)>""")
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""", re.I).findall
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""").search
END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in SILENT}

HAS_ARTICLE = re.compile(r"<(?:article|main)\b", re.I).search

ARTICLE, OPEN, OUT = 0, 1, 2


def marked(attributes: str, only: frozenset[str] | None = None) -> bool:
    """Whether a class, id or role tells of what isn't the article; ``only``: names that are such a word by themselves."""
    for values in NAMED(attributes):
        for name in " ".join(values).lower().split():
            if only is not None:
                if name in only:
                    return True
                continue
            parts = re.split("[_-]+", name)
            if any(p in SURE for p in parts):
                return True
            if any(p in LIKELY for p in parts) and all(p in LIKELY or p in PLAIN for p in parts):
                return True
    return False


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, ARTICLE, OPEN or OUT) of each block, in order. Where what stands around them would leave out every article of a
    page, as a form or a class name around the whole page, it doesn't count."""
    found = scanned(page, False)
    if page and HAS_ARTICLE(page) and all(kind != ARTICLE for _, kind in found):
        return scanned(page, True)
    return found


def scanned(page: str | None, lenient: bool) -> list[tuple[str, int]]:
    """The blocks by one forward pass; ``lenient``: an article begins even inside what its name leaves out."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether an article or in one, whether left out
    opened: dict[str, int] = {}  # how often each element is on the stack
    endless: set[str] = set()  # elements without text that aren't closed any more
    own_out = False  # of a paragraph by its own class
    inline: list = []  # of an element inside a line that its class leaves out: name, where its text begins, how often it is open
    page = page or ""
    at, n = 0, len(page)

    def close() -> None:
        if inline:
            del held[inline[1] :]
            inline.clear()
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            inside, left_out = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append((text, OUT if left_out or own_out else ARTICLE if inside else OPEN))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        held.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        second = page[lt + 1 : lt + 2]
        if second in ("!", "?") and second:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        first = page[lt + 2 : lt + 3] if second == "/" else second
        if not (first.isascii() and first.isalpha()):
            held.append("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if not m:  # the page ends inside this tag
            break
        at = m.end()
        name, closing = m[2].lower(), bool(m[1])
        if name in SILENT:
            if not closing and not (name in ("svg", "math") and SELF_CLOSED(m[3])):
                end = None if name in endless else END[name].search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title", "iframe"):
                    break  # their text goes on to the end of the page
                else:
                    endless.add(name)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCKS and name not in HOLDERS:
            if inline and name == inline[0]:
                inline[2] += -1 if closing else 1
                if not inline[2]:
                    del held[inline[1] :]
                    inline.clear()
            elif not inline and not closing and name not in VOID and m[3] and marked(m[3], SURE):
                inline[:] = [name, len(held), 1]
            continue
        close()
        own_out = False
        if closing:
            if opened.get(name):
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            continue
        if name == "hr":
            continue
        if name == "li" and stack and stack[-1][0] == "li":  # an item ends where the next begins
            opened[stack.pop()[0]] -= 1
        inside, left_out = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        begins = name in ("article", "main") and not inside and (lenient or not left_out)
        if begins:
            left_out = False
        bad = name in NEVER or (name == "header" and not inside) or (not begins and bool(m[3]) and marked(m[3]))
        if name in HOLDERS:
            stack.append((name, inside or begins, left_out or bad))
            opened[name] = opened.get(name, 0) + 1
        else:
            own_out = bad
    close()
    return out


def edges(blocks: list[tuple[str, int]]) -> set[int]:
    """Positions of the short blocks with which an article begins and ends."""
    article = [k for k, (_, kind) in enumerate(blocks) if kind == ARTICLE]
    found: set[int] = set()
    for side in (article, article[::-1]):
        for k in side:
            if k in found or len(blocks[k][0].split(None, EDGE)) > EDGE:
                break
            found.add(k)
    return found


def streamed(blocks: list[tuple[str, int]]) -> list[int]:
    """Positions of the blocks of a page's stream."""
    short = edges(blocks)
    return [k for k, (_, kind) in enumerate(blocks) if kind != ARTICLE or k in short]


def identity(blocks: list[tuple[str, int]], stream: str) -> int:
    """What distinct pages differ in."""
    words = [w for text, kind in blocks if kind == ARTICLE for w in text.split()]
    if not words:
        return signed(xxhash.xxh64_intdigest(stream))
    return signed(min(xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def run_hash(tokens: list[str]) -> int:
    return signed(xxhash.xxh64_intdigest(" ".join(tokens)))


def suffix_order(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before, by prefix doubling."""
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1]]
    step = 1
    while step < n and ranks[-1].max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - step] = ranks[-1][step:]
        ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + second + 1, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
        for x in (common, a, b):
            x[same] += 1 << k
    return order, np.concatenate([[0], common])


def runs(streams: list[str], least: int) -> list[tuple[int, int]]:
    """(hash, number of streams) of each run of RUN tokens that is in at least so many of the streams."""
    ids: dict[str, int] = {}
    tokens, owner = [], []
    for k, stream in enumerate(streams):
        own = [ids.setdefault(w, len(ids)) for w in stream.split()]
        tokens += [*own, -1 - k]  # a stream's end is unlike any other token
        owner += [k] * (len(own) + 1)
    if len(tokens) < RUN:
        return []
    at, owners = np.array(tokens), np.array(owner)
    order, common = suffix_order(at)
    run = np.cumsum(common < RUN) - 1  # suffixes that share their first RUN tokens
    pairs = np.unique(run.astype(np.int64) * len(streams) + owners[order])
    spread = np.bincount(pairs // len(streams), minlength=run[-1] + 1)
    first = order[np.flatnonzero(np.diff(run, prepend=-1))]
    whole = (first + RUN < len(at)) & (owners[np.minimum(first + RUN, len(at) - 1)] == owners[first])
    words = list(ids)
    return [(run_hash([words[t] for t in tokens[i : i + RUN]]), int(c)) for i, c in zip(first[whole & (spread >= least)].tolist(), spread[whole & (spread >= least)].tolist(), strict=True)]


def covered(blocks: list[tuple[str, int]], positions: list[int], shared: set[int]) -> dict[int, float]:
    """Share of each stream block's tokens that shared runs cover."""
    tokens = [(w, k) for k in positions for w in blocks[k][0].split()]
    flags, until = [], 0
    for i in range(len(tokens)):
        if i + RUN <= len(tokens) and run_hash([w for w, _ in tokens[i : i + RUN]]) in shared:
            until = i + RUN
        flags.append(i < until)
    total, hit = dict.fromkeys(positions, 0), dict.fromkeys(positions, 0)
    for (_, k), flag in zip(tokens, flags, strict=True):
        total[k] += 1
        hit[k] += flag
    return {k: hit[k] / max(1, total[k]) for k in positions}


def main_text(blocks: list[tuple[str, int]], many: set[int], most: set[int]) -> tuple[list[str], int]:
    """Blocks of the main text, and how many blocks boilerplate took; ``many`` and ``most`` are runs on SHARE and on
    EDGE_SHARE of the host's pages."""
    article = [k for k, (_, kind) in enumerate(blocks) if kind == ARTICLE]
    candidates = article or [k for k, (_, kind) in enumerate(blocks) if kind == OPEN]
    runs_, limit = (most, 1.0) if article else (many, COVERED)
    if not runs_:
        return [blocks[k][0] for k in candidates], 0
    share = covered(blocks, streamed(blocks), runs_)
    kept = [k for k in candidates if share.get(k, 0.0) < limit]
    if article and not kept:
        kept = article
    return [blocks[k][0] for k in kept], len(candidates) - len(kept)


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_runs(pages: DataFrame) -> DataFrame:
    """(host, many array<long>, most array<long>) of hosts with shared runs; takes (host, html).

    A host has at most 1 / SHARE times as many of them as its pages have runs on average, so the arrays are about as
    long as a page's text, whatever the host's size.
    """

    def parse(it):
        for batch in batches(it):
            ids, streams = [], []
            for page in batch.column(1):
                blocks = blocks_of(page.as_py())
                streams.append("\n".join(blocks[k][0] for k in streamed(blocks)))
                ids.append(identity(blocks, streams[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(streams, pa.string())], names=["host", "id", "stream"])

    streams = pages.select("host", "html").mapInArrow(parse, "host string, id long, stream string")
    streams = checkpointed(streams.groupBy("host", "id").agg(F.min("stream").alias("stream")))
    sizes = checkpointed(streams.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES))
    sized = small(sizes)

    def count(group: pa.Table) -> pa.Table:
        one = group["groups"][0].as_py() == 1  # the whole host: rarer runs needn't be told
        found = runs(group["stream"].to_pylist(), MIN_PAGES if one else 1)
        return pa.table({"host": pa.array([group["host"][0].as_py()] * len(found), pa.string()), "run": pa.array([h for h, _ in found], pa.int64()), "n": pa.array([c for _, c in found], pa.int64())})

    dealt = streams.join(sized, "host").withColumn("groups", F.ceil(F.col("pages") / GROUP))
    dealt = dealt.withColumn("group", F.pmod("id", "groups")).repartition("host", "group")
    counted = dealt.groupBy("host", "group").applyInArrow(count, "host string, run long, n long")
    total = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(sized, "host")
    enough = total.where(F.col("n") >= F.greatest(F.lit(MIN_PAGES), SHARE * F.col("pages")))
    most = F.when(F.col("n") >= F.greatest(F.lit(EDGE_PAGES), EDGE_SHARE * F.col("pages")), F.col("run"))
    return checkpointed(enough.groupBy("host").agg(F.collect_list("run").alias("many"), F.collect_list(most).alias("most"), F.count("*").alias("n")))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_boilerplate) of every page; the last counts the blocks that shared runs took."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "(?s)^[^/]*?://([^/?#]*)", 1))
    picked = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html")
    shared = shared_runs(picked)
    if (shared.agg(F.sum("n")).first()[0] or 0) + shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)

    def decide(it):
        for batch in batches(it):
            sets: dict[tuple, set[int]] = {}
            texts, dropped = [], []
            for page, host, *lists in zip(*(batch.column(k).to_pylist() for k in (2, 3)), batch.column(4), batch.column(5), strict=True):
                many, most = (sets.setdefault((host, k), set(x.as_py() or ())) if (host, k) not in sets else sets[host, k] for k, x in enumerate(lists))
                kept, n = main_text(blocks_of(page), many, most)
                texts.append("\n\n".join(kept))
                dropped.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(dropped, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_boilerplate"])

    joined = picked.join(shared, "host", "left").select("page_id", "url", "html", "host", "many", "most")
    return joined.mapInArrow(decide, "page_id long, url string, text string, n_chars long, n_boilerplate long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
