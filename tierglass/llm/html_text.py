"""Main text of web pages by repeated runs within a host.

Method: the suffixes of the token streams of all pages of a host are brought together by their first ``RUN``
tokens, which is as deep as the decision looks; runs that two distinct pages of the host have are
boilerplate, what is unique is kept. Tokens are the words of text blocks and one mark for every block's
chain of elements.

Suffixes that begin alike have the same anchor, the least-hashed ``GRAM`` tokens among the ``RUN``. Anchors
of every page are counted first, one in three suffixes has a new one; only suffixes on anchors that can
decide something are then counted in full. Both are rows of a hash that holds the host, so a host of any
size is spread over all tasks and each of its pages counts.

Elements are checked afterwards. Menus, forms, adverts and the like go even where their words are unique.
An article quotes, and is published twice, so inside an article or main element a run is boilerplate only if
more than half of the pages of the host have it, ``SEVERAL`` at least: a block that such runs cover whole is
a notice that the host puts in its articles. An article that is mostly such runs is one text published
often, and stays. html is never shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierglass.functions.membership import filter_of, probable, with_probable
from tierglass.llm import words as W
from tierglass.llm.common import cut, table

RUN = 8
GRAM = 4
COVERED = 0.5
#: Pages that must have a run inside an article or main element, and more than half of the host's pages.
SEVERAL = 4
#: An anchor only picks suffixes to be counted in full, so fewer bits lose nothing and shuffle less.
_ANCHOR = np.uint64((1 << 40) - 1)
#: Stands for the missing id of a page, as all rows without one count as one page.
_NO_ID = -(1 << 63)

_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select head".split())
_DROPPED = frozenset(
    "nav header footer aside form button menu dialog figcaption fieldset label option input audio video".split()
)
_MAIN = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Words of class, id and role that name what is not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer footer header masthead menu menubar modal nav navbar navigation newsletter notice notification pagination "
    "pager popup promo promoted recommended related reply replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget complementary contentinfo search".split()
)
#: Words in front of a name that say something of the page, not of the element.
_ABOUT = frozenset("no has with without is not show hide".split())
#: Elements that are no article text even around an article or main element.
_ASIDE = _DROPPED - frozenset("form fieldset label option input button".split()) | {"head"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?\s*(=?)\s*")
_PLAIN_VALUE = re.compile(r"[^\s>]*")
_CLOSES_P = _BLOCK - {"html", "body"}


def blocks(page: str) -> list[tuple[str, str, str]]:
    """Text blocks in page order: (kind, chain of open elements, text).

    Kinds: ``main`` inside an article or main element, ``drop`` inside what is never article text, and
    ``open`` elsewhere. Character references are decoded, white space is made one blank. The time is
    linear in the page, whatever is left open in it.
    """
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, main
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            outer = next((i for i, s in enumerate(stack) if s[2]), None)
            main = outer is not None
            # Around an article or main element only elements decide, not names.
            dropped = any(s[1] for s in stack[outer or 0 :]) or any(s[0] in _ASIDE for s in stack[: outer or 0])
            out.append(("drop" if dropped else "main" if main else "open", ">".join(s[0] for s in stack[-6:]), text))

    reader = _Reader(page)
    for name, closing, attributes, text in reader:
        if name is None:
            held.append(text)
            continue
        if name == "br":
            held.append("\n")
        elif name in _BLOCK:
            flush()
        if closing:
            _close(stack, name)
        elif name not in _VOID and attributes is not None:
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if name in _BLOCK or name in _DROPPED or name == "head":
                stack.append((name, name in _DROPPED or name == "head" or _unwanted(name, attributes), name in _MAIN))
    flush()
    return out


class _Reader:
    """Tags and texts of a page in one pass; what stands in raw elements is left out.

    A tag ends at the first ``>`` outside a quoted value. A quote that is never closed is no quote, a raw
    element that is closed at once or never loses only itself. Each search that fails is made once.
    """

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def __iter__(self):
        """(name, whether it closes, attributes, None) of tags and (None, None, None, text) of texts.

        The attributes of an element that closes itself are None.
        """
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            tag = self._find("<", at)
            if tag < 0:
                yield None, None, None, html.unescape(page[at:])
                return
            if tag > at:
                yield None, None, None, html.unescape(page[at:tag])
            at = tag + 1
            if page.startswith("!--", at):
                end = self._find("-->", at + 1)
                at = n if end < 0 else end + 3
            elif page.startswith("![CDATA[", at):
                end = self._find("]]>", at)
                yield None, None, None, page[at + 8 : n if end < 0 else end]
                at = n if end < 0 else end + 3
            elif page[at : at + 1] in ("!", "?"):
                end = self._find(">", at)
                at = n if end < 0 else end + 1
            else:
                closing = page.startswith("/", at)
                found = _NAME.match(page, at + closing)
                if found is None:
                    yield None, None, None, "<"
                    continue
                at, attributes = self._attributes(found.end())
                name = found[0].lower()
                if name in _RAW and name != "head":
                    at = at if closing or attributes is None else self._after(name, at)
                    continue
                yield name, closing, attributes, None

    def _attributes(self, at: int) -> tuple[int, dict[str, str] | None]:
        """End of the tag, and its attributes; None if it closes itself. A tag without end is the rest."""
        page, out, n = self.page, {}, len(self.page)
        while at < n:
            if page[at] == ">":
                return at + 1, out
            if page.startswith("/>", at):
                return at + 2, None
            found = _ATTRIBUTE.match(page, at)
            start = at = found.end()
            if found[2] and page[at : at + 1] in ("'", '"'):
                end = self._find(page[at], at + 1)
                if end >= 0:
                    out.setdefault((found[1] or "").lower(), page[at + 1 : end])
                    at = end + 1
                    continue
            if found[2]:
                at = _PLAIN_VALUE.match(page, at).end()
                value = page[start:at]
                if value.endswith("/") and page.startswith(">", at):
                    return at + 1, None
                out.setdefault((found[1] or "").lower(), value)
        return n, out

    def _after(self, name: str, at: int) -> int:
        """Behind the end tag of a raw element; right here if there is none."""
        if f"</{name}" in self.missing:
            return at
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(self.page, at)
        if found is None:
            self.missing.add(f"</{name}")
            return at
        return found.end()


def _close(stack: list[tuple[str, bool, bool]], name: str) -> None:
    """Close the innermost such element and all inside it; an end tag without a start does nothing."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return


def _unwanted(name: str, attributes: dict[str, str]) -> bool:
    """Whether a class, id or role names what is not the article: by its last word, as in ``site-header``."""
    if name in ("html", "body") or name in _MAIN:
        return False
    for value in (attributes.get(k, "") for k in ("class", "id", "role")):
        for one in value.lower().split():
            words = [w for w in re.split(r"[^a-z]+", one) if w]
            if words and words[-1] in _NAMES and words[0] not in _ABOUT:
                return True
    return False


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN, least: int = 2) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that two distinct pages have, or as many as ``least`` says.

    ``page`` numbers the page of each token and does not fall. Runs do not cross pages.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < run:
        return covered
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.full(n, -1, np.int64)
        ahead[:-step] = rank[step:]
        rank = np.unique((rank + 1) * (n + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    start = np.flatnonzero(page[: n - run + 1] == page[run - 1 :])
    if not len(start):
        return covered
    rank, own = rank[start], page[start]
    order = np.lexsort((own, rank))
    rank, own = rank[order], own[order]
    group = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    fresh = np.append(True, (rank[1:] != rank[:-1]) | (own[1:] != own[:-1]))
    several = np.add.reduceat(fresh.astype(np.int64), group) >= least
    hit = start[order][np.repeat(several, np.diff(np.append(group, len(rank))))]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + run, -1)
    return np.cumsum(change[:-1]) > 0


def main_texts(pages: list[list[tuple[str, str, str]]], names: np.ndarray, run: int = RUN) -> list[str]:
    """Main text of the pages of one small host in memory, by sorted suffixes; tests compare with it."""
    page_tokens, page_numbers, spans = [], [], []
    total = 0
    for number, found in zip(names.tolist(), pages):
        own = []
        for kind, chain, text in found:
            words = text.split(" ")
            own.append((total, total + len(words) + 1, kind, text))
            page_tokens.append(np.fromiter(map(hash, (chain, *words)), np.int64, len(words) + 1))
            page_numbers.append(np.full(len(words) + 1, number, np.int64))
            total += len(words) + 1
        spans.append(own)
    if not total:
        return [""] * len(pages)
    tokens, numbers = np.concatenate(page_tokens), np.concatenate(page_numbers)
    many = max(SEVERAL, len(set(names.tolist())) // 2 + 1)
    by_least = {k: np.concatenate([[0], np.cumsum(repeated_runs(tokens, numbers, run, k))]) for k in (2, many)}
    out = []
    for own in spans:
        kinds = "".join(kind[0] for *_, kind, _ in own)
        covered = by_least[2 if _undecided(kinds) else many]
        counts = [int(covered[b] - covered[a]) for a, b, *_ in own]
        kept = _unique(kinds, [b - a for a, b, *_ in own], counts)
        out.append("\n".join(text for keep, (*_, text) in zip(kept, own) if keep))
    return out


def _undecided(kinds: str) -> bool:
    """Whether a page has text that no element decides and no article or main element."""
    return "o" in kinds and "m" not in kinds


def _unique(kinds: str, sizes: list[int], covered: list[int]) -> list[bool]:
    """Which blocks of a page stay, by their kinds, tokens, and tokens in runs of other pages."""
    main = [(c, n) for kind, n, c in zip(kinds, sizes, covered) if kind == "m"]
    if not main:
        return [kind == "o" and c <= COVERED * n for kind, n, c in zip(kinds, sizes, covered)]
    copy = sum(c for c, _ in main) > COVERED * sum(n for _, n in main)
    return [kind == "m" and (copy or c < n) for kind, n, c in zip(kinds, sizes, covered)]


def _stream(found: list[tuple[str, str, str]]) -> str:
    """A line for every block: its chain as one word, then its text."""
    return "\n".join(f"<{chain} {text}" for _, chain, text in found)


def _parsed(batch: pa.RecordBatch) -> tuple[pa.Array, list[str]]:
    """Token stream and kinds of blocks of each page."""
    streams, kinds = [], []
    for page in batch.column("html").to_pylist():
        found = blocks(page or "")
        streams.append(_stream(found))
        kinds.append("".join(kind[0] for kind, _, _ in found))
    return pa.array(streams, pa.string()), kinds


def _suffixes(streams: pa.Array, hosts: pa.Array, run: int):
    """Suffixes of ``run`` tokens or more: place, stream, hash of host and first tokens, anchor; offsets of the streams."""
    data, offsets = W.buffers(streams)
    starts, ends, token_offsets = W.bounds(data, offsets)
    words = W.hashes(data, starts, ends)
    h, grams = W.windows(words, run), W.windows(words, min(GRAM, run))
    anchor = grams[: len(h)].copy()
    for step in range(1, run - min(GRAM, run) + 1):
        np.minimum(anchor, grams[step : step + len(h)], out=anchor)
    stream = np.repeat(np.arange(len(streams)), np.diff(token_offsets))
    place = np.flatnonzero(stream[: len(h)] == stream[run - 1 :]) if len(h) else np.zeros(0, np.int64)
    own = stream[place]
    host = hosts.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[own]
    return place, own, W.mix(h[place] ^ host).view(np.int64), (anchor[place] & _ANCHOR).view(np.int64), token_offsets


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html).

    A null or empty html, and one without article text, gives an empty text. A null url is a host of
    its own; repeated rows get a row each and count as one page when runs are compared. Other columns
    are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    pages = pages.select(
        "page_id",
        "url",
        "html",
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page"),
        F.xxhash64(host).alias("host"),
        F.xxhash64("page_id", "url", "html").alias("row"),
    )
    out = "page_id long, url string, text string"

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b, "html")):
            streams, kinds = _parsed(batch)
            _, own, _, anchor, _ = _suffixes(streams, batch.column("host"), run)
            # Neighbours share an anchor. Rows stay in page order, which shuffles in fewer bytes.
            keep = np.ones(len(own), bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
            own = pa.array(own[keep])
            undecided = pa.array(list(map(_undecided, kinds)), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[keep]), *(c.take(own) for c in (batch.column("page"), batch.column("host"), undecided))],
                ["anchor", "page", "host", "undecided"],
            )

    sizes = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    met = (
        pages.select("html", "page", "host")
        .mapInArrow(W.task(anchors), "anchor long, page long, host long, undecided boolean")
        .groupBy("anchor", "host")
        .agg(
            F.min("page").alias("first"),
            F.max("page").alias("last"),
            F.count("*").alias("n"),
            F.max("undecided").alias("undecided"),
        )
        .where(F.expr(f"first < last and (undecided or n >= {SEVERAL})"))
    )
    # Rows are no fewer than pages, so this lets every anchor pass that a run below has.
    shared = cut(met.join(sizes, "host").where("undecided or 2 * n > pages").select("anchor", "host"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b, "html")):
            yield _texts(batch, *_parsed(batch), run)

    if shared.isEmpty():
        return pages.select("page_id", "url", "html", "host").mapInArrow(W.task(plain), out)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b, "html")):
            streams, kinds = _parsed(batch)
            _, own, values, anchor, _ = _suffixes(streams, batch.column("host"), run)
            own = pa.array(own)
            undecided = pa.array(list(map(_undecided, kinds)), pa.bool_())
            columns = (*(batch.column(c) for c in ("page", "host", "row")), undecided)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(values), *(c.take(own) for c in columns)],
                ["anchor", "h", "page", "host", "row", "undecided"],
            )

    # Bloom filters of bounded size: suffixes on other anchors cost time and change nothing.
    asked = probable(
        probable(pages.select("html", "page", "host", "row"), filter_of(shared, ["host"]), ["host"]).mapInArrow(
            W.task(suffixes), "anchor long, h long, page long, host long, row long, undecided boolean"
        ),
        filter_of(shared, ["host", "anchor"]),
        ["host", "anchor"],
    )
    runs = (
        asked.groupBy("h", "page")
        .agg(F.min("host").alias("host"))
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.min("host").alias("host"))
        .where("n > 1")
    )
    # Written, so that the join has an exchange on either side and Spark can split a frequent suffix.
    frequent = F.expr(f"n >= {SEVERAL} and 2 * n > pages").alias("frequent")
    repeated = cut(runs.join(sizes, "host").select("h", frequent))
    hits = cut(
        asked.select("h", "row", "undecided")
        .join(repeated, "h")
        .where("undecided or frequent")
        .groupBy("row")
        .agg(F.collect_set("h").alias("repeated"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b, "html")):
            streams, kinds = _parsed(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "row")), streams, pa.array(kinds, pa.string())],
                ["page_id", "url", "host", "row", "stream", "kinds"],
            )

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in W.slices(b, "stream")):
            yield _texts(batch, batch.column("stream"), batch.column("kinds").to_pylist(), run)

    # Only pages that may have such runs meet them; the others are read where they lie.
    split = with_probable(pages.drop("page"), filter_of(hits, ["row"]), ["row"], "asked")
    without = split.where("not asked").select("page_id", "url", "html", "host").mapInArrow(W.task(plain), out)
    columns = "page_id long, url string, host long, row long, stream string, kinds string"
    some = split.where("asked").select("page_id", "url", "html", "host", "row").mapInArrow(W.task(read), columns)
    return without.unionByName(some.join(hits, "row", "left").mapInArrow(W.task(unique), out))


def _texts(batch: pa.RecordBatch, streams: pa.Array, kinds: list[str], run: int) -> pa.RecordBatch:
    """Main texts of the pages of a batch, whose column ``repeated``, if any, has their runs of other pages."""
    sets, texts = batch.column("repeated") if "repeated" in batch.schema.names else None, []
    if sets is not None:
        place, own, values, _, offsets = _suffixes(streams, batch.column("host"), run)
        borders = np.searchsorted(own, np.arange(len(batch) + 1))
    for i, stream in enumerate(streams.to_pylist()):
        lines = stream.split("\n") if stream else []
        ends = np.cumsum([0, *(line.count(" ") + 1 for line in lines)])
        covered = np.zeros(ends[-1] + 1, np.int64)
        if sets is not None and sets[i].is_valid:
            part = slice(borders[i], borders[i + 1])
            hit = place[part][np.isin(values[part], np.asarray(sets[i].values, np.int64))] - offsets[i]
            change = np.zeros(ends[-1] + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + run, -1)
            covered[1:] = np.cumsum(np.cumsum(change[:-1]) > 0)
        kept = _unique(kinds[i], np.diff(ends).tolist(), np.diff(covered[ends]).tolist())
        texts.append("\n".join(line.partition(" ")[2] for keep, line in zip(kept, lines) if keep))
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
    )


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
