"""Main text of web pages: a host's repeated runs choose it, the page's structure checks it.

A page becomes blocks of text, each with what its containers say: of an article (or
of the main part, where there is no article), unwanted (menus, headers, footers,
sidebars, notices, adverts, forms and comments), or open.

The words of all blocks are a page's stream.  The distinct streams of a host are
concatenated and sorted into a suffix array to the depth of ``RUN`` words; neighbours
that agree so far and come from distinct streams are a repeated run.  So copies of a
page count once and do not cover each other; a passage that pages of different
streams share is covered, on all of them.  ``repeated_words`` counts a page's covered
words; the others are its own.

The page's own stretch of wanted blocks (own words less covered ones, at their most)
says where the main text is, and structure how far it goes:

* Articles are taken whole, with passages that other pages share, and what stands
  outside goes.  Of several, one goes if it lies outside the stretch, runs cover at
  least half of it, and less than half of the longest: a teaser, say.
* If the stretch meets no article and has more own words than the longest article has
  words, that is no article of this page: its blocks are open, as are the others.
* Words of open blocks that runs cover are boilerplate and go.
* If nothing is repeated, or nothing is a page's own, runs say nothing: all articles
  stay.

A large host is cut into slices of bounded text.  Each slice sorts its own suffixes;
windows of ``RUN`` words meet those of other slices by their hash, in ranges of hashes
as many as slices: first by ``SHORT`` bits, and by all 64 where those are shared.
Pages travel once, packed, and a task sends a page that it remembers without its
blocks.

Defined results: a null html is empty; a page without text has text '' and
n_chars 0; a null url is the empty host; rows of one page_id are pages of their own;
pages of a host with equal streams get the same runs and count as one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import in_slices

#: Words of the shortest repeated run, a power of two, characters of html of a slice, and pages a task remembers.
RUN, SLICE_CHARS, SEEN = 8, 8_000_000, 100_000
#: Bits of a window's hash that every window of a large host sends.
SHORT = 40
#: What structure says of blocks that are of no article or main part.
OPEN, UNWANTED = -1, -2

#: Elements by what they do to text, and names of containers that hold no article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
DROPPED = frozenset("nav footer aside form head button select textarea dialog menu noscript template svg iframe object canvas".split())
TRACKED = frozenset("article main header section div ul ol table body html p span fieldset figure details blockquote li dl".split()) | DROPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg")
NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer
gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies share sharing sidebar social sponsor sponsored subscribe
toolbar widget widgets""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[^A-Za-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    """This container holds no article text."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if name in ("html", "body", "article", "main") or "=" not in attributes:
        marked = ()
    else:
        marked = _NAMED.findall(attributes)
    for key, value in marked:
        words = {w.lower() for w in _PARTS.split(value) if w}
        if words & (ROLES if key.lower() == "role" else NAMES) or key.lower() != "role" and not in_article and "header" in words:
            return True
    if name == "article" and "=" in attributes:  # a comment may be an article of its own
        return any({"comment", "comments", "reply", "ad"} & {w.lower() for w in _PARTS.split(v)} for _, v in _NAMED.findall(attributes))
    return False


def blocks(page: str) -> tuple[list[tuple[str, int, bool, str]], set[str]]:
    """(where, part, unwanted, text) of the page's blocks in order, and which wanted parts there are; where is 'article', 'main' or '', part numbers them."""
    parts: set[str] = set()
    out: list[tuple[str, int, bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str, int, bool]] = []
    where, part, unwanted, last = "", 0, False, 0

    def end() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            out.append((where, part, unwanted, words))
        text.clear()

    at, size = 0, len(page)
    while at < size:
        m = _PIECE.search(page, at)
        if not m:
            text.append(page[at:])
            break
        text.append(page[at:m.start()])
        at = m.end()
        if not m.group(2):
            continue
        closing, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name in BLOCKS:
            end()
        elif name == "br":
            text.append(" ")
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if name in TRACKED else None
            if depth is not None:
                if unwanted or stack[depth][3]:
                    end()
                del stack[depth:]
                where, part, unwanted = stack[-1][1:] if stack else ("", 0, False)
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            at = close.end() if close else size
            continue
        if name in TRACKED and name not in VOID and not attributes.endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before
                stack.pop()
                where, part, unwanted = stack[-1][1:] if stack else ("", 0, False)
            drop = unwanted or _unwanted(name, attributes, where != "")
            if drop != unwanted:
                end()
            if name == "article" and where != "article" or name == "main" and where == "":
                last += 1
                where, part = name, last
            unwanted = drop
            stack.append((name, where, part, unwanted))
            if not unwanted:
                parts.add(where)
    end()
    return out, parts


def split(page: str) -> tuple[str | None, list[tuple[int, str]], list[tuple[int, str]]]:
    """'' if no block is wanted; else the blocks that are main text unless runs say otherwise, each with its place in the stream; and all blocks by their part."""
    found, inside = blocks(page)
    main = "article" if "article" in inside else "main" if "main" in inside else None
    empty = main and not any(where == main and not unwanted for where, _, unwanted, _ in found)
    coded = [(UNWANTED if unwanted or empty else part if main and where == main else OPEN, text) for where, part, unwanted, text in found]
    open_ = _open(coded, {c for c, _ in coded if c >= 0} or {OPEN})
    return None if open_ else "", open_, coded


def _open(found: list[tuple[int, str]], parts: set[int]) -> list[tuple[int, str]]:
    """(place in the stream, text) of the blocks of these parts."""
    out, at = [], 0
    for part, text in found:
        if part in parts:
            out.append((at, text))
        at += text.count(" ") + 1
    return out


def stretch(weights: list[int]) -> range:
    """The places whose weights have the greatest sum, the first and longest such; empty if none is above zero."""
    best, found, total, start = 0, range(0), 0, 0
    for i, w in enumerate(weights):
        total += w
        if total > best or total == best > 0 and start == found.start:
            best, found = total, range(start, i + 1)
        if total < 0:
            total, start = 0, i + 1
    return found


def chosen(found: list[tuple[int, str]], gone: np.ndarray) -> str:
    """The main text among the blocks of a page, given which words of its stream repeated runs cover."""
    named = {part for part, _ in found if part >= 0}
    if not gone.any():
        return "\n".join(t for _, t in _open(found, named or {OPEN}))
    covered = np.r_[0, np.cumsum(gone)].tolist()
    wanted, at = [], 0  # (part, words, own words less covered ones)
    for part, text in found:
        n = text.count(" ") + 1
        if part != UNWANTED:
            wanted.append((part, n, n - 2 * (covered[at + n] - covered[at])))
        at += n
    own = stretch([w for _, _, w in wanted])
    if named and own:
        words, balance = dict.fromkeys(sorted(named), 0), dict.fromkeys(named, 0)
        for part, n, w in wanted:
            if part >= 0:
                words[part] += n
                balance[part] += w
        longest = max(words, key=words.get)
        inside = {wanted[i][0] for i in own}
        if inside & named or sum(wanted[i][1] + wanted[i][2] for i in own) // 2 <= words[longest]:
            if balance[longest] > 0:  # else the page is a version of another, and runs can't tell its articles from teasers
                named = {part for part in named if part in inside or balance[part] > 0}
        else:
            named, found = set(), [(min(part, OPEN), text) for part, text in found]
    if named:
        return "\n".join(t for _, t in _open(found, named))
    return unique([{"at": a, "text": t} for a, t in _open(found, {OPEN})], set(np.flatnonzero(gone).tolist()))


def suffix_classes(tokens: np.ndarray) -> np.ndarray:
    """The rank of each position among all by the next ``RUN`` tokens: equal ranks, equal windows.

    Prefix doubling: ranks of k tokens and of the k tokens behind them order 2k.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(tokens)
    while k < RUN:
        behind = np.zeros(n, np.int64)
        behind[:n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def repeated(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, class, seen on another page) of every whole window of the streams."""
    sizes = np.array([len(s) for s in streams], np.int64)
    page = np.repeat(np.arange(len(streams)), sizes + 1)
    place = np.arange(len(page)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    # a mark of its own ends each stream, so that no window runs into the next
    tokens = np.concatenate([np.r_[s, -1 - i] for i, s in enumerate(streams)]) if streams else np.zeros(0, np.int64)
    whole = place + RUN <= sizes[page]
    rank = suffix_classes(tokens)[whole]
    page, place = page[whole], place[whole]
    array = np.argsort(rank, kind="stable")  # the suffix array, to the depth of a run
    first = np.flatnonzero(np.r_[True, np.diff(rank[array]) != 0]) if len(array) else np.zeros(0, np.int64)
    seen = np.zeros(len(rank), bool)
    if len(array):
        low, high = np.minimum.reduceat(page[array], first), np.maximum.reduceat(page[array], first)
        seen[array] = np.repeat(low != high, np.diff(np.r_[first, len(array)]))
    return page, place, rank, seen


def _windows(tokens: np.ndarray) -> np.ndarray:
    """A hash of the ``RUN`` tokens from each place on that has as many."""
    out = np.zeros(max(0, len(tokens) - RUN + 1), np.uint64)
    for k in range(RUN):
        out = (out ^ tokens[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host")


def parsed(pages: DataFrame) -> DataFrame:
    """host, the stream's digest, the digest of the blocks, the rows that have them, and the packed blocks unless the task has just given them."""
    rows = pages.select("page_id", "url", _host(), "html")
    id_type = dict(pages.dtypes)["page_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in in_slices(batches):
            places: dict[tuple, list[int]] = {}
            bodies = {}
            for i, (host, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                found = split(page or "")[2]
                body = "\n".join(f"{part}\t{text}" for part, text in found).encode()
                key = xxhash.xxh3_128_digest(" ".join(text for _, text in found).encode())
                one = host, key, xxhash.xxh3_128_digest(body)
                places.setdefault(one, []).append(i)
                if one not in seen:
                    seen.add(one)
                    bodies[one] = zlib.compress(body, 1)
            ids = batch.select([0, 1]).take(pa.array([i for at in places.values() for i in at], pa.int64()))
            ends = np.cumsum([0, *map(len, places.values())]).astype(np.int32)
            arrays = [pa.array(c, t) for c, t in zip(zip(*places), (pa.string(), pa.binary(), pa.binary()))]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), ids.to_struct_array()))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(map(bodies.get, places), pa.binary())], names=["host", "key", "form", "ids", "body"])
            if len(seen) > SEEN:
                seen.clear()

    return rows.mapInArrow(run, f"host string, key binary, form binary, ids array<struct<page_id: {id_type}, url: string>>, body binary")


def _found(body: bytes) -> list[tuple[int, str]]:
    lines = (line.split("\t", 1) for line in zlib.decompress(body).decode().split("\n") if line)
    return [(int(part), text) for part, text in lines]


def _slice(table: pa.Table) -> tuple[dict[bytes, list], list[bytes], list[np.ndarray], np.ndarray]:
    """Blocks of each form, the distinct streams' digests in order, their words as numbers, and a hash of each number's word."""
    forms, streams = {}, {}
    for key, form, body in zip(*(table[c].to_pylist() for c in ("key", "form", "body"))):
        if body is not None and form not in forms:
            forms[form] = _found(body)
            streams[key] = form
    keys = sorted(streams)
    texts = [" ".join(text for _, text in forms[streams[key]]) for key in keys]
    words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = words.values.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    numbers = coded.indices.to_numpy().astype(np.int64)
    # the empty text of an empty page is split into one word
    parts = [s if t else s[:0] for s, t in zip(np.split(numbers, words.offsets.to_numpy()[1:-1]), texts)] if keys else []
    return forms, keys, parts, hashes


def _packed(grams: np.ndarray) -> bytes:
    """Sorted hashes as their differences, first all highest bytes."""
    return zlib.compress(np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, ::-1].T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T[:, ::-1]).view(np.uint64).ravel(), dtype=np.uint64)


_RUNS = pa.schema([("host", pa.string()), ("range", pa.int64()), ("slice", pa.int64()), ("key", pa.binary()), ("starts", pa.list_(pa.int32())), ("grams", pa.binary())])
_MARKS = pa.schema([("host", pa.string()), ("slice", pa.int64()), ("key", pa.binary()), ("starts", pa.list_(pa.int32())), ("grams", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _ranges(host: str, part: int, slices: int, grams: np.ndarray, bits: int) -> list[tuple]:
    """Rows with a slice's sorted hashes, by as many ranges as slices."""
    width = (1 << bits) // slices + 1
    cuts = np.searchsorted(grams, np.array([i * width for i in range(1, slices)], np.uint64))
    return [(host, i, part, None, None, _packed(g)) for i, g in enumerate(np.split(grams, cuts)) if len(g)]


def slice_runs(table: pa.Table) -> pa.Table:
    """The runs of a slice's distinct streams; where a host has more slices, also the short hashes of its windows for the others."""
    host, part, slices = (table[c][0].as_py() for c in ("host", "slice", "slices"))
    _, keys, streams, hashes = _slice(table)
    page, at, _, seen = repeated(streams)
    out = [(host, -1 - part, part, keys[i], starts.tolist(), None) for i, starts in zip(*_by_page(page[seen], at[seen]))]
    if slices > 1:
        grams = np.unique(np.concatenate([_windows(hashes[s]) for s in streams]) >> np.uint64(64 - SHORT))
        out += _ranges(host, part, slices, grams, SHORT)
    return _table(out, _RUNS)


def shared_windows(table: pa.Table) -> pa.Table:
    """For each slice its hashes of this range that another slice has, too; runs inside a slice go through."""
    if table["range"][0].as_py() < 0:
        return table.select(_MARKS.names)
    host, slices = table["host"][0].as_py(), table["slice"].to_pylist()
    sets = [_unpacked(g) for g in table["grams"].to_pylist()]
    grams = np.sort(np.concatenate(sets))
    shared = np.unique(grams[1:][grams[1:] == grams[:-1]])
    both = [np.intersect1d(s, shared, assume_unique=True) for s in sets]
    return _table([(host, i, None, None, _packed(g)) for i, g in zip(slices, both) if len(g)], _MARKS)


def _shared(marks: pa.Table) -> np.ndarray:
    """The sorted hashes that a slice shares with others."""
    sets = [_unpacked(g) for g in marks["grams"].to_pylist() if g is not None]
    return np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)


def _among(grams: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which of the hashes are shared."""
    return shared[np.minimum(np.searchsorted(shared, grams), len(shared) - 1)] == grams


def slice_windows(table: pa.Table, marks: pa.Table) -> pa.Table:
    """The whole hashes of windows whose short ones are shared; runs inside a slice go through."""
    local = [(r["host"], -1 - r["slice"], r["slice"], r["key"], r["starts"], None) for r in marks.filter(pc.is_valid(marks["key"])).to_pylist()]
    shared = _shared(marks)
    if not len(shared):
        return _table(local, _RUNS)
    host, part, slices = (table[c][0].as_py() for c in ("host", "slice", "slices"))
    _, _, streams, hashes = _slice(table)
    grams = np.concatenate([_windows(hashes[s]) for s in streams])
    grams = np.unique(grams[_among(grams >> np.uint64(64 - SHORT), shared)])
    return _table(local + _ranges(host, part, slices, grams, 64), _RUNS)


def slice_texts(table: pa.Table, marks: pa.Table) -> pa.Table:
    """ids, text, n_chars and repeated_words of each form of a slice's pages."""
    forms, keys, streams, hashes = _slice(table)
    gone = {key: np.zeros(len(s), bool) for key, s in zip(keys, streams)}
    for key, starts in zip(marks["key"].to_pylist(), marks["starts"].to_pylist()):
        if key is not None:
            for k in range(RUN):
                gone[key][np.array(starts) + k] = True
    shared = _shared(marks)
    if len(shared):
        for key, s in zip(keys, streams):
            starts = np.flatnonzero(_among(_windows(hashes[s]), shared))
            for k in range(RUN):
                gone[key][starts + k] = True
    places: dict[tuple, list[int]] = {}
    for i, one in enumerate(zip(table["form"].to_pylist(), table["key"].to_pylist())):
        places.setdefault(one, []).append(i)
    ids = table["ids"].take(pa.array([i for at in places.values() for i in at], pa.int64())).combine_chunks()
    sizes = ids.value_lengths().to_numpy()
    ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum([len(at) for at in places.values()])].astype(np.int64)].astype(np.int32)
    texts = [chosen(forms[form], gone[key]) for form, key in places]
    return pa.table([pa.ListArray.from_arrays(pa.array(ends), ids.flatten()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()),
                     pa.array([int(gone[key].sum()) for _, key in places], pa.int64())], names=["ids", "text", "n_chars", "repeated_words"])


def _by_page(page: np.ndarray, place: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(page, kind="stable")
    which, first = np.unique(page[order], return_index=True)
    return which.tolist(), np.split(place[order], first[1:]) if len(which) else []


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and repeated_words of every row."""
    slices = F.greatest(F.lit(1), F.ceil(F.sum(F.length("html")) / SLICE_CHARS)).alias("slices")
    large = pages.select(_host(), F.coalesce("html", F.lit("")).alias("html")).groupBy("host").agg(slices).filter("slices > 1")
    rows = parsed(pages).join(F.broadcast(large), "host", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("key"), "slices"))
    found = "slice long, key binary, starts array<int>, grams binary"
    runs, marks = f"host string, range long, {found}", f"host string, {found}"
    short = rows.groupBy("host", "slice").applyInArrow(slice_runs, runs).groupBy("host", "range").applyInArrow(shared_windows, marks)
    whole = rows.groupBy("host", "slice").cogroup(short.groupBy("host", "slice")).applyInArrow(slice_windows, runs)
    seen = whole.groupBy("host", "range").applyInArrow(shared_windows, marks)
    ids = dict(rows.dtypes)["ids"]
    texts = rows.groupBy("host", "slice").cogroup(seen.groupBy("host", "slice")).applyInArrow(
        slice_texts, f"ids {ids}, text string, n_chars long, repeated_words long")
    return texts.select(F.explode("ids").alias("_id"), "text", "n_chars", "repeated_words").select("_id.page_id", "_id.url", "text", "n_chars", "repeated_words")


def unique(open_: list[dict], gone: set[int]) -> str:
    """The open blocks without the words at the places that are gone."""
    kept = (" ".join(w for i, w in enumerate(b["text"].split(" "), b["at"]) if i not in gone) for b in open_)
    return "\n".join(t for t in kept if t)
