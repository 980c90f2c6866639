"""Test passages in a corpus: greedy string tiling over the tokens around shared seeds."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arclume.session import spread

# Letters that look like Latin ones, after lower-casing.
LOOKALIKES = str.maketrans("авекмнорстухіѕјԁһӏԛԝαβεικορτυνχοս", "abekmhopctyxisjdhlqwabeikoptyvxou")
#: Characters that a reader doesn't see.
DROPPED = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])
#: Combining marks of the scripts in which they are accents, and the voicing marks of kana.
MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u3099\u309a\ufe20-\ufe2f]")
UNSEEN = re.compile(f"[{''.join(map(chr, DROPPED))}]")
#: Tags of any length: in one line whatever they hold, over several lines with attributes as such; and targets of links. No part runs over the next
#: character that opens one, so a text is passed in linear time.
TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<[A-Za-z][\w:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))?)*\s*/?>|\]\((?:[^()\s]|\([^()\s]*\))+\)")
HYPHEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
WIDE = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002ffff"
TOKEN = re.compile(rf"[{WIDE}]|[^\W_{WIDE}]+")
WIDE_TOKEN, NARROW_TOKEN, ASCII_TOKEN = re.compile(rf"[{WIDE}]"), re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
ALIKE = frozenset(map(chr, LOOKALIKES))

#: Tokens of a seed, and of the shortest tile, in words and in characters of scripts without spaces.
SEED, WIDE_SEED = 4, 3
TILE, WIDE_TILE = 3, 2
#: Opening tokens of an item that alone are too few to count, unless they are all of it.
SHORT, SHORT_WIDE = 6, 8
#: Tokens of the longest stretch without a seed, which may be out of reach of any.
UNSEEDED, WIDE_UNSEEDED = 3, 8
#: Tokens that may lie between two tiles of a stretch.
GAP = 24
#: Sentences that so many items begin with are lead-ins.
LEAD_IN = 4
#: Items and tokens of one block: what a task's index holds.
BLOCK_ITEMS, BLOCK_TOKENS = 20_000, 4_000_000
#: Test items in all: what the driver reads.
MOST_ITEMS = 1_000_000
#: Texts whose seeds are looked up together.
TEXTS = 500


def _uncommented(text: str) -> str:
    """``text`` without its closed comments, of any length."""
    parts, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (close := text.find("-->", begin + 4)) >= 0:
        parts += [text[at:begin], " "]
        at = close + 3
    return "".join([*parts, text[at:]])


def tokens(text: str) -> list[str]:
    """What a reader sees of ``text``: words (characters of Chinese and Japanese) without case, accents, punctuation, markup,
    invisible characters and letters that only look alike."""
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = UNSEEN.sub("", text)
    if "-" in text:
        text = HYPHEN.sub("", text)
    if "<!--" in text:
        text = _uncommented(text)
    if "<" in text or "](" in text:
        text = TAG.sub(" ", text)
    if plain:
        return ASCII_TOKEN.findall(text.lower())
    text = MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
    for c in ALIKE.intersection(text):
        text = text.replace(c, chr(LOOKALIKES[ord(c)]))
    return TOKEN.findall(text) if WIDE_TOKEN.search(text) else NARROW_TOKEN.findall(text)


@dataclass
class Item:
    item: int
    toks: list[str]
    wide: bool
    ids: list[int] = field(default_factory=list)
    pairs: np.ndarray | None = None


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?。！？])\s*", text, maxsplit=1)


def read_items(rows: Sequence[tuple[int, str | None]]) -> list[Item]:
    """The items that have words, without the lead-in that many of them share."""
    heads = Counter(tuple(tokens(_sentences(t)[0])) for _, t in rows if t)
    leads = {h for h, n in heads.items() if h and n >= LEAD_IN}
    out = []
    for item, text in rows:
        if text:
            toks, head = tokens(text), tuple(tokens(_sentences(text)[0]))
            if head in leads:
                toks = toks[len(head) :]
            if toks:
                out.append(Item(item, toks, 2 * sum(bool(WIDE_TOKEN.match(t)) for t in toks) > len(toks)))
    return out


def _least(n: int, wide: bool, share: float) -> tuple[int, int]:
    """Tokens of the shortest tile and of a seed for an item of ``n`` tokens: fewer than usual where ``share`` of it is that short."""
    part = max(1, math.ceil(n * share - 1e-9))
    tile = min(WIDE_TILE if wide else TILE, part)
    return tile, min(WIDE_SEED if wide else SEED, max(tile, (part + 1) // 2))


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` ids; 0 for runs over an id below 0."""
    n = max(0, len(ids) - k + 1)
    out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for i in range(k):
        part = ids[i : i + n]
        known &= part >= 0
        out = (out ^ (part + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.where(known, out | np.uint64(1), np.uint64(0))


class Index:
    """Seeds of a block of items: runs of SEED tokens, as sorted hashes with the item and place each occurs at."""

    def __init__(self, items: list[Item], share: float = 1 / 3) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items = items
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, it in enumerate(items):
            it.ids = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in it.toks]
            _, k = _least(len(it.ids), it.wide, share)
            own = np.array(it.ids, dtype=np.int64)
            by_width.setdefault(k, []).append((n, own))
            it.pairs = own[:-1] << 32 | own[1:]
        self.seeds = []
        for k, members in sorted(by_width.items()):
            hashed = [_hashes(own, k) for _, own in members]
            h = np.concatenate(hashed)
            who = np.repeat([n for n, _ in members], [len(x) for x in hashed])
            order = np.argsort(h, kind="stable")
            self.seeds.append((k, h[order], who[order]))

    def ids(self, toks: list[str]) -> list[int]:
        return list(map(self.vocabulary.get, toks, repeat(-1)))

    def hits(self, docs: list[list[int]]) -> dict[int, dict[int, list[int]]]:
        """Number in ``docs`` -> item number -> places at which both share a seed. All documents' seeds are hashed and looked up together; those
        without a hit don't come out. Equal hashes of different seeds only cost work: what counts is compared by tokens later."""
        sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), -1, dtype=np.int64)
        for at, d in zip(starts.tolist(), docs):
            flat[at : at + len(d)] = d
        out: dict[int, dict[int, list[int]]] = {}
        for k, seeds, who in self.seeds:
            h = _hashes(flat, k)
            low = np.searchsorted(seeds, h, side="left")
            place = np.flatnonzero((h != 0) & (low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == h)) if len(seeds) else np.empty(0, dtype=np.int64)
            high = np.searchsorted(seeds, h[place], side="right")
            doc = np.searchsorted(starts, place, side="right") - 1
            for p, d, a, b in zip((place - starts[doc]).tolist(), doc.tolist(), low[place].tolist(), high.tolist()):
                by_item = out.setdefault(d, {})
                for n in who[a:b].tolist():
                    places = by_item.setdefault(n, [])
                    if not places or places[-1] != p:
                        places.append(p)
        return out


def _shared_pairs(pairs: np.ndarray, item: Item) -> tuple[int, int]:
    """Pairs of neighbouring tokens of the item that are among ``pairs``, and the tokens of the longest run of such."""
    if not len(item.pairs) or not len(pairs):
        return 0, 1
    there = pairs[np.minimum(np.searchsorted(pairs, item.pairs), len(pairs) - 1)] == item.pairs
    ends = np.concatenate([[-1], np.flatnonzero(~there), [len(there)]])
    return len(there) + 2 - len(ends), int((ends[1:] - ends[:-1]).max())


def _least_pairs(n: int, share: float) -> int:
    """Pairs of neighbouring tokens that two stretches keep which carry ``share`` of ``n`` words.

    A stretch of L words has at most L / 7 edits (one in eight of it, added words included), each of which breaks at most three pairs; two
    stretches have two pairs less than words.
    """
    part = max(1, math.ceil(n * share - 1e-9))
    return min(t - 2 - 3 * (t // 7) for t in range(part, part + 7))


#: An odd number and its inverse modulo 2**64: the base of the running hashes.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and UNBASE up to 2**bits - 1."""
    up, down = np.ones(1 << bits, dtype=np.uint64), np.ones(1 << bits, dtype=np.uint64)
    up[1:], down[1:] = BASE, UNBASE
    return np.cumprod(up), np.cumprod(down)


class _Running:
    """Tokens, which of them are marked, and running Karp-Rabin hashes of all windows of any length."""

    def __init__(self, ids: Sequence[int]) -> None:
        self.ids = np.asarray(ids, dtype=np.int64)
        self.marked = self.ids < 0
        self.up, down = _powers(max(1, len(self.ids).bit_length()))
        self.sums = np.zeros(len(self.ids) + 1, dtype=np.uint64)
        np.cumsum((self.ids + 2).astype(np.uint64) * down[: len(self.ids)], out=self.sums[1:])

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of ``s`` tokens without a marked one, and their hashes."""
        n = len(self.ids) - s + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        upto = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(upto[s:] == upto[:n])
        return at, (self.sums[at + s] - self.sums[at]) * self.up[at]


def tiles(doc: Sequence[int], item: Sequence[int], least: int, longest: int = 32) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in doc, place in item, length) of matches of at least ``least`` tokens.

    The search length starts at ``longest``, a bound of the matches' lengths (32 of longer ones), and is halved; at each length the windows of
    unmarked tokens are hashed, matches are extended as far as they go, and the longest are marked first. No token is in two tiles.
    """
    d, t = _Running(doc), _Running(item)
    out = []
    s = min(len(doc), len(item), longest, 32)
    s = least if s < 3 * least else s  # few lengths: one pass finds them all
    while True:
        again = True
        while again:
            again = False
            at, h = d.windows(s)
            places, own = t.windows(s)
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            low, high = np.searchsorted(own, h, side="left"), np.searchsorted(own, h, side="right")
            hits = np.flatnonzero(high > low)
            if not len(hits):
                break
            n = (high - low)[hits]
            a = np.repeat(at[hits], n)
            b = places[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hits], n)]
            # a longer match begins before
            inner = (a > 0) & (b > 0) & ~d.marked[a - 1] & ~t.marked[b - 1] & (d.ids[a - 1] == t.ids[b - 1])
            found = []
            for x, y in zip(a[~inner].tolist(), b[~inner].tolist()):
                m = min(len(d.ids) - x, len(t.ids) - y)
                stop = (d.ids[x : x + m] != t.ids[y : y + m]) | d.marked[x : x + m] | t.marked[y : y + m]
                m = int(stop.argmax()) if stop.any() else m
                if m >= s:
                    found.append((m, x, y))
            found.sort(key=lambda f: (-f[0], f[1], f[2]))
            for m, x, y in found:
                if d.marked[x : x + m].any() or t.marked[y : y + m].any():
                    again = True  # partly taken: what is left may still be long enough
                    continue
                d.marked[x : x + m] = t.marked[y : y + m] = True
                out.append((x, y, m))
        if s <= least:
            return sorted(out)
        s = max(least, s // 2)


def _common(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence of two short runs."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    return row[-1]


#: Tokens of document and item to pass over, by the edits that it costs.
STEPS = [[(n, n), *((n, k) for k in range(n - 1, -1, -1)), *((k, n) for k in range(n - 1, -1, -1))] for n in range(GAP + 1)]


def _run_on(doc: Sequence[int], item: Sequence[int], i: int, j: int, span: int, edits: int, one_in: int) -> tuple[int, int, int, int]:
    """How far a stretch of ``span`` tokens that ends at (i, j) goes on beyond it: (tokens of doc, tokens of item, edits in all, tokens kept). It goes on
    over changed tokens only to tokens that match again, and within one edit of ``one_in``."""
    start_doc, start_item, same = i, j, 0
    n_doc, n_item = len(doc), len(item)
    while True:
        while i < n_doc and j < n_item and doc[i] == item[j]:
            i, j, same = i + 1, j + 1, same + 1
        found = None
        reach = span + max(i - start_doc, j - start_item)
        left_doc, left_item = n_doc - i, n_item - j
        # what is left of the item bounds the edits that can still be afforded
        most = min(GAP, (reach + left_item - edits * one_in) // (one_in - 1))
        for cost in range(1, most + 1):
            for x, y in STEPS[cost]:
                if x >= left_doc or y >= left_item or doc[i + x] != item[j + y]:
                    continue
                n, a, b = 1, i + x + 1, j + y + 1
                while a < n_doc and b < n_item and doc[a] == item[b]:
                    n, a, b = n + 1, a + 1, b + 1
                if (edits + cost) * one_in <= reach + min(x, y) + n and (found is None or n > found[0]):
                    found = (n, x, y, cost)
            if found:
                break
        if found is None:
            return i - start_doc, j - start_item, edits, same
        n, x, y, cost = found
        i, j, edits, same = i + x + n, j + y + n, edits + cost, same + n


def _run_back(doc: Sequence[int], item: Sequence[int], i: int, j: int, span: int, edits: int, one_in: int) -> tuple[int, int, int, int]:
    """``_run_on`` in front of a stretch that begins at (i, j)."""
    reach = 2 * len(item) + GAP
    return _run_on(doc[max(0, i - reach) : i][::-1], item[:j][::-1], 0, 0, span, edits, one_in)


def stretches(doc: Sequence[int], item: Sequence[int], tiled: list[tuple[int, int, int]], one_in: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (doc from, doc to, item from, item to, words kept): chains of tiles in the order of both, in which at most one
    token of ``one_in`` is changed, added or left out; each as it is, and carried on beyond its ends by what still matches."""
    out = []

    def add(a: int, b: int, c: int, d: int, kept: int, edits: int) -> None:
        out.append((a, b, c, d, kept))
        for order in ("on back", "back on"):
            w, x, y, z, spent, same = a, b, c, d, edits, kept
            for way in order.split():
                if way == "on":
                    p, q, spent, n = _run_on(doc, item, x, z, max(x - w, z - y), spent, one_in)
                    x, z = x + p, z + q
                else:
                    p, q, spent, n = _run_back(doc, item, w, y, max(x - w, z - y), spent, one_in)
                    w, y = w - p, y - q
                same += n
            if (w, x) != (a, b):
                out.append((w, x, y, z, same))

    for first in range(len(tiled)):
        a, b, n = tiled[first]
        start_doc, start_item, kept, edits, end_doc, end_item = a, b, n, 0, a + n, b + n
        add(start_doc, end_doc, start_item, end_item, kept, edits)
        at = first
        while True:
            best = None
            for nxt in range(at + 1, len(tiled)):
                x, y, m = tiled[nxt]
                gap_doc, gap_item = x - end_doc, y - end_item
                if gap_doc > GAP:
                    break
                if gap_item < 0 or gap_item > GAP or gap_doc < 0:
                    continue
                same = _common(doc[end_doc:x], item[end_item:y]) if gap_doc and gap_item else 0
                cost = max(gap_doc, gap_item) - same
                if best is None or cost - m / one_in < best[0]:
                    best = (cost - m / one_in, nxt, cost, same)
            if best is None:
                break
            _, nxt, cost, same = best
            x, y, m = tiled[nxt]
            edits += cost
            end_doc, end_item, kept, at = x + m, y + m, kept + same + m, nxt
            if edits * one_in <= max(end_item - start_item, end_doc - start_doc):
                add(start_doc, end_doc, start_item, end_item, kept, edits)
    return out


def coverage(doc: Sequence[int], item: Sequence[int], wide: bool, share: float = 1 / 3, longest: int = 32) -> tuple[float, int]:
    """(share of the item's tokens carried in its order in one or two stretches, tokens of the longer)."""
    tile, _ = _least(len(item), wide, share)
    spans = list(dict.fromkeys(s[:4] for s in stretches(doc, item, tiles(doc, item, tile, longest), 4 if wide else 8)))
    if not spans:
        return 0.0, 0
    longest = max(s[3] - s[2] for s in spans)
    few = min(SHORT_WIDE if wide else SHORT, len(item))
    best = max((s[3] - s[2] for s in spans if s[2] > 0 or s[3] >= few), default=0)
    # the best second stretch after each, in both orders
    spans.sort(key=lambda s: s[1])
    for i, s in enumerate(spans):
        if s[3] - s[2] + longest <= best:
            continue
        for t in spans[i + 1 :]:
            if t[0] >= s[1] and t[2] >= s[3]:
                best = max(best, s[3] - s[2] + t[3] - t[2])
    return best / len(item), longest


def tiled(doc: Sequence[int], item: Sequence[int], wide: bool, share: float = 1 / 3, longest: int = 32) -> float:
    """Share of the item's tokens that its tiles in the document cover, in whatever order they stand."""
    least, _ = _least(len(item), wide, share)
    return sum(n for _, _, n in tiles(doc, item, least, longest)) / len(item)


def leaks_of(ids: list[int], hits: dict[int, list[int]], index: Index, share: float, ordered: bool = True) -> list[tuple[int, float]]:
    """(item id, coverage) of the items that a document of the tokens ``ids`` with these ``hits`` carries to at least ``share``."""
    out = []
    own = np.array(ids, dtype=np.int64)
    pairs = np.sort((own[:-1] << 32 | own[1:])[(own[:-1] >= 0) & (own[1:] >= 0)])
    for n, places in hits.items():
        it = index.items[n]
        shared, longest = _shared_pairs(pairs, it)
        if ordered and not it.wide and shared < _least_pairs(len(it.ids), share):
            continue
        margin = len(it.ids) + len(it.ids) // 4 + 8
        # the parts of the document within reach of a seed; what lies between counts as a break
        window: list[int] = []
        low = high = None
        for p in sorted(places):
            if high is not None and p - margin <= high:
                high = p + margin
            else:
                if high is not None:
                    window += ids[max(0, low) : high]
                    window += [-1] * 32
                low, high = p - margin if high is None else max(p - margin, high), p + margin
        window += ids[max(0, low) : high]
        if not ordered:
            best = tiled(window, it.ids, it.wide, share, longest)
        else:
            best, _ = coverage(window, it.ids, it.wide, share, longest)
            if best < share <= best + (WIDE_UNSEEDED if it.wide else UNSEEDED) / len(it.ids):
                best, _ = coverage(ids, it.ids, it.wide, share, longest)  # what is missing may stand where no seed is
        if best >= share:
            out.append((it.item, best))
    return out


def leaks_in(texts: Sequence[str | None], index: Index, share: float, ordered: bool = True) -> Iterator[tuple[int, int, float]]:
    """(number of the text, item id, coverage)."""
    docs = [index.ids(tokens(t)) if isinstance(t, str) else [] for t in texts]
    for d, hits in sorted(index.hits(docs).items()):
        for item, best in leaks_of(docs[d], hits, index, share, ordered):
            yield d, item, best


def _blocks(items: list[Item], most: int) -> Iterator[list[Item]]:
    part: list[Item] = []
    size = 0
    for it in items:
        if part and (len(part) >= most or size + len(it.toks) > BLOCK_TOKENS):
            yield part
            part, size = [], 0
        part.append(it)
        size += len(it.toks)
    if part:
        yield part


def find_leaks(documents: DataFrame, items: DataFrame, share: float = 1 / 3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", block: int = BLOCK_ITEMS, ordered: bool = True) -> DataFrame:
    """The documents that carry a test item: (doc_id, item_id, coverage).

    An item counts if at least ``share`` of its words (Chinese and Japanese: characters) stand in the document in the item's order,
    in one or two stretches, in which up to one word in eight (one character in four) is changed, added or left out. Case,
    punctuation, markup, layout and invisible or look-alike characters don't matter; the lead-in that many items begin with
    is no part of them. Null and empty texts carry nothing; rows of one id count as one by their best coverage. ``ordered`` False: the coverage
    is that of all tiles in whatever order, which finds passages whose parts were moved about as well.

    The items are the stated query set, MOST_ITEMS at most (more raise ValueError). They are indexed in blocks of ``block`` items and BLOCK_TOKENS
    tokens at most, so that each index has a bounded size, and all documents pass once per block, without a shuffle of texts.
    """
    schema = documents.select(F.col(doc_id).alias("doc_id")).schema.add("item_id", items.schema[item_id].dataType).add("coverage", "double")
    parts = []
    texts = spread(documents.filter(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")))
    rows = items.filter(F.length(item_text) > 0).select(item_id, item_text).distinct().orderBy(item_id, item_text)
    taken = [(r[0], r[1]) for r in rows.limit(MOST_ITEMS + 1).toLocalIterator()]  # the query set, read in order
    if len(taken) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} test items")
    for part in _blocks(read_items(taken), block):
        shared = documents.sparkSession.sparkContext.broadcast([(i.item, i.toks, i.wide) for i in part])

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = Index([Item(*x) for x in shared.value], share)
            for b in batches:
                ids = b["doc_id"]
                for at in range(0, len(b), TEXTS):
                    found = [(ids.iat[at + d], i, c) for d, i, c in leaks_in(b["_text"].iloc[at : at + TEXTS].tolist(), index, share, ordered)]
                    if found:
                        yield pd.DataFrame(found, columns=["doc_id", "item_id", "coverage"])

        parts.append(texts.mapInPandas(search, schema))
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))
