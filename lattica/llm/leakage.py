"""Evaluation texts leaking into training text (problem 8).

A positional inverted index over the corpus, distributed by document: every segment (a row of a written
table) holds the postings of all words of some hundred documents, term by term, under a hash of the term.
It is made once and serves any set of passages.

A search takes the pairs of neighbouring words of every passage.  A first pass over the index counts how
often each stands in the corpus; of a passage, so many of the commonest are left aside that a document
that repeats half of the passage must hold at least one of the others (:func:`least_paired`).  Postings of
these rarest pairs, looked up by pair, give the documents in question; there the postings of all pairs of
the passage are intersected, shifted by their places, and documents with too few of them for two stretches
cannot pass.  All others are aligned word by word as a whole, which gives exact and near matches.  No step
drops a document that the alignment would accept.

Only the passages go to the driver and back to all tasks; they are bounded by the test set, which is
checked.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import written

#: A test set beyond this many words is refused: it is sent to every task.
MOST_TEST_WORDS = 20_000_000
SEGMENT_WORDS = 1_000_000
#: Words that may be lost, changed or added between two runs of one stretch.
GAP = 6

# fixed values: letters of other scripts that look like Latin ones, and their Latin forms
_ALIKE = str.maketrans("аеорсухіјѕһԁкмтвнзАЕОРСУХІЈЅКМТВНαορντικ", "aeopcyxijshdkmtbh3aeopcyxijskmtbhaopvtik")
_DROP = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E])
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|sub|sup|mark|small|code|font)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|([nrt"/\\]))')
_CLOCK = re.compile(r"^\[\d+:\d+(?::\d+)?\] ", re.M)
_JOIN = re.compile(r"(?<=[^\W_])[-‐‑–'’.,*_]+\n?(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text whatever its letter case, punctuation, layout, markup or character forms.
    Points, commas, hyphens and apostrophes inside a word or number do not part it."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROP).translate(_ALIKE)
    if "[" in text:
        text = _CLOCK.sub("", text)
    return _WORD.findall(_JOIN.sub("", text).lower())


def term_hash(word: str) -> int:
    """The number of a term in every index and search: 64 bits, signed."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Index segments: ids and first word places of the documents; the terms' hashes in order, how many postings
    each has, and the places of the postings, term by term, as the four byte planes of their differences
    (which compress).  A document stays in one segment, however long it is."""

    def close(ids: list[int], starts: list[int], codes: list[np.ndarray], local: dict[str, int]) -> pa.RecordBatch:
        seq = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        terms = np.fromiter(map(term_hash, local), np.int64, len(local))
        rank = np.empty(len(terms), np.int32)
        rank[np.argsort(terms, kind="stable")] = np.arange(len(terms), dtype=np.int32)
        seq = rank[seq]
        place = np.argsort(seq, kind="stable").astype(np.uint32)
        planes = np.diff(place, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [one(ids, pa.int64()), one([*starts, len(seq)], pa.int32()), one(np.sort(terms), pa.int64()), one(np.bincount(seq, minlength=len(terms)), pa.int32()), pa.array([planes], pa.binary())],
            names=["docs", "starts", "terms", "counts", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, codes, local, n = [], [], [], {}, 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                ids.append(i)
                starts.append(n)
                codes.append(np.array([local.setdefault(w, len(local)) for w in words], np.int32))
                n += len(words)
                if n >= SEGMENT_WORDS:
                    yield close(ids, starts, codes, local)
                    ids, starts, codes, local, n = [], [], [], {}, 0
        if ids:
            yield close(ids, starts, codes, local)

    schema = "docs array<bigint>, starts array<int>, terms array<bigint>, counts array<int>, places binary"
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(run, schema)


# ------------------------------------------------------------------------------------------ alignment


def _pair_keys(words: np.ndarray, terms: int) -> np.ndarray:
    """One number for every two neighbouring words; -1 where one of them is unknown."""
    a, b = words[:-1].astype(np.int64), words[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), a * terms + b, -1)


def _meetings(wanted: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``wanted``, place) wherever a wanted key stands among the sorted keys ``key``."""
    lo, hi = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(np.arange(len(wanted)), n), place[at]


def _runs(i: np.ndarray, j: np.ndarray, width: int = 2) -> np.ndarray:
    """Rows (place in p, place in d, length) of every maximal run of equal words, in order, from the places of all
    equal pairs of neighbouring words (``width`` 2) or of all equal words (1)."""
    if not len(i):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    runs = np.column_stack([i[first], j[first], np.diff(np.r_[first, len(i)]) + width - 1])
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _in_order(a: np.ndarray, b: np.ndarray) -> int:
    """The most words that two short sequences have in common in order."""
    best = [0] * (len(b) + 1)
    for x in a.tolist():
        left = 0  # the value above and to the left
        for k, y in enumerate(b.tolist(), 1):
            here = best[k]
            best[k] = left + 1 if x == y and x >= 0 else max(here, best[k - 1])
            left = here
    return best[-1]


def aligned(runs: np.ndarray, p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows (covered, equal): words of passage ``p`` that ``d`` repeats in order in at most two stretches, and of
    them the equal ones, for the ways to end in each run with most equal words and with most equal words
    against those covered.  Inside a stretch up to GAP words may be lost, changed or added between two
    runs; of those, equal words in order count as equal as far as others are lost beside them."""
    ri, rj, rn = runs.T
    ei, ej = ri + rn, rj + rn
    earlier = np.searchsorted(ri, ri, "left").tolist()
    count = len(runs)
    # [stretches - 1][most equal, best ratio]; -1: none
    cover, same = np.zeros((2, 2, count), np.int64), np.full((2, 2, count), -1, np.int64)
    for r, (i, j, n) in enumerate(runs.tolist()):
        cut = np.maximum(ei[: earlier[r]] - i, ej[: earlier[r]] - j)
        before = np.flatnonzero((cut < n) & (rj[: earlier[r]] < j))
        one, two = [(n, n)], []
        if len(before):
            cut = cut[before]
            more = n - np.maximum(cut, 0)
            for k in np.flatnonzero(cut >= -GAP).tolist():  # else too far for one stretch
                q, m = int(before[k]), int(more[k])
                a, z = int(ei[q]), int(ej[q])
                lost, added = i + n - m - a, j + n - m - z
                if lost > GAP or added > GAP:
                    continue
                inner = _in_order(p[a : a + lost], d[z : z + added]) if lost and added else 0
                credit = min(inner, lost - inner)
                for used, options in ((0, one), (1, two)):
                    for way in (0, 1):
                        had = int(same[used, way, q])
                        if had >= 0:
                            options.append((int(cover[used, way, q]) + lost + m, had + credit + m))
            for way in (0, 1):  # a second stretch
                value, width = same[0, way, before] + more, cover[0, way, before] + more
                for k in {int(value.argmax()), int((8 * value - 7 * width).argmax())}:
                    two.append((int(width[k]), int(value[k])))
        for used, options in ((0, one), (1, two)):
            if options:
                cover[used, 0, r], same[used, 0, r] = max(options, key=lambda v: (v[1], -v[0]))
                cover[used, 1, r], same[used, 1, r] = max(options, key=lambda v: (8 * v[1] - 7 * v[0], v[1]))
    got = np.column_stack([cover.ravel(), same.ravel()])
    return got[got[:, 1] >= 0]


def repeated(p: np.ndarray, d: np.ndarray) -> tuple[int, int]:
    """(covered, equal) of the alignment of ``p`` and ``d`` with most equal words."""
    terms = int(max(p.max(initial=0), d.max(initial=0))) + 1
    key = _pair_keys(d, terms)
    order = np.argsort(key, kind="stable")
    wanted = np.where(_pair_keys(p, terms) < 0, -2, _pair_keys(p, terms))
    states = aligned(_runs(*_meetings(wanted, key[order], order)), p, d)
    return max(map(tuple, states.tolist()), key=lambda v: v[1], default=(0, 0))


def slack(n: int) -> float:
    """Words more than one in eight that may be lost in a passage of ``n``: shares of stretches are no whole words."""
    return min(2.0, n / 16)


def least_words(n: int) -> float:
    """The fewest words of a passage of ``n`` that a document that leaks it holds in order: half of it, where one in
    eight of these is lost or changed; and two less, single words between such a word and the end of a stretch."""
    return max(1.0, 7 * n / 16 - min(2.0, n / 24))


def leaks(cover, same, n: int):
    """At least half of the passage, with at most one word in eight of what is covered not equal."""
    return (same >= least_words(n)) & (8 * (cover - same) <= cover + 8 * slack(n))


def least_paired(n: int) -> float:
    """The fewest words of a passage of ``n`` that stand in runs of two or more in a document that leaks it.  Of m
    equal words at most m / 7 and 8/7 of the slack are lost between them, and no more stand by themselves
    than are lost beside them."""
    return 6 / 7 * least_words(n) - 8 / 7 * slack(n)


#: Passages below this length have too few pairs to tell and are looked up by their words.
PAIRED_FROM = next(n for n in range(1, 100) if least_paired(n) > 2)


# ------------------------------------------------------------------------------------------ search


@dataclass
class Passages:
    """The passages of a search over one vocabulary: ``words`` (codes, end to end), ``first`` word of each,
    ``hashes`` of the vocabulary in order, ``keys`` of all their pairs (words, for the shortest) in order."""

    items: np.ndarray
    words: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    keys: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.items, self.words, self.first, self.hashes, self.keys

    @property
    def terms(self) -> int:
        return len(self.hashes)

    def of(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(passage, key) of every place that can be looked up."""
        size = np.diff(self.first)
        owner = np.repeat(np.arange(len(size)), size)
        short = size[owner] < PAIRED_FROM
        inner = np.r_[owner[1:] == owner[:-1], False] & ~short if len(owner) else short
        pair = np.r_[_pair_keys(self.words, self.terms), -1] if len(owner) else np.zeros(0, np.int64)
        single = self.terms * self.terms + self.words.astype(np.int64)
        return np.r_[owner[inner], owner[short]], np.r_[pair[inner], single[short]]


def passages_of(lists: list[tuple[int, list[str]]]) -> Passages:
    """``lists``: (item, words); items without words are left out."""
    lists = [x for x in lists if x[1]]
    vocabulary = {w: term_hash(w) for _, ws in lists for w in ws}
    hashes = np.unique(np.fromiter(vocabulary.values(), np.int64, len(vocabulary)))
    words = np.searchsorted(hashes, np.fromiter((vocabulary[w] for _, ws in lists for w in ws), np.int64)).astype(np.int32)
    first = np.r_[0, np.cumsum([len(ws) for _, ws in lists])].astype(np.int64)
    made = Passages(np.array([i for i, _ in lists], np.int64), words, first, hashes, np.zeros(0, np.int64))
    made.keys = np.unique(made.places()[1])
    return made


class _Segment:
    """A segment as a search sees it: its documents, the code of every word in the search's vocabulary (-1 for
    others), and the known keys in order with their places."""

    def __init__(self, columns: dict[str, pa.Array], row: int, wanted: Passages):
        get = lambda name: columns[name][row].values.to_numpy()
        self.docs, self.starts, terms, counts = (get(x) for x in ("docs", "starts", "terms", "counts"))
        place = np.frombuffer(columns["places"][row].as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().cumsum(dtype=np.uint32)
        code = np.full(len(terms), -1, np.int32)
        if len(terms):
            at = np.minimum(np.searchsorted(terms, wanted.hashes), len(terms) - 1)
            known = np.flatnonzero(terms[at] == wanted.hashes)
            code[at[known]] = known
        self.seq = np.full(self.starts[-1], -1, np.int32)
        self.seq[place] = np.repeat(code, counts)
        self.owner = np.repeat(np.arange(len(self.docs)), np.diff(self.starts))
        if len(self.seq):
            key = _pair_keys(self.seq, wanted.terms)
            key = np.where(self.owner[:-1] == self.owner[1:], key, -1)
            pairs, words = np.flatnonzero(key >= 0), np.flatnonzero(self.seq >= 0)
            key = np.r_[key[pairs], wanted.terms * wanted.terms + self.seq[words].astype(np.int64)]
            self.place = np.r_[pairs, words]
        else:
            key, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(wanted.keys, key), len(wanted.keys) - 1)
        mine = np.flatnonzero(wanted.keys[at] == key) if len(wanted.keys) else np.zeros(0, np.int64)
        self.number, self.place = at[mine], self.place[mine]  # of the key among the wanted ones
        order = np.argsort(self.number, kind="stable")
        self.number, self.place = self.number[order], self.place[order]


def _segments(batches: Iterator[pa.RecordBatch], wanted: Passages) -> Iterator[_Segment]:
    for b in batches:
        columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for row in range(b.num_rows):
            yield _Segment(columns, row, wanted)


def key_counts(index: DataFrame, shared) -> np.ndarray:
    """How often each of the passages' keys stands in the corpus; at most one row per word of the test set
    comes to the driver.  ``shared``: the broadcast parts of the passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Passages(*shared.value)
        total = np.zeros(len(wanted.keys), np.int64)
        for s in _segments(batches, wanted):
            total += np.bincount(s.number, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])

    counts = np.zeros(len(shared.value[-1]), np.int64)
    for r in index.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[r[0]] = r[1]
    return counts


def rarest(wanted: Passages, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, passage), under which passages each key is to be looked up, and (own, key), the keys of each passage
    to be looked up.  Of a passage that many of its commonest keys are left aside as do not make up
    :func:`least_paired` words, two words a pair."""
    owner, key = wanted.places()
    number = np.searchsorted(wanted.keys, key)
    order = np.lexsort((-counts[number], owner))
    owner, number = owner[order], number[order]
    size = np.bincount(owner, minlength=len(wanted.items))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    length = np.diff(wanted.first)
    aside = np.array([np.ceil(least_paired(n) / 2) - 1 if n >= PAIRED_FROM else np.ceil(least_words(n)) - 1 for n in length], np.int64)
    keep = rank >= aside[owner]
    several = max(1, len(wanted.items))
    by_key = np.unique(number[keep] * several + owner[keep])
    by_passage = np.unique(owner[keep] * (len(wanted.keys) + 1) + number[keep])
    own = np.searchsorted(by_passage, np.arange(len(wanted.items) + 1) * (len(wanted.keys) + 1))
    return np.searchsorted(by_key, np.arange(len(wanted.keys) + 1) * several), by_key % several, own, by_passage % (len(wanted.keys) + 1)


def _enough(i: np.ndarray, doc: np.ndarray, n: int, least: float, pair: bool) -> np.ndarray:
    """The documents in which at least ``least`` places of the passage stand in an equal pair (or word)."""
    if not len(doc):
        return doc
    low = doc.min()
    cells = np.zeros((doc.max() - low + 1) * n + 1, bool)
    at = (doc - low) * n + i
    cells[at] = True
    if pair:
        cells[at + 1] = True
    return low + np.flatnonzero(np.count_nonzero(cells[:-1].reshape(-1, n), axis=1) >= least)


def _ending(score: np.ndarray) -> np.ndarray:
    """Per row the largest sum of neighbouring scores that ends in each place."""
    sums = np.cumsum(score, axis=1, dtype=np.int32)
    before = np.minimum.accumulate(np.roll(sums, 1, axis=1) * (np.arange(score.shape[1]) > 0), axis=1)
    return sums - np.minimum(before, 0)


def _two_stretches(i: np.ndarray, j: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which pairs, given in the order of ``j``, may belong to two stretches of a document that together pass.  A
    stretch has at most GAP words between two runs, so it never goes on beyond more than that without a pair.
    Two stretches that pass have P >= L = :func:`least_paired` paired words and at most U <= P / 3 + 8/3 slack
    others, so for every x >= 0 they reach (1 + x) P - 3 x U >= L - 8 x slack; the most that any part of the
    passage reaches with the pairs of a stretch bounds that from above."""
    if not len(i):
        return np.zeros(0, bool)
    fresh = np.r_[True, (np.diff(j) > GAP + 2) | (np.diff(doc) != 0)]
    at, owner = np.cumsum(fresh) - 1, doc[fresh]
    paired = np.zeros((len(owner), n), bool)  # documents in question only
    paired[at, i] = paired[at, i + 1] = True
    alive = np.arange(len(owner))
    for x in (0.0, 0.25, 1.0):
        score = np.where(paired[alive], np.int32(4 + 4 * x), np.int32(-12 * x))
        if x:
            upto = np.maximum.accumulate(_ending(score), axis=1)
            after = np.maximum.accumulate(_ending(score[:, ::-1]), axis=1)[:, ::-1]
            best, twice = upto[:, -1], (upto[:, :-1] + after[:, 1:]).max(axis=1)  # both with the same pairs around them
        else:
            best = twice = score.sum(axis=1)
        mine = owner[alive]
        order = np.lexsort((-best, mine))
        first = np.flatnonzero(np.r_[True, np.diff(mine[order]) != 0])
        size = np.diff(np.r_[first, len(order)])
        second = np.where(size > 1, best[order[np.minimum(first + 1, len(order) - 1)]], 0)
        other = np.repeat(best[order[first]], size)
        other[first] = second
        least = 4 * (least_paired(n) - 8 * x * slack(n))
        alive = alive[np.sort(order[(best[order] + other >= least) | (twice[order] >= least)])]
        if not len(alive):
            break
    held = np.zeros(len(owner), bool)
    held[alive] = True
    return held[at]


def _leaks_in(s: _Segment, wanted: Passages, first: np.ndarray, under: np.ndarray, own: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, words, covered, equal) of the leaks of a segment."""
    here, at = np.unique(s.number, return_index=True)
    to = np.r_[at[1:], len(s.number)]
    many = first[here + 1] - first[here]
    places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[here], many)
    for k in np.unique(under[places]).tolist():
        passage = wanted.of(k)
        n = len(passage)
        pair = n >= PAIRED_FROM
        keys = _pair_keys(passage, wanted.terms) if pair else wanted.terms * wanted.terms + passage.astype(np.int64)
        numbers = np.searchsorted(wanted.keys, keys)
        mine = seeds[own[k] : own[k + 1]]
        seen = np.minimum(np.searchsorted(here, mine), len(here) - 1)
        seen = seen[here[seen] == mine]
        docs = np.zeros(len(s.docs), bool)
        for x in seen.tolist():
            docs[s.owner[s.place[at[x] : to[x]]]] = True
        i, j = _meetings(numbers, s.number, s.place)
        mine = docs[s.owner[j]]
        i, j = i[mine], j[mine]
        held = _enough(i, s.owner[j], n, least_paired(n) if pair else least_words(n), pair)
        docs[:] = False
        docs[held] = True
        mine = np.flatnonzero(docs[s.owner[j]])
        mine = mine[np.argsort(j[mine], kind="stable")]
        i, j = i[mine], j[mine]
        if pair:
            mine = _two_stretches(i, j, s.owner[j], n)
            i, j = i[mine], j[mine]
        doc = s.owner[j]
        held = np.unique(doc)
        lo, hi = np.searchsorted(doc, held, "left"), np.searchsorted(doc, held, "right")
        for d, a, z in zip(held.tolist(), lo.tolist(), hi.tolist()):
            states = aligned(_runs(i[a:z], j[a:z], 2 if pair else 1), passage, s.seq)
            good = states[leaks(states[:, 0], states[:, 1], n)]
            if len(good):
                cover, same = max(map(tuple, good.tolist()), key=lambda v: (v[1], -v[0]))
                yield int(s.docs[d]), int(wanted.items[k]), n, cover, same


def search(index: DataFrame, lists: list[tuple[int, list[str]]]) -> DataFrame:
    """(doc_id, item_id, words, covered, equal) of every document and passage whose alignment passes.  ``index``:
    written segments; ``lists``: (item, words)."""
    wanted = passages_of(lists)
    context = index.sparkSession.sparkContext
    shared = context.broadcast(wanted.parts())
    found = context.broadcast(rarest(wanted, key_counts(index, shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Passages(*shared.value)
        for s in _segments(batches, wanted):
            out = list(_leaks_in(s, wanted, *found.value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "item_id", "words", "covered", "equal"])

    return index.mapInArrow(run, "doc_id bigint, item_id bigint, words bigint, covered bigint, equal bigint")


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, words, covered, equal): every document that repeats at least half of a passage.
    Copies of a document count each; null, empty and blank texts and passages repeat nothing; repeated
    items are reported under each of their ids.  ``index``: the written :func:`segments` of ``docs``, if made before."""
    words = items.where(F.col(passage).isNotNull()).select(F.sum(F.size(F.split(passage, r"\s+")))).first()[0] or 0
    if words > MOST_TEST_WORDS:
        raise ValueError(f"a test set of {words} words is too large to send to every task; search it in parts")
    rows = items.select(F.col(item_id).cast("bigint"), passage).collect()
    index = written(segments(docs, doc_id, text), "index") if index is None else index
    return search(index, [(int(r[0]), words_of(r[1])) for r in rows])
