"""Filling fixed-capacity containers with items (problem 7).

Sizes are at most the capacity, so an instance of any number of items is its histogram of at most
``capacity`` sizes, and the packing is planned on that histogram alone: groups of equal containers, each
with a count per size.  Items then find their container from their size and their place among the
items of that size.

The plan first fixes, for the largest size left, sets that provably dominate every other choice
(Martello and Toth): the item alone if nothing fits beside it; the item with a partner that fills the
container exactly; the item with its largest fitting partner if no two fit beside it, or if no three do and no
two that do are together larger than that partner; the item with its largest fitting partner and the
largest that then fits, if no three fit beside it and these two replace any two that do.  Fixed sets leave
the instance, which shrinks it, and this repeats.  Best fit, largest first, places the remainder.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.hotkeys import number_rows, read_blocks
from lattica.session import written_path

CAPACITY = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text before byte pairs are merged; a fixed value of the vocabulary (from its package).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(path: str):
    """The encoding of a rank file; kept at the library, so that a worker loads it once for all tasks."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encodings", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens): whole texts in tokens of a public vocabulary; null and empty texts have 0.
    Special tokens' strings are ordinary text.  Lone surrogates count as their replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


@dataclass
class Plan:
    """Groups of equal containers: ``groups[i] = (containers, {size: items per container})``."""

    capacity: int
    groups: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    fixed: int = 0  #: containers fixed by dominance

    @property
    def containers(self) -> int:
        return sum(n for n, _ in self.groups)


class _Counts:
    """Sizes in order with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        """Takes ``k`` items of a size away, or puts them back if it is negative."""
        if size not in self.n:
            self.n[size] = 0
            self.order.insert(bisect_right(self.order, size), size)
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.order[bisect_right(self.order, size) - 1]

    def largest(self, room: int, without: int | None = None) -> int | None:
        """The largest size that fits ``room``; one item of ``without`` is not there."""
        i = bisect_right(self.order, room) - 1
        while i >= 0 and self.order[i] == without and self.n[without] < 2:
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, k: int, without: int) -> int | None:
        """The sum of the ``k`` smallest items besides one of ``without``; None if there are fewer."""
        total, left = 0, k
        for s in self.order:
            have = self.n[s] - (s == without)
            t = min(left, have)
            total, left = total + t * s, left - t
            if not left:
                return total
        return None


def _best_two(c: _Counts, room: int, j: int, above: int = 0) -> int:
    """The largest sum of two items larger than ``above``, besides one of ``j``, that fits ``room``; 0 if none."""
    best, lo, hi = 0, bisect_right(c.order, above), bisect_right(c.order, room) - 1
    while lo <= hi:
        a, b = c.order[lo], c.order[hi]
        need_a = (a == j) + 1 + (a == b)
        if lo == hi and c.n[a] < need_a:
            break
        if a + b <= room and c.n[a] >= 1 + (a == j) and c.n[b] >= 1 + (b == j):
            best = max(best, a + b)
        if a + b > room:
            hi -= 1
        else:
            lo += 1
    return best


def _dominating(c: _Counts, j: int, capacity: int) -> tuple[int, ...] | None:
    """Items that with ``j`` dominate every other set of a container with ``j``: any such set can be divided so that
    each part fits in the place of one of them.  None if no such set of at most three is known."""
    room = capacity - j
    k = c.largest(room, without=j)
    if k is None:  # nothing fits beside it
        return ()
    if k == room:
        return (k,)
    two, three = c.smallest(2, j), c.smallest(3, j)
    if two is None or two > room:
        return (k,)
    if three is not None and three <= room:
        return None
    # beside j at most two items fit: x alone, x <= k, or x and y
    if _best_two(c, room, j) <= k:
        return (k,)
    c.take(k, 1)
    b = c.largest(room - k, without=j)
    c.take(k, -1)
    # k and b replace x and y if y <= b, or if both go where k is
    if b is not None and _best_two(c, room, j, above=b) <= k:
        return (k, b)
    return None


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for ``histogram`` (size to number of items, 1 <= size <= capacity)."""
    c, plan = _Counts(dict(histogram)), Plan(capacity)
    changed = True
    while changed and c.order:
        changed = False
        for j in reversed(list(c.order)):
            partners = _dominating(c, j, capacity) if j in c.n else None
            if partners is None:
                continue
            # taking a dominating set leaves fewer others to compare, so it stays one while its items last
            has = dict(Counter((j, *partners)))
            m = min(c.n[s] // per for s, per in has.items())
            if m:
                plan.groups.append((m, has))
                for s, per in has.items():
                    c.take(s, m * per)
                changed = True
    plan.fixed = plan.containers
    # best fit, largest first, on what is left: open containers by the room they have
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    order: list[int] = []

    def put(room: int, n: int, has: dict[int, int]) -> None:
        if not n:
            return
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_right(order, room), room)
        rooms[room].append((n, has))

    for s in reversed(list(c.order)):
        left = c.n[s]
        while left:
            i = bisect_right(order, s - 1)
            if i == len(order):
                per = min(capacity // s, left)
                n = left // per
                put(capacity - per * s, n, {s: per})
                left -= n * per
                continue
            room = order[i]
            n, has = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[i]
            per = min(room // s, left)
            m = min(n, left // per)
            put(room - per * s, m, {**has, s: has.get(s, 0) + per})
            put(room, n - m, has)
            left -= m * per
    plan.groups += [g for room in order for g in rooms[room]]
    return plan


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and by items larger than half a container."""
    total = sum(s * n for s, n in histogram.items())
    return max(-(-total // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))


def items_of(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_tokens): an item per text; a text beyond the capacity becomes full pieces and a
    rest.  A text without tokens stays one item of size 0."""
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    pieces = F.when(F.col("n_tokens") <= capacity, F.array(F.col("n_tokens").cast("int"))).otherwise(F.concat(F.array_repeat(F.lit(capacity), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    return lengths.select("doc_id", F.posexplode(pieces).alias("piece", "n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(items, plan): items are (doc_id, piece, n_tokens, container_id); every text is whole in one
    container unless it alone exceeds the capacity.  Texts without tokens need no room and have a null
    container.  plan has (containers, fixed, lower_bound, tokens, capacity).  No texts: no items."""
    spark = docs.sparkSession
    path = written_path(items_of(token_counts(docs, tokenizer=tokenizer), capacity), "items")
    items = spark.read.schema("doc_id bigint, piece int, n_tokens int").parquet(path)
    histogram = {int(r[0]): int(r[1]) for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    plan = plan_packing(histogram, capacity)
    # for each size, in order: from which place on items go to which containers
    taken = dict.fromkeys(histogram, 0)
    rows, base = [], 0
    for n, has in plan.groups:
        for s, per in has.items():
            rows.append((s, taken[s], base, per))
            taken[s] += n * per
        base += n
    assert taken == histogram
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    rows.sort()
    for s in histogram:
        mine = [r for r in rows if r[0] == s]
        by_size[s] = tuple(np.array([r[i] for r in mine], np.int64) for i in (1, 2, 3))
    shared = spark.sparkContext.broadcast(by_size)  # groups are bounded by a small multiple of the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, no = b.column(2).to_numpy(), b.column(3).to_numpy()
            to = np.full(len(size), -1, np.int64)
            for s in np.unique(size):
                if s == 0:
                    continue
                start, first, per = shared.value[int(s)]
                at = np.flatnonzero(size == s)
                g = np.searchsorted(start, no[at], "right") - 1
                to[at] = first[g] + (no[at] - start[g]) // per[g]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(to, mask=to < 0)], names=["doc_id", "piece", "n_tokens", "container_id"])

    numbered = number_rows(read_blocks(spark, path, ["doc_id", "piece", "n_tokens"]), "n_tokens")
    placed = numbered.select("doc_id", "piece", "n_tokens", F.col("_no").cast("bigint").alias("no")).mapInArrow(place, "doc_id bigint, piece int, n_tokens int, container_id bigint")
    total = sum(s * n for s, n in histogram.items())
    summary = spark.createDataFrame([(plan.containers, plan.fixed, lower_bound(histogram, capacity), total, capacity)], "containers long, fixed long, lower_bound long, tokens long, capacity long")
    return placed, summary
