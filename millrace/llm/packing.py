"""Filling containers of a fixed number of tokens with texts that belong together.

Texts come in shards (consecutive documents of a task, up to SHARD of them, fewer where they are very long), each with an inverted index of its own. In decreasing order
of size, every unused document seeds a container. BM25, asked with all terms of the seed, ranks all unused documents that share one
with it. They fill the container in order of score as long as the next one fits, and the room that is then left with the largest of the
other neighbours that fit. The ranking is exact within the shard. Neighbours alone leave gaps, so a gap is then filled with the largest unused
items of the shard that fit; ``placed`` tells seeds, neighbours and fillers apart. A text longer than the capacity is cut into full containers and a rest that is packed like any other
item; no other text is cut.

Everything happens where the texts are read: nothing is shuffled, a task holds one shard, and all capacities are served from
one reading of the text. Each text comes out once per capacity, copies too. Null and empty texts take no room and come out with
container null.
"""

from __future__ import annotations

from collections import Counter as Bag
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import VOCABULARY, counter

#: Documents to a shard, and to an index; and the entries of an index at most, which bounds a task's memory where texts are very long.
SHARD = 4096
ENTRIES = 3_000_000
# The usual parameters of BM25.
K1, B = 1.2, 0.75

PLACES = "pack_name string, capacity_tokens int, container long, {keep}, piece int, first_token long, tokens long, placed string"
SEED, NEIGHBOUR, FILLER, FULL = "seed", "neighbour", "filler", "full"


class Index:
    """BM25 over the documents of a shard."""

    def __init__(self, bags: list[Bag]):
        ids: dict[str, int] = {}
        docs, terms, counts = [], [], []
        for i, bag in enumerate(bags):
            docs.append(np.full(len(bag), i, dtype=np.int32))
            terms.append(np.fromiter((ids.setdefault(t, len(ids)) for t in bag), dtype=np.int32, count=len(bag)))
            counts.append(np.fromiter(bag.values(), dtype=np.float32, count=len(bag)))
        self.n = len(bags)
        self.terms = terms
        every = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        doc, term, tf = every(docs, np.int32), every(terms, np.int32), every(counts, np.float32)
        order = np.argsort(term, kind="stable")
        df = np.bincount(term, minlength=len(ids))
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        length = np.bincount(doc, weights=tf, minlength=self.n).astype(np.float32)
        norm = K1 * (1 - B + B * length / max(1e-9, length.mean() if self.n else 1))
        weight = self.idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.df = df
        self.postings = np.concatenate([[0], np.cumsum(df)]), doc[order], weight[order].astype(np.float32)

    def scores(self, seed: int, postings: tuple | None = None) -> np.ndarray:
        """Scores of all documents (in ``postings``, if given) for all the seed's terms that others have too."""
        start, doc, weight = postings or self.postings
        terms = self.terms[seed]
        terms = terms[start[terms] < start[terms + 1]]
        if not len(terms):
            return np.zeros(self.n)
        size = start[terms + 1] - start[terms]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start[terms] - ends + size, size)
        return np.bincount(doc[at], weights=weight[at], minlength=self.n)

    def without(self, free: np.ndarray, postings: tuple) -> tuple:
        """The postings of the free documents only."""
        start, doc, weight = postings
        keep = free[doc]
        return np.concatenate([[0], np.cumsum(keep)])[start], doc[keep], weight[keep]


class _Unused:
    """Unused items by size; finds the largest that fits."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i in np.argsort(-np.arange(len(sizes))):
            if sizes[i] > 0:
                self.by_size[sizes[i]].append(int(i))
        self.free = sizes > 0
        self.below = np.arange(capacity + 1)

    def _find(self, size: int) -> int:
        path = []
        while size > 0:
            while self.by_size[size] and not self.free[self.by_size[size][-1]]:
                self.by_size[size].pop()
            if self.by_size[size]:
                break
            path.append(size)
            size = int(self.below[size]) if self.below[size] < size else size - 1
        for p in path:
            self.below[p] = size
        return size

    def largest(self, room: int) -> int | None:
        size = self._find(room)
        return self.by_size[size][-1] if size > 0 else None


def pack(sizes: np.ndarray, capacity: int, index: Index) -> list[list[tuple[int, str]]]:
    """Containers, as lists of (document, how it was placed), of the items with sizes from 1 to the capacity (0: no item)."""
    unused = _Unused(sizes, capacity)
    free, out = unused.free, []
    postings, left, kept = index.postings, int(free.sum()), int(free.sum())
    while (seed := unused.largest(capacity)) is not None:
        free[seed] = False
        inside, room = [(seed, SEED)], capacity - int(sizes[seed])
        if left < kept / 2:
            # Half of the postings are of used documents.
            postings, kept = index.without(free, postings), left
        if room and unused.largest(room) is not None:
            scores = index.scores(seed, postings)
            near = np.flatnonzero((scores > 0) & free & (sizes <= room))
            near = near[np.argsort(-scores[near], kind="stable")]
            # As many of the nearest as fit one after the other; what is left of the room takes the largest neighbours that fit, the nearer of equals.
            n = int(np.searchsorted(np.cumsum(sizes[near]), room, "right"))
            taken, near = near[:n].tolist(), near[n:]
            room -= int(sizes[taken].sum())
            while room and len(near := near[sizes[near] <= room]):
                at = int(np.argmax(sizes[near]))
                taken.append(int(near[at]))
                room -= int(sizes[near[at]])
                near = np.delete(near, at)
            free[taken] = False
            inside += [(i, NEIGHBOUR) for i in taken]
        while room and (i := unused.largest(room)) is not None:
            free[i] = False
            inside.append((i, FILLER))
            room -= int(sizes[i])
        left -= len(inside)
        out.append(inside)
    return out


def pack_shard(tokens: np.ndarray, bags: list[Bag], packs: list[tuple[str, int]]) -> Iterator[tuple[str, int, int | None, int, int, int, int, str | None]]:
    """(pack, capacity, container, document, piece, first token, tokens, placed) of a shard; containers count from 0 per pack."""
    index = Index(bags)
    for name, capacity in packs:
        n = 0
        for i in np.flatnonzero(tokens == 0):
            yield name, capacity, None, int(i), 0, 0, 0, None
        full = tokens // capacity
        rest = np.where(tokens <= capacity, tokens, tokens % capacity)
        for i in np.flatnonzero(tokens > capacity):
            for piece in range(int(full[i])):
                yield name, capacity, n, int(i), piece, piece * capacity, capacity, FULL
                n += 1
        for inside in pack(rest, capacity, index):
            for i, how in inside:
                piece = int(full[i]) if tokens[i] > capacity else 0
                yield name, capacity, n, i, piece, piece * capacity, int(rest[i]), how
            n += 1


def packing(df: DataFrame, text: str, keep: list[str], packs: list[tuple[str, int]], vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """Where each piece of each text goes: (pack_name, capacity_tokens, container, keep..., piece, first_token, tokens, placed).

    packs: (name, capacity in tokens) of each kind of container, positive; few, as pack_sizes has them.
    """
    if any(c is None or c < 1 for _, c in packs):
        raise ValueError(f"capacities must be positive: {packs}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        base, done = TaskContext.get().partitionId() << 40, [0] * len(packs)
        kept, tokens, bags, entries = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(kept).combine_chunks()
            rows = list(pack_shard(np.array(tokens, dtype=np.int64), bags, packs))
            name, capacity, container, doc, piece, first, size, placed = zip(*rows, strict=True)
            at = {p[0]: k for k, p in enumerate(packs)}
            numbers = [None if c is None else base + done[at[p]] + c for p, c in zip(name, container, strict=True)]
            for k, (p, _) in enumerate(packs):
                done[k] += 1 + max([-1, *(c for q, c in zip(name, container, strict=True) if q == p and c is not None)])
            columns = [pa.array(name, pa.string()), pa.array(capacity, pa.int32()), pa.array(numbers, pa.int64())]
            columns += [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.take(pa.array(doc, pa.int64())).columns]
            columns += [pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(placed, pa.string())]
            yield from pa.table(columns, names=["pack_name", "capacity_tokens", "container", *keep, "piece", "first_token", "tokens", "placed"]).to_batches(max_chunksize=50_000)

        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(len(keep))):
                if len(tokens) >= shard or entries >= ENTRIES:
                    kept.append(batch.slice(start, i - start).select(keep))
                    yield from flush()
                    kept, tokens, bags, entries, start = [], [], [], 0, i
                t = t.as_py()
                chunks = count.chunks(t) if t else []
                tokens.append(count.of_chunks(chunks) if count.plain(t) else count.count(t))
                bags.append(Bag(chunks))
                entries += len(bags[-1])
            kept.append(batch.slice(start).select(keep))
        if tokens:
            yield from flush()

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    names = ", ".join(f"`{c}` {t}" for c, t in source.drop("__text").dtypes)
    return source.mapInArrow(read, PLACES.format(keep=names))
