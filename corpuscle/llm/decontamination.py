"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark is read in blocks of a fixed number of items. For each block one
pass over the corpus counts in how many documents each of the block's n-grams
occurs; an item's seeds are those of its n-grams that occur at all, or the rarest
share of them. An item of fewer words has one n-gram of its own length. A second
pass finds the seeds in the documents and aligns the item with the passage around
each hit.
Both passes are maps over the documents: no document is shuffled, and what the
driver holds is bounded by a block of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import _arrays as A

U64 = np.uint64
#: Bytes that separate words: ASCII white space, controls and punctuation.
_SEPARATORS = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LEAK_SCHEMA = "doc_id long, item_id long, score double, n_matched long, n_item_words long, byte_start long, byte_end long"


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, row pointer) of the words of letters and digits, lower-cased in A-Z."""
    plain = np.where(_SEPARATORS[data], np.uint8(0x20), A._LOWER[data])
    start, end, ptr = A.word_spans(plain, offs)
    return start, end, A.span_hashes(plain, start, end), ptr


@dataclass
class Block:
    """A block of benchmark items as arrays: words, n-grams and where each n-gram occurs."""

    ids: np.ndarray
    words: np.ndarray
    ptr: np.ndarray
    sizes: list[int]  # of n-grams: n, and the lengths of shorter items
    gram: np.ndarray  # distinct n-grams, ascending
    at_gram: np.ndarray  # of each occurrence: index into gram, item, word position
    at_item: np.ndarray
    at_word: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> Block:
        column = pa.array([t for _, t in rows], type=pa.large_string())
        data, offs = A.binary_parts(column)
        _, _, hashes, ptr = words(data, offs)
        counts = np.diff(ptr)
        sizes = sorted({n, *counts[(counts > 0) & (counts < n)].tolist()})
        grams, items, places = [], [], []
        for size in sizes:
            own, gptr = A.shingles(hashes, ptr, size, short_whole=False)
            item = A.row_of(gptr)
            keep = counts[item] == size if size < n else counts[item] >= n
            grams.append(own[keep])
            items.append(item[keep])
            places.append((np.arange(len(own)) - gptr[item])[keep])
        grams, item, place = map(np.concatenate, (grams, items, places))
        order = np.lexsort((place, item))
        grams, item, place = grams[order], item[order], place[order]
        distinct, at = np.unique(grams, return_inverse=True)
        return cls(np.array([i for i, _ in rows], dtype=np.int64), hashes, ptr, sizes, distinct, at, item, place)

    def hits(self, hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word position, index into self.gram) of the block's n-grams in texts."""
        rows, places, grams = [], [], []
        for size in self.sizes:
            own, gptr = A.shingles(hashes, ptr, size, short_whole=False)
            at, gram = self.found(own)
            row = np.searchsorted(gptr, at, side="right") - 1
            rows.append(row)
            places.append(at - gptr[row])
            grams.append(gram)
        return tuple(map(np.concatenate, (rows, places, grams)))

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into grams, index into self.gram) of those that the block has."""
        if not len(self.gram) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.zeros(1 << 20, dtype=bool)
        bits[self.gram >> U64(44)] = True
        maybe = np.flatnonzero(bits[grams >> U64(44)])
        at = np.searchsorted(self.gram, grams[maybe])
        at[at == len(self.gram)] = 0
        same = self.gram[at] == grams[maybe]
        return maybe[same], at[same]

    def seeds(self, counts: np.ndarray, share: float, least: int) -> np.ndarray:
        """Which occurrences are seeds: of each item's n-grams that occur in a document the rarest share, least at the minimum."""
        present = counts[self.at_gram] > 0
        order = np.lexsort((self.at_word, counts[self.at_gram], ~present, self.at_item))
        sizes = np.bincount(self.at_item, minlength=len(self.ids))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = np.bincount(self.at_item[present], minlength=len(self.ids))
        return present & (rank < np.maximum(least, np.ceil(found * share))[self.at_item])


def align(item: np.ndarray, passage: np.ndarray, mismatch: float = -0.5, gap: float = -0.5) -> tuple[float, int, int, int]:
    """Best local alignment, match 1: (score, matches, start, end) with the span in passage words."""
    m = len(passage)
    score, hits, begin = np.zeros(m + 1), np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0.0, 0, 0, 0)
    steps = np.arange(m + 1) * gap
    for w in item:
        same = passage == w
        diagonal = score[:-1] + np.where(same, 1.0, mismatch)
        up = score[1:] + gap
        take = diagonal >= up
        new = np.zeros(m + 1)
        new[1:] = np.maximum(np.where(take, diagonal, up), 0.0)
        n_hits, n_begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
        n_hits[1:] = np.where(new[1:] > 0, np.where(take, hits[:-1] + same, hits[1:]), 0)
        n_begin[1:] = np.where(new[1:] > 0, np.where(take, begin[:-1], begin[1:]), np.arange(1, m + 1))
        # gaps in the item: a running maximum of score minus the cost of the way
        run = np.maximum.accumulate(new - steps)
        left = run + steps
        better = left > new + 1e-12
        if better.any():
            source = np.maximum.accumulate(np.where(new - steps >= run - 1e-12, np.arange(m + 1), 0))
            n_hits, n_begin = np.where(better, n_hits[source], n_hits), np.where(better, n_begin[source], n_begin)
            new = np.where(better, left, new)
        score, hits, begin = new, n_hits, n_begin
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), int(hits[k]), int(begin[k]), k)
    return best


def _count(docs: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each of the block's n-grams occurs; the result is as large as the block."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = held.value, np.zeros(len(held.value.gram), dtype=np.int64)
        for batch in batches:
            for _, _, data, offs in A.blocks(batch.column(1), 1 << 20):
                _, _, hashes, ptr = words(data, offs)
                row, _, gram = own.hits(hashes, ptr)
                total += np.bincount(np.unique(row * len(total) + gram) % max(1, len(total)), minlength=len(total))
        A.release()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(len(block.gram), dtype=np.int64)
    for row in docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row["gram"]] = row["n"]
    return out


def _diagonals(block: Block, occurrences: np.ndarray, ptr_of: np.ndarray, row: np.ndarray, place: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (row, item, shift) of all meetings of a hit with an occurrence of its n-gram, in this order.

    A text and an item that repeat one n-gram meet in as many pairs as the product
    of their repeats, so meetings are expanded in portions and made distinct at once:
    what is held is bounded by the shifts that there are.
    """
    many = ptr_of[gram + 1] - ptr_of[gram]
    held = np.zeros((0, 3), dtype=np.int64)
    for some in A._portions(np.flatnonzero(many), many):
        hit = occurrences[A.ragged(ptr_of[gram[some]], many[some])]
        met = np.column_stack([np.repeat(row[some], many[some]), block.at_item[hit], np.repeat(place[some], many[some]) - block.at_word[hit]])
        held = np.concatenate([held, met])
        held = held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))]
        fresh = np.ones(len(held), dtype=bool)
        fresh[1:] = (held[1:] != held[:-1]).any(axis=1)
        held = held[fresh]
    return held[:, 0], held[:, 1], held[:, 2]


def _leaks(docs: DataFrame, block: Block, seed: np.ndarray, least_score: float, slack: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((block, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = held.value
        # a gap costs 0.5 a word, so an alignment that reaches least_score inserts or leaves out at most so many words
        reach = np.maximum(slack, np.ceil(np.diff(own.ptr) * max(0.0, 1 - least_score) / 0.5)).astype(np.int64)
        occurrences = np.flatnonzero(chosen)
        occurrences = occurrences[np.argsort(own.at_gram[occurrences], kind="stable")]
        ptr_of = np.searchsorted(own.at_gram[occurrences], np.arange(len(own.gram) + 1))
        for batch in batches:
            ids, out = batch.column(0).cast(pa.int64()).to_pylist(), []
            for first, _, data, offs in A.blocks(batch.column(1), 1 << 20):
                start, end, hashes, ptr = words(data, offs)
                row, item, shift = _diagonals(own, occurrences, ptr_of, *own.hits(hashes, ptr))
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(shift) > reach[item[1:]])) + 1
                for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]), strict=True):
                    if a == b:
                        continue
                    r, i = int(row[a]), int(item[a])
                    text = own.words[own.ptr[i] : own.ptr[i + 1]]
                    lo = int(ptr[r]) + max(0, int(shift[a]) - int(reach[i]))
                    hi = min(int(ptr[r + 1]), int(ptr[r]) + int(shift[b - 1]) + len(text) + int(reach[i]))
                    if np.isin(text, hashes[lo:hi]).sum() < least_score * len(text):
                        continue  # a match uses up a word of the item, so the score can't be reached
                    score, hits, s, e = align(text, hashes[lo:hi])
                    if score >= least_score * len(text):
                        base = offs[r]
                        out.append((ids[first + r], int(own.ids[i]), score / len(text), hits, len(text), int(start[lo + s] - base), int(end[lo + e - 1] - base)))
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x, strict=True)) for x in out], schema=_ARROW)

    return docs.mapInArrow(run, LEAK_SCHEMA)


_NAMES = [x.split()[0] for x in LEAK_SCHEMA.split(", ")]
_ARROW = pa.schema([(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in LEAK_SCHEMA.split(", ")])


def leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = 3, seed_share: float = 1.0, least_seeds: int = 8,
    least_score: float = 0.5, slack: int = 8, block_items: int = 20_000,
) -> DataFrame:
    """One row for each (document, benchmark item) that aligns with at least least_score of the item's words.

    Words are runs of letters, digits and non-ASCII bytes, lower-cased in A-Z. Of
    several passages of one document that match an item, the best is returned
    (ties: the first). A passage is looked at if it shares n words in a row with the
    item; it reaches as far as an alignment with least_score can, slack words at the
    least. With seed_share below 1 only the rarest share of the item's n-grams counts.
    Null or empty texts match nothing; items without words and items with a null id
    are no items; an item shorter than n words is looked for as a whole, wherever it
    stands in a text. Rows that repeat a doc_id are one document, rows that repeat
    an item_id are one item that is found by the best of its texts. Byte offsets are into the text's UTF-8. Other columns of either
    table are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    n_blocks = max(1, -(-items.count() // block_items))
    out = None
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).distinct().orderBy("item_id", "text").collect()
        block = Block.of([tuple(r) for r in rows], n)
        counts = _count(docs, block)
        part = _leaks(docs, block, block.seeds(counts, seed_share, least_seeds), least_score, slack)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("score", (-F.col("byte_start")).alias("first"), "n_matched", "n_item_words", "byte_start", "byte_end")).alias("best")
    found = out.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.score", "best.n_matched", "best.n_item_words", "best.byte_start", "best.byte_end")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a benchmark passage."""
    found = leaks(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
