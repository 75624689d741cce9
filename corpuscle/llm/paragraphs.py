"""Substring deduplication by paragraphs: banding, verification, and removal by components.

It has two passes, the second on what the first has left. In the first, paragraphs
are the lines of a text: they are banded by MinHash over five-word shingles,
colliding ones are verified by exact Jaccard and grouped by components, and of each
component the first line stays, in order of doc_id and position. In the second,
texts are cut into pieces at words that content alone chooses (in every window the
word pair of least hash), so that a passage set into the middle of a paragraph is
cut alike wherever it stands: a repeat of ``2 * window + 1`` words or more always
holds a whole piece. Of equal pieces the first stays, and the others are extended
word by word against it, so that a repeat goes from end to end.

As the second pass sees no line that is removed, and each word that it cuts has an
equal word that stands earlier in what was left, every passage that it removes
stands in a text that is kept, whole or put together from such words. What is
compared is always the first occurrence in the corpus, so results do not hang on
how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import _arrays as A
from corpuscle.llm import superminhash as S
from corpuscle.llm._spark import KEY, Tables, keyed

U64 = np.uint64
LEFT, RIGHT = 0, 1
LARGEST = U64(0xFFFFFFFFFFFFFFFF)


class Layout:
    """Words of a block of texts, lower-cased in A-Z, and where its lines begin."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        plain = A._LOWER[data]
        self.start, self.end, self.ptr = A.word_spans(plain, offs)
        self.words = A.span_hashes(plain, self.start, self.end)
        self.heads = self.ptr[:-1][np.diff(self.ptr) > 0]
        new_line = np.zeros(len(self.words), dtype=bool)
        if len(new_line):
            breaks = np.concatenate([[0], np.cumsum(data == 10)])
            new_line[1:] = breaks[self.start[1:]] != breaks[self.end[:-1]]
            new_line[self.heads] = True
        self.lines = np.flatnonzero(new_line)

    def line_sizes(self) -> np.ndarray:
        return np.diff(np.append(self.lines, len(self.words)))

    def pieces(self, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of the pieces: from one cut to the next, least words if there are so many."""
        n, counts = len(self.words), np.diff(self.ptr)
        cuts = self.heads
        sizes = np.maximum(counts - window + 1, 0)
        if sizes.sum():
            key = np.full(n, LARGEST)
            key[1:] = A.mix(self.words[:-1] * U64(3) + self.words[1:])
            key[self.heads] = LARGEST
            # the place in the low bits makes the first of equal keys the least
            low = U64((1 << max(1, int(n).bit_length())) - 1)
            best = (key & ~low) | np.arange(n, dtype=np.uint64)
            width = 1
            while 2 * width <= window:
                best = np.minimum(best[:-width], best[width:])
                width *= 2
            if width < window:
                best = np.minimum(best[: len(best) - (window - width)], best[window - width :])
            chosen = best[A.ragged(self.ptr[:-1], sizes)] & low
            cuts = np.unique(np.concatenate([cuts, chosen.astype(np.int64)]))
        row_end = np.repeat(self.ptr[1:], counts)[cuts] if n else cuts
        size = np.minimum(np.append(cuts[1:], n), row_end) - cuts
        return cuts, np.minimum(np.maximum(size, least), row_end - cuts)

    def digests(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high half of a digest) of the runs of words."""
        lo, hi = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
        for some in A._portions(np.flatnonzero(size), size):
            n = size[some]
            at, place = A.ragged(first[some], n), A.mix(A.ragged(np.zeros(len(some), np.int64), n).astype(np.uint64) + U64(1))
            heads = np.cumsum(n) - n
            lo[some], hi[some] = (A.mix(np.add.reduceat(A.mix(self.words[at] * U64(odd) ^ place), heads) + n.astype(np.uint64)) for odd in (0x2545F4914F6CDD1D, 0x6C62272E07BB0143))
        return lo, hi


LINE_SCHEMA = "doc_id long, word long, n_words long, lo long, hi long, n_shingles long, bands array<long>"
PIECE_SCHEMA = "doc_id long, word long, n_words long, lo long, hi long"


def lines(docs: DataFrame, least_words: int, n: int, bands: int, rows: int) -> DataFrame:
    """The lines of least_words words or more of (doc_id, text): place, size, digest, and band keys.

    Of lines that are equal within a block only the first has band keys. Sets of
    under four shingles are as near as four fifths to equal sets alone and have one
    key, that of the first band, in which equal sets always meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, data, offs in A.blocks(batch.column(1), 1 << 20):
                own = Layout(data, offs)
                first, size = own.lines, own.line_sizes()
                keep = size >= least_words
                first, size = first[keep], size[keep]
                lo, hi = own.digests(first, size)
                row = A.row_of(own.ptr)[first]
                doc, word = ids[i:j][row], first - own.ptr[row]
                order = np.lexsort((word, doc, hi, lo))
                fresh = np.ones(len(lo), dtype=bool)
                fresh[1:] = (lo[order[1:]] != lo[order[:-1]]) | (hi[order[1:]] != hi[order[:-1]])
                new = np.sort(order[fresh])
                values, vptr = A.distinct(*A.shingles(own.words[A.ragged(first[new], size[new])], np.concatenate([[0], np.cumsum(size[new])]), n))
                keys = S.band_keys(S.signatures(values, vptr, bands * rows), bands, rows)
                sizes, many = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
                sizes[new] = np.diff(vptr)
                many[new] = np.where(sizes[new] < 4, 1, bands)
                keys = keys[np.arange(bands) < many[new][:, None]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc), pa.array(word), pa.array(size), pa.array(A.signed(lo)), pa.array(A.signed(hi)),
                        pa.array(sizes), A.list_column(A.signed(keys), np.concatenate([[0], np.cumsum(many)]), pa.int64()),
                    ],
                    names=[f.split()[0] for f in LINE_SCHEMA.split(", ")],
                )
        A.release()

    return docs.mapInArrow(run, LINE_SCHEMA)


def pieces(docs: DataFrame, window: int, least_words: int) -> DataFrame:
    """The pieces of (doc_id, text): place, size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, data, offs in A.blocks(batch.column(1), 1 << 20):
                own = Layout(data, offs)
                first, size = own.pieces(window, least_words)
                keep = size >= least_words
                first, size = first[keep], size[keep]
                lo, hi = own.digests(first, size)
                row = A.row_of(own.ptr)[first]
                columns = [ids[i:j][row], first - own.ptr[row], size, A.signed(lo), A.signed(hi)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])
        A.release()

    return docs.mapInArrow(run, PIECE_SCHEMA)


def _line_sets(docs: DataFrame, items: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, shingles) of lines, found again by the document and word where they first occur."""
    wanted = ids.join(items.select("id", "doc_id", "word", "n_words"), "id").groupBy("doc_id").agg(F.collect_list(F.struct("word", "n_words", "id")).alias("lines"))
    held = docs.join(wanted, "doc_id").select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).to_pylist()
            for i, j, data, offs in A.blocks(batch.column(0), 1 << 20):
                words, ptr = A.word_hashes(data, offs)
                picked = [(x["id"], ptr[r] + x["word"], x["n_words"]) for r in range(j - i) for x in lines[i + r]]
                first, size = np.array([p[1] for p in picked]), np.array([p[2] for p in picked])
                values, vptr = A.distinct(*A.shingles(words[A.ragged(first, size)], np.concatenate([[0], np.cumsum(size)]), n))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in picked], pa.int64()), A.list_column(A.signed(values), vptr, pa.int64())], names=["id", "shingles"])
        A.release()

    return held.mapInArrow(run, "id long, shingles array<long>")


def _place() -> Column:
    """Where a unit stands, in the order of the corpus."""
    return F.struct(F.col("doc_id").alias("d"), F.col("word").alias("w"))


def _firsts(tables: Tables, units: DataFrame, name: str) -> DataFrame:
    """(lo, hi, first): the first place of every digest that occurs more than once."""
    seen = units.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
    return tables.write(seen.where("n > 1").drop("n"), name)


def line_removals(tables: Tables, docs: DataFrame, percent: int, n: int, least_words: int, miss: float, rows: int = 3) -> DataFrame:
    """(doc_id, word, n_words, of): lines that equal or nearly equal a kept line in document `of`."""
    bands, rows = S.banding(percent / 100, miss, rows)
    found = tables.write(lines(docs, least_words, n, bands, rows), "lines")
    firsts = _firsts(tables, found, "line-firsts")
    marked = found.join(firsts, ["lo", "hi"], "left")
    alone = F.col("first").isNull() | (_place() == F.col("first"))
    marked = marked.withColumn("id", F.when(alone & (F.size("bands") > 0), F.monotonically_increasing_id()))
    marked = tables.write(marked.withColumn("bands", F.when(F.col("id").isNotNull(), F.col("bands"))), "marked")
    tables.drop("lines")
    items = marked.where("id is not null")
    groups = S.grouped(tables, items.select("id", "n_shingles", "bands"), lambda ids: _line_sets(docs, items, ids, n), percent)
    grouped = groups.join(items.select("id", "lo", "hi", _place().alias("own")), "id")
    keepers = tables.write(grouped.groupBy("component").agg(F.min("own").alias("kept")), "keepers")
    moved = tables.write(grouped.join(keepers, "component").where("own > kept").select("lo", "hi", "kept"), "moved")
    later = marked.join(moved, ["lo", "hi"], "left").withColumn("kept", F.coalesce("kept", "first"))
    return later.where(_place() > F.col("kept")).select("doc_id", "word", "n_words", F.col("kept.d").alias("of"))


def piece_removals(tables: Tables, docs: DataFrame, window: int, least_words: int) -> DataFrame:
    """(doc_id, word, n_words, of, at): pieces that equal the first of their kind, at word `at` of document `of`."""
    found = tables.write(pieces(docs, window, least_words), "pieces")
    again = found.join(_firsts(tables, found, "piece-firsts"), ["lo", "hi"]).where(_place() > F.col("first"))
    return again.select("doc_id", "word", "n_words", F.col("first.d").alias("of"), F.col("first.w").alias("at"))


def _merged(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, sorted by (row, first), joined where they touch: (run of each span, row, first, end of each run)."""
    reach, head = np.maximum.accumulate(end), np.ones(len(first), dtype=bool)
    head[1:] = (first[1:] > reach[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    return np.cumsum(head) - 1, row[at], first[at], np.maximum.reduceat(end, at) if len(at) else end


def _flat(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """(row of each element, the fields) of a column of lists of structs; a null list has no elements."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.repeat(np.arange(len(column)), sizes), list(column.flatten().flatten())


def extensions(tables: Tables, docs: DataFrame, spans: DataFrame, context: int) -> DataFrame:
    """(doc_id, ends): of each document with equal runs, [side, edge, words] with the words of the kept occurrence beyond it.

    Words are 64-bit hashes, to the left in falling order. Beyond a run, equal text
    of more than context words holds a whole piece again, which is a run of its own,
    so context words are enough. Each kept document is read once for all that ask for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, fields = _flat(batch.column(1))
            word, size, of, at = map(np.asarray, fields)
            order = np.lexsort((word, row))
            row, word, size, of, at = row[order], word[order], size[order], of[order], at[order]
            base = row * (1 << 40)  # keeps the words of rows apart
            run_of, _, first, end = _merged(row, base + word, base + word + size)
            ids = np.asarray(batch.column(0))[row]
            left = (base + word == first[run_of]) & (word > 0) & (at > 0)
            right = base + word + size == end[run_of]
            columns = [
                np.concatenate([ids[left], ids[right]]), np.repeat([LEFT, RIGHT], [left.sum(), right.sum()]), np.concatenate([word[left], (word + size)[right]]),
                np.concatenate([of[left], of[right]]), np.concatenate([at[left], (at + size)[right]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "side", "edge", "of", "place"])

    edges = tables.write(spans.select("doc_id", "_spans").mapInArrow(run, "doc_id long, side long, edge long, of long, place long"), "edges")
    asked = edges.groupBy(F.col("of").alias("doc_id")).agg(F.collect_set(F.struct("side", "place")).alias("asked"))
    held = docs.join(asked, "doc_id").select("doc_id", "text", "asked")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, data, offs in A.blocks(batch.column(1), 1 << 20):
                hashes, ptr = A.word_hashes(data, offs)
                out: list[tuple[int, int, int, bytes]] = []
                for r in range(j - i):
                    own = hashes[ptr[r] : ptr[r + 1]]
                    for x in asked[i + r]:
                        at = x["place"]
                        beyond = own[at : at + context] if x["side"] == RIGHT else own[max(0, at - context) : at][::-1]
                        out.append((ids[i + r], x["side"], at, beyond.tobytes()))
                of, side, place, beyond = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(side, pa.int64()), pa.array(place, pa.int64()), pa.array(beyond, pa.binary())], names=["of", "side", "place", "words"])
        A.release()

    beyond = tables.write(held.mapInArrow(words, "of long, side long, place long, words binary"), "beyond")
    return edges.join(beyond, ["of", "side", "place"]).groupBy("doc_id").agg(F.collect_list(F.struct("side", "edge", "words")).alias("_ends"))


def _extended(words: np.ndarray, ptr: np.ndarray, row: np.ndarray, ends: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) in words of the block by which equal runs go on, for each end (side, edge, words of the kept occurrence)."""
    side, edge = np.asarray(ends[0]), np.asarray(ends[1])
    data, offs = A.binary_parts(ends[2])
    there, size = np.frombuffer(data.tobytes(), dtype=np.uint64), np.diff(offs) // 8
    at, low, high = ptr[row] + edge, ptr[row], ptr[row + 1]
    size = np.minimum(size, np.where(side == RIGHT, high - at, at - low))
    k = A.ragged(np.zeros(len(size), np.int64), size)
    step = np.repeat(np.where(side == RIGHT, 1, -1), size)
    here = words[np.repeat(np.where(side == RIGHT, at, at - 1), size) + step * k]
    same, n = here == there[np.repeat(offs[:-1] // 8, size) + k], size.copy()
    some = np.flatnonzero(size)
    if len(some):
        heads = np.cumsum(size[some]) - size[some]
        n[some] = np.minimum.reduceat(np.where(same, np.repeat(size, size), k), heads)
    return np.where(side == RIGHT, at, at - n), np.where(side == RIGHT, at + n, at)


def _cut(data: np.ndarray, offs: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block without runs of words; the white space after a run goes with it unless it breaks the line."""
    last = layout.end[end - 1]
    inside = end < layout.ptr[row + 1]
    stop = offs[row + 1].copy()
    stop[inside] = layout.start[end[inside]]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.where(breaks[stop] > breaks[last], last, stop)
    edges = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edges, layout.start[first], 1)
    np.add.at(edges, stop, -1)
    keep = np.cumsum(edges[:-1]) == 0
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


_ADDED = ("n_removed_words", "n_spans", "linked")
_COUNTS = "n_removed_words long, n_spans long, linked array<long>"


def _without(docs: DataFrame, spans: DataFrame, least_run: int) -> DataFrame:
    """docs (with KEY and the added columns) without the runs of (doc_id, _spans, _of, _ends), counted in the added columns."""
    columns = docs.columns
    joined = docs.join(spans.withColumnRenamed("doc_id", "_id"), F.col(KEY) == F.col("_id"), "left").select(*columns, "_spans", "_of", "_ends")
    at, added = columns.index("text"), [columns.index(c) for c in _ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, some = list(batch.columns[: len(columns)]), batch.column(len(columns)).is_valid()  # other rows stay as they are
            rows = batch.filter(some)
            texts, words, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, data, offs in A.blocks(rows.column(at), 1 << 20):
                own = Layout(data, offs)
                row, (word, size) = _flat(rows.column(len(columns)).slice(i, j - i))
                first = own.ptr[row] + np.asarray(word)
                end = first + np.asarray(size)
                ends_row, ends = _flat(rows.column(len(columns) + 2).slice(i, j - i))
                if len(ends_row):
                    more = _extended(own.words, own.ptr, ends_row, ends)
                    row, first, end = np.concatenate([row, ends_row]), np.concatenate([first, more[0]]), np.concatenate([end, more[1]])
                order = np.lexsort((first, row))
                _, row, first, end = _merged(row[order], first[order], end[order])
                keep = (end - first >= least_run) & (end > first)
                row, first, end = row[keep], first[keep], end[keep]
                cut, new = _cut(data, offs, row, first, end, own) if len(row) else (data, offs)
                texts.append(pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(np.ascontiguousarray(new, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(cut))]))
                words.append(np.bincount(row, weights=end - first, minlength=j - i).astype(np.int64))
                counts.append(np.bincount(row, minlength=j - i))
            if rows.num_rows:
                words, counts = np.concatenate(words), np.concatenate(counts)
                new = pa.concat_arrays(texts).cast(pa.large_string()).cast(out[at].type)
                out[at] = pc.replace_with_mask(out[at], some, pc.if_else(rows.column(at).is_valid(), new, None))
                for k, values in zip(added[:2], (words, counts), strict=True):
                    out[k] = pc.replace_with_mask(out[k], some, pc.add(rows.column(k), pa.array(values)))
                changed = np.flatnonzero(counts)
                old, of = (rows.column(k).take(pa.array(changed)).to_pylist() for k in (added[2], len(columns) + 1))
                place = np.arange(batch.num_rows)
                place[np.flatnonzero(np.asarray(some))[changed]] = batch.num_rows + np.arange(len(changed))
                lists = pa.concat_arrays([out[added[2]], pa.array([sorted({*x, *y}) for x, y in zip(old, of, strict=True)], out[added[2]].type)])
                out[added[2]] = lists.take(pa.array(place))
            yield pa.RecordBatch.from_arrays(out, names=columns)
        A.release()

    return joined.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns))


def deduplicated(
    docs: DataFrame, percent: int = 80, n: int = 5, window: int = 24, least_words: int = 5, least_run: int = 15, miss: float = 1e-6,
) -> DataFrame:
    """All columns of docs with repeated passages cut from text, and n_removed_words, n_spans, linked.

    Lines of least_words words or more go if an earlier line equals them or is as
    near as percent on n-word shingles (a pair at the threshold is missed with
    probability miss), by components. In what is left, words go that repeat earlier
    ones in a run of least_run words or more that holds a whole piece, as every run
    of 2 * window + 1 words does; shorter repeats inside a line stay. linked lists
    the documents that hold the occurrences that were kept, n_spans counts runs.

    Null and empty texts, rows with a null doc_id, and documents without repeats
    come back unchanged with n_removed_words 0. Rows that repeat a doc_id and its
    text are one document and are cut alike; of an id with several texts one takes
    part and the others stay unchanged. Ties go to the smaller doc_id, then to the
    earlier place. A document that only repeats others keeps a row with what is
    left, perhaps an empty text. Input columns named like the added ones are
    replaced. A text of any length is read whole, by itself if it is longer than a block.
    """
    tables = Tables(docs.sparkSession, "paragraphs")
    docs = docs.drop(*_ADDED)
    columns = docs.columns
    whole, used = keyed(tables, docs)
    whole = whole.withColumns({"n_removed_words": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "linked": F.array().cast("array<long>")})
    gone = tables.write(line_removals(tables, used, percent, n, least_words, miss), "line-spans")
    for name in ("marked", "line-firsts", "keepers", "moved"):
        tables.drop(name)
    none = F.lit(None).cast("array<struct<side:long,edge:long,words:binary>>").alias("_ends")
    spans = gone.groupBy("doc_id").agg(F.collect_list(F.struct("word", "n_words")).alias("_spans"), F.array_sort(F.collect_set("of")).alias("_of"))
    left = tables.write(_without(whole, spans.select("*", none), 1), "left")
    tables.drop("line-spans")

    used = left.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("doc_id"), "text")
    if not tables.is_empty("repeated-ids"):
        used = used.dropDuplicates(["doc_id"])
    again = tables.write(piece_removals(tables, used, window, least_words), "piece-spans")
    for name in ("pieces", "piece-firsts"):
        tables.drop(name)
    spans = again.groupBy("doc_id").agg(F.collect_list(F.struct("word", "n_words", "of", "at")).alias("_spans"))
    spans = tables.write(spans, "grouped")
    tables.drop("piece-spans")
    ends = extensions(tables, used, spans, 2 * window + 1 + least_words)
    plain = F.transform("_spans", lambda x: F.struct(x["word"].alias("word"), x["n_words"].alias("n_words"))).alias("_spans")
    of = F.array_sort(F.array_distinct(F.transform("_spans", lambda x: x["of"]))).alias("_of")
    return _without(left, spans.join(ends, "doc_id", "left").select("doc_id", plain, of, "_ends"), least_run).select(*columns, *_ADDED)
