"""Exact removal of repeated byte strings of a fixed length by prefix-free parsing.

A rolling hash of k bytes chooses triggers: in every window of ``length`` bytes
the k-gram of least hash (ties: the first). The windows that share a trigger
form a phrase; neighbouring phrases overlap by length - 1 bytes, so every window
lies in exactly one phrase, and equal windows lie in phrases of the same trigger,
wherever they stand. The dictionary holds each distinct phrase with its first place
in corpus order, the parse is the corpus as a sequence of phrases.

Corpus order comes from both. The parse is sorted by phrase and place: a phrase
that isn't the first of its kind is repeated throughout. For the windows that
distinct phrases have in common, the dictionary's phrases of one trigger get a
suffix array (ranks of suffixes by prefix doubling on their bytes, cut at length);
neighbours of equal rank are one string, and their order is that of the places of
their phrases. As matches have one fixed length and lie within a phrase, suffixes
of the parse never have to be compared beyond their first phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.llm import _arrays as A
from corpuscle.llm._spark import KEY, Tables, keyed

U64 = np.uint64
TRIGGER = 24
PARSE_SCHEMA = "repeat boolean, h long, phrase long, doc_id long, start long, n long"
SPAN_SCHEMA = "doc_id long, start long, n long"


def phrases(data: np.ndarray, offs: np.ndarray, length: int, k: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, trigger hash, phrase hash) of the phrases of each row."""
    n, w = len(data), length - k + 1
    sizes = np.maximum(np.diff(offs) - length + 1, 0)
    if not sizes.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(n - k + 1)
    gram = A.RollingHash(data)(at, at + k)
    mask = U64((1 << max(1, int(n).bit_length())) - 1)
    least = (gram & ~mask) | at.astype(np.uint64)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    window = A.ragged(offs[:-1], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    trigger = (least[window] & mask).astype(np.int64)
    head = np.ones(len(window), dtype=bool)
    head[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(window)))
    start, where = window[first], trigger[first]
    whole = A.span_hashes(data, start, start + count - 1 + length)
    return row[first], start, count, gram[where], A.mix(whole + (where - start).astype(np.uint64) * A.GOLDEN)


def _joined(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, with those that adjoin in one document as one."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(head)
    return doc[at], start[at], np.add.reduceat(n, at) if len(at) else n


def parse(docs: DataFrame, length: int) -> DataFrame:
    """The phrases of (doc_id, text); within an Arrow batch only the first of equal phrases, others as repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = np.asarray(batch.column(0)), []
            for i, j, data, offs in A.blocks(batch.column(1), 1 << 20):
                row, start, n, h, phrase = phrases(data, offs, length)
                parts.append((h, phrase, ids[i:j][row], start - offs[row], n))
            if not parts:
                continue
            h, phrase, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, doc, phrase, h))
            h, phrase, doc, start, n = h[order], phrase[order], doc[order], start[order], n[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (phrase[1:] != phrase[:-1])
            names = [x.split()[0] for x in PARSE_SCHEMA.split(", ")]
            a, b = np.flatnonzero(fresh), np.flatnonzero(~fresh)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), bool)), *(pa.array(x[a]) for x in (A.signed(h), A.signed(phrase), doc, start, n))], names=names)
            doc, start, n = _joined(doc[b], start[b], n[b])
            none = np.zeros(len(doc), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(doc), bool)), *map(pa.array, (none, none, doc, start, n))], names=names)
        A.release()

    return docs.mapInArrow(run, PARSE_SCHEMA)


def _phrase_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, start, body, hot) of the wanted phrases (doc_id, start, n, h, hot)."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "h", "hot")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8")
                out += [(x["h"], doc, x["start"], raw[x["start"] : x["start"] + x["n"] - 1 + length], x["hot"]) for x in w]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "doc_id", "start", "body", "hot"])

    held = docs.where("text is not null").join(by_doc, "doc_id").select("doc_id", "text", "w")
    return held.mapInArrow(run, "h long, doc_id long, start long, body binary, hot boolean")


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of the suffix at each place, compared on its first length bytes; equal ranks are equal strings.

    Ranks of eight bytes are doubled; the last step joins two that overlap. Places
    with fewer than length bytes behind them have ranks of no meaning.
    """
    n, width = len(data), min(8, length)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    eight = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64) >> U64(8 * (8 - width))
    rank = np.unique(eight, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]
        width += step
    return rank


def _windows(doc: np.ndarray, start: np.ndarray, body: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """(bytes, first byte, doc, place) of the windows of phrases in suffix order, equal ones in corpus order, and which equal the one before."""
    data, offs = A.binary_parts(body)
    sizes = np.maximum(np.diff(offs) - length + 1, 0)
    at, row = A.ragged(offs[:-1], sizes), np.repeat(np.arange(len(sizes)), sizes)
    rank = suffix_ranks(data, length)[at]
    doc, place = doc[row], start[row] + at - offs[row]
    order = np.lexsort((place, doc, rank))
    rank, doc, place, at = rank[order], doc[order], place[order], at[order]
    same = np.zeros(len(at), dtype=bool)
    same[1:] = rank[1:] == rank[:-1]
    return data, at, doc, place, same


def _later(body: DataFrame, length: int, buffer: int = 4 << 20) -> DataFrame:
    """Runs of windows that stand earlier in another phrase of the same trigger hash.

    Rows come sorted by h; whole groups are resolved together, about buffer bytes
    at once. Only groups of a bounded number of phrases come here.
    """

    def resolve(rows: pa.Table) -> pa.RecordBatch:
        doc, start = (np.asarray(rows.column(c)) for c in ("doc_id", "start"))
        _, _, doc, place, same = _windows(doc, start, rows.column("body").combine_chunks(), length)
        doc, place, n = _joined(doc[same], place[same], np.ones(int(same.sum()), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                held.append(whole.slice(k, 1000))
                size += held[-1].column("body").nbytes
                if size >= buffer:
                    rows = pa.Table.from_batches(held)
                    h = np.asarray(rows.column("h"))
                    full = int(np.searchsorted(h, h[-1], side="left"))  # the last group may go on
                    if full:
                        yield resolve(rows.slice(0, full))
                    held = rows.slice(full).to_batches()
                    size = sum(b.column("body").nbytes for b in held)
        if held:
            yield resolve(pa.Table.from_batches(held))
        A.release()

    return body.repartition("h").sortWithinPartitions("h").mapInArrow(run, SPAN_SCHEMA)


def _later_hot(tables: Tables, body: DataFrame, length: int) -> DataFrame:
    """The same for trigger hashes of very many phrases: every window is dealt out by two hashes of its own bytes.

    Windows that repeat one of their own batch are resolved there, so a hot window is one row a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 8192):
                batch = whole.slice(k, 8192)
                data, at, doc, place, same = _windows(np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3), length)
                new, none = ~same, np.zeros(int(same.sum()), np.int64)
                one, two = (A.signed(A.span_hashes(data, at[new], at[new] + length, seed)) for seed in (0, 1))
                columns = (np.concatenate([none, one]), np.concatenate([none, two]), np.concatenate([doc[same], doc[new]]), np.concatenate([place[same], place[new]]), np.arange(len(at)) < len(none))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["one", "two", "doc_id", "start", "again"])
        A.release()

    windows = tables.write(body.mapInArrow(run, "one long, two long, doc_id long, start long, again boolean"), "windows")
    place = F.struct(F.col("doc_id").alias("d"), F.col("start").alias("s"))
    new = windows.where("not again")
    first = tables.write(new.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first-windows")
    later = new.join(first, ["one", "two"]).where(place > F.col("first"))
    return windows.where("again").select("doc_id", "start").unionByName(later.select("doc_id", "start")).withColumn("n", F.lit(1).cast("long"))


def repeats(tables: Tables, docs: DataFrame, length: int, hot: int = 4096) -> DataFrame:
    """(doc_id, start, n): runs of windows that also start earlier in the corpus, of (doc_id, text) with one row an id."""
    parsed = tables.write(parse(docs, length), "parse")
    # phrases that repeat one of their batch are gone, so a phrase has one row a batch at most
    place = F.row_number().over(W.partitionBy("h", "phrase").orderBy("doc_id", "start"))
    names = ["first", "h", "doc_id", "start", "n"]
    ranked = parsed.where("not repeat").withColumn("first", place == 1).select(*names)
    ranked = tables.write(ranked.unionByName(parsed.where("repeat").withColumn("first", F.lit(False)).select(*names)), "ranked")
    tables.drop("parse")
    whole, dictionary = ranked.where("not first").select("doc_id", "start", "n"), ranked.where("first")
    # written before it is joined, so that a trigger of very many phrases can be split
    kinds = tables.write(dictionary.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    shared = dictionary.join(kinds, "h").withColumn("hot", F.col("kinds") > hot)
    body = tables.write(_phrase_bytes(docs, shared, length), "body")
    parts = _later(body.where("not hot").drop("hot"), length)
    return whole.unionByName(parts).unionByName(_later_hot(tables, body.where("hot").drop("hot"), length))


def _merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte runs covered by the windows."""
    out: list[list[int]] = []
    for a, n in sorted((s["start"], s["n"]) for s in spans):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, length: int = 100, digest: bool = False) -> DataFrame:
    """What is left of each text without the bytes of strings of that length that also start earlier.

    (doc_id, n_bytes, n_removed, n_spans, kept), kept being the remaining bytes,
    or kept_sha256 if digest. Earlier is a smaller doc_id, or a smaller start in
    the same document. Null texts count as empty; texts shorter than length keep
    all. Rows with a null doc_id keep all and are matched with nothing. Rows that
    repeat a doc_id and its text are one document and are cut alike; of an id with
    several texts one takes part and the others keep all. Strings are compared by
    their bytes within a trigger, phrases and the windows of triggers with very many
    phrases by 128 bits of hashes. A text of any length is read whole. Other
    columns, whatever their names, are ignored.
    """
    tables = Tables(docs.sparkSession, "prefix-free")
    docs, used = keyed(tables, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = tables.write(repeats(tables, used, length), "spans")
    for name in ("ranked", "kinds", "body", "windows", "first-windows"):
        tables.drop(name)
    spans = found.groupBy(F.col("doc_id").alias(KEY)).agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                cuts = _merged(s, length) if s else []
                ends = [0, *(x for cut in cuts for x in cut), len(raw)]
                kept = b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2))
                out.append((len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest() if digest else kept))
            kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digest else "kept"
    kind = "string" if digest else "binary"
    return docs.join(spans, KEY, "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")
