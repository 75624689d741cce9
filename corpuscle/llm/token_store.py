"""A content-addressed store of token ids: rolling-hash chunks, recipes and Merkle manifests.

Texts are encoded, ended by one id, and cut into chunks where a rolling hash of
the last ids says so; a chunk is named by a 128-bit digest of its ids and stored
once. A recipe lists the chunks of a document and the digest of that list. The
manifest is a Merkle tree over the recipes of each bucket of ascending doc_id: a
node digests up to FAN recipes or nodes below it, and one root digests the tops of
all buckets, so that no group that is digested at once grows with the data. All
are Parquet tables, so the store lives wherever Spark can write.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from corpuscle.llm import _arrays as A
from corpuscle.llm.pretokens import PartIds

U64 = np.uint64
WINDOW, MEAN_BITS, LONGEST, FAN = 4, 8, 4096, 1024


class ByteBpe:
    """Ids of texts by the tokenizers library, by way of their distinct parts.

    A single space or line end between two visible characters always begins a
    pre-token of the byte-level pattern, so a text without other white space is
    cut before each of them. Parts are told apart by two 64-bit hashes; those
    not met before are encoded by the library, many in one text. Texts that can't
    be cut so are given to the library whole.
    """

    def __init__(self, spec: str, most: int = 1_200_000) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of each token; its letters stand for bytes
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.roll = A.mix(np.arange(1, len(self.width) + 1, dtype=np.uint64) * A.GOLDEN)  # what each id adds to the rolling hash
        self.store = PartIds(most)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _uneven(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which texts can't be cut at single spaces and line ends."""
        space = (data == 32) | (data == 10)
        odd = (data < 32) & ~space | (data == 127) | (data >= 0xD4)
        follow = np.zeros(len(data), dtype=bool)
        follow[:-1] = space[:-1] & space[1:] | (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
        edge = np.zeros(len(data), dtype=bool)
        sizes = np.diff(offs)
        edge[offs[:-1][sizes > 0]] = True
        edge[offs[1:][sizes > 0] - 1] = True
        bad = odd | follow | edge & space
        for s in self.special:
            if len(data) >= len(s):
                hit = data[: len(data) - len(s) + 1] == s[0]
                for k in range(1, len(s)):
                    hit = hit & (data[k : len(data) - len(s) + 1 + k] == s[k])
                bad[: len(hit)] |= hit
        total = np.concatenate([[0], np.cumsum(bad)])
        return total[offs[1:]] > total[offs[:-1]]

    def _parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers) of parts, encoded many in one text; a part that no space leads is a text of its own."""
        led = (data[start] == 32) | (data[start] == 10)
        order = np.concatenate([np.flatnonzero(led), np.flatnonzero(~led)])
        n_led, size = int(led.sum()), (end - start)[order]
        raw = data[A.ragged(start[order], size)].tobytes()
        ends = np.cumsum(size)
        groups = [(a, min(a + 400, n_led)) for a in range(0, n_led, 400)] + [(k, k + 1) for k in range(n_led, len(order))]
        encoded = self._whole([raw[ends[a] - size[a] : ends[b - 1]].decode("utf-8") for a, b in groups])
        ids = np.fromiter((i for x in encoded for i in x), np.int64)
        reached = np.cumsum(self.width[ids])
        last = np.searchsorted(reached, ends)
        if not (len(ids) and last[-1] < len(reached) and (reached[last] == ends).all()):
            raise ValueError("tokens don't end where parts do")
        counts = np.diff(np.concatenate([[-1], last]))
        where = np.argsort(order)  # back into the order of the parts
        return ids[A.ragged((np.cumsum(counts) - counts)[where], counts[where])], counts[where]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row pointer) of a block of texts."""
        rows = len(offs) - 1
        uneven = self._uneven(data, offs)
        even = np.flatnonzero(~uneven & (np.diff(offs) > 0))
        counts, pieces = np.zeros(rows, np.int64), []
        if len(even):
            cut = (data == 32) | (data == 10)
            cut[offs[:-1][np.diff(offs) > 0]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))
            row = np.searchsorted(offs, start, side="right") - 1
            keep = ~uneven[row]
            start, end, row = start[keep], end[keep], row[keep]
            ids, size = self.store.ids(data, start, end, lambda new: self._parts(data, start[new], end[new]))
            pieces.append(ids)
            counts += np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        whole = np.flatnonzero(uneven)
        ids = pieces[0] if pieces else np.zeros(0, np.int64)
        if len(whole):
            others = self._whole([data[offs[r] : offs[r + 1]].tobytes().decode("utf-8") for r in whole])
            counts[whole] = [len(x) for x in others]
            ptr = np.concatenate([[0], np.cumsum(counts)])
            out = np.zeros(int(ptr[-1]), np.int64)
            out[A.ragged(ptr[even], counts[even])] = ids
            for r, x in zip(whole, others, strict=True):
                out[ptr[r] : ptr[r + 1]] = x
            ids = out
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def _loaded(spec: str) -> ByteBpe:
    """One tokenizer for all tasks of a Python worker; a task has one core, so the library gets one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(spec)


def chunk_ends(ids: np.ndarray, doc_ends: np.ndarray, roll: np.ndarray) -> np.ndarray:
    """Where chunks end in a stream of ids: by content, at the end of documents, and after LONGEST ids; roll has a value for each id."""
    x = roll[ids]
    h = x.copy()
    for k in range(1, WINDOW):
        h[k:] += x[: len(x) - k] * U64(2 * k + 1)
    cut = np.flatnonzero((A.mix(h) >> U64(64 - MEAN_BITS)) == 0) + 1
    ends = np.unique(np.concatenate([cut, doc_ends]))
    ends = ends[ends > 0]
    gaps = np.diff(np.concatenate([[0], ends]))
    if len(gaps) and gaps.max() > LONGEST:
        extra = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
        ends = np.unique(np.concatenate([ends, *extra]))
    return ends


def _ids(body: bytes) -> np.ndarray:
    """The ids of a chunk: its first byte says how wide they are."""
    return np.frombuffer(body, f"<u{body[0]}", offset=1)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


STAGED = "kind string, doc_id long, n_tokens long, root binary, chunks array<binary>, ends array<int>, ids binary"
_STAGED = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()),
    ("chunks", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("ids", pa.binary()),
])


_RECIPE = pa.schema([("bucket", pa.int32()), ("seq", pa.int64()), *(f for f in _STAGED if f.name not in ("kind", "ids"))])


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _STAGED], schema=_STAGED)


def _staged(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, met, packer = _loaded(spec.value), set(), zstandard.ZstdCompressor(level=1)
        if not 0 <= end_id < len(bpe.roll):
            raise ValueError(f"the end id {end_id} is not in the vocabulary")
        width = 2 if len(bpe.roll) <= 1 << 16 else 4
        lead = bytes([width])
        for batch in batches:
            for i, j, data, offs in A.blocks(batch.column(1), 2 << 20):
                ids, ptr = bpe.encode(data, offs)
                sizes = np.diff(ptr) + 1
                doc_ends = np.cumsum(sizes)
                stream = np.full(int(doc_ends[-1]), end_id, dtype=f"<u{width}")
                keep = np.ones(len(stream), dtype=bool)
                keep[doc_ends - 1] = False
                stream[keep] = ids
                ends = chunk_ends(stream, doc_ends, bpe.roll)
                raw, a, names, fresh = stream.tobytes(), 0, [], {}
                for b in ends.tolist():
                    body = lead + raw[width * a : width * b]
                    name = hashlib.blake2b(body, digest_size=16).digest()
                    names.append(name)
                    if name not in met and name not in fresh:
                        fresh[name] = packer.compress(body)
                    a = b
                last = np.searchsorted(ends, doc_ends, side="left") + 1
                first = np.concatenate([[0], last[:-1]])
                lists = [names[p:q] for p, q in zip(first, last, strict=True)]
                starts = doc_ends - sizes
                own_ends = [(ends[p:q] - s).astype(np.int32) for p, q, s in zip(first, last, starts, strict=True)]
                n = j - i
                yield _rows(kind=["recipe"] * n, doc_id=batch.column(0).slice(i, n).to_pylist(), n_tokens=sizes.tolist(), root=[_digest(*x) for x in lists], chunks=lists, ends=own_ends)
                if fresh:
                    yield _rows(kind=["chunk"] * len(fresh), root=list(fresh), ids=list(fresh.values()))
                if len(met) < 200_000:  # names met in this task; what is missed here is made unique later
                    met.update(fresh)
        A.release()

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: set[bytes] = set()  # those of one partition
        for batch in batches:
            keep = []
            for kind, root in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(kind != "chunk" or root not in names)
                if kind == "chunk":
                    names.add(root)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # a recipe goes by its document, a chunk by its name: equal chunks meet, and each is kept once
    key = F.when(F.col("kind") == "chunk", F.xxhash64("root")).otherwise(F.xxhash64("doc_id", "n_tokens"))
    return docs.mapInArrow(run, STAGED).repartition(key).mapInArrow(unique, STAGED)


def _ordered(recipes: DataFrame, buckets: int) -> DataFrame:
    """Recipes in ascending doc_id order with bucket and seq, and the nodes of each bucket's tree.

    Of a node seq is minus its level (1: above recipes), doc_id its place in the
    level, n_tokens that of all below it, and ends the number of recipes below it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seq = TaskContext.get().partitionId(), 0
        open_nodes: list[list[tuple[bytes, int, int]]] = [[]]  # by level: (digest, tokens, recipes) of children not yet under a node
        done: list[int] = []
        nodes: list[dict] = []

        def close(level: int) -> None:
            """Puts the open children of a level under a node of the next."""
            if level + 1 == len(open_nodes):
                open_nodes.append([])
                done.append(0)
            children = open_nodes[level]
            root, tokens, docs = _digest(*(c[0] for c in children)), sum(c[1] for c in children), sum(c[2] for c in children)
            nodes.append({"bucket": bucket, "seq": -1 - level, "doc_id": done[level], "n_tokens": tokens, "root": root, "chunks": None, "ends": [docs]})
            done[level] += 1
            open_nodes[level] = []
            open_nodes[level + 1].append((root, tokens, docs))
            if len(open_nodes[level + 1]) == FAN:
                close(level + 1)

        for batch in batches:
            n = batch.num_rows
            for root, tokens in zip(batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                open_nodes[0].append((root, tokens, 1))
                if len(open_nodes[0]) == FAN:
                    close(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(np.arange(seq, seq + n)), *batch.columns], names=["bucket", "seq", *batch.schema.names])
            seq += n
            if nodes:
                yield pa.RecordBatch.from_pylist(nodes, schema=_RECIPE)
                nodes.clear()
        level = 0
        while seq and (level == 0 or level + 1 < len(open_nodes) or len(open_nodes[level]) > 1):
            if open_nodes[level]:
                close(level)
            level += 1
        if nodes:
            yield pa.RecordBatch.from_pylist(nodes, schema=_RECIPE)

    ordered = recipes.select("doc_id", "n_tokens", "root", "chunks", "ends").repartitionByRange(buckets, "doc_id").sortWithinPartitions("doc_id", "root")
    return ordered.mapInArrow(run, "bucket int, seq long, doc_id long, n_tokens long, root binary, chunks array<binary>, ends array<int>")


class TokenStore:
    """Tables ordered (recipes and manifest), parts (chunks) and root below one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, docs: DataFrame, tokenizer: str, end_id: int = 0, buckets: int | None = None) -> TokenStore:
        """Stores (doc_id, text) in ascending doc_id order; a null or empty text is the end id alone.

        Documents of equal doc_id follow each other, those without one come first;
        repeated rows are documents of their own. A text of any length is cut into
        chunks of LONGEST ids at most. Other columns, whatever their names, are ignored.
        """
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        buckets = buckets or max(8, docs.rdd.getNumPartitions())
        packed = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
        _staged(docs, tokenizer, end_id).write.options(**packed).parquet(f"{self.path}/parts")
        recipes = self.spark.read.schema(STAGED).parquet(f"{self.path}/parts").where("kind = 'recipe'")
        _ordered(recipes, buckets).write.options(**packed).parquet(f"{self.path}/ordered")
        self.spark.createDataFrame([self._root()], "n_buckets long, root binary").write.parquet(f"{self.path}/root")
        self._collect_garbage()
        return self

    def recipes(self) -> DataFrame:
        return self.table("ordered").where("seq >= 0")

    def chunks(self) -> DataFrame:
        """(chunk, ids): every chunk by its name, once."""
        rows = self.spark.read.schema(STAGED).parquet(f"{self.path}/parts").where("kind = 'chunk'")
        return rows.select(F.col("root").alias("chunk"), "ids")

    def manifest(self) -> DataFrame:
        """(bucket, n_docs, n_tokens, root): the top of each bucket's tree."""
        tops = self.table("ordered").where("seq < 0").groupBy("bucket").agg(F.min_by(F.struct("ends", "n_tokens", "root"), "seq").alias("x"))
        return tops.select("bucket", F.col("x.ends")[0].cast("long").alias("n_docs"), "x.n_tokens", "x.root")

    def _root(self) -> tuple[int, bytes]:
        """How many buckets there are, and the digest of their tops; buckets are as many as the partitions of a write."""
        tops = sorted((r["bucket"], bytes(r["root"])) for r in self.manifest().collect())
        return len(tops), _digest(*(t for _, t in tops))

    def _collect_garbage(self) -> None:
        self.spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of finished jobs

    def chunk_digests(self) -> DataFrame:
        """(chunk, n, crc) of every stored chunk, read and verified against its name; crc is of 32-bit ids."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                names, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sizes, crcs = [], []
                for name, body in zip(names, map(unpack, bodies), strict=True):
                    if hashlib.blake2b(body, digest_size=16).digest() != name:
                        raise ValueError(f"chunk {name.hex()} does not have its digest")
                    ids = _ids(body)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["chunk", "n", "crc"])

        return self.chunks().mapInArrow(run, "chunk binary, n long, crc long")

    def verify(self) -> bool:
        """If recipes have their digests, nodes those of what is below them, and the root that of all buckets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bucket, seq, tokens, chunks, root, ends = (batch.column(k).to_pylist() for k in range(6))
                good = [s < 0 or _digest(*c) == r and e[-1] == t and len(c) == len(e) for s, t, c, r, e in zip(seq, tokens, chunks, root, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 6, 2, 4)), pa.array(good)], names=["bucket", "seq", "place", "n_tokens", "root", "good"])

        @arrow_udf("binary")
        def merkle(lists: pa.Array) -> pa.Array:
            return pa.array([_digest(*x) for x in lists.to_pylist()], pa.binary())

        if tuple(map(lambda r: (r["n_buckets"], bytes(r["root"])), self.table("root").collect())) != (self._root(),):
            return False
        place = F.when(F.col("seq") < 0, F.col("doc_id")).otherwise(F.col("seq")).alias("place")
        rows = self.table("ordered").select("bucket", "seq", "n_tokens", "chunks", "root", "ends", place)
        rows = rows.mapInArrow(run, "bucket int, seq long, place long, n_tokens long, root binary, good boolean")
        rows = rows.withColumn("level", F.greatest(F.lit(0), -F.col("seq")))
        above = rows.groupBy("bucket", (F.col("level") + 1).alias("level"), F.expr(f"place div {FAN}").alias("place")).agg(
            F.sort_array(F.collect_list(F.struct("place", "root"))).alias("r"), F.sum("n_tokens").alias("below"), F.every("good").alias("good")
        )
        above = above.select("bucket", "level", "place", "below", "good", F.size("r").alias("n"), merkle(F.transform("r", lambda x: x["root"])).alias("top"))
        nodes = rows.where("level > 0").select("bucket", "level", "place", "n_tokens", "root")
        joined = above.join(nodes, ["bucket", "level", "place"], "full")
        # what has no node above it: the top of a bucket, which stands alone in its level
        alone = F.col("root").isNull() & F.col("good") & (F.col("n") == 1) & (F.col("place") == 0) & (F.col("level") > 1)
        right = F.col("good") & (F.col("top") == F.col("root")) & (F.col("below") == F.col("n_tokens"))
        return not joined.where(~F.coalesce(alone | F.coalesce(right, F.lit(False)), F.lit(False))).limit(1).count()

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

        Manifest and recipes are verified first, chunks while they are read; a store
        with a part that is missing or changed raises an error.
        """
        if not self.verify():
            raise ValueError(f"recipes and manifest of {self.path} don't agree")
        order = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        offsets = self.manifest().select("bucket", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("offset"))
        recipes = self.recipes()
        within = W.partitionBy("bucket").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
        places = recipes.select("bucket", "seq", "doc_id", F.col("n_tokens").alias("stated"), F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before")).join(offsets, "bucket")
        parts = recipes.select("bucket", "seq", F.col("n_tokens").alias("whole"), F.explode(F.arrays_zip("chunks", "ends")).alias("x"))
        parts = parts.select("bucket", "seq", F.col("x.chunks").alias("chunk"), (4 * (F.col("whole") - F.col("x.ends"))).alias("after"))
        joined = parts.join(self.chunk_digests(), "chunk").select("bucket", "seq", "n", shifted_crc(F.col("crc"), F.col("after")).alias("crc"))
        whole = joined.groupBy("bucket", "seq").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
        found = F.when(F.col("n_tokens") == F.col("stated"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("chunks of a recipe are missing")).cast("long"))
        return places.join(whole, ["bucket", "seq"], "left").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), found.alias("n_tokens"), "ids_crc32")

    def ids(self, doc_ids: DataFrame) -> DataFrame:
        """(doc_id, ids) of the documents named in doc_ids (doc_id), put together from their chunks."""

        @arrow_udf("array<int>")
        def unpack(lists: pa.Array) -> pa.Array:
            whole = zstandard.ZstdDecompressor().decompress
            return pa.array([np.concatenate([_ids(whole(c)) for c in x]).astype(np.int32) for x in lists.to_pylist()], pa.list_(pa.int32()))

        wanted = self.recipes().join(doc_ids.select("doc_id").distinct(), "doc_id")
        parts = wanted.select("bucket", "seq", "doc_id", F.posexplode("chunks").alias("k", "chunk")).join(self.chunks(), "chunk")
        lists = parts.groupBy("bucket", "seq", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x"))
        return lists.select("doc_id", unpack(F.transform("x", lambda x: x["ids"])).alias("ids"))


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """[k][byte][value]: the CRC-32 state after 2**k zero bytes, by bytes of the state."""
    one = np.arange(256, dtype=np.uint32)
    step = one.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    first = np.stack([step, *((one << np.uint32(8 * b - 8)) for b in (1, 2, 3))])

    def apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]

    tables = [first]
    for _ in range(47):
        tables.append(np.stack([apply(tables[-1], apply(tables[-1], one << np.uint32(8 * b))) for b in range(4)]))
    return np.stack(tables)


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC-32 adds to that of a longer text that has n_bytes after the part."""
    out, tables = crc.astype(np.uint32), _shift_tables()
    for k in range(48):
        at = np.flatnonzero((n_bytes >> k) & 1)
        if len(at):
            x, t = out[at], tables[k]
            out[at] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
    return out


@arrow_udf(LongType())
def shifted_crc(crc: pa.Array, n_bytes: pa.Array) -> pa.Array:
    return pa.array(shift_crc(np.asarray(crc), np.asarray(n_bytes)).astype(np.int64))
