"""BPE encoding and decoding through a pair occurrence index.

The distinct words of a block of texts are laid out as one array of symbols. The
index maps each adjacent pair to all its positions; the ranks of pairs that occur
are taken in ascending order, every position of the pair is merged, and only the
lists of the neighbouring pairs are updated. Ids equal those of the reference
tokenizer for the supported form: NFC, lower case, a splitting pattern, byte
alphabet, an end-of-word suffix.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from corpuscle.llm import _arrays as A
from corpuscle.llm.pretokens import PartIds, PretokenIds


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = (b for b in range(256) if b not in set(printable))
    stand_in = dict(zip(others, range(256, 512), strict=False))
    return [chr(b if b in set(printable) else stand_in[b]) for b in range(256)]


class WordBpe:
    """A word-level BPE of a tokenizer file: encode and decode."""

    def __init__(self, spec: str) -> None:
        held = json.loads(spec)
        model = held["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = (self.vocab[a], self.vocab[b])
            if key not in self.merges:
                self.merges[key] = (rank, self.vocab[a + b])
        steps = held["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        # scripts whose character data may be of another Unicode version here than in the reference tokenizer
        self.other_split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.other_form = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s\x1c-\x1fa-z0-9]+|[\x1c-\x1f]+", re.ASCII)
        self.alphabet = byte_alphabet()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.store = PretokenIds(self.encode_words, 100_000)
        self.parts = PartIds(600_000)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens stand as they are, between NULs that no other word holds."""
        if self.cut is not None and self.cut.search(text):
            out = []
            for k, part in enumerate(self.cut.split(text)):
                out += [f"\0{part}\0"] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() and not _ODD.search(text):
            return self.ascii.findall(text.lower())
        if _OTHER.search(text):
            return [w for w, _ in self.other_split.pre_tokenize_str(self.other_form.normalize_str(text))]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final form
        return self.split.findall(text.lower())

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: all words of the list are merged together, rank by rank."""
        symbols: list[int] = []
        ends: list[int] = []
        known: dict[int, list[int]] = {}
        first: list[int] = []
        vocab, alphabet, suffix = self.vocab, self.alphabet, self.suffix
        for k, w in enumerate(words):
            first.append(len(symbols))
            if w[0] == "\0" and w[-1] == "\0" and w[1:-1] in self.special:
                known[k] = [self.special[w[1:-1]]]
                ends.append(len(symbols))
                continue
            raw = w.encode("utf-8")
            symbols += [vocab[alphabet[b]] for b in raw[:-1]]
            symbols.append(vocab[alphabet[raw[-1]] + suffix])
            ends.append(len(symbols))
        self._merge(symbols, first, ends)
        return [known[k] if k in known else [s for s in symbols[a:b] if s >= 0] for k, (a, b) in enumerate(zip(first, ends, strict=True))]

    def _merge(self, symbols: list[int], first: list[int], ends: list[int]) -> None:
        """Merges in place; positions that were merged into the one before hold -1."""
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, b in zip(first, ends, strict=True):
            if a < b:
                before[a], after[b - 1] = -1, -1
        index: dict[tuple[int, int], list[int]] = {}
        for p in range(n):
            q = after[p]
            if q >= 0:
                pair = (symbols[p], symbols[q])
                if pair in merges:
                    if pair in index:
                        index[pair].append(p)
                    else:
                        index[pair] = [p]
        active = [(merges[pair][0], pair) for pair in index]
        heapq.heapify(active)
        while active:
            rank, pair = heapq.heappop(active)
            places = index.pop(pair, None)
            if places is None:
                continue
            a, b = pair
            new = merges[pair][1]
            places.sort()
            for k, p in enumerate(places):
                q = after[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = new, -1
                r = after[q]
                after[p] = r
                lower = False
                if r >= 0:
                    before[r] = p
                    joined = (new, symbols[r])
                    if joined in merges:
                        if joined in index:
                            index[joined].append(p)
                        else:
                            index[joined] = [p]
                            heapq.heappush(active, (merges[joined][0], joined))
                        lower |= merges[joined][0] < rank
                o = before[p]
                if o >= 0:
                    joined = (symbols[o], new)
                    if joined in merges:
                        if joined in index:
                            index[joined].append(o)
                        else:
                            index[joined] = [o]
                            heapq.heappush(active, (merges[joined][0], joined))
                        lower |= merges[joined][0] < rank
                if lower and k + 1 < len(places):  # a lower rank has become active: it comes first
                    index.setdefault(pair, []).extend(places[k + 1 :])
                    heapq.heappush(active, (rank, pair))
                    break

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row pointer) of a block of texts; no pre-token goes across white space, so parts between it are looked up."""
        start, end, ptr = A.word_spans(data, offs)

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = data.tobytes()
            rows = [self.words(raw[a:b].decode("utf-8")) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self.store.learn(rows)
            counts = np.fromiter((len(r) for r in rows), np.int64, len(rows))
            ids, sizes = self.store.all_ids([w for r in rows for w in r])
            return ids, np.bincount(np.repeat(np.arange(len(rows)), counts), weights=sizes, minlength=len(rows)).astype(np.int64)

        ids, sizes = self.parts.ids(data, start, end, encode)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[ptr]

    def encode_texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null counts as empty."""
        ids, ptr = self.encode_block(*A.binary_parts(pa.array(texts, pa.large_string())))
        for a, b in zip(ptr[:-1], ptr[1:], strict=True):
            yield ids[a:b]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: tokens with a space between them, as without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


#: ASCII that the fast path leaves to the full pattern: the separators FS to US, and NUL.
_ODD = re.compile("[\x00\x1c-\x1f]")
_OTHER = re.compile("[^\x00-\u04ff]")


@lru_cache(maxsize=2)
def _loaded(spec: str) -> WordBpe:
    """One tokenizer for all tasks of a Python worker, with the words that it has met."""
    return WordBpe(spec)


def encode(docs: DataFrame, tokenizer: str, block_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text by the tokenizer file at that path of the driver.

    A null or empty text has no ids. Rows are independent: repeated ids and rows
    stay as they are. Other columns are ignored.
    """
    return _mapped(docs, tokenizer, block_bytes, False)


def digests(docs: DataFrame, tokenizer: str, block_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, with digests in place of ids and text."""
    return _mapped(docs, tokenizer, block_bytes, True)


def _mapped(docs: DataFrame, tokenizer: str, block_bytes: int, short: bool) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in batches:
            for i, j, data, offs in A.blocks(batch.column(1), block_bytes):
                docs_ids = batch.column(0).slice(i, j - i)
                ids, ptr = bpe.encode_block(data, offs)
                rows = [ids[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                decoded = map(bpe.decode, rows)
                if short:
                    digests = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in rows]
                    columns = [pa.array(list(map(len, rows)), pa.int64()), pa.array(digests, pa.string())]
                    columns.append(pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded], pa.string()))
                else:
                    columns = [A.list_column(ids, ptr, pa.int32()), pa.array(decoded, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if short else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([docs_ids, *columns], names=["doc_id", *names])
        A.release()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if short else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
