"""Packing of documents into training sequences by lexical retrieval."""

from __future__ import annotations

import itertools
import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm._shared import lean, leaning, written

#: Ends every document.
END = 1
#: White space as the vocabulary has it, and what only Python takes for it (``token_counts``).
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words that need neither normalisation across characters nor added tokens: Latin letters up to U+024F and ASCII, without "<|".
_PLAIN = re.compile(r"(?!.*<\|)[!-~\u00c0-\u024f]+")
#: Several such words with a space between them and without "<", in which there is nothing to look for.
_PLAINEST = re.compile(r"[ -;=-~\u00c0-\u024f]+").fullmatch
#: The vocabulary's own division of words (fixed), letters first: no other branch begins with one.
_PIECES = regex.compile(r"[\p{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words whose ids a task keeps; beyond, the store begins anew.
_WORDS = 600_000
#: Bytes of text that are divided at once.
_SLICE = 1 << 22
#: What a byte is part of: white space, a letter, a digit, a sign, or something that leaves its whole word to be divided later.
_GAP, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)


def _byte_kinds() -> np.ndarray:
    """The kind of each byte of UTF-8, for words of ASCII and the letters U+00C0 to U+00FF (byte C3 and one more); contractions and special strings stay whole."""
    kinds = np.full(256, _WHOLE, dtype=np.uint8)
    kinds[[*b"\t\n\v\f\r "]] = _GAP
    for b in {*range(33, 127)}.difference(b"'<"):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    kinds[[0xC3, *range(0x80, 0xC0)]] = _LETTER
    kinds[[0x97, 0xB7]] = _WHOLE  # multiplication and division signs
    return kinds


def _lower_bytes() -> np.ndarray:
    """Each byte of such a letter in lower case."""
    lower = np.arange(256, dtype=np.uint8)
    lower[[*range(65, 91), *range(0x80, 0x9F)]] += 32
    return lower


_KIND, _LOWER = _byte_kinds(), _lower_bytes()


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column in a row, and the bounds between values."""
    column = column.cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def divided(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Parts of texts that can be encoded each by itself: pieces in lower case of simple words (``_byte_kinds``), any other word as it is.

    Returns, for all parts in a row, the byte of those that are one ASCII
    character and 255 for the others, the others as strings, and the count of
    parts up to each text's end.
    """
    data, bounds = _laid_out(texts)
    kinds = _KIND[data]
    gap = kinds == _GAP
    start = np.append(True, gap[:-1])[: len(data)]
    start[bounds[:-1][bounds[:-1] < len(data)]] = True
    start &= ~gap
    if (kinds == _WHOLE).any():
        words = np.flatnonzero(start)
        whole = np.repeat(np.maximum.reduceat(kinds, words) == _WHOLE, np.diff(words, append=len(data)))
        kinds[words[0] :][whole & ~gap[words[0] :]] = _WHOLE
    start[1:] |= (kinds[1:] != kinds[:-1]) & ~gap[1:]
    start |= kinds == _DIGIT
    single = start & (data < 128)
    single[:-1] &= start[1:] | gap[1:]
    at = np.flatnonzero(start)
    one = np.where(single[at], data[at], np.uint8(255))
    kept = ~(gap | single)
    lowered = np.where(kinds == _LETTER, _LOWER[data], data)[kept]
    offsets = np.append(np.flatnonzero(start[kept]), len(lowered)).astype(np.int32)
    longer = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(lowered)])
    return one, longer, np.searchsorted(at, bounds[1:])


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others are code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words:
    """Ids by word for a vocabulary that drops white space and joins nothing across it.

    A text's ids are those of its words in a row, and a word's those of its
    pieces, so up to 600,000 pieces (of words that ``divided`` leaves whole:
    words) are kept with their ids while a task lasts. Arrow numbers the
    different ones, so only these are looked up; NumPy lays out the ids. Those
    of one byte have a fixed place. Those not seen before are merged in bulk:
    the same vocabulary as ranks, in which a zero byte stands for the end of a
    piece. Words outside plain Latin are left to the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        suffix = model["end_of_word_suffix"]

        def octets(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(letters[x] for x in (token[: -len(suffix)] if end else token)) + b"\0" * end

        ranks = {bytes([b]): len(model["merges"]) + 300 + b for b in range(256)} | {bytes([b, 0]): b for b in range(1, 256)}
        for rank, merge in enumerate(model["merges"]):
            ranks.setdefault(octets("".join(merge) if isinstance(merge, list) else merge.replace(" ", "")), rank + 256)
        self.ids_of = np.zeros(max(ranks.values()) + 1, dtype="<u4")
        for token, i in model["vocab"].items():
            if all(x in letters for x in token.removesuffix(suffix)) and (rank := ranks.get(octets(token))) is not None:
                self.ids_of[rank] = i
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(len(self.ids_of), dtype=bool)
        self.ends[[rank for octet, rank in ranks.items() if octet.endswith(b"\0")]] = True
        self.fixed = [*(self.tokenizer.encode(chr(b), add_special_tokens=False).ids for b in range(128)), [END]]
        self.clear()

    def clear(self) -> None:
        """Begins the store anew: ASCII by its own numbers, and at place 128 the end of a document, which no word is."""
        self.known: dict[str, int] = {}
        self.sizes = np.array([len(x) for x in self.fixed], dtype=np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.pool = np.array([i for x in self.fixed for i in x], dtype="<u4")

    def _learn(self, words: list[str]) -> np.ndarray:
        """Stores different words that aren't known yet; their places."""
        if _PLAINEST(" ".join(words)):
            plain, others = range(len(words)), []
        else:
            fit = [_PLAIN.fullmatch(w) is not None for w in words]
            plain, others = np.flatnonzero(fit).tolist(), np.flatnonzero(~np.array(fit)).tolist()
        ids = [np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype="<u4") for i in others]
        sizes = np.array([len(x) for x in ids], dtype=np.int32)
        order = np.array(others, dtype=np.int64)
        if plain:
            lowered = unicodedata.normalize("NFC", " ".join(words[i] for i in plain)).lower().split(" ")
            letters = np.fromiter(map(str.isalpha, lowered), dtype=bool, count=len(lowered))
            mixed = [_PIECES.sub("\\g<0>\0", w) for w in itertools.compress(lowered, ~letters)]
            pieces = np.append(np.ones(letters.sum(), dtype=np.int64), np.array([w.count("\0") for w in mixed], dtype=np.int64))
            ranks = self.merger.encode_to_numpy("".join([*(f"{w}\0" for w in itertools.compress(lowered, letters)), *mixed]), disallowed_special=())
            ids.append(self.ids_of[ranks])
            ends = np.flatnonzero(self.ends[ranks])[np.cumsum(pieces) - 1]
            sizes = np.append(sizes, np.diff(ends, prepend=-1).astype(np.int32))
            order = np.concatenate([order, np.array(plain)[letters], np.array(plain)[~letters]])
        places = np.empty(len(words), dtype=np.int32)
        places[order] = np.arange(len(self.sizes), len(self.sizes) + len(words))
        self.known.update(zip(words, places.tolist()))
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int32) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.concatenate([self.pool, *ids])
        return places

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row, each text's followed by ``END``, and the bounds between texts."""
        if len(self.known) > _WORDS:
            self.clear()
        places, longer, ends = divided(texts)
        coded = longer.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)  # much faster than a list
        of_word = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), dtype=np.int32, count=len(words))
        new = np.flatnonzero(of_word < 0)
        if len(new):
            fresh = words[new].tolist()
            of_word[new] = self._learn(fresh)
        places = places.astype(np.int32)
        places[places == 255] = of_word[coded.indices.to_numpy()]
        places = np.insert(places, ends, len(self.fixed) - 1)
        sizes = self.sizes[places]
        after = np.cumsum(sizes, dtype=np.int32)
        at = np.arange(after[-1], dtype=np.int32) + np.repeat(self.starts[places] - after + sizes, sizes)
        return self.pool[at], np.append(0, after[ends + np.arange(len(ends))])


@lru_cache(maxsize=1)
def _words(vocabulary: str) -> Words:
    return Words(vocabulary)


def public_vocabulary() -> str:
    """The place of the public vocabulary that production uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(texts: list[str], vocabulary: str) -> list[np.ndarray]:
    """The ids of whole texts, each followed by ``END``, by this worker's own word store."""
    if not texts:
        return []
    ids, bounds = _words(vocabulary).ids(pa.array(texts, pa.string()))
    return np.split(ids, bounds[1:-1])


def by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_SLICE`` bytes of a text column, a longer text by itself or as the last."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // _SLICE)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if end > start:
            yield batch.slice(start, end - start)


def count_documents(ids: np.ndarray, bounds: np.ndarray, counts: np.ndarray, at_once: int = 64) -> None:
    """Adds to counts in how many documents each id occurs; ``at_once`` (at most 255) documents have a table of flags."""
    for first in range(0, len(bounds) - 1, at_once):
        own = bounds[first : first + at_once + 1]
        seen = np.zeros((len(own) - 1, len(counts)), dtype=np.uint8)
        seen[np.repeat(np.arange(len(own) - 1), np.diff(own)), ids[own[0] : own[-1]]] = 1
        counts += seen.sum(axis=0, dtype=np.uint8)


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, part, ids binary, n, counts): the ids of every row as little-endian unsigned 16-bit (or 32-bit) numbers.

    part is a hash that also takes the row's place in its task, so that
    repeated rows don't fall together. counts is null, but each task adds one
    row that has nothing else: in how many of its documents each id occurs.
    """
    size = Tokenizer.from_file(vocabulary).get_vocab_size()
    width = "<u2" if size <= 1 << 16 else "<u4"
    names, kinds = ["doc_id", "place", "ids", "n", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean(_words(vocabulary)):
            yield from parts(batches)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, counts = 0, np.zeros(size, dtype=np.int64)
        for b in batches:
            for part in by_bytes(b, 1):
                ids, bounds = _words(vocabulary).ids(pc.fill_null(part.column(1), ""))
                n = part.num_rows
                kept = ids.astype(width)
                offsets = pa.py_buffer((bounds * kept.itemsize).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(kept)])
                count_documents(ids, bounds, counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(place, place + n)), packed, pa.array(np.diff(bounds), pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
                place += n
        if place:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, None, None, counts], kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, place long, ids binary, n long, counts array<long>")
    return found.select("doc_id", F.xxhash64("doc_id", "place", F.crc32("ids")).alias("part"), "ids", "n", "counts")


def _unpacked(ids: bytes | np.ndarray, n: int) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4")


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """In how many documents each id occurs; one number per id of the vocabulary."""
    rows = tokens.select(F.posexplode("counts").alias("id", "n")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


class Index:
    """A BM25 inverted index over one shard's documents, with corpus-wide statistics."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        sizes, flat = np.array([len(ids) for ids in docs]), np.concatenate(docs)
        pairs = np.repeat(np.arange(len(docs)) << 32, sizes) | flat
        pairs.sort()
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        tf = np.diff(first, append=len(pairs))
        of, terms = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
        weights = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[of] / mean))
        self.terms = np.split(terms, np.cumsum(np.bincount(of, minlength=len(docs)))[:-1])
        order = np.argsort(terms.astype(flat.dtype), kind="stable")  # of 16 bits: a radix sort
        self.docs, self.weights = of[order], weights[order]
        counts = np.bincount(terms, minlength=len(idf))
        self.last = np.cumsum(counts)
        self.first = self.last - counts
        self.n = len(docs)

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents, best score for the terms of ``doc`` first; ties by place."""
        terms = self.terms[doc]
        first, counts = self.first[terms], self.last[terms] - self.first[terms]
        at = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
        scores = np.bincount(self.docs[at], self.weights[at], minlength=self.n)
        found = np.flatnonzero(unused)
        return found[np.argsort(-scores[found], kind="stable")]


def fill(docs: list[np.ndarray], index: Index, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard.

    A sequence begins with what is left of the document cut last, or else with
    the first unused document, and takes that seed's best unused neighbours
    until it is full; the last one is cut. The final sequence, if short, is
    split into powers of two, which need no padding.
    """
    unused = np.ones(len(docs), dtype=bool)
    sequence, first, cut = 0, 0, None
    while True:
        if cut is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            cut = (first, 0)
            unused[first] = False
        taken: list[tuple[int, int, int]] = []
        room = length
        seed, start = cut
        cut = None
        ranked, at = None, 0
        doc = seed
        while True:
            n = min(room, len(docs[doc]) - start)
            taken.append((doc, start, n))
            room -= n
            if start + n < len(docs[doc]):
                cut = (doc, start + n)
            if not room:
                break
            if ranked is None:
                ranked = index.neighbours(seed, unused)
            if at == len(ranked):
                break
            doc, start = int(ranked[at]), 0
            unused[doc] = False
            at += 1
        left = length - room
        sizes = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1] if room else [length]
        for size in sizes:
            offset = 0
            while offset < size:
                doc, start, n = taken.pop(0)
                part = min(n, size - offset)
                yield doc, start, part, sequence, offset
                offset += part
                if part < n:
                    taken.insert(0, (doc, start + part, n - part))
            sequence += 1


def content_keys(tokens: DataFrame, frequency: np.ndarray, n: int, most: int = 500) -> DataFrame:
    """tokens with key, three ids by which documents of like content come near each other, and salt.

    They are the document's ids of the least document frequency, of those in
    two documents or more; missing ones are -1. Ties go to the smaller id. No
    more documents than the first id's frequency can have it first, so ids of
    more than ``most`` documents (-1: of n) are split by salt.
    """
    order = np.argsort(frequency, kind="stable")
    rank = np.full(len(order) + 1, len(order), dtype=np.int32)  # the last: none
    rank[order] = np.where(frequency[order] >= 2, np.arange(len(order)), len(order))
    handle = tokens.sparkSession.sparkContext.broadcast((np.append(order, -1), rank, np.append(frequency, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, rank, frequency = handle.value
        for b in batches:
            for part in by_bytes(b, 2):
                sizes = part.column(3).to_numpy()
                ends = np.cumsum(sizes)
                ranks = rank[_unpacked(_laid_out(part.column(2))[0], ends[-1])]
                ranks[ends - 1] = rank[-1]  # END
                keys = np.empty((len(sizes), 3), dtype=np.int32)
                for i in range(3):
                    least = np.minimum.reduceat(ranks, ends - sizes)
                    keys[:, i] = order[least]
                    ranks[ranks == np.repeat(least, sizes)] = rank[-1]
                salts = part.column(1).to_numpy() % -(-frequency[keys[:, 0]] // most)
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, 3, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, listed, pa.array(salts)], names=["doc_id", "part", "ids", "n", "key", "salt"])

    return tokens.select("doc_id", "part", "ids", "n").mapInArrow(leaning(run), "doc_id long, part long, ids binary, n long, key array<int>, salt long")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = 2048, shard_tokens: int = 400_000) -> DataFrame:
    """(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset): one row per piece of a document.

    Whole texts become ids of the vocabulary file plus ``END``; documents are
    cut freely, and every id lies in one piece. ids holds the piece's ids as
    little-endian unsigned 32-bit numbers. The documents are dealt by content
    (``content_keys``), ordered by it and cut into shards of about
    ``shard_tokens`` ids (a longer document is a shard with what came before);
    each shard is an inverted index of its own, scored by BM25 with document
    frequencies and mean length of the whole corpus. So a seed's neighbours
    come from its shard, which like documents share. Null text: empty, so END
    alone. A null doc_id is kept, and repeated rows are packed each on its own.
    An empty table gives an empty result. Only doc_id and text are read.
    """
    vocabulary = vocabulary or public_vocabulary()
    size = Tokenizer.from_file(vocabulary).get_vocab_size()
    table = written(tokenized(docs, vocabulary), "tokens")
    tokens = table.filter("n is not null")
    total, n = tokens.agg(F.sum("n"), F.count("*")).first()
    frequency = document_frequencies(table, size)
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
    mean = (total or 1) / max(1, n)
    handle = docs.sparkSession.sparkContext.broadcast(idf)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def shard(doc_ids: list, ids: list[np.ndarray], begin: int) -> tuple[pa.RecordBatch, int]:
        found = list(fill(ids, Index(ids, handle.value, mean), length))
        doc, start, size, sequence, offset = zip(*found)
        pieces = [ids[d][a : a + n].astype("<u4").tobytes() for d, a, n, _, _ in found]
        columns = [[doc_ids[d] for d in doc], start, size, pieces, [len(ids[d]) for d in doc], [begin + q for q in sequence], offset]
        kinds = [pa.binary() if c is pieces else pa.int64() for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), begin + sequence[-1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, doc_ids, ids, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, x, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                doc_ids.append(doc_id)
                ids.append(_unpacked(x, n))
                held += n
                if held >= shard_tokens:
                    out, begin = shard(doc_ids, ids, begin)
                    yield out
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield shard(doc_ids, ids, begin)[0]

    parts = max(1, math.ceil((total or 0) / (4 * shard_tokens)))
    dealt = content_keys(tokens, frequency, n).withColumn("first", F.col("key")[0]).repartition(parts, "first", "salt")
    dealt = dealt.sortWithinPartitions("first", "salt", "key", "part").select("doc_id", "ids", "n")
    return dealt.mapInArrow(leaning(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark, sf_dir):
    """All documents packed; edge cases as in ``pack``."""
    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
