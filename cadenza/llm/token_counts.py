"""Token counts of whole texts; words that are one token of the vocabulary are only looked up."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm._shared import lean
from cadenza.llm.packing import _PIECES, _PLAIN, _SEPARATORS, _SPACE, _byte_letters, public_vocabulary

#: Words whose counts a task keeps, of at most so many characters; beyond, the store begins anew.
_WORDS, _LONG = 600_000, 64


@lru_cache(maxsize=1)
def _tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary)


def whole_tokens(vocabulary: str) -> frozenset[str]:
    """The pre-tokens that the vocabulary encodes as one token, each proved by the library.

    A string of the vocabulary that can end a word is a candidate. It is kept
    if the normaliser leaves it as it is, the pre-tokenizer makes one piece of
    it, and its merges end in its own id; in a vocabulary of merges that isn't
    given, as an earlier merge can lead elsewhere.
    """
    tokenizer = _tokenizer(vocabulary)
    letters = _byte_letters()
    suffix = tokenizer.model.end_of_word_suffix or ""
    found = set()
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        piece = token.removesuffix(suffix)
        if not piece or not token.endswith(suffix) or any(x not in letters for x in piece):
            continue
        try:
            text = bytes(letters[x] for x in piece).decode("utf-8")
        except UnicodeDecodeError:  # part of a character
            continue
        if tokenizer.normalizer.normalize_str(text) == text and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [piece] and tokenizer.encode(text, add_special_tokens=False).ids == [i]:
            found.add(text)
    return frozenset(found)


class Counter:
    """Tokens by word, for a vocabulary that drops white space and joins nothing across it.

    A plain word (``packing``: Latin letters and ASCII, no special string) is
    normalised and divided into pre-tokens here; those in ``whole`` count one,
    only the others are merged. Any other word is left to the library.
    """

    def __init__(self, vocabulary: str, whole: frozenset[str]):
        self.tokenizer, self.whole = _tokenizer(vocabulary), whole
        self.known: dict[str, int] = {}
        self.merged = 0

    def _merge(self, pieces: list[str]) -> Iterator[int]:
        """The tokens of each piece, merged as one text with a space between them."""
        self.merged += len(pieces)
        encoded = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        return map(int, np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(pieces)))

    def _learn(self, words: set[str]) -> None:
        mixed: dict[str, list[str]] = {}
        rest: dict[str, int] = {}
        for word in words:
            if not _PLAIN.fullmatch(word):
                self.known[word] = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
                continue
            text = unicodedata.normalize("NFC", word).lower()
            if text in self.whole:
                self.known[word] = 1
                continue
            mixed[word] = pieces = _PIECES.findall(text)
            rest.update((p, 0) for p in pieces if p not in self.whole)
        if rest:
            rest = dict(zip(rest, self._merge(list(rest))))
        for word, pieces in mixed.items():
            self.known[word] = sum(rest.get(p, 1) for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        """The tokens of whole texts."""
        if len(self.known) > _WORDS:
            self.known.clear()
        split = [_SPACE.split(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        fresh = set().union(*split).difference(self.known)
        self._learn(fresh)
        tokens = self.known.__getitem__
        found = [sum(map(tokens, words)) for words in split]
        for word in fresh:
            if len(word) > _LONG:
                del self.known[word]
        return found


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    n_tokens: as the library ``tokenizers`` encodes the whole text, without
    begin, end or added special tokens; special strings inside a text count as
    it treats them by default. over_limit: more than limit tokens. The proof of
    whole tokens is made once by the driver and bounded by the vocabulary. No
    row leaves its partition.

    A null text counts as an empty one, 0 bytes and 0 tokens; null and repeated
    doc_ids and repeated rows are kept. Very long words are counted without
    being stored. An empty table gives an empty result. Only doc_id and text
    are read, so other columns can't clash.
    """
    whole = whole_tokens(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, whole)
        with lean(counter.known):
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    part = b.slice(at, 100)
                    counts = counter.counts(part.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir):
    """Every document's bytes and tokens; edge cases as in ``token_counts``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
