"""Encoding of whole corpora with the public tokenizers."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the published pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The characters of Unicode's White_Space, the ASCII ones first.
ASCII_SPACE = "\t\n\x0b\x0c\r "
OTHER_SPACE = "\x85\xa0                　"

CACHE_FRAGMENTS = 150_000  # fragments kept per worker; at this many the cache starts anew
CACHE_CHARS = 64  # longer fragments are not kept
SLICE_CHARS = 4_000_000  # characters encoded between two output batches


def certain_cuts(vocabulary: list[bytes]) -> tuple[str, bool]:
    """The ASCII spaces before which every text may be cut after a non-space character, and whether texts may be cut
    between a digit and one of : . , as well.

    A place between two bytes is a certain cut if the pair occurs inside no vocabulary token: no token can then span it. A
    pair inside a token counts unless its left byte ends a white-space character there, as no cut is made after those. The
    splitting pattern agrees with these cuts in any context: it never joins a non-space character to a following space,
    nor digits to other classes, and looks ahead only within white space, which the cuts never divide.
    """
    seen = np.zeros((256, 256), bool)
    for token in vocabulary:
        for at in range(1, len(token)):
            left, right = token[at - 1], token[at]
            if right in ASCII_SPACE.encode():
                head = token[:at].decode("utf-8", "replace")
                if head[-1] in ASCII_SPACE or head[-1] in OTHER_SPACE:
                    continue
            seen[left, right] = True
    not_space = [b for b in range(256) if chr(b) not in ASCII_SPACE]
    spaces = "".join(c for c in ASCII_SPACE if not seen[not_space, ord(c)].any())
    digits = list(range(ord("0"), ord("9") + 1))
    others = [b for b in range(128) if b not in digits]
    return spaces, not seen[np.ix_(digits, others)].any()


class ByteLevel:
    """A byte-level BPE whose texts are cut at certain cuts; fragments are encoded on their own, repeated ones once."""

    def __init__(self, ranks_file: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        spaces, digits = certain_cuts(list(ranks))
        space, cut, uncut = (re.escape(x) for x in (ASCII_SPACE + OTHER_SPACE, spaces, "".join(c for c in ASCII_SPACE + OTHER_SPACE if c not in spaces)))
        word = rf"[{space}]*[^{space}]+(?:[{uncut}][{space}]*[^{space}]+)*|[{space}]+" if cut else r"(?s:.+)"
        number = rf"[{space}]*[0-9]+(?::[0-9]+)?(?=[:.,][0-9])|(?<=[0-9])[:.,][0-9]++(?![^\x00-\x7f])|" if cut and digits else ""
        self.fragments = re.compile(number + word).findall
        encode = self.encoding.encode_ordinary

        class Ids(dict):
            def __missing__(self, fragment: str) -> bytes:
                ids = np.array(encode(fragment), dtype=np.int32).tobytes()
                if len(fragment) <= CACHE_CHARS:
                    if len(self) >= CACHE_FRAGMENTS:
                        self.clear()
                    self[fragment] = ids
                return ids

        class Counts(dict):
            def __missing__(self, fragment: str) -> int:
                n = len(encode(fragment))
                if len(fragment) <= CACHE_CHARS:
                    if len(self) >= CACHE_FRAGMENTS:
                        self.clear()
                    self[fragment] = n
                return n

        self._ids, self._counts = Ids(), Counts()

    def ids(self, text: str) -> bytes:
        """The ids as int32 in native byte order."""
        return b"".join(map(self._ids.__getitem__, self.fragments(text)))

    def count(self, text: str) -> int:
        return sum(map(self._counts.__getitem__, self.fragments(text)))


class Whole:
    """A tokenizer whose texts are encoded in one piece: white space has no certain cuts there."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self._encode = lambda text: model.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype=np.int32).tobytes()

    def count(self, text: str) -> int:
        return len(self._encode(text))


#: The files of the tokenizers.
FILES = {
    "byte_bpe_50k": "byte_bpe_50k.tiktoken",
    "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken",
    "word_bpe_49k": "word_bpe_49k.json",
    "piece_bpe_32k": "piece_bpe_32k.model",
}


@lru_cache(maxsize=4)
def encoder(name: str, folder: str) -> ByteLevel | Whole:
    path = os.path.join(folder, FILES[name])
    return ByteLevel(path) if path.endswith(".tiktoken") else Whole(path)


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) of consecutive slices of about SLICE_CHARS characters."""
    start, part, size = 0, [], 0
    for text in texts:
        text = text.as_py()
        part.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield start, part
            start, part, size = start + len(part), [], 0
    if part:
        yield start, part


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): the token ids of each text, without special tokens; an empty list for an empty or null text.

    Texts are taken whole and unchanged. One pass without a shuffle, Arrow batches in and out; a worker holds a slice of
    SLICE_CHARS characters and a bounded cache, and a text of any length is one row of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            for start, part in slices(batch.column(1)):
                ids = [enc.ids(t) if t else b"" for t in part]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keep and tokens bigint: the number of ids that encode_corpus gives; 0 for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = [enc.count(t) if t else 0 for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*keep, "tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, tokens bigint")
