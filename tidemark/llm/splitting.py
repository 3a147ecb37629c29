"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.tokens import TOKENIZERS, ByteLevel, encoder

#: Strength of a boundary: within a word, at a word's end, at a line's end, between cues, between cues after a sentence.
INSIDE, WORD, LINE, CUE, SENTENCE = range(5)
KINDS = ("inside", "word", "line", "cue", "sentence")

FRAMES = re.compile(r"\s*[\[{][0-9]+[\]}]")  # a dialect with one cue a line
NEWLINE = re.compile(r"(?<=[^\s])(?=[ \t]*[\r\n])")
SPACE = re.compile(r"(?<=[^\s])(?=[ \t\r\n])")
ENDS = tuple(".!?…。！？\"”»")


@dataclass(frozen=True)
class SplitRule:
    """limit: most tokens of a piece; overlap: tokens that a piece repeats of the one before it; slack: tokens that a cut
    piece stays under limit, since its text may take a few tokens more when it is encoded on its own. A text with a piece
    that takes more than limit nevertheless is split again with a greater slack."""

    limit: int = 600
    overlap: int = 50
    slack: int = 4

    @property
    def room(self) -> int:
        return self.limit - self.slack


def cues(text: str) -> list[str]:
    """text cut before blank lines, in the dialect with one cue a line before each line; only where a non-space character
    stands before the cut, so that all cuts are certain."""
    end = "\r\n" if "\r\n" in text else "\r" if "\r" in text and "\n" not in text else "\n"
    gap = end if FRAMES.match(text) else end + end
    at, cuts, step = text.find(gap), [0], len(gap)
    while at >= 0:
        if at and not text[at - 1].isspace():
            cuts.append(at)
        at = text.find(gap, at + step)
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def segments(text: str, enc: ByteLevel, rule: SplitRule) -> tuple[list[int], list[int], list[int]]:
    """(sizes, ends, strengths): atomic segments in order, their tokens, the character where each ends, and the strength of
    the boundary after it.

    Merging weakest boundaries first joins every line that fits before any two lines, and every cue that fits before any
    two cues; so segments start as whole cues, a cue that doesn't fit as its lines, a line that doesn't fit as its words,
    a word that doesn't fit as runs of tokens.
    """
    most = rule.room - rule.overlap
    sizes: list[int] = []
    ends: list[int] = []
    strengths: list[int] = []

    def word(part: str, at: int) -> None:
        ids = np.frombuffer(enc.ids(part), np.int32).tolist()
        done = chars = 0
        while done < len(ids):
            took = min(most, len(ids) - done)
            while True:  # back to where a character ends; at most three tokens
                raw = enc.encoding.decode_bytes(ids[done : done + took])
                n = len(raw.decode("utf-8", "ignore"))
                if done + took == len(ids) or len(part[chars : chars + n].encode()) == len(raw):
                    break
                took -= 1
            done, chars = done + took, chars + n
            sizes.append(took)
            ends.append(at + chars)
            strengths.append(INSIDE)

    def walk(parts: list[str], level: int, at: int, after: int) -> None:
        """parts: neighbours at boundaries of `level`, from character `at`; after: the strength behind the last one."""
        for part in parts:
            n, at = enc.count(part), at + len(part)
            if n <= most:
                sizes.append(n)
                ends.append(at)
                strengths.append(level)
            elif level > WORD:
                walk((NEWLINE if level == CUE else SPACE).split(part), level - 1, at - len(part), level)
            else:
                word(part, at - len(part))
                strengths[-1] = level
            if level == CUE and part.rstrip().endswith(ENDS):
                strengths[-1] = SENTENCE
        strengths[-1] = max(strengths[-1], after)

    walk(cues(text), CUE, 0, CUE)
    return sizes, ends, strengths


def merge(sizes: list[int], strengths: list[int], rule: SplitRule) -> list[int]:
    """The last segment of each piece. Adjacent pieces wait in a heap, weakest boundary first and of equal ones the
    leftmost; a pair is merged if their size and the overlap fit the room, else the boundary stays for good."""
    n, room, over = len(sizes), rule.room, rule.overlap
    first, last, size = list(range(n)), list(range(n)), list(sizes)  # first: of the piece that ends here; last, size: of the piece that starts here
    ahead = [0, *accumulate(sizes)]
    heap = [(strength, i) for i, strength in enumerate(strengths[:-1])]  # the boundary after segment i
    heapq.heapify(heap)
    while heap:  # sizes only grow: a boundary that doesn't fit now never will, so each is looked at once
        _, i = heapq.heappop(heap)
        a = first[i]
        joined = size[a] + size[i + 1]
        if joined + min(over, ahead[a]) <= room:
            size[a], last[a] = joined, last[i + 1]
            first[last[a]] = a
    out, a = [], 0
    while a < n:
        out.append(last[a])
        a = last[a] + 1
    return out


def overlap_start(text: str, enc: ByteLevel, at: int, over: int) -> int:
    """The character where the last `over` tokens of text[:at] start; at is a certain cut or the end of a token."""
    width = 8 * over
    while True:
        lo = max(0, at - width)
        if lo:  # start at a word, so that the tokens are the document's
            m = SPACE.search(text, lo, at)
            lo = m.start() if m else 0
        ids = np.frombuffer(enc.ids(text[lo:at]), np.int32).tolist()
        if len(ids) >= over or lo == 0:
            raw = enc.encoding.decode_bytes(ids[: max(0, len(ids) - over)])
            return lo + len(raw.decode("utf-8", "ignore"))
        width *= 4


def fits(text: str, enc: ByteLevel, piece: tuple[int, int, int, int, str], limit: int) -> bool:
    """Whether the piece takes at most limit tokens when it is encoded on its own.

    From its first certain cut on it has the document's own tokens; before it, it has at most those of the fragment that it
    starts in. Only if this bound is over the limit, or the piece ends inside a word, the whole piece is counted.
    """
    start, end, char, upto, kind = piece
    m = SPACE.search(text, char, upto)
    if kind != KINDS[INSIDE] and end - start + enc.count(text[char : m.start() if m else upto]) <= limit:
        return True
    return enc.count(text[char:upto]) <= limit


def split_text(text: str | None, enc: ByteLevel, rule: SplitRule) -> list[tuple[int, int, int, int, str]]:
    """(token_start, token_end, char_start, char_end, boundary) of each piece; boundary is the kind behind the piece."""
    if not text:
        return [(0, 0, 0, 0, "end")]
    while True:
        sizes, ends, strengths = segments(text, enc, rule)
        total = sum(sizes)
        if total <= rule.limit:
            return [(0, total, 0, len(text), "end")]
        out, tokens, chars, first = [], 0, 0, 0
        for e in merge(sizes, strengths, rule):
            upto = tokens + sum(sizes[first : e + 1])
            char = overlap_start(text, enc, chars, rule.overlap) if tokens else 0
            out.append((max(0, tokens - rule.overlap), upto, char, ends[e], KINDS[strengths[e]]))
            tokens, chars, first = upto, ends[e], e + 1
        if all(fits(text, enc, p, rule.limit) for p in out):
            out[-1] = (*out[-1][:4], "end")
            return out
        if rule.room - rule.overlap <= 1:
            raise ValueError("a text has no pieces under the limit")
        rule = replace(rule, slack=min(2 * rule.slack + 4, rule.limit - rule.overlap - 1))


def split_documents(df: DataFrame, key: str, text: str, rule: SplitRule = SplitRule(), with_text: bool = True, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row per piece: (key, piece from 0, pieces, token_start, token_end, char_start, char_end, boundary[, text]).

    A text of at most rule.limit tokens is one piece, so are null and empty texts (0 tokens). Otherwise atomic segments are
    merged, weakest boundary first, while their size and the overlap fit. Token positions are those of the document's own
    encoding: a piece is the tokens [token_start, token_end), and each piece but the first starts rule.overlap tokens
    before the one before it ends. char_start is the character in which the piece's first token starts. The pieces without
    their overlaps are the whole text. One pass without a shuffle; a worker holds one Arrow batch.
    """

    names = [key, "piece", "pieces", "token_start", "token_end", "char_start", "char_end", "boundary", *(["text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            rows, held = [], 0
            for doc, body in zip(batch.column(0), batch.column(1)):
                doc, body = doc.as_py(), body.as_py()
                pieces = split_text(body, enc, rule)
                for i, p in enumerate(pieces):
                    rows.append((doc, i, len(pieces), *p, *([body[p[2] : p[3]] if body is not None else None] if with_text else [])))
                held += len(body or "")
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(df.schema[key].dataType), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, pieces int, token_start bigint, token_end bigint, char_start bigint, char_end bigint, boundary string" + ", text string" * with_text
    return df.select(key, text).mapInArrow(run, schema)
