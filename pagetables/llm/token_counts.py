"""Token counts of byte-level BPE by rank-synchronous array merging.

The pre-tokens of a slab of texts lie in one ragged array of symbols.  In every round each
sequence merges all places of its lowest-rank pair at once; a sequence without a known pair
drops out, and what is left of it is its count.  Merges never make a pair of a lower rank
than their own (checked when the vocabulary is read), so rounds give what merging one place
after the other gives.  Long sequences, whose rounds would be many, are merged together in
one sweep over the ranks, which visits only places that changed.

Nulls and empty texts have no tokens.  Texts are read whole; one text is cut into slabs of
pre-tokens, so memory does not grow with it.  Rows are kept as they are, repeated ids too.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from pagetables.llm.common import pick, runs

#: Fixed: how byte-level vocabularies cut text into pre-tokens, by classes of letters and digits.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
LETTERS, DIGITS = r"\p{L}", r"\p{N}"
#: Characters of text, or pre-tokens of one text, taken together.
SLAB = 1 << 20
#: Sequences of more symbols are merged by the sweep over ranks.
LONG = 64
#: Counts of pre-tokens remembered by a task; the memory is emptied beyond this.
REMEMBERED = 300_000
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte) if byte in plain else chr(next(spare)) for byte in range(256)]


def newer_characters() -> str:
    """Ranges of letters and digits of ``regex`` that the library, with an older Unicode, takes for signs."""
    every = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1))))
    young = [one for one in regex.findall(f"[{LETTERS}{DIGITS}]", every) if unicodedata.category(one) == "Cn"]
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    signs = [ord(one) for one in young if len(split("a" + one)) > 1 and len(split("1" + one)) > 1]
    cuts = runs(np.array(signs, np.int64) - np.arange(len(signs)))
    return "".join(f"{chr(signs[a])}-{chr(signs[b - 1])}" for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def pre_token_pattern(without: str = "") -> regex.Pattern:
    """The pattern of pre-tokens; the characters of ``without`` are neither letters nor digits."""
    letters, digits = (f"[{group}--[{without}]]" if without else group for group in (LETTERS, DIGITS))
    return regex.compile(PRE_TOKEN.replace("{L}", letters).replace("{N}", digits), regex.V1)


@dataclass(frozen=True)
class Merges:
    """The merges of a vocabulary: ``keys`` (left * size + right, sorted), their ranks and results."""

    size: int
    first: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    specials: tuple[str, ...]
    newer: str

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; negative symbols belong to no pair."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK, np.int32)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NO_RANK).astype(np.int32)


def read_merges(path: str) -> Merges:
    """The merges of a byte-level BPE file of the ``tokenizers`` library, read on the driver.

    Files with a normalizer, another pre-tokenizer or strip rules are refused.
    """
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    cut, model = found.get("pre_tokenizer") or {}, found["model"]
    if (
        found.get("normalizer")
        or cut.get("type") != "ByteLevel"
        or cut.get("add_prefix_space")
        or not cut.get("use_regex", True)
        or model.get("type") != "BPE"
        or any(model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    ):
        raise ValueError("only plain byte-level BPE files can be counted")
    added = found.get("added_tokens") or []
    if any(token["single_word"] or token["lstrip"] or token["rstrip"] for token in added):
        raise ValueError("added tokens with strip or word rules are not supported")
    ids = model["vocab"]
    pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    born = np.full(len(ids) + len(added) + 1, -1, np.int64)
    born[made[::-1]] = np.arange(len(pairs))[::-1]
    if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
        raise ValueError("a merge comes before the merges of its parts")
    size = max(ids.values(), default=0) + 1
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    first = np.array([ids[letter] for letter in byte_letters()], np.int64)
    specials = tuple(sorted((token["content"] for token in added), key=len, reverse=True))
    return Merges(size, first, keys[order], order.astype(np.int32), left, right, made, specials, newer_characters())


def _alternate(follows: np.ndarray) -> np.ndarray:
    """Of places in order, where ``follows`` tells that one overlaps the one before: every other."""
    n = np.arange(len(follows))
    begin = np.maximum.accumulate(np.where(follows, 0, n))
    return (n - begin) % 2 == 0


def _rounds(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols are left of each sequence: one round merges one rank in each."""
    left_over = lengths.copy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    last = np.concatenate((row[1:] != row[:-1], [True]))
    rank = np.where(last, NO_RANK, merges.rank(symbols, np.concatenate((symbols[1:], [-1]))))
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        size = np.diff(np.append(starts, len(row)))
        least = np.minimum.reduceat(rank, starts)
        left_over[row[starts]] = size
        live = np.repeat(least < NO_RANK, size)
        if not live.all():
            symbols, row, rank = symbols[live], row[live], rank[live]
            size, least = size[least < NO_RANK], least[least < NO_RANK]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(least, size))
        at = at[_alternate(np.concatenate(([False], at[1:] == at[:-1] + 1)))]
        symbols[at] = merges.made[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        changed[np.maximum(at - 1, 0)] = True
        symbols, row, rank, changed = symbols[keep], row[keep], rank[keep], changed[keep]
        at = np.flatnonzero(changed)
        after = np.minimum(at + 1, len(symbols) - 1)
        joined = (after > at) & (row[after] == row[at])
        rank[at] = np.where(joined, merges.rank(symbols[at], symbols[after]), NO_RANK)
    return left_over


def _sweep(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """As ``_rounds``, for long sequences: all of them go up the ranks together.

    ``after`` and ``before`` link the symbols that are left; an end mark follows each sequence.
    """
    n = len(symbols) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(n, bool)
    inside[ends] = False
    line = np.full(n + 1, -1, np.int64)
    line[:n][inside] = symbols
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(at: np.ndarray) -> None:
        rank = merges.rank(line[at], line[after[at]])
        at, rank = at[rank < NO_RANK], rank[rank < NO_RANK]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = runs(rank)
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            one = int(rank[begin])
            if one not in waiting:
                waiting[one] = []
                heapq.heappush(queue, one)
            waiting[one].append(at[begin:end])

    note(np.flatnonzero(inside))
    while queue:
        one = heapq.heappop(queue)
        at = np.unique(np.concatenate(waiting.pop(one)))
        at = at[(line[at] == merges.left[one]) & (line[after[at]] == merges.right[one])]
        if not len(at):
            continue
        at = at[_alternate(np.concatenate(([False], after[at[:-1]] == at[1:])))]
        gone = after[at]
        line[at], line[gone] = merges.made[one], -2
        after[at] = after[gone]
        before[after[at]] = at
        earlier = before[at]
        note(np.unique(np.concatenate((at, earlier[earlier >= 0]))))
    kept = np.concatenate(([0], np.cumsum(line[:n] >= 0)))
    return kept[ends] - kept[ends - lengths]


def symbols_left(words: list[bytes], merges: Merges) -> np.ndarray:
    """The number of tokens of each pre-token."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = merges.first[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.zeros(len(words), np.int64)
    long = lengths > LONG
    of_long = np.repeat(long, lengths)
    for some, method, part in ((~long & (lengths > 0), _rounds, ~of_long), (long, _sweep, of_long)):
        if some.any():
            counts[some] = method(symbols[part], lengths[some], merges)
    return counts


class PreTokens:
    """Cuts texts into pre-tokens as the library does; ``newer`` is that of `newer_characters`."""

    def __init__(self, newer: str):
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.beyond = regex.compile(f"[{newer[:1]}-\U0010ffff]") if newer else None
        self.word, self.strict = pre_token_pattern(), pre_token_pattern(newer)

    def pattern(self, part: str) -> regex.Pattern:
        doubtful = self.newer and not part.isascii() and self.beyond.search(part) and self.newer.search(part)
        return self.strict if doubtful else self.word


class Counter:
    """Counts tokens of texts, slab by slab; remembers the counts of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.words = PreTokens(merges.newer)
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None
        self.known: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(words.difference(self.known))
        self.known.update(zip(new, symbols_left([word.encode() for word in new], self.merges).tolist(), strict=True))

    def _total(self, words: list[str]) -> int:
        return sum(map(self.known.__getitem__, words))

    def _one(self, part: str) -> int:
        """The tokens of one long text, some pre-tokens at a time."""
        total, found = 0, self.words.pattern(part).finditer(part)
        while words := [match.group() for match in islice(found, SLAB // 8)]:
            self.known.clear()
            self._learn(set(words))
            total += self._total(words)
        self.known.clear()
        return total

    def _slab(self, texts: list[list[str]]) -> list[int]:
        words = [[word for part in parts for word in self.words.pattern(part).findall(part)] for parts in texts]
        self.known = {} if len(self.known) > REMEMBERED else self.known
        self._learn(set().union(*words))
        return [len(parts) - 1 + self._total(some) for parts, some in zip(texts, words, strict=True)]

    def count(self, texts: Iterable[str | None]) -> Iterator[int]:
        """Special strings inside a text are one token each and cut it."""
        slab: list[list[str]] = []
        size = 0
        for text in texts:
            parts = self.special.split(text or "") if self.special else [text or ""]
            length = len(text or "")
            if length > SLAB or size + length > SLAB:
                yield from self._slab(slab)
                slab, size = [], 0
            if length > SLAB:
                yield len(parts) - 1 + sum(self._one(part) for part in parts)
            else:
                slab.append(parts)
                size += length
        yield from self._slab(slab)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its merges, as many
    as the file has, go to the tasks as arrays.  A narrow job: no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_merges(vocabulary))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column("text")
            tokens = np.fromiter(counter.count(text.as_py() for text in texts), np.int64, len(texts))
            size = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
