"""Alignment of two tokenizers by the bytes of their tokens, with corpus-wide pair counts.

One pass encodes every text with both tokenizers and keeps the ids.  Texts are cut where no
token of either reaches over (`cuts_at_spaces`); different stretches are encoded once and
remembered for a while.  Where tokens of both end at the same byte they are linked.  The distinct pairs of linked ids get a minimal
perfect hash for each shard of the pairs; partial counts become dense vectors indexed by it,
which are summed in a tree.  A second pass aligns the documents again and looks up the
counts of their links; the key in a slot is compared, so no pair takes another one's count.

The index goes to every task where it has at most ``BROADCAST`` pairs; a larger one stays
where it is, and the links of the documents go to its shards, salted by document.

Texts that are null, empty, or that one of the tokenizers does not give back byte for byte
have no tokens: zeros and an empty digest.  Rows are kept as they are, repeated ids too.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled
from pagetables.llm.perfect_hash import PerfectHash, verified
from pagetables.llm.token_counts import REMEMBERED, PreTokens, byte_letters, newer_characters

#: A space after a sign that is no white space; the last character of a text is not cut off.
CUT = re.compile(r" (?<=\S )(?!\Z)")
#: Characters of remembered stretches; the memory is emptied beyond this.
LETTERS = 16 * REMEMBERED
#: Characters of texts, and tokens of documents, that a task handles together.
SLAB, TOKENS = 1 << 20, 1 << 20
#: Distinct pairs that a task gathers before it hands on their counts.
GATHERED = 1 << 20
#: Pairs of one hash; pairs of an index that is broadcast (16 bytes and 4 bits each).
SHARD, BROADCAST = 500_000, 1_000_000
#: Partial counts of one dense vector; vectors that are summed at a time; links of a lookup group.
LEAF, FAN, LOOKUPS = 250_000, 4, 1_000_000
DIGEST = (
    "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "n_best bigint, count_sum bigint, groups_sha256 string"
)
INDEX = "shard bigint, sizes array<bigint>, bits binary, keys binary"


#: The ids of some texts in one line, and how many each text has.
Ids = tuple[np.ndarray, np.ndarray]


@dataclass
class Stretches:
    """Stretches of texts with the ids of A and B, each in one line.

    The ids of stretch i begin at entry i of ``starts``; one more entry is the end.  ``whole``
    tells whether both tokenizers give a stretch back.  ``words`` are pre-tokens of A.
    """

    ids: list[np.ndarray]
    starts: list[np.ndarray]
    whole: np.ndarray
    places: dict[str, int]
    words: dict[str, bytes]
    letters: int = 0

    @classmethod
    def none(cls, both: Tokenizers) -> Stretches:
        ids, starts = [np.zeros(0, kind) for kind in both.types], [np.zeros(1, np.int64) for _ in both.types]
        return cls(ids, starts, np.zeros(0, bool), {}, {})

    def full(self) -> bool:
        return max(len(self.places), len(self.words)) > REMEMBERED or self.letters > LETTERS

    def add(self, new: list[str], found: tuple[Ids, Ids], whole: np.ndarray) -> None:
        for side, (ids, counts) in enumerate(found):
            self.ids[side] = np.concatenate((self.ids[side], ids))
            self.starts[side] = np.concatenate((self.starts[side], np.cumsum(counts) + self.starts[side][-1]))
        self.whole = np.concatenate((self.whole, whole))
        self.places.update(zip(new, range(len(self.places), len(self.whole)), strict=True))
        self.letters += sum(map(len, new))

    def joined(self, side: int, at: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of texts as bytes; a text is the next ``counts`` of the stretches ``at``."""
        begin, sizes = self.starts[side][at], self.starts[side][at + 1] - self.starts[side][at]
        ends = np.cumsum(sizes)
        ids = self.ids[side][np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)]
        return _sliced(ids.tobytes(), ends[np.cumsum(counts) - 1] * ids.itemsize)


def _sliced(line: bytes, ends: np.ndarray) -> list[bytes]:
    cuts = [0, *ends.tolist()]
    return [line[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers with the bytes of every id: A byte-level, B of pieces.

    ``words`` finds the pre-tokens of A; it is None where texts cannot be cut.
    """

    a: object
    b: object
    words: PreTokens | None
    entries: tuple[list[bytes], list[bytes]]
    lengths: tuple[np.ndarray, np.ndarray]

    @property
    def types(self) -> tuple[str, str]:
        return tuple(id_type(len(some)) for some in self.entries)

    def _line(self, side: int, found: list[list[int]]) -> Ids:
        ids = np.fromiter(chain.from_iterable(found), self.types[side])
        return ids, np.fromiter(map(len, found), np.int64, len(found))

    def _of_words(self, texts: list[str], known: dict[str, bytes]) -> Ids:
        """Ids of A: the pre-tokens of all texts go through its model once and are remembered."""
        words = [self.words.pattern(text).findall(text) for text in texts]
        model, letters, kind = self.a.model, byte_letters(), np.dtype(self.types[0])
        for word in set().union(*words).difference(known):
            shown = word.encode().decode("latin-1").translate(letters)
            known[word] = np.array([token.id for token in model.tokenize(shown)], kind).tobytes()
        blobs = [b"".join(map(known.__getitem__, some)) for some in words]
        counts = np.fromiter(map(len, blobs), np.int64, len(blobs)) // kind.itemsize
        return np.frombuffer(b"".join(blobs), kind), counts

    def found(self, texts: list[str], known: dict[str, bytes] | None) -> tuple[Ids, Ids]:
        """Ids by A with a space before each text, and by B, which adds the space.

        Without ``known``, A takes every text in one.
        """
        spaced = [" " + text for text in texts]
        if known is None:
            a = self._line(0, [one.ids for one in self.a.encode_batch_fast(spaced, add_special_tokens=False)])
        else:
            a = self._of_words(spaced, known)
        return a, self._line(1, self.b.encode(texts, num_threads=1))

    def given_back(self, texts: list[str], found: tuple[Ids, Ids]) -> np.ndarray:
        """Whether the tokens of both are a space and the text, byte for byte."""
        wanted, whole = [b" " + text.encode() for text in texts], np.ones(len(texts), bool)
        for (ids, counts), entries, lengths in zip(found, self.entries, self.lengths, strict=True):
            ends = np.concatenate(([0], np.cumsum(lengths[ids])))[np.cumsum(counts)]
            made = _sliced(b"".join(map(entries.__getitem__, ids.tolist())), ends)
            whole &= np.fromiter(map(bytes.__eq__, made, wanted), bool, len(wanted))
        return whole

    def encode(self, texts: list[str], known: Stretches) -> tuple[list[bytes], list[bytes]]:
        """Ids of texts as bytes, none where a text is empty or not given back.

        The tokens of a text whose stretches are all given back are those of its stretches.
        Any other text is encoded again without cuts.
        """
        if not texts:
            return [], []
        parts = [CUT.split(text) if self.words else [text] for text in texts]
        new = list(set().union(*parts).difference(known.places))
        found = self.found(new, known.words if self.words else None)
        known.add(new, found, self.given_back(new, found))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(known.places.__getitem__, chain.from_iterable(parts)), np.int64, counts.sum())
        a, b = known.joined(0, at, counts), known.joined(1, at, counts)
        whole = np.logical_and.reduceat(known.whole[at], np.cumsum(counts) - counts)
        for row in np.flatnonzero(~whole).tolist():
            a[row] = b[row] = b""
            if counts[row] > 1:
                one = self.found([texts[row]], None)
                if self.given_back([texts[row]], one)[0]:
                    a[row], b[row] = (ids.tobytes() for ids, _ in one)
        return a, b


def cuts_at_spaces(json_file: bytes, model_file: bytes) -> bool:
    """Whether texts may be cut (`CUT`) without changing a token; the files are read on the driver.

    A then cuts there itself: only a pre-token of white space alone has white space that is
    not its beginning.  B has no piece with a space after another sign, so no merge
    reaches over; it takes texts as they are and marks spaces.
    """
    from sentencepiece import sentencepiece_model_pb2

    a, b = json.loads(json_file), sentencepiece_model_pb2.ModelProto.FromString(model_file)
    cut, rules = a.get("pre_tokenizer") or {}, b.normalizer_spec
    return (
        not a.get("normalizer")
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and a["model"].get("type") == "BPE"
        and not a["model"].get("dropout")
        and all(token["special"] for token in a.get("added_tokens") or [])
        and b.trainer_spec.model_type == b.trainer_spec.BPE
        and not rules.precompiled_charsmap
        and rules.escape_whitespaces
        and not any("▁" in one.piece.lstrip("▁") for one in b.pieces)
    )


@lru_cache(1)
def open_tokenizers(json_file: bytes, model_file: bytes, newer: str | None) -> Tokenizers:
    """``newer`` is that of `newer_characters`; None where texts cannot be cut."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_buffer(json_file), sentencepiece.SentencePieceProcessor(model_proto=model_file)
    a.encode_special_tokens = True
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    bytes_a = [b""] * a.get_vocab_size(with_added_tokens=True)
    for entry, at in a.get_vocab(with_added_tokens=False).items():
        bytes_a[at] = bytes(map(byte_of.__getitem__, entry))
    pieces = [b.id_to_piece(at) for at in range(b.get_piece_size())]
    bytes_b = [
        bytes([int(piece[3:5], 16)]) if b.is_byte(at) else piece.replace("▁", " ").encode()
        for at, piece in enumerate(pieces)
    ]
    lengths = tuple(np.array([len(one) for one in some], np.int64) for some in (bytes_a, bytes_b))
    return Tokenizers(a, b, None if newer is None else PreTokens(newer), (bytes_a, bytes_b), lengths)


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _slabs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows with about ``most`` in all, one row at least."""
    begin, total = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > begin and total + size > most:
            yield slice(begin, at)
            begin, total = at, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def token_table(docs: DataFrame, files) -> DataFrame:
    """(rid, doc_id, a, b): the ids of both tokenizers as bytes; rid numbers the rows."""

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = open_tokenizers(*files.value)
        known = Stretches.none(both)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in _slabs(np.array([len(text) for text in texts], np.int64), SLAB):
                some = texts[part]
                if known.full():
                    known = Stretches.none(both)
                a, b = both.encode(some, known)
                ids = batch.column("doc_id").slice(part.start, len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(some))), ids, pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                    ["rid", "doc_id", "a", "b"],
                )
                rid += len(some)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        encoded, "rid bigint, doc_id bigint, a binary, b binary"
    )


@dataclass(frozen=True)
class Links:
    """Tokens of some documents in one line, and the places where tokens of both end together."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray

    @classmethod
    def of(cls, blobs_a: list[bytes], blobs_b: list[bytes], lengths: tuple[np.ndarray, np.ndarray]) -> Links:
        type_a, type_b = (id_type(len(some)) for some in lengths)
        a, b = np.frombuffer(b"".join(blobs_a), type_a), np.frombuffer(b"".join(blobs_b), type_b)
        n_a, n_b = (
            np.array([len(blob) for blob in blobs], np.int64) // np.dtype(kind).itemsize
            for blobs, kind in ((blobs_a, type_a), (blobs_b, type_b))
        )
        ends_a, ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
        near = np.searchsorted(ends_b, ends_a)  # both lines have the same bytes, so none is beyond the end
        at_a = np.flatnonzero(ends_b[near] == ends_a)
        return cls(a, b, n_a, n_b, at_a, near[at_a])

    @property
    def keys(self) -> np.ndarray:
        return (self.a[self.at_a].astype(np.int64) << 32) | self.b[self.at_b].astype(np.int64)

    @property
    def rows(self) -> np.ndarray:
        """The document of each link."""
        return np.searchsorted(np.cumsum(self.n_a), self.at_a, side="right")

    def digests(self, words: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each document's groups; ``words`` is that of `separators`."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.at_a] = last_b[self.at_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        ended_b = np.concatenate(([0], self.at_b + 1))
        codes[np.arange(len(self.a)) + ended_b[group_a]] = 2 * self.a.astype(np.int64) + last_a
        codes[np.arange(len(self.b)) + self.at_a[group_b] + 1] = -1 - (2 * self.b.astype(np.int64) + last_b)
        signs, sizes = words
        padded = signs[codes].view(np.uint8)
        written = padded[padded > 0].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes[codes])))[np.cumsum(self.n_a + self.n_b)]
        return [hashlib.sha256(groups[:-1]).hexdigest() if groups else "" for groups in _sliced(written, ends)]


def separators(size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry 2 i + last for id i of A, and from the end backwards the same for B; their lengths."""
    first = [f"{at}{sign}" for at in range(size_a) for sign in ",|"]
    every = np.array(first + [f"{at}{sign}" for at in range(size_b) for sign in ",;"][::-1], "S")
    return every, np.char.str_len(every)


def _batches(batches: Iterable[pa.RecordBatch], lengths) -> Iterator[tuple[pa.RecordBatch, Links]]:
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        for part in _slabs(np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) // 2, TOKENS):
            yield batch.slice(part.start, part.stop - part.start), Links.of(a[part], b[part], lengths)


def partial_counts(tokens: DataFrame, files) -> DataFrame:
    """(task, key, n): links of each id pair, counted within a task first."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = open_tokenizers(*files.value).lengths
        task = TaskContext.get().partitionId()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), task, np.int64)), pa.array(keys), pa.array(counts)], ["task", "key", "n"]
            )

        for _, links in _batches(batches, lengths):
            new, times = np.unique(links.keys, return_counts=True)
            every, place = np.unique(np.concatenate((keys, new)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, times)), len(every)).astype(np.int64)
            keys = every
            if len(keys) > GATHERED:
                yield out()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    return tokens.mapInArrow(counted, "task bigint, key bigint, n bigint")


def hash_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of the distinct keys: its perfect hash and the keys by slot."""

    def hashed(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        made = PerfectHash.of(keys)
        by_slot = np.empty(len(keys), np.int64)
        by_slot[made.slots(keys)] = keys
        return pa.table(
            [[group.column("shard")[0].as_py()], [list(made.sizes)], [made.bits], [by_slot.tobytes()]],
            schema=pa.schema(
                [("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())]
            ),
        )

    dealt = keys.select(F.pmod("key", F.lit(shards)).alias("shard"), "key")
    return dealt.groupBy("shard").applyInArrow(hashed, INDEX)


@dataclass(frozen=True)
class Shard:
    """A shard of the index opened."""

    hashed: PerfectHash
    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        counts = np.frombuffer(row.get("counts") or b"", np.int64)
        return cls(PerfectHash(tuple(row["sizes"]), row["bits"]), np.frombuffer(row["keys"], np.int64), counts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        slots = verified(self.hashed, self.keys, keys)
        if len(slots) and slots.min() < 0:
            raise ValueError("a pair is missing in the index")
        return slots


def count_vectors(index: DataFrame, partials: DataFrame, shards: int, leaves: int) -> DataFrame:
    """(shard, counts): a dense vector by slot for each leaf of the partials, summed in a tree."""
    kinds = pa.schema([("shard", pa.int64()), ("leaf", pa.int64()), ("counts", pa.binary())])

    def leaf_vector(key: tuple, group: pa.Table, shard: pa.Table) -> pa.Table:
        one = Shard.of(shard.to_pylist()[0])
        counts = np.zeros(len(one.keys), np.int64)
        np.add.at(counts, one.slots(group.column("key").to_numpy()), group.column("n").to_numpy())
        return pa.table([[key[0].as_py()], [key[1].as_py()], [counts.tobytes()]], schema=kinds)

    def summed(key: tuple, group: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(blob, np.int64) for blob in group.column("counts").to_pylist()]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [np.sum(vectors, axis=0).tobytes()]], schema=kinds)

    shown = "shard bigint, leaf bigint, counts binary"
    dealt = partials.select(
        F.pmod("key", F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("task"), F.lit(leaves)).alias("leaf"), "key", "n"
    )
    copies = index.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1)).cast("array<bigint>")))
    vectors = dealt.groupBy("shard", "leaf").cogroup(copies.groupBy("shard", "leaf")).applyInArrow(leaf_vector, shown)
    while leaves > 1:
        leaves = math.ceil(leaves / FAN)
        vectors = vectors.withColumn("leaf", F.pmod("leaf", F.lit(leaves)))
        vectors = vectors.groupBy("shard", "leaf").applyInArrow(summed, shown)
    return vectors.select("shard", "counts")


def pair_table(index: DataFrame) -> DataFrame:
    """(a_id, b_id, n) of every linked pair of ids of an index with counts."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = Shard.of(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.keys >> 32), pa.array(one.keys & 0xFFFFFFFF), pa.array(one.counts)], ["a_id", "b_id", "n"]
                )

    return index.mapInArrow(listed, "a_id bigint, b_id bigint, n bigint")


def pair_index(tokens: DataFrame, files) -> tuple[DataFrame, int, int]:
    """The index with counts (``INDEX`` and counts), the number of its pairs, that of the links."""
    partials = settled(partial_counts(tokens, files), "pair-counts")
    keys = settled(partials.select("key").distinct(), "pairs")
    pairs, (rows, links) = keys.count(), partials.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, math.ceil(pairs / SHARD)) | 1
    index = settled(hash_index(keys, shards), "pair-index")
    vectors = count_vectors(index, partials, shards, max(1, math.ceil(rows / (shards * LEAF))))
    return settled(index.join(vectors, "shard"), "pair-vectors"), pairs, links


def _found(shards: dict[int, Shard], keys: np.ndarray, parts: int) -> np.ndarray:
    """The corpus-wide count of each key."""
    different, place = np.unique(keys, return_inverse=True)
    counts, home = np.zeros(len(different), np.int64), different % parts
    for part in np.unique(home).tolist():
        mine = home == part
        counts[mine] = shards[part].counts[shards[part].slots(different[mine])]
    return counts[place]


def _digested(tokens: DataFrame, files, index, best, parts: int) -> DataFrame:
    """A row for every document; without an ``index``, counts are left at 0."""

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = open_tokenizers(*files.value)
        lengths, words = both.lengths, separators(*map(len, both.entries))
        shards = {row["shard"]: Shard.of(row) for row in index.value} if index else {}
        for batch, links in _batches(batches, lengths):
            rows, n = links.rows, len(links.n_a)
            n_links = np.bincount(rows, minlength=n)
            n_best = count_sum = np.zeros(n, np.int64)
            if index:
                counts = _found(shards, links.keys, parts)
                n_best = np.bincount(rows[counts == best.value[links.keys & 0xFFFFFFFF]], minlength=n)
                count_sum = _sums(rows, counts, n)
            numbers = [links.n_a, links.n_b, n_links, n_links, n_best, count_sum]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    batch.column("doc_id"),
                    *(pa.array(some.astype(np.int64)) for some in numbers),
                    pa.array(links.digests(words), pa.string()),
                ],
                [part.split(" ")[0] for part in DIGEST.split(", ")],
            )

    return tokens.mapInArrow(digested, DIGEST)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by row; rows are in order."""
    total = np.concatenate(([0], np.cumsum(values)))
    cuts = np.searchsorted(rows, np.arange(n + 1))
    return total[cuts[1:]] - total[cuts[:-1]]


def _looked_up(tokens: DataFrame, files, index: DataFrame, best, parts: int, salts: int) -> DataFrame:
    """(rid, n_best, count_sum) with the index left in its shards."""

    def emitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = open_tokenizers(*files.value).lengths
        for batch, links in _batches(batches, lengths):
            rows, keys = links.rows, links.keys
            order = np.lexsort((keys, rows))
            rows, keys = rows[order], keys[order]
            new = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
            cuts = np.flatnonzero(np.concatenate(([True], new, [True]))) if len(keys) else np.zeros(1, np.int64)
            first = cuts[:-1]
            rid = batch.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[rows[first]]), pa.array(keys[first]), pa.array(np.diff(cuts))], ["rid", "key", "times"]
            )

    def counted(group: pa.Table, shard: pa.Table) -> pa.Table:
        one, keys = Shard.of(shard.to_pylist()[0]), group.column("key").to_numpy()
        n, times = one.counts[one.slots(keys)], group.column("times").to_numpy()
        rid, place = np.unique(group.column("rid").to_numpy(), return_inverse=True)
        sums = [np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)]
        np.add.at(sums[0], place, times * (n == best.value[keys & 0xFFFFFFFF]))
        np.add.at(sums[1], place, times * n)
        return pa.table([rid, *sums], names=["rid", "n_best", "count_sum"])

    dealt = tokens.mapInArrow(emitted, "rid bigint, key bigint, times bigint").select(
        F.pmod("key", F.lit(parts)).alias("shard"), F.pmod(F.xxhash64("rid"), F.lit(salts)).alias("salt"), "rid", "key", "times"
    )
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    found = (
        dealt.groupBy("shard", "salt")
        .cogroup(copies.groupBy("shard", "salt"))
        .applyInArrow(counted, "rid bigint, n_best bigint, count_sum bigint")
    )
    return found.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, json_path: str, model_path: str, broadcast_pairs: int = BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A encodes a space and the text, B the text (it adds the space itself).  The files are
    read on the driver; they and B's highest counts, one number for each id, are broadcast.
    """
    spark = docs.sparkSession
    with open(json_path, "rb") as json_file, open(model_path, "rb") as model_file:
        content = json_file.read(), model_file.read()
    content = *content, newer_characters() if cuts_at_spaces(*content) else None
    both = open_tokenizers(*content)
    files = spark.sparkContext.broadcast(content)
    tokens = settled(token_table(docs, files), "tokens")
    index, pairs, links = pair_index(tokens, files)
    parts = max(1, math.ceil(pairs / SHARD)) | 1
    highest = np.zeros(len(both.entries[1]), np.int64)
    for row in pair_table(index).groupBy("b_id").agg(F.max("n").alias("n")).collect():
        highest[row["b_id"]] = row["n"]
    best = spark.sparkContext.broadcast(highest)
    if pairs <= broadcast_pairs:
        rows = [row.asDict() for row in index.collect()]
        found = _digested(tokens, files, spark.sparkContext.broadcast(rows), best, parts)
    else:
        salts = max(1, math.ceil(links / (parts * LOOKUPS)))
        sums = _looked_up(tokens, files, index, best, parts, salts)
        plain = _digested(tokens, files, None, best, parts).drop("n_best", "count_sum")
        found = plain.join(sums, "rid", "left").fillna(0, ["n_best", "count_sum"])
    columns = [part.split(" ")[0] for part in DIGEST.split(", ")]
    return found.select(*columns[1:])
