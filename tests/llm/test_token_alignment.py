import hashlib
import io
import random
import sys
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetables.llm.perfect_hash import PerfectHash, verified
from pagetables.llm.token_alignment import Stretches, alignment, cuts_at_spaces, open_tokenizers
from pagetables.llm.token_counts import newer_characters
from tests.llm.data import DOCS, awkward, empty, prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract word for word: loops over tokens, counts in a dictionary."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain_bytes}
    letters.update((chr(256 + i), x) for i, x in enumerate(x for x in range(256) if x not in plain_bytes))

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def ends(parts):
        at, out = 0, []
        for part in parts:
            at += len(part)
            out.append(at)
        return out

    docs, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, [], [], []))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        links, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i), ends_b.index(end, j)
            groups.append((ids_a[i : x + 1], ids_b[j : y + 1]))
            links.append((ids_a[x], ids_b[y]))
            i, j = x + 1, y + 1
        counts.update(links)
        docs.append((doc_id, ids_a, ids_b, list(zip(groups, links, strict=True))))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, ids_a, ids_b, found in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for (x, y), _ in found)
        links = [link for _, link in found]
        out.append((
            doc_id, len(ids_a), len(ids_b), len(found), len(links), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else "",
        ))
    return out


def key(row):
    return [(x is not None, x) for x in row]


def some_rows():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 80))) for i in range(60)]
    rows += [(100 + i, text) for i, text in enumerate([
        "", None, " ", "  two  spaces  ", "▁ mark", "<s> </s> <|endoftext|> <unk>", "<0x41> 漢字 \U0001f600՘",
        "tab\tand\nline", "zero\x00byte", "é" * 50, "é ﬁ ﬁ ½", "aaaaaaaaaaaaaaaaaaaaaaa", "\r\n", "1234567 0.5",
    ])]
    return rows + [(3, rows[3][1]), (None, rows[4][1])]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 0])
def test_equals_plain(spark, broadcast_pairs, monkeypatch):
    monkeypatch.setattr("pagetables.llm.token_alignment.SHARD", 200)
    monkeypatch.setattr("pagetables.llm.token_alignment.LEAF", 100)
    monkeypatch.setattr("pagetables.llm.token_alignment.LOOKUPS", 50)
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [tuple(row) for row in alignment(docs, *PATHS, broadcast_pairs=broadcast_pairs).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_awkward_and_empty(spark):
    frame = awkward(spark)
    got = [tuple(row) for row in alignment(frame, *PATHS).collect()]
    rows = [(row["doc_id"], row["text"]) for row in frame.select("doc_id", "text").collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert alignment(empty(spark), *PATHS).collect() == []
    assert DOCS


def contents(paths):
    return tuple(open(path, "rb").read() for path in paths)


class Recorder:
    """Stands for B and keeps what it was asked."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def encode(self, texts, **options):
        self.asked += texts
        return self.inner.encode(texts, **options)


def test_each_stretch_is_encoded_once():
    both = open_tokenizers(*contents(PATHS), newer_characters())
    recorder = Recorder(both.b)
    known = Stretches.none(both)
    for _ in range(2):
        replace(both, b=recorder).encode(["amber birch cedar. " * 50, "", "  birch  amber\namber", "amber"], known)
    assert len(recorder.asked) == len(set(recorder.asked)) and sum(map(len, recorder.asked)) < 100


def test_cut_texts_have_the_tokens_of_whole_texts():
    assert cuts_at_spaces(*contents(PATHS))
    both = open_tokenizers(*contents(PATHS), newer_characters())
    rng = random.Random(9)
    signs = [*map(chr, (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F))]
    signs += [*"\u205f\u2060\u3000\ufeff\u0301▁é漢՘'!1½aB", "\U0001f600", *[" "] * 20, "'s", "the", "<s>", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(16))) for _ in range(3000)]
    texts += [f"a{one}  b{one} c {one} {one}d1{one} 's{one}\n {one} x " for one in signs]
    uncut = replace(both, words=None)
    assert both.encode(texts, Stretches.none(both)) == uncut.encode(texts, Stretches.none(uncut))


@pytest.mark.parametrize("options", [
    {"normalization_rule_name": "identity", "split_by_whitespace": False}, {"normalization_rule_name": "nmt_nfkc"},
])
def test_other_models_take_whole_texts(spark, options, tmp_path, monkeypatch):
    model, rng = io.BytesIO(), random.Random(4)
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(["the amber of the birch " + prose(rng, 6) for _ in range(200)]), model_writer=model,
        model_type="bpe", vocab_size=400, byte_fallback=True, minloglevel=2, remove_extra_whitespaces=False, **options,
    )
    (tmp_path / "other.model").write_bytes(model.getvalue())
    paths = PATHS[0], str(tmp_path / "other.model")
    assert not cuts_at_spaces(*contents(paths))
    monkeypatch.setattr(sys.modules[__name__], "PATHS", paths)
    rows = [*some_rows(), (500, "the amber of the birch the amber")]
    got = [tuple(row) for row in alignment(spark.createDataFrame(rows, "doc_id bigint, text string"), *paths).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_emptied_memory(spark, monkeypatch):
    monkeypatch.setattr("pagetables.llm.token_alignment.REMEMBERED", 5)
    monkeypatch.setattr("pagetables.llm.token_alignment.SLAB", 100)
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = [tuple(row) for row in alignment(docs, *PATHS).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


@given(st.sets(st.integers(0, 2**62), max_size=400), st.sets(st.integers(0, 2**62), max_size=50))
def test_perfect_hash(keys, others):
    array = np.array(sorted(keys), np.int64)
    made = PerfectHash.of(array)
    assert sorted(made.slots(array).tolist()) == list(range(len(array)))
    by_slot = np.empty(len(array), np.int64)
    by_slot[made.slots(array)] = array
    found = verified(made, by_slot, np.array(sorted(others), np.int64))
    assert [slot >= 0 for slot in found.tolist()] == [other in keys for other in sorted(others)]
