import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetables.llm import prefix_trie as module
from pagetables.llm.prefix_trie import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """The contract word for word, with prefixes as tuples."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sym = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            said[c].append(((turn is not None, turn or 0), sym, role, text))
    said = {c: [(role, text) for _, _, role, text in sorted(some)] for c, some in said.items()}
    whole = {}
    for c, own in said.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = (said.get(base, [])[:h]) + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = []
    for node, some in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        own = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in some if len(whole[c]) == len(node))
        out.append((
            some[0], len(node), members[node[:-1]][0] if node else None, len(some),
            sum(len(x) == len(node) + 1 for x in below), sum(x not in parents for x in below), own,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS c", "1 AS d", "'y' AS name", "2 AS n", "3 AS words")
    return sorted(map(tuple, prefix_trie(frame.repartition(3)).collect()), key=str)


def conversations(rng, n, longest):
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"][turn % 2 :][:1]), " ".join("ab"[rng.randrange(2)] for _ in range(rng.randrange(3)))))
    return rows


@pytest.mark.parametrize("seed, n, longest", [(1, 70, 6), (2, 45, 20)])
def test_equals_plain(spark, seed, n, longest):
    rows = conversations(random.Random(seed), n, longest)
    assert trie(spark, rows) == plain(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 8)
    rows = [(None, 0, "user", "lost"), (None, None, None, None)]
    rows += [(c, turn, "user", "same") for c in range(40) for turn in (None, 3)]
    rows += [(41, 1, "user", "b"), (41, 1, "user", "a"), (41, 1, "user", "a"), (41, 1, None, None), (41, 2, "", "")]
    rows += [(-3, 0, "user", "x"), (-3, 1, None, "y \t z"), (0, 9, "user", "w " * 20_000), (45, 0, "us", "er"), (47, 0, "u", "ser")]
    rows += [(60, turn, "user", f"t{turn % 2}") for turn in range(70)] + [(61, turn, "user", f"t{turn % 2}") for turn in range(67)]
    assert trie(spark, rows) == plain(rows)


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 4), st.just("u"), st.sampled_from(["a", "b c"])), min_size=1, max_size=40))
def test_any_rows(spark, rows):
    assert trie(spark, rows) == plain(rows)
