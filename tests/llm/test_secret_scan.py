import hashlib
import random
import re

import pytest

from pagetables.llm.secret_scan import _CODE_OF, LONGEST, Automaton, all_spans, base_spans, find_secrets, learn, redact, redacted, symbols
from tests.llm.data import DOCS, awkward, empty, prose


def plain_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
            ("access", r"AKIA[A-Z0-9]+", 0, 18),
            ("hex", r"[0-9a-f]+", 0, 16),
        )
    ):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def some_texts():
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choices(letters, k=n))
    pieces = [
        lambda: f'token = "{hexes(40)}"', lambda: f"PassWord:{mixed(11)}", lambda: f"api_key='{mixed(14)}'", lambda: "secret = = abc",
        lambda: "AKIA" + mixed(16).upper(), lambda: "AKIAAKIA" + mixed(9).upper(), lambda: hexes(15), lambda: hexes(17),
        lambda: "toKen=password=" + mixed(20), lambda: "toKen=" + mixed(20), lambda: "paſsword=" + mixed(20),
        lambda: "ghp_" + mixed(36), lambda: "xoxb-" + "123456789012-" + mixed(24), lambda: "é漢\U0001f600",
    ]
    return [" ".join(prose(rng, rng.randrange(5)) + " " + rng.choice(pieces)() for _ in range(6)) for _ in range(60)]


def test_base_spans_equal_the_plain_rules(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(some_texts())]
    found = {r["doc_id"]: r for r in find_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        base = plain_spans(text)
        r = found[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(every)
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


def test_the_method_adds_known_formats_and_leaves_words_alone(spark):
    rng = random.Random(9)
    texts = some_texts() + [prose(rng, 300) for _ in range(200)]
    model = learn(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choices(letters, k=n))
    hits = [model.best("ghp_" + mixed(36)) for _ in range(40)]
    assert sum(h is not None and h[0] == "forge" for h in hits) >= 36
    clean = ["mail6.example.com/page12", "version-2024.10.12-final", "birch37heath19cedar5ridge", "2024-01-01T00.00.00", "w3.org/1999/xhtml/strict"]
    assert [c for c in clean if model.best(c)] == []


def test_secrets_are_found_inside_runs(spark):
    rng = random.Random(10)
    texts = some_texts() + [prose(rng, 300) for _ in range(200)]
    model = learn(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choices(letters, k=n))
    around = ["{}.", "GH_PAT={}", "?key={}&x", "/srv/keys/{}/raw.txt", "a.b-{}", "one/{}/two", "x={}=="]
    makers = [lambda: "ghp_" + mixed(36), lambda: "AIza" + mixed(35), lambda: "sk_live_" + mixed(24)]
    found = tried = 0
    for form in around:
        for make in makers:
            for _ in range(10):
                secret = make()
                text = "see " + form.format(secret) + " there"
                tried += 1
                found += secret not in (clean := redacted(text, all_spans(text, model)[1])) and secret[6:20] not in clean
    assert found >= 0.9 * tried
    two = f"ghp_{mixed(36)}/ghp_{mixed(36)}"
    assert [k for _, k, _ in model.parts(two)] == ["forge", "forge"]
    # A hexadecimal middle is a base span; the rest of the token goes as well.
    token = "ghp_" + "G7" + "0123456789abcdef0" + "Zk" + mixed(15)
    assert base_spans(token) and redacted(token, all_spans(token, model)[1]).startswith("[forge secret]")
    clean = ["mail6.example.com/page12", "version-2024.10.12-final", "birch37heath19cedar5ridge", "2024-01-01T00.00.00", "w3.org/1999/xhtml/strict"]
    assert [c for c in clean if model.parts(c)] == []


def a_model(spark, rng):
    texts = some_texts() + [prose(rng, 300) for _ in range(200)]
    return learn(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS))


def test_formats_that_nobody_listed(spark):
    rng = random.Random(12)
    model = a_model(spark, rng)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choices(letters, k=n))
    for make in (lambda: "sk_test_" + mixed(24), lambda: "npm_" + mixed(36), lambda: "glpat-" + mixed(20), lambda: mixed(32)):
        texts = [(secret, f"we use {secret} here") for secret in (make() for _ in range(100))]
        found = sum(secret[8:18] not in redacted(text, all_spans(text, model)[1]) for secret, text in texts)
        assert found >= 80
    names = "Utf8StringBuilderFactory2 550e8400-e29b-41d4-a716-446655440000 usr/lib/x86_64-linux-gnu/libc.so.6 IMG_20240612_183355.jpeg"
    names += " www.example.com/articles/2024/06/how-to-cook-rice-5-ways MacBookPro16-inch2021 ISBN978-3-16-148410-0 iPhone15ProMax256GB"
    assert [n for n in names.split() if model.parts(n)] == []


def test_parts_have_the_greatest_sum(spark):
    rng = random.Random(13)
    model = a_model(spark, rng)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choices(letters, k=n))

    def worth(part, kind):
        """What the part has above text and margin."""
        codes = [0, *(int(_CODE_OF[ord(c)]) for c in part), 0]
        text = sum(model.text[a, b] + model.margin for a, b in zip(codes, codes[1:]))
        score = model.automata[kind].score(symbols(part))
        return None if score is None else score * (len(part) + 1) - text

    hit = 0
    for _ in range(60):
        words = (rng.choice((lambda: "ghp_" + mixed(36), lambda: mixed(rng.randrange(4, 30)), lambda: "word7", lambda: "AIza" + mixed(35)))() for _ in range(rng.randrange(1, 5)))
        run = "".join(w + rng.choice("=/.-") for w in words)[: rng.randrange(16, 130)]
        best = [0.0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            best[end] = best[end - 1]
            for start in range(end - 15):
                part = run[start:end]
                if (start and run[start - 1] not in "=/.-") or (end < len(run) and run[end] not in "=/.-") or not re.search("[0-9]", part):
                    continue
                for kind in model.automata:
                    value = worth(part, kind)
                    if value is not None and value > 0:
                        best[end] = max(best[end], best[start] + value)
        parts = model.parts(run)
        assert sum(worth(run[a:b], kind) for a, kind, b in parts) == pytest.approx(best[-1])
        assert all(x[2] <= y[0] for x, y in zip(parts, parts[1:]))
        hit += len(parts)
    assert hit > 40


def test_a_long_label_teaches_no_end():
    long = Automaton(["a1" * LONGEST] * 50)
    whole = Automaton(["a1" * (LONGEST // 2)] * 50)
    assert min(whole.end) < max(whole.end) and max(long.end) < max(whole.end)


def test_awkward_rows(spark):
    found = find_secrets(awkward(spark)).collect()
    assert len(found) == 12
    none = hashlib.sha256(b"").hexdigest()
    assert all(r["spans"] == "" and r["base_sha256"] == none for r in found)
    assert find_secrets(empty(spark)).collect() == []


def test_stage_replaces_spans_only(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(99, None, "en", "s", None)], DOCS)
    spans = {r["doc_id"]: r["spans"] for r in find_secrets(docs).collect()}
    out = redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if r["doc_id"] == 99:
            assert r["text"] is None
            continue
        parts = [s.split(":") for s in spans[r["doc_id"]].split(",") if s]
        assert r["text"] == redacted(texts[r["doc_id"]], [(int(a), k, int(b)) for k, a, b in parts])
        assert base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])


def test_overlapping_spans_become_one_mark():
    assert redacted("abcdefghij", [(1, "assign", 6), (3, "hex", 8), (9, "hex", 10)]) == "a[assign secret]i[hex secret]"


@pytest.mark.parametrize("seed", range(4))
def test_automaton_learns_a_loop(seed):
    rng = random.Random(seed)
    made = ["x" + "9f" * (1 + min(30, int(rng.expovariate(0.3)))) for _ in range(400)]
    automaton = Automaton(made)
    assert len(automaton.step) < 10
    assert automaton.score(symbols("x" + "9f" * 60)) is not None
    assert automaton.score(symbols("q-")) is None
