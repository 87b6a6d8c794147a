"""Secret scans: formats learnt as probabilistic automata from labelled credentials.

Learning merges states of a prefix tree.  The tree of a kind's labelled credentials counts
how often each state is left by each class of characters and how often it ends.  States are
taken breadth first; a state is merged into the nearest of the earlier ones whose counts agree
within the Hoeffding bound, as do those of their successors.  What remains is a probabilistic
automaton of the format.

Labels are the base rules' own matches in the corpus, ``SAMPLE`` of each kind at most, and
generated examples of public formats, so that an automaton exists without any match.  One of
these, *opaque*, has no fixed beginning: 20 to 48 random letters of both cases and digits, after
a short word or none.  Its automaton finds credentials whose format nobody listed.

Candidates are the parts, with a digit, of runs of token characters.  They begin at the
run's beginning or after a sign and end before a sign or at the run's end.  Every automaton
scores them: the mean log likelihood of a character in the format against that in running
text, where a character depends on the one before: half by how often the corpus has the two
characters in a row, half by their classes, but for a share ``ANY`` that is any character.
So words and names with digits are text, also where no document has their letters in a row.
A candidate above ``MARGIN``
is a span of that format.  Of those that overlap, the choice with the greatest sum of what
they have above the margin is taken, in one pass over the run.  One inside a base span is
left out; one that contains a base span, or reaches beyond it, is a span beside it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled, utf8

#: The kinds of the base rules in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORTH = re.compile(r"passw|secret|token|api_?key")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Labelled matches of a kind that are learnt from at most.
SAMPLE = 1000
#: Generated examples of each public format.
EXAMPLES = 300
#: Confidence of the test that keeps states apart.
ALPHA = 0.05
#: Nats by which a character must be likelier in the format than in words.
MARGIN = 0.5
#: Share of the characters in running text that may be any: names with digits are text as well.
ANY = 0.1
#: Characters of a labelled match that are learnt from; a longer one has no end there.
LONGEST = 256
#: Characters of a candidate at least, and the signs at which one can begin and end.
SHORTEST = 16
SIGNS = "=/.-"
SEED = 2

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{16,}")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"


def _public_formats() -> dict[str, list[str]]:
    """Examples of widely documented credential formats, the same ones in every run."""
    rng = random.Random(SEED)
    upper, mixed = _LETTERS.upper() + _DIGITS, _LETTERS + _LETTERS.upper() + _DIGITS
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    return {
        "access": ["AKIA" + some(upper, 16) for _ in range(EXAMPLES)],
        "hex": [some("0123456789abcdef", rng.choice((32, 40, 64))) for _ in range(EXAMPLES)],
        "forge": ["gh" + rng.choice("pousr") + "_" + some(mixed, 36) for _ in range(EXAMPLES)],
        "chat": ["xox" + rng.choice("bap") + "-" + some(_DIGITS, 12) + "-" + some(mixed, 24) for _ in range(EXAMPLES)],
        "cloud": ["AIza" + some(mixed + "-_", 35) for _ in range(EXAMPLES)],
        "opaque": [_opening(rng) + some(mixed, rng.randrange(20, 49)) for _ in range(EXAMPLES)],
        "pay": ["sk_live_" + some(mixed, 24) for _ in range(EXAMPLES)],
        "signed": ["eyJ" + some(mixed, 33) + ".eyJ" + some(mixed, 60) + "." + some(mixed + "-_", 43) for _ in range(EXAMPLES)],
    }


def _opening(rng: random.Random) -> str:
    """One or two short words, each with a sign after it, or nothing."""
    words = ("".join(rng.choices(_LETTERS, k=rng.randrange(2, 7))) + rng.choice("_-") for _ in range(rng.randrange(3)))
    return "".join(words)


#: Fixed beginnings that stay letter by letter; any other character counts as its class.
_LITERAL = ("AKIA", "gh", "xox", "AIza", "sk_live_", "eyJ")


def symbols(text: str) -> list[str]:
    """The characters as the automata read them: hexadecimal, other letters, digits, signs."""
    head = next((x for x in _LITERAL if text.startswith(x)), "")
    return list(head) + _classes(text[len(head) :])


def _classes(text: str) -> list[str]:
    out = []
    for c in text:
        if c in _DIGITS:
            out.append("9")
        elif "a" <= c <= "f":
            out.append("f")
        elif c.islower():
            out.append("z")
        elif c.isupper():
            out.append("Z")
        else:
            out.append("_" if c not in "-./" else c)
    return out


#: How many characters each class stands for: a class's probability is shared among them.
_SIZE = {"9": 10, "f": 6, "z": 20, "Z": 26, "_": 3}
#: The same classes, then the three signs that stand alone, then all else, by byte.
_CLASS_SIZE = np.array([10, 6, 20, 26, 3, 1, 1, 1, 1])
_OTHER = len(_CLASS_SIZE) - 1
_CLASS_OF = np.full(256, _OTHER, np.uint8)
for _i, _some in enumerate((_DIGITS, "abcdef", "ghijklmnopqrstuvwxyz", _LETTERS.upper(), "_+=", "-", ".", "/")):
    _CLASS_OF[[ord(_c) for _c in _some]] = _i
#: Code of each byte: token characters from 1, all else 0; and the class of each code.
_TOKEN = np.flatnonzero(_CLASS_OF < _OTHER)
_CODES = len(_TOKEN) + 1
_CODE_OF = np.zeros(256, np.int64)
_CODE_OF[_TOKEN] = np.arange(1, _CODES)
_CODE_CLASS = np.concatenate(([_OTHER], _CLASS_OF[_TOKEN])).astype(np.int64)


@dataclass
class State:
    ends: int = 0
    out: Counter = field(default_factory=Counter)
    to: dict[str, int] = field(default_factory=dict)

    @property
    def seen(self) -> int:
        return self.ends + sum(self.out.values())


class Automaton:
    """Probabilistic automaton by state merging over a prefix tree."""

    def __init__(self, examples: list[str], alpha: float = ALPHA) -> None:
        self.states = [State()]
        self.alpha = alpha
        for text in examples:
            at = 0
            for s in symbols(text[:LONGEST]):
                state = self.states[at]
                state.out[s] += 1
                if s not in state.to:
                    state.to[s] = len(self.states)
                    self.states.append(State())
                at = state.to[s]
            self.states[at].ends += len(text) <= LONGEST
        self._merge_states()
        self._finish()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def _compatible(self, a: int, b: int) -> bool:
        open_, seen = [(a, b)], set()
        while open_:
            a, b = pair = open_.pop()
            if a == b or pair in seen:
                continue
            seen.add(pair)
            x, y = self.states[a], self.states[b]
            n, m = x.seen, y.seen
            if self._differ(x.ends, n, y.ends, m):
                return False
            for s in x.out.keys() | y.out.keys():
                if self._differ(x.out[s], n, y.out[s], m):
                    return False
                if s in x.to and s in y.to:
                    open_.append((x.to[s], y.to[s]))
        return True

    def _distance(self, a: int, b: int) -> float:
        """How far apart the ways out of two states are."""
        x, y = self.states[a], self.states[b]
        n, m = max(1, x.seen), max(1, y.seen)
        ways = sum(abs(x.out[s] / n - y.out[s] / m) for s in sorted(x.out.keys() | y.out.keys()))
        return ways + abs(x.ends / n - y.ends / m)

    def _fold(self, a: int, b: int) -> None:
        """The tree below b is added to the states from a."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            x, y = self.states[a], self.states[b]
            x.ends += y.ends
            for s, n in y.out.items():
                x.out[s] += n
                if s in x.to:
                    open_.append((x.to[s], y.to[s]))
                else:
                    x.to[s] = y.to[s]

    def _merge_states(self) -> None:
        kept, queue = [0], [(0, s) for s in sorted(self.states[0].to)]
        while queue:
            parent, s = queue.pop(0)
            at = self.states[parent].to[s]
            if at in kept:
                continue
            alike = [k for k in kept if self._compatible(k, at)]
            same = min(alike, key=lambda k: self._distance(k, at), default=None)
            if same is None:
                kept.append(at)
            else:
                self.states[parent].to[s] = same
                self._fold(same, at)
            done = set(kept)
            queue = [(k, c) for k in kept for c in sorted(self.states[k].to) if self.states[k].to[c] not in done]

    def _finish(self) -> None:
        """Tables of the reachable states: log probability of a character, next state, end."""
        order, place = [0], {0: 0}
        for at in order:
            for s in sorted(self.states[at].to):
                if (to := self.states[at].to[s]) not in place:
                    place[to] = len(order)
                    order.append(to)
        self.step, self.end = [], []
        for at in order:
            state = self.states[at]
            total = state.seen + 1
            self.step.append(
                {s: (math.log(n / total / _SIZE.get(s, 1)), place[state.to[s]]) for s, n in state.out.items()}
            )
            self.end.append(math.log(max(state.ends, 0.5) / total))
        del self.states

    def score(self, read: list[str]) -> float | None:
        """Mean log likelihood of a character, the end included; None outside the format."""
        at, total = 0, 0.0
        for s in read:
            step = self.step[at].get(s)
            if step is None:
                return None
            total += step[0]
            at = step[1]
        return (total + self.end[at]) / (len(read) + 1)


@dataclass
class SecretModel:
    automata: dict[str, Automaton]
    #: Log probability of a character, by the code before it and its own.
    text: np.ndarray
    margin: float = MARGIN

    def best(self, candidate: str) -> tuple[str, float] | None:
        """The format whose likelihood exceeds that of running text by the most."""
        read = symbols(candidate)
        scored = ((a.score(read), kind) for kind, a in self.automata.items())
        score, kind = max(((s, k) for s, k in scored if s is not None), default=(None, None))
        if score is None:
            return None
        codes = _CODE_OF[np.frombuffer(f" {candidate} ".encode(), np.uint8)]
        plain = float(self.text[codes[:-1], codes[1:]].mean())
        return (kind, score - plain) if score - plain > self.margin else None

    def parts(self, run: str) -> list[tuple[int, str, int]]:
        """The parts of a run, as (start, kind, end), that are secrets and do not overlap.

        ``best`` has the greatest sum of scores above the margin up to a place.  Readings of
        one automaton that are in the same state differ in their past only, so the better
        one goes on; those too short to end yet are kept apart.
        """
        n, kinds = len(run), list(self.automata)
        tables = [self.automata[k] for k in kinds]
        codes = _CODE_OF[np.frombuffer(run.encode(), np.uint8)]
        first = (self.text[0, codes] + self.margin).tolist()
        inner = [0.0, *(self.text[codes[:-1], codes[1:]] + self.margin).tolist()]
        last = (self.text[codes, 0] + self.margin).tolist()
        read = _classes(run)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        #: Readings as (automaton, start, state, value, has a digit), by where they go on.
        later: dict[int, list[tuple]] = {}
        young: list[tuple] = []
        grown: dict[tuple[int, int, bool], tuple[float, int]] = {}
        for at in range(n + 1):
            if at:
                best[at] = best[at - 1]
            if at == n or run[at] in SIGNS:
                for (k, state, digit), (value, start) in grown.items():
                    if digit and (total := value + tables[k].end[state] - last[at - 1]) > best[at]:
                        best[at], back[at] = total, (start, kinds[k])
            if at == n:
                break
            if n - at >= SHORTEST and (at == 0 or run[at - 1] in SIGNS):
                head = next((x for x in _LITERAL if run.startswith(x, at)), "")
                for k, table in enumerate(tables):
                    state, value = 0, best[at]
                    for i, s in enumerate(head, at):
                        step = table.step[state].get(s)
                        if step is None:
                            break
                        state, value = step[1], value + step[0] - (inner[i] if i > at else first[i])
                    else:
                        later.setdefault(at + len(head), []).append((k, at, state, value, False))
            young += later.pop(at, ())
            s, digit = read[at], read[at] == "9"
            moved, young_before, young = {}, young, []
            for (k, state, had), (value, start) in grown.items():
                if step := tables[k].step[state].get(s):
                    key, value = (k, step[1], had or digit), value + step[0] - inner[at]
                    if key not in moved or value > moved[key][0]:
                        moved[key] = (value, start)
            for k, start, state, value, had in young_before:
                if step := tables[k].step[state].get(s):
                    value += step[0] - (inner[at] if at > start else first[at])
                    if at + 1 - start < SHORTEST:
                        young.append((k, start, step[1], value, had or digit))
                        continue
                    key = (k, step[1], had or digit)
                    if key not in moved or value > moved[key][0]:
                        moved[key] = (value, start)
            grown = moved
        out, at = [], n
        while at > 0:
            if back[at]:
                out.append((*back[at], at))
                at = back[at][0]
            else:
                at -= 1
        return out[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base rules' matches, in order."""
    found = []
    if _WORTH.search(text.lower()):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, model: SecretModel) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans, each as (start, kind, end)."""
    base = base_spans(text)
    taken = [(a, b) for a, _, b in base]
    more = []
    for m in _CANDIDATE.finditer(text):
        for a, kind, b in model.parts(m[0]):
            a, b = a + m.start(), b + m.start()
            if not any(x <= a and b <= y for x, y in taken):
                more.append((a, kind, b))
    named = [(a, KINDS[k], b) for a, k, b in base]
    rank = {kind: i for i, kind in enumerate(KINDS)}
    return named, sorted(named + more, key=lambda s: (s[0], rank.get(s[1], len(KINDS)), s[1], s[2]))


def _pairs(data: np.ndarray) -> np.ndarray:
    """How often each two codes stand in a row."""
    codes = _CODE_OF[data]
    return np.bincount(codes[:-1] * _CODES + codes[1:], minlength=_CODES**2)


def _text_model(pairs: np.ndarray) -> np.ndarray:
    """Log probabilities from counts of neighbouring codes."""
    by_class = np.zeros((len(_CLASS_SIZE), len(_CLASS_SIZE)))
    np.add.at(by_class, (_CODE_CLASS[:, None], _CODE_CLASS[None, :]), pairs)
    share = (by_class + 1) / (by_class + 1).sum(axis=1, keepdims=True) / _CLASS_SIZE
    classes = share[_CODE_CLASS[:, None], _CODE_CLASS[None, :]]
    seen = (pairs + classes) / (pairs.sum(axis=1, keepdims=True) + 1)
    return np.log((1 - ANY) / 2 * (seen + classes) + ANY / _CODES)


def learn(docs: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> SecretModel:
    """Automata of all formats from the corpus's labelled matches and the public examples.

    Neighbouring characters are counted over all texts but for the labelled matches in them; of each kind's different matches those
    with the least hash are learnt from, ``sample`` at most.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_CODES**2, np.int64)
        for batch in batches:
            pairs += _pairs(utf8(batch["text"])[0])
            out = []
            for text in batch["text"].to_pylist():
                done = 0
                for a, kind, b in base_spans(text or ""):
                    pairs -= _pairs(np.frombuffer(text[max(a, done) : b].encode(), np.uint8))
                    done = max(done, b)
                    value = _ASSIGN.match(text, a, b)[1] if kind == 0 else text[a:b]
                    out.append((KINDS[kind], value[: LONGEST + 1], 1))
            yield _labels(out)
        yield _labels([("pair", str(i), int(n)) for i, n in enumerate(pairs) if n])

    rows = pick(docs, text="string").mapInArrow(labelled, "kind string, value string, n bigint")
    found = settled(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")), "labelled")
    formats = _public_formats()
    for kind in KINDS:
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        formats[kind] = [r["value"] for r in rows] + formats.get(kind, [])
    pairs = np.zeros(_CODES**2)
    for r in found.where("kind = 'pair'").collect():  # 4,761 at most
        pairs[int(r["value"])] = r["n"]
    automata = {k: Automaton(v) for k, v in formats.items() if v}
    return SecretModel(automata, _text_model(pairs.reshape(_CODES, _CODES)), margin)


def _labels(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    types = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["kind", "value", "n"])


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` of every row.

    ``spans`` lists all spans as kind:start:end in code points, end exclusive, by start, then
    kind.  Null and empty texts have none.  Every row is returned, repeated ones too; other
    columns are ignored.  The model is learnt from ``docs`` unless it is given.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, joined = [], []
            for text in batch["text"].to_pylist():
                base, spans = all_spans(text or "", held.value)
                for kind, column in zip(KINDS, counts, strict=True):
                    column.append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind} secret]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, model: SecretModel | None = None) -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced, ``n_chars`` counted anew; rows and columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, all_spans(t, held.value)[1]) for t in batch["text"].to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
