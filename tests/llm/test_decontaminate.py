import hashlib
import random
import re

from pagetables.llm.decontaminate import contamination, without_contaminated
from tests.llm.data import DOCS, awkward, awkward_rows, empty, prose

ITEMS = "item_id bigint, text string, kind string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for item, text, *_ in items:
            iw = words(text)
            n = min(10, len(iw))
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    if item is not None:
                        ids.add(item)
        listed = sorted(map(str, ids))
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.drop("items", "rid").collect()), key=str)


def some():
    rng = random.Random(12)
    items = [(i, prose(rng, n), "x") for i, n in enumerate((25, 40, 10, 11, 3, 1, 9, 5, 60))]
    items += [(20, items[0][1], "copy"), (21, items[0][1][:100], "part"), (0, items[0][1], "again"), (30, "one one one one one one one one one one one one", "")]
    items += [(None, prose(rng, 15), "no id"), (40, None, ""), (41, " ;-) ", "")]
    docs = []
    for i in range(80):
        text = prose(rng, rng.randrange(60))
        if i % 2:
            part = words(rng.choice(items[:9] + items[-3:-2])[1])
            a = rng.randrange(len(part))
            cut = part[a : a + rng.randrange(1, 30)]
            text = prose(rng, rng.randrange(6)) + " " + "; ".join(cut).upper() + "\n" + text
        if i % 9 == 0:
            text += " one" * rng.randrange(8, 15)
        docs.append((i if i % 10 else None, text, "en", "s", 1))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = some()
    frame = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(frame) == brute(docs, items)


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, awkward_rows()[0][1][:200], "x"), (2, "漢字 text", ""), (3, "byte and", "")]
    benchmark = spark.createDataFrame(items, ITEMS)
    assert got(contamination(awkward(spark), benchmark)) == brute(awkward_rows(), items)
    assert contamination(empty(spark), benchmark).collect() == []
    none = contamination(awkward(spark), benchmark.limit(0))
    assert got(none) == brute(awkward_rows(), [])


def test_stage_drops_exactly_the_contaminated(spark):
    docs, items = some()
    kept = without_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = sorted(t for (_, t, *_), row in ((d, brute([d], items)[0]) for d in docs) if not row[5])
    assert sorted(r["text"] for r in kept.collect()) == clean
