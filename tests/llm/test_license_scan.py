import random
import re

from pagetables.llm.license_scan import TEMPLATES, license_scan
from tests.llm.data import DOCS, awkward, empty, prose


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def plain(text, templates=TEMPLATES):
    """Names of templates of which some stretch of the text has enough shingles."""
    w = words(text or "")
    shingles = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    found = set()
    for name, template in templates.items():
        t = words(template)
        wanted = {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
        for a in range(len(shingles)):
            near = set(shingles[a : a + len(t)])
            if len(wanted & near) >= 0.8 * len(wanted):
                found.add(name)
                break
    return ",".join(sorted(found))


def plain_best(text, templates=TEMPLATES):
    """Names with a stretch, begun early, that overlaps by half at most with each better one of another name."""
    w = words(text or "")
    shingles = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    found = []
    for name, template in templates.items():
        t = words(template)
        order = [tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))]
        wanted = set(order)
        places = [i for i, s in enumerate(shingles) if s in wanted]
        for a in places:
            near = [i for i in places if a <= i < a + len(t)]
            share = len({shingles[i] for i in near}) / len(wanted)
            if share >= 0.8 and order.index(shingles[a]) <= len(order) - 0.8 * len(wanted) + 1e-6:
                found.append((name, a, near[-1] + 5, share, len(wanted)))

    def beaten(f):
        return any(
            o[0] != f[0]
            and 2 * (min(o[2], f[2]) - max(o[1], f[1])) > min(o[2] - o[1], f[2] - f[1])
            and ((o[3], o[4]) > (f[3], f[4]) or ((o[3], o[4]) == (f[3], f[4]) and o[0] < f[0]))
            for o in found
        )

    return ",".join(sorted({f[0] for f in found if not beaten(f)}))


def test_versions_are_told_apart(spark):
    names = ["GPL-2.0", "GPL-3.0", "GPL-2.0-notice", "GPL-3.0-notice", "AGPL-3.0-notice", "LGPL-2.1-notice", "LGPL-3.0-notice"]
    names += ["BSD-2-Clause-text", "BSD-3-Clause-text", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0-name", "CC-BY-SA-4.0-name", "MIT-text", "ISC-text"]
    names += ["EPL-1.0-notice", "EPL-2.0-notice", "MPL-1.1-notice", "MPL-2.0-notice", "MIT-distributed", "CC-BY-4.0-short"]
    rng = random.Random(4)
    rows = [(i, f"{prose(rng, 40)}\n{TEMPLATES[n]}\n{prose(rng, 40)}", "en", "s", 1) for i, n in enumerate(names)]
    rows.append((99, TEMPLATES["GPL-2.0-notice"] + " " + TEMPLATES["GPL-3.0-notice"], "en", "s", 1))
    found = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {names[i]: found[i]["best"] for i in range(len(names))} == {n: n for n in names}
    assert found[99]["best"] == "GPL-2.0-notice,GPL-3.0-notice"
    assert "GPL-3.0-notice" in found[names.index("GPL-2.0-notice")]["licenses"]


def test_repeated_words_and_long_texts(spark):
    templates = {"loop": "a b c d e a b c d e f", "many": " ".join(f"w{i}" for i in range(400)), "part": " ".join(f"w{i}" for i in range(100, 130))}
    rng = random.Random(8)
    rows = []
    for i in range(40):
        w = templates["many"].split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(400)] = "x"
        text = "a b c d e " * rng.randrange(6) + "f " + " ".join(w[rng.randrange(80) :]) + " a b c d e a b c d e f" * rng.randrange(3)
        rows.append((i, text * rng.randrange(1, 3), "en", "s", 1))
    frame = spark.createDataFrame(list(templates.items()), "license string, text string")
    found = license_scan(spark.createDataFrame(rows, DOCS), frame).collect()
    want = {d: (plain(t, templates), plain_best(t, templates)) for d, t, *_ in rows}
    assert {r["doc_id"]: (r["licenses"], r["best"]) for r in found} == want
    assert len({*want.values()}) > 3


def test_equals_a_plain_search(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        text = prose(rng, rng.randrange(200))
        for _ in range(rng.randrange(3)):
            t = rng.choice(list(TEMPLATES.values())).split()
            if rng.random() < 0.2 and len(t) > 25:
                t[rng.choice((0, 1, -1))] = "changed"
            if rng.random() < 0.2:
                t = t[: len(t) // 2]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "\n# " + " ".join(t).upper() + "\n" + text[at:]
        rows.append((i, text, "en", "s", 1))
    found = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: r["licenses"] for d, r in found.items()} == {d: plain(t) for d, t, *_ in rows}
    assert {d: r["best"] for d, r in found.items()} == {d: plain_best(t) for d, t, *_ in rows}
    assert all(r["n_licenses"] == len([x for x in r["licenses"].split(",") if x]) for r in found.values())


def test_awkward_rows(spark):
    assert [tuple(r)[1:] for r in license_scan(awkward(spark)).collect()] == [(0, "", "")] * 12
    assert license_scan(empty(spark)).collect() == []
    rows = [(None, "Released under the MIT License.", None, None, None)] * 2 + [(1, "released  UNDER the MIT-License", "", "", 0)]
    templates = spark.createDataFrame([("M", TEMPLATES["MIT"], 1), ("N", None, 2), (None, "", 3), ("short", "the MIT", 4)], "license string, text string, fp int")
    found = license_scan(spark.createDataFrame(rows, DOCS), templates).collect()
    assert [(r["n_licenses"], r["licenses"]) for r in found] == [(1, "M")] * 3


def test_no_template_no_license(spark):
    templates = spark.createDataFrame([], "license string, text string")
    assert [r["n_licenses"] for r in license_scan(awkward(spark), templates).collect()] == [0] * 12
