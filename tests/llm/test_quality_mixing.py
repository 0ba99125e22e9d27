import math
import re
from collections import Counter, defaultdict

import pytest

from silt.llm import mixing, quality

SPACES = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(c not in SPACES for c in text), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_base_figures(which, request):
    df = request.getfixturevalue(which)
    rows = quality.line_first_cleaning(df).collect()
    assert len(rows) == df.count()
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
            assert got == base(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize(
    "line, fault",
    [
        ("This is a plain sentence that ends well.", None), ("Short title", None),
        ("Home | About | Contact | News", "navigation"), ("these words have no sentence mark at all", "punctuation"),
        ("win### big*** money$$$ now&&& here.", "punctuation"), ("All rights reserved.", "boilerplate"),
        ("Alle Rechte vorbehalten.", "boilerplate"), ("TÉRMINOS Y CONDICIONES.", "boilerplate"), ("Tous droits réservés.", "boilerplate"),
        ("BUY THIS NOW OR NEVER AGAIN!", "shouting"), ("word word word word word word.", "stutter"),
    ],
)
def test_line_rules(line, fault):
    assert quality.line_fault(line) == fault


def test_rejects_what_loses_too_much(spark):
    good = "A sentence of several words that is fine and stays. " * 1
    bad = "one two three four five six seven eight nine ten eleven twelve"
    other = "Another quite different line with many more words in it to count, and more still."
    rows = [(1, f"{good}\n{other}"), (2, f"{bad}\n{good.split('.')[0]}.\n{bad} again and again and yet again here")]
    out = {r["doc_id"]: r for r in quality.line_first_cleaning(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[1]["kept"] and out[1]["n_lines_removed"] == 0
    assert not out[2]["kept"] and out[2]["clean_text"] == good.split(".")[0] + "."


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "old", 7)], "doc_id int, text string, KEPT string, n_words int")
    r = quality.line_first_cleaning(df).first()
    assert r["n_words"] == 2 and r["kept"] is False


def test_empty_tables(no_docs):
    assert quality.line_first_cleaning(no_docs).count() == 0
    assert mixing.copies(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def targets(sizes):
    """Share by weight; over the cap stop there and share the excess anew."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_mix_meets_targets(which, request):
    df = request.getfixturevalue(which)
    rows = mixing.copies(df).collect()
    assert len(rows) == df.count()
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = targets(dict(size))
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
        assert all(r["source_size"] == size[s] for r in rows if r["source"] == s)


def test_reduction_tree_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 4}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = {r["doc_id"]: r["taken"] for r in mixing.copies(df).collect()}
    b = {r["doc_id"]: r["taken"] for r in mixing.copies(df.repartition(7)).collect()}
    assert a == b
    for r in mixing.copies(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 9


def test_mix_repeats_rows(odd_docs):
    plan = mixing.copies(odd_docs).collect()
    out = mixing.mix(odd_docs).collect()
    assert len(out) == sum(r["copies"] for r in plan)


def test_equal_rows_are_rounded_together(spark):
    rows = [(1, "a b c", "hot")] * 700 + [(i, "w " * (i % 7), "hot") for i in range(2, 300)] + [(900, "x " * 2000, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.copies(df).collect()
    assert len(out) == len(rows)
    taken = sum(r["taken"] for r in out if r["source"] == "hot")
    target = next(r["target"] for r in out if r["source"] == "hot")
    assert abs(taken - target) <= 7 and len({r["copies"] for r in out if r["doc_id"] == 1}) <= 2
    assert mixing.mix(df).count() == sum(r["copies"] for r in out)


def test_mix_keeps_rows_with_their_own_source(spark):
    rows = [(1, "a b c", s, k, -1) for k, s in enumerate(["x", "y", None] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, target int")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copy"]
    by = Counter(r["source"] for r in out.collect())
    plan = Counter()
    for r in mixing.copies(df).collect():
        plan[r["source"]] += r["copies"]
    assert by == plan
    assert all(r["source"] == ["x", "y", None][r["copies"] % 3] and r["target"] == -1 for r in out.collect())
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)


def test_each_stock_phrase_has_its_part():
    for part, phrase in quality.BOILERPLATE:
        said = re.sub(r"\(\?:([^|)]*)[^()]*(?:\([^()]*\)[^()]*)*\)\??", r"\1", phrase).replace("\\(c\\)", "(c)").replace("\\b", "")
        said = re.sub(r"\[(.)[^\]]*\](?:\{3\})?", r"\1", said).replace("?", "")
        assert part in said.lower() and part == part.lower(), (part, said)
