"""Line dedup, ranked search and spelling variants against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import awkward, awkward_rows, documents, folder, nothing, spark  # noqa: F401

from eviflow.llm import lexical, line_dedup, spelling

SPACES = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- line dedup ----------------------------------------------------------------------------------
def slow_lines(rows, min_chars=40, min_docs=5):
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text); a null doc_id is below all others."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACES).translate(UPPER)].add(-math.inf if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(SPACES).translate(UPPER)
            goes = len(key) >= min_chars and len(holders[key]) >= min_docs and (doc is None or doc != max(holders[key]))
            kept += [] if goes else [line]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def shared_lines(seed, docs=60):
    rng = random.Random(seed)
    pool = [f"Line {k} with É and some more words to be long enough, {'x' * (k % 7)}" for k in range(12)] + ["short line", "", "   ", "é" * 39, "é" * 40]
    rows = []
    for d in range(docs):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", "  "]) for _ in range(rng.randrange(0, 150))]
        rows.append((rng.choice([d, d // 2]), "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    return rows + [(None, rows[3][1]), (None, None), rows[3], (99, ""), (98, pool[0] + "\n" + pool[0])]


@pytest.mark.parametrize("hot_lines", [line_dedup.HOT_LINES, 1])
def test_lines_equal_brute_force(spark, folder, monkeypatch, hot_lines):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot_lines)  # 1: nearly every key is answered by the aggregates for hot keys
    rows = shared_lines(1)
    found = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder)
    got = Counter(tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == slow_lines(rows)
    assert sum(n for (_, _, dropped, _), n in got.items() if dropped) > 20


def test_bitmaps_tell_kept_lines(spark, folder):
    line = "a line that is long enough to count, forty characters"
    rows = [(d, "\n".join(["first", line] + [str(i) for i in range(100)] + [line])) for d in range(6)]
    maps = line_dedup.keep_bitmaps(line_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string")), folder).collect()
    assert sorted(m.doc_id for m in maps) == [0, 1, 2, 3, 4]  # the largest keeps its lines
    for m in maps:
        gone = {64 * k.word + b for k in m.keep for b in range(64) if not (k.bits >> b) & 1}
        assert gone == {1, 102} and m.n_dropped == 2


def test_lines_awkward(spark, awkward, nothing, folder):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = Counter(tuple(r) for r in line_dedup.dedup(awkward, f"{folder}/a", min_docs=2).collect())
    assert got == slow_lines(rows, min_docs=2)
    assert line_dedup.dedup(nothing, f"{folder}/b").count() == 0


# --- ranked search -------------------------------------------------------------------------------
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def slow_search(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score), every document scored."""
    cut = [(doc, Counter(TERM.findall((text or "").translate(UPPER)))) for doc, text in docs]
    cut = [(doc, c, sum(c.values())) for doc, c in cut if c]
    total, length = len(cut), sum(n for *_, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for doc, c, n in cut:
            m = 10 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            scored += [(-score, math.inf if doc is None else doc)] if score > 0 else []
        out += [(item, rank, None if doc == math.inf else doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made_texts(seed, docs=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(500)] + ["Été", "naïve", "x_y", "42"]
    rows = [(d, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40, 300])))) for d in range(docs)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20])))) for i in range(25)]
    return rows + [(None, rows[0][1]), rows[1], rows[1], (900, None), (901, "!!")], items + [(25, None), (26, "unseen"), (26, items[0][1])]


@pytest.mark.parametrize(("leaf", "shard"), [(lexical.LEAF, lexical.SHARD_DOCS), (2, 37)])
def test_search_equals_brute_force(spark, folder, monkeypatch, leaf, shard):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    rows, items = made_texts(5)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.search(docs, asked, f"{folder}/one").collect()), key=str)
    assert got == slow_search(rows, items)
    blocks = sorted((tuple(r) for r in lexical.search(docs, asked, f"{folder}/blocks", block_items=5).collect()), key=str)
    assert blocks == got


def test_range_maxima_bound_every_score():
    rng = np.random.default_rng(3)
    n, terms = 200, 12
    held = [np.unique(rng.integers(0, terms, rng.integers(0, 9))) for _ in range(n)]
    shard = lexical.Shard(rng.permutation(n), rng.integers(5, 50, n), held, [rng.integers(1, 5, len(h)) for h in held], rng.integers(1, 900, terms), (n, 5000))
    asked = np.arange(0, terms, 2)
    for low, high in [(0, 200), (3, 4), (17, 90), (120, 200)]:
        bound, peak = (x[0] for x in shard.maxima(asked, np.array([low]), np.array([high])))
        own = [shard.impact[(shard.keys >= t * n + low) & (shard.keys < t * n + high)] for t in asked]
        assert bound == sum(x.max(initial=0) for x in own)
        assert (low <= peak < high or not bound) and bound >= shard.scores(asked, np.arange(low, high)).max()


def test_search_prunes(spark):
    """One document that holds all rare terms ends the search before most documents are scored."""
    n = 4000
    held, tfs = [np.array([0]) for _ in range(n)], [np.array([1]) for _ in range(n)]
    held[1234], tfs[1234] = np.array([0, 1, 2]), np.array([9, 9, 9])
    shard = lexical.Shard(np.arange(n), np.full(n, 50), held, tfs, np.array([1, 900, 900]), (n, 50 * n))
    seen = []
    scores, intervals = shard.scores, shard.interval_scores
    shard.scores = lambda terms, docs: seen.append(len(docs)) or scores(terms, docs)
    shard.interval_scores = lambda terms, low, high: seen.append(int((high - low).sum())) or intervals(terms, low, high)
    best = []
    shard.search(np.array([0, 1, 2]), best, 1)
    assert best[0][1] == 1234 and sum(seen) < 100


def test_search_awkward(spark, awkward, nothing, folder):
    items = spark.createDataFrame([(1, "fox river WORD"), (2, None), (3, "straße 漢字 x")], "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.search(awkward, items, f"{folder}/a").collect()), key=str)
    assert got == slow_search([(r[0], r[1]) for r in awkward_rows()], [tuple(r) for r in items.collect()])
    assert lexical.search(nothing, items, f"{folder}/b").count() == 0
    assert lexical.search(awkward, items.limit(0), f"{folder}/c").count() == 0


# --- spelling ------------------------------------------------------------------------------------
def slow_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def slow_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out)


def misspelt(seed):
    rng = random.Random(seed)
    letters = "abcdeéß"
    base = ["".join(rng.choices(letters, k=rng.randrange(7, 12))) for _ in range(40)]
    words = list(base)
    for _ in range(3):
        for w in list(words)[:120]:
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return {w: rng.choice([2, 3, 25, 300, 3000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("crowd", [spelling.CROWD, 1])
def test_forms_equal_all_pairs(spark, folder, crowd):
    words = misspelt(2)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.forms(frame, folder, crowd=crowd).collect()
    want = slow_groups(words)
    assert sorted((r.word, r.form, r.n, r.n_near, r.form_n) for r in found) == sorted((w, f, n, k, m) for w, f, _, n, k, m in want)
    assert sum(r.n_near for r in found) > 300


def test_signatures_meet_every_near_pair(spark):
    """Also with any letters of the range, and at the ends of words."""
    rng = random.Random(4)
    alphabet = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    pairs = []
    for _ in range(400):
        w = "".join(rng.choices(alphabet, k=rng.randrange(7, 14)))
        i = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
        v = rng.choice([w[:i] + rng.choice(alphabet) + w[i:], w + rng.choice(alphabet), w[:i] + rng.choice(alphabet) + w[i + 1 :]])
        pairs += [(w, v)] if one_edit(w, v) else []
    words = spark.createDataFrame([(w, 1) for w in {x for p in pairs for x in p}], "word string, n long")
    keys = defaultdict(set)
    for r in spelling.split_crowds(spelling.signatures(words), crowd=0).collect():
        keys[r.word, r.role].add(r.sig)
    for w, v in pairs:
        w, v = sorted((w, v), key=len)
        assert keys[w, 0] & keys[v, 0] if len(w) == len(v) else keys[w, 1] & keys[v, 2]


def test_grouped_documents(spark, documents, folder):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = spelling.grouped(documents, folder).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == slow_groups(slow_words(rows))


def test_roots_follow_long_chains(spark, folder):
    """Each word's form is a letter longer and ten times as frequent."""
    text, word = [], "abcdefg"
    for k in range(4):
        text += [word] * (2 * 10**k)
        word += "hijk"[k]
    counts = Counter(text)
    doc = next(d for d in range(99) if slow_words([(d, " ".join(text))]) == counts)  # no run of it loses a letter
    frame = spark.createDataFrame([(doc, " ".join(text))], "doc_id long, text string")
    got = {r.word: r.root for r in spelling.grouped(frame, folder).collect()}
    assert set(got.values()) == {"abcdefghij"}


def test_spelling_awkward(spark, awkward, nothing, folder):
    got = sorted((tuple(r) for r in spelling.grouped(awkward, f"{folder}/a").collect()), key=lambda r: r[0])
    assert got == slow_groups(slow_words([(r[0], r[1]) for r in awkward_rows()]))
    assert spelling.grouped(nothing, f"{folder}/b").count() == 0
