"""Mixture, sharding, suffix arrays, nearest neighbours, classifiers and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import PROSE, awkward, awkward_rows, documents, folder, nothing, spark  # noqa: F401
from pyspark.sql import functions as F

from eviflow.llm import language, mixture, quality_model, sharding, suffix, vptree
from eviflow.llm.dc3 import ranks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text):
    return len(WORDS.findall(text or ""))


# Mixture


def slow_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    left, out = total * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s]
    while open_:
        all_ = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / all_ for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else share[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def found_targets(spark, folder, sizes):
    rows = spark.createDataFrame([(f"s{i:05}", n) for i, n in enumerate(sizes)], "source string, size long")
    found = mixture.source_targets(rows, folder).orderBy("s").collect()
    assert [r["source"] for r in found] == [f"s{i:05}" for i in range(len(sizes))]
    return [r["target"] for r in found]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [], [0, 10], [0], [3, 1000, 50, 0, 7], [1, 4, 16, 64, 256, 1024, 4096, 5]])
def test_targets(spark, folder, sizes):
    found = found_targets(spark, folder, sizes)
    assert found == pytest.approx(slow_targets(sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes, strict=True))


def test_blocks_of_many_sources(spark, folder):
    """100,000 sources, a third of all blocks in one: every quota and every shard's size is exact."""
    quotas = spark.range(100_000).select(F.col("id").alias("s"), F.when(F.col("id") == 777, 100_000).otherwise(F.col("id") % 5).alias("quota"))
    dealt = mixture.deal_blocks(quotas, 8, seed=3).toPandas()
    ends = np.array(dealt["room"].tolist())
    want = np.where(dealt["node"] == 777, 100_000, dealt["node"] % 5)
    assert len(dealt) == 100_000 and (ends[:, -1] == want).all()
    shards = np.diff(ends, axis=1, prepend=0)
    assert shards.min() >= 0 and np.ptp(shards.sum(axis=0)) <= 1
    assert all(np.gcd(a, max(q, 1)) == 1 for a, q in zip(dealt["step"], want))


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_mix_taken_from_blocks(request, folder, table):
    """What every document gives, counted word by word over the blocks that the plan deals to each shard."""
    docs, shards, size = request.getfixturevalue(table), 5, 64
    rows = mixture.mix(docs, folder, carry=["doc_id", "source"], block_words=size, bucket_docs=3, shards=shards).collect()
    plan = {r["source"]: r for r in docs.sparkSession.read.parquet(f"{folder}/plan").collect()}
    hashed = docs.sparkSession.read.parquet(f"{folder}/sizes").collect()
    of = defaultdict(list)
    for r in hashed:
        of[r["source"]].append(((r["h"] % -(-plan[r["source"]]["n_docs"] // 3)), r["h"], r["size"], r["doc"]["doc_id"]))
    want = Counter()
    for source, own in of.items():
        p, stream = plan[source], [doc for _, _, n, doc in sorted(own, key=lambda o: o[:3]) for _ in range(n)]
        for shard in range(shards):
            for place in range(p["ends"][shard - 1] if shard else 0, p["ends"][shard]):
                block = next(b for b in range(p["quota"]) if b * p["step"] % p["quota"] == place)
                for word in range(block * size, min((block + 1) * size, p["take"])):
                    want[source, stream[word % len(stream)], shard] += 1
    found = Counter()
    for r in rows:
        for d in r["draws"]:
            found[r["doc"]["source"], r["doc"]["doc_id"], d["shard"]] += d["words"]
        assert r["taken"] == sum(d["words"] for d in r["draws"])
    assert found == want


def test_quota_tree_is_exact():
    quotas = [1000, 17, 0, 3, 260]
    dealt = mixture.split_quotas(quotas, 7, seed=1)
    assert dealt.sum(axis=0).tolist() == quotas and dealt.min() >= 0
    assert max(dealt.sum(axis=1)) - min(dealt.sum(axis=1)) <= 1
    assert (dealt == mixture.split_quotas(quotas, 7, seed=1)).all()
    # Each shard's share of a source is near the source's share of all.
    many = np.mean([mixture.split_quotas([400, 100], 4, seed=s)[0] for s in range(200)], axis=0)
    assert many == pytest.approx([100, 25], rel=0.03)


@pytest.mark.parametrize("table", ["awkward", "documents", "nothing"])
def test_mix(request, folder, table):
    docs = request.getfixturevalue(table)
    rows = mixture.mix(docs, folder, carry=["doc_id", "source"], block_words=64, bucket_docs=3).collect()
    again = mixture.mix(docs, None, carry=["doc_id", "source"], block_words=64, bucket_docs=3).collect()
    flat = lambda rs: Counter((r["doc"]["doc_id"], r["size"], r["taken"], tuple((d["block"], d["shard"], d["words"]) for d in r["draws"])) for r in rs)
    assert flat(rows) == flat(again)
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += n_words(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, slow_targets([sizes[s] for s in order]), strict=True))
    taken, blocks = Counter(), defaultdict(Counter)
    for r in rows:
        source = r["doc"]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(d["words"] for d in r["draws"])
        taken[source] += r["taken"]
        for d in r["draws"]:
            blocks[source, d["block"]][d["shard"]] += d["words"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert all(len(shards) == 1 and sum(shards.values()) <= 64 for shards in blocks.values())
    assert len(rows) == docs.count()


def test_mixed_documents_carry_all_columns(awkward):
    found = mixture.mixed_documents(awkward, shards=4)
    assert found.columns == awkward.columns
    assert all(n_words(r["text"]) for r in found.collect())


# Sharding


@pytest.mark.parametrize("table", ["awkward", "documents", "nothing"])
def test_sharding(request, table):
    docs = request.getfixturevalue(table)
    rows = sharding.placed(docs, shards=40).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, shard_of = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def slow_draw(key, level, weights):
    u = lambda c: (int(hashlib.md5(f"{level}{c}:{key}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
    return min(weights, key=lambda c: (-math.log(u(c)) / weights[c], c))


def slow_shard(key, n):
    nodes = sharding.tree(n)
    region = slow_draw(key, "region", dict.fromkeys(nodes, 1.0))
    rack = slow_draw(key, "rack", dict.fromkeys(nodes[region], 1.0))
    return slow_draw(key, "shard", dict.fromkeys(nodes[region][rack], 1.0))


@pytest.mark.parametrize("shards", [1, 2, 3, 7, 8, 9, 40])
def test_shard_draws_and_growth(documents, shards):
    rows = sharding.placed(documents, shards=shards).collect()
    assert all(r["shard"] == slow_shard(str(r["doc_id"]), shards) and r["grown_shard"] == slow_shard(str(r["doc_id"]), shards + 1) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], shards) for r in rows)


def test_changed_weights_move_rows_in_their_subtree_only(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    nodes = sharding.tree(40)
    key = F.col("doc_id").cast("string")
    both = sharding.descend(sharding.descend(docs, key, "a", nodes), key, "b", nodes, {(1, 3, 11): 3.0})
    moved = [(r["a"], r["b"]) for r in both.collect() if r["a"] != r["b"]]
    assert moved and all(a % 8 == 3 and b == 11 for a, b in moved)


# Suffix arrays


def test_suffix_ranks():
    draw = np.random.default_rng(0)
    for _ in range(400):
        text = draw.integers(1, draw.integers(2, 6), draw.integers(1, 70))
        for depth in (1, 3, 5, 50, 100):
            order = np.argsort(ranks(text, depth), kind="stable")
            prefixes = [tuple(text[i : i + depth]) for i in order]
            assert prefixes == sorted(prefixes)


def slow_removal(rows, length):
    first = {}
    known = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in known:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, math.inf), i)
    out = Counter()
    for (i, _), (n, b) in zip(rows, known, strict=True):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < n:
                gone[k : k + length] = True
        kept = bytes(c for c, x in zip(b, gone, strict=False) if not x)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(b) else 0
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("table", "length", "hot"), [("awkward", 50, 1024), ("awkward", 30, 0), ("documents", 50, 1024), ("documents", 100, 1024), ("documents", 50, 0), ("nothing", 50, 1024)])
def test_suffix_dedup(request, monkeypatch, folder, table, length, hot):
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = suffix.dedup(docs, folder, length=length, hot_blocks=hot, part_bytes=1 << 14).collect()
    assert Counter(map(tuple, found)) == slow_removal(rows, length)


def test_anchors_of_segments(monkeypatch):
    """Runs don't depend on where the text is cut for computing, and cover each window once."""
    draw = np.random.default_rng(2)
    text = draw.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 30, 1000, 1049, 3000, 5000])
    whole = suffix.anchors(text, ends, 50)
    monkeypatch.setattr(suffix, "SEGMENT", 256)
    cut = suffix.anchors(text, ends, 50)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    windows = np.concatenate([np.arange(f, f + n) for f, n in zip(whole[0], whole[1], strict=True)])
    want = [k for a, b in zip([0, *ends[:-1]], ends, strict=True) for k in range(a, b - 49)]
    assert sorted(windows.tolist()) == want


def test_suffix_stage_keeps_columns(awkward, spark, folder):
    kept = suffix.dedup(awkward, folder, length=50, carry=True)
    assert kept.schema == awkward.schema and kept.count() == awkward.count()
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert by_id[-7]["text"].startswith(PROSE) and by_id[7]["text"] == "." and by_id[7]["size"] == "s"


# Nearest neighbours


def vectors(n=1500, width=8, seed=4):
    draw = np.random.default_rng(seed)
    out = draw.normal(size=(n, width))
    out[n // 2 : n // 2 + 200] = out[0]  # one very common vector
    return [(i, [float(x) for x in v], "e") for i, v in enumerate(out)]


ODD = [(2000, None, "e"), (2020, [0.0] * 8, "e"), (2040, [1.0] * 7 + [None], "e"), (2060, [float("nan")] * 8, "e"), (2080, [float("inf")] * 8, "e"), (None, [1.0] * 8, "e"), (40, [2.0] * 8, "e"), (2100, [1.0] * 3, None), (2101, [1.0] * 3, "e")]


@pytest.mark.parametrize("shape", [{}, {"shard_rows": 300, "block_queries": 20}])
def test_nearest_are_exact(spark, shape):
    rows = vectors() + ODD
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = defaultdict(list)
    for r in vptree.search(frame, **shape).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, v in usable:
        if q % 20 or q == 40:  # 40 is held twice
            continue
        near = []
        for i, w in usable:
            if i != q and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w, strict=True):
                    total += a * b
                near.append((-total, i))
        assert found[q] == [(i, -s) for s, i in sorted(near)[:20]]
    assert set(found) == {i for i, v in usable if i % 20 == 0}


def test_relaxed_search_keeps_most(spark):
    frame = spark.createDataFrame([r[:2] for r in vectors(seed=5)], "vec_id long, embedding array<double>")
    exact = {(r["query_id"], r["vec_id"]) for r in vptree.search(frame).collect()}
    relaxed = {(r["query_id"], r["vec_id"]) for r in vptree.search(frame, relax=1.3).collect()}
    assert len(exact & relaxed) >= 0.9 * len(exact)


def test_no_vectors(spark):
    assert vptree.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Classifiers


def test_language_held_out(documents, folder):
    found = {r["doc_id"]: r for r in language.identified(documents, folder).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_backoff():
    model = language.Model(["a", "b"], {"known": 0}, {"^x": 0, "x": 1}, np.array([[-1.0, -5.0]]), np.array([[-2.0, -9.0], [-7.0, -1.0]]), np.zeros(2))
    assert model.unseen("xy").tolist() == [-2.0, -9.0]  # the longest length with a known n-gram decides
    assert model.unseen("yx").tolist() == [-7.0, -1.0]
    assert model.unseen("q").tolist() == [0.0, 0.0]


def slow_languages(rows):
    """(doc_id -> language, score), learned from the rows (doc_id, text, lang) whose crc32 mod 4 is not 2."""
    words, grams, docs = defaultdict(Counter), defaultdict(Counter), Counter()
    for doc, text, lang in rows:
        if zlib.crc32(str(doc).encode()) % 4 != 2 and lang is not None and text is not None:
            docs[lang] += 1
            for w in language.word_runs(text):
                words[lang][w] += 1
                for n in range(1, 5):
                    for g in language.grams(w, n):
                        grams[lang][g] += 1
    langs = sorted(docs)
    logs = []
    for counts in (words, grams):
        items = {x for c in counts.values() for x in c}
        total = {x: sum(counts[x].values()) for x in langs}
        logs.append({i: [math.log((counts[x][i] + 0.5) / (total[x] + 0.5 * (len(items) + 1))) for x in langs] for i in items})
    out = {}
    for doc, text, _ in rows:
        found = language.word_runs(text or "")
        score = [math.log(docs[x] / sum(docs.values())) for x in langs]
        for w in found:
            own = logs[0].get(w)
            for n in range(4, 0, -1):
                if own is None and (known := [logs[1][g] for g in language.grams(w, n) if g in logs[1]]):
                    own = [sum(k) / len(known) for k in zip(*known, strict=True)]
            score = [a + b for a, b in zip(score, own or [0.0] * len(langs), strict=True)]
        best = max(range(len(langs)), key=lambda k: (score[k], -k))
        out[doc] = (langs[best], 1 / sum(math.exp(x - score[best]) for x in score)) if found else ("und", 0.0)
    return out


def test_languages_equal_brute_force(spark, folder):
    """Eighty languages, one of which holds nine of ten documents, with words of any length."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnop"))
    rows = []
    for d in range(900):
        lang = 0 if d % 10 else 1 + d // 10 % 79
        own = np.roll(letters, lang)[:6]
        rows.append((d, " ".join("".join(rng.choice(own, rng.integers(1, 9))) for _ in range(12)) + (" " + "x" * 90 if lang == 3 else ""), f"l{lang:02}"))
    rows += [(1000, "12 !", "l01"), (1001, None, "l02"), (1002, "abc", None)]
    found = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folder, max_words=10**6, max_grams=10**6).collect()
    want = slow_languages(rows)
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {d: lang for d, (lang, _) in want.items()}
    assert all(r["score"] == pytest.approx(want[r["doc_id"]][1], rel=1e-9) for r in found)
    assert len({r["lang_pred"] for r in found}) > 60  # of 80 learned


def test_language_awkward(awkward, nothing, folder):
    rows = language.identified(awkward, folder).collect()
    assert len(rows) == len(awkward_rows())
    und = Counter(r["doc_id"] for r in rows if r["lang_pred"] == "und")
    assert und == Counter(r[0] for r in awkward_rows() if not any(c.isalpha() for c in r[1] or ""))
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "und"}
    assert language.identified(nothing, folder + "0").count() == 0


def test_quality_held_out(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {r["doc_id"]: r for r in quality_model.scored(docs, labels, folder).collect()}
    held = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(found) == docs.count() and all(f["held_out"] for f, _ in held)
    assert np.mean([f["predicted"] == q for f, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def test_quality_awkward(spark, awkward, nothing, folder):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(14)] + [(None, 1, 0), (3, None, 0), (5, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.scored(awkward, labels, folder).count() == len(awkward_rows())
    unlearned = quality_model.scored(awkward, labels.limit(0), folder + "0").collect()
    assert {r["score"] for r in unlearned} == {0.5}
    assert quality_model.scored(nothing, labels, folder + "1").count() == 0


def test_isotonic():
    rate = quality_model.isotonic(np.arange(5), np.array([1.0, 1, 2, 1, 1]), np.array([0.0, 1, 0, 1, 1]))
    assert rate.tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1, 1])


# Pipeline


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing, folder):
    import corpus_pipeline

    from eviflow.llm.common import written

    for n, docs in enumerate((awkward, nothing)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            found = written(stage(spark, docs, "unused"), folder, f"{n}-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert found.columns == docs.columns, name
            found.count()


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(found) > 100 and all(r["round_trip"] for r in found)


def test_simhash_stage_keeps_one_of_each_group(spark, awkward):
    from eviflow.llm import stages

    kept = stages.simhash_stage(spark, awkward, "unused").collect()
    texts = [(r["text"] or "").lower().split() for r in kept]
    assert len({tuple(t) for t in texts}) == len(texts)
    assert {tuple((r[1] or "").lower().split()) for r in awkward_rows()} >= {tuple(t) for t in texts}


def slow_groups(texts, words=5, percent=80):
    """For each text the first of its near-copy group, by all pairs, and the similar pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    first, pairs = list(range(len(texts))), set()
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                pairs.add((i, j))
                x, y = sorted((first[i], first[j]))
                first = [x if f == y else f for f in first]
    return first, pairs


def copied_texts():
    """Copies with several words changed, a crowd of them, longer and shorter ones, and texts that share a passage only."""
    draw = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in draw.integers(0, 5000, n)]
    texts, passage = [" ".join(text(n)) for n in (3, 5, 30, 100)], text(60)
    for _ in range(12):
        base = text(int(draw.integers(80, 400)))
        texts.append(" ".join(base))
        for share in (0.002, 0.01, 0.018, 0.025, 0.05):
            texts.append(" ".join(w if draw.random() > share else "new" for w in base))
        texts += [" ".join(base[: int(len(base) * cut)]) for cut in (0.79, 0.8, 0.81, 0.9)]
        texts.append(" ".join([*passage, *text(30)]))
    base = text(150)
    texts += [" ".join(w if draw.random() > 0.02 else f"x{draw.integers(99)}" for w in base) for _ in range(60)]
    return [*texts, None, "", " \n", texts[0].upper(), "a b", "A  b"]


@pytest.mark.parametrize(("rounds", "sample_docs"), [(2, 20_000), (0, 20_000), (1, 1)])
def test_near_copies_are_those_of_all_pairs(spark, folder, rounds, sample_docs):
    from eviflow.llm import jaccard, simhash

    texts = copied_texts()
    want, pairs = slow_groups(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    found = dict(map(tuple, jaccard.near_copies(rows, folder, rounds=rounds, sample_docs=sample_docs).collect()))
    assert [found[i] for i in range(len(texts))] == want
    marks = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert sum((marks[i] ^ marks[j]).bit_count() > 4 for i, j in pairs) > 100  # pairs that four bits of SimHash miss


def test_simhash_round_links_near_fingerprints(spark, folder):
    from eviflow.llm import jaccard, simhash
    from eviflow.llm.components import local_components

    sets = {jaccard.shingles((t or "").encode()).tobytes() for t in copied_texts()}
    marks = [simhash.majority(np.frombuffer(s, dtype=np.uint64)) for s in sets]
    rows = [(i, m - (m >> 63 << 64)) for i, m in enumerate([*marks, marks[0]])]
    near = [(i, j) for i, (_, x) in enumerate(rows) for j, (_, y) in enumerate(rows[:i]) if ((x ^ y) & (1 << 64) - 1).bit_count() <= jaccard.NEAR_BITS]
    want = local_components(len(rows), *(np.array(x) for x in zip(*near, strict=True)))
    found = [tuple(r) for r in jaccard.simhash_pairs(spark.createDataFrame(rows, "class long, fp long"), folder).collect()]
    assert all(a < b for a, b in found) and (want != np.arange(len(rows))).sum() > 10
    assert local_components(len(rows), *(np.array(x) for x in zip(*found, strict=True))).tolist() == want.tolist()


def test_near_copies_begin_with_simhash_and_free_their_tables(spark, folder):
    from eviflow.llm import jaccard

    rows = spark.createDataFrame(list(enumerate(copied_texts())), "row long, text string")
    jaccard.near_copies(rows, folder).count()
    marks = {r["class"]: r["fp"] for r in spark.read.parquet(f"{folder}/classes").collect()}
    links = spark.read.parquet(f"{folder}/links-0").collect()
    assert links and any(marks[r["a"]] != marks[r["b"]] for r in links)
    for name in ("prefixes", "keys", "apart", "sets-0", "sets-2"):
        assert spark.read.parquet(f"{folder}/{name}").count() == 0, name


def test_lengths_by_start_miss_no_piece():
    from itertools import product

    from eviflow.llm.pieces import ONE, lengths_by_start

    pieces = {"a", "ab", "abc", "abca", "b", "cab", "caba", "cb"}
    sizes = lengths_by_start(pieces)
    for text in map("".join, product("abcd", repeat=4)):
        held = [n for n in range(4, 0, -1) if text[:n] in pieces]
        tried = sizes.get(text[:3]) or sizes.get(text[:2]) or ONE
        assert [n for n in tried if text[:n] in pieces] == held
    assert sizes["abc"] == (4, 3, 2, 1) and sizes["cab"] == (4, 3, 1) and "abd" not in sizes


def test_links_of_earlier_rounds_are_not_carried_on(spark, folder, monkeypatch):
    from eviflow.llm import jaccard
    from eviflow.llm.components import components

    given, root = [], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    def counted(edges, where):
        pairs = [tuple(r) for r in edges.select("a", "b").collect()]
        assert all(find(a) != find(b) for a, b in pairs)  # not linked by earlier rounds
        for a, b in pairs:
            root[find(a)] = find(b)
        given.append(len(pairs))
        return components(edges, where)

    monkeypatch.setattr(jaccard, "components", counted)
    draw = np.random.default_rng(5)
    body = [f"word{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        words = list(body)
        for at in draw.choice(100, 2, replace=False):
            words[at] = f"other{draw.integers(1 << 30)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    found = dict(map(tuple, jaccard.near_copies(rows, folder).collect()))
    assert [found[i] for i in range(60)] == slow_groups(texts)[0]
    assert len(given) == 3 and sum(given) > 0


def test_no_near_copies(spark, folder):
    from eviflow.llm import jaccard

    assert jaccard.near_copies(spark.createDataFrame([], "row long, text string"), folder).count() == 0


def test_simhash_stage_drops_copies_with_changed_words(spark):
    from eviflow.llm import stages

    texts = copied_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    want, _ = slow_groups(texts)
    kept = {r["doc_id"]: r["text"] for r in stages.simhash_stage(spark, docs, "unused").collect()}
    assert kept == {i: texts[i] for i in set(want)}


def test_suffix_stage_removes_passages_of_50_bytes(spark):
    from eviflow.llm import stages

    draw = np.random.default_rng(3)
    text = lambda n: "".join(chr(97 + x) for x in draw.integers(0, 26, n))
    passages = {n: text(n) for n in (49, 50, 75, 99, 100)}
    texts = [text(200) for _ in passages] + [text(40).upper() + p + text(40).upper() for _ in range(2) for p in passages.values()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in stages.suffix_array_stage(spark, docs, "unused").collect()}
    want = slow_removal(list(enumerate(texts)), 50)
    assert Counter(hashlib.sha256(t.encode()).hexdigest() for t in kept.values()) == Counter({h: n for (*_, h), n in want.items()})
    assert [len(kept[10 + k]) - 80 for k in range(5)] == [49, 0, 0, 0, 0]
