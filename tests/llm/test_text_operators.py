"""Quality rules, SimHash, token files, pieces, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import awkward, documents, folder, nothing, spark  # noqa: F401

from eviflow.llm import pieces, quality_rules, simhash, token_files
from eviflow.llm.components import components, local_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def counters(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("table", ["awkward", "documents", "nothing"])
def test_quality_counters(request, folder, table):
    docs = request.getfixturevalue(table)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality_rules.judged(docs, folder).select("doc_id", *names, "base_failed").collect()
    want = Counter()
    for doc_id, text in texts_of(docs):
        c = counters(text)
        want[(doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert Counter(map(tuple, found)) == want


def test_bad_host_loses_its_documents(spark, folder):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 == 0 else "short", "bad", "x") for i in range(200)] + [(1000 + i, good, f"fine{i % 5}", "x") for i in range(200)]
    found = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string, host string"), folder)
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert not any(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200))


def test_one_odd_document_does_not_condemn_a_small_host(spark, folder):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, f"h{i % 20}") for i in range(400)] + [(900, "short", "tiny"), (901, good, "tiny")]
    found = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), folder)
    assert {r["doc_id"]: r["kept"] for r in found.collect()}[901]


def test_beta_prior_by_hand():
    # Hosts 0/10, 10/10: between-host variance 0.25 leaves the weakest prior.
    assert quality_rules.beta_prior(2, 20, 10, 10.0) == pytest.approx((0.5, 0.5), abs=0.05)
    # No more spread than chance: as strong as allowed.
    alpha, beta = quality_rules.beta_prior(2, 20, 10, 5.0)
    assert alpha + beta == pytest.approx(1e6)


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("table", ["awkward", "documents"])
@pytest.mark.parametrize("hot", [4096, 1])
def test_simhash_against_all_pairs(request, folder, table, hot):
    docs = request.getfixturevalue(table)
    found = simhash.near_duplicates(docs, folder, hot=hot).collect()
    want = [(i, slow_fingerprint(t)) for i, t in texts_of(docs)]
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in found) == Counter(want)
    a, b = zip(*[(x, y) for x in range(len(want)) for y in range(x) if (want[x][1] ^ want[y][1]).bit_count() <= 4], strict=True)
    label = local_components(len(want), np.array(a), np.array(b))
    least = {}
    for (i, _), at in zip(want, label, strict=True):
        least.setdefault(at, set()).add(i)
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter((i, min((x for x in least[at] if x is not None), default=None)) for (i, _), at in zip(want, label, strict=True))


def test_simhash_crowded_keys(spark, folder):
    """A chain of fingerprints within one block, and crowds that share blocks, keep all their links."""
    draw = np.random.default_rng(3)
    centre = int(draw.integers(1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in draw.choice(64, 6, replace=False)) for _ in range(300)} | {centre ^ ((1 << k) - 1) for k in range(0, 40, 4)}
    fps = np.array(sorted(fps), dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    label = local_components(len(fps), i, j)
    want = {int(fps.view(np.int64)[k]): {int(fps.view(np.int64)[m]) for m in np.flatnonzero(label == label[k])} for k in range(len(fps)) if (label == label[k]).sum() > 1}
    for n, hot in enumerate((4096, 20, 1)):
        got = {}
        for r in components(simhash.links(frame, hot=hot), f"{folder}/{n}").collect():
            got.setdefault(r["label"], set()).add(r["node"])
        assert {x: c for c in got.values() for x in c} == want


def test_simhash_empty_table(nothing, folder):
    assert simhash.near_duplicates(nothing, folder).count() == 0


def test_components_of_a_long_path(spark, folder):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(edges, folder).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("table", ["awkward", "documents", "nothing"])
def test_token_files(request, folder, table):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(TOKENS)
    found = sorted(token_files.write_and_read(docs, TOKENS, folder).collect(), key=lambda r: r["start"])
    ids = [np.frombuffer(r["ids"], dtype="<u4").tolist() for r in found]
    want = Counter((i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for i, t in texts_of(docs))
    assert Counter((r["doc_id"], *x) for r, x in zip(found, ids, strict=True)) == want
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
    assert order == sorted(order) and [r["n_tokens"] for r in found] == [len(x) for x in ids]
    assert [r["start"] for r in found] == np.cumsum([0, *map(len, ids)])[:-1].tolist()


def test_other_tokenizers_are_left_to_the_library(awkward, folder):
    """A file with other steps before its model gives the library's ids too."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found = token_files.write_and_read(awkward, path, folder, end_id=50256).collect()
    want = Counter((i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 50256) for i, t in texts_of(awkward))
    assert Counter((r["doc_id"], *np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in found) == want
    assert token_files.cut_as_here(TOKENS) and not token_files.cut_as_here(path)


def test_token_digest_and_small_blocks(documents, folder, monkeypatch):
    whole = token_files.write_and_read(documents, TOKENS, folder).collect()
    digest = token_files.write_and_read(documents, TOKENS, folder + "2", digest=True).collect()
    assert {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in whole} == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in digest}


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_code_round_trip(values):
    control, data = token_files.encode_values(np.array(values, dtype="<u4"))
    assert token_files.decode_values(control, data, len(values)).tolist() == values
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)


def test_pieces_equal_the_library(spark, awkward, documents):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    for docs in (awkward, documents):
        texts = texts_of(docs)
        coded = pieces.encode(docs, PIECES)
        want = Counter((i, *model.encode(t or ""), "▁" not in (t or "")) for i, t in texts)
        assert Counter((r["doc_id"], *r["ids"], r["round_trip"]) for r in coded.collect()) == want
        back = Counter(map(tuple, pieces.decode(coded, PIECES).collect()))
        assert back == Counter((i, (t or "").replace("▁", " ")) for i, t in texts)


def test_pieces_random_texts_and_empty_table(nothing):
    from sentencepiece import SentencePieceProcessor

    model, machine = SentencePieceProcessor(model_file=PIECES), pieces.Transducer(PIECES)
    draw = np.random.default_rng(1)
    letters = list("  aabbe thT漢é\n\t\x00😀,.1ﬁ  ▁in")
    for _ in range(1500):
        text = "".join(draw.choice(letters, draw.integers(0, 40)))
        assert machine.encode(text).tolist() == model.encode(text)
    assert pieces.encode(nothing, PIECES).count() == 0


def test_unigram_path_is_the_cheapest():
    machine = pieces.Transducer(PIECES, kind="unigram")
    text = machine.normalised("the theme")

    def cheapest(rest):
        if not rest:
            return 0.0
        return min(cheapest(rest[n:]) - machine.score[machine.ids[rest[:n]]] for n in range(1, len(rest) + 1) if rest[:n] in machine.ids)

    assert -sum(machine.score[i] for i in machine.shortest(text)) == cheapest(text)
