"""Language identification, words first: known words score by their log frequency per language, unseen words by their
character n-grams, the longest length of which any n-gram is known.

The classifier learns from a bounded sample: of each language about ``lang_docs`` documents by hash order (all, where there
are fewer), and of ``max_words`` words and ``max_grams`` n-grams each language chooses an equal share, its own most
frequent ones. So a rare language learns as much as one that dominates the table; how frequent languages are counts as
prior, from all labelled documents. These bounds are parameters of the classifier; every language is learned, and
prediction reads every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text where nothing could be
learned; equal scores go to the first language in code point order; null languages and null doc_ids teach nothing;
repeated rows count each when learning and are predicted alike; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eviflow.llm.common import batch_of, binary_text, rows_of, written
from eviflow.operators.common import top_k

RUNS = re.compile(r"[^\W\d_]+")
LONGEST = 4
CACHED = 200_000


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def word_runs(text: str) -> list[str]:
    """Lower-cased letter runs; none if the text has no letter."""
    found = RUNS.findall(text.lower())
    if found and not any(w.isalpha() for w in found) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray  # [word, lang] log frequencies
    gram_scores: np.ndarray
    prior: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            at = [i for g in grams(word, n) if (i := self.grams.get(g)) is not None]
            if at:
                return self.gram_scores[at].mean(axis=0)
        return np.zeros(len(self.langs))


def counted(rows: DataFrame, of) -> DataFrame:
    """(lang, item, n) summed; ``of`` gives the (lang, item, n) of one row of values."""
    schema = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for row in rows_of(batch):
                of(total, *row)
            yield batch_of(schema, zip(*((a, b, n) for (a, b), n in total.items()), strict=True) if total else ([], [], []))

    return rows.mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _count_words(total, lang, octets):
    total.update((lang, w) for w in word_runs(octets.decode("utf-8", "replace")))


def _count_grams(total, lang, word, n):
    for size in range(1, LONGEST + 1):
        for gram in grams(word, size):
            total[lang, gram] += n


def fit(docs: DataFrame, folder: str, lang_docs: int = 5_000, max_words: int = 100_000, max_grams: int = 100_000) -> Model:
    """Model of the rows of ``docs`` (lang, text) that a hash order puts first in their language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), "doc_id", binary_text().alias("text"))
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("held")), folder, "languages")
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20))
    sample = known.join(sizes, "lang").filter(place < F.floor(F.lit(lang_docs) / F.col("held") * (1 << 20)) + 1).select("lang", "text")
    words = written(counted(sample, _count_words), folder, "words")
    parts = written(counted(words, _count_grams), folder, "grams")
    weight = {r["lang"]: r["held"] for r in sizes.collect()}  # one row per language
    langs = sorted(weight)

    def table(counts: DataFrame, most: int) -> tuple[dict[str, int], np.ndarray]:
        chosen = top_k(counts, ["lang"], [F.desc("n"), F.asc("item")], max(1, most // max(len(langs), 1))).select("item").distinct()
        often = counts.join(chosen, "item").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        rows = often.orderBy("item").collect()  # ``most`` rows at most
        scores = np.array([[r["by"].get(lang, 0) for lang in langs] for r in rows], dtype=np.float64).reshape(len(rows), len(langs))
        return {r["item"]: i for i, r in enumerate(rows)}, np.log((scores + 0.5) / (scores.sum(axis=0) + 0.5 * (len(rows) + 1)))

    word_at, word_scores = table(words, max_words)
    gram_at, gram_scores = table(parts, max_grams)
    prior = np.log(np.array([weight[x] for x in langs], dtype=np.float64) / max(sum(weight.values()), 1)) if langs else np.zeros(0)
    return Model(langs, word_at, gram_at, word_scores, gram_scores, prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; the score is the posterior of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's own parameters
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        n_langs = len(m.langs)
        table = np.empty((len(m.words) + CACHED + 1, n_langs))
        table[: len(m.words)] = m.word_scores
        at, used = dict(m.words), len(m.words)
        for batch in batches:
            out = []
            for doc_id, octets in rows_of(batch):
                words = word_runs(octets.decode("utf-8", "replace")) if octets else []
                if not words or not n_langs:
                    out.append((doc_id, "und", 0.0))
                    continue
                total = m.prior.copy()
                for lo in range(0, len(words), CACHED // 2):
                    own = words[lo : lo + CACHED // 2]
                    for w in {w for w in own if w not in at}:
                        if used == len(table):
                            at, used = dict(m.words), len(m.words)
                            break
                        if len(w) <= 64:
                            table[used], at[w] = m.unseen(w), used
                            used += 1
                    places = [at.get(w, -1) for w in own]
                    for k in [k for k, p in enumerate(places) if p < 0]:
                        total += m.unseen(own[k])
                    total += table[[p for p in places if p >= 0]].sum(axis=0)
                best = int(total.argmax())
                out.append((doc_id, m.langs[best], float(1 / np.exp(total - total[best]).sum())))
            yield batch_of(schema, zip(*out, strict=True) if out else ([], [], []))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, folder: str, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents whose crc32(doc_id) mod ``folds`` is ``held`` teach nothing."""
    model = fit(docs.filter(remainder(F.col("doc_id"), folds) != held), folder, **options)
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
