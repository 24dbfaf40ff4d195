"""Results depend on rows, not on how they are dealt over partitions and files."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thalweg.llm import common, langid, linededup, mixing, neardup, packing, tokenfile
from thalweg.llm.common import Scratch
from thalweg.llm.queries import vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    """Equal rows, equal ids with other texts, null ids."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(120)]
    rows = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts)]
    rows += rows[:20] * 3 + [(5, "other text of five", "s1", "en"), (None, "no id", None, None), (None, "no id", None, None), (None, "no id either", "s0", "en")] + [(500 + i, texts[3] + " end", "s2", "en") for i in range(6)]
    return rows


def dealt(spark, rows, parts):
    rows = rows if parts == 1 else random.Random(parts).sample(rows, len(rows))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(parts)


def both(spark, docs, f):
    one, seven = (Counter(map(tuple, f(dealt(spark, docs, n)).collect())) for n in (1, 7))
    assert one == seven and one
    return one


def test_numbers_among_equals(spark):
    for parts in (1, 5):
        rows = Scratch(spark, "numbers").save(spark.createDataFrame([(i % 3 or None, i % 2) for i in range(60)], "a int, b int").repartition(parts), "t")
        got = common.number_among_equals(rows, ["a", "b"], "k").collect()
        by = {}
        for r in got:
            by.setdefault((r.a, r.b), []).append(r.k)
        assert len(by) == 6 and all(sorted(v) == [*range(10)] for v in by.values())


def test_packing(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(packing, "EQUALS", 2)
    found = both(spark, docs, lambda d: packing.pack(spark, packing.pieces(d, vocabulary("byte_bpe_50k.json"), "byte", 0, 64), 64))
    by = {}
    for r in found.elements():
        by.setdefault(r[5], []).append((r[6], r[3]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfile.write, "__defaults__", (60,))
    heavy = docs + [(3, "the same words again", "s0", "en")] * 40  # an id of more ids than a file holds
    found = both(spark, heavy, lambda d: tokenfile.encode_documents(spark, d, vocabulary("word_bpe_49k.json"), ids_too=False))
    starts = sorted((r[1], r[2]) for r in found.elements())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_mixing_stage(spark, docs):
    both(spark, docs, lambda d: mixing.materialise(spark, d))


def test_mixing(spark, docs):
    both(spark, docs, lambda d: mixing.mix(spark, d))


def test_near_duplicates_stage(spark, docs):
    kept = both(spark, docs, lambda d: neardup.representatives(spark, d))
    assert max(kept.values()) == 1


def test_line_dedup_stage(spark, docs):
    both(spark, docs, lambda d: linededup.dedup_passages(spark, d))


def test_language_stage(spark, docs):
    both(spark, docs, lambda d: langid.accepted(spark, d, d).withColumn("n", F.length("text")))
