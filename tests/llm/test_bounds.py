"""What the driver holds, and what is left on disk between steps."""

import math
import os
import random
from collections import Counter

import pytest

pytest.importorskip("newsgauge.llm")

import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from newsgauge.llm import language_id, lm_scoring, shared  # noqa: E402


def test_language_pieces_are_fitted_in_tasks(spark, monkeypatch):
    driver, make = os.getpid(), language_id.Pieces.__init__

    def in_a_task(self, spec):
        if os.getpid() == driver:
            raise AssertionError("the driver loads the vocabulary")
        make(self, spec)

    monkeypatch.setattr(language_id.Pieces, "__init__", in_a_task)
    rows = [(k, ("the house and the garden " if k % 2 else "la maison et le jardin ") * (1 + k % 5), "en" if k % 2 else "fr") for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "12 34", "fr")], "doc_id long, text string, lang string").repartition(3)
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert told == {k: lang for k, _, lang in rows} | {100: "und", 101: "und"}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_staged_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    step = shared.staged(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")), "step")
    assert step.count() == 700 and not [x for x in shuffle_files(spark) - before if x.endswith(".data")]


def test_lm_looks_up_in_rounds(spark, monkeypatch):
    """Whatever is looked up in whichever round; rows that repeat an id, with the same text or another, are all scored."""
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(80)) + f" seldom{k % 9}" for k in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, texts[5]), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "COMMON_SHARE", 64)
    monkeypatch.setattr(lm_scoring, "CACHE_SHARE", 64)
    got = []
    for rounds in (1, 5):
        monkeypatch.setattr(lm_scoring, "LOOKUP_ROUNDS", rounds)
        got.append(sorted((tuple(r) for r in lm_scoring.score_texts(docs).collect()), key=str))
    assert Counter(r[0] for r in got[0]) == Counter(d for d, _ in rows)
    for one, other in zip(*(sorted(x, key=lambda r: (str(r[:5]), r[6])) for x in got), strict=True):
        assert one[:5] == other[:5] and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(one[5:], other[5:], strict=True))
    of = {d: Counter(r[2] for r in got[0] if r[0] == d) for d in (3, 7, None)}
    assert sum(of[3].values()) == 3
    assert of[7][1] == 2 and of[None] == {len(texts[5].split()) + 1: 2}
