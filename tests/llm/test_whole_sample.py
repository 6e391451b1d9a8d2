"""The sample of the language dictionaries: every language, in draw order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.llm import langid


def test_each_language_has_its_own_sample(spark, monkeypatch):
    rows = [(1, f"many {k}", "aa") for k in range(60)] + [(k, f"word{k}", "bb") for k in range(100, 160)] + [(7, "only", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.learn(docs, F.lit(True), sample_docs=5)
    assert {lang: len(d.split(b"\n")) for lang, d in learned.items()} == {"aa": 5, "bb": 5, "cc": 1}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="over 2 languages"):
        langid.learn(docs, F.lit(True))
