"""What stages leave behind in the shared folder, and what the token encoder remembers."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

LETTERS = "bcdfghklmnprstvz"


@pytest.fixture
def left(tmp_path, monkeypatch):
    """The folders of data that the stages left in their shared folders."""
    from graphloom.llm import jaccard, toxicity

    for stage in (jaccard, toxicity):
        monkeypatch.setattr(stage, "shared_dir", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    yield lambda: [d for d, _, files in os.walk(tmp_path) if any(x.endswith(".parquet") for x in files)]


def test_training_leaves_no_tables(spark, left):
    from graphloom.llm import toxicity

    text = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "vile scum").otherwise("kind words"), F.col("id").cast("string"), F.lit("and the rest"))
    docs = spark.range(240).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    labels = spark.range(240).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    rows = toxicity.score(docs, labels).collect()
    assert left() == []
    assert len(rows) == 240 and sum((r["score"] > 0.5) == (r["doc_id"] % 2 == 0) for r in rows) == 240


def test_deduplication_leaves_only_its_members(spark, left):
    from graphloom.llm import jaccard

    words = " ".join(f"{a}o{b}" for a in LETTERS for b in LETTERS)
    docs = spark.createDataFrame([(1, words), (2, words), (3, words + " end"), (4, "one other text of six words"), (5, None)], "doc_id bigint, text string")
    out = jaccard.deduplicated(docs)
    inner = [d for d in left() if os.path.basename(d) in ("sets", "heads", "classes", "home", "links", "labels", "open", "links2")]
    assert inner == []
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5]


def test_encoder_keeps_marked_words(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from graphloom.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokens.Encoder(path)
    texts = ["One two, three; four!\nfive. six", "", "  a\t b,\n\nc, d\r\n e\x1cf", "naïve, café. naïve,", "two, " * 5 + "x" * 90 + ",", "a \nb, c\n d,  e", "<s> two, </s>", "  two,  three;"]
    for _ in range(2):
        for t, got in zip(texts, enc(texts), strict=True):
            assert got == enc.whole(t)
    assert {"two,", "three;", "naïve,"} <= set(enc.rest)
    monkeypatch.setattr(tokens, "MARKED", 2)
    for some in (["p q, r, s, t, u"], ["p q, r,", "v w,"]):
        for t, got in zip(some, enc(some), strict=True):
            assert got == enc.whole(t)
        assert len(enc.marked) <= 2 and not {"two,", "q,"} & set(enc.rest)


def test_white_space_after_white_space():
    from graphloom.llm import tokens

    for t in ("a b\nc", "", " ", "a\tb", "a b", "a  b", "a\n\nb", "a \nb", "a\n b", "a \tb", "a\x1c\nb", "ä  b", "ä b", "a\x0b\x0cb"):
        assert tokens._unsafe(t) == bool(tokens._UNSAFE.search(t)), t
