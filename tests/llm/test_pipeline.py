"""The pipeline's stages against brute force, and its effect on planted documents."""

import re
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trendlab.llm.suffixes import removals
from trendlab.sources.sinks import stored

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), f"test-{name}")
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_stages_return_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == columns, name
        assert after.count() > 0


def test_one_document_of_each_group_stays(stages):
    """Groups by hand: all pairs of distinct texts, 0.8 of their 5-word shingles in common, closed over links."""
    before, after = stages["near_duplicates"]
    sets, first = {}, {}
    for r in before.collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) if w]
        key = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
        sets[key] = None
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    groups = {key: {key} for key in sets}
    for a, b in combinations(sets, 2):
        if 10 * len(a & b) >= 8 * len(a | b) and groups[a] is not groups[b]:
            merged = groups[a] | groups[b]
            for key in merged:
                groups[key] = merged
    want = {min(first[key] for key in group) for group in groups.values()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
    assert before.count() > after.count() and len(want) < len(sets)


def test_no_passage_is_left_twice_and_clean_texts_stay(stages):
    before, after = stages["repeated_passages"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    gone = {r["doc_id"]: r["n_removed"] for r in removals(before).collect()}
    first = {r["doc_id"]: r["text"] for r in before.collect()}
    assert set(texts) == set(first)
    assert all(texts[i] == first[i] for i, n in gone.items() if n == 0)
    assert all(len(texts[i].encode()) <= len(first[i].encode()) - n for i, n in gone.items())


def test_no_benchmark_window_is_left(spark, stages):
    _, after = stages["decontamination"]
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = split(r["text"])
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))}
    for r in after.collect():
        words = split(r["text"])
        assert not windows & {tuple(words[k : k + 10]) for k in range(len(words) - 9)}


def test_tokens_equal_the_library(stages):
    before, after = stages["tokens"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids"] for r in after.collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_run_equals_its_stages(spark, stages):
    _, after = stages["tokens"]
    key = lambda frame: sorted((r["doc_id"], r["ids_sha256"]) for r in frame.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(after)
