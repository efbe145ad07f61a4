"""Ids beyond 2^53 beside a null in one batch, in every operator that hands rows to Python."""

import pytest

from eigenforge.llm import bpe_trie, chat, embedding_dedup, line_dedup, mixing, ngram_join, token_store, toxicity, warc
from eigenforge.llm.catalog import tokenizer_path

IDS = [2**53 + 1, None, 2**53 + 3, 2**63 - 2]
TEXT = "some words that make up the text of a document here, number %s"


@pytest.mark.parametrize("name", ["tokens", "mix", "bpe", "lines", "jaccard", "toxic"])
def test_documents(spark, make_docs, name):
    docs = make_docs([(i, TEXT % n) for n, i in enumerate(IDS)], 1)
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(IDS)], "doc_id long, toxic int")
    run = {
        "tokens": lambda: token_store.token_digests(spark, docs, tokenizer_path()),
        "mix": lambda: mixing.mix(spark, docs),
        "bpe": lambda: bpe_trie.encode_digests(spark, docs, tokenizer_path()),
        "lines": lambda: line_dedup.digests(spark, docs),
        "jaccard": lambda: ngram_join.similar_components(spark, docs),
        "toxic": lambda: toxicity.score(spark, docs, toxicity.fit(spark, docs, labels)),
    }[name]
    assert {r["doc_id"] for r in run().collect()} == set(IDS)


def test_other_tables(spark):
    turns = spark.createDataFrame([(i, t, r, "x") for i in IDS for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r["conv_id"] for r in chat.format_turns(spark, turns).collect()} == set(IDS)
    pages = spark.createDataFrame([(i, f"http://a.example/{n}", "same" if n else "own") for n, i in enumerate(IDS)], "page_id long, url string, html string").coalesce(1)
    got = warc.digests(spark, pages).collect()
    assert {r["page_id"] for r in got} == set(IDS) and {r["refers_to"] for r in got} == {None, 2**53 + 3}
    vectors = spark.createDataFrame([(i, [1.0, float(n)], 1) for n, i in enumerate(IDS)], "vec_id long, embedding array<double>, label int").coalesce(1)
    assert {r["vec_id"] for r in embedding_dedup.near_duplicates(spark, vectors).collect()} == set(IDS)
