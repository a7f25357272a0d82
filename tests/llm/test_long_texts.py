"""A text of ten megabytes through every operator, beside a short one: a row for each, and what is known of it."""

import hashlib

import numpy as np
import pytest

from waymark.llm import byte_bpe, host_quality, license_scan, masked_lm, pii_crf, simhash, token_files

WORDS = 1_700_000


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(19)
    words = np.array(["alpha", "beta", "gamma", "delta", "rare", "under", "the", "mit", "license", "one@mail.example.com", "10.0.0.7"])
    text = " ".join(words[rng.choice(len(words), WORDS, p=[0.2, 0.2, 0.2, 0.2, 0.1, 0.02, 0.03, 0.02, 0.02, 0.005, 0.005])].tolist())
    assert len(text) > 9_000_000
    return text, spark.createDataFrame([(1, text, "en", "s"), (2, "a short one", "en", "s")], "doc_id bigint, text string, lang string, source string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens(long_docs):
    text, docs = long_docs
    got = by_id(byte_bpe.encode_digests(docs))
    assert got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].n_tokens >= WORDS
    files = by_id(token_files.token_output(docs, partitions=2))
    assert files[1].start == 0 and files[2].start == files[1].n_tokens > WORDS


def test_personal_data(long_docs):
    text, docs = long_docs
    got = by_id(pii_crf.find_pii(docs))
    assert got[1].n_email == text.count("@") and got[1].n_ip == text.count("10.0.0.7") and got[2].n_spans == 0


def test_counts(long_docs):
    text, docs = long_docs
    assert by_id(license_scan.scan_licenses(docs))[1].n_base == sum(text.startswith("under the mit license", k) for k in (i for i in range(len(text)) if text[i] == "u"))
    assert by_id(host_quality.judge_documents(docs))[1].n_words == WORDS
    assert set(by_id(simhash.near_duplicates(docs))) == {1, 2}


def test_scores(long_docs):
    _, docs = long_docs
    got = by_id(masked_lm.score_documents(docs))
    assert got[1].n_tokens >= WORDS and got[1].log_likelihood < got[2].log_likelihood < 0
