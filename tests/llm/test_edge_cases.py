"""Odd and empty tables through every operator and stage: one row for each row, and nothing fails."""

import pytest

import corpus_pipeline
from waymark.llm import byte_bpe, host_quality, language_id, license_scan, masked_lm, pii_crf, simhash, token_files, url_filter

ROW_WISE = [language_id.identify, masked_lm.score_documents, byte_bpe.encode_digests, pii_crf.find_pii, pii_crf.mask_pii, simhash.near_duplicates, token_files.token_output, host_quality.judge_documents, license_scan.scan_licenses]


@pytest.mark.parametrize("operator", ROW_WISE, ids=lambda f: f.__name__)
def test_every_row_has_a_row(odd_docs, operator):
    got = operator(odd_docs).collect()
    ids = lambda rows: sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    assert ids(got) == ids(odd_docs.collect())


@pytest.mark.parametrize("operator", ROW_WISE, ids=lambda f: f.__name__)
def test_empty_table(no_docs, operator):
    assert operator(no_docs).collect() == []


def test_pages_empty_and_null(spark):
    pages = spark.createDataFrame([(1, None), (None, None), (None, "http://x.org/")], "page_id bigint, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages).collect()] == ["allow"] * 3
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_stages_on_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
            stage(spark, docs, "/root/testdata/sf0.001").collect()


def test_one_row_of_each_group_stays(odd_docs):
    kept = simhash.keep_one_of_each(odd_docs).collect()
    groups = {r.group_fp for r in simhash.near_duplicates(odd_docs).collect()}
    assert len(kept) == len(groups)


def test_pipeline_against_brute_force(spark):
    """Every stage's decision on a table, in turn, by plain code."""
    import hashlib

    import numpy as np
    from test_operators import plain_components, plain_fingerprint

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdicts = {r.doc_id: r.kept for r in host_quality.judge_documents(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if verdicts[r.doc_id]}
    fps = [(d, plain_fingerprint(t)) for d, t in texts.items()]
    class_of = plain_components(fps)
    texts = {d: texts[d] for d, f in fps if class_of[f] == d}
    flat = lambda t: " ".join(t.split())
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not any(x in flat(t) for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(texts)
    plain = [d for d, t in texts.items() if not any(c.isdigit() or c == "@" for c in t)]
    assert plain
    assert all(got[d].decoded_sha256 == hashlib.sha256(texts[d].encode()).hexdigest() for d in plain)
    assert np.mean([got[d].n_tokens for d in got]) > 0
