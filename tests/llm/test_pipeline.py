"""Every stage of the pipeline against brute force, on its own input."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from test_llm_operators import components_by_hand, removed_by_hand

import corpus_pipeline
from tessera.llm import byte_bpe, common, quality


def plain(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage."""
    docs, out = common.table(spark, sf_dir, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        made = common.stored(stage(spark, docs, sf_dir), "test")
        out.append((docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for before, after in stages[:4]:
        assert set(after.columns) == set(corpus_pipeline.COLUMNS) and after.count() > 0 and before.count() >= 1


def test_rejected_documents_go(spark, sf_dir, stages):
    docs, kept = stages[0]
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    expected = Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in docs.collect() if model.score([r.text])[0] >= 0.5)
    assert plain(kept) == expected and kept.count() < docs.count()


def test_one_of_each_group_stays(stages):
    docs, kept = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    firsts = {c for _, _, c in components_by_hand(rows)}
    assert {r.doc_id for r in kept.collect()} == firsts and kept.count() == len(firsts)


def test_passages_go_and_other_texts_stay(stages):
    docs, out = stages[2]
    texts = {r.doc_id: r for r in docs.collect()}
    for (i, n, gone, kept), times in removed_by_hand([(r.doc_id, r.text) for r in texts.values()]).items():
        row = out.where(f"doc_id = {i}").collect() if gone else None
        if row is not None:
            assert len(row) == times and row[0].text == kept and row[0].n_chars == len(kept) and n
    same = {r.doc_id for r in out.collect() if r.text == texts[r.doc_id].text}
    assert len(same) >= out.count() - sum(1 for _, _, g, _ in removed_by_hand([(r.doc_id, r.text) for r in texts.values()]) if g)


def test_mix_takes_up_to_two(stages):
    docs, out = stages[3]
    source, taken = plain(docs), plain(out)
    assert set(taken) <= set(source) and all(n <= 2 * source[r] for r, n in taken.items())
    words = lambda rows: sum(len(common.WORD_BYTES.findall((r[1] or "").encode())) * n for r, n in rows.items())
    longest = max(len(common.WORD_BYTES.findall((r[1] or "").encode())) for r in source)
    assert abs(words(taken) - 1.5 * words(source)) <= longest


def test_ids_are_the_library_s(stages):
    docs, out = stages[4]
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        expected[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == expected


def test_run_applies_all_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter((r.doc_id, r.ids_sha256) for r in got.collect()) == Counter((r.doc_id, r.ids_sha256) for r in stages[4][1].collect())
