"""Registered queries against plain Python, calibration, factors, hot rows, awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import AWKWARD, components_by_hand, docs, empty  # noqa: F401 - fixtures

import corpus_pipeline
from tessera.llm import ann, common, mixing, quality, simhash, substring, toxicity
from tessera.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text or "", r.source) for r in common.table(spark, sf_dir, "documents").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, other = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert Counter(tuple(r) for r in df.select(*other.columns).collect()) == Counter(other.fetchall())


def test_sharding_query(spark, sf_dir, rows):
    out = QUERIES["op1_hypergeometric_sharding"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(r.law == "rows" and r.grown_shard is None and 0 <= r.slot < sizes[r.shard] for r in out) and len({(r.shard, r.slot) for r in out}) == len(out)


@pytest.mark.parametrize(("name", "folds", "held", "cut"), [("op3_toxicity", 4, 2, 0.3), ("op7_quality", 3, 1, 0.5)])
def test_classifier_queries(spark, sf_dir, rows, name, folds, held, cut):
    out = QUERIES[name](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in out)


def test_token_count_query(spark, sf_dir, rows):
    out = QUERIES["op9_token_counts"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len(t.encode())) for i, t, _ in rows) and all(r.over_limit == (r.n_tokens > 2048) for r in out)


def test_simhash_query(spark, sf_dir, rows):
    out = QUERIES["op10_simhash_mih"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == components_by_hand([(i, t) for i, t, _ in rows])


def test_bpe_query(spark, sf_dir, rows):
    out = QUERIES["op4_byte_bpe"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows)


def test_isotonic_rates_rise():
    rng = np.random.default_rng(2)
    y = np.array([1.0] * 19 + [0.0, 1.0])
    at, rate = toxicity.isotonic(np.arange(21.0), y)
    assert (np.diff(rate) >= 0).all() and (np.diff(at) > 0).all()
    for _ in range(20):
        m, t = rng.integers(0, 30, 200) / 10, (rng.random(200) < 0.3).astype(float)
        at, rate = toxicity.isotonic(m, t)
        assert (np.diff(rate) >= 0).all() and (np.diff(at) > 0).all()
    # Without small blocks it is the least-squares rising fit: the largest of means from below, the least of those from above.
    m, t = np.repeat(np.arange(8.0), 40), (rng.random(320) < 0.4).astype(float)
    rate, weight, _ = toxicity.pooled(t.reshape(8, 40).mean(1), np.full(8, 40.0), np.arange(8.0))
    mean = t.reshape(8, 40).mean(1)
    by_hand = [max(min(mean[a : b + 1].mean() for b in range(k, 8)) for a in range(k + 1)) for k in range(8)]
    assert np.allclose(np.repeat(rate, (weight / 40).astype(int)), by_hand)


def test_a_tree_splits_where_brute_force_does():
    rng = np.random.default_rng(4)
    x = rng.random((200, 3))
    y = (x[:, 1] > 0.6).astype(float)
    tree = toxicity.Trees(x, y)
    b, g, h = tree.binned(x), y - y.mean(), np.full(200, 0.25)
    gain = {(j, k): g[b[:, j] <= k].sum() ** 2 / (h[b[:, j] <= k].sum() + 1) + g[b[:, j] > k].sum() ** 2 / (h[b[:, j] > k].sum() + 1) for j in range(3) for k in range(b.max()) if min((b[:, j] <= k).sum(), (b[:, j] > k).sum()) >= tree.leaf}
    assert tree.grow(b, g, h, np.arange(200), 1)[:2] == max(gain, key=gain.get)


def test_repeated_rows_stay_linear(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(80))
    made = {}
    real = common.stored

    def counted(df, label):
        out = real(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(substring, "stored", counted)
    repeated = [(7, text)] * 2000 + [(3, text + " tail"), (9, "head " + text)]
    out = substring.remove_repeats(spark.createDataFrame(repeated, "doc_id long, text string").repartition(3)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(3, 0, 1), (7, 80, 2000), (9, 80, 1)]
    assert max(made.values()) <= 20 * len(repeated)


def test_factors_name_their_source(spark):
    passage = [f"p{i}" for i in range(120)]
    texts = [(1, " ".join(["a"] * 5 + passage)), (2, " ".join(["b"] * 9 + passage[10:] + ["c"])), (3, " ".join(passage[:60] + ["d"] + passage[60:]))]
    out = {r.doc_id: [tuple(f) for f in r.factors] for r in substring.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    words = {i: t.split() for i, t in texts}
    assert out[1] == [] and out[2] == [(9, 110, 1, 15)] and sorted(out[3]) == [(0, 60, 1, 5), (61, 60, 1, 65)]
    for i, found in out.items():
        assert all(words[i][a : a + n] == words[s][b : b + n] for a, n, s, b in found)


def test_ann_scores_less_than_the_table(spark):
    x = np.random.default_rng(8).standard_normal((12_000, 32)).astype(np.float32)
    index = ann.PostingIndex(x, len(x), float((x.astype(float) ** 2).sum(1).max()))
    lists = index.lists_for_rows(x)
    sizes = np.bincount(np.concatenate(lists), minlength=len(index.centroids))
    asked = np.arange(0, len(x), 50)
    read = index.lists_for_queries(x[asked], ann.QUERY_RATIO, sizes, 80)
    hits = 0
    for q, own in zip(asked, read, strict=True):
        near = [int(i) for i in np.argsort(-(x @ x[q]))[:21] if i != q][:20]
        hits += sum(bool(set(own.tolist()) & set(lists[i].tolist())) for i in near)
    assert hits / (20 * len(asked)) >= 0.9 and np.mean([sizes[r].sum() for r in read]) < 0.5 * len(x)


def test_copies_without_an_id_go(spark):
    text = [" ".join(f"{a}{i}" for i in range(100)) for a in "xy"]
    df = spark.createDataFrame([(None, text[0]), (None, text[0]), (None, text[1]), (4, text[1])], "doc_id long, text string")
    for similarity in (None, 0.8):
        assert Counter(tuple(r) for r in simhash.keep_first(df, similarity=similarity).collect()) == Counter([(None, text[0]), (4, text[1])])


def test_mix_spreads_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a", 1, f"t{i}") for i in range(4000)], "doc_id long, source string, size long, text string")
    assert mixing.mix(df).groupBy("times").count().count() == 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, sf_dir, docs, empty, name):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, sf_dir).count() == 0
    out = stage(spark, docs, sf_dir)
    assert (out.columns == list(corpus_pipeline.COLUMNS) or name == "byte-level BPE") and out.count() <= 2 * len(AWKWARD)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scored_replaces_a_clashing_column(spark, empty, module):  # noqa: F811
    model = module.fit(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int, quality int"))
    rows = spark.createDataFrame([("x", "keep", "own"), (None, "keep", "own"), ("long " * 100_000, "keep", "own")], "text string, other string, score string")
    out = module.scored(rows, model).collect()
    assert all(isinstance(r.score, float) and r.other == "keep" for r in out) and len(out) == 3
    assert module.scored(empty.withColumn("score", F.lit("x")), model).count() == 0
