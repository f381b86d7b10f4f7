"""Stages of the pipeline on untidy tables, training order, and measured recall; op9 against a plain discriminant, op8's sidecar."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from duelight.llm import embeddings, neardup, qda, secrets, warc
from duelight.llm.langid import held_out
from duelight.llm.tables import materialise, new_path, read
from duelight.llm.textstats import features

CLASH = ["spans", "row", "keys", "position", "words", "size", "_kinds", "_id", "short", "training_order", "x", "first"]


@pytest.fixture(scope="module")
def untidy(spark, sf):
    """Supplied documents, and rows with nulls in every column, empty and very long texts, ties and repeated rows, under clashing extra columns."""
    docs = read(spark, sf, "documents")
    some = docs.where("doc_id < 60").collect()
    base = some[0]
    long = " ".join(some[k % 20].text for k in range(200))
    odd = [(9000, None, "en", "s", None), (9001, "", "en", "s", 0), (None, base.text, None, None, None), (9002, "password = hunter22secret", None, "s", 1), (9003, long, "en", None, len(long)), (9004, " \n\t", "en", "s", 3), (9005, "12 34", "en", "s", 5)]
    odd += [(9006, "x" * 30_000, "en", "s", 30_000)] + [(9007, base.text, base.lang, base.source, base.n_chars)] * 3
    rows = [tuple(r[c] for c in p.COLUMNS) for r in some] + odd
    table = spark.createDataFrame(rows, docs.schema)
    return table.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_stages_take_untidy_and_empty_tables(spark, sf, untidy, name):
    stage = dict(p.STAGES)[name]
    table = materialise(untidy, f"test-untidy-{name}")
    out = stage(spark, table, sf)
    got = out.collect()
    rows = table.collect()
    none = stage(spark, materialise(untidy.where("false"), f"test-none-{name}"), sf)
    assert none.columns == out.columns and none.count() == 0
    if name != "byte_bpe":
        assert out.columns == p.COLUMNS
    ids = [r.doc_id for r in got]
    if name == "language_id":
        assert not {9000, 9001, 9004, 9005} & set(ids) and ids.count(9007) == 3 and 9003 in ids and None in ids
        assert sum(i is not None and i < 60 for i in ids) >= 55
    elif name == "near_duplicates":
        # of exact copies the least id stays, nulls last; nulls are copies of nothing, wordless texts only of equal ones
        assert ids.count(9007) == 0 and None not in ids and {9000, 9001, 9004} <= set(ids)
        assert len(ids) == len(set(ids))
    elif name == "secret_scan":
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert by[9000].text is None and by[9000].n_chars is None and by[9001].text == "" and by[9002].text == "[secret]"
        assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    elif name == "source_mix":
        assert not {9000, 9001, 9004} & set(ids)
        words = sum(len(r.text.split()) for r in got)
        have = sum(len((r.text or "").split()) for r in rows)
        assert words == pytest.approx(1.5 * have, rel=0.05)
    else:
        assert len(got) == len(rows) and len({r.training_order for r in got}) == len(rows)
        by = {r.doc_id: r for r in got}
        assert by[9000].n_tokens == by[9001].n_tokens == 0 and by[9003].n_tokens > 10_000
        for r in rows:
            if r.doc_id in (9003, 9006, 9002, 9004):
                assert by[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert all(r.n_tokens == len(r.token_ids) for r in got)


def test_token_ids_read_by_training_order_are_in_the_order_of_the_mix(spark, sf):
    mixed = p.source_mix(spark, read(spark, sf, "documents"), sf)
    want = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect()]
    ids = p.byte_bpe(spark, materialise(mixed, "test-mixed"), sf)
    got = [(r.doc_id, r.decoded_sha256) for r in sorted(ids.collect(), key=lambda r: r.training_order)]
    assert len(want) > 100 and got == want


def test_classifier_equals_a_plain_discriminant(spark, sf):
    """Scores against normal densities written out with determinants and inverses, from the same features."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    docs = docs.unionByName(spark.createDataFrame([(9000, "word " * 200_000, None, None, None), (9001, None, None, None, None), (9002, "", None, None, None), (9002, "", None, None, None)], docs.schema)).withColumns({"x": F.lit(1), "score": F.lit("clash")})
    got = {}
    for r in qda.classify(docs, labels).collect():
        assert r.predicted == (r.score >= 0.5)
        got[r.doc_id] = r.score
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("h"), features("text").alias("f")).collect()
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    x = {k: np.array([r.f for r in rows if not r.h and label.get(r.doc_id) == k]) for k in (0, 1)}
    n = {k: len(x[k]) for k in x}
    cov = {k: np.cov(x[k].T, bias=True) for k in x}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))

    def density(v, k):
        c = (0.8 * cov[k] + 0.2 * pooled) / np.outer(scale, scale)
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c)) + 1e-6 * np.eye(len(c))
        d = (v - x[k].mean(axis=0)) / scale
        return np.log(n[k] / (n[0] + n[1])) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.inv(c) @ d

    for r in rows:
        v = np.array(r.f)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -700, 700))), abs=1e-6)
    assert qda.classify(docs.where("false"), labels).count() == 0


def test_vector_links_found_among_ten_thousand(spark):
    """Recall of links at cosines of 0.95 to 0.97, against all pairs: at least 0.99."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(8000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(2500, 48))
    other -= (other * base[:2500]).sum(axis=1, keepdims=True) * base[:2500]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.9505, 0.97, size=(2500, 1))
    all_ = np.concatenate([base, (c * base[:2500] + np.sqrt(1 - c * c) * other) * rng.uniform(0.1, 9, size=(2500, 1))])
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    table = spark.createDataFrame([(k, v) for k, v in enumerate(all_.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(table).collect()}
    found = np.array([got[k] for k in range(len(all_))])
    assert want.sum() >= 5000 and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()


def test_recall_of_edited_texts_in_hot_buckets(spark):
    """Texts that share half their words with hundreds of others, each with one edited partner at similarity 0.82 to 0.9: at least 0.95 end in one class."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    shared = [word() for _ in range(150)]
    rows, pairs = [], []
    for k in range(250):
        text = shared + [word() for _ in range(150)]
        new = list(text)
        for at in rng.sample(range(300), rng.randrange(30, 55)):
            new[at] = word()
        rows += [(2 * k, " ".join(text), "x"), (2 * k + 1, " ".join(new), "x")]
        pairs.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert len({got[a] for a, _ in pairs}) == len(pairs)


def test_a_wrong_sidecar_is_refused(spark, sf):
    """An index that lacks a record, or names another one, is an error, not a shorter result."""
    pages = read(spark, sf, "pages").limit(20)
    folder = new_path(spark, "test-warc")
    archives = warc.normalise(warc.write_streams(warc.plan(pages), folder), folder)
    assert warc.read_records(archives, folder).count() == 20
    path = next(r.path for r in archives.collect() if r.records > 1)
    local = path.removeprefix("file:") + ".index"
    whole = open(local).read().splitlines()
    open(local, "w").write("\n".join(whole[:-1]) + "\n")
    with pytest.raises(Exception, match="names .* records of"):
        warc.read_records(archives, folder).count()
    first, second = json.loads(whole[0]), json.loads(whole[1])
    first["record_id"], second["record_id"] = second["record_id"], first["record_id"]
    open(local, "w").write("\n".join([json.dumps(first), json.dumps(second), *whole[2:]]) + "\n")
    with pytest.raises(Exception, match="lies"):
        warc.read_records(archives, folder).count()



def test_small_batches_only_lower_the_limits(spark):
    before = {k: spark.conf.get(k) for k in p.BATCH}
    try:
        for given, want in ((("10000", "64m"), ("2000", "4194304")), (("500", "1m"), ("500", "1m")), (("0", "4194304b"), ("2000", "4194304b"))):
            for k, v in zip(p.BATCH, given):
                spark.conf.set(k, v)
            p.by_small_batches(spark)
            assert tuple(spark.conf.get(k) for k in p.BATCH) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_workers_give_freed_memory_back(spark):
    environment = spark.sparkContext.environment
    before = dict(environment)
    try:
        environment["MALLOC_ARENA_MAX"] = "2"
        p.by_small_batches(spark)

        @F.udf("array<string>")
        def seen(names):
            import os

            return [os.environ.get(n) for n in names]

        got = spark.range(1).select(seen(F.array(*map(F.lit, p.WORKERS)))).first()[0]
        assert dict(zip(p.WORKERS, got)) == p.WORKERS | {"MALLOC_ARENA_MAX": "2"}
    finally:
        environment.clear()
        environment.update(before)


def test_secret_candidates_start_no_python(spark):
    queries = {"two": [frozenset({"abc", "bcd"})], "either": [frozenset({"abc"}), frozenset({"xyz"})]}
    postings = spark.sql("select * from values (1L, 'abc'), (1L, 'bcd'), (2L, 'xyz'), (3L, 'bcd') t(doc_id, trigram)")
    found = secrets.candidates(postings, queries)
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: sorted(r.kinds) for r in found.collect()} == {1: ["either", "two"], 2: ["either"]}
