"""Source mixing against a plain loop, and byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from duelight.llm import bpe, mixing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, source string, size long"


def plain_mix(rows, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), share * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * size[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = cap * size[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = []
    for s in sources:
        at = 0
        for d, n in sorted(((d, n) for d, x, n in rows if x == s), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] or 0, r[1])):
            taken.append((d, n, sum(max(0, min(n, int(target[s]) - k * size[s] - at)) for k in range(2))))
            at += n
    return target, sorted(taken, key=repr)


def test_mix_equals_plain_loop(spark):
    random.seed(4)
    rows = [(i, random.choice(["hot"] * 6 + ["b", "é", None, "a"]), random.choice([0, 1, 5, 40])) for i in range(300)] + [(7, "hot", 5), (7, "hot", 5), (None, "a", 3)]
    target, taken = plain_mix(rows)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), bucket_rows=20).collect()
    assert sorted([(r.doc_id, r.size, r.taken) for r in got], key=repr) == taken
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size
        assert r.position is None or 0 <= r.position <= 1
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places)


def test_mix_cases(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, None, 0)], SCHEMA)).collect()
    assert [r.taken for r in got] == [0, 0]
    extra = spark.createDataFrame([(1, "a", 4, 9, "x")], SCHEMA + ", target long, position string")
    assert mixing.mix(extra).count() == 1


def test_curriculum_inverts_its_integral(spark):
    from pyspark.sql import functions as F

    bent = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))
    rows = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.due([bent], F.lit(0), F.col("u")).alias("t")).collect()

    def area(t):
        return t + 2 * t * t if t <= 0.5 else 1.0 + (t - 0.5) * 3 - 3 * (t - 0.5) ** 2

    assert all(area(r.t) / mixing.integral(bent) == pytest.approx(r.u, abs=1e-9) for r in rows)


def test_first_words(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("  a b\nc d", 2), ("a  b c", 3), ("", 1)], "t string, n int")
    assert [r[0] for r in rows.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a b\n", "a  b c", ""]


@pytest.fixture(scope="module")
def codecs():
    ranks = bpe.load_ranks(PATH)
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeth n's09\n")), max_size=80))
def test_encode_equals_tiktoken(codecs, text):
    own, other = codecs
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_pieces(codecs):
    own, other = codecs
    for text in ("ab" * 20_000, "é" * 9_999, " " * 5_000 + "x", "<|endoftext|>"):
        assert own.encode(text) == other.encode_ordinary(text)


def test_digests_and_columns(spark, codecs):
    from pyspark.sql import functions as F

    rows = [(1, "The cat's hat", "x"), (2, None, "y"), (3, "", "z"), (3, "naïve 日本", "z"), (None, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digests(spark, docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t, _ in rows:
        ids = codecs[1].encode_ordinary(t or "")
        r = got[(i, len(ids))]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = docs.select("text", bpe.decode(spark, bpe.encode(spark, F.col("text"), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).alias("b")).collect()
    assert all(bytes(r.b) == (r.text or "").encode() for r in back)
    assert bpe.tokenised(spark, docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_workers_drop_the_codec_with_its_broadcast(spark):
    docs = spark.createDataFrame([(i, "The cat's hat") for i in range(40)], "doc_id long, text string").repartition(8)
    assert bpe.digests(spark, docs, PATH, public_tokenizers.PATTERN).where("n_tokens > 0").count() == 40

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._CODECS)])], ["n"])

    assert spark.range(0, 16, 1, 8).mapInArrow(held, "n long").groupBy().sum("n").head()[0] == 0
