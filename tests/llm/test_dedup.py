"""Near vectors, near documents and repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from duelight.llm import embeddings, graph, neardup, substrings
from duelight.llm.words import blocks


def parts(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 90), random.randint(0, 90)) for _ in range(50)] + [(500 + i, 501 + i) for i in range(30)]
    want = parts(edges, {n for e in edges for n in e})
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 24))
    x = [b for b in rng.standard_normal((120, 24))] + [base[i % 3] + 0.15 * rng.standard_normal(24) for i in range(90)] + [base[0]] * 20 + [2 * base[1]]
    rows = [(i, [float(np.float32(v)) for v in e], 1, "k") for i, e in enumerate(x)]
    rows += [(900, None, 1, "k"), (901, [0.0] * 24, 1, "k"), (902, [float("nan")] + [1.0] * 23, 1, "k"), (903, [], 1, "k"), (904, [None] + [1.0] * 23, 1, "k"), (905, rows[0][1][:5], 1, "k")]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, keys string")).collect()}
    m = np.array([r[1] for r in rows[: len(x)]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    want = parts([(i, j) for i, j in zip(*np.nonzero(near))], range(len(x)))
    found = sum(got[i].n_links for i in range(len(x)))
    true = int(near.sum()) - len(x)
    assert 0.98 * true <= found <= true
    assert [got[i].component_id for i in range(len(x))] == [want[i] for i in range(len(x))]
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_alignment_bound():
    random.seed(9)
    for _ in range(800):
        a = [random.randint(0, 6) for _ in range(random.randint(0, 22))]
        b = list(a)
        for _ in range(random.randint(0, 8)):
            r = random.random()
            if r < 0.4 and b:
                b[random.randrange(len(b))] = random.randint(0, 9)
            elif r < 0.7:
                b.insert(random.randint(0, len(b)), random.randint(0, 9))
            elif b:
                del b[random.randrange(len(b))]
        most = random.randint(0, 10)
        assert neardup.within(np.array(a, "u4"), np.array(b, "u4"), most) == (distance(a, b) <= most)


def sample_docs():
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6)))
    passage = [word() for _ in range(60)]
    docs, near = {}, []
    for i in range(0, 60):
        docs[i] = [word() for _ in range(random.randint(30, 120))]
        if i % 4 == 0:  # many documents share a passage and nothing else
            docs[i] = docs[i][:50] + passage + docs[i][50:]
    nxt = 100
    for i in (1, 2, 3, 5, 8):
        for _ in range(6):
            w = list(docs[i])
            for _ in range(max(1, len(w) // 20)):
                w[random.randrange(len(w))] = word()
            if random.random() < 0.5:
                w.insert(random.randrange(len(w)), word())
            docs[nxt] = w
            near.append((i, nxt))
            nxt += 1
    for k in range(40):
        docs[nxt + k] = docs[7]
    return docs


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COLD", 4)
    docs = sample_docs()
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if docs[a] == docs[b] or (abs(len(docs[a]) - len(docs[b])) <= 30 and distance(docs[a], docs[b]) <= 0.2 * max(len(docs[a]), len(docs[b])))]
    want = parts(links, ids)
    rows = [(i, " ".join(w), "x") for i, w in docs.items()] + [(500, None, "x"), (501, None, "x"), (502, "", "x"), (503, "", "x"), (504, "one two", "x"), (1, " ".join(docs[1]), "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = neardup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id < 500} == want
    other = {r.doc_id: r.class_id for r in got if r.doc_id >= 500}
    assert other == {500: 500, 501: 501, 502: 502, 503: 502, 504: 504}
    kept = neardup.keep_one(table)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()) | {500, 501, 502, 504})
    assert kept.columns == table.columns
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def edited(words, share, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), round(share * len(out))):
        out[k] = "x" + str(rng.randrange(10**9))
    return out


def test_copies_that_only_link_with_their_original(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "COLD", 16)
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    at = 87
    docs = [edited(base, 0.12, rng) for _ in range(150)]
    docs.insert(at, base)
    ids = [np.array([hash(w) & 0xFFFFFFFF for w in d], "u4") for d in docs]
    alone = [k for k in range(len(ids)) if k != at and not any(neardup.within(ids[k], ids[j], 60) for j in range(len(ids)) if j not in (k, at))]
    assert len(alone) > 50 and all(neardup.within(ids[k], ids[at], 60) for k in range(len(ids)))
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    assert [r.class_id for r in got] == [0] * 151


@pytest.mark.parametrize("sizes", [[70, 3], [9, 9, 9, 9, 9], [25, 1, 1], [5, 4]])
def test_texts_of_different_classes_meet_in_one_block(spark, monkeypatch, sizes):
    monkeypatch.setattr(neardup, "BLOCK", 10)
    label = [k for k, n in enumerate(sizes) for _ in range(n)]
    rows = [(i, k, 1, 0, False, len(label), 0, sizes[0]) for i, k in enumerate(label)]
    found = neardup._large_blocks(spark.createDataFrame(rows, "nid long, label long, h long, at byte, second boolean, n long, main long, n_main long")).collect()
    blocks = {}
    for r in found:
        blocks.setdefault((r.p, r.q), []).append(r)
    assert max(map(len, blocks.values())) <= 50
    met = set()
    for block in blocks.values():
        both = len({r.side for r in block}) == 2
        met |= {(x.nid, y.nid) for x in block for y in block if x.nid < y.nid and not (both and x.side == y.side)}
    assert {(i, j) for i in range(len(label)) for j in range(i + 1, len(label)) if label[i] != label[j]} <= met
    assert len(found) == len(rows) or len(rows) > 10


@pytest.mark.parametrize("n, similarity, least", [(300, 0.8, 0.98), (100, 0.8, 0.98), (30, 0.867, 0.98), (20, 0.85, 0.96)])
def test_similar_texts_share_a_bucket(n, similarity, least):
    import pyarrow as pa

    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for _ in range(300)]
    texts = [" ".join(w) for w in base + [edited(w, 1 - similarity, rng) for w in base]]
    keys = [set(neardup._orders(neardup._labelled(g))[0].tolist()) for b in blocks(pa.array(texts)) for g in neardup._grams(b)]
    assert sum(bool(x & y) for x, y in zip(keys[:300], keys[300:])) >= least * 300


def test_blocks_compare_all_pairs_of_different_classes():
    rng = random.Random(4)
    base = [rng.randrange(10**6) for _ in range(100)]
    words = [np.array(base, "u4")]
    for k in range(30):
        w = list(base) if k < 20 else [rng.randrange(10**6) for _ in range(100)]
        for i in rng.sample(range(100), 12):
            w[i] = rng.randrange(10**6)
        words.append(np.array(w, "u4"))
    n = len(words)
    for side in (np.zeros(n, int), np.arange(n) % 2):
        allowed = [(a, b) for a in range(n) for b in range(a + 1, n) if (not side.any() or side[a] != side[b]) and neardup.within(words[a], words[b], 20)]
        got = neardup.block_links(words, np.arange(n), side)
        assert parts(got, range(n)) == parts(allowed, range(n))
        assert neardup.block_links(words, np.zeros(n, int), side) == []


def test_occurrence_labels_and_order():
    import pyarrow as pa

    block = next(blocks(pa.array(["a b c d e a b c d e a b c d e"])))
    gram = next(neardup._grams(block))
    assert len(set(gram.tolist())) < len(gram) == len(set(neardup._labelled(gram).tolist()))


def plain_passages(docs):
    seen, gone = set(), defaultdict(set)
    for i in sorted(docs):
        w = docs[i]
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[i] |= set(range(s, s + 20))
            seen.add(key)
    return gone


def test_passages_equal_brute_force(spark):
    import hashlib

    random.seed(2)
    word = lambda: random.choice("abcdefghijklmnopqrstuvwxyz") + random.choice(["", "é", "x"])
    shared = [word() for _ in range(55)]
    docs = {}
    for i in range(80):
        w = [word() for _ in range(random.randint(0, 60))]
        if i % 2:
            at = random.randint(0, len(w))
            w = w[:at] + shared[random.randint(0, 20) :] + w[at:]
        docs[i] = w
    docs[90] = ["x", "y", "z"] * 30  # periodic
    docs[91] = ["w"] * 200
    docs[92] = docs[3]
    gone = plain_passages(docs)
    rows = [(i, "\t ".join(w) + "\n") for i, w in docs.items()] + [(95, None), (96, ""), (97, " \n ")]
    got = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, w in docs.items():
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest()), i
    assert all(got[i].n_words == 0 for i in (95, 96, 97))


def test_passages_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substrings.deduplicate(rows).collect())
    assert got == [(0, 40), (1, 0), (1, 0), (2, 40)]
    assert substrings.deduplicate(rows.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_blocks_split_words_alike(size):
    import pyarrow as pa

    texts = ["a bb  c", None, "", "x", "y z", "\x0bq\x0c", "é ü"]
    got = [[bytes(b.data[s:e]).decode() for s, e in zip(b.start[i:j], b.end[i:j])] for b in blocks(pa.array(texts), size) for i, j in zip(b.word_from[:-1], b.word_from[1:])]
    assert got == [(t or "").split() for t in texts]


def test_short_texts_link_wherever_they_are_edited(spark, monkeypatch):
    """Every pair of short texts within 20% of edits ends in one class, also in hot buckets: equal to all pairs by plain edit distance."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    docs = {}
    for k in range(90):
        base = rng.choices(words, k=rng.randrange(5, 24))
        docs[3 * k] = base
        for j in (1, 2):
            new = list(base)
            for _ in range(rng.randrange(1, len(base) // 5 + 1)):
                at, what = rng.randrange(len(new)), rng.randrange(3)
                new[at : at + (what < 2)] = [rng.choice(words)] if what != 1 else []
            docs[3 * k + j] = new
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if docs[a] == docs[b] or distance(docs[a], docs[b]) <= int(0.2 * max(len(docs[a]), len(docs[b])) + 1e-9)]
    links = [(a, b) for a, b in links if min(len(docs[a]), len(docs[b])) <= neardup.SHORT]
    want = parts(links, ids)
    assert len(links) > 150
    table = spark.createDataFrame([(i, " ".join(w), "x") for i, w in docs.items()], "doc_id long, text string, key string")
    for cold in (64, 3):
        monkeypatch.setattr(neardup, "COLD", cold)
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(table).collect()}
        assert all(got[a] == got[b] for a, b in links)
        assert all(got[i] == want[i] for i in ids if len(docs[i]) <= neardup.SHORT and all(len(docs[j]) <= neardup.SHORT for j in ids if want[j] == want[i]))


def test_segments_meet_for_every_pair(spark):
    """The stretches of the shorter text hold an intact segment of the longer one, for random edits of texts over few words."""
    rng = random.Random(3)
    for _ in range(3000):
        long = [rng.randrange(4) for _ in range(rng.randrange(5, 26))]
        most = neardup.most_edits(len(long))
        other = list(long)
        for _ in range(most):
            at, what = rng.randrange(len(other)), rng.randrange(3)
            other[at : at + (what < 2)] = [rng.randrange(4)] if what != 1 else []
        a, b = sorted((long, other), key=len)
        if len(a) > neardup.SHORT or distance(a, b) > neardup.most_edits(len(b)):
            continue
        keys = [{(n, tuple(t[s:e])) for s, e, n in zip(*(x.tolist() for x in neardup.segments(len(t))))} for t in (a, b)]
        assert keys[0] & keys[1], (a, b)


def test_texts_meet_their_buckets_in_one_row_each(spark):
    """The join that gives buckets the columns of their texts makes a row per text, however many buckets hold it."""
    rows = spark.createDataFrame([(n, 100 * b, b) for n in range(5) for b in range(40)], "nid long, key long, at int")
    text = spark.createDataFrame([(n, n % 2, 10 * n) for n in range(4)], "nid long, label long, long int")
    got = neardup._placed(rows, text, "key", "at")
    assert sorted(map(tuple, got.collect())) == sorted((n, 100 * b, b, n % 2, 10 * n) for n in range(4) for b in range(40))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner") < plan.index("Aggregate [nid")
