"""Shared strings, ranked search and conversation repair, against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelight.llm import dialogue, search, suffixes

DOCS = "doc_id long, text string"


# --- shared strings


def shared(texts):
    """n_bytes, n_removed, n_spans and digest of each text, by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[k : k + 400] for r in raw for k in range(len(r) - 399))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - 399):
            if count[r[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def check_shared(spark, rows, schema=DOCS, split=3):
    docs = spark.createDataFrame(rows, schema).repartition(split)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs).collect())
    want = sorted((r[0] is not None, r[0] or 0, *w) for r, w in zip(rows, shared([r[1] for r in rows])))
    assert got == want


def prose(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def test_shared_strings_equal_brute_force(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 900), prose(rng, 410)
    rows = [(k, prose(rng, rng.randrange(0, 900)) + passage[rng.randrange(0, 300) : rng.randrange(500, 900)] + prose(rng, rng.randrange(0, 300))) for k in range(40)]
    rows += [(100 + k, prose(rng, k) + other + prose(rng, 3 * k)) for k in range(12)]
    rows += [(200, passage + passage), (201, "x" * 1200), (202, "xy" * 700), (203, None), (204, ""), (205, prose(rng, 399)), (206, prose(rng, 400)), (207, other[:399]), (208, other[:400])]
    rows += [(300, passage), (300, passage), (None, passage[:450]), (None, passage[:450]), (None, prose(rng, 500))]
    whole = rows[0][1]
    rows += [(400, whole), (401, "z" + whole[1:]), (402, whole[:-1] + "z"), (403, prose(rng, 40_000) + whole)]
    check_shared(spark, rows)
    check_shared(spark, [(d, t, "clash", 1) for d, t in rows[-12:]], "doc_id long, text string, spans string, w0 int")
    check_shared(spark, [])


def test_edges_that_only_part_of_a_group_shares(spark):
    """One middle with many left and right contexts: which windows repeat depends on both sides at once."""
    rng = random.Random(5)
    middle, lefts, rights = prose(rng, 260), [prose(rng, 300) for _ in range(5)], [prose(rng, 300) for _ in range(5)]
    rows = [(k, prose(rng, 100) + lefts[k % 5][rng.randrange(0, 300) :] + middle + rights[k // 5 % 5][: rng.randrange(0, 300)] + prose(rng, 50)) for k in range(60)]
    check_shared(spark, rows)


def test_multikey_order_sorts_and_finds_equals():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 500).astype(np.int64) for _ in range(3)]
    order, equal = suffixes.multikey_order(words)
    keys = [tuple(int(w[k]) for w in words) for k in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_borders_of_buckets_are_compared(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 20)
    rng = random.Random(9)
    middle = prose(rng, 380)
    check_shared(spark, [(k, prose(rng, 60) + middle + "abcdefgh"[k % 3] * 30 + prose(rng, 60)) for k in range(12)], split=12)


# --- ranked search

CHARS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in CHARS.findall(text or "")]


def ranked(docs, items):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted, scores = Counter(terms(text)), []
        for doc, bag in bags:
            m = 100 - 75 + (75 * bag.total() * n) // length if length else 0
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, c in wanted.items() if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=lambda r: (r[0] is None, r))


def check_ranked(spark, docs, items):
    got = search.rank(spark.createDataFrame(docs, DOCS + ", score string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted([tuple(r) for r in got], key=lambda r: (r[0] is None, r)), ranked([d[:2] for d in docs], items)


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 64)
    monkeypatch.setattr(search, "WAVE_ITEMS", 12)
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "kélmnop" for b in "aeiouxyz09"]
    text = lambda n: rng.choice(["  ", "", "\x7f"]).join(["", " "]).join(rng.choices(words, [1 / (k + 1) for k in range(70)], k=n))
    docs = [(k, text(rng.randrange(1, 60)), "") for k in range(400)] + [(900 + k, "Ka kA ka", "") for k in range(15)]
    docs += [(1000, None, ""), (1001, "", ""), (1002, "-- !", ""), (None, docs[3][1], ""), (3, docs[3][1], ""), (1003, text(30_000), "")]
    items = [(k, text(rng.randrange(1, 12))) for k in range(30)] + [(50, "KA"), (51, None), (52, "absent"), (53, "ka ka é-ka"), (54, docs[7][1])]
    got, want = check_ranked(spark, docs, items)
    assert got == want
    assert not check_ranked(spark, [], items)[0] and not check_ranked(spark, docs, [])[0]


def test_pruning_skips_leaves_and_big_sums_are_whole():
    """Documents of separate vocabularies: few pairs of leaves are scored. Items whose sums pass 2**53 are summed in whole numbers."""
    rng = np.random.default_rng(4)
    docs = [(np.arange(k // 32 * 8, k // 32 * 8 + 8), rng.integers(1, 900_000, 8).astype(float)) for k in range(1024)]
    items = [(np.arange(k * 8, k * 8 + 8), np.full(8, 5000.0)) for k in range(32)]
    one, two = search.Tree.over(items, 256, search.ITEM_LEAF), search.Tree.over(docs, 256, search.DOC_LEAF)
    best = search.Best(32, 10, np.ones(32, dtype=np.int64))
    scored = search.search(one, two, [(False, k, 0) for k in range(1024)], best, np.ones(32, dtype=bool))
    assert scored == 32 < len(one.levels[0]) * len(two.levels[0])
    for k in range(32):
        want = heapq.nlargest(10, [int(d[1].sum()) * 5000 for d in docs[k * 32 : k * 32 + 32]])
        assert sorted((h[0] for h in best.held[k]), reverse=True) == want
    huge = search.Tree.over([(np.array([0, 1]), np.array([2.0**40 + 1, 1.0]))], 2, 8)
    doc = search.Tree.over([(np.array([0, 1]), np.array([999_999.0, 1.0]))], 2, 32)
    best = search.Best(1, 10, np.ones(1, dtype=np.int64))
    search.search(huge, doc, [(False, 1, 0)], best, np.zeros(1, dtype=bool))
    assert best.held[0][0][0] == (2**40 + 1) * 999_999 + 1


# --- conversations

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(roles, faults):
    """Least cost and ASCII-least script, by trying all scripts in order of cost."""
    n, queue, best = len(roles), [(0, "", 0, "")], None
    while queue:
        cost, audit, i, made = heapq.heappop(queue)
        if best and cost > best[0]:
            break
        if i == n and PATTERN.fullmatch(made):
            best = min(best or (cost, audit), (cost, audit))
        grown = []
        if i < n:
            grown.append((cost + 4, audit + "D", i + 1, made))
            if faults[i] in (0, 3):
                extra = 3 if faults[i] == 3 else 0
                grown.append((cost + extra, audit + "K", i + 1, made + roles[i]))
                grown += [(cost + extra + 3, audit + "R", i + 1, made + r) for r in "ua"]
        grown += [(cost + 3, audit + "I", i, made + r) for r in "ua"]
        for g in grown:
            if any(PATTERN.fullmatch(g[3] + more) for more in ("", "a", "ua", "uaua")):
                heapq.heappush(queue, g)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=6))
def test_script_equals_trying_all(rows):
    codes = bytes("suax".index(r) * 4 + f for r, f in rows)
    assert dialogue.script(codes) == cheapest([r for r, _ in rows], [f for _, f in rows])


def test_script_of_many_turns():
    n = 30_000
    codes = bytes([dialogue.U * 4, dialogue.A * 4] * n)
    assert dialogue.script(codes) == (0, "K" * 2 * n)
    assert dialogue.script(codes[1:]) == (3, "I" + "K" * (2 * n - 1))


def damaged(rows):
    out = defaultdict(list)
    some = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = some(role), some(text)
        tie = hashlib.md5(f"{role}:{text}".encode()).digest()
        fate = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn is not None, turn or 0, tie, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(r) for c, r in out.items()}


def repaired(rows):
    seen, faults, turns, roles = set(), [], [r[1] for r in rows if r[0]], [r[3][:1] for r in rows]
    for *_, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 0 if last[0] in ".!?" else 3)
        seen.add((role, text))
    cost, audit = cheapest(["sua"["sua".index(r)] if r in ("s", "u", "a") else "x" for r in roles], faults)
    lines, at, made = [], 0, ""
    for edit in audit:
        due = "assistant" if made.endswith("u") else "user"
        if edit != "D":
            role = rows[at][3] if edit == "K" else due
            lines.append(role + ":" + ("" if edit == "I" else rows[at][4]))
            made += role[0]
        at += edit != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("extra", [False, True])
def test_conversations_equal_brute_force(spark, extra):
    rng = random.Random(7)
    say = ["Fine.", "So?", "and then", " \n", "", None, "Yes!\t", "é.", "Fine."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    rows = [(c, t if rng.random() > 0.1 else rng.choice([None, 1, 9]), roles[min(1, t) + t % 2 if rng.random() > 0.3 else rng.randrange(8)], rng.choice(say)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(None, t, "user", "Null.") for t in range(3)] + [(200, 1, "user", "Same.")] * 4 + [(201, 2, "user", "word. " * 20_000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    if extra:
        docs = docs.selectExpr("*", "'x' as tie", "1 as kind", "'y' as audit")
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair(dialogue.damage(docs)).collect()}
    assert got == {c: repaired(r) for c, r in damaged(rows).items()}
    assert dialogue.repair(dialogue.damage(docs.where("false"))).count() == 0
