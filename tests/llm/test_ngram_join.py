import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join
from tessera.llm.components import components
from tessera.llm.ngram_join import CountTree, group_counts, near_duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def edited(rng, words, share):
    return [rng.choice(["zig", "zag", "zog", str(rng.randrange(999))]) if rng.random() < share else w for w in words]


def corpus(seed):
    """Near copies at all distances, chains, shared passages, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))
    passage, texts = [word() for _ in range(60)], [None, "", " \t", "one", "ONE", "a b c d e", "A b  c\nd e", "a b c"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120, 400]))]
        for k in range(rng.choice([1, 2, 5, 12])):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))))
            base = edited(rng, base, 0.01) if k % 3 == 0 else base
        texts.append(" ".join(base[: len(base) // 2] + passage + base[len(base) // 2 :]))
    texts += [" ".join(passage)] * 5 + [" ".join(passage + [word() for _ in range(n)]) for n in range(0, 40, 4)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "chunk"), [(1, 256), (2, 4)])
def test_against_brute_force(make_docs, monkeypatch, seed, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = corpus(seed)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    got = near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_empty_and_single(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert [tuple(r) for r in near_duplicates(make_docs(["a b"])).collect()] == [(0, 1, 0)]


def test_tree_loses_nothing():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), np.uint64))
        sets += [base] + [np.unique(np.where(rng.random(len(base)) < p, rng.integers(0, 2**63, len(base), np.uint64), base)) for p in (0.02, 0.1, 0.2)]
    tree, pairs = CountTree(np.array([group_counts(s) for s in sets]), 75), 0
    for i, a in enumerate(sets):
        near = set(tree.query(tree.points[i]).tolist())
        for j, b in enumerate(sets):
            if ngram_join.linked(a, b, 75):
                assert j in near
                pairs += i != j
        assert len(near) < len(sets) // 2
    assert pairs > 20


def test_prefix_argument():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 80)
        a = set(rng.sample(range(400), n))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randrange(0, n // 4 + 1)):
            b.discard(x)
        b |= set(rng.sample(range(400, 800), rng.randrange(0, n // 4 + 1)))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        head = lambda s: set(sorted(s)[: ngram_join.prefix_size(len(s), 75)])
        both = len(head(a) & head(b))
        assert both >= ngram_join.prefix_need(len(a), 75) and both >= ngram_join.prefix_need(len(b), 75)


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (300, 301), (302, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 300, 301: 300, 302: 300}


def test_frequent_tokens_in_all_prefixes(make_docs, monkeypatch):
    """Documents put together from few common passages: every token is frequent, hardly any pair is linked."""
    from itertools import combinations

    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = random.Random(11)
    passages = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(9)]
    texts = [" ".join(passages[k] for k in some) for some in combinations(range(9), 4)]
    base = " ".join(passages[:5])
    texts += [base] * 3 + [" ".join(edited(rng, base.split(), 0.02)) for _ in range(40)]
    texts += [" ".join(edited(rng, t.split(), 0.01)) for t in texts[:30]]
    rows = [(5 * i % 997, t) for i, t in enumerate(texts)]
    got = near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_a_token_of_thousands_of_unlinked_documents(make_docs, monkeypatch):
    """5,000 documents with one passage and words of their own; survivors joined by a shuffle."""
    seen = []
    real = ngram_join.survivors
    monkeypatch.setattr(ngram_join, "survivors", lambda sets, percent: seen.append(1) or real(sets, percent, most_broadcast=0))
    passage = " ".join(f"common{i}" for i in range(30))
    texts = [f"{passage} " + " ".join(f"own{k}y{i}" for i in range(9)) for k in range(5000)]
    texts += [texts[7], texts[7] + " tail", texts[4000]]
    want = {i: i for i in range(5000)} | {5000: 7, 5001: 7, 5002: 4000}
    got = near_duplicates(make_docs(texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and seen
    assert {r.n_shingles for r in got} == {35, 36}


def test_odd_rows(spark):
    """Null ids, repeated rows, clashing names and a very long text."""
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(None, "a b c d e f g", 1), (1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (2, None, 1), (3, long, 1), (4, long + " end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token int").withColumns({"node": F.lit(1), "id": F.lit("x"), "n": F.lit(2), "component_id": F.lit(3)})
    got = sorted(tuple(r) for r in near_duplicates(docs).na.fill(-1).collect())
    assert got == [(-1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 199_996, 3), (4, 199_997, 3)]


def test_smaller_set_has_the_first_common_token_early():
    """The shorter prefix of step 4 loses nothing."""
    rng = random.Random(6)
    for _ in range(500):
        n = rng.randrange(1, 80)
        a = set(rng.sample(range(300), n))
        b = set(a) - set(rng.sample(sorted(a), rng.randrange(0, n // 4 + 1))) | set(rng.sample(range(300, 600), rng.randrange(0, n // 4 + 1)))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        small, large = sorted((a, b), key=len)
        order = rng.sample(range(600), 600)
        place = lambda s: sorted(s, key=order.__getitem__)
        first = next(t for t in place(large) if t in small)
        assert place(large).index(first) < len(large) - -(-75 * len(large) // 100) + 1
        assert place(small).index(first) < len(small) - -(-150 * len(small) // 175) + 1


def test_a_pair_leaves_one_block():
    """Not that of every token which both have: of the first one, and only if finer groups admit it too."""
    columns = ["node", "token", "band", "hot", "c1", "c2", "root", "right", "point", "firsts", "bucket"]

    def pairs(sets, token, firsts, percent=75):
        rows = [(k, token, -1, False, 0, 0, k, right, ngram_join._pack(group_counts(s, ngram_join.FINE)), np.array(firsts), 0) for k, s in enumerate(sets) for right in (False, True)]
        return ngram_join._block_pairs(percent)(pd.DataFrame(rows, columns=columns)).values.tolist()

    rng = np.random.default_rng(4)
    common, *own = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 300, 300))
    twins, misses = [np.r_[common, x[:1]] for x in own], [np.r_[common, x] for x in own]
    assert pairs(twins, 7, [7, 3, 9]) == [[0, 1]]
    assert pairs(twins, 3, [7, 3, 9]) == pairs(twins, 9, [7, 3, 9]) == pairs(twins, 5, [7, 3, 9]) == []
    coarse = np.array([group_counts(s) for s in misses])
    assert len(CountTree(coarse, 70).query(coarse[0])) == 2 and pairs(misses, 7, [7], 70) == []
