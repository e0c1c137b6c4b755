"""Spelling variants and Merkle proofs against plain Python, and both queries against their SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle as K
from tessera.llm import spelling as S
from tessera.llm.queries import ORACLES, QUERIES


def _near(a, b):
    """Differ by exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _plain_variants(words, ratio=10):
    near = {w: sorted((-n, v) for v, n in words.items() if _near(w, v)) for w in words}
    form = {w: b[0][1] if b and -b[0][0] >= ratio * words[w] else None for w, b in near.items()}
    out = {}
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w] = (form[w], end, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def _found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_are_those_of_all_pairs(spark):
    r = random.Random(2)
    words = {"".join(r.choice("abß") for _ in range(r.randint(1, 6))): r.choice([1, 2, 11, 12, 130, 1400]) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert _found(S.group_variants(df)) == _plain_variants(words)


def test_forms_are_followed_to_the_last(spark):
    words = {"aaaaaaaa": 1, "aaaaaaab": 10, "aaaaaaabc": 100, "aaaaaaabcd": 1000, "aaaaaaabcde": 10_000}
    found = _found(S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[1] for v in found.values()} == {"aaaaaaabcde"} and found == _plain_variants(words)


def test_odd_words(spark):
    """Ties go to the smallest word; repeated rows add up; nulls go; long words work; no words give none."""
    rows = [("cat", 1), ("cab", 20), ("can", 20), ("dog", 4), ("dog", 3), (None, 5), ("x", None), ("q" * 400, 1), ("q" * 401, 50), ("q" * 400 + "r", 2)]
    found = _found(S.group_variants(spark.createDataFrame(rows, "word string, n long")))
    assert found["cat"][:2] == ("cab", "cab") and found["dog"][2] == 7 and "x" not in found and None not in found
    assert found["q" * 400] == ("q" * 401, "q" * 401, 1, 2, 50)
    assert S.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_least_length_changes_nothing_for_longer_words(spark):
    words = {"abcdefg": 50, "abcdefgh": 2, "abcdefgx": 3, "bcdefgh": 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert _found(S.group_variants(df, least_length=7)) == _plain_variants(words)


def test_runs_lower_only_a_to_z(spark):
    docs = spark.createDataFrame([(1, "ÀBC-dÉ f×g", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, run string")
    rows = S.runs_of_letters(docs, "[A-Za-zÀ-ÿ]{2,}")
    assert rows.columns == ["doc_id", "run"] and [r["run"] for r in rows.orderBy("run").collect()] == ["dÉ", "f×g", "Àbc"]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_proofs(digests):
    """Top and proofs (before, after, leaf first) of a list of digests."""
    proofs, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for leaf, i in enumerate(at):
            run = runs[i // 3]
            proofs[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at = [i // 3 for i in at]
        level = [_h(*run) for run in runs]
    return level[0], proofs


def _plain_manifest(rows):
    """(group, key, digest) -> (subroot, root, proof) of all rows, sorted."""
    groups = {}
    for group, key, digest in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in order:
        groups[g].sort()
        tops.append(_plain_proofs([d for _, _, d in groups[g]]))
    root, over = _plain_proofs([t for t, _ in tops])
    return sorted(
        (str(g), str(k if known else None), d, top, root, tuple(p + above))
        for g, (top, proofs), above in zip(order, tops, over, strict=True)
        for (known, k, d), p in zip(groups[g], proofs, strict=True)
    )


def _rows(df):
    return sorted((str(r["g"]), str(r["k"]), r["digest"], r["subroot"], r["root"], tuple((p["before"], p["after"]) for p in r["proof"])) for r in df.collect())


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [9, 1], [28, 10, 1, 2], [1] * 11])
def test_manifest(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(f"s{g}é" if g else None, k, _h(str(g), str(k))) for g, n in enumerate(sizes) for k in range(n)]
    r.shuffle(rows)
    out = K.manifest(spark.createDataFrame(rows, "g string, k long, digest string").repartition(3), "g", ["k"])
    assert _rows(out) == _plain_manifest(rows)
    ok = out.select((K.fold(F.col("digest"), F.col("proof")) == F.col("root")).alias("ok"), K.digest_of_proof(F.col("proof")).alias("p"), "proof").collect()
    assert all(x["ok"] and x["p"] == _h(*[s for step in x["proof"] for s in step]) for x in ok)


def test_manifest_of_repeated_and_null_keys(spark):
    """Equal keys go by digest, equal rows each have a leaf, null keys come first; clashing names are kept."""
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "w"), ("a", None, "y"), ("b", None, "z"), (None, 5, "v")]
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], "g string, k long, digest string, idx int, subroot_ string")
    out = K.manifest(df, "g", ["k"])
    assert _rows(out) == _plain_manifest(rows) and out.columns == [*df.columns, "subroot", "root", "proof"]
    empty = K.manifest(df.where("false"), "g", ["k"])
    assert empty.columns == out.columns and empty.count() == 0


def test_group_that_holds_most_rows_is_in_many_tasks(spark):
    rows = [("hot", k, _h(str(k))) for k in range(500)] + [("cold", 1, _h("c"))]
    out = K.manifest(spark.createDataFrame(rows, "g string, k long, digest string").repartition(8), "g", ["k"])
    assert _rows(out) == _plain_manifest(rows)


def test_leaf_frames_its_fields(spark):
    r = spark.createDataFrame([(12, None, "é|")], "a long, b string, c string").select(K.leaf(F.col("a"), F.col("b"), F.col("c")).alias("h")).first()
    assert r["h"] == _h("2:12", "-", "3:é|")


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory, odd):
    r = random.Random(11)
    lines = [" ".join(r.choice(["Variante", "variants", "Ähnliché", "weiteres", "weitere", "kurz"]) for _ in range(30)) + "\n" for _ in range(40)]
    texts = [*odd, *odd, *lines, "x" * 5000 + " " + "X" * 5000]
    rows = [(k, t, "en", [None, "a", "b", "B", "é"][min(k % 7, 4)], len(t or ""), 0.5, "x", 1) for k, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, 0.5, "x", 1), (None, None, None, None, None, 0.5, "x", 1), (4, "again", "en", "a", 5, 0.5, "x", 1)]
    path = tmp_path_factory.mktemp("odd")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, `__finds` int"
    spark.createDataFrame(rows, kinds).repartition(4).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["op12_spelling", "op13_merkle"])
def test_queries_on_odd_documents_equal_their_sql(spark, odd_documents, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd_documents}/documents.parquet/*.parquet'")
    found = con.sql(ORACLES[name])
    df = QUERIES[name](spark, odd_documents).select(*found.columns)
    got, want = sorted(map(repr, (tuple(r) for r in df.collect()))), sorted(map(repr, found.fetchall()))
    assert got == want and len(got) > 4
    if name == "op13_merkle":
        tampered = {k for k in range(70) if zlib.crc32(str(k).encode()) % 2 == 0}
        assert {r["doc_id"] for r in df.where("NOT verified").collect()} <= tampered
