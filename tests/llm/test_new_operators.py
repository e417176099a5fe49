"""Ranked lexical search, Jaccard join and spelling variants against plain Python, on the small tables and on odd rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lexical, queries, spelling, trie_join
from corpusloom.llm.hashing import U
from tests.llm import brute
from tests.llm.conftest import SF, prose


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def found11(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect()]


def test_op11(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert found11(queries.QUERIES["op11_lexical_search"](spark, SF)) == sorted(brute.op11(docs, items))


@pytest.mark.parametrize("most", [20_000, 2])
def test_op11_odd_rows(spark, odd_rows, monkeypatch, most):
    """Nulls, ties, repeated rows, items without terms, several groups of items, small blocks, clashing columns."""
    monkeypatch.setattr(lexical, "MAX_ITEMS", most)
    rows = [r[:2] for r in odd_rows] + [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (90, "alpha beta gamma"), (91, "alpha beta gamma")]
    items = [(1, "alpha ALPHA beta"), (2, None), (3, "..."), (4, "zzz yyy"), (5, "äöü ß 漢字 one"), (6, prose(40, 9))]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, rank int, score string").repartition(5)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for depth in (20, 3):
        assert found11(lexical.search(d, b, depth=depth)) == sorted(brute.op11(rows, items, depth), key=lambda x: x[:2])
    assert lexical.search(d.limit(0), b).count() == 0 and lexical.search(d, b.limit(0)).count() == 0


def test_op11_scores_stay_whole_numbers():
    n = np.array([1, 10**7, 3 * 10**8], dtype=np.int64)
    got = lexical.impacts(np.array([1, 5, 10**6]), n, np.array([7, 7, 7]), 3 * 10**10, 10**13)
    want = [7 * (10**9 * t // (1000 * t + 12 * (75 + 25 * int(x) * 3 * 10**10 // 10**13))) for t, x in zip((1, 5, 10**6), n, strict=True)]
    assert got.tolist() == want


def test_op12(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op12_jaccard_join"](spark, SF).collect()}
    assert got == {d: x[:2] for d, x in brute.op9(docs, 80).items()}


def variants_of(n, seed):
    """Copies of a few texts with words changed, so that similarities lie on both sides of the threshold; ids in no order."""
    r = random.Random(seed)
    bases = [prose(r.choice((6, 30, 90)), s).split() for s in range(5)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            k = r.randrange(len(w))
            w[k : k + r.choice((0, 1, 1))] = [r.choice("abcdefgh") * 3] * r.choice((0, 1, 1))
        out.append((r.randrange(10**6) * 400 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("limit", "most"), [(trie_join.LIMIT, trie_join.MAX_BROADCAST), (600, 0)])
def test_op12_odd_rows(spark, odd_rows, limit, most):
    """Also with clusters that are done in turns and texts that are picked by a shuffle."""
    rows = [r[:2] for r in odd_rows if r[0] != 11] + variants_of(150, 1)
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, rows[3], (None, rows[3][1])]], "doc_id long, text string, node string, n int").repartition(3)
    got = {}
    for r in trie_join.groups(df, limit=limit, max_broadcast=most).collect():
        assert got.setdefault(r["doc"], (r["n_shingles"], r["component_id"])) == (r["n_shingles"], r["component_id"])
    assert got.pop(None)[1] is None
    assert got == {d: x[:2] for d, x in brute.op9(rows, 80).items()}
    assert trie_join.groups(df.limit(0)).count() == 0


def test_op12_ids_with_several_texts_join_their_links(spark):
    rows = [(5, prose(40, 1)), (5, prose(40, 2)), (7, prose(40, 1)), (9, prose(40, 2) + " end"), (11, prose(40, 3))]
    got = {r["doc"]: r["component_id"] for r in trie_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 11: 11}


@pytest.mark.parametrize("seed", range(6))
def test_trie_walks_find_what_all_pairs_find(seed):
    r = random.Random(seed)
    items, groups = [], []
    for g in range(4):
        base = r.sample(range(10**6), r.choice((3, 40, 200)))
        for _ in range(r.choice((1, 12, 40))):
            s = set(base) - set(r.sample(base, r.randrange(0, max(1, len(base) // 6)))) | {r.randrange(10**6) for _ in range(r.randrange(0, max(1, len(base) // 8)))}
            items.append(np.array(sorted(s), dtype=U))
            groups.append(g)
    groups, pivots = np.array(groups), np.array([r.random() < 0.7 for _ in items])
    linked = trie_join._Classes(np.arange(len(items)))
    for x, y in trie_join.join_groups(items, np.array([len(x) for x in items]), np.arange(len(items)), pivots, groups):
        both = len(np.intersect1d(items[x], items[y]))
        assert groups[x] == groups[y] and 100 * both >= 80 * (len(items[x]) + len(items[y]) - both)
        linked.join(x, y)
    want = trie_join._Classes(np.arange(len(items)))
    for x in range(len(items)):
        for y in range(x):
            both = len(np.intersect1d(items[x], items[y]))
            if groups[x] == groups[y] and (pivots[x] or pivots[y]) and 100 * both >= 80 * (len(items[x]) + len(items[y]) - both):
                want.join(x, y)
    assert linked.of().tolist() == want.of().tolist()


def found13(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_op13(spark, docs):
    assert found13(queries.QUERIES["op13_spelling_variants"](spark, SF)) == brute.op13(docs)


@pytest.mark.parametrize("rows", [spelling.BLOCK_ROWS, 2])
def test_op13_odd_rows(spark, rows):
    """Repeated letters, code points above a byte of ASCII, long words, ties, nulls; blocks are subdivided to the end."""
    r = random.Random(4)
    words = ["aaaaa", "aaaaaa", "aaaab", "baaaa", "abaaa", "ährenfeld", "ahrenfeld", "ährenfelds", "École", "École", "ÿÿÿÿÿ", "ÿÿÿÿ÷ÿ", "x" * 3000, "x" * 3001, "x" * 2999 + "y", "abcde", "abcdef", "bcdef", "abxde", "abyde"]
    texts = [" ".join(w for w in words for _ in range(r.choice((0, 1, 1, 2, 4)))) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (50, None), (51, ""), (52, "1 2 3"), (52, texts[1]), (52, texts[1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    assert found13(spelling.variants(df, block_rows=rows)) == brute.op13(docs)
    assert spelling.variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_near_words_of_any_alphabet(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choice("ab" if seed % 2 else "abcé") for _ in range(r.choice((5, 6, 7, 8)))) for _ in range(300)}
    n = {w: r.randrange(3, 40) for w in words}
    want = {}
    for w in words:
        near = [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and any(w[:i] == x[:i] and (w[i + 1 :] == x[i + 1 :] or w[i:] == x[i + 1 :] or w[i + 1 :] == x[i:]) for i in range(max(len(w), len(x)))) and w != x]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    got = {x["word"]: (x["n_near"], x["best_n"], x["best"]) for x in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), block_rows=(20_000, 3)[seed % 2]).collect()}
    assert got == want
