"""The queries of the contracts against plain Python, on the small tables and on odd rows."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import decontaminate, line_dedup, near_dedup, quality, queries, substring_dedup, token_store
from corpusloom.llm.common import new_path, sha256_hex
from tests.llm import brute
from tests.llm.conftest import SF, prose

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def fetched(sql):
    return duckdb.sql(sql).fetchall()


@pytest.fixture(scope="module")
def docs():
    return fetched(f"select doc_id, text, source from '{SF}/documents.parquet'")


def answers(df, width):
    return {r[0]: tuple(r[1 : 1 + width]) for r in df.collect()}


def test_op1(spark, docs):
    assert answers(queries.QUERIES["op1_line_dedup"](spark, SF), 3) == brute.op1(docs)


def test_op2(spark, docs):
    assert answers(queries.QUERIES["op2_substring_dedup"](spark, SF), 4) == brute.op2([r[:2] for r in docs])


def test_op4(spark, docs):
    items = fetched(f"select item_id, text from '{SF}/benchmark.parquet'")
    assert answers(queries.QUERIES["op4_decontamination"](spark, SF), 5) == brute.op4([r[:2] for r in docs], items)


def test_op7(spark, docs):
    assert answers(queries.QUERIES["op7_quality_rules"](spark, SF), 6) == brute.op7([r[:2] for r in docs])


def test_op8(spark, docs):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = brute.op8([r[:2] for r in docs], lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    assert answers(queries.QUERIES["op8_token_store"](spark, SF), 3) == want


def test_op9(spark, docs):
    assert answers(queries.QUERIES["op9_near_dedup"](spark, SF), 3) == brute.op9([r[:2] for r in docs])


def test_odd_rows_op1(odd_docs, odd_rows):
    for low in (1, 2):
        got = line_dedup.dedup_lines(odd_docs, min_sites=low).select("doc_id", "n_lines", "n_removed", sha256_hex(F.coalesce("text", F.lit(""))))
        assert answers(got, 3) == brute.op1(odd_rows, low)


@pytest.mark.parametrize("hot", [2000, 0])
def test_odd_rows_op2(odd_docs, odd_rows, hot):
    got = substring_dedup.dedup_substrings(odd_docs, hot_blocks=hot)
    assert answers(got, 4) == brute.op2([r[:2] for r in odd_rows])
    kept = {r["doc"]: bytes(r["kept"]) for r in got.select("doc", "kept").collect()}
    assert kept[4] == odd_rows[3][1].encode() and kept[5] == b""


def test_odd_rows_op4(spark, odd_docs, odd_rows, monkeypatch):
    items = [(1, None), (2, ""), (3, "three FOUR"), (4, " ".join(odd_rows[3][1].split()[5:20])), (5, "three four"), (11, "not found in any of these texts at all, not once")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most, anchors in ((decontaminate.MAX_BROADCAST, decontaminate.MAX_ANCHORS), (0, 0)):
        monkeypatch.setattr(decontaminate, "MAX_ANCHORS", anchors)
        got = decontaminate.report(odd_docs, bench, max_broadcast=most).select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")), "contaminated")
        assert answers(got, 5) == brute.op4([r[:2] for r in odd_rows], items)
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(odd_docs, bench, remove="spans").collect()}
    assert left[15] == "one two" and left[1] is None and left[2] == "" and left[11] == odd_rows[10][1]
    assert len(left[4].split()) == 120 - 15
    assert {4, 5, 15, 16}.isdisjoint(r["doc_id"] for r in decontaminate.decontaminate(odd_docs, bench).collect())
    with pytest.raises(ValueError):
        decontaminate.decontaminate(odd_docs, bench, remove="all")


def test_odd_rows_op7(odd_docs, odd_rows):
    scored, _, n = quality.score(odd_docs)
    got = scored.select("doc_id", *[F.col(f"{n['features']}.{c}") for c in quality.FEATURES], "base_failed")
    assert answers(got, 6) == brute.op7([r[:2] for r in odd_rows])


def test_odd_rows_op8(spark, odd_docs, odd_rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    folder = new_path(spark, "store")
    data = token_store.write_store(odd_docs.repartition(3), folder, WORD_BPE)
    got = token_store.read_store(spark, folder)
    want = brute.op8([r[:2] for r in odd_rows], lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    assert answers(got, 3) == want
    place = {r["doc"]: (r["shard"], r["place"]) for r in got.collect()}
    shard, at = place[15]
    assert token_store.Shard(token_store.shard_path(folder, shard), data).document(at).tolist() == [*tokenizer.encode("one two three four", add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(token_store.shard_path(folder, shard), b"other")


@pytest.mark.parametrize("most", [near_dedup.MAX_BROADCAST, 0])
def test_odd_rows_op9(odd_docs, odd_rows, most):
    assert answers(near_dedup.groups(odd_docs, max_broadcast=most), 3) == brute.op9([r[:2] for r in odd_rows])


def test_chains_and_crowds_of_near_copies(spark):
    """A chain whose ends aren't alike, and a crowd of copies with one or two changed words each."""
    words, rows = prose(200, 11).split(), []
    for i in range(25):
        words[i * 7 % 200] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    base = prose(60, 12).split()
    for i in range(60):
        w = list(base)
        w[i % 60], w[(i * 13 + 5) % 60] = f"u{i}", f"v{i}"
        rows.append((500 + i, " ".join(w)))
    for i in range(40):
        w = list(base)
        for k in range(0, 60, 9):
            w[(k + i) % 60] = f"far{i}x{k}"
        rows.append((900 + i, " ".join(w)))
    for i in range(30):  # a second crowd, near to the first one but not linked with it, and bridges
        w = list(base)
        w[:4] = ["other", "words", "stand", "here"]
        w[10 + i % 40], w[(i * 7 + 9) % 50 + 8] = f"p{i}", f"q{i % 3}"
        rows.append((1200 + i, " ".join(w[: 60 - i % 9])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for each in (near_dedup.EACH, 3):
        assert answers(near_dedup.groups(frame, each=each), 3) == brute.op9(rows)


def test_texts_longer_than_a_piece_op2(spark):
    import random

    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh") for _ in range(300))
    long = "".join(r.choice("0123456789ABCDEF") for _ in range(substring_dedup.CHUNK_BYTES + 200_000))
    at = substring_dedup.CHUNK_BYTES - 120
    docs = spark.createDataFrame([(1, "first " + passage), (2, long[:at] + passage + long[at:]), (3, long), (4, long[at - 60 : at + 60])], "doc_id long, text string")
    got = answers(substring_dedup.dedup_substrings(docs, with_text=False), 4)
    assert got[1][1] == 0 and got[2][1:3] == (300, 1) and got[2][3] == brute.sha(long)
    assert got[3][1:3] == (len(long), 1) and got[3][3] == brute.sha("")  # each byte is in 50 bytes that document 2 has too
    assert got[4][0] == 120


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    from corpusloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i % 3 if i % 2 else 7, i) for i in range(60)]
    big, small = spark.createDataFrame(rows, "k int, v int"), spark.createDataFrame([(7, "hot", 30), (1, "few", 10), (9, "none", 0)], "k int, name string, n long")
    for how in ("inner", "left"):
        got = common.spread_join(big, small, ["k"], "n", how).select("k", "v", "name").collect()
        want = big.join(small, "k", how).select("k", "v", "name").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_words_are_hashed_alike_in_any_blocks():
    from corpusloom.llm.hashing import word_hashes

    texts = [b"ab  Cd\n" * 3, b"", b" ", b"abcdefghijkl" * 5, b"x ab", b"cd\tab"]
    whole, first = word_hashes(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    for block in (1, 2, 3, 7, 64):
        got, at = word_hashes(texts, block)
        assert (got == whole).all() and (at == first).all()


def test_empty_tables(spark, odd_docs):
    none, bench = odd_docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.dedup_lines(none).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert decontaminate.report(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(odd_docs, bench).collect())
    assert quality.filter_quality(none).count() == 0
    folder = new_path(spark, "store")
    token_store.write_store(none, folder, WORD_BPE)
    assert token_store.read_store(spark, folder).count() == 0
    assert near_dedup.groups(none).count() == 0


def test_clashing_columns_and_repeated_rows(spark, odd_docs):
    names = ("k1", "k2", "gone", "kept", "spots", "features", "quality", "base_failed", "h", "at", "words")
    wide = odd_docs.unionByName(odd_docs.filter("doc_id in (4, 9)")).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    bench = spark.createDataFrame([(1, "three four")], "item_id long, text string")
    assert line_dedup.dedup_lines(wide, added=("x", "y"), min_sites=2).drop("x", "y").columns == wide.columns
    assert decontaminate.decontaminate(wide, bench).columns == wide.columns
    assert decontaminate.decontaminate(wide, bench, remove="spans").count() == wide.count()
    assert quality.filter_quality(wide).columns == wide.columns
    kept = near_dedup.dedup(wide)
    assert kept.columns == wide.columns and sorted(r["doc_id"] for r in kept.filter("doc_id in (4, 5, 9)").collect()) == [4, 4, 9, 9]


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, prose(30, 1)), (1, prose(30, 1)), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc"]), str(r["component_id"]), r["kept"]) for r in near_dedup.groups(rows).collect()) == [("1", "1", True), ("None", "None", True), ("None", "None", True)]
    got = {(r["doc"], r["n_bytes"]): r["n_removed"] for r in substring_dedup.dedup_substrings(rows).collect()}
    n = len(prose(30, 1))
    assert got == {(None, n): n, (1, n): 0, (None, 0): 0}


def test_op10_ids_are_the_library_s_over_the_whole_table(spark, docs):
    import sentencepiece

    from corpusloom.llm import pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    coded = pieces.encode(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), model, decoded="decoded")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in coded.collect()}
    for d, text, _ in docs:
        ids = None if text is None else library.encode(text)
        assert got[d] == (ids, None if text is None else library.decode(ids))
