"""Parts of the operators on small cases of their own."""

import itertools
import random
import re
import tempfile
import time

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat, html_text, licences, line_dedup, near_dedup, pieces, quality, queries, substring_dedup, token_store
from tests.llm import brute
from tests.llm.conftest import LOREM, SF, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "the", "ing", "▁", "漢", "字", "\n", "\t", "é", "ß", "1", ".", "!!", "http", "\x00", "ation", "<|endoftext|>", "'s", "É", "İ", "ΑΣ", "²"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)


# -- line dedup


def test_band_covers_the_threshold():
    low, high = line_dedup.band(10)
    assert low <= 9 and high >= 11
    assert line_dedup.band(10_000)[0] < 10_000 * 0.95


def test_estimates_away_from_the_threshold_need_no_exact_count(spark):
    rows = [(i, "far\nnear\nrare", f"s{i}") for i in range(30)] + [(100 + i, "edge", f"s{i}") for i in range(10)] + [(200 + i, "under", f"s{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["n_removed"] for r in line_dedup.dedup_lines(docs).filter("doc_id between 101 and 109").collect()}
    assert found == {1}
    assert {r["n_removed"] for r in line_dedup.dedup_lines(docs).filter("doc_id >= 200").collect()} == {0}
    assert line_dedup.dedup_lines(docs, keep_first=False).filter("doc_id = 0").first()["n_removed"] == 3
    assert line_dedup.dedup_lines(docs, drop_emptied=True).count() == 1 + 1 + 9


# -- transforms


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_smallest_owner_against_a_dictionary(seed):
    r = np.random.default_rng(seed)
    n, base = int(r.integers(8, 14)), r.integers(97, 99 + 3 * (seed % 2), 150).astype(np.uint8)
    segments = []
    for _ in range(int(r.integers(1, 14))):
        a = int(r.integers(0, 100))
        x = base[a : a + int(r.integers(n, 45))].copy()
        if r.random() < 0.5:
            x[r.integers(0, len(x))] = 120
        segments.append(x)
    docs = r.permutation(len(segments)).astype(np.int64)
    got = substring_dedup.smallest_owner(np.concatenate(segments), np.array([len(x) for x in segments]), docs, n)
    first = {}
    for x, d in zip(segments, docs, strict=True):
        for i in range(len(x) - n + 1):
            first[x[i : i + n].tobytes()] = min(first.get(x[i : i + n].tobytes(), 10**9), d)
    want = [first[x[i : i + n].tobytes()] if i + n <= len(x) else substring_dedup.MISSING for x in segments for i in range(len(x))]
    assert got.tolist() == want


def _steps_of_op2(folder, rows, buckets=4, tasks=3):
    """The steps of op2 without Spark, a block for each of the rows given: what is sent, and the report."""

    def batch(names, *columns):
        return pa.record_batch([pa.array(c) for c in columns], names=names)

    blocks = []
    for part in rows:
        docs = batch(["doc", "text"], [d for d, _ in part], [t for _, t in part])
        blocks += [b.column(0)[0].as_py() for b in substring_dedup._write_blocks(folder)([docs])]
    keys = list(substring_dedup._keys(folder, buckets)([batch(["block"], blocks)]))
    repeated = [r for b in substring_dedup._repeated(2000)(keys) for r in b.to_pylist()]
    of = [[{k: r[k] for k in ("bucket", "n", "data")} for r in repeated if r["block"] == x] for x in blocks]
    sent = list(substring_dedup._send(folder, buckets, tasks)([batch(["block", "rows"], [x for x, r in zip(blocks, of, strict=True) if r], [r for r in of if r])]))
    by_task = pa.Table.from_batches(sent).to_pylist()
    answers = []
    for task in {r["task"] for r in by_task}:
        mine = pa.Table.from_pylist([r for r in by_task if r["task"] == task], schema=sent[0].schema)
        answers += [r for b in substring_dedup._answer(mine.combine_chunks().to_batches()) for r in b.to_pylist()]
    got = [[r["data"] for r in answers if r["block"] == x] for x in blocks]
    report = substring_dedup._report(folder, buckets, False)([batch(["block", "rows", "answers"], blocks, of, got)])
    return by_task, {r["doc"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for b in report for r in b.to_pylist()}


def test_op2_sends_a_row_for_each_block_and_task_and_compares_what_differs_only(tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    passage = "".join(r.choice(list("abcdefgh"), 4000))
    compared = []
    owner = substring_dedup.smallest_owner
    monkeypatch.setattr(substring_dedup, "smallest_owner", lambda data, *rest: compared.append(len(data)) or owner(data, *rest))
    rows = [(1, passage), (5, passage)], [(9, passage), (4, "")], [(7, passage)]
    sent, got = _steps_of_op2(str(tmp_path / "copies"), rows)
    assert got == brute.op2([x for part in rows for x in part])
    assert not compared  # each key has one segment, whoever has it
    assert len(sent) == len({(x["task"], x["block"]) for x in sent}) <= 3 * 3
    changed = passage[:2000] + "X" + passage[2001:]
    rows = *rows, [(3, changed), (8, "before " + passage[1000:2500])]
    _, got = _steps_of_op2(str(tmp_path / "changed"), rows)
    assert got == brute.op2([x for part in rows for x in part])
    assert 0 < sum(compared) < 2 * len(passage)  # the surroundings of where texts differ


@given(st.integers(0, 10_000))
@settings(max_examples=15, deadline=None)
def test_op2_of_texts_that_share_pieces(seed):
    r = np.random.default_rng(seed)
    alphabet = list("ab" if seed % 3 == 0 else "abcdéß \n")
    base = ["".join(r.choice(alphabet, int(r.integers(40, 400)))) for _ in range(4)]
    rows = []
    for d in r.permutation(12).tolist():
        t = "".join(base[r.integers(4)][int(a) : int(a) + int(r.integers(30, 300))] for a in r.integers(0, 60, int(r.integers(0, 5))))
        rows.append((d, t))
    with tempfile.TemporaryDirectory() as folder:
        _, got = _steps_of_op2(f"{folder}/blocks", [rows[:5], rows[5:6], rows[6:]])
    assert got == brute.op2(rows)


# -- signatures


def test_signatures_estimate_and_vary_less_than_independent_hashes():
    r, error = np.random.default_rng(5), []
    for _ in range(150):
        base = r.integers(0, 2**63, 68).astype(np.uint64)
        s = near_dedup.signatures([np.sort(base[:60]), np.sort(base[8:68])])
        assert (s != np.iinfo(np.uint64).max).all()
        error.append(float((s[0] == s[1]).mean()) - 52 / 68)
    p = 52 / 68
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.85 * (p * (1 - p) / near_dedup.PLACES) ** 0.5


def test_sets_without_items_have_no_signature():
    assert (near_dedup.signatures([np.zeros(0, np.uint64)]) == np.iinfo(np.uint64).max).all()


# -- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain text", "plain text"),
        ("<nav>Menu</nav><article><h1>A</h1><p>b  c&amp;d&nbsp;e<br>f</p><p>Te.</p></article><footer>x</footer>", "A\n\nb c&d e f\n\nTe."),
        ("<article><p>one<p>two<div class='ad'>buy</div><aside>x</aside><form>q</form><p>three</article><p>out", "one\n\ntwo\n\nthree"),
        ("<article><p>a</p><section id='comments'><p>me too</p></section><div class=cookie-notice>ok</div></article>", "a"),
        ("<script>var t='</p>';</script><article><p>x</p><!-- <p>no</p> --><style>p{}</style></article>", "x"),
        ("<div class=menu><a href=x>Home</a></div><p>" + "long text " * 20 + "</p><p>short end.</p><div class=footer>&copy; us</div>", ("long text " * 20).strip() + "\n\nshort end."),
        ("<article><p title='a > b'>x < y</p></article>", "x < y"), ("<article><p>cut off <b", "cut off"), ("<article><ul><li>a<li>b</ul></article>", "a\n\nb"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<span>" * 16_000 + "</div>" * 16_000, "<b><div>" + "<span>" * 16_000 + "</b>" * 16_000, "<a " * 16_000 + "'", "<div class=ad>" * 16_000 + "x", "<td>" * 16_000,
        "<p>" * 8000 + '<a "' * 8000, "<script>" * 16_000, "<!--" * 16_000,
    ],
)
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 1.5  # 0.2 s at most, with slack for a busy machine


def test_op3_keeps_every_page_and_counts_code_points(spark):
    got = queries.QUERIES["op3_html_extraction"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 50
    assert got.filter("char_length(text) <> n_chars or n_chars = 0").count() == 0
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract(rows).collect()] == [(1, "u", None, "x", "", 0)] * 2
    assert html_text.extract(rows.limit(0)).count() == 0


# -- licences


def test_whole_licences_and_statements(spark):
    permission = open("/usr/share/common-licenses/Apache-2.0").read()
    rows = [
        (1, permission), (2, permission.upper().replace("license", "LICENCE").replace(",", " ,")), (3, "Copyright (c) 2020 Someone\n" + permission), (4, permission + " and more"),
        (5, prose(20) + "\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT Licence."), (6, None), (7, ""), (7, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["statements"]) for r in licences.scan(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 6, 7)] == ["Apache-2.0"] * 3 + [None] * 3
    assert got[5] == (None, ["Apache-2.0", "MIT"]) and got[6][1] == []
    assert licences.scan(docs).count() == 8 and licences.scan(docs.limit(0)).count() == 0


MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def test_notices_in_one_line_and_whole_words_only(spark):
    rows = [
        (1, "Copyright (c) 2020 X. " + MIT), (2, "MIT License Copyright (c) 2020 X " + MIT), (3, "MIT License\n\n© 2020 X, all rights reserved. " + MIT), (4, MIT.replace("sublicense", "sub licence").replace("limitation", "limitations")),
        (5, "Copyright 2021 X. Licensed under the MIT Licence."), (6, "a programmer's licences " * 3000 + "\nReleased under the MIT License"), (None, MIT),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("x"), "k1": F.lit(1)})
    got = {r["doc_id"]: (r["licence"], r["statements"]) for r in licences.scan(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["MIT (untitled)", "MIT", "MIT", None, None, None, "MIT (untitled)"]
    assert got[5][1] == ["MIT"] and got[6][1] == ["MIT"]
    form = spark.createDataFrame([("licence licences LICENCE, programmers programmes sub license",)], "t string").select(licences._joined(licences.canonical(F.col("t")))).first()[0]
    assert form == "license licenses license programmers programs sublicense"


# -- conversations

TALK = [
    (1, 0, "user", "Hello there, how are you?\nSecond line."),
    (1, 1, "assistant", "> Hello there, how are you?\nI am fine.\n> second line\nYes"),
    (1, 2, "user", "> > Hello there, how are you?\n> I am fine.\nGood!"),
    (1, 3, "user", "unrelated"),
    (1, 4, "a", ">Good!\n\n> unrelated\nok"),
    (1, 4, "a", ">Good!\n\n> unrelated\nok"),
    (2, 0, "u", None),
    (None, 0, "u", "x"),
    (None, 1, "u", ">x\ny"),
    (3, 0, "u", "> Good!"),
]


def test_replies_threads_and_texts(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"], r["text"]) for r in chat.link_messages(df).collect()}
    assert got == {
        (1, 0): (None, 0, 0, "Hello there, how are you?\nSecond line."), (1, 1): (0, 0, 1, "I am fine.\nYes"), (1, 2): (1, 0, 2, "Good!"), (1, 3): (None, 3, 0, "unrelated"),
        (1, 4): (3, 3, 1, "ok"), (2, 0): (None, 0, 0, ""), (None, 0): (None, 0, 0, "x"), (None, 1): (0, 0, 1, "y"), (3, 0): (None, 0, 0, ""),
    }
    threads = {(r["conv_id"], r["thread"]): len(r["messages"]) for r in chat.conversations(chat.link_messages(df)).collect()}
    assert threads[1, 0] == 3 and threads[1, 3] == 2
    assert chat.link_messages(df.limit(0)).count() == 0


def test_long_reply_chains(spark):
    n = 70
    rows = [(1, i, "u", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(n)]
    got = chat.link_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r["turn"], r["depth"], r["thread"]) for r in got.collect()) == [(i, i, 0) for i in range(n)]


def test_op6_keeps_every_message(spark):
    raw = spark.read.parquet(f"{SF}/conversations.parquet")
    assert queries.QUERIES["op6_chat_formatting"](spark, SF).count() == raw.distinct().count()


def replies_by_rule(talk):
    """What op6 says of messages with distinct turns: reply_to, thread, depth, n_quoted, n_linked, own text."""
    normal = lambda x: re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", re.sub(r"\s+", " ", x.lower()))
    parsed, first, out = {}, {}, {}
    for conv, turn, text in sorted(talk):
        rows = []
        for line in text.split("\n"):
            marks = re.match(r"(?:\s*>)*", line)[0]
            body = line[len(marks) :]
            rows.append((marks.count(">"), body.removeprefix(" ") if marks else line))
        solid = [r for r in rows if r[1].strip()]
        runs = [(k, "\n".join(b for _, b in g)) for k, g in itertools.groupby(solid, lambda r: r[0])]
        own = re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "", "\n".join(b for k, b in rows if k == 0))
        passages = {(k, normal(b)) for k, b in [*rows, *runs, (0, own)]} - {(k, "") for k in range(9)}
        parsed[conv, turn] = (passages, sum(k > 0 and b.strip() != "" for k, b in rows), own)
        for k, p in passages:
            if k == 0:
                first[conv, p] = min(first.get((conv, p), turn), turn)
    for (conv, turn), (passages, n_quoted, own) in sorted(parsed.items()):
        votes, n = {}, 0
        for k, p in passages:
            at = first.get((conv, p))
            if k and at is not None and at < turn:
                votes[k, at], n = votes.get((k, at), 0) + len(p), n + 1
        at = max(((-k, w, at) for (k, at), w in votes.items()), default=(0, 0, None))[2]
        up = out.get((conv, at))
        out[conv, turn] = (at, up[1] if up else turn, up[2] + 1 if up else 0, n_quoted, n, own)
    return out


def test_generated_quotations_against_plain_rules(spark):
    r, talk = random.Random(4), []
    for conv in range(40):
        said: list[str] = []
        for turn in range(r.choice([1, 3, 12, 60])):
            lines = []
            for _ in range(r.randrange(3)):
                if said:
                    quoted = r.choice(said[-6:]).split("\n")
                    a = r.randrange(len(quoted))
                    lines += [r.choice(["> ", ">", "  > "]) + x for x in quoted[a : a + r.randrange(1, 4)]]
                lines += [" ".join(r.choice(LOREM) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(3))] + [""] * r.randrange(2)
            lines.append(f"line {conv} {turn}" if r.random() < 0.7 else "Thanks!")
            said.append("\n".join(lines))
            talk.append((conv, turn, said[-1]))
    want = replies_by_rule(talk)
    got = chat.link_messages(spark.createDataFrame([(c, t, "user", x) for c, t, x in talk], "conv_id long, turn int, role string, text string")).collect()
    assert {(x["conv_id"], x["turn"]): (x["reply_to"], x["thread"], x["depth"], x["n_quoted"], x["n_linked"], x["text"]) for x in got} == want
    assert sum(v[0] is not None for v in want.values()) > 100 and max(v[2] for v in want.values()) > 5


def test_repeated_and_missing_turns(spark):
    rows = [(1, 1, "a", "one"), (1, 1, "b", "two"), (1, 1, "a", "one"), (1, 2, "a", "> two"), (1, None, "a", "> one"), (None, 1, "a", "x"), (None, 2, "b", "> x"), (2, 3, None, None), (2, 4, "a", "long line\n" * 5000)]
    got = sorted(((r["conv_id"], r["turn"], r["reply_to"], r["n_linked"]) for r in chat.link_messages(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()), key=str)
    assert got == sorted([(1, 1, None, 0), (1, 1, None, 0), (1, 2, 1, 1), (1, None, None, 0), (None, 1, None, 0), (None, 2, 1, 1), (2, 3, None, 0), (2, 4, None, 0)], key=str)


# -- quality


def test_fit_finds_the_better_rules():
    r, rows = random.Random(3), {}
    truth = [r.random() < 0.7 for _ in range(6000)]
    for good in truth:
        v = tuple((1 if good == (r.random() < a) else -1) if r.random() < 0.8 else 0 for a in (0.95, 0.9, 0.6, 0.85))
        rows[v] = rows.get(v, 0) + 1
    m = quality.fit(list(rows.items()), 4)
    assert abs(m.share - 0.7) < 0.05 and m.on_good[0] > m.on_good[2] + 0.2 and abs(m.on_good[0] - 0.95) < 0.05


def test_no_documents_and_useless_rules():
    assert quality.fit([], 3).posterior([0, 0, 0]) == pytest.approx(quality.SHARE)
    m = quality.fit([((1, 1), 50), ((-1, 1), 50)], 2)
    assert all(g + b >= 1 for g, b in zip(m.on_good, m.on_bad, strict=True))


def test_posterior_agrees_with_its_column(spark):
    m = quality.LabelModel((0.9, 0.6), (0.8, 0.7), 0.6)
    rows = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("q", m.column([F.col("a"), F.col("b")]))
    assert all(abs(r["q"] - m.posterior([r["a"], r["b"]])) < 1e-12 for r in df.collect())


def test_labelled_quality(spark):
    """Of the labelled documents that pass the base rules nearly all good ones are kept, and hardly any of the bad ones."""
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_quality_rules"](spark, sf).filter("not base_failed").select("doc_id", "kept")
    t: pd.DataFrame = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).toPandas().set_index("quality")
    assert t.n[0] >= 20 and t.kept[1] > 0.99 and t.kept[0] < 0.1


# -- tokens


@pytest.fixture(scope="module")
def memory():
    return token_store.WordMemory(public_tokenizers.path("word_bpe_49k.json"), remember=500)


@given(st.lists(texts, max_size=6))
@settings(max_examples=150, deadline=None)
def test_remembered_words_give_the_library_ids(memory, xs):
    want = [memory.tokenizer.encode(x, add_special_tokens=False).ids for x in xs]
    assert [np.frombuffer(b, "<u4").tolist() for b in memory.encode(xs)] == want


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(PIECES, remember=500)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_bpe_ids_are_the_library_ids(encoder, x):
    got = encoder.encode(x)
    assert np.frombuffer(got, "<u4").tolist() == encoder.model.library.encode(x)
    assert encoder.decode(got) == x.replace("▁", " ")


def test_long_words_need_only_a_window(encoder):
    x = prose(9000, 8).replace(" ", "")
    search = pieces.StreamingViterbi(encoder.model)
    ids = []
    for i in range(0, len(x), 777):
        ids += search.feed(("▁" + x)[i : i + 777] if i else ("▁" + x)[:777])
    ids += search.feed(("▁" + x)[len(range(0, len(x), 777)) * 777 :]) + search.finish()
    assert ids == encoder.model.library.encode(x) and search.widest <= 4 * encoder.model.longest


def test_unigram_search_finds_the_best_sum():
    class Model:
        kind, longest, lowest, bytes, unknown = pieces.UNIGRAM, 3, -9.0, {}, 0

        def __init__(self, seed):
            r = random.Random(seed)
            self.scores = {p: -r.random() * 5 for n in (1, 2, 3) for p in {"".join(r.choice("abc") for _ in range(n)) for _ in range(9)}}
            self.ids = {p: i + 1 for i, p in enumerate(self.scores)}

        id_list = pieces.PieceModel.id_list

    for seed in range(30):
        m, text = Model(seed), "".join(random.Random(seed).choice("abc") for _ in range(60))
        best = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 3), e):
                p = text[s:e]
                v = m.scores.get(p, -19.0 if len(p) == 1 else None)
                if v is not None:
                    best[e] = max(best[e], best[s] + v)
        search = pieces.StreamingViterbi(m)
        ids = search.feed(text) + search.finish()
        names = {i: p for p, i in m.ids.items()}
        assert sum(m.scores[names[i]] if i else -19.0 for i in ids) == pytest.approx(best[-1])


def test_op10_round_trip_and_odd_rows(spark, odd_docs):
    got = pieces.decode(pieces.encode(odd_docs.withColumn("ids", F.lit(1)), PIECES), PIECES, ids="_ids")
    rows = {r["doc_id"]: r for r in got.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in rows.values():
        assert r["decoded"] == r["text"] and (r["_ids"] is None if r["text"] is None else list(r["_ids"]) == lib.encode(r["text"]))
    assert queries.QUERIES["op10_sentencepiece"](spark, SF).filter("not round_trip").count() == 0
    assert pieces.encode(odd_docs.limit(0), PIECES).count() == 0
