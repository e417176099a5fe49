"""Threads of op6: messages apart, parts of bounded length, places in order."""

from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def parts(spark, rows, block=1000):
    linked = chat.link_messages(spark.createDataFrame(rows, SCHEMA).repartition(7))
    return linked, chat.in_order(linked, block=block).collect()


def test_unlinked_messages_of_one_turn_or_none_stay_apart(spark):
    rows = [(1, 3, "user", f"message number {i} says {i * i}") for i in range(2500)] + [(2, None, "user", f"other number {i}") for i in range(2500)]
    _, built = parts(spark, rows)
    assert len(built) == 5000 and all(len(r["messages"]) == 1 for r in built)
    assert len({r["root"] for r in built}) == 5000


def test_a_long_thread_goes_on_in_parts_by_rank(spark):
    rows = [(1, 0, "user", "first words of all")] + [(1, 1 + i // 40, "user", f"> first words of all\nanswer {i}") for i in range(2400)] + [(2, 0, "user", "alone")]
    linked, built = parts(spark, rows)
    assert all(len(r["messages"]) <= 1000 for r in built)
    root = next(r["root"] for r in linked.collect() if r["conv_id"] == 1 and r["turn"] == 0)
    thread = sorted((r["part"], r["messages"]) for r in built if r["root"] == root)
    assert [(p, len(m)) for p, m in thread] == [(0, 1000), (1, 1000), (2, 401)]
    told = [(p, m["place"]) for p, ms in thread for m in ms]
    assert told == [(i // 1000, i % 1000) for i in range(2401)]
    turns = [m["turn"] for _, ms in thread for m in ms]
    assert turns == sorted(turns)
    assert sum(len(r["messages"]) for r in built) == linked.count() == 2402


def brute_roots(rows):
    """Root message of each message whose quotes are whole messages: the first that says the quoted line, if it is earlier."""
    own = lambda t: "\n".join(x for x in t.split("\n") if not x.startswith(">"))
    first = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0], x[1])):
        first.setdefault((c, own(t)), (c, n, r, t))
    up = {}
    for row in rows:
        quoted = [x[2:] for x in row[3].split("\n") if x.startswith("> ")]
        to = first.get((row[0], quoted[0])) if quoted else None
        up[row] = to if to and to[1] < row[1] else None
    out = {}
    for row in rows:
        top = row
        while up[top]:
            top = up[top]
        out[row] = top
    return out


def test_roots_against_plain_python(spark):
    """Turns out of order and repeated; several threads of a conversation; quotes of later messages link nothing."""
    rows = []
    for c in range(6):
        for i in range(30):
            n = (i * 7) % 11
            to = (i * 5) % 30
            quote = f"> text {to} of {c}\n" if i % 3 else ""
            rows.append((c, n, "user", f"{quote}text {i} of {c}"))
    rows = list(dict.fromkeys(rows))
    linked, built = parts(spark, rows, block=4)
    own = lambda t: "\n".join(x for x in t.split("\n") if not x.startswith(">"))
    want = defaultdict(set)
    for row, top in brute_roots(rows).items():
        want[(top[0], own(top[3]))].add(own(row[3]))
    by_root = defaultdict(list)
    for r in built:
        by_root[r["root"]] += [(m["turn"], r["part"], m["place"], m["text"]) for m in r["messages"]]
        assert len(r["messages"]) <= 4
    roots = {r["message"]: (r["conv_id"], r["text"]) for r in linked.filter(F.col("message") == F.col("root")).collect()}
    assert {roots[k]: {x[3] for x in v} for k, v in by_root.items()} == want
    for v in by_root.values():
        at = sorted(v, key=lambda x: (x[1], x[2]))
        assert [(x[1], x[2]) for x in at] == [(i // 4, i % 4) for i in range(len(v))] and [x[0] for x in at] == sorted(x[0] for x in v)


def test_columns_that_clash_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b c", "x"), (1, 1, "bot", "> a b c\nyes", "y")], SCHEMA + ", root string")
    assert chat.in_order(chat.link_messages(df)).count() == 1
    assert chat.in_order(chat.link_messages(df.limit(0))).count() == 0
