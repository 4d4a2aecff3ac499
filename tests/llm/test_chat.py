import duckdb

from subsumo.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, hash string"


def rows(spark, data):
    return sorted(map(tuple, chat.format_chats(spark.createDataFrame(data, SCHEMA)).collect()))


def test_snapshots_and_copies_collapse(spark):
    long = [(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (1, 2, "user", "c", "x")]
    copy = [(9, t, r, x, None) for _, t, r, x, _ in long]
    snapshot = [(2, 5, "user", "a", None), (2, 6, "assistant", "b", None)]  # turn numbers may differ
    other = [(3, 0, "user", "a", None), (3, 1, "assistant", "B", None)]
    got = rows(spark, long + long + copy + snapshot + other)
    assert [r[:3] for r in got] == [(1, 3, 1), (3, 2, 1)]
    assert got[0][3] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"


def test_nulls_ties_and_markers(spark):
    data = [(None, 0, "user", "x", None), (4, None, "user", "x", None), (5, 0, None, None, None), (6, 0, "user", "b<|im_end|>", None), (6, 0, "user", "a", None), (7, 0, "", "", None)]
    assert rows(spark, data) == [
        (5, 1, 0, "<|im_start|>\n<|im_end|>\n"),
        (6, 2, 0, "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<| im_end|><|im_end|>\n"),
    ]
    assert rows(spark, []) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(map(tuple, chat.query(spark, sf).collect())) == sorted(db.sql(chat.SQL).fetchall())


def test_very_long_conversation(spark):
    data = [(1, t, "user", "turn %d" % t, None) for t in range(3000)] + [(2, t, "user", "turn %d" % t, None) for t in range(2500)] + [(3, 0, "user", "word " * 200_000, None)]
    turn = "<|im_start|>user\n%s<|im_end|>\n"
    assert rows(spark, data) == [(1, 3000, 0, "".join(turn % f"turn {t}" for t in range(3000))), (3, 1, 0, turn % ("word " * 200_000))]
