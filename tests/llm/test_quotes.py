from sedge.llm import quotes

SF = "/root/testdata/sf0.001"
A, B, C = "The first message says this.", "Second one answers\nwith two lines here.", "A third remark entirely."
THREAD = [
    (1, 0, "user", A, 9), (1, 1, "assistant", B, 9), (1, 2, "user", C, 9),
    (1, 3, "user", f"> {A}\nI reply to the first.", 9),
    (1, 4, "assistant", f">> {A}\n> I REPLY  to the first!\n\nNested answer text.", 9),
    (1, 5, "user", "> with two lines here.\nOn the second line.", 9),
    (1, 6, "user", "> never said by anyone\nDangling quote.", 9),
    (2, 0, "user", f"> {A}\nOther conversation.", 9), (None, None, "user", None, 9), (None, None, "user", None, 9),
]


def frame(spark, rows=THREAD):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")


def test_links_order_and_bare_text(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(frame(spark)).collect() if r.conv_id}
    reply = {t: (r.parent.turn if r.parent else None) for (c, t), r in got.items() if c == 1}
    assert reply == {0: None, 1: None, 2: None, 3: 0, 4: 3, 5: 1, 6: None}
    assert [t for _, t in sorted((r.reply_order, t) for (c, t), r in got.items() if c == 1)] == [0, 3, 4, 1, 5, 2, 6]
    assert got[1, 4].depth == 3 and got[1, 4].text == "Nested answer text." and got[1, 4].quotes == 2
    assert got[1, 6].text == "Dangling quote." and got[2, 0].parent is None
    assert got[1, 1].text == B


def test_nulls_repeats_and_empty(spark):
    rows = [r for r in quotes.reply_ordered(frame(spark)).collect() if r.conv_id is None]
    assert sorted(r.reply_order for r in rows) == [1, 2] and all(r.text == "" for r in rows)
    assert quotes.reply_ordered(frame(spark, [])).count() == 0


def test_nested_rows(spark):
    got = {r.conv_id: r.messages for r in quotes.conversations(frame(spark)).collect()}
    assert [m.turn for m in got[1]] == [0, 3, 4, 1, 5, 2, 6]


def test_long_chain_of_replies(spark):
    said = [f"message number {chr(97 + i)} here" for i in range(20)]
    rows = [(1, i, "user", (f"> {said[i - 1]}\n" if i else "") + said[i], 0) for i in range(20)]
    got = sorted((r.reply_order, r.turn, r.depth) for r in quotes.reply_ordered(frame(spark, rows)).collect())
    assert got == [(i + 1, i, i + 1) for i in range(20)]


def test_query_covers_the_table(spark):
    rows = quotes.op1(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").count()
