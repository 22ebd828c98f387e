from test_quotes import frame

from sedge.llm import quotes


def test_short_passages_link(spark):
    rows = [(1, 0, "user", "Why?", 0), (1, 1, "assistant", "我不知道。", 0), (1, 2, "user", "> Why?\nBecause.", 0), (1, 3, "user", "> 我不知道。\n好", 0), (1, 4, "user", "> 好\n1", 0), (1, 5, "user", "> ...\nNothing said.", 0)]
    got = {r.turn: r for r in quotes.reply_ordered(frame(spark, rows)).collect()}
    assert {t: (r.parent.turn if r.parent else None) for t, r in got.items()} == {0: None, 1: None, 2: 0, 3: 1, 4: 3, 5: None}
    assert [got[t].quotes for t in range(6)] == [0, 0, 1, 1, 1, 0]
