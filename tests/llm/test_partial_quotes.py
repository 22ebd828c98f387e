from test_quotes import frame

from sedge.llm import quotes

LONG = "First line of the message.\nSecond line follows it.\nThird line ends it.\n\nAnother paragraph which\nwas wrapped by hand."
THREAD = [
    (1, 0, "user", LONG, 0), (1, 1, "assistant", "Second line follows it.\nSomething else entirely.", 0),
    (1, 2, "user", "> Second line follows it.\n> Third line ends it.\nTwo of three lines.", 0),
    (1, 3, "user", "> Another paragraph which was\n> wrapped by hand.\nOne paragraph, wrapped anew.", 0),
    (1, 4, "user", "> First line of the message.\n> Third line ends it.\nTwo single lines.", 0),
    (1, 5, "user", "> Third line ends it.\n> Something else entirely.\nLines of two messages.", 0),
    (1, 6, "user", "> Something else entirely.\n> Second line follows it.\nNot in this order.", 0),
    (1, 7, "user", "> First line of the message. Second line\n> follows it. Third line ends it.\n>\n> Another paragraph which was\n> wrapped by hand.\nAll of it, wrapped anew.", 0),
    (2, 0, "user", "> Second line follows it.\n> Third line ends it.\nOther conversation.", 0),
]


def test_quotes_of_parts_of_a_message(spark):
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(frame(spark, THREAD)).collect()}
    reply = {t: (r.parent.turn if r.parent else None) for (c, t), r in got.items() if c == 1}
    assert reply == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0}
    assert got[1, 2].depth == 2 and got[1, 2].quotes == 1 and got[1, 2].text == "Two of three lines."
    assert got[2, 0].parent is None
    assert [t for _, t in sorted((r.reply_order, t) for (c, t), r in got.items() if c == 1)] == [0, 2, 3, 4, 7, 1, 5, 6]
