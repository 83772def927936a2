"""Terms beside their stems, and long quotations."""

from tidemark.llm import toxicity as tox


def test_terms_keep_their_edits_beside_a_stem(spark):
    bad = [(i, f"you {w} go", 1) for i, w in enumerate(["loser"] * 12 + ["losers", "losel", "loserly", "losed", "losest"] * 2)]
    good = [(100 + i, "you may go", 0) for i in range(60)]
    lexicon = tox.learn_lexicon(spark.createDataFrame(bad + good, "doc_id long, text string, toxic int"))
    assert "loser" in lexicon.words and "lose" in lexicon.stems
    a = tox.Automaton(lexicon)
    assert a.match("looser") == ("loser", 1, False) and a.match("lozer") == ("loser", 1, False)
    assert a.match("loser") == ("loser", 0, False) and a.match("losexyz") == ("lose", 0, True)
    assert a.match("lozexyz") is None


def test_terms_do_not_go_on_from_the_tail_of_a_stem():
    a = tox.Automaton(tox.Lexicon({"loser": 3.0, "lose": 2.0}, {"lose": 1.0}))
    assert a.match("losexyzr") == ("lose", 0, True) and a.match("lose") == ("lose", 0, False)
    assert tox.features("losexyzr", a)[4] == 0.25 and tox.features("lose", a)[4] == 0.5


def test_quotations_of_any_length():
    a = tox.Automaton(tox.Lexicon({"idiot": 5.0}, {}))
    for left, right in (('"', '"'), ("\u201c", "\u201d"), ("\u00ab", "\u00bb")):
        text = f"idiot {left}{'some words ' * 90}idiot{' more words' * 90}{right} idiot"
        assert [f[4] for f in tox.findings(text, a)] == [False, True, False]
