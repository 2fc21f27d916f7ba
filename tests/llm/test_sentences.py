from millrace.llm.subjects import sentences


def test_sentences_go_on_over_line_ends():
    assert sentences("# Notes\n\nThe court heard the claim and then\nthe judge left. Nobody\nspoke again.\n") == ["The court heard the claim and then the judge left.", "Nobody spoke again."]
    assert sentences("> A quoted line goes on\n> here and ends. It\n> ends again.\nThe answer follows.") == ["A quoted line goes on here and ends.", "It ends again.", "The answer follows."]
    assert sentences("One ends. Two has no full stop but more than six words") == ["One ends.", "Two has no full stop but more than six words"]
    assert sentences("Why\ncan\nSharedRelay.run\nfail so\noften?") == ["Why can SharedRelay.run fail so often?"]


def test_headings_are_marked_or_short():
    assert sentences("= A title =\n\nBug: count #483\n\nsrc/a.py:304\nThe cache is keyed by queue.\n\nA title that is longer than six words\n=====\nText one.\n") == ["The cache is keyed by queue.", "Text one."]
    assert sentences("- First item goes\n  on here.\n- Second one.") == ["- First item goes on here.", "- Second one."]
    assert sentences("") == [] and sentences("Heading only") == []
