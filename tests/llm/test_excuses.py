"""Innocent senses of doubtful nouns: they count in their own sentence or quotation only, and never where somebody is addressed."""

import pytest

from graphloom.llm import abuse


@pytest.mark.parametrize(
    "text, case",
    [
        ("He wrote (you cockroach) The parties were given until 9 August 2007 to file written observations.", True),
        ("You are a bastard, said the witness at the trial.", True),
        ("He is a filthy rat. The witness saw mice in the crop.", True),
        ('"What a filthy rat" The crop was sprayed.', True),
        ("He is a stupid bastard and the rat is a witness.", True),
        ("Ihr Schweine gehört in den Stall.", True),
        ("There was a dirty rat among the mice.", False),
        ("It was a rotten bastard file.", False),
        ("Er sah ihr Schwein im Stall.", False),
        ("the delay made it worthless. the rats breed like mad", False),
    ],
)
def test_sober_words_excuse_their_noun_in_their_sentence_only(text, case):
    assert (abuse.lexicon().score(text)[0] >= abuse.THRESHOLD) is case


def test_a_missing_vocabulary_is_no_error(tmp_path):
    assert abuse.Lexicon(str(tmp_path)).score("you absolute bastard")[0] >= abuse.THRESHOLD


def test_long_sentences_keep_what_stands_before_a_late_word():
    filler = "whether the loan note passed to the claimant before or after the deed of that year was sealed "
    assert abuse.lexicon().score("Put shortly, the question is " + filler * 3 + "the only good hill folk are dead ones")[0] >= abuse.THRESHOLD
