import re
from re import _constants as c
from re import _parser

import pytest

from heddle.llm import residue

FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
]
OTHERS = ["By {author_name} today.", "Dear {first_name}, hello.", "Headline TK", "Quote TK: the hem.", "Met [ insert name ] at noon.", "Seen by [ your name] here.", "Add a bio", "Write a short caption for it."]


def strings(parsed):
    """Strings for a parsed pattern: each branch, options in and out, repeats at their least and, of any letters, longer."""
    out = [""]
    for op, arg in parsed:
        if op is c.LITERAL:
            part = [chr(arg)]
        elif op is c.ANY or op is c.NOT_LITERAL:
            part = ["b"]
        elif op is c.IN:
            kind, x = arg[0]
            classes = {c.CATEGORY_DIGIT: "4", c.CATEGORY_SPACE: " ", c.CATEGORY_NOT_WORD: "."}
            part = [chr(x) if kind is c.LITERAL else chr(x[0]) if kind is c.RANGE else classes.get(x, "b") if kind is c.CATEGORY else "b"]
        elif op is c.BRANCH:
            part = [s for branch in arg[1] for s in strings(branch)]
        elif op is c.SUBPATTERN:
            part = strings(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            least, most, sub = arg
            one = strings(sub)
            part = [s * least for s in one] if least else ["", *(one if most == 1 else [])]
            if sub[0][0] is c.ANY:
                part = [*part, " qj "]
        else:  # places and what stands about them
            part = [""]
        out = [a + b for a in out for b in part]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("pattern", residue.SLOTS + residue.NOTICES)
def test_every_string_of_a_pattern_holds_a_cue(pattern):
    automaton = residue.cue_automaton()
    found = [s for s in strings(_parser.parse(pattern, re.I)) if residue.has_residue(s)]
    assert found
    for s in found:
        for text in (s, s.upper(), f"The coat was soft. It was cut.\n{s}"):
            assert residue.has_residue(text, None, automaton) or not residue.has_residue(text), text


@pytest.mark.parametrize("text", FILLER + OTHERS)
def test_sentences_with_and_without_cues(text):
    for x in (text, text.upper(), f"The coat was soft. {text} It was cut."):
        assert residue.has_residue(x) and residue.has_residue(x, None, residue.cue_automaton())


@pytest.mark.parametrize("word", sorted(residue._FILLER_ONLY))
def test_every_filler_word_is_a_cue(word):
    assert residue.has_residue(f"{word} " * 5, None, residue.cue_automaton())


@pytest.mark.parametrize("text", ["Denim, an elite minimal animal print; the magnate's commodore coat.", "It is not the hem. It was not there that Alda sat.", "[The label] closed in [1962] for [a year]."])
def test_prose_with_cues_is_no_case(text):
    assert not residue.has_residue(text) and not residue.has_residue(text, None, residue.cue_automaton())
