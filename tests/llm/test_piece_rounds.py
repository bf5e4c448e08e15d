"""Long texts without a boundary: chunks that agree, maps that are scanned, and transitions beyond the plain table."""

import base64
import random
import time

import pytest

from cortexloom.llm import piece_automaton
from cortexloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def model():
    return piece_automaton.load_model(tokenizer_path())


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def texts(size):
    rng = random.Random(size)
    return {
        "ab": "".join(rng.choices("ab", k=size)), "a": "a" * size, "aab": "aab" * (size // 3), "ACGT": "".join(rng.choices("ACGT", k=size)), "base64": base64.b64encode(rng.randbytes(size * 3 // 4)).decode(),
        "runs": "".join(c * rng.randint(1, 3000) for c in rng.choices("abe", k=size // 1500)), "mixed": "ing" * (size // 6) + "".join(rng.choices("ing", k=size // 2)), "words": "theandofto" * (size // 10), "odd": "".join(rng.choices("aé漢🙂", k=size)),
    }


@pytest.mark.parametrize("rounds, mapped, states, classes", [(6, 1 << 16, 1 << 16, 128), (0, 1 << 16, 1 << 16, 128), (0, 1, 1 << 16, 128), (1, 1, 7, 128), (6, 1 << 16, 1 << 16, 5)])
def test_each_way_equals_the_library(sp, model, monkeypatch, rounds, mapped, states, classes):
    monkeypatch.setattr(piece_automaton, "ROUNDS", rounds)
    monkeypatch.setattr(piece_automaton, "DENSE_STATES", states)
    monkeypatch.setattr(piece_automaton, "DENSE_CLASSES", classes)
    automaton = piece_automaton.PieceAutomaton(model, most_mapped=mapped)
    own = texts(12_000)
    got = piece_automaton.count(automaton, list(own.values()), size=5000)
    assert dict(zip(own, got.tolist())) == {k: len(sp.encode(t)) for k, t in own.items()}
    ids, offsets = piece_automaton.encode(automaton, list(own.values()))
    for k, t in enumerate(own.values()):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == sp.encode(t)


@pytest.mark.parametrize("kind", ["ab", "a", "aab", "ACGT", "words", "runs"])
def test_five_million_characters(sp, model, kind):
    """A few letters, compiled anew: a second or two; the count of the start equals the library's."""
    text = texts(5_000_000)[kind] if kind == "runs" else texts(60_000)[kind] * 90
    automaton = piece_automaton.PieceAutomaton(model)
    began = time.process_time()
    n = piece_automaton.count(automaton, [text])[0]
    took = time.process_time() - began
    assert took < 12 and 0 < n <= len(text) + 1  # far below what one lane a step takes; see the README for figures
    assert piece_automaton.count(automaton, [text[:100_000]])[0] == len(sp.encode(text[:100_000]))
