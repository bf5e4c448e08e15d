"""The compiled piece automaton on blocks, boundless runs and models of other types."""

import random

import numpy as np
import pytest

from cortexloom.llm import piece_automaton, pieces, queries
from cortexloom.llm.transitions import Transitions


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


@pytest.fixture(scope="module")
def model():
    return piece_automaton.load_model(queries.tokenizer_path())


def texts():
    rng = random.Random(8)
    runs = ["a" * 3000, "ab" * 1500, "".join(rng.choice("ab") for _ in range(3000)), "".join(rng.choice("abcdefghijklmnop") for _ in range(4000)), "=" * 2500 + "x" + "-" * 2500, " " * 2000, "aaaaab" * 400, "漢" * 1000, "é" * 2000]
    return ["", *runs, " ".join(runs), "".join(runs), *["word " * rng.randint(0, 9) for _ in range(30)], ""]


@pytest.mark.parametrize("size", [1, 7, 191, 192, 193, 1000, 1 << 18])
def test_blocks_of_any_size(sp, model, size):
    some = texts() if size > 100 else [t[:300] for t in texts()]
    want = sp.encode(some)
    automaton = piece_automaton.PieceAutomaton(model)
    ids, at = piece_automaton.encode(automaton, some, size)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert piece_automaton.count(automaton, some, size).tolist() == [len(w) for w in want]


def test_maps_that_are_not_tabulated(sp, model):
    automaton = piece_automaton.PieceAutomaton(model, most_mapped=1)
    assert piece_automaton.count(automaton, texts()).tolist() == [len(w) for w in sp.encode(texts())]


@pytest.mark.parametrize("unit", ["a", "ab", "=-", "aaaaab"])
def test_scan_of_a_long_run(sp, model, unit):
    """Millions of characters without a boundary take rounds by the logarithm of their number, not one for each chunk."""
    text = unit * (5_000_000 // len(unit))
    automaton = piece_automaton.PieceAutomaton(model)
    calls = 0
    plain = automaton._next

    def counted(states, codes):
        nonlocal calls
        calls += 1
        return plain(states, codes)

    automaton._next = counted
    n = piece_automaton.count(automaton, [text])
    small = len(sp.encode(unit * 20_000))
    assert abs(n[0] - small * len(text) / (len(unit) * 20_000)) < 0.01 * n[0]
    assert calls < len(text) / 100
    piece = text[: 100_000 // len(unit) * len(unit)]
    assert piece_automaton.count(automaton, [piece])[0] == len(sp.encode(piece))


def test_the_window_is_bounded(model):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(20_000)) + "a" * 50_000
    automaton = piece_automaton.PieceAutomaton(model)
    window, held, given = piece_automaton.PieceWindow(automaton), 0, 0
    for _, points, states, bounds in piece_automaton._runs(automaton, [text], 4096):
        given += len(window.feed(automaton.token[states], points, bounds)[0])
        held = max(held, len(window.tokens))
    assert given and held <= 4 * automaton.longest
    assert given + len(window.close()[0]) == piece_automaton.count(automaton, [text])[0]


def test_many_classes(sp, model):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x4E00, 0x9FFF)]
    text = "".join(rng.choice(letters) for _ in range(60_000)) + " " + "".join(letters)
    ids, at = piece_automaton.encode(piece_automaton.PieceAutomaton(model), [text])
    assert ids.tolist() == sp.encode(text) and at.tolist() == [0, len(ids)]


def test_transitions():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 55, 60_000))
    table, values = Transitions(2), np.arange(len(keys), dtype=np.int32)
    for i in range(0, len(keys), 1000):
        table.put(keys[i : i + 1000], values[i : i + 1000])
    assert (table.get(keys) == values).all() and (table.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert 2 * table.n <= len(table.key) and not len(table.get(keys[:0]))


def test_types_of_models(model):
    varint = lambda n: bytes([n])
    message = lambda number, raw: bytes([number << 3 | 2]) + varint(len(raw)) + raw
    piece = message(1, message(1, b"a") + b"\x15\x00\x00\x80\x3f")
    assert piece_automaton.model_kind(piece + message(2, message(1, b"f") + bytes([3 << 3, 2]))) == "bpe"
    assert piece_automaton.model_kind(piece + message(2, bytes([3 << 3, 1]))) == "unigram"
    assert piece_automaton.model_kind(piece + message(2, bytes([3 << 3, 4]))) == "char" and piece_automaton.model_kind(piece) == "unigram"
    assert model["kind"] == "bpe"
    with pytest.raises(ValueError):
        piece_automaton.PieceAutomaton(model | {"kind": "unigram"})


def test_unigram_models_are_encoded_by_score(model):
    """The query's path for a unigram model against the best path of all, found by brute force."""
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba", *[f"<0x{i:02X}>" for i in range(256)]]
    unigram = {"pieces": names, "normal": list(range(7)), "scores": [-3.0, -2.1, -2.2, -3.5, -2.5, -3.9, -5.0] + [0.0] * 256, "bytes": {i: 7 + i for i in range(256)}, "digest": "u", "kind": "unigram"}
    score = dict(zip(names, unigram["scores"]))

    def best(text):
        paths = [(0.0, [])] + [None] * len(text)
        for i in range(len(text)):
            for p in names[:7]:
                if text.startswith(p, i) and paths[i]:
                    got = (paths[i][0] + score[p], paths[i][1] + [names.index(p)])
                    if paths[i + len(p)] is None or got[0] > paths[i + len(p)][0]:
                        paths[i + len(p)] = got
        return paths[-1][1]

    rng = random.Random(3)
    some = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    ids, at = pieces.encode_texts(unigram, some)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [best("▁" + t.replace(" ", "▁")) if t else [] for t in some]
