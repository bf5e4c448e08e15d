"""A piece model compiled, state by state as texts need it, into a deterministic transducer over characters.

Byte-pair encoding has a local form: the encoding of a prefix of a text ends with the one piece t
that forms an admissible pair with the last piece of the prefix before t, and a pair (a, b) is
admissible if encoding the string ab gives [a, b].  (What is merged on one side of a boundary that
no merge ever crosses does not depend on the other side.)  So the last piece and the number of
pieces of each prefix follow from those of the prefixes at most one piece length shorter.  A state
holds just these, relative to the current position, for the positions that a later piece can start
from; there are finitely many.  A transition carries the change of the number of pieces, and the
state entered carries the last piece.  Where no piece holds two neighbouring characters side by
side, the state is the start state whatever came before.

Texts are read in blocks, and blocks are cut into chunks.  A chunk's state map takes the state
before it to the state after it.  From the first boundary in the chunk on where nothing is carried
over the map is constant.  Chunks without one are run from the state that the chunk before ends in,
side by side, again for those whose predecessor then ends elsewhere: as states differ for a few
characters only, most texts agree after a round or two.  Where they do not (a few letters that
repeat), the maps are tabulated over the states that occur between chunks (equal chunks share a map,
and a run ends early where it meets the one that is known), and a prefix scan composes them in as
many rounds as the number of chunks has bits; if there are too many states for that, the rounds of
agreement go on, each of which settles one more chunk of every run at least.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np

from .transitions import CLASS_BITS, Transitions, keys_of

SPACE = "▁"
START = ("", (None,), (0,))
STRIDE = 192
#: Characters read at once; states, maps and backpointers are held for these only.
BLOCK = 1 << 18
#: States that a worker keeps; beyond them it forgets all and compiles anew what is needed.
MOST_STATES = 1 << 18
#: Rounds of agreement before maps are tabulated, and pairs of a chunk and a state that they are tabulated over.
ROUNDS, MOST_MAPPED = 6, 1 << 16
#: States and classes whose transitions lie in a plain table; those of others are hashed.
DENSE_STATES, DENSE_CLASSES = 1 << 16, 128


#: Values of the field model_type of a model file's trainer_spec: fixed by the format.
KINDS = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        number, form = divmod(varint(), 8)
        if form == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(form) or varint()
            yield number, raw[at : at + size]
            at += size


def model_kind(raw: bytes) -> str:
    """Type of a model file: field 3 of its field 2, unigram if it is not set."""
    return KINDS[next((v for spec in (v for k, v in _fields(raw) if k == 2) for k, v in _fields(spec) if k == 3), 1)]


def load_model(path: str) -> dict:
    """Pieces of a SentencePiece model file with their scores: only what encoding needs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    model = {
        "pieces": pieces,
        "normal": [i for i in range(len(pieces)) if not special(i)],
        "scores": [sp.get_score(i) for i in range(len(pieces))],
        "bytes": {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if sp.is_byte(i)},
        "unknown": sp.unk_id(),
        "kind": model_kind(sp.serialized_model_proto()),
    }
    if model["kind"] not in ("bpe", "unigram"):
        raise ValueError(f"a {model['kind']} model is not supported")
    if len(model["bytes"]) != 256:
        raise ValueError("a model without byte fallback is not supported")
    if sp.encode("a  b ") == sp.encode("a b") or sp.encode("ﬁ") == sp.encode("fi"):
        raise ValueError("a model that normalizes its input is not supported")
    model["digest"] = hashlib.sha1(repr((pieces, model["scores"])).encode()).hexdigest()
    return model


def _packed(key: tuple) -> bytes:
    """A state in a fifth of the memory that its tuples take."""
    text, tokens, counts, delta, token = key
    n = len(tokens)
    return struct.pack(f"<B{n}i{n}bhi", n, *(-2 if t is None else t for t in tokens), *counts, delta, token) + text.encode("utf-8", "surrogatepass")


def _unpacked(raw: bytes) -> tuple:
    n = raw[0]
    form = f"<B{n}i{n}bhi"
    got = struct.unpack_from(form, raw)
    return raw[struct.calcsize(form) :].decode("utf-8", "surrogatepass"), tuple(None if t == -2 else t for t in got[1 : n + 1]), got[n + 1 : 2 * n + 1], got[-2], got[-1]


class PieceAutomaton:
    def __init__(self, model: dict, most_states: int = MOST_STATES, most_mapped: int = MOST_MAPPED):
        if model.get("kind", "bpe") != "bpe":
            raise ValueError("only byte-pair models can be compiled")
        self.model = model
        self.id = {model["pieces"][i]: i for i in model["normal"]}
        self.score = {p: model["scores"][i] for p, i in self.id.items()}
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p))}
        self.neighbours = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.length = np.ones(len(model["pieces"]) + 5, np.int64)  # the last five: characters that become bytes
        for p, i in self.id.items():
            self.length[i] = len(p)
        self.longest = int(self.length.max())
        self.byte_ids = np.array([model["bytes"][b] for b in range(256)], np.int32)
        self.pairs: dict[int, bool] = {}
        self.most_states, self.most_mapped = most_states, most_mapped
        self.classes: list = [None, 0]  # class 0: not seen yet; 1: a cut between texts
        self.index: dict = {}
        self.class_of = np.zeros(0x110000, np.uint16)
        self.joins = np.zeros(0, np.int64)
        self.joined = 0  # classes that joins knows
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.next = Transitions()
        self.table = np.full(1024 * DENSE_CLASSES, -1, np.int32)
        self.delta = np.zeros(1024, np.int16)
        self.token = np.zeros(1024, np.int32)
        self.start = self._state((*START, 0, -1))

    def _state(self, key: tuple) -> int:
        raw = _packed(key)
        s = self.known.get(raw)
        if s is None:
            s = self.known[raw] = len(self.keys)
            self.keys.append(raw)
            if s >= len(self.delta):
                for table in (self.delta, self.token):
                    table.resize(len(table) * 3 // 2, refcheck=False)
            if s < DENSE_STATES and s * DENSE_CLASSES >= len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
            self.delta[s], self.token[s] = key[3], key[4]
        return s

    def encode_short(self, text: str) -> list[str]:
        """Byte-pair encoding by its definition: merge the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, a: int | None, b: str) -> bool:
        pair = (-1 if a is None else a) << 32 | self.id[b]
        got = self.pairs.get(pair)
        if got is None:
            if a is None:
                got = self.encode_short(b) == [b]
            else:
                left = self.model["pieces"][a]
                got = self.encode_short(left + b) == [left, b]
            if len(self.pairs) > 150_000:
                self.pairs.clear()
            self.pairs[pair] = got
        return got

    def step(self, key: tuple, c) -> tuple:
        """The state after one more character; c: a character, or the number of bytes of one that no piece has."""
        if isinstance(c, int):
            return (*START, c, len(self.model["pieces"]) + c)
        text, tokens, counts = key[:3]
        if text and text[-1] + c not in self.neighbours:
            text, tokens, counts = START
        text += c
        for j in range(len(text)):
            t = text[j:]
            if t in self.id and self.admissible(tokens[j], t):
                break
        else:
            raise AssertionError(f"no piece ends at {text!r}")
        token, delta = self.id[t], counts[j] + 1
        depth = next((len(text) - k for k in range(len(text)) if text[k:] in self.prefixes), 0)
        if not depth:
            return (*START, delta, token)
        text = text[-depth:]
        tokens, counts = (*tokens, token)[-depth - 1 :], tuple(x - delta for x in (*counts, delta))[-depth - 1 :]
        live = [text[k:] in self.prefixes for k in range(depth)] + [True]  # from elsewhere no piece can start any more
        return (text, tuple(t if a else -1 for t, a in zip(tokens, live)), tuple(n if a else 0 for n, a in zip(counts, live)), delta, token)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points: one for each character that is a piece, four for the others by their UTF-8 length."""
        got = self.class_of[points]
        if not got.all():
            for p in np.unique(points[got == 0]).tolist():
                c = chr(p)
                c = SPACE if c == " " else c
                kind = c if c in self.id else len(c.encode("utf-8", "surrogatepass"))
                if kind not in self.index:
                    self.index[kind] = len(self.classes)
                    self.classes.append(kind)
                self.class_of[p] = self.index[kind]
            got = self.class_of[points]
        return got

    def carried(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether a piece has two neighbouring characters of these classes side by side."""
        if self.joined != len(self.classes):
            of = {c: k for k, c in enumerate(self.classes) if isinstance(c, str)}
            pairs = ((of.get(p[0]), of.get(p[1])) for p in self.neighbours)
            self.joins = np.unique(np.array([a << 16 | b for a, b in pairs if a and b], np.int64))
            self.joined = len(self.classes)
            n = self.joined
            self.dense = np.zeros((n, n), bool) if n <= 2048 else None
            if self.dense is not None:
                self.dense[self.joins >> 16, self.joins & 0xFFFF] = True
        if self.dense is not None:
            return self.dense[before, after]
        return np.isin(before.astype(np.int64) << 16 | after, self.joins)

    def _known(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, negative where the transition is missing."""
        got = self.table.take(states * np.int32(DENSE_CLASSES) + codes, mode="clip")
        if len(self.keys) > DENSE_STATES or len(self.classes) > DENSE_CLASSES:
            far = np.flatnonzero((states >= DENSE_STATES) | (codes >= DENSE_CLASSES))
            if len(far):
                got[far] = self.next.get(keys_of(states[far], codes[far]))
        return got

    def _next(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, adding the transitions that are missing."""
        got = self._known(states, codes)
        if len(got) and got.min() < 0:
            miss = np.flatnonzero(got < 0)
            new = np.unique(keys_of(states[miss], codes[miss]))
            state, code = new >> CLASS_BITS, new & ((1 << CLASS_BITS) - 1)
            to = np.array([self._state(self.step(_unpacked(self.keys[a]), self.classes[c])) for a, c in zip(state.tolist(), code.tolist())], np.int32)
            near = (state < DENSE_STATES) & (code < DENSE_CLASSES)
            self.table[state[near] * DENSE_CLASSES + code[near]] = to[near]
            if not near.all():
                self.next.put(new[~near], to[~near])
            got[miss] = self._known(states[miss], codes[miss])
        return got

    def _lockstep(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray, out: np.ndarray) -> None:
        """Run lanes begin..end side by side from the given states; out gets the state after each character."""
        order = np.argsort(begin - end, kind="stable")
        begin, states = begin[order], states[order].astype(np.int32)
        lengths = end[order] - begin
        live = len(begin)
        for k in range(int(lengths[0]) if live else 0):
            while live and lengths[live - 1] <= k:
                live -= 1
            at = begin[:live] + k
            states[:live] = out[at] = self._next(states[:live], codes[at])

    def _agree(self, codes: np.ndarray, begin: np.ndarray, states: np.ndarray, out: np.ndarray, rounds: int | None) -> bool:
        """Run whole chunks from the state that `out` has before them, until it has the same for all of them.

        states: those that the runs in `out` began from.  A run ends where it meets the one before.  False: not in so many rounds."""
        states = states.copy()
        while True:
            want = out[begin - 1]
            lane = np.flatnonzero(want != states)
            if not len(lane):
                return True
            if rounds == 0:
                return False
            states[lane] = want[lane]
            rounds = None if rounds is None else rounds - 1
            now = want[lane].astype(np.int32)
            for k in range(STRIDE):
                at = begin[lane] + k
                now = self._next(now, codes[at])
                apart = now != out[at]
                lane, now, at = lane[apart], now[apart], at[apart]
                if not len(lane):
                    break
                out[at] = now

    def _exits(self, codes: np.ndarray, begin: np.ndarray, states: np.ndarray, trace: np.ndarray) -> np.ndarray:
        """State after each whole chunk from the given state, given the states of its run from the start state in `trace`."""
        out = trace[begin + STRIDE - 1].copy()
        lane, states = np.arange(len(begin)), states.astype(np.int32)
        for k in range(STRIDE):
            states = self._next(states, codes[begin[lane] + k])
            apart = states != trace[begin[lane] + k]
            if k == STRIDE - 1:
                out[lane[apart]] = states[apart]
            lane, states = lane[apart], states[apart]
            if not len(lane):
                break
        return out

    def _compose(self, codes: np.ndarray, chunk: np.ndarray, free: np.ndarray, out: np.ndarray) -> np.ndarray | None:
        """The state before each chunk of `free` (whole chunks whose maps are not constant), by a prefix scan of their maps;
        out holds the runs of these chunks from the start state, and the right end of those that are not free.  None: too many states."""
        _, first, content = np.unique(np.lib.stride_tricks.sliding_window_view(codes, STRIDE)[chunk[free]].copy().view(f"V{STRIDE * codes.itemsize}").ravel(), return_index=True, return_inverse=True)
        content = content.ravel()
        begin = chunk[free][first]
        alone = np.diff(free, prepend=free[0] - 2) > 1  # the chunk before is not free: its end is known
        places = [int(x) for x in np.unique(out[chunk[free[alone]] - 1])]
        index, rows, done = {s: k for k, s in enumerate(places)}, [], 0
        while done < len(places):
            new = np.array(places[done:], np.int64)
            if len(places) * len(begin) > self.most_mapped or len(places) * len(free) > 16 * self.most_mapped:
                return None
            got = self._exits(codes, np.repeat(begin, len(new)), np.tile(new, len(begin)), out).reshape(len(begin), len(new))
            rows.append(got)
            done = len(places)
            for s in np.unique(got).tolist():
                if s not in index:
                    index[s] = len(places)
                    places.append(s)
        table = np.array(places)
        order = np.argsort(table)
        maps = order[np.searchsorted(table, np.concatenate(rows, axis=1), sorter=order)][content].astype(np.int32)  # chunk x state -> state
        start = np.maximum.accumulate(np.where(alone, np.arange(len(free)), 0))
        step = 1
        while step < len(free):  # maps[i]: all chunks from the later of i - step + 1 and the start of the run to i
            i = np.flatnonzero(np.arange(len(free)) - step >= start)
            if not len(i):
                break
            maps[i] = np.take_along_axis(maps[i], maps[i - step], 1)
            step *= 2
        entry = np.array([index[int(s)] for s in out[chunk[free[start]] - 1].tolist()])
        before = np.where(alone, entry, maps[np.maximum(np.arange(len(free)) - 1, 0), entry])
        return table[before]

    def run(self, codes: np.ndarray, last: int = 1, state: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each character, and the positions before which nothing is carried over.

        last, state: class of the character before and the state after it (None: the start state)."""
        n = len(codes)
        out = np.empty(n + 1, np.int32)
        out[-1] = self.start if state is None else state  # chunk 0 finds it at place -1
        if not n:
            return out[:0], np.zeros(0, np.int64)
        sync = ~self.carried(np.concatenate([[np.uint16(last)], codes[:-1]]), codes)
        bounds = np.flatnonzero(sync)
        chunk = np.arange(0, n, STRIDE)
        stop = np.minimum(chunk + STRIDE, n)
        here = np.append(bounds, n)[np.searchsorted(bounds, chunk)]
        here = np.where(here < stop, here, -1)
        tails = np.flatnonzero(here >= 0)
        self._lockstep(codes, here[tails], stop[tails], np.full(len(tails), self.start), out)
        free = np.flatnonzero((here < 0) & (stop - chunk == STRIDE))
        heads, ready = np.flatnonzero(here != chunk), here >= 0
        if len(free) > 1:
            began = np.full(len(free), self.start)
            self._lockstep(codes, chunk[free], stop[free], began, out)
            if not self._agree(codes, chunk[free], began, out, ROUNDS):
                before = self._compose(codes, chunk, free, out)
                if before is None:
                    self._agree(codes, chunk[free], np.full(len(free), -1), out, None)
                else:
                    self._lockstep(codes, chunk[free], stop[free], before, out)
            ready[free] = True
            heads = heads[~np.isin(heads, free)]
        while len(heads):  # one round, unless chunks have to follow one another
            now = heads[ready[heads - 1] | (heads == 0)]
            self._lockstep(codes, chunk[now], np.where(here[now] >= 0, here[now], stop[now]), out[chunk[now] - 1], out)
            ready[now] = True
            heads = heads[~np.isin(heads, now)]
        return out[:n], bounds


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[np.ndarray]:
    """Code points of the texts one after the other, each with a place for a cut and, unless it is empty, a space before it."""
    held, have = [], 0
    for t in texts:
        t = "\n " + t if t else "\n"
        at = 0
        while at < len(t):
            part = t[at : at + size - have]
            held.append(part)
            at, have = at + len(part), have + len(part)
            if have == size:
                yield np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
                held, have = [], 0
    if held:
        yield np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)


def places(texts: list[str]) -> np.ndarray:
    """Place of the cut before each text in the blocks taken together, and their length."""
    return np.concatenate([[0], np.cumsum([len(t) + 2 if t else 1 for t in texts], dtype=np.int64)])


def _runs(automaton: PieceAutomaton, texts: list[str], size: int) -> Iterator[tuple]:
    """Of each block: its place, code points, states and boundaries."""
    cuts, at, last, state = places(texts)[:-1], 0, 1, None
    for points in blocks(texts, size):
        if len(automaton.keys) > automaton.most_states:
            raw = None if state is None else automaton.keys[state]
            automaton._clear()
            state = None if raw is None else automaton._state(_unpacked(raw))
        codes = automaton.codes(points).copy()
        codes[cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, at + len(points))] - at] = 1
        states, bounds = automaton.run(codes, last, state)
        last, state = int(codes[-1]), int(states[-1])
        yield at, points, states, bounds
        at += len(points)


def count(automaton: PieceAutomaton, texts: list[str], size: int = BLOCK) -> np.ndarray:
    """Number of pieces of each text."""
    edges, out = places(texts), np.zeros(len(texts), np.int64)
    for at, points, states, _ in _runs(automaton, texts, size):
        sums = np.zeros(len(points) + 1, np.int64)
        np.cumsum(automaton.delta[states], out=sums[1:])
        lo, hi = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + len(points))
        out[lo:hi] += np.diff(sums[np.clip(edges[lo : hi + 1] - at, 0, len(points))])
    return out


class PieceWindow:
    """The streaming Viterbi pass over blocks of text, many lanes side by side.

    Each position has one surviving backpointer, its last piece.  A later piece can begin at the last
    `longest` positions only; where all their paths meet, the ids before are final: they are given
    out, and only the backpointers behind that boundary stay in the window.
    """

    def __init__(self, automaton: PieceAutomaton):
        self.automaton = automaton
        self.tokens, self.points, self.bounds, self.at = np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def feed(self, tokens: np.ndarray, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the last pieces of the next positions; the ids that became final, and the place that each one's piece ends in front of."""
        self.bounds = np.concatenate([self.bounds, bounds + len(self.tokens)])
        self.tokens, self.points = np.concatenate([self.tokens, tokens]), np.concatenate([self.points, points])
        return self._commit(self._meeting())

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        return self._commit(len(self.tokens))

    def _meeting(self) -> int:
        """The last boundary that the paths from all live positions have in common."""
        n, length = len(self.tokens), self.automaton.length
        live = set(range(max(0, n - self.automaton.longest + 1), n + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - int(length[self.tokens[last - 1]]))
        return live.pop()

    def _commit(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Follow the backpointers from all boundaries up to `end` at once."""
        automaton = self.automaton
        inside = self.bounds[: np.searchsorted(self.bounds, end)]
        begin = inside if len(inside) and inside[0] == 0 else np.concatenate([[0], inside])
        at = np.append(begin[1:], end) - 1
        begin, at = begin[at >= begin], at[at >= begin]
        ends = np.zeros(end, bool)
        while len(at):
            ends[at] = True
            at = at - automaton.length[self.tokens[at]]
            more = at >= begin
            at, begin = at[more], begin[more]
        place = np.flatnonzero(ends)
        ids = self.tokens[place]
        extra = ids - len(automaton.model["pieces"])  # number of bytes of a character that no piece has; 0: a cut
        place, ids, extra = place[extra != 0], ids[extra != 0], extra[extra != 0]
        repeat = np.maximum(extra, 1)
        where = np.cumsum(repeat) - repeat
        out = np.repeat(ids, repeat)
        for k in range(1, 5):
            those = np.flatnonzero(extra == k)
            if len(those):
                raw = np.array(self.points[place[those]]).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                out[where[those][:, None] + np.arange(k)] = automaton.byte_ids[np.frombuffer(raw, np.uint8).reshape(-1, k)]
        got = out, np.repeat(place, repeat) + self.at
        self.tokens, self.points, self.bounds, self.at = self.tokens[end:].copy(), self.points[end:].copy(), self.bounds[self.bounds >= end] - end, self.at + end
        return got


def encode(automaton: PieceAutomaton, texts: list[str], size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts joined, and their n+1 offsets."""
    edges, window, ids, counts = places(texts), PieceWindow(automaton), [], np.zeros(len(texts), np.int64)

    def keep(got: tuple) -> None:
        ids.append(got[0])
        lo = np.searchsorted(edges, got[1][:1], "right")[0] - 1 if len(got[1]) else 0
        n = np.bincount(np.searchsorted(edges, got[1], "right") - 1 - lo)
        counts[lo : lo + len(n)] += n

    for _, points, states, bounds in _runs(automaton, texts, size):
        keep(window.feed(automaton.token[states], points, bounds))
    keep(window.close())
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])


class PieceBytes:
    """Decoding: the bytes of each id in one buffer, gathered for many ids at once."""

    def __init__(self, model: dict):
        raw = [b""] * len(model["pieces"])
        for i in model["normal"]:
            raw[i] = model["pieces"][i].replace(SPACE, " ").encode()
        for b, i in model["bytes"].items():
            raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts joined and their n+1 offsets, without the space put before each text."""
        size = self.size[ids]
        sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=sums[1:])
        out = self.data[np.arange(sums[-1]) + np.repeat(self.at[ids] - sums[:-1], size)]
        ends = sums[offsets]
        keep = np.ones(len(out), bool)
        keep[ends[:-1][ends[1:] > ends[:-1]]] = False
        return out[keep], ends - np.concatenate([[0], np.cumsum(ends[1:] > ends[:-1])])


_CACHE: dict[str, PieceAutomaton] = {}


def automaton_for(model: dict) -> PieceAutomaton:
    """One for each model and Python worker: what earlier batches compiled stays."""
    got = _CACHE.get(model["digest"])
    if got is None:
        got = _CACHE[model["digest"]] = PieceAutomaton(model)
    return got
