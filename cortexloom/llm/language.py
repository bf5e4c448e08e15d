"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed greedily into the
longest phrases that occur in that text; the language with the fewest phrases, normalised by the
length of its own text as in the Ziv-Merhav estimate (phrases * log2(n) / length), wins.  Because a
phrase ends exactly where the automaton has no transition, the parse is itself a transducer: a
missing transition is the root's transition with one phrase counted.  All texts of a batch run
through the transducers side by side, as lanes of one table lookup; a text longer than a lane is
cut into lanes whose first phrases are parsed anew from the state that the lane before ends in.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, mapped, slices
from .transitions import Transitions, keys_of

#: Training text for a language: it ends with the text that reaches so many characters; of a longer text, MAX_TEXT from its first letter on.
TRAIN_CHARS, MAX_TEXT = 60_000, 20_000
#: Expected rows collected for a language.
TRAIN_ROWS = 120
LETTER, GAP = 1, 0
STRIDE = 512
SLICE_BYTES = 512 << 10
#: Rounds in which all lanes of a slice are parsed again side by side.
MEND_ROUNDS = 8
#: Cells of a language's table (states x letters) above which its transitions are hashed.
DENSE_CELLS = 1 << 23
UNDETERMINED = "und"


def fold(text: str) -> str:
    """Lower case; each run of what isn't a letter or mark becomes one space."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict]:
    """Transitions of the states of the smallest automaton of all substrings; state 0 is the root."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class DenseTable:
    """Next state and phrases ended by state and class; a state is the offset of its row."""

    def __init__(self, states: list[dict], code: dict, width: int):
        table = np.empty((len(states), width), np.int32)
        again = np.full(width, 2, np.int32)  # a letter that the language's text lacks ends the phrase before it and is one itself
        for c, s in states[0].items():
            again[code[c]] = 4 * width * s + 1
        table[:] = again
        table[0] = 1
        for i, row in enumerate(states):
            for c, s in row.items():
                table[i, code[c]] = 4 * width * s
        self.table = table.reshape(-1)

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """4 * next state + phrases ended."""
        return self.table[states + classes]


class HashedTable:
    """The same for a large alphabet: only the transitions that there are."""

    def __init__(self, states: list[dict], code: dict, width: int):
        rows = [(i, code[c], s) for i, row in enumerate(states) for c, s in row.items()]
        i, c, s = (np.array(x, np.int64) for x in zip(*rows))
        self.next = Transitions()
        self.next.put(keys_of(i, c), (4 * s).astype(np.int32))
        self.again = np.full(width, 2, np.int32)
        root = i == 0
        self.again[c[root]] = 4 * s[root] + 1

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        got = self.next.get(keys_of(states, classes))
        none = np.flatnonzero(got < 0)
        got[none] = np.where(states[none] == 0, 1, self.again[classes[none]])
        return got


class Languages:
    """Transducers of all languages, each over the classes of its own letters."""

    def __init__(self, samples: dict[str, str], dense_cells: int = DENSE_CELLS):
        self.names = sorted(k for k in samples if samples[k])
        folded = {k: fold(samples[k])[:TRAIN_CHARS] for k in self.names}
        self.names = [k for k in self.names if folded[k]]
        self.alphabet = sorted({c for k in self.names for c in folded[k]} - {" "})
        self.weights = [np.log2(max(2, len(folded[k]))) for k in self.names]
        self.tables, self.own = [], []
        for k in self.names:
            letters = sorted(set(folded[k]) - {" "})
            states, width = suffix_automaton(folded[k]), len(letters) + 2
            kind = DenseTable if len(states) * width <= dense_cells else HashedTable
            self.tables.append(kind(states, {c: i + 2 for i, c in enumerate(letters)} | {" ": GAP}, width))
            place = {c: i + 2 for i, c in enumerate(letters)}
            self.own.append(np.array([GAP, LETTER, *(place.get(c, LETTER) for c in self.alphabet)], np.int32))  # class of each common class

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_parser"}

    def parser(self) -> "Parser":
        """One for each worker."""
        if not hasattr(self, "_parser"):
            self._parser = Parser(self)
        return self._parser

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of each code point after lower-casing, and which are letters."""
        letters = np.zeros(0x110000, bool)
        n = len(self.alphabet) + 2
        table = np.zeros(0x110000, np.uint8 if n < 1 << 8 else np.uint16 if n < 1 << 16 else np.uint32)
        code = {c: i + 2 for i, c in enumerate(self.alphabet)}
        for p in range(0x110000):
            kind = unicodedata.category(chr(p))
            if kind[0] in "LM":
                letters[p] = kind[0] == "L"
                low = chr(p).lower()
                table[p] = code.get(low, LETTER)
        return table, letters


class Parser:
    def __init__(self, languages: Languages):
        self.languages = languages
        self.table, self.letters = languages.classes()

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text for each language."""
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.languages.names)), np.int64)
        if not len(codes):
            return out
        lanes_of = -(-sizes // STRIDE)
        text = np.repeat(np.arange(len(sizes)), lanes_of)
        begin = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)) * STRIDE
        length = np.minimum(begin + STRIDE, offsets[1:][text]) - begin
        first = begin == offsets[:-1][text]
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # the column of each lane
        longest = length[order]
        live = np.searchsorted(-longest, -np.arange(1, STRIDE + 1), "right")
        common = codes[np.minimum(begin[order][None, :] + np.arange(STRIDE)[:, None], len(codes) - 1)]
        trace = np.zeros((STRIDE, len(order)), np.int32)
        ends_text = np.append(first[1:], True)
        for k, table in enumerate(self.languages.tables):
            grid = self.languages.own[k][common]
            counts = np.zeros(len(order), np.int32)
            state = np.zeros(len(order), np.int32)
            for j in range(STRIDE):
                n = live[j]
                if not n:
                    break
                got = table.step(state[:n], grid[j, :n])
                counts[:n] += got & 3
                state[:n] = trace[j, :n] = got >> 2
            last = state[place]
            counts = counts[place]
            # A lane that begins inside a text was parsed from the root: parse it again from the state that the
            # lane before ends in, until both parses are in the same state.
            self._mend(first, text, counts, last, grid, trace, place, length, table)
            counts[ends_text] += last[ends_text] != 0  # the phrase that the end of a text closes
            np.add.at(out[:, k], text, counts)
        return out

    @staticmethod
    def _mend(first, text, counts, last, grid, trace, place, length, table) -> None:
        """All lanes at once; what a lane ends in seldom depends on what it begins with, so a few rounds settle most.
        From then on the first open lane of each text goes alone, as the lanes before it are final."""
        roots, ends, used, rounds = counts.copy(), last.copy(), np.zeros(len(first), last.dtype), 0
        while True:
            now = np.flatnonzero(~first & (used != np.concatenate([last[:1], last[:-1]])))
            if not len(now):
                return
            if rounds >= MEND_ROUNDS:
                now = now[np.diff(text[now], prepend=-1) != 0]
            rounds += 1
            used[now] = last[now - 1]
            counts[now], last[now] = roots[now], ends[now]
            lane, column, state, before, j = now, place[now], used[now], np.zeros(len(now), np.int32), 0
            live = state != before
            lane, column, state, before = lane[live], column[live], state[live], before[live]
            while len(lane):
                c = grid[j, column]
                got, old = table.step(state, c), table.step(before, c)
                counts[lane] += (got & 3) - (old & 3)
                state, before = got >> 2, trace[j, column]
                j += 1
                over = j >= length[lane]
                last[lane[over]] = state[over]
                more = ~over & (state != before)
                lane, column, state, before = lane[more], column[more], state[more], before[more]

    def lettered(self, texts: list[str]) -> list[bool]:
        """Whether each text has a letter."""
        return [bool(self.letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, weights = self.languages.names, np.array(self.languages.weights)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        codes = self.table[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)  # one gap for a run of them
        inner = offsets[1:-1]
        keep[inner[inner < len(codes)]] = True
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        letters = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(self.letters[points], out=letters[1:])
        some = letters[offsets[1:]] > letters[offsets[:-1]]
        if not names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cost = self.phrases(codes[keep], kept[offsets]) * weights
        best = np.argmin(cost, axis=1)
        ranked = np.sort(cost, axis=1)
        second = ranked[:, 1] if len(names) > 1 else 2 * ranked[:, 0]
        score = np.where(some, second / np.maximum(ranked[:, 0] + second, 1e-9), 0.0)
        return [names[b] if s else UNDETERMINED for b, s in zip(best, some)], score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Learn each lang of the rows of docs whose text has a letter: a sample bounded for each language by
    TRAIN_ROWS expected rows and TRAIN_CHARS, chosen by a hash of id and text.  Rows that repeat both count
    once.  A text longer than MAX_TEXT gives an excerpt of that length."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).collect()}  # a row for each language
    if not have:
        return Languages({})
    space = 1 << 40
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(have.items()) for x in (k, max(1, min(space, space * TRAIN_ROWS // max(1, n))))]), F.col("lang"))
    excerpt = F.when(F.length("text") <= MAX_TEXT, F.col("text")).otherwise(F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, MAX_TEXT))
    # rows that repeat an id and a text are one, so that their number bounds nothing but the work of this aggregation
    picked = rows.where(F.pmod("_h", F.lit(space)) < limit).withColumn("text", excerpt).distinct().toArrow()
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.to_pylist(), key=lambda r: (r["_h"], r["doc_id"] or 0, r["text"])):
        got = samples.setdefault(r["lang"], [])
        if sum(map(len, got)) < TRAIN_CHARS:
            got.append(r["text"])
    return Languages({k: " ".join(v) for k, v in samples.items()})


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row for each row of docs.

    lang_pred is a learned language, or "und" if the text is null or has no letter, or nothing was
    learned; ties go to the name that sorts first.  score is how much cheaper the best language is
    than the next, best / both, from 0.5 (a tie) up to 1, and 0 for "und".  Whole texts count;
    columns besides id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        parser = sent.value.parser()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                names, score = parser.predict(pc.fill_null(part.column("text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return mapped(ids_and_texts(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, languages: Languages, rejected: tuple = (UNDETERMINED,), text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and where they are, whose predicted language isn't one of `rejected`.

    If nothing was learned, no text has a language and only null texts and those without a letter count
    as "und"."""
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        parser = sent.value.parser()
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                texts = pc.fill_null(part.column(text_col), "").to_pylist()
                names, _ = parser.predict(texts)
                if not parser.languages.names:
                    names = [None if some else n for n, some in zip(names, parser.lettered(texts))]
                yield part.filter(pa.array([n not in rejected for n in names], pa.bool_()))

    return mapped(docs, run, docs.schema)
