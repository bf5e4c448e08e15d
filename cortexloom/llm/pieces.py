"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of a text has an edge for each piece at each place.  Only the backpointers of the last
positions, at most the longest piece back, can still matter; whenever all of them lead through one
boundary, the ids before it are final and leave the window.  For a byte-pair model a path is worth
something only if all its neighbouring pieces are admissible pairs (see piece_automaton), so each
position keeps one backpointer and the best path is the model's own encoding; for a unigram model
the edges carry the piece scores.  For byte-pair models the pass is compiled (`PieceWindow`): a
block of text gives the backpointers of its positions, many lanes at once, and the ids up to the
boundary where the live paths meet leave the window.  `StreamingViterbi` takes single characters,
for either type of model; unigram models are encoded by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, text_buffer
from .piece_automaton import SPACE, PieceAutomaton, PieceBytes, automaton_for, encode, load_model

SLICE_BYTES = 512 << 10


class StreamingViterbi:
    """Feeds characters one at a time; `feed` and `close` return the ids that have become final."""

    def __init__(self, model: dict, kind: str | None = None):
        kind = kind or model["kind"]
        self.model, self.kind = model, kind
        self.ids = {model["pieces"][i]: i for i in model["normal"]}
        self.longest = max(map(len, self.ids))
        self.pairs = PieceAutomaton(model) if kind == "bpe" else None
        self.normal = set(model["normal"])
        self.worst = min(model["scores"]) - 10
        self.text, self.nodes = "", [(0.0, None, None)]  # for each boundary in the window: score, start of the last piece, the piece's ids

    def feed(self, c: str) -> list[int]:
        self.text += SPACE if c == " " else c
        n, best = len(self.text), None
        for size in range(min(self.longest, n), 0, -1):
            piece, (score, _, before) = self.text[n - size :], self.nodes[n - size]
            if score is None or piece not in self.ids:
                continue
            if self.kind == "bpe":
                if self.pairs.admissible(before[-1] if before and before[-1] in self.normal else None, piece):
                    best = (0.0, n - size, [self.ids[piece]])
                    break
            elif best is None or score + self.model["scores"][self.ids[piece]] > best[0]:
                best = (score + self.model["scores"][self.ids[piece]], n - size, [self.ids[piece]])
        if self.text[-1] not in self.ids and (self.kind == "bpe" or best is None):
            best = (self.nodes[n - 1][0] + self.worst, n - 1, [self.model["bytes"][b] for b in self.text[-1].encode("utf-8", "surrogatepass")])
        self.nodes.append(best)
        return self._commit()

    def _commit(self) -> list[int]:
        live = set(range(max(0, len(self.nodes) - self.longest), len(self.nodes)))
        while len(live) > 1:  # step the latest boundary back until all paths meet
            at = max(live)
            live.remove(at)
            live.add(self.nodes[at][1] if self.nodes[at][1] is not None else 0)
            if 0 in live and len(live) > 1 and max(live) == 0:
                break
        meet = live.pop()
        if not meet:
            return []
        out = self._back(meet)
        last = self.nodes[meet]
        self.text = self.text[meet:]
        self.nodes = [(last[0], None, last[2])] + [(s, None if b is None else b - meet, i) for s, b, i in self.nodes[meet + 1 :]]
        return out

    def _back(self, at: int) -> list[int]:
        out = []
        while self.nodes[at][1] is not None:
            out[:0] = self.nodes[at][2]
            at = self.nodes[at][1]
        return out

    def close(self) -> list[int]:
        out = self._back(len(self.nodes) - 1)
        self.text, self.nodes = "", [(0.0, None, None)]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for c in " " + text if text else "":
            out += self.feed(c)
        return out + self.close()


def encode_texts(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts joined, and their n+1 offsets, by the pass for the model's type."""
    if model["kind"] == "bpe":
        return encode(automaton_for(model), texts)
    viterbi = StreamingViterbi(model)
    got = [viterbi.encode(t) for t in texts]
    return np.array([i for ids in got for i in ids], np.int32), np.concatenate([[0], np.cumsum([len(ids) for ids in got], dtype=np.int64)])


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), one row for each row of docs.

    Ids are the library's without begin or end tokens.  A null or empty text has no ids.  Repeated
    rows are encoded each; columns besides id and text are ignored.
    """
    return _encode(docs, model_path, id_col, text_col, check=False)


def encode_and_check(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """As encode_pieces, and round_trip: whether decoding the ids gives the text again (U+2581 reads as a space); the columns `carry` of docs follow."""
    return _encode(docs, model_path, id_col, text_col, check=True, carry=carry)


def _encode(docs: DataFrame, model_path: str, id_col: str, text_col: str, check: bool, carry: tuple = ()) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    names = ["doc_id", "n_tokens", "ids"] + ["round_trip"] * check + list(carry)

    def run(batches):
        pieces = PieceBytes(model.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column("text"), "")
                ids, offsets = encode_texts(model.value, texts.to_pylist())
                columns = [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))]
                if check:
                    columns.append(pa.array(_same(pieces, ids, offsets, texts)))
                columns += [part.column(c) for c in carry]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    kinds = "".join(f", `{c}` {read.schema[c].dataType.simpleString()}" for c in carry)
    return mapped(read, run, "doc_id long, n_tokens long, ids array<int>" + ", round_trip boolean" * check + kinds)


def _same(pieces: PieceBytes, ids: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    got, at = pieces.decode(ids, offsets)
    want, place = text_buffer(texts)
    if np.array_equal(at, place) and np.array_equal(got, want):
        return np.ones(len(texts), bool)
    got, plain = got.tobytes(), [(t or "").replace(SPACE, " ").encode() for t in texts.to_pylist()]
    return np.array([got[at[i] : at[i + 1]] == t for i, t in enumerate(plain)], bool)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts that ids stand for; null or no ids give an empty text, bytes that aren't UTF-8 become U+FFFD."""
    model = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        pieces = PieceBytes(model.value)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            offsets = np.zeros(len(lists) + 1, np.int64)
            np.cumsum([len(x or ()) for x in lists], out=offsets[1:])
            data, at = pieces.decode(np.array([i for x in lists for i in x or ()], np.int64), offsets)
            data = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([data[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(lists))], pa.string())], names=["doc_id", "text"])

    return mapped(encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids"), run, "doc_id long, text string")
