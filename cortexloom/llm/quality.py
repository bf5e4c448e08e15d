"""Quality classifier: a sparse ensemble of rules.

Statistics of each whole text (one vectorised pass over its bytes) are the variables.  Small trees
are boosted on a bounded sample of labelled rows; every path from a root to a node is a conjunctive
rule; a lasso logistic regression over the rules keeps few of them; and what is kept is compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, mapped, slices, text_buffer, word_hashes, words

#: Labelled rows that the classifier is fitted on, at most (chosen by a hash of the id).
TRAIN_ROWS = 20_000
STATISTICS = ["n_bytes", "n_words", "word_bytes", "upper", "digits", "points", "symbols", "bars", "marks", "space", "lines", "wide", "capitals", "distinct", "repeated_lines", "ends"]
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
ROUNDS = 400

_KIND = {
    "upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "points": b".,;:'-()\"", "symbols": b"#$%&*@+=<>[]{}\\^_`~/", "bars": b"|", "marks": b"!?",
    "space": b" \t\n\v\f\r", "newline": b"\n", "wide": range(0xC0, 0x100),
}
_LUT = {k: np.isin(np.arange(256), list(v)) for k, v in _KIND.items()}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; all are 0 for an empty one."""
    data, offsets = text_buffer(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    kinds = {k: per_text(lut[data]) if len(data) else np.zeros(n) for k, lut in _LUT.items()}
    starts, ends, first = words(data, offsets)
    count = np.diff(first).astype(float)
    text_of = np.repeat(np.arange(n), np.diff(first))
    hashes = word_hashes(data, starts, ends)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    by_word = lambda flags: np.bincount(text_of, flags, n)
    capital = _LUT["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    capital_all = capital & (ends - starts > 1) & _LUT["upper"][data[np.maximum(ends - 2, starts)]] if len(starts) else capital
    final = np.isin(data[ends - 1], list(b".!?")) if len(ends) else capital
    distinct = _runs(text_of, hashes, n)[0]
    # lines: the sum of the hashes of the words between two line feeds
    line = np.cumsum(_LUT["newline"][data])[starts] if len(starts) else np.zeros(0, np.int64)
    edge = np.ones(len(line), bool)
    edge[1:] = (line[1:] != line[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(edge)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=sums[1:])
    line_hash, line_text = sums[np.append(at[1:], len(hashes))] - sums[at] if len(at) else sums[:0], text_of[at]
    different, n_lines = _runs(line_text, line_hash, n)
    repeated = n_lines - different
    return np.column_stack([
        sizes, count, share(sizes - kinds["space"], count), share(kinds["upper"], sizes), share(kinds["digits"], sizes), share(kinds["points"], sizes), share(kinds["symbols"], sizes), share(kinds["bars"], sizes), share(kinds["marks"], sizes),
        share(kinds["space"], sizes), share(n_lines, count), share(kinds["wide"], sizes), share(by_word(capital_all), count), share(distinct, count), share(repeated, n_lines), share(by_word(final), count),
    ])


def _runs(text_of: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different and all entries of each text (24 bits of text, 40 of hash in one sorted key)."""
    keys = np.sort((text_of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    text = (keys >> np.uint64(40)).astype(np.int64)
    return np.bincount(text[new], minlength=n).astype(float), np.bincount(text, minlength=n).astype(float)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS for each row (null text: all 0)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in got.T)], names=["doc_id", *STATISTICS])

    return mapped(docs, run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, found: list) -> np.ndarray:
    """Grow a tree on binned variables; append each node's path; returns the leaf value of each row of `rows`."""
    value = grad[rows].sum() / (hess[rows].sum() + 1.0)
    out = np.full(len(rows), value)
    if depth == 0 or len(rows) < 40:
        return out
    score = lambda g, h: g * g / (h + 1.0)
    best = (1e-3, None, None)
    for v in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[rows, v], grad[rows], BINS))
        h = np.cumsum(np.bincount(bins[rows, v], hess[rows], BINS))
        n = np.cumsum(np.bincount(bins[rows, v], minlength=BINS))
        gain = score(g, h) + score(g[-1] - g, h[-1] - h) - score(g[-1], h[-1])
        gain[(n < 15) | (n > len(rows) - 15)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], v, k)
    if best[1] is None:
        return out
    low = bins[rows, best[1]] <= best[2]
    for side, part in ((True, low), (False, ~low)):
        there = (*path, (best[1], best[2], side))
        found.append(there)
        out[part] = _tree(bins, grad, hess, rows[part], there, depth - 1, found)
    return out


class RuleEnsemble:
    """bias + sum of weights of the rules that hold; a rule is a tuple of (statistic, threshold, at most?)."""

    def __init__(self, bias: float, rules: list[tuple[tuple, float]]):
        self.bias, self.rules = bias, rules

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> "RuleEnsemble":
        """x: statistics, y: 0 or 1.  With one class only, or no rows, the score is the smoothed share of ones."""
        if len(y) == 0 or y.min() == y.max():
            p = (y.sum() + 0.5) / (len(y) + 1)
            return RuleEnsemble(float(np.log(p / (1 - p))), [])
        cuts = [np.unique(np.quantile(x[:, v], np.linspace(0, 1, BINS + 1)[1:-1])) for v in range(x.shape[1])]
        bins = np.column_stack([np.searchsorted(c, x[:, v], "left") for v, c in enumerate(cuts)])
        margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            margin = margin + RATE * _tree(bins, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, paths)
        paths = [p for p in dict.fromkeys(paths) if all(k < len(cuts[v]) for v, k, _ in p)]
        holds = lambda p: np.logical_and.reduce([(bins[:, v] <= k) == low for v, k, low in p])
        kept, columns, seen = [], [], set()
        for p in paths:
            c = holds(p)
            if (key := c.tobytes()) not in seen and 0 < c.sum() < len(c):
                seen.add(key)
                kept.append(p)
                columns.append(c)
        a = np.column_stack(columns).astype(float) if columns else np.zeros((len(y), 0))
        bias, w = _lasso(a, y, penalty)
        return RuleEnsemble(float(bias), [(tuple((STATISTICS[v], float(cuts[v][k]), low) for v, k, low in p), float(c)) for p, c in zip(kept, w) if c])

    def column(self) -> Column:
        """The probability of label 1, over columns named as STATISTICS."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = None
            for name, cut, low in rule:
                t = F.col(name) <= F.lit(cut) if low else F.col(name) > F.lit(cut)
                test = t if test is None else test & t
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * np.logical_and.reduce([(x[:, STATISTICS.index(s)] <= cut) == low for s, cut, low in rule])
        return 1 / (1 + np.exp(-total))


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the bias, by accelerated proximal steps."""
    n, m = a.shape
    step = 4 * n / max(1e-9, float(np.linalg.norm(np.column_stack([a, np.ones(n)]), 2)) ** 2)
    w, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w, bias, 1.0
    for _ in range(ROUNDS):
        r = 1 / (1 + np.exp(-(a @ v + vb))) - y
        w2 = v - step * (a.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t = w2, b2, t2
    return bias, w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """Fit on at most TRAIN_ROWS labels, and as many rows of docs, chosen by hashes.

    Null labels and null ids take no part.  An id and a label count once, however often they repeat; an
    id with both labels counts with each; rows of docs that repeat an id count each with its labels."""
    spark = docs.sparkSession
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_label")).where("doc_id is not null and _label is not null").distinct()
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(TRAIN_ROWS)
    known: dict[int, list[int]] = {}
    for r in picked.collect():
        known.setdefault(r["doc_id"], []).append(r["_label"])
    if not known:
        return RuleEnsemble(0.0, [])
    table = spark.createDataFrame([(d,) for d in known], "doc_id long")  # TRAIN_ROWS rows at most
    found = with_statistics(ids_and_texts(docs, id_col, text_col).join(F.broadcast(table), "doc_id", "left_semi"))
    got = found.orderBy(F.xxhash64("doc_id", *STATISTICS)).limit(TRAIN_ROWS).toArrow().to_pandas().sort_values(["doc_id", *STATISTICS], kind="stable")
    each = [known[d] for d in got["doc_id"]]
    x = np.repeat(got[STATISTICS].to_numpy(float), [len(e) for e in each], axis=0)
    return RuleEnsemble.fit(x, np.array([y for e in each for y in e], float))


def score(docs: DataFrame, rules: RuleEnsemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold), one row for
    each row of docs.  A null text is scored as an empty one; columns besides id and text are ignored."""
    scored = with_statistics(ids_and_texts(docs, id_col, text_col)).select("doc_id", rules.column().alias("score"))
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
