"""Host-level quality rules: failures of documents summed by host, shrunk rates, verdicts joined back.

One pass over the texts counts what the rules need and writes it to the shared folder.  The counts
are summed by host; for each rule the hosts' failure rates share a beta prior, fitted to all hosts by
moments, and a host's rate is the mean of its posterior, so that a host with few documents stays
near the rate of all.  A rule whose shrunk rate passes `reject` drops a host with all its documents;
one that passes `enforce` is held against each document of the host; below that, a failure is taken
for an accident of one document.  The base rules hold for every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, slices, text_buffer, word_hashes, words

#: A document that fails one of these is out, whatever its host: conditions over the counts.
BASE = {"short": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words"}
#: Those that only count by host.
RULES = BASE | {
    "symbols": "10 * n_symbols > n_words",
    "lines": "3 * n_dup_lines > n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
ENFORCE, REJECT = 0.05, 0.5
#: Hosts with more than one in so many of all rows are dealt to several tasks; there are at most so many of them.
HOT, SALTS = 200, 64
#: Bytes of text that are counted at a time.
PIECE = 2 << 20
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACES = " \t\n\x0b\x0c\r"

_SYMBOL, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)], _SPACE[list(_SPACES.encode())] = True, True


def host_of_url(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a leading www.; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(host, r"^www\.|\.$", "")
    return F.when(host != "", host)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only: by hashes, which are compared byte by byte with the first word that has the same."""
    _, first, ids = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, twin = ends - starts, first[ids]
    same = bool((sizes == sizes[twin]).all())
    for a in range(0, len(starts), 1 << 16):
        if not same:
            break
        n = sizes[a : a + (1 << 16)]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = bool((data[np.repeat(starts[a : a + len(n)], n) + step] == data[np.repeat(starts[twin[a : a + len(n)]], n) + step]).all())
    if same:
        return ids
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends)])


def repeated_words(ids: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text the number of words in windows of `size` words that occur twice or more in that text.

    ids: the words of all texts; first: per text the index of its first word (n+1)."""
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(texts[: max(0, len(ids) - size + 1)] == texts[size - 1 :])
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    keys = texts[at]
    for k in range(size):  # as small numbers, so that no product leaves 64 bits
        keys = np.unique(keys * (int(ids.max()) + 1) + ids[at + k], return_inverse=True)[1]
    at = at[np.bincount(keys)[keys] > 1]
    cover = np.zeros(len(ids) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _line_counts(text: str | None) -> tuple[int, int]:
    """Lines with a word, and how many of them are equal to an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def _count(batches):
    for batch in batches:
        for piece in slices(batch, "text", PIECE):
            data, offsets = text_buffer(piece.column("text"))
            starts, ends, first = words(data, offsets)
            below = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            lead = ((data & 0xC0) != 0x80) & ~_SPACE[data]
            lines = np.array([_line_counts(t.as_py()) for t in piece.column("text")], np.int64).reshape(-1, 2)
            got = {
                "n_words": np.diff(first),
                "word_chars": below(lead),
                "n_symbols": below(_SYMBOL[data]),
                "n_dup_lines": lines[:, 1],
                "n_repeat_words": repeated_words(word_ids(data, starts, ends), first) if len(starts) else np.zeros(piece.num_rows, np.int64),
                "n_lines": lines[:, 0],
            }
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("host"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "host", *COUNTS])


def count(docs: DataFrame, host: Column | str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host and the counts of each row's whole text: n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word)."""
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, _count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def beta_prior(n_hosts: int, rows: int, failed: int, squares: float, weighted: float) -> tuple[float, float]:
    """Both parameters of the beta distribution of the hosts' rates, by moments.

    squares: sum of rows squared; weighted: sum of failed squared over rows, of all hosts.  The
    spread of the rates beyond chance is the intraclass correlation 1 / (a + b + 1); it is held
    between 1e-6 (all hosts alike) and 0.999 (each for itself).  Without a failure or a pass nothing
    can be told about the spread, and the rate of all holds."""
    p = failed / rows
    chance = n_hosts - 1
    room = rows - squares / rows - chance
    spread = (weighted - failed * p) / (p * (1 - p)) - chance if 0 < p < 1 and room > 0 else 0.0
    rho = min(max(spread / room if room > 0 else 0.0, 1e-6), 0.999)
    return p * (1 / rho - 1), (1 - p) * (1 / rho - 1)


def host_rates(counted: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """host, rows, and for each rule failed_<rule>, rate_<rule>: documents that fail it, and the shrunk rate.

    Rows without host belong to none.  Only the sums over all hosts, one row, reach the driver."""
    rules = RULES if rules is None else rules
    hosts = counted.where("host is not null").groupBy("host").agg(F.count("*").alias("rows"), *(F.count_if(F.expr(c)).alias(f"failed_{r}") for r, c in rules.items()))
    hosts = materialize(hosts)
    real = lambda c: F.col(c).cast("double")
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("rows").alias("rows"), F.sum(real("rows") * real("rows")).alias("squares"),
                     *(F.sum(f"failed_{r}").alias(f"failed_{r}") for r in rules), *(F.sum(real(f"failed_{r}") * real(f"failed_{r}") / real("rows")).alias(f"weighted_{r}") for r in rules)).first()
    if not sums["rows"]:
        return hosts.select("*", *(F.lit(0.0).alias(f"rate_{r}") for r in rules))
    prior = {r: beta_prior(sums["hosts"], sums["rows"], sums[f"failed_{r}"], sums["squares"], sums[f"weighted_{r}"]) for r in rules}
    return hosts.select("*", *(((F.col(f"failed_{r}") + F.lit(a)) / (F.col("rows") + F.lit(a + b))).alias(f"rate_{r}") for r, (a, b) in prior.items()))


def judge(docs: DataFrame, host: Column | str = "source", rules: dict[str, str] | None = None, base: dict[str, str] | None = None, enforce: float = ENFORCE, reject: float = REJECT, **columns) -> DataFrame:
    """doc_id, the counts, base_failed, host_rejected, kept of every row.

    rules and base: conditions over the counts by name; base ones hold for every document.  kept:
    no base rule failed, the host is not rejected, and no rule failed that is enforced on the host.
    A null text has no words; rows without host are judged by the base rules alone; rows that repeat
    an id are judged each.  Other columns of docs can have any name.  An empty table gives no rows.
    """
    rules, base = RULES if rules is None else rules, BASE if base is None else base
    counted = materialize(count(docs, host, **columns))
    rates = host_rates(counted, rules)
    any_of = lambda conditions: F.expr(" or ".join(f"({c})" for c in conditions) or "false")
    rejected = any_of(f"rate_{r} > {reject!r}D" for r in rules)
    enforced = F.array_compact(F.array(*(F.when(F.expr(f"rate_{r} > {enforce!r}D"), F.lit(r)) for r in rules))) if rules else F.array().cast("array<string>")
    verdicts = rates.select(F.col("host").alias("_host"), "rows", rejected.alias("host_rejected"), enforced.alias("_enforced"))
    # a host with a large share of all rows meets its verdict in several tasks
    total = rates.agg(F.sum("rows")).first()[0] or 0
    hot = [r[0] for r in rates.where(F.col("rows") * HOT > total).select("host").collect()]  # fewer than HOT
    spread = lambda c: c.isin(hot) if hot else F.lit(False)
    copies = verdicts.select("*", F.explode(F.when(spread(F.col("_host")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_part"))
    rows = counted.withColumn("_salt", F.when(spread(F.col("host")), F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = rows.join(copies, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left")
    fails = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(r)) for r, c in rules.items()))) if rules else F.array().cast("array<string>")
    joined = joined.withColumn("base_failed", any_of(base.values())).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    held = F.coalesce(F.arrays_overlap(fails, F.col("_enforced")), F.lit(False))
    return joined.select("doc_id", *COUNTS, "base_failed", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected") & ~held).alias("kept"))
