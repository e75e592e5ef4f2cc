"""Quality scores by a sparse rule ensemble.

Statistics of a whole text (lengths, shares of character kinds, repetition) are worked out once per document. Shallow
boosted trees are grown on labelled statistics; every path from a root is a rule, a conjunction of comparisons. A
lasso logistic regression over the rules keeps few of them, and those compile into one Spark column expression over
the statistics, so scoring all documents is a projection inside code generation.

The ensemble is fitted on at most about ``SAMPLE`` labelled documents, dealt by a hash of the id (a documented bound);
statistics and scores cover all.

Defined results: null texts count as empty and are scored like any text; a document labelled more than once has the
mean of its labels, rounded up; labels that are null teach nothing; without labels, or with labels of one kind only,
all scores are the smoothed share of label 1; a null id is not held out and teaches nothing; repeated rows get
repeated results, and of rows under one id the least statistics teach; equal statistics get equal scores; very long texts
are read whole, a part at a time; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import arrow_rows, written

SAMPLE, TREES, DEPTH, RATE, BINS, LEAF = 20_000, 40, 3, 0.3, 32, 20
#: Weight of the lasso penalty against the mean loss, and rounds of the proximal gradient.
PENALTY, ROUNDS = 5e-4, 400
#: Characters of a text that are taken apart at once, and where parts may end.
PART, BLANK = 1 << 20, re.compile(r"\s")
#: Kinds of characters that are counted.
KINDS = ("lower", "upper", "other_letter", "digit", "mark", "symbol", "blank", "line")
MARKS = frozenset(".,;:!?'\"()-")
STATS = ("chars", "words", "lines", "word_length", "line_words", "upper_share", "letter_share", "digit_share", "mark_share", "symbol_share", "shout_share", "repeat_share", "distinct_share", "top_share", "line_copies", "ended_share")
_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of each code point."""
    if not _KIND:
        table = np.full(0x110000, KINDS.index("symbol"), dtype=np.uint8)
        by = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 6, "Cc": 6}
        for cp in range(0x110000):
            if (kind := by.get(unicodedata.category(chr(cp)))) is not None:
                table[cp] = kind
        table[[ord(c) for c in MARKS]] = 4
        table[10] = 7
        _KIND.append(table)
    return _KIND[0]


def parts(text: str, wide: int = 0) -> Iterator[str]:
    """A text in parts of about ``wide`` characters that end before white space, so that no word is cut."""
    at, wide = 0, wide or PART
    while at < len(text):
        m = BLANK.search(text, at + wide)
        yield text[at : m.start() if m else len(text)]
        at = m.start() if m else len(text)


def statistics(text: str | None) -> tuple[float, ...]:
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    by_kind, counts, again, n_words, last = np.zeros(8, dtype=np.int64), Counter(), 0, 0, None
    for part in parts(text):
        by_kind += np.bincount(kinds()[np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)], minlength=8)
        words = part.split()
        if words:
            counts.update(words)
            again += sum(map(operator.eq, words, words[1:])) + (words[0] == last)
            n_words, last = n_words + len(words), words[-1]
    lower, upper, other, digit, mark, symbol, _, _ = by_kind.tolist()
    letters, shown = lower + upper + other, max(1, lower + upper + other + digit + mark + symbol)
    n = max(1, n_words)
    return (
        float(len(text)), float(n_words), float(len(lines)), shown / n, n_words / max(1, len(lines)),
        upper / max(1, letters), letters / shown, digit / shown, mark / shown, symbol / shown, text.count("!") / n,
        again / n, len(counts) / n, max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines) / max(1, len(lines)),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the statistics of every row's whole text."""
    import pyarrow as pa

    schema = T.StructType([docs.schema[id_col], *(T.StructField(s, T.DoubleType()) for s in STATS)])

    def run(batches):
        for part in arrow_rows(batches):
            rows = np.array([statistics(t.as_py()) for t in part.column(1)], dtype=np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(rows[:, c]) for c in range(len(STATS)))], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


@dataclass
class Rules:
    """A fitted ensemble: rules are tuples of (statistic, is above, bound); a linear term over them."""

    bias: float
    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for name, above, bound in rule:
                part = F.col(name) > bound if above else F.col(name) <= bound
                holds = part if holds is None else holds & part
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests."""
        total = np.full(len(rows), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holding(rows, rule)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def holding(rows: np.ndarray, rule) -> np.ndarray:
    held = np.ones(len(rows), dtype=bool)
    for name, above, bound in rule:
        value = rows[:, STATS.index(name)]
        held &= value > bound if above else value <= bound
    return held


def grow(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> tuple[list, np.ndarray]:
    """One tree by second-order gain: the rules of all its paths, and the value of the leaf of each row."""
    paths, value = [], np.zeros(len(slope))
    stack = [((), np.arange(len(slope)), 0)]
    while stack:
        path, at, depth = stack.pop()
        if path:
            paths.append(path)
        g, h = slope[at].sum(), curve[at].sum()
        best = (1e-6, None, None)
        for c, edges in enumerate(cuts) if depth < DEPTH and len(at) >= 2 * LEAF else ():
            if not len(edges):
                continue
            b = binned[at, c]
            n = np.bincount(b, minlength=len(edges) + 1).cumsum()[:-1]
            gl, hl = (np.bincount(b, x[at], minlength=len(edges) + 1).cumsum()[:-1] for x in (slope, curve))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAF) | (len(at) - n < LEAF)] = 0
            if gain[k := int(gain.argmax())] > best[0]:
                best = (gain[k], c, k)
        if best[1] is None:
            value[at] = -g / (h + 1)
            continue
        _, c, k = best
        above = binned[at, c] > k
        stack += [((*path, (STATS[c], bool(side), float(cuts[c][k]))), at[above == side], depth + 1) for side in (False, True)]
    return paths, value


def lasso(held: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights under an absolute penalty, by accelerated proximal gradient; the bias is free."""
    n, r = held.shape
    x = np.concatenate([held, np.ones((n, 1), dtype=held.dtype)], axis=1)
    probe = np.ones(r + 1, dtype=x.dtype)
    for _ in range(20):
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / max(1e-9, float(probe @ (x.T @ (x @ probe))))
    w, ahead, t = np.zeros(r + 1), np.zeros(r + 1), 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50)))
        new = ahead - step * (x.T @ (p - labels)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * PENALTY)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return float(w[-1]), w[:-1]


def fit(rows: np.ndarray, labels: np.ndarray) -> Rules:
    """The ensemble for statistics (in the order of STATS) and labels 0 or 1."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        return Rules(bias)
    cuts = [np.unique(np.quantile(rows[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(rows.shape[1])]
    cuts = [e[e < rows[:, c].max()] for c, e in enumerate(cuts)]
    binned = np.stack([np.searchsorted(e, rows[:, c], side="left") for c, e in enumerate(cuts)], axis=1)
    total, found = np.full(len(labels), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        paths, value = grow(binned, cuts, p - labels, p * (1 - p))
        total += RATE * value
        for path in paths:
            found.setdefault(tuple(sorted(set(path))))
    rules = list(found)
    held = np.stack([holding(rows, r) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(rows), 0), np.float32)
    bias, weights = lasso(held, labels)
    keep = np.flatnonzero(np.abs(weights) > 1e-6)
    return Rules(bias, [rules[k] for k in keep], [float(weights[k]) for k in keep])


def learn(stats: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Rules:
    """Fit on the documents of ``stats`` whose label may be used. The driver gets about ``sample`` short rows."""
    known = labels.where(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("_label"))
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col("_id").cast("string")), 11) / F.lit(float(1 << 53))
    rows = stats.join(known.where(draw < F.lit(sample / max(1, n))), F.col(id_col) == F.col("_id"))
    # one row an id, however often it is repeated: the driver gets no more
    rows = rows.groupBy("_id", "_label").agg(F.min(F.struct(*STATS)).alias("_stats")).collect()
    rows.sort(key=lambda r: r["_id"])
    return fit(np.array([list(r["_stats"]) for r in rows], dtype=np.float64).reshape(-1, len(STATS)), np.array([r["_label"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, labels: DataFrame, out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted; ``out`` says of an id whether it is held out."""
    stats = written(measured(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels, ~out, id_col, label_col)
    scored = stats.select(id_col, out.alias("held_out"), rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
