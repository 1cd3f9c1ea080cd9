"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation finds how far to trust each.

Rules look at statistics of one whole text and vote good (+1), bad (-1) or abstain (0). The votes are a vector of few values, so the
corpus enters the estimate as counts of vote patterns: at most 3 ** len(RULES) rows come to the driver, whatever the input's size.
The label model takes rules as independent given the class; per rule and class it has the probability of each vote, given that the rule votes. The
posterior probability of "good", not a list of tests that must all pass, decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import arrow_map, documents, materialize, texts, type_of

LEAST_WORDS, MOST_REPEATED = 50, 50
KEEP_AT = 0.5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Statistics of a text; the first five are those of the base test.
_LONG = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_distinct", "n_chars")


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + b"0123456789"
_ABOVE_ASCII = bytes(range(128, 256))


def statistics(raw: bytes) -> tuple[int, ...]:
    """The _LONG statistics of one text, over the whole of it. Letters are letters and digits of ASCII and all code points above it, capitals those of ASCII."""
    words = raw.split()
    text = raw.decode()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    repeated = 0
    if n >= 6 or n > 3 and len(set(words)) < n:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        k = len(number)
        _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)  # by pairs first: a triple of numbers may not fit a word
        _, inverse, counts = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        if (again := counts[inverse] > 1).any():
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : shift + n - 2] |= again
            repeated = int(covered.sum())
    lines = text.split("\n")
    seen = Counter(x for x in lines if x.encode().split()) if len(lines) > 1 else {}
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _LETTERS)) + (len(text) - len(raw.translate(None, _ABOVE_ASCII)))
    return n, word_chars, len(_SYMBOLS.findall(text)), sum(c - 1 for c in seen.values()), repeated, upper, letters, len(lines), len(set(words)), len(text)


def _share(part: str, of: str) -> Column:
    return F.col(f"s_{part}") / F.greatest(F.col(f"s_{of}"), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: Votes on the statistics: good, bad, else abstain.
RULES: dict[str, Callable[[], Column]] = {
    "repeats": lambda: _vote(_share("n_repeat_words", "n_words") < 0.2, _share("n_repeat_words", "n_words") > 0.4),
    "lines": lambda: _vote(_share("n_dup_lines", "n_lines") < 0.2, (F.col("s_n_dup_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
    "symbols": lambda: _vote(_share("n_symbols", "n_words") < 0.02, _share("n_symbols", "n_words") > 0.1),
    "letters": lambda: _vote(_share("n_letters", "word_chars") > 0.93, _share("n_letters", "word_chars") < 0.9),
    "capitals": lambda: _vote(_share("n_upper", "n_letters") < 0.1, _share("n_upper", "n_letters") > 0.3),
    "word_length": lambda: _vote(_share("word_chars", "n_words").between(3.0, 8.0), ~_share("word_chars", "n_words").between(2.5, 12.0)),
    "variety": lambda: _vote((F.col("s_n_words") >= 50) & (F.col("s_n_distinct") > 3 * F.sqrt("s_n_words")), (F.col("s_n_words") >= 50) & (F.col("s_n_distinct") < 2 * F.sqrt("s_n_words"))),
}


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` and the statistics s_* of each row's text, a row for each row; carry has no names of that form. A null text is empty."""
    schema = ", ".join([*(f"`{c}` {type_of(docs, c)}" for c in carry), *(f"s_{c} long" for c in _LONG)])

    def f(batch: pa.RecordBatch) -> dict:
        rows = np.array([statistics(x) for x in texts(batch)], np.int64).reshape(-1, len(_LONG))
        return {c: batch.column(c) for c in carry} | {f"s_{c}": pa.array(rows[:, i]) for i, c in enumerate(_LONG)}

    return arrow_map(docs.select(*dict.fromkeys([*carry, "text"])), f, schema)


def _votes() -> list[Column]:
    """The votes, 1 to 3 for bad, abstain and good, over columns s_*."""
    return [(rule() + 2).alias(f"v_{name}") for name, rule in RULES.items()]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how often each occurs.

    Gives the share of good texts and the probabilities [class, rule, vote] with classes bad, good and votes bad, good, given that the rule
    votes; abstaining tells nothing. It starts from
    the view that one vote for bad outweighs those for good, and stops when the log-likelihood gains less than 1e-9 of itself. Without rows: even odds.
    """
    n_rules = patterns.shape[1]
    hot = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)
    if not len(patterns):
        return 0.5, np.full((2, n_rules, 2), 0.5)
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    last = -np.inf
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        p = np.einsum("cp,prv->crv", weight, hot) + smooth
        p /= p.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + smooth) / (counts.sum() + 2 * smooth)
        logs = np.einsum("prv,crv->pc", hot, np.log(p)) + np.log([1 - prior, prior])
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        good = np.exp(logs[:, 1] - total)
        now = float(counts @ total)
        if now - last < 1e-9 * abs(now):
            break
        last = now
    return float(prior), p


def label_model(stats: DataFrame) -> tuple[float, np.ndarray]:
    """fit() over the vote patterns of all rows of with_statistics(). Patterns come in a fixed order, so that reruns agree to the bit."""
    rows = stats.select(*_votes()).groupBy(*[f"v_{x}" for x in RULES]).count().collect()  # 3 ** len(RULES) at most
    rows = sorted(tuple(r) for r in rows)
    table = np.array(rows, np.int64).reshape(-1, len(RULES) + 1)
    return fit(table[:, :-1] - 2, table[:, -1].astype(float))


def judged(stats: DataFrame, model: tuple[float, np.ndarray], keep_at: float = KEEP_AT) -> DataFrame:
    """stats with base_failed, p_good and kept."""
    prior, p = model
    log_odds = F.lit(float(np.log(prior / (1 - prior))))
    df = stats.select("*", *_votes())
    for r, name in enumerate(RULES):
        gain = np.log(p[1, r] / p[0, r])
        log_odds = log_odds + F.element_at(F.array(*[F.lit(float(x)) for x in (gain[0], 0, gain[1])]), F.col(f"v_{name}"))
    failed = (F.col("s_n_words") < LEAST_WORDS) | (100 * F.col("s_n_repeat_words") > MOST_REPEATED * F.col("s_n_words"))
    df = df.withColumns({"base_failed": failed, "p_good": 1 / (1 + F.exp(-log_odds))})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at)).drop(*[f"v_{x}" for x in RULES])


def filter_quality(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names.

    Rows are stored once with their statistics, for the corpus' vote patterns and to judge each row, so no text is shuffled or looked at twice.
    Null and empty texts have no words and are rejected; repeated rows get the same verdict; a text of any length is judged whole; an
    empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names).withColumn("text", F.col(f"c{docs.columns.index('text')}").cast("string"))
    stats = materialize(with_statistics(inner, names), "op1-rows")
    return judged(stats, label_model(stats), keep_at).where("kept").select(*names).toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good.

    A null text is empty: all counts are 0, base_failed is true. Repeated rows each get their row and one verdict; texts are read whole; an empty
    table gives an empty result; other columns are not read.
    """
    stats = materialize(with_statistics(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"]), "op1-statistics")
    out = judged(stats, label_model(stats))
    return out.select("doc_id", *[F.col(f"s_{c}").alias(c) for c in _LONG[:5]], "base_failed", "kept", "p_good")
