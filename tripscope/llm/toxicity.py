"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses at sentence punctuation and line ends. A lexicon maps each word to a symbol (insult, threat, target, negation,
report verb, other) and a weight. Four small transducers read the symbols one after the other, each rewriting what the one before it
wrote: ``negation`` marks insults and threats in its scope, ``reported`` marks what follows a report verb, ``aimed`` joins insults with a
target nearby, ``menace`` joins threats with one. They are composed into one deterministic machine when the grammar is built, so a clause
is read once. What the machine accepts is a weighted match; words outside a match count nothing. The matches of a text, by kind, give its
features, and a logistic regression over these its score.

Insults are the seeds below and words or word beginnings learned from labelled rows: those found in toxic rows at least ``MIN_LIFT`` times
as often as in others, on evidence that chance rarely gives. Labels are read only of rows whose CRC32 of the id is not a multiple of five, and of at most about
``max_rows`` of those (drawn by a hash of the id); lexicon and weights are small and go with the tasks. Scoring reads every text whole, once,
without a shuffle.

Defined cases: a null or empty text has no match and gets the score of such texts; rows with a null or repeated id are scored like any
other (a null id counts as held out); without labels of both kinds the seeds and ``DEFAULT`` weights are used; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripscope.llm.common import documents, table, written
from tripscope.plans.registry import Book

BOOK = Book()
FOLDS = 5
MAX_ROWS = 20_000
MIN_LIFT = 10.0
MIN_EVIDENCE = 30.0
MIN_ROWS = 4
MAX_TERMS = 50_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons loser losers scum clown clowns trash stupid pathetic worthless disgusting imbecile fool fools dumb filth garbage vermin scumbag coward jerk",
    THREAT: "kill hurt destroy beat burn smash crush shoot stab punch strangle attack hunt",
    TARGET: "you your yours yourself he she they them these those this that is are du ihr sie dich euch tu vous te ellos ustedes eres sois es",
    NEGATION: "not no never neither nor isn aren wasn don nicht kein keine nie pas jamais non nunca ni",
    REPORT: "said says say wrote writes called calls claimed claims quoted reported sagte schrieb behauptet dit disait écrit dijo dice escribió",
}
SEED_WEIGHT = 3.0
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Step(NamedTuple):
    state: int
    symbol: str
    weight: float


class Transducer(NamedTuple):
    """``rules[state, symbol]`` where given, else ``fade`` to the next state with the symbol passed on."""

    rules: dict[tuple[int, str], Step]
    fade: dict[int, int]

    def step(self, state: int, symbol: str) -> Step:
        return self.rules.get((state, symbol), Step(self.fade.get(state, state), symbol, 1.0))


def _scope(opener: str, width: int, marked: dict[str, str], weight: float) -> Transducer:
    """After ``opener``, symbols within ``width`` words are rewritten; width 0 reaches to the end of the clause."""
    rules = {}
    last = max(width, 1)
    for state in range(last + 1):
        rules[state, opener] = Step(last, opener, 1.0)
        if state:
            after = state - 1 if width else state
            rules.update({(state, a): Step(after, b, weight) for a, b in marked.items()})
    return Transducer(rules, {s: s - 1 for s in range(1, last + 1)} if width else {})


def _joined(word: str, other: str, width: int, out: str, weight: float) -> Transducer:
    """``word`` within ``width`` words of ``other``, in either order, becomes ``out``."""
    rules, near_other, near_word = {}, width, 2 * width
    for state in range(2 * width + 1):
        rules[state, other] = Step(near_other, out + "-after" if state > width else other, weight)
        rules[state, word] = Step(near_word, out if 0 < state <= width else word, weight if 0 < state <= width else 1.0)
    fade = {s: 0 if s in (1, width + 1) else s - 1 for s in range(1, 2 * width + 1)}
    return Transducer(rules, fade)


NAMES = {OTHER: "other", INSULT: "insult", THREAT: "threat", TARGET: "target", NEGATION: "negation", REPORT: "report"}
GRAMMAR = [
    _scope("negation", 3, {"insult": "negated", "threat": "negated"}, 0.5),
    _scope("report", 0, {"insult": "reported", "threat": "reported"}, 0.7),
    _joined("insult", "target", 4, "aimed", 1.5),
    _joined("threat", "target", 3, "menace", 1.5),
]
KINDS = ["insult", "aimed", "aimed-after", "menace", "menace-after", "threat", "negated", "reported"]


def compose(parts: list[Transducer]) -> dict[tuple[int, int], tuple[int, int, float]]:
    """(state, word symbol) -> (state, kind or -1, weight) of the machine that runs ``parts`` in a row."""
    number = {(0,) * len(parts): 0}
    queue, table_ = deque(number), {}
    while queue:
        state = queue.popleft()
        for word, symbol in NAMES.items():
            weight, after = 1.0, []
            for part, at in zip(parts, state):
                step = part.step(at, symbol)
                after.append(step.state)
                symbol, weight = step.symbol, weight * step.weight
            after = tuple(after)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            table_[number[state], word] = (number[after], KINDS.index(symbol) if symbol in KINDS else -1, weight)
    return table_


class Lexicon(dict):
    """(symbol, weight) by word; words not listed are looked up by their learned beginnings and remembered up to a bound."""

    BOUND = 500_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.stems, self.spans = stems, sorted({len(s) for s in stems})
        self.words = {w: (symbol, SEED_WEIGHT if symbol in (INSULT, THREAT) else 1.0) for symbol, listed in SEEDS.items() for w in listed.split()}
        self.words.update({w: (INSULT, weight) for w, weight in words.items()})

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.BOUND:
            self.clear()
        found = self.words.get(word)
        if found is None:
            found = max(((INSULT, self.stems[word[:n]]) for n in self.spans if word[:n] in self.stems), default=(OTHER, 0.0), key=lambda x: x[1])
        self[word] = found
        return found


class Grammar:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.lexicon, self.machine = Lexicon(words, stems), compose(GRAMMAR)

    def matches(self, text: str | None) -> np.ndarray:
        """Summed weight of the matches of each kind, then the weight of the heaviest clause."""
        out = np.zeros(len(KINDS) + 1)
        if not text:
            return out
        lexicon, machine, low = self.lexicon, self.machine, text.lower()
        if not any([0 < lexicon[w][0] <= THREAT for w in _WORD.findall(low)]):
            return out
        for clause in _CLAUSE.split(low):
            state, total, carried = 0, 0.0, 0.0
            for word in _WORD.findall(clause):
                symbol, own = lexicon[word]
                state, kind, weight = machine[state, symbol]
                if symbol in (INSULT, THREAT):
                    carried = own
                if kind >= 0:
                    value = weight * (own if symbol in (INSULT, THREAT) else 0.3 * carried)
                    out[kind] += value
                    total += value if KINDS[kind] not in ("negated", "reported") else value / 2
            out[-1] = max(out[-1], total)
        return out


def _features(matched: np.ndarray) -> np.ndarray:
    return np.log1p(matched)


class Model(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]  # of the features, then the intercept


DEFAULT = [1.5, 1.5, 0.5, 1.0, 0.5, 0.2, 0.1, 0.3, 1.0, -3.0]


def _terms(text: str | None) -> set[str]:
    """Words, and beginnings of 3 to 8 letters marked with a star."""
    words = set(_WORD.findall((text or "").lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in range(3, min(9, len(w)))}


def _counted(wanted: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column("text").to_pylist():
                count.update(_terms(text) if wanted is None else _terms(text) & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])

    return run


def _evidence(a: int, of_a: int, b: int, of_b: int) -> float:
    """Log-likelihood ratio of two shares; 30 keeps chance finds among ``MAX_TERMS`` terms rare."""
    both = (a + b) / (of_a + of_b)
    return 2 * sum(seen * np.log(seen / (of * share)) for n, of in ((a, of_a), (b, of_b)) for seen, share in ((n, both), (of - n, 1 - both)) if seen)


def in_fold(id_col: str = "doc_id", folds: int = FOLDS):
    """Whether a row is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits lexicon and weights on a bounded sample of the labelled rows that are not held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~in_fold()).distinct()
    total = known.count()
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    # At most about max_rows rows of two numbers.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"), "labelled").repartition(max(1, min(total, max_rows) // 1000 + 1), "doc_id")
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not rows.get(0) or not rows.get(1):
        return Model({}, {}, DEFAULT)
    least = max(MIN_ROWS, rows[1] // 250)
    schema = "term string, n long"
    often = (
        sample.filter("toxic = 1").select("text").mapInArrow(_counted(None), schema).groupBy("term").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(MAX_TERMS)
    )
    toxic = {r["term"]: r["n"] for r in often.collect()}
    clean = {r["term"]: r["n"] for r in sample.filter("toxic = 0").select("text").mapInArrow(_counted(set(toxic)), schema).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    words, stems = {}, {}
    for term, n in toxic.items():
        lift = (n / rows[1]) / ((clean.get(term, 0) + 0.5) / rows[0])
        if lift >= MIN_LIFT and _evidence(n, rows[1], clean.get(term, 0), rows[0]) >= MIN_EVIDENCE:
            (stems if term[-1] == "*" else words)[term.rstrip("*")] = float(np.log(lift))
    grammar = Grammar(words, stems)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_features(grammar.matches(t)).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    fit = sample.mapInArrow(measured, "toxic int, x array<double>").toPandas()
    return Model(words, stems, _logistic(np.array(fit["x"].tolist()), fit["toxic"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, weights = Grammar(model.words, model.stems), np.array(model.weights)
        for batch in batches:
            x = np.array([_features(grammar.matches(t)) for t in batch.column("text").to_pylist()]).reshape(-1, len(KINDS) + 1)
            z = x @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    model = learn(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, weights = Grammar(model.words, model.stems), np.array(model.weights)
        at = names.index("text")
        for batch in batches:
            x = np.array([_features(grammar.matches(t)) for t in batch.column(at).to_pylist()]).reshape(-1, len(KINDS) + 1)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


@BOOK.query("op6_transducer_toxicity")
def transducer_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, as ``labels.toxic`` marks it."""
    docs = documents(spark, sf_dir)
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
