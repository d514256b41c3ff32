"""Toxicity: a learned lexicon, found despite misspelling, and scored in its context."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.words import WORD, chunks, field_types, remainder, texts_of, with_columns
from galley.session import stage

#: Labelled rows a model is fitted on, those with the smallest hashes of their ids; the rest only get scores.
FIT_ROWS = 20_000
#: Terms of the lexicon at most.
MAX_TERMS = 2_000
#: Least log-likelihood ratio of a term (a chance of about 1e-7) and least share of toxic among its documents.
MIN_EVIDENCE = 28.0
MIN_SHARE = 0.6
#: Shorter words must match exactly, longer ones may have one edit.
EDIT_LENGTH = 5
#: Words on either side of a hit that tell quotation from abuse.
CONTEXT = 8
#: Words whose hits a worker remembers before it starts over.
MEMORY = 100_000
EDGES = ".,;:!?\"'()[]{}<>*$%&#|`~_-+=/\\«»“”„‘’…"
OPENING, CLOSING = "\"'«“„‘(", "\"'»”’)"
REPORTING = frozenset(
    "said says wrote writes called quote quoted word term dit écrit appelé sagte schrieb nannte dijo escribió llamó".split()
)
ADDRESS = frozenset("you your you're u ur tu toi vous du dich dir ihr tú usted te".split())
FEATURES = ("exact", "fuzzy", "terms", "density", "strongest", "misspelled_share")


class LexiconAutomaton:
    """Levenshtein automata of a lexicon run over its trie, made deterministic as words need it.

    A state is a set of (trie node, edits so far, letter a swap still waits for). Reading a letter
    matches, replaces, skips or swaps it, or passes a trie letter by. Each transition is worked out
    once; a word then costs one lookup per letter until no term can match any more.
    """

    MAX_STATES = 50_000

    def __init__(self, terms: list[str], max_edits: int = 1):
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.terms = terms
        self.max_edits = max_edits
        for number, term in enumerate(terms):
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                node = self.children[node][letter]
            self.term_at[node] = number
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.members: list[frozenset] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _closed(self, items: set) -> frozenset:
        """With trie letters passed by, and without what costs more than needed."""
        best: dict[tuple[int, str], int] = {}
        waiting = list(items)
        while waiting:
            node, edits, swap = waiting.pop()
            if best.get((node, swap), self.max_edits + 1) <= edits:
                continue
            best[node, swap] = edits
            if edits < self.max_edits and not swap:
                waiting += [(child, edits + 1, "") for child in self.children[node].values()]
        return frozenset((node, edits, swap) for (node, swap), edits in best.items())

    def _state(self, items: set) -> int:
        if not items:
            return -1
        members = self._closed(items)
        if members not in self.number:
            self.number[members] = len(self.steps)
            self.steps.append({})
            self.members.append(members)
            found = [(e, self.term_at[n]) for n, e, swap in members if n in self.term_at and not swap]
            found = [(e, t) for e, t in found if e == 0 or len(self.terms[t]) >= EDIT_LENGTH]
            self.accepts.append(min(found) if found else None)
        return self.number[members]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, edits, swap in self.members[state]:
            if swap:
                if swap == letter:
                    after.add((node, edits, ""))
                continue
            children = self.children[node]
            if letter in children:
                after.add((children[letter], edits, ""))
            if edits < self.max_edits:
                after.add((node, edits + 1, ""))
                for other, child in children.items():
                    if other != letter:
                        after.add((child, edits + 1, ""))
                        if letter in self.children[child]:
                            after.add((self.children[child][letter], edits + 1, other))
        found = self._state(after)
        self.steps[state][letter] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term within the allowed edits; the first of equal ones."""
        if len(self.steps) > self.MAX_STATES:
            self._reset()
        state = self.start
        for letter in word:
            after = self.steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state < 0:
                return None
        return self.accepts[state]


def clean_word(word: str) -> str:
    return word.lower().strip(EDGES)


def context_score(words: list[str], at: int) -> float:
    """1 for plain use; half inside quotation marks or near a reporting verb; more when it addresses someone."""
    before, after = words[max(0, at - CONTEXT) : at + 1], words[at : at + CONTEXT + 1]
    around = {clean_word(word) for word in before + after}
    quoted = any(w[0] in OPENING for w in before) and any(w[-1] in CLOSING for w in after)
    score = 0.5 if quoted or around & REPORTING else 1.0
    return score * 1.5 if not quoted and around & ADDRESS else score


class Featurizer:
    """What a text shows of the lexicon."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        self.weights = [weight for _, weight in lexicon]
        self.automaton = LexiconAutomaton([term for term, _ in lexicon])
        self.known: dict[str, tuple[int, int] | None] = {}

    def _match(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.match(clean_word(word))
        self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        known, match = self.known, self._match
        if len(known) > MEMORY:
            known.clear()
        hits = [(at, hit) for at, word in enumerate(words) if (hit := known[word] if word in known else match(word))]
        if not hits:
            return [0.0] * len(FEATURES)
        scores = [context_score(words, at) for at, _ in hits]
        exact = sum(s for s, (_, (edits, _)) in zip(scores, hits, strict=True) if not edits)
        fuzzy = sum(s for s, (_, (edits, _)) in zip(scores, hits, strict=True) if edits)
        terms = len({term for _, (edits, term) in hits if not edits})
        strongest = max(s * self.weights[t] / (1 + e) for s, (_, (e, t)) in zip(scores, hits, strict=True))
        density = 100 * (exact + fuzzy / 2) / len(words)
        return [math.log1p(exact), math.log1p(fuzzy), float(terms), math.log1p(density), strongest, fuzzy / (exact + fuzzy)]


@dataclass(frozen=True)
class ToxicityModel:
    """A lexicon with its weights and a logistic model over FEATURES."""

    lexicon: list[tuple[str, float]]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        linear = (features - self.center) / self.scale @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(linear, -30, 30)))


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple:
    """Center, scale, weights and intercept by Newton steps."""
    center, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale == 0] = 1.0
    x = np.column_stack([(features - center) / scale, np.ones(len(features))])
    penalty = np.diag([ridge] * features.shape[1] + [1e-6])
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - penalty @ weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, weights[:-1], float(weights[-1])


def _sketch(words: list[str]) -> int:
    """The smallest hash of three-word shingles; near copies mostly share it."""
    from xxhash import xxh3_64_intdigest

    size = min(3, len(words))
    return min((xxh3_64_intdigest(" ".join(words[i : i + size])) for i in range(len(words) - size + 1)), default=0) >> 1


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = [WORD.findall(text) for text in texts_of(batch.column(0))]
        sets = [sorted({w for w in map(clean_word, found) if len(w) > 2}) for found in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(map(_sketch, words)), pa.int64()), batch.column(1), pa.array(sets, pa.list_(pa.string()))],
            names=["sketch", "toxic", "words"],
        )


def _lexicon(labelled: DataFrame) -> list[tuple[str, float]]:
    """Words that mark toxic documents beyond chance; near copies of a document count once."""
    rows = labelled.select("text", "toxic").mapInArrow(_word_rows, "sketch long, toxic int, words array<string>")
    distinct = rows.groupBy("sketch").agg(F.max_by("toxic", F.struct("toxic", "words")).alias("toxic"),
                                          F.max(F.struct("toxic", "words")).getField("words").alias("words"))
    totals = distinct.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    if not 0 < totals.toxic < totals.n:
        return []
    counted = distinct.select("toxic", F.explode("words").alias("word")).groupBy("word")
    counted = counted.agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    rate = F.lit(totals.toxic / totals.n)
    rest = F.col("n") - F.col("t")
    share = F.col("t") / F.col("n")
    evidence = 2 * (
        F.col("t") * F.log(share / rate) + F.when(rest > 0, rest * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    )
    odds = F.log((F.col("t") + 0.5) / (rest + 0.5)) - F.log(rate / (1 - rate))
    chosen = counted.filter((share >= MIN_SHARE) & (share > rate)).withColumn("evidence", evidence)
    chosen = chosen.filter(F.col("evidence") >= MIN_EVIDENCE).orderBy(F.desc("evidence"), "word").limit(MAX_TERMS)
    return sorted((row.word, row.odds) for row in chosen.select("word", odds.alias("odds")).collect())


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, work_folder: str | None = None
) -> ToxicityModel:
    """Learn from labelled documents that are not held out, at most ``fit_rows`` of them.

    Null labels, ids or texts are left out; of several labels of a document the largest counts.
    Without rows of both kinds the model has no lexicon and scores every text 0.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(remainder(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    labelled = documents.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id")
    labelled = stage(labelled, "labelled", work_folder)
    lexicon = _lexicon(labelled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(lexicon)
        for batch in chunks(batches):
            rows = [featurizer.features(text) for text in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["features", "toxic"]
            )

    rows = labelled.select("text", "toxic").mapInArrow(run, "features array<double>, toxic int").collect() if lexicon else []
    size = len(FEATURES)
    if not rows:
        return ToxicityModel([], np.zeros(size), np.ones(size), np.zeros(size), -30.0)
    features = np.array([row.features for row in rows])
    return ToxicityModel(lexicon, *fit_logistic(features, np.array([row.toxic for row in rows], dtype=float)))


def with_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents with a column ``score`` from 0 to 1, from the text alone.

    Each row is scored where it is read; nothing is shuffled, and a task holds the lexicon and a
    bounded memory of words. Null and empty texts get the score of a text without hits. Repeated
    rows get equal scores, and long texts are read whole.
    """
    schema = field_types(documents, ["score"]) + ", score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(model.lexicon)
        for batch in chunks(batches):
            texts = texts_of(batch.column(batch.schema.get_field_index("text")))
            features = np.array([featurizer.features(text) for text in texts]).reshape(len(texts), len(FEATURES))
            yield with_columns(batch, {"score": pa.array(model.scores(features), pa.float64())})

    return documents.mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``, fitted on ``labels``."""
    model = fit_toxicity(documents, labels, **options)
    scored = with_toxicity(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
