"""Language-model scores: add-one unigrams, and a hashed maximum-entropy model over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from galley.llm.words import chunks, remainder, texts_of
from galley.session import stage

#: The token that ends a text; no word is empty.
END = b""
#: Words whose counts every task holds at most (16 bytes each). Counts of all others come by a join.
HELD_WORDS = 500_000
#: Frequent words that are outcomes of the model themselves.
OWN_WORDS = 503
#: All other words fall into classes by their ending.
ENDINGS = 72
#: The softmax picks one of GROUPS groups, then one of SIZE outcomes in it.
GROUPS = 24
SIZE = 24
#: Buckets the context features are hashed into.
BUCKETS = 4096
FEATURES = 4
#: Rounds of updates; together they look at every position once.
ROUNDS = 2
RATE = 0.3
MINIBATCH = 4096
#: Tasks that train side by side.
TRAINERS = 64
#: Pieces the weights travel in.
PIECES = 48
CHUNK = 256
#: Logits up to this size are raised to e as they are.
SAFE = 60.0
#: Words a task counts, or knows by number, before it starts anew, and the bytes of those it knows.
COUNTED_WORDS = 200_000
KNOWN_WORDS = 200_000
KNOWN_BYTES = 1 << 24


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """64 bits of each word, as signed numbers."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64).view(np.int64)


def word_hash(word: bytes) -> int:
    """64 bits of a word, as a signed number."""
    return int(word_hashes([word])[0])


def ending_classes(words: Iterable[bytes]) -> np.ndarray:
    """A class from the last four bytes of each word without its punctuation."""
    return word_hashes(word.rstrip(b".,;:!?*$%&#|\"')")[-4:] for word in words) % ENDINGS


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes are split at the six ASCII blanks of the word rule."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(documents: DataFrame) -> DataFrame:
    """(hash, class, n) of every token of ``documents(text)``, ends included.

    A task adds up its counts and hands them on when it holds COUNTED_WORDS words.
    """

    def rows_of(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "hash": pa.array(word_hashes(counts)),
            "class": pa.array(ending_classes(counts).astype(np.int32)),
            "n": pa.array(counts.values(), pa.int64()),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in chunks(batches, CHUNK):
            for text in texts_of(batch.column(0)):
                counts.update(words_of(text))
            counts[END] += batch.num_rows
            if len(counts) > COUNTED_WORDS:
                yield rows_of(counts)
                counts.clear()
        yield rows_of(counts)

    rows = documents.select("text").mapInArrow(run, "hash long, class int, n long")
    return rows.groupBy("hash").agg(F.max("class").alias("class"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """What every task knows of the training tokens."""

    tokens: int
    distinct: int
    hashes: np.ndarray  # of held words, sorted
    counts: np.ndarray
    outcomes: np.ndarray  # of held words: own outcome, or -1
    class_tokens: np.ndarray
    class_words: np.ndarray
    outcome_counts: np.ndarray

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places of held words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def gather_counts(vocabulary: DataFrame, held_words: int = HELD_WORDS) -> tuple[Counts, int]:
    """Totals, the counts of the most frequent words, and the count below which words are not held.

    The limit comes from a histogram of counts with a few hundred bins, so at most ``held_words``
    rows come to the driver.
    """
    bin_of = F.floor(F.log2("n") * 16).cast("int")
    bins = vocabulary.groupBy(bin_of.alias("bin")).agg(
        F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")
    )
    held, limit, tokens, distinct = 0, None, 0, 0
    for row in sorted(bins.collect(), key=lambda row: -row.bin):
        tokens, distinct = tokens + row.tokens, distinct + row.words
        held += row.words
        if held <= held_words:
            limit = row.least
    limit = limit if limit is not None else 1 << 62
    frequent = vocabulary.filter(F.col("n") >= limit).select("hash", "n").toArrow()
    hashes, counts = (frequent.column(name).to_numpy().astype(np.int64) for name in ("hash", "n"))
    by = np.lexsort((hashes, -counts))
    hashes, counts = hashes[by], counts[by]
    own_hashes = [h for h in hashes.tolist() if h != word_hash(END)][:OWN_WORDS]
    own = {word_hash(END): 0} | {h: 1 + k for k, h in enumerate(own_hashes)}
    outcomes = np.array([own.get(h, -1) for h in hashes.tolist()], dtype=np.int64)
    rest = vocabulary.filter(~F.col("hash").isin(list(own)))
    per_class = rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    class_tokens, class_words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in per_class:
        class_tokens[row["class"]], class_words[row["class"]] = row.n, row.words
    outcome_counts = np.zeros(GROUPS * SIZE)
    outcome_counts[outcomes[outcomes >= 0]] = counts[outcomes >= 0]
    outcome_counts[1 + OWN_WORDS : 1 + OWN_WORDS + ENDINGS] = class_tokens
    by = np.argsort(hashes, kind="stable")
    return (
        Counts(tokens, distinct, hashes[by], counts[by], outcomes[by], class_tokens, class_words, outcome_counts),
        limit,
    )


@dataclass
class MaxEnt:
    """Group and member weights by hashed context feature, over biases of the outcome frequencies."""

    group_bias: np.ndarray
    member_bias: np.ndarray
    group: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, GROUPS), np.float32))
    member: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS * GROUPS, SIZE), np.float32))

    @classmethod
    def from_counts(cls, outcome_counts: np.ndarray) -> MaxEnt:
        """Outcome k is member k // GROUPS of group k % GROUPS. Unused outcomes keep a small share."""
        table = (outcome_counts + 0.5).reshape(SIZE, GROUPS).T
        groups = table.sum(axis=1)
        return cls(
            np.log(groups / groups.sum()).astype(np.float32), np.log(table / groups[:, None]).astype(np.float32)
        )

    def _logits(self, features: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all groups, and of the members of the given groups, small enough to be raised to e."""
        first = self.group_bias + self.group.take(features[:, 0], axis=0)
        second = self.member_bias.take(groups, axis=0)
        second += self.member.take(features[:, 0] * GROUPS + groups, axis=0)
        for k in range(1, FEATURES):
            first += self.group.take(features[:, k], axis=0)
            second += self.member.take(features[:, k] * GROUPS + groups, axis=0)
        for logits in (first, second):
            # the largest of a row is seldom needed and dear: only where a power could leave the floats
            if logits.size and max(logits.max(), -logits.min()) > SAFE:
                logits -= logits.max(axis=1, keepdims=True)
        return first, second

    def probabilities(self, features: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group probabilities, and member probabilities within the given groups."""
        both = self._logits(features, groups)
        for logits in both:
            np.exp(logits, out=logits)
            logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
        return both

    def log10(self, outcomes: np.ndarray, features: np.ndarray) -> np.ndarray:
        groups, members = outcomes % GROUPS, outcomes // GROUPS
        first, second = self._logits(features, groups)
        row = np.arange(len(outcomes))
        chosen = first[row, groups].astype(np.float64) + second[row, members]
        for logits in (first, second):
            np.exp(logits, out=logits)
            chosen -= np.log((logits @ np.ones(logits.shape[1], np.float32)).astype(np.float64))
        return chosen / np.log(10)


def context_features(outcomes: np.ndarray, starts: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the word before, the one before that, both, and the last with the third (a skip).

    ``starts`` are the places where texts begin; words before a text are one special outcome.
    ``place`` chooses positions, else all are taken.
    """
    place = np.arange(len(outcomes)) if place is None else place
    begin = starts[np.searchsorted(starts, place, side="right") - 1]
    before = []
    for back in (1, 2, 3):
        known = place - back >= begin
        before.append(np.where(known, outcomes[np.maximum(place - back, 0)], GROUPS * SIZE).astype(np.uint64))
    one, two, three = before
    salt = np.uint64(1 << 20)
    mixed = np.stack([one + salt, two + salt * 2, one * np.uint64(1031) + two + salt * 3, one * np.uint64(1031) + three + salt * 4], axis=1)
    with np.errstate(over="ignore"):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(52)).astype(np.int64)


def _run_sums(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin where ``new``, in pairs, pairs of pairs and so on; overwrites ``values``."""
    starts = np.flatnonzero(new)
    left = np.flatnonzero(~new)
    place, step = left - starts[np.cumsum(new)[left] - 1], 1
    while len(left):
        odd = place & 1 == 1
        values[left[odd] - step] += values.take(left[odd], axis=0)
        left, place, step = left[~odd], place[~odd] >> 1, step * 2
    return values.take(starts, axis=0)


def _add_rows(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, slopes: np.ndarray) -> None:
    """A step on the given rows, adapted to what each row has seen; slopes of one row are added first.

    ``rows`` are FEATURES in a row for each of ``slopes``.
    """
    keys = np.sort((rows << 32) | np.arange(len(rows)))  # several times as fast as argsort
    rows, by = keys >> 32, (keys & 0xFFFFFFFF) // FEATURES
    new = np.append(True, rows[1:] != rows[:-1])
    at = rows[new]
    total = _run_sums(slopes.take(by, axis=0), new)
    seen = squares.take(at) + np.einsum("ij,ij->i", total, total)
    squares[at] = seen
    total *= (RATE / np.sqrt(seen))[:, None]
    weights[at] = weights.take(at, axis=0) - total


def train(model: MaxEnt, batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> int:
    """Gradient updates of the model in place; returns the number of positions."""
    group_squares, member_squares = (np.ones(len(w), np.float32) for w in (model.group, model.member))
    seen = 0
    for outcomes, features in batches:
        for at in range(0, len(outcomes), MINIBATCH):
            y, f = outcomes[at : at + MINIBATCH], features[at : at + MINIBATCH]
            groups, members = y % GROUPS, y // GROUPS
            first, second = model.probabilities(f, groups)
            row = np.arange(len(y))
            first[row, groups] -= 1
            second[row, members] -= 1
            _add_rows(model.group, group_squares, f.ravel(), first)
            _add_rows(model.member, member_squares, (f * GROUPS + groups[:, None]).ravel(), second)
            seen += len(y)
    return seen


_PREPARED = (
    "row long, doc_id {id_type}, training boolean, n_tokens long, held_known long, held_sum double, "
    "fixed_sum double, outcomes binary, others array<long>"
)


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _WordTable:
    """What the counts say of words, looked up once a word and kept by its number."""

    def __init__(self, known: Counts):
        self.known = known
        self.class_cost = np.log10(known.class_tokens + known.class_words + 1)
        self.clear()

    def clear(self) -> None:
        self.ids, self.bytes = _Numbers(), 0
        self.columns: list[np.ndarray] = self._describe([])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; words not met before are added."""
        before = len(self.ids)
        numbers = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        new = list(islice(reversed(self.ids), len(self.ids) - before))[::-1]
        self.bytes += sum(map(len, new))
        self.columns = [np.concatenate(c) for c in zip(self.columns, self._describe(new), strict=True)]
        return numbers

    def _describe(self, words: list[bytes]) -> list[np.ndarray]:
        """Hash, whether held, whether it has a held count, log of the count, fixed part of the score, outcome."""
        known = self.known
        hashes, classes = word_hashes(words), ending_classes(words)
        at = known.look_up(hashes)
        held = at >= 0
        counts = np.where(held, known.counts[at] if len(known.counts) else 0, 0)
        own = np.where(held, known.outcomes[at] if len(known.outcomes) else -1, -1)
        own[hashes == word_hash(END)] = 0  # the end is always an outcome
        logs = np.log10(counts + 1.0)
        fixed = np.where(own >= 0, 0.0, logs - self.class_cost[classes])
        # the end counts as held: it is in no list of words that come by the join
        held |= own == 0
        return [hashes, held, counts > 0, logs, fixed, np.where(own >= 0, own, 1 + OWN_WORDS + classes).astype("<u2")]

    def trim(self) -> None:
        """Start anew when the words are too many or too long."""
        if len(self.ids) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self.clear()


def _prepared(batches: Iterable[pa.RecordBatch], known: Counts) -> Iterator[pa.RecordBatch]:
    """Per document: outcomes, sums over words that are held, and hashes of the others."""
    number = TaskContext.get().partitionId() << 33
    table = _WordTable(known)
    for batch in chunks(batches, CHUNK):
        words: list[bytes] = []
        ends = []
        for text in texts_of(batch.column(1)):
            words += words_of(text)
            words.append(END)
            ends.append(len(words))
        ids = table.numbers(words)
        del words
        ends = np.array(ends, dtype=np.int64)
        starts = np.append(0, ends[:-1])
        hashes, held, counted, logs, fixed, outcomes = table.columns
        rare = ~held[ids]
        rare_ends = np.append(0, np.cumsum(rare))[np.append(0, ends)]
        outcome = outcomes[ids]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(number, number + len(ends))), batch.column(0), batch.column(2),
                pa.array(ends - starts), pa.array(np.add.reduceat(counted[ids].astype(np.int64), starts)),
                pa.array(np.add.reduceat(logs[ids], starts)), pa.array(np.add.reduceat(fixed[ids], starts)),
                pa.array([outcome[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(hashes[ids[rare]])),
            ],
            names=["row", "doc_id", "training", "n_tokens", "held_known", "held_sum", "fixed_sum", "outcomes", "others"],
        )
        number += len(ends)
        table.trim()


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined outcomes of several texts, and where each begins."""
    parts = [np.frombuffer(data, dtype="<u2") for data in column.to_pylist()]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.concatenate(parts).astype(np.int64), np.cumsum(sizes) - sizes


def chosen_places(rows: np.ndarray, starts: np.ndarray, total: int, turn: int) -> np.ndarray:
    """Positions of one round: every ROUNDS-th of each text, so the rounds part the positions of a text however it is read."""
    of = np.searchsorted(starts, np.arange(total), side="right") - 1
    return np.flatnonzero((np.arange(total) - starts[of] + rows[of] + turn) % ROUNDS == 0)


def fit_maxent(prepared: DataFrame, counts: Counts) -> MaxEnt:
    """Rounds of gradient updates over all training documents.

    In a round every trainer updates its own copy on one position in ROUNDS of its documents, other
    positions in each round, so every position gives one update; the copies are averaged by the
    number of positions and sent out again.
    Weights travel in pieces, which are added up by tasks of their own.
    """
    model = MaxEnt.from_counts(counts.outcome_counts)
    texts = prepared.filter("training").select("row", "outcomes").coalesce(TRAINERS)
    spark = prepared.sparkSession
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def update(batches: Iterable[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            start = sent.value
            own = MaxEnt(start.group_bias, start.member_bias, start.group.copy(), start.member.copy())

            def positions() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in chunks(batches, CHUNK):
                    outcomes, begin = _texts(batch.column(1))
                    chosen = chosen_places(batch.column(0).to_numpy(), begin, len(outcomes), turn)
                    yield outcomes[chosen], context_features(outcomes, begin, chosen)

            seen = train(own, positions())
            for piece in range(PIECES):
                change = [
                    ((new - old)[piece::PIECES] * np.float32(seen)).tobytes()
                    for new, old in ((own.group, start.group), (own.member, start.member))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece], pa.int32()), pa.array([seen], pa.int64()), *[pa.array([c], pa.binary()) for c in change]],
                    names=["piece", "seen", "group", "member"],
                )

        def add(table: pa.Table) -> pa.Table:
            total = [
                sum(np.frombuffer(data.as_py(), np.float32).astype(np.float64) for data in table.column(name))
                for name in ("group", "member")
            ]
            return pa.table({
                "piece": table.column("piece")[:1],
                "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()),
                **{n: pa.array([t.astype(np.float32).tobytes()], pa.binary()) for n, t in zip(("group", "member"), total, strict=True)},
            })

        schema = "piece int, seen long, group binary, member binary"
        changes = texts.mapInArrow(update, schema).groupBy("piece").applyInArrow(add, schema).collect()
        for row in changes:
            if row.seen:
                for weights, data in ((model.group, row.group), (model.member, row.member)):
                    part = weights[row.piece :: PIECES]
                    part += np.frombuffer(data, np.float32).reshape(part.shape) / np.float32(row.seen)
        sent.unpersist()
    return model


def score_documents(
    documents: DataFrame, held_out: int = 2, parts: int = 7, held_words: int = HELD_WORDS, work_folder: str | None = None
) -> DataFrame:
    """Scores of all whole texts, learned from those whose crc32(doc_id) mod ``parts`` is not ``held_out``.

    ``base_score``: log10 add-one unigram probability over all training tokens. ``score``: log10
    probability of the model. It predicts an outcome from hashed features of the three tokens
    before: a frequent word, the end, or the class of endings of any other word, whose share within
    its class is its add-one count there; so all texts have a probability.

    Counts cover all training documents. Every task holds the most frequent words; counts of the
    rest reach the documents by a join on words that are rare by that definition, so no key is hot.
    Documents are tokenized once more into narrow rows in the work folder, which training, the join
    and scoring read.

    Null or empty text is its end token. Null ids count as empty text in the split. Repeated rows
    are scored each; very long texts are scored whole, in memory that grows with one text. Without
    training documents all counts are zero. Other columns are not read.
    """
    training = (remainder(F.col("doc_id"), parts) != held_out).alias("training")
    rows = documents.select("doc_id", "text", training)
    vocabulary = stage(word_counts(rows.filter("training")), "vocabulary", work_folder)
    counts, limit = gather_counts(vocabulary, held_words)
    sent = documents.sparkSession.sparkContext.broadcast(counts)
    schema = _PREPARED.format(id_type=rows.schema["doc_id"].dataType.simpleString())
    prepared = stage(rows.mapInArrow(lambda batches: _prepared(batches, sent.value), schema), "prepared", work_folder)
    model = documents.sparkSession.sparkContext.broadcast(fit_maxent(prepared, counts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK):
            outcomes, begin = _texts(batch.column(0))
            features = context_features(outcomes, begin)
            logs = [
                model.value.log10(outcomes[at : at + MINIBATCH], features[at : at + MINIBATCH])
                for at in range(0, len(outcomes), MINIBATCH)
            ]
            sums = np.add.reduceat(np.concatenate(logs), begin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sums)], names=[*batch.schema.names[1:], "model_sum"]
            )

    own = prepared.select("outcomes", "row", "doc_id", "training", "n_tokens", "held_known", "held_sum", "fixed_sum")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    modelled = own.mapInArrow(run, f"{types}, model_sum double")
    rare = vocabulary.filter(F.col("n") < limit).select("hash", F.log10(F.col("n") + 1.0).alias("log"))
    others = prepared.select("row", F.explode("others").alias("hash")).join(rare, "hash")
    others = others.groupBy("row").agg(F.sum("log").alias("rare_sum"), F.count("*").alias("rare_known"))
    whole = modelled.join(others, "row", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return whole.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("held_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("held_sum") + rare_sum - F.col("n_tokens") * float(np.log10(counts.tokens + counts.distinct + 1))).alias("base_score"),
        (F.col("model_sum") + F.col("fixed_sum") + rare_sum).alias("score"),
    )
