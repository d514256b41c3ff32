import random
import zlib

from galley.llm.registry import op6_toxicity
from galley.llm.toxicity import EDIT_LENGTH, LexiconAutomaton, context_score, fit_toxicity, toxicity, with_toxicity
from tests.llm.helpers import no_documents, odd_documents


def edits(a, b):
    """Insertions, deletions, replacements and swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def test_automaton_equals_the_definition():
    draw = random.Random(6)
    terms = sorted({"".join(draw.choices("abc", k=draw.randint(1, 8))) for _ in range(60)})
    for most in (1, 2):
        automaton = LexiconAutomaton(terms, most)
        for _ in range(1_500):
            word = "".join(draw.choices("abcd", k=draw.randint(0, 9)))
            near = [(edits(word, t), k) for k, t in enumerate(terms)]
            near = [(e, k) for e, k in near if e <= most and (e == 0 or len(terms[k]) >= EDIT_LENGTH)]
            assert automaton.match(word) == (min(near) if near else None)


def test_context():
    plain = "what an awful idiot that is".split()
    assert context_score(plain, 3) == 1.0
    assert context_score('they wrote of "the idiot" again'.split(), 4) == 0.5
    assert context_score("you are an idiot".split(), 3) == 1.5


def labelled(spark):
    draw = random.Random(1)
    words = [f"word{k}" for k in range(400)]
    bad = ["scoundrel", "villain", "blackguard"]
    rows = []
    for k in range(600):
        text = draw.choices(words, k=60)
        if k % 6 == 0:
            for _ in range(3):
                text.insert(draw.randrange(60), draw.choice(bad))
        rows.append((k, " ".join(text), int(k % 6 == 0)))
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (9_999, 1)], "doc_id long, toxic int")
    return documents, labels


def test_learns_terms_and_finds_misspelled_ones(spark):
    documents, labels = labelled(spark)
    model = fit_toxicity(documents, labels)
    assert [term for term, _ in model.lexicon] == ["blackguard", "scoundrel", "villain"]
    text = "word1 word2 word3 " * 10
    probe = [(1, text), (2, text + "scoundrel villain Villain!"), (3, text + "scoundrle vilain blackgaurd vlllain"), (4, None), (5, "")]
    scores = {r.doc_id: r.score for r in with_toxicity(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert scores[2] > 0.8 and scores[3] > scores[1] == scores[4] == scores[5] < 0.1


def test_odd_rows(spark):
    documents, labels = labelled(spark)
    model = fit_toxicity(documents, labels)
    frame, texts = odd_documents(spark)
    rows = with_toxicity(frame, model).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(no_documents(spark), labels).count() == 0
    unlabelled = toxicity(documents, labels.limit(0)).collect()
    assert all(r.score < 0.3 and r.predicted == 0 for r in unlabelled)
    assert toxicity(frame, labels).count() == len(texts)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op6_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    wins = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert wins > 0.75
    flagged = [y for _, y, p in held if p]
    assert sum(flagged) >= 0.9 * len(flagged)
