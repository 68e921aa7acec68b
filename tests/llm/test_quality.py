import random

import numpy as np
import pytest

from spanforge.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    texts = [t for _, t in quality.inspected_examples(seed=77, each=3)]
    kinds = [k for k, _ in quality.inspected_examples(seed=77, each=3)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, label string, kind double")
    labels = spark.createDataFrame([(i, kinds[i], "ann") for i in range(0, 30)] + [(30, "junk", "ann"), (31, "nonsense", "ann"), (32, None, "a"), (None, "list", "a"), (1, kinds[1], "b")], "doc_id bigint, label string, annotator string")
    return docs, labels, kinds


def test_held_out_accuracy(tables):
    docs, labels, kinds = tables
    got = {r.doc_id: r.kind for r in quality.kinds(docs, labels).collect()}
    assert sum(got[i] == k for i, k in enumerate(kinds)) >= 0.95 * len(kinds)


def test_majority_of_characters(tables, spark):
    docs, labels, _ = tables
    r = random.Random(5)
    word = lambda: r.choice("b d f g l m n p r s t v w".split()) + r.choice("a e i o u".split()) + r.choice("nd rt ll m st ck ve".split()) + r.choice(["", "er", "ing", "on", "et"])
    forms = ["The {} near the {} was {} when it came to us.", "We have not seen a {} which {} the {} before.", "If there is no {} then they will take the {} and {} on.", "Both of them were at the {} for a {}, but nobody had a {}."]
    prose_of = lambda n: " ".join(r.choice(forms).format(word(), word(), word()) for _ in range(n))
    prose = prose_of(1) + " "
    table = "\n".join(f"| item{i} | {i * 7} | red |" for i in range(30))
    more = [(1, prose_of(2) + "\n\n" + table), (2, prose_of(12) + "\n\n" + table), (3, None), (4, ""), (5, " \n "), (6, prose + "\n```\n" + "x = y[1]\n" * 40 + "```\n"), (6, prose), (7, prose_of(2000))]
    m = quality.train(docs, labels)
    assert [quality.kind_of(t, m) for _, t in more] == ["table", "prose", "junk", "junk", "junk", "prose", "prose", "prose"]
    got = quality.found(spark.createDataFrame(more, "doc_id bigint, text string"), labels).collect()
    assert len(got) == len({tuple(r) for r in got}) and {(3, "junk"), (4, "junk"), (5, "junk")} <= {tuple(r) for r in got}


def test_empty_tables(tables):
    docs, labels, _ = tables
    assert quality.kinds(docs.limit(0), labels).count() == 0
    assert quality.kinds(docs.limit(5), labels.limit(0)).count() == 5


def test_plain_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\nOn a mat\n\n#"), (2, None), (3, "")], "doc_id bigint, text string")
    r = {x.doc_id: x for x in quality.document_statistics(df).collect()}
    assert r[1].n_words == 7 and abs(r[1].punctuated_line_share - 1 / 3) < 1e-9 and abs(r[1].common_word_share - 3 / 6) < 1e-9
    assert r[2].n_words == 0 and r[3].mean_word_length is None


def test_long_units_repeated(tables):
    docs, labels, _ = tables
    r = random.Random(9)
    forms = ["The {} near the {} was {} when it came to us.", "We have not seen a {} which the {} made before it was {}.", "If there is no {} then they will take the {} and be {}."]
    noun = lambda: r.choice("bridge river teacher harbour village engine window parser station market lesson kitchen doctor forest".split()) + r.choice(["", "s", "like", "ing"])
    unit = " ".join(r.choice(forms).format(noun(), noun(), noun()) for _ in range(20))
    assert len(unit.split()) > 180
    paragraph = " ".join(unit.split()[:45])
    m = quality.train(docs, labels)
    texts = [" ".join([unit] * 10), "\n\n".join([paragraph] * 8), "\n\n".join([unit] * 4), unit, unit + "\n\n" + paragraph]
    assert [quality.kind_of(t, m) for t in texts] == ["junk", "junk", "junk", "prose", "prose"]
    tail = [quality.statistics([unit + " " + " ".join(["again"] * n)])[quality.FEATURES.index("repeats")] for n in (0, 40)]
    assert tail[1] > tail[0]  # the last words are read too


def test_the_mixture_is_fitted_on_all_documents(spark):
    r = random.Random(3)
    sentences = [t for k, t in quality.inspected_examples(seed=5, each=20) if k == "prose" and "\n" not in t]
    rows = [(i, r.choice(sentences) + f" It took {r.randrange(10**6)} minutes.") for i in range(6000)]
    rows += [(6000 + i, None if i % 2 else " \n") for i in range(10)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, "list") for i in range(2500)], "doc_id bigint, label string")
    examples = [(quality.KINDS.index(k), x[i]) for k, t in quality.inspected_examples() for _, _, x, i, _ in [quality.measure(t)] if i >= 0]
    of = [quality.measure(t) for i, t in rows if t and i is not None]
    own = np.array([x[i] for _, _, x, i, _ in of if i >= 0], np.float32).astype(np.float64)
    known, x = np.array([k for k, _ in examples]), np.array([x for _, x in examples])
    got = quality.train(docs, labels)
    none = np.full(len(own), -1)
    want = quality.fit_mixture(lambda f: f(own, none), lambda f: f(own[:2500], none[:2500] + 2), x, known)
    assert np.allclose(got.mean, np.concatenate([own, x]).mean(0)) and np.allclose(got.scale, np.concatenate([own, x]).std(0) + 1e-3)
    assert np.allclose(got.weights, want.weights, atol=1e-9) and np.allclose(got.centres, want.centres, atol=1e-6) and np.allclose(got.kinds, want.kinds, atol=1e-6)
    # every label has a vote: 2,500 for lists
    votes = quality.totals(spark.createDataFrame([("list", row) for row in own[:2500].tolist()], "kind string, x array<double>"))(quality._votes(got))
    assert abs(votes.reshape(-1, 4)[:, 1].sum() - 2500) < 1e-6 and abs(votes.sum() - 2500) < 1e-6
