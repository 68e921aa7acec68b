import random

import numpy as np

from spanforge.llm import history
from spanforge.llm.words import common_subsequence, words_of

WORDS = [f"w{i}" for i in range(120)] + "the of a is to and it for".split() * 6


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(r, t, share):
    w = t.split()
    for i in r.sample(range(len(w)), int(share * len(w))):
        w[i] = r.choice(["zz", "", w[i] + " extra", "yy"])
    return " ".join(w)


def brute(rows):
    docs = [(i, words_of(t or "")) for i, t in sorted(dict(rows).items())]
    lead = {}
    for k, (b, wb) in enumerate(docs):
        for a, wa in docs[:k]:
            if wa and wb and common_subsequence(wa, wb) >= 0.8 * max(len(wa), len(wb)):
                lead[b] = lead.get(a, a)
                break
    return {(a, b) for b, a in lead.items()}


def sample(seed, n):
    r = random.Random(seed)
    base = [text(r, r.choice([6, 12, 30, 60, 150, 300])) for _ in range(n)]
    rows, i = [], 0
    for t in base:
        rows.append((i := i + 1, t))
        for _ in range(r.choice([0, 0, 1, 3])):
            rows.append((i := i + 1, r.choice([t.upper() + "!", t.replace(" ", "\n\n"), changed(r, t, 0.04), changed(r, t, 0.1), changed(r, t, 0.5)])))
    r.shuffle(rows)
    return rows


def test_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(0)
    for _ in range(200):
        a, b = [r.randint(0, 5) for _ in range(r.randint(0, 90))], [r.randint(0, 5) for _ in range(r.randint(0, 90))]
        assert common_subsequence(a, b) == slow(a, b)


def as_traces(make_traces, rows):
    return make_traces([{"row_id": i, "batch_no": i // 100, "steps": None if t is None else [{"content": t[: len(t) // 2]}, None, {"content": None}, {"content": t[len(t) // 2 :]}]} for i, t in rows])


def test_repeats_against_brute_force(spark):
    rows = sample(1, 60)
    df = spark.createDataFrame(rows, "row_id bigint, text string").selectExpr("row_id", "0L AS batch_no", "array(named_struct('content', text)) AS steps", "1 AS token", "2 AS leader")
    got = {(r.row_a, r.row_b) for r in history.repeats(df).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.97 * len(want), sorted(want - got)[:5]
    assert {b for _, b in got} <= {b for _, b in want}


def test_nulls_empties_ties_and_repeats(make_traces):
    long = " ".join(f"word{i}" for i in range(60))
    df = as_traces(make_traces, [(1, None), (2, ""), (3, "   "), (4, "..."), (7, long), (5, long), (5, long), (9, long.upper())])
    assert {(r.row_a, r.row_b) for r in history.repeats(df).collect()} == {(5, 7), (5, 9)}
    assert history.repeats(as_traces(make_traces, [])).count() == 0
    assert {r.batch_no: (r.n_rows, r.n_repeats) for r in history.batch_split(df).collect()}[0] == (7, 2)


def test_very_long_text(make_traces):
    r = random.Random(2)
    t = text(r, 20_000)
    assert {(x.row_a, x.row_b) for x in history.repeats(as_traces(make_traces, [(1, t), (2, changed(r, t, 0.05))])).collect()} == {(1, 2)}


def test_index_grows_by_batches(spark, tmp_path):
    rows = sorted(sample(3, 40))
    index = history.HistoryIndex(str(tmp_path / "index"), buckets=4)
    got = set()
    for lo in range(0, len(rows), 30):
        part = spark.createDataFrame(rows[lo : lo + 30], "row_id bigint, text string")
        got |= {(r.row_a, r.row_b) for r in index.accept(part, f"b{lo}").collect()}
    want = {b for _, b in brute(rows)}
    assert len({b for _, b in got} & want) >= 0.9 * len(want)
    assert {b for _, b in got} <= want
    again = spark.createDataFrame([(10_000 + i, t) for i, t in rows], "row_id bigint, text string")
    assert index.probe(again).count() == sum(bool(words_of(t)) for _, t in rows)


def stock(seed, n, k=14):
    """Sessions of stock steps: every run of words is held by many texts; near-copies have 2 of 15 steps changed."""
    r = random.Random(seed)
    steps = [[r.choice(WORDS) for _ in range(12)] for _ in range(k)]
    base = [[r.randrange(k) for _ in range(15)] for _ in range(n)]
    copies = [[r.randrange(k) if i in (p, q) else x for i, x in enumerate(b)] for b in base for p, q in [r.sample(range(15), 2)]]
    rows = base + copies
    r.shuffle(rows)
    return [(i, " ".join(" ".join(steps[x]) for x in row)) for i, row in enumerate(rows, 1)]


def test_stock_steps_are_compared_in_full(make_traces):
    rows = stock(5, 150)
    want = brute(rows)
    assert len(want) >= 140
    assert {(x.row_a, x.row_b) for x in history.repeats(as_traces(make_traces, rows)).collect()} == want


def test_long_lists_are_split(make_traces, monkeypatch):
    rows = stock(6, 40)
    monkeypatch.setattr(history, "LIST", 16)
    assert {(x.row_a, x.row_b) for x in history.repeats(as_traces(make_traces, rows)).collect()} == brute(rows)


def test_one_word_in_five_changed_evenly(make_traces):
    r = random.Random(7)
    rows = []
    for k, n in enumerate([5, 40, 50, 60, 200, 1000]):
        w = text(r, n).split()
        rows += [(2 * k + 1, " ".join(w)), (2 * k + 2, " ".join(f"new{i}" if i % 5 == 4 else x for i, x in enumerate(w)))]
    short = text(r, 60).split()
    rows += [(91, " ".join(short)), (92, " ".join(x for i, x in enumerate(short) if i % 5 != 2))]  # 48 of 60 words
    df = make_traces([{"row_id": i, "batch_no": 1, "steps": [{"content": t}]} for i, t in rows])
    got = {(x.row_a, x.row_b) for x in history.repeats(df).collect()}
    assert got == {(2 * k + 1, 2 * k + 2) for k in range(6)} | {(91, 92)}


def test_a_repeat_of_a_repeat_is_found_by_the_index(spark, tmp_path):
    w = [f"w{i}" for i in range(100)]
    texts = [w, w[:85] + [f"x{i}" for i in range(15)], [f"y{i}" for i in range(12)] + w[12:85] + [f"x{i}" for i in range(15)]]
    index = history.HistoryIndex(str(tmp_path / "index"), buckets=4)
    got = [{(r.row_a, r.row_b) for r in index.accept(spark.createDataFrame([(i, " ".join(t))], "row_id bigint, text string"), f"b{i}").collect()} for i, t in enumerate(texts, 1)]
    assert got == [set(), {(1, 2)}, {(1, 3)}]


def test_batch_after_batch_equals_one_delivery(make_traces):
    rows = [(i, t) for i, t in stock(8, 40)]
    df = make_traces([{"row_id": i, "batch_no": 1 + i // 30, "steps": [{"content": t}]} for i, t in rows] + [{"row_id": 500, "batch_no": None, "steps": [{"content": rows[0][1]}]}])
    linked = [{r.row_b for r in history.repeats(df, k).collect()} for k in (1, 3)]
    assert linked[1] >= linked[0] - {rows[0][0]} and {x for x in linked[0] ^ linked[1]} <= {rows[0][0], 500}


def test_a_resumed_session_does_not_hide_a_repeat(make_traces):
    r = random.Random(9)
    w = text(r, 600).split()
    near = w[:300] + [f"n{i}" for i in range(15)] + w[315:]
    longer = [text(r, 400).split() + w + text(r, 400).split() for _ in range(2)]
    rows = [(1, longer[0]), (2, w), (3, longer[1]), (4, near)]
    df = make_traces([{"row_id": i, "batch_no": i, "steps": [{"content": " ".join(t)}]} for i, t in rows])
    assert {(x.row_a, x.row_b) for x in history.repeats(df, 4).collect()} == {(2, 4)}


def test_an_accepted_batch_can_be_accepted_again(spark, tmp_path):
    rows = sorted(sample(4, 20))
    first, second = (spark.createDataFrame(x, "row_id bigint, text string") for x in (rows[:20], rows[20:]))
    index = history.HistoryIndex(str(tmp_path / "index"), buckets=4)
    index.accept(first, "one")
    once = {(r.row_a, r.row_b) for r in index.accept(second, "two").collect()}
    held = spark.read.parquet(str(tmp_path / "index/postings")).count()
    assert {(r.row_a, r.row_b) for r in index.accept(second, "two").collect()} == once
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() == held


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    index = history.HistoryIndex(str(tmp_path / "index"), buckets=2)
    a = spark.createDataFrame([(1, "one two three four five")], "row_id bigint, text string")
    b = spark.createDataFrame([(2, "six seven eight nine ten")], "row_id bigint, text string")
    index.accept(a, "a")
    index._write(spark.createDataFrame([(bytearray(16), 9, 9, 0)], "digest binary, row_id bigint, leader bigint, bucket int"), "digests", "broken")
    assert index._accepted(spark) == ["a"]
    assert index.accept(b, "b").count() == 0
    assert {(r.row_a, r.row_b) for r in index.probe(spark.createDataFrame([(3, "Six, seven eight nine ten!"), (4, "one two three four")], "row_id bigint, text string")).collect()} == {(2, 3), (1, 4)}


def test_a_batch_reads_only_its_partitions(spark, tmp_path):
    index = history.HistoryIndex(str(tmp_path / "index"), buckets=16)
    index.accept(spark.createDataFrame([(i, text(random.Random(i), 40)) for i in range(60)], "row_id bigint, text string"), "a")
    plan = index._read(spark, "records", "row_id bigint, words array<int>, leader bigint", ["a"], [3])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0]
    assert "bucket" in filters and "batch" in filters
    assert index._read(spark, "records", "row_id bigint, words array<int>, leader bigint", ["a"], [3]).count() < 30


def test_blocks_keep_every_pair_in_reach():
    r = random.Random(11)
    texts = []
    for n in (8, 60, 235, 245, 460, 480, 700):  # both sides of the lengths at which fewer bits are compared
        for _ in range(6):
            w = [r.randrange(90) for _ in range(n)]
            texts += [w, [90 + i if r.random() < 0.15 else x for i, x in enumerate(w)], w[: len(w) - len(w) // 6]]
    words = [np.array(w, np.int32) for w in texts]
    tokens = [history.tokens_of(w) for w in words]
    wide = np.array([np.packbits((np.bincount((t >> 40) & (history.WIDE - 1), minlength=history.WIDE) & 1).astype(np.uint8)).view(np.uint64) for t in tokens])
    n, ids = np.array([len(w) for w in words]), np.arange(len(words))
    want = {(a, b) for b in ids for a in ids[:b] if len(np.intersect1d(tokens[a], tokens[b])) >= history.needed(max(n[a], n[b]))}
    assert len(want) > 60
    whole = history.Block(ids, n, wide)
    even, odd = (history.Block(ids[ids % 2 == k], n[ids % 2 == k], wide[ids % 2 == k]) for k in (0, 1))
    for x, y, some in ((whole, whole, want), (even, odd, {p for p in want if sum(p) % 2}), (odd, even, {p for p in want if sum(p) % 2})):
        got = [tuple(sorted((x.ids[a], y.ids[b]))) for i, j in history._close(x, y, 4, 16) for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and some <= set(got)


def test_long_texts_of_few_words_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT_LEAST", 4)
    r = random.Random(12)
    w = [[r.randrange(400) for _ in range(600)] for _ in range(120)]
    w += [[x if r.random() < 0.9 else 500 for x in w[0]]]
    records = spark.createDataFrame(list(enumerate(w)), "row_id bigint, words array<int>").cache()
    new = history.postings(records, history.rarity(records)).selectExpr("*", "row_id % 2 = 0 AS new")
    drawn = history.sketches(records).selectExpr("*", "row_id % 2 = 0 AS new")
    pairs = {(x.a, x.b, x.old) for x in history.candidates(new, drawn).collect()}
    assert (0, 120, False) in pairs and len(pairs) < 20  # 5,122 where lists are joined with sketches of 512 bits
