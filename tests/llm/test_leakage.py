import random

from spanforge.llm import leakage

VOCAB = [f"v{i}" for i in range(300)]
OPEN = "Answer only from the text that follows, please."


def make(seed):
    r = random.Random(seed)
    items = [(i, "s", f"{OPEN} " + " ".join(r.choice(VOCAB) for _ in range(r.randint(21, 60))) + ".") for i in range(12)]
    items += [(100, "s", " ".join(VOCAB[:12])), (101, "s", "tiny item here"), (102, "s", ""), (103, "s", None), (1, "s", items[1][2])]
    docs = []
    for d in range(80):
        w = [r.choice(VOCAB) for _ in range(r.randint(30, 120))]
        if d % 2:
            words = items[r.randrange(12)][2][len(OPEN) :].split()
            n = r.choice([12, 19, 20, 21, len(words)])
            at = r.randint(0, max(0, len(words) - n))
            part = words[at : at + n]
            for _ in range(r.choice([0, 1, 2, 3])):
                k = r.randrange(len(part))
                part[k] = r.choice(["qq", part[k] + " ins"])
            w[10:10] = part
        t = " ".join(w)
        docs.append((d, r.choice([t, t.upper(), t.replace(" ", "\n"), "<b>" + t.replace(" ", " ** ") + "</b>", t.replace(" ", " "), "> " + t.replace(" ", "\n> "), OPEN + " " + t])))
    return items, docs


def brute(items, docs):
    texts = leakage.strip_openings([t or "" for _, _, t in items])
    out = set()
    for (i, _, _), t in zip(items, texts, strict=True):
        w = leakage.plain_words(t)
        n = min(leakage.WINDOW, len(w))
        for d, x in docs:
            dw = leakage.plain_words(x or "")
            code: dict[str, int] = {}
            ids = [code.setdefault(y, len(code)) for y in dw]
            item = [code.setdefault(y, len(code)) for y in w]
            if n and any(leakage.myers_within(item[s : s + n], ids, n // leakage.BUDGET) for s in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def frames(spark, items, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS item_id", "'y' AS suite"), spark.createDataFrame(items, "item_id bigint, suite string, text string")


def test_against_brute_force(spark):
    items, docs = make(4)
    docs += [(200, "so tiny item here, then"), (201, " ".join(VOCAB[:5] + ["x"] + VOCAB[6:12])), (202, OPEN), (203, None), (204, "")]
    d, i = frames(spark, items, docs)
    got = {tuple(r) for r in leakage.leaks(d, i).collect()}
    assert got == brute([x for x in items if x[2]], docs)
    assert (200, 101) in got and (201, 100) in got and not any(x == 202 for x, _ in got)


def test_blocks_of_items(spark, monkeypatch):
    items, docs = make(5)
    d, i = frames(spark, items, docs)
    whole = {tuple(r) for r in leakage.leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 600)
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == whole


def test_empty_tables(spark):
    d, i = frames(spark, [], [])
    assert leakage.leaks(d, i).count() == 0
    items, docs = make(6)
    assert leakage.leaks(frames(spark, [], docs)[0], i).count() == 0
    report = leakage.leak_report(*frames(spark, items, [(1, "z " * 200_000)])).collect()
    assert len(report) == 16 and all(r.n_documents == 0 for r in report)


def test_distance():
    assert leakage.myers_within([1, 2, 3], [9, 1, 3, 9], 1) and not leakage.myers_within([1, 2, 3], [9, 1, 9], 1)


def test_three_errors_in_the_middle_of_thirty_words(spark):
    item = [f"i{k}" for k in range(60)]
    hit = [f"x{k}" if k in (11, 14, 17) else w for k, w in enumerate(item[10:40])]
    miss = [f"x{k}" if k in (5, 11, 14, 17) else w for k, w in enumerate(item[10:40])]
    around = lambda w: " ".join([f"a{k}" for k in range(15)] + w + [f"b{k}" for k in range(15)])
    docs = spark.createDataFrame([(1, around(hit)), (2, around(miss)), (3, around(hit[:29]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaks(docs, items).collect()} == {(1, 7)}
