import random

from docloom.llm.leaks import leak_report, leaks
from docloom.llm.skeleton import plain_words

DOCS, ITEMS = "doc_id long, text string, position int, item_id string", "item_id long, text string, words int"


def brute(docs, items, run):
    windows = {}
    for i, t, *_ in items:
        w = plain_words(t)
        for k in range(len(w) - run + 1):
            windows.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = plain_words(t)
        out |= {(d, i) for k in range(len(w) - run + 1) for i in windows.get(tuple(w[k : k + run]), ())}
    return {x for x in out if None not in x}


def fixture():
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([5, 13, 20, 40]))), 1) for k in range(30)]
    docs = []
    for k in range(150):
        w = some(80)
        if k % 3 == 0:
            source = items[rng.randrange(30)][1].split()
            n = rng.choice([12, 13, 25])
            at = rng.randrange(max(1, len(source) - n + 1))
            w[30:30] = [x.upper() for x in source[at : at + n]]
        docs.append((k, " , ".join(w), 1, "x"))
    docs += [(1000, None, 1, "x"), (1001, "", 1, "x"), (None, items[0][1], 1, "x"), (1002, " ".join(some(50_000)), 1, "x"), docs[0]]
    items += [(200, None, 1), (201, "", 1), (None, "a b c", 1), items[1], (202, items[2][1], 1), (203, "rep " * 30, 1)]
    docs.append((1004, "rep " * 14, 1, "x"))
    items += [(206, items[k][1], 1) for k in range(10)]  # several texts under one id
    return docs, items


def test_against_brute_force_both_ways(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items, 13)
    assert len(want) > 10
    assert {tuple(r) for r in leaks(d, i).collect()} == want
    assert {tuple(r) for r in leaks(d, i, local_item_words=0).collect()} == want
    report = {r.item_id: r.documents for r in leak_report(leaks(d, i), i).collect()}
    assert report[201] == 0 and report[203] == 1


def test_empty_tables(spark):
    docs, items = fixture()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leaks(d.limit(0), i).count() == 0
    assert leaks(d, i.limit(0)).count() == 0
