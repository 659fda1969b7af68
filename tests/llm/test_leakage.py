import random

import numpy as np
import pytest

from vankho.llm.fm_index import FMIndex, suffix_order
from vankho.llm.leakage import find_leaks


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    rnd = random.Random(seed)
    symbols = np.array([rnd.choice([0, 1, 1, 2, 3, 4, 5]) if rnd.random() < 0.7 else 1 for _ in range(500)] + [0])
    index = FMIndex(symbols, 3)
    phrases = np.array([[rnd.randrange(1, 6) for _ in range(3)] for _ in range(60)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(symbols) - 2) if (symbols[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order_stops_at_zero():
    symbols = np.array([2, 1, 0, 2, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0])

    def key(i):
        end = i + symbols[i:].tolist().index(0)
        return symbols[i : end + 1].tolist(), i

    assert suffix_order(symbols, 2).tolist() == sorted(range(len(symbols)), key=key)


WORDS = [f"từ{i}" for i in range(400)]


def _item(rnd, n=60):
    return [rnd.choice(WORDS) for _ in range(n)]


def test_planted_leaks(spark):
    rnd = random.Random(3)
    items = {i: _item(rnd) for i in range(12)}
    filler = lambda n: " ".join(rnd.choice(["thẻ", "két", "sổ", "quỹ"]) for _ in range(n))
    docs, want = [], set()
    for d in range(60):
        i = rnd.randrange(12)
        part = list(items[i])
        kind = d % 6
        if kind == 1:
            part = part[10:35]
        elif kind == 2:
            part = [w.upper() if rnd.random() < 0.5 else w for w in part]
        elif kind == 3:
            part = [("khác" if k % 12 == 5 else w) for k, w in enumerate(part) if k % 17 != 3]
        elif kind == 4:
            part = part[:8]
        elif kind == 5:
            part = rnd.sample(part, len(part))
        docs.append((d, filler(30) + "\n" + ",  ".join(part) + ". " + filler(20), "clash"))
        if kind < 4:
            want.add((d, i))
    docs += [(None, docs[0][1], "x"), (1000, None, "x"), (1001, "", "x"), (1002, filler(50_000), "x"), (1003, docs[0][1], "x")]
    want.add((1003, next(i for d, i in want if d == 0)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None)], "item_id bigint, item_text string")
    assert {tuple(r) for r in find_leaks(df, table).collect()} == want
    spans = {r.doc_id: (r.begin, r.end) for r in find_leaks(df, table, spans=True).collect()}
    text = docs[0][1]
    assert text[spans[0][0] : spans[0][1]].startswith(items[next(i for d, i in want if d == 0)][0])
    assert set(spans) == {d for d, _ in want}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id bigint, item_text string")
    assert find_leaks(none, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_a_clause_that_many_items_share_and_a_text_repeats():
    """2,000 repeats of an opening that 1,000 items share: the same rows as in smaller parts, in bounded memory."""
    import tracemalloc

    import pyarrow as pa

    from vankho.llm import codepoints as C
    from vankho.llm import leakage as L

    opening = "theo quy định của pháp luật hiện hành về quản lý kho quỹ"
    rnd = random.Random(1)
    items = [(i, opening + " " + " ".join(rnd.choice(WORDS) for _ in range(60))) for i in range(1000)]
    p = L.phrases_of(items)
    text = " ".join([opening + " khác"] * 2000 + [items[7][1]])
    tracemalloc.start()
    found = L.search_shard(*C.decode(pa.array([text, "x", items[3][1]])), p)
    assert tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()
    assert {(int(a), int(b)) for a, b in zip(found["text"], found["item"])} == {(0, 7), (2, 3)}
