import random

import numpy as np
import pyarrow as pa
import pytest

from pagequern.llm import decontaminate as dc


def brute(docs, items, k=5, least=0.8):
    """Every window of every item's length, compared directly."""
    it = dc.Items([i for i, _ in items], pa.array([t for _, t in items]), k)
    out = set()
    for d, t in docs:
        for _, _, data, offsets in dc.text_chunks(pa.array([t])):
            _, _, hashes, _ = dc.words(data, offsets)
            found = dc.shingles(hashes, k)
            for n, item in enumerate(it.ids):
                size = it.size[n] - k + 1
                if any(it.similarity(found[s : s + size], n) >= least for s in range(len(found) - size + 1)):
                    out.add((d, item))
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(6, 40)))) for i in range(30)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        words = r.choices(vocabulary, k=r.choice((0, 3, 50, 400)))
        for _ in range(r.choice((0, 1, 2))):
            leak = r.choice(items[:30])[1].split()
            if r.random() < 0.4:
                leak[r.randrange(len(leak))] = "changed"
            if r.random() < 0.3:
                leak = leak[: len(leak) * 4 // 5]
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() for w in leak] if r.random() < 0.3 else leak
        docs.append((d, " ".join(words)))
    return docs, items


@pytest.mark.parametrize("words", [1 << 20, 100])
def test_matches_brute_force(spark, docs_of, case, words):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(d, t, "s") for d, t in docs] + [(500, None, "s"), (501, "", "s"), (3, docs[3][1], "s")]
    got = dc.leaks(docs_of(rows), bench, broadcast_words=words).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want
    kept = sorted(r.doc_id for r in dc.drop_leaking(docs_of(rows), bench, broadcast_words=words).collect())
    assert kept == sorted(d for d, _, _ in rows if d not in {x for x, _ in want})
    for r in got:
        said = next(t for d, t in docs if d == r.doc_id).lower().split()[r.start_word : r.end_word]
        assert len(said) == len(next(t for i, t in items if i == r.item_id).split())


def test_index_finds_all_within_radius():
    r = random.Random(1)
    it = dc.Items([0], pa.array(["a b c d e f g h"]), 5)
    for n in range(dc.RADIUS + 3):
        value = int(it.prints[0]) ^ sum(1 << b for b in r.sample(range(64), n))
        assert it.within_radius(value, 8) == ([0] if n <= dc.RADIUS else [])


def test_clean_rows_stay(spark, docs_of, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = docs_of([(d, t, "s") for d, t in docs] + [(600, None, "s")])
    kept = dc.drop_leaking(table, bench)
    assert kept.columns == table.columns
    leaked = {d for d, _ in brute(docs, items)}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - leaked | {600}
    assert dc.leaks(docs_of([]), bench).count() == 0
    assert dc.leaks(table, bench.limit(0)).count() == 0
    assert dc.drop_leaking(table, bench.limit(0)).count() == 61


def test_items_longer_than_the_document(spark, docs_of):
    r = random.Random(8)
    items = [(i, " ".join(r.choices([f"w{n}" for n in range(300)], k=40))) for i in range(20)]
    cut = [(i, " ".join(t.split()[i % 3 : 40 - i // 4])) for i, t in items]
    rows = [(d, t, "s") for d, t in cut] + [(99, " ".join(items[0][1].split()[:20]), "s")]
    it = dc.Items([i for i, _ in items], pa.array([t for _, t in items]), 5)
    want = {}
    for d, t, _ in rows:
        for _, _, data, offsets in dc.text_chunks(pa.array([t])):
            found = dc.shingles(dc.words(data, offsets)[2], 5)
            want |= {(d, i): (s, 0, len(t.split())) for i in range(20) if (s := it.similarity(found, i)) >= 0.8}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.start_word, x.end_word) for x in dc.leaks(docs_of(rows), bench).collect()}
    assert got == want and len(want) > 15 and (99, 0) not in want
    assert {x.doc_id for x in dc.drop_leaking(docs_of(rows), bench).collect()} == {d for d, *_ in rows} - {d for d, _ in want}


def test_items_shorter_than_a_shingle(spark, docs_of):
    bench = spark.createDataFrame([(1, "too short"), (2, "Four words are here"), (3, ""), (4, "too short")], "item_id bigint, text string")
    docs = docs_of([(1, "TOO  short", "s"), (2, "it is too short", "s"), (3, "four words are here", "s"), (4, "", "s"), (5, None, "s"), (6, "short too", "s")])
    got = sorted((r.doc_id, r.item_id, r.similarity, r.start_word, r.end_word) for r in dc.leaks(docs, bench).collect())
    assert got == [(1, 1, 1.0, 0, 2), (1, 4, 1.0, 0, 2), (3, 2, 1.0, 0, 4)]
    assert sorted(r.doc_id for r in dc.drop_leaking(docs, bench).collect()) == [2, 4, 5, 6]


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(9,2)"])
def test_keys_of_any_type(spark, docs_of, kind):
    text = "one two three four five six seven eight"
    bench = spark.sql(f"SELECT CAST('{'2024-01-02' if kind == 'date' else '7'}' AS {kind}) AS item_id, '{text}' AS text")
    got = dc.leaks(docs_of([(1, text, "s"), (2, "other", "s")]), bench)
    assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType and [r.doc_id for r in got.collect()] == [1]


def test_recall_of_similar_windows(spark):
    """Of windows that are similar enough, the share whose fingerprints are within the radius."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect() if len((r.text or "").split()) >= 12]
    it, r = dc.Items(list(range(len(texts))), pa.array(texts), 5), random.Random(6)
    found = similar = 0
    for n, text in enumerate(texts):
        for _ in range(30):
            words = text.split()
            for _ in range(r.randint(1, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = f"x{r.randrange(99)}"
            for _, _, data, offsets in dc.text_chunks(pa.array([" ".join(words)])):
                window = dc.shingles(dc.words(data, offsets)[2], 5)
            if it.similarity(window, n) >= 0.8:
                similar += 1
                value = int(it.fingerprints(window, np.zeros(1, np.int64), len(window))[0])
                found += n in it.within_radius(value, it.size[n])
    assert similar > 300 and found >= 0.97 * similar, (found, similar)


def test_a_very_long_text(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    got = dc.leaks(docs_of([(1, f"{long} {item} {long}", "s")]), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.start_word) for r in got] == [(1, 400_000)]
