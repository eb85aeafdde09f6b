import random

import pytest

from pagequern.llm import source_mix


def quotas(votes, seats):
    """Highest quotients one after another."""
    got = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportion_is_highest_quotients(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in range(6):
        votes = [r.choice((0, r.randint(1, 9), r.randint(1, 5000))) for _ in range(r.randint(1, 12))]
        rows += [(g, k, float(v), r2) for r2 in [r.choice((0, 1, 5, 40, 997))] for k, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g bigint, k bigint, votes double, seats bigint")
    got = {(r.g, r.k): r.quota for r in source_mix.apportion(df, ["g"], "k", "votes", "seats").collect()}
    for g in range(6):
        own = [x for x in rows if x[0] == g]
        assert [got[g, x[1]] for x in own] == quotas([x[2] for x in own], own[0][3])


def filled(sizes):
    """Targets by resharing what is over the cap."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        weight = sum(i % 3 + 1 for i in free)
        level = {i: rest * (i % 3 + 1) / weight for i in free}
        over = {i for i in free if level[i] > 3 * sizes[i] + 1e-9}
        if not over:
            return [level.get(i, 3 * s) for i, s in enumerate(sizes)]
        capped |= over


def rows_of(seed, n=300):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice((0, 1, 3, 50, r.randint(1, 200)))), r.choice(("big", "big", "big", "b", "c", "Z", "ä", None))) for i in range(n)]
    return [*rows, (1000, None, "c"), (1001, "lone words here", "tiny"), (1001, "lone words here", "tiny"), (None, "a b", None)]


@pytest.mark.parametrize("shard_words", [1 << 20, 500])
def test_mix_meets_targets(docs_of, shard_words):
    rows = rows_of(1)
    got = source_mix.mix(docs_of(rows), shard_words=shard_words).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in names]
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_source.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(by_source) == sorted({(s, round(t, 6)) for s, t in zip(sizes, filled(sizes))})
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= max(3, 0.02 * target)
    again = source_mix.mix(docs_of(rows[::-1]), shard_words=shard_words).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("docs, size, shard_words", [(50, 10, 2000), (40, 30, 300), (1, 600, 100)])
def test_thin_source_meets_target(docs_of, docs, size, shard_words):
    rows = [(i, " ".join(["w"] * 1000), "a") for i in range(60)] + [(1000 + i, " ".join(["w"] * size), "b") for i in range(docs)]
    got = source_mix.mix(docs_of(rows), fineness=1, block_words=200, shard_words=shard_words).collect()
    thin = [r for r in got if r.doc_id >= 1000]
    assert {r.target for r in thin} == {3.0 * docs * size}
    assert sum(r.taken for r in thin) == 3 * docs * size and all(r.taken == 3 * r.size for r in thin)


def test_take_keeps_columns_and_repeats(docs_of):
    docs = docs_of(rows_of(2))
    got = source_mix.take(docs)
    assert [c for c in docs.columns if c in got.columns and c not in ("size", "target")] == [c for c in docs.columns if c not in ("size", "target")]
    assert got.where("taken <= 0 OR taken > 3 * size").count() == 0
    assert got.where("doc_id = 1001").count() in (0, 2)


def test_empty(docs_of):
    assert source_mix.mix(docs_of([])).count() == 0
    got = source_mix.mix(docs_of([(1, None, None), (2, "", "a")])).collect()
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
