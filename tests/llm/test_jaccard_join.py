import random

import numpy as np
import pytest

from pagequern.llm import jaccard_join as jj


def sets_of(text, k):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def rows_of(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocabulary, k=40))
    rows = []
    for g in range(25):
        base = r.choices(vocabulary, k=r.choice((1, 3, 4, 6, 12, 30, 80, 200, 500)))
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(r.choice((0, 0, 1, 2, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(vocabulary).upper()
            text = " ".join(own) + (" " + passage if r.random() < 0.3 else "")
            rows.append((len(rows), text, "s"))
    return [*rows, (900, None, "s"), (901, "", "s"), (902, " \t\n", "s"), (5, rows[5][1], "s"), (None, rows[7][1], "s"), (None, "only one", "s")]


@pytest.mark.parametrize(("seed", "k", "percent", "options"), [(1, 4, 85, {}), (2, 5, 80, {"block_shingles": 600}), (3, 4, 85, {"broadcast_rows": 0})])
def test_components_match_brute_force(docs_of, seed, k, percent, options):
    rows = rows_of(seed)
    got = jj.cluster(docs_of(rows), k=k, percent=percent, **options)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [50, 75])
def test_any_threshold_matches_brute_force(docs_of, percent):
    rows = rows_of(percent)
    got = jj.cluster(docs_of(rows), k=4, percent=percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, 4, percent)


def test_a_hot_key_is_spread(docs_of, monkeypatch):
    """Most rows share keys: none of the bounds on a group, a sample or a block hides a link or adds one, and no group is gathered."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(r.choice((0, 1, 1, 2))):
            own[r.randrange(60)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(own), "s"))
    rows += [(1000 + i, " ".join(f"w{j}" for j in range(40)) + " " + " ".join(f"y{i}z{j}" for j in range(r.randint(0, 25))), "s") for i in range(60)]
    for name, value in (("CROWD", 20), ("GROUP", 4), ("SAMPLE", 2), ("_LEAST_SET", 1)):
        monkeypatch.setattr(jj, name, value)
    for block in (400, 1 << 21):
        got = jj.cluster(docs_of(rows), k=4, percent=85, block_shingles=block)
        assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()), key=str) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 70, 80, 85])
def test_linked_sets_share_a_key(percent):
    """Whatever the sizes, two sets at the threshold share a key of a common band."""
    r, bands = np.random.default_rng(percent), jj.Bands(percent)
    for _ in range(400):
        n = int(r.integers(2, 600))
        common = r.integers(0, 1 << 64, n, dtype=np.uint64)
        most = n * (100 - percent) // percent
        extra = r.integers(0, 1 << 64, most, dtype=np.uint64)
        cut = int(r.integers(0, most + 1))
        a, b = (np.unique(np.concatenate([common, x])) for x in (extra[:cut], extra[cut:]))
        keys = [set(np.concatenate([np.zeros(0, np.uint64), *(bands.keys(i, x) for i in bands.of(len(x)))]).tolist()) for x in (a, b)]
        assert np.array_equal(a, b) or keys[0] & keys[1]


def test_bitmap_bound_loses_no_link():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = sorted((np.unique(np.concatenate([base[r.random(300) > 0.06], r.integers(0, 1 << 64, 5, dtype=np.uint64)])) for _ in range(60)), key=len)
    links = jj.tile_forest(list(range(60)), sets, 85)
    root = list(range(60))
    for a, b in links:
        x, y = root[a], root[b]
        root = [x if v == y else v for v in root]
    for i in range(60):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                assert root[i] == root[j]


def test_survivors(docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "a"), (2, text + " tail", "a"), (3, "other words", "a"), (4, None, "a"), (5, "", "a"), (3, "other words", "a")]
    docs = docs_of(rows)
    got = jj.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]


def test_empty(docs_of):
    assert jj.cluster(docs_of([])).count() == 0
    assert jj.drop_near_copies(docs_of([])).count() == 0
