import hashlib
import os
import random

import pytest

from pagequern.llm import suffix_dedup as sd
from pagequern.llm._suffix_runs import Run, common_prefix, merge, pack, unpack


def brute(docs, length=100):
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) of each row, in order of id, nulls last."""
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, seed):
    r = random.Random(seed)
    letters = "abc dé" if seed == 1 else "abcdefgh "
    passages = ["".join(r.choices(letters, k=n)) for n in (90, 120, 150, 400)]
    rows = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(0, 200))) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "a" * 1000, "s"), (503, "a" * 99, "s"), (504, "ab" * 300, "s"), (505, "a" * 150, "s"), (None, rows[3][1], "s"), (7, rows[7][1], "s")]
    got = sd.removed(docs_of(rows)).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=str) == brute([(i, t) for i, t, _ in rows])
    for x in got:
        assert sum(s.end - s.start for s in x.spans) == x.n_removed and len(x.spans) == x.n_spans


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_anchors_are_split(docs_of, monkeypatch, seed):
    """A passage in most texts, after and before text of their own: the result is the same, and no bucket gets all of them."""
    for name, value in (("SAMPLE", 2), ("HOT_LEAST", 3), ("RUN", 50)):
        monkeypatch.setattr(sd, name, value)
    r = random.Random(seed)
    letters = "ab" if seed == 1 else "abcdefghijklmnop "
    passage = "".join(r.choices("abcdefgh ", k=230))
    rows = [(i, "".join(r.choices(letters, k=r.randint(0, 60))) + (passage if i % 4 else passage[r.randint(0, 90) :]) + "".join(r.choices(letters, k=r.randint(0, 150))), "s") for i in range(90)]
    rows += [(100, rows[3][1], "s"), (3, rows[3][1], "s"), (101, rows[5][1] + rows[5][1], "s"), (None, passage * 2, "s")]
    got = sd.removed(docs_of(rows)).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=str) == brute([(i, t) for i, t, _ in rows])


def test_split_suffixes_of_equal_windows_meet():
    """For every distance, equal windows get one name, and a suffix's spans hold each of its windows once."""
    r = random.Random(4)
    gram = bytes(r.choices(b"xyz", k=32))
    for _ in range(200):
        left, right = bytes(r.choices(b"ab", k=68)), gram + bytes(r.choices(b"ab", k=68))
        high, low = r.randint(0, 68), 0
        other = bytes(r.choices(b"ab", k=68))
        cut = r.randint(0, 68)
        spans = [list(sd.split_suffix(right[: 100 - low], x[:h], low, 7, 100)) for x, h in ((left, high), (left[:cut] + other[cut:], 68))]
        for o in range(min(high, cut) + 1):
            names = [[n for rr, ll, first, n in own if first <= o <= len(ll) and len(rr) >= 100 - o] for own in spans]
            assert names[0] == names[1] and len(names[0]) == 1


def test_small_runs_and_buckets_and_shuffled_texts(docs_of, monkeypatch):
    for name, value in (("RUN", 7), ("BUCKET", 5), ("BROADCAST_PLACES", 0), ("BROADCAST_SPANS", 0), ("SEGMENT", 300)):
        monkeypatch.setattr(sd, name, value)
    r = random.Random(5)
    passage = "".join(r.choices("abcdef ", k=260))
    rows = [(i, "".join(r.choices("abcdef ", k=r.randint(0, 700))) + (passage if i % 3 == 0 else ""), "s") for i in range(40)]
    got = sd.removed(docs_of(rows)).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=str) == brute([(i, t) for i, t, _ in rows])


def test_empty(docs_of):
    assert sd.removed(docs_of([])).count() == 0


def test_merge_is_sorted_with_common_prefixes():
    r = random.Random(3)
    for _ in range(100):
        runs = []
        for _ in range(r.randint(0, 9)):
            s = sorted(bytes(r.choices(b"ab", k=r.randint(0, 9))) for _ in range(r.randint(0, 8)))
            runs.append((s, [0 if i == 0 else common_prefix(s[i - 1], s[i]) for i in range(len(s))]))
        out = list(merge(runs))
        got = [runs[k][0][i] for k, i, _ in out]
        assert got == sorted(x for s, _ in runs for x in s)
        assert all(n == common_prefix(a, b) for a, b, (_, _, n) in zip(got, got[1:], out[1:], strict=False))


def test_pack_round_trip():
    s = sorted(os.urandom(20)[: i % 20] for i in range(50))
    run = Run(s, [0 if i == 0 else common_prefix(s[i - 1], s[i]) for i in range(50)], s[::-1])
    run.about.resize((50, 4), refcheck=False)
    back = unpack(pack(run))
    assert (back.right, back.lcp, back.left) == (run.right, run.lcp, run.left) and back.about.shape == (50, 4)
