import hashlib

from pagequern.llm import exact_dedup

ROWS = [(1, "Same text", "a"), (2, "same TEXT", "a"), (3, "other", "b"), (4, None, "b"), (5, "", None), (6, "ÄB", "c"), (7, "äb", "c"), (None, "same text", "a"), (3, "other", "b")]


def test_decisions(docs_of):
    got = exact_dedup.decide(docs_of(ROWS)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert (by[1][0].keep_id, by[1][0].group_size, by[1][0].kept) == (2, 3, False)
    assert by[2][0].kept and not by[None][0].kept and by[None][0].keep_id == 2
    assert by[4][0].keep_id == 5 and by[5][0].kept  # null is empty
    assert by[6][0].kept and by[7][0].kept  # only A-Z is lowered
    assert sorted(r.kept for r in by[3]) == [False, True]  # a repeated row stays once
    assert by[1][0].text_sha256 == hashlib.sha256(b"same text").hexdigest()


def test_heavy_digests_are_found_and_settled(spark, docs_of):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}", "s") for i in range(600)]
    heavy = exact_dedup.heavy_digests(exact_dedup.digest_table(docs_of(rows)), 0.01).collect()
    assert [r.group_size for r in heavy] == [200]
    for support in (0.01, 0.0001, 0.9):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.decide(docs_of(rows), support=support).collect()}
        groups = {}
        for i, t, _ in rows:
            groups.setdefault(t, []).append(i)
        assert got == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_survivors(docs_of):
    docs = docs_of(ROWS)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, "same TEXT"), (3, "other"), (5, ""), (6, "ÄB"), (7, "äb")]


def test_empty(docs_of):
    assert exact_dedup.decide(docs_of([])).count() == 0
    assert exact_dedup.drop_copies(docs_of([])).count() == 0
