import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from pagequern.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_accuracy(found, labels, column, mod, rest):
    rows = found.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", column).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    return np.mean([r.predicted == r[column] for r in out]), [r for r in out if r[column] == 0 and r.predicted], out


def test_toxicity_held_out(tables):
    """A few toxic labels of the table are on texts without anything toxic, 1 in 14 of the English ones."""
    docs, labels = tables
    _, false, out = held_out_accuracy(toxicity.score(docs, labels), labels, "toxic", 3, 1)
    toxic = [r for r in out if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic) and len(false) <= 0.01 * len(out)
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in toxic if langs[r.doc_id] == lang]
        assert sum(r.predicted for r in own) >= 0.85 * len(own), lang


def test_toxicity_scores_equal_single_compressions():
    """Window by window, with one compressor call for each, in plain Python."""
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("abcdefghijé", k=r.randint(1, 9))) for _ in range(n))
    texts = [prose(80) for _ in range(120)] + [f"{prose(40)} Loweian loweiix, {prose(20)} loweitum! {prose(30)}" for _ in range(30)]
    model = toxicity.fit_texts(pa.array(texts), np.array([0] * 120 + [1] * 30))
    assert b"LOWEi" in model.toxic and b"LOWEi" not in model.ordinary

    def size(content, window):
        given = zstandard.ZstdCompressionDict(content + toxicity.PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=given, compression_params=toxicity.parameters()).compress(toxicity.PRIMER + window + toxicity.TAIL))

    def slow(text):
        data = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        shown, groups = bytearray(data), {}
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", data):
            bare = re.fullmatch(rb"[!-/:-@\[-`{-~]*(.*?)[!-/:-@\[-`{-~]*", m[0], re.S)
            at = m.start() + bare.start(1)
            shown[at : at + min(toxicity.CAPITALS, len(bare[1]))] = bytes(x - 32 if 97 <= x <= 122 else x for x in bare[1][: toxicity.CAPITALS])
            groups.setdefault(m.start() // toxicity.WINDOW, []).append(m.span())
        gains = [size(model.ordinary, w) - size(model.toxic, w) for g in groups.values() for w in [bytes(shown[g[0][0] : g[-1][1]])]]
        reached = [sum(g >= least for g in gains) for least in toxicity.GAINS]
        x = [min(n, 3) for n in reached] + [min(20 * n / max(len(gains), 1), 3) for n in reached] + [1]
        return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))

    some = [*texts[::25], "", "Loweian", "... -- !", f"x {'y' * 500} loweitum"]
    fast = toxicity._column_features(pa.array(some), toxicity.Compressor(model.ordinary), toxicity.Compressor(model.toxic)) @ np.array(model.weights)
    assert np.allclose(1 / (1 + np.exp(-np.clip(fast, -30, 30))), [slow(t) for t in some])


def test_quality_held_out(tables):
    docs, labels = tables
    accuracy, _, _ = held_out_accuracy(quality.score(docs, labels), labels, "quality", 5, 0)
    assert accuracy > 0.98


def test_quality_scores_equal_a_scalar_version():
    """Hashes, means and the logistic function in plain Python, for fixed weights."""
    r = np.random.default_rng(2)
    model = quality.Model(r.normal(0, 3, quality.BUCKETS).astype(np.float32).tobytes(), 0.4)
    gains, mask = np.frombuffer(model.gains, np.float32), (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def hashed(b):
        return mix((sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(b)) + len(b)) & mask)

    def slow(text):
        plain = re.sub(rb"[\x20\x09-\x0D]", b" ", text.encode()).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
        words = [hashed(w) for w in plain.split(b" ") if w]
        found = [*words, *(mix((b - a + 1) & mask) for a, b in zip(words, words[1:], strict=False))]
        found += [hashed(plain[i : i + n]) for n in quality.GRAMS for i in range(len(plain) - n + 1)]
        z = sum(float(gains[h & quality.BUCKETS - 1]) for h in found) / max(len(found), 1) + model.bias
        return 1 / (1 + np.exp(-min(max(z, -30), 30)))

    texts = ["Some Words, some\twords", "", "é", "a", "ab cd", "x " * 50, "Überall\n\nnichts  Neues"]
    for _, _, data, offsets in quality.text_chunks(pa.array(texts)):
        assert np.allclose(quality.scores(data, offsets, gains, model.bias), [slow(t) for t in texts])


@pytest.mark.parametrize("module", [toxicity, quality])
def test_a_table_without_texts(spark, module):
    model = module.fit_texts(pa.array(["a", "b"]), np.array([0, 0]))
    got = module.with_score(spark.range(3), model)
    assert got.columns == ["id", "__score"] and len({r["__score"] for r in got.collect()}) == 1


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, docs_of, module, label):
    rows = [(1, None, "s"), (2, "", "s"), (None, "x y", "s"), (3, "wörd " * 3000, "s"), (3, "wörd " * 3000, "s"), (4, " \n", "s")]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = module.score(docs_of(rows), some).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert module.score(docs_of([]), labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)


def test_drop_toxic_keeps_columns(spark, docs_of):
    r = random.Random(2)
    prose = lambda: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(60))
    texts = [(i, prose(), "s") for i in range(200)] + [(i, f"{prose()} idiot {prose()} worthless moron {prose()}", "s") for i in range(200, 300)]
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(texts)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(200))) == 200 and len(ids) < 210


def test_windows_cover_every_word():
    from pagequern.llm._text import text_chunks, words

    texts = pa.array(["one two", None, "x" * 500, "a b " * 100, ""])
    for _, _, data, offsets in text_chunks(texts):
        start, end, _, _ = words(data, offsets)
        ws, we, _ = toxicity.windows(data, offsets)
        assert all(any(a <= s and e <= b for a, b in zip(ws, we, strict=True)) for s, e in zip(start, end, strict=True))
