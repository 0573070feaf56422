"""Whitening against a dense eigensolver, quality on held-out labels, spelling against all deletions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from treeshift.llm import quality, spelling, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, component int, whitened double, scaled int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 0.5, 2) for i, v in rows], VECTORS).repartition(3)


def dense(rows, components=16):
    """Codes, n, S and the leading pairs of the fit list, by definition."""
    x = {}
    for i, v in rows:
        x.setdefault(i, []).append(np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) + 1_000_000)
    every = np.array([c for codes in x.values() for c in codes])
    fit = np.unique(every, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    gap = fit - sums / n
    values, directions = np.linalg.eigh(gap.T @ gap / n)
    order = np.argsort(-values)[:components]
    return x, n, sums, values[order], directions[:, order], np.trace(gap.T @ gap) / n


def stretched(count, size, seed=0):
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(size, size)) * np.geomspace(1, 0.05, size)
    return [(i, [float(c) for c in np.float32(rng.normal(size=size) @ shape.T)]) for i in range(count)]


def test_whitening_is_the_dense_one(spark):
    rows = stretched(400, 40)
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # equal vectors count once in the fit
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    odd = [(5000, None), (5001, []), (5002, [1.0, None] * 20), (5003, [float("nan")] * 40), (5004, [float("inf")] * 40)]
    odd += [(5005, [1.0]), (5006, [1e30] * 40)]
    got = whitening.whitened(vectors(spark, rows + odd)).toPandas()
    x, n, sums, values, directions, trace = dense(rows)
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    signs = np.zeros(16)
    for key, part in got.groupby(got["vec_id"].fillna(-1)):
        code = x[None if key == -1 else int(key)][0]
        want = (code - sums / n) @ directions / np.sqrt(values)
        for row in part.itertuples():
            k = row.component - 1
            signs[k] = signs[k] or np.sign(row.whitened * want[k])
            assert abs(signs[k] * row.whitened - want[k]) < 1e-8
            assert row.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(code, sums))
            assert abs(row.explained / (values[k] / trace) - 1) < 1e-9


def test_whitening_of_few_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]  # all on one line
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert set(got["component"]) == {1} and len(got) == 6
    assert got["explained"].sub(1).abs().max() < 1e-12
    assert abs((got["whitened"] ** 2).mean() - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


@pytest.mark.parametrize("size, rank, wanted", [(6, 6, 6), (30, 9, 12), (120, 120, 16), (90, 90, 1)])
def test_jacobi_davidson_finds_the_leading_pairs(size, rank, wanted):
    rng = np.random.default_rng(size)
    root = rng.normal(size=(size, rank))
    square = root @ root.T / rank
    seen = []

    def apply(block):
        seen.append(block.shape[1])
        return square @ block

    values, directions = whitening.leading_pairs(apply, size, wanted)
    want = np.linalg.eigvalsh(square)[::-1][:wanted]
    assert np.allclose(values, want, atol=1e-12 * want[0])
    assert np.linalg.norm(square @ directions - directions * values, axis=0).max() < 2e-13 * want[0] * 10
    assert np.allclose(directions.T @ directions, np.eye(wanted), atol=1e-12)
    assert max(seen) <= wanted + 8


def test_equal_eigenvalues():
    values, directions = whitening.leading_pairs(lambda b: 3.0 * b, 20, 4)
    assert np.allclose(values, 3) and np.allclose(directions.T @ directions, np.eye(4))


def test_deviation_beyond_a_long():
    middle = whitening.Centre(1 << 30, tuple([(1 << 30) * 7] * 4))
    exact = middle.deviations(np.array([[7, 7, 7, 8], [7, 7, 7, 7 + (1 << 20)]]))
    assert exact == [1 << 60, None]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, quality int, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, 1, 1) for i, t in rows], DOCS).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, 0, "x") for i, q in rows], "doc_id long, quality int, toxic int, text string")


def graded(count, seed=4):
    rng = random.Random(seed)
    words = "the river runs past an old mill and over stones to a quiet harbour".split()
    texts, marks = [], []
    for i in range(count):
        text = " ".join(rng.choices(words, k=rng.randint(8, 60)))
        bad = rng.random() < 0.3
        texts.append((i, text.upper() + "!!! BUY $$$" if bad else text.capitalize() + "."))
        marks.append((i, 0 if bad else 1))
    return texts, marks


def test_quality_on_held_out_labels(spark):
    texts, marks = graded(600)
    odd = [(9000, None), (9001, ""), (9002, "x" * 300_000), (None, "no id"), (3, texts[3][1])]
    more = [(9001, None), (77777, 1), (None, 0), (9000, 5)]
    got = quality.qualities(documents(spark, texts + odd), labels(spark, marks + more)).collect()
    assert len(got) == len(texts) + len(odd)
    answer = dict(marks)
    for row in got:
        text = b"" if row.doc_id is None else str(row.doc_id).encode()
        assert row.held_out == (zlib.crc32(text) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
    judged = [r for r in got if r.held_out and r.doc_id in answer]
    assert len(judged) > 150
    assert sum(r.predicted == answer[r.doc_id] for r in judged) >= 0.98 * len(judged)
    again = quality.qualities(documents(spark, texts + odd), labels(spark, marks + more)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_learns_from_rows_that_are_not_held_out(spark):
    texts, marks = graded(120)
    hidden = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = [(i, 1 - q if i in hidden else q) for i, q in marks]
    docs = documents(spark, texts)
    scores = [sorted(map(str, quality.qualities(docs, labels(spark, m)).collect())) for m in (marks, wrong)]
    assert scores[0] == scores[1]


def test_quality_learns_from_all_labelled_rows(spark):
    drawn = F.pmod(F.xxhash64("id", F.lit("quality sample")), F.lit(1 << 30))
    rows = spark.range(2800).select("id", F.row_number().over(Window.orderBy(drawn, "id")).alias("place"))
    docs = rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("calm words "), F.col("id").cast("string")).alias("text"), "place")
    bad = spark.range(5000, 5100).select(F.col("id").alias("doc_id"), F.concat(F.lit("LOUD!! "), F.col("id").cast("string")).alias("text"), F.lit(0).alias("place"))
    docs = docs.unionByName(bad).repartition(3).cache()
    known = docs.select("doc_id", (F.col("place") > 0).cast("int").alias("quality"))
    others = docs.withColumn("text", F.when(F.col("place") > 2000, F.concat("text", F.lit(" of another kind"))).otherwise(F.col("text")))
    first, again, changed = (quality.train(d.select("doc_id", "text"), known) for d in (docs, docs, others))
    assert np.array_equal(first.weights, again.weights) and (first.threshold, first.slope) == (again.threshold, again.slope)
    assert not np.array_equal(first.weights, changed.weights)
    assert (first.scores([b"calm words 7"]) > 0.5).all() and (first.scores([b"LOUD!! 7"]) < 0.5).all()


def test_quality_threshold_is_a_quantile_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "BINS", 7)
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(-(10**12), 10**12)) for _ in range(500)] + [(1, 5)] * 40
    weight = {q: 0.5 / sum(r[0] == q for r in rows) for q in (0, 1)}
    judged = spark.createDataFrame(rows, "quality int, strength bigint").repartition(3)
    for share in (0.001, 0.3, 0.52, 0.999, 1.0):
        total, at = 0.0, None
        for strength in sorted({s for _, s in rows}):
            total += sum(weight[q] for q, s in rows if s == strength)
            if total >= share - 1e-12:
                at = strength
                break
        after = min((s for _, s in rows if s > at), default=at)
        assert quality._threshold(judged, weight, share) == (at + after) / 2 / quality.UNIT


@pytest.mark.parametrize("marks, want", [([], 0.5), ([(0, 1), (2, 1), (3, 1)], 1.0)])
def test_quality_without_pairs(spark, marks, want):
    got = quality.qualities(documents(spark, [(0, "a"), (2, None), (3, "")]), labels(spark, marks)).collect()
    assert [r.score for r in got] == [want] * 3


def test_no_documents_have_no_quality(spark):
    assert quality.qualities(documents(spark, []), labels(spark, [(1, 1)])).collect() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    texts = [b"", b"a", bytes(range(1, 250)) * 9, b"abc" * 50]
    whole = quality.features(texts)
    monkeypatch.setattr(quality, "PIECE", 100)
    assert np.array_equal(whole, quality.features(texts))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    found = collections.Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return found


def neighbours(words):
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for word in words:
        for p in range(len(word)):
            short = word[:p] + word[p + 1 :]
            holes[word[:p], word[p + 1 :]].add(word)
            if short in words:
                near[word].add(short)
                near[short].add(word)
    for group in holes.values():
        for word in group:
            near[word] |= group - {word}
    return near


def grouped(rows, shortest=5, least=3):
    words = {w: n for w, n in counted(rows).items() if len(w) >= shortest and n >= least}
    near, form = neighbours(words), {}
    for word in words:
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        if best is not None and words[best] >= 2 * words[word]:
            form[word] = best
    out = {}
    for word, n in words.items():
        root = word
        while root in form:
            root = form[root]
        out[word] = (form.get(word), root, n, len(near[word]), words[form[word]] if word in form else None)
    return out


def speech(seed=9):
    rng = random.Random(seed)
    parts = "an er th on é st ñd ly ing ou ß ÿÀ".split()
    stock = ["".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(300)]
    rows = [
        (None, "Nobody nobody nobody nobodÿ"), (0, None), (1, ""), (2, "12 ×÷ 中文 a"), (3, "colour Colour COLOUR color color"),
        (3, "colour Colour COLOUR color color"), (4, "x" * 20_000 + " " + "x" * 20_000), (5, "x" * 20_000 + " " + "x" * 19_999),
        (6, "x" * 19_999 + " " + "x" * 19_999), (7, "straße·straße, straſe STRASSE strassÉ éÉ ÀÀÀÀÀ ààààà"),
    ]
    for i in range(150):
        words = rng.choices(stock, k=120)
        for at in range(0, 120, 9):
            word = words[at]
            p = rng.randrange(len(word))
            words[at] = rng.choice([word[:p] + word[p + 1 :], word[:p] + "e" + word[p:], word[:p] + "o" + word[p + 1 :], word.upper()])
        rows.append((100 + i, rng.choice([" ", "\n", "-", "’"]).join(words)))
    return rows


@pytest.mark.parametrize("part, groups", [(2048, 6), (16, 2), (5, 1)])
def test_spelling_is_brute_force(spark, monkeypatch, part, groups):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "group_count", lambda words: groups)
    rows = speech()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(documents(spark, rows)).collect()}
    want = grouped(rows)
    assert sum(v[0] is not None for v in want.values()) > 30
    assert got == want


def test_words_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = speech(2)[:60]
        got = {r.word: r.n_near for r in spelling.variants(documents(spark, rows), 2, 1).collect()}
        assert got == {w: v[3] for w, v in grouped(rows, 2, 1).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_chain_of_forms_ends_at_its_root(spark):
    words = ["aaaaaa" + "b" * k for k in range(12)]
    forms = spark.createDataFrame(list(zip(words[:-1], words[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {w: words[-1] for w in words[:-1]}


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "a b c")]):
        got = spelling.variants(documents(spark, rows))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.collect() == []


def test_hashes_are_those_of_zlib():
    texts = ["Abc déf ÿ", "", "É x" + "y" * 40]
    assert spelling.count_runs(["1", "2", "3"], [t.encode() for t in texts], 1) == counted(zip([1, 2, 3], texts))
