import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import factorisation, language_id, quality_rules
from assetloom.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, ws string, score string, h string"
ODD = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "ok " * 60_000, None), (None, "der die das und nicht " * 5, "de"), (4, "ok", "en"), (4, "ok", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "w", "s", "h") for i, t, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_language_of_held_out_documents(spark, docs):
    from assetloom.llm.queries import op2_ftrl_language_id

    rows = op2_ftrl_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs):
    model = language_id.train(docs, sample=400)
    rows = frame(spark, ODD)
    got = language_id.predict(rows, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert got[5] == got[6] and len(got) == len(ODD)
    assert language_id.keep_known(rows, model).columns == rows.columns
    assert language_id.predict(frame(spark, []), model).count() == 0
    none = language_id.train(frame(spark, [(1, "a", None)]))
    assert language_id.predict(rows, none).filter("lang_pred <> 'und'").count() == 0


def test_slices_lose_no_ngram(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(1000))
    whole = Counter(np.concatenate(list(language_id.buckets(text))).tolist())
    monkeypatch.setattr(language_id, "_SLICE", 7)
    assert Counter(np.concatenate(list(language_id.buckets(text))).tolist()) == whole
    assert sum(whole.values()) == 1000 + 999 + 998


def test_temperature_softens_what_is_too_sure():
    logits = np.array([[9.0, 0.0], [9.0, 0.0], [0.0, 9.0], [9.0, 0.0]])
    assert language_id.temperature(logits, np.array([0, 0, 1, 1])) > 2


def test_factorisation_of_held_out_documents(spark):
    from assetloom.llm.queries import op9_factorisation_machine

    rows = op9_factorisation_machine(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_sum_of_squares_identity_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    model = factorisation.fit([])
    model.w[:], model.v[:] = rng.normal(size=model.w.shape), rng.normal(size=model.v.shape)
    at, x = factorisation.features("One two two THREE | four")
    pairs = sum(model.v[at[i]] @ model.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert model.raw(at, x) == pytest.approx(model.bias + x @ model.w[at] + pairs)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (4, 1), (4, 0)], "doc_id long, quality int")
    fitted = factorisation.train(frame(spark, ODD), labels)
    got = factorisation.score(frame(spark, ODD), fitted).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = factorisation.train(frame(spark, []), labels)
    assert {r.score for r in factorisation.score(frame(spark, ODD), empty).collect()} == {0.5} or all(abs(r.score - 0.5) < 0.2 for r in factorisation.score(frame(spark, ODD), empty).collect())


def slow_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_brute_force(spark):
    rng = random.Random(7)
    texts = [t for _, t, _ in ODD] + ["a b c d e a b c d e", "a a a a a a", "x\nx\n \nx\n", " lead", "tail ", "a\x0bb\x0cc\rd", "é# $é <>|", "one two three four five"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["\n".join(rng.choice(["p q", "r", " "]) for _ in range(12)) for _ in range(10)]
    rows = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for r in quality_rules.quality(rows, labels).collect():
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_follow_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = quality_rules.quality(docs, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality(docs, none).filter("NOT base_failed AND NOT kept").count() == 0
    assert quality_rules.quality(frame(spark, []), none).count() == 0


def test_every_good_document_is_in_the_target(spark):
    docs = spark.range(50_000).selectExpr("id AS doc_id", "concat('all w', id % 7, ' x', id % 11) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert quality_rules.target_ids(labels).count() == 50_000
    assert {r.llr for r in quality_rules.quality(docs, labels).select("llr").distinct().collect()} == {0.0}


def test_verdicts_do_not_depend_on_the_size_of_the_corpus(spark):
    docs, labels = (table(spark, SF, t) for t in ("documents", "labels"))
    found = []
    for copies in (1, 3):
        more = lambda df: df.crossJoin(spark.range(copies)).withColumn("doc_id", F.col("doc_id") * 3 + F.col("id")).drop("id")  # noqa: E731, B023
        rows = quality_rules.quality(more(docs), more(labels)).filter("doc_id % 3 = 0").collect()
        found.append({r.doc_id: (r.kept, round(r.llr, 3)) for r in rows})
    assert found[0] == found[1]


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.mark.parametrize("bitmaps", [1 << 12, 0])
def test_the_ratio_against_a_plain_version(spark, bitmaps, monkeypatch):
    """Words spell their own bucket, by either way of marking the target; ids are negative, far apart, null and repeated."""
    monkeypatch.setattr(quality_rules, "BITMAPS", bitmaps)
    rng = random.Random(8)
    ids = [-70_000, -32_768, -1, 0, 1, 32_767, 32_768, 2**40, 2**62 + 1, None, 7, 7]
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(10, 60))) for _ in ids[:-2]] + ["ax bx " * 10, None]
    good = {-70_000, -1, 0, 32_768, 2**62 + 1, 7, 99}
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in good] + [(7, 1), (None, 1), (1, 0)], "doc_id long, quality int")
    every = sorted({w for t in texts for w in plain_words(t)})
    both = sorted({p for t in texts for p in zip(plain_words(t), plain_words(t)[1:])})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", quality_rules._word_bucket(F.col("w")).alias("b")).collect()}
    bucket |= {(r.a, r.b): r.k for r in spark.createDataFrame(both, "a string, b string").select("a", "b", quality_rules._pair_bucket(F.col("a"), F.col("b")).alias("k")).collect()}
    grams = [[bucket[g] for g in plain_words(t)] + [bucket[g] for g in zip(plain_words(t), plain_words(t)[1:])] for t in texts]
    table_, size = {}, quality_rules.BUCKETS
    for half in (0, 1):
        raw, target = Counter(), Counter()
        for i, own in zip(ids, grams):
            mine = [b for b in own if b // size == half]
            raw.update(mine)
            target.update(mine if i in good else [])
        part, shrink = sum(target.values()) / sum(raw.values()), quality_rules.SMOOTHING * sum(target.values()) / size
        table_ |= {b: round(math.log((target[b] + shrink) / (raw[b] * part + shrink)), 4) for b in raw}
    want = sorted((str(i), round(sum(table_[b] for b in own) / len(own), 6) if own else 0.0) for i, own in zip(ids, grams))
    got = quality_rules.quality(docs, labels).collect()
    assert sorted((str(r.doc_id), round(r.llr, 6)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD) for r in got)
