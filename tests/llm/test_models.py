import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import mixing, quality
from ledgerwatch.llm.common import materialize
from ledgerwatch.llm.decontaminate import WINDOW, allowed, find_overlaps, masks
from ledgerwatch.llm.ngrams import discounts, lm_scores
from tests.conftest import SF
from tests.llm.plain import SCHEMA, odd_docs, tokens


def plain_lm(rows, order):
    """Scores by dictionaries: the same model, written down from its definition."""
    texts = [(i, tokens(t) + ["</s>"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t, *_ in rows]
    raw, grams = Counter(), {order: Counter()}
    for _, w, held in texts:
        if not held:
            raw.update(w)
            padded = ["<b>"] * (order - 1) + w
            grams[order].update(tuple(padded[k: k + order]) for k in range(len(w)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    total, size, found = sum(raw.values()), len(raw), {}
    for n, c in grams.items():
        contexts = defaultdict(lambda: [0, 0, 0, 0])
        for g, x in c.items():
            contexts[g[:-1]][0] += x
            contexts[g[:-1]][min(x, 3)] += 1
        found[n] = (discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))), contexts)

    def p(gram):
        value = 1 / (size + 1)
        for n in range(1, order + 1):
            own, (d, contexts) = gram[order - n:], found[n]
            if own[:-1] in contexts:
                t, x = contexts[own[:-1]], grams[n].get(own, 0)
                value = (x - d[min(x, 3)] if x else 0) / t[0] + sum(d[k] * t[k] for k in (1, 2, 3)) / t[0] * value
        return value

    scores = []
    for i, w, held in texts:
        padded = ["<b>"] * (order - 1) + w
        scores.append((i, held, len(w), sum(x in raw for x in w), total, sum(math.log10((raw[x] + 0.5) / (total + 0.5 * (size + 1))) for x in w), sum(math.log10(p(tuple(padded[k: k + order]))) for k in range(len(w)))))
    return scores, p, [*raw, "never seen"]


def rounded(rows):
    return Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in rows)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_matches_its_definition(spark, order):
    rows = odd_docs()
    want, p, vocabulary = plain_lm(rows, order)
    got = lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), order=order)
    assert rounded(tuple(r) for r in got.collect()) == rounded(want)
    for front in ("w1", "never seen", "<b>"):
        assert sum(p((front,) * (order - 1) + (w,)) for w in vocabulary) == pytest.approx(1)


def test_registered_language_model_sees_two_words_of_context(spark, tmp_path):
    from ledgerwatch.llm.queries import QUERIES

    rows = odd_docs()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert rounded(tuple(r) for r in QUERIES["op2_lm_scoring"](spark, str(tmp_path)).collect()) == rounded(plain_lm(rows, 3)[0])


def test_language_model_without_training_rows(spark):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1]
    docs = spark.createDataFrame([(k, "some words", *[None] * 5) for k in held], SCHEMA)
    assert {tuple(r)[1:7] for r in lm_scores(docs).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}
    assert lm_scores(docs.limit(0)).collect() == []


def test_quality_finds_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    found = quality.quality(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    wrong = sum(r["predicted"] != r["quality"] for r in found)
    assert len(found) > 60 and wrong <= 0.05 * len(found)


def test_quality_of_odd_rows(spark):
    rows = odd_docs()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(6, 1), (6, 1), (7, 0), (8, None), (None, 1), (999, 0), (9, 1)], "doc_id long, quality int")
    got = quality.quality(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.quality(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []


def test_quality_fits_one_row_of_an_id(spark, monkeypatch):
    """Rows that repeat a labelled id do not add to what the driver holds, nor change the model."""
    base = [(k, f"text number {k}, " * (k % 9 + 1), *[None] * 5) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    shapes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: shapes.append(x.shape) or fit(x, y))
    once = quality.train(spark.createDataFrame(base, SCHEMA), labels)
    again = quality.train(spark.createDataFrame(base * 30, SCHEMA).repartition(5), labels)
    assert shapes[0] == shapes[1] and shapes[0][0] == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))
    assert all((a == b).all() for a, b in zip(once.tables, again.tables))


def test_quality_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    x[:20, 2] = x[0, 2]
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    bin_of = lambda k, v: sum(v >= b for b in model.borders[k])
    for row, score in zip(x, model.score(x)):
        total = model.base + sum(model.tables[k][bin_of(k, row[k])] for k in range(4))
        total += sum(t[bin_of(i, row[i]), bin_of(j, row[j])] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_measures_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t, *_ in odd_docs()]
    whole = quality.measure(pa.array(texts, pa.binary()))
    alone = np.concatenate([quality.measure(pa.array([t], pa.binary())) for t in texts])
    np.testing.assert_allclose(whole, alone)
    assert not whole[[k for k, t in enumerate(texts) if not t]].any()


def test_pair_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    both, single = quality.fit(x, y), quality.fit(x, y, pairs=0)
    right = lambda m: ((m.score(x) > 0.5) == y).mean()
    assert right(both) > 0.95 > 0.7 > right(single) and {(i, j) for i, j, _ in both.pairs} >= {(0, 1)}


@pytest.mark.parametrize("size", range(1, WINDOW + 1))
def test_masks_survive_all_allowed_replacements(size):
    from itertools import combinations

    for hole in combinations(range(size), size - allowed(size)):
        assert any(not {o + p for p in m} & set(hole) for m in masks(size) for o in range(size - m[-1]))


def plain_overlaps(docs, items):
    out = Counter()
    for i, t, *_ in docs:
        w, found = tokens(t), set()
        for item, text in items:
            b = tokens(text)
            size = min(WINDOW, len(b))
            if size and any(
                sum(x == y for x, y in zip(w[p: p + size], b[q: q + size])) >= allowed(size)
                for p in range(len(w) - size + 1) for q in range(len(b) - size + 1)
            ):
                found.add(item)
        out[(i, bool(found), tuple(sorted(found)))] += 1
    return out


def test_overlaps_match_plain_search(spark):
    rows = odd_docs()
    source = tokens(next(t for i, t, *_ in rows if i == 13))
    items = [(1, " ".join(source[20:60])), (2, " ".join(source[25:30])), (3, "never there at all"), (4, None), (5, ""), (6, "ONE"), (7, " ".join(tokens(rows[0][1])[:13]))]
    edited = source[20:60]
    for k in range(0, 40, 6):
        edited[k] = "changed"
    rows += [(200, " ".join(["x"] * 9 + edited), *[None] * 5), (201, " ".join(e if k % 3 else "no" for k, e in enumerate(source[20:60])), *[None] * 5)]
    docs, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    want = plain_overlaps(rows, items)
    for block in (8 << 20, 100):
        got = find_overlaps(docs, benchmark, block_bytes=block).collect()
        assert Counter((r["doc_id"], r["contaminated"], tuple(sorted(r["items"]))) for r in got) == want
    found = next(r for r in find_overlaps(docs, benchmark).collect() if r["doc_id"] == 200)
    assert (found["starts"][0], found["lengths"][0], found["equal"][0]) == (9, 40, 33) or found["lengths"][0] >= WINDOW


def test_overlaps_with_nothing(spark):
    docs = spark.createDataFrame(odd_docs(), SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in find_overlaps(docs, none).collect())
    assert find_overlaps(docs.limit(0), none).collect() == []


def test_rates_meet_the_targets_like_plain_descent(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(0, 500, 400)
    known = materialize(spark.createDataFrame([(i, i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, tie long, n_tokens long, p array<double>"), "known")
    weights = [0.7, 0.2, 0.1]
    steps, targets, reached = mixing.fit_rates(known, weights)
    np.testing.assert_allclose(targets, n.sum() * np.array(weights))
    np.testing.assert_allclose(reached, targets, atol=1e-5 * n.sum())
    rate = np.ones(400)
    for s in steps:
        rate = np.maximum(0, rate - p @ s)
    got = np.array([r["r"] for r in known.orderBy("doc_id").select(mixing.rate_of(steps, 3).alias("r")).collect()])
    np.testing.assert_allclose(got, rate, atol=1e-9)
    np.testing.assert_allclose((n * rate) @ p, reached)


def test_targets_that_cannot_be_met_end_at_least_squares(spark):
    known = spark.createDataFrame([(1, 1, 100, [0.5, 0.5]), (2, 2, 50, [0.5, 0.5])], "doc_id long, tie long, n_tokens long, p array<double>")
    _, targets, reached = mixing.fit_rates(known, [0.9, 0.1])
    np.testing.assert_allclose(reached, [75, 75], rtol=1e-3)


def test_mixing_of_odd_rows(spark):
    rows = odd_docs()
    docs = spark.createDataFrame(rows, SCHEMA)
    labelled = spark.createDataFrame([(6, "a"), (7, "b"), (7, "b"), (8, None), (9, "other"), (None, "a")], "doc_id long, domain string")
    got = mixing.mix_sources(docs, labelled, {"a": 1.0, "b": 1.0}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["p_a"] + r["p_b"] == pytest.approx(1) and r["rate"] >= 0 and math.floor(r["rate"] - 0.01) <= r["copies"] <= math.ceil(r["rate"] + 0.01)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(tokens(t))) for i, t, *_ in rows)
    assert mixing.mix_sources(docs.limit(0), labelled, {"a": 1.0, "b": 1.0}).collect() == []


def test_mixing_meets_targets_on_labelled_words(spark):
    rows = [(k, f"{'sun' if k % 3 else 'moon'} word{k % 7} " * (1 + k % 5)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "day" if k % 3 else "night") for k in range(0, 300, 2)], "doc_id long, domain string")
    got = mixing.mix_sources(docs, labelled, {"day": 1.0, "night": 3.0}).collect()
    total = sum(r["n_tokens"] for r in got)
    for side, share in (("p_day", 0.25), ("p_night", 0.75)):
        assert sum(r["rate"] * r[side] * r["n_tokens"] for r in got) == pytest.approx(share * total, rel=1e-4)
    assert all((r["p_day"] > 0.9) == bool(r["doc_id"] % 3) for r in got)


def test_mixing_separates_held_out_domains(spark):
    folder = f"{SF.rsplit('/', 1)[0]}/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labelled = mixing.label_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    fitted, rest = labelled.where(F.col("doc_id") % 2 == 0), labelled.where(F.col("doc_id") % 2 == 1)
    base, weights = mixing.classifier(docs, fitted, ["clean", "junk", "toxic"], "doc_id", "text")
    found = mixing.posteriors(docs.join(rest.select("doc_id"), "doc_id"), base, weights, "doc_id", "text").join(rest, "doc_id")
    best = F.element_at(F.array(*map(F.lit, ["clean", "junk", "toxic"])), F.array_position("p", F.array_max("p")).cast("int"))
    right = found.agg(F.avg((best == F.col("domain")).cast("int"))).first()[0]
    assert right > 0.9
