import zlib

import numpy as np

from cellweft.llm import toxicity


def corpus(spark, n=1500):
    rng = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, 25))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["rottenish"] * insult + ["martians"] * group
        rng.shuffle(words)
        docs.append((k, " ".join(words).title(), 9, "x"))
        labels.append((k, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, toxic int, held_out string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learns_the_pair_that_neither_word_shows(spark):
    docs, labels = corpus(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(spark, 400)
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    flipped = labels.selectExpr("doc_id", f"case when doc_id in ({','.join(map(str, held))}) then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "…"), (3, "rottenish martians " * 30_000)], "doc_id bigint, text string")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (None, 1, 2)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    for table, value in ((labels.limit(0), 0), (labels.where("toxic = 1"), 1)):
        assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, table)).collect()} == {value}


def test_learns_an_interaction_without_any_main_effect():
    rng = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(np.sort(np.concatenate([rng.choice(60, 20, replace=False), [100] * int(a), [101] * int(b)])).astype(np.int32))
        y.append(float(a ^ b))
    model = toxicity.fit(texts[:2000], np.array(y[:2000]))
    place = {int(b): k for k, b in enumerate(model.buckets)}
    own = [[place[t] for t in x.tolist() if t in place] for x in texts[2000:]]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    got = model.score(row, np.concatenate([np.array(x, int) for x in own]), len(own))
    assert np.mean((got >= 0.5) == np.array(y[2000:])) > 0.97


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.Model(-0.4, np.arange(9, dtype=np.int32), rng.normal(0, 1, 9), rng.normal(0, 1, (9, 3)))
    for n in (0, 1, 2, 9):
        terms = rng.choice(9, n, replace=False)
        z = model.bias + model.weights[terms].sum() + sum(model.vectors[a] @ model.vectors[b] for k, a in enumerate(terms) for b in terms[:k])
        assert abs(model.score(np.zeros(n, int), terms, 1)[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_an_id_of_many_rows_is_one_text(spark):
    docs, labels = corpus(spark, 300)
    again = docs.unionByName(spark.createDataFrame([(1, f"zz {k}", 0, "y") for k in range(500)], docs.schema))
    assert len(toxicity.T.one_text(again, labels.withColumnRenamed("toxic", "label"), ["label"]).collect()) == 300
