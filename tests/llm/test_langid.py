import numpy as np
import zstandard

from cellweft.llm import langid

PARTS = {"aa": ["tion", "the", "ing", "st", "er", "ou"], "bb": ["sch", "ung", "ä", "ver", "ich", "tz"], "cc": ["ción", "ñ", "los", "rr", "mente", "do"]}


def corpus(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        lang = list(PARTS)[k % 3]
        words = ["".join(rng.choice(PARTS[lang], rng.integers(1, 4))) for _ in range(rng.integers(20, 60))]
        rows.append((k, " ".join(words), lang, "s", 1.5))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_not_learned(spark):
    docs = corpus(spark)
    other = docs.withColumn("lang", docs.lang).where(~langid.held_out(docs.doc_id))
    assert langid.train(docs) == langid.train(other)


def test_odd_rows(spark):
    model = langid.train(corpus(spark))
    odd = spark.createDataFrame([(1, None, None), (1, "", None), (None, "123 !?", None), (2, "ción " * 60_000, None), (3, "世界", None)], "doc_id bigint, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert (1, "und") in got and (None, "und") in got and (2, "cc") in got and (3, "und") not in got
    assert langid.predict(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(odd, {"aa": b"x"}).where("lang_pred = 'aa'").count() == 2
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.train(odd) == {}


def test_filter_keeps_rows_as_they_are(spark):
    docs = corpus(spark)
    model = langid.train(docs)
    with_odd = docs.union(spark.createDataFrame([(900, None, "aa", "s", 1.0), (901, "...", "aa", "s", 1.0)], docs.schema))
    kept = langid.keep_identified(with_odd, model)
    assert kept.schema.names == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() > 0.97 * docs.count()


def test_predictions_are_the_smallest_plain_compression(spark):
    docs = corpus(spark, 90)
    model = langid.train(docs, per_language=5)
    texts = {r.doc_id: r.text for r in docs.collect()} | {900: "ción tion " * 2000, 901: "sch the"}
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(k, texts[k]) for k in (900, 901)], "doc_id bigint, text string"))
    for r in langid.predict(rows, model).collect():
        words = [w for w in "".join(c if c.isalpha() else " " for c in texts[r.doc_id].lower()).split()]
        words = [w for k, w in enumerate(words) if k == 0 or w != words[k - 1]]
        data = " ".join(words).encode()
        n = max(1, -(-len(data) // langid.PIECE))
        pieces = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
        total = {}
        for lang, content in model.items():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.PIECE, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0)
            total[lang] = sum(len(zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).compress(b"  " + p + b" " * 24)) for p in pieces)
        best, second, *_ = sorted(total.values())
        assert total[r.lang_pred] == best and abs(r.score - (1 - best / second)) < 1e-12 and r.rejected == (r.score < langid.MARGIN)


def test_whole_texts_are_learned(spark):
    docs = spark.createDataFrame([(0, "front " * 3000 + "tailword", "aa"), (0, "front", "aa"), (0, "zebra", "aa"), (1, "autre", "bb"), (None, "none", "bb")], "doc_id bigint, text string, lang string")
    assert langid.train(docs.where("doc_id = 0").unionByName(docs.where("doc_id = 1"))) == {"aa": b"front", "bb": b"autre"}
    assert langid.train(docs.where("text <> 'front'"))["aa"].endswith(b"tailword")
