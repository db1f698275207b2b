import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cellweft.llm import queries as Q

from . import test_hardneg, test_packing

SMALL = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = corpus_pipeline.keep(stage(spark, docs, SMALL), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == columns, name
            assert got.join(docs, "doc_id", "left_anti").count() == 0
            assert got.count() <= docs.count()
        else:
            assert got.columns == [*columns, "copy", "size", "target"]
            assert got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).where("n <> m or m > 3").count() == 0
        docs = got
    assert docs.count() > 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    long = " ".join(words[k * 7 % 48] + str(k) for k in range(300))
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, long.replace("ax", "AX"), "en", "s", 1), (4, "quite another text", "en", "s", 1), (4, "quite another text", "en", "s", 1), (None, "nobody's own line of words", None, None, None), (6, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "4", "6", "None"]


def test_near_duplicate_stage_leaves_unrelated_texts_of_one_id_or_none(spark):
    own = [" ".join(f"{c}{k}" for k in range(50)) for c in "abcdef"]
    rows = [(None, own[0]), (None, own[1]), (None, own[2] + " more"), (1, own[2]), (1, own[3]), (1, own[3]), (2, own[4]), (2, own[5]), (3, own[4]), (0, own[5]), (None, own[1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([(None, own[0]), (None, own[1]), (1, own[2]), (1, own[3]), (2, own[4]), (0, own[5])], key=str)


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id int, copies int, target int, size int, copy int, row int, own int, key1 int, text_key int, component_id int"


def odd_rows():
    long = "der lange Text hat viele Worte und ist " * 30_000
    texts = ["the first text of the day is about the sea", "der andere Text ist von dem Haus und dem Hof", "a b c", "", " ", "123 !?", None, long]
    rows = [(k, t, ("en", "de")[k % 2], f"s{k % 3}", 1) for k, t in enumerate(texts)] + [(None, texts[0], "en", None, None)] * 2 + [(1, texts[1], None, "s1", 3), (0, texts[0], "en", "s0", 1), (50, None, None, None, None)]
    rows += [(100 + k, f"the {w} of {v} is not far from the sea and the {w} is old, as {v} said on day {k}", "en", f"s{k % 4}", 5) for k, (w, v) in enumerate((w, v) for w in ("house", "river", "garden", "tower") for v in ("anna", "berta", "carl"))]
    return [(*r, *range(10)) for r in rows]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
@pytest.mark.parametrize("many", [True, False])
def test_stages_with_odd_rows_and_clashing_columns(spark, stage, many):
    docs = spark.createDataFrame(odd_rows() if many else [], ODD).repartition(3)
    got = corpus_pipeline.keep(stage(spark, docs, SMALL), "odd")
    if stage is corpus_pipeline.mix_sources:
        assert got.columns == [c for c in docs.columns if c not in ("copy", "size", "target")] + ["copy", "size", "target"]
    else:
        assert got.columns == docs.columns and got.exceptAll(docs).count() * (stage is not corpus_pipeline.drop_lines) == 0
    if not many:
        assert got.count() == 0
        return
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    if stage is corpus_pipeline.identify_language:
        assert {3, 4, 5, 6, 50}.isdisjoint(ids) and 7 in ids
    elif stage is corpus_pipeline.drop_lines:
        assert len(rows) == docs.count()
    elif stage is corpus_pipeline.drop_near_duplicates:
        assert sorted(i for i in ids if i is not None and i < 100) == [0, 1, 2, 3, 5, 7] and None not in ids
    elif stage is corpus_pipeline.decontaminate:
        assert len(rows) == docs.count()
    else:
        assert {3, 4, 6, 50}.isdisjoint(ids) and all(r.size == len(r.text.split()) for r in rows)


def test_mixing_stage_with_repeated_rows(spark):
    rows = [(k % 20, f"t{k} " * (k % 7), "en", f"s{k % 3}", 0) for k in range(200)] + [(None, None, None, None, None)] + [(None, "x y z", "en", "s0", k) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.mix_sources(spark, docs, SMALL).collect()
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.size
        assert r.size == len((r.text or "").split())
    target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert len({(r.doc_id, r.text, r.copy) for r in got}) == len(got)


def brute_similar(texts):
    """Least position of each text's group at a Jaccard similarity of 0.8 of five-word shingles."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * 80 and part[a] != part[b]:
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return part


def test_the_whole_run_against_brute_force_on_what_each_stage_got(spark, tmp_path):
    base = [" ".join(f"{a}{'xyzuvwt'[k % 7]}{b}" for k, b in enumerate("the sea and house of old river is far from home by day".split() * 4)) for a in "abcdefgh"]
    item = " ".join(f"q{k}" for k in range(15))
    rows = [(k, f"the text of {t}\nthe shared line of all texts here") for k, t in enumerate(base)]
    rows += [(20 + k, f"the text of {t} end\nthe shared line of all texts here") for k, t in enumerate(base[:3])] + [(30, f"the words {item} and more of the sea"), (31, "123"), (32, None)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    named = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in named.collect()} == {i for i, _ in rows} - {31, 32}
    lined = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, named, str(tmp_path)).collect()}
    want = {i: "\n".join(x for x in t.split("\n") if i == 0 or x != "the shared line of all texts here") for i, t in rows if i not in (31, 32)}
    assert lined == want
    ids = sorted(lined)
    part = brute_similar([lined[i] for i in ids])
    single = {ids[p] for p in part}
    assert len(single) == len(ids) - 3
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= single - {30}
    rated = got.groupBy("source").agg(F.sum("size").alias("taken"), F.first("target").alias("target")).collect()
    assert all(r.taken <= 3 * sum(len(lined[i].split()) for i in single) for r in rated) and len(rated) == 2


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    got = Q.QUERIES[name](spark, SMALL)
    key, table = ("page_id", "pages") if name.startswith("op1_") else ("doc_id", "documents")
    rows = got.collect()
    if name.startswith("op11_"):
        points = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
        want = test_hardneg.brute([(r.vec_id, None if r.embedding is None else list(r.embedding), r.label) for r in points])
        assert want and sorted((tuple(r) for r in rows), key=str) == want
        return
    if name.startswith("op13_"):
        test_packing.check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])
        return
    if name.startswith("op12_"):
        groups = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "source").na.fill("").distinct()
        assert {(r.lang, r.source) for r in rows if r.part == "pair"} == {tuple(r) for r in groups.collect()}
    else:
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count() and key in got.columns
    if name in Q.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        want = con.execute(Q.ORACLES[name]).fetchall()
        names = [c[0] for c in con.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted([tuple(r[c] for c in names) for r in rows], key=str) == sorted(want, key=str)


def test_entry_names_all():
    assert set(Q.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
