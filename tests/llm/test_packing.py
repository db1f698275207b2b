import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellweft.llm import packing
from cellweft.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Σίσυφος ΟΔΟΣ İstanbul", "é ́ a b　c \x1c x\x85y", "<|endoftext|>a it's IT'S 'S", "", None, " \n ", "a" * 9000, "word " * 5000, "tab\tand\x0bmore\x0c", "x" * 3 + "ab1 " * 700, "many 12345 numbers!!! ... ;;", "word " * 2047, "word " * 2048]


def fewest(items, capacity):
    """The least number of sequences, by trying everything."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= items[k]}:
            j = rooms.index(r)
            go(k + 1, [*rooms[:j], r - items[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_search_is_optimal_on_small_cases():
    rng = np.random.default_rng(3)
    better = 0
    for _ in range(300):
        capacity = int(rng.integers(10, 40))
        items = rng.integers(1, capacity + 1, int(rng.integers(1, 12))).tolist()
        have = np.bincount(items, minlength=capacity + 1)
        plan = packing.complete(have)
        least = fewest(items, capacity)
        assert sum(m for _, m in plan) == least >= packing.bound(have)
        better += sum(m for _, m in packing.best_fit(have)) > least
    assert better  # best fit alone would not do


def test_plans_use_every_piece_once():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 701, 200), rng.integers(1, 2049, 3000), np.clip(rng.normal(700, 200, 2000).astype(int), 1, 2048), [1] * 5000, [2048] * 7, []):
        have = np.bincount(np.array(sizes, int), minlength=2049)
        plan = packing.complete(have, nodes=500)
        used = np.zeros(2049, int)
        for filled, m in plan:
            assert sum(filled) <= 2048
            np.add.at(used, list(filled), m)
        assert (used == have).all()
        assert packing.bound(have) <= sum(m for _, m in plan) <= sum(m for _, m in packing.best_fit(have))


def test_undominated_fillings():
    have = np.bincount([7, 5, 4, 3, 3, 2], minlength=13)
    assert list(packing.fillings(have, 7)) == [(7,)]
    got = list(packing.fillings(have, 12, 20))
    assert all(sum(f) <= 12 for f in got) and got[0] == (7, 5)
    assert not any(packing.dominates(a, b) for i, a in enumerate(got) for b in got[i + 1 :])
    assert packing.dominates((7, 5), (4, 3, 3, 2)) and not packing.dominates((7, 5), (4, 4, 4))
    # counts do not change as the fillings are read one by one
    it = packing.fillings(have, 11)
    first = next(it)
    have[:] = 0
    assert [first, *it] == list(packing.fillings(np.bincount([7, 5, 4, 3, 3, 2], minlength=13), 11))


def test_ids_are_those_of_the_tokenizer(monkeypatch):
    model = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "SEGMENT", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    encoder = packing.Encoder(PATH)
    for text in [t for t in TEXTS if t] * 2:
        assert np.frombuffer(b"".join(encoder.segments(text.encode())), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    """Rows of op13 against the texts of each doc_id."""
    model = Tokenizer.from_file(PATH)
    want = []
    for doc, text in texts:
        ids = [*(model.encode(text, add_special_tokens=False).ids if text else []), 0]
        want += [(doc, k, 2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k in range(-(-len(ids) // 2048)) for part in [ids[2048 * k : 2048 * (k + 1)]]]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((d or 0, *w) for d, *w in want)
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        spans.sort()
        assert [s for s, _ in spans] == np.concatenate([[0], np.cumsum([n for _, n in spans])[:-1]]).tolist() and sum(n for _, n in spans) <= 2048
    return len(at)


def test_query(spark, tmp_path):
    texts = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (3, "another text"), (3, "another text")] + [(100 + k, "copy of one text") for k in range(300)]
    frame = spark.createDataFrame([(d, t, "clash", 1, 2, 3) for d, t in texts], "doc_id bigint, text string, ids string, length int, task int, `before` int")
    frame.repartition(5).write.parquet(f"{tmp_path}/a/documents.parquet")
    n = check(QUERIES["op13_packing"](spark, f"{tmp_path}/a").collect(), texts)
    model = Tokenizer.from_file(PATH)
    total = sum(len(model.encode(t, add_special_tokens=False).ids) if t else 0 for _, t in texts) + len(texts)
    assert n <= -(-total // 2048) + 1
    frame.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert QUERIES["op13_packing"](spark, f"{tmp_path}/b").collect() == []


def test_sequences_hold_the_ids(spark):
    frame = spark.createDataFrame(list(enumerate(t for t in TEXTS if t is not None)), "doc_id bigint, text string")
    packed = packing.pack(packing.pieces(frame, PATH)).cache()
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(map(len, whole.values())) == 4 * packed.agg(F.sum("length")).first()[0]
