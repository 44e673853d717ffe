"""Vector codes, merge pieces and the filter audit against brute force, the library and odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from skyledger.llm import filter_audit, merge_pieces, queries, vector_codes
from skyledger.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
PIECES = "piece_bpe_32k.model"
VECTORS = "vec_id long, embedding array<float>, label int, codes string, part int"


# -- vector codes ---------------------------------------------------------------


def whole(vector):
    return [int(np.floor(float(x) * 1024)) for x in vector]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error) rows and the codebooks by the definition, in Python integers."""
    points = np.array([whole(v) for _, v in rows], object)
    if np.abs(points).max() < 1 << 20:
        points = points.astype(np.int64)
    width = points.shape[1] // parts
    codes, errors, books = [], [0] * len(rows), []
    for p in range(parts):
        own = points[:, p * width : (p + 1) * width]
        book = own[:entries].copy()
        for step in range(rounds + 1):
            distances = ((own[:, None] - book[None]) ** 2).sum(2)
            nearest = distances.argmin(1)
            if step < rounds:
                for e in set(nearest.tolist()):
                    mine = own[nearest == e]
                    book[e] = [int(c) // len(mine) for c in mine.sum(0)]
        codes.append(nearest)
        errors = [e + int(d[n]) for e, d, n in zip(errors, distances, nearest)]
        books.append(book)
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return [(r[0], bytes(c).hex(), e) for r, c, e in zip(rows, zip(*codes), errors)], hashlib.sha256(flat.encode()).hexdigest()


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS).repartition(3)
    return vector_codes.digests(*vector_codes.compress(df, **options)).collect()


def test_codes_equal_brute_force_on_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    expected, books = brute_codes(rows)
    got = queries.op11_vector_codes(spark, SMALL).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == expected
    assert {r.codebooks_sha256 for r in got} == {books}
    of_label = {}
    for label, error in zip([r.label for r in sorted(table.collect())], [e for *_, e in expected]):
        of_label[label] = of_label.get(label, 0) + error
    labels = {r.vec_id: r.label for r in table.collect()}
    assert all(r.label_error == of_label[labels[r.vec_id]] for r in got)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_codes_with_ties_odd_rows_and_large_numbers(spark, scale):
    """Few distinct values give ties in every round; 1e7 leaves the numbers that doubles hold exactly."""
    rng = random.Random(5)
    good = [(k, [rng.randrange(-4, 5) * scale / 8 for _ in range(8)], k % 3 or None) for k in range(400)]
    good += [(7, good[7][1], 1), (900, good[3][1], None)]
    bad = [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, 1)]
    bad += [(1004, [1.0, 2.0], 1), (1005, [], 1), (1006, [1e30] * 8, 1)]
    expected, books = brute_codes(sorted((i, v) for i, v, _ in good))
    got = coded(spark, good + bad)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(expected)
    assert {r.codebooks_sha256 for r in got} == {books}
    nulls = {r.label_error for r in got if r.vec_id == 900}
    errors = {(i, c): e for i, c, e in expected}
    of_null = [errors[r.vec_id, r.code] for r in got if any(i == r.vec_id and label is None for i, _, label in good)]
    assert nulls == {sum(of_null)}


def test_codes_of_few_vectors_odd_lengths_and_none(spark):
    got = coded(spark, [(1, [0.5, 0.25, 0.0], 1), (None, [0.5, 0.25, 0.5], 1), (2, [0.5, 0.25, 0.0], None)])
    assert {(r.vec_id, r.error) for r in got} == {(1, 0), (None, 0), (2, 0)}
    assert {r.vec_id: r.code for r in got} == {1: "00000000", 2: "00000000", None: "00000200"}
    assert coded(spark, []) == []


def test_net_displacement_spares_comparisons(spark):
    """Bundles of entries far from each other: a bound over the other bundles outlasts all rounds."""
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(0, 0.01, 8) + (k // 8 % 8)).astype(np.float32).tolist(), 0) for k in range(500)]
    got = coded(spark, rows, entries=64)
    expected, _ = brute_codes([(i, v) for i, v, _ in rows], entries=64)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == expected
    assert sum(r.compared for r in got) < 0.45 * len(got) * 4 * 64 * 5


def test_bounds_hold_for_every_entry_of_a_group():
    """Whatever the history, a bound less the net displacement is under each distance it stands for."""
    rng = np.random.default_rng(8)
    numbers = vector_codes.Numbers(4, 1, 400)
    points = np.floor(rng.normal(0, 100, (300, 4)))
    book, history, state = points[:40].copy(), [], None
    for step in range(6):
        history.append(book)
        assigner = vector_codes.Assigner(numbers, history, 5)
        state = assigner.first(points) if state is None else assigner.assign(points, state[0], state[2].astype(float), state[3])
        squares = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (state[0] == squares.argmin(1)).all() and (state[1] == squares.min(1)).all()
        lower = state[2] - assigner.moved[state[3], np.arange(5)]
        for g, (a, b) in enumerate(assigner.spans):
            for e in range(a, b):
                others = state[0] != e
                assert (lower[others, g] <= np.sqrt(squares[others, e]) + 1e-3).all()
        drift = rng.normal(0, 30 if step % 2 else 3, book.shape)
        book = np.floor(book + drift)


# -- merge pieces ---------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return merge_pieces.MergeEncoder(merge_pieces.read_model(tokenizer_path(PIECES)))


def odd_texts(n):
    rng = random.Random(0)
    letters = "abthe \t\n\r.,éß日本語▁  　x<>0A\x00​🙂－﻿"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 70))) for _ in range(n)]
    return texts + ["", " ", "▁", "\n", "<s> </s><unk> <0x0A>", "a" * 100_000, " " * 3000, "the" * 20_000, "日" * 5000]


def test_ids_equal_the_library_on_odd_texts(encoder):
    texts = odd_texts(30_000)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts, "none")]
    assert got == encoder.library.encode(texts)
    assert encoder.encode(texts, "runs") == encoder.encode(texts, "texts")


def test_arrays_and_heaps_merge_alike(encoder):
    rng = random.Random(4)
    runs = list({"".join(rng.choice("▁theinga\n日é") for _ in range(rng.randrange(1, 40))) for _ in range(4000)})
    assert {r: np.frombuffer(x, "<i4").tolist() for r, x in encoder._id_bytes(runs)} == {r: encoder.run_ids(r) for r in runs}


def test_a_difference_from_the_library_stops_the_job():
    broken = merge_pieces.MergeEncoder(merge_pieces.read_model(tokenizer_path(PIECES)))
    broken.pair_ranks = broken.pair_ranks[::-1].copy()
    with pytest.raises(ValueError, match="otherwise"):
        broken.encode(["the quick brown fox jumps over the lazy dog"], "runs")


def test_pieces_without_byte_fallback_share_unknown_ids():
    plain = merge_pieces.MergeEncoder(merge_pieces.read_model(tokenizer_path(PIECES)))
    plain.byte_ids, plain.by_run = None, False
    unknown = plain.unknown
    assert plain.run_ids("\ue001\ue002a\ue003") == [unknown, plain.ids["a"], unknown]


def test_round_trip_of_documents(spark, encoder):
    got = {r.doc_id: r for r in queries.op12_merge_pieces(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = encoder.library.encode(d.text or "")
        row = got[d.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()


def test_encode_then_decode_odd_rows(spark):
    rows = [(1, None, "e"), (2, "", "e"), (None, "a b", "e"), (3, "a  b\n\tc ", "e"), (3, "a  b\n\tc ", "e"), (4, "x" * 300_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = tokenizer_path(PIECES)
    encoded = merge_pieces.encode(docs, path)
    back = merge_pieces.decode(encoded, path).collect()
    assert sorted((str(i), t) for i, t in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert merge_pieces.round_trip(docs, path, "texts").filter("doc_id = 3").select("decoded").distinct().count() == 1
    assert merge_pieces.digests(merge_pieces.round_trip(docs.limit(0), path)).collect() == []
    with pytest.raises(ValueError, match="check must be"):
        merge_pieces.encode(docs, path, "some")


# -- filter audit ----------------------------------------------------------------


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = {}
    for i, text, _ in docs:
        if i is not None:
            seen[text or ""] = min(i, seen.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > seen[text],
        }
        rows.append((lang or "", {x for x, failed in fails.items() if failed}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                now = [r for r in left if letter in r[1]]
                only = [r for r in left + gone if r[1] == {letter}]
                left = [r for r in left if letter not in r[1]]
                redundant = sum(letter in r[1] for r in gone)
                gone += now
                out[part, order, step] = (len(left), len(now), redundant, len(only), sum(r[2] for r in now), sum(r[3] for r in now))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(now)
    return {(*key, *value, shapley[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


DOCS = "doc_id long, text string, lang string, mask int, n string"


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, "n") for d in docs], DOCS)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return [tuple(r) for r in filter_audit.audit(df, said).collect()]


def test_audit_by_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "x#1", "delta", "|"] + [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choices(words[: rng.choice((4, 60, 306))], k=rng.choice((3, 150, 260)))), rng.choice(("en", "fr", None, "")))
            for k in range(150)]
    docs += [(200 + k, rng.choice(docs)[1], rng.choice(("en", "de"))) for k in range(60)]
    docs += [(300, None, "en"), (301, "", None), (None, docs[0][1], "en"), (None, "", "fr"), (5, docs[5][1], "fr"), (5, docs[5][1], "en"),
             (302, "A" * 50_000, "en"), (303, "word " * 60_000, "fr")]
    labels = [(k, k % 2, (k // 3) % 2) for k in range(0, 220, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (7, None, None)]
    got = audited(spark, docs, labels)
    assert len(got) == len(set(got)) == 600 * len({d[2] or "" for d in docs})
    assert set(got) == brute_audit(docs, labels)


def test_audit_of_no_documents(spark):
    assert audited(spark, [], []) == []
    assert set(audited(spark, [(1, "a", "en")], [])) == brute_audit([(1, "a", "en")], [])


def test_audit_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    relation = con.execute(filter_audit.ORACLE_SQL)
    df = queries.op13_filter_audit(spark, SMALL)
    assert [d[0] for d in relation.description] == df.columns
    assert sorted(relation.fetchall()) == sorted(tuple(r) for r in df.collect())


def test_recursion_has_a_fixed_size(spark):
    level = filter_audit.steps(spark)
    assert level.count() == 325 * 32
    assert level.filter("step = 5").select("prefix").distinct().count() == 120


def test_text_operators_never_hint_a_broadcast():
    import pathlib

    for path in pathlib.Path(queries.__file__).parent.rglob("*.py"):
        text = path.read_text()
        assert "F.broadcast(" not in text and "crossJoin" not in text and "localCheckpoint" not in text, path


def test_audit_plan_has_no_python_and_no_product(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = filter_audit.cells(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "ArrowEval", "Cartesian", "NestedLoop"))


# -- token ids by piece ------------------------------------------------------------


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_by_piece_equal_the_tokenizer(name, keeps_space):
    from skyledger.llm.tokens import PieceEncoder

    with open(tokenizer_path(name), encoding="utf-8") as file:
        encoder = PieceEncoder(file.read(), keeps_space, generation=5000)
    rng = random.Random(6)
    letters = "ab  \t\n.,'-<|#éß日本語▁  　xAIS9\x00​🙂the\x1c\x85—“\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(30_000)]
    texts += ["", " ", "a" * 5000, " " * 500, "don't  we'll IT'S", "Á İx", "x<|endoftext|> y", "<|startoftext|>a <|endoftext|"]
    texts += ["end.\n\n\nNext", "end \n Next", "a\n1", "ΑΣ Σ", "x\n"]
    for k in range(0, len(texts), 4000):
        part = texts[k : k + 4000]
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([t.encode() for t in part])]
        want = [e.ids for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert got == want


def test_one_doc_id_on_many_rows_fills_several_shards(spark):
    from skyledger.llm import token_store

    rows = [(7, f"word{k} and {k * 17}") for k in range(300)] + [(k, f"other {k}") for k in range(600)] + [(None, f"n {k}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = token_store.write(docs, tokenizer_path("word_bpe_49k.json"), shards=12)
    back = token_store.read_back(store).collect()
    assert len(back) == len(rows)
    assert len({(r.doc_id, r.occurrence) for r in back}) == len(rows)
    ordered = sorted(back, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert [-1 if r.doc_id is None else r.doc_id for r in ordered] == sorted(-1 if i is None else i for i, _ in rows)
    sizes = [r["count"] for r in store.entries.groupBy("shard").count().collect()]
    assert max(sizes) <= 3 * len(rows) / 12
    one = token_store.read_back(store, spark.createDataFrame([(7, 300), (7, 301), (None, 3)], "doc_id long, occurrence int")).collect()
    assert {(r.doc_id, r.occurrence) for r in one} == {(7, 300), (None, 3)}
