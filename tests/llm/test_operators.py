"""The text operators against brute force, round trips, held-out labels and odd inputs."""

from __future__ import annotations

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import (
    decontaminate, language_id, lattice_lm, near_dedup, packing, quality_qda, quality_rules, substring_dedup, token_store, toxicity,
)
from skyledger.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, _kept_id int"
WORDS = [a + b + c for a in ("ka", "to", "mi", "re") for b in ("lo", "na", "su", "vi") for c in ("", "n", "st", "r", "da")]


def prose(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


def frame(spark, rows):
    """Documents with columns whose names operators use themselves."""
    full = [(i, t, lang, "s", None if t is None else len(t), 0.5, "b", 1) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 40 + k), "en") for k in range(30)]
    rows += [(100, None, "en"), (101, "", None), (102, "\n \t", "en"), (103, "one two", None), (None, prose(rng, 30), "en")]
    rows += [(104, "x" * 50_000 + " y", "en"), (105, prose(rng, 20_000), "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (106, "12 34 !!", "en")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (5, None)], "doc_id long, label int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(1, prose(rng, 40)), (2, None), (3, "")], "item_id long, text string")


def run_all(docs, labels, benchmark):
    return {
        "op1": lambda: quality_qda.classify(docs, labels),
        "op2": lambda: packing.pack(docs, tokenizer_path("byte_bpe_50k.json")),
        "op3": lambda: toxicity.classify(docs, labels),
        "op4": lambda: lattice_lm.score(docs, tokenizer_path("piece_bpe_32k.model"), rounds=1),
        "op5": lambda: language_id.identify(docs),
        "op6": lambda: decontaminate.contaminated(docs, benchmark),
        "op7": lambda: token_store.read_back(token_store.write(docs, tokenizer_path("word_bpe_49k.json"), shards=2)),
        "op8": lambda: quality_rules.apply(docs),
        "op9": lambda: near_dedup.classes(docs),
        "op10": lambda: substring_dedup.repeated_runs(docs),
    }


PER_DOCUMENT = ("op1", "op3", "op4", "op5", "op7", "op8", "op9")


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 11)])
def test_odd_rows(name, spark, odd, labels, benchmark):
    rows = run_all(odd, labels, benchmark)[name]().collect()
    if name in PER_DOCUMENT:
        assert len(rows) == odd.count()
    if name == "op2":
        assert {r.doc_id for r in rows} == {r.doc_id for r in odd.select("doc_id").collect()}
    if name == "op5":
        und = {r.doc_id for r in rows if r.lang_pred == "und"}
        assert und == {100, 101, 102, 106}
    if name == "op9":
        of = {r.doc_id: r.class_id for r in rows}
        assert of[100] == 100 and sum(r.class_size == 3 for r in rows) == 3
    for r in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 11)])
def test_empty_table(name, spark, odd, labels, benchmark):
    assert run_all(odd.limit(0), labels, benchmark)[name]().collect() == []


def test_odd_rows_pass_filters_unchanged(spark, odd, benchmark):
    for out in (near_dedup.keep_one(odd), substring_dedup.remove(odd), decontaminate.clean(odd, benchmark)):
        assert out.columns == odd.columns
    kept = near_dedup.keep_one(odd).collect()
    assert sum(r.doc_id == 3 for r in kept) == 1 and any(r.text is None for r in kept)
    assert substring_dedup.remove(odd).count() == odd.count()


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_token_ids_round_trip(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = lambda name, end: {
        k: e.ids + [end]
        for k, e in zip(texts, Tokenizer.from_file(tokenizer_path(name)).encode_batch(list(texts.values()), add_special_tokens=False))
    }
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())

    want, stored = ids("byte_bpe_50k.json", 0), packing.encoded(docs.repartition(3), tokenizer_path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(packing.pieces(stored).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at and r.length <= 1024
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        at += r.length
    assert at == sum(map(len, want.values()))
    windows = {r.sequence_id: r.ids for r in packing.sequences(stored).collect()}
    assert sorted(windows) == list(range(-(-at // 1024))) and sum(map(len, windows.values())) == at
    assert all(len(windows[k]) == 1024 for k in windows if k < at // 1024)

    want = ids("word_bpe_49k.json", 1)
    store = token_store.write(docs.repartition(3), tokenizer_path("word_bpe_49k.json"), shards=3, bucket_keys=50)
    got = {r.doc_id: r for r in token_store.read_back(store).collect()}
    start = 0
    for k in sorted(want):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want[k]), crc(want[k]))
        start += len(want[k])
    unknown = spark.createDataFrame([(-5, 0), (10**12, 0)], "doc_id long, occurrence int")
    assert token_store.locate(store, unknown).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    function = token_store.PerfectHash.build(keys)
    assert sorted(function.slots(keys)) == list(range(keys.size))
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([7, 7], np.uint64))


def test_rule_counts_by_brute_force(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.apply(docs).collect():
        text = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_rule_thresholds_by_brute_force(spark):
    """With fewer rows than a sketch holds, its quantiles are exact."""
    rng = random.Random(3)
    docs = frame(spark, [(k, prose(rng, 60) + " #" * (k % 3), "en") for k in range(60)] + [(99, prose(rng, 30) + " ###" * 60, "en")])
    rows = quality_rules.with_ratios(quality_rules.measure(docs)).cache()
    values = [r.symbol_ratio for r in rows.collect() if not r.base_failed]
    mid, near, far = np.quantile(values, [0.5, 0.95, 0.99], method="inverted_cdf")
    scale = (near - mid) / math.log(20) if near > mid else (far - mid) / math.log(100)
    limit = quality_rules.thresholds(rows).first()
    assert abs(limit.symbol_ratio_max - (mid + scale * math.log(10_000))) < 1e-6
    kept = {r.doc_id: r.kept for r in quality_rules.apply(docs).collect()}
    assert not kept[99] and sum(kept.values()) >= 59


def test_fences_follow_the_distribution_of_a_source(spark):
    """Two sources of 600 rows; what is ordinary in one is far outside in the other. Nothing is fixed."""
    rng = random.Random(8)
    marked = lambda n: "".join(f" {rng.choice(WORDS)}#" for _ in range(n))
    rows = []
    for source, most in (("plain", 4), ("marked", 40)):
        for k in range(600):
            rows.append((len(rows), prose(rng, 100) + marked(rng.randrange(most)), "en", source))
    rows += [(9000, prose(rng, 100) + marked(30), "en", "plain"), (9001, prose(rng, 100) + marked(30), "en", "marked")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality_rules.with_ratios(quality_rules.measure(docs)).cache()
    fence = {r.t_source: r for r in quality_rules.thresholds(measured, shrink=50.0).collect()}
    assert fence["marked"].symbol_ratio_max > 3 * fence["plain"].symbol_ratio_max
    kept = {r.doc_id: r.kept for r in quality_rules.apply(docs, shrink=50.0).collect()}
    assert kept[9001] and not kept[9000]


def test_a_small_group_lies_between_its_own_and_its_language(spark):
    """Shrinking is smooth: each further row moves the fence a little, at no size does the rule change."""
    rng = random.Random(9)
    common = [(k, prose(rng, 60) + " #" * (k % 2), "en", "big") for k in range(300)]
    limits = []
    for n in (1, 5, 50, 199, 200, 201):
        rows = common + [(1000 + k, prose(rng, 60) + " #" * (k % 12), "en", "small") for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        found = quality_rules.thresholds(quality_rules.with_ratios(quality_rules.measure(docs)))
        limits.append({r.t_source: r.symbol_ratio_max for r in found.collect()}["small"])
    assert abs(limits[3] - limits[4]) < 0.02 and abs(limits[4] - limits[5]) < 0.02
    assert limits[0] < limits[2] < limits[4]


def test_rules_plan_has_no_nested_loop(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    measured = quality_rules.with_ratios(quality_rules.measure(docs))
    text = quality_rules.thresholds(measured)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    for k in range(25):  # a hot group of near copies, and copies of copies
        words = texts[0].split()
        words[rng.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [texts[1]] * 20
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    of = {r.doc_id: r.class_id for r in near_dedup.classes(docs, block_bytes=4000, bucket_bytes=2000).collect()}
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append(collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    df = collections.Counter(s for c in sets for s in c)
    weigh = lambda c: {s: float(near_dedup.shingle_weight(np.array([n]), np.array([df[s]]), len(texts))[0]) for s, n in c.items()}
    weighted = [weigh(c) for c in sets]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = sum(min(w, weighted[b][s]) for s, w in weighted[a].items() if s in weighted[b])
            if common / (sum(weighted[a].values()) + sum(weighted[b].values()) - common) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert of == {k: find(k) for k in range(len(texts))}


def template_group():
    """400 pairs of about 0.84 in a group whose members are mostly about 0.73 similar to each other, and all classes."""
    rng = random.Random(15)
    texts = []
    for pair in range(400):
        block = [f"p{pair}x{k}" for k in range(13)]
        for half in range(2):
            words = [f"t{k}" for k in range(300)]
            for k in (rng.randrange(10, 120), rng.randrange(180, 290)):
                words[k] = f"e{pair}x{half}x{k}"
            texts.append(" ".join(words[:150] + block + words[150:]))
    number: dict = {}
    held = [[number.setdefault(tuple(w[k : k + 5]), len(number)) for k in range(len(w) - 4)] for w in map(str.split, texts)]
    sets = np.zeros((len(texts), len(number)), np.float32)
    for row, columns in zip(sets, held):
        row[columns] = 1
    weight = near_dedup.shingle_weight(1, sets.sum(axis=0), len(texts))
    common = (sets * weight) @ sets.T
    whole = np.diag(common)
    near = common / (whole[:, None] + whole - common) >= 0.8
    root = np.arange(len(texts))
    while (low := np.array([root[row].min() for row in near])).tolist() != root.tolist():
        root = low
    return texts, dict(enumerate(root.tolist()))


def test_pairs_inside_a_template_group_are_all_found(spark):
    texts, want = template_group()
    out = near_dedup.classes(frame(spark, [(k, t, "en") for k, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.class_id for r in out} == want and len(set(want.values())) > 200


def near_copies(count):
    """Texts of one base with one to six changed words, most of them under 0.8 similar to each other, and all classes."""
    rng = random.Random(25)
    base, texts = [f"b{k}" for k in range(160)], []
    for number in range(count):
        words = list(base)
        for k in rng.sample(range(160), rng.randint(1, 6)):
            words[k] = f"c{number}x{k}"
        texts.append(" ".join(words))
    column: dict = {}
    held = [[column.setdefault(tuple(w[k : k + 5]), len(column)) for k in range(len(w) - 4)] for w in map(str.split, texts)]
    sets = np.zeros((count, len(column)), np.float32)
    for row, own in zip(sets, held):
        row[own] = 1
    weight = near_dedup.shingle_weight(1, sets.sum(axis=0), count)
    common = (sets * weight) @ sets.T
    near = common / (np.diag(common)[:, None] + np.diag(common) - common) >= 0.8
    root = np.arange(count)
    while (low := np.array([root[row].min() for row in near])).tolist() != root.tolist():
        root = low
    return texts, dict(enumerate(root.tolist()))


def test_texts_apart_in_a_group_of_near_copies_are_not_compared_in_all_pairs(spark, monkeypatch):
    texts, want = near_copies(600)
    compared, settled = [], near_dedup.settle

    def settle(df, label, **options):
        out = settled(df, label, **options)
        if label == "near-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "settle", settle)
    out = near_dedup.classes(frame(spark, [(k, t, "en") for k, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.class_id for r in out} == want and len(set(want.values())) > 200
    assert sum(compared) < 30 * len(texts)  # of 179,700 pairs


def test_shuffled_texts_and_packed_lists_go_with_the_write_that_reads_them(spark, monkeypatch):
    """Without any garbage collection; both have more than the input, and the texts are shuffled twice."""
    rng = random.Random(31)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(200)) for _ in range(200)]
    texts += [f"{t} end" for t in texts[:20]]
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_")}

    before, most, settled = set(shuffles()), sum(map(len, texts)) // 10, near_dedup.settle
    left = {}

    def settle(df, label, **options):
        out = settled(df, label, **options)
        for _ in range(100):  # executors delete in the background
            left[label] = sum(n for name, n in shuffles().items() if name not in before)
            if left[label] < most:
                break
            time.sleep(0.1)
        return out

    monkeypatch.setattr(near_dedup, "settle", settle)
    monkeypatch.setattr(near_dedup, "release", lambda _: None)
    out = near_dedup.classes(frame(spark, [(k, t, "en") for k, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.class_id for r in out} == {k: k if k < 200 else k - 200 for k in range(220)}
    assert max(left[label] for label in ("near-shared", "near-candidates", "near-links")) < most
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was


def test_repeated_passage_is_cut_from_later_documents(spark):
    rng = random.Random(6)
    passage = prose(rng, 80)
    own = [prose(rng, 50) for _ in range(4)]
    texts = [f"{own[0]} {passage} {own[1]}", own[2], f"{own[3]} {passage}"]
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    runs = substring_dedup.repeated_runs(docs).collect()
    assert [r.doc_id for r in runs] == [2] and runs[0].kept_in == 0
    assert texts[2][runs[0].begin : runs[0].stop] in passage and runs[0].n_words >= 60
    out = {r.doc_id: r for r in substring_dedup.remove(docs).collect()}
    assert out[0].text == texts[0] and out[1].text == texts[1]
    assert out[2].text == texts[2][: runs[0].begin] + texts[2][runs[0].stop :] and out[2].n_chars == len(out[2].text)


def test_marks_are_five_longs_and_units_are_told_apart_by_their_words(spark):
    rng = random.Random(26)
    pool = [prose(rng, rng.randint(1, 12)).replace(".", "") for _ in range(40)] + ["a b", "b a", "ab", "a  B", "\u0130x \u03a3", "a\u00a0b", "a b\0"]
    texts = ["".join(rng.choice(pool) + rng.choice((". ", "!\t ", "\n", "\r\n", ".\n\n")) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["", " \n ", "...", "a b a b. A B"]
    rows = substring_dedup.marks(frame(spark, [(k, t, "en") for k, t in enumerate(texts)]), 13)
    assert [kind for _, kind in rows.dtypes] == ["bigint"] * 5  # every mark is shuffled twice
    opened = substring_dedup._opened(rows.withColumns({"kept_in": F.lit(0), "n": F.lit(0)}), 13).collect()
    got = {(r.doc_id, r["at"]): r for r in opened if not r.seed}
    phrases: dict = {}
    for k, text in enumerate(texts):
        at, seen = 0, set()
        for unit in re.split(r"(?<=[.!?])[ \t]+|[\r\n]+", text):
            if words := unit.lower().split():
                r = got.pop((k, at))
                phrase = " ".join(words).replace("\0", "\1")
                assert (r.words, r.again, r.before, r.after) == (len(words), phrase in seen, -1, -1)
                assert phrases.setdefault(phrase, (r["first"], r.second)) == (r["first"], r.second)
                seen.add(phrase)
                at += len(words)
    assert not got and len(set(phrases.values())) == len(phrases)
    grams = {(k, i): w[i : i + 13] for k, w in enumerate(t.lower().split() for t in texts) for i in range(len(w) - 12)}
    seeds = [r for r in opened if r.seed]
    assert seeds and all(len(grams[r.doc_id, r["at"]]) == r.words == 13 for r in seeds)
    assert all((r.before < 0) == (r["at"] == 0) and r.before < 256 and (r.after < 0) == ((r.doc_id, r["at"] + 1) not in grams) for r in seeds)


def test_passages_over_cut_sentences_are_removed_to_the_word(spark):
    rng = random.Random(16)
    plain = lambda tag, n: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    texts, want = [], {}
    for k, n in enumerate((25, 27, 50, 51, 65, 120)):
        words = plain("p", n).split()
        if k % 2:  # one sentence end inside, the sentences around it are cut
            words[n // 2] += "."
        passage = " ".join(words)
        texts += [
            f"{plain('a', 9)} {' '.join(words[3:20])} {plain('b', 9)}",  # an earlier place of a part
            f"{plain('c', 14)}. {plain('d', 7)} {passage} {plain('e', 5)}. {plain('f', 9)}",
            f"{plain('g', 8)}\u2003{plain('h', 11)} {passage.upper()} {plain('i', 6)}.",
        ]
        want[3 * k + 2] = passage.upper()
    once = plain("q", 40)
    texts.append(f"{plain('r', 6)} {once} {plain('s', 6)} {once} {plain('t', 6)}")
    want[len(texts) - 1] = once
    texts.append(plain("u", 24) + " " + " ".join(texts[1].split()[5:29]) + " " + plain("v", 9))  # 24 words stay
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(texts)])
    runs = substring_dedup.repeated_runs(docs).collect()
    assert {r.doc_id: texts[r.doc_id][r.begin : r.stop] for r in runs} == want and len(runs) == len(want)
    assert all(r.n_words == len(want[r.doc_id].split()) for r in runs)


def test_benchmark_items_are_found_and_parts_are_not(spark):
    rng = random.Random(7)
    vocabulary = [a + b for a in WORDS for b in ("", "lu", "pe", "ri")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(rng.randint(16, 50)) for _ in range(12)]
    rows, leaked = [], set()
    for k in range(240):
        body = [text(120), text(80)]
        if k % 20 == 0:
            words = items[k // 20].split()
            if k % 40 == 0:
                words[len(words) // 2] = "paraphrased"
            body.insert(1, " ".join(words))
            leaked.add((k, k // 20))
        elif k % 20 == 1:
            body.insert(1, " ".join(items[k // 20].split()[:6]))
        rows.append((k, " ".join(body), "en"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == leaked
    blocks = decontaminate.contaminated(docs, bench, block_items=5)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == leaked
    assert decontaminate.clean(docs, bench).count() == 240 - len(leaked)


def test_items_of_words_that_are_rare_in_the_corpus_are_found(spark):
    rng = random.Random(17)
    vocabulary = [f"w{k}" for k in range(6000)] * 3  # more words than were columns once, each in several passages
    rng.shuffle(vocabulary)
    bodies = [" ".join(vocabulary[k : k + 150]) for k in range(0, len(vocabulary), 150)]
    items = [" ".join(f"rare{i}x{k}" for k in range(18 + i)) for i in range(8)]
    rows = [(k, f"{body[: len(body) // 2]} {items[k]} {body[len(body) // 2 :]}" if k < 8 else body, "en") for k, body in enumerate(bodies)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k in range(8)}


def test_common_subsequence_by_dynamic_programming():
    rng = random.Random(8)
    items = decontaminate.Items([0], [b"a b c d e f g h a b"], [b""], decontaminate.Projection(np.full(1 << 16, -1), np.zeros((0, 3), np.float32)))
    own = items.words[0].tolist()
    for _ in range(50):
        other = [rng.choice(own + [1, 2, 3]) for _ in range(rng.randint(0, 25))]
        table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for i, x in enumerate(own):
            for j, y in enumerate(other):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert items.common_subsequence(0, np.array(other, np.uint64)) == table[-1][-1]


def test_lattice_sums_all_segmentations():
    pieces, begins = [b"a", b"b", b"ab", b"b", b"ba", b"a"], [True, True, True, False, False, False]
    logs = np.log([0.2, 0.1, 0.3, 0.2, 0.1, 0.05])
    lattice = lattice_lm.Lattice(pieces, begins, logs)
    weight = {(p, s): w for p, s, w in zip(pieces, begins, np.exp(logs))}

    def total(word, first=True):
        return 1.0 if not word else sum(weight.get((word[:k], first), 0.0) * total(word[k:], False) for k in range(1, len(word) + 1))

    for word in (b"a", b"ab", b"abba", b"babab"):
        block = np.frombuffer(word, np.uint8).reshape(1, -1)
        assert math.isclose(math.exp(lattice.forward(block)[0][0]), total(word), rel_tol=1e-9)
        assert math.isclose(math.exp(lattice.forward_all(block, logs[None, :])[0, 0]), total(word), rel_tol=1e-9)
        if word == b"ab":  # "ab", or "a" + "b"
            uses = lattice.forward(block, np.array([2.0]))[1]
            assert math.isclose(uses[2], 2 * 0.3 / total(word)) and math.isclose(uses[0], 2 * 0.04 / total(word))


def test_base_score_by_brute_force(spark):
    docs = documents(spark)
    words = {r.doc_id: r.text.encode().lower().split() for r in docs.collect()}
    out = {r.doc_id: r for r in lattice_lm.score(docs, tokenizer_path("piece_bpe_32k.model"), rounds=1).collect()}
    train = [w for k, w in words.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for k, w in words.items():
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert math.isclose(out[k].base_score, want, rel_tol=1e-9) and out[k].train_tokens == n
        assert (out[k].n_tokens, out[k].n_known) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1)
        assert out[k].score < 0


@pytest.mark.parametrize("name", ["quality", "toxic", "lang"])
def test_held_out_accuracy(name, spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if name == "lang":
        rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
        right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
        assert right > 0.95
        return
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(name).alias("label"))
    rows = {"quality": quality_qda, "toxic": toxicity}[name].classify(docs, known).join(known, "doc_id").filter("held_out")
    right = rows.agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0]
    assert right > (0.95 if name == "quality" else 0.88)


def test_hashes_do_not_depend_on_the_batch():
    from skyledger.llm.words import shingle_hashes, word_hashes

    texts = [b"one two three four five six", b"", b"one two", b"x" * 40 + b" y z one two three"]
    joined, offsets = word_hashes(texts)
    for k, t in enumerate(texts):
        alone, at = word_hashes([t])
        assert np.array_equal(alone, joined[offsets[k] : offsets[k + 1]]) and at[-1] == len(t.split())
        a, o = shingle_hashes(alone, at, 5)
        s, so = shingle_hashes(joined, offsets, 5)
        assert np.array_equal(a, s[so[k] : so[k + 1]])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
