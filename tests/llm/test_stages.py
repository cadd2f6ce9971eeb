"""The stages of the pipeline and the operators on what their rules leave to no single id: thresholds, nulls, repeats, hot keys."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, plain_near

import corpus_pipeline
from tripledger.llm import byte_bpe, common, exact_dedup, language_id, minhash_join, mixing, suffix_dedup, superkmer_dedup


def _banded(pairs: int) -> list[tuple[int, str]]:
    """Pairs of texts of 104 words whose shingle sets have a similarity of 90 / 110 (0.818)."""
    rows = []
    for p in range(pairs):
        words = [f"p{p}w{i}" for i in range(104)]
        other = list(words)
        other[30], other[70] = "x", "y"
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    return rows


def test_near_stage_links_pairs_between_80_and_85_percent(spark):
    rows = _banded(40)
    sets = [{tuple(w[i:i + 5]) for i in range(100)} for w in (WORD.findall(t) for _, t in rows[:2])]
    assert 80 <= 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == {d for d, (_, top) in plain_near(rows, 80).items() if d == top}
    assert minhash_join.near_groups(docs).where("not kept").isEmpty()  # op6 stays at 85
    assert (minhash_join.least_matches(85), minhash_join.least_matches(80)) == (30, 26)
    with pytest.raises(ValueError):
        minhash_join.near_groups(docs, percent=10)


def test_rare_language_and_whole_texts_are_learned(spark):
    common = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word is number "), "id").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(-i, f"ein wort mehr {i}", "de") for i in (2, 4, 5)], "doc_id long, text string, lang string")
    late = spark.createDataFrame([(-9, "a" * 5000 + "z" * 5000, "zz")], "doc_id long, text string, lang string")
    model = language_id.train(common.union(rare).union(late))
    assert model.langs == ["de", "en", "zz"]
    spans, langs = language_id.training_spans(common.union(rare).union(late))
    assert 0 < langs.count("en") <= language_id.LANG_ROWS * language_id.ROW_SPANS
    assert any(b"z" in s for s, lang in zip(spans, langs, strict=True) if lang == "zz")
    assert (spans, langs) == language_id.training_spans(common.union(rare).union(late).repartition(5))


#: Rows (doc_id, text) with several null ids and repeated ids: bad and clean, copies and near copies, some under null ids alone.
NEAR = [" ".join(f"{c}{i}" for i in range(104)) for c in "abc"]
MANY = [(None, None), (None, "123"), (None, "clean words of one row"), (None, "other clean words"), (7, ""), (7, "seven has words"), (7, "seven has more words"),
        (8, "same  text"), (8, "same text"), (8, "same  text"), (None, "copy of nulls"), (None, "copy of nulls"), (9, "copy of one"), (None, "copy of one"),
        (None, NEAR[0]), (None, NEAR[0] + " end"), (20, NEAR[1] + " end"), (None, NEAR[1]), (3, NEAR[2]), (3, NEAR[2] + " end"), (3, "three apart")]


def _many(spark, rows):
    return spark.createDataFrame([(d, x, ["en", "de"][k % 2], "s") for k, (d, x) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)


def _rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_decide_by_row_with_null_and_repeated_ids(spark):
    docs = _many(spark, MANY)
    read = Counter((d, x) for d, x in MANY if x and re.search("[a-z]", x))
    assert _rows(language_id.keep_readable(docs)) == read
    copies = {}
    for d, x in MANY:
        copies.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x or ""), []).append((-len(x or ""), d is None, d or 0, x))
    best = Counter()
    for group in copies.values():
        _, none, d, x = min(group, key=lambda r: r[:3])
        best[None if none else d, x] += 1
    got = _rows(exact_dedup.drop_copies(docs))
    assert {(d, x or "") for d, x in got} == {(d, x or "") for d, x in best} and got.total() == best.total()
    wordy = [r for r in MANY if r[1]]
    numbers = {i: r for i, r in enumerate(sorted(wordy, key=lambda r: (r[0] is None, r[0] or 0)))}
    near = plain_near([(i, x) for i, (_, x) in numbers.items()], 80)
    ids = _rows(minhash_join.keep_one(_many(spark, wordy), percent=80))
    assert Counter(d for d, _ in ids.elements()) == Counter(numbers[i][0] for i, (_, top) in near.items() if i == top)
    taken = mixing.mixture(docs.withColumn("row", F.monotonically_increasing_id()), row="row").collect()
    laps = Counter({(r["doc_id"], r["size"]): 0 for r in taken})
    for r in taken:
        laps[r["doc_id"], r["size"]] += -(-r["taken"] // r["size"]) if r["taken"] else 0
    order = Counter((d, len(WORD.findall(x or ""))) for d, x in _rows(mixing.training_order(docs)).elements())
    assert order == +laps


def test_sliced_words_are_whole_words_and_windows_are_compared_exactly():
    shared = [f"w{i}" for i in range(13)]
    texts = [" ".join(x).encode() for x in (
        [*shared, "a\0", "a", "sixteen-bytes-ab", "sixteen-bytes-abc"], [], ["\u00e9" * 9, *shared], [*shared[:-1], "x" * 40, "x" * 41, "x" * 40])]
    words, plain = superkmer_dedup.sliced_words_of(texts, 7), superkmer_dedup.sliced_words_of([b"  ", *texts], 7)
    assert [words.body[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)] == b" ".join(texts).split()
    assert words.first.tolist() == [0, 17, 17, 31, 46] and plain.first.tolist() == [0, 0, 17, 17, 31, 46]
    named = {}
    for w, key in zip(b" ".join(texts).split(), zip(words.value.tolist(), words.other.tolist(), strict=True), strict=True):
        assert named.setdefault(w, key) == key
    assert len(set(named.values())) == len(named)
    tell = set(zip(*(p.tolist() for p in words.exact), (words.end - words.start).tolist(), strict=True))
    assert len(tell) == len(named)
    # windows 0, 18 and 31 as one group of equal hashes: the last one differs in a word and is cut off
    assert superkmer_dedup._verified(words, np.array([0, 18, 31]), np.array([0])).tolist() == [0, 2]


def test_no_readable_text_goes_for_its_score(spark, monkeypatch):
    rows = [(i, w) for i, w in enumerate(["a", "zq", "word", "ein wort the word", "漢字", "12", None])]
    monkeypatch.setattr(language_id, "train", lambda docs: language_id.Model([f"l{i:02}" for i in range(20)], language_id.fit([], []).w | {
        "v": np.zeros((20, 2 * language_id.UNITS), np.float32), "c": np.zeros(20, np.float32)}))  # every score is 1 / 20
    assert {r["doc_id"] for r in language_id.keep_readable(_many(spark, rows)).collect()} == {0, 1, 2, 3, 4}


def test_pipeline_gives_the_plain_rows_and_repetitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    named = {r["doc_id"] for r in language_id.predict(docs, language_id.train(docs)).where("lang_pred <> 'und'").collect()}
    groups = {}
    for d in named:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[d]["text"]), []).append((-len(rows[d]["text"]), d))
    near = plain_near([(d, rows[d]["text"]) for d in (min(g)[1] for g in groups.values())], corpus_pipeline.NEAR_PERCENT)
    left = sorted((rows[d]["source"] is None, rows[d]["source"] or "", hashlib.md5(str(d).encode()).hexdigest(), d) for d, (_, top) in near.items() if d == top)
    size = {d: len(WORD.findall(rows[d]["text"])) for *_, d in left}
    sources = list(dict.fromkeys(x[:2] for x in left))
    total = {s: sum(size[x[3]] for x in left if x[:2] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(sources)}
    full: set = set()
    while True:  # shares that pass the most a source may give are shared again
        level = (mixing.SHARE * sum(total.values()) - sum(mixing.PASSES * total[s] for s in full)) / (sum(w for s, w in weight.items() if s not in full) or 1)
        more = {s for s in sources if weight[s] * level >= mixing.PASSES * total[s]}
        if more <= full:
            break
        full |= more
    expected: Counter = Counter()
    for s in sources:
        words, at = math.floor(min(mixing.PASSES * total[s], weight[s] * level) if s not in full else mixing.PASSES * total[s]), 0
        own = [x[3] for x in left if x[:2] == s]
        for _ in range(mixing.PASSES):
            for d in own:
                if at < words and size[d]:
                    expected[d] += 1
                at += size[d]
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def plain_cuts(rows, width, units, glue):
    """(id, units, units removed, digest) of each row: a row loses what starts in a row of a smaller id; null ids take no part."""
    first = {}
    for d, x in rows:
        parts = units(x)
        for i in range(len(parts) - width + 1 if d is not None else 0):
            first[glue(parts[i:i + width])] = min(d, first.get(glue(parts[i:i + width]), d))
    out = Counter()
    for d, x in rows:
        parts = units(x)
        gone = set()
        for i in range(len(parts) - width + 1 if d is not None else 0):
            if first[glue(parts[i:i + width])] < d:
                gone.update(range(i, i + width))
        out[d, len(parts), len(gone), hashlib.sha256(glue([p for i, p in enumerate(parts) if i not in gone])).hexdigest()] += 1
    return out


def _same_cuts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in superkmer_dedup.without_repeats(docs).collect())
    assert found == plain_cuts(rows, 13, lambda x: [w.encode() for w in WORD.findall(x or "")], b" ".join)
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.without_repeats(docs).collect())
    assert found == plain_cuts(rows, 50, lambda x: [bytes([b]) for b in (x or "").encode()], b"".join)


def test_cuts_with_null_and_repeated_ids(spark):
    one, two = NEAR[0], NEAR[1]
    _same_cuts(spark, [(1, one), (None, one), (None, one + " more"), (5, "head " + one), (5, "another start of it " + one), (5, "no repeats " + NEAR[2]),
                       (5, two), (6, two), (7, two + " " + one), (7, two + " " + one), (None, None), (7, None), (5, "head " + one)])


def test_hot_minimiser_is_split(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    ruler = "-" * 16
    rows = [(d, " ".join(f"{c}{d}" for c in "abcdefghijkl") + f" as it was {ruler} " + " ".join(f"{c}{d}" for c in "mnopqrstuvwxyz")) for d in range(60)]
    rows += [(100 + d, x + " end") for d, x in rows[:10]] + [(200 + d, "-" * (60 + d)) for d in range(30)]
    _same_cuts(spark, rows)
    docs = common.tagged(spark.createDataFrame(rows[:60], "doc_id long, text string").repartition(12))
    total = sum(len(x) for _, x in rows[:60])
    most = []
    for hot in (np.zeros(0, np.uint64), superkmer_dedup.hot_minimisers(docs, total)):
        home = superkmer_dedup.packed_runs(docs, 1 << 40, hot).where("packed is not null").groupBy("bucket").count()
        most.append(home.agg(F.max("count")).first()[0])
    for hot in (np.zeros(0, np.uint64), suffix_dedup.hot_marks(docs, total)):
        home = suffix_dedup.hashed_pieces(docs, 1 << 40, hot).where("packed is not null").select(F.length("packed").alias("n"), "bucket").groupBy("bucket")
        most.append(home.agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0])
    assert most[1] < most[0]
    assert len(superkmer_dedup.hot_minimisers(docs, total)) and len(suffix_dedup.hot_marks(docs, total))
    assert most[3] < most[2]


def _morse(letters, n):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_texts_made_to_share_polynomial_hashes_stay_apart(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64, whatever the base."""
    x, y = _morse("ab", 1024), _morse("ba", 1024)
    head = " ".join(f"w{i}" for i in range(12))
    _same_cuts(spark, [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {y}")])
    docs = spark.createDataFrame([(1, x), (2, y), (3, y + " ")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_join.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 2}
    rows = []
    for d, letters in ((1, "ab"), (2, "ba")):  # a header every 32 bytes, and one letter of each block by the sequence
        blocks = ["HEADER-OF-BLOCKS" + "m" * 7 + c + "n" * 8 for c in _morse(letters, 1024)]
        rows.append((d, "".join(blocks)))
    _same_cuts(spark, rows)


def test_prime_hash_is_the_polynomial_of_its_bytes():
    rng = np.random.default_rng(3)
    value, base = rng.integers(1, 257, 150_000).astype(np.uint64), 1_234_567_890_123_456_789
    first, stop = np.array([0, 7, 65_000, 70_000]), np.array([5, 140_000, 66_000, 70_001])
    found = suffix_dedup.prime_hashes(suffix_dedup.prime_sums(value, base), first, stop, base)
    for a, b, h in zip(first, stop, found, strict=True):
        plain = 0
        for v in value[a:b][::-1].tolist():
            plain = (plain * base + v) % suffix_dedup.PRIME
        assert int(h) == plain
    a, b = (rng.integers(0, suffix_dedup.PRIME, 500).astype(np.uint64) for _ in range(2))
    assert [int(z) for z in suffix_dedup.product(a, b)] == [int(x) * int(y) % suffix_dedup.PRIME for x, y in zip(a, b, strict=True)]
    key = rng.integers(0, 1 << 60, 1000)
    for k in (key, key >> 40, key % 5, key[:0]):
        assert suffix_dedup._order(k).tolist() == np.argsort(k, kind="stable").tolist()


def test_near_groups_with_repeated_and_null_ids(spark):
    a, b, c = NEAR
    near = lambda x: x + " end"
    docs = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (20, near(c)), (5, near(near(c))), (None, None), (6, ""), (None, "alone " * 9), (None, near("alone " * 9))]
    found = minhash_join.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter(
        [(1, 1), (1, 1), (2, 1), (3, 1), (None, 5), (20, 5), (5, 5), (None, None), (6, 6), (None, None), (None, None)])
    apart = [(1, a), (1, b), (2, near(a)), (0, near(b))]  # rows of an id are in the components of their own texts
    found = minhash_join.near_groups(spark.createDataFrame(apart, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter([(1, 1), (2, 1), (1, 0), (0, 0)])


def test_rows_of_files_are_numbered_without_a_copy(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(7)
    docs.write.parquet(str(tmp_path / "t"))
    rows = common.with_rows(spark.read.parquet(str(tmp_path / "t")))
    assert rows.select("_row").distinct().count() == 2000 and rows.inputFiles() == spark.read.parquet(str(tmp_path / "t")).inputFiles()
    gone = rows.where("doc_id % 3 = 0").select("_row")
    assert Counter(r["doc_id"] % 3 for r in common.without_rows(rows, gone).collect()) == Counter(i % 3 for i in range(2000) if i % 3)
    assert common.with_rows(docs).select("_row").distinct().count() == 2000


def test_missing_language_is_filled_in(spark):
    known = [(i, f"the word is number {i}", "en") for i in range(40)] + [(100 + i, f"das Wort ist Nummer {i}", "de") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in known + [(200, "the word is", None), (201, "das Wort ist", None), (202, "12", None)]],
                                 "doc_id long, text string, lang string, names string")
    found = {r["doc_id"]: r["lang"] for r in language_id.keep_readable(docs).collect()}
    assert found == {d: lang for d, _, lang in known} | {200: "en", 201: "de"}


def test_texts_are_held_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(minhash_join, "HELD_BYTES", 100)
    texts = ["Ab" * 20, None, "c" * 300, "", "É" * 10, "D" * 70, "e" * 45]
    parts = list(minhash_join.lowered_pieces(pa.array(texts)))
    assert [t for _, _, part in parts for t in part] == [b"ab" * 20, b"", b"c" * 300, b"", "É".encode() * 10, b"d" * 70, b"e" * 45]
    assert [(lo, hi) for lo, hi, _ in parts] == [(0, 3), (3, 7)]
    assert all(sum(map(len, part[:-1])) < 100 for _, _, part in parts)


def test_tokens_do_not_depend_on_the_blocks(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = [(i, f"Zyxwv{i % 7} qqruzz Émile 12{i}") for i in range(60)] + [(60, None), (61, ""), (None, "qqruzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (
        sorted(map(str, byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, with_ids=True, block_chars=n).collect())) for n in (40, 8_000_000))
    assert small == large and len(small) == len(rows)
