"""The numbered operators against plain statements of their contracts, on small tables and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tripledger.llm import (
    byte_bpe, exact_dedup, language_id, minhash_join, mixing, projection_search, quality, suffix_dedup, superkmer_dedup, toxicity,
)
from tripledger.llm.queries import llm_oracles, llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
#: Nulls, empty and blank texts, copies, ties, a very long text, clashing column names.
ROWS = [
    (1, PHRASE, "en", "b"), (2, "  " + PHRASE.replace(" ", "\n"), "en", "b"), (3, PHRASE + " sixteen", None, "a"), (4, None, "en", None),
    (5, "", "de", "b"), (6, " \t\r\n", None, "b"), (7, LONG, "en", "c"), (8, LONG + " end", "en", "c"), (9, "short", "de", "c"),
    (10, "short", "de", None), (11, "aaaa" * 40, "de", "a"), (12, "x" + "aaaa" * 40, "de", "a"), (13, "ünï çødé 漢字 🙂    tail", "de", "b"),
    (14, "zero " * 60, "en", "b"), (15, "Zero " * 60, "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(*r, "t", 0, True) for r in ROWS], "doc_id long, text string, lang string, source string, bucket string, start int, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def _docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def _by_id(df):
    rows = df.collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain_bytes(rows):
    first, out = {}, {}
    for doc, text in sorted(rows):
        body = (text or "").encode()
        hit = [False] * len(body)
        for i in range(len(body) - 49):
            if first.setdefault(body[i:i + 50], doc) < doc:
                hit[i:i + 50] = [True] * 50
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out[doc] = (len(body), sum(hit), spans, _sha(bytes(b for b, h in zip(body, hit, strict=True) if not h)))
    return out


def plain_words(rows):
    first, out = {}, {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        hit = [False] * len(words)
        for i in range(len(words) - 12):
            if first.setdefault(tuple(words[i:i + 13]), doc) < doc:
                hit[i:i + 13] = [True] * 13
        out[doc] = (len(words), sum(hit), _sha(" ".join(w for w, h in zip(words, hit, strict=True) if not h).encode()))
    return out


def plain_near(rows, percent=85):
    sets, root = {}, {}
    for doc, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        root[doc] = doc

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posted = defaultdict(list)
    for doc in sorted(sets):
        seen = Counter(other for s in sets[doc] for other in posted[s])
        for other, both in seen.items():
            if 100 * both >= percent * (len(sets[doc]) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
        for s in sets[doc]:
            posted[s].append(doc)
    return {doc: (len(s), find(doc)) for doc, s in sets.items()}


@pytest.mark.parametrize("which", ["odd", "table"])
def test_bytes_words_and_near_copies(which, odd, spark, sf_dir):
    docs = odd if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r[0], r[1]) for r in ROWS] if which == "odd" else _docs(spark, sf_dir)
    found = _by_id(suffix_dedup.without_repeats(docs, with_spans=True))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == plain_bytes(rows)
    assert all(sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"] for r in found.values())
    found = _by_id(superkmer_dedup.without_repeats(docs, with_text=True))
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in found.items()} == plain_words(rows)
    found = _by_id(minhash_join.near_groups(docs))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == plain_near(rows)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())


def test_hot_near_copies_meet_in_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):  # pairs around the threshold, so that lists hold several components
        words = list(base)
        for j in range(1 + d % 5):
            words[(d * 7 + j * 23) % 120] = f"x{d}y{j}"
        rows.append((d, " ".join(words)))
    monkeypatch.setattr(minhash_join, "LIST_BLOCK", 32)
    found = _by_id(minhash_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == plain_near(rows)


def test_suffix_order_is_the_order_of_suffixes():
    rng = np.random.default_rng(1)
    for n in [*range(12), 100, 101, 102]:
        for letters in (1, 2, 6):
            text = rng.integers(1, letters + 1, n)
            assert suffix_dedup.suffix_order(text).tolist() == sorted(range(n), key=lambda i, t=text: t[i:].tolist())


def test_exact_groups_on_odd_rows(odd):
    found = _by_id(exact_dedup.exact_groups(odd))
    groups = defaultdict(list)
    for doc, text, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    for body, members in groups.items():
        for _, doc in members:
            r = found[doc]
            assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(members)[1], len(members), _sha(body.encode()))
            assert r["kept"] == (doc == r["keep_id"])
    again = exact_dedup.exact_groups(odd.union(odd.where("doc_id = 9"))).where("doc_id = 9").collect()
    assert [(r["group_size"], r["keep_id"]) for r in again] == [(3, 9), (3, 9)]


def test_full_filter_still_gives_exact_groups(odd, monkeypatch):
    expected = sorted(map(tuple, exact_dedup.exact_groups(odd).collect()))
    monkeypatch.setattr(exact_dedup, "SLOTS_PER_ROW", 0)
    monkeypatch.setattr(exact_dedup, "PAGE_BITS", 3)
    assert sorted(map(tuple, exact_dedup.exact_groups(odd).collect())) == expected


def test_mixture_reaches_its_targets(odd, spark, sf_dir):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = mixing.mixture(docs).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(docs).collect()))
        source = {r["doc_id"]: r["source"] for r in docs.collect()}
        took, target = Counter(), {}
        for r in rows:
            assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
            assert (r["position"] is None) == (r["taken"] == 0)
            took[source[r["doc_id"]]] += r["taken"]
            target[source[r["doc_id"]]] = r["target"]
        for name, words in target.items():
            assert math.floor(words) - 1 <= took[name] <= words + 1
    order = mixing.training_order(odd)
    assert order.columns == odd.columns and {r["doc_id"] for r in order.collect()} <= {r[0] for r in ROWS}


def test_mixture_places_every_repetition(odd, spark, sf_dir, monkeypatch):
    sorts = []
    monkeypatch.setattr(mixing, "numbered", lambda df, order, name, real=mixing.numbered: sorts.append(order) or real(df, order, name))
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        sorts.clear()
        rows = mixing.mixture(docs).collect()
        assert ["position", "_row", "lap"] in sorts  # the placements pass through the range sort
        assert any(r["taken"] > r["size"] for r in rows)
        for r in rows:
            assert len(r["positions"]) == (-(-r["taken"] // r["size"]) if r["size"] else 0)
            assert r["position"] == (r["positions"][0] if r["positions"] else None)
            for lap, t in enumerate(r["positions"]):
                words = r["first"] + lap * r["source_size"]
                assert abs(r["target"] * (t + r["tilt"] * (t * t - t)) - words) < 1e-6 * (1 + words)


def test_demand_is_inverted(spark):
    rows = [(float(w), tilt) for w in range(0, 101, 5) for tilt in (-0.5, 0.0, 0.5)]
    at = spark.createDataFrame(rows, "w double, tilt double").select(
        "w", "tilt", mixing.when_demanded(F.col("w"), F.lit(100.0), F.col("tilt")).alias("t")).collect()
    assert all(abs(100 * (r["t"] + r["tilt"] * (r["t"] ** 2 - r["t"])) - r["w"]) < 1e-9 for r in at)


def test_byte_bpe_is_the_library(odd, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 20_000)  # several blocks a task
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    with open(path, "rb") as lines:
        plain = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={})
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for doc, r in _by_id(byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, with_ids=True)).items():
            ids = library.encode_ordinary(texts[doc])
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[doc].encode()
            assert (r["ids_sha256"], r["decoded_sha256"]) == (_sha(",".join(map(str, ids)).encode()), _sha(texts[doc].encode()))


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    w = {k: rng.normal(0, 0.4, s) for k, s in {"tf": (6, 256), "tb": (6, 256), "uf": (6, 2), "ub": (6, 2), "v": (3, 4), "c": (3,)}.items()}
    tokens, target = rng.integers(97, 101, (5, 4)), np.array([0, 1, 2, 1])
    _, grads = language_id._loss(w, tokens, target)
    for k, spot in {"tf": (1, 98), "tb": (4, 99), "uf": (3, 1), "ub": (0, 0), "v": (2, 3), "c": (1,)}.items():
        high, low = ({n: x.copy() for n, x in w.items()} for _ in range(2))
        high[k][spot] += 1e-5
        low[k][spot] -= 1e-5
        slope = (language_id._loss(high, tokens, target)[0] - language_id._loss(low, tokens, target)[0]) / 2e-5
        assert abs(slope - grads[k][spot]) < 1e-5


def test_language_of_held_out_rows(odd, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in language_id.predict(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in found) >= 0.9 * len(found)
    rows = _by_id(language_id.predict(odd, model))
    assert {k for k, r in rows.items() if r["lang_pred"] == "und"} == {4, 5, 6}
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit([], [])).collect()} == {"und"}
    assert language_id.keep_readable(docs).columns == docs.columns


def _held_out(rows, label):
    return [(r, label[r["doc_id"]]) for r in rows if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]


def test_quality_and_toxicity_of_held_out_rows(odd, none, spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.collect()
    rows = _held_out(quality.scored(docs, labels).collect(), {r["doc_id"]: r["quality"] for r in marks})
    assert sum(r["predicted"] == y for r, y in rows) >= 0.95 * len(rows)
    rows = _held_out(toxicity.graded(docs, labels).collect(), {r["doc_id"]: r["toxic"] for r in marks})
    assert sum(r["predicted"] == y for r, y in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["score"] <= r["severity"] <= toxicity.GRADES for r, _ in rows)
    assert quality.scored(odd, labels.where("false")).where("score <> 0.5").isEmpty()
    assert toxicity.graded(odd, labels.where("false")).where("severity <> 0").isEmpty()
    assert len(quality.scored(odd, labels).collect()) == len(toxicity.graded(odd, labels).collect()) == len(ROWS)
    assert quality.scored(none, labels).isEmpty() and toxicity.graded(none, labels).isEmpty()


def test_ordinal_regression_orders_grades():
    grade = np.repeat([0, 1, 2, 3], 50)
    row = np.repeat(np.arange(200), grade)
    w, thresholds = toxicity.regress(np.zeros(len(row), np.int64), row, grade, 1, 3)
    assert w[0] > 0 and (np.diff(thresholds) > 0).all()


def test_nearest_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(10_001, None), (10_002, [0.0] * 64), (10_003, [float("nan")] + [1.0] * 63), (10_004, [1.0]), (10_005, [None] + [1.0] * 63)],
                                "vec_id long, embedding array<float>")
    copies = table.where("vec_id = 0").crossJoin(spark.range(20_000, 20_012)).select(F.col("id").alias("vec_id"), "embedding")
    vectors = table.union(bad).union(copies).withColumn("cell", F.lit("x"))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.union(copies).collect()]
    ids, units = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    queries = vectors.where("vec_id % 50 = 0")
    found = projection_search.nearest(vectors, queries).collect()
    hits = total = 0
    for q in {i for i in ids.tolist() if i % 50 == 0}:
        c = units @ units[ids == q][0]
        c[ids == q] = -9
        best = np.lexsort((ids, -np.round(c, 9)))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits, total = hits + len(set(ids[best].tolist()) & {m[1] for m in mine}), total + 5
        assert all(abs(s - c[ids == i][0]) < 1e-9 for _, i, s in mine)
    assert hits >= 0.9 * total
    own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 0)
    assert [i for _, i in own] == [20_000, 20_001, 20_002, 20_003, 20_004]
    assert projection_search.nearest(vectors.where("false"), vectors.where("false")).isEmpty()


def test_empty_tables(none):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for df in (suffix_dedup.without_repeats(none), superkmer_dedup.without_repeats(none), minhash_join.near_groups(none), exact_dedup.exact_groups(none),
               mixing.mixture(none), byte_bpe.encoded(none, ranks, public_tokenizers.PATTERN), language_id.predict(none, language_id.train(none))):
        assert df.isEmpty()
    for stage in (language_id.keep_readable, exact_dedup.drop_copies, minhash_join.keep_one, mixing.training_order):
        assert stage(none).columns == none.columns and stage(none).isEmpty()


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_equals_oracle(name, spark, duck, sf_dir):
    expected = duck.sql(llm_oracles()[name])
    names = sorted(d[0] for d in expected.description)
    found = llm_queries()[name](spark, sf_dir)
    assert sorted(found.columns) == names
    assert sorted(map(str, map(tuple, found.select(*names).collect()))) == sorted(map(str, expected.select(*names).fetchall()))
