"""Near copies by an inverted join over MinHash signature coordinates.

1. Every document gets the set of its word shingles and a signature of COORDINATES minima. Documents with equal sets are
   one class, represented by the smallest id, so that groups of copies never meet as pairs.
2. A (coordinate, value) pair is a token. Two sets above the threshold agree in at least ``least`` tokens (see
   least_matches), so each class is posted only under its rarest tokens, as many as make a common one certain; a class with
   fewer than ``least`` shared tokens is posted nowhere.
3. The first round joins each posting list's most central class with the others of the list, confirms the links on
   the full sets and contracts the linked classes to components.
4. The second round takes only lists that still hold several components. It is cut in blocks; collisions are counted
   in the blocks, pairs inside a component are skipped, and what is left is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import held, mixed, numbered, tidied, with_rows, without_rows
from tripledger.llm.words import LOWER, shingles_of, words_of
from tripledger.operators.keep import join_once

SHINGLE = 5
PERCENT = 85
#: Sets with a similarity of s agree in Binomial(48, s) coordinates. As many matches are asked for as all but MISSED of
#: the pairs at the threshold have (see least_matches), and the more similar the rarer a miss. All other steps are exact.
COORDINATES = 48
MISSED = 1 / 30_000
#: Classes of a block of neighbours in which pairs are confirmed, and members of a block of a posting list.
BLOCK = 64
LIST_BLOCK = 512
#: Bytes of text whose shingles a task holds at once; a longer text is held by itself.
HELD_BYTES = 1_000_000
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def least_matches(percent: int) -> int:
    """Coordinates in which a pair at ``percent`` agrees but for MISSED of the cases: 30 of 48 at 85, 26 at 80."""
    p, below, least = percent / 100, 0.0, 0
    while least < COORDINATES:
        below += math.comb(COORDINATES, least) * p**least * (1 - p) ** (COORDINATES - least)
        if below > MISSED:
            break
        least += 1
    if not (0 < percent <= 100 and least):
        raise ValueError(f"{COORDINATES} coordinates do not tell pairs at {percent} percent")
    return least


def lowered_pieces(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of neighbouring texts of about HELD_BYTES together, with their bytes, A-Z in lower case; null is empty."""
    lo, filled, texts = 0, 0, []
    for i, text in enumerate(column):
        texts.append((text.as_py() or "").encode("utf-8").translate(LOWER))
        filled += len(texts[-1])
        if filled >= HELD_BYTES:
            yield lo, i + 1, texts
            lo, filled, texts = i + 1, 0, []
    if texts:
        yield lo, len(column), texts


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id (16 bytes; null for a document without words), tokens."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in lowered_pieces(batch.column(1)):
                words = words_of(texts)
                (shingles, first), (others, _) = shingles_of(words, SHINGLE), shingles_of(words, SHINGLE, other=True)
                counts, sets, tokens = np.zeros(hi - lo, np.int64), [None] * (hi - lo), [None] * (hi - lo)
                some = np.flatnonzero(np.diff(first) > 0)
                if len(some):
                    minima = np.empty((len(some), COORDINATES), np.int64)
                    for k, seed in enumerate(_SEEDS):
                        low = np.minimum.reduceat((shingles * seed) >> np.uint64(32), first[some])
                        minima[:, k] = low.astype(np.int64) | (k << 32)
                    for row, i in enumerate(some):
                        counts[i], sets[i] = _named(shingles[first[i]:first[i + 1]], others[first[i]:first[i + 1]])
                        tokens[i] = minima[row]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(sets, pa.binary()),
                     pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "tokens"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(rows, "doc_id long, n_shingles long, set_id binary, tokens array<bigint>")


def _named(one: np.ndarray, two: np.ndarray) -> tuple[int, bytes]:
    """Size and name of a shingle set: a digest of its pairs of hashes in order."""
    order = np.lexsort((two, one))
    pairs = np.stack([one[order], two[order]], 1)
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return int(new.sum()), hashlib.blake2b(pairs[new].tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, text: str) -> DataFrame:
    """set_id, and the sorted shingle hashes as bytes, of documents with words.

    A hash joins both values of a shingle by odd factors that are drawn for each run, so that no two shingles can be
    made to share it; results do not depend on them.
    """
    first_factor, second_factor = (secrets.randbits(64) | 1 for _ in range(2))

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in lowered_pieces(batch.column(0)):
                words = words_of(texts)
                (one, first), (two, _) = shingles_of(words, SHINGLE), shingles_of(words, SHINGLE, other=True)
                both = mixed(one * np.uint64(first_factor) + two * np.uint64(second_factor))
                spans = [(a, b) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
                yield pa.record_batch([
                    pa.array([_named(one[a:b], two[a:b])[1] for a, b in spans], pa.binary()),
                    pa.array([np.unique(both[a:b]).tobytes() for a, b in spans], pa.binary())], names=["set_id", "own"])

    return docs.select(F.col(text).alias("text")).mapInArrow(rows, "set_id binary, own binary")


def groups_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by ``keys``, one at a time, also where a group spans batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if rest and (rest[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if rest and a:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(batch.iloc[a:b])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _parts(df: DataFrame) -> int:
    """All shuffle partitions, since the work of these small rows is large."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def postings(reps: DataFrame, least: int) -> DataFrame:
    """Classes that may have a partner: rep, tokens (those of several classes, rarest first), prefix, weight."""
    tokens = reps.select("rep", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").count().where("count > 1")
    # the second key makes both sides shuffle for the join alone: a common token can then be split
    shared = tokens.withColumn("at", F.shiftright("token", 32)).join(
        often.withColumn("at", F.shiftright("token", 32)), ["token", "at"])
    return (
        shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("tokens"))
        .where(F.size("tokens") >= least)
        .select("rep", "tokens", F.slice("tokens", F.lit(1), F.size("tokens") - least + 1).alias("prefix"),
                F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x["count"]).alias("weight"),
                F.element_at("tokens", -1)["token"].alias("anchor"))
    )


def _packed(pairs: DataFrame) -> DataFrame:
    """Pairs of positions as block, other, codes (position in block times BLOCK plus position in other)."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return pairs.select(
        F.expr(f"least(a, b) div {BLOCK}").alias("block"), F.expr(f"greatest(a, b) div {BLOCK}").alias("other"),
        F.array(((low % BLOCK) * BLOCK + high % BLOCK).cast("int")).alias("codes"))


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, for each pair, exactly.

    Few pairs are searched one by one. Many are counted from a table of the values that several sets hold, by columns.
    """
    if len(i) < 4 * len(sets):
        out = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            small, large = sorted((sets[a], sets[b]), key=len)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            out[k] = int((large[at] == small).sum())
        return out
    values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    table = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        ones = np.zeros((len(sets), 4096), np.float32)
        ones[row[a:b], column[a:b] - lo] = 1
        table += (ones @ ones.T).astype(np.int64)
    return table[i, j]


def confirmed(packed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of positions that span the components of each block pair, checked on the full sets."""
    at = F.expr(f"array_distinct(concat(transform(codes, c -> block * {BLOCK} + c div {BLOCK}), "
                f"transform(codes, c -> other * {BLOCK} + c % {BLOCK})))")
    # one row per block pair, at most BLOCK * BLOCK codes, before its members are listed
    packed = packed.groupBy("block", "other").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    needed = packed.select("block", "other", F.explode(at).alias("pos"))
    rows = packed.select("block", "other", F.lit(None).cast("long").alias("pos"), "codes", F.lit(None).cast("binary").alias("own")).unionByName(
        needed.join(sets, "pos").select("block", "other", "pos", F.lit(None).cast("array<int>").alias("codes"), "own"))

    @tidied
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, ["block", "other"]):
            block, other = int(group["block"].iloc[0]), int(group["other"].iloc[0])
            codes = np.unique(np.concatenate([np.asarray(c, np.int64) for c in group["codes"] if c is not None]))
            own = {int(p): np.frombuffer(s, np.uint64) for p, s in zip(group["pos"], group["own"], strict=True) if s is not None}
            root = {p: p for p in own}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            left, right = block * BLOCK + codes // BLOCK, other * BLOCK + codes % BLOCK
            spot = {p: i for i, p in enumerate(own)}
            i, j = (np.array([spot[p] for p in side.tolist()]) for side in (left, right))
            size = np.array([len(s) for s in own.values()])
            both = _common(list(own.values()), i, j)
            good = 100 * both >= percent * (size[i] + size[j] - both)
            links = []
            for a, b in zip(left[good].tolist(), right[good].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    links.append((a, b))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return rows.repartition(_parts(packed), "block", "other").sortWithinPartitions("block", "other").mapInPandas(check, "a long, b long")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, label: the smallest node that each linked node reaches, by minima over neighbours and pointer jumps."""
    edges = held(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = held(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                  .select("node", F.least("node", "near").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = held(step.join(jump, "next").select("node", F.col("label").alias("was"), F.least("next", "far").alias("label")))
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


def _first_round(posted: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of positions: the most central class of each posting list and each other one with enough tokens."""
    listed = posted.select("pos", "weight", F.explode("prefix.token").alias("token"))
    leaders = listed.groupBy("token").agg(F.max(F.struct("weight", (-F.col("pos")).alias("less"))).alias("best"))
    pairs = (
        listed.withColumn("at", F.shiftright("token", 32))
        .join(leaders.select("token", F.shiftright("token", 32).alias("at"), (-F.col("best.less")).alias("leader")), ["token", "at"])
        .where("pos <> leader").select("pos", "leader").distinct()
    )
    own, theirs = (posted.select(F.col("pos").alias(name), F.col("tokens.token").alias(f"{name}_tokens")) for name in ("pos", "leader"))
    return (
        pairs.join(own, "pos").join(theirs, "leader")
        .where(F.size(F.array_intersect("pos_tokens", "leader_tokens")) >= least)
        .select(F.col("pos").alias("a"), F.col("leader").alias("b"))
    )


def _second_round(posted: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Pairs between different components with enough common tokens, packed by blocks."""
    grouped = posted.join(labels.withColumnRenamed("node", "pos"), "pos", "left").withColumn("label", F.coalesce("label", "pos"))
    # tokens are sent once per row that is compared, not along with every posting
    listed = grouped.select("pos", "label", F.size("prefix").alias("posted"), F.explode("prefix.token").alias("token")).withColumn("at", F.shiftright("token", 32))
    mixed_lists = (
        listed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        .select("token", F.shiftright("token", 32).alias("at"), F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks"))
    )
    spot = F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int")
    cut = (
        listed.join(mixed_lists, ["token", "at"]).withColumn("spot", spot)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("spot", "with").alias("p"), F.greatest("spot", "with").alias("q"), "spot", "pos", "label", "posted")
        .join(posted.select("pos", F.col("tokens.token").alias("tokens")), "pos")
    )

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, ["token", "p", "q"]):
            if len(group) < 2:
                continue
            token = int(group["token"].iloc[0])
            label, pos, spot = (group[c].to_numpy(np.int64) for c in ("label", "pos", "spot"))
            same_block = group["p"].iloc[0] == group["q"].iloc[0]
            n, lists = len(group), [np.asarray(t, np.int64) for t in group["tokens"]]
            values = np.repeat(-1 - np.arange(n)[:, None], COORDINATES, 1)
            early = np.zeros((n, COORDINATES), bool)  # tokens of the prefix that come before this list's token
            for i, (own, posted_n) in enumerate(zip(lists, group["posted"], strict=True)):
                values[i, own >> 32] = own
                head = own[:posted_n]
                early[i, head[:int(np.flatnonzero(head == token)[0])] >> 32] = True
            rows = np.arange(n) if same_block else np.flatnonzero(spot == group["p"].iloc[0])
            cols = np.arange(n) if same_block else np.flatnonzero(spot == group["q"].iloc[0])
            hits = np.zeros((len(rows), len(cols)), np.uint8)
            seen = np.zeros((len(rows), len(cols)), bool)
            for k in range(COORDINATES):
                equal = values[rows, k][:, None] == values[cols, k]
                hits += equal
                if early[:, k].any():
                    seen |= equal & early[rows, k][:, None] & early[cols, k]
            good = (hits >= least) & ~seen & (label[rows][:, None] != label[cols])
            if same_block:
                good &= pos[rows][:, None] < pos[cols]
            i, j = np.nonzero(good)
            if not len(i):
                continue
            a, b = np.minimum(pos[rows[i]], pos[cols[j]]), np.maximum(pos[rows[i]], pos[cols[j]])
            out = pd.DataFrame({"block": a // BLOCK, "other": b // BLOCK, "codes": (a % BLOCK) * BLOCK + b % BLOCK})
            yield out.groupby(["block", "other"])["codes"].agg(list).reset_index()

    return cut.repartition(_parts(posted), "token", "p", "q").sortWithinPartitions("token", "p", "q").mapInPandas(
        count, "block long, other long, codes array<int>")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are runs other than blanks and line ends, A-Z in lower case; a set holds distinct five-word shingles, or the
    whole sequence of a shorter text. Documents without words (null, empty or blank text) have no set and no link.
    The matches asked for follow from ``percent``; one for which the coordinates are too few is refused. Each row is a
    document, also one that repeats an id or has none; a component in which no row has an id has a null one. Other
    columns are not read.
    """
    least = least_matches(percent)
    facts = held(signatures(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    # a class is named by one of its rows; ids come in at the end, as rows may repeat or lack them
    classes = held(facts.where("set_id is not null").groupBy("set_id").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("top"), F.max("n_shingles").alias("n_shingles")))
    reps = facts.select(F.col("row").alias("rep"), "doc_id", "tokens").join(classes.select("rep", "set_id"), "rep")
    posted = held(numbered(postings(reps, least), ["anchor", "rep"], "pos"))
    named = posted.select("rep", "pos").join(reps.select("rep", "doc_id", "set_id"), "rep")
    wanted = docs.join(named.select(F.col("doc_id").alias("_rep")).distinct(), F.col(doc_id).cast("long").eqNullSafe(F.col("_rep")), "left_semi")
    sets = held(full_sets(wanted, text).dropDuplicates(["set_id"]).join(named.select("set_id", "pos"), "set_id").select("pos", "own"))
    first = held(confirmed(_packed(_first_round(posted, least)), sets, percent))
    second = held(confirmed(_second_round(posted, components(first), least), sets, percent))
    labels = components(first.union(second)).withColumnRenamed("node", "pos")
    linked = held(labels.join(named.select("pos", "set_id"), "pos").join(classes.select("set_id", "top"), "set_id").select("label", "set_id", "top"))
    least_ids = linked.groupBy("label").agg(F.min("top").alias("least"))
    linked = join_once(linked.select("label", "set_id"), least_ids, ["label"]).select("set_id", "least")
    tops = classes.join(linked, "set_id", "left").select("set_id", "n_shingles", F.coalesce("least", "top").alias("component_id"))
    return (
        facts.join(tops, ["set_id", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; all columns as they came.

    Rows are judged one by one: a row with a null id is a document too and stands behind all others, rows that repeat an
    id are documents of their own, and rows without words stay.
    """
    rows = with_rows(docs)
    groups = held(near_groups(rows, "_row", percent=percent).select(F.col("doc_id").alias("_row"), "component_id"))
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("rank"))
    stay = groups.join(ids, "_row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank._row")
    return without_rows(rows, groups.select("_row").join(stay, "_row", "left_anti")).select(*docs.columns)
