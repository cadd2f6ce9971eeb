"""Language by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The whole text is cut into runs of ``SPAN`` bytes. In each run a forward and a backward unit read every byte; each
position gets a probability per language from both states, and a document's probabilities are the mean over all of its
positions. The input weights are a table of 256 columns, so reading a byte is a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import held_out, tidied

#: Bytes of a run, units per direction, and runs that are scored together.
SPAN = 128
UNITS = 4
BATCH = 2048
#: The training sample: at most so many rows of each language, chosen by a checksum of id and text, so many runs of
#: TRAIN_SPAN bytes from anywhere in each text; and its schedule.
LANG_ROWS = 750
ROW_SPANS = 16
STEPS, TRAIN_BATCH, TRAIN_SPAN, RATE = 160, 384, 48, 0.02
UNKNOWN = "und"


@dataclass
class Model:
    """Weights: byte tables (3 units x 256), recurrent weights, biases inside the candidate gate, output layer."""

    langs: list[str]
    w: dict[str, np.ndarray]


def _states(tokens: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (positions, units, runs) of byte runs (positions, runs), read from the first position on.

    The squashing function is x / (1 + |x|), of which gates take half plus a half: no call per element is needed.
    """
    n, runs = table.shape[0] // 3, tokens.shape[1]
    x, a, size = (np.empty((3 * n, runs), table.dtype) for _ in range(3))
    h, out = np.zeros((n, runs), table.dtype), np.empty((tokens.shape[0], n, runs), table.dtype)
    gates, z, r, c = a[:2 * n], a[:n], a[n:2 * n], a[2 * n:]
    for t, byte in enumerate(tokens):
        np.take(table, byte, axis=1, out=x, mode="clip")
        np.matmul(u, h, out=a)
        gates += x[:2 * n]
        np.abs(gates, out=size[:2 * n])
        size[:2 * n] += 1
        gates /= size[:2 * n]
        gates *= 0.5
        gates += 0.5
        if keep is not None:
            kept = [h.copy(), z.copy(), r.copy(), c.copy()]
        c *= r
        c += x[2 * n:]
        np.abs(c, out=size[2 * n:])
        size[2 * n:] += 1
        c /= size[2 * n:]
        if keep is not None:
            keep.append((*kept, c.copy()))
        h = np.subtract(h, c, out=out[t])
        h *= z
        h += c
    return out


def _back(tokens: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights, from the last position back to the first."""
    n = table.shape[0] // 3
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    d_h = np.zeros_like(d_out[0])
    for t in range(len(tokens) - 1, -1, -1):
        h, z, r, c, g = keep[t]
        d_h = d_h + d_out[t]
        d_g = d_h * (1 - z) * (1 - np.abs(g)) ** 2
        d_z = d_h * (h - g) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_g * c * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_x = np.concatenate([d_z, d_r, d_g])
        d_a = np.concatenate([d_z, d_r, d_g * r])
        d_u += d_a @ h.T
        order = np.argsort(tokens[t], kind="stable")
        starts = np.flatnonzero(np.diff(tokens[t][order], prepend=-1))
        d_table[:, tokens[t][order][starts]] += np.add.reduceat(d_x[:, order], starts, axis=1)
        d_h = d_h * z + u.T @ d_a
    return d_table, d_u


def _loss(w: dict[str, np.ndarray], tokens: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of the runs (positions, runs), and its gradients."""
    kf, kb = [], []
    back = tokens[::-1]
    f = _states(tokens, w["tf"], w["uf"], kf)
    b = _states(back, w["tb"], w["ub"], kb)[::-1]
    both = np.concatenate([f, b], axis=1)
    logits = np.matmul(w["v"], both) + w["c"][:, None]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    runs = np.arange(tokens.shape[1])
    loss = float(-np.log(p[:, target, runs] + 1e-9).mean())
    d = p
    d[:, target, runs] -= 1
    d /= tokens.size
    d_both = np.matmul(w["v"].T, d)
    n = f.shape[1]
    d_tf, d_uf = _back(tokens, w["tf"], w["uf"], kf, d_both[:, :n])
    d_tb, d_ub = _back(back, w["tb"], w["ub"], kb, d_both[::-1, n:])
    return loss, {"tf": d_tf, "uf": d_uf, "tb": d_tb, "ub": d_ub,
                  "v": np.einsum("tcb,tnb->cn", d, both, optimize=True), "c": d.sum((0, 2))}


def fit(texts: list[bytes], langs: list[str], seed: int = 7) -> Model:
    """The network fitted to labelled byte strings, each language drawn equally often. Same input, same weights."""
    known = sorted(set(langs))
    rng = np.random.default_rng(seed)
    n, shape = UNITS, {"tf": (3 * UNITS, 256), "tb": (3 * UNITS, 256), "uf": (3 * UNITS, UNITS), "ub": (3 * UNITS, UNITS),
                       "v": (max(1, len(known)), 2 * UNITS), "c": (max(1, len(known)),)}
    w = {k: (rng.normal(0, 0.3, s) if k != "c" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    for k in ("tf", "tb"):
        w[k][:n] += 1.0  # starts with a long memory
    pools: dict[str, list[bytes]] = {lang: [] for lang in known}
    for t, x in zip(texts, langs, strict=True):
        if t:
            pools[x].append(t)
    by = [(i, pools[lang]) for i, lang in enumerate(known) if pools[lang]]
    if len(by) < 2:
        return Model(known, w)
    m, v2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        tokens, target = np.zeros((TRAIN_SPAN, TRAIN_BATCH), np.int64), np.zeros(TRAIN_BATCH, np.int64)
        for i in range(TRAIN_BATCH):
            target[i], pool = by[rng.integers(len(by))]
            text = pool[rng.integers(len(pool))]
            at = rng.integers(max(1, len(text) - TRAIN_SPAN + 1))
            piece = np.frombuffer(text, np.uint8)[at:at + TRAIN_SPAN]
            tokens[:, i] = np.resize(piece, TRAIN_SPAN)
        _, grads = _loss(w, tokens, target)
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(known, w)


def training_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[bytes], list[str]]:
    """Runs of bytes and their languages: of every language of any row that is not held out and has a text, LANG_ROWS
    rows at most and ROW_SPANS runs of each, drawn in the tasks from the whole text. Same rows, same runs."""
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0) & ~held_out(F.col(doc_id))).select(
        F.xxhash64(F.col(doc_id), F.col(text)).alias("mark"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return [], []
    # only about the rows that are wanted leave the tasks, whatever their number; of a rare language all do
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int(min(1.0, 1.3 * LANG_ROWS / n) * (1 << 30)))])

    @tidied
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for mark, text_ in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                body = text_.as_py().encode("utf-8")
                last = max(0, len(body) - TRAIN_SPAN)
                at = np.random.default_rng(mark & (2**64 - 1)).integers(last + 1, size=ROW_SPANS) if last else [0]
                spans.append([body[a:a + TRAIN_SPAN] for a in at])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.binary()))], names=["mark", "lang", "spans"])

    drawn = known.where(F.pmod("mark", F.lit(1 << 30)) <= F.element_at(share, F.col("lang"))).mapInArrow(
        draw, "mark long, lang string, spans array<binary>")
    first = Window.partitionBy("lang").orderBy("mark", "spans")
    rows = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= LANG_ROWS).orderBy("lang", "n").collect()
    return [bytes(x) for r in rows for x in r["spans"]], [r["lang"] for r in rows for _ in r["spans"]]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on runs of LANG_ROWS rows of each language at most, none of them held out; see training_spans."""
    return fit(*training_spans(docs, doc_id, text, lang))


def pooled(texts: list[bytes], model: Model) -> np.ndarray:
    """Mean probability per language (rows, languages) over every byte of each text."""
    w, classes = model.w, max(1, len(model.langs))
    sums = np.zeros((len(texts), classes))
    lengths = np.array([len(t) for t in texts], np.int64)
    runs = -(-lengths // SPAN)
    owner = np.repeat(np.arange(len(texts)), runs)
    if not len(owner):
        return sums
    body = np.zeros(int(runs.sum()) * SPAN, np.uint8)
    starts = (np.cumsum(runs) - runs) * SPAN
    for text, at in zip(texts, starts, strict=True):
        body[at:at + len(text)] = np.frombuffer(text, np.uint8)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    filled = np.minimum(SPAN, lengths[owner] - inside * SPAN)
    body = body.reshape(-1, SPAN)
    for lo in range(0, len(owner), BATCH):
        part = np.ascontiguousarray(body[lo:lo + BATCH].T)
        size = filled[lo:lo + BATCH]
        f = _states(part, w["tf"], w["uf"])
        # a short run is read backwards from its own last byte: its padding comes first and the state is cleared there
        b = _backwards(part, size, w["tb"], w["ub"])
        n = f.shape[1]
        total, alive = np.zeros((classes, part.shape[1]), np.float32), np.empty(part.shape[1], np.float32)
        logits, more = np.empty_like(total), np.empty_like(total)
        for t in range(SPAN):
            np.matmul(w["v"][:, :n], f[t], out=logits)
            logits += np.matmul(w["v"][:, n:], b[t], out=more)
            logits += w["c"][:, None]
            np.exp(logits, out=logits)
            np.divide(t < size, logits.sum(0), out=alive)
            logits *= alive
            total += logits
        np.add.at(sums, owner[lo:lo + BATCH], total.T.astype(np.float64))
    return sums / np.maximum(1, lengths)[:, None]


def _backwards(part: np.ndarray, size: np.ndarray, table: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Backward states by position. Runs shorter than SPAN are shifted so that their last byte is read first."""
    short = np.flatnonzero(size < SPAN)
    turned = part[::-1].copy()
    for i in short:
        turned[:, i] = 0
        turned[:size[i], i] = part[:size[i], i][::-1]
    out = _states(turned, table, u)[::-1]
    if len(short):
        out = out.copy()
        for i in short:
            out[:size[i], :, i] = out[SPAN - size[i]:, :, i]
    return out


def _answers(texts: list[bytes], net: Model) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text, by pieces of about 4 MB; an empty text is UNKNOWN."""
    best, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    lo, held_bytes = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or held_bytes >= 4_000_000:
            p = pooled(texts[lo:i], net)
            if i > lo:
                best[lo:i], top[lo:i] = p.argmax(1), p.max(1)
            lo, held_bytes = i, 0
        if i < len(texts):
            held_bytes += len(texts[i])
    names = [net.langs[k] if t and net.langs else UNKNOWN for k, t in zip(best, texts, strict=True)]
    return names, [float(min(1.0, s)) if t and net.langs else 0.0 for s, t in zip(top, texts, strict=True)]


def _readable(text: str) -> Column:
    return F.col(text).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _bytes_of(texts: pa.Array, readable: pa.Array) -> list[bytes]:
    return [x.as_py().encode("utf-8") if ok else b"" for x, ok in zip(texts, readable.to_pylist(), strict=True)]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (the pooled probability of that language).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned. Ties
    go to the first language by code point. Other columns are not read; repeated rows get equal rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, whatever the input

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _answers(_bytes_of(batch.column(1), batch.column(2)), shared.value)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _readable(text).alias("readable"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def keep_readable(docs: DataFrame) -> DataFrame:
    """The documents for which the network names a language, with any score; all columns as they came but for ``lang``.

    Only ``und`` goes: null texts, texts without a letter, and all texts if nothing could be learned. A document
    without a ``lang`` gets the one that the network names. Each row is judged by its own text in one pass, whatever its
    id: rows with a null or a repeated id stay or go one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    @tidied
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array(_answers(_bytes_of(batch.column(text_at), batch.column(batch.num_columns - 1)), shared.value)[0], pa.string())
            columns = batch.columns[:-1]
            columns[lang_at] = pc.coalesce(columns[lang_at], names)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))]).filter(pc.not_equal(names, UNKNOWN))

    # columns by place, as their names may clash
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    read = plain.withColumn("readable", _readable(f"c{text_at}")).mapInArrow(judge, plain.schema)
    return read.toDF(*docs.columns)
