"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so training tokens are labelled from them first: words and word beginnings are chosen
one by one that explain toxic training documents no earlier choice explains, as long as the likelihood-ratio
statistic of (attribute, toxic) is significant; their occurrences in toxic documents are toxic tokens, all others
are not.  The field has two states; a token's features are its word, its two neighbours and its first 4 to 8 bytes.
It is fitted by gradient steps on the exact likelihood.  A document's score is a logistic function of its
forward-backward marginals: the largest one, the expected number of toxic tokens and their share.

Training reads at most ``MAX_ROWS`` labelled documents, whose attributes are counted on the executors; only useful ones
reach the driver.  The field is fitted on at most ``FIELD_ROWS`` documents.
Null texts are empty; a text without words has the score of a clean one.  Without toxic training documents every
score is 0.  Repeated rows are scored alike, further columns pass through, and a null doc_id counts as not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import flat, pieces, saved, text_column
from tabspark.llm.supervised import fit_logistic, labelled_sample, logistic, remainder
from tabspark.llm.tokens import ALNUM, Words, words

MAX_ROWS, FIELD_ROWS = 3_000, 1_000
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
SEGMENT = 64
SIGNIFICANT, USEFUL = 20.0, 8.0  # likelihood-ratio statistics of a seed and of an attribute with a weight


PREFIXES = (4, 5, 6, 7, 8)
_SIEVE = 1 << 20


def attributes(words: Words) -> np.ndarray:
    """(1 + prefixes, tokens): hashes of the word and of its beginnings."""
    return np.vstack([words.hash[None], words.prefix])


@dataclass
class Field:
    vocabulary: np.ndarray  # sorted attribute hashes
    weights: np.ndarray  # (slots, attributes + 1): word, word before, word after, prefixes; the last column is unknown
    bias: float
    moves: np.ndarray  # 2 x 2 transition potentials
    doc: np.ndarray | None = None  # calibration of document features

    def __post_init__(self):
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[self.vocabulary & np.uint64(_SIEVE - 1)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Index of every attribute; the number of known ones where it is unknown."""
        n = len(self.vocabulary)
        out = np.full(hashes.shape, n, np.int32)
        maybe = self.sieve[hashes & np.uint64(_SIEVE - 1)]
        some = hashes[maybe]
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, some), n - 1)
            out[maybe] = np.where(self.vocabulary[at] == some, at, n)
        return out

    def emissions(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.weights[0][ids[0]] + self.bias
        for slot, row in zip(self.weights[3:], ids[1:]):
            e += slot[row]
        if len(e) > 1:
            inner = _inner(len(e), first)
            e[1:] += self.weights[1][ids[0, :-1]] * inner
            e[:-1] += self.weights[2][ids[0, 1:]] * inner
        return e


def _inner(n: int, first: np.ndarray) -> np.ndarray:
    """For each token but the first: whether it continues a text."""
    inner = np.ones(n, bool)
    inner[first[:-1][first[:-1] < n]] = False
    return inner[1:]


def _norm(v):
    return v / v.sum(axis=0)


def marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token is toxic) per token, and expected transitions (2 x 2); texts start in the clean state.

    Texts are cut into segments whose 2 x 2 products are chained, so a long text costs few steps.
    """
    size = np.diff(first)
    per = -(-size // SEGMENT)
    n_seg = int(per.sum())
    p = np.zeros(len(e))
    if not n_seg:
        return p, np.zeros((2, 2))
    start = np.cumsum(per) - per  # first segment of each text
    owner = np.repeat(np.arange(len(size)), per)
    within = np.arange(n_seg) - start[owner]
    at = first[:-1][owner] + within * SEGMENT  # first token of each segment
    length = np.minimum(SEGMENT, size[owner] - within * SEGMENT)
    steps = np.arange(SEGMENT)[:, None]
    real = steps < length
    x = np.exp(np.clip(e[np.where(real, at + steps, 0)], -30, 30))
    t = moves

    def forward(a, s):  # (2, segments) times M_s
        b = np.stack([a[0] * t[0, 0] + a[1] * t[1, 0], (a[0] * t[0, 1] + a[1] * t[1, 1]) * x[s]])
        return np.where(real[s], b, a)

    def backward(b, s):  # M_s times (2, segments)
        y = b[1] * x[s]
        c = np.stack([t[0, 0] * b[0] + t[0, 1] * y, t[1, 0] * b[0] + t[1, 1] * y])
        return np.where(real[s], c, b)

    rows = np.zeros((2, 2, n_seg))  # product of each segment, one start state at a time
    rows[0, 0] = rows[1, 1] = 1
    for s in range(SEGMENT):
        rows = np.stack([forward(rows[0], s), forward(rows[1], s)])
        rows /= rows.sum(axis=(0, 1))
    into, out = np.zeros((2, n_seg)), np.ones((2, n_seg))
    into[0] = 1
    for k in range(1, int(per.max())):
        seg = start[per > k] + k
        into[:, seg] = _norm(np.stack([(into[:, seg - 1] * rows[:, j, seg - 1]).sum(axis=0) for j in (0, 1)]))
    for k in range(int(per.max()) - 2, -1, -1):
        seg = start[per > k + 1] + k
        out[:, seg] = _norm(np.stack([(rows[i][:, seg + 1] * out[:, seg + 1]).sum(axis=0) for i in (0, 1)]))
    alphas = np.empty((SEGMENT + 1, 2, n_seg))
    alphas[0] = into
    for s in range(SEGMENT):
        alphas[s + 1] = _norm(forward(alphas[s], s))
    beta, moved = out, np.zeros((2, 2))
    for s in range(SEGMENT - 1, -1, -1):
        on = real[s]
        both = alphas[s + 1] * beta
        p[(at + s)[on]] = (both[1] / both.sum(axis=0))[on]
        y = beta[1] * x[s]
        pair = np.stack([alphas[s][0] * t[0, 0] * beta[0], alphas[s][0] * t[0, 1] * y, alphas[s][1] * t[1, 0] * beta[0], alphas[s][1] * t[1, 1] * y])
        moved += (pair / pair.sum(axis=0))[:, on].sum(axis=1).reshape(2, 2)
        beta = _norm(backward(beta, s))
    return p, moved


def features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: largest marginal, log of one plus the expected number of toxic tokens, and their share."""
    size = np.diff(first)
    out = np.zeros((len(size), 4))
    full = np.flatnonzero(size)
    if len(full):
        total = np.add.reduceat(p, first[:-1][full])
        out[full, 0] = np.maximum.reduceat(p, first[:-1][full])
        out[full, 1] = np.log1p(total)
        out[full, 2] = np.minimum(1, 20 * total / (size[full] + 20))
    out[:, 3] = np.log1p(size) / 10
    return out


def _ratio(hit: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood-ratio statistic of attributes that occur more among n1 toxic than among n0 clean documents, else 0."""
    share = n1 / (n0 + n1)
    seen = np.maximum(hit + clean, 1e-9)
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / b), 0)
    out = 2 * (log(hit, seen * share) + log(clean, seen * (1 - share)))
    return np.where(hit > seen * share, out, 0)


def seed_attributes(docs: list[np.ndarray], toxic: np.ndarray, n: int) -> np.ndarray:
    """Which of n attributes explain toxic documents, chosen greedily; ``docs`` are the attributes of each one's tokens.

    An attribute is counted as present, and separately as present in two or more tokens.
    """
    items, owners = [], []
    for i, d in enumerate(docs):
        values, counts = np.unique(d, return_counts=True)
        items += [values, values[counts > 1] + n]
        owners.append(np.full(len(values) + int((counts > 1).sum()), i))
    item, doc = np.concatenate(items), np.concatenate(owners)
    clean = np.bincount(item[toxic[doc] == 0], minlength=2 * n).astype(float)
    n0, left, chosen = max(1.0, float((toxic == 0).sum())), toxic == 1, set()
    while n and left.any():
        hit = np.bincount(item[left[doc]], minlength=2 * n).astype(float)
        score = _ratio(hit, clean, float(left.sum()), n0)
        score[hit < 3 * clean] = 0
        best = int(score.argmax())
        if score[best] < SIGNIFICANT:
            break
        chosen.add(best % n)
        left[doc[item == best]] = False
    return np.array(sorted(chosen), np.int64)


def fit_field(docs: list[np.ndarray], toxic: np.ndarray, seeds: np.ndarray, vocabulary: np.ndarray, steps: int = 60, rate: float = 0.3, ridge: float = 0.5) -> Field:
    """Gradient ascent with per-weight step sizes on the exact conditional likelihood of the labelled tokens."""
    ids, n = np.hstack(docs), len(vocabulary) + 1
    size = np.array([d.shape[1] for d in docs])
    first = np.concatenate([[0], np.cumsum(size)])
    labels = np.isin(ids, seeds).any(axis=0) & np.repeat(toxic == 1, size)
    f = Field(vocabulary, np.zeros((2 + len(ids), n)), 0.0, np.ones((2, 2)))
    inner = _inner(ids.shape[1], first)
    before = np.concatenate([[0], labels[:-1] & inner]).astype(int)
    seen_moves = np.bincount(before * 2 + labels, minlength=4).reshape(2, 2)
    logs, past = np.zeros((2, 2)), [np.full(f.weights.shape, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    scale = max(1, labels.sum())
    for _ in range(steps):
        p, moved = marginals(f.emissions(ids, first), first, f.moves)
        d = labels - p
        slots = [(ids[0], d), (ids[0, :-1], d[1:] * inner), (ids[0, 1:], d[:-1] * inner), *((row, d) for row in ids[1:])]
        g = (np.stack([np.bincount(i, v, n) for i, v in slots]) - ridge * f.weights) / scale
        g[:, -1] = 0
        grads = [g, d.sum() / scale, (seen_moves - moved) / scale]
        past = [a + b * b for a, b in zip(past, grads)]
        f.weights = f.weights + rate * grads[0] / np.sqrt(past[0])
        f.bias += rate * grads[1] / np.sqrt(past[1])
        logs = np.clip(logs + rate * grads[2] / np.sqrt(past[2]), -8, 8)
        f.moves = np.exp(logs)
    return f


def _presence(batches):
    """How many toxic and clean documents have an attribute, and have it in two or more tokens; one row per task and attribute."""
    held = []
    for batch in pieces(batches):
        w = words(*flat(text_column(batch, "text")), ALNUM, PREFIXES)
        every, label = attributes(w), batch.column("label").to_numpy()
        for a, b, y in zip(w.first.tolist(), w.first[1:].tolist(), label.tolist()):
            values, counts = np.unique(every[:, a:b], return_counts=True)
            held.append((values[values != 0], counts[values != 0] > 1, y))
    if held:
        keys, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        toxic = np.concatenate([np.full(len(h[0]), h[2]) for h in held])
        twice = np.concatenate([h[1] for h in held])
        counts = [np.bincount(back, x, len(keys)).astype(np.int64) for x in (toxic, 1 - toxic, toxic * twice, (1 - toxic) * twice)]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], ["attribute", "t1", "c1", "t2", "c2"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, field_rows: int = FIELD_ROWS) -> Field | None:
    sample = saved(labelled_sample(docs, labels, "toxic", FOLDS, HELD, max_rows))
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(1):
        return None
    counted = sample.mapInArrow(_presence, "attribute bigint, t1 bigint, c1 bigint, t2 bigint, c2 bigint").groupBy("attribute").agg(*[F.sum(c).alias(c) for c in ("t1", "c1", "t2", "c2")])
    # attributes commoner among toxic documents, at most some per word of the bounded sample
    few = counted.where(f"t1 > 2 AND t1 * {n.get(0, 0)} > c1 * {n[1]}").toPandas()
    score = np.maximum(*[_ratio(few[t].to_numpy(float), few[c].to_numpy(float), float(n[1]), max(1.0, float(n.get(0, 0)))) for t, c in (("t1", "c1"), ("t2", "c2"))])
    f = Field(np.sort(few.attribute.to_numpy(np.int64).view(np.uint64)[score >= USEFUL]), np.zeros((3 + len(PREFIXES), 1)), 0.0, np.ones((2, 2)))
    shared = docs.sparkSession.sparkContext.broadcast(f)

    def known(batches):  # of each text the number of tokens and its known attributes: (slot, token, attribute)
        for batch in pieces(batches):
            w = words(*flat(text_column(batch, "text")), ALNUM, PREFIXES)
            ids, rows = shared.value.ids(attributes(w)), []
            for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
                slot, at = np.nonzero(ids[:, a:b] < len(shared.value.vocabulary))
                rows.append(np.stack([slot, at, ids[slot, a + at]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(np.diff(w.first), pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "label", "n", "known"])

    rows = sorted(((r.doc_id, r.label, r.n, np.frombuffer(r.known, np.int32).reshape(3, -1)) for r in sample.mapInArrow(known, "doc_id bigint, label int, n bigint, known binary").toLocalIterator() if r.n), key=lambda r: r[0])
    toxic = np.array([r[1] for r in rows])
    if not toxic.any():
        return None

    def dense(row):
        out = np.full((1 + len(PREFIXES), row[2]), len(f.vocabulary), np.int32)
        out[row[3][0], row[3][1]] = row[3][2]
        return out

    seeds = seed_attributes([r[3][2] for r in rows], toxic, len(f.vocabulary))
    bad, good = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
    chosen = np.concatenate([bad[: field_rows // 2], good[: field_rows // 2]])
    f = fit_field([dense(rows[i]) for i in chosen], toxic[chosen], seeds, f.vocabulary)
    x, part = [], []
    for r in [*rows, None]:  # texts are scored together, some hundred thousand tokens at a time
        if r is None or sum(k.shape[1] for k in part) > 200_000:
            first = np.concatenate([[0], np.cumsum([k.shape[1] for k in part])])
            x.append(features(marginals(f.emissions(np.hstack(part), first), first, f.moves)[0], first))
            part = []
        if r is not None:
            part.append(dense(r))
    f.doc = fit_logistic(np.concatenate(x), toxic.astype(float))
    return f


def tag(docs: DataFrame, model: Field | None, spans: bool = True) -> DataFrame:
    """All columns of ``docs`` with __score and, if wanted, __spans: [from, to) code-point offsets of tokens that are toxic with probability 0.5 or more."""
    field = docs.sparkSession.sparkContext.broadcast(model)
    more = [T.StructField("__score", T.DoubleType())] + ([T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType())))] if spans else [])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + more)

    def run(batches):
        f = field.value
        for batch in pieces(batches):
            data, offsets = flat(text_column(batch, "text"))
            score, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            if f is not None:
                w = words(data, offsets, ALNUM, PREFIXES)
                p, _ = marginals(f.emissions(f.ids(attributes(w)), w.first), w.first, f.moves)
                score = logistic(features(p, w.first), f.doc)
                if spans:
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for i in np.flatnonzero(p >= 0.5).tolist():
                        d = int(np.searchsorted(w.first, i, "right")) - 1
                        found[d].append([int(points[x[i]] - points[offsets[d]]) for x in (w.start, w.end)])
            new = [pa.array(score)] + ([pa.array(found, pa.list_(pa.list_(pa.int64())))] if spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = True) -> DataFrame:
    """Train on the labelled documents outside the held-out fold and tag every document."""
    return tag(docs, train(docs, labels), spans)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = toxicity(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
                      F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), F.size("__spans").cast("long").alias("n_spans"))
