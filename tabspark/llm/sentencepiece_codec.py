"""SentencePiece encoding and decoding with a unigram model.

The best segmentation of a text is the Viterbi path of largest summed piece scores.  Pieces are found in a
double-array trie over their UTF-8 bytes; a character no piece covers costs the smallest score less 10 and becomes
byte pieces.  Blanks are written as U+2581, with one in front of the text; decoding turns them back and drops
that one.  On equal scores the piece that starts first wins.

No piece continues over the start of a run of blanks (checked when the model is loaded), so texts are cut there
and each distinct stretch of a task is segmented once, all stretches of one length together in arrays.

The model file is a parameter: any SentencePiece file whose pieces have scores.  Null and empty texts have no tokens;
null stays null when it is decoded.  A U+2581 in a text decodes to a blank, all else round-trips.  Columns beside
``text`` pass through, and repeated rows are encoded alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 100_000  # stretches whose pieces a task remembers
_STRETCH = re.compile(r" +[^ ]*|[^ ]+")


@dataclass
class Pieces:
    base: np.ndarray  # double array: child of s by byte c is base[s] + c + 1, if check there is s
    check: np.ndarray
    value: np.ndarray  # piece that ends in a state, or -1
    score: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    raw: list[bytes]  # what each piece decodes to

    def __post_init__(self):
        self.size = np.array([len(x) for x in self.raw])
        self.place = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(self.raw), np.uint8)

    def encode_stretches(self, stretches: list[bytes]) -> list[bytes]:
        """Piece ids (32 bits each) of each stretch."""
        out: list = [None] * len(stretches)
        lengths = np.array([len(x) for x in stretches])
        for n in np.unique(lengths).tolist():
            where = np.flatnonzero(lengths == n)
            step = max(1, 1_000_000 // (n + 1))
            for i in range(0, len(where), step):
                part = where[i : i + step]
                for w, ids in zip(part.tolist(), self._best(np.frombuffer(b"".join(stretches[k] for k in part.tolist()), np.uint8).reshape(-1, n))):
                    out[w] = ids
        return out

    def _best(self, text: np.ndarray):
        rows, n = text.shape
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, rows), np.int32)
        piece = np.full((n + 1, rows), -1, np.int32)
        columns = np.ascontiguousarray(text.T)
        first = (columns & 0xC0) != 0x80
        size = np.ones((n, rows), np.int32)
        for i in range(n - 2, -1, -1):
            size[i] = np.where(first[i + 1], 1, size[i + 1] + 1)
        for i in range(n):
            lanes = np.flatnonzero(first[i])
            single = ~first[i]
            at, state = lanes, np.zeros(len(lanes), np.int64)
            for d in range(n - i):
                child = self.base[state] + columns[i + d, at] + 1
                ok = self.check[child] == state
                at, state = at[ok], child[ok]
                if not len(at):
                    break
                ends = self.value[state] >= 0
                if ends.any():
                    who, ids = at[ends], self.value[state[ends]]
                    single[who[size[i, who] == d + 1]] = True
                    self._update(best, back, piece, i, np.full(len(who), i + d + 1), who, best[i, who] + self.score[ids], ids)
            lost = np.flatnonzero(~single)
            if len(lost):
                self._update(best, back, piece, i, i + size[i, lost], lost, best[i, lost] + self.unknown, np.full(len(lost), -1))
        # walk all paths back together; a step of -1 is a character without a piece
        every, end, steps = np.arange(rows), np.full(rows, n), []
        while end.any():
            steps.append(np.where(end > 0, piece[end, every], -2))
            end = np.where(end > 0, back[end, every], 0)
        path = np.array(steps[::-1], np.int32).T
        length = (path != -2).sum(axis=1)
        whole = path[path != -2].tobytes()
        cuts = np.concatenate([[0], np.cumsum(length)]) * 4
        lost = (path == -1).any(axis=1)
        for r in range(rows):
            if not lost[r]:
                yield whole[cuts[r] : cuts[r + 1]]
                continue
            ids, e = [], n
            while e > 0:
                start, p = int(back[e, r]), int(piece[e, r])
                ids.append([p] if p >= 0 else self.byte_ids[text[r, start:e]].tolist())
                e = start
            yield np.array([x for part in reversed(ids) for x in part], np.int32).tobytes()

    @staticmethod
    def _update(best, back, piece, start, end, who, value, ids):
        better = value > best[end, who]
        e, w = end[better], who[better]
        best[e, w], back[e, w], piece[e, w] = value[better], start, ids[better]

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[np.ndarray]:
        cut = []
        for t in texts:
            cut.append([x[1:] for x in _STRETCH.findall(" " + t)] if "  " in " " + t else t.split(" ") if t else [])
        new = list({x for stretches in cut for x in stretches if x not in cache})
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({x for stretches in cut for x in stretches})
        for x, ids in zip(new, self.encode_stretches([(BLANK + x.replace(" ", BLANK)).encode() for x in new])):
            cache[x] = ids
        return [np.frombuffer(b"".join([cache[x] for x in stretches]), np.int32) for stretches in cut]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids: run i is ids[cuts[i]:cuts[i + 1]]."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[ids] - (ends - size), size)
        data, edge = self.letters[at].tobytes(), np.concatenate([[0], ends])[cuts]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edge.tolist(), edge[1:].tolist())]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def double_array(words: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of the trie of ``words``."""
    nodes: list[dict[int, int]] = [{}]
    ends = [-1]
    for w, i in zip(words, ids):
        at = 0
        for c in w:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                ends.append(-1)
            at = nodes[at][c]
        ends[at] = i
    slots = np.full(257, -1, np.int64)  # states of slots; the first 257 stay empty, so that a leaf (base 0) has no children
    base, check, value, used = np.zeros(257, np.int64), slots, slots.copy(), np.zeros(257, bool)
    used[0] = True

    def grow(n):
        nonlocal base, check, value, used
        if n > len(used):
            more = n - len(used)
            base, used = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([used, np.zeros(more, bool)])
            check, value = np.concatenate([check, np.full(more, -1, np.int64)]), np.concatenate([value, np.full(more, -1, np.int64)])

    hole, wide, todo = 257, 257, [(0, 0)]  # first free slot; where nodes of several children look first
    while todo:
        node, state = todo.pop()
        value[state] = ends[node]
        kids = sorted(nodes[node])
        if not kids:
            continue
        codes = np.array(kids) + 1
        if len(kids) == 1:
            while hole < len(used) and used[hole]:
                hole += 1
            b = hole - int(codes[0])
        else:
            while True:
                grow(wide + 8192)
                first = wide + np.flatnonzero(~used[wide : wide + 4096])
                fits = first[~used[first[:, None] - codes[0] + codes].any(axis=1)] if len(first) else first
                if len(fits):
                    b = int(fits[0]) - int(codes[0])
                    break
                wide += 4096
        grow(b + 600)
        base[state] = b
        for c in kids:
            child = b + c + 1
            used[child], check[child] = True, state
            todo.append((nodes[node][c], child))
    grow(len(used) + 600)
    return base, check, value


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    texts = {i: model.id_to_piece(i) for i in plain}
    if any(re.search(f"[^{BLANK}]{BLANK}", t) for t in texts.values()):
        raise ValueError("a piece continues over a blank; texts cannot be cut at blanks with this model")
    score = np.array([model.get_score(i) for i in range(n)])
    byte_ids, raw = np.full(256, model.unk_id(), np.int32), [b""] * n
    for i in range(n):
        if model.is_byte(i):
            b = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[b], raw[i] = i, bytes([b])
    for i, t in texts.items():
        raw[i] = t.replace(BLANK, " ").encode()
    raw[model.unk_id()] = raw[model.unk_id()] or " ⁇ ".encode()
    return Pieces(*double_array([t.encode() for t in texts.values()], plain), score, float(score[plain].min()) - UNKNOWN_PENALTY, byte_ids, raw)


def encode(docs: DataFrame, model: Pieces | str = MODEL, decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` with __ids (null for a null text), __score (the summed score of the pieces), and __decoded if wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model) if isinstance(model, str) else model)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField("__ids", T.ArrayType(T.IntegerType())), T.StructField("__score", T.DoubleType())] + ([T.StructField("__decoded", T.StringType())] if decoded else []))

    def run(batches):
        m, cache = shared.value, {}
        cost = m.score.copy()
        cost[m.byte_ids] = m.unknown
        for batch in pieces(batches, size=4 << 20):  # many new stretches at a time make the arrays long
            texts = batch.column("text").to_pylist()
            got = m.encode([t or "" for t in texts], cache)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])])
            missing = pa.array([t is None for t in texts])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(got)), mask=missing)
            new = [ids, pa.array([float(cost[x].sum()) for x in got])]
            if decoded:
                new.append(_decoded(m, ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return docs.mapInArrow(run, schema)


def _decoded(m: Pieces, lists: pa.Array) -> pa.Array:
    ids, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    return pc.if_else(lists.is_valid(), pa.array(m.decode(ids, cuts), pa.string()), None)


def decode(docs: DataFrame, model: Pieces | str = MODEL) -> DataFrame:
    """All columns of ``docs`` with __decoded, the text of __ids."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model) if isinstance(model, str) else model)
    schema = T.StructType([*docs.schema.fields, T.StructField("__decoded", T.StringType())])

    def run(batches):
        m = shared.value
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(m, batch.column("__ids"))], schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, score, SHA-256 of the comma-joined ids and whether the ids decode to the text."""
    out = encode(docs.select("doc_id", "text"), model, decoded=True)
    return out.select("doc_id", F.coalesce(F.size("__ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("__score").alias("score"),
                      F.sha2(F.array_join(F.coalesce("__ids", F.array().cast("array<int>")), ","), 256).alias("ids_sha256"), F.col("text").eqNullSafe(F.col("__decoded")).alias("round_trip"))
