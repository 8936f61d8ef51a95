"""Document likelihood under a unigram model of subword pieces, summed over all segmentations.

The pieces and the order of their scores come from an existing vocabulary. A document is its words, each
with a mark before it, and an end. A forward recursion in log space over the lattice of pieces gives the marginal
probability of a word; no piece crosses from word to word, so a document's is the product of its words'.
Piece weights start as 1 / (score rank + RANK_SHIFT) and are re-estimated by expectation-maximisation on all the
words of the training documents. Pieces are never added: no tokenizer is trained.

Words are weighed once each, in a distributed table; documents are scored by a join with it. The most frequent
words (BROADCAST_WORDS, a fixed number) are sent to all tasks instead, which also takes the hot keys out of the join.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import ship, written

MARK = "▁"
RANK_SHIFT = 50.0
#: Steps of the estimation, each over all training words.
STEPS = 3
#: Characters of a word whose expectations are computed with plain probabilities, where those do not underflow.
PLAIN_CHARS = 64
BROADCAST_WORDS = 300_000
#: Added to every piece's expected count.
PRIOR = 0.1
_LOG10 = math.log(10)


def _add(into: dict[str, float], piece: str | tuple[str, ...], c: float) -> None:
    for x in (piece,) if isinstance(piece, str) else piece:
        into[x] = into.get(x, 0.0) + c


def _log_sum(t: list[float]) -> float:
    if len(t) < 2:
        return t[0] if t else -math.inf
    m = max(t)
    return m if m == -math.inf else m + math.log(sum([math.exp(x - m) for x in t]))


class Lattice:
    """Pieces with log weights; END stands for the end of a document."""

    END = "</s>"

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        #: Every piece with its weight, and every beginning of one (None): a search goes on as long as it is here.
        self.table: dict[str, float | None] = {p[:k]: None for p in weights for k in range(1, len(p))}
        self.table.update(weights)
        #: The same as plain probabilities; 0 for a mere beginning.
        self.plain = {p: 0.0 if w is None else math.exp(w) for p, w in self.table.items()}

    @classmethod
    def from_vocabulary(cls, path: str) -> Lattice:
        """Pieces of a sentencepiece file; single bytes stand for characters that are no piece."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i)) and MARK not in p[1:]:
                pieces[p] = -model.get_score(i) if not model.is_byte(i) else model.get_piece_size()
        pieces[cls.END] = 0
        total = math.log(sum(1 / (r + RANK_SHIFT) for r in pieces.values()))
        return cls({p: -math.log(r + RANK_SHIFT) - total for p, r in pieces.items()})

    def arcs(self, s: str) -> list[list[tuple[int, float, object]]]:
        """For each place the arcs that end there: (begin, log weight, piece or tuple of byte pieces)."""
        table, n = self.table, len(s)
        out: list[list[tuple[int, float, object]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if s[i] not in self.weights:
                raw = self.bytes_of(s[i])
                out[i + 1].append((i, sum(w for _, w in raw), tuple(b for b, _ in raw)))
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in table:
                    break
                w = table[p]
                if w is not None:
                    out[j].append((i, w, p))
        return out

    def forward(self, arcs: list[list[tuple[int, float, object]]]) -> list[float]:
        a = [0.0]
        for into in arcs[1:]:
            a.append(_log_sum([a[i] + w for i, w, _ in into]))
        return a

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the marked word, by a forward recursion in log space."""
        s, table = MARK + word, self.table
        n, a = len(s), 0.0
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            t = into[i]
            if not t:
                continue
            a = t[0] if len(t) == 1 else _log_sum(t)
            if s[i] not in self.weights:
                into[i + 1].append(a + sum(w for _, w in self.bytes_of(s[i])))
            for j in range(i + 1, n + 1):
                p = s[i:j]
                if p not in table:
                    break
                w = table[p]
                if w is not None:
                    into[j].append(a + w)
        return _log_sum(into[n])

    def bytes_of(self, c: str) -> list[tuple[str, float]]:
        """The byte pieces of a character that is no piece, with their log weights."""
        return [(b, self.weights.get(b, -50.0)) for b in (f"<0x{x:02X}>" for x in c.encode("utf-8", "surrogatepass"))]

    def expect(self, word: str, count: float, into: dict[str, float]) -> None:
        """Adds count times the expected number of each piece in the word."""
        if len(word) >= PLAIN_CHARS or not self._expect_plain(word, count, into):
            self._expect_log(word, count, into)

    def _expect_plain(self, word: str, count: float, into: dict[str, float]) -> bool:
        """With plain probabilities; False, with nothing added, if they underflow."""
        s, get = MARK + word, self.plain.get
        n = len(s)
        a = [1.0] + [0.0] * n
        arcs = []
        for i in range(n):
            ai = a[i]
            if s[i] not in self.weights:
                raw = self.bytes_of(s[i])
                w = math.exp(sum(w for _, w in raw))
                a[i + 1] += ai * w
                arcs.append((i, i + 1, w, tuple(b for b, _ in raw)))
            for j in range(i + 1, n + 1):
                p = s[i:j]
                w = get(p, -1.0)
                if w > 0.0:
                    a[j] += ai * w
                    arcs.append((i, j, w, p))
                elif w < 0.0:
                    break
        if a[n] < 1e-250:
            return False
        b = [0.0] * n + [count / a[n]]
        for i, j, w, p in reversed(arcs):
            t = b[j] * w
            b[i] += t
            if type(p) is str:
                into[p] = into.get(p, 0.0) + a[i] * t
            else:
                _add(into, p, a[i] * t)
        return True

    def _expect_log(self, word: str, count: float, into: dict[str, float]) -> None:
        arcs = self.arcs(MARK + word)
        n, exp = len(arcs) - 1, math.exp
        a = self.forward(arcs)
        b = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            if b[j] == -math.inf:
                continue
            for i, w, p in arcs[j]:
                t = b[j] + w
                b[i] = t if b[i] == -math.inf else max(b[i], t) + math.log1p(exp(-abs(b[i] - t)))
                _add(into, p, count * exp(a[i] + t - a[n]))

    def reweighted(self, expected: dict[str, float]) -> Lattice:
        total = math.log(sum(expected.get(p, 0.0) for p in self.weights) + PRIOR * len(self.weights))
        return Lattice({p: math.log(expected.get(p, 0.0) + PRIOR) - total for p in self.weights})


_MODELS: dict[str, Lattice] = {}


def _model(key: str, weights: dict[str, float]) -> Lattice:
    """The lattice of a worker process: built once for all its tasks."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Lattice(weights)
    return _MODELS[key]


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space


def word_counts(df: DataFrame) -> DataFrame:
    """(word binary, c) of (held, text): training count of every word of any document, summed in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[bytes] = Counter()
            other: set[bytes] = set()
            for held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held:
                    other.update(_split(text))
                else:
                    count.update(_split(text))
            other.difference_update(count)
            words = [*count, *other]
            for lo in range(0, len(words), 100_000):
                part = words[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([count[w] if w in count else 0 for w in part], pa.int64())], ["word", "c"])

    return df.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, docs: int, path: str, steps: int = STEPS) -> Lattice:
    """Estimates the weights by expectation-maximisation, each step over all training words.

    words: (word, c); docs: number of training documents. Of a step one sum for each piece and partition leaves the
    executors, added up by Spark: no more rows than the vocabulary has pieces reach the driver.
    """
    model = Lattice.from_vocabulary(path)
    trained = words.filter("c > 0")
    for _ in range(steps):
        sent = words.sparkSession.sparkContext.broadcast(model.weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            own, sums = _model(key, sent.value), {}
            for b in batches:
                for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own.expect(w.decode("utf-8", "surrogatepass"), c, sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], ["piece", "n"])

        rows = trained.mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        expected = dict(zip(rows["piece"].to_pylist(), rows["n"].to_pylist()))
        if not expected:
            break
        expected[Lattice.END] = float(docs)
        model = model.reweighted(expected)
    return model


def score(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each input row; logs to base 10.

    A null or empty text is the end alone. A null id counts as a training document. Repeated ids and rows count
    and return each time. Very long texts and words are read whole. Without training documents every count is 0
    and the weights are the vocabulary's own. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    src = df.select(df[id_col].alias("id"), held_out(df[id_col]).alias("held"), df[text_col].alias("text"))
    words = written(word_counts(src.select("held", "text")), "word-counts")
    docs = src.filter("not held").count()
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = tokens + docs, distinct + (docs > 0)
    below = math.log10(tokens + 0.5 * (distinct + 1))
    model = fit(words, docs, path)
    sent, key = spark.sparkContext.broadcast(model.weights), uuid.uuid4().hex

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(key, sent.value)
        for b in batches:
            got = [own.log_probability(w.decode("utf-8", "surrogatepass")) / _LOG10 for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["word", "c", "p"])

    weighed = written(words.mapInArrow(weigh, "word binary, c long, p double"), "word-weights")
    top = weighed.orderBy(F.desc("c"), "word").limit(BROADCAST_WORDS).toArrow()
    hot = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy(), top["p"].to_numpy()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sums of its frequent words, and one for each of its other words."""
        task, row = TaskContext.get().partitionId() << 33, 0
        listed, c, p = hot.value
        at = {w: i for i, w in enumerate(listed)}
        base = np.log10(c + 0.5) - below
        schema = pa.schema([("row", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        for b in batches:
            ids, held = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 250):
                out: list[list] = [[], [], [], [], [], [], [], [], []]
                for k, text in zip(range(lo, min(lo + 250, b.num_rows)), b.column(2).slice(lo, 250).to_pylist()):
                    own = _split(text)
                    place = np.fromiter((at.get(w, -1) for w in own), np.int64, len(own))
                    there = place[place >= 0]
                    key = task | row
                    row += 1
                    # No word has a space: this key meets nothing in the join, and is not a null that would fill one task.
                    head = (key, b" %d" % key, 0, len(own) + 1, int((c[there] > 0).sum()) + (docs > 0), float(base[there].sum()) + math.log10(docs + 0.5) - below, float(p[there].sum()) + model_end)
                    rest = Counter([own[i] for i in np.flatnonzero(place < 0).tolist()])
                    for x, v in zip(out, (*head, k, True)):
                        x.append(v)
                    if rest:
                        m = len(rest)
                        for x, v in zip(out, ([key] * m, list(rest), list(rest.values()), [0] * m, [0] * m, [0.0] * m, [0.0] * m, [k] * m, [False] * m)):
                            x.extend(v)
                first = pa.array(out[8])
                place = pa.array(out[7], pa.int64())
                none = pa.scalar(None, ids.type)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t.type) for x, t in zip(out[:7], schema)), pc.if_else(first, ids.take(place), none), pc.if_else(first, held.take(place), pa.scalar(None, pa.bool_()))], [*schema.names, "id", "held"])

    model_end = model.weights[Lattice.END] / _LOG10
    kind = df.schema[id_col].dataType.simpleString()
    rows = src.mapInArrow(split, f"row long, word binary, tf long, n long, known long, base double, score double, id {kind}, held boolean")
    tf, got = F.col("tf"), rows.join(weighed, "word", "left")
    unknown = F.lit(math.log10(0.5) - below)
    base = F.when(tf > 0, tf * F.coalesce(F.log10(F.col("c") + 0.5) - below, unknown)).otherwise(F.col("base"))
    per = got.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.max("held").alias("held_out"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(F.col("c") > 0, tf).otherwise(F.col("known"))).alias("n_known"),
        F.sum(base).alias("base_score"),
        F.sum(F.when(tf > 0, tf * F.col("p")).otherwise(F.col("score"))).alias("score"),
    )
    return per.select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
