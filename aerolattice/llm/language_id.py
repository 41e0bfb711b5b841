"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions, over words and lines, labels every position with a probability for
each language, and a document pools the log-probabilities of its positions. Texts are read in windows that all texts of
a slice share a batch with; a window begins ``MARGIN`` bytes before and ends as many after the positions that it labels,
so that the states there have read what surrounds them. Whole texts are read. Training is backpropagation through time
in numpy, with Adam, on windows drawn from all over the texts of a bounded number of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bounds of the training sample, in rows: of one language, and of all. Their whole texts are used.
SAMPLE_DOCS, SAMPLE_ROWS = 400, 2_000
#: Parts of a long training text, and their code points.
PARTS, PART = 32, 512
#: Units of each direction; steps, windows of a step and bytes of a window in training.
HIDDEN, STEPS, BATCH, STRETCH = 8, 500, 128, 64
#: Bytes that a window labels, bytes that it reads before and after them, and windows that run together.
WINDOW, MARGIN, TOGETHER = 448, 32, 2048
SLICE_BYTES = 4_000_000
UNDECIDED = "und"
PAD = 256
#: Positions that speak for a language: ASCII letters and all bytes of other scripts.
LETTER = np.zeros(257, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """Softsign in place, the network's cheap stand-in for tanh; its slope is the square of 1 - |value|."""
    np.abs(x, out=room)
    room += 1
    x /= room


def _slope(value: np.ndarray) -> np.ndarray:
    return (1 - np.abs(value)) ** 2


@dataclass
class Direction:
    """One direction's weights: a row of gate inputs for each byte (it holds the embedding), and the recurrence. The
    columns are the reset gate, the update gate and the candidate. Gates are ``(1 + squash) / 2``; the candidate's
    recurrence holds its half."""

    table: np.ndarray  # 257 x 3H; the last row is padding
    back: np.ndarray  # H x 3H

    def run(self, x: np.ndarray, keep: bool = False, out: np.ndarray | None = None):
        """States (time x units x segments) after each position of ``x`` (segments x time), written to ``out`` if given.
        Padding leaves the state as it is, whatever its row of the table."""
        units = self.back.shape[0]
        table, back = np.ascontiguousarray(self.table.T), np.ascontiguousarray(self.back.T)
        table[units : 2 * units, PAD] = 1e30  # the update gate keeps all
        n, steps = x.shape
        x = np.ascontiguousarray(x.T)
        h = np.zeros((units, n), table.dtype)
        states, tape = np.empty((steps, units, n), table.dtype) if out is None else out, []
        into, past, size = (np.empty((3 * units, n), table.dtype) for _ in range(3))
        for t in range(steps):
            if keep:
                into, past = np.empty_like(into), np.empty_like(past)
            np.take(table, x[t], axis=1, out=into, mode="clip")
            np.matmul(back, h, out=past)
            gates, r, z, c, held = into[: 2 * units], into[:units], into[units : 2 * units], into[2 * units :], past[2 * units :]
            gates += past[: 2 * units]
            _squash(gates, size[: 2 * units])
            c += held
            np.multiply(r, held, out=size[:units])
            c += size[:units]
            _squash(c, size[:units])
            if keep:
                tape.append((h, r, z, c, held))
            new = np.subtract(h, c, out=states[t])
            new *= z
            new += h
            new += c
            new *= 0.5
            h = new
        return states, tape

    def gradient(self, x: np.ndarray, tape: list, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of the table and the recurrence from those of the states."""
        d_back, carry = np.zeros_like(self.back), np.zeros_like(above[0])
        inputs = np.empty((x.shape[1], self.table.shape[1], x.shape[0]), above.dtype)
        for t in reversed(range(x.shape[1])):
            h, r, z, c, held = tape[t]
            d = (above[t] + carry) * 0.5
            dc = d * (1 - z) * _slope(c)
            dr, dz = dc * held * _slope(r), d * (h - c) * _slope(z)
            inputs[t] = np.concatenate([dr, dz, dc])
            into = np.concatenate([dr, dz, dc * (1 + r)])
            d_back += h @ into.T
            carry = d * (1 + z) + self.back @ into
        flat, places = inputs.transpose(1, 0, 2).reshape(inputs.shape[1], -1), x.T.ravel()
        d_table = np.stack([np.bincount(places, row, len(self.table)) for row in flat], axis=1).astype(self.table.dtype)
        d_table[PAD] = 0
        return d_table, d_back


@dataclass
class Network:
    forward: Direction
    backward: Direction
    out: np.ndarray  # 2H + 1 x languages
    languages: list[str]

    def read(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list, list]:
        """Both directions' states and a one (time x 2H + 1 x segments), and their tapes."""
        units = self.forward.back.shape[0]
        joined = np.ones((x.shape[1], 2 * units + 1, len(x)), self.out.dtype)
        _, tape_a = self.forward.run(x, keep, joined[:, :units])
        _, tape_b = self.backward.run(x[:, ::-1], keep, joined[::-1, units : 2 * units])
        return joined, tape_a, tape_b

    def label(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (time x languages x segments) of each position."""
        return _log_softmax(np.matmul(self.out.T, self.read(x)[0]))

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its letter positions' log-probabilities, and their number in the last column."""
        total = np.zeros((len(texts), len(self.languages) + 1))
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW - MARGIN
        width = np.minimum(sizes[owner] - first, WINDOW + 2 * MARGIN)
        order = np.argsort(width, kind="stable")
        for at in range(0, len(order), TOGETHER):
            part = order[at : at + TOGETHER]
            place = first[part, None] + np.arange(width[part[-1]])
            inside = (place >= 0) & (place < sizes[owner[part], None])
            place += (np.cumsum(sizes) - sizes)[owner[part], None]
            x = np.where(inside, data[np.clip(place, 0, len(data) - 1)], np.intp(PAD))
            letters = LETTER[x]
            letters[:, :MARGIN] = letters[:, MARGIN + WINDOW :] = False
            sums = np.einsum("tln,tn->nl", self.label(x), np.ascontiguousarray(letters.T, np.float32))
            np.add.at(total, owner[part], np.column_stack([sums, letters.sum(axis=1)]))
        return total


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Along the second last axis."""
    x = x - x.max(axis=-2, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-2, keepdims=True))


def pack(texts: list[bytes]) -> np.ndarray:
    """Byte strings as rows of byte values, padded by 256."""
    x = np.full((len(texts), max(map(len, texts), default=0)), PAD, np.intp)
    for k, t in enumerate(texts):
        x[k, : len(t)] = np.frombuffer(t, np.uint8)
    return x


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    by: dict[str, list[bytes]] = {name: [] for name in languages}
    for text, name in zip(texts, labels):
        by[name] += [text.encode()] if text else []
    pools = [by[name] or [b" "] for name in languages]
    spread = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    side = lambda: Direction((rng.standard_normal((257, 3 * HIDDEN)) * 0.5).astype(np.float32), spread(HIDDEN, 3 * HIDDEN))
    net = Network(side(), side(), spread(2 * HIDDEN + 1, len(languages)), languages)
    weights = [net.forward.table, net.forward.back, net.backward.table, net.backward.back, net.out]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def stretch(pool: list[bytes]) -> bytes:
        text = pool[rng.integers(len(pool))]
        at = int(rng.integers(max(len(text) - STRETCH, 0) + 1))
        return text[at : at + STRETCH]

    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        x = pack([stretch(pools[k]) for k in y])
        joined, tape_a, tape_b = net.read(x, keep=True)
        letters = LETTER[x].T[:, None, :]
        error = np.exp(_log_softmax(np.matmul(net.out.T, joined)))
        error[:, y, np.arange(BATCH)] -= 1
        error *= (letters / max(letters.sum(), 1)).astype(np.float32)
        up = np.matmul(net.out, error)
        grads = [
            *net.forward.gradient(x, tape_a, up[:, :HIDDEN]),
            *net.backward.gradient(x[:, ::-1], tape_b, up[::-1, HIDDEN : 2 * HIDDEN]),
            np.matmul(joined, error.transpose(0, 2, 1)).sum(axis=0),
        ]
        rate = 0.02 * (1 - step / (steps + 1))
        for w, g, m, v in zip(weights, grads, mean, square):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def training_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``docs_each`` rows of each language, and about ``rows`` in all, chosen by a hash of the id among labelled
    rows that aren't held out, with their texts, of long ones parts: what reaches the driver is bounded. One slim count (a row for each language, as the network has an
    output for each) and one scan; no shuffle of texts."""
    usable = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return usable.limit(0)
    each = min(docs_each, rows / len(sizes))
    wanted = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, each / n)))
    share = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    # Training reads short stretches, so of a long text PARTS parts of equal length, evenly spread, are as good.
    size = F.length("text")
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.substring("text", F.floor(k * (size - PART) / (PARTS - 1)).cast("int") + 1, F.lit(PART)))
    text = F.when(size > PARTS * PART, F.array_join(parts, " ")).otherwise(F.col("text"))
    return usable.filter(share < wanted[F.col("lang")]).withColumn("text", text)


def fit(docs: DataFrame, docs_each: int = SAMPLE_DOCS, steps: int = STEPS) -> Network | None:
    """The trained network, or None where no row has a language."""
    rows = sorted(training_sample(docs, docs_each).select("doc_id", "lang", "text").collect(), key=lambda r: (r.lang, str(r.doc_id), r.text))
    return train([r.text for r in rows], [r.lang for r in rows], steps) if rows else None


def judge(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    total = net.pool([t.encode() if t and any(map(str.isalpha, t)) else b"" for t in texts])
    pooled = np.exp(_log_softmax((total[:, :-1] / np.maximum(total[:, -1:], 1)).T)).T
    known = total[:, -1] > 0
    names = [net.languages[k] if ok else UNDECIDED for k, ok in zip(pooled.argmax(axis=1).tolist(), known.tolist())]
    return names, np.where(known, np.minimum(pooled.max(axis=1), 1.0), 0.0).round(6).tolist()


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row for each input row, repeated ones too: ``doc_id, held_out, lang_pred, score``; other columns are dropped.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. The score is the
    pooled (geometric mean) probability, to six places; of tied languages the first by name is taken. A null id isn't
    held out. An empty table gives no rows. Row-local: no shuffle; whole texts are read, very long ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            names, scores = judge(sent.value, part.column("text").to_pylist()) if sent.value else ([UNDECIDED] * part.num_rows, [0.0] * part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows that aren't held out, then label all rows."""
    return identify(docs, fit(docs))
