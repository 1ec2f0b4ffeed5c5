"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows. It reads every
byte of a text, in windows of a fixed number of bytes, forwards and backwards, gives each position a distribution over
languages, and a document's distribution is the mean over its positions.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import arrays
from graphloom.llm.common import append_columns

#: Bytes of a window, and windows the network reads at once.
STEPS, TOGETHER = 64, 2048
UNKNOWN = "und"


@dataclasses.dataclass(frozen=True)
class Training:
    """The sample's bounds (documents of each language, passages of each), and how the network is trained."""

    per_language: int = 256
    passages: int = 6
    languages: int = 256
    hidden: int = 8
    epochs: int = 4
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


def _squash(x: np.ndarray, work: np.ndarray) -> None:
    """x to its hyperbolic tangent, in place, by the rational form x (27 + x^2) / (27 + 9 x^2), within 0.025 of it."""
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=work)
    work += 27
    x *= work
    work *= 9
    work -= 216
    x /= work


def _slope(x: np.ndarray) -> np.ndarray:
    """The derivative of that rational form at x: ((9 - x^2) / (3 (3 + x^2)))^2, 0 beyond 3."""
    square = np.minimum(x * x, 9)
    return ((9 - square) / (3 * (3 + square))) ** 2


class Network:
    """Weights of both directions: from bytes (2, 256, 3h), recurrent (2, h, 3h), to languages (2h, k), bias (k)."""

    def __init__(self, languages: list[str], hidden: int, seed: int, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        k = len(languages)
        self.languages, self.hidden, self.kind = languages, hidden, kind
        self.weights = [
            rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(kind), rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(kind),
            rng.normal(0, 0.3, (2 * hidden, k)).astype(kind), np.zeros(k, kind),
        ]

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, windows, 2h); what backpropagation needs goes to ``keep``.

        Update, reset and new state have arrays of their own, all contiguous, which are written in place.
        """
        n, steps = codes.shape
        h = self.hidden
        out = np.empty((steps, n, 2 * h), self.kind)
        places = np.ascontiguousarray(codes.T.astype(np.intp))
        work = np.empty((2, n, h), self.kind)
        for d in range(2):
            tables = [np.ascontiguousarray(self.weights[0][d][:, i * h : (i + 1) * h]) for i in range(3)]
            own = [np.ascontiguousarray(self.weights[1][d][:, i * h : (i + 1) * h]) for i in range(3)]
            state = np.zeros((n, h), self.kind)
            given, made = np.empty((3, n, h), self.kind), np.empty((3, n, h), self.kind)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                if keep is not None:
                    given, made = np.empty_like(given), np.empty_like(made)
                for i in range(3):
                    np.take(tables[i], places[t], axis=0, out=given[i], mode="clip")
                    np.matmul(state, own[i], out=made[i])
                gates = given[:2]
                gates += made[:2]
                gates *= 0.5
                slopes = None if keep is None else _slope(gates) / 4
                _squash(gates, work)
                gates += 1
                gates *= 0.5
                new = given[2]
                np.multiply(gates[1], made[2], out=work[0])
                new += work[0]
                slope = None if keep is None else _slope(new)
                _squash(new, work[1])
                if keep is not None:
                    keep.append((d, t, state, gates[0], gates[1], new, made[2], slopes, slope))
                state = new + gates[0] * (state - new)
                out[t, :, d * h : (d + 1) * h] = state
        return out

    def positions(self, states: np.ndarray) -> np.ndarray:
        """The distribution over languages (languages, steps, windows) at each position."""
        logits = self.weights[2].T @ states.reshape(-1, 2 * self.hidden).T
        logits += self.weights[3][:, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits.reshape(-1, *states.shape[:2])

    def gradients(self, codes: np.ndarray, valid: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy over valid positions, by backpropagation through time."""
        h = self.hidden
        saved: list = []
        states = self.states(codes, saved)
        probabilities = np.ascontiguousarray(self.positions(states).transpose(1, 2, 0))
        mask = valid.T.astype(self.kind)
        total = max(1.0, float(mask.sum()))
        rows = np.arange(len(labels))
        loss = float(-(np.log(probabilities[:, rows, labels] + 1e-9) * mask).sum() / total)
        wrong = probabilities
        wrong[:, rows, labels] -= 1
        wrong *= mask[..., None] / total
        k = wrong.shape[-1]
        to_out = states.reshape(-1, 2 * h).T @ wrong.reshape(-1, k)
        back = wrong @ self.weights[2].T
        from_bytes, recurrent = np.zeros_like(self.weights[0]), np.zeros_like(self.weights[1])
        carried = [np.zeros((len(labels), h), self.kind) for _ in range(2)]
        for d, t, state, update, reset, new, own, slopes, slope in reversed(saved):
            error = back[t, :, d * h : (d + 1) * h] + carried[d]
            e_new = error * (1 - update) * slope
            e_update = error * (state - new) * slopes[0]
            e_reset = e_new * own * slopes[1]
            e_own = np.concatenate([e_update, e_reset, e_new * reset], axis=1)
            recurrent[d] += state.T @ e_own
            carried[d] = error * update + e_own @ self.weights[1][d].T
            e_given = np.concatenate([e_update, e_reset, e_new], axis=1)
            order = np.argsort(codes[:, t], kind="stable")
            present, first = np.unique(codes[order, t], return_index=True)
            from_bytes[d][present] += np.add.reduceat(e_given[order], first, axis=0)
        return [from_bytes, recurrent, to_out, wrong.sum(axis=(0, 1))], loss

    def train(self, codes: np.ndarray, valid: np.ndarray, labels: np.ndarray, settings: Training) -> list[float]:
        """Adam with clipped gradients and a falling rate; returns the loss of each step."""
        rng = np.random.default_rng(settings.seed)
        mean, square = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        steps = settings.epochs * -(-len(labels) // settings.batch)
        losses: list[float] = []
        for _ in range(settings.epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), settings.batch):
                rows = order[at : at + settings.batch]
                grads, loss = self.gradients(codes[rows], valid[rows], labels[rows])
                losses.append(loss)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                rate = settings.rate * (1 - (len(losses) - 1) / steps) + 1e-4
                for i, g in enumerate(grads):
                    g = g * min(1.0, 1.0 / (size + 1e-9))
                    mean[i] += 0.1 * (g - mean[i])
                    square[i] += 0.01 * (g * g - square[i])
                    self.weights[i] -= (rate * (mean[i] / (1 - 0.9 ** len(losses))) / (np.sqrt(square[i] / (1 - 0.99 ** len(losses))) + 1e-7)).astype(self.kind)
        return losses

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's distribution over languages: the mean over all its bytes; zeros for an empty text."""
        lengths = np.diff(offsets)
        windows = -(-lengths // STEPS)
        doc = np.repeat(np.arange(len(lengths)), windows)
        first = np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.repeat(offsets[:-1], windows) + (np.arange(len(doc)) - first) * STEPS
        size = np.minimum(STEPS, np.repeat(offsets[1:], windows) - begin)
        sums = np.zeros((len(lengths), len(self.languages)))
        padded = np.append(data, np.zeros(STEPS, np.uint8))
        for at in range(0, len(doc), TOGETHER):
            part = slice(at, at + TOGETHER)
            inside = np.arange(STEPS) < size[part, None]
            codes = np.where(inside, padded[begin[part, None] + np.arange(STEPS)], 0)
            chances = self.positions(self.states(codes))
            chances *= inside.T
            of_windows = chances.sum(axis=1).astype(np.float64)
            for i, row in enumerate(of_windows):
                sums[:, i] += np.bincount(doc[part], weights=row, minlength=len(sums))
        return sums / np.maximum(lengths, 1)[:, None]


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, training: Training, id_col: str, text_col: str, lang_col: str) -> list:
    """Passages (lang, bytes) of labelled rows that aren't held out: of each language one row, the one of the smallest
    id, from each of ``per_language`` ranges of the id's hash; of each such row ``passages`` passages at places that
    the hash of the id gives. The number of languages is bounded too; the most frequent ones stay."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    spread = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(training.per_language)).alias("slot"))
    chosen = spread.groupBy("lang", "slot").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    top = chosen.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(training.languages)
    chosen = chosen.join(F.broadcast(top.select("lang")), "lang").select("lang", "id")
    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["lang", "id"])
    room = F.greatest(F.lit(1), F.length("text") - STEPS + 1)
    places = F.transform(F.sequence(F.lit(1), F.lit(training.passages)), lambda i: F.substring("text", 1 + F.pmod(F.xxhash64("id", i), room).cast("int"), F.lit(STEPS)))
    return sorted((r.lang, tuple(r.parts)) for r in texts.select("lang", places.alias("parts")).collect())


def fit(docs: DataFrame, training: Training | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network trained on a bounded sample of docs; None where no row is labelled."""
    training = training or Training()
    passages = [(lang, p.encode()[:STEPS]) for lang, parts in sample(docs, training, id_col, text_col, lang_col) for p in parts if any(c.isalpha() for c in p)]
    if not passages:
        return None
    languages = sorted({lang for lang, _ in passages})
    codes, valid = np.zeros((len(passages), STEPS), np.uint8), np.zeros((len(passages), STEPS), bool)
    for i, (_, p) in enumerate(passages):
        codes[i, : len(p)] = np.frombuffer(p, np.uint8)
        valid[i, : len(p)] = True
    number = {lang: i for i, lang in enumerate(languages)}
    network = Network(languages, training.hidden, training.seed)
    network.train(codes, valid, np.array([number[lang] for lang, _ in passages]), training)
    return network


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    found = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = np.diff(found[offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        points, _ = arrays.code_points(data[offsets[i] : offsets[i + 1]])
        out[i] = bool((arrays.classes()[points] == arrays.LETTER).any())
    return out


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language of the highest pooled probability, and that probability.

    Of languages with the same probability the first by name is taken.
    A null text and one without a letter is ``und`` with score 0, and so is every text if there is no network. Whole
    texts are read, in windows; no shuffle. Columns with the result's names are replaced, all others and repeated rows
    pass through. An empty table gives an empty one.
    """

    def make():
        def run(texts: pa.Array) -> dict[str, pa.Array]:
            data, offsets = arrays.buffer(texts)
            known = has_letter(data, offsets)
            if network is None:
                known[:] = False
                best, score = np.zeros(len(known), np.int64), np.zeros(len(known))
            else:
                chances = network.pooled(data, offsets)
                best, score = chances.argmax(axis=1), chances.max(axis=1)
            names = [UNKNOWN, *(network.languages if network else [])]
            return {
                "lang_pred": pa.array(names, pa.string()).take(pa.array(np.where(known, best + 1, 0))),
                "score": pa.array(np.where(known, np.minimum(score, 1.0), 0.0)),
            }

        return run

    return append_columns(docs, make, [("lang_pred", "string"), ("score", "double")], text_col)


def identify(docs: DataFrame, training: Training | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score, by a network trained on those rows of docs that aren't held out.

    Training reads the text and the label of labelled rows only; prediction reads the text alone.
    """
    network = fit(docs, training, id_col, text_col, lang_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), network, text_col)
