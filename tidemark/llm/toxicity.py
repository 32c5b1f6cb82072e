"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every text is cut into words (runs of ASCII letters and digits and of all bytes from 0x80, lower-cased; a run of more than
``LONG`` bytes, as in scripts without blanks, into overlapping words of about ``2 * STEP`` bytes, between characters) and
scored in windows of ``WINDOW`` words that overlap by half, to its end. A word's input is the sum of its own hashed vector and the
mean of hashed vectors of its character 3- to 5-grams with a mark at either end. Forward and backward gated units read
a window; attention pools their states to one logit. A text's logit is the largest of its windows; it is calibrated by
logistic regression together with the logarithm of the number of windows.

Training sees only the text's label: the gradient goes to the window with the largest logit. It runs on the driver, on a
sample of labelled rows that are not held out: about ``fit_rows`` in order of a hash, half of either label where there
are as many, whole texts of at most ``fit_chars`` code points, marked ones of a quarter of ``fit_total`` together and
others of the rest. The calibration weighs them as
all labelled rows. One input of a word and of a character n-gram begins with how far its texts exceed the share of
marked texts, so that a few dozen marked texts teach something. Scoring reads all windows of all texts in tasks, a
bounded number of bytes at a time; a long text is cut between words, where a window of the whole text begins. (Where a
cut falls within a run of over ``LONG`` bytes, the words of its rest may begin elsewhere.)

Defined cases: null text counts as empty; a text without words is one empty window; if labelled rows of one kind
only exist the score is that label for all, and 0 (nothing is rejected) if there are none; repeated rows get equal scores; a null ``doc_id`` is not held out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, table, text_or_empty, without
from tidemark.llm.labelled import held_out, teaching_sample

WINDOW = 32
STRIDE = 16
#: Bytes of the longest run that is one word, and bytes between the beginnings of words in longer runs.
LONG = 64
STEP = 12
#: Windows that run through the network at once, and bytes of text that are cut into words at once.
_LANES = 2048
_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = _IS_WORD[48:58] = _IS_WORD[97:123] = True


def _parted(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs as words: those of more than LONG bytes as words that begin every STEP bytes and reach over two steps, to the run's end."""
    n = np.where(end - start > LONG, -(-(end - start) // STEP) - 1, 1)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left, right, many = np.repeat(start, n), np.repeat(end, n), np.repeat(n, n)

    def border(steps: np.ndarray) -> np.ndarray:
        at = left + STEP * steps
        for _ in range(3):  # back to the first byte of a character
            at = at - ((steps > 0) & (raw[np.minimum(at, len(raw) - 1)] & 0xC0 == 0x80))
        return at

    return (left, right) if (n == 1).all() else (border(k), np.where(k + 1 < many, border(k + 2), right))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of the words in lower-cased UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    inside = _IS_WORD[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return raw, *_parted(raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, hash) of the words in lower-cased UTF-8."""
    raw, start, end = word_places(data)
    hashes = np.zeros(len(start), np.uint64)
    # tables made where they are used: as globals they would travel with every task
    up, down = _powers(_BASE, min(_BYTES, len(raw)) + 1), _powers(pow(_BASE, -1, 2**64), min(_BYTES, len(raw)) + 1)
    for at in range(0, len(raw), _BYTES):  # words that reach over a border of the pieces are cut there for their hash
        sums = np.concatenate(([np.uint64(0)], np.cumsum((raw[at : at + _BYTES].astype(np.uint64) + np.uint64(1)) * up[: min(_BYTES, len(raw) - at)])))
        a, b = np.searchsorted(end, at, "right"), np.searchsorted(start, at + _BYTES, "left")
        s, e = np.clip(start[a:b] - at, 0, len(sums) - 1), np.clip(end[a:b] - at, 0, len(sums) - 1)
        hashes[a:b] += (sums[e] - sums[s]) * down[s]
    return raw, start, end, _mixed(hashes)


def text_parts(text: bytes, size: int = _BYTES // 4) -> Iterator[bytes]:
    """A long text in parts that end after a window's last word; the next begins with the word that the next window begins with."""
    at, reach = 0, size
    while len(text) - at > reach:
        part = text[at : at + reach]
        _, start, end = word_places(part)
        n = (int(np.searchsorted(end, len(part), "left")) - WINDOW) // STRIDE + 1
        if n < 1:
            reach *= 2
            continue
        yield part[: end[(n - 1) * STRIDE + WINDOW - 1]]
        at, reach = at + int(start[n * STRIDE]), size
    yield text[at:]


class BiGru:
    """Parameters and their use; ``p`` maps names to arrays."""

    def __init__(self, units: int = 8, width: int = 16, word_slots: int = 1 << 14, gram_slots: int = 1 << 15, seed: int = 5, epochs: int = 4, fit_rows: int = 2400, fit_chars: int = 20_000, fit_total: int = 3_000_000, batch: int = 64, rate: float = 0.02, input_rate: float = 0.1):
        self.units, self.width, self.word_slots, self.gram_slots, self.seed = units, width, word_slots, gram_slots, seed
        self.epochs, self.fit_rows, self.fit_chars, self.fit_total, self.batch, self.rate = epochs, fit_rows, fit_chars, fit_total, batch, rate
        self.input_rate = input_rate
        r, h, w = np.random.default_rng(seed), units, width
        small = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {"word": (r.standard_normal((word_slots, w)) * 0.05).astype(np.float32), "gram": (r.standard_normal((gram_slots, w)) * 0.1).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": 2 * small(w, 3 * h), f"U{d}": small(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": 2 * small(2 * h, 1), "out": 3 * small(2 * h, 1), "bias": np.full(1, -2, np.float32)}
        self.calibration: np.ndarray | None = None
        self.prior = 0.0

    # words to vectors ----------------------------------------------------------------------------------------------
    def grams(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the character n-grams of words, and where each word's begin."""
        size = end - start + 2
        base = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(base[-1]) - np.repeat(base[:-1], size)
        source = np.repeat(start, size) + at - 1
        text = raw[np.clip(source, 0, max(len(raw) - 1, 0))].astype(np.uint64) if len(raw) else np.zeros(0, np.uint64)
        text[at == 0] = 1
        text[base[1:] - 1] = 2
        left = np.repeat(size, size) - at
        owner = np.repeat(np.arange(len(size)), size)
        slots, owners = [], []
        h = np.zeros(len(text), np.uint64)
        for n in range(5):
            h = h * np.uint64(0x100000001B3)
            h[: len(text) - n] += text[n:] + np.uint64(7 * n + 1)
            if n >= 2:
                fits = left > n
                slots.append((_mixed(h[fits]) % np.uint64(self.gram_slots)).astype(np.int64))
                owners.append(owner[fits])
        owner, slot = np.concatenate(owners), np.concatenate(slots)
        order = np.argsort(owner, kind="stable")
        return slot[order], np.searchsorted(owner[order], np.arange(len(size)))

    def vectors(self, word: np.ndarray, slot: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, self.width), np.float32)
        n = np.diff(np.append(first, len(slot)))[:, None].astype(np.float32)
        return self.p["word"][word] + np.add.reduceat(self.p["gram"][slot], first) / n

    def vocabulary(self, raw, start, end, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id of every word, word slot, gram slots, firsts of grams) of the distinct words."""
        _, example, ids = np.unique(hashes, return_index=True, return_inverse=True)
        slot, first = self.grams(raw, start[example], end[example])
        return ids, (hashes[example] % np.uint64(self.word_slots)).astype(np.int64), slot, first

    @staticmethod
    def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of all windows of texts with so many words; a text has one at least."""
        n = np.maximum(1, -(-np.maximum(counts - (WINDOW - STRIDE), 0) // STRIDE))
        text = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        base = np.cumsum(counts) - counts
        return text, base[text] + k * STRIDE, np.clip(counts[text] - k * STRIDE, 0, WINDOW)

    # network -------------------------------------------------------------------------------------------------------
    def _states(self, table: np.ndarray, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each of the steps, time first; ``table`` has the input part of the gates by word id."""
        h, n, lanes = self.units, ids.shape[1], ids.shape[0]
        u, state = self.p[f"U{d}"], np.zeros((lanes, self.units), np.float32)
        out = np.empty((n, lanes, h), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            x, g = table[ids[:, t]], state @ u
            gates = np.tanh(0.5 * (x[:, : 2 * h] + g[:, : 2 * h])) * 0.5 + 0.5
            r, z = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, r, z, new, g[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def logits(self, x: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """``x``: vectors of the distinct words and, last, of padding; ``ids``: windows × WINDOW."""
        both = []
        for d in "fb":
            steps: list | None = [] if keep is not None else None
            both.append(self._states(x @ self.p[f"W{d}"] + self.p[f"b{d}"], ids, d, steps))
            if keep is not None:
                keep[d] = steps
        s = np.concatenate(both, 2)
        a = (s @ self.p["att"])[:, :, 0]
        a = np.where(np.arange(len(a))[:, None] < np.maximum(size, 1), a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tl,tlk->lk", a, s)
        if keep is not None:
            keep |= {"s": s, "a": a, "pooled": pooled}
        return (pooled @ self.p["out"])[:, 0] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted logistic loss; also the gradient of ``x``."""
        keep: dict = {}
        logit = self.logits(x, ids, size, keep)
        h, s, a, pooled = self.units, keep["s"], keep["a"], keep["pooled"]
        dl = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target)).astype(np.float32)
        g = {"out": pooled.T @ dl[:, None], "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * self.p["out"][:, 0]
        da = np.einsum("lk,tlk->tl", dpool, s)
        de = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tl,tlk->k", de, s)[:, None]
        ds = a[:, :, None] * dpool + de[:, :, None] * self.p["att"][:, 0]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, carried = self.p[f"U{d}"], np.zeros((ids.shape[0], h), np.float32)
            du, dt = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            for t, before, r, z, new, gn in reversed(keep[d]):
                total = carried + ds[t, :, k * h : (k + 1) * h]
                dnew = total * (1 - z) * (1 - new * new)
                dr, dz = dnew * gn * r * (1 - r), total * (before - new) * z * (1 - z)
                dg = np.concatenate([dr, dz, dnew * r], 1)
                du += before.T @ dg
                carried = total * z + dg @ u.T
                np.add.at(dt, ids[:, t], np.concatenate([dr, dz, dnew], 1))
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = du, x.T @ dt, dt.sum(0)
            dx += dt @ self.p[f"W{d}"].T
        return g, dx

    # learning ------------------------------------------------------------------------------------------------------
    def _informed(self, slots: int, slot: np.ndarray, text: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """For each slot, in -1 to 1, how far the texts that hold it exceed the share of marked ones, in standard errors."""
        pairs = np.unique(slot * len(labels) + text)
        n = np.bincount(pairs // len(labels), minlength=slots)
        marked = np.bincount(pairs // len(labels), labels[pairs % len(labels)], minlength=slots)
        p = labels.mean()
        z = (marked - n * p) / np.sqrt(n * p * (1 - p) + 1)
        return np.where(np.abs(z) > 2, np.tanh((z - 2 * np.sign(z)) / 3), 0).astype(np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, importance: np.ndarray | None = None) -> BiGru:
        """``importance``: how many rows of all labelled ones each text stands for."""
        importance = np.ones(len(labels)) if importance is None else importance
        self.prior = float(np.average(labels, weights=importance)) if len(labels) else 0.0
        if len(set(labels.tolist())) < 2:
            return self
        data = [t.lower().encode() + b" " for t in texts]
        raw, start, end, hashes = words_of(b"".join(data))
        ids, word, slot, first = self.vocabulary(raw, start, end, hashes)
        ends = np.cumsum([len(t) for t in data])
        counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
        text, at, size = self.windows(counts)
        pad = len(word)
        grid = np.where(np.arange(WINDOW) < size[:, None], np.append(ids, pad)[np.minimum(at[:, None] + np.arange(WINDOW), len(ids))], pad)
        spans = np.searchsorted(text, np.arange(len(texts) + 1))
        gram_n = np.diff(np.append(first, len(slot)))
        del raw, start, end, hashes
        holder = np.repeat(np.arange(len(texts)), counts)
        uses = np.unique(ids * len(texts) + holder)  # each word once a text
        used, holder = uses // len(texts), uses % len(texts)
        self.p["word"][:, 0] += self._informed(self.word_slots, word[used], holder, labels)

        def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = gram_n[words]
            begin = np.cumsum(n) - n
            return np.arange(n.sum()) + np.repeat(first[words] - begin, n), begin

        self.p["gram"][:, 1] += self._informed(self.gram_slots, slot[grams_of(used)[0]], np.repeat(holder, gram_n[used]), labels)
        del uses, used, holder
        r, step, held = np.random.default_rng(self.seed), 0, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        weight = np.where(labels == 1, np.minimum(8.0, 0.5 / max(labels.mean(), 1e-3)), 1.0)
        epochs = max(self.epochs, min(10, -(-140 * self.batch // len(texts))))  # few texts are read more often
        for epoch in range(epochs):
            rate = self.rate * (1 - epoch / epochs) + 5e-4
            order = r.permutation(len(texts))
            for k in range(0, len(order), self.batch):
                some = order[k : k + self.batch]
                rows = np.concatenate([np.arange(spans[i], spans[i + 1]) for i in some])
                used, local = np.unique(grid[rows], return_inverse=True)
                local = local.reshape(-1, WINDOW)
                known = used[used < pad]
                pieces, starts = grams_of(known)
                x = np.zeros((len(used), self.width), np.float32)
                x[: len(known)] = self.vectors(word[known], slot[pieces], starts)
                logit = self.logits(x, local, size[rows])
                owner = np.repeat(np.arange(len(some)), spans[some + 1] - spans[some])
                # at first texts also show other windows than their largest, and words are left out: no window is learnt by heart
                early = 1 - 2 * epoch / epochs
                logit = np.where(r.random(len(some)) < early, 1e3, 0)[owner] * r.random(len(logit)) + logit
                best = np.lexsort((-logit, owner))[np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))]
                # of the words, those of the windows that teach
                seen, shown = np.unique(local[best], return_inverse=True)
                shown = np.where(r.random((len(best), WINDOW)) < 0.2, len(seen), shown.reshape(-1, WINDOW))
                x = np.concatenate([x[seen], np.zeros((1, self.width), np.float32)])
                g, dx = self.gradients(x, shown, size[rows][best], labels[some], weight[some] / len(some))
                known = used[seen[used[seen] < pad]]
                pieces, starts = grams_of(known)
                dx = dx[: len(known)]
                for name, where, part in (("word", word[known], dx), ("gram", slot[pieces], np.repeat(dx / gram_n[known][:, None], gram_n[known], axis=0))):
                    u, inv = np.unique(where, return_inverse=True)
                    total = np.zeros((len(u), self.width), np.float32)
                    np.add.at(total, inv, part)
                    g[name] = (u, total)
                step += 1
                for name, d in g.items():
                    u, d = d if isinstance(d, tuple) else (slice(None), d)
                    m, v = held[name]
                    m[u] = 0.9 * m[u] + 0.1 * d
                    v[u] = 0.99 * v[u] + 0.01 * d * d
                    # inputs move slowly: few marked texts would be learnt by heart
                    self.p[name][u] -= rate * (self.input_rate if name in ("word", "gram") else 1) * (m[u] / (1 - 0.9**step)) / (np.sqrt(v[u] / (1 - 0.99**step)) + 1e-7)
        del held, grid, slot, first, ids
        z = np.column_stack([np.ones(len(texts)), *self.raw_scores([t.lower().encode() for t in texts])])
        w = np.zeros(z.shape[1])
        for _ in range(40):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (importance * q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (importance * (q - labels)) + 0.1 * w)
        self.calibration = w
        return self

    # scoring -------------------------------------------------------------------------------------------------------
    def raw_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(largest logit of the windows, log of their number) of lower-cased texts."""
        best, number = np.full(len(texts), -np.inf), np.zeros(len(texts))
        for piece, owner in self._pieces(texts):
            raw, start, end, hashes = words_of(b" ".join(piece))
            ids, word, slot, first = self.vocabulary(raw, start, end, hashes)
            x = np.concatenate([self.vectors(word, slot, first), np.zeros((1, self.width), np.float32)])
            ends = np.cumsum([len(t) + 1 for t in piece])
            counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
            text, at, size = self.windows(counts)
            ids = np.concatenate([ids, np.full(WINDOW, len(word))])
            for k in range(0, len(text), _LANES):
                part = slice(k, k + _LANES)
                grid = ids[at[part, None] + np.arange(WINDOW)]
                grid[np.arange(WINDOW) >= size[part, None]] = len(word)
                np.maximum.at(best, owner[text[part]], self.logits(x, grid, size[part]))
            np.add.at(number, owner[text], 1)
        return np.clip(best, -30, 30), np.log(number)

    @staticmethod
    def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Groups of texts of at most about _BYTES / 2; longer texts in parts."""
        held, owner, size = [], [], 0
        for k, t in enumerate(texts):
            for part in text_parts(t):
                if size + len(part) > _BYTES // 2 and held:
                    yield held, np.array(owner)
                    held, owner, size = [], [], 0
                held.append(part)
                owner.append(k)
                size += len(part) + 1
        if held:
            yield held, np.array(owner)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.calibration is None or not texts:
            return np.full(len(texts), self.prior)
        logit, number = self.raw_scores(texts)
        w = self.calibration
        return 1 / (1 + np.exp(-np.clip(w[0] + w[1] * logit + w[2] * number, -30, 30)))

    # use -----------------------------------------------------------------------------------------------------------
    def fitted(self, docs: DataFrame, labels: DataFrame, label: str = "toxic") -> BiGru:
        sample = teaching_sample(docs, labels, label, self.fit_rows, self.fit_chars, whole=True, balanced=True)
        size = sample.groupby("label")["text"].transform(lambda t: t.str.len().cumsum())
        kept = sample[size <= sample["label"].map({1: self.fit_total // 4, 0: self.fit_total - self.fit_total // 4})]
        weight = sample.groupby("label")["weight"].sum() / kept.groupby("label")["weight"].sum()
        return self.fit(kept["text"].tolist(), kept["label"].to_numpy(), (kept["weight"] * kept["label"].map(weight)).to_numpy())

    def score(self, docs: DataFrame, *keep: str) -> DataFrame:
        """(doc_id, score) of every row; with names in ``keep``, those columns too."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for b in batches for part in slices(b, "_text")):
                out = model.scores([t.lower().encode() for t in batch.column("_text").to_pylist()])
                columns = {c: batch.column(c) for c in batch.schema.names if c != "_text"} | {"score": pa.array(out, pa.float64())}
                yield pa.RecordBatch.from_pydict(columns)

        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, text_or_empty().alias("_text"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema) + ", score double"
        return rows.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = BiGru().fitted(docs, labels).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more, all columns."""
    digest = F.xxhash64(text_or_empty())
    scored = BiGru().fitted(docs, labels).score(docs.select("doc_id", "text", digest.alias("_hash")), "_hash")
    gone = stored(scored.filter(F.col("score") >= threshold).select("doc_id", "_hash").distinct(), "toxic-decisions")
    return without(docs, gone, digest)
