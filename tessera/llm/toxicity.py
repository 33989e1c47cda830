"""Operator 2: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's input is the embedding of its word (words that enough training documents use) plus the mean of embeddings of its
character n-grams (hashed bytes, with marks at both ends), so that inflected and unseen forms are covered. A forward and a backward GRU
read windows of WINDOW words that overlap by half; attention pools a window's states into one logit. A document's score is
that of its highest window: every window of the whole text is read, however long it is. A long run of word characters (a clause of
a script without spaces, words joined by underscores) is read as overlapping pieces, so that all of its n-grams count.

Training sees a bounded sample of labelled documents (MAX_TOXIC and MAX_CLEAN, drawn by a hash of doc_id, MAX_CHARS of each). Words outside the list of
MAX_WORDS count by their n-grams. Labels are given to documents, so
each round trains on the window of a toxic document that the model rates highest and, of clean documents, on the window it
rates highest and a random one. The first round's windows are rated by log-odds of words and n-grams.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, GRAM_BUCKETS = 16, 8, 8192
#: Bounds of the labelled sample that training reads.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2400, 20_000_000
MIN_WORD_DOCS, MAX_WORDS = 4, 20_000
ROUNDS, EPOCHS, BATCH, RATE, SEED = 3, 4, 128, 0.01, 11
#: Steps of a round at least: a small sample is passed over more often.
MIN_STEPS = 120
#: Weight decay of the embeddings.
DECAY = 0.3
THRESHOLD = 0.7
#: Distinct words that a worker remembers before it starts afresh.
WORD_CACHE = 400_000
#: Bytes of the longest run that is one word, of a longer run's pieces, and from one piece's begin to the next one's.
LONG_RUN, PIECE, PIECE_STEP = 64, 24, 12
#: Words that are scored in one pass; a multiple of STRIDE.
PART = 96_000
#: At an end of a piece that is none of its run.
CUT = "\0"
_WORD = re.compile(r"\w+")


def pieces(run: str) -> Iterator[str]:
    """A long run as pieces cut between characters, each of which shares bytes enough with the next for every n-gram to lie in one."""
    data = run.encode("utf-8", "replace")

    def cut(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return min(at, len(data))

    for at in range(0, len(data), PIECE_STEP):
        end = cut(at + PIECE)
        yield CUT * (at > 0) + data[cut(at) : end].decode() + CUT * (end < len(data))
        if end == len(data):
            return


def _long(run: str) -> bool:
    return len(run) > LONG_RUN // 4 and len(run.encode("utf-8", "replace")) > LONG_RUN


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    if max(map(len, words), default=0) > LONG_RUN // 4:
        words = [w for run in words for w in (pieces(run) if _long(run) else (run,))]
    return words


def parts_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lists of bounded length, whose windows are together the windows of the whole text."""
    if len(text or "") <= PART:
        yield words_of(text)
        return
    held: list[str] = []
    for m in _WORD.finditer(text.lower()):
        for word in pieces(m[0]) if _long(m[0]) else (m[0],):
            held.append(word)
            if len(held) == PART + WINDOW:
                yield held[:PART]
                held = held[PART - WINDOW + STRIDE :]
    yield held


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all 3- and 4-grams of bytes of `<word>`, word after word, and where each word's begin."""
    raw = [b"<" * (w[:1] != CUT) + w.strip(CUT).encode("utf-8", "replace") + b">" * (w[-1:] != CUT) for w in words]
    raw = [x if len(x) > 2 else x.ljust(3, b"\0") for x in raw]  # an n-gram never reaches into the next word
    data = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = np.array([len(x) for x in raw])
    begin = np.cumsum(n) - n
    k3, k4 = n - 2, n - 3
    three = data[:-3] * 961 + data[1:-2] * 31 + data[2:-1]
    four = three * 31 + data[3:] * np.uint32(2654435761) + np.uint32(77)
    three, four = (((x * np.uint32(2654435761)) >> np.uint32(15)) % GRAM_BUCKETS for x in (three, four))
    total = k3 + k4
    starts = np.cumsum(total) - total
    word = np.repeat(np.arange(len(words)), total)
    at = np.arange(int(total.sum())) - starts[word]
    is4 = at >= k3[word]
    out = np.where(is4, four[np.minimum(begin[word] + at - k3[word], len(four) - 1)], three[np.minimum(begin[word] + at, len(three) - 1)])
    return out.astype(np.int32), starts


def windows(n: int) -> list[int]:
    """Where the windows of a text of n words begin: every word lies in one, the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes; x is (WINDOW, batch, DIM), mask (WINDOW, batch) with 1 where there is a word. W, U and c hold both
    directions, which run side by side: the backward one on the window in reverse."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        r = lambda fan, *s: rng.standard_normal(s) * 0.3 / np.sqrt(fan)
        self.p = {"grams": rng.standard_normal((GRAM_BUCKETS, DIM)) * 0.02, "att": r(2 * HIDDEN, 2 * HIDDEN), "out": r(2 * HIDDEN, 2 * HIDDEN), "bias": np.full(1, -1.0)}
        self.p |= {"W": 3 * r(DIM, 2, DIM, 3 * HIDDEN), "U": 3 * r(HIDDEN, 2, HIDDEN, 3 * HIDDEN), "c": np.zeros((2, 3 * HIDDEN))}

    def inputs(self, x):
        """Input parts of update, reset and candidate for both directions: (..., 6 HIDDEN)."""
        return np.concatenate([x @ self.p["W"][k] + self.p["c"][k] for k in (0, 1)], axis=-1)

    def _states(self, g, mask, keep: bool):
        """g: (time, batch, 6 HIDDEN). States of both directions (time, batch, 2 HIDDEN), and what the way back needs."""
        steps, b, n = len(g), g.shape[1], HIDDEN
        g = np.stack([g[:, :, : 3 * n], g[::-1, :, 3 * n :]], axis=1)
        m = np.stack([mask, mask[::-1]], axis=1)[..., None]
        h, out, saved, u = np.zeros((2, b, n), g.dtype), np.empty((steps, 2, b, n), g.dtype), [], self.p["U"]
        for t in range(steps):
            hu = h @ u
            zr = _sigmoid(g[t, :, :, : 2 * n] + hu[:, :, : 2 * n])
            z, r = zr[:, :, :n], zr[:, :, n:]
            c = np.tanh(g[t, :, :, 2 * n :] + r * hu[:, :, 2 * n :])
            if keep:
                saved.append((h, z, r, c, hu[:, :, 2 * n :], m[t]))
            h = out[t] = h + m[t] * (c + z * (h - c) - h)
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2), saved

    def _pool(self, hs, mask):
        e = hs @ self.p["att"] + (mask - 1) * 1e4
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        ctx = np.einsum("tb,tbh->bh", a, hs)
        return a, ctx, ctx @ self.p["out"] + self.p["bias"][0]

    def logits(self, g, mask):
        """g: (time, batch, 6 HIDDEN), as of inputs()."""
        return self._pool(self._states(g, mask, False)[0], mask)[2]

    def gradients(self, x, mask, y, weight):
        """Returns loss, gradients of the parameters and of x."""
        p, g, n = self.p, {}, HIDDEN
        hs, saved = self._states(self.inputs(x), mask, True)
        a, ctx, logit = self._pool(hs, mask)
        prob = _sigmoid(logit)
        loss = float(-(weight * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())
        d = weight * (prob - y) / len(y)
        g["out"], g["bias"] = ctx.T @ d, np.array([d.sum()])
        dctx = d[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dctx, hs)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", de, hs)
        dhs = a[:, :, None] * dctx + de[:, :, None] * p["att"]
        dhs = np.stack([dhs[:, :, :n], dhs[::-1, :, n:]], axis=1)
        dg, dhu = np.zeros((*dhs.shape[:3], 3 * n)), np.zeros((*dhs.shape[:3], 3 * n))
        dh, ut = np.zeros(dhs.shape[1:]), p["U"].transpose(0, 2, 1)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, hu, m = saved[t]
            dh = dh + dhs[t]
            dn = dh * m
            dc, dz = dn * (1 - z) * (1 - c * c), dn * (h - c) * z * (1 - z)
            dr = dc * hu * r * (1 - r)
            dhu[t] = np.concatenate([dz, dr, dc * r], axis=2)
            dg[t] = np.concatenate([dz, dr, dc], axis=2)
            dh = dh * (1 - m) + dn * z + dhu[t] @ ut
        before = np.stack([s[0] for s in saved])
        flat = lambda v, k: v[:, k].reshape(-1, v.shape[-1])
        g["U"] = np.stack([flat(before, k).T @ flat(dhu, k) for k in (0, 1)])
        g["c"] = dg.sum(axis=(0, 2))
        both = (dg[:, 0], dg[::-1, 1])
        g["W"] = np.stack([x.reshape(-1, x.shape[-1]).T @ v.reshape(-1, 3 * n) for v in both])
        return loss, g, sum(v @ p["W"][k].T for k, v in enumerate(both))


class ToxicityModel:
    """A network with its word list. constant: the score of every text where there was nothing to learn from."""

    def __init__(self):
        self.net, self.vocabulary, self.constant = Network(), {}, None
        self._start()

    def __getstate__(self):
        return {"net": self.net, "vocabulary": self.vocabulary, "constant": self.constant}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self):
        """Forget remembered words: row numbers and the GRUs' input parts."""
        self.rows, self.parts, self.n = {}, np.zeros((1024, 6 * HIDDEN), self.net.p["att"].dtype), 0

    def embed(self, words: list[str]) -> np.ndarray:
        grams, starts = gram_buckets(words)
        sizes = np.diff(np.append(starts, len(grams)))
        x = np.add.reduceat(self.net.p["grams"][grams], starts, axis=0) / sizes[:, None].astype(self.net.p["grams"].dtype)
        if "words" in self.net.p:
            at = np.array([self.vocabulary.get(w, -1) for w in words])
            x[at >= 0] += self.net.p["words"][at[at >= 0]]
        return x

    def _rows(self, docs: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*docs).difference(self.rows))
        if self.n + len(new) > WORD_CACHE and self.n:
            self._start()
            new = list(set().union(*docs))
        if new:
            part = self.net.inputs(self.embed(new))
            if self.n + len(new) > len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros((max(len(self.parts), len(new)), self.parts.shape[1]), self.parts.dtype)])
            self.parts[self.n : self.n + len(new)] = part
            self.rows |= {w: self.n + i for i, w in enumerate(new)}
            self.n += len(new)
        get = self.rows.__getitem__
        return [np.fromiter(map(get, d), np.int32, len(d)) for d in docs]

    def window_logits(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The logits of every window of each document; one padded window for a short one, also for an empty one."""
        rows = self._rows(docs)
        per_doc, index, mask = [], [], []
        for r in rows:
            begins = windows(len(r))
            per_doc.append(len(begins))
            if len(r) < WINDOW:
                index.append(np.concatenate([r, np.zeros(WINDOW - len(r), np.int32)])[None])
                mask.append((np.arange(WINDOW) < len(r))[None])
            else:
                index.append(r[np.array(begins)[:, None] + np.arange(WINDOW)])
                mask.append(np.ones((len(begins), WINDOW), bool))
        index, mask = np.concatenate(index), np.concatenate(mask).astype(self.parts.dtype)
        out = np.empty(len(index), self.parts.dtype)
        for i in range(0, len(index), 1024):
            out[i : i + 1024] = self.net.logits(self.parts[index[i : i + 1024].T], np.ascontiguousarray(mask[i : i + 1024].T))
        return np.split(out, np.cumsum(per_doc)[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        out, held, n = np.full(len(texts), -np.inf), [], 0

        def flush():
            for (i, _), w in zip(held, self.window_logits([part for _, part in held]), strict=True):
                out[i] = max(out[i], float(w.max()))

        for i, text in enumerate(texts):
            for part in parts_of(text):
                if held and n + len(part) > PART:  # groups of bounded words, also within a very long text
                    flush()
                    held, n = [], 0
                held.append((i, part))
                n += len(part)
        flush()
        return np.round(1 / (1 + np.exp(-out)), 6)


def _log_odds(docs: list[list[str]], y: np.ndarray):
    """How much more documents of label 1 use each word and n-gram; rates the first round's windows."""
    sets = [set(d) for d in docs]
    seen: dict[str, list[int]] = {}
    grams = np.ones((2, GRAM_BUCKETS))
    for s, label in zip(sets, y, strict=True):
        for w in s:
            seen.setdefault(w, [0, 0])[int(label)] += 1
        if s:
            grams[int(label), np.unique(gram_buckets(list(s))[0])] += 1
    n = np.bincount(y.astype(int), minlength=2) + 2
    gram_odds = np.log(grams[1] / n[1]) - np.log(grams[0] / n[0])
    word_odds = {w: np.log((b + 0.5) / n[1]) - np.log((a + 0.5) / n[0]) for w, (a, b) in seen.items() if a + b >= MIN_WORD_DOCS}
    frequent = sorted(word_odds, key=lambda w: (-sum(seen[w]), w))[:MAX_WORDS]
    return word_odds, gram_odds, frequent


class _Words:
    """The distinct words of the training texts as numbers: their n-grams and their rows in the word list."""

    def __init__(self, docs: list[list[str]], model: ToxicityModel):
        self.all = sorted(set().union(*docs)) or ["_"]
        number = {w: i for i, w in enumerate(self.all)}
        self.docs = [np.array([number[w] for w in d], np.int64) for d in docs]
        parts = [gram_buckets(self.all[i : i + 10_000]) for i in range(0, len(self.all), 10_000)]
        self.grams = np.concatenate([g for g, _ in parts])
        self.sizes = np.concatenate([np.diff(np.append(starts, len(g))) for g, starts in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.array([model.vocabulary.get(w, -1) for w in self.all])

    def mean(self, table: np.ndarray) -> np.ndarray:
        """The mean of each word's n-grams in a table of buckets."""
        return (np.add.reduceat(table[self.grams], self.starts, axis=0).T / self.sizes).T


def _summed(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct groups and the sums of their rows, in an order that does not change."""
    order = np.argsort(groups, kind="stable")
    found, starts = np.unique(groups[order], return_index=True)
    return found, np.add.reduceat(values[order], starts, axis=0)


def _filled(tokens: np.ndarray, docs: list[np.ndarray], clean: np.ndarray, rng) -> np.ndarray:
    """A short text's only window; half the time with words of a clean document around it, as windows of long texts have them."""
    if len(tokens) == WINDOW or rng.random() < 0.5:
        return tokens
    other = docs[clean[rng.integers(len(clean))]]
    at = rng.integers(max(1, len(other) - WINDOW + 1))
    other, cut = other[at : at + WINDOW - len(tokens)], rng.integers(WINDOW - len(tokens) + 1)
    return np.concatenate([other[:cut], tokens, other[cut:]])


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = SEED) -> ToxicityModel:
    """A model fitted to labelled texts, in double precision: rounding that differs by machine or threads stays far below what
    decides a window or a prediction. Without examples of both labels the score is constant: the only label's, or 0."""
    model, y = ToxicityModel(), np.array(labels, np.float64)
    if len(set(labels)) < 2:
        model.constant = float(y[0]) if len(y) else 0.0
        return model
    rng, one = np.random.default_rng(seed), {}
    docs = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]
    word_odds, gram_odds, frequent = _log_odds(docs, y)
    model.vocabulary = {w: i for i, w in enumerate(frequent)}
    p = model.net.p
    p["words"] = rng.standard_normal((max(1, len(frequent)), DIM)) * 0.02
    if frequent:  # the first dimension starts from the log-odds, so that a few examples of a word go a long way
        p["words"][:, 0] = [np.clip(word_odds[w], -3, 6) / 3 for w in frequent]
    p["grams"][:, 0] = np.clip(gram_odds, -3, 6) / 3
    words = _Words(docs, model)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    begins, step, clean = [windows(len(d)) for d in docs], 0, np.flatnonzero(y == 0)
    for k in range(rounds):
        if k == 0:
            rate = np.maximum(0, [word_odds.get(w, 0.0) for w in words.all]) + np.maximum(0, words.mean(gram_odds))
            rated = [np.stack([np.sort(rate[d[b : b + WINDOW]])[-3:].sum() for b in bs]) for d, bs in zip(words.docs, begins, strict=True)]
        else:
            rated = []
            for i in range(0, len(docs), 32):
                if i == 0 or model.n > 30_000:
                    model._start()  # the driver's memory stays small
                rated += model.window_logits(docs[i : i + 32])
            model._start()
        best = [int(np.argmax(np.round(x, 4))) for x in rated]  # of windows that differ by rounding only, the first
        picks = [(i, begins[i][b]) for i, b in enumerate(best)] + [(i, begins[i][rng.integers(len(begins[i]))]) for i in range(len(docs)) if y[i] == 0]
        weight1 = max(1.0, 0.4 * sum(y[i] == 0 for i, _ in picks) / max(1.0, y.sum()))
        for _ in range(max(epochs, -(-MIN_STEPS * BATCH // len(picks)))):
            order = rng.permutation(len(picks))
            for at in range(0, len(order), BATCH):
                batch = [picks[j] for j in order[at : at + BATCH]]
                yb = np.array([y[i] for i, _ in batch])
                step += 1
                toks = [_filled(words.docs[i][b : b + WINDOW], words.docs, clean, rng) for i, b in batch]
                _step(model, words, toks, yb, np.where(yb > 0, weight1, 1.0), moments, step, rng)
    model.net.p = {k: v.astype(np.float32) for k, v in p.items()}
    model._start()
    return model


def _step(model: ToxicityModel, words: _Words, toks: list[np.ndarray], y, weight, moments, step: int, rng) -> None:
    """One Adam step. Word embeddings are left out at random, so that n-grams learn what words they stand for."""
    p = model.net.p
    used, place = np.unique(np.concatenate(toks), return_inverse=True)
    if not len(used):
        used = np.zeros(1, np.int64)
    sizes = words.sizes[used]
    at = np.repeat(words.starts[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    grams = words.grams[at]
    table_x = np.add.reduceat(p["grams"][grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    row = np.where(rng.random(len(used)) < 0.3, -1, words.row[used])
    known = row >= 0
    table_x[known] += p["words"][row[known]]
    n = np.array([len(t) for t in toks])
    mask = (np.arange(WINDOW)[:, None] < n).astype(np.float64)
    index = np.zeros((len(toks), WINDOW), np.int64)
    index[mask.T > 0] = place
    _, g, dx = model.net.gradients(table_x[index.T], mask, y, weight)
    dtable = np.zeros_like(table_x)
    if len(place):
        seen, sums = _summed(dx.transpose(1, 0, 2)[mask.T > 0], place)
        dtable[seen] = sums
    for k, (at, sums) in {"grams": _summed(np.repeat(dtable / sizes[:, None], sizes, axis=0), grams), "words": (row[known], dtable[known])}.items():
        g[k] = np.zeros_like(p[k])
        g[k][at] = sums
    shrink = min(1.0, 5 / (float(np.sqrt(sum((v * v).sum() for v in g.values()))) + 1e-9))
    for k, v in g.items():
        m, s = moments[k]
        v *= shrink
        m *= 0.9
        m += 0.1 * v
        s *= 0.999
        s += 0.001 * v * v
        if k in ("grams", "words"):
            p[k][:, 1:] *= 1 - RATE * DECAY
        p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, text, toxic: at most so many labelled texts of each kind outside the held-out third, with at most max_chars characters together for
    each kind, chosen in an order that only doc_id decides; a text over what is left of that bound is passed over.

    Rows without a label or doc_id are not used; a doc_id labelled twice counts as toxic if one label says so; of several texts of
    one doc_id the least one counts.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"))).withColumn("draw", F.xxhash64("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known.join(texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("size")), "doc_id")
    chosen: dict[int, list[int]] = {}
    for toxic, most in ((1, max_toxic), (0, max_clean)):
        left, chosen[toxic] = max_chars, []
        for r in known.filter(F.col("toxic") == toxic).orderBy("draw", "doc_id").limit(most).select("doc_id", "size").collect():  # short rows
            if r["size"] <= left:
                left -= r["size"]
                chosen[toxic].append(r.doc_id)
    found = texts.filter(F.col("doc_id").isin(chosen[1] + chosen[0])).groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.withColumn("toxic", F.col("doc_id").isin(chosen[1]).cast("int"))


def training_sample(docs: DataFrame, labels: DataFrame, **bounds: int) -> tuple[list[str], list[int]]:
    """sample() as lists, by doc_id."""
    rows = sorted(map(tuple, sample(docs, labels, **bounds).collect()))
    return [t for _, t, _ in rows], [y for _, _, y in rows]


def _train(batches):
    rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, t, _ in rows], [y for *_, y in rows]))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> ToxicityModel:
    """A model of the bounded sample, trained in one task, which runs again where its executor is lost; the driver gets the model alone."""
    small_batches(docs.sparkSession)
    made = sample(docs, labels, **bounds).coalesce(1).mapInArrow(_train, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([], [])


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (six decimals) for each row's whole text.

    Null texts are empty ones, which have a score too; repeated rows have the same score, an empty table gives an empty one. A column of docs
    with the name of out_col is replaced; other columns are carried as they are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(out_col, score(F.col(text_col).cast("string")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
