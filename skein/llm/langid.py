"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows.  A forward and a backward recurrent layer
read each window; every position, that is every byte of every text, gets a language
distribution from both states, and a document's probabilities are the mean over its
positions.  The network is trained in numpy by backpropagation through time, on the
driver, from a bounded sample: ``PER_LANGUAGE`` documents of each language, of each of
which one window is drawn.  The weights, a few thousand numbers, go with the task code.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows
without a language are not learned from; if there is nothing to learn from, every text
is ``und``; ties go to the first language in order; repeated rows each get a row; an empty
table gives no rows; every byte of a text of any length is labelled; other columns are not read,
and ``keep_known`` keeps them all (names that start with __ are an error there).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_thread, refuse, split_batches, text_bytes

HIDDEN, WINDOW, PER_LANGUAGE, STEPS, BATCH, LANES = 8, 96, 1000, 500, 64, 4096
#: Parts of a language in which its sample is drawn first; the most languages that are learned.
SALTS, LANGUAGES = 64, 256
SCORES = "doc_id long, lang_pred string, score double"


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == rest


def sample(docs: DataFrame, eligible: Column, per_language: int = PER_LANGUAGE, window: int = WINDOW) -> tuple[list[str], list[bytes]]:
    """Languages and windows of the training sample: at most ``per_language`` rows a language, by a hash of the id."""
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = (F.xxhash64("doc_id", F.lit(7)), "doc_id")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SALTS))
    start = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    cut = rows.select("lang", "doc_id", F.substring(F.col("text"), start, F.lit(window)).alias("part"))
    # each salt of a language keeps its first rows, then they meet: no task has more than SALTS * per_language rows of one
    some = cut.withColumn("n", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*draw))).where(F.col("n") <= per_language)
    picked = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*draw))).where(F.col("n") <= per_language)
    # of very many values of lang those of most documents are learned: LANGUAGES at the most, so what comes to the driver is bounded
    common = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).select("lang")
    picked = picked.join(F.broadcast(common), "lang", "left_semi").orderBy("lang", "n").collect()
    return [r["lang"] for r in picked], [r["part"].encode()[:window] for r in picked]


class Net:
    """The network: an input table a direction (byte to gate inputs), recurrent weights, and the labelling layer."""

    NAMES = ("E0", "U0", "E1", "U1", "V", "b")

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> None:
        g = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        h, n = hidden, len(languages)
        f = lambda *s, by: (g.standard_normal(s) * by).astype(np.float32)
        self.w = {"E0": f(3 * h, 256, by=0.3), "U0": f(3 * h, h, by=0.3), "E1": f(3 * h, 256, by=0.3), "U1": f(3 * h, h, by=0.3), "V": f(n, 2 * h, by=0.3), "b": np.zeros((n, 1), np.float32)}

    @staticmethod
    def _step(e, u, h, hid):
        """One position of all lanes: gates r and z, candidate n, new state."""
        a = u @ h
        g = e[: 2 * hid] + a[: 2 * hid]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        r, z = g[:hid], g[hid:]
        n = a[2 * hid :] * r
        n += e[2 * hid :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return r, z, n, a[2 * hid :], new

    def states(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (positions, 2 hidden, lanes) of byte lanes x (positions, lanes); a lane's padding leaves its state alone."""
        t, lanes = x.shape
        hid = self.hidden
        out, tape = np.empty((t, 2 * hid, lanes), np.float32), ([None] * t, [None] * t)
        for d, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
            table, u, h = self.w[f"E{d}"], self.w[f"U{d}"], np.zeros((hid, lanes), np.float32)
            for i in order:
                r, z, n, a, new = self._step(np.take(table, x[i], axis=1), u, h, hid)
                if mask is not None:
                    new = np.where(mask[i], new, h)
                if keep:
                    tape[d][i] = (h, r, z, n, a)
                out[i, d * hid : (d + 1) * hid] = h = new
        return out, tape

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Language probabilities (positions, languages, lanes)."""
        p = self.w["V"] @ states
        p += self.w["b"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        hid, (t, lanes) = self.hidden, x.shape
        states, tape = self.states(x, mask, keep=True)
        p = self.positions(states)
        share = (mask / max(1, mask.sum())).astype(np.float32)
        right = p[np.arange(t)[:, None], y[None, :], np.arange(lanes)[None, :]]
        loss = float(-(np.log(right + 1e-9) * share).sum())
        dp = p
        dp[np.arange(t)[:, None], y[None, :], np.arange(lanes)[None, :]] -= 1
        dp *= share[:, None, :]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["V"] = np.einsum("tnl,thl->nh", dp, states, optimize=True)
        g["b"] = dp.sum(axis=(0, 2))[:, None]
        ds = self.w["V"].T @ dp
        for d, order in ((0, range(t - 1, -1, -1)), (1, range(t))):
            u, dh = self.w[f"U{d}"], np.zeros((hid, lanes), np.float32)
            per_byte = np.zeros((256, 3 * hid), np.float32)
            for i in order:
                h, r, z, n, a = tape[d][i]
                dnew = (dh + ds[i, d * hid : (d + 1) * hid]) * mask[i]
                dz = dnew * (h - n) * z * (1 - z)
                dn = dnew * (1 - z) * (1 - n * n)
                dr = dn * a * r * (1 - r)
                gates, back = np.concatenate([dr, dz, dn]), np.concatenate([dr, dz, dn * r])
                dh = np.where(mask[i], dnew * z, dh) + u.T @ back
                g[f"U{d}"] += back @ h.T
                np.add.at(per_byte, x[i], gates.T)
            g[f"E{d}"] = per_byte.T
        return loss, g


def train(languages: list[str], windows: list[bytes], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 1) -> Net:
    """A network fitted by Adam; each batch draws its languages evenly."""
    names = sorted(set(languages))
    net, g = Net(names, seed=seed), np.random.default_rng(seed)
    if len(names) < 2:
        return net
    y = np.array([names.index(x) for x in languages])
    size = max(map(len, windows))
    x, mask = np.zeros((len(windows), size), np.uint8), np.zeros((len(windows), size), bool)
    for i, wnd in enumerate(windows):
        x[i, : len(wnd)], mask[i, : len(wnd)] = np.frombuffer(wnd, np.uint8), True
    of = [np.flatnonzero(y == k) for k in range(len(names))]
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = np.array([g.choice(of[k]) for k in g.integers(0, len(names), batch)])
        _, grad = net.gradients(x[pick].T, mask[pick].T, y[pick])
        norm = np.sqrt(sum(float((d * d).sum()) for d in grad.values()))
        lr = rate * min(1.0, 2 * (1 - s / (steps + 1)))
        for k, d in grad.items():
            d = d * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            net.w[k] -= lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)
    return net


def pooled(net: Net, raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
    """Mean language probabilities (texts, languages) over every byte of each text."""
    size = np.diff(offsets)
    pieces = -(-size // window)
    owner = np.repeat(np.arange(len(size)), pieces)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][owner] + start * window
    length = np.minimum(window, offsets[1:][owner] - start)
    total = np.zeros((len(size), len(net.languages)))
    order = np.argsort(length, kind="stable")  # lanes of like length meet, so full ones need no mask
    steps = np.arange(window)[:, None]
    for a in range(0, len(order), lanes):
        o = order[a : a + lanes]
        t = int(length[o].max())
        at = start[o][None, :] + steps[:t]
        mask = steps[:t] < length[o][None, :]
        full = bool(mask.all())
        x = raw[at if full else np.minimum(at, len(raw) - 1)]
        states, _ = net.states(x, None if full else mask)
        p = net.positions(states)
        if not full:
            p *= mask[:, None, :]
        np.add.at(total, owner[o], p.sum(axis=0).T)
    return total / np.maximum(size, 1)[:, None]


def _label(net: Net | None):
    def run(batches):
        import pyarrow as pa

        one_thread()
        for whole in batches:
            for batch in split_batches(whole):
                raw, off = text_bytes(batch.column("text"))
                letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                if net is None:
                    lang, score = [("und")] * len(letters), np.zeros(len(letters))
                else:
                    p = pooled(net, raw, off)
                    best = p.argmax(axis=1)
                    lang = [net.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, eligible: Column) -> Net | None:
    languages, windows = sample(docs, eligible)
    return train(languages, windows) if languages else None


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_label(net), SCORES)


def _known(net: Net | None, least: float, columns: list[str]):
    def run(batches):
        one_thread()
        for whole in batches:
            for batch in split_batches(whole, column="__text"):
                if net is None:
                    continue
                letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
                p = pooled(net, *text_bytes(batch.column("__text"))).max(axis=1)
                import pyarrow as pa

                yield batch.filter(pa.array(letters & (p >= least))).select(columns)

    return run


def keep_known(docs: DataFrame, net: Net | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text isn't ``und`` and has a language of probability ``least`` or more; all columns kept.

    ``least`` is little over what a text of no language in particular gets, so only such texts go.
    """
    refuse(docs, "__")
    rows = docs.withColumns({"__text": F.col("text").cast("string"), "__letters": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    return rows.mapInArrow(_known(net, least, docs.columns), docs.schema)
