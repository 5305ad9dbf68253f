"""Log-likelihoods of whole documents under a gated recurrent language model and a unigram base.

Counts of all training words are summed in Spark. The most frequent words (``shortlist``, and the end of a text) have an output
of their own; every other word belongs to one of a fixed number of tail classes, by the last bytes of the word, and is shared out
within it by its count. The output is factored: a softmax over groups, then one within the group, over its words or, in the last
groups, over tail classes. Each
Spark task trains a copy from the same start on its own documents, by truncated backpropagation with the state carried on,
and the copies are averaged by a tree of partial sums. Only model parts of fixed size pass through the driver: counts of words
beyond ``known`` stay in Spark and reach their documents by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import Scratch, U, Words, column, crc_mod, mix, pieces, text_bytes

TAIL = 64
SHORT = 16
GROUPS = SHORT + 4
END = np.iinfo(np.int64).min


def tail_class(words: Words) -> np.ndarray:
    """Class of each word by its last two bytes."""
    last = words.data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    fold = lambda b: np.where((b >= U(65)) & (b <= U(90)), b + U(32), b)
    return (mix(fold(last) << U(8) | fold(before)) % U(TAIL)).astype(np.int64)


def count_words(piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", piece_bytes):
            words = Words(column(table, "text"), lower=True)
            names, first, n = np.unique(words.hashes.astype(np.int64), return_index=True, return_counts=True)
            kinds = tail_class(words)[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(names, END)), pa.array(np.append(kinds, 0).astype(np.int32)), pa.array(np.append(n, table.num_rows))], names=["word", "tail", "n"])

    return run


class Vocabulary:
    """Known words by hash (ascending) with counts; ids 0..S-1 for the shortlist; totals of the tail classes."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, size: int, tail_mass: np.ndarray, total: int, distinct: int):
        self.total, self.distinct, self.tail_mass = total, distinct, tail_mass
        order = np.argsort(known)
        self.words, self.counts = known[order], counts[order]
        self.ids = np.full(len(known), -1)
        self.ids[np.searchsorted(self.words, known[:size])] = np.arange(size)
        self.bits = U(64 - max(1, len(known).bit_length() + 1))
        self.first = np.searchsorted(self.words, (np.arange(1 << int(U(64) - self.bits)).astype(U) << self.bits ^ U(1 << 63)).astype(np.int64))
        self.depth = int(np.diff(np.append(self.first, len(self.words))).max(initial=0))
        self.short_counts = counts[:size]
        # Frequent words first: groups are runs. Equal sums of roots give the least sum of mass times size, the outputs of a word.
        roots = np.cumsum(np.sqrt(self.short_counts + 1.0))
        short = np.minimum((roots / roots[-1] - 1e-9) * SHORT, SHORT - 1).astype(np.int64)
        self.group = np.append(short, SHORT + np.arange(TAIL) * (GROUPS - SHORT) // TAIL)
        self.edges = np.searchsorted(self.group, np.arange(GROUPS + 1))
        self.mass = np.append(self.short_counts + 1.0, np.maximum(tail_mass, 1e-3))

    def look(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Id of each word (shortlist, or shortlist size + tail class) and its count (0 if not among the known)."""
        h = words.hashes.astype(np.int64)
        at = self.first[(words.hashes ^ U(1 << 63)) >> self.bits]  # hashes spread evenly, so few words share their leading bits
        last = len(self.words) - 1
        for _ in range(self.depth):
            at += self.words[np.minimum(at, last)] < h
        np.minimum(at, last, out=at)
        hit = self.words[at] == h
        found = np.where(hit, self.ids[at], -1)
        return np.where(found >= 0, found, len(self.short_counts) + tail_class(words)), np.where(hit, self.counts[at], 0)


def exponents(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """exp of the logits w.T @ h, up to a factor of each column. States lie within -1 and 1, so the weights bound the logits;
    only where they could leave single precision is the maximum taken off first, and exponents then end at -80."""
    e = w.T @ h
    if np.abs(w).sum(0).max(initial=0) > 40:
        e -= e.max(0)
        np.maximum(e, -80, out=e)
    return np.exp(e, out=e)


class Network:
    """Gated recurrent units with a class-factored output; parameters are float32 arrays."""

    def __init__(self, vocabulary: Vocabulary, hidden: int):
        v, rng = vocabulary, np.random.default_rng(1)
        self.v, self.hidden, self.size = v, hidden, len(v.short_counts)
        groups = np.bincount(v.group, weights=v.mass, minlength=GROUPS)
        self.p = {
            "x": rng.normal(0, 0.1, (self.size + TAIL, 3 * hidden)), "u": rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)), "b": np.zeros(3 * hidden),
            "wc": np.zeros((hidden, GROUPS)), "bc": np.log(np.maximum(groups, 1e-3) / groups.sum()), "ww": np.zeros((hidden, len(v.mass))), "bw": np.log(v.mass)}
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    def forward(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, train: bool = True):
        """Hidden states before each token: ids and fresh are (steps, lanes); a fresh token starts a text from zero. The gates
        of each step are kept for training only.

        States come and go as (lanes, units). Within, they and the gates are (units, lanes), so that every slice of gates is
        one run of memory; what is returned are views of that.
        """
        p, H, steps, h = self.p, self.hidden, [], h.T
        outs = np.empty((len(ids), *h.shape), np.float32)
        sign = np.repeat(np.array([-1, 1], np.float32), (2 * H, H))  # the sigmoids take exponents of the negative
        inputs = np.ascontiguousarray(((p["x"] + p["b"]) * sign)[ids].transpose(0, 2, 1))
        keep = (~fresh).astype(np.float32)
        u = np.ascontiguousarray((p["u"] * sign).T)
        g, zr, n = np.empty_like(inputs[0]), np.empty_like(inputs[0][: 2 * H]), np.empty_like(h)
        for t in range(len(ids)):
            if train:
                g, zr, n = np.empty_like(g), np.empty_like(zr), np.empty_like(n)
            h, x = np.multiply(h, keep[t], out=outs[t]), inputs[t]
            np.matmul(u, h, out=g)
            np.add(g[: 2 * H], x[: 2 * H], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:H], zr[H:]
            np.multiply(r, g[2 * H :], out=n)
            n += x[2 * H :]
            np.tanh(n, out=n)
            if train:
                steps.append((h, z, r, n, g[2 * H :]))
            h = h - n
            h *= z
            h += n
        return outs.transpose(0, 2, 1), steps, h.T

    def output(self, h: np.ndarray, ids: np.ndarray, train: bool):
        """Log probability of each id (of its class alone, for a tail class) given states (ids, units); gradients if training."""
        p, v = self.p, self.v
        cls = v.group[ids].astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        cls, ids, h = cls[order], ids[order], np.ascontiguousarray(h[order].T)
        cuts = np.searchsorted(cls, np.arange(GROUPS + 1))
        h1 = np.concatenate([h, np.ones((1, h.shape[1]), np.float32)])  # the last row carries the biases
        w = np.concatenate([p["wc"], p["bc"][None]])
        e = exponents(w, h1)
        s = np.ones(len(e), np.float32) @ e
        out = np.log(e[cls, np.arange(len(cls))] / s)
        grads, dh = {}, None
        if train:
            gw = (h1 / s) @ e.T
            ends = np.flatnonzero(np.append(cls[1:] != cls[:-1], True)) if len(cls) else np.zeros(0, np.int64)
            gw[:, cls[ends]] -= np.add.reduceat(h1, np.append(0, ends[:-1] + 1), axis=1) if len(cls) else 0
            grads = {"wc": gw[:-1], "bc": gw[-1], "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
            dh = (p["wc"] @ e) / s - p["wc"][:, cls]
        w = np.concatenate([p["ww"], p["bw"][None]])
        for k in range(GROUPS):
            i, j = v.edges[k], v.edges[k + 1]
            mine = slice(cuts[k], cuts[k + 1])
            if j - i < 2 or cuts[k] == cuts[k + 1]:
                continue
            hk, which = h1[:, mine], ids[mine] - i
            rows = np.arange(len(which))
            e = exponents(w[:, i:j], hk)
            e /= np.ones(j - i, np.float32) @ e
            out[mine] += np.log(e[which, rows])
            if train:
                e[which, rows] -= 1
                gw = hk @ e.T
                grads["ww"][:, i:j], grads["bw"][i:j] = gw[:-1], gw[-1]
                dh[:, mine] += p["ww"][:, i:j] @ e
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[back], grads, dh.T[back] if train else None

    def backward(self, ids: np.ndarray, fresh: np.ndarray, steps: list, douts: np.ndarray) -> dict:
        """Truncated backpropagation through the steps of one window; douts is (steps, lanes, units)."""
        p, H = self.p, self.hidden
        du, dx = np.zeros_like(p["u"]), np.empty((len(ids), 3 * H, ids.shape[1]), np.float32)
        keep = (~fresh).astype(np.float32)
        dh = np.zeros_like(steps[0][0])
        dg = np.empty_like(dx[0])
        for t in range(len(ids) - 1, -1, -1):
            h, z, r, n, gn = steps[t]
            d = dx[t]
            dn = np.multiply(dh * (1 - z), 1 - n * n, out=d[2 * H :])
            np.multiply(dh * (h - n), z * (1 - z), out=d[:H])
            np.multiply(dn * gn, r * (1 - r), out=d[H : 2 * H])
            dg[: 2 * H] = d[: 2 * H]
            np.multiply(dn, r, out=dg[2 * H :])
            du += h @ dg.T
            dh = dh * z
            dh += p["u"] @ dg
            dh += douts[t].T
            dh *= keep[t]
        flat = np.ascontiguousarray(dx.transpose(0, 2, 1)).reshape(-1, 3 * H)
        full = np.zeros_like(p["x"])
        each = ids.ravel().astype(np.uint16)
        order = np.argsort(each, kind="stable")
        sorted_ = each[order]
        turn = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        full[sorted_[turn]] = np.add.reduceat(flat[order], turn)
        return {"x": full, "u": du, "b": flat.sum(0)}

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, a in self.p.items():
            self.p[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size


class Lanes:
    """Texts of a batch laid one after another into lanes of about equal length; each text ends with the end token."""

    def __init__(self, table: pa.Table, vocabulary: Vocabulary, most: int):
        self.words = words = Words(column(table, "text"), lower=True)
        self.ids, self.counts = vocabulary.look(words)
        self.end = int(vocabulary.ids[np.searchsorted(vocabulary.words, END)])
        sizes = words.counts + 1
        lanes = int(max(1, min(most, len(sizes))))
        order = np.argsort(-sizes, kind="stable")
        load = np.zeros(lanes, np.int64)
        at = np.empty(len(sizes), np.int64)
        lane = np.empty(len(sizes), np.int64)
        for first in range(0, len(order), lanes):  # longest texts first, each round from the emptiest lane on
            some = order[first : first + lanes]
            to = np.argsort(load, kind="stable")[: len(some)]
            lane[some], at[some] = to, load[to]
            load[to] += sizes[some]
        rank = np.empty(lanes, np.int64)
        rank[np.argsort(-load, kind="stable")] = np.arange(lanes)  # longest lanes first, so those still open are the first ones
        lane, self.load = rank[lane], np.sort(load)[::-1]
        self.steps = int(load.max(initial=0))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        value = np.full(len(doc), self.end)
        value[within < words.counts[doc]] = self.ids
        self.grid = np.zeros((self.steps, lanes), np.int32)
        self.doc = np.full((self.steps, lanes), -1, np.int32)
        self.fresh = np.ones((self.steps, lanes), bool)
        where = at[doc] + within, lane[doc]
        self.grid[where], self.doc[where], self.fresh[where] = value, doc, within == 0

    def windows(self, tokens: int) -> Iterator[tuple[slice, int]]:
        """Steps and open lanes of each window; a window has about ``tokens`` tokens and 16 to 256 steps."""
        t = 0
        while t < self.steps:
            open_ = int(np.searchsorted(-self.load, -t, side="left"))
            size = min(256, max(16, tokens // open_))
            yield slice(t, t + size), open_
            t += size


def train_batches(shared, lanes: int, window: int, rate: float, piece_bytes: int):
    """One row for each task: the parameters after its documents, and its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        net.p = {k: a.copy() for k, a in net.p.items()}
        first = {k: np.zeros_like(a) for k, a in net.p.items()}
        second = {k: np.zeros_like(a) for k, a in net.p.items()}
        seen = turn = 0
        for table in pieces(batches, "text", piece_bytes):
            data = Lanes(table, net.v, lanes)
            h = np.zeros((data.grid.shape[1], net.hidden), np.float32)
            for at, m in data.windows(window):
                ids, fresh, real = data.grid[at, :m], data.fresh[at, :m], data.doc[at, :m] >= 0
                outs, steps, h = net.forward(ids, fresh, h[:m])
                _, grads, dh = net.output(outs[real], ids[real], True)
                douts = np.zeros_like(outs)
                douts[real] = dh
                grads |= net.backward(ids, fresh, steps, douts)
                n, turn = int(real.sum()), turn + 1
                seen += n
                for k, g in grads.items():  # Adam
                    g *= np.float32(1 / max(n, 1))
                    first[k] *= np.float32(0.9)
                    first[k] += np.float32(0.1) * g
                    g *= g
                    g *= np.float32(0.02)
                    second[k] *= np.float32(0.98)
                    second[k] += g
                    np.multiply(second[k], np.float32(1 / (1 - 0.98**turn)), out=g)
                    np.sqrt(g, out=g)
                    g += np.float32(1e-6)
                    np.divide(first[k], g, out=g)
                    g *= np.float32(rate / (1 - 0.9**turn))
                    net.p[k] -= g
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([net.packed().astype(np.float32).tobytes()]), pa.array([float(seen)])], names=["parameters", "tokens"])

    return run


def score_batches(shared, lanes: int, window: int, piece_bytes: int):
    """Sums of each text that need no word beyond the known ones, and its other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        v, ln10 = net.v, np.log(10)
        task, turn = TaskContext.get().partitionId(), 0
        for table in pieces(batches, "text", piece_bytes):
            data = Lanes(table, v, lanes)
            rows = table.num_rows
            score = np.zeros(rows)
            h = np.zeros((data.grid.shape[1], net.hidden), np.float32)
            for at, m in data.windows(window):
                ids, doc = data.grid[at, :m], data.doc[at, :m]
                outs, _, h = net.forward(ids, data.fresh[at, :m], h[:m], False)
                real = doc >= 0
                logs, _, _ = net.output(outs[real], ids[real], False)
                score += np.bincount(doc[real], weights=logs, minlength=rows)
            of = np.repeat(np.arange(rows), data.words.counts)
            tail = data.ids - net.size
            in_tail = tail >= 0
            share = np.where(in_tail, np.log10(data.counts + 1.0) - np.log10(v.tail_mass[np.maximum(tail, 0)]), 0)
            score = score / ln10 + np.bincount(of, weights=share, minlength=rows)
            end = v.counts[np.searchsorted(v.words, END)]
            base = np.bincount(of, weights=np.log10(data.counts + 1.0), minlength=rows) + np.log10(end + 1.0)
            known = np.bincount(of, weights=data.counts > 0, minlength=rows).astype(np.int64) + int(end > 0)
            open_ = np.flatnonzero(data.counts == 0)
            names = data.words.hashes[open_].astype(np.int64)
            order = np.lexsort((names, of[open_]))
            names, owner = names[order], of[open_][order]
            new = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1]))) if len(names) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(names)))
            offsets = pa.array(np.searchsorted(owner[new], np.arange(rows + 1)).astype(np.int32))
            key = (np.int64(task) << 33) + turn + np.arange(rows)
            turn += rows
            yield pa.RecordBatch.from_arrays([pa.array(key), column(table, "id"), column(table, "held_out"), pa.array(data.words.counts + 1), pa.array(known), pa.array(base), pa.array(score),
                                              pa.ListArray.from_arrays(offsets, pa.array(names[new])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                                             names=["key", "id", "held_out", "n_tokens", "known", "base", "score", "words", "times"])

    return run


def vocabulary(counts: DataFrame, known: int, shortlist: int) -> Vocabulary:
    """The bounded part of the counts. Ties in frequency go to the smaller hash; the end token is always in the shortlist."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.filter(F.col("word") != END).orderBy(F.desc("n"), "word").limit(known).toPandas()
    end = counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    words, n, tail = np.append(END, top["word"].to_numpy(np.int64)), np.append(end, top["n"].to_numpy(np.int64)), np.append(0, top["tail"].to_numpy(np.int64))
    order = np.argsort(-n, kind="stable")
    size = min(shortlist, len(words))
    rank = np.append(0, order[order > 0])[:size]
    rank = rank[np.argsort(-n[rank], kind="stable")]
    order = np.append(rank, np.setdiff1d(np.arange(len(words)), rank))
    mass = np.ones(TAIL)  # one place for all unseen words of a class
    for row in counts.filter(F.col("word") != END).groupBy("tail").agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[row["tail"]] += row["m"]
    short = rank[rank > 0]
    np.subtract.at(mass, tail[short], n[short] + 1)
    return Vocabulary(words[order], n[order], size, mass, int(totals["n"]), int(totals["v"]))


def score_documents(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", hidden: int = 16, shortlist: int = 2048, known: int = 1 << 16, lanes: int = 256, window: int = 8192, rate: float = 0.01, piece_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: its only token is the end. ``held_out`` is a condition on the rows; those where it does not
    hold are trained on, all of them. Repeated rows count and are scored as often as they come; null ids are kept; other
    columns are not read. Without training rows all counts are 0 and the network keeps its start; an empty table gives none.
    Words are counted by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = base.filter("not held_out").select("text")
    counts = scratch.write(learn.mapInArrow(count_words(piece_bytes), "word long, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")))
    v = vocabulary(counts, known, shortlist)
    net = Network(v, hidden)
    trained = learn.mapInArrow(train_batches(spark.sparkContext.broadcast(net), lanes, window, rate, piece_bytes), "parameters binary, tokens double")
    weighed = trained.rdd.map(lambda r: (np.frombuffer(r[0], np.float32) * np.float64(r[1]), r[1]))
    start = (np.zeros(len(net.packed())), 0.0)
    total, tokens = weighed.treeAggregate(start, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
    if tokens:
        net.load(total / tokens)
    rows = scratch.write(base.mapInArrow(score_batches(spark.sparkContext.broadcast(net), lanes, window, piece_bytes),
                                         "key long, id long, held_out boolean, n_tokens long, known long, base double, score double, words array<long>, times array<int>"))
    rare = rows.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = rare.join(counts.filter(F.col("word") != END).select("word", "n"), "word").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found"))
    out = rows.drop("words", "times").join(sums, "key", "left")
    more, place = F.coalesce("more", F.lit(0.0)), float(np.log10(v.total + v.distinct + 1))
    return out.select(F.col("id").alias(id_column), "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
                      (F.col("base") + more - F.col("n_tokens") * place).alias("base_score"), (F.col("score") + more).alias("score"))
