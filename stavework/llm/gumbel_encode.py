"""SentencePiece encoding by sampling: Gumbel top-k without replacement over the unigram lattice, and decoding.

A segmentation of a text is drawn with a probability in proportion to exp(alpha * its score). Its perturbed score is its log
probability plus Gumbel noise; the k best perturbed scores are a sample of k distinct segmentations without replacement.
They are found best first, as A* does, with the exact maximum of a set of segmentations as its bound. Sets are
"follow a path found so far up to its i-th piece, then leave it": the maximum over such a set is a Gumbel variable at
the log of the set's probability, cut off at the bound of the set it was split from. The queue begins with the set of
all segmentations; the set with the highest bound gives the next segmentation and is split along it.
All texts of a batch are walked together in numpy. Noise comes from a counter-based generator keyed by the row's key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, file_bytes, mix64, releasing, text_chunks, uniform
from .lattice import MARK, Vocabulary

#: Arcs that a worker remembers: beyond them it forgets all units but those met in most batches, at most half of the store, before it
#: learns more. It bounds memory, not results.
STORE = 2_500_000
_WALK, _SETS, _REST, _CHOICE = 1, 2, 3, 4


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Lattices:
    """Lattices of units with arcs' probabilities given their start node."""

    def __init__(self, model: bytes, alpha: float, store: int = STORE) -> None:
        self.vocabulary, self.alpha, self.store = Vocabulary(model), alpha, store
        self.base: dict[str, int] = {}
        self.n_nodes = self.n_arcs = 0
        # of nodes (length and batches met are those of the unit that starts there)
        self.arrays = {k: np.zeros(1 << 16, t) for k, t in (("head", np.int32), ("degree", np.int16), ("length", np.int32), ("met", np.int32))}
        # of arcs
        self.arrays |= {k: np.zeros(1 << 16, t) for k, t in (("target", np.int32), ("logp", np.float64), ("leave", np.float32), ("cum", np.float32), ("id", np.int32), ("source", np.int32))}

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        a = self.arrays[name]
        if at + len(values) > len(a):
            a = self.arrays[name] = np.concatenate([a[:at], np.zeros(at // 2 + 2 * len(values), a.dtype)])
        a[at : at + len(values)] = values

    def add(self, units: list[str]) -> np.ndarray:
        """Learns distinct units and returns their start nodes."""
        a = self.vocabulary.arcs(units, automaton=False)
        first, size = a["first"], a["size"]
        left = np.repeat(first + size, size + 1)[a["start"]] - a["start"]
        order = np.argsort(((left * (int((size + 1).sum()) + 1) + a["start"]) << 5) + np.minimum(a["end"] - a["start"], 31))
        start, end, left = a["start"][order], a["end"][order], left[order]
        gain = self.alpha * self.vocabulary.arc_scores(a["id"][order])
        rest = np.zeros(int((size + 1).sum()) + 1)  # log of the summed weight from a node to the end of its unit
        cuts = np.flatnonzero(np.diff(left)) + 1
        logp = np.empty(len(start))
        for lo, hi in zip([0, *cuts], [*cuts, len(start)], strict=True) if len(start) else ():
            v = gain[lo:hi] + rest[end[lo:hi]]
            heads = np.flatnonzero(np.r_[True, np.diff(start[lo:hi]) != 0])
            width = np.diff(np.r_[heads, hi - lo])
            top = np.maximum.reduceat(v, heads)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, width)), heads))
            rest[start[lo:hi][heads]] = total
            logp[lo:hi] = v - np.repeat(total, width)
        ids = a["id"][order]
        ids = np.where((ids < 0) & (ids >= -128), self.vocabulary.byte_id[np.clip(-1 - ids, 0, 127)], ids)
        nodes = int((size + 1).sum())
        # arcs of a node lie together
        heads = np.flatnonzero(np.r_[True, np.diff(start) != 0]) if len(start) else np.zeros(0, np.int64)
        width = np.diff(np.r_[heads, len(start)])
        degree, head = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        degree[start[heads]], head[start[heads]] = width, heads
        p = np.exp(logp)
        cum = np.cumsum(p)
        cum -= np.repeat(cum[heads] - p[heads], width)
        # log of the probability to leave by another arc; of an arc likelier than all others together, their sum
        leave = np.log(-np.expm1(np.minimum(logp, -1e-300)))
        likely = np.flatnonzero(logp > -0.5)
        if len(likely):
            node = np.searchsorted(heads, likely, "right") - 1
            wide = width[node] > 1
            leave[likely[~wide]] = -np.inf
            likely, node = likely[wide], node[wide]
            size = width[node]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(heads[node], size)
            others = np.where(at == np.repeat(likely, size), -np.inf, logp[at])
            begins = np.cumsum(size) - size
            if len(begins):
                second = np.maximum.reduceat(others, begins)
                leave[likely] = second + np.log(np.add.reduceat(np.exp(others - np.repeat(second, size)), begins))
        self._put("head", self.n_nodes, head + self.n_arcs)
        self._put("degree", self.n_nodes, degree)
        length = np.zeros(nodes, np.int64)
        length[first] = a["size"]
        self._put("length", self.n_nodes, length)
        self._put("met", self.n_nodes, np.zeros(nodes, np.int64))
        self._put("target", self.n_arcs, end + self.n_nodes)
        self._put("source", self.n_arcs, start + self.n_nodes)
        for name, values in (("logp", np.minimum(logp, 0)), ("leave", np.minimum(leave, 0)), ("cum", cum), ("id", ids)):
            self._put(name, self.n_arcs, values)
        first = first + self.n_nodes
        self.base.update(zip(units, first.tolist(), strict=True))
        self.n_nodes += nodes
        self.n_arcs += len(start)
        return first

    def nodes_of(self, units: list[str]) -> np.ndarray:
        """The start node of each of a batch's distinct units; those not yet known are learned."""
        at = self._look(units)
        missing = np.flatnonzero(at < 0)
        if len(missing) and self.n_arcs > self.store:
            self.forget()
            at = self._look(units)
            missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            at[missing] = self.add(new)
        self.arrays["met"][at] += 1
        return at

    def _look(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.base.get, units, repeat(-1)), np.int64, len(units))

    def forget(self) -> None:
        """Keeps the units met in most batches, in two at least, as far as half of the store holds their arcs."""
        a, units = self.arrays, list(self.base)
        first = self._look(units)
        arcs = np.add.reduceat(a["degree"][: self.n_nodes], first, dtype=np.int64)
        often = np.argsort(-a["met"][first], kind="stable")
        often = often[(np.cumsum(arcs[often]) <= self.store // 2) & (a["met"][first[often]] > 1)]
        often.sort()
        nodes = _spans(first[often], a["length"][first[often]] + 1)
        degree = a["degree"][nodes].astype(np.int64)
        kept = _spans(a["head"][nodes].astype(np.int64), degree)
        place = np.zeros(self.n_nodes, np.int32)
        place[nodes] = np.arange(len(nodes))
        for name in ("logp", "leave", "cum", "id"):
            a[name][: len(kept)] = a[name][kept]
        for name in ("target", "source"):
            a[name][: len(kept)] = place[a[name][kept]]
        for name in ("degree", "length"):
            a[name][: len(nodes)] = a[name][nodes]
        a["head"][: len(nodes)] = np.cumsum(degree) - degree
        a["met"][: len(nodes)] = a["met"][nodes] // 2
        self.base = dict(zip([units[i] for i in often.tolist()], place[first[often]].tolist(), strict=True))
        self.n_nodes, self.n_arcs = len(nodes), len(kept)

    def rest(self) -> None:
        """Keeps no more than half of the store, in arrays of its size: what a worker holds while it has no task."""
        if self.n_arcs > self.store // 2:
            self.forget()
        for name, a in self.arrays.items():
            used = self.n_nodes if name in ("head", "degree", "length", "met") else self.n_arcs
            self.arrays[name] = a[: max(used, 1)].copy()

    def walk(self, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to the end of its unit by random arcs: the arcs in order, and the row that each belongs to.

        seed: the noise of each row's text; place: the character position of its node in that text.
        """
        head, degree, target, cum = (self.arrays[k] for k in ("head", "degree", "target", "cum"))
        turn = np.uint64(0x9E3779B97F4A7C15)
        rows, at, key = np.arange(len(node)), node, seed + (place - node).astype(np.uint64) * turn
        count = np.zeros(len(node), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            wide = degree[at]
            live = np.flatnonzero(wide)
            if len(live) < len(rows):
                rows, at, key, wide = rows[live], at[live], key[live], wide[live]
            if not len(rows):
                break
            u = uniform(key + at.astype(np.uint64) * turn)
            arc = head[at].astype(np.int64)
            more = np.flatnonzero((u > cum[arc]) & (wide > 1))
            noise, place_, last = u[more], arc[more], arc[more] + wide[more] - 1
            while len(more):
                place_ += 1
                on = (noise > cum[place_]) & (place_ < last)
                arc[more] = place_
                more, noise, place_, last = more[on], noise[on], place_[on], last[on]
            steps.append((rows, arc))
            count[rows] = len(steps)
            at = target[arc].astype(np.int64)
        offset = np.cumsum(count) - count
        arcs = np.empty(int(count.sum()), np.int64)
        for i, (r, arc) in enumerate(steps):
            arcs[offset[r] + i] = arc
        return arcs, np.repeat(np.arange(len(node)), count)


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at location, given that they don't exceed bound; -inf where the location is."""
    with np.errstate(divide="ignore"):
        return np.minimum(-np.logaddexp(-bound, np.log(-np.log(u)) - location), bound)


class _Path:
    """The pieces of one segmentation of one text, and the bounds of the sets that leave it at each piece."""

    __slots__ = ("arcs", "bound", "logs", "spent", "units")

    def __init__(self, arcs: np.ndarray, units: np.ndarray, logs: np.ndarray, bound: np.ndarray) -> None:
        self.arcs, self.units, self.logs, self.bound = arcs, units, logs, bound
        self.spent: dict[int, list[int]] = {}


def sample_texts(texts: list[str | None], keys: np.ndarray, lattices: Lattices, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k segmentations in descending perturbed score: (arcs, log probability, perturbed score,
    log inclusion score), fewer where the lattice has fewer paths. keys: uint64 for each text."""
    codes, units, per_text = lattices.vocabulary.coded_units(texts)
    text_end = np.cumsum(per_text)
    base = lattices.nodes_of(units)[codes]
    chars = lattices.arrays["length"][base].astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    place = np.cumsum(chars) - chars
    place -= np.repeat(place[(text_end - per_text)[per_text > 0]], per_text[per_text > 0])
    logp, target, degree = lattices.arrays["logp"], lattices.arrays["target"], lattices.arrays["degree"]
    seeds = mix64(keys)
    root = -np.log(-np.log(uniform(seeds)))

    def noise(stream: int, turn: int) -> np.ndarray:
        return mix64(seeds + np.uint64((stream * 0xD1B54A32D192ED03 + turn * 0x8CB92BA72F3D8DD7) % 2**64))

    def bounds(arcs: np.ndarray, before: np.ndarray, cap: np.ndarray, seed: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return _truncated(before + lattices.arrays["leave"][arcs], cap, uniform(seed + spot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    arcs, unit = lattices.walk(base, noise(_WALK, 0)[text_of], place)
    text = text_of[unit]
    count = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(count)
    sums = np.cumsum(logp[arcs], dtype=np.float64)
    start = np.repeat(np.where(ends > count, np.r_[0.0, sums][ends - count], 0.0), count)
    before = sums - logp[arcs] - start
    spot = np.arange(len(arcs)) - np.repeat(ends - count, count)
    bound = bounds(arcs, before, root[text], noise(_SETS, 0)[text], spot)
    paths = [[_Path(arcs[e - c : e], unit[e - c : e], logp[arcs[e - c : e]], bound[e - c : e])] for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
    scores = [[float(g)] for g in root]
    kappa = np.full(len(texts), -np.inf)

    def best(own: list[_Path]) -> tuple[float, _Path | None, int]:
        top, path, i = -np.inf, None, -1
        for p in own:
            if len(p.bound) and p.bound[j := int(p.bound.argmax())] > top:
                top, path, i = float(p.bound[j]), p, j
        return top, path, i

    for turn in range(1, k + 1):
        chosen = []
        u_choice, u_rest = uniform(noise(_CHOICE, turn)), uniform(noise(_REST, turn))
        for t, own in enumerate(paths):
            if len(own) < turn:
                continue
            top, path, i = best(own)
            if turn == k:
                kappa[t] = top
            elif path is not None:
                node = lattices.arrays["source"][path.arcs[i]]
                head = int(lattices.arrays["head"][node])
                spent = path.spent.setdefault(i, [int(path.arcs[i])])
                options = np.array([x for x in range(head, head + int(degree[node])) if x not in spent])
                p = np.exp(logp[options] - logp[options].max())
                j = min(int((p.cumsum() < u_choice[t] * p.sum()).sum()), len(options) - 1)
                pick = int(options[j])
                spent.append(pick)
                prefix = float(path.logs[:i].sum(dtype=np.float64))
                others = logp[np.delete(options, j)]
                rest = others.max() + np.log(np.exp(others - others.max()).sum()) if len(others) else -np.inf
                path.bound[i] = _truncated(np.float64(prefix + rest), np.float64(top), u_rest[t])
                chosen.append((t, path, i, pick, top, prefix))
        if not chosen:
            break
        nodes, seeds_of, places, unit_of, sizes = [], [], [], [], []
        walk_seed, set_seed = noise(_WALK, turn), noise(_SETS, turn)
        for t, path, i, pick, _, _ in chosen:
            u, end = int(path.units[i]), int(text_end[t])
            nodes += [target[pick : pick + 1], base[u + 1 : end]]
            places += [target[pick : pick + 1] - base[u] + place[u], place[u + 1 : end]]
            unit_of.append(np.arange(u, end))
            sizes.append(end - u)
        owner = np.repeat(np.arange(len(chosen)), sizes)
        which = np.fromiter((c[0] for c in chosen), np.int64, len(chosen))
        arcs, row = lattices.walk(np.concatenate(nodes), walk_seed[which][owner], np.concatenate(places))
        whose, unit = owner[row], np.concatenate(unit_of)[row]
        count = np.bincount(whose, minlength=len(chosen))
        ends = np.cumsum(count)
        sums = np.cumsum(logp[arcs], dtype=np.float64)
        start = np.repeat(np.r_[0.0, sums][ends - count], count)
        ahead = np.array([c[5] + float(logp[c[3]]) for c in chosen])
        before = sums - logp[arcs] - start + ahead[whose]
        spot = np.arange(len(arcs)) - np.repeat(ends - count, count) + 1
        bound = bounds(arcs, before, np.array([c[4] for c in chosen])[whose], set_seed[which][whose], spot)
        for (t, path, i, pick, top, _), e, c in zip(chosen, ends.tolist(), count.tolist(), strict=True):
            new = np.concatenate([path.arcs[:i], [pick], arcs[e - c : e]])
            paths[t].append(_Path(new, np.concatenate([path.units[: i + 1], unit[e - c : e]]), logp[new], np.concatenate([np.full(i + 1, -np.inf), bound[e - c : e]])))
            scores[t].append(top)
    out = []
    for own, g, least in zip(paths, scores, kappa, strict=True):
        logs = [float(p.logs.sum(dtype=np.float64)) for p in own]
        with np.errstate(over="ignore", divide="ignore"):
            include = [_log_inclusion(x - least) for x in logs]
        out.append([(p.arcs, x, s, w) for p, x, s, w in zip(own, logs, g, include, strict=True)])
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))): x is a segmentation's log probability less the (k+1)-th perturbed score."""
    if x < -30:
        return float(x)
    return 0.0 if x > 5 else float(np.log(-np.expm1(-np.exp(x))))


def token_ids(lattices: Lattices, arcs: np.ndarray) -> np.ndarray:
    """Piece ids of arcs; a character without a piece becomes the ids of its UTF-8 bytes."""
    ids = lattices.arrays["id"][arcs]
    if not len(ids) or ids.min() >= 0:
        return ids
    out: list[int] = []
    for i in ids.tolist():
        out.extend([i] if i >= 0 else lattices.vocabulary.byte_id[list(chr(-1 - i).encode("utf-8", "replace"))].tolist())
    return np.array(out, np.int64)


_lattices: dict[tuple[int, float, int], Lattices] = {}


def sample_encode(docs: DataFrame, k: int = 2, alpha: float = 0.0005, seed: int = 17, key: str = "doc_id", text: str = "text", model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", store: int = STORE) -> DataFrame:
    """Up to k distinct segmentations of every text, without replacement.

    Rows: key, sample (0: highest perturbed score), n_tokens, log_prob, perturbed, log_inclusion (log of the probability that
    a segmentation is among the k, given the (k+1)-th perturbed score; 0 where the k are all there are), piece_ids, and of
    the text that the ids are decoded to: decoded_sha256, gives_back (whether it is the text, null being the empty one), and
    n_marks (mark characters in the text; each is decoded to a space, so gives_back is false for these texts only).
    A null or empty text has one segmentation, the empty one. A null key takes a seed of its own; repeated rows get the
    same segmentations. Other columns are neither read nor returned. A text whose lattice has fewer than k
    paths gives all of them. The model file (under 1 MB) is read on the driver and broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = hash(model.value), alpha, store
        lattices = _lattices.get(which) or _lattices.setdefault(which, Lattices(model.value, alpha, store))
        for b in text_chunks(batches, "t", 600_000):
            keys = np.asarray(b.column("s")).astype(np.int64).view(np.uint64)
            texts = [t or "" for t in b.column("t").to_pylist()]
            found = sample_texts(texts, keys, lattices, k)
            flat = [(i, j, *x) for i, own in enumerate(found) for j, x in enumerate(own)]
            ids = [token_ids(lattices, x[2]) for x in flat]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            decoded_texts = lattices.vocabulary.decode_lists(lists)
            marks = [t.count(MARK) for t in texts]
            digests, same = [], []
            for (i, *_), decoded in zip(flat, decoded_texts, strict=True):
                same.append(decoded == texts[i])
                digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            back = [pa.array(digests, pa.string()), pa.array(same, pa.bool_()), pa.array([marks[x[0]] for x in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(pa.array([x[0] for x in flat])), pa.array([x[1] for x in flat], pa.int32()), pa.array(sizes), *(pa.array([x[i] for x in flat], pa.float64()) for i in (3, 4, 5)), lists, *back],
                ["k", "sample", "n_tokens", "log_prob", "perturbed", "log_inclusion", "piece_ids", "decoded_sha256", "gives_back", "n_marks"],
            )
        lattices.rest()

    read = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.lit(seed), F.col(key)).alias("s"))
    out = read.mapInArrow(releasing(run), f"k {key_type}, sample int, n_tokens long, log_prob double, perturbed double, log_inclusion double, piece_ids array<int>, decoded_sha256 string, gives_back boolean, n_marks long")
    return out.withColumnRenamed("k", key)


def decode_ids(ids: Column, model: bytes) -> Column:
    """The text of an array of piece ids (null: null). Encoding and decoding give the text back, but that a
    mark character in it becomes a space."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        vocabulary = _decoders.get(hash(model)) or _decoders.setdefault(hash(model), Vocabulary(model))
        return rows.map(vocabulary.decode, na_action="ignore")

    return run(ids)


_decoders: dict[int, Vocabulary] = {}
