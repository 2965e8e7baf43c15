"""Weighted optimal-string-alignment distance, for batches of labels at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.dims import KEYBOARD_COST, OTHER_COST, VISUAL_COST, Brand, substitution_kinds

OPS = "array<struct<type:string,a:string,b:string,kind:string>>"
NEAREST = "struct<ord:int,distance:double,similarity:double,visual:boolean,swapped:boolean>"
OPS_ARROW = pa.list_(pa.struct([(c, pa.string()) for c in ("type", "a", "b", "kind")]))
ALIGNED = f"struct<distance:double,trace:{OPS}>"


_KINDS = substitution_kinds()
#: Costs are whole numbers of 1/SCALE.
SCALE = 20
TYPES = np.array(["transpose", "match", "sub", "del", "ins"])
KINDS = np.array(["different", "visual", "keyboard", "same"])
SWAP, PAIR, GONE, MORE = range(4)
#: Word-core cells filled at once.
CELLS = 200_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and kind (place in KINDS) of putting one character for another; place 128 stands for any beyond ASCII."""
    cost, kind = np.full((129, 129), OTHER_COST), np.zeros((129, 129), np.uint8)
    for (p, q), name in _KINDS.items():
        cost[ord(p), ord(q)] = VISUAL_COST if name == "visual" else KEYBOARD_COST
        kind[ord(p), ord(q)] = 1 if name == "visual" else 2
    return cost, kind


_COST, _KIND = _tables()


def _spell(words: list[str], width: int) -> np.ndarray:
    """Code points in rows, padded with 0."""
    text = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width).astype(np.int64)


def _by_length(words: list[str], most: int) -> list[np.ndarray]:
    """Places of words in runs of equal length, of at most `most` words."""
    lens = np.array([len(w) for w in words])
    order = np.argsort(lens, kind="stable")
    if not words:
        return []
    cuts = np.flatnonzero(np.diff(lens[order], prepend=-1)).tolist()
    return [order[k : min(k + most, end)] for at, end in zip(cuts, [*cuts[1:], len(order)], strict=True) for k in range(at, end, most)]


class Aligned:
    """Weighted optimal-string-alignment tables of pairs (a, b), the a of one length, one cell of all pairs at a time.

    Cell i, j is the distance of the first i and j characters: insertions and deletions cost 1, substitutions by
    likeness, a swap of neighbours 1. `op` is the last of the cheapest edits to it: a swap comes first, then a pair, a
    deletion, an insertion.
    """

    def __init__(self, a: list[str], b: list[str]) -> None:
        self.n, m = len(a[0]), max(map(len, b))
        self.last = np.array([len(w) for w in b])
        self.x, self.y = x, y = _spell(a, self.n), _spell(b, m)
        p, q = np.minimum(x, 128)[:, :, None], np.minimum(y, 128)[:, None, :]
        same = x[:, :, None] == y[:, None, :]
        self.kind = np.where(same, 3, _KIND[p, q])
        cost = np.where(same, 0.0, _COST[p, q])
        shape = (self.n + 1, m + 1, len(a))
        d, self.op = np.zeros(shape), np.full(shape, MORE, np.uint8)
        d[:, 0] = np.arange(self.n + 1)[:, None]
        d[0] = np.arange(m + 1)[:, None]
        self.op[1:, 0] = GONE
        for i in range(1, self.n + 1):
            for j in range(1, m + 1):
                up, left, pair = d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + cost[:, i - 1, j - 1]
                best = np.minimum(np.minimum(up, left), pair)
                swaps = None
                if i > 1 and j > 1:
                    swaps = same[:, i - 1, j - 2] & same[:, i - 2, j - 1] & ~same[:, i - 1, j - 1]
                    if swaps.any():
                        best = np.where(swaps, np.minimum(best, d[i - 2, j - 2] + 1), best)
                        swaps &= best == d[i - 2, j - 2] + 1
                    else:
                        swaps = None
                op = np.where(best == up, np.uint8(GONE), np.uint8(MORE))
                op[best == pair] = PAIR
                if swaps is not None:
                    op[swaps] = SWAP
                d[i, j], self.op[i, j] = best, op
        self.distance = d[self.n, self.last, np.arange(len(a))]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs have a look-alike, and which a swap, among their edits."""
        visual, swapped = np.zeros(len(self.last), bool), np.zeros(len(self.last), bool)
        live, i, j = np.arange(len(self.last)), np.full(len(self.last), self.n), self.last
        while (more := i + j > 0).any():
            live, i, j = live[more], i[more], j[more]
            op = self.op[i, j, live]
            swap, pair = op == SWAP, op == PAIR
            swapped[live[swap]] = True
            k = np.flatnonzero(pair)
            like = self.kind[live[k], i[k] - 1, j[k] - 1] == 1
            visual[live[k[like]]] = True
            i = i - (op != MORE) - swap
            j = j - (op != GONE) - swap
        return visual, swapped

    def edits(self) -> tuple[np.ndarray, ...]:
        """Of all edits, first to last for each pair: pair, type, code points of a and of b (two columns), kind (-1: none)."""
        i, j = np.full(len(self.last), self.n), self.last.copy()
        found = []
        step = 0
        while (live := np.flatnonzero(i + j)).size:
            at, to = i[live], j[live]
            op = self.op[at, to, live]
            a, b = np.zeros((len(live), 2), np.uint32), np.zeros((len(live), 2), np.uint32)
            kind = np.full(len(live), -1)
            for k in (0, 1):  # a swap has two characters on each side
                x = (op == SWAP) if k else (op != MORE)
                y = (op == SWAP) if k else (op != GONE)
                back = (op == SWAP).astype(np.int64) - k
                a[x, k] = self.x[live[x], at[x] - 1 - back[x]]
                b[y, k] = self.y[live[y], to[y] - 1 - back[y]]
            pair = op == PAIR
            kind[pair] = self.kind[live[pair], at[pair] - 1, to[pair] - 1]
            place = np.select([op == SWAP, pair & (kind == 3), pair, op == GONE], [0, 1, 2, 3], 4)
            found.append((live, np.full(len(live), -step), place, a, b, kind))
            i[live] = at - np.select([op == SWAP, op == MORE], [2, 0], 1)
            j[live] = to - np.select([op == SWAP, op == GONE], [2, 0], 1)
            step += 1
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros((0, 2), np.uint32), np.zeros((0, 2), np.uint32), none
        live, turn, place, a, b, kind = (np.concatenate(c) for c in zip(*found, strict=True))
        o = np.lexsort((turn, live))
        return live[o], place[o], a[o], b[o], kind[o]


class Cores:
    """Words that others are compared with, laid out for whole rows of cells."""

    def __init__(self, cores: list[str]) -> None:
        self.cores, self.sizes = cores, np.array([len(c) for c in cores])
        self.spelt = _spell(cores, int(self.sizes.max())).T  # (place, core)
        # neighbours in all cores, by the two letters turned round: where a swap ends
        j, c = np.nonzero(self.spelt[1:])
        turned = (self.spelt[1:][j, c] << 32) | self.spelt[:-1][j, c]
        o = np.argsort(turned, kind="stable")
        self.turned, self.place, self.core = turned[o], j[o] + 2, c[o]

    def distances(self, words: np.ndarray) -> np.ndarray:
        """Distances, in 1/SCALE, of words of one length (code points in rows) to all cores, exactly.

        The cell of j letters of a core is kept less j insertions, so that a running minimum makes all insertions of a row.
        """
        width, n = len(self.spelt), words.shape[1]
        kind = np.int16 if (n + width) * SCALE < 30_000 else np.int32
        letters, x = np.unique(words, return_inverse=True)
        x = x.reshape(words.shape)
        low = np.minimum(letters, 128)[None, :, None]
        cost = np.rint(_COST[low, np.minimum(self.spelt, 128)[:, None, :]] * SCALE).astype(kind)
        cost[letters[None, :, None] == self.spelt[:, None, :]] = 0
        cost -= SCALE
        row = np.zeros((width + 1, len(words), len(self.cores)), kind)
        before = row
        for i in range(n):
            new = row + kind(SCALE)
            pair = np.take(cost, x[:, i], axis=1)
            pair += row[:-1]
            np.minimum(new[1:], pair, out=new[1:])
            if i:
                met = (words[:, i - 1] << 32) | words[:, i]
                first = np.searchsorted(self.turned, met)
                count = np.searchsorted(self.turned, met, "right") - first
                if count.any():
                    w = np.repeat(np.arange(len(words)), count)
                    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(w))
                    j, c = self.place[at], self.core[at]
                    new[j, w, c] = np.minimum(new[j, w, c], before[j - 2, w, c] - SCALE)
            np.minimum.accumulate(new, axis=0, out=new)
            before, row = row, new
        cores = np.arange(len(self.cores))
        return row[self.sizes, :, cores].T.astype(np.int32) + self.sizes * SCALE


def nearest(words: list[str], cores: list[str]) -> dict[str, np.ndarray]:
    """The most similar core of each word: its index (ord), distance, similarity, and how the edits look.

    The first of equally similar cores wins; index -1 (and distance NaN) where no core has anything in common.
    """
    sizes = np.array([max(1, len(c)) for c in cores])
    out = {
        "ord": np.full(len(words), -1), "distance": np.full(len(words), np.nan), "similarity": np.zeros(len(words)),
        "visual": np.zeros(len(words), bool), "swapped": np.zeros(len(words), bool),
    }
    if not cores:
        return out
    laid = Cores(cores)
    word, core = [], []
    for run in _by_length(words, max(1, CELLS // (len(cores) * (int(sizes.max()) + 1)))):
        some = [words[k] for k in run]
        if n := len(some[0]):
            likely = 1 - laid.distances(_spell(some, n)) / SCALE / np.maximum(n, sizes)
            # whole numbers leave ties as they are: those are settled by the same sums as single pairs have
            at, c = np.nonzero((likely >= likely.max(1)[:, None] - 1e-9) & (likely > 0))
            word.append(run[at])
            core.append(c)
    if not word:
        return out
    word, core = np.concatenate(word), np.concatenate(core)
    spelt = [words[k] for k in word]
    for run in _by_length(spelt, 4000):
        pairs = Aligned([spelt[k] for k in run], [cores[c] for c in core[run]])
        visual, swapped = pairs.marks()
        w, c = word[run], core[run]
        sim = np.maximum(0.0, 1 - pairs.distance / np.maximum(pairs.n, sizes[c]))
        o = np.lexsort((c, -sim, w))
        first = o[np.flatnonzero(np.diff(w[o], prepend=-1))]
        for name, x in zip(out, (c, pairs.distance, sim, visual, swapped), strict=True):
            out[name][w[first]] = x[first]
    return out


def _struct(found: dict[str, np.ndarray], places: np.ndarray, back: np.ndarray) -> pa.Array:
    columns = [pa.array(np.append(places, -1)[found["ord"]][back], pa.int32()), pa.array(found["distance"][back], from_pandas=True)]
    columns += [pa.array(found[k][back]) for k in ("similarity", "visual", "swapped")]
    return pa.StructArray.from_arrays(columns, ["ord", "distance", "similarity", "visual", "swapped"])


def nearest_brand(label: Column, brands: list[Brand]) -> Column:
    """struct(ord, distance, similarity, visual, swapped): the brand, by place in the list, nearest to a label."""
    held = [(k, b.core) for k, b in enumerate(brands) if len(b.core) >= 4]
    places, cores = np.array([k for k, _ in held], np.int64), [c for _, c in held]

    @F.arrow_udf(NEAREST)
    def run(s: pa.Array) -> pa.Array:
        names = s.fill_null("").dictionary_encode()
        return _struct(nearest(names.dictionary.to_pylist(), cores), places, names.indices.to_numpy())

    return run(label)


def nearest_learned(label: Column, cores: Column) -> Column:
    """The same struct for cores that each row has itself (array of strings): ord is the place in the row's array."""

    @F.arrow_udf(NEAREST)
    def run(s: pa.Array, lists: pa.Array) -> pa.Array:
        rows: dict[tuple, list[int]] = {}
        for k, some in enumerate(lists.to_pylist()):
            rows.setdefault(tuple(some or ()), []).append(k)
        labels = s.fill_null("").to_pylist()
        parts = []
        for some, at in rows.items():
            held = [(k, c) for k, c in enumerate(some) if len(c) >= 4]
            found = nearest([labels[k] for k in at], [c for _, c in held])
            parts.append(_struct(found, np.array([k for k, _ in held], np.int64), np.arange(len(at))))
        back = np.argsort(np.concatenate([np.array(at) for at in rows.values()]))
        return pa.concat_arrays(parts).take(pa.array(back))

    return run(label, cores)


def _texts(codes: np.ndarray) -> pa.Array:
    """Strings of one or two code points; null for none."""
    text = pa.array(np.ascontiguousarray(codes).view("<U2").ravel())
    return pc.if_else(pa.array(codes[:, 0] > 0), text, pa.scalar(None, pa.string()))


def alignments(a: list[str], b: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Distances of pairs and their edits as an Arrow list array."""
    distance = np.zeros(len(a))
    parts = []
    for run in _by_length(a, 2000):
        pairs = Aligned([a[k] for k in run], [b[k] for k in run])
        distance[run] = pairs.distance
        at, *edits = pairs.edits()
        parts.append((run[at], *edits))
    if not parts:
        return distance, pa.array([], OPS_ARROW)
    at, place, x, y, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
    o = np.argsort(at, kind="stable")
    kinds = pc.if_else(pa.array(kind[o] >= 0), pa.array(KINDS[kind[o]]), pa.scalar(None, pa.string()))
    ops = pa.StructArray.from_arrays([pa.array(TYPES[place[o]]), _texts(x[o]), _texts(y[o]), kinds], ["type", "a", "b", "kind"])
    ends = np.cumsum(np.bincount(at, minlength=len(a)))
    return distance, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), ops)


def align(a: Column, b: Column) -> Column:
    """struct(distance, trace) of two strings; null if either is. Different pairs of a batch are aligned once."""

    @F.arrow_udf(ALIGNED)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        known = pc.and_(x.is_valid(), y.is_valid())
        both = pa.table({"x": x.filter(known), "y": y.filter(known)})
        different = both.group_by(["x", "y"], use_threads=False).aggregate([])
        distance, edits = alignments(different["x"].to_pylist(), different["y"].to_pylist())
        place = {pair: k for k, pair in enumerate(zip(different["x"].to_pylist(), different["y"].to_pylist(), strict=True))}
        at = iter([place[pair] for pair in zip(both["x"].to_pylist(), both["y"].to_pylist(), strict=True)])
        back = pa.array([next(at) if k else None for k in known.to_pylist()], pa.int64())
        return pa.StructArray.from_arrays([pa.array(distance).take(back), edits.take(back)], ["distance", "trace"])

    return run(a, b)


def weighted_distance(a: Column, b: Column) -> Column:
    return align(a, b)["distance"]


def substitution_cost(a: Column, b: Column) -> Column:
    """The cost of one character for another, by built-in expressions."""
    pairs = F.create_map(*[F.lit(x) for item in sorted(_KINDS.items()) for x in item])
    kind = F.try_element_at(pairs, F.concat(a, b))
    return (
        F.when(a == b, F.lit(0.0))
        .when(kind == "visual", F.lit(VISUAL_COST))
        .when(kind == "keyboard", F.lit(KEYBOARD_COST))
        .otherwise(F.lit(OTHER_COST))
    )


def substitution_kind(a: Column, b: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in sorted(_KINDS.items()) for x in item])
    return F.when(a == b, F.lit("same")).otherwise(F.coalesce(F.try_element_at(pairs, F.concat(a, b)), F.lit("different")))
