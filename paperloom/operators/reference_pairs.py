"""Two groups of references of one paper, compared inside a task: only the best of each guess leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs (or members of sets) that are held at once, about; pairs of a bucket that are listed with others, not multiplied on their own; grams of a product.
STEP, FEW, WIDE = 1 << 20, 64, 512
#: Scores that nine digits may not tell apart are nearer than this.
TIE = 2e-9


def _counted(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 0, 1, 1, 1 and 0, 1, 0, 1, 2 for the sizes 2, 3."""
    place = np.repeat(np.arange(len(size)), size)
    return place, np.arange(len(place)) - (np.cumsum(size) - size)[place]


def _slices(size: np.ndarray, most: int = STEP) -> Iterator[slice]:
    """Cuts into pieces whose sizes add up to ``most`` at most, or of one item."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + most, "right")))
        yield slice(at, end)
        at = end


def _found(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` is among the sorted ``codes``, and whether it is there."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


class Sets:
    """A set of numbers for each row, from rows and their members."""

    def __init__(self, row: np.ndarray, member: np.ndarray, rows: int):
        names, member = np.unique(member, return_inverse=True)
        self.width = max(len(names), 1)
        self.codes = np.unique(row * self.width + member)
        row, self.member = np.divmod(self.codes, self.width)
        self.size = np.bincount(row, minlength=rows)
        self.start = np.cumsum(self.size) - self.size

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``rows`` and the member, for each member of these rows."""
        place, step = _counted(self.size[rows])
        return place, self.member[self.start[rows][place] + step]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many members row ``a[k]`` shares with row ``b[k]``."""
        both = np.zeros(len(a), np.int64)
        for s in _slices(self.size[a]):
            place, member = self.of(a[s])
            here = _found(self.codes, b[s][place] * self.width + member)[1]
            both[s] = np.bincount(place[here], minlength=s.stop - s.start)
        return both

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many members each row of ``a`` (down) shares with each row of ``b`` (across)."""
        sides = [(len(rows), *self.of(rows)) for rows in (a, b)]
        common, both = np.intersect1d(sides[0][2], sides[1][2]), np.zeros((len(a), len(b)), np.float32)
        for at in range(0, len(common), WIDE):
            wide, factors = common[at : at + WIDE], []
            for rows, place, member in sides:
                column, here = _found(wide, member)
                factors.append(np.zeros((rows, len(wide)), np.float32))
                factors[-1][place[here], column[here]] = 1
            both += factors[0] @ factors[1].T
        return both


def title_grams(titles: list[str]) -> Sets:
    """The grams of ``similarity.char_grams``; a gram's number is made of its three code points."""
    length = np.fromiter(map(len, titles), np.int64, len(titles))
    row, step = _counted(np.maximum(length, 3))
    signs = np.full(len(row), 0x110000, np.int64)  # no code point: stands after a title of one or two
    signs[step < length[row]] = np.frombuffer("".join(titles).encode("utf-32-le"), "<u4")
    whole = (row[:-2] == row[2:]) & (signs[:-2] < 0x110000)
    return Sets(row[:-2][whole], ((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:])[whole], len(titles))


def _numbered(left: pa.Table, right: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row (those of ``right`` after those of ``left``) and number of each value in a column of lists, and the values by number."""
    lists = [t.column(name).combine_chunks() for t in (left, right)]
    size = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    values = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode("encode")
    return _counted(size)[0], values.indices.to_numpy(zero_copy_only=False).astype(np.int64), values.dictionary


def _pairs(row: np.ndarray, key: np.ndarray, lefts: int, grams: Sets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Left row, right row and common grams, of all pairs that share a key and a gram; a pair may come again with another key."""
    keys, order = int(key.max(initial=-1)) + 1, np.lexsort((row, key))
    row, key = row[order], key[order]
    n, m = (np.bincount(key[side], minlength=keys) for side in (row < lefts, row >= lefts))
    start = np.cumsum(n + m) - n - m  # a key's rows: those of the left, then those of the right
    few = np.flatnonzero((n * m > 0) & (n * m <= FEW))
    for s in _slices((n * m)[few]):
        place, step = _counted((n * m)[few[s]])
        k, total = few[s][place], grams.size.size
        i, j = np.divmod(np.unique(row[start[k] + step // m[k]] * total + row[start[k] + n[k] + step % m[k]]), total)
        both = grams.shared(i, j)
        yield i[both > 0], j[both > 0], both[both > 0]
    for k in np.flatnonzero(n * m > FEW):
        a, b = row[start[k] : start[k] + n[k]], row[start[k] + n[k] : start[k] + n[k] + m[k]]
        for s in _slices(np.full(len(a), len(b))):
            both = grams.crossed(a[s], b)
            i, j = np.nonzero(both)
            yield a[s][i], b[j], both[i, j].astype(np.int64)


def _best(entry: np.ndarray, score: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of each entry's highest score, and of those that may tie with it; of equal scores only the least rank's."""
    order = np.lexsort((rank, -score, entry))
    e, s = entry[order], score[order]
    first = np.diff(e, prepend=-1) != 0
    top = s[first][np.cumsum(first) - 1] if len(e) else s
    return order[(first | (np.diff(s, prepend=np.inf) != 0)) & (s >= top - TIE)]


def compare(accept: float, near: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of guesses' classes (``paper, class, title, lasts, keys, years``) and gold ones (``title, lasts, keys, gold_id, years, ids``): the best
    accepted gold ids of a class, whatever the year (``year`` null), and of each of its years, where that one may be better."""

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        lefts, rows = left.num_rows, left.num_rows + right.num_rows
        if lefts in (0, rows):
            return schema.empty_table()
        grams = title_grams(left.column("title").to_pylist() + right.column("title").to_pylist())
        row, member, _ = _numbered(left, right, "lasts")
        lasts = Sets(row, member, rows)
        weight = np.array([min(1.2 ** (k - 10), 1e5) if k < 100 else 1e5 for k in range(int(grams.size.max()) + 1)])
        row, year, years = _numbered(left, right, "years")
        span, later = max(len(years), 1), row >= lefts
        own = np.bincount(row[~later], minlength=lefts)  # years of each class of guesses
        own_from, own_year = np.cumsum(own) - own, year[~later]
        codes = row[later] * span + year[later]
        by_code = np.argsort(codes)
        codes = codes[by_code]
        # a gold id for each class, then one for each class and year, in the order of the lists
        ids = pa.concat_arrays([right.column("gold_id").combine_chunks(), right.column("ids").combine_chunks().flatten()])
        rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)

        def best(found: list[tuple]) -> tuple:
            entry, score, gold = (np.concatenate(x) for x in zip(*found))
            keep = _best(entry, score, rank[gold])
            return entry[keep], score[keep], gold[keep]

        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        alone, same = [none], [none]  # class, or class and year; score; place of the gold id
        row, key, _ = _numbered(left, right, "keys")
        for i, j, both in _pairs(row, key, lefts, grams):
            a, b = grams.size[i], grams.size[j]
            f = weight[np.minimum(a, b)]
            t = (both / (a + b - both) + f * (both / np.minimum(a, b))) / (1 + f)
            high = t > min(near, accept)
            i, j, t = i[high], j[high], t[high]
            alone.append(best([(i[t > accept], t[t > accept], j[t > accept] - lefts)]))
            common = lasts.shared(i, j)
            union = lasts.size[i] + lasts.size[j] - common
            together = np.where(t > near, np.maximum(t, np.where(union > 0, common / np.maximum(union, 1), 0.0) - 0.01), t)
            high = together > accept
            i, j, together = i[high], j[high], together[high]
            for s in _slices(own[i]):
                place, step = _counted(own[i[s]])
                of = own_year[own_from[i[s]][place] + step]
                at, here = _found(codes, j[s][place] * span + of)
                same.append(best([((i[s][place] * span + of)[here], together[s][place][here], right.num_rows + by_code[at[here]])]))
        alone, same = best(alone), best(same)
        top = np.full(lefts, -np.inf)
        np.maximum.at(top, alone[0], alone[1])
        useful = same[1] >= top[same[0] // span] - TIE
        same = tuple(x[useful] for x in same)
        rows = np.concatenate([alone[0], same[0] // span])
        of_year = pa.array(np.concatenate([np.zeros(len(alone[0]), np.int64), same[0] % span]), mask=np.arange(len(rows)) < len(alone[0]))
        made = {
            "paper": left.column("paper").take(pa.array(rows)), "class": left.column("class").take(pa.array(rows)), "year": years.take(of_year),
            "gold_id": ids.take(pa.array(np.concatenate([alone[2], same[2]]))), "score": pa.array(np.concatenate([alone[1], same[1]])),
        }
        return pa.table(made).select(schema.names).cast(schema)

    return compared
