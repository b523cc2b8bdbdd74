"""Windows of units (bytes or words) that repeat anywhere in a corpus, without listing every position.

Every window of ``window`` units has an anchor: the leftmost of its
``anchor``-unit grams with the least hash. Equal windows have equal anchors at
equal offsets, so the suffixes that start at the windows fall into classes by
anchor, and neighbouring starts that share an anchor form one run. About 1.7 %
of byte positions (8 % of word positions) begin a run.

1. Each document is scanned once for its runs: anchor hash, hash of the whole
   run's units (``Equality``), first and last start.
2. Counts by anchor (combined before the shuffle): an anchor seen once can't
   repeat; if all runs of an anchor are the same, all their windows repeat.
3. Counts by (anchor, run) settle the equal runs among the mixed anchors. One
   representative of every distinct run goes on.
4. The units of the representatives are gathered by anchor and resolved
   suffix by suffix. A resolver gets complete anchor groups of a bounded size.
   An anchor with more distinct runs than ``group_limit`` (a passage that a
   large part of the corpus shares) is divided by whole windows instead:
   counts by (anchor, stretch) and (anchor, window hash), again combined
   before the shuffle.

No step gathers the occurrences of an anchor in one task: joins back to the
runs have one large side only, whose hot keys adaptive execution can split.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._shared import dropped, leaning, written

_U = np.uint64
_PIECE = 1 << 20  # starts scanned at once; anchors are local, so pieces change nothing but run ends
_STRETCH = 8  # window starts in a stretch
_POSITION = 24  # low bits of an anchor's rank that hold its position in a piece


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of any range of a value array, from prefix sums modulo 2^64."""

    forward = _powers(_BASE, 1)
    back = _powers(_BASE, 1)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(_Rolling.forward) <= n:
            size = 1 << (n + 1).bit_length()
            _Rolling.forward = _powers(_BASE, size)
            _Rolling.back = _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * _Rolling.forward[:n], out=self.sums[1:])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sums[hi] - self.sums[lo]) * _Rolling.back[lo] + _mix((hi - lo).astype(_U)))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * _Rolling.back[:n])


#: The greatest prime below 2^32.
_PRIME = (1 << 32) - 5


class Equality:
    """Hashes that decide which ranges of units are equal: 128 bits, from the values of four polynomials modulo a prime.

    They are taken at points that are drawn anew for every job and not known
    outside it, so no text can be made to collide: two different ranges of up
    to n units agree in all four with a probability of (n / 2^32)^4.
    """

    tables: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, values: np.ndarray, points: tuple[int, ...]):
        n = len(values)
        known = Equality.tables.get(points, [])
        if not known or len(known[0][0]) <= n:
            size = n + 1 if n >= _PIECE // 2 else 1 << (n + 1).bit_length()
            Equality.tables.clear()
            known = Equality.tables[points] = [tuple(self._powers(p, size) for p in (point, pow(point, -1, _PRIME))) for point in points]
        self.back = [back for _, back in known]
        small = values.astype(_U) % _U(_PRIME - 1) + _U(1)  # never zero, so that lengths count
        self.sums = []
        for forward, _ in known:
            sums = np.zeros(n + 1, dtype=_U)
            np.cumsum(small * forward[:n] % _U(_PRIME), out=sums[1:])
            self.sums.append(sums)

    @staticmethod
    def draw() -> tuple[int, ...]:
        return tuple(secrets.randbelow(_PRIME - 2) + 2 for _ in range(4))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, dtype=_U)
        while len(out) < n:
            out = np.concatenate([out, out[: n - len(out)] * _U(pow(base, len(out), _PRIME)) % _U(_PRIME)])
        return out.astype(np.uint32)

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of every range's hash, as signed numbers."""
        parts = [(sums[hi] - sums[lo]) % _U(_PRIME) * back[lo] % _U(_PRIME) for sums, back in zip(self.sums, self.back)]
        return tuple((a << _U(32) | b).view(np.int64) for a, b in (parts[:2], parts[2:]))


class Bytes:
    """Units are the UTF-8 bytes of a text."""

    size = 1

    @staticmethod
    def split(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)

    @staticmethod
    def values(units: np.ndarray) -> np.ndarray:
        return _BYTE[units]

    @staticmethod
    def pack(units: np.ndarray) -> bytes:
        return units.tobytes()

    @staticmethod
    def unpack(body: bytes) -> np.ndarray:
        return np.frombuffer(body, dtype=np.uint8)


class Words:
    """Units are 64-bit hashes of the runs of bytes other than space and 0x09-0x0D."""

    size = 8

    @staticmethod
    def split(text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=_U, count=len(words))

    @staticmethod
    def values(units: np.ndarray) -> np.ndarray:
        return units | _U(1)

    @staticmethod
    def pack(units: np.ndarray) -> bytes:
        return units.astype("<u8").tobytes()

    @staticmethod
    def unpack(body: bytes) -> np.ndarray:
        return np.frombuffer(body, dtype="<u8")


def runs(values: np.ndarray, window: int, anchor: int) -> Iterator[tuple]:
    """Arrays (first start, last start, anchor position, anchor hash) and where the piece begins, piece by piece."""
    starts = len(values) - window + 1
    width = window - anchor + 1
    for at in range(0, max(0, starts), _PIECE):
        count = min(_PIECE, starts - at)
        grams = _Rolling(values[at : at + count + window - 1]).grams(anchor)
        n = len(grams)
        rank = (grams >> _U(_POSITION) << _U(_POSITION)) | np.arange(n, dtype=_U)
        blocks = np.concatenate([rank, np.full(-n % width, ~_U(0))]).reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[:count], left[width - 1 : width - 1 + count])
        where = (least & _U((1 << _POSITION) - 1)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        hi = np.concatenate([lo[1:] - 1, [count - 1]])
        p = where[lo]
        yield lo + at, hi + at, p + at, grams[p], at


def _scan(docs: DataFrame, unit: type, window: int, anchor: int, points: tuple[int, ...]) -> DataFrame:
    """(key, lo, hi, p, seed, run, run2) for every run of docs (key, text)."""
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("p", pa.int32()), ("seed", pa.int64()), ("run", pa.int64()), ("run2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in schema]
            held = 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                units = unit.split(text)
                for lo, hi, p, seed, at in runs(unit.values(units), window, anchor):
                    hashes = Equality(units[at : hi[-1] + window], points).ranges(lo - at, hi - at + window)
                    for column, x in zip(out, (np.full(len(lo), key), lo.astype(np.int32), hi.astype(np.int32), p.astype(np.int32), seed.view(np.int64), *hashes)):
                        column.append(x)
                    held += len(lo)
                if held >= 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)
                    out, held = [[] for _ in schema], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return docs.mapInArrow(leaning(run), "key long, lo int, hi int, p int, seed long, run long, run2 long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, as lists of ranges take much memory once they are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _bodies(docs: DataFrame, wanted: DataFrame, unit: type, window: int) -> DataFrame:
    """The wanted runs (key, lo, hi, p, seed, large) with the units they span as a binary column body."""
    per_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "p", "seed", "large", "open")).alias("runs"))
    joined = docs.join(per_doc, "key").select("key", "text", "runs")
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("p", pa.int32()), ("seed", pa.int64()), ("large", pa.bool_()), ("open", pa.bool_()), ("body", pa.binary())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in slices(batches):
            for key, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                units = unit.split(text)
                for r in found:
                    rows.append((key, r["lo"], r["hi"], r["p"], r["seed"], r["large"], r["open"], unit.pack(units[r["lo"] : r["hi"] + window])))
                    held += len(rows[-1][-1])
                    if held >= 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return joined.mapInArrow(leaning(run), "key long, lo int, hi int, p int, seed long, large boolean, open boolean, body binary")


def suffixes(bodies: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, window units) of every suffix of the rows, cut at the window's length."""
    counts = hi - lo + 1
    row = np.repeat(np.arange(len(bodies)), counts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    base = np.concatenate([[0], np.cumsum([len(x) for x in bodies])[:-1]])
    flat = np.concatenate(bodies)
    units = np.lib.stride_tricks.sliding_window_view(flat, window)[base[row] + inner]
    return row, lo[row] + inner, units


Resolver = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _resolved(bodies: DataFrame, unit: type, window: int, resolver: Resolver) -> DataFrame:
    """(key, lo, hi): ranges of starts of the open runs whose windows repeat inside their anchor's group."""
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key, lo, hi, p, seed = (np.array([r[i] for r in rows]) for i in range(5))
        is_open = np.array([r[5] for r in rows])
        row, start, units = suffixes([unit.unpack(r[6]) for r in rows], lo, hi, window)
        _, group = np.unique(seed, return_inverse=True)
        kind = group[row] * (window + 1) + (p[row] - start)
        hit = resolver(kind, units) & is_open[row]
        row, start = row[hit], start[hit]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 1)])) if len(row) else np.array([], dtype=np.int64)
        last = np.concatenate([first[1:] - 1, [len(row) - 1]]) if len(row) else first
        return pa.RecordBatch.from_arrays([pa.array(key[row[first]], pa.int64()), pa.array(start[first], pa.int32()), pa.array(start[last], pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, seed = 0, None
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("key", "lo", "hi", "p", "seed", "open", "body"))):
                if r[4] != seed:
                    if held >= 50_000:
                        yield solve(rows)
                        rows, held = [], 0
                    seed = r[4]
                rows.append(r)
                held += r[2] - r[1] + 1
        if rows:
            yield solve(rows)

    return bodies.repartition("seed").sortWithinPartitions("seed").mapInArrow(leaning(run), "key long, lo int, hi int")


def _counted(bodies: DataFrame, unit: type, window: int, points: tuple[int, ...]) -> DataFrame:
    """As ``_resolved`` for anchors with very many distinct runs: stretches, then windows are counted by (anchor, hash).

    A run is cut into stretches of up to ``_STRETCH`` starts at fixed distances
    from the anchor, so that equal windows lie in stretches of one place. A
    stretch that occurs again settles all its starts; windows are listed for
    one representative of every distinct stretch only.
    """
    names = ["key", "seed", "open", "lo", "hi", "off", "stretch", "stretch2", "windows", "windows2"]
    schema = pa.schema(zip(names, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, lo, hi, p, seed, is_open, body in zip(*(b.column(n).to_pylist() for n in ("key", "lo", "hi", "p", "seed", "open", "body"))):
                equal = Equality(unit.unpack(body), points)
                inner = np.arange(hi - lo + 1)
                each, each2 = equal.ranges(inner, inner + window)
                place = (p - lo - inner) // _STRETCH
                first = np.flatnonzero(np.diff(place, prepend=place[0] + 1))
                last = np.append(first[1:] - 1, hi - lo)
                whole = [x.tolist() for x in equal.ranges(first, last + window)]
                out += [(key, seed, is_open, lo + i, lo + k, p - lo - k, h, h2, each[i : k + 1].tolist(), each2[i : k + 1].tolist()) for i, k, h, h2 in zip(first.tolist(), last.tolist(), *whole)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    stretches = bodies.mapInArrow(leaning(run), "key long, seed long, open boolean, lo int, hi int, off int, stretch long, stretch2 long, windows array<long>, windows2 array<long>")
    same = ["seed", "off", "stretch", "stretch2"]
    distinct = written(stretches.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi", "open", "windows", "windows2")).alias("one")), "stretches")
    settled = stretches.filter("open").join(distinct.filter("n > 1").select(*same), same, "left_semi").select("key", "lo", "hi")
    windows = distinct.select("seed", "n", "one.key", "one.lo", "one.open", F.posexplode(F.arrays_zip(F.col("one.windows").alias("a"), F.col("one.windows2").alias("b"))).alias("at", "w")).withColumns({"window": F.col("w.a"), "window2": F.col("w.b")}).drop("w")
    many = windows.groupBy("seed", "window", "window2").agg(F.sum(F.least("n", F.lit(2))).alias("n")).filter("n > 1").select("seed", "window", "window2")
    single = windows.filter("n = 1 and open").join(many, ["seed", "window", "window2"], "left_semi").select("key", (F.col("lo") + F.col("at")).alias("lo"))
    return settled.unionByName(single.select("key", "lo", F.col("lo").alias("hi")))


def keyed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, key, rest): text as a string (null: empty), a 64-bit hash of doc_id and text, and the columns ``keep``.

    Rows with one key are repeated rows, for which every result is the same.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(True)
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"), rest.alias("rest"))


def repeated_starts(docs: DataFrame, unit: type, window: int, anchor: int, resolver: Resolver, group_limit: int = 1500) -> DataFrame:
    """(key, starts): per document of docs (key, text) the ranges (lo, hi) of starts whose window occurs more than once."""
    points = Equality.draw()
    found = written(_scan(docs.select("key", "text"), unit, window, anchor, points), "runs")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("run", "run2") for f in (F.min, F.max)]
    by_seed = found.groupBy("seed").agg(F.count("*").alias("n"), *ends).filter("n > 1").selectExpr("seed", "min_run <> max_run or min_run2 <> max_run2 as mixed")
    # Written, so that the join reads two shuffles (or sends the small side) and adaptive execution can split a hot anchor.
    by_seed = written(by_seed, "anchors")
    # Dealt anew, as the join leaves a hot anchor's rows together.
    known = written(found.join(by_seed, "seed").repartition("key", "lo"), "repeated")
    dropped(found)
    same = known.filter("not mixed").select("key", "lo", "hi")
    mixed = known.filter("mixed")
    one = F.min(F.struct("key", "lo", "hi", "p"))
    by_run = written(mixed.groupBy("seed", "run", "run2").agg(F.count("*").alias("n"), one.alias("one")), "distinct")
    settled = mixed.join(by_run.filter("n > 1").select("seed", "run", "run2"), ["seed", "run", "run2"], "left_semi").select("key", "lo", "hi")
    size = by_run.groupBy("seed").agg(F.count("*").alias("distinct"))
    wanted = by_run.join(size, "seed").select("one.*", "seed", (F.col("distinct") > group_limit).alias("large"), (F.col("n") == 1).alias("open"))
    bodies = written(_bodies(docs, wanted, unit, window), "bodies")
    ranges = same.unionByName(settled).unionByName(_resolved(bodies.filter("not large"), unit, window, resolver)).unionByName(_counted(bodies.filter("large"), unit, window, points))
    # Repeated rows have one key and the same ranges; the set holds each once.
    return written(ranges.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")), "starts")


def covered(n: int, starts: list[dict] | None, window: int) -> np.ndarray:
    """Which of n units lie in a window that begins in one of the ranges of starts."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for r in starts or ():
        edge[r["lo"]] += 1
        edge[r["hi"] + window] -= 1
    return np.cumsum(edge[:n]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last positions of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
