"""Counts, sums and best rows of all pairs, from blocks of pairs in NumPy; only what is asked for leaves a task.

Tops meet beds by key code and tempo band, as in the banded plan of
``pairs``. A code and band is one group, large ones are cut into chunks, so a
task holds at most ``CHUNK`` rows of each side and ``CELLS`` pairs at a time.
Every pair is made and tested; none is left out unscored unless its tempo and
key alone put it below rows found before.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.constants import INSTRUMENTAL_OVER_INSTRUMENTAL, VOCAL_OVER_INSTRUMENTAL, MatchConfig
from cadenza.functions import scalars as S
from cadenza.operators import pairs
from cadenza.tables import written

CHUNK, CELLS = 8192, 1 << 15
#: Tests of pairs that a task gets, about.
TASK_TESTS = 100_000_000
BOTH = (VOCAL_OVER_INSTRUMENTAL, INSTRUMENTAL_OVER_INSTRUMENTAL)
#: Nearer than this to a half, in units of the last digit, a total is summed again in Spark's order before it is rounded.
_TIE = 1e-5


def _groups(named: DataFrame, config: MatchConfig, combos: tuple[str, ...], vectors: bool) -> tuple[DataFrame, DataFrame]:
    """Tops and beds with the keys (code, band, i, j) of the groups in which they meet, a row of ``named`` as often as it has groups; no pair meets twice."""
    more = [S.loudness(F.col("loudness_rms"), F.col("energy")).alias("loud"), F.col("mfcc")] if vectors else []
    side = named.filter("bpm > 0").select("row", "song_id", "bpm", "stem_type", F.coalesce("camelot", F.lit("?")).alias("code"), *more)
    beds = side.filter("stem_type = 'instrumental'")
    kinds = [F.when(F.col("stem_type") == ("vocals" if c == VOCAL_OVER_INSTRUMENTAL else "instrumental"), F.lit(i)) for i, c in enumerate(combos)]
    tops = side.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
    codes = lambda df, name: df.select(F.col("code").alias(name)).distinct()
    compat = codes(tops, "code").join(codes(beds, "inst_code"), S.camelot_score(F.col("code"), F.col("inst_code")) >= config.key_min).withColumn("score_key", S.camelot_score(F.col("code"), F.col("inst_code")))
    compat = written(compat, "codes")
    few = compat.count() <= pairs.MOST_CODES
    tops = tops.join(F.broadcast(compat) if few else compat, "code").drop("code", "stem_type").withColumnRenamed("inst_code", "code")
    tops, beds, _ = pairs.dealt(*pairs.banded(tops, beds.drop("stem_type"), "bpm", "bpm", config), ["code", "band"], CHUNK, TASK_TESTS)
    return tops, beds


def _vectors(column, width: int):
    """(vectors filled up with zeros, sizes (0: missing), whether one has a null element) of an Arrow list column."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    holes = pc.is_null(flat).to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    out, void = np.zeros((len(sizes), width)), np.zeros(len(sizes), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values
    void[row[holes]] = True
    return out, sizes, void


def _summed(a, b):
    """Row by row the dot product, from the first place to the last, as Spark's aggregate adds."""
    import numpy as np

    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total = total + a[:, k] * b[:, k]
    return total


def _side(table, vectors: bool, width: int, order) -> dict:
    import numpy as np

    found = {n: table[n].to_numpy()[order] for n in ("row", "song_id", "bpm")}
    if vectors:
        loud = table["loud"].to_pandas().to_numpy(dtype=float, na_value=np.nan)
        null = table["loud"].is_null().to_numpy()
        found["loud"] = np.where(null, 0.0, loud)[order]  # null and 0: unknown
        v, sizes, void = _vectors(table["mfcc"], width)
        found |= {"vector": v[order], "size": sizes[order], "void": void[order], "norm": np.sqrt(_summed(v, v))[order]}
    return found


def _tempo(distance, most: float):
    """The tempo's score of distances; ``most``: the greatest that matters."""
    import numpy as np

    steps = [0.5, 3.0, 6.0, 10.0, 15.0, 25.0]
    at = np.zeros(distance.shape, np.int8)
    for s in (s for s in steps if s <= most):
        at += distance >= s
    score = np.array([1.0, 0.95, 0.85, 0.65, 0.40, 0.20, 0.0])[at]
    return np.where(at == 6, np.maximum(0.0, 0.20 - (distance - 25.0) / 100.0), score) if most >= 25 else score


def _energy(a, b):
    import numpy as np

    gap = 1.0 - np.minimum(a, b) / np.maximum(a, b)
    score = np.exp(-(gap * gap) / (2.0 * 0.25 * 0.25))
    return np.where(((a > 0) | np.isnan(a)) & ((b > 0) | np.isnan(b)), score, 0.5)


def _timbre(dot, norms, missing, void):
    import numpy as np

    score = np.where(norms == 0, 0.0, np.fmin(1.0, np.maximum(0.0, dot / norms)))
    return np.where(missing, 0.5, np.where(void, 0.0, score))


def _rounded(total, again: Callable):
    """(totals in ten-thousandths, rounded half up as Spark does; where they aren't finite). again(places): those totals anew, in Spark's order."""
    import numpy as np

    scaled = total * 1e4
    out = np.rint(scaled)
    near = np.flatnonzero(np.abs(scaled - out) > 0.5 - _TIE)
    if len(near):
        exact = again(near)
        out.flat[near] = [float(Decimal(repr(float(x))).quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10_000) for x in exact]
    return out


def _blocks(tops, beds, config: MatchConfig, combos: tuple[str, ...], vectors: bool):
    """(kind, tops, beds, rows of the tops, of the beds, distances, which pairs pass), block by block."""
    import numpy as np

    width = 0
    if vectors:
        import pyarrow.compute as pc

        width = max(pc.max(pc.list_value_length(t["mfcc"])).as_py() or 0 for t in (tops, beds))
    b = _side(beds, vectors, width, np.argsort(beds["bpm"].to_numpy(), kind="stable"))
    kinds, keys, bpm = tops["kind"].to_numpy(), tops["score_key"].to_numpy(), tops["bpm"].to_numpy()
    order = np.lexsort((bpm, keys, kinds))
    a = _side(tops, vectors, width, order)
    kinds, keys = kinds[order], keys[order]
    cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (keys[1:] != keys[:-1])) + 1
    most = config.bpm_max
    for begin, end in zip([0, *cuts], [*cuts, len(kinds)]):
        at = begin
        while at < end:
            # So many tops, next to each other in tempo, that a block has about CELLS pairs.
            step = 8
            while True:
                some = slice(at, min(at + step, end))
                low, high = a["bpm"][some.start], a["bpm"][some.stop - 1]
                slack = 1e-9 * (high + most) + 1e-9
                near = [np.searchsorted(b["bpm"], ((low - most) * k - 2 * slack, (high + most) * k + 2 * slack)) for k in (0.5, 1.0, 2.0)]
                near = [(max(lo, near[i - 1][1]) if i else lo, hi) for i, (lo, hi) in enumerate(near)]
                beds_at = np.concatenate([np.arange(lo, hi) for lo, hi in near])
                if some.stop == end or step >= 4096 or step * 2 * len(beds_at) > CELLS:
                    break
                step *= 2
            at = some.stop
            if not len(beds_at):
                continue
            x, y = a["bpm"][some, None], b["bpm"][None, beds_at]
            distance = np.abs(x - y)
            np.minimum(distance, np.abs(x - y / 2.0), out=distance)
            np.minimum(distance, np.abs(x - y * 2.0), out=distance)
            passing = distance <= most
            one, other = a["song_id"][some, None], b["song_id"][None, beds_at]
            passing &= one < other if combos[kinds[begin]] == INSTRUMENTAL_OVER_INSTRUMENTAL else one != other
            yield int(kinds[begin]), float(keys[begin]), a, b, some, beds_at, distance, passing


def _totals(key: float, a: dict, b: dict, rows, cols, distance, config: MatchConfig, passing=None):
    """Rounded totals in ten-thousandths: of all pairs of rows and cols, or, with 1-d rows and cols of one length, of those pairs."""
    import numpy as np

    w = {k: float(v) for k, v in (config.weights or MatchConfig().weights).items()}
    flat = passing is None
    of = lambda side, name, places, axis: side[name][places] if flat else np.expand_dims(side[name][places], axis)
    pick = lambda name: (of(a, name, rows, 1), of(b, name, cols, 0))
    (sa, sb), (na, nb), (va, vb) = pick("size"), pick("norm"), pick("void")
    uneven = (sa != sb) & (sa > 0) & (sb > 0)
    if (uneven if flat else uneven & passing).any():
        raise ValueError("vectors of different lengths")
    energy, tempo = _energy(*pick("loud")), _tempo(distance, config.bpm_max)
    missing, void = (sa <= 0) | (sb <= 0), va | vb

    def total(tempo, energy, timbre):
        return ((tempo * w.get("bpm", 0.0) + key * w.get("key", 0.0)) + energy * w.get("energy", 0.0)) + timbre * w.get("timbre", 0.0)

    u, v = a["vector"][rows], b["vector"][cols]
    dot = _summed(u, v) if flat else u @ v.T
    found = total(tempo, energy, _timbre(dot, na * nb, missing, void))

    def again(places):
        if flat:
            return found[places]
        i, j = np.unravel_index(places, found.shape)
        at = lambda x: np.broadcast_to(x, found.shape)[i, j]
        return total(tempo[i, j], energy[i, j], _timbre(_summed(u[i], v[j]), (na * nb)[i, j], at(missing), at(void)))

    return _rounded(found, again)


def _counted(tops, beds, config, combos):
    import numpy as np
    import pyarrow as pa

    n = [0] * len(combos)
    for kind, *_, passing in _blocks(tops, beds, config, combos, False):
        n[kind] += int(np.count_nonzero(passing))
    return pa.table({"kind": pa.array(range(len(combos)), pa.int32()), "n": pa.array(n, pa.int64())})


def _added(tops, beds, config, combos):
    import numpy as np
    import pyarrow as pa

    n, sums, odd = [0] * len(combos), [0] * len(combos), [0.0] * len(combos)
    with np.errstate(all="ignore"):
        for kind, key, a, b, some, cols, distance, passing in _blocks(tops, beds, config, combos, True):
            totals = _totals(key, a, b, some, cols, distance, config, passing)[passing]
            finite = np.isfinite(totals)
            if not finite.all():
                odd[kind] += float(totals[~finite].sum())
                totals = totals[finite]
            n[kind] += int(np.count_nonzero(passing))
            sums[kind] += int(totals.astype(np.int64).sum())
    return pa.table({"kind": pa.array(range(len(combos)), pa.int32()), "n": pa.array(n, pa.int64()), "sum": pa.array(sums, pa.int64()), "odd": pa.array(odd, pa.float64())})


def _best(found: list, most: int) -> list:
    """The ``most`` first of (total, song ids, rows), in the order of ``rank``; NaN is the greatest."""
    import numpy as np

    total, one, other, *rows = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((*reversed(rows), other, one, -total))[:most]
    return [[x[order] for x in (total, one, other, *rows)]]


def _chosen(tops, beds, config, combos, most, known):
    """known: by kind the total that ``most`` rows of this task have reached."""
    import numpy as np
    import pyarrow as pa

    found = {k: [] for k in range(len(combos))}
    w = {k: float(v) for k, v in (config.weights or MatchConfig().weights).items()}
    bounded = min(w.values(), default=0.0) >= 0
    with np.errstate(all="ignore"):
        for kind, key, a, b, some, cols, distance, passing in _blocks(tops, beds, config, combos, True):
            least = known.get(kind, -np.inf)
            if bounded and np.isfinite(least):
                reach = (_tempo(distance, config.bpm_max) * w.get("bpm", 0.0) + key * w.get("key", 0.0) + w.get("energy", 0.0) + w.get("timbre", 0.0)) * 1e4
                # Energy or timbre that isn't a number counts as the greatest total, so it isn't bounded.
                strange = ~np.isfinite(a["loud"][some])[:, None] | ~np.isfinite(b["loud"][cols])[None, :]
                passing &= (reach + 0.51 >= least) | strange
            i, j = np.nonzero(passing)
            if not len(i):
                continue
            if 4 * len(i) < passing.size:
                totals = _totals(key, a, b, some.start + i, cols[j], distance[i, j], config)
            else:
                totals = _totals(key, a, b, some, cols, distance, config, passing)[i, j]
            totals = np.where(np.isnan(totals), np.inf, totals)
            keep = totals >= least
            if not keep.any():
                continue
            i, j = some.start + i[keep], cols[j[keep]]
            found[kind].append([totals[keep], a["song_id"][i], b["song_id"][j], a["row"][i], b["row"][j]])
            if sum(len(x[0]) for x in found[kind]) > 2 * most:
                found[kind] = _best(found[kind], most)
            if len(found[kind]) == 1 and len(found[kind][0][0]) >= most > 0:
                known[kind] = max(least, found[kind][0][0].min())
    rows = [(k, _best(x, most)[0]) for k, x in found.items() if x]
    join = lambda n, dtype: np.concatenate([x[n] for _, x in rows]).astype(dtype) if rows else np.zeros(0, dtype)
    kinds = np.concatenate([np.full(len(x[0]), k, np.int32) for k, x in rows]) if rows else np.zeros(0, np.int32)
    return pa.table({"kind": kinds, "total": join(0, float), "top_row": join(3, np.int64), "bed_row": join(4, np.int64)})


def _applied(named: DataFrame, config: MatchConfig, combos: tuple[str, ...], vectors: bool, step: Callable, schema: str) -> DataFrame:
    keys = ["code", "band", "i", "j"]
    tops, beds = _groups(named, config, combos, vectors)

    def work(left, right):
        return step(left, right, config, combos)

    beds = beds.toDF(*beds.columns)  # columns of its own, as both come from one table
    return tops.groupBy(*keys).cogroup(beds.groupBy(*keys)).applyInArrow(work, schema)


def _sides(features: DataFrame, songs: DataFrame) -> DataFrame:
    """Sides with titles and a row number, written once, as plans over them are several."""
    named = pairs.with_titles(features, songs).filter(F.col("stem_type").isin("vocals", "instrumental"))
    return written(named.select(*pairs.SIDE, "stem_type", "mfcc", F.monotonically_increasing_id().alias("row")), "sides")


def _named(combos: tuple[str, ...]):
    return F.get(F.array(*[F.lit(c) for c in combos]), F.col("kind")).alias("combo_type")


def counts(features: DataFrame, songs: DataFrame, config: MatchConfig | None = None, combos: tuple[str, ...] = BOTH) -> DataFrame:
    """(combo_type, scored): how many pairs ``pairs.score_all`` has."""
    found = _applied(_sides(features, songs), config or MatchConfig(), combos, False, _counted, "kind int, n long")
    return found.groupBy("kind").agg(F.sum("n").alias("scored")).filter("scored > 0").select(_named(combos), "scored")


def summary(features: DataFrame, songs: DataFrame, config: MatchConfig | None = None, combos: tuple[str, ...] = BOTH) -> DataFrame:
    """(combo_type, n_pairs, mean_total) of ``pairs.score_all``; totals are added as whole ten-thousandths."""
    found = _applied(_sides(features, songs), config or MatchConfig(), combos, True, _added, "kind int, n long, sum long, odd double")
    sums = found.groupBy("kind").agg(F.sum("n").alias("n_pairs"), F.sum("sum").alias("sum"), F.sum("odd").alias("odd")).filter("n_pairs > 0")
    return sums.select(_named(combos), "n_pairs", ((F.col("sum") + F.col("odd")) / 1e4 / F.col("n_pairs")).alias("mean_total"))


def best(features: DataFrame, songs: DataFrame, most: int, config: MatchConfig | None = None, combos: tuple[str, ...] = BOTH) -> DataFrame:
    """Rows of ``pairs.score_all`` among which are the first ``most`` of each kind in the order of ``rank``.

    Blocks find them; the few rows found are then scored by the same columns
    as all pairs.
    """
    if most < 0:
        raise ValueError("a limit can't be negative")
    config = config or MatchConfig()
    sides = _sides(features, songs)
    step = partial(_chosen, most=most, known={})
    found = written(_applied(sides, config, combos, True, step, "kind int, total double, top_row long, bed_row long"), "best")
    made = None
    for kind, combo in enumerate(combos):
        own = found.filter(F.col("kind") == kind)
        last = own.orderBy(F.col("total").desc()).select("total").limit(most).agg(F.min("total")).first()[0]
        # One step of the last digit below, as the last bit of exp isn't the same in NumPy and Java.
        rows = F.broadcast(own.filter(F.col("total") >= (last - 1.0 if last is not None else 0.0)).select("top_row", "bed_row"))
        a, b = (pairs.sided(sides, s).withColumn(r, F.col("row")).drop("row") for s, r in (("vocal", "top_row"), ("inst", "bed_row")))
        joined = a.join(rows, "top_row").join(b, "bed_row").drop("top_row", "bed_row")
        one = pairs.scored(joined, combo, config)
        made = one if made is None else made.unionByName(one)
    return made
