"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._shared import leaning, written
from cadenza.llm.repeats import _Rolling

_U = np.uint64
_NONE = np.zeros(1, dtype=np.uint8)
#: Words that count as numbers, units that follow a number, and symbols that are units anywhere.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres kmh mph percent cent cents dollar dollars euro euros usd eur gbp "
    "degree degrees w kw v kv j kj cal kcal hz khz mhz ghz b kb mb gb tb"
).split()
SYMBOLS = "%$€£°"
_NUMBER, _UNIT, _NAME = (xxhash.xxh64_intdigest(x) for x in ("<number>", "<unit>", "<name>"))
#: Benchmarks whose template windows, with the values of their slots, take up to so many bytes are sent to every task; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its kind (0 none, 1 letter, 2 digit, 3 symbol, 4 joins digits), its lower case, its case (1 upper, 2 lower)."""
    size = 0x110000
    chars = lambda: map(chr, range(size))
    kind = np.fromiter((2 if c.isdecimal() else 1 if c.isalnum() else 0 for c in chars()), dtype=np.uint8, count=size)
    kind[[ord(c) for c in SYMBOLS]] = 3
    kind[[ord(c) for c in ".,:/"]] = 4
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars()), dtype=np.uint32, count=size)
    case = np.fromiter((1 if c.isupper() else 2 if c.islower() else 0 for c in chars()), dtype=np.uint8, count=size)
    return kind, lower, case


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _word_codes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _Rolling(np.multiply(points, _U(0x9E3779B97F4A7C15), dtype=_U)).ranges(start, end)


@lru_cache(maxsize=1)
def _octets() -> tuple[bytes, bytes, bytes]:
    """The same for Latin-1 texts, as translation tables."""
    return tuple(x[:256].astype(np.uint8).tobytes() for x in _characters())


def _read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, lower case and case of every character."""
    try:
        octets = text.encode("latin-1")
    except UnicodeEncodeError:
        points = _points(text)
        return tuple(x[points] for x in _characters())
    return tuple(np.frombuffer(bytearray(octets.translate(x)), dtype=np.uint8) for x in _octets())


@lru_cache(maxsize=2)
def _codes_of(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.concatenate([_word_codes(_points(w), np.array([0]), np.array([len(w)])) for w in words]))


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of codes that are in the sorted array known."""
    if not len(known):
        return np.zeros(0, dtype=np.int64)
    shift = _U(64 - max(16, min(26, 4 + len(known).bit_length())))
    bitmap = np.zeros(1 << (64 - int(shift)), dtype=bool)
    bitmap[known >> shift] = True
    at = np.flatnonzero(bitmap[codes >> shift])
    return at[known[np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)] == codes[at]]


def template(text: str | None, typed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, codes, slots) of a text's tokens: a code is that of the word or placeholder; slots tells which are placeholders.

    Numbers (digits, also joined by .,:/ or number words), capitalised words
    (first letter upper, last lower case: names, wherever they stand) and units
    (symbols, or unit words right after a number) become typed placeholders.
    Other words are compared in lower case; punctuation isn't. Not ``typed``:
    no token becomes a placeholder.
    """
    kind, lower, case = _read(text or "")
    joint = np.flatnonzero(kind == 4)
    inside = joint[(joint > 0) & (joint < len(kind) - 1)]
    kind[joint] = 0
    kind[inside[(kind[inside - 1] == 2) & (kind[inside + 1] == 2)]] = 2
    bounds = np.concatenate([_NONE, kind, _NONE])
    edge = np.flatnonzero(bounds[1:] != bounds[:-1])
    edge = np.union1d(edge, np.flatnonzero(kind == 3) + 1) if (kind == 3).any() else edge
    start, end = edge[:-1], edge[1:]
    token = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
    start, end = start[token], end[token]
    if not len(start):
        return start, end, np.zeros(0, dtype=_U), np.zeros(0, dtype=bool)
    codes = _word_codes(lower, start, end)
    if not typed:
        return start, end, codes, np.zeros(len(codes), dtype=bool)
    number = kind[start] == 2
    number[_among(codes, _codes_of(tuple(NUMBER_WORDS)))] = True
    unit = kind[start] == 3
    measure = _among(codes, _codes_of(tuple(UNITS)))
    measure = measure[measure > 0]
    unit[measure[number[measure - 1]]] = True
    name = (case[start] == 1) & (case[end - 1] == 2) & ~number & ~unit
    codes[number], codes[unit], codes[name] = _NUMBER, _UNIT, _NAME
    return start, end, codes, number | unit | name


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every window of ``size`` codes; fewer codes: one window of all of them; none: no window."""
    size = min(size, len(codes))
    n = len(codes) - size + 1 if size else 0
    total = np.full(n, size, dtype=_U)
    for i in range(size):
        total = (total ^ (total >> _U(29))) * _U(0x9E3779B97F4A7C15) + codes[i : i + n]
    return (total ^ (total >> _U(32))) * _U(0xD6E8FEB86659FD93)


def windows(rows: DataFrame, size: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, pos, hash, slots) for the template windows of rows (key, text): the first token's place, the hash and the placeholders' values.

    wanted: only windows whose hash is in this sorted array.
    """
    value = pa.list_(pa.string())
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int64()), ("hash", pa.int64()), ("slots", value)])
    handle = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = handle.value if handle else None
        for b in batches:
            out: list[list] = [[], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start, end, codes, slots = template(text)
                hashes = window_hashes(codes, size)
                at = np.arange(len(hashes)) if asked is None else _among(hashes, asked)
                if not len(at):
                    continue
                own = min(size, len(codes))
                found = [[text[start[i] : end[i]].lower() for i in range(a, a + own) if slots[i]] for a in at.tolist()]
                for column, x in zip(out, ([key] * len(at), at.tolist(), hashes[at].view(np.int64).tolist(), found)):
                    column.extend(x)
                if len(out[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                    out = [[], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return rows.select("key", "text").mapInArrow(leaning(run), "key long, pos long, hash long, slots array<string>")


def _phrases(rows: DataFrame, size: int, lengths: list[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, length, hash): a hash of tokens as they stand, in lower case, without placeholders.

    lengths None: of the whole text, if it has fewer than ``size`` tokens. Else
    of every distinct sequence of so many tokens in a text; only those whose
    hash is in the sorted array wanted, if it is given.
    """
    handle = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = template(text, typed=False)[2]
                for n in lengths if lengths is not None else [len(codes)] * (len(codes) < size):
                    hashes = window_hashes(codes, n) if 0 < n <= len(codes) else codes[:0]
                    hashes = np.unique(hashes if handle is None else hashes[_among(hashes, handle.value)])
                    for column, x in zip(out, (np.full(len(hashes), key, dtype=np.int64), np.full(len(hashes), n, dtype=np.int32), hashes.view(np.int64))):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "length", "hash"])

    return rows.select("key", "text").mapInArrow(leaning(run), "key long, length int, hash long")


def _short_items(rows: DataFrame, asked: DataFrame, size: int, broadcast_bytes: int) -> DataFrame | None:
    """(key, item_id): items of fewer than ``size`` tokens that stand word for word anywhere in a text; None if no item is so short."""
    short = written(_phrases(asked, size).select(F.col("key").alias("item_id"), "length", "hash").distinct(), "short")
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())
    if not lengths:
        return None
    wanted = None
    if 8 * short.count() <= broadcast_bytes:
        wanted = np.sort(np.array([r["hash"] for r in short.select("hash").distinct().collect()], dtype=np.int64).view(_U))
    return _phrases(rows, size, lengths, wanted).join(short, ["length", "hash"]).select("key", "item_id").distinct()


def _fits_itself(values: tuple, held: tuple) -> bool:
    return len(set(zip(values, held))) == len(set(values))


def consistent(group: list[dict], needed: float) -> int:
    """As ``best_consistent`` for the hits (pos, hash, slots, places) of a pair, places being those of the hash in the item.

    The fillings over the whole text are counted by slot, not by hit and place,
    so that an item that is one template over and over (numbers, say) costs in
    proportion to its places and the hits.
    """
    places, fillings = {}, {}
    for h in group:
        places.setdefault(h["hash"], [tuple(p["item_slots"]) for p in h["places"]])
        fillings.setdefault(h["hash"], Counter())[tuple(h["slots"])] += 1
    held: dict[tuple, Counter] = {}
    for name, found in fillings.items():
        for slots, n in found.items():
            for i, x in enumerate(slots):
                held.setdefault((name, i), Counter())[x] += n
    asked: dict[str, Counter] = {}
    for name, found in places.items():
        for values in found:
            for i, v in enumerate(values):
                asked.setdefault(v, Counter())[name, i] += 1

    @lru_cache(maxsize=None)
    def likeliest(slots: frozenset) -> str:
        votes: Counter = Counter()
        for slot, n in slots:
            for x, c in held[slot].items():
                votes[x] += n * c
        return max(votes.items(), key=lambda x: (x[1], x[0]))[0]

    usual = {v: likeliest(frozenset(c.items())) for v, c in asked.items()}
    best = sum(any(tuple(usual[v] for v in values) in fillings[name] for values in found) for name, found in places.items())
    if best == len(places):
        return best
    if len(places) == 1:  # any occurrence is as good as its one window
        (name, found), = places.items()
        shapes = {tuple(values.index(v) for v in values): values for values in found}
        return int(any(_fits_itself(values, slots) for values in shapes.values() for slots in fillings[name]))
    return best_consistent([(h["pos"], p["item_pos"], h["hash"], tuple(p["item_slots"]), tuple(h["slots"])) for h in group for p in h["places"]], needed)


def _fitting(hits: list[tuple]) -> int:
    """How many distinct windows fit the usual fillings of the hits (place in the text, place in the item, hash, item's values, text's values).

    A value's usual filling is the one held most often, of equals the greatest string.
    """
    votes: dict[str, Counter] = {}
    for _, _, _, values, held in hits:
        for v, h in zip(values, held):
            votes.setdefault(v, Counter())[h] += 1
    usual = {v: max(c.items(), key=lambda x: (x[1], x[0]))[0] for v, c in votes.items()}
    return len({h for _, _, h, values, held in hits if all(usual[v] == x for v, x in zip(values, held))})


def _occurrences(hits: list[tuple]) -> Iterator[list[tuple]]:
    """Parts of the hits that may each be one copy of the item.

    Hits of one offset (place in the text less place in the item); hits of
    offsets up to half an item apart, for copies with words put in or left out;
    and chains along the text in which the item's places increase, for copies
    with whole passages put in. A hit is in at most seven parts.
    """
    by_offset = sorted(hits, key=lambda x: x[0] - x[1])
    offsets = [p - q for p, q, *_ in by_offset]
    for _, part in groupby(by_offset, key=lambda x: x[0] - x[1]):
        yield list(part)
    width = max(q for _, q, *_ in hits) // 2
    begin = None
    for o in offsets:
        if begin is None or o > begin + width // 4:
            begin = o
            yield by_offset[bisect_left(offsets, o) : bisect_right(offsets, o + width)]
    chain: list[tuple] = []
    for _, part in groupby(sorted(hits, key=lambda x: x[:2]), key=lambda x: x[0]):
        same = list(part)
        following = next((x for x in same if chain and x[1] > chain[-1][1]), None)
        if following is None and chain:
            yield chain
            chain = []
        chain.append(following or same[0])
    yield chain


def best_consistent(hits: list[tuple], needed: float) -> int:
    """The most windows that fit each other, over the whole text or in any one occurrence with at least ``needed`` distinct windows."""
    matched = len({x[2] for x in hits})
    best = _fitting(hits)
    for part in _occurrences(hits) if best < matched else ():
        if len({x[2] for x in part}) >= max(needed, best + 1):
            best = max(best, _fitting(part))
            if best == matched:
                break
    return best


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, doc_id, item_id, item_windows, matched, consistent, share): benchmark items that a document holds, also with other numbers, names or units.

    docs: doc_id, text; items: item_id, text. An item's windows of ``size``
    template tokens are looked up in the documents. A text of fewer tokens is
    one window, which equals only such a whole text; inside longer texts such an
    item is found where its tokens stand word for word, in any case (one window,
    consistent), as its template alone would fit clean texts. Slots are consistent if
    each value of the item stands for one value of the document; a window with
    a slot that differs from the usual value for it doesn't count. This is
    judged over the whole text and in each occurrence on its own, so that
    copies with different fillings in one text don't spoil each other;
    ``consistent`` is the best of these. An item is leaked if ``share`` of its
    distinct windows match consistently.
    key: a hash of doc_id and text. Null texts and texts without a token match
    nothing; rows with a null item_id are left out; a null doc_id is kept;
    repeated rows (of either) are listed once. Only these columns are read.

    Pairs of a document and an item begin with the item's rarest windows among
    all items, so many that no item can be leaked without one of them; a
    window that many items share (five numbers, say) so makes pairs only for
    items that hold little else. Tasks know the item windows up to
    ``broadcast_bytes``; beyond, documents' windows are joined with them by a
    shuffle.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).filter("key is not null").distinct()
    known = written(windows(asked, size).select(F.col("key").alias("item_id"), F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots")), "benchmark")
    held = F.lit(48) + F.aggregate("item_slots", F.lit(0), lambda n, x: n + F.octet_length(x) + 16)
    small = (known.agg(F.sum(held)).first()[0] or 0) <= broadcast_bytes
    sent = F.broadcast if small else lambda df: df
    if small:
        hashes = np.array([r["hash"] for r in known.select("hash").distinct().collect()], dtype=np.int64).view(_U)
        hits = windows(rows, size, np.sort(hashes))
    else:
        hits = windows(rows, size).join(known.select("hash").distinct(), "hash", "left_semi")
    hits = written(hits.distinct(), "hits")
    # A hash also takes the number of tokens, so a short text's only window equals no full one.
    placed = known.groupBy("item_id", "hash").agg(F.collect_list(F.struct("item_pos", "item_slots")).alias("places"))
    total = known.groupBy("item_id").agg(F.countDistinct("hash").alias("item_windows"))
    spread = known.select("item_id", "hash").distinct().withColumn("n", F.count("*").over(Window.partitionBy("hash")))
    spread = spread.withColumn("at", F.row_number().over(Window.partitionBy("item_id").orderBy("n", "hash"))).join(total, "item_id")
    rare = written(spread.filter(F.col("at") <= F.col("item_windows") - F.ceil(share * F.col("item_windows") - 1e-9) + 1).select("item_id", "hash"), "rare")
    seen = hits.select("key", "hash").distinct()
    likely = seen.join(sent(rare), "hash").select("key", "item_id").distinct()
    likely = likely.join(sent(known.select("item_id", "hash").distinct()), "item_id").join(seen, ["key", "hash"]).groupBy("key", "item_id").agg(F.count("*").alias("matched"))
    likely = written(likely.join(sent(total), "item_id").filter(F.col("matched") >= share * F.col("item_windows")), "likely")
    pairs = likely.join(sent(placed), "item_id").join(hits, ["key", "hash"]).groupBy("key", "item_id", "item_windows", "matched").agg(F.collect_list(F.struct("pos", "hash", "slots", "places")).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for n, group in zip(b.column("item_windows").to_pylist(), b.column("hits").to_pylist()):
                best.append(consistent(group, share * n))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(best, pa.int64())], names=["key", "item_id", "item_windows", "matched", "consistent"])

    found = pairs.mapInArrow(leaning(judge), "key long, item_id long, item_windows long, matched long, consistent long")
    found = written(found.withColumn("share", F.col("consistent") / F.col("item_windows")).filter(F.col("share") >= share), "found")
    short = _short_items(rows, asked, size, broadcast_bytes)
    if short is not None:
        ones = [F.lit(1).cast("long").alias(c) for c in ("item_windows", "matched", "consistent")]
        more = short.join(found.select("key", "item_id"), ["key", "item_id"], "left_anti").select("key", "item_id", *ones, F.lit(1.0).alias("share"))
        found = written(found.unionByName(more), "found")
    named = rows.select("key", "doc_id").join(found.select("key").distinct(), "key", "left_semi").distinct()
    return named.join(found, "key").select("key", "doc_id", "item_id", "item_windows", "matched", "consistent", "share")


def clean(docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """docs without the documents that hold an item; see ``leaks``."""
    found = leaks(docs, items, size, share).select(F.col("key").alias("_leak")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(written(found, "leaks"), key == F.col("_leak"), "left_anti")


def op3_benchmark_decontamination(spark, sf_dir):
    """Every benchmark item in every document; edge cases as in ``leaks``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items).drop("key")


OP3_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
tokens AS (SELECT side, id, regexp_extract_all(text, '\d+(?:[.,:/]\d+)*|[\p{L}\p{No}\p{Nl}]+|[%$€£°]') AS t FROM texts WHERE text IS NOT NULL),
coded AS (
  SELECT side, id, t, list_transform(t, lambda x: CASE
    WHEN regexp_matches(x, '^\d') OR lower(x) IN ('zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety','hundred','thousand','million','billion') THEN '<number>'
    WHEN x IN ('%','$','€','£','°') THEN '<unit>'
    WHEN regexp_matches(x, '^\p{Lu}.*\p{Ll}$') THEN '<name>'
    ELSE lower(x) END) AS c FROM tokens WHERE len(t) > 0),
united AS (
  SELECT side, id, t, list_transform(c, lambda x, i: CASE
    WHEN i > 1 AND c[i - 1] = '<number>' AND x IN ('mm','cm','m','km','in','inch','inches','ft','foot','feet','yd','yard','yards','mi','mile','miles','mg','g','kg','gram','grams','kilogram','kilograms','lb','lbs','pound','pounds','oz','ounce','ounces','ml','l','liter','liters','litre','litres','s','sec','second','seconds','min','minute','minutes','h','hr','hour','hours','day','days','week','weeks','month','months','year','years','meter','meters','metre','metres','kilometer','kilometers','kilometre','kilometres','kmh','mph','percent','cent','cents','dollar','dollars','euro','euros','usd','eur','gbp','degree','degrees','w','kw','v','kv','j','kj','cal','kcal','hz','khz','mhz','ghz','b','kb','mb','gb','tb') THEN '<unit>'
    ELSE x END) AS c FROM coded),
places AS (SELECT side, id, t, c, least(5, len(c)) AS w, unnest(range(0, len(c) - least(5, len(c)) + 1)) AS pos FROM united),
wins AS (
  SELECT side, id, pos, array_to_string(c[pos + 1 : pos + w], ' ') AS win,
    list_transform(list_filter(range(pos + 1, pos + w + 1), lambda i: c[i] IN ('<number>', '<unit>', '<name>')), lambda i: lower(t[i])) AS slots FROM places),
pairs AS (
  SELECT d.id AS doc_id, i.id AS item_id, i.win, i.slots AS item_slots, d.slots FROM wins i JOIN wins d ON i.win = d.win WHERE i.side = 'i' AND d.side = 'd'),
total AS (SELECT id AS item_id, count(DISTINCT win) AS item_windows FROM wins WHERE side = 'i' GROUP BY id),
likely AS (
  SELECT doc_id, item_id, count(DISTINCT win) AS matched, any_value(item_windows) AS item_windows FROM pairs JOIN total USING (item_id)
  GROUP BY doc_id, item_id HAVING count(DISTINCT win) >= 0.8 * any_value(item_windows)),
near AS (SELECT *, row_number() OVER () AS r FROM pairs JOIN likely USING (doc_id, item_id)),
filled AS (SELECT r, doc_id, item_id, unnest(item_slots) AS value, unnest(slots) AS held FROM near),
usual AS (
  SELECT doc_id, item_id, value, held FROM (SELECT doc_id, item_id, value, held, count(*) AS n FROM filled GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, value ORDER BY n DESC, held DESC) = 1),
wrong AS (SELECT DISTINCT f.r FROM filled f JOIN usual u USING (doc_id, item_id, value) WHERE f.held <> u.held),
sound AS (
  SELECT doc_id, item_id, item_windows, matched, count(DISTINCT win) AS consistent FROM near WHERE r NOT IN (SELECT r FROM wrong) GROUP BY ALL),
found AS (SELECT doc_id, item_id, item_windows, matched, consistent, consistent / item_windows AS share FROM sound WHERE consistent / item_windows >= 0.8),
short AS (SELECT DISTINCT id AS item_id, len(t) AS k, list_transform(t, lambda x: lower(x)) AS words FROM tokens WHERE side = 'i' AND len(t) BETWEEN 1 AND 4),
spots AS (
  SELECT id AS doc_id, t, k, unnest(range(0, len(t) - k + 1)) AS pos FROM tokens CROSS JOIN (SELECT DISTINCT k FROM short) WHERE side = 'd' AND len(t) >= k),
verbatim AS (
  SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, list_transform(t[pos + 1 : pos + k], lambda x: lower(x)) AS words FROM spots) JOIN short USING (words))
SELECT * FROM found
UNION ALL
SELECT doc_id, item_id, 1, 1, 1, 1.0 FROM verbatim WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id IS NOT DISTINCT FROM verbatim.doc_id AND f.item_id = verbatim.item_id)
"""
