"""Chat formatting, decontamination, SimHash, toxicity, language ID, HTML, packing and the pipeline."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import chat_format, decontamination, edited, html_extraction, language_id, maxscore, packing, simhash, suffix_dedup, toxicity
from tests.llm.helpers import SCHEMA, SF, corpus, docs

MESSAGES = "tree long, node long, parent long, score double, role string, text string, t string, known string"


def test_reply_trees_give_every_path(spark):
    rng = random.Random(1)
    rows = []
    for tree in (1, 2, None):
        rows += [(tree, i, rng.randrange(i) if i > 1 else None, float(rng.randint(0, 5)), rng.choice(["user", "assistant", None]), rng.choice(["a\\#<b", "</turn>\n### x: ", None, ""])) for i in range(1, 30)]
    rows += [(9, 1, 2, 1.0, "user", "c"), (9, 2, 1, 1.0, "user", "d"), (5, 1, 77, None, "a:b\n", "orphan")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], MESSAGES)
    expected = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        inner = {r[2] for r in own.values()}
        found = []
        for leaf in own.keys() - inner:
            path, at = [], leaf
            while at in own:
                path.insert(0, own[at])
                at = own[at][2]
            found.append((-sum(r[3] or 0.0 for r in path), leaf, [(r[4] or "", r[5] or "") for r in path]))
        expected += [(tree, leaf, rank, *chat_format.formatted(turns)) for rank, (_, leaf, turns) in enumerate(sorted(found), 1) if rank <= 3]
    got = [(r["tree"], r["leaf"], r["rank"], r["conversation"], [(s["start"], s["end"]) for s in r["loss_spans"]]) for r in chat_format.format_trees(df, 3).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    for _, _, _, text, _ in got:
        assert chat_format.formatted(chat_format.parsed(text))[0] == text
    assert chat_format.format_trees(df.filter("false")).count() == 0


def test_long_conversations_and_odd_turns(spark):
    """2,000 turns in one conversation, a hot one with null turns, roles, texts and repeats, a null conv_id, and columns with clashing names."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(2000)]
    rows += [(2, t, r, x) for t in (None, 3, 3, 1) for r in ("assistant", None, "") for x in ("<b>", None, "")]
    rows += [(None, 1, "user", "a"), (None, 0, "assistant", "#")]
    df = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, tree long, node long, up string")
    found = {r["tree"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in chat_format.read_back(chat_format.format_trees(chat_format.from_turns(df), 1)).collect()}
    order = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        expected = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        assert found[conv] == (expected, "".join(x for role, x in expected if role == "assistant"))
    assert len(found) == 3 and chat_format.format_trees(chat_format.from_turns(df.filter("false")), 1).count() == 0


def test_decontamination(spark):
    item = "Alice buys 3 apples and 4 pears from the market near Paris, then walks 12 km home with all of them."
    texts = [
        f"before {item} after",
        item.replace("Alice", "Bob").replace("3", "17").replace("12 km", "9 miles").replace("Paris", "Rome"),
        "Alice buys 3 apples and 4 pears from the market",
        "three words only", None, "", "nothing of the kind is said in this clean text about apples and the market", "THREE words only!",
    ]
    items = spark.createDataFrame([(1, item, "x"), (2, "three words only", "x"), (3, None, "x"), (None, item, "x"), (1, item, "x")], "item_id long, text string, key string")
    for bound in (1 << 26, 0):
        found = sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, texts), items, broadcast_bytes=bound).collect())
        assert found == [(0, 1), (1, 1), (3, 2), (7, 2)]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs(spark, texts), items).collect()) == [2, 4, 5, 6]
    assert decontamination.leaks(docs(spark, texts).filter("false"), items).count() == 0 == decontamination.leaks(docs(spark, texts), items.filter("false")).count()


def test_slots_must_be_consistent(spark):
    item = "when x is 5 and y is 5 then the sum of 5 and 5 is a number that we call n"
    good, bad = item.replace("5", "8"), "when x is 1 and y is 2 then the sum of 3 and 4 is a number that we call n"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.leaks(docs(spark, [good, bad]), items).collect()] == [0]


def test_copies_with_different_fillings_in_one_text(spark):
    item = "Alice buys 3 apples and 4 pears from the market near Paris, then walks 12 km home with all of them."
    fill = lambda name, a, b, place, way: item.replace("Alice", name).replace("3", a).replace("4", b).replace("Paris", place).replace("12 km", way)
    one, two = fill("Bob", "17", "20", "Berlin", "9 miles"), fill("Carol", "12", "35", "Rome", "8 hours")
    spread = lambda text: text.replace("market", "market (which was, as on any other day of that long and hot summer, quite full of people)")
    texts = [one, two, f"{one} {two}", f"{item} and so on {one}", f"{two}\n{item}\n{one}\n{two}", f"{one} {spread(two)} {item}", f"{one[:60]} {two[60:]}", f"{one[:40]} {two[:40]} {item[:40]}"]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for bound in (1 << 26, 0):
        found = {r["doc_id"]: r["consistent"] for r in decontamination.leaks(docs(spark, texts), items, broadcast_bytes=bound).collect()}
        assert {d: n for d, n in found.items() if d < 6} == dict.fromkeys(range(6), 17) and 7 not in found
    hits = [(p, p % 40, p % 40, (str(p % 40),), (str(p),)) for p in range(4000)]
    assert decontamination.best_consistent(hits, 32) == 40 and decontamination.best_consistent(hits[:35:2], 32) == 18


def test_common_windows_ties_and_long_texts(spark):
    """Items that share a hot window of five numbers; a tied vote; a text of 60,000 words that holds an item."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfg") for _ in range(5))
    items = [f"{' '.join(word() for _ in range(8))} 1 2 3 4 5 6 {' '.join(word() for _ in range(8))}" for _ in range(40)] + ["1 2 3 4 5 6 7", "see x be 5 and 5 then stop"]
    texts = [f"{word()} 7 8 9 10 11 12 13 {word()}" for _ in range(300)] + [items[3].replace("1 2 3", "9 8 7"), " ".join(word() for _ in range(30_000)) + f" {items[7]} " + " ".join(word() for _ in range(30_000))]
    texts += ["see x be 6 and 7 then stop", "see x be 7 and 7 then stop"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bound in (1 << 26, 0):
        found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(spark, texts), table, broadcast_bytes=bound).collect()}
        # All windows of item 40 have one template. The tied vote keeps the windows with the usual value only: too few.
        assert found == {(i, 40) for i in range(302)} | {(300, 3), (301, 7), (303, 41)}, found


def test_short_items_are_found_inside_texts(spark):
    """Items of one to four tokens stand word for word in a text, at its ends too; another number or order isn't the item."""
    items = ["How many are 7", "blue whale", "Zürich", "42 km", "", None, "!", "blue whale"]
    texts = ["x y how many are 7, then z", "how many are 8 of them", "How many are 9", "a blue, WHALE", "whale blue", "in zürich and zürich", "it is 42 km", "it is 43 km and 42 m", None, "", "blue whale"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bound in (1 << 26, 0):
        rows = decontamination.leaks(docs(spark, texts), table, broadcast_bytes=bound).collect()
        assert {(r["consistent"], r["share"]) for r in rows} == {(1, 1.0)}
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(0, 0), (2, 0), (3, 1), (3, 7), (5, 2), (6, 3), (10, 1), (10, 7)]


def test_short_items_in_the_query_and_its_sql(spark, tmp_path):
    texts = ["a blue whale swims", "blue whale", None, "it is 42 km to that place where all of us will meet some day", "the blue fish"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Blue whale!"), (2, texts[3]), (3, "42 km"), (None, "blue")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = decontamination.op3_benchmark_decontamination(spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(decontamination.OP3_SQL).fetchall())
    assert found.count() == 4


def test_repeated_templates_are_counted_by_slot():
    """The same as by hit and place; 1,000 numbers against 20,000 take seconds."""
    rng = random.Random(3)
    for _ in range(400):
        value = lambda: rng.choice("123")
        group = []
        for name in range(rng.randint(2, 4)):
            width = rng.randint(0, 2)
            places = [{"item_pos": q, "item_slots": [value() for _ in range(width)]} for q in rng.sample(range(9), rng.randint(1, 4))]
            group += [{"pos": p, "hash": name, "slots": [value() for _ in range(width)], "places": places} for p in rng.sample(range(12), rng.randint(1, 4))]
        tuples = [(h["pos"], p["item_pos"], h["hash"], tuple(p["item_slots"]), tuple(h["slots"])) for h in group for p in h["places"]]
        for needed in (1.6, 3):
            assert decontamination.consistent(group, needed) == decontamination.best_consistent(tuples, needed)
    began = time.time()
    numbers = lambda n, least: [str(x) for x in range(least, least + n)]
    item, text = numbers(1000, 0), numbers(20_000, 5000)
    places = [{"item_pos": q, "item_slots": item[q : q + 5]} for q in range(996)]
    assert decontamination.consistent([{"pos": p, "hash": 1, "slots": text[p : p + 5], "places": places} for p in range(19_996)], 0.8) == 1
    assert time.time() - began < 10
    one = lambda values, held: decontamination.consistent([{"pos": 0, "hash": 1, "slots": held, "places": [{"item_pos": 0, "item_slots": values}]}], 0.8)
    assert one(["1", "1"], ["2", "3"]) == 0 and one(["1", "2"], ["3", "3"]) == 1


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 2, 3, 4)] + [0, 1 << 63, (1 << 63) | 3]
    fps += [base[0]] * 3
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    root = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    from cadenza.llm.components import connected_components

    node = {r["node"]: r["component"] for r in connected_components(simhash.links(df, 2)).collect()}
    groups = {}
    for i, f in rows:
        groups.setdefault(node.get(f, f), []).append(i)
    assert sorted(groups.values()) == sorted([i for i, r in enumerate(root) if r == k] for k in set(root))
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_fingerprints_from_the_definition(spark):
    """Bits counted one by one, with whole long texts."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Aa", "b", "Éé", "c\x0bd", "E\u00a0f", "g"]) for _ in range(k)) for k in (0, 1, 2, 3, 4, 50, 30_000)] + [None, "\t \r", "X y z"]
    expected = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
        expected.append(f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}")
    found = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_simhash_edge_cases(spark):
    texts = ["a b c d e", "A b\tC d  e", None, "", "zz", None]
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts, [5, 3, 8, 9, 1, None])).collect())
    zero = "0" * 16
    assert [x for x in found if x[1] == zero] == [(-1, zero, 8), (8, zero, 8), (9, zero, 8)]
    assert [x[2] for x in found if x[0] in (3, 5)] == [3, 3]
    assert sorted(r["doc_id"] for r in simhash.representatives(docs(spark, texts, [5, 3, 8, 9, 1, None])).collect()) == [1, 3, 8]
    assert simhash.near_duplicates(docs(spark, texts).filter("false")).count() == 0


def test_edited_copies_leave_the_pipeline(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    line = " ".join(word() for _ in range(12))
    texts = [None, "", "one", "two words here"]
    for n in (30, 120, 400, 3000):
        text = [word() for _ in range(n)]
        for edits in (0, 1, n // 60, n // 45, n // 30, n // 12):
            copy = list(text)
            for at in rng.sample(range(n), edits):
                copy[at] = rng.choice([word(), "", "x y"])
            texts.append(" ".join(copy) + " " + line)
    crowd = [word() for _ in range(60)]
    texts += [" ".join([*crowd, f"v{i}"]) for i in range(90)] + [f"{line} {word()} {word()}" for _ in range(90)]
    sets = [set(zip(*[(t or "").split()[k:] for k in range(min(5, len((t or "").split())))])) for t in texts]
    near = lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    before = {r["doc_id"] for r in corpus_pipeline.deduplicated(spark, docs(spark, texts), SF).collect()}
    kept = {r["doc_id"] for r in stage(spark, docs(spark, texts), SF).collect()}
    assert kept < before and not any(near(a, b) for a, b in itertools.combinations(sorted(kept), 2))
    assert all(any(near(a, b) for a in before if a < b) for b in before - kept)
    assert stage(spark, docs(spark, texts).filter("false"), SF).count() == 0


def test_bitmaps_differ_in_no_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 700, 20_000):
        hashes = np.unique(rng.integers(0, 1 << 63, n + 200, dtype=np.uint64) << np.uint64(1))
        one, two = hashes[: n + 100], hashes[rng.integers(0, 100) :]
        bits = sum(int(x).bit_count() for x in (edited._bitmap(one) ^ edited._bitmap(two)).view(np.uint64))
        assert bits <= len(set(one.tolist()) ^ set(two.tolist())) and (n == 20_000 or bits)
        assert len(edited._bitmap(one)) == 32 and not (edited._bitmap(one) ^ edited._bitmap(one[::-1])).any()


@pytest.mark.parametrize("block", [32, 0])
def test_top_k_matches_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 12) / 4]) for i in range(300)] + [(300, None), (301, [float("nan")] * 12), (302, [None] * 12)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    items = df.select("id", maxscore.quantised(F.col("embedding"), 256).alias("vector"))
    found = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in maxscore.top_k(items, items.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, block).collect())
    table = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:300]}
    expected = []
    for q in range(0, 300, 20):
        best = sorted((-int(table[q] @ table[i]), i) for i in table if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == expected
    assert maxscore.top_k(items.filter("id = 0"), items.filter("id = 0").withColumnRenamed("id", "query_id")).count() == 0
    assert maxscore.top_k(items.filter("false"), items.filter("false").withColumnRenamed("id", "query_id")).count() == 0


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(3000)}" if rng.random() < 0.5 else rng.choice("abcdefgh") * 3 for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["Idiot!", "scum", "clown,"])
        texts.append(" ".join(words))
        labels.append((i, None if i == 1 else int(rng.random() < 0.8), int(bad)))
    labels += [(0, 1, 0), (None, 1, 1), (10_000, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs(spark, texts), table.filter("doc_id < 400 or doc_id is null"), ["quality", "toxic"])
    found = {r["doc_id"]: r for r in toxicity.score(docs(spark, [*texts, None, ""]), chain).collect()}
    assert sum(found[i]["toxic"] == (i % 4 == 0) for i in range(400, 600)) >= 195
    assert not found[600]["toxic"] and not found[601]["toxic"] and found[600]["lang"] == "en"
    assert toxicity.score(docs(spark, texts).filter("false"), chain).count() == 0
    clash = spark.createDataFrame([(1, "idiot " * 50_000, 7.0, "x")] * 2, "doc_id long, text string, p_quality double, toxic string")
    assert [r["toxic"] for r in toxicity.score(clash, chain).collect()] == [True, True]
    p = toxicity.score(clash, chain).first()["p_toxic"]
    assert toxicity.score(clash, chain, p).first()["toxic"] and not toxicity.score(clash, chain, p + 1e-9).first()["toxic"]  # a tie reaches the threshold
    none = toxicity.fit_chain(docs(spark, texts), table.filter("false"), ["quality", "toxic"])
    assert {r["toxic"] for r in toxicity.score(docs(spark, texts[:3]), none).collect()} == {False}


def test_top_k_of_repeated_short_and_large_vectors(spark, tmp_path):
    """Against the query's own SQL: repeated rows (also of a query), shorter vectors, infinities; scores beyond 64 bits are refused."""
    inf = float("inf")
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [2.0, 0.5]), (1, [2.0, 0.5]), (2, [2.0, 0.5]), (3, [inf, 1.0]), (4, [-inf, 1.0]), (5, None), (50, [0.0, 0.0]), (51, [-3.0, 9.0]), (None, [9.0, 9.0])]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, vector string, score int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names = ["query_id", "rank", "vec_id", "score"]
    found = sorted(tuple(r[n] for n in names) for r in maxscore.op5_exact_top_k(spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({maxscore.OP5_SQL})").fetchall()) and len(found) == 10
    short = spark.createDataFrame([(1, [3]), (2, [1, 1, 7]), (3, [])], "id long, vector array<long>")
    asked = spark.createDataFrame([(9, [2, 5])], "query_id long, vector array<long>")
    assert [(r["id"], r["score"]) for r in maxscore.top_k(short, asked).orderBy("rank").collect()] == [(2, 7), (1, 6), (3, 0)]
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>").select("id", maxscore.quantised(F.col("embedding"), 256).alias("vector"))
    with pytest.raises(ValueError):
        maxscore.top_k(huge, huge.withColumnRenamed("id", "query_id"))


def test_outliers_in_other_components_are_no_reason_to_refuse(spark):
    items = spark.createDataFrame([(1, [0, 2**31]), (2, [1, 1]), (3, [-1, 2**62]), (4, [3, -(2**61)])], "id long, vector array<long>")
    asked = spark.createDataFrame([(9, [2**33, 0]), (8, [-(2**60), 0])], "query_id long, vector array<long>")
    found = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in maxscore.top_k(items, asked, 2).collect()}
    assert found == {(9, 1): (4, 3 * 2**33), (9, 2): (2, 2**33), (8, 1): (3, 2**60), (8, 2): (1, 0)}


def test_out_of_fold_models_do_not_see_their_fold(spark):
    """Each fold's model, refit by hand from the other folds' rows alone; a word of one fold's positives is no input of its model."""
    rng = random.Random(9)
    rows = []
    for i in range(240):
        fold, y = i % 3, int(rng.random() < 0.4)
        words = {rng.choice("abcdefghij") for _ in range(5)} | ({f"only{fold}"} if y else set()) | ({"bad"} if y and rng.random() < 0.9 else set())
        rows.append((i, sorted(words), fold, y, rng.random()))
    df = spark.createDataFrame(rows, "id long, words array<string>, fold int, toxic int, p_quality double")
    links = toxicity._links(df, "toxic", ["quality"], 3, 50, 512)
    for m in range(4):
        own = [r for r in rows if r[2] != m]
        share = sum(r[3] for r in own) / len(own)
        n, hit = Counter(w for r in own for w in r[1]), Counter(w for r in own if r[3] for w in r[1])
        related = lambda w: abs(hit[w] - n[w] * share) / (n[w] * (1 - n[w] / (len(own) + 1.0))) ** 0.5  # noqa: E731, B023
        best = sorted((w for w in n if n[w] > 1), key=lambda w: (-related(w), w))  # noqa: B023
        assert m == 3 or f"only{m}" not in best
        place = {w: i for i, w in enumerate(best)}
        weights, before, base = toxicity.fit_logistic([np.array([place[w] for w in r[1] if w in place]) for r in own], np.array([[r[4]] for r in own]), np.array([float(r[3]) for r in own]), len(best), len(best))
        expected = {w: x for w, x in zip(best, weights) if x}
        assert links[m].weights == pytest.approx(expected, abs=1e-6) and expected
        assert links[m].before == pytest.approx(list(before), abs=1e-6) and links[m].intercept == pytest.approx(base, abs=1e-6)
    constant = toxicity._links(df.filter("fold = 1 or toxic = 1"), "toxic", [], 3, 50, 512)
    assert constant[1].weights == {} and constant[1].intercept == 35.0 and constant[3].weights


def test_language_id_on_held_out_documents(spark):
    rows = language_id.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    model = language_id.learned(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)
    rng = random.Random(6)
    letters = {"latin": [chr(c) for c in range(97, 123)] + [" "] * 4, "greek": [chr(c) for c in range(0x3B1, 0x3CA)] + [" "] * 4, "han": [chr(c) for c in range(0x4E00, 0x5E00)]}
    strange = ["".join(rng.choice(x) for _ in range(k)) for x in letters.values() for k in (60, 1000, 20_000)]
    polish = "w nie na się że do jest to po jak ale za od który przez był oraz może tylko wszystko człowiek państwo źródło".split()
    strange += [" ".join(rng.choice(polish) for _ in range(k)) for k in (30, 3000)]
    assert all(r["rejected"] for r in language_id.identify(docs(spark, strange), model).collect())
    clash = spark.createDataFrame([(1, "the of and", "old", 9.0, "x")] * 2, "doc_id long, text string, lang_pred string, score double, rejected string")
    assert [tuple(r)[:3] for r in language_id.identify(clash, model).collect()] == [(1, "the of and", "en")] * 2 and language_id.identify(clash.filter("false"), model).count() == 0
    none = language_id.train(docs(spark, ["x"]).filter("false"))
    assert [(r["lang_pred"], r["rejected"]) for r in language_id.identify(clash, none).collect()] == [("und", True)] * 2
    odd = {r["doc_id"]: r for r in language_id.identify(docs(spark, [None, "", "123 !?", "你好" * 20, "the of and"]), model).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(odd[i]["rejected"] for i in range(4)) and odd[4]["lang_pred"] == "en"


PAGE = """<!doctype html><title>no</title><style>p{}</style><script>"</p>"</script><body><h1>Head <b>line</h1><p>one<br>two<p>three
 four<!-- c --><ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><div hidden>no</div><div style="display: none">no</div><span style="visibility:hidden">no<i style="visibility:visible">yes</i></span>
<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide</table><pre>  a
   b</pre><select><option>p<option selected>q</select><details><summary>s</summary>no</details>&lt;end&gt;"""


def test_rendering():
    expected = "Head line\n\none\ntwo\n\nthree four\n\n- a\n- b\n  3. x\n  4. y\n\nyes\n\nName       N\nlong name  1\nwide\n\n  a\n   b\n\nq\ns\n<end>"
    found = html_extraction.render(PAGE)
    assert found == expected, found  # blank lines and columns included
    assert html_extraction.render(None) == html_extraction.render("") == html_extraction.render("<p hidden>x") == ""
    assert html_extraction.render("<div>" * 3000 + "deep") == "deep"
    assert html_extraction.render("<table>out<tr><td>in</table>").split() == ["out", "in"]


def test_style_rules():
    css = "/* .a{display:none} */ .x, p.y {display : none} #z{visibility:hidden} @media print{.m{display:none}} @import 'a'; b{display:none} b.on{display:inline} div p{display:none} .t{xdisplay:none}"
    page = f"<style>{css}</style><div class='q x'>1</div><p class=y>2<p class=m>3<span class=y>4</span><i id=z>5<u style='visibility:visible'>6</u></i><b>7</b><b class=on>8</b><b style='display:inline'>9</b><div><p>10</div><p class=t>11"
    assert "".join(html_extraction.render(page).split()) == "346891011"


def test_block_spacing():
    r = html_extraction.render
    assert r("<p>a</p>\n\n<p>b") == "a\n\nb" and r("<div>a</div><div>b") == "a\nb" and r("a<br><br>b") == "a\n\nb"
    assert r("<h1>t</h1>x<ul><li>a<ul><li>b</ul><li>c</ul>y") == "t\n\nx\n\n- a\n  - b\n- c\n\ny"
    assert r("<blockquote>a<p>b</blockquote>c") == "  a\n\n  b\n\nc" and r("<ol><li>a<br>b<li>c</ol>") == "1. a\n   b\n2. c"
    assert r("a  \n b<span> c</span> <b>d </b> e") == "a b c d e" and r("<pre>a\n\n  b</pre>c") == "a\n\n  b\n\nc"


def test_tables_match_a_plain_layout():
    """Cells without spans, laid out a second time from their texts alone."""
    rng = random.Random(2)
    for _ in range(60):
        cells = [["" if rng.random() < 0.15 else "\n".join("w" * rng.randint(1, 12) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        ends = rng.random() < 0.5
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c.replace(chr(10), '<br>')}" + "</td>" * ends for c in row) + "</tr>" * ends for row in cells) + "</table>"
        pad = rng.choice([6, 80])
        width = [max([len(x) for row in cells if i < len(row) for x in row[i].split("\n") if len(x) <= pad], default=0) for i in range(5)]
        out = []
        for row in cells:
            for k in range(max(c.count("\n") + 1 for c in row)):
                line = ""
                for i, c in enumerate(row):
                    part = (c.split("\n")[k : k + 1] or [""])[0]
                    if part:
                        left = sum(width[:i]) + 2 * i
                        line = (line.ljust(left) if len(line) <= left else line + "  ") + part
                out.append(line.rstrip())
        assert html_extraction.render(html, pad) == "\n".join(out).strip("\n")


def test_deep_pages_take_linear_time():
    began = time.time()
    for tag in ("div", "b", "p", "li", "span", "ul><li", "blockquote", "x-y"):
        assert html_extraction.render(f"<{tag}>" * 50_000 + "deep" + f"</{tag.split('>')[0]}>" * 50_000).endswith("deep")
    assert html_extraction.render("<table><td>" + "<i>" * 50_000 + "deep" + "</u></b></p>" * 50_000).startswith("deep")
    assert html_extraction.render("<ol>" + "<li>x" * 20_000).count("\n") == 19_999
    assert time.time() - began < 60


def test_odd_style_text_and_tags_take_linear_time():
    began = time.time()
    r = html_extraction.render
    for css in ("x" * 200_000, "@" * 200_000, "a{" * 100_000, "@media{" * 50_000, "}" * 200_000, "@a}" * 100_000):
        assert r(f"<style>{css}</style>text") == "text"
    assert r("<a " * 100_000).count("<a") == 100_000 and r("<p>x</p>a < b &amp; <b") == "x\n\na < b & <b"
    assert r("<!-- > no <b") == r("<!-- > no <b", 80)
    assert time.time() - began < 20


def test_style_text_against_patterns():
    """Rules and at-rules as two backtracking patterns find them, on short texts."""
    rng = random.Random(8)
    for _ in range(3000):
        css = "".join(rng.choice(["a", ".b", "@m ", "{", "}", ";", "display:none", ",", " "]) for _ in range(rng.randint(0, 14)))
        depth, start, flat = 0, 0, []
        for m in re.finditer(r"@[^{};]*[;{]|[{}]", css):
            if depth == 0 and m[0][0] == "@":
                flat.append(css[start : m.start()])
                start, depth = m.end(), int(m[0][-1] == "{")
            elif depth:
                depth += {"{": 1, "}": -1}.get(m[0][-1], 0)
                start = m.end()
        plain = "".join([*flat, css[start:] if not depth else ""])
        assert html_extraction._flat(css) == plain, css
        gone = {x.strip() for sel, body in re.findall(r"([^{}]*)\{([^{}]*)\}", plain) if re.search(r"(?<![\w-])display:none(?![a-z-])", body) for x in sel.split(",")}
        rules = html_extraction.Styles([css]).rules
        assert {k for k in ("a", ".b") if any(rule[1:3] == (("a", set()) if k == "a" else ("*", {".b"})) and rule[3] == {"display": "none"} for rule in rules.get(k, ()))} == gone & {"a", ".b"}, css


def test_blanks_grow_with_the_cells():
    wide = "<tr>" + "".join(f"<td>{'w' * 80}" for _ in range(1000))
    page = f"<table>{wide}" + "<tr><td colspan=999><td>x" * 2000 + "<tr><td>a<td>b</table>"
    out = html_extraction.render(page)
    assert len(out) < 1002 * 2000 + 90_000 and out.count("x") == 2000 and out.endswith("a" + " " * 81 + "b") and out.count("w") == 80_000
    assert html_extraction.render("<table><tr><td>ab<td>cd<td>e<tr><td>a<td>b<td>c</table>", reach=3) == "ab  cd  e\na  b  c"


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "old"), (1, "<p>x</p>", "old"), (None, None, "old")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_extraction.extract(df).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert html_extraction.extract(df.filter("false")).count() == 0


def test_packing_round_trip(spark):
    texts = [t for t in corpus(7)] + ["Ünïcödé don't 12,345 <|endoftext|> 你好", "it's\x1cok"]
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(docs(spark, texts), None, 256, 2000).collect()
    own, rooms = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(expected[r["doc_id"]])
        own.setdefault(r["doc_id"], []).append((r["start"], ids))
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in own.items()} == expected
    for pieces in rooms.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    assert packing.pack(docs(spark, texts).filter("false")).count() == 0


def test_neighbours_and_filling_match_brute_force():
    rng = np.random.default_rng(5)
    texts = [rng.integers(2, 40, rng.integers(0, 60)).tolist() + [1] for _ in range(30)]
    df = np.array([max(1, sum(t in x for x in texts)) for t in range(40)])
    idf, mean = np.log(1 + (30 - df + 0.5) / (df + 0.5)), sum(map(len, texts)) / 30
    arrays = [np.array(x, dtype="<u4") for x in texts]
    index = packing.Index(arrays, idf, mean)

    def bm25(a, b):
        return sum(idf[t] * texts[b].count(t) * 2.2 / (texts[b].count(t) + 1.2 * (0.25 + 0.75 * len(texts[b]) / mean)) for t in set(texts[a]) if t in texts[b])

    for seed in range(30):
        unused = rng.random(30) < 0.7
        expected = sorted(np.flatnonzero(unused).tolist(), key=lambda d: (-round(bm25(seed, d), 9), d))  # noqa: B023
        assert [round(bm25(seed, d), 9) for d in index.neighbours(seed, unused)] == [round(bm25(seed, d), 9) for d in expected]
    # Greedy filling, said again: a cut document or the first unused one, then its best unused neighbours.
    unused, sequences, cut = np.ones(30, dtype=bool), [], None
    while cut is not None or unused.any():
        seed, at = cut or (int(np.argmax(unused)), 0)
        unused[seed] = False
        room, pieces, cut = 64, [], None
        for doc in [seed, *index.neighbours(seed, unused).tolist()]:
            begin = at if doc == seed else 0
            n = min(room, len(texts[doc]) - begin)
            unused[doc] = False
            pieces.append((doc, begin, n))
            room -= n
            if begin + n < len(texts[doc]):
                cut = (doc, begin + n)
            if not room:
                break
        sequences.append(pieces)
    found = {}
    for doc, start, n, sequence, offset in packing.fill(arrays, index, 64):
        assert offset == sum(x[2] for x in found.get(sequence, []))
        found.setdefault(sequence, []).append((doc, start, n))
    assert [found[i] for i in range(len(sequences) - 1)] == sequences[:-1]
    assert sum(x[2] for p in list(found.values())[len(sequences) - 1 :] for x in p) == sum(x[2] for x in sequences[-1])


def test_like_documents_share_a_shard(spark):
    """Documents with a planted passage lie in the shards of their likes, in a corpus of many shards; null ids, repeated rows and a document longer than a shard are packed whole."""
    rng = random.Random(3)
    known = sorted(t.removesuffix("</w>") for t in Tokenizer.from_file(packing.public_vocabulary()).get_vocab() if re.fullmatch("[a-z]{5,}</w>", t))
    rng.shuffle(known)
    words, rare = known[:1500], known[1500:4500]
    plain = lambda k: " ".join(rng.choice(words) for _ in range(k))
    strange = [" ".join(rng.choice(rare) for _ in range(40)) for _ in range(20)]
    texts = [f"{plain(60)} {strange[i % 20] if i < 200 else ''} {plain(60)}" for i in range(600)] + [plain(4000), None, None, "x", "x"]
    ids = [*range(600), 600, None, None, 7, 7]
    rows = packing.pack(docs(spark, texts, ids), None, 2048, 4000).collect()
    place = {}
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_tokens"] > 2:
            place.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    near = [bool(place[a] & place[b]) for k in range(20) for a in range(k, 200, 20) for b in range(a + 20, 200, 20)]
    far = [bool(place[a] & place[a + 1]) for a in range(199)]
    assert sum(near) / len(near) > 0.5 > 5 * sum(far) / len(far), (sum(near) / len(near), sum(far) / len(far))
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    sizes = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(sizes) == sum(r["length"] for r in rows) and sum(r["start"] == 0 for r in rows) == len(texts)


def test_ids_of_odd_texts_are_the_tokenizers():
    """Ids of plain words come from the vocabulary rebuilt for bulk merging; here they are compared with the tokenizer itself."""
    rng = random.Random(7)
    signs = "abcdefgzABCXYZ0189 \t\n.,;:!?'\"()<|>-_/#@$%&*+=~^`{}[]\\" + "éüßñçøÅÉœŠž\u0301\u00a0\u2028\u3000你好日本кириллα👍\x1c\x85\u200d"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["<|endoftext|>", "don't we'll I'D", "x" * 5000, "\u00e9" * 300]
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    for text, ids in zip(texts, packing.token_ids(texts, packing.public_vocabulary())):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_words_of_a_slice_are_looked_up_once(monkeypatch):
    """Only the different words of a slice meet the store; slices and a store that begins anew change no ids."""
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    words = packing.Words(packing.public_vocabulary())
    asked = []

    class Counted(dict):
        def get(self, word, *rest):
            asked.append(word)
            return super().get(word, *rest)

    words.known = Counted(words.known)
    texts = ["ab cd, ab  ab"] * 50 + ["x\x1cy ab", "", " "]
    words.ids(pa.array(texts))
    assert len(asked) == len(set(asked)) == 3
    monkeypatch.setattr(packing, "_SLICE", 40)
    monkeypatch.setattr(packing, "_WORDS", 3)
    found = []
    for part in packing.by_bytes(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), 0):
        ids, bounds = words.ids(part.column(0))
        found += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert found == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_pieces_are_merged_once_whatever_stands_around_them():
    """The store holds pieces in lower case, not every word that they make with signs and capitals; contractions and other letters stay words. All ids are the tokenizer's."""
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    words = packing.Words(packing.public_vocabulary())
    texts = ["Étage étage, (ÉTAGE) étage!! 7étage7 étage\u00d72", "étage", "", "don't 'Tis ''s <|endoftext|> <|ENDOFTEXT|> a<b Œuvre œuvre İx x\x00y ×÷ Ǆ", "b\u00a0c\x1cd", "éé"]
    for column in (pa.array(texts), pa.array(["?", *texts]).slice(1), pa.array(texts, pa.large_string())):
        ids, bounds = words.ids(column)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [w for w in words.known if "tage" in w.lower()] == ["étage", "étage\u00d72"]
    for broken in (b"a \xc3 b", b"\x80", b"ab\xe9"):
        with pytest.raises(pa.ArrowException):
            words.ids(pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(broken)], np.int32)), pa.py_buffer(broken)]))


def test_document_frequencies_come_with_the_ids(spark):
    """Documents are counted while they are divided, so their ids aren't read again for it; keys are the rarest ids of two documents or more."""
    texts = [*corpus(5)[:150], None, "", "ab ab", "ab"]
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    expected = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    size = tokenizer.get_vocab_size()
    table = packing.tokenized(docs(spark, texts).repartition(3), packing.public_vocabulary()).cache()
    assert table.filter("counts is not null").count() == 3 and table.filter("n is not null").count() == len(texts)
    found = packing.document_frequencies(table, size)
    df = np.bincount([i for t in expected for i in set(t)], minlength=size)
    assert found.tolist() == df.tolist()
    rows = packing.content_keys(table.filter("n is not null"), found, len(texts), 20).collect()
    assert len(rows) == len(texts)
    for r in rows:
        least = sorted((df[i], i) for i in set(expected[r["doc_id"]][:-1]) if df[i] >= 2)[:3]
        assert r["key"] == [*(i for _, i in least), *[-1] * (3 - len(least))]
        assert r["salt"] == r["part"] % -(-int(least[0][0] if least else len(texts)) // 20)
    table.unpersist()


def test_suffix_stage_needs_one_python_worker_a_task(spark):
    """Two Python steps in a row hold two workers a task, and executors keep them through the later stages."""
    plan = corpus_pipeline.trimmed(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    texts = ["ab" + "é" * 30 + "x", "b" + "é" * 30 + "yé", None]
    found = [
        sorted((r["doc_id"], r["kept"]) for r in suffix_dedup.remove_repeats(docs(spark, texts), 51, 16, as_text=as_text).select("doc_id", "kept").collect()) for as_text in (False, True)
    ]
    assert [(i, bytes(b).decode("utf-8", "ignore")) for i, b in found[0]] == found[1] and all("é" * 30 not in t for _, t in found[1])


def test_pipeline_stages(spark):
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identified(spark, docs_in, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() >= 0.97 * docs_in.count()
    single = corpus_pipeline.deduplicated(spark, docs_in, SF)
    groups = {r["component_id"] for r in simhash.near_duplicates(docs_in).collect()}
    assert {r["doc_id"] for r in single.collect()} == groups
    cut = {r["doc_id"]: r for r in corpus_pipeline.trimmed(spark, docs_in, SF).collect()}
    assert len(cut) == docs_in.count() and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    left = {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs_in, SF).collect()}
    leaked = {r["doc_id"] for r in decontamination.op3_benchmark_decontamination(spark, SF).collect()}
    assert left == set(cut) - leaked and leaked
    table = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1, "k", "x", "y")] * 2, SCHEMA)
    assert corpus_pipeline.deduplicated(spark, table, SF).count() == 1
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_digest_columns_of_chat(spark):
    row = chat_format.op2_chat_formatting(spark, SF).filter("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
