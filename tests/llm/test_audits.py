"""Filter audits, token counts and repaired conversations, against brute force and the queries' own SQL."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import pytest
from tokenizers import Tokenizer

from cadenza.llm import conversation_repair as repair
from cadenza.llm import filter_audit, token_counts
from cadenza.llm.packing import public_vocabulary
from tests.llm.helpers import SF, corpus, docs

SPACES = b" \t\n\x0b\x0c\r"


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr([r[c] for c in names]) for r in df.collect())


def rows_of_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{rows}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr([r[i] for i in order]) for r in found.fetchall())


def simulated(rows, labels):
    """The audit by dropping documents filter by filter. rows: (doc_id, text, source)."""

    def fails(i):
        doc_id, text, _ = rows[i]
        words = (text or "").encode().split()
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in text or "") > 5 * len(text or "")) + "D" * any(c in "#$%&*|" for c in text or "")
        return out + "E" * any(d is not None and doc_id is not None and d < doc_id and (t or "") == (text or "") for d, t, _ in rows)

    failed = [fails(i) for i in range(len(rows))]
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    found, totals = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {s or "" for *_, s in rows}:
            left = [i for i in range(len(rows)) if (rows[i][2] or "") == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failed[i]]
                left = [i for i in left if f not in failed[i]]
                redundant = sum(f in failed[i] for i in everyone) - len(gone)
                found[part, order, step] = [len(left), len(gone), redundant, sum(failed[i] == f for i in everyone), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
    return {k: [*v, totals[k[0], k[1][k[2] - 1]]] for k, v in found.items()}


def test_filter_audit_matches_a_simulation(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["ab", "Cd", "EF", "x#", "y", f"w{rng.randint(0, 99)}"]) for _ in range(rng.choice([0, 3, 49, 50, 51, 80])))
    texts = [text() for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(40)] + [None, None, "", " \t", "\xa0 É" * 30, "AB" * 5000]
    rows = [(rng.choice([i, i, i, 7, None]), t, rng.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (min(i for i, *_ in rows if i is not None), rows[3][1], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 100, 2), 4, 4, None]]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, digest string, n long, A long")
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(table, known).collect()}
    assert found == simulated(rows, labels) and len(found) == 3 * 600


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], none.schema)
    assert {r["removed"] for r in filter_audit.audit(one, labels.limit(0)).filter("step = 1 and filter_order like 'A%'").collect()} == {1}


@pytest.mark.parametrize("name", ["op11", "op13"])
def test_queries_match_their_sql(spark, name):
    query, sql, tables = {
        "op11": (filter_audit.op11_filter_interaction_audit, filter_audit.OP11_SQL, ["documents", "labels"]),
        "op13": (repair.op13_conversation_structure_repair, repair.OP13_SQL, ["conversations"]),
    }[name]
    assert rows_of(query(spark, SF)) == rows_of_sql(sql, **{t: f"{SF}/{t}.parquet" for t in tables})


ODD = ["a", "B", "İ", "ß", "é", "é", "́", " ", "\n", "\x1c", "\x85", "　", "'s", "'S", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "1", "٣", "Ⅷ", "漢字", "Σ", "ς", "!", "'", "’s", "\U0001f600", "‍", "﻿", "\x00", "don't", "ǅ", "ﬁ", "가", "K", "-", "\xad", "</w>", "Ġ"]


def test_token_counts_are_the_librarys(spark):
    rng = random.Random(3)
    texts = corpus(2) + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += ["x" * 5000 + " y" * 3000, "漢" * 3000, "<|endoftext|>" * 2100, "word " * 2048, "word " * 2049, None]
    ids = [*range(len(texts) - 2), 5, None]
    library = Tokenizer.from_file(public_vocabulary())
    expected = sorted((repr(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in zip(ids, texts))
    found = token_counts.token_counts(docs(spark, texts, ids).withColumnRenamed("key", "n_tokens"), public_vocabulary())
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect()) == expected
    assert token_counts.token_counts(docs(spark, []), public_vocabulary()).count() == 0


def test_token_counts_of_the_query(spark):
    library = Tokenizer.from_file(public_vocabulary())
    expected = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.op12_token_counts(spark, SF).collect()} == expected


def test_whole_tokens_are_single_and_are_not_merged():
    library, whole = Tokenizer.from_file(public_vocabulary()), token_counts.whole_tokens(public_vocabulary())
    assert len(whole) > 30_000 and all(len(e.ids) == 1 for e in library.encode_batch(sorted(whole), add_special_tokens=False))
    counter = token_counts.Counter(public_vocabulary(), whole)
    assert counter.counts([" ".join(sorted(whole)[::50])]) == [len(sorted(whole)[::50])] and counter.merged == 0


def cheapest(rows):
    """(cost, audit, said) of rows (role, text, fault) by trying all edits, with at most two insertions in a row."""
    best = 2 * len(rows), "D" * len(rows), []

    def fits(roles):
        initials = "".join(r[:1] or "?" for r in roles)
        rest = initials.removeprefix("s") if len(initials) > 1 else initials
        return rest == "ua" * (len(rest) // 2) and (rest or not initials)

    def choices(row):
        role, text, fault = row
        yield "D", 2, None
        if fault in ("none", "truncated"):
            more = 5 * (fault == "truncated")
            yield "K", more, (role, text)
            for other in ("user", "assistant"):
                yield "R", 1 + more, (other, text)

    def walk(i, cost, audit, said, inserted):
        nonlocal best
        if cost > best[0]:
            return
        roles = [r for r, _ in said]
        if i == len(rows) and fits(roles) and (cost, audit) < best[:2]:
            best = cost, audit, said
        if inserted < 2:
            for r in ("user", "assistant"):
                walk(i, cost + 5, audit + "I", [*said, (r, "")], inserted + 1)
        if i < len(rows):
            for edit, more, out in choices(rows[i]):
                walk(i + 1, cost + more, audit + edit, said if out is None else [*said, out], 0)

    walk(0, 0, "", [], 0)
    return best


def damaged_rows(rows):
    """The damage by its definition: rows (conv_id, turn, role, text) to (turn, role, text) by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        found = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        found += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def expected_repair(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.encode().strip(SPACES)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1:] not in (b".", b"!", b"?") else "none")
        seen.add((role, text))
    cost, audit, said = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()]


def test_repairs_match_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 3, 2, None]), role, rng.choice(["Yes.", "No", "Why?\n", "\xa0", " \t", None, f"{turn}!", "a. b"])))
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "z", True) for r in rows], "conv_id long, turn long, role string, text string, place int, fault string, gone boolean")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {r["conv_id"]: [r[c] for c in names] for r in repair.audited(repair.damaged(table)).collect()}
    assert found == {c: expected_repair(v) for c, v in damaged_rows(rows).items()}
    assert repair.audited(repair.damaged(table.limit(0))).count() == 0


def test_a_conversation_without_rows_after_damage(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(1, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert repair.audited(repair.damaged(table)).first()[:] == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_automaton_stays_small_and_looks_up():
    automaton, rng = repair.Automaton(), random.Random(2)
    for _ in range(200):
        state = automaton.end
        for _ in range(50):
            state, _ = automaton.before(state, rng.choice("suax"), rng.randrange(4))
    known, states = len(automaton.table), len(automaton.states)
    assert states <= 64 and known <= 16 * states
    assert all(min(s) == 0 and max(s) <= 4 * repair.INSERT for s in automaton.states)


def test_edits_are_rows_in_order(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "R."), (1, 3, "user", "cut"), (2, 0, "assistant", "A.")]
    table = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    found = {c: [tuple(r)[2:] for r in sorted(repair.repaired(table).filter(f"conv_id = {c}").collect(), key=lambda r: r["n"])] for c in (1, 2)}
    assert found == {1: [("K", 0, "system", "S."), ("K", 0, "user", "Q?"), ("R", 1, "assistant", "R."), ("D", 2, None, "cut")], 2: [("D", 2, None, "A.")]}


def test_long_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(30_000)]
    table = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    found = repair.audited(table).first()
    assert (found["cost"], found["audit"]) == (0, "K" * 30_000)
