"""Exact duplicates, vector codes and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import rows_of
from cytolake.llm import content_sort, conversation_repair as cr, cover_tree
from cytolake.llm.oracles import EXACT, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- exact duplicates

def brute_groups(rows, largest=True):
    by = {}
    for doc_id, text in rows:
        by.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        left = 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left == 1, hashlib.sha256(text.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=repr)


def test_exact_groups(spark, docs, texts):
    got = content_sort.duplicates(docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups([(r[0], r[1]) for r in texts])


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_a_group_over_many_ranges(spark, keep):
    rng = random.Random(3)
    texts = ["one long common beginning " * 4 + f"{k % 40}" for k in range(400)] + ["Hot TEXT é"] * 700 + ["hot text É"] * 3 + [None, ""] * 40
    rows = [(rng.randrange(10 ** 6) if rng.random() < 0.95 else None, t if rng.random() < 0.5 or t is None else t.translate(LOWER)) for t in texts]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = content_sort.duplicates(df, keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, keep == "largest")


def test_one_of_each_group_stays_whole(docs, texts):
    got = content_sort.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted(r[0] for r in brute_groups([(r[0], r[1]) for r in texts], largest=False) if r[3] and r[0] is not None)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == kept


def test_no_documents_have_no_groups(none):
    assert content_sort.duplicates(none).count() == 0 and content_sort.keep_one(none).count() == 0


# --- vector codes

def brute_codes(rows, rounds=2):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64), lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    points = np.stack([v for _, v, _ in kept]).reshape(len(kept), 16, -1)
    seen, start = set(), []
    for (i, _, _), p in zip(kept, points):
        if i is not None and i not in seen and len(seen) < 64:
            seen.add(i)
            start.append(p)
    books = np.stack(start, 1).copy()

    def nearest():
        return np.stack([((points[:, p, None, :] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(16)], 1)
    for _ in range(rounds):
        code = nearest()
        for p in range(16):
            for e in range(books.shape[1]):
                own = points[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    code = nearest()
    error = sum(((points[:, p] - books[p][code[:, p]]) ** 2).sum(-1) for p in range(16))
    sums = {}
    for (_, _, lab), e in zip(kept, error):
        sums[lab] = sums.get(lab, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), int(e), sums[lab], sha) for (i, _, lab), c, e in zip(kept, code, error)), key=repr)


def vectors(seed, n, dims=64, kinds=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dims))
    return [(int(k), (centres[k % kinds] + 0.1 * rng.normal(size=dims)).astype(np.float32).tolist(), int(k % kinds)) for k in range(n)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def test_codes_with_odd_rows(spark):
    rows = vectors(1, 300)
    rows += [(None, rows[0][1], None), (5, rows[7][1], 2), (5, rows[7][1], 2), (900, None, 1), (901, [float("nan")] * 64, 1), (902, [None] * 64, 1),
             (903, [float("inf")] + [0.0] * 63, 1), (904, [0.0] * 64, None), (905, [0.0] * 64, None), (906, rows[3][1], 7), (907, [-1e-9] * 64, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"id": F.lit(1), "code": F.lit("x"), "carried": F.lit(2), "none": F.lit(True)})
    got = cover_tree.code_table(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(rows)
    short = spark.createDataFrame([*rows, (1000, [1.0] * 32, 1), (1001, [1.0] * 7, 1), (1002, [], 1)], SCHEMA)
    assert sorted(map(tuple, cover_tree.code_table(short).collect()), key=repr) == brute_codes(rows)


def test_few_vectors_copies_and_none(spark):
    rows = [(k, [0.5] * 32, None) for k in range(40)] + [(k, vectors(2, 1, 32)[0][1], 1) for k in range(40, 45)]
    assert sorted(map(tuple, cover_tree.code_table(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute_codes(rows)
    assert cover_tree.code_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cover_tree.code_table(spark.createDataFrame([(1, None, 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_far_components_are_limited(spark):
    rows = vectors(4, 70)
    far = spark.createDataFrame([*rows, (80, [3e38] * 64, 1)], SCHEMA)
    near = spark.createDataFrame([*rows, (80, [float(1 << 18)] * 64, 1)], SCHEMA)
    assert sorted(map(tuple, cover_tree.code_table(far).collect())) == sorted(map(tuple, cover_tree.code_table(near).collect()))


@pytest.mark.parametrize("dims, n", [(1, 500), (4, 2000), (8, 700), (4, 1), (4, 12)])
def test_trees_cover_separate_and_assign_exactly(dims, n):
    rng = np.random.default_rng(n)
    points = np.round(rng.normal(size=(n, dims)) * 40).astype(np.int64)      # many equal points and ties
    order, nodes = cover_tree.build(points)
    assert sorted(order) == list(range(n))
    covered = np.zeros(n, int)
    for node in nodes:
        own = points[order[node["lo"]:node["hi"]]]
        away = np.sqrt(((own - points[node["point"]]) ** 2).sum(1))
        assert np.isclose(away.max(), node["reach"])
        if node["kids"]:
            kids = nodes[node["kid"]:node["kid"] + node["kids"]]
            assert kids["point"][0] == node["point"] and kids["lo"][0] == node["lo"] and kids["hi"][-1] == node["hi"]
            assert (kids["reach"] <= node["reach"] / 2).all()
            apart = np.sqrt(((points[kids["point"]][:, None] - points[kids["point"]][None]) ** 2).sum(-1))
            assert (apart[~np.eye(len(kids), dtype=bool)] > node["reach"] / 2).all()
        else:
            covered[order[node["lo"]:node["hi"]]] += 1
    assert (covered == 1).all()
    book = points[rng.integers(0, n, 20)]
    got = np.full(n, -1)
    for lo, hi, entry in cover_tree.assign(points, order, nodes, book):
        for a, b, e in zip(lo, hi, entry):
            assert (got[order[a:b]] == -1).all()
            got[order[a:b]] = e
    assert (got == ((points[:, None] - book[None]) ** 2).sum(-1).argmin(1)).all()


def test_whole_subtrees_are_assigned():
    points = cover_tree.scaled(np.array([v for _, v, _ in vectors(5, 3000, 4, 6)]))
    order, nodes = cover_tree.build(points)
    book = np.stack([points[k::6].mean(0) for k in range(6)]).astype(np.int64)
    ranges = [hi - lo for lo, hi, _ in cover_tree.assign(points, order, nodes, book)]
    assert sum(map(len, ranges)) < 300 and sum(map(sum, ranges)) == 3000


# --- conversations

def edits_of(rows):
    """Least (cost, audit, letters) by shortest paths over (rows done, state), row by row."""
    best = {0: (0, "", "")}

    def insertions(cells):
        while True:
            more = dict(cells)
            for p, (c, a, w) in cells.items():
                for x, q in cr.MOVES[p].items():
                    if x != "s" and (q not in more or (c + 5, a + "I") < more[q][:2]):
                        more[q] = (c + 5, a + "I", w + x)
            if more == cells:
                return cells
            cells = more
    best = insertions(best)
    for letter, fault in rows:
        now = {}

        def put(q, value):
            if q not in now or value[:2] < now[q][:2]:
                now[q] = value
        for p, (c, a, w) in best.items():
            put(p, (c + 2, a + "D", w))
            if fault in (1, 2):
                continue
            t = 5 * (fault == 3)
            for x, q in cr.MOVES[p].items():
                if x == letter:
                    put(q, (c + t, a + "K", w + x))
                if x != "s":
                    put(q, (c + t + 1, a + "R", w + x))
        best = insertions(now)
    return min(best[q] for q in (0, 3) if q in best)


def cyk(rows):
    """The same by every split of every span."""
    n = len(rows)
    table = {(i, 1): cr.terminal(*rows[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = {}
            for cut in range(1, length):
                for at, value in cr.combine(table[i, cut], table[i + cut, length - cut]).items():
                    cr.least(cell, at, value)
            table[i, length] = cell
    whole = cr.combine(cr.INSERTIONS, table[0, n]) if n else cr.INSERTIONS
    return min(whole[0, q] for q in cr.FINAL if (0, q) in whole)


def test_every_short_conversation():
    kinds = [(x, f) for x in "sua" for f in (0, 3)] + [("u", 1), ("x", 0)]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            spans = cr.Spans()
            for r in rows:
                spans.push(1, cr.terminal(*r))
            whole = cr.combine(cr.INSERTIONS, spans.whole())
            assert min(whole[0, q] for q in cr.FINAL if (0, q) in whole) == edits_of(rows)[:2], rows
    rng = random.Random(1)
    for _ in range(40):
        rows = [(rng.choice("ssuuuaax"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(5, 14))]
        assert cyk(rows) == edits_of(rows)[:2]


def brute_repair(rows):
    """(conv_id, turn, role, text) -> the table, in plain loops."""
    out, by = [], {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in mine:
            bare = text.rstrip(space)
            judged.append((role[:1], 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((role, text))
        cost, audit, letters = edits_of(judged)
        lines, pos, at = [], -1, 0
        for e in audit:
            pos += e != "I"
            if e == "D":
                continue
            role = mine[pos][1] if e == "K" else {"u": "user", "a": "assistant"}[letters[at]]
            lines.append(f"{role}:{'' if e == 'I' else mine[pos][2]}")
            at += 1
        turns = [t for t, _, _ in mine if t is not None]
        faults = [f for _, f in judged]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(judged, judged[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


TALK = "conv_id bigint, turn bigint, role string, text string"


def talk(seed, convs, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(turns):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""])
            text = rng.choice(["Yes.", "No!", "open end", "Why? ", "  \t", None, "", "é.\n", f"text {rng.random()}.", f"Line one.\nline {rng.random()}!"])
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


def test_repairs(spark, monkeypatch):
    rows = talk(1, 40, 6) + talk(2, 2, 0) + [(77, 0, "user", "Hi."), (77, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, TALK).repartition(4).withColumns({"key": F.lit("k"), "pos": F.lit(1), "fault": F.lit(3), "part": F.lit(0)})
    want = brute_repair(rows)
    assert sorted(map(tuple, cr.repair_table(df).collect()), key=repr) == want
    monkeypatch.setattr(cr, "BLOCK", 3)          # conversations over several blocks
    assert sorted(map(tuple, cr.repair_table(df).collect()), key=repr) == want


def test_one_long_conversation(spark):
    rows = [(1, t, random.Random(t).choice(["user", "assistant", "user"]), f"Text {t}" + ".!?,"[t % 4]) for t in range(3000)]
    got = cr.repair_table(spark.createDataFrame(rows, TALK)).collect()
    assert [tuple(r) for r in got] == brute_repair(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TALK)
    assert cr.repair_table(none).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cr.repair_table(spark.createDataFrame([(gone, 0, "user", "Hi.")], TALK)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_repairs_of_the_given_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert sorted(map(tuple, cr.repair_table(df).collect()), key=repr) == brute_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_codes_and_groups_in_sql_on_more_rows(spark):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
    for sql, df in ((vector_codes(2), cover_tree.code_table(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))),
                    (EXACT, content_sort.duplicates(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))):
        con.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in con.description], con.fetchall())
