import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from pagetext.llm import prefixtrie as pt
from pagetext.llm.oracle import OP12

from .helpers import frame

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    members = defaultdict(list)
    for v in own.values():
        v.sort()
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(t[3:] for t in own.get(base, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c, end in sorted(m) if end)
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=2):
    rng = random.Random(seed)
    rows = []
    said = [("user", "hi"), ("assistant", "hello, Ñandú 😀"), (None, "hi"), ("user", None), ("", "")]
    for c in [*range(-120, 160), *range(300, 330), 1007, 1008]:          # bases 1000 and -200 are absent
        for t in range(rng.choice((1, 1, 2, 3, 6, 9))):
            rows.append((c, t if rng.random() < 0.9 else None, *rng.choice(said)))
    for c in (201, 202, 203, 204, 205, 206):                              # long copies, and copies that part late
        n = {201: 300, 202: 300, 203: 300, 204: 128, 205: 129, 206: 64}[c]
        rows += [(c, t, "user", f"turn {t}" + (" other" if c == 203 and t == 200 else "")) for t in range(n)]
    rows += [(401, t, "user", f"alone {t}") for t in range(200)]
    rows += [(402, 0, "user", "same row")] * 3 + [(403, 1, "user", "b"), (403, 1, "user", "a"), (None, 1, "user", "nobody")]
    for c in range(500, 590):                                             # a group of copies
        rows += [(c, t, "user", f"copy {t}") for t in range(7)]
    rng.shuffle(rows)
    return rows


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("parts", ["1", "7", "60"])
def test_nodes_equal_brute_force(spark, parts):
    rows = conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = nodes(pt.prefix_trie(frame(spark, rows, SCHEMA, clashing=("depth", "keys", "Part", "n_convs"))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_sql_equals_brute_force():
    rows = conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(OP12).fetchall(), key=str) == brute(rows)


def test_many_ids_of_a_skeleton_node_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 4)
    rows = [(c, 0, "user", "x") for c in range(50, 100)] + [(c, 0, "user", "x") for c in range(1001, 1040)]
    assert nodes(pt.prefix_trie(frame(spark, rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert pt.prefix_trie(frame(spark, [], SCHEMA)).count() == 0


def test_skeleton_numbers_are_those_of_the_first_splitter():
    k = [bytes([i]) * 16 for i in range(5)]
    s = pt.Skeleton([(0, 0, k[0] + k[1] + k[2]), (0, 0, k[0] + k[1] + k[3]), (0, 0, k[0] + k[1] + k[3]), (0, 0, k[0] + k[4]), (1, 0, k[0])])
    width = pt.DEPTH + 1
    assert [s.number(3, d) for d in range(3)] == [0, 1, 3 * width + 2]
    assert [s.number(2, d) for d in range(4)] == [0, 1, 2, width + 3]
    assert s.number(4, 1) == 4 * width + 1 and s.parent(width + 3) == 2 and s.parent(0) is None
