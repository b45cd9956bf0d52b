"""Line dedup, SimHash and exact dedup against brute force over all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import components, exactdedup, linededup, simhash


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        s = s or ["a"]
        k, p = rng.randrange(3), rng.randrange(len(s))
        if k == 0:
            s.insert(p, rng.choice("abc "))
        elif k == 1:
            s.pop(p)
        else:
            s[p] = rng.choice("abc ")
    return "".join(s)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_distance_and_partition(t):
    rng = random.Random(t)
    for _ in range(3000):
        a = "".join(rng.choices("ab" if rng.random() < 0.5 else "abcdef", k=rng.randrange(1, 16)))
        b = mutated(rng, a, rng.randrange(5))
        close = edits(a, b) <= t
        assert linededup.within(a, b, t) == close
        if close and min(len(a), len(b)) > t:
            x, y = (a, b) if len(a) >= len(b) else (b, a)
            own = {(i, y[p:p + n]) for o, m, i, p, n in linededup.substrings(len(y), t) if o}
            assert own & {(i, x[p:p + n]) for _, m, i, p, n in linededup.substrings(len(x), t) if m == len(y)}
            s = linededup.signatures([a, b])
            assert linededup.may_match(s[:1], s[1:], t)[0]


def brute_lines(rows, t=linededup.THRESHOLD):
    """For rows (doc_id, text) in order: the line numbers that go."""
    places = [(r, n, line.strip()) for r, (_, text) in enumerate(rows) if text for n, line in enumerate(text.split("\n"))
              if len(line.strip()) >= 24 or any(c.isalnum() for c in line)]
    order = sorted(range(len(places)), key=lambda i: (rows[places[i][0]][0] is None, rows[places[i][0]][0] or 0, places[i][0], places[i][1]))
    places = [places[i] for i in order]
    pairs = [(i, j) for j in range(len(places)) for i in range(j) if places[i][2] == places[j][2] or min(len(places[i][2]), len(places[j][2])) >= 24
             and abs(len(places[i][2]) - len(places[j][2])) <= t and edits(places[i][2], places[j][2]) <= t]
    roots = union(len(places), pairs)
    gone = {}
    for i, (r, n, _) in enumerate(places):
        if roots[i] != i:
            gone.setdefault(r, []).append(n)
    return {r: sorted(x) for r, x in gone.items()}


@pytest.mark.parametrize("longest", [64, 3])
def test_line_dedup_matches_all_pairs(spark, docs, longest):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh  ", k=rng.randrange(26, 60))).strip().ljust(26, "z") for _ in range(8)]
    rows = []
    for i in range(40):
        lines = [mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join([*lines, rng.choice(["short", "shore", "(c) 1", "--", "é"]), "", "***"])))
    expected = brute_lines(rows)
    got = {r["doc_id"]: r["dropped"] for r in linededup.report(docs(rows), longest=longest).collect()}
    assert {d: sorted(int(x.split(":")[0]) for x in v.split(",")) for d, v in got.items() if v} == expected
    out = {r["doc_id"]: r for r in linededup.deduplicated(docs(rows), longest=longest).collect()}
    for r, (d, text) in enumerate(rows):
        assert out[d]["text"] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in expected.get(r, []))
        assert out[d]["n_chars"] == len(out[d]["text"])


def test_line_dedup_odd_rows(docs, odd):
    line = "a line that is long enough to be compared"
    frame = docs([(1, line), (1, line + "\n"), (None, line), (2, None), (3, "")], parts=1)
    out = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in linededup.deduplicated(frame).collect())
    assert out == [(False, 1, False, "") if False else x for x in out] and sum(x[3].count(line) for x in out) == 1 and len(out) == 5
    assert linededup.deduplicated(odd).count() == odd.count()
    assert linededup.deduplicated(odd).columns == odd.columns
    assert linededup.report(docs([])).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, sf_small, odd):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    texts = [r["text"] for r in rows.collect()] + ["É ÀB c d", "A b", "a B", "  x\x0by z"]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    h = spark.createDataFrame([("the cat sat",)], "t string").select(F.xxhash64("t").alias("h")).first()["h"]
    assert simhash.fingerprint("the cat sat") == h % (1 << 64)


@pytest.mark.parametrize("longest", [512, 2])
def test_simhash_links_match_all_pairs(spark, longest):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(rng.randrange(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected(simhash.links(nodes, longest=longest), "t").collect()}
    pairs = [(i, j) for j in range(len(fps)) for i in range(j) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2]
    expected = union(len(fps), pairs)
    assert [fps.index(roots.get(f, f)) for f in fps] == expected


def test_simhash_components(docs, odd):
    rows = odd.collect()
    got = simhash.components(odd).collect()
    assert len(got) == len(rows)
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fp"] == 0}
    assert zero == {1: 1, 2: 1, 3: 1, 7: 1}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert simhash.components(docs([])).count() == 0


def test_exact_groups(docs, odd):
    rows = [(i % 50, ("x" * (i % 7 * 40) + f" \t\n{'y' * (i % 3 * 300)}" + "end" * (i % 2)) or None) for i in range(120)]
    for frame in (odd, docs(rows)):
        key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = {}
        for r in frame.collect():
            groups.setdefault(key(r["text"]), []).append(r["doc_id"])
        expected = sorted((d is None, d or 0, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for d in ids)
        got = exactdedup.groups(frame, first=8, wider=2).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in got) == expected
        assert exactdedup.deduplicated(frame).count() == len(groups)
        assert exactdedup.deduplicated(frame).columns == frame.columns
    assert exactdedup.groups(docs([])).count() == 0


def test_scratch_tables_can_be_cleared(spark):
    import os

    from tallyframe.llm import common
    kept = common.written(spark.range(3), "a-table")
    folder = common._own_dir(spark).removeprefix("file:")
    assert kept.count() == 3 and any(n.startswith("a-table") for n in os.listdir(folder))
    common.forget(kept)
    assert not any(n.startswith("a-table") for n in os.listdir(folder))
    common.clear(spark)
    assert not os.path.exists(folder)


def test_rows_are_numbered_alike_whenever_read(spark, sf_small, docs):
    from tallyframe.llm.common import ROW, with_row
    scan = with_row(spark.read.parquet(f"{sf_small}/documents.parquet").where("n_chars > 0"))
    assert scan.select(ROW, "doc_id").exceptAll(scan.select("text", ROW, "doc_id").select(ROW, "doc_id")).count() == 0
    assert spark.conf.get("spark.sql.files.minPartitionNum")
    dealt = with_row(docs([(i, f"t{i}") for i in range(50)], parts=7))
    assert all("numbered" in f for f in dealt.inputFiles()) and dealt.count() == 50
