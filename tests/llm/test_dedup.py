import pathlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark import workspace
from shelfspark.llm import dartminhash, edits, line_dedup, meeting, quality_rules
from shelfspark.operators import graph

rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]


def passage(n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Originals, exact and near copies in groups, unlike texts, and rows of every odd kind."""
    rows, i = [], 0
    for size in (2, 3, 40):
        base = passage(200)
        for k in range(size):
            words = [w if rnd.random() > 0.008 else "zz" + w for w in base]
            rows.append((i, " ".join(base if k % 5 == 1 else words)))
            i += 1
    shared = passage(60)
    for _ in range(20):
        rows.append((i, " ".join(passage(150) + shared)))
        i += 1
    rows += [(900, ""), (901, ""), (902, None), (903, None), (904, "one two"), (905, "One, two!"), (906, "word " * 20000), (907, "word " * 20000), (904, "other text with this id here")]
    return rows


def shingles(text):
    words = text.lower().translate({c: " " for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_classes(rows):
    """For every row (id, text) the indices of its class."""
    sets = [shingles(t) if t else None for _, t in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] is not None and rows[a][1] == rows[b][1] or sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = root_of(parent, a), root_of(parent, b)
                parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root_of(parent, i)].append(i)
    return list(members.values())


def least(ids):
    return min((k for k in ids if k is not None), default=None)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "en", 1) for k, t in rows], "doc_id long, text string, digest string, node int").repartition(4)
    got = Counter((r["doc_id"], r["class_id"]) for r in dartminhash.classes(df).collect())
    groups = brute_classes(rows)
    assert got == Counter((rows[i][0], least(rows[j][0] for j in g)) for g in groups for i in g)
    kept = dartminhash.keep_first(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(least(rows[i][0] for i in g) for g in groups)
    assert dartminhash.classes(df.limit(0)).count() == 0 and dartminhash.keep_first(df.limit(0)).count() == 0


def test_one_row_of_each_class_stays_where_ids_are_null_or_repeated(spark):
    texts = [" ".join(passage(30)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, texts[3]), (None, texts[3]), (7, texts[0]), (1, texts[1]), (None, texts[2])]
    df = spark.createDataFrame([(k, t, k, "x") for k, t in rows], "doc_id long, text string, row long, twins string").repartition(3)
    got = dartminhash.keep_first(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (2, texts[3])])
    assert Counter(r["kept"] for r in dartminhash.classes(df).collect()) == {True: 4, False: 4}


def test_very_many_tiny_texts_are_signed_in_bounded_steps():
    texts = [f"a{i} b{i} c{i}" for i in range(3000)]
    h, at = dartminhash.cells(texts)
    together = dartminhash.signatures(h, at)
    assert all((dartminhash.signatures(h[i : i + 1], np.array([0, 1])) == together[i]).all() for i in range(0, 3000, 500))


def test_links_of_a_group_join_what_all_pairs_join():
    for trial in range(60):
        base = passage(120)
        texts = [" ".join(w if rnd.random() > rnd.choice([0.005, 0.02, 0.03]) else "zz" + w for w in base) for _ in range(rnd.randint(2, 14))] + [" ".join(passage(40))]
        h, at = dartminhash.cells(texts)
        sets = [np.sort(h[a:b]) for a, b in zip(at[:-1], at[1:])]
        n, across = len(sets), trial % 2
        parts = np.array([i % 2 if across else 0 for i in range(n)])
        roots = np.array([i if i > 2 else 0 for i in range(n)])
        met = [(i, j) for i in range(n) for j in range(i) if not across or parts[i] != parts[j]]
        joined = lambda links: frozenset(frozenset(g) for g in groups_of(n, [(1, 0), (2, 0)] + links))
        got = dartminhash.joining_links(roots, parts, sets)
        assert joined(got) == joined([p for p in met if dartminhash.similarity(sets[p[0]], sets[p[1]]) >= 0.8]) and len(got) < n


def groups_of(n, links):
    parent = list(range(n))
    for a, b in links:
        x, y = root_of(parent, a), root_of(parent, b)
        parent[max(x, y)] = min(x, y)
    out = defaultdict(list)
    for i in range(n):
        out[root_of(parent, i)].append(i)
    return out.values()


def test_signatures_estimate_weighted_similarity():
    errors, met = [], 0
    for _ in range(40):
        base = passage(300) + ["again and again and again"] * 5
        other = [w if rnd.random() > 0.01 else "zz" + w for w in base]
        h, at = dartminhash.cells([" ".join(base), " ".join(other)])
        s = dartminhash.signatures(h, at)
        exact = dartminhash.similarity(np.sort(h[at[0] : at[1]]), np.sort(h[at[1] : at[2]]))
        errors.append((s[0] == s[1]).mean() - exact)
        b = dartminhash.band_hashes(s)
        met += (b[0] == b[1]).any() or exact < 0.8
    assert abs(np.mean(errors)) < 0.02 and met == 40


def test_every_two_members_of_a_key_share_a_group(spark, monkeypatch):
    monkeypatch.setattr(meeting, "PART_ROWS", 4)
    members = spark.createDataFrame([(7, n) for n in range(30)] + [(8, 1), (8, 2), (9, 5)], "bucket long, node long")
    got = [tuple(r) for r in meeting.deal(members, "bucket", "node").select("bucket", "a", "b", "node").collect()]
    groups = defaultdict(set)
    for bucket, a, b, node in got:
        groups[bucket, a, b].add(node)
    assert len(groups) > 20 and max(map(len, groups.values())) < 25
    for bucket, n in ((7, 30), (8, 3)):
        own = [g for (k, _, _), g in groups.items() if k == bucket]
        assert all(any({x, y} <= g for g in own) for x in range(n) for y in range(x) if bucket == 7 or 0 < y)
    assert len(got) == len(set(got))


def test_groups_stay_whole_over_batches():
    keys = sorted(rnd.choices(range(12), k=200))
    rows = pa.record_batch([pa.array(keys), pa.array([0] * 200), pa.array(range(200))], ["k", "a", "x"])
    for size in (1, 3, 17, 500):
        seen = []
        for part, edges in meeting.whole_groups((rows.slice(i, size) for i in range(0, 200, size)), 2):
            for a, b in zip(edges[:-1], edges[1:]):
                assert len(set(part.column(0)[a:b].to_pylist())) == 1
                seen.append((part.column(0)[a].as_py(), part.column(2)[a:b].to_pylist()))
        assert [k for k, _ in seen] == sorted(set(keys)) and [x for _, xs in seen for x in xs] == list(range(200))


@pytest.mark.parametrize("part_rows", [2, 2048])
def test_a_text_like_only_one_of_a_crowd_is_in_its_class(spark, monkeypatch, part_rows):
    """All texts meet in one bucket; each is like the next alone, so leaders of the bucket cannot hold the chain."""
    base = passage(200)
    texts = [" ".join([f"n{i}" if i < 15 * k else w for i, w in enumerate(base)]) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sign = dartminhash._sign

    def one_bucket(batches):
        for b in sign(batches):
            column = pa.array([[1]] * b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], column], ["doc_id", "digest", "bytes", "bands"])

    monkeypatch.setattr(dartminhash, "_sign", one_bucket)
    monkeypatch.setattr(meeting, "PART_ROWS", part_rows)
    assert {r["class_id"] for r in dartminhash.classes(df).collect()} == {0}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (601, 600), (600, 601)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 400)} | {601: 600}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_of(parts):
    return " ".join("".join(parts).split())


def test_edit_similarity_at_and_above_the_threshold():
    pairs = [("", ""), ("", "a"), ("a b", ""), ("a b c", "a c"), ("a", "a b")]
    for _ in range(3000):
        a = line_of(rnd.choice("abc ") for _ in range(rnd.randint(0, 25)))
        pairs.append((a, line_of(c if rnd.random() > 0.15 else rnd.choice(["", "x", c + c, "\u00e9 "]) for c in a)))
    for n in range(60):
        a = " ".join(passage(rnd.randint(10, 40)))
        pairs.append((a, line_of(c if rnd.random() > n / 200 else rnd.choice(["", "x", c + c]) for c in a)))
    want = [1 - plain_distance(a, b) / max(len(a), len(b)) if a or b else 1.0 for a, b in pairs]
    assert all(abs(edits.edit_similarity(a, b) - w) < 1e-9 for (a, b), w in zip(pairs, want))
    assert edits.alike(*zip(*pairs)).tolist() == [w >= 0.8 for w in want]
    assert edits.alike([], []).tolist() == []


def test_distances_together_are_on_the_right_side_of_their_limits():
    a, b, limit = [], [], []
    for _ in range(400):
        x = [rnd.randrange(4) for _ in range(rnd.choice([1, 3, 20, 63, 64, 65, 128, 130, 200]))]
        share = rnd.choice([0.02, 0.1, 0.2, 0.5])
        y = [z for c in x for z in ([c] if rnd.random() > share else rnd.choice([[], [3], [c, 1]]))]
        a.append(np.array(x, np.int32)), b.append(np.array(y, np.int32)), limit.append(rnd.choice([0, 1, 5, len(x) // 5, len(x)]))
    got = edits.capped_distances(a, b, np.array(limit))
    assert [g <= k for g, k in zip(got, limit)] == [plain_distance(x.tolist(), y.tolist()) <= k for x, y, k in zip(a, b, limit)]
    long = [np.array([rnd.randrange(50) for _ in range(5000)], np.int32)]
    assert edits.capped_distances(long, [long[0][3:]], np.array([2]))[0] > 2 and edits.capped_distances(long, [long[0][3:]], np.array([3]))[0] <= 3


@pytest.mark.parametrize("kinds", [3, 60, 5000])
def test_pairs_that_exceed_their_limit_are_left_behind_and_no_others(monkeypatch, kinds):
    """Lines of several blocks, whatever their letters, the places looked at on the way and the pairs together."""
    a, b = [], []
    for _ in range(60):
        x = [rnd.randrange(kinds) for _ in range(rnd.choice([63, 64, 65, 200, 400]))]
        share = rnd.choice([0.02, 0.1, 0.3])
        y = [z for c in x for z in ([c] if rnd.random() > share else rnd.choice([[], [kinds - 1], [c, 1]]))]
        a.append(np.array(x, np.int32)), b.append(np.array(rnd.choice([y, y[40:] + y[:40]]), np.int32))
    exact = np.array([edits.distance(x.tolist(), y.tolist()) for x, y in zip(a, b)])
    steps: list = []
    monkeypatch.setattr(edits, "_in_reach", lambda *args, f=edits._in_reach: steps.append(args[-1]) or f(*args))
    for look, most in ((1, 2048), (16, 7)):
        monkeypatch.setattr(edits, "LOOK", look), monkeypatch.setattr(edits, "TOGETHER", most)
        for limit in (exact, np.maximum(exact - 1, 0), exact // 4, np.full(60, 70)):
            assert ((edits.capped_distances(a, b, limit) <= limit) == (exact <= limit)).all()
    assert steps


def test_line_dedup_leaves_no_tables_that_nothing_reads(spark):
    folder = pathlib.Path(workspace.shared_dir(spark).removeprefix("file:")) / "shelfspark"
    names = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    base = passage(20)
    rows = [(i, " ".join([*base[:-1], f"w{i}"]) + "\n" + " ".join(passage(12))) for i in range(6)]
    before = names()
    out = line_dedup.dedup_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {n.split("-")[0] for n in names() - before} == {"numbered", "dropped_lines"}
    assert sum(r["text"].startswith(" ".join(base[:-1])) for r in out.collect()) == 1


def test_pigeonhole_deals_find_all_near_values():
    base = np.array([rnd.getrandbits(64) for _ in range(50)], np.uint64)
    flipped = base.copy()
    for i in range(50):
        for bit in rnd.sample(range(64), 3):
            flipped[i] ^= np.uint64(1 << bit)
    for n in (10, 10**7, 10**10, 10**12):
        m, agree = line_dedup.plan_blocks(n)
        assert (line_dedup._deal(base, m, agree) == line_dedup._deal(flipped, m, agree)).any(axis=1).all()


def lines_corpus():
    base = [" ".join(passage(40)) for _ in range(30)]
    rows = []
    for i in range(40):
        lines = [rnd.choice(base) for _ in range(3)] + [" ".join(passage(30))]
        if i % 3 == 0:
            lines[0] = lines[0].replace("a", "q", 1)
        if i % 7 == 0:
            lines.append(lines[1].upper() + "!!")
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n  \n***"), (5, "an id that is there already\nx"), (103, "long line " * 5000), (104, "long line " * 5000)]


def duplicates_by_edits_alone(rows):
    """row, line of every occurrence that goes, without any SimHash. rows: doc_id, text."""
    occurrences = defaultdict(list)
    for i, (k, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            if x := line_dedup.normal_line(line):
                occurrences[x].append(((k is not None, k or 0), i, n))
    keys = list(occurrences)
    met = [(a, b) for a in range(len(keys)) for b in range(a) if abs(len(keys[a]) - len(keys[b])) <= 0.2 * max(len(keys[a]), len(keys[b])) + 1e-6]
    same = edits.alike([keys[a] for a, _ in met], [keys[b] for _, b in met])
    out = set()
    for g in groups_of(len(keys), [p for p, s in zip(met, same) if s]):
        held = [o for i in g for o in occurrences[keys[i]]]
        out |= {(i, n) for k, i, n in held if (k, i, n) != min(held)}
    return out


def dropped(spark, rows):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    return {(r["row"], r["line"]) for r in line_dedup.duplicate_lines(df, "n")[1].collect()}


def test_lines_equal_brute_force(spark):
    rows = lines_corpus()
    want = duplicates_by_edits_alone(rows)
    assert dropped(spark, rows) == want and len(want) > 40
    df = spark.createDataFrame([(k, t, i, "row") for i, (k, t) in enumerate(rows)], "doc_id long, text string, line int, h string")
    out = line_dedup.dedup_texts(df).collect()
    assert len(out) == len(rows) and len(out[0]) == 4
    texts = {(r["doc_id"], r["line"]): r["text"] for r in out}
    for i, (k, t) in enumerate(rows):
        assert texts[k, i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want))


def test_edited_lines_of_every_length_are_found(spark):
    """Recall against brute force on the edit similarity alone."""
    rows = []
    for n in (4, 6, 8, 10, 12, 13, 20, 30, 60):
        for _ in range(12):
            base = passage(n)
            for count in (0, 1, max(1, n // 8)):
                copy = list(base)
                for at in rnd.sample(range(n), count):
                    copy[at] = rnd.choice(VOCABULARY)
                rows.append((len(rows), " ".join(copy)))
    want, got = duplicates_by_edits_alone(rows), dropped(spark, rows)
    assert not got - want and len(got) >= 0.98 * len(want) and len(want) > 100, (len(got), len(want))


@pytest.mark.parametrize("part_rows", [4, 1024])
def test_a_crowd_of_near_lines_loses_no_link(spark, monkeypatch, part_rows):
    """Lines edited at many rates: the nearest one may be too far, and others of the crowd are not."""
    monkeypatch.setattr(meeting, "PART_ROWS", part_rows)
    base = passage(40)
    rows = [(i, " ".join(w if rnd.random() > rnd.choice([0.02, 0.1, 0.25]) else rnd.choice(VOCABULARY) for w in base)) for i in range(60)]
    want, got = duplicates_by_edits_alone(rows), dropped(spark, rows)
    assert not got - want and len(got) >= len(want) - 1 and 10 < len(want) < 60, (len(got), len(want))


def test_null_and_repeated_ids_have_lines_of_their_own(spark):
    a, b, c = (" ".join(passage(20)) for _ in range(3))
    near = a + " more"
    rows = [(None, a), (None, near), (3, b), (3, b + "\n" + c), (3, b), (1, c), (None, None), (None, "")]
    assert dropped(spark, rows) == duplicates_by_edits_alone(rows) == {(1, 0), (3, 0), (4, 0), (3, 1)}


def test_rows_alone_in_their_deal_are_left_out_whatever_the_batches():
    deals = sorted(rnd.choices(range(40), k=60))
    rows = pa.record_batch([pa.array(deals), pa.array(range(60))], ["deal", "id"])
    want = [i for i, d in enumerate(deals) if deals.count(d) > 1]
    for size in (1, 2, 7, 60):
        got = [x for part in line_dedup._several(rows.slice(i, size) for i in range(0, 60, size)) for x in part.column(1).to_pylist()]
        assert got == want


@pytest.mark.parametrize("n", [0, 1])
def test_few_or_no_lines(spark, n):
    df = spark.createDataFrame([(1, "just one line")], "doc_id long, text string").limit(n)
    _, drop = line_dedup.duplicate_lines(df)
    assert drop.count() == 0 and line_dedup.dedup_texts(df).count() == n


def test_classes_are_the_same_without_broadcasts(spark, monkeypatch):
    """From a size that the driver can hold several times on, tables of nodes are joined by a shuffle."""
    base = [f"w{i}" for i in range(60)]
    texts = [base, base, [*base[:-1], "x"], [f"v{i}" for i in range(60)], "", None]
    docs = spark.createDataFrame([(i, " ".join(t) if t else t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = lambda: sorted(tuple(r) for r in dartminhash.classes(docs).select("doc_id", "class_id", "kept").collect())
    want = found()
    monkeypatch.setattr(dartminhash, "BROADCAST_BYTES", -1)
    got = dartminhash.classes(docs)
    assert "ResolvedHint" not in got._jdf.queryExecution().analyzed().toString() and sorted(tuple(r) for r in got.select("doc_id", "class_id", "kept").collect()) == want
    assert sorted(r["doc_id"] for r in dartminhash.keep_first(docs).collect()) == sorted(x[0] for x in want if x[2])


def test_near_dedup_moves_no_texts_while_few_rows_go(spark, monkeypatch):
    """Room for the rows that go, and none for those that stay."""
    monkeypatch.setattr(dartminhash, "BROADCAST_BYTES", 2000)
    rows = [(i, " ".join(passage(20))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, rows[0][1]), (301, rows[1][1]), (302, None), (0, rows[0][1])], "doc_id long, text string")
    kept = dartminhash.keep_first(workspace.materialize(docs, "docs"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [*range(300), 302]
    plan = kept.where("doc_id > 0")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_near_lines_carry_their_deals_and_nodes_stay(spark, monkeypatch):
    """What is compared last is found from the near lines alone; each has its sketch's deals there, and no others."""
    facing, write = [], workspace.materialize
    monkeypatch.setattr(workspace, "materialize", lambda df, name, *a: (facing.append(df.inputFiles()) if name == "facing_lines" else None, write(df, name, *a))[1])
    base = passage(40)
    line_dedup.duplicate_lines(spark.createDataFrame([(i, " ".join(rnd.choice(VOCABULARY) if rnd.random() < 0.1 else w for w in base)) for i in range(20)], "doc_id long, text string"))
    assert facing and not any("line_nodes" in f for f in facing[0])


def test_line_dedup_drops_each_large_shuffle_before_the_next(spark, monkeypatch):
    """Digests and deals by either route are the largest shuffles; no two of them lie on disk at once."""
    seen, written, discard = [], workspace.materialize, workspace.discard
    monkeypatch.setattr(workspace, "materialize", lambda df, name, *a, **k: (written(df, name, *a, **k), seen.append(name))[0])
    monkeypatch.setattr(workspace, "discard", lambda *t: (discard(*t), seen.append("discard"))[0])
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, line), (2, line + " eleven"), (3, "something else entirely")], "doc_id long, text string")
    _, drop = line_dedup.duplicate_lines(docs)
    assert drop.count() == 1
    for large in ("line_nodes", "dealt_by_block", "dealt_by_sketch"):
        assert seen[seen.index(large) + 1] == "discard"


def unmarked_broadcasts(monkeypatch):
    """A list that gets each written table's name and how many broadcasts its plan has beyond those marked after counting."""
    write, seen = workspace.materialize, []

    def note(df, name, *a, **k):
        plan = df._jdf.queryExecution()
        seen.append((name, plan.executedPlan().toString().count("BroadcastHashJoin") - plan.analyzed().toString().count("strategy=broadcast")))
        return write(df, name, *a, **k)

    monkeypatch.setattr(workspace, "materialize", note)
    return seen


def test_near_dedup_broadcasts_no_exploded_bands(spark, monkeypatch):
    """Spark takes all bands of a text for one, and so for small enough to send to the driver. Only tables counted before go there."""
    seen, base = unmarked_broadcasts(monkeypatch), passage(40)
    dartminhash.classes(spark.createDataFrame([(i, " ".join([*base, f"w{i % 7}"])) for i in range(30)], "doc_id long, text string"))
    assert {"in_buckets", "wanted", "rooted", "components"} <= {name for name, _ in seen} and not [x for x in seen if x[1] > 0]


def test_line_stages_broadcast_only_what_was_counted(spark, monkeypatch):
    """Lines exploded from their documents, and nodes in small files, are not sent to the driver by Spark's own estimate."""
    seen, base = unmarked_broadcasts(monkeypatch), passage(40)
    docs = spark.createDataFrame([(i, " ".join([*base, f"w{i % 7}"]) + "\nx y", "a") for i in range(30)], "doc_id long, text string, source string")
    line_dedup.duplicate_lines(docs)
    workspace.materialize(quality_rules.clean(docs), "cleaned")
    seen = [x for x in seen if x[0] != "frequent_lines"]  # its hosts are few, and grouped before
    assert {"raw_lines", "rooted_lines", "line_groups", "cleaned"} <= {name for name, _ in seen} and not [x for x in seen if x[1] > 0]


def test_rows_alone_in_a_large_deal_are_not_dealt_out():
    """Of a pigeonhole deal larger than a part only values with a near one in it go on, whatever the strips."""
    values = np.random.default_rng(5).integers(0, 2**63, 3 * meeting.PART_ROWS).astype(np.uint64)
    values[2000], values[2001] = values[17] ^ np.uint64(7), values[18] ^ np.uint64(15)
    assert np.flatnonzero(line_dedup._close(values)).tolist() == [17, 2000] and len(values) < line_dedup.LARGE_DEAL


def test_lines_compared_last_are_shared_by_their_number(spark, monkeypatch):
    """A crowd's parts meet in tasks of their own, however few bytes they have."""
    monkeypatch.setattr(meeting, "PART_ROWS", 8)
    monkeypatch.setattr(line_dedup, "LINES_A_TASK", 20)
    write, tasks = workspace.materialize, []
    monkeypatch.setattr(workspace, "materialize", lambda df, name, *a: (tasks.append(df.rdd.getNumPartitions()) if name == "line_links" else None, write(df, name, *a))[1])
    base = passage(40)
    line_dedup.duplicate_lines(spark.createDataFrame([(i, " ".join(w if rnd.random() > rnd.choice([0.02, 0.1, 0.25]) else rnd.choice(VOCABULARY) for w in base)) for i in range(60)], "doc_id long, text string"))
    assert len(tasks) == 2 and tasks[1] > 4


def test_one_passage_at_different_places_is_refuted_without_letters(monkeypatch):
    """Such lines have near SimHashes; parts looked up where an alignment can bring them tell them apart, and no alike lines."""
    compared, exact = [], edits.capped_distances
    monkeypatch.setattr(edits, "capped_distances", lambda a, b, limit: compared.append(len(a)) or exact(a, b, limit))
    a, b = [], []
    for n in (20, 60, 100):
        for _ in range(20):
            shared = passage(n)
            a.append(" ".join([*shared, *passage(n // 2)])), b.append(" ".join([*passage(n // 2), *shared]))
    assert not edits.alike(a, b).any() and not sum(compared)


def test_no_pair_within_its_limit_is_refuted():
    a, b = [], []
    for n in (1, 5, 40, 63, 64, 65, 127, 128, 129, 300, 700):
        for _ in range(40):
            x = "".join(rnd.choice("abcdefgh \u00e9\u4e00\U0001f600") for _ in range(n))
            share, moved = rnd.choice([0.01, 0.1, 0.2, 0.4]), rnd.randint(0, n // 4)
            y = "".join(c if rnd.random() > share else rnd.choice(["", "x", c + c]) for c in x)
            a.append(x), b.append(rnd.choice([y, y[moved:] + "q" * moved, "q" * moved + y[: n - moved], y[moved:], "q" * moved + y]))
    exact = np.array([edits.distance(x, y) for x, y in zip(a, b)])
    for limit in (exact, exact + 3, np.maximum(exact, edits.limits(a, b))):
        for end in (len(a), 1, 0):
            assert not edits.apart(a[:end], b[:end], limit[:end]).any()
    assert not edits.apart(b, a, exact).any() and edits.apart(a, b, np.maximum(exact // 3 - 3, 0)).sum() > 100
    assert edits.apart(["a" * 5000], ["b" * 5000], np.array([1000])).tolist() == [False]  # left to the comparison
