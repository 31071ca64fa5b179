"""Near copies, line dedup, mixing, neighbours, toxicity and the pipeline against plain versions."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import ann, components, jaccard, linededup, mixing, toxicity
from tremor.llm.common import materialize, table


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)] if words else [])


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets}


def mutated(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def corpus(rng, n=260):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 150, 400]))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = i % 6
        base = bases[i % len(bases)]
        if kind < 3:
            words = mutated(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.08]))
        elif kind == 3:
            words = passage + [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 90]))]
        elif kind == 4:
            words = base[: max(1, int(len(base) * rng.choice([0.8, 0.9, 0.97])))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 9))]
        rows.append((i, " ".join(words) if i % 7 else " ".join(words).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(docs, monkeypatch, seed):
    rows = [*corpus(random.Random(seed)), (900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE two"), (905, "b " * 30_000)]
    if seed == 2:  # make frequent shingles and many rounds happen on small data
        monkeypatch.setattr(jaccard, "frequent_shingles", lambda sets, n: _often(rows, 4))
        monkeypatch.setattr(jaccard, "SMALL", 2)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_report(docs(rows, extra=True)).collect()}
    assert got == plain_components(rows)


def test_blocks_connect_what_links_connect():
    """Sets of all sizes with ties and labels: the links of a block give the same components as all pairs."""
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        sets = []
        for i in range(300):
            kept = base[: rng.choice([5, 40, 41, 300, 2000])] if i % 3 or not i else sets[rng.integers(len(sets))]
            kept = kept[rng.random(len(kept)) > rng.choice([0, 0.03, 0.08])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.choice([1, 3, 9]), dtype=np.uint64)])))
        labels = [i if i % 5 else 0 for i in range(300)]
        nodes = [1000 + i for i in range(300)]
        every = [(a, b) for a in range(300) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        found = [(a - 1000, b - 1000) for a, b in jaccard.connecting_links(nodes, labels, list(sets), percent)]
        assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in every}

        def classes(links):
            label = list(labels)
            for a, b in links:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
            return label

        assert classes(found) == classes(every) and len(found) == len(set(labels)) - len(set(classes(every)))


def test_sets_of_unlike_sizes_do_not_meet(docs, monkeypatch):
    """Beginnings of one text share all their shingles, but none is within a link's reach of another; a longer one than BLOCK allows is split by sizes, not indexed again."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "difference_lists", lambda *_: pytest.fail("indexed again"))
    words = [f"w{k}" for k in range(4000)]
    rows = [(2 * k + twin, " ".join(words[: int(20 * 1.3**k)] + ["end"] * twin)) for k in range(20) for twin in (0, 1)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_report(docs(rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_pairs_are_written_without_their_differences(docs, monkeypatch):
    """Whole sets beside each pair took more disk than the texts; only groups that are indexed again need them."""
    put, tables = jaccard.Shelf.put, []
    monkeypatch.setattr(jaccard.Shelf, "put", lambda self, name, df: tables.append((name, df.columns)) or put(self, name, df))
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(12)]
    got = jaccard.jaccard_components(docs(rows), percent=80, words=5).collect()
    assert {r["__component"] for r in got} == {0} and "verified" in dict(tables)
    assert not [name for name, columns in tables if "__delta" in columns]


def test_shingles_of_many_texts_at_once():
    rng = np.random.default_rng(1)
    texts = [None, "", " \n", "one", "Two words", "a b c", "a b c d", "é ü\ud800 x y z x y z", *(" ".join(rng.choice(["a", "B", "cc", "d\t"], n)) for n in (3, 4, 5, 50, 5000)), "x" * 200_000]
    made = jaccard.shingle_sets(texts)
    for text, h in zip(texts, made, strict=True):
        words = (text or "").lower().split()
        assert len(h) == len({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else ()) and (np.diff(h.view(np.int64).astype(object)) != 0).all()
        assert (h == jaccard.shingles_of(text)).all() and (np.sort(h) == h).all()
    assert made[5].tolist() != made[6].tolist() and not set(made[3].tolist()) & set(made[4].tolist())


def test_many_edited_copies_of_copies(docs):
    """Thousands of copies, each an edited copy of an earlier one, take few rounds."""
    rng = random.Random(8)
    copies = [[f"w{rng.randrange(5000)}" for _ in range(150)]]
    while len(copies) < 3000:
        words = list(copies[max(0, len(copies) - 1 - int(rng.expovariate(1 / 40)))])
        for _ in range(rng.choice([1, 1, 2, 4])):
            words[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        copies.append(words)
    began = time.time()
    found = {r.doc_id: r["__component"] for r in jaccard.jaccard_components(docs([(i, " ".join(w)) for i, w in enumerate(copies)]), 80, 5).collect()}
    assert time.time() - began < 60
    sets = [jaccard.shingles_of(" ".join(w), 5) for w in copies]
    links = jaccard.connecting_links(list(range(3000)), list(range(3000)), sets, 80)  # held against all pairs above
    label = {i: i for i in range(3000)}
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {i: new if x == old else x for i, x in label.items()} if old != new else label
    assert found == label and len(set(label.values())) < 2500


def _often(rows, words):
    counts = collections.Counter(h for _, t in rows for h in jaccard.shingles_of(t, words).tolist())
    return np.sort(np.array([h for h, n in counts.items() if n >= 12], dtype=np.uint64))


def test_jaccard_cases(spark, docs):
    assert jaccard.jaccard_report(docs([])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_report(docs([(3, None)])).collect()] == [(3, 0, 3)]
    twice = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (7, "q r s t"), (7, "u v w x")]
    assert sorted(tuple(r) for r in jaccard.jaccard_report(docs(twice)).collect()) == [(2, 3, 2), (5, 3, 2), (5, 3, 2), (7, 1, 7), (7, 1, 7)]


def test_jaccard_of_null_ids(docs):
    base = [f"w{i}" for i in range(120)]
    copy = lambda words, *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    other = [f"v{i}" for i in range(120)]
    last = [f"u{i}" for i in range(120)]
    rows = [(None, copy(base)), (5, copy(base)), (3, copy(base, 0)), (9, copy(base, 119)), (None, copy(base, 119)), (None, copy(base, 0, 119, 118))]
    rows += [(None, copy(other)), (None, copy(other, 0)), (None, copy(other)), (7, copy(last)), (None, copy(last, 0)), (None, copy(last, 119)), (None, None), (None, "")]
    assert 100 * len(plain_set(rows[0][1]) & plain_set(rows[5][1])) >= 85 * len(plain_set(rows[0][1]) | plain_set(rows[5][1]))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_report(docs(rows)).collect()]
    wanted = [3] * 6 + [None] * 3 + [7] * 3 + [None] * 2
    assert collections.Counter(got) == collections.Counter((i, len(plain_set(t)), c) for (i, t), c in zip(rows, wanted, strict=True))


def test_one_of_near_copies_stays_without_ids(spark, docs):
    text = lambda name, *at: " ".join("x" if i in at else f"{name}{i}" for i in range(120))
    rows = [(None, text("a")), (5, text("a", 0)), (None, text("b")), (None, text("b", 0)), (None, text("b")), (7, text("c")), (7, text("d", 0)), (2, text("d")), (None, None), (None, "")]
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(rows), "").collect()}
    ours = [t for i, t in kept if i is None and t and t.split()[5] == "b5"]
    assert len(ours) == 1 and kept == {(5, text("a", 0)), (None, ours[0]), (7, text("c")), (2, text("d")), (None, None), (None, "")}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 205), (205, 203), (203, 201)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, **dict.fromkeys((200, 201, 203, 205), 200)}


def test_components_in_rounds_and_at_once(spark, monkeypatch):
    """A small edge table is solved in a few jobs instead of rounds; a table over the bound goes in rounds, with the same result."""
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (3, 5), (5, 3), (3, 5)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    table_of = materialize(spark.createDataFrame(edges, "a long, b long").repartition(9), "edges")
    jobs = []
    for bound in (100_000, 50, 0):
        monkeypatch.setattr(components, "EDGES", bound, raising=False)
        spark.sparkContext.setJobGroup(group := f"components-{bound}", "")
        got = components.components(table_of, "a", "b").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert sorted((r.node, r.root) for r in got) == sorted(root.items())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] <= 6 < jobs[1], jobs
    assert not components.components(table_of.filter("a < 0"), "a", "b").collect()


def shared_runs(a, b, same):
    """All maximal runs of equal lines of a and b, as (lo, hi, shift) of a; of one text, with what comes before in it."""
    for shift in range(1 if same else -len(b) + 1, len(a)):
        lo = None
        for i in range(max(0, shift), min(len(a), len(b) + shift) + 1):
            equal = i < len(a) and i - shift < len(b) and a[i] == b[i - shift]
            if equal and lo is None:
                lo = i
            if not equal and lo is not None:
                yield lo, i, shift
                lo = None


def check_dedup(rows, got, gram, window):
    """Every run of window words that an earlier text has is gone, whatever else has parts of it; no line goes that is in no repeated run of gram words."""
    strip = lambda t: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    lined = [(i, strip(t)) for i, t in sorted(rows)]
    for k, (i, lines) in enumerate(lined):
        words = [len(x.split()) for x in lines]
        must, may = set(), set()
        for m in range(k + 1):
            for lo, hi, shift in shared_runs(lines, lined[m][1], m == k):
                if sum(words[lo:hi]) >= gram:
                    may |= set(range(lo, hi))
                if sum(words[lo:hi]) >= window and (m < k or hi - lo <= shift):
                    must |= set(range(lo, hi))
        left = strip(got[i].text)
        assert got[i].n_lines == len(lines) and got[i].n_deleted == len(lines) - len(left)
        gone, at = set(), 0
        for j, x in enumerate(lines):  # lines with equal text in a row may stand for one another
            if at < len(left) and x == left[at] and j not in must:
                at += 1
            else:
                gone.add(j)
        assert at == len(left) and must <= gone, (i, must - gone)
        assert gone <= may, (i, gone - may)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_all_pairs_of_runs(docs, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(rng.choice([2, 5, 9, 20, 30, 55])))
    passage = [line() for _ in range(40)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            lo = rng.randrange(0, 38)
            parts += passage[lo : lo + rng.randrange(1, 12)] if rng.random() < 0.7 else [line(), ""]
        rows.append((i, "\n".join(f" {x}" if rng.random() < 0.2 else x for x in parts)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "w " * 60_000)]
    found = linededup.line_dedup_report(docs(rows, extra=True)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    check_dedup([r for r in rows if r[1] is not None], got, linededup.GRAM_WORDS, linededup.WINDOW_WORDS)
    assert got[900].text is None and got[901].text == "" and got[902].text == "\n\n"
    assert sum(r.n_deleted for r in got.values()) > 50
    if not seed:
        assert linededup.line_dedup_report(docs([])).count() == 0


def test_runs_that_the_first_place_has_not(docs):
    """The first text has the middle of a passage only, two later ones the whole passage."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    for _ in range(5):
        u, v, w = line(20), line(26), line(19)
        rows = [(1, "\n".join([line(30), v, line(30)])), (2, "\n".join([line(9), u, v, w])), (3, "\n".join([u, v, w, line(8)]))]
        got = {r.doc_id: r.n_deleted for r in linededup.line_dedup_report(docs(rows)).collect()}
        assert got[1] == 0 and got[3] == 3


def test_line_dedup_of_other_ids(spark):
    passage = "\n".join(f"{k} " + "w " * 30 for k in range(3))
    rows = [("b", passage), ("a", passage), (None, "one\n" + passage), ("c", "own line"), ("d", passage + "\nlast"), ("d", passage + "\nlast")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([("a", ""), ("b", ""), (None, rows[2][1]), ("c", "own line"), ("d", "last"), ("d", "last")], key=str)


def test_runs_of_window_words_are_always_found(docs):
    rng = random.Random(9)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    for cut in ([55], [25, 25], [10] * 5, [1] * 50, [49, 1]):
        passage = [line(n) for n in cut]
        rows = [(1, "\n".join([line(9), *passage, line(7)])), (2, "\n".join([line(3), line(12), *passage]))]
        got = {r.doc_id: r for r in linededup.line_dedup_report(docs(rows)).collect()}
        assert (got[1].n_deleted, got[2].n_deleted) == (0, len(passage))


WEIGHTS = [{"a": 500, "b": 300, "c": 200}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 3}, {f"s{i}": (i + 2) ** 0.5 for i in range(8)}, {f"s{i}": 1.0 for i in range(30)}, {"a": 1e-4, "b": 1.0, "c": 0.01}, {f"s{i}": 3.0 ** -i for i in range(14)}]


@pytest.mark.parametrize("weights", WEIGHTS)
@pytest.mark.parametrize("segment", [1, 13, 500, 20_000])
def test_schedule_stays_within_a_block(weights, segment):
    """Every block in its window and every source within one block of its target at every slot, across the borders of segments."""
    shares = list(mixing.integer_weights(weights).values())
    whole, done, slots = sum(shares), [0] * len(shares), 20_000 if segment > 1 else 800
    plan = [x for t in range(0, slots, segment) for x in mixing.pfair_segment(t, min(slots, t + segment), shares)]
    assert len(plan) == slots
    for t, (i, k) in enumerate(plan):
        assert k == done[i] and k * whole // shares[i] <= t < -(-(k + 1) * whole // shares[i])
        done[i] += 1
        if t % 7 == 0 or t < 2000:
            assert all(abs(d * whole - (t + 1) * m) < whole for d, m in zip(done, shares, strict=True))


def test_deviation_does_not_grow():
    """Square-root weights, 100,000 slots and a segment far behind: less than one block from the exact target."""
    weights = {f"s{i}": (i + 2) ** 0.5 for i in range(8)}
    shares = list(mixing.integer_weights(weights).values())
    target = np.array(list(weights.values())) / sum(weights.values())
    for first in (0, 10**9):
        done = np.array(mixing.blocks_before(first, shares), dtype=float)
        worst = 0.0
        for at in range(first, first + 100_000, mixing.SEGMENT):
            for t, (i, _) in enumerate(mixing.pfair_segment(at, min(first + 100_000, at + mixing.SEGMENT), shares), at + 1):
                done[i] += 1
                if t % 11 == 0:
                    worst = max(worst, np.abs(done - t * target).max())
        assert worst < 1 and done.sum() == first + 100_000


def test_mix(spark, docs):
    rows = [(i, f"t{i}", "en", ("big" if i % 3 else "small") if i % 10 else None) for i in range(500)] + [(7, "again", "en", "big")] + [(None, f"n{i}", "en", "big") for i in range(60)]
    df = docs(rows, extra=True)
    weights = mixing.tempered_weights(df)
    got = mixing.mix_sources(df, weights, block_docs=4, bucket_docs=50).collect()
    assert len(got) == 561 and len({(r["__slot"], r["__place"]) for r in got}) == 561
    shares = mixing.integer_weights(weights)
    names = sorted(shares)
    sizes = collections.Counter(r.source if r.source is not None else mixing.NO_SOURCE for r in got)
    last = max(-(-(-(-sizes[n] // 4)) * sum(shares.values()) // shares[n]) for n in names)
    plan = {x: t for t, x in enumerate(mixing.pfair_segment(0, last, [shares[n] for n in names]))}
    for r in got:
        assert r["__slot"] == plan[names.index(r.source if r.source is not None else mixing.NO_SOURCE), r["__block"]]
    for s in {r.source for r in got}:  # blocks are full but for the last
        sizes = collections.Counter(r["__block"] for r in got if r.source == s)
        assert sorted(sizes) == list(range(len(sizes))) and all(sizes[k] == 4 for k in range(len(sizes) - 1))
    again = {(r.doc_id, r.text): r["__slot"] for r in mixing.mix_sources(df.repartition(5), weights, block_docs=4, bucket_docs=50).collect()}
    assert again == {(r.doc_id, r.text): r["__slot"] for r in got}
    assert mixing.mix_report(docs([])).count() == 0
    with pytest.raises(ValueError, match="small"):  # a source without a weight loses no document silently
        mixing.mix_sources(df, {"big": 1.0, mixing.NO_SOURCE: 1.0})
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {})
    assert mixing.mix_sources(df, {**weights, "absent": 3.0}).count() == 561
    with pytest.raises(ValueError, match="nearly empty"):
        mixing.mix_sources(df, {"big": 1e-5, "small": 1.0, mixing.NO_SOURCE: 1.0})
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": 0.0, "b": 1.0})
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": 1e-10, "b": 1.0})
    for weights in ({"a": 1e-4, "b": 1.0}, {f"s{i}": 1.0 + i % 7 for i in range(3000)}):
        got = mixing.integer_weights(weights)
        assert all(abs(got[s] / sum(got.values()) / (w / sum(weights.values())) - 1) <= 1e-6 for s, w in weights.items())


def test_segments_make_one_schedule(spark):
    names, shares = ["a", "b", "c"], list(mixing.integer_weights({"a": 5.0, "b": 2.0**0.5, "c": 0.3}).values())
    whole = mixing.scheduled(spark, shares, [400, 90, 30], names, 10**6).collect()
    parts = mixing.scheduled(spark, shares, [400, 90, 30], names, 64).collect()
    assert len(whole) == len(parts) == 520 and collections.Counter(r["__source"] for r in parts) == {"a": 400, "b": 90, "c": 30}
    assert len({r["__slot"] for r in parts}) == 520


def test_neighbours(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in table(spark, sf_dir, "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    got = collections.defaultdict(list)
    for r in ann.neighbour_report(table(spark, sf_dir, "embeddings")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        assert [k for k, _, _ in found] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in found)
        d[ids == q] = np.inf
        hit += len({v for _, v, _ in found} & set(ids[np.lexsort((ids, d))[:10]]))
    assert set(got) == {i for i in rows if i % 100 == 0} and hit >= 0.9 * 10 * len(got)


def test_neighbour_cases(spark):
    v = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [1.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [None, 1.0], "x"), (7, [1.0, 2.0, 3.0], "x"), (100, [0.5, 0.5], "x")]
    got = [tuple(r) for r in ann.neighbour_report(spark.createDataFrame(rows, v)).orderBy("query_id", "rank").collect()]
    half = float(np.sqrt(0.5))
    assert got == [(0, 1, 2, 0.0), (0, 2, 100, half), (0, 3, 1, float(np.sqrt(2.0))), (100, 1, 0, half), (100, 2, 1, half), (100, 3, 2, half)]
    assert ann.neighbour_report(spark.createDataFrame([], v)).count() == 0
    copies = [(i, [1.0, 0.0], "x") for i in range(300)]
    near = [tuple(r)[2] for r in ann.neighbour_report(spark.createDataFrame(copies, v)).filter("query_id = 100").orderBy("rank").collect()]
    assert near == list(range(10))  # ties go to smaller ids


@pytest.mark.parametrize("size", [1.0, 1e6])
def test_many_copies_of_long_vectors(spark, size):
    rng = np.random.default_rng(8)
    copy = (rng.normal(size=64) * size).tolist()
    rows = [(i, copy) for i in range(300)] + [(i, (rng.normal(size=64) * size).tolist()) for i in range(300, 600)]
    found = ann.neighbour_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.vec_id, r.score) for r in found.filter("query_id = 100").orderBy("rank").collect()]
    assert got == [(i, 0.0) for i in range(10)]
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_toxicity(spark, sf_dir, docs):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = toxicity.toxicity_report(d, labels).join(labels, "doc_id").filter("held_out").collect()  # no row is left out
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in got} == {0}
    pos, neg = ([r.score for r in got if r.toxic == t] for t in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) >= 3 and auc >= 0.75 and np.mean([r.predicted == r.toxic for r in got]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (3, "you idiot"), (4, "fine"), (4, "fine")]
    small = {r.doc_id: r.score for r in toxicity.toxicity_report(docs(rows, extra=True), none).collect()}
    assert small == {1: 0.0, 2: 0.0, 3: 0.5, 4: 0.0}
    assert toxicity.toxicity_report(docs([]), none).count() == 0


def test_pipeline(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "source_mix", "sentencepiece"]
    docs = table(spark, sf_dir, "documents").cache()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept = out.cache()
        kept.count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.count() == kept.count() and last.filter("NOT lossless").count() == 0
    assert docs.count() * 0.7 < kept.count() < docs.count()
    assert jaccard.jaccard_components(kept).filter("__component <> doc_id").count() == 0
    assert kept.filter(F.col("n_chars") != F.length("text")).count() == docs.filter(F.col("n_chars") != F.length("text")).count()


def test_source_mix_decides_the_order(spark, docs):
    rows = [(i, f"text {i}", "en", "hot" if i % 10 else f"s{i // 10 % 2}") for i in range(2000)]
    df = materialize(docs(rows).repartition(7), "docs")
    mixed = materialize(corpus_pipeline.mix_by_weight(spark, df, ""), "mixed")
    order = lambda d: [(r.position, r.doc_id) for r in corpus_pipeline.encode(spark, d, "").orderBy("position").collect()]
    wanted = mixing.mix_sources(df, mixing.tempered_weights(df)).orderBy("__slot", "__place").collect()
    assert order(mixed) == [(k, r.doc_id) for k, r in enumerate(wanted)]
    assert [i for _, i in order(df)] != [i for _, i in order(mixed)]  # the rows differ without the stage
    assert [i for _, i in order(mixed.cache())] == [r.doc_id for r in wanted]
    hot = np.mean([r.source == "hot" for r in wanted[:200]])
    assert abs(hot - 1800**0.5 / (1800**0.5 + 2 * 100**0.5)) < 0.1  # and not its share of the documents, 0.9
    assert corpus_pipeline.encode(spark, docs([]), "").count() == 0


def test_pipeline_drops_copies_at_five_words(spark, docs):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join(["x" if i == 25 else w for i, w in enumerate(words)]))]  # 0.80 at five words, 0.84 at four
    assert jaccard.jaccard_components(docs(rows)).filter("__component = 1").count() == 1
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(rows), "").collect()] == [1]


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing names: every stage gives the columns it got and keeps what it should."""
    long = "\n".join(f"line {k} of a very long text with words w{k} v{k}" for k in range(20_000))
    rows = [(None, "no id here at all", None, None), (1, None), (2, ""), (3, " \n\n"), (4, long), (5, "twice the same row"), (5, "twice the same row"), (6, "a", "en", None), (7, "b", None, "s9")]
    df = docs(rows, extra=True)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
        assert ids == sorted((r[0] for r in rows), key=str) if name != "jaccard_join" else ids == sorted({r[0] for r in rows}, key=str), name
    last = corpus_pipeline.encode(spark, df, "")
    assert last.count() == len(rows) and last.filter("NOT lossless").count() == 0
    empty = docs([])
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0, name


def test_toxic_documents_go_on_odd_rows(spark, docs, sf_dir):
    """The first stage beside real documents and alone: odd rows stay as often as they came, columns and all; a toxic very long text goes."""
    long = "a perfectly ordinary line of words about the weather\n" * 40_000
    toxic = "you stupid idiot, you worthless moron! shut up you disgusting trash!!! " * 4000
    rows = [(None, "no id here at all"), (-1, None), (-2, ""), (-3, " \n\n"), (-4, long), (-5, "twice the same row"), (-5, "twice the same row"), (-6, toxic)]
    real = table(spark, sf_dir, "documents")
    odd = docs(rows).select(*[F.col(f.name).cast(f.dataType) for f in real.schema]).withColumn("score", F.lit("x"))
    kept = corpus_pipeline.drop_toxic(spark, real.withColumn("score", F.lit("y")).unionByName(odd), sf_dir)
    assert kept.columns == [*real.columns, "score"]
    found = collections.Counter(r.doc_id for r in kept.filter("score = 'x'").select("doc_id").collect())
    assert found == {None: 1, -1: 1, -2: 1, -3: 1, -4: 1, -5: 2}
    assert kept.filter("score = 'y'").count() > 0.8 * real.count()
    alone = corpus_pipeline.drop_toxic(spark, odd, sf_dir)
    assert alone.count() == 7 and corpus_pipeline.drop_toxic(spark, odd.limit(0), sf_dir).count() == 0


def plain_toxicity_features(text, fixed, learned):
    """The features that need no stems, one by one from their definitions."""
    text = text or ""
    words = [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w]
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in fixed or w in learned]
    second = {w.decode() for w in toxicity.SECOND_PERSON}
    raw = text.encode()
    letters = max(1, sum(chr(c).isascii() and chr(c).isalpha() or c >= 128 for c in raw))
    known, taught = sum(w in fixed for w in words), sum(w in learned for w in words)
    near = sum(any(words[j] in second for j in range(max(0, i - 5), min(len(words), i + 6))) for i in hits)
    runs = sum(raw[i] == raw[i + 1] == raw[i + 2] and (raw[i] >= 128 or chr(raw[i]).isalpha()) for i in range(len(raw) - 2))
    return {0: 100 * known / n, 1: np.log1p(known), 2: 100 * taught / n, 3: np.log1p(taught), 4: len({words[i] for i in hits}), 5: np.log1p(near), 6: 100 * sum(w in second for w in words) / n, 7: sum(65 <= c <= 90 for c in raw) / letters,
            8: 100 * text.count("!") / n, 9: 100 * text.count("?") / n, 11: sum(48 <= c <= 57 for c in raw) / max(1, len(raw)), 14: 100 * runs / n, 15: np.log1p(len(words)), 16: letters / n}


def test_toxicity_features_are_what_they_say():
    rng = random.Random(4)
    lexicon = toxicity.Lexicon(["grumf", "blarg"])
    pool = ["you", "IDIOT", "moron!", "Grumf", "blarg", "your", "the", "weather?", "is", "soooo", "12", "été", "tú", "fine.", "!!!", "\n", "u"]
    for _ in range(200):
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 40, 200])))
        got = toxicity.features_of(text, lexicon)
        for k, v in plain_toxicity_features(text, set(toxicity.LEXICON), {"grumf", "blarg"}).items():
            assert got[k] == pytest.approx(v), (k, text)
    hidden = toxicity.features_of("you 1d1ot and m0r0n and a1b", lexicon)
    assert hidden[13] > 0 and hidden[12] > 0 and toxicity.features_of("you idiot", lexicon)[13] == 0
    assert toxicity.features_of(None, lexicon) == toxicity.features_of("", lexicon)
