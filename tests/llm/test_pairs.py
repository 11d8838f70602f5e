from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from odd_rows import documents, nothing, tricky  # noqa: F401

from wayfreight.llm import decontaminate, jaccard
from wayfreight.llm.common import UPPER

LOWERED = str.maketrans(UPPER, UPPER.lower())


def brute_sets(pairs, size):
    out = []
    for i, t in pairs:
        words = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWERED))
        if not words:
            out.append((i, frozenset()))
        elif len(words) < size:
            out.append((i, frozenset([tuple(words)])))
        else:
            out.append((i, frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))))
    return out


def brute_components(pairs, size, percent):
    sets = brute_sets(pairs, size)
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for x in s:
            holders[x].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                parent[root(k)] = root(j)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return sorted(((i, len(s), smallest.get(root(k))) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(tricky, documents, size, percent):
    for docs in (tricky, documents):
        pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert rows(jaccard.jaccard_components(docs, size=size, percent=percent)) == brute_components(pairs, size, percent)


def mutated(rng, words, share):
    return [w if rng.random() > share else f"m{rng.randrange(10**9)}" for w in words]


@pytest.mark.parametrize(("chunk", "short"), [(1024, 32), (7, 5)])
def test_families_of_near_copies(spark, monkeypatch, chunk, short):
    """Copies of copies around the threshold, chains among them; also with hot groups cut into small chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    rng = random.Random(4)
    texts = []
    for family in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(120 + 40 * family)]
        parts = [base]
        for _ in range(45):
            parts.append(mutated(rng, rng.choice(parts), rng.choice((0.005, 0.01, 0.02, 0.03))))
        texts += [" ".join(p) for p in parts]
    passage = " ".join(f"common{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    for percent in (90, 80):
        assert rows(jaccard.jaccard_components(docs, size=3, percent=percent)) == brute_components(pairs, 3, percent)


def test_an_id_of_several_texts(spark):
    """The smallest id of every family is the same one; each of its texts links with its own family."""
    rng = random.Random(8)
    pairs = [(None, "w1 w2 w3 w4 w5 w6"), (None, None), (0, "w1 w2 w3 w4 w5 w6")]
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(100)]
        pairs += [(0 if k == 0 else 100 * family + k // 2 + 1, " ".join(mutated(rng, base, 0.01 * (k % 3)))) for k in range(9)]
    rng.shuffle(pairs)
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    for size, percent in ((3, 90), (5, 80)):
        assert rows(jaccard.jaccard_components(docs, size=size, percent=percent)) == brute_components(pairs, size, percent)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_lists_are_cut_at_the_size_that_can_link(percent):
    n = np.sort(np.random.default_rng(3).integers(1, 60, 200))
    for a, (start, end) in enumerate(zip(*(x.tolist() for x in jaccard.reach(n, n, percent)))):
        can = [min(n[a], m) >= jaccard.overlap_needed(n[a], m, percent) for m in n]
        assert can == [start <= b < end for b in range(len(n))]


@pytest.mark.parametrize("kind", ["one text", "chain"])
def test_pairs_grow_with_a_family_and_not_with_its_square(spark, monkeypatch, kind):
    """All near copies of one text, or each a copy of an earlier one: as many pairs a copy when there are four times as many."""
    pairs = {}
    real = jaccard.stored
    monkeypatch.setattr(jaccard, "VOTES", 7)  # no pivots: everything is left to the lists
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    for n in (150, 600):
        made = []

        def counted(df, purpose, made=made):
            out = real(df, purpose)
            if purpose == "jaccard-candidates":
                made.append(out.count())
            return out

        monkeypatch.setattr(jaccard, "stored", counted)
        rng = random.Random(n)
        texts = [[f"w{rng.randrange(5000)}" for _ in range(200)]]
        while len(texts) < n:
            texts.append(mutated(rng, texts[0] if kind == "one text" else rng.choice(texts[-20:]), 0.012))
        docs = list(enumerate(" ".join(t) for t in texts))
        found = rows(jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
        assert found == brute_components(docs, 5, 80)
        pairs[n] = sum(made)
    assert pairs[600] <= 6 * pairs[150] and pairs[600] <= 20 * 600, pairs


def test_dealt_rows_meet_every_minor_row(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    many, few = range(95), {3, 17, 40}
    frame = spark.createDataFrame([(1, x, x in few, 10, 1) for x in many], "g int, x long, minor boolean, chunks int, minor_chunks int")
    met, parts = set(), defaultdict(lambda: ([], []))
    dealt = jaccard._dealt(frame, "x").collect()
    for r in dealt:
        parts[r.i, r.j][r.side].append(r.x)
    for all_rows, minor in parts.values():
        met |= {(a, b) for a in all_rows for b in minor}
    assert met == {(a, b) for a in many for b in few}
    assert len(dealt) == 95 + 3 * 10  # hardly copied


def test_one_of_each_stays(tricky, nothing):
    left = jaccard.keep_one_of_each(tricky)
    assert left.columns == tricky.columns
    assert sorted((r.doc_id for r in left.select("doc_id").collect()), key=str) == sorted([1, 3, 4, 5, 6, 8, 9, 11, 11, 12, None, None], key=str)
    assert jaccard.keep_one_of_each(nothing).count() == 0


def test_shared_keys_across_batches():
    """A stream cut anywhere gives the same rows."""
    rng = np.random.default_rng(1)
    table = sorted({(int(k), int(c)) for k, c in zip(rng.integers(0, 12, 60), rng.integers(0, 3, 60))} | {(3, 1)})
    repeated = sorted(table * 2)
    many = Counter(k for k, _ in table)
    expected = [(k, c) for k, c in table if many[k] > 1]
    for cut in (1, 2, 3, 7, 200):
        batches = [
            pa.RecordBatch.from_pydict({"key": [k for k, _ in repeated[a : a + cut]], "cls": [c for _, c in repeated[a : a + cut]]})
            for a in range(0, len(repeated), cut)
        ]
        found = [(k, c) for b in jaccard._shared_keys(iter(batches)) for k, c in zip(b["key"].to_pylist(), b["cls"].to_pylist())]
        assert found == expected


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = dict(rows(jaccard.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


# --- benchmark --------------------------------------------------------------------------------------


def norm(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").translate(LOWERED))


def brute_matches(docs, items):
    """Best weighted similarity of all windows of an item's length, without fingerprints."""
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    known = {i: Counter(shingles(norm(t))) for i, t in items if t is not None and norm(t)}
    having = Counter(s for c in known.values() for s in c)
    weight = lambda s: np.log1p(len(known) / having.get(s, 1))
    best = {}
    for d, text in docs:
        words = norm(text)
        for i, t in items:
            n = len(norm(t))
            if i not in known or n > len(words) or (n < 5 and n != len(words)):
                continue
            for f in range(len(words) - n + 1):
                window = Counter(shingles(words[f : f + n]))
                both = sum(weight(s) * min(c, known[i][s]) for s, c in window.items() if s in known[i])
                if both:
                    total = sum(weight(s) * c for s, c in (window | known[i]).items())
                    if both / total >= 0.8 - 1e-9:
                        best[d, i] = max(best.get((d, i), 0), both / total)
    return best


def test_matches_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.randrange(20, 60)))) for k in range(12)]
    items += [(20, "one two three"), (21, ""), (22, None), (23, items[0][1])]
    docs = []
    for k in range(60):
        words = [word() for _ in range(rng.randrange(0, 150))]
        if k % 2:
            copy = items[rng.randrange(12)][1].split()
            if k % 3 == 0:
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else ",\n".join(words)))
    docs += [(70, "one, two THREE"), (71, "one two three four"), (72, None), (73, ""), (1, docs[1][1])]
    frame = spark.createDataFrame([(i, t, 0.1) for i, t in docs], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = decontaminate.find_contamination(frame, bench).collect()
    expected = brute_matches(docs, items)
    assert {(r.doc_id, r.item_id) for r in found} == set(expected)
    assert len(found) == len(expected) + sum(d == 1 for d, _ in expected)
    for r in found:
        assert r.similarity == pytest.approx(expected[r.doc_id, r.item_id])


def brute_windows(docs, items):
    """Best weighted similarity of all windows of an item's length; if none will do, of windows of all lengths."""
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    known = {i: Counter(shingles(norm(t))) for i, t in items}
    having = Counter(s for c in known.values() for s in c)
    weight = lambda s: np.log1p(len(known) / having.get(s, 1))
    total = {i: sum(weight(s) * n for s, n in c.items()) for i, c in known.items()}
    best = brute_matches(docs, items)
    for d, text in docs:
        made = shingles(norm(text))
        for i in known:
            if (d, i) in best:
                continue
            for a in range(len(made)):
                both = all_of = 0.0
                seen = Counter()
                for s in made[a:]:
                    seen[s] += 1
                    all_of += weight(s)
                    both += weight(s) * (seen[s] <= known[i][s])
                    if both / (all_of + total[i] - both) >= 0.8 - 1e-9:
                        best[d, i] = max(best.get((d, i), 0), both / (all_of + total[i] - both))
    return best


def test_windows_of_other_lengths_are_found(spark):
    """Texts shorter than an item, and passages with words left out or put in."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = words(12)
    items = [(k, words(n)) for k, n in enumerate((40, 59, 20, 100))] + [(k, shared + words(20)) for k in range(4, 8)]
    items += [(8, ["again", "and", "over", "and", "out"] * 9)]
    texts = [items[0][1][:n] for n in (39, 35, 33, 32, 31, 20, 4)] + [items[0][1][k:] for k in (1, 7, 8, 12)]
    for k, item in items:
        for n in (1, 3, 7):
            at = rng.randrange(1, len(item) - n)
            for part in (item[:at] + item[at + n :], item[:at] + words(n) + item[at:], item[n:], item[:-n]):
                texts += [part, words(rng.randrange(30)) + part + words(rng.randrange(30))]
    texts.append(words(9000) + items[1][1][:27] + items[1][1][29:] + words(9000))
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    items = [(k, " ".join(t)) for k, t in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(0, 0), (1, 0), (2, 0)} <= {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame, bench).collect()}
    found = decontaminate.find_contamination(frame, bench, every_length=True).collect()
    short = docs[:-1]
    expected = brute_windows(short, items)
    assert {(0, 0), (1, 0), (2, 0)} <= set(expected) and len(expected) > len(brute_matches(short, items)) + 20
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in found if r.doc_id < len(short)} == expected
    for r in found:
        assert 0 <= r.first_word and r.first_word + r.n_words <= len(texts[r.doc_id])
    assert [r.item_id for r in found if r.doc_id == len(short)] == [1]


@pytest.mark.parametrize("radius", [decontaminate.RADIUS, 15])
def test_templated_items_are_found(spark, monkeypatch, radius):
    """Items of a long shared part and few words of their own, which weigh most; also when fingerprints find little."""
    monkeypatch.setattr(decontaminate, "RADIUS", radius)
    rng = random.Random(5)
    shared = [f"t{k}" for k in range(180)]
    items = [shared + [f"own{k}x{j}" for j in range(6)] for k in range(40)]
    docs = []
    for k in range(120):
        text = list(items[k % 40])
        for j in range(rng.randrange(6)):
            text[-1 - j] = f"z{rng.randrange(10**9)}"
        docs.append((k, " ".join(["before", *text, "after"])))
    items = [(k, " ".join(t)) for k, t in enumerate(items)]
    expected = brute_matches(docs, items)
    found = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in found.collect()} == expected
    assert len(expected) > 40 and any(s < 0.85 for s in expected.values())


def test_fingerprints_of_templated_items_are_near():
    shared = [f"t{k}" for k in range(180)]
    items = [" ".join(shared + [f"own{k}x{j}" for j in range(3)]) for k in range(300)]
    bench = decontaminate.Benchmark(list(range(300)), items)
    assert min(decontaminate._similarity(bench, k, bench.items[0][0]) for k in range(300)) > 0.78
    apart = [sum(int(x).bit_count() for x in bench.prints[0] ^ bench.prints[k]) for k in range(1, 300)]
    assert max(apart) <= decontaminate.RADIUS


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    bench = decontaminate.Benchmark(list(range(30)), [" ".join(f"w{x}" for x in rng.integers(0, 999, 30)) for _ in range(30)])
    flips = rng.integers(0, 110, 400)
    prints = np.repeat(bench.prints, 14, axis=0)[:400].copy()
    for row, n in zip(prints, flips):
        for bit in rng.choice(256, n, replace=False):
            row[bit // 16] ^= 1 << (bit % 16)
    found = {(k, int(r)) for k, hit in bench.near(prints) for r in hit}
    count = lambda a, b: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b))
    expected = {(k, r) for k in range(30) for r in range(400) if count(bench.prints[k], prints[r]) <= decontaminate.RADIUS}
    assert found == expected and expected


def test_contaminated_documents_go(spark, tricky, nothing):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None)], "item_id long, text string")
    left = decontaminate.drop_contaminated(tricky, bench)
    assert left.columns == tricky.columns
    assert not {1, 2} & {r.doc_id for r in left.select("doc_id").collect()}
    assert left.count() == tricky.count() - 2
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert decontaminate.find_contamination(tricky, bench.limit(0)).count() == 0


@pytest.mark.parametrize("most", [60_000, 3_000, 400])
def test_parts_of_a_benchmark_give_the_same_matches(spark, monkeypatch, most):
    """Templated items share shingles across parts; texts hold them whole, edited, mixed and with words lost."""
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    frames = [word(12) for _ in range(4)]
    items = [(k, f"{frames[k % 4]} {word(25)} {frames[(k + 1) % 4]}") for k in range(60)] + [(60, "one two"), (61, ""), (5, word(30))]
    texts = []
    for k in range(150):
        words = f"{items[k % 60][1]}".split()
        if k % 3:
            words[int(rng.integers(0, len(words)))] = frames[k % 4] if k % 3 == 1 else "x"
        texts.append((k, f"{word(20)} {' '.join(words)} {frames[k % 4]} {word(9)}"))
    texts += [(150, "One Two"), (151, None), (152, word(400))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in decontaminate.find_contamination(docs, bench, every_length=True).collect())
    whole = found()
    monkeypatch.setattr(decontaminate, "MOST_BENCHMARK_BYTES", most)
    split = found()
    assert [r[:2] + r[3:] for r in split] == [r[:2] + r[3:] for r in whole]
    assert [r[2] for r in split] == pytest.approx([r[2] for r in whole])
    assert {(k, k % 60) for k in range(0, 150, 3)} <= {r[:2] for r in whole}
    with monkeypatch.context() as m:
        m.setattr(decontaminate, "MOST_SHARED", 3)
        if most < 60_000:
            with pytest.raises(ValueError, match="several items"):
                found()
