"""Line windows, benchmark passages and n-gram Jaccard against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from threadloom.llm import decontaminate, jaccard, lines
from threadloom.llm.components import components

from conftest import words


def brute_lines(rows, width):
    """Texts by doc_id when every later window loses its lines; ids are unique here."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        own = (text or "").split("\n")
        gone = set()
        for p in range(max(1, len(own) - width + 1)):
            window = tuple(own[p : p + width])
            if any(x.strip(" ") for x in window):
                if window in seen:
                    gone.update(range(p, min(p + width, len(own))))
                seen.add(window)
        out[i] = (text if not gone else "\n".join(x for k, x in enumerate(own) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("width", [1, 3])
def test_line_windows_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(i, "\n".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 30)))) for i in range(80)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in lines.dedup_lines(docs, width, "gone").collect()}
    assert got == brute_lines(rows, width)


def test_line_windows_on_edge_rows(edge_docs, edge_rows, no_docs):
    out = lines.dedup_lines(edge_docs, removed="gone")
    rows = out.collect()
    assert out.columns == [*edge_docs.columns, "gone"] and len(rows) == len(edge_rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r["doc_id"]].append(r["text"])
    assert texts[10] == ["line x\nlast"] and texts[9][0].count("\n") == 3
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == ["   \n \t"]
    assert texts[4][0] and texts[5] == ["", ""]  # equal id and text: one document, later than 4
    assert lines.dedup_lines(no_docs).count() == 0


def edits(rng, text, n):
    chars = list(text)
    for _ in range(n):
        chars[rng.randrange(len(chars))] = rng.choice("abcde")
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_search_is_the_least_distance_to_any_part():
    rng = random.Random(5)
    for _ in range(200):
        p = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 8)))
        t = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 12)))
        n, a, b = decontaminate.best_part(p, t)
        assert n == min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert n == distance(p, t[a:b])


def test_passages_within_the_rate_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    items = [(k, words(rng, rng.randrange(12, 50), 5000)) for k in range(30)] + [(90, None), (None, "no id here at all"), (91, "  ")]
    docs, want = [], set()
    for i in range(300):
        text = words(rng, 120, 5000)
        if i % 3 == 0:
            k = rng.randrange(30)
            passage = edits(rng, items[k][1], int(0.08 * len(items[k][1])) if i % 2 else 0)
            if i % 4 == 0:
                passage = passage.upper().replace(" ", "\n", 3)
            text = f"{text} {passage} {words(rng, 50, 5000)}"
            want.add((i, k))
        docs.append((i, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = decontaminate.find_leaks(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    for r in found:
        span = " ".join(docs[r["doc_id"]][1].lower().split()[r["first_word"] : r["end_word"]])
        assert distance(span, items[r["item_id"]][1]) <= r["distance"] + 12  # the span is rounded to whole words
    sliced = decontaminate.find_leaks(frame, bench, slice_chars=1000).collect()
    assert {(r["doc_id"], r["item_id"]) for r in sliced} == want
    kept = decontaminate.drop_leaks(frame, bench).collect()
    assert {r["doc_id"] for r in kept} == set(range(300)) - {i for i, _ in want}


def test_copies_without_three_whole_words_are_found():
    """At every rate up to the largest one, with random edits and with a letter changed in every third word."""
    rng = random.Random(21)
    items = [(k, words(rng, rng.randrange(12, 50), 5000)) for k in range(30)]
    index = decontaminate.ItemIndex(items, 0.2)
    for rate in (0.1, 0.15, 0.2, None):
        texts = []
        for _, text in items:
            if rate is None:
                copy = " ".join(w if n % 3 else "#" + w[1:] for n, w in enumerate(text.split()))
            else:
                copy = edits(rng, text, int(rate * len(text)))
            texts.append(f"{words(rng, 60, 5000)} {copy} {words(rng, 60, 5000)}")
        found = {(d, i) for d, i, *_ in index.find(texts)}
        assert {(k, k) for k in range(30)} <= found


def test_leaks_equal_a_search_of_every_pair(spark):
    """Copies at all rates among clean texts of few syllables, against the least distance of every pair."""
    rng = random.Random(31)
    sound = ["the", "ing", "tion", "ha", "re", "on", "er", "st", "nd", "ea"]

    def prose(n):
        return " ".join("".join(rng.choices(sound, k=rng.randrange(1, 4))) for _ in range(n))

    items = [(k, prose(rng.randrange(3, 50))) for k in range(40)]
    docs = []
    for i in range(160):
        text = prose(rng.randrange(60))
        if i % 2:
            own = rng.choice(items)[1]
            text = f"{text} {edits(rng, own, int(rng.choice((0, 0.05, 0.1, 0.15, 0.19)) * len(own)))} {prose(20)}"
        docs.append((i, text))
    plain = [" ".join(t.split()) for _, t in docs]
    want = {(i, k) for i, t in enumerate(plain) for k, p in items if decontaminate.best_part(p, t)[0] <= int(0.2 * len(p))}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= want and len(found) >= 0.97 * len(want) > 60
    index = decontaminate.ItemIndex(items, 0.2)
    together = index.find([t for _, t in docs])
    assert together == [(i, *row) for i, (_, t) in enumerate(docs) for _, *row in index.find([t])]


def test_a_very_long_item():
    rng = random.Random(32)
    long = words(rng, 9_000, 5000)
    assert len(long) > 50_000
    copy = edits(rng, long, len(long) // 20)
    index = decontaminate.ItemIndex([(1, long), (2, "a" * 3000)], 0.2)
    found = index.find([f"{words(rng, 500, 5000)} {copy}", words(rng, 9_000, 5000), "a" * 5000, None, ""])
    assert {(d, i) for d, i, *_ in found} == {(0, 1), (2, 2)}


def test_search_of_many_is_the_search_of_each():
    rng = random.Random(22)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 150))), "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 200)))) for _ in range(300)]
    best = [decontaminate.best_part(p, t)[0] for p, t in pairs]
    for more in (-1, 0):
        codes = [[decontaminate._codes(x) for x in xs] for xs in zip(*pairs, strict=True)]
        limits = decontaminate.np.array(best) + more
        assert decontaminate.within(*codes, limits).tolist() == [more == 0] * len(pairs)


def test_passages_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    bench = spark.createDataFrame([(1, "line b line c"), (2, "one"), (1, "line b line c")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(edge_docs, bench).collect()}
    assert found == {(9, 1), (10, 1), (8, 2), (11, 2)}
    kept = decontaminate.drop_leaks(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(edge_docs, none).count() == 0 == decontaminate.find_leaks(no_docs, bench).count()
    assert decontaminate.drop_leaks(edge_docs, none).count() == len(edge_rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 200), (300, None)]
    parent = {v: v for e in edges if None not in e for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((v, root(v)) for v in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(rng):
    rows = []
    for group in range(40):
        base = words(rng, rng.choice([3, 8, 60, 150]), 3000).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), (" " if group % 2 else "  ").join(own)))
    hot = words(rng, 200, 3000).split()
    for k in range(60):  # one large group, every text different
        rows.append((len(rows), " ".join(hot[:190] + [f"z{k}"])))
    return rows


def brute_near(rows):
    """Links of each text and the least id of each component."""
    sets = {}
    for _, t in rows:
        w = (t or "").lower().split()
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {t: {u for u in sets if u != t and sets[t] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])} for t in sets}
    ids = defaultdict(list)
    for i, t in rows:
        ids[t].append(i)
    group = {}
    for t in sets:
        if t not in group:
            stack, own = [t], {t}
            while stack:
                for u in links[stack.pop()] - own:
                    own.add(u)
                    stack.append(u)
            known = [i for u in own for i in ids[u] if i is not None]
            group.update(dict.fromkeys(own, min(known, default=None)))
    return links, group, sets


@pytest.mark.parametrize("block", [jaccard.BLOCK_CLASSES, 9])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = near_texts(random.Random(4))
    text = dict(rows)
    links, group, _ = brute_near(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["class_id"], r["n_links"]) == (group[text[r["doc_id"]]], len(links[text[r["doc_id"]]]))
    assert Counter(r["class_id"] for r in got if r["is_first"]) == Counter(dict.fromkeys(set(group.values()), 1))
    assert all(r["doc_id"] == r["class_id"] for r in got if r["is_first"])


def test_empty_blocks_add_no_links(spark, monkeypatch):
    """Long texts make more blocks than a component fills."""
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 30)
    rng = random.Random(12)
    rows = []
    for _ in range(30):
        base = words(rng, 80, 3000).split()
        rows += [(len(rows) + k, " ".join([*base, f"end{k}"])) for k in range(2)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (i - i % 2, 1) for i, _ in rows}


def test_near_duplicates_on_edge_rows(edge_docs, edge_rows, no_docs):
    _, group, sets = brute_near([(i, t) for i, t, *_ in edge_rows])
    got = jaccard.near_duplicates(edge_docs).collect()
    want = Counter((i, group[t] if sets[t] else i) for i, t, *_ in edge_rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    kept = jaccard.keep_first(edge_docs)
    left = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == edge_docs.columns
    # 5 (twice) and 6 go with 4; rows without words all stay.
    assert left == Counter(i for i, *_ in edge_rows) - Counter({5: 2, 6: 1})
    assert jaccard.near_duplicates(no_docs).count() == 0 == jaccard.keep_first(no_docs).count()


def test_pruning_keeps_what_can_still_reach_the_threshold():
    checks = jaccard.least_matches(0.8, 1e-6)
    assert [n for n, _ in checks] == list(range(16, 129, 16))
    assert all(0 < m < 0.8 * n for n, m in checks) and [m for _, m in checks] == sorted(m for _, m in checks)


def test_rows_without_words_are_all_kept_whatever_their_white_space(spark):
    rows = [(1, "\u00a0"), (1, "\u00a0"), (1, " "), (2, "\u2003"), (2, "\u2003"), (None, None), (None, None), *[(3, "some words of a text")] * 2]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(rows) - Counter([(3, "some words of a text")])
