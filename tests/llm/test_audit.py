import random
from collections import defaultdict
from itertools import permutations

import oracle
import pytest
from threadloom.llm import audit, queries

SMALL = "/root/testdata/sf0.001"
FIELDS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(docs, labels):
    """Apply the filters one after the other, order by order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))

    def fails(i, text):
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text),
            "D": any(c in text for c in "#$%&*|"), "E": i is not None and i > first.get(text, i),
        }

    parts = defaultdict(list)
    for i, text, source in docs:
        parts[source or ""].append((i, fails(i, text)))
    rows = []
    for part, own in parts.items():
        shapley = defaultdict(int)
        mine = []
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, start=1):
                now = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                redundant = sum(d[1][f] for d in gone)
                gone = gone + now
                shapley[f] += len(now)
                alone = sum(sum(d[1].values()) == 1 and d[1][f] for d in own)
                mine.append((part, "".join(order), step, len(left), len(now), redundant, alone, sum(d[0] in good for d in now), sum(d[0] in toxic for d in now)))
        rows += [(*r, shapley[r[1][r[2] - 1]]) for r in mine]
    return sorted(rows)


def collected(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def frames(spark, docs, labels, extra=""):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, Part int").repartition(3)
    return d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")


def test_query_equals_sql(spark):
    columns, got = oracle.spark_rows(queries.op11_filter_audit(spark, SMALL))
    want_columns, want = oracle.sql_rows(oracle.connect(SMALL), queries.SQL["op11_filter_audit"])
    assert columns == want_columns and got == want


def test_every_order_by_hand(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "Bc", "d#", "éé", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([0, 3, 199, 200, 260]))) for _ in range(60)]
    texts += [" ".join(f"u{k}" for k in range(210)), " ".join(["x"] * 300), "ÀÉ plain", "A" + "a" * 49, "A" + "a" * 48, " one word", "\x1ctwo\x0bwords\x85"]
    docs = [(i, t, rng.choice(["web", "books", None, ""])) for i, t in enumerate(texts * 2)]
    docs += [(None, None, "web"), (None, "", "web"), (None, texts[0], None), (500, None, "new"), (500, None, "new"), (500, "", "new"), (499, "", "web"), (-1, "only", "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (500, 1, 1)]
    assert collected(audit.audit_filters(*frames(spark, docs, labels))) == by_hand(docs, labels)


def test_no_rows(spark):
    assert audit.audit_filters(*frames(spark, [], [])).count() == 0
    one = collected(audit.audit_filters(*frames(spark, [(1, "a", "s")], [])))
    assert len(one) == 600 and one == by_hand([(1, "a", "s")], [])


@pytest.mark.parametrize("n", [1, 255, 256, 65_535, 65_536, 10**12])
def test_full_fields_do_not_run_over(spark, n):
    counts = spark.createDataFrame([("p", 31, True, True, n)], "part string, mask int, good boolean, toxic boolean, n long")
    rows = audit.step_counts(counts).collect()
    assert len(rows) == 600
    for r in rows:
        first = r["step"] == 1
        assert (r["kept"], r["removed"], r["redundant"]) == (0, n if first else 0, 0 if first else n)
        assert (r["good_lost"], r["toxic_lost"], r["unique_fails"]) == (r["removed"], r["removed"], 0)
        assert r["shapley"] == 24 * n


def test_copies_fold_before_they_meet(spark):
    docs = spark.createDataFrame([(i, "same text", "hot") for i in range(500)] + [(1000 + i, f"t {i}", "cold") for i in range(50)], "doc_id long, text string, source string")
    rows = [r for r in audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() if r["part"] == "hot" and r["filter_order"] == "EABCD"]
    assert {r["step"]: (r["kept"], r["removed"]) for r in rows} == {1: (1, 499), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
