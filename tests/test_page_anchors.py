"""Anchors of pages, one pass over a pair's texts."""

import random

from collatio.functions import scalar as s
from collatio.operators import review


def test_anchors_equal_all_pairs_compared():
    rng = random.Random(2)
    words = ["net", "income", "rose", "in", "the", "quarter", "a", "5", "(3)", "costs"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 12])))

    def fits(a, b):
        a, b = s.no_refs(a), s.no_refs(b)
        return bool(b and s.bag_of(a)) and (a == b or max(s.overlap(a, b), s.overlap(b, a)) >= 0.82 or round(s.alike(a, b), 9) >= 0.9)

    found = 0
    for _ in range(300):
        tops, texts = [{"page": k, "order": 10 * k, "text": some()} for k in range(6)], [some() for _ in range(3)] + [None]
        want = [(t["page"], t["order"]) for t in tops if (len(s.bag_of(t["text"])) >= 3 or len(s.key_of(t["text"])) >= 24) and any(fits(t["text"], x) for x in texts)]
        assert list(review.anchored_tops(tops, texts)) == want
        found += len(want)
    assert 100 < found < 1500


def test_texts_of_a_pair_go_to_python_once(spark):
    """A pair is one row, so its blocks are not repeated for each of its texts."""
    right = spark.createDataFrame([(1, 3, 7, "net income rose in the quarter"), (2, 4, 9, "nothing like it is said")], "pair_id long, page int, order int, text string")
    left = spark.createDataFrame([(1, "net income rose in a quarter"), (1, None), (2, "costs")], "pair_id long, text string")
    got = review.anchors(right, left)
    assert [tuple(r) for r in got.collect()] == [(1, 3, 7)] and got.schema["order"].dataType == right.schema["order"].dataType
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
