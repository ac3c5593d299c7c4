"""Merged license spans are verified in order; drifting and shuffled notices have no label."""

import random

from stavework.llm import licenses

NOTICE = next(n for n, label in licenses.NOTICES.items() if label == "mit-text").split()


def labels(spark, texts):
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r.doc_id: (r.labels, round(r.score, 6)) for r in out.collect()}


def chain(template, words):
    """Most template words in order in any stretch of the words whose diagonals are at most DRIFT apart (by pairs that stand together)."""
    pairs = [(i, p) for i in range(len(words) - 1) for p in range(len(template) - 1) if words[i : i + 2] == template[p : p + 2]]
    most = 0
    for low in {i - p for i, p in pairs}:
        at = sorted({(p + k, i + k) for i, p in pairs for k in (0, 1) if low <= i - p <= low + licenses.DRIFT})
        best = {}
        for w, i in at:
            best[w, i] = 1 + max((n for (v, j), n in best.items() if v < w and j < i), default=0)
        most = max(most, *best.values())
    return most / len(template)


def test_words_that_drift_apart_or_are_turned_round_are_no_license(spark):
    drifting = " zz yy ".join(" ".join(NOTICE[i : i + 2]) for i in range(len(NOTICE) - 1))
    backwards = " ".join(" ".join(NOTICE[i : i + 4]) for i in range(len(NOTICE) - 4, -1, -4))
    inserted = " ".join([*NOTICE[:6], "quite", *NOTICE[6:12], "really", *NOTICE[12:]])
    shortened = " ".join([*NOTICE[:5], *NOTICE[6:]])
    got = labels(spark, [drifting, backwards, inserted, shortened, " ".join(NOTICE)])
    assert [got[i][0] for i in range(5)] == ["", "", "mit-text", "mit-text", "mit-text"]
    assert got[0][1] == 0 and got[4][1] == 1 and got[2][1] == 1


def test_shares_equal_a_plain_chain(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = list(NOTICE)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(words))
            kind = rng.randrange(4)
            if kind == 0:
                words.insert(i, rng.choice(["of", "to", "zz"]))
            elif kind == 1:
                del words[i]
            elif kind == 2:
                words[i : i + 2] = words[i : i + 2][::-1]
            else:
                words = words[i:] + words[:i]
        texts.append(" ".join(words))
    got = labels(spark, texts)
    seen = set()
    for i, text in enumerate(texts):
        share = chain(NOTICE, text.split())
        expected = round(share, 6) if share >= licenses.LEAST_SHARE else 0.0
        seen.add(expected > 0)
        assert got[i] == ("mit-text" if expected else "", expected), text
    assert seen == {True, False}
