"""Recall and precision of the added spans in the documents' own prose, and the detector's work on long runs."""

import random
import time

import numpy as np
import pytest

from ledgerlens.llm import pii

DOCS = "/root/testdata/sf0.01/documents.parquet"


def planted(texts, source, seed=11):
    """Texts with positive examples of a source put between words, and their spans."""
    r, out = random.Random(seed), []
    found, spans, good = pii.examples(4000, seed, source)
    items = [(k, t[a:b]) for t, (k, a, b), g in zip(found, spans, good) if g]
    for t in texts:
        words, here = t.split(" ")[:400], []
        chosen = r.sample(items, 4)
        places = sorted(r.sample(range(len(words) + 1), min(4, len(words) + 1)))
        at, text = 0, ""
        for place, (kind, s) in zip(places, chosen):
            text += "".join(w + " " for w in words[at:place])
            at = place
            if r.random() < 0.4:
                text += r.choice(pii._CUES[kind]) + r.choice((": ", " "))
            here.append((kind, len(text), len(text) + len(s)))
            text += s + r.choice((" ", ", ", "\n"))
        out.append((text + " ".join(words[at:]), here))
    return out


@pytest.mark.parametrize("source", ["train", "calibrate"])
def test_recall_and_precision_in_prose(spark, source):
    texts = [r.text for r in spark.read.parquet(DOCS).select("text").where("text is not null").orderBy("doc_id").limit(500).collect()]
    rows = planted(texts, source)
    plain = pii.find(texts, pii.detector())
    assert sum(len(every) - len(base) for base, every in plain) <= len(texts) // 100  # the documents' own prose has next to none
    hit, n, right, added = ({k: 0 for k in pii.KINDS} for _ in range(4))
    for (text, here), (base, every) in zip(rows, pii.find([t for t, _ in rows], pii.detector())):
        for s in here:
            n[s[0]] += 1
            hit[s[0]] += any(k == s[0] and a <= s[1] and b >= s[2] for k, a, b in every)
        for k, a, b in set(every) - set(base):
            added[k] += 1
            right[k] += any(k == s[0] and a < s[2] and s[1] < b for s in here)
    recall, precision = {k: round(hit[k] / n[k], 3) for k in n}, {k: round(right[k] / max(1, added[k]), 3) for k in n}
    print(source, "recall", recall, "precision", precision)
    assert min(precision.values()) >= 0.95, precision
    assert all(recall[k] >= (0.9 if source == "train" else 0.6) for k in recall), recall


def test_forms_that_base_patterns_miss():
    d = pii.detector()
    for text, want in {
        "phone: 030 1234567 now": [("phone", "030 1234567")],
        "see 2001:db8:0:0:0:0:2:1 ok and 2001:db8::1 too": [("ip", "2001:db8:0:0:0:0:2:1"), ("ip", "2001:db8::1")],
        "write to john (at) corp (dot) com today": [("email", "john (at) corp (dot) com")],
        "at 12:34:56:78:90:12:34:56 x": [],
        "mac aa:bb:cc:dd:ee:ff and std::vector a::b at 12:30:45": [],
        "order 12345678 of 2024-01-02": [],
    }.items():
        assert [(k, text[a:b]) for k, a, b in pii.find([text], d)[0][1]] == want
    pair = "(555) 123-4567 (555) 987-6543"  # of two numbers in a row at least one stands out
    assert {pair[a:b] for _, a, b in pii.find([pair], d)[0][1]} & {"(555) 123-4567", "(555) 987-6543"}


def test_every_kind_has_positives_and_negatives_of_both_sources():
    for source in ("train", "calibrate"):
        _, spans, y = pii.examples(800, 3, source)
        kinds = np.array([s[0] for s in spans])
        assert all({0, 1} == set(np.array(y)[kinds == k].tolist()) for k in pii.KINDS)
    train, held = ({t[a:b] for t, (_, a, b) in zip(*pii.examples(3000, 5, s)[:2])} for s in ("train", "calibrate"))
    assert len(train & held) < 0.02 * len(held)


def test_overlaps_and_work_are_linear():
    d, took = pii.detector(), []
    for n in (4000, 16000):
        t = "(555) 123-4567 " * n
        began = time.process_time()
        assert pii.find([t], d)[0][0] == []
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]
    taken = pii._Taken([(5, 9), (1, 3), (8, 12)])
    assert [taken.meets(a, a + 1) for a in range(13)] == [False, True, True, False, False] + [True] * 7 + [False]
