import random

from ledgerlens.llm import line_dedup


def plain(rows, w=3, long_words=50):
    runs = []
    for i, t in rows:
        lines = [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()]
        if 0 < len(lines) < w:
            runs.append((("whole", *(x for _, x in lines)), (i, 0), [n for n, _ in lines]))
        for size in (1, 2, w):
            for s in range(len(lines) - size + 1):
                part = lines[s : s + size]
                if size == w or sum(len(x.split()) for _, x in part) > long_words:
                    runs.append((tuple(x for _, x in part), (i, s), [n for n, _ in part]))
    first, gone = {}, {}
    for content, place, _ in runs:
        first[content] = min(first.get(content, place), place)
    for content, place, numbers in runs:
        if first[content] != place:
            gone.setdefault(place[0], set()).update(numbers)
    return {i: sorted(n) for i, n in gone.items()}


def test_long_lines_and_short_texts_count(spark):
    r = random.Random(2)
    line = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    pool = [line(n) for n in (1, 5, 20, 24, 26, 30, 50, 51, 60, 90)] + ["", "  "]
    rows = [(i, "\n".join(r.choice([*pool, *[line(8)] * 6]) for _ in range(r.choice([1, 1, 2, 2, 3, 9])))) for i in range(150)]
    rows += [(900, "short copy"), (901, " short copy \n\n"), (902, f"{pool[-3]}"), (903, f"a\n{pool[-3]}\nb c\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert {x.doc_id: x.lines for x in line_dedup.repeated_lines(df, long_words=50).collect()} == want
    assert want[901] == [0] and 1 in want[903]
    texts = {x.doc_id: x.text for x in line_dedup.deduplicate(df).collect()}
    assert 900 in texts and 901 not in texts and texts[903] == "a\nb c\nd"
