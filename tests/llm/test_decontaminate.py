import hashlib
import random
import re

import pytest

from deskspark.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        words = WORDS.findall(lower(text))
        if words:
            for i in range(max(1, len(words) - size + 1)):
                wins.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        words, hit, names = WORDS.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = wins.get(tuple(words[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        told = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(names), told, bool(hit)))
    return sorted(out, key=repr)


def run(spark, frame, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = D.contamination(D.find_benchmark_text(frame(docs), table))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_windows_short_items_repeats_and_odd_rows(spark, frame, prose, odd):
    items = [(1, prose(1, 14)), (2, prose(2, 10)), (3, "A."), (10, prose(2, 10)), (4, None), (5, "?!"), (6, "one TWO; three")]
    inside = prose(1, 14)
    docs = [
        (1, f"Before {inside.upper()} after"),
        (2, inside.replace(" ", " -- ")),
        (3, prose(3, 40)),
        (3, prose(3, 40)),
        (4, " ".join(prose(1, 14).split()[:9])),
        (5, f"x {prose(2, 10)} {prose(2, 10)} a One,two\nthree"),
        (6, (prose(6, 500) + " ") * 40 + inside),
        *odd,
    ]
    assert run(spark, frame, docs, items) == brute(docs, items)


def test_random_texts_over_few_words(spark, frame):
    draw = random.Random(4)
    items = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(1, 14)))) for i in range(6)]
    docs = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(0, 80)))) for i in range(60)]
    assert run(spark, frame, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], [])])
def test_empty_tables(spark, frame, docs, items):
    assert [r[:4] for r in run(spark, frame, docs, items)] == [(1, 2, 0, 0)] * len(docs)


def test_loads_are_of_bounded_size(spark, prose, monkeypatch):
    monkeypatch.setattr(D, "SEARCH_BYTES", 3000)
    items = spark.createDataFrame([(i, prose(i % 30, 40)) for i in range(60)], "item_id long, text string")
    few, folder, loads = D._loads(items, "item_id", "text", 10)
    read = list(D._read_loads(folder, loads))
    assert few == [] and loads > 5
    assert max(sum(len(w) for w in load.owners) for load in read) < 3 * 3000
    whole = {w: names for load in read for w, names in load.owners.items()}
    assert len(whole) == sum(len(load.owners) for load in read) == D.item_windows(items, "item_id", "text", 10).count()
    assert all(len(names) == 2 for names in whole.values())


def test_many_searches_give_the_same(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(D, "SEARCH_BYTES", 400)
    items = [(i, prose(i, 15)) for i in range(20)]
    docs = [(i, prose(i, 15) + " " + prose(i + 1, 12)) for i in range(0, 40, 3)]
    assert run(spark, frame, docs, items) == brute(docs, items)
