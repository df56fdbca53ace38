import random
import re

import pytest

from colloquy.llm.decontamination import Pattern, drop_contaminated, find_passages


def edit_distance_inside(pattern: bytes, text: bytes) -> int:
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(200):
        pattern = bytes(rng.choices(b"abc", k=rng.randint(1, 90)))
        text = bytes(rng.choices(b"abc", k=rng.randint(0, 120)))
        assert Pattern.of(0, pattern, 0).distance(text) == edit_distance_inside(pattern, text)


def plain(text):
    return re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", text.lower().encode())


def found_in(item, text):
    """The item's distance in the text where that is within its budget; short items stand between blanks."""
    pattern = plain(item or "").strip()
    budget = int(len(pattern) * 0.08)
    if not pattern:
        return None
    if len(pattern) < 25:
        pattern = b" " + pattern + b" "
    n = edit_distance_inside(pattern, re.sub(rb" +", b" ", b" " + plain(text or "") + b" "))
    return n if n <= budget else None


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(90, None), (None, text(20)), (91, ""), (92, "abc")]
    docs = [(None, text(30)), (1000, None), (1001, ""), (1002, "...")]
    for d in range(150):
        body = text(rng.randint(0, 60))
        if d % 2:
            passage = list(rng.choice(items[:25])[1])
            for _ in range(rng.randint(0, 1 + len(passage) // 8)):
                at = rng.randrange(len(passage))
                passage[at] = rng.choice(["", "x", "Q", passage[at] + "z", passage[at].upper()])
            body = f"{body}, {''.join(passage)}!\n{text(5)}"
        docs.append((d, body))
    docs.append((3, docs[9][1]))
    return docs, items


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_against_brute_force(spark, case, block_bytes):
    docs, items = case
    expected = {}
    for d, text in docs:
        for i, item in items:
            if i is not None and (n := found_in(item, text)) is not None:
                expected[d, i] = min(n, expected.get((d, i), n))
    frame = spark.createDataFrame([(d, t, i) for (d, t), i in zip(docs, range(len(docs)), strict=True)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = find_passages(frame, bench, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in found} == expected and len(found) == len(expected) > 30
    kept = drop_contaminated(frame, bench, block_bytes=block_bytes)
    assert kept.columns == frame.columns
    bad = {i for i, (_, t) in enumerate(docs) if any(j is not None and found_in(x, t) is not None for j, x in items)}
    assert {r.item_id for r in kept.collect()} == set(range(len(docs))) - bad


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s")], "item_id long, text string")
    assert find_passages(docs, items).count() == 0
    assert find_passages(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
    assert drop_contaminated(items, items.limit(0)).count() == 1


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "The quick, brown fox"), (2, "cat"), (3, "42"), (4, "?!"), (5, "x")], "item_id long, text string")
    texts = ["see the quick brown fox!", "the quick browm fox", "education", "a Cat.", "cat", "1423", "n=42", "", None, "quick brown", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in find_passages(docs, items).collect()}
    assert found == {(0, 1): 0, (1, 1): 1, (3, 2): 0, (4, 2): 0, (6, 3): 0, (10, 5): 0}
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {2, 5, 7, 8, 9}


def test_long_texts_are_searched_whole(spark):
    item = "which of these nine planets is the nearest to the sun and why is that so"
    filler = "plain filler words without end " * 120_000
    docs = spark.createDataFrame([(1, filler + item), (2, filler), (2, item + filler), (3, filler[:-3] + item.replace("nine", "nin") + filler)], "doc_id long, text string")
    rows = find_passages(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.distance) for r in rows) == [(1, 0), (2, 0), (3, 1)]
