import random
import zlib

import numpy as np
import pytest

from colloquy.llm.packing import PROBES, Encoder, best_fit_decreasing, fill_slack, pack_documents
from colloquy.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = [*PROBES, "a <|endoftext|> b", "<|endoftext|><|endoftext|>x  <|endoftext|>", "<|endoftext", "", "x" * 5000, "a  b\n\n c ", "word " * 3000, "\x1c!\x1c x", "   z　　w", None, "word " * 3000]


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encode = Encoder(tokenizer_path(), keep=3)
    texts = [t or "" for t in TEXTS]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 40))), reverse=True)
        used: list[int] = []
        expected = []
        for n in lengths:
            fits = [64 - u for u in used if 64 - u >= n]
            expected.append(min(fits, default=64))
            if fits:
                used[next(i for i, u in enumerate(used) if 64 - u == min(fits))] += n
            else:
                used.append(n)
        bins, offsets = best_fit_decreasing(lengths, 64)
        assert [64 - o for o in offsets] == expected


def test_slack_is_filled():
    lengths = sorted((random.Random(2).randint(400, 1023) for _ in range(500)), reverse=True)
    parts = fill_slack(best_fit_decreasing(lengths, 1024)[0], lengths, 1024, 16)
    used: dict[int, int] = {}
    for p, n in zip(parts, lengths, strict=True):
        assert [a for _, a, _ in p] == [sum(x for _, _, x in p[:i]) for i in range(len(p))] and sum(x for _, _, x in p) == n
        for b, _, x in p:
            used[b] = used.get(b, 0) + x
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 1024
    assert sum(used.values()) > 0.98 * 1024 * (len(used) - 1)


def test_pieces_hold_every_id_once(spark, tokenizer):
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    rows = pack_documents(docs, tokenizer_path(), group_docs=4).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i if i else None], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 1024


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_many_equal_rows_are_split(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 3000 + [(None, None)] * 1000, "doc_id long, text string").coalesce(1)
    rows = pack_documents(docs, tokenizer_path(), group_docs=400).collect()
    by_group = {}
    for r in rows:
        by_group[r.sequence_id >> 32] = by_group.get(r.sequence_id >> 32, 0) + 1
    assert len(by_group) == 10 and max(by_group.values()) < 700
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {1: 3000 * rows[[r.doc_id for r in rows].index(1)].doc_tokens, None: 1000}
