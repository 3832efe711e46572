import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from motorlake.llm import packing, wordcuts

tokenizers = pytest.importorskip("tokenizers")

SIGNS = [*" a b the\n\t  ▁▁é<s></s>&;\r{}()0123漢🙂　\xa0​'s\x1c\x85᠎​﻿", "tion", "</s>", "<|endoftext|>", "\n", "    ", " word", " word\n", "don't", "\x00"]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(packing.vocabulary_path())


def test_ids_are_those_of_the_library(tokenizer):
    rnd, encoder = random.Random(1), packing.Encoder(tokenizer, remembered=300)
    for _ in range(800):
        texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(40))) for _ in range(3)]
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_joined_segments_are_the_text():
    rnd = random.Random(2)
    for _ in range(2000):
        text = "".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(30)))
        assert "".join(map(wordcuts.segment, wordcuts.keys(text))) == (" " + text if text else "")


def filled(plan, counts):
    """Every place of a plan, checked: nothing overlaps, no gaps, every piece has one."""
    bins, given = defaultdict(list), Counter()
    for (length, rank, sequence, each, offset), count in runs_with_counts(plan, counts):
        assert rank == given[length]
        for n in range(count):
            bins[sequence + n // each].append((offset + n % each * length, length))
        given[length] += count
    assert given == Counter({k: n for k, n in counts.items() if n})
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert set(bins) == set(range(plan.sequences))
    return bins


def runs_with_counts(plan, counts):
    runs = sorted(plan.runs)
    for k, run in enumerate(runs):
        later = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == run[0] else counts[run[0]]
        yield run, later - run[1]


def test_plan_fills_tightly():
    rnd = random.Random(3)
    for capacity in (7, 12, 60, 1024):
        for _ in range(60):
            counts = Counter({k: rnd.randrange(9) for k in rnd.sample(range(1, capacity + 1), min(capacity, 40))})
            plan = packing.make_plan(counts, capacity)
            bins = filled(plan, counts)
            for parts in bins.values():
                assert sum(3 * length > capacity for _, length in parts) <= 2
            # Best fit descending, one piece after the other, needs no fewer.
            gaps, opened = [], 0
            for length in sorted(Counter(counts).elements(), reverse=True):
                fit = min((g for g in gaps if g >= length), default=None)
                if fit is None:
                    opened += 1
                    fit = capacity
                else:
                    gaps.remove(fit)
                gaps.append(fit - length)
            assert plan.sequences <= opened


def test_large_pieces_are_matched_best():
    plan = packing.make_plan({400: 3, 600: 2, 624: 1, 500: 1}, 1024)
    assert plan.sequences == 4  # 624+400, 600+400, 600+400, 500


def check(rows, texts, tokenizer, capacity, end):
    """Pieces of documents (by id, ids may repeat) against the library, and places against each other."""
    want = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, n, start, stop - start, zlib.crc32(np.asarray(ids[start:stop], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize("capacity", [1024, 16])
def test_awkward_rows(awkward, nothing, tokenizer, capacity):
    rows = packing.pack(awkward, capacity=capacity).collect()
    texts = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    check(rows, texts, tokenizer, capacity, 2)
    assert packing.pack(nothing, capacity=capacity).count() == 0


def test_given_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(5)).collect()
    bins = check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 1024, 2)
    assert len(bins) <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1


def test_sequences_hold_the_ids(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).cache()
    want = Counter(i for r in docs.collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])
    rows = packing.sequences(docs, capacity=256).collect()
    assert Counter(i for r in rows for i in r.ids) == want
    assert max(len(r.ids) for r in rows) <= 256
