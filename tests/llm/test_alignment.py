import hashlib
import random
from collections import Counter

import pytest

from motorlake.llm import alignment, packing

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pair():
    return alignment._pair(packing.vocabulary_path(alignment.A_VOCABULARY), packing.vocabulary_path(alignment.B_VOCABULARY))


def groups(pair, text):
    """Groups of one text, token by token; None where it has none."""
    a, b, _ = pair
    if not text:
        return None
    left, right, want = a.own.encode(" " + text, add_special_tokens=False).ids, b.own.encode(text), (" " + text).encode()
    if b"".join(a.bytes[i] for i in left) != want or b"".join(b.bytes[i] for i in right) != want:
        return None
    found, at, end, part = [], [0, 0], [0, 0], ([], [])
    while at[0] < len(left) or at[1] < len(right):
        side = 0 if end[0] <= end[1] and at[0] < len(left) else 1
        token = (left, right)[side][at[side]]
        part[side].append(token)
        at[side] += 1
        end[side] += len((a, b)[side].bytes[token])
        if end[0] == end[1]:
            found.append(part)
            part = ([], [])
    return found


def brute(pair, rows):
    cut = [(i, groups(pair, t)) for i, t in rows]
    links = [[(p, q) for u, v in g or [] for p in u for q in v] for _, g in cut]
    count = Counter(x for doc in links for x in set(doc))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = Counter()
    for (i, g), doc in zip(cut, links, strict=True):
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g or [])
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        figures = [sum(len(u) for u, _ in g or []), sum(len(v) for _, v in g or []), len(g or []), len(doc)]
        out[(i, *figures, sum(count[x] == best[x[0]] for x in doc), sum(count[x] for x in doc), sha)] += 1
    return out, count


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_segments_align_like_whole_texts(pair):
    rnd = random.Random(1)
    signs = [*" a b the\n\t  ▁é<s></s>&;\r{}()0123漢🙂　\xa0​'s\x1c\x85᠎﻿", "tion", "</s>", "<|endoftext|>", "\n", "    ", " word", " word\n", "\x00", " xylophonique", "überall "]
    aligner = alignment.Aligner(pair[0], pair[1])
    for _ in range(1500):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(40))).replace("▁", rnd.choice(["", "", "▁"]))
        numbers, want = aligner.numbers([text])[0], groups(pair, text)
        good = len(numbers) > 0 and bool(aligner.sizes.flat[4 * numbers + 3].all())
        assert good == (want is not None), text
        if want:
            got = "".join(aligner.strings[k] for k in numbers)[:-1]
            assert got == ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in want), text


def test_awkward_rows(awkward, nothing, pair):
    want, _ = brute(pair, [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert rows_of(alignment.align(awkward)) == want
    assert alignment.align(nothing).count() == 0


def test_given_documents_in_small_blocks(spark, sf_dir, pair, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    want, count = brute(pair, [(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(alignment.align(docs)) == want
    got = {(r.a, r.b): r.n_docs for r in alignment.dictionary(docs).collect()}
    assert got == dict(count)


def test_marks_and_special_strings(spark, pair):
    texts = [None, "", " ", "a▁b", "<s> x </s>", "<|endoftext|>", "x<|endoftext|>y", "▁", "\n", " \n ", "tab\tto", "é" * 9, "a  b   c\n\n d "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want, _ = brute(pair, list(enumerate(texts)))
    assert rows_of(alignment.align(docs)) == want


def test_blocks_are_small_to_read_and_shuffle(spark, sf_dir, pair):
    """Row groups of the blocks are bounded, whatever a task has read, and so are blocks of documents without text."""
    import pyarrow.parquet as pq

    paths = [packing.vocabulary_path(n) for n in (alignment.A_VOCABULARY, alignment.B_VOCABULARY)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").coalesce(1)
    many = docs.crossJoin(spark.range(60).select()).coalesce(1)
    blocks, _, _ = alignment.pair_counts(many, *paths)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 16
    assert max(g.total_byte_size for g in groups) < 6 * alignment.BLOCK_CHARS
    empty = spark.range(30_000).selectExpr("id AS doc_id", "'' AS text").coalesce(1)
    assert alignment._blocks(empty, *paths).where("doc_id is not null").count() > 2
    assert alignment.align(empty).where("n_a = 0 AND groups_sha256 = ''").count() == 30_000
