"""Token counts by batch encoding in an Arrow function that returns lengths only.

The vocabulary is a piece model with byte fallback whose merges never join a white-space mark to
what stands before it: all pieces have marks only at their start, or are runs of marks.  So a text
may be cut before every run of marks without changing its tokens.  Long texts are cut there into
pieces, pieces are gathered into batches of about equal bytes, and a batch is encoded once for each
distinct segment.  The whole text is counted, whatever its length; one segment without any mark
stays whole.

Defined results: a null or empty text has 0 bytes and 0 tokens.  Strings that look like special
tokens are plain text, as in the library's default.  An empty table gives no rows.  Repeated rows
are counted one by one, and columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motorlake.llm.rows import column, ship, text_of

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BATCH_BYTES = 4 << 20
PIECE_CHARS = 1 << 20
#: A run of marks (space or U+2581) and what follows up to the next run.
SEGMENT = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
CUT = re.compile("(?<=[^ ▁])(?=[ ▁])")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut before a run of marks wherever a piece has reached ``most`` characters."""
    start = 0
    while len(text) - start > most:
        cut = CUT.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:] if start else text


def segments(piece: str, first: bool) -> list[str]:
    """The segments of a piece, each without the mark that the library puts before a text.

    A segment of one mark alone becomes the empty string.
    """
    # The library's mark stands before the first piece only; later pieces start with their own.
    own = piece if first else piece[1:]
    if "▁" not in own and "  " not in own and own[:1] != " " and own[-1:] != " ":
        return own.split(" ")
    return [s[1:] for s in SEGMENT.findall(" " + own)]


class Counter:
    """Token counts of texts; remembers the lengths of up to ``keep`` segments between batches."""

    def __init__(self, encoder, keep: int = 400_000):
        self.encoder, self.keep, self.lengths = encoder, keep, {}

    def learn(self, wanted: set[str]) -> None:
        if len(self.lengths) > self.keep:
            self.lengths = {}
        new = [s for s in wanted if s not in self.lengths]
        self.lengths.update(zip(new, map(len, self.encoder.encode(new, num_threads=1)), strict=True))
        self.lengths[""] = 1  # one mark alone; the library would give the empty text no token

    def count(self, texts: list[str], batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> list[int]:
        """Counts of whole texts, encoded in batches of about ``batch_bytes``."""
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            self.learn(set().union(*[s for _, s in held]))
            for k, parts in held:
                totals[k] += sum(map(self.lengths.__getitem__, parts))
            held.clear()

        for k, text in enumerate(texts):
            for n, piece in enumerate(pieces(text, piece_chars)):
                held.append((k, segments(piece, n == 0)))
                size += len(piece)
                if size >= batch_bytes:
                    flush()
                    size = 0
        flush()
        return totals


def token_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    model: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    path = model or model_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_encoder(path))
        for batch in batches:
            tokens = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    text = text_of(docs, text_column)
    narrow = docs.select(
        column(docs, id_column).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    counted = narrow.mapInArrow(encode, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
