"""Language of web pages by fusing evidence in Bayes' rule.

Four sources are combined: the visible text (hashed byte trigrams, learned from all documents with a
declared language), the language that the page's markup declares (weighed by how often declarations
agree with texts), the address suffix, and the host.  Host, suffix and overall shares form a
hierarchy: a host's share of a language is its count plus ``STRENGTH`` times the suffix's share, and
a suffix's share leans on the overall one in the same way.  All counts come from grouped
aggregation over all pages of text posteriors in whole thousandths, so results do not depend on the
order of sums.  A page does not count in its own host's prior.

Languages are those that occur in the documents, rare ones together as ``OTHER``; they are few, so
profiles (``BUCKETS`` numbers a language) are held in the driver and sent to tasks.

Defined results: a null or empty page is judged by declaration and priors alone.  A missing or broken
address counts as an empty host and suffix.  Documents without a language or text teach nothing; if
there are none at all, the language is null with confidence 0.  Ties go to the language first in
order.  Repeated rows each give a row, an empty table gives no rows, extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from motorlake.llm import bytewords
from motorlake.llm.html_tree import ATTRIBUTE
from motorlake.llm.rows import column, ship, text_of
from motorlake.session import settle

BUCKETS = 1 << 14
#: Overlapping trigrams are not independent evidence.
TEMPER = 0.2
STRENGTH = 10.0
#: Values of ``lang`` that fewer than this part of the documents carry are one class, so that dirty
#: values cannot make the table of profiles grow: it has at most 1 / RARE + 1 of them.
RARE, OTHER = 0.001, "und"
CHUNK = 1 << 20
UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)
#: Comments and raw elements are skipped, so that no tag inside them is taken; quotes may hold >.
OPENING = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?P<tag>html|body)(?=[\s/>])(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)",
    re.S | re.I,
)
CODE = re.compile(r"\s*([a-zA-Z]{2,3})(?![a-zA-Z0-9])")
_MARK = np.arange(256, dtype=np.uint8)
_MARK[65:91] += 32
#: Signs, digits and white space are all one separator.
_MARK[[i for i in range(128) if not chr(i).isalpha()]] = 32


def trigrams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of one text, in stretches of bounded size."""
    for lo in range(0, max(len(data) - 2, 0), CHUNK):
        x = _MARK[data[lo : lo + CHUNK + 2]].astype(np.uint32)
        code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
        # Runs of separators say nothing.
        yield (code >> np.uint32(18))[(x[:-2] != 32) | (x[1:-1] != 32)]


def declared(page: str) -> str | None:
    """The language code of the page's html element, from its attribute named ``lang``."""
    for m in OPENING.finditer(page):
        if m.group("tag") is None:
            continue
        if m.group("tag").lower() == "body":
            return None
        for a in ATTRIBUTE.finditer(m.group("attrs")):
            if a.group(1).lower() == "lang":
                code = CODE.match(a.group(2) or a.group(3) or a.group(4) or "")
                return code.group(1).lower() if code else None
        return None
    return None


def profiles(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability of each bucket in each of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in bytewords.bounded(batches, 1):
            data, offsets = bytewords.text_buffers(batch.column(1))
            for k, lang in enumerate(batch.column(0).to_pylist()):
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in trigrams(data[offsets[k] : offsets[k + 1]]):
                    own += np.bincount(part, minlength=BUCKETS)
        for lang, own in totals.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])

    lang = F.lower(F.trim(column(docs, lang_column).cast("string")))
    told = docs.select(lang.alias("lang"), text_of(docs, text_column).alias("text")).where("lang is not null and lang != ''")
    numbers = told.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    least = numbers.agg(F.coalesce(F.sum("n"), F.lit(0)) * F.lit(RARE)).first()[0]
    common = [r["lang"] for r in numbers.where(F.col("n") >= least).select("lang").collect()]
    told = told.withColumn("lang", F.when(F.col("lang").isin(common), F.col("lang")).otherwise(OTHER))
    sums = told.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    where = {x: i for i, x in enumerate(langs)}
    np.add.at(counts, (np.array([where[x] for x in sums["lang"].to_pylist()], int), sums["bucket"].to_numpy()), sums["n"].to_numpy())
    counts += 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def evidence(pages: DataFrame, langs: list[str], logs: np.ndarray, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """page_id, url, host, suffix, declared, likely: the page's own evidence; ``likely`` has a tempered log-likelihood for each language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytewords.bounded(batches, 3):
            told, likely = [], np.zeros((len(batch), len(langs)))
            for k, page in enumerate(batch.column(3).to_pylist()):
                told.append(declared(page))
                text = html.unescape(UNSEEN.sub(" ", page)).encode("utf-8", "ignore")
                for part in trigrams(np.frombuffer(text, np.uint8)):
                    likely[k] += TEMPER * logs[:, part].sum(axis=1)
            ends = pa.array(np.arange(0, likely.size + 1, len(langs), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(told, pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.round(likely - likely.max(axis=1, keepdims=True), 6).ravel()))],
                names=["page_id", "url", "host", "declared", "likely"],
            )

    url = column(pages, url_column).cast("string")
    rows = pages.select(
        column(pages, id_column).alias("page_id"), url.alias("url"),
        F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))).alias("host"),
        F.coalesce(column(pages, html_column).cast("string"), F.lit("")).alias("html"),
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    made = rows.mapInArrow(read, f"page_id {kind}, url string, host string, declared string, likely array<double>")
    return made.withColumn("suffix", F.substring_index("host", ".", -1))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raised = [F.exp(s - top) for s in scores]
    total = sum(raised[1:], raised[0])
    return [r / total for r in raised]


def _shares(counts: str, parent: str, number: int) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).cast("double") / 1000.0
    return F.array(*[(F.col(counts)[i] / 1000.0 + STRENGTH * F.col(parent)[i]) / (total + STRENGTH) for i in range(number)])


def languages(
    pages: DataFrame,
    docs: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per page: page_id, url, host, declared, text_lang, lang, confidence."""
    ship(pages.sparkSession)
    langs, logs = profiles(docs)
    number = len(langs)
    if not number:
        none = F.lit(None).cast("string")
        return pages.select(
            column(pages, id_column).alias("page_id"), column(pages, url_column).cast("string").alias("url"), none.alias("host"),
            none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("confidence"),
        )
    own = [F.round(p * 1000).cast("long") for p in _softmax([F.col("likely")[i] for i in range(number)])]
    told = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNull(), F.lit("-")).otherwise(F.lit("?"))
    rows = settle(
        evidence(pages, langs, logs, id_column, url_column, html_column).select("*", told.alias("told"), F.array(*own).alias("own")), "evidence"
    )

    def counted(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("own")[i]) for i in range(number)]).alias("n"))

    # The overall shares and the reliability of declarations are a few rows.
    overall = rows.agg(*[F.coalesce(F.sum(F.col("own")[i]), F.lit(0)).alias(f"n{i}") for i in range(number)]).first()
    total = sum(overall)
    prior = [(overall[i] / 1000 + 1) / (total / 1000 + number) for i in range(number)]
    said = {r["told"]: r["n"] for r in counted("told").collect()}
    kinds = [*langs, "-", "?"]
    by_lang = [sum(n[i] for n in said.values()) for i in range(number)]
    share = {k: (sum(said.get(k, [0])) + 1000) / (total + 1000 * len(kinds)) for k in kinds}
    reliability = F.create_map(*[
        x for k in kinds for x in (
            F.lit(k),
            F.array(*[F.lit(float(np.log((said.get(k, [0] * number)[i] / 1000 + STRENGTH * share[k]) / (by_lang[i] / 1000 + STRENGTH)))) for i in range(number)]),
        )
    ])
    suffixes = counted("suffix").withColumn("all", F.array(*[F.lit(p) for p in prior])).select("suffix", _shares("n", "all", number).alias("by_suffix"))
    hosts = counted("host", "suffix").select("host", "suffix", F.col("n").alias("host_n")).join(suffixes, "suffix").select("host", "host_n", "by_suffix")

    joined = rows.join(hosts, "host").withColumn("others", F.array(*[F.col("host_n")[i] - F.col("own")[i] for i in range(number)]))
    priors = joined.withColumn("by_host", _shares("others", "by_suffix", number)).withColumn("r", reliability[F.col("told")])
    posterior = _softmax([F.col("likely")[i] + F.log(F.col("by_host")[i]) + F.col("r")[i] for i in range(number)])
    scored = priors.withColumn("p", F.array(*[F.round(p, 6) for p in posterior]))
    names = F.array(*[F.lit(x) for x in langs])

    def best(scores: str) -> Column:
        return F.element_at(names, F.array_position(F.col(scores), F.array_max(scores)).cast("int"))

    return scored.select(
        "page_id", "url", "host", "declared", best("likely").alias("text_lang"), best("p").alias("lang"), F.array_max("p").alias("confidence")
    )
