"""Personal data: patterns, and terms that reveal what the patterns protect.

Base kinds are found by pattern in whole texts.  The protected entities are their values.  How far
a term t reveals an entity e is estimated from the corpus: with N documents, df documents that have
t or e, and c documents that have both, wherever they stand, the term's pointwise mutual information
with e is log(N c / (df(t) df(e))), at most the information log(N / df(e)) that masking e should
keep.  Their ratio is the term's disclosure of e, and a term's disclosure is its largest.  Terms from
``remove_from`` on are removed, terms from ``generalise_from`` on are generalised, in every
occurrence in the corpus, also where the entity itself is not named.  A pair counts only with
``support`` different texts, so copies of one text prove nothing.  Terms are words of three letters
or more; words inside an e-mail address are none.

Patterns run in one pass over the texts.  A mention's place is the sum of the lengths of the gaps
and matches before it, added up by a window in its document, so long lists cost no more than their
sum.

Pairs are counted on different texts with their numbers of copies, not on documents.  As c is at most
df(e), a term with more than df(e)^g N^(1-g) documents, g being ``generalise_from``, cannot reach the
threshold and makes no pair, and neither does a term of one document or an entity of one text.
Entities of the same texts have the same pairs, and so have terms of the same texts: pairs are made
of such classes, known by 128 bits of hashes, so that a list of values copied into many texts
makes one pair a text and not a product.

Defined results: a null text counts as empty and has no spans.  Repeated rows are counted one by
one; a null id is returned as null.  Spans of different kinds may overlap; in the sanitised text a
span that starts inside an earlier one is left out.  Empty tables give no rows.  Extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlake.llm.rows import column, free_name, located, text_of
from motorlake.session import settle

#: The kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns.  Possessive repeats and the guards before a run give the same matches as
#: plain ones, in linear time and without recursion on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
#: The filter of told terms has at most 2 ** SLOT_BITS rows of two longs, some ten megabytes in a task's memory.
SLOT_BITS = 18


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
    # A part of zeros alone is 0; the pattern already asks for a digit in each part.
    return (
        F.when(kind == "ip", value.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
        .when(kind == "card", F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )


def _entity(kind: Column, value: Column) -> Column:
    """A mention's value with writing differences taken out."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def mentions(docs: DataFrame, place: Column, text_column: str = "text") -> DataFrame:
    """file, row, text_key, kind, start, end, value: a row for each base match that holds.

    Positions are code points, end exclusive.
    """
    text = text_of(docs, text_column)
    source = docs.select(place["file"].alias("file"), place["row"].alias("row"), text.alias("text"))
    has = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    found = source.select("*", *[
        (F.when(has[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))) if k in has else F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(k)
        for k, p in PATTERNS.items()
    ]).where(" OR ".join(f"size({k}) > 0" for k in PATTERNS))
    per_kind = found.select(
        "file", "row", F.md5("text").alias("text_key"),
        F.explode(F.array(*[
            F.when(F.size(k) > 0, F.struct(F.lit(k).alias("kind"), F.col(k).alias("values"), F.split("text", p, -1).alias("gaps")))
            for k, p in PATTERNS.items()
        ])).alias("k"),
    ).where("k is not null")
    one_by_one = per_kind.select(
        "file", "row", "text_key", F.col("k.kind").alias("kind"),
        F.posexplode(F.arrays_zip(
            F.col("k.values").alias("value"),
            F.transform(F.slice("k.gaps", F.lit(1), F.size("k.values")), F.length).alias("gap"),
        )).alias("nth", "m"),
    )
    before = Window.partitionBy("file", "row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = one_by_one.select(
        "file", "row", "text_key", "kind", F.col("m.value").alias("value"),
        F.sum(F.col("m.gap") + F.length("m.value")).over(before).cast("long").alias("end"),
    )
    return placed.where(valid(F.col("kind"), F.col("value"))).select(
        "file", "row", "text_key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value"
    )


def _prose(text: Column) -> Column:
    """The text with each e-mail address overwritten by as many signs that are no letters."""
    addresses = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    overwritten = F.zip_with(
        F.split(text, PATTERNS["email"], -1), addresses, lambda gap, a: F.concat(gap, F.coalesce(F.rpad(F.lit(""), F.length(a), F.lit("@")), F.lit("")))
    )
    return F.when(text.contains("@"), F.array_join(overwritten, "")).otherwise(text)


def _terms(text: Column) -> Column:
    """The words of a text in order, in lower case."""
    return F.transform(F.regexp_extract_all(_prose(text), F.lit(TERM), F.lit(0)), F.lower)


def _same_texts(of: str) -> list[Column]:
    """Two hashes of a set of distinct texts, the same for all members of a class."""
    return [F.bit_xor(F.xxhash64("text_key", F.lit(seed))).alias(f"{of}_set{seed}") for seed in (1, 2)]


def disclosures(docs: DataFrame, place: Column, found: DataFrame, text_column: str, generalise_from: float, support: int) -> DataFrame:
    """term, disclosure: the terms whose largest disclosure is ``generalise_from`` or more."""
    text = text_of(docs, text_column)
    total = docs.count()
    rows = found.groupBy(_entity(F.col("kind"), F.col("value")).alias("entity"), "text_key", "file", "row").agg(F.lit(1).alias("x"))
    texts = rows.groupBy("entity", "text_key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("file", "row")).alias("at"))
    texts = settle(texts, "entity_texts")
    entities = texts.groupBy("entity").agg(
        F.sum("copies").alias("df_entity"), F.count(F.lit(1)).alias("n_texts"), *_same_texts("entity")
    ).where((F.col("n_texts") >= support) & (F.col("df_entity") < total))
    held = settle(
        texts.join(entities, "entity").groupBy("df_entity", "entity_set1", "entity_set2", "text_key")
        .agg(F.first("copies").alias("copies"), F.first("at").alias("at")),
        "entity_classes",
    )
    reach = held.agg(F.max("df_entity")).first()[0]
    if reach is None:
        return docs.sparkSession.createDataFrame([], "term string, disclosure double")

    def most(df: Column) -> Column:
        # A little more than the bound, as the threshold itself is tested on the disclosure.
        return F.pow(df.cast("double"), F.lit(generalise_from)) * F.lit(float(total) ** (1 - generalise_from) * (1 + 1e-9))

    frequent = docs.select(F.explode(F.array_distinct(_terms(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    frequent = frequent.where((F.col("df_term") >= support) & (F.col("df_term") <= most(F.lit(reach))))
    carriers = held.groupBy("text_key").agg(F.min("at").alias("at")).select("text_key", F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    own = docs.select(place["file"].alias("file"), place["row"].alias("row"), text.alias("text")).join(carriers, ["file", "row"]).select(
        "text_key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")
    )
    term_texts = settle(own.join(frequent, "term"), "term_texts")
    members = term_texts.groupBy("term", "df_term").agg(F.count(F.lit(1)).alias("n_texts"), *_same_texts("term")).where(F.col("n_texts") >= support)
    members = settle(members, "term_members")
    classes = settle(
        term_texts.join(members.select("term", "term_set1", "term_set2"), "term").select("df_term", "term_set1", "term_set2", "text_key").distinct(),
        "term_classes",
    )
    information = F.log(F.lit(float(total)) / F.col("df_entity"))
    pairs = (
        held.select("df_entity", "entity_set1", "entity_set2", "text_key", "copies").join(classes, "text_key")
        .where(F.col("df_term") <= most(F.col("df_entity")))
        .groupBy("df_entity", "entity_set1", "entity_set2", "df_term", "term_set1", "term_set2")
        .agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("n_texts"))
        .where(F.col("n_texts") >= support)
        .select("df_term", "term_set1", "term_set2", ((information + F.log(F.col("both") / F.col("df_term"))) / information).alias("disclosure"))
    )
    best = pairs.groupBy("df_term", "term_set1", "term_set2").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise_from)
    return members.join(best, ["df_term", "term_set1", "term_set2"]).select("term", "disclosure")


def occurrences(docs: DataFrame, place: Column, told: DataFrame, text_column: str) -> DataFrame:
    """file, row, start, end, disclosure: every place of a told term in the texts."""
    text = text_of(docs, text_column)
    rows = docs.select(place["file"].alias("file"), place["row"].alias("row"), text.alias("text"))
    words = rows.select("file", "row", F.posexplode(_terms(F.col("text"))).alias("nth", "term"))
    # Only words whose hash bit is set in a table of bounded size travel to the terms themselves.
    slot, bit = F.shiftrightunsigned(F.xxhash64("term"), 64 - SLOT_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64("term").bitwiseAND(63).cast("int"))
    slots = told.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("set"))
    words = words.join(F.broadcast(slots), (slot == F.col("slot")) & (F.col("set").bitwiseAND(bit) != 0)).drop("slot", "set")
    hits = words.join(told, "term").groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("nth", "disclosure"))).alias("hits"))
    prose = rows.join(settle(hits, "term_hits"), ["file", "row"]).select("file", "row", "hits", _prose(F.col("text")).alias("prose")).select(
        "file", "row", "hits",
        F.transform(F.regexp_extract_all("prose", F.lit(TERM), F.lit(0)), F.length).alias("words"),
        F.transform(F.split("prose", TERM, -1), F.length).alias("gaps"),
    )

    def length_between(first: Column, last: Column) -> Column:
        """Of the gaps and words from ``first`` up to the gap before word ``last``; each is read once."""
        def sum_of(items: str, n: Column) -> Column:
            return F.aggregate(F.slice(items, first + 1, n), F.lit(0), lambda a, x: a + x)

        return sum_of("gaps", last - first + 1) + sum_of("words", last - first)

    stretches = F.transform("hits", lambda h, k: F.struct(
        h["disclosure"].alias("disclosure"),
        F.element_at("words", h["nth"] + 1).alias("own"),
        F.when(k == 0, length_between(F.lit(0), h["nth"]))
        .otherwise(length_between(F.col("hits")[F.greatest(k - 1, F.lit(0))]["nth"] + 1, h["nth"])).alias("before"),
    ))
    upto = Window.partitionBy("file", "row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        prose.select("file", "row", F.posexplode(stretches).alias("k", "s"))
        .select("file", "row", "s.disclosure", "s.own", F.sum(F.col("s.before") + F.col("s.own")).over(upto).cast("long").alias("end"))
        .select("file", "row", (F.col("end") - F.col("own")).alias("start"), "end", "disclosure")
    )


def find(
    docs: DataFrame,
    text_column: str = "text",
    generalise_from: float = 0.6,
    remove_from: float = 0.8,
    support: int = 2,
) -> DataFrame:
    """file, row, kind, start, end, action: all spans of ``docs``, whose rows must come from files (``located``)."""
    docs, place = located(docs)
    base = settle(mentions(docs, place, text_column), "mentions")
    told = settle(disclosures(docs, place, base, text_column, generalise_from, support), "told")
    terms = occurrences(docs, place, told, text_column).select(
        "file", "row", F.lit("term").alias("kind"), "start", "end",
        F.when(F.col("disclosure") >= remove_from, F.lit("remove")).otherwise("generalise").alias("action"),
    )
    return base.select("file", "row", "kind", "start", "end", F.lit("mask").alias("action")).unionByName(terms)


def by_document(spans: DataFrame) -> DataFrame:
    """file, row and the document's spans in order of kind and start."""
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return spans.groupBy("file", "row").agg(
        F.array_sort(F.collect_list(F.struct(number.alias("k"), "start", "end", "kind"))).alias("spans")
    )


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans, n_term."""
    docs, place = located(docs)
    found = by_document(find(docs, text_column, **options))
    ids = docs.select(column(docs, id_column).alias("doc_id"), place["file"].alias("file"), place["row"].alias("row"))
    spans = F.coalesce("spans", F.array().cast("array<struct<k:bigint,start:bigint,end:bigint,kind:string>>"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def amount(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return ids.join(found, ["file", "row"], "left").select(
        "doc_id", *[amount(k) for k in KINDS[:4]],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
        joined(spans).alias("spans"), amount("term"),
    )


def sanitise(docs: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with its spans replaced: ``[EMAIL]`` and so on for base kinds, ``[TERM]`` for generalised terms, nothing for removed ones."""
    docs, place = located(docs)
    spans = find(docs, text_column, **options)
    earlier = Window.partitionBy("file", "row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("reached", F.coalesce(F.max("end").over(earlier), F.lit(0))).where("start >= reached")
    cuts = outer.groupBy(F.col("file").alias("_file"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct(
        "start", "end", "reached",
        F.when(F.col("action") == "remove", F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).alias("put"),
    ))).alias("_cuts"))
    at = free_name(docs, "_at")
    rows = docs.select("*", place.alias(at))
    joined = rows.join(cuts, (rows[at]["file"] == cuts["_file"]) & (rows[at]["row"] == cuts["_row"]), "left")
    text = rows[f"`{text_column}`"]
    last = F.element_at(cuts["_cuts"], -1)["end"]
    parts = F.transform(cuts["_cuts"], lambda c: F.concat(F.substr(text, (c["reached"] + 1).cast("int"), (c["start"] - c["reached"]).cast("int")), c["put"]))
    whole = F.concat(F.array_join(parts, ""), F.substr(text, (last + 1).cast("int"), F.length(text)))
    return joined.select(*[
        (F.when(cuts["_cuts"].isNotNull(), whole).otherwise(text)).alias(c) if c == text_column else rows[f"`{c}`"] for c in docs.columns
    ])
