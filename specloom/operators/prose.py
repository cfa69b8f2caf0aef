"""Normative rules and status codes from prose, many documents at a time.

Every operator takes documents as rows and partitions by them, so a corpus of any number of them is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import names, text
from specloom.functions.lexicon import RFC2119, Lexicon


def with_offset(rows: DataFrame, keys: list[str], order: str, length: Column, name: str = "offset") -> DataFrame:
    """Running offset of a document's parts, the sum of the lengths before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("bigint"))


def paragraphs(docs: DataFrame, keys: list[str], lexicon: Lexicon = RFC2119) -> DataFrame:
    """Paragraphs with ordinal and approximate offset (each separator counts as two characters)."""
    parts = docs.select(*keys, F.posexplode(F.split("text", lexicon.paragraph)).alias("para_ord", "para"))
    return with_offset(parts, keys, "para_ord", F.length("para") + 2)


def headers(docs: DataFrame, keys: list[str], lexicon: Lexicon = RFC2119) -> DataFrame:
    """Section titles with level and offset."""
    mark = lexicon.header
    parts = docs.select(*keys, F.posexplode(F.split("text", rf"(?m)(?=^{mark}\s)")).alias("part_ord", "part"))
    placed = with_offset(parts, keys, "part_ord", F.length("part"))
    return placed.where(F.col("part").rlike(rf"^{mark}\s+\S")).select(
        *keys, "offset", F.length(F.regexp_extract("part", rf"^({mark})\s", 1)).alias("level"), text.strip(F.regexp_extract("part", rf"^{mark}\s+(.+)", 1)).alias("title")
    )


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], at: str, value: str, out: str, default: str | None = None) -> DataFrame:
    """For every row the value of the last event at or before it, by ``keys``; ``default`` where none is.

    Both sides are one union, so it is one shuffle by the keys and one sort, however many rows fall between events.
    """
    left = rows.withColumn("__kind", F.lit(1)).withColumn("__value", F.lit(None).cast(dict(events.dtypes)[value]))
    right = events.select(*keys, at, F.lit(0).alias("__kind"), F.col(value).alias("__value"))
    w = Window.partitionBy(*keys).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right, allowMissingColumns=True).withColumn(out, F.last("__value", ignorenulls=True).over(w))
    filled = filled.where("__kind = 1").drop("__kind", "__value")
    return filled if default is None else filled.withColumn(out, F.coalesce(out, F.lit(default)))


def normative_sentences(docs: DataFrame, keys: list[str], lexicon: Lexicon = RFC2119, sections: bool = True) -> DataFrame:
    """Sentences of normative paragraphs that are long enough, before numbering."""
    paras = paragraphs(docs, keys, lexicon).where(~text.skipped(F.col("para"), lexicon) & text.found(F.col("para"), lexicon.normative))
    paras = as_of(paras, headers(docs, keys, lexicon), keys, "offset", "title", "section", "") if sections else paras.withColumn("section", F.lit(""))
    said = paras.select(
        *keys, "para_ord", "section", text.phase(F.col("section"), F.col("para"), lexicon).alias("phase"), F.posexplode(text.sentences(F.col("para"))).alias("sent_ord", "sentence")
    ).where(text.found(F.col("sentence"), lexicon.normative))
    return said.withColumn("clean", text.clean_markup(F.col("sentence"))).where(F.length("clean") >= lexicon.min_length)


def rules(docs: DataFrame, keys: list[str], lexicon: Lexicon = RFC2119, sections: bool = True) -> DataFrame:
    """Numbered rules; the number runs by document and phase."""
    said = normative_sentences(docs, keys, lexicon, sections)
    n = F.row_number().over(Window.partitionBy(*keys, "phase").orderBy("para_ord", "sent_ord"))
    ordered = said.withColumn("n", n)
    return ordered.select(
        *keys, (F.col("para_ord").cast("bigint") * 100_000 + F.col("sent_ord")).alias("ord"), names.rule_id(F.col("phase"), F.col("n")).alias("rule_id"),
        F.left("clean", F.lit(lexicon.description_cap)).alias("description"), text.severity(F.col("sentence"), lexicon).alias("severity"), "phase",
        F.lit("").alias("condition"), F.lit("").alias("action"), F.slice(text.entity_refs(F.col("sentence")), 1, lexicon.reference_cap).alias("referenced_entities"),
        F.col("section").alias("spec_section"), F.left("clean", F.lit(lexicon.source_cap)).alias("source_text"),
    )


def status_codes(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tables between pairs of ``|===`` lines, with the category that the text before speaks of.

    A last delimiter without partner opens nothing. Header rows ``value`` and ``code`` are dropped.
    """
    delimiter = r"(?m)^\|={3,}"
    # pieces of text between delimiters: odd ones are tables, if another delimiter follows
    pieces = docs.select(*keys, F.split("text", delimiter).alias("piece"), F.regexp_extract_all("text", F.lit(delimiter), 0).alias("mark"))
    # the context reaches back over earlier tables, with their delimiters; these have four characters at least, so it
    # is within so many pieces, and no table's row has the whole document
    back = text.CONTEXT // 4 + 1
    piece = lambda j, end: F.concat(F.get("piece", j), F.when(j < end - 1, F.get("mark", j)).otherwise(""))
    before = lambda end: text.context(F.array_join(F.transform(F.sequence(F.greatest(end - back, F.lit(0)), end - 1), lambda j: piece(j, end)), ""))
    is_table = lambda i: (i % 2 == 1) & (i < F.size("piece") - 1)
    placed = F.transform("piece", lambda p, i: F.when(is_table(i), F.struct(p.alias("body"), before(i).alias("before"))))
    tables = pieces.select(*keys, F.posexplode(placed).alias("table_ord", "t")).where("t is not null").select(*keys, "table_ord", "t.body", "t.before")
    row = r"(?m)^[|]`?(\p{Alpha}[\p{Alnum}._-]*)`?\s*[|]\s*(.+?)\s*[|]\s*(.+?)\s*$"
    cells = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(row), k).alias(n) for k, n in ((1, "code"), (2, "meaning"), (3, "url_usage"))])
    found = tables.select(*keys, "table_ord", text.category(F.col("before")).alias("category"), F.posexplode(cells).alias("row_ord", "c"))
    return found.where(~F.lower("c.code").isin("value", "code")).select(
        *keys, (F.col("table_ord").cast("bigint") * 100_000 + F.col("row_ord")).alias("ord"), "c.code",
        text.link_labels(text.strip(F.col("c.meaning"))).alias("meaning"), text.link_labels(text.strip(F.col("c.url_usage"))).alias("url_usage"), "category",
    )
