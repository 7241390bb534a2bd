"""Rows to documents: field maps, labels, keywords, ids, and nested data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, DoubleType, MapType, StringType, StructType

from siftwell.functions.text import clean_text

KEYWORDS = "array<struct<keyword_or_phrase:string,explanation:string>>"

DOCUMENT_SCHEMA = (
    "id string, content string, content_type string, dataframe string, keywords array<string>, score double, embedding array<float>, "
    f"meta struct<labels:array<string>,url:string,chunk_id:string,keywords_or_phrases:{KEYWORDS},extra:map<string,string>>"
)


def missing(c: Column, kind: DataType) -> Column:
    """Null, or NaN in floating columns."""
    return c.isNull() | F.isnan(c) if isinstance(kind, (FloatType, DoubleType)) else c.isNull()


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that aren't there are no error."""
    return df.drop(*(n for n in names if n.strip()))


def normalised_labels(c: Column, kind: DataType) -> Column:
    """Labels as an array: text gives one label as it stands, or a JSON list's items; items are trimmed, empty ones and nulls go."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.filter(F.transform(c.cast("array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    s = c.cast("string")
    parsed = F.when(F.substring(F.ltrim(s), 1, 1) == "[", F.from_json(s, "array<string>"))
    # A list that can't be parsed gives no rows of nulls but the text itself
    items = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(s.isNull() | (F.trim(s) == ""), F.array().cast("array<string>")).when(parsed.isNotNull(), items).otherwise(F.array(s))


def normalised_keywords(c: Column, kind: DataType) -> Column:
    """Keywords as structs ``(keyword_or_phrase, explanation)``; the key ``keywords_or_phrase`` is an alias; blank keywords go."""
    empty = F.array().cast(KEYWORDS)
    if isinstance(kind, StringType):
        listed = F.from_json(c, "array<struct<keyword_or_phrase:string,keywords_or_phrase:string,explanation:string>>")
        single = F.array(F.struct(c.alias("keyword_or_phrase"), F.lit("").alias("explanation")))
        items = F.transform(listed, lambda x: F.struct(F.coalesce(x["keyword_or_phrase"], x["keywords_or_phrase"]).alias("keyword_or_phrase"), F.coalesce(x["explanation"], F.lit("")).alias("explanation")))
        out = F.when(F.substring(F.ltrim(c), 1, 1) == "[", items).otherwise(single)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        names = kind.elementType.fieldNames()
        word = [n for n in ("keyword_or_phrase", "keywords_or_phrase") if n in names]
        items = lambda x: F.struct(F.coalesce(*(x[n] for n in word)).alias("keyword_or_phrase"), (F.coalesce(x["explanation"], F.lit("")) if "explanation" in names else F.lit("")).alias("explanation"))
        out = F.transform(c, items)
    else:
        out = F.transform(c.cast("array<string>"), lambda x: F.struct(x.alias("keyword_or_phrase"), F.lit("").alias("explanation")))
    return F.coalesce(F.filter(out, lambda x: x["keyword_or_phrase"].isNotNull() & (F.trim(x["keyword_or_phrase"]) != "")), empty)


def to_documents(
    df: DataFrame, content: str = "content", queries: str = "queries", chunk_id: str = "chunk_id", keywords: str = "keywords_or_phrases", url: str = "url",
    required: tuple[str, ...] = (), preserve_all_fields: bool = True,
) -> DataFrame:
    """Adapt rows to documents. Rows without content or a required field go; empty content stays.

    Labels come from the query column, else from ``meta.<queries>``, else from ``meta.labels``: the first that is
    there, even if empty. Other columns go to ``meta.extra`` as text when ``preserve_all_fields``.
    """
    schema = df.schema
    kinds = {f.name: f.dataType for f in schema.fields}
    for c in (content, *required):
        df = df.where(~missing(F.col(c), kinds[c]))
    label_cols = [(F.col(queries), kinds[queries])] if queries in kinds else []
    if isinstance(kinds.get("meta"), StructType):
        for n in (queries, "labels"):
            if n in kinds["meta"].fieldNames():
                label_cols.append((F.col(f"meta.{n}"), kinds["meta"][n].dataType))
    labels = F.coalesce(*(F.when(~missing(c, k), normalised_labels(c, k)) for c, k in label_cols), F.array().cast("array<string>"))
    words = normalised_keywords(F.col(keywords), kinds[keywords]) if keywords in kinds else F.array().cast(KEYWORDS)
    text = lambda n: F.col(n).cast("string") if n in kinds else F.lit(None).cast("string")
    rest = [n for n in kinds if n not in (content, queries, chunk_id, keywords, url, "meta")]
    as_text = lambda n: F.to_json(F.col(n)) if isinstance(kinds[n], (ArrayType, MapType, StructType)) else F.col(n).cast("string")
    extra = F.map_filter(F.create_map(*(x for n in rest for x in (F.lit(n), as_text(n)))), lambda _, v: v.isNotNull()) if preserve_all_fields and rest else F.create_map().cast("map<string,string>")
    meta = F.struct(labels.alias("labels"), text(url).alias("url"), text(chunk_id).alias("chunk_id"), words.alias("keywords_or_phrases"), extra.alias("extra"))
    return df.select(F.coalesce(text(chunk_id), F.sha2(F.col(content).cast("string"), 256)).alias("id"), F.col(content).cast("string").alias("content"), meta.alias("meta"))


def unique_ids(df: DataFrame, column: str) -> DataFrame:
    """The rows, unless an id that is not null occurs twice: then an error when they are read."""
    twice = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").select(column).limit(1).collect()
    if twice:
        raise ValueError(f"{column} {twice[0][0]!r} occurs more than once")
    return df


def hoisted(df: DataFrame, struct: str, *keep: str) -> DataFrame:
    """A struct's fields one level up, beside the named columns."""
    return df.select(*keep, f"{struct}.*")


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """All nested structs as columns named by their path."""

    def walk(kind: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            p = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, p)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p)))
        return out

    return df.select(*walk(df.schema, ()))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added, nulls filled."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these text columns, white space cleaned, blanks for what is missing."""
    return df.select(*((clean_text(F.col(c).cast("string")) if c in df.columns else F.lit("")).alias(c) for c in columns))


def first_label(title: Column, labels: Column) -> Column:
    """The title, else the first label that isn't blank, else ``unknown``."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(title), F.get(F.filter(labels, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lit(0)), F.lit("unknown"))


def flat_list(c: Column, kind: DataType) -> Column:
    """The innermost elements of nested arrays, in order; as many levels go as the type has."""
    while isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c


def ids_as_text(c: Column, kind: DataType, name: str = "") -> Column:
    """Fields whose names end with ``id`` and items of lists as text, at any depth of structs."""
    if isinstance(kind, StructType):
        return F.struct(*(ids_as_text(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return c.cast("array<string>") if not isinstance(kind.elementType, (StructType, ArrayType)) else F.transform(c, lambda x: F.to_json(x))
    return c.cast("string") if name.endswith("id") else c


def request_documents(df: DataFrame) -> DataFrame:
    """``content, meta, keywords_or_phrases`` of documents in a request; what is missing or null is empty."""
    empty = {"meta": F.create_map().cast("map<string,string>"), "keywords_or_phrases": F.array().cast(KEYWORDS)}
    return df.select("content", *((F.coalesce(F.col(c), e.cast(df.schema[c].dataType) if c != "meta" else e) if c in df.columns else e).alias(c) for c, e in empty.items()))
