"""Queries over text functions, document adaptation and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import ids, text
from siftwell.operators import adapt, clusters, filters
from siftwell.plans.registry import query, table

_WS = r"'[ \t\n\x0B\f\r]+'"
_CLEAN = f"trim(regexp_replace(coalesce({{0}}, ''), {_WS}, ' ', 'g'))"
_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~'"
_TOKENS = f"list_filter(string_split_regex(translate(lower(trim({{0}})), {_PUNCT}, ''), {_WS}), lambda x: x <> '')"


@query(f"SELECT doc_id, md5({_CLEAN.format('text')}) AS cleaned, length({_CLEAN.format('text')})::INT AS n FROM documents")
def x01_clean_text(spark, d):
    c = text.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(c).alias("cleaned"), F.length(c).alias("n"))


@query(f"SELECT conv_id, turn, len({_TOKENS.format('text')})::INT AS n, array_to_string({_TOKENS.format('text')}[:5], ' ') AS head FROM conversations")
def x02_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query(r"SELECT item_id, len(list_filter(string_split(regexp_replace(lower(text), '[^\p{Latin}\p{Cyrillic}0-9_\-]+', ' ', 'g'), ' '), lambda x: x <> ''))::INT AS n FROM benchmark")
def x03_clean_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(text.clean_tokens(F.col("text"))).alias("n"))


@query("SELECT item_id, CASE WHEN starts_with(text, 'The') THEN text ELSE 'The' || text END AS served, trim('passage: ' || trim(text)) AS trained FROM benchmark")
def x04_prefixes(spark, d):
    c = F.col("text")
    return table(spark, d, "benchmark").select("item_id", text.prefixed(c, "The").alias("served"), text.prefixed_for_training(c, " passage: ").alias("trained"))


@query("SELECT doc_id, md5(text[:6000]) AS clipped, CASE WHEN length(text) > 50 THEN text[:50] || '...' ELSE text END AS short FROM documents")
def x06_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clip(F.col("text"))).alias("clipped"), text.shorten(F.col("text"), 50).alias("short"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def x07_rfc3339(spark, d):
    return table(spark, d, "events").select("event_id", text.rfc3339(F.col("ts")).alias("at"))


@query("SELECT event_id, TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS type_number, TRY_CAST(user_id::VARCHAR AS DOUBLE) IS NOT NULL AS user_number, json_valid(props) AS props_json, json_valid(event_type) AS type_json FROM events")
def x09_probes(spark, d):
    return table(spark, d, "events").select(
        "event_id", text.is_number(F.col("event_type")).alias("type_number"), text.is_number(F.col("user_id").cast("string")).alias("user_number"),
        text.is_json(F.col("props")).alias("props_json"), text.is_json(F.col("event_type")).alias("type_json"),
    )


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def x10_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN [role, 'x'] WHEN 1 THEN [role] ELSE ['plain ' || role] END AS queries FROM conversations")
def x11_payload_queries(spark, d):
    payload = F.when(F.col("turn") % 3 == 0, F.to_json(F.array(F.col("role"), F.lit(" x "), F.lit("")))).when(
        F.col("turn") % 3 == 1, F.to_json(F.struct(F.array("role").alias("questions")))).otherwise(F.concat(F.lit("plain "), "role"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.payload_queries(payload).alias("queries"))


@query("SELECT doc_id, upper(sha1(text)[:10]) AS tag, md5(text) AS digest, upper(source[1]) || lower(source[2:]) AS collection, regexp_replace('a b/' || source || '?', '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM documents")
def x19_tags_and_names(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.sha1_tag(F.col("text")).alias("tag"), F.md5("text").alias("digest"), text.collection_name(F.col("source")).alias("collection"),
        text.file_name(F.concat(F.lit("a b/"), "source", F.lit("?"))).alias("file"),
    )


@query("SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(source || '-x_y z', '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS name FROM documents")
def x21_camel_case(spark, d):
    return table(spark, d, "documents").select("doc_id", text.camel_case(F.concat("source", F.lit("-x_y z"))).alias("name"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def x20_name_uuid(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.name_uuid(F.col("source")).alias("uuid"))


@query()
def p10_content_id(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.content_id(F.col("text")).alias("content_id"), ids.stable_key(F.col("text")).alias("key"))


@query("SELECT n, round(gamma(n), 6) AS gamma, round(gamma(n) * gamma(2.5) / gamma(n + 2.5), 9) AS beta FROM (SELECT DISTINCT (r_regionkey + 1)::DOUBLE AS n FROM region)")
def x15_gamma(spark, d):
    n = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("double").alias("n")).distinct()
    return n.select("n", F.round(ids.gamma(F.col("n")), 6).alias("gamma"), F.round(ids.beta(F.col("n"), F.lit(2.5)), 9).alias("beta"))


_IDF = """
WITH t AS (SELECT a.conv_id, a.turn, {q} AS q, {d} AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT conv_id, turn, q, d, list_transform(q, lambda x: 1 / ln(1 + greatest(1, len(list_filter(d, lambda y: y = x))))) AS w FROM t)
SELECT conv_id, turn, round(coalesce(list_sum([CASE WHEN list_contains(d, q[i]) THEN w[i] ELSE 0 END FOR i IN range(1, len(q) + 1)]), 0) / CASE WHEN len(q) = 0 THEN 1 ELSE list_sum(w) END, 6) AS recall,
 round(coalesce(list_sum([1 / ln(1 + len(list_filter(d, lambda y: y = x))) FOR x IN list_distinct(q) IF list_contains(d, x)]), 0), 6) AS keyword_recall,
 len(list_intersect(list_distinct(q), list_distinct(d)))::INT AS common FROM w
""".format(q=_TOKENS.format("a.text"), d=_TOKENS.format("b.text"))


@query(_IDF)
def x16_inverse_idf_recall(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", "turn", text.tokens(F.col("text")).alias("q"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), text.tokens(F.col("text")).alias("d"))
    q, x = F.col("q"), F.col("d")
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.inverse_idf_recall(q, x), 6).alias("recall"), F.round(text.keyword_recall(q, x), 6).alias("keyword_recall"), text.common_words(q, x).alias("common")
    )


@query("""WITH t AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 1 AS id FROM (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM t) GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, term) <= 100),
x AS (SELECT item_id, i, coalesce(v.id, 1) AS id FROM (SELECT item_id, generate_subscripts(w, 1) AS i, unnest(w) AS term FROM t) LEFT JOIN v USING (term)),
l AS (SELECT item_id, list(id ORDER BY i) AS ids FROM x GROUP BY 1)
SELECT item_id, [coalesce(ids[i], 0)::BIGINT FOR i IN range(1, 13)] AS ids, [(i <= len(ids))::INT FOR i IN range(1, 13)] AS mask FROM l""")
def x28_vocabulary_lookup(spark, d):
    from pyspark.sql.window import Window

    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "term"))
    # The 100 most frequent terms: a top-n, numbered as one small group.
    v = w.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)
    v = v.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1).cast("long").alias("id"))
    x = w.join(F.broadcast(v), "term", "left").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(1).cast("long")).alias("id")))).alias("l"))
    i = F.transform("l", lambda z: z["id"])
    return x.select("item_id", text.padded(i, 12).alias("ids"), text.attention_mask(i, 12).alias("mask"))


@query("SELECT doc_id, doc_id // 128 AS chunk, doc_id % 4 AS worker FROM documents")
def x26_chunks_and_workers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 128).alias("chunk"), (F.col("doc_id") % 4).alias("worker"))


@query("SELECT doc_id, 'lang=' || lang || '|source=' || source AS snapshot, 'Doc ' || doc_id || ' from ' || source || ': .' AS rendered FROM documents")
def p14_snapshot_and_template(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.snapshot("|", lang=F.col("lang"), source=F.col("source")).alias("snapshot"),
        text.render("Doc {{ doc_id }} from {{meta.source}}: {{ nothing.here }}.", {"doc_id": F.col("doc_id"), "meta.source": F.col("source")}).alias("rendered"),
    )


@query("SELECT conv_id, string_agg('Paragraph ' || p || ': ' || role, chr(10) ORDER BY turn) AS joined FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) GROUP BY 1")
def p23_paragraphs(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", text.paragraphs(F.transform("r", lambda x: x["role"])).alias("joined"))


@query("SELECT page_id, to_base64(encode(url)) AS blob, url AS back FROM pages")
def p21_base64(spark, d):
    blob = text.base64_text(F.col("url"))
    return table(spark, d, "pages").select("page_id", blob.alias("blob"), text.base64_back(blob).alias("back"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 0.0 END, toxic::DOUBLE) AS score FROM labels")
def p22_score_precedence(spark, d):
    return table(spark, d, "labels").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, 0.0), F.col("toxic").cast("double")).alias("score"))


def _raw_documents(spark, d):
    """Documents as rows with labels in three shapes."""
    t = table(spark, d, "documents")
    q = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" what is "), "source")).when(F.col("doc_id") % 4 == 1, F.to_json(F.array(F.concat(F.lit(" "), "lang"), F.lit(""), F.col("source")))).when(F.col("doc_id") % 4 == 2, F.lit(None)).otherwise(F.lit("[not json"))
    return t.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), q.alias("queries"), "lang", "source", "n_chars")


@query("""SELECT doc_id::VARCHAR AS id, md5(text) AS content, CASE doc_id % 4 WHEN 0 THEN [' what is ' || source] WHEN 1 THEN [lang, source] WHEN 2 THEN []::VARCHAR[] ELSE ['[not json'] END AS labels,
 lang AS extra_lang, n_chars::VARCHAR AS extra_chars FROM documents""")
def p04_documents_adapter(spark, d):
    docs = adapt.to_documents(_raw_documents(spark, d), required=("lang",))
    return docs.select("id", F.md5("content").alias("content"), "meta.labels", F.col("meta.extra")["lang"].alias("extra_lang"), F.col("meta.extra")["n_chars"].alias("extra_chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS first FROM documents")
def p08_keywords(spark, d):
    j = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.to_json(F.array(F.struct(F.col("source").alias("keywords_or_phrase")), F.struct(F.col("lang").alias("keywords_or_phrase")))))
    t = table(spark, d, "documents").select("doc_id", j.alias("k"))
    k = adapt.normalised_keywords(F.col("k"), t.schema["k"].dataType)
    return t.select("doc_id", F.size(k).alias("n"), k[0]["keyword_or_phrase"].alias("first"))


@query("SELECT doc_id::VARCHAR AS doc_id, trim(lang) AS lang, '' AS title FROM documents")
def p17_aligned_columns(spark, d):
    return adapt.aligned(table(spark, d, "documents"), ["doc_id", "lang", "title"])


@query("SELECT doc_id, lang AS \"meta.lang\", source AS \"meta.where.source\" FROM documents")
def p12_flattened(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.struct("lang", F.struct("source").alias("where")).alias("meta"))
    return adapt.flattened(n)


@query("SELECT doc_id, lang, source FROM documents")
def p11_hoisted(spark, d):
    return adapt.hoisted(table(spark, d, "documents").select("doc_id", F.struct("lang", "source").alias("meta")), "meta", "doc_id")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, 'und') AS lang, 'web' AS origin FROM documents")
def p15_defaults(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"))
    return adapt.with_defaults(t, {"lang": "und", "origin": "web"})


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE 'unknown' END AS label FROM documents")
def k04_label_resolution(spark, d):
    t = table(spark, d, "documents")
    labels = F.when(F.col("doc_id") % 3 == 1, F.array(F.lit(" "), "lang")).otherwise(F.array().cast("array<string>"))
    return t.select("doc_id", adapt.first_label(F.when(F.col("doc_id") % 3 == 0, F.col("source")), labels).alias("label"))


@query(f"""WITH t AS (SELECT lang AS topic, unnest({_TOKENS.format('text')}) AS term FROM documents), n AS (SELECT topic, term, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT topic, sum(n) AS words FROM n GROUP BY 1), f AS (SELECT term, sum(n) AS f FROM n GROUP BY 1),
s AS (SELECT topic, term, n / words * ln(1 + (SELECT avg(words) FROM w) / f) AS score FROM n JOIN w USING (topic) JOIN f USING (term))
SELECT topic, rank::INT AS rank, term, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 10""")
def k01_topic_words(spark, d):
    t = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.explode(text.tokens(F.col("text"))).alias("term"))
    return clusters.topic_words(t, 10).withColumn("score", F.round("score", 9))


# Filters.

_LEAF = lambda f, o, v: {"field": f, "operator": o, "value": v}
_FILTERS = {
    "f01_equal": _LEAF("lang", "==", "en"),
    "f02_not_equal": _LEAF("lang", "!=", "en"),
    "f03_greater": _LEAF("n_chars", ">", 1000),
    "f04_at_least": _LEAF("n_chars", ">=", 1000),
    "f05_less": _LEAF("n_chars", "<", 500),
    "f06_at_most": _LEAF("n_chars", "<=", 500),
    "f07_in": _LEAF("meta.source", "in", ["src1", "src2", "src3"]),
    "f08_not_in": _LEAF("source", "not in", ["src1", "src2", "src3"]),
    "f09_and_or": {"operator": "AND", "conditions": [_LEAF("n_chars", ">", 300), {"operator": "OR", "conditions": [_LEAF("lang", "==", "fr"), _LEAF("source", "==", "src4")]}]},
    "f10_not": {"operator": "NOT", "conditions": [_LEAF("lang", "==", "en"), {"operator": "NOT", "conditions": [_LEAF("n_chars", ">", 1000)]}]},
    "f13_equals_all": filters.equals_all(["en"], "lang"),
}


def _filter_query(name, f):
    def run(spark, d):
        return filters.apply_filter(table(spark, d, "documents"), f).select("doc_id", "lang", "source", "n_chars")

    run.__name__ = name
    query(f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {filters.to_sql(f)}")(run)


for _name, _f in _FILTERS.items():
    _filter_query(_name, _f)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def f04_dates(spark, d):
    f = {"operator": "AND", "conditions": [_LEAF("ts", ">=", "2024-01-10"), _LEAF("ts", "<", "2024-01-12T00:00:00")]}
    return filters.apply_filter(table(spark, d, "events"), f).select("event_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND NOT (n_chars > 1000 OR source = 'src1')")
def f15_older_language(spark, d):
    t = table(spark, d, "documents")
    return t.where(filters.compile_legacy(t.schema, {"lang": ["en", "de"], "$not": {"n_chars": {"$gt": 1000}, "source": "src1"}})).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length({_CLEAN.format('source')}) BETWEEN 3 AND 256 AND length({_CLEAN.format('text')}) BETWEEN 50 AND 1500")
def f18_pair_lengths(spark, d):
    t = table(spark, d, "documents")
    return t.where(F.length(text.clean_text(F.col("source"))).between(3, 256) & F.length(text.clean_text(F.col("text"))).between(50, 1500)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_has_any([lang, source], ['de', 'src7'])")
def f19_any_keyword(spark, d):
    return table(spark, d, "documents").where(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("de"), F.lit("src7")))).select("doc_id")


_COVERED = "list_filter(string_split_regex(lower({0}), '[^A-Za-z\u0430-\u044f\u0410-\u042f0-9" + "".join("\\" + x for x in text.COVERAGE_SYMBOLS).replace("'", "''").replace("{", "{{").replace("}", "}}") + "]+'), lambda x: x <> '')"
_SHARE = f"(CASE WHEN ld > 0 THEN len(list_intersect(list_distinct({_COVERED}), dd)) / ld ELSE 0 END)"


@query(f"""WITH d AS (SELECT doc_id, lang, source, len({_COVERED.format('text')})::DOUBLE AS ld, list_distinct({_COVERED.format('text')}) AS dd FROM documents)
SELECT doc_id, (len({_COVERED.format('lang')}) + len({_COVERED.format("source || ' en'")})) / 2 AS "LQ", ld AS "LD", round(({_SHARE.format('lang')} + {_SHARE.format("source || ' en'")}) / 2, 9) AS "LQD",
 round({_SHARE.format("source || ' the'")}, 9) AS "LKD", round({_SHARE.format("source || ' the' || chr(10) || lang || ' and'")}, 9) AS "LKED" FROM d""")
def x22_coverage(spark, d):
    t = table(spark, d, "documents")
    keywords = F.array(F.struct(F.concat("source", F.lit(" the")).alias("keyword_or_phrase"), F.concat("lang", F.lit(" and")).alias("explanation")))
    c = text.coverage(F.array("lang", F.concat("source", F.lit(" en"))), F.col("text"), keywords)
    return t.select("doc_id", c.alias("c")).select("doc_id", "c.LQ", "c.LD", *(F.round(f"c.{x}", 9).alias(x) for x in ("LQD", "LKD", "LKED")))


@query("SELECT doc_id, array_to_string([lang, source, lang, 'x'], ' ') AS flat, 4 AS n FROM documents")
def p13_flat_list(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.array(F.array(F.array("lang", "source"), F.array("lang")), F.array(F.array(F.lit("x")))).alias("nested"))
    return t.withColumn("flat", adapt.flat_list(F.col("nested"), t.schema["nested"].dataType)).select("doc_id", F.concat_ws(" ", "flat").alias("flat"), F.size("flat").alias("n"))


@query("SELECT doc_id::VARCHAR AS doc_id, n_chars, doc_id::VARCHAR AS inner_id, (n_chars + 1)::VARCHAR AS item FROM documents")
def p16_ids_as_text(spark, d):
    t = table(spark, d, "documents").select(F.struct("doc_id", "n_chars", F.struct(F.col("doc_id").alias("chunk_id"), F.array(F.col("n_chars") + 1).alias("items")).alias("meta")).alias("r"))
    return t.select(adapt.ids_as_text(F.col("r"), t.schema["r"].dataType).alias("r")).select("r.doc_id", "r.n_chars", F.col("r.meta.chunk_id").alias("inner_id"), F.col("r.meta.items")[0].alias("item"))


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'de' AND n_chars > 200) AND (source IN ('web', 'code') OR lang IS NOT NULL)")
def f16_emitted_sql(spark, d):
    """A filter written out as SQL and read by the engine's own parser."""
    leaf = lambda f, o, v: {"field": f, "operator": o, "value": v}
    f = {"operator": "AND", "conditions": [
        {"operator": "NOT", "conditions": [leaf("lang", "==", "de"), leaf("n_chars", ">", 200)]},
        {"operator": "OR", "conditions": [leaf("source", "in", ["web", "code"]), leaf("lang", "!=", None)]},
    ]}
    return table(spark, d, "documents").where(filters.to_sql(f)).select("doc_id")
