"""Queries over joins, aggregates, windows, sorts, sets and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text
from siftwell.operators import evaluate, relational, training
from siftwell.plans.registry import query, table
from siftwell.plans.texts import _TOKENS


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_inner_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.n_chars % 2 = l.quality")
def j02_left_join_composite(spark, d):
    a, b = table(spark, d, "documents").alias("d"), table(spark, d, "labels").alias("l")
    return a.join(b, (F.col("d.doc_id") == F.col("l.doc_id")) & (F.col("d.n_chars") % 2 == F.col("l.quality")), "left").select("d.doc_id", "l.toxic")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.g, b.g) AS g, a.n AS left_n, b.n AS right_n FROM (SELECT l_suppkey % 40 AS k, l_returnflag AS g, count(*) AS n FROM lineitem WHERE l_discount < 0.03 GROUP BY ALL) a FULL JOIN (SELECT l_suppkey % 50 AS k, l_returnflag AS g, count(*) AS n FROM lineitem WHERE l_discount > 0.06 GROUP BY ALL) b ON a.k = b.k AND a.g = b.g")
def j03_full_outer_join(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_discount < 0.03").groupBy((F.col("l_suppkey") % 40).alias("k"), F.col("l_returnflag").alias("g")).agg(F.count(F.lit(1)).alias("left_n"))
    b = li.where("l_discount > 0.06").groupBy((F.col("l_suppkey") % 50).alias("k"), F.col("l_returnflag").alias("g")).agg(F.count(F.lit(1)).alias("right_n"))
    return a.join(b, ["k", "g"], "full_outer")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def j04_lookup_chain(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("""WITH q AS (SELECT o_custkey AS qid, o_orderkey AS pid, o_orderkey AS seq FROM orders), p AS (SELECT l_suppkey AS qid, l_orderkey AS pos, l_partkey AS neg, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
ok AS (SELECT p.qid, arg_min(neg, seq) AS neg FROM p WHERE EXISTS (SELECT 1 FROM q WHERE q.qid = p.qid AND q.pid = p.pos) GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS nth FROM q)
SELECT n.qid, pid, n.seq, CASE WHEN nth = 1 THEN neg END AS neg FROM n LEFT JOIN ok USING (qid)""")
def j05_verified_negatives(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("pid"), F.col("o_orderkey").alias("seq"))
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("neg"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return relational.verified_negatives(q, p)


@query("WITH r AS (SELECT o_orderkey AS request_id, [o_custkey, 1000000000, o_orderkey] AS ids FROM orders) SELECT request_id, i - 1 AS pos, c_custkey AS id, c_name AS name FROM (SELECT request_id, generate_subscripts(ids, 1) AS i, unnest(ids) AS id FROM r) JOIN customer ON c_custkey = id")
def j06_ordered_lookup(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.array(F.col("o_custkey").cast("long"), F.lit(1000000000).cast("long"), F.col("o_orderkey").cast("long")).alias("ids"))
    return relational.lookup(r, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).select("request_id", "pos", "id", "name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j12_delete_by_ids(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents")
def a01_counts(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query("SELECT source, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS std FROM documents GROUP BY 1")
def a02_mean_and_deviation(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("n_chars"), F.lit(0.0)), 6).alias("std"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles, string_agg(role, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY 1")
def a04_ordered_lists(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    roles = F.transform("r", lambda x: x["role"])
    return g.select("conv_id", roles.alias("roles"), F.array_join(roles, " ").alias("joined"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 20")
def a05_word_counts(spark, d):
    t = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query(f"SELECT item_id, term, count(*)::INT AS tf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL")
def a07_term_frequencies(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(text.term_frequencies(text.tokens(F.col("text")))).alias("term", "tf"))


@query("SELECT o_custkey AS query, list_sort(list(DISTINCT o_orderpriority)) AS positives FROM orders GROUP BY 1")
def a09_positive_sets(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("positives"))


@query("SELECT count(*) AS batches FROM (SELECT doc_id // 8 AS b FROM documents GROUP BY 1 HAVING count(source) > count(DISTINCT source))")
def a10_duplicate_batches(spark, d):
    return training.duplicate_batches(table(spark, d, "documents"), "doc_id", "source", 8)


@query("SELECT count(*) AS total, count(*) FILTER (NOT contains(lower(text), lower(k))) AS absent FROM (SELECT text, unnest(['licensed', 'worthless', 'the']) AS k FROM documents)")
def a12_keyword_coverage(spark, d):
    t = table(spark, d, "documents").withColumn("k", F.array(*(F.lit(x) for x in ("licensed", "worthless", "the"))))
    return relational.keyword_coverage(t, "k", "text")


@query("SELECT doc_id, round((n_chars - m) / s, 6) AS z FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)")
def a13_broadcast_statistics(spark, d):
    t = table(spark, d, "documents")
    s = t.agg(F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("s")).first()
    return t.select("doc_id", F.round((F.col("n_chars") - s["m"]) / s["s"], 6).alias("z"))


@query("SELECT event_type, value >= 50 AS above, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY ALL")
def a14_histogram_share(spark, d):
    return evaluate.histogram_share(table(spark, d, "events"), ["event_type"], "value", 50).withColumn("share", F.round("share", 6))


@query("SELECT round(sqrt(sum(value * value)), 6) AS norm FROM events")
def a16_norm(spark, d):
    return table(spark, d, "events").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("norm"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents")
def w01_count_over(spark, d):
    return table(spark, d, "documents").select("doc_id", F.count(F.lit(1)).over(Window.partitionBy("source")).alias("n"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def w02_keep_first(spark, d):
    return relational.first_per(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "source")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nr FROM events")
def w03_row_numbers(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("nr"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def w04_moving_average(spark, d):
    return relational.moving_average(table(spark, d, "events"), "value", "event_id", 5, ["user_id"]).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT l_suppkey AS k, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 4) AS slope, round(regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 3) AS intercept FROM lineitem GROUP BY 1")
def w05_linear_trend(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    t = relational.linear_trend(li, "x", "y", ["k"])
    return t.select("k", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS level, min(doc_id) OVER (PARTITION BY source) AS first FROM documents")
def t02_rebalanced_rows(spark, d):
    return training.rebalanced(table(spark, d, "documents"), "source", "doc_id").select("doc_id", F.col("level").cast("long").alias("level"), "first")


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 100")
def o07_last_rows(spark, d):
    return relational.last_rows(table(spark, d, "events").select("event_id", "ts"), 100, "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def o01_top_k_per_group(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def o04_sorted_head(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT doc_id FROM documents ORDER BY md5('17:' || doc_id), doc_id LIMIT 100")
def o05_reservoir(spark, d):
    return training.reservoir(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("""WITH q AS (SELECT DISTINCT o_custkey AS qid FROM orders), a AS (SELECT qid FROM q ORDER BY md5('42:' || qid), qid LIMIT 50), b AS (SELECT qid FROM q WHERE qid NOT IN (SELECT qid FROM a) ORDER BY md5('43:' || qid), qid LIMIT 20)
SELECT qid, 'train' AS split FROM a UNION ALL SELECT qid, 'dev' AS split FROM b""")
def o11_seeded_selection(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.lit(1).alias("relevance"))
    s = relational.selection(q, 50, 20)
    return s["train"].withColumn("split", F.lit("train")).union(s["dev"].withColumn("split", F.lit("dev")))


@query("""WITH n AS (SELECT doc_id AS pid FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents)),
r AS (SELECT doc_id AS pid FROM documents WHERE doc_id NOT IN (SELECT pid FROM n) ORDER BY md5('44:' || doc_id), doc_id LIMIT (SELECT greatest(0, 500 - count(*)) FROM n))
SELECT pid, true AS needed FROM n UNION ALL SELECT pid, false AS needed FROM r""")
def o11_corpus_selection(spark, d):
    docs, good = table(spark, d, "documents").select(F.col("doc_id").alias("pid")), table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("pid"))
    return relational.corpus_selection(docs, good, 500)


@query("SELECT * FROM (SELECT doc_id, 0 AS sample FROM documents ORDER BY md5('17:' || doc_id), doc_id LIMIT 40) UNION ALL SELECT * FROM (SELECT doc_id, 1 AS sample FROM documents ORDER BY md5('18:' || doc_id), doc_id LIMIT 40)")
def o10_repeated_samples(spark, d):
    return training.repeated_samples(table(spark, d, "documents").select("doc_id"), 40, 2, "doc_id")


@query("""SELECT doc_id // 16 AS batch, doc_id, coalesce(lead(doc_id) OVER w, first(doc_id) OVER w) AS partner FROM documents WINDOW w AS (PARTITION BY doc_id // 16 ORDER BY md5('17:' || doc_id), doc_id)""")
def o12_derangement(spark, d):
    return training.derangement(table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("batch"), "doc_id"), "batch", "doc_id").select("batch", "doc_id", "partner")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 2) ORDER BY doc_id LIMIT 100")
def f20_selected_titles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    titles = [r[0] for r in docs.where("source is not null").select("source").distinct().orderBy("source").limit(2).collect()]
    return relational.selected_titles(docs, "source", titles, 100, "doc_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a17_grouping_sets(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT event_id, user_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, (ntile(4) OVER w)::INT AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w10_neighbouring_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"))


@query("(SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def u06_set_operations(spark, d):
    lab = table(spark, d, "labels")
    good, bad = lab.where("quality = 1").select("doc_id"), lab.where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id").intersect(good).subtract(bad)


@query("SELECT doc_id AS id FROM documents UNION ALL SELECT item_id AS id FROM benchmark")
def u01_concat(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id")))


@query("SELECT DISTINCT lang, source FROM documents")
def u03_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY ALL")
def u04_dedup_pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return relational.first_per(li, ["l_partkey", "l_suppkey"], "seq")


@query("SELECT c.conv_id, t - 1 AS query_pos, r AS query, n FROM (SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1) c, LATERAL (SELECT generate_subscripts(roles, 1) AS t, unnest(roles) AS r)")
def t01_training_rows(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count(F.lit(1)).alias("n"))
    g = g.select("conv_id", F.transform("r", lambda x: x["role"]).alias("queries"), "n")
    return training.training_rows(g, "queries", "n", "conv_id").select("conv_id", F.col("query_pos").cast("long").alias("query_pos"), "query", "n")


def _keyed_batches(spark, d):
    return table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("batch"), (F.col("doc_id") % 16).alias("i"), F.col("doc_id").alias("doc_key"), F.md5("text").alias("content_key"), F.col("source").alias("query_key"))


@query("""WITH k AS (SELECT doc_id // 16 AS batch, doc_id % 16 AS i, text, source FROM documents),
p AS (SELECT a.batch, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 2 WHEN a.text = b.text OR a.source = b.source THEN 1 ELSE 0 END AS tier FROM k a JOIN k b ON a.batch = b.batch)
SELECT batch, i, j AS negative, tier > 0 AS fallback FROM p QUALIFY row_number() OVER (PARTITION BY batch, i ORDER BY tier, md5('17:' || i || ':' || j), j) = 1""")
def t03_safe_negatives(spark, d):
    return training.safe_negatives(_keyed_batches(spark, d))


_TURNS = f"""q AS (SELECT conv_id // 8 AS batch, conv_id % 8 AS i, a.text AS query, b.text AS doc FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn = 1)"""


def _turns(spark, d):
    """First questions and answers of conversations, in batches of eight."""
    c = table(spark, d, "conversations")
    q, a = c.where("turn = 0").select("conv_id", F.col("text").alias("query")), c.where("turn = 1").select("conv_id", F.col("text").alias("doc"))
    return q.join(a, "conv_id").select(
        F.floor(F.col("conv_id") / 8).alias("batch"), (F.col("conv_id") % 8).alias("i"), F.col("conv_id").alias("doc_key"), F.md5("doc").alias("content_key"), F.md5("query").alias("query_key"), "query", "doc"
    )


def _negatives_sql(top: int | None) -> str:
    rank = f"WHERE NOT any_safe OR nth <= {top}" if top else ""
    good = "safe AND s >= 0.2" if top else "safe"
    return f"""WITH {_TURNS},
p AS (SELECT a.batch, a.i, b.i AS j, CASE WHEN a.doc = b.doc THEN 2 WHEN a.query = b.query THEN 1 ELSE 0 END AS tier, {_TOKENS.format('a.query')} AS q, {_TOKENS.format('b.doc')} AS d FROM q a JOIN q b ON a.batch = b.batch AND a.i <> b.i),
l AS (SELECT * FROM p QUALIFY tier = min(tier) OVER (PARTITION BY batch, i)),
w AS (SELECT *, list_transform(q, lambda x: 1 / ln(1 + greatest(1, len(list_filter(d, lambda y: y = x))))) AS w FROM l),
s AS (SELECT batch, i, j, tier, round(coalesce(list_sum([CASE WHEN list_contains(d, q[n]) THEN w[n] ELSE 0 END FOR n IN range(1, len(q) + 1)]), 0) / CASE WHEN len(q) = 0 THEN 1 ELSE list_sum(w) END, 9) AS s FROM w),
f AS (SELECT *, s <= 0.6 AS safe FROM s), g AS (SELECT *, {good} AS good FROM f),
h AS (SELECT *, bool_or(safe) OVER x AS any_safe, bool_or(good) OVER x AS any_good FROM g WINDOW x AS (PARTITION BY batch, i)),
k AS (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) AS nth FROM h WHERE CASE WHEN any_good THEN good WHEN any_safe THEN safe ELSE true END),
m AS (SELECT * FROM (SELECT * FROM k {rank}) QUALIFY row_number() OVER (PARTITION BY batch, i ORDER BY md5('17:' || batch || ':' || i || ':' || j), j) = 1)
SELECT q.batch, q.i, coalesce(m.j, q.i) AS negative, coalesce(tier = 2, true) AS fallback FROM q LEFT JOIN m ON q.batch = m.batch AND q.i = m.i"""


def _recall(q, x):
    return F.round(text.inverse_idf_recall(text.tokens(q), text.tokens(x)), 9)


@query(_negatives_sql(None))
def t04_safe_random_negatives(spark, d):
    return training.idf_negatives(_turns(spark, d), _recall, "safe-random", high=0.6)


@query(_negatives_sql(2))
def t04_hard_idf_negatives(spark, d):
    return training.idf_negatives(_turns(spark, d), _recall, "hard-idf", 0.2, 0.6, 2)


@query(f"WITH {_TURNS} SELECT a.batch, a.i, b.i AS slot, a.doc = b.doc OR a.query = b.query AS match FROM q a JOIN q b ON a.batch = b.batch + 1")
def j09_bank_identities(spark, d):
    """Each batch against a bank that holds the batch before it."""
    t = _turns(spark, d)
    bank = t.select((F.col("batch") + 1).alias("batch"), F.col("i").alias("slot"), *training.KEYS)
    return training.bank_identities(t, bank)


@query("""WITH r AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, CASE WHEN event_id % 2 = 0 THEN value END AS score, event_type = 'error' AS relevant FROM events)
SELECT query_id, rank::INT AS rank, coalesce(score, count(*) OVER (PARTITION BY query_id) - rank + 1)::DOUBLE AS score, relevant FROM r""")
def m11_default_scores(spark, d):
    """Events of each user as results: those with odd ids lack a score."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = table(spark, d, "events").select(
        F.col("user_id").alias("query_id"), F.lit("error").alias("query"), rank.alias("rank"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("score"), F.col("event_type").alias("labels")
    )
    return evaluate.scored_results(r).select("query_id", "rank", "score", "relevant")


@query("WITH k AS (SELECT l_orderkey AS batch, l_linenumber AS i, l_quantity::DOUBLE AS s FROM lineitem), p AS (SELECT a.batch, a.i, b.i AS j, a.s * b.s / 2500 AS s FROM k a JOIN k b ON a.batch = b.batch) SELECT batch, i, j FROM p WHERE i <> j AND s BETWEEN 0.1 AND 0.5 QUALIFY row_number() OVER (PARTITION BY batch, i ORDER BY s DESC, j) <= 2")
def t04_semi_hard_negatives(spark, d):
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("double").alias("s"))
    p = k.join(k.select("batch", F.col("i").alias("j"), F.col("s").alias("t")), "batch").select("batch", "i", "j", (F.col("s") * F.col("t") / 2500).alias("s"))
    return training.scored_negatives(p, "semi-hard", 0.1, 0.5, 2).select("batch", "i", "j")


@query("SELECT doc_id, round(quality / (1 + exp(-0.5)) + toxic / (1 + exp(0.25)), 6) AS bigamma, round(0.3 * quality + 0.7 * toxic, 6) AS gamma FROM labels")
def t16_gamma_mix(spark, d):
    t = table(spark, d, "labels")
    q, x = F.col("quality"), F.col("toxic")
    return t.select("doc_id", F.round(training.bigamma(q, x, 0.5, -0.25), 6).alias("bigamma"), F.round(training.gamma_mix(q, x, 0.3), 6).cast("double").alias("gamma"))
