"""The audit queries on the star-schema and document tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.functions import names as N
from corvane.operators import aggregates as A
from corvane.operators import joins as J
from corvane.operators import languages as L
from corvane.operators import samples as S
from corvane.operators import sets as P
from corvane.operators import similarity as M
from corvane.operators.spans import first_spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BUCKETS = ["easy positive", "easy negative", "hard positive", "hard negative"]


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels: bucket is difficulty by length and polarity by quality."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, d, "labels"), "doc_id", "left")
    bucket = F.concat_ws(" ", F.when(F.col("n_chars") < 2000, "easy").otherwise("hard"), F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative"))
    return rows.withColumn("bucket", bucket)


LABELLED = """labelled AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
  CASE WHEN n_chars < 2000 THEN 'easy' ELSE 'hard' END || CASE quality WHEN 1 THEN ' positive' WHEN 0 THEN ' negative' ELSE '' END AS bucket
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"""WITH {LABELLED} SELECT count(*) AS total,
  count(*) FILTER (bucket = 'easy positive') AS easy_positive, count(*) FILTER (bucket = 'easy negative') AS easy_negative,
  count(*) FILTER (bucket = 'hard positive') AS hard_positive, count(*) FILTER (bucket = 'hard negative') AS hard_negative,
  count(*) FILTER (bucket IN ('easy', 'hard')) AS other FROM labelled""")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.label_distribution(labelled(spark, d), F.col("bucket"), BUCKETS)


@query(f"""WITH {LABELLED} SELECT coalesce(bucket, 'total') AS bucket, count(*) FILTER (toxic = 0) AS accepted,
  count(*) FILTER (toxic = 1) AS disagreed, count(*) AS generated, round(count(*) FILTER (toxic = 0) / count(*) * 100, 6) AS rate
  FROM labelled WHERE quality IS NOT NULL GROUP BY ROLLUP (bucket)""")
def corpus_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.breakdown(labelled(spark, d), F.col("bucket"), F.col("toxic") == 0, BUCKETS)


DIMENSIONS = """dims AS (SELECT doc_id, unnest(['lang', 'source', 'size']) AS dimension, unnest([lang, source, CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS VARCHAR)]) AS value FROM documents),
counted AS (SELECT dimension, value, count(*) AS n, min(doc_id) AS first FROM dims GROUP BY ALL),
shares AS (SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension) * 100, 6) AS share,
  CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, first, value) AS INTEGER) AS rank FROM counted)"""


def dimensions() -> dict:
    return {"lang": F.col("lang"), "source": F.col("source"), "size": F.floor(F.col("n_chars") / 1000)}


@query(f"WITH {DIMENSIONS} SELECT * FROM shares WHERE rank <= 8")
def composition_topn(spark: SparkSession, d: str) -> DataFrame:
    return A.composition(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), dimensions(), 8, F.col("doc_id"))


@query(f"""WITH {DIMENSIONS} SELECT dimension, count(*) AS "distinct", min(share) AS min_share, max(share) AS max_share, round(100.0 / count(*), 6) AS even_share FROM shares GROUP BY dimension""")
def business_spread(spark: SparkSession, d: str) -> DataFrame:
    return A.spread(table(spark, d, "documents").select("lang", "source", "n_chars"), dimensions())


SUMMARY = """s AS (SELECT list_sort(list(n_chars)) AS l, count(*) AS n FROM documents WHERE n_chars > 0),
summary AS (SELECT n AS total, l[1] AS shortest, (l[CAST(floor((n + 1) / 2) AS BIGINT)] + l[CAST(floor(n / 2) AS BIGINT) + 1]) / 2 AS median, l[n] AS longest,
  l[least(n - 1, CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) + 1] AS p99 FROM s)"""


@query(f"WITH {SUMMARY} SELECT * FROM summary")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.length_summary(table(spark, d, "documents"), F.col("n_chars"))


@query(f"""WITH {SUMMARY}, t AS (SELECT shortest, greatest(p99, shortest + 1) AS top FROM summary),
w AS (SELECT *, coalesce(list_min(list_filter([10, 20, 25, 50, 100, 200, 250, 500, 1000, 2000, 2500, 5000, 10000], lambda x: x >= (top - shortest) / 28)),
  10000 * greatest(1, CAST(round_even((top - shortest) / 28 / 10000, 0) AS BIGINT))) AS width FROM t),
b AS (SELECT width, CAST(floor(shortest / width) AS BIGINT) * width AS low, CAST(floor(top / width) AS BIGINT) * width AS high FROM w),
bins AS (SELECT unnest(range(low, high + 1, width)) AS bin, width, high FROM b),
c AS (SELECT least(CAST(floor(n_chars / width) AS BIGINT) * width, high) AS bin, count(*) AS n FROM documents, b WHERE n_chars > 0 AND n_chars <= high + width GROUP BY 1)
SELECT bin, bin + width AS upto, coalesce(n, 0) AS n FROM bins LEFT JOIN c USING (bin)
UNION ALL SELECT high + width, NULL, (SELECT count(*) FROM documents WHERE n_chars > high + width) FROM b""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.length_histogram(table(spark, d, "documents"), F.col("n_chars"))


@query("""SELECT lang AS value, count(*) AS n, (SELECT count(*) FROM documents WHERE trim(lang) <> '') AS total FROM documents WHERE trim(lang) <> ''
GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1""")
def dominant_language(spark: SparkSession, d: str) -> DataFrame:
    return A.dominant(table(spark, d, "documents"), F.col("lang"), F.col("doc_id"))


@query("""WITH c AS (SELECT conv_id, bool_or(role = 'assistant') AS hit, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS polarity FROM conversations GROUP BY conv_id)
SELECT polarity, count(*) FILTER (hit) AS detected, count(*) AS checked, round(count(*) FILTER (hit) / count(*) * 100, 6) AS percent FROM c GROUP BY polarity""")
def detection_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("polarity", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    return A.coverage(rows, "conv_id", F.col("role") == "assistant", "polarity")


ENTROPY = """SELECT {group}, CAST(sum(c) AS BIGINT) AS total, count(*) AS bands, CASE WHEN count(*) > 1 THEN round(sum(-p * log2(p)) / log2(count(*)), 6) ELSE 0.0 END AS entropy
FROM (SELECT *, c / sum(c) OVER (PARTITION BY {group}) AS p FROM (SELECT {group}, band, count(*) AS c FROM (SELECT {group}, {band} AS band FROM {source}) WHERE band IS NOT NULL GROUP BY {group}, band)) GROUP BY {group}"""

POSITIONS = """(SELECT lang, instr(text, '. ') - 1 AS start, n_chars FROM documents WHERE instr(text, '. ') > 0)"""


@query(ENTROPY.format(group="lang", band="CAST(least(4, greatest(0, floor(start / n_chars * 5))) AS INTEGER)", source=POSITIONS))
def position_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Where the first sentence ends, in fifths of the text, by language."""
    at = F.instr("text", ". ")
    rows = table(spark, d, "documents").where(at > 0).select("lang", (at - 1).alias("start"), "n_chars")
    return A.band_entropy(rows, ["lang"], X.position_band(F.col("start"), F.col("n_chars")))


KEYWORD_BAND = "CASE WHEN value >= 0 AND value < 200 THEN CAST(least(3, floor(value / 50)) AS INTEGER) WHEN value >= 201 AND value <= 300 THEN 10 + CAST(least(4, floor((value - 201) / 19.8::DOUBLE)) AS INTEGER) END"


def keyword_bands(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    band = F.coalesce(X.keyword_band(F.lit("easy"), value), F.lit(10) + X.keyword_band(F.lit("hard"), value))
    return A.band_entropy(table(spark, d, "events"), ["event_type"], band)


@query(ENTROPY.format(group="event_type", band=KEYWORD_BAND, source="events"))
def keyword_entropy(spark: SparkSession, d: str) -> DataFrame:
    return keyword_bands(spark, d)


@query(f"""SELECT event_type, entropy, CASE WHEN entropy >= 0.7 THEN 'strong' WHEN entropy >= 0.55 THEN 'acceptable' WHEN entropy >= 0.3 THEN 'weak' ELSE 'critical' END AS grade
FROM ({ENTROPY.format(group="event_type", band=KEYWORD_BAND, source="events")})""")
def grade_ladder(spark: SparkSession, d: str) -> DataFrame:
    return keyword_bands(spark, d).select("event_type", "entropy", X.grade(F.col("entropy"), 0.7, 0.55, 0.3).alias("grade"))


@query(r"""WITH f AS (SELECT text, instr(text, regexp_extract(text, '[0-9]+')) - 1 AS start FROM documents WHERE regexp_matches(text, '[0-9]')),
w AS (SELECT regexp_replace(substring(text, greatest(0, start - 80) + 1, start - greatest(0, start - 80)), '(?s)^.*(\n|[.!?]\s)', '') AS cut FROM f),
t AS (SELECT list_filter(string_split_regex(regexp_replace(cut, '^[ \t:–-]+|[ \t:–-]+$', '', 'g'), '\s+'), lambda x: x <> '') AS words FROM w),
l AS (SELECT lower(regexp_replace(array_to_string(words[greatest(1, len(words) - 3):len(words)], ' '), '^[ :,-]+|[ :,-]+$', '', 'g')) AS label FROM t)
SELECT count(*) AS total, count(DISTINCT label) AS "distinct", round(count(DISTINCT label) / count(*), 6) AS score FROM l WHERE label <> ''""")
def label_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """How many of the lead-ins of first digit runs are worded differently."""
    text = F.col("text")
    rows = table(spark, d, "documents").where(text.rlike("[0-9]"))
    label = X.observed_label(text, F.regexp_instr(text, F.lit("[0-9]")) - 1)
    found = rows.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return found.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.round(F.count("*") / F.sum("n"), 6).alias("score"))


@query(f"""WITH {LABELLED} SELECT unnest(['lang', 'source', 'quality', 'toxic']) AS field, unnest([n, n, n, n]) AS total, unnest([a, b, c, e]) AS n_empty FROM
(SELECT count(*) AS n, count(*) FILTER (lang IS NULL OR lang = '') AS a, count(*) FILTER (source IS NULL OR source = '') AS b,
  count(*) FILTER (quality IS NULL) AS c, count(*) FILTER (toxic IS NULL) AS e FROM labelled)""")
def field_completeness(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return A.field_completeness(labelled(spark, d), {c: blank(c) for c in ("lang", "source", "quality", "toxic")})


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS numeric, CAST(sum(CAST(props->>'$.k' AS DOUBLE)) AS DOUBLE) AS total FROM events GROUP BY event_type""")
def numeric_confidence(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    rows = table(spark, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").alias("v"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(X.is_numeric(v)).alias("numeric"), F.sum(X.to_number(v)).alias("total"))


@query("""SELECT CAST(props->>'$.k' AS BIGINT) AS k, 'BIGINT' AS kind, count(*) AS n FROM events GROUP BY ALL""")
def json_projection(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    rows = table(spark, d, "events").select(X.get(v, "$.k", "long").alias("k"), X.kind(F.try_variant_get(v, "$.k", "variant")).alias("kind"))
    return rows.groupBy("k", "kind").agg(F.count("*").alias("n"))


MAJORITY = """m AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM m)"""


@query(f"""WITH {MAJORITY}, x AS (SELECT d.source, d.doc_id FROM documents d JOIN r ON d.source = r.source AND r.rank = 1 AND d.lang IS DISTINCT FROM r.lang),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM x)
SELECT k.source, any_value(r.lang) AS majority, count(*) AS n, list(doc_id ORDER BY doc_id) FILTER (i <= 3) AS examples FROM k JOIN r ON k.source = r.source AND r.rank = 1 GROUP BY k.source""")
def language_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose language is not that of most rows of their source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    counted = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    main = counted.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("majority"))
    odd = docs.join(main, "source").where(~F.col("lang").eqNullSafe(F.col("majority")))
    return A.top_examples(odd, ["source", "majority"], ["doc_id"], "doc_id", 3)


@query("""SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS "both", count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS orphan
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def parity_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return P.parity(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def disjoint_intersect(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return P.overlap(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def orphan_anti(spark: SparkSession, d: str) -> DataFrame:
    return P.orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def wanted_semi(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the customers of a market segment."""
    asked = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return P.wanted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), asked, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


LINES = """lines AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, min(l_shipdate) AS first_ship, CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DOUBLE) AS total,
  CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS status FROM lineitem GROUP BY l_orderkey)"""


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linestatus", "l_extendedprice", "l_discount", "l_tax")
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return lines.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), total.alias("total"), status.alias("status"))


@query(f"""WITH {LINES}, j AS (SELECT * FROM orders JOIN lines USING (o_orderkey))
SELECT unnest(['status', 'total', 'late']) AS field, unnest([n, n, n]) AS checked, unnest([a, b, c]) AS mismatched FROM
(SELECT count(*) AS n, count(*) FILTER (o_orderstatus IS DISTINCT FROM status) AS a, count(*) FILTER (round(o_totalprice, 0) IS DISTINCT FROM round(total, 0)) AS b,
  count(*) FILTER ((first_ship < o_orderdate) IS DISTINCT FROM false) AS c FROM j)""")
def join_field_mismatch(spark: SparkSession, d: str) -> DataFrame:
    fields = {
        "status": (F.col("o_orderstatus"), F.col("status")),
        "total": (F.round("o_totalprice", 0), F.round("total", 0)),
        "late": (F.col("first_ship") < F.col("o_orderdate"), F.lit(False)),
    }
    return J.field_mismatch(table(spark, d, "orders"), order_lines(spark, d), ["o_orderkey"], fields)


@query(f"""WITH {LINES}, a AS (SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders),
b AS (SELECT count(*) AS with_lines, count(*) FILTER (status = 'F') AS finished_lines, CAST(sum(n) AS BIGINT) AS lines FROM lines)
SELECT *, orders = with_lines AS same_count, finished = finished_lines AS same_finished FROM a, b""")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two one-row aggregates side by side."""
    a = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    b = order_lines(spark, d).agg(F.count("*").alias("with_lines"), F.count_if(F.col("status") == "F").alias("finished_lines"), F.sum("n").alias("lines"))
    return a.join(F.broadcast(b)).withColumn("same_count", F.expr("orders = with_lines")).withColumn("same_finished", F.expr("finished = finished_lines"))


@query("""WITH f AS (SELECT p_brand, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS form, count(*) AS n FROM part GROUP BY ALL HAVING form <> '')
SELECT p_brand, CAST(sum(n) AS BIGINT) AS total, count(*) AS "distinct", CAST(sum(n - 1) AS BIGINT) AS reused, round(1 - sum(n - 1) / sum(n), 6) AS diversity FROM f GROUP BY p_brand""")
def value_reuse_diversity(spark: SparkSession, d: str) -> DataFrame:
    return A.value_reuse(table(spark, d, "part"), F.col("p_name"), ["p_brand"])



# Whole items are looked for.
PROBES = r"""probes AS (SELECT item_id, text AS value FROM benchmark WHERE text <> ''),
hits AS (SELECT doc_id, item_id, value, text, instr(text, value) - 1 AS start, length(value) AS size FROM documents JOIN probes ON contains(text, value))"""


def value_hits(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, item_id, value, start, size): benchmark items in documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("value_id"), F.col("text").alias("value"))
    return first_spans(docs, items).withColumnsRenamed({"id": "doc_id", "value_id": "item_id"})


@query(rf"""WITH {PROBES}, all_hits AS (SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM hits GROUP BY item_id)
SELECT * FROM all_hits""")
def value_span_search(spark: SparkSession, d: str) -> DataFrame:
    return value_hits(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query(rf"""WITH {PROBES} SELECT doc_id, item_id, CAST(start AS BIGINT) AS start,
  CASE WHEN substring(text, claimed + 1, size) = value THEN 'exact' ELSE 'drifted' END AS verdict
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN start + 1 ELSE start END AS claimed FROM hits)""")
def offset_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Claimed offsets (every third document claims one too far) against the text."""
    claimed = value_hits(spark, d).withColumn("claimed", F.when(F.col("doc_id") % 3 == 0, F.col("start") + 1).otherwise(F.col("start")))
    exact = F.substring(F.col("text"), F.col("claimed") + 1, F.col("size")) == F.col("value")
    return claimed.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.when(exact, "exact").otherwise("drifted").alias("verdict"))


@query(rf"""WITH {PROBES} SELECT doc_id, item_id,
  length(substring(text, greatest(0, start - 250) + 1, start + size + 250 - greatest(0, start - 250))) AS width,
  contains(substring(text, greatest(0, start - 250) + 1, start + size + 250 - greatest(0, start - 250)), ' the ') AS confirmed FROM hits""")
def proximity_window(spark: SparkSession, d: str) -> DataFrame:
    """Whether a keyword stands near the value."""
    window = X.proximity_window(F.col("text"), F.col("start"), F.col("size"), F.lit(None).cast("long"), F.lit(None).cast("string"))
    rows = value_hits(spark, d).withColumn("window", window)
    return rows.select("doc_id", "item_id", F.length("window").cast("long").alias("width"), F.contains("window", F.lit(" the ")).alias("confirmed"))


# Whole items are part 0, their sentences parts 1, 2, ...; a text may have some of the sentences alone.
SENTENCES = r"""pieces AS (SELECT item_id, text, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
probes AS (SELECT item_id, 0 AS part, text AS value FROM pieces WHERE text <> ''
  UNION ALL SELECT item_id, part, parts[part] FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS part FROM pieces) WHERE parts[part] <> ''),
hits AS (SELECT doc_id, item_id, part, text, instr(text, value) - 1 AS start FROM documents JOIN probes ON contains(text, value))"""


@query(rf"""WITH {SENTENCES}, p AS (SELECT doc_id, item_id, part, start, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM hits),
e AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: length(x) + 1)) AS BIGINT) - 1) AS ends FROM p),
h AS (SELECT *, list_min(list_filter(range(1, len(parts) + 1), lambda i: ends[i] >= start AND (i = 1 OR ends[i - 1] + 1 <= start))) AS hit FROM e)
SELECT doc_id, item_id, CAST(part AS INTEGER) AS part, CASE WHEN hit > 1 THEN trim(parts[hit - 1], ' ' || chr(10)) ELSE '' END AS "before", trim(parts[hit], ' ' || chr(10)) AS "current",
  coalesce(trim(parts[hit + 1], ' ' || chr(10)), '') AS "after" FROM h""")
def sentence_context(spark: SparkSession, d: str) -> DataFrame:
    """The sentence with the value and its neighbours, for whole items and for each of their sentences."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    parts = F.concat(F.array("text"), F.split("text", r"(?<=[.!?])\s+"))
    pieces = table(spark, d, "benchmark").select("item_id", F.posexplode(parts).alias("part", "value"))
    found = first_spans(docs, pieces.select(F.col("value").alias("value_id"), "value").distinct())
    rows = found.select("id", "value", X.sentence_context(F.col("text"), F.col("start"), F.col("size")).alias("c")).join(pieces, "value")
    return rows.select(F.col("id").alias("doc_id"), "item_id", "part", "c.before", "c.current", "c.after")


SHINGLES = """words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words WHERE len(w) > 0),
classes AS (SELECT list_sort(s) AS key, min(doc_id) AS id_a FROM sets GROUP BY 1),
grams AS (SELECT id_a AS id, len(key) AS n, unnest(key) AS g FROM classes),
hits AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, round(c / (n + m - c), 6) AS jaccard FROM hits WHERE 100 * c >= 75 * (n + m - c)
  UNION ALL SELECT id_a, doc_id, 1.0 FROM sets JOIN classes ON list_sort(s) = key WHERE doc_id > id_a)"""


# As SHINGLES, but a class is of equal texts, so that different texts with equal sets have all their pairs.
TEXT_PAIRS = """words AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
classes AS (SELECT text, any_value(w) AS w, min(doc_id) AS id_a FROM words WHERE len(w) > 0 GROUP BY text),
sets AS (SELECT id_a AS id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM classes),
grams AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
hits AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, round(c / (n + m - c), 6) AS jaccard FROM hits WHERE 100 * c >= 75 * (n + m - c)
  UNION ALL SELECT id_a, doc_id, 1.0 FROM documents JOIN classes USING (text) WHERE doc_id > id_a)"""


def exact_pairs(spark: SparkSession, d: str, of_sets: bool = False) -> DataFrame:
    return M.similar_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 75, of_sets).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {TEXT_PAIRS} SELECT * FROM pairs")
def shingle_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return exact_pairs(spark, d)


@query(f"""WITH {SHINGLES}, ends AS (SELECT id, max(jaccard) AS best FROM (SELECT id_a AS id, jaccard FROM pairs UNION ALL SELECT id_b, jaccard FROM pairs) GROUP BY id),
t AS (SELECT unnest([0.75::DOUBLE, 0.85::DOUBLE, 0.9::DOUBLE]) AS threshold)
SELECT threshold, (SELECT count(*) FROM ends WHERE best >= threshold) AS clustered, (SELECT count(*) FROM documents) AS total,
  round((SELECT count(*) FROM ends WHERE best >= threshold) / (SELECT count(*) FROM documents), 6) AS rate FROM t""")
def near_dup_cluster_rate(spark: SparkSession, d: str) -> DataFrame:
    return M.cluster_rates(table(spark, d, "documents"), exact_pairs(spark, d, of_sets=True), "jaccard")


@query()
def minhash_lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of whole texts by MinHash bands, confirmed on their full sets. No SQL: the hash family is Spark's."""
    return M.text_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT lang, len(words) AS n, """ + ", ".join(f"len(list_filter(words, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS {k}_n" for k, ws in X.STOP_WORDS.items()) + """ FROM w WHERE len(words) >= 6),
g AS (SELECT lang, n, CASE WHEN greatest(en_n, de_n, fr_n, es_n) = 0 THEN NULL WHEN en_n >= greatest(de_n, fr_n, es_n) THEN 'en' WHEN de_n >= greatest(fr_n, es_n) THEN 'de' WHEN fr_n >= es_n THEN 'fr' ELSE 'es' END AS guess FROM s)
SELECT lang, count(*) AS checked, CAST(sum(n) AS BIGINT) AS assessed, CAST(coalesce(sum(n) FILTER (guess <> lang), 0) AS BIGINT) AS unexpected,
  round(1 - coalesce(sum(n) FILTER (guess <> lang), 0) / sum(n), 6) AS purity FROM g WHERE guess IS NOT NULL GROUP BY lang""")
def language_purity(spark: SparkSession, d: str) -> DataFrame:
    """Words in documents whose stop words point to another language than the one stated."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    rows = table(spark, d, "documents").select("lang", words.alias("w")).where(F.size("w") >= 6)
    among = lambda known: F.size(F.filter("w", lambda x: x.isin(known)))
    hits = F.array(*[F.struct(among(known).alias("n"), F.lit(-i).alias("early"), F.lit(lang).alias("lang")) for i, (lang, known) in enumerate(X.STOP_WORDS.items())])
    guessed = rows.select("lang", F.size("w").cast("long").alias("n"), F.array_max(hits).alias("best")).where("best.n > 0")
    odd = F.when(F.col("best.lang") != F.col("lang"), F.col("n")).otherwise(0)
    out = guessed.groupBy("lang").agg(F.count("*").alias("checked"), F.sum("n").alias("assessed"), F.sum(odd).alias("unexpected"))
    return out.withColumn("purity", F.round(1 - F.col("unexpected") / F.col("assessed"), 6))


@query()
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language that each text is in, by what the other four fifths of the texts state. No SQL: a fitted model."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    model = L.fit(docs.where("not held_out").select("text", F.col("lang").alias("language")))
    return L.detected(docs, model).select("doc_id", "lang", "held_out", "detected")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '(-[0-9a-f]{1,16})+$', '') AS plain FROM pages""")
def scenario_slug(spark: SparkSession, d: str) -> DataFrame:
    name = X.slug(F.regexp_replace("url", "^https?://", ""))
    return table(spark, d, "pages").select("page_id", name.alias("slug"), X.without_hashes(name).alias("plain"))


@query(r"""SELECT page_id, nullif(regexp_extract('/data/Version_20240101_' || lpad(CAST(page_id AS VARCHAR), 4, '0') || '/x/' || url, 'Version_\d{8}_\d{4}'), '') AS stamp,
  regexp_extract(url, '[^/]*$') AS base FROM pages""")
def version_stamp(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/Version_20240101_"), F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit("/x/"), F.col("url"))
    return table(spark, d, "pages").select("page_id", X.version_stamp(path).alias("stamp"), X.base_name(F.col("url")).alias("base"))


TOKENS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"""WITH a AS (SELECT DISTINCT p_name, {TOKENS.format('p_name')} AS l FROM part), b AS (SELECT DISTINCT p_type, {TOKENS.format('p_type')} AS r FROM part),
s AS (SELECT p_name, p_type, len(list_intersect(l, r)) / len(r) AS score FROM a, b WHERE len(list_intersect(l, r)) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_type) AS i FROM s WHERE score >= 0.3)
SELECT p_name, p_type, round(score, 6) AS score FROM k WHERE i = 1""")
def best_name_match(spark: SparkSession, d: str) -> DataFrame:
    """For each part name the type with the largest share of its words in the name."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))
    parts = table(spark, d, "part")
    names = parts.select("p_name").distinct().withColumn("l_tokens", tokens("p_name"))
    types = parts.select("p_type").distinct().withColumn("r_tokens", tokens("p_type"))
    score = F.size(F.array_intersect("l_tokens", "r_tokens")) / F.size("r_tokens")
    return J.best_match(names, types, "p_name", "p_type", score, 0.3).withColumn("score", F.round("score", 6))


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""WITH placed AS (SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
names AS (SELECT DISTINCT n_name || ' ' || r_name || ' ' || c_mktsegment || ' Number' AS name FROM placed),
others AS (SELECT DISTINCT r_name || '_' || o_orderpriority || '_' || c_mktsegment || ' v1 Data' AS other FROM orders JOIN placed ON o_custkey = c_custkey),
words AS (SELECT name, list_filter(regexp_split_to_array(lower(replace(name, '.', '')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN {_listed(N.STOP_WORDS)}) AS w FROM (SELECT name FROM names UNION SELECT other FROM others)),
plain AS (SELECT name, w, list_filter(w, lambda x: x NOT IN {_listed(N.QUALIFIERS)}) AS p FROM words),
tokens AS (SELECT name, list_distinct(w || CASE WHEN len(p) BETWEEN 2 AND 6 THEN [array_to_string(list_transform(p, lambda x: x[1]), '')] ELSE [] END) AS t FROM plain),
marked AS (SELECT name, t, list_min(list_filter(t, lambda x: x IN {_listed(N.QUALIFIERS)})) AS mark FROM tokens),
pairs AS (SELECT a.name, b.name AS other, a.mark AS m, b.mark AS n, list_intersect(a.t, b.t) AS met, least(len(a.t), len(b.t)) AS smaller
  FROM names JOIN marked a USING (name), others JOIN marked b ON others.other = b.name),
scored AS (SELECT name, other, CASE WHEN len(list_filter(met, lambda x: x NOT IN {_listed(N.GENERIC + N.QUALIFIERS)})) = 0 OR coalesce(m <> n, false) THEN 0
  WHEN smaller > 2 THEN len(met)::DOUBLE / smaller WHEN len(met) = smaller THEN 1 ELSE 0 END AS score FROM pairs)
SELECT name, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS i FROM scored WHERE score >= 0.5) WHERE i = 1""")
def reference_match(spark: SparkSession, d: str) -> DataFrame:
    """For each nation, region and segment the best matching name of region, priority and segment; names of two qualifiers never match."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nations = table(spark, d, "nation").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    customers = table(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "n_name", "r_name", "c_mktsegment")
    names = customers.select("n_name", "r_name", "c_mktsegment").distinct().select(F.concat_ws(" ", "n_name", "r_name", "c_mktsegment", F.lit("Number")).alias("name"))
    ordered = table(spark, d, "orders").select("o_custkey", "o_orderpriority").join(customers, "o_custkey")
    others = ordered.select("r_name", "o_orderpriority", "c_mktsegment").distinct().select(F.concat(F.concat_ws("_", "r_name", "o_orderpriority", "c_mktsegment"), F.lit(" v1 Data")).alias("other"))
    left, right = names.withColumn("l_tokens", N.tokens(F.col("name"))), others.withColumn("r_tokens", N.tokens(F.col("other")))
    met = J.best_match(left, right, "name", "other", N.match_score(F.col("l_tokens"), F.col("r_tokens")), 0.5, N.specific)
    return met.withColumn("score", F.round("score", 6))


@query(f"""WITH l(code, said) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in N.LANGUAGES.items())})
SELECT lang, coalesce(said, trim(lang)) AS name, CASE WHEN said IS NULL THEN upper(trim(lang)) ELSE upper(trim(lang)) || ' - ' || said END AS shown, count(*) AS n
FROM documents LEFT JOIN l ON code = lower(trim(lang)) GROUP BY ALL""")
def language_names(spark: SparkSession, d: str) -> DataFrame:
    tally = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return tally.select("lang", N.language_name(F.col("lang")).alias("name"), N.shown_language(F.col("lang")).alias("shown"), "n")


@query("""WITH p AS (SELECT unnest(['role', 'turn', 'absent']) AS field, unnest([role, turn::VARCHAR, NULL]) AS value FROM conversations)
SELECT field, lower(trim(value)) AS value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY ALL""")
def field_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Values of fields of JSON lines, made of the turns."""
    lines = table(spark, d, "conversations").select(F.parse_json(F.to_json(F.struct("role", "turn"))).alias("v"), F.lit(False).alias("bad"))
    return A.field_distribution(lines, ["role", "turn", "absent"])


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1""")
def last_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return J.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


SAMPLE = 150


@query(f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS total FROM documents)
SELECT doc_id FROM n WHERE i IN (SELECT CAST(floor(k * (total / {SAMPLE}.0::DOUBLE)) AS BIGINT) FROM range({SAMPLE}) t(k), (SELECT count(*) AS total FROM documents))""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.even_sample(table(spark, d, "documents").select("doc_id"), ["doc_id"], SAMPLE)


@query(f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT {SAMPLE}""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], SAMPLE)


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """The places that a seeded generator draws. No SQL: the generator is Python's."""
    return S.seeded_sample(table(spark, d, "documents").select("doc_id"), ["doc_id"], SAMPLE)


def findings(spark: SparkSession, d: str) -> DataFrame:
    """(rule, category, total, bad, bad_status, examples): a rule catalogue over documents, labels and conversations.

    Each table is read once: its rules are conditional aggregates of one pass.
    """

    def rules(df: DataFrame, key: str, category: str, tests: dict) -> DataFrame:
        aggs = [F.count("*").alias("total")]
        for i, (bad, _) in enumerate(tests.values()):
            aggs += [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"n{i}"), F.min(F.when(bad, F.col(key))).alias(f"x{i}")]
        rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(status).alias("bad_status"), F.col(f"n{i}").alias("bad"), F.col(f"x{i}").alias("example")) for i, (name, (_, status)) in enumerate(tests.items())])
        return df.agg(*aggs).select("total", F.inline(rows)).withColumn("category", F.lit(category))

    docs = labelled(spark, d)
    lengths = table(spark, d, "documents").select("doc_id", F.length("text").alias("size"), "n_chars", (F.instr("text", "@") > 0).alias("address"), F.col("text").rlike(r"\d{3}-\d{2}-\d{4}").alias("secret"))
    return (
        rules(docs, "doc_id", "1. Documents", {"language is known": (F.col("lang").isNull() | (F.col("lang") == ""), "FAIL"), "source is known": (F.col("source").isNull(), "FAIL"), "quality is labelled": (F.col("quality").isNull(), "WARN"), "no toxic text": (F.col("toxic") == 1, "WARN")})
        .unionByName(rules(lengths, "doc_id", "2. Texts", {"length is right": (F.col("size") != F.col("n_chars"), "FAIL"), "text is not empty": (F.coalesce(F.col("size"), F.lit(0)) == 0, "FAIL"), "no addresses": (F.col("address"), "WARN"), "no secrets": (F.col("secret"), "FAIL")}))
        .unionByName(rules(table(spark, d, "conversations"), "conv_id", "3. Conversations", {"role is known": (~F.col("role").isin("user", "assistant", "system"), "FAIL"), "turn has text": (F.coalesce(F.length("text"), F.lit(0)) == 0, "WARN")}))
    )


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("bad") > 0, F.col("bad_status")).otherwise("PASS")
    return findings(spark, d).select("rule", "category", "total", "bad", "example", status.alias("status"))


def _rule(category: str, source: str, key: str, name: str, bad: str, status: str) -> str:
    return f"SELECT '{name}' AS rule, '{category}' AS category, count(*) AS total, count(*) FILTER ({bad}) AS bad, min({key}) FILTER ({bad}) AS example, CASE WHEN count(*) FILTER ({bad}) > 0 THEN '{status}' ELSE 'PASS' END AS status FROM {source}"


FINDINGS = f"WITH {LABELLED} " + " UNION ALL ".join(
    [_rule("1. Documents", "labelled", "doc_id", *x) for x in (("language is known", "lang IS NULL OR lang = ''", "FAIL"), ("source is known", "source IS NULL", "FAIL"), ("quality is labelled", "quality IS NULL", "WARN"), ("no toxic text", "toxic = 1", "WARN"))]
    + [_rule("2. Texts", "documents", "doc_id", *x) for x in (("length is right", "length(text) <> n_chars", "FAIL"), ("text is not empty", "coalesce(length(text), 0) = 0", "FAIL"), ("no addresses", "contains(text, '@')", "WARN"), ("no secrets", r"regexp_matches(text, '\d{3}-\d{2}-\d{4}')", "FAIL"))]
    + [_rule("3. Conversations", "conversations", "conv_id", *x) for x in (("role is known", "role NOT IN ('user', 'assistant', 'system')", "FAIL"), ("turn has text", "coalesce(length(text), 0) = 0", "WARN"))]
)


@query(FINDINGS)
def audit_rules(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d)


@query(f"""SELECT category, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'PASS') AS pass,
  CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS worst FROM ({FINDINGS}) GROUP BY category""")
def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("status")
    worst = F.when(F.bool_or(status == "FAIL"), "FAIL").when(F.bool_or(status == "WARN"), "WARN").otherwise("PASS")
    return verdicts(spark, d).groupBy("category").agg(*[F.count_if(status == s).alias(s.lower()) for s in ("FAIL", "WARN", "PASS")], worst.alias("worst"))


@query("""WITH b AS (SELECT doc_id, unnest(['no quality label', 'long text', 'toxic']) AS rule, unnest([quality IS NULL, n_chars > 5000, toxic = 1]) AS bad FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT rule, doc_id, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS i FROM b WHERE bad)
SELECT rule, count(*) AS n, list(doc_id ORDER BY doc_id) FILTER (i <= 3) AS examples FROM n GROUP BY rule""")
def topk_examples(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts and the first three ids for each rule that is broken."""
    tests = {"no quality label": F.col("quality").isNull(), "long text": F.col("n_chars") > 5000, "toxic": F.col("toxic") == 1}
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]), lambda x: x.isNotNull())
    rows = labelled(spark, d).select("doc_id", F.explode(broken).alias("rule"))
    return A.top_examples(rows, ["rule"], ["doc_id"], "doc_id", 3)
