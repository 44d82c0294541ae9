"""Queries of the span algebra, ordered operators, tree paths and pair rules, over rows of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspark.functions import spans, text, units
from quantspark.operators import filters, sequence
from quantspark.operators.matching import unit_choice
from quantspark.operators.paths import nearest_candidates
from quantspark.plans.registry import query, table
from quantspark.session import ship

_INT = "array<struct<start:int,end:int>>"
#: Each line of an order as a span: it starts at its quantity and is three times its number long.
_LINES = "(SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS tag, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + 3 * l_linenumber AS b FROM lineitem)"


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("tag"), a.alias("start"), (a + 3 * F.col("l_linenumber")).cast("int").alias("end"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, spans) of each order, in the order of line numbers."""
    listed = line_spans(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "start", "end"))).alias("x"))
    return listed.select("k", F.transform("x", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def shown(column) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")


@query(f"SELECT k, min(a) AS low, max(b) AS high, count(*)::INTEGER AS n, string_agg((a + 7) || '-' || (b + 7), ' ' ORDER BY n, a) AS moved, string_agg(a || '-' || b, ' ' ORDER BY b DESC, a DESC) AS edited FROM {_LINES} GROUP BY k")
def span_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_spans(spark, sf_dir).withColumn("e", spans.envelope(F.col("spans")))
    tags = F.create_map(F.lit("value"), F.col("spans"), F.lit("unit"), F.array().cast(_INT))
    return rows.select("k", F.col("e.start").alias("low"), F.col("e.end").alias("high"), spans.count_spans(tags).alias("n"), shown(spans.shift(F.col("spans"), 7)).alias("moved"), shown(spans.right_to_left(F.col("spans"))).alias("edited"))


@query(f"WITH m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {_LINES}), i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT k, island, min(a) AS a, max(b) AS b FROM i GROUP BY k, island) SELECT k, string_agg(a || '-' || b, ' ' ORDER BY a) AS merged FROM g GROUP BY k")
def merged_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_spans(spark, sf_dir).select("k", shown(spans.merge_spans(F.col("spans"))).alias("merged"))


@query(f"WITH m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k, tag ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {_LINES}), i AS (SELECT *, sum(new) OVER (PARTITION BY k, tag ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT k, tag, min(a) AS start, max(b) AS \"end\" FROM i GROUP BY k, tag, island")
def merged_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that touch are one only where their tags are equal."""
    return spans.merge_span_rows(line_spans(spark, sf_dir).select("k", "tag", "start", "end"), ["k", "tag"])


@query(f"SELECT k, n, a AS start, lag(b) OVER (PARTITION BY k ORDER BY a, b, n) AS last_end, lead(a) OVER (PARTITION BY k ORDER BY a, b, n) AS next_start FROM {_LINES}")
def growth_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each span may grow on either side; of equal spans the lower line comes first."""
    return sequence.with_bounds(line_spans(spark, sf_dir), ["k"], ("n",)).select("k", "n", "start", "last_end", "next_start")


#: Spans of an order's returned lines against those of its other lines.
_SIDES = f"(SELECT k, n, a, b, tag = 'R' AS own FROM {_LINES})"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_spans(spark, sf_dir).withColumn("own", F.col("tag") == "R")
    pick = lambda own: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("own") == own, F.struct("n", "start", "end"))), lambda s: s.isNotNull())), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return rows.groupBy("k").agg(pick(True).alias("own"), pick(False).alias("others"))


@query(f"SELECT k, string_agg(a || '-' || b, ' ' ORDER BY n, a) AS kept FROM {_SIDES} x WHERE own AND NOT EXISTS (SELECT 1 FROM {_SIDES} y WHERE y.k = x.k AND NOT y.own AND y.a < x.b AND x.a < y.b) GROUP BY k")
def overlap_antijoin_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sides(spark, sf_dir).withColumn("kept", spans.without_overlaps(F.col("own"), F.col("others")))
    return kept.where(F.size("kept") > 0).select("k", shown("kept").alias("kept"))


@query(f"SELECT k, string_agg(a || '-' || b, ' ' ORDER BY n, a) AS kept FROM {_SIDES} x WHERE own AND EXISTS (SELECT 1 FROM {_SIDES} y WHERE y.k = x.k AND NOT y.own AND y.a < x.b AND x.a < y.b) GROUP BY k")
def touching_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sides(spark, sf_dir).withColumn("kept", F.filter("own", lambda s: spans.touches_any(s, F.col("others"))))
    return found.where(F.size("kept") > 0).select("k", shown("kept").alias("kept"))


@query(f"SELECT x.k, string_agg(x.a || '-' || x.b, ' ' ORDER BY x.n, x.a) AS kept FROM {_SIDES} x JOIN (SELECT k, min(a) AS a, max(b) AS b FROM {_SIDES} WHERE NOT own GROUP BY k) e ON x.k = e.k WHERE own AND x.a >= e.a AND x.b <= e.b GROUP BY x.k")
def contained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(spark, sf_dir).where(F.size("others") > 0)
    found = rows.withColumn("kept", spans.inside(F.col("own"), spans.envelope(F.col("others"))))
    return found.where(F.size("kept") > 0).select("k", shown("kept").alias("kept"))


#: Against one span: what lies inside is dropped, what is partly covered is cut to the longer free side.
@query(f"WITH o AS (SELECT k, min(struct_pack(n := n, a := a, b := b)) AS o FROM {_SIDES} WHERE NOT own GROUP BY k), c AS (SELECT x.k, n, x.a, x.b, o.a AS oa, o.b AS ob FROM (SELECT * FROM {_SIDES} WHERE own) x JOIN (SELECT k, o.a AS a, o.b AS b FROM o) o ON x.k = o.k), d AS (SELECT k, n, a AS orig, CASE WHEN NOT (a < ob AND oa < b) THEN a WHEN oa - a >= b - ob THEN a ELSE ob END AS a, CASE WHEN NOT (a < ob AND oa < b) THEN b WHEN oa - a >= b - ob THEN oa ELSE b END AS b FROM c WHERE NOT (a < ob AND oa < b AND oa - a <= 0 AND b - ob <= 0)) SELECT k, string_agg(a || '-' || b, ' ' ORDER BY n, orig) AS clipped FROM d GROUP BY k")
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(spark, sf_dir).where(F.size("others") > 0)
    found = rows.withColumn("clipped", spans.clip(F.col("own"), F.slice("others", 1, 1)))
    return found.where(F.size("clipped") > 0).select("k", shown("clipped").alias("clipped"))


@query(f"WITH v AS (SELECT k, min(struct_pack(n := n, a := a, b := b)) AS v FROM {_SIDES} WHERE NOT own GROUP BY k), d AS (SELECT x.k, x.a, x.b, greatest(x.a - v.v.b, v.v.a - x.b) AS gap FROM {_SIDES} x JOIN v ON x.k = v.k WHERE own), m AS (SELECT *, min(gap) OVER (PARTITION BY k) AS least, count(*) OVER (PARTITION BY k) AS n FROM d) SELECT k, least AS gap, CASE WHEN n = 1 OR (count(*) = 1 AND least < 2) THEN min(a) END AS start FROM m WHERE gap = least GROUP BY k, least, n")
def nearest_units_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distance of units (returned lines) to a value (the first other line), and the one that is chosen, if any."""
    rows = sides(spark, sf_dir).where((F.size("own") > 0) & (F.size("others") > 0)).withColumn("value", F.get("others", F.lit(0)))
    gap = F.array_min(F.transform("own", lambda s: spans.distance(s, F.col("value"))))
    return rows.select("k", gap.alias("gap"), unit_choice(F.col("own"), F.col("value"))["start"].alias("start"))


@query(f"SELECT k, n, a AS first_token, coalesce(sum(n) OVER (PARTITION BY k ORDER BY n, a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start, sum(n) OVER (PARTITION BY k ORDER BY n, a ROWS UNBOUNDED PRECEDING)::INTEGER AS \"end\" FROM {_LINES}")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as long as their line number: the characters that a token takes follow from those before it."""
    by = Window.partitionBy("k").orderBy("n", "first_token")
    rows = sequence.running_offset(line_spans(spark, sf_dir).drop("end").withColumnRenamed("start", "first_token"), ["k"], ["n", "first_token"], F.col("n"), "start")
    rows = rows.withColumn("tokens", F.collect_list(F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n")).cast("int").alias("end"))).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = F.row_number().over(by) - 1
    rows = rows.withColumn("at", at).withColumn("s", spans.token_to_char(F.col("tokens"), F.col("at"), F.col("at")))
    return rows.select("k", "n", "first_token", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query("SELECT doc_id, len(string_split(text, ', '))::INTEGER AS n_segments, (length(text) - length(list_extract(string_split(text, ', '), -1)))::INTEGER AS last_start FROM documents WHERE text IS NOT NULL")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", F.explode(F.array(sequence.segments(F.col("text"), ", "))).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_segments"), F.element_at("s", -1)["start"].alias("last_start"))


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS opens, coalesce(length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), 0)::INTEGER AS n_before FROM conversations")
def previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sequence.with_previous(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    return turns.select("conv_id", "turn", F.col("previous").isNull().alias("opens"), F.coalesce(F.length("previous"), F.lit(0)).alias("n_before"))


@query("SELECT s.doc_id, (SELECT string_agg(v, ' ' ORDER BY v DESC) FROM (SELECT unnest([s.n_chars % 7, s.doc_id % 5]) AS v)) AS flat, length(s.text)::INTEGER AS blank FROM documents s WHERE text IS NOT NULL")
def blanked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text blanked out from end to end keeps its length; nested arrays become one."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    nested = F.flatten(F.array(F.array(F.col("n_chars") % 7), F.array(F.col("doc_id") % 5)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    blank = spans.blank_out(F.col("text"), whole)
    return docs.select("doc_id", F.array_join(F.reverse(F.array_sort(nested)), " ").alias("flat"), F.when(blank.rlike("^ *$"), F.length(blank)).alias("blank"))


# A chain of tokens, each the head of the one before: the path between two is their difference.
@query(f"WITH c AS (SELECT k, a % 12 AS pos, row_number() OVER (PARTITION BY k ORDER BY n, a) - 2 AS i FROM {_LINES}), e AS (SELECT c.k, c.i, abs(c.pos - t.pos) AS gap FROM c JOIN c t ON c.k = t.k AND t.i = -1 WHERE c.i >= 0) SELECT k, string_agg(i::VARCHAR, ',' ORDER BY i) AS found FROM e WHERE gap = (SELECT min(gap) FROM e f WHERE f.k = e.k) GROUP BY k")
def shortest_chain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines the nearest to the first, on a chain of twelve tokens; ties are all listed."""
    ship(spark)
    rows = order_spans(spark, sf_dir).where(F.size("spans") > 1)
    places = F.transform("spans", lambda s: s["start"] % 12)
    heads = F.array(*[F.lit(min(k + 1, 11)) for k in range(12)])
    rows = rows.select("k", heads.alias("heads"), F.transform(F.slice(places, 2, 100), lambda p: F.array(p)).alias("candidates"), F.slice(places, 1, 1).alias("target"))
    return rows.select("k", F.array_join(nearest_candidates("heads", "candidates", "target"), ",").alias("found"))


# Two examples at a time, of an order's lines: entity, property (or none), value and unit follow from their columns.
_PAIRED = "(SELECT l_orderkey AS k, (nth - 1) // 2 AS g, (nth - 1) % 2 AS i, l_suppkey % 2 AS e, l_partkey % 3 AS p, CAST(l_quantity AS INTEGER) % 2 AS v, CASE WHEN l_tax > 0.02 THEN 0 ELSE 1 END AS u, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem))"


@query(f"""WITH x AS (SELECT a.k, a.g, a.e = b.e AS e, a.p = b.p AS p, a.v = b.v AS v, a.u = b.u AS u, a.q = b.q AS q, a.p = 0 AS none_a, b.p = 0 AS none_b, a.q AS qa, b.q AS qb
  FROM {_PAIRED} a JOIN {_PAIRED} b ON a.k = b.k AND a.g = b.g AND a.i = 0 AND b.i = 1), r AS (
  SELECT k, g, CASE WHEN e AND p AND v AND u AND q THEN 'same_example_already_exists' WHEN e AND p AND v AND u THEN 'same_example_with_more_qualifiers_already_exists'
    WHEN e AND NOT p AND v AND u AND (none_a OR none_b) THEN 'same_example_with_property_match_exists' WHEN e AND NOT p AND v AND u THEN 'same_example_with_different_property_exists'
    WHEN v AND (NOT e OR NOT u) THEN 'same_example_with_different_entity_or_unit_exists' WHEN e AND p AND NOT v AND u AND q THEN 'same_example_with_different_value_exists' END AS reason,
    CASE WHEN e AND p AND v AND u AND q THEN 1 WHEN e AND p AND v AND u THEN CASE WHEN qa < qb THEN 0 ELSE 1 END WHEN e AND NOT p AND v AND u AND none_a THEN 0 WHEN e AND NOT p AND v AND u AND none_b THEN 1 ELSE 2 END AS who FROM x)
SELECT p.k, p.g, p.i, CASE WHEN who = 2 OR who = p.i THEN reason END AS reason FROM {_PAIRED} p LEFT JOIN r ON p.k = r.k AND p.g = r.g""")
def reconciled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    at = lambda c: F.when(c < 0, F.array().cast(_INT)).otherwise(F.array(F.struct(c.cast("int").alias("start"), (c + 1).cast("int").alias("end"))))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    tags = F.create_map(
        F.lit("entity"), at(F.col("l_suppkey") % 2), F.lit("property"), at(F.col("l_partkey") % 3 - 1), F.lit("value"), at(F.col("l_quantity").cast("int") % 2),
        F.lit("unit"), at(F.when(F.col("l_tax") > 0.02, 0).otherwise(1)), F.lit("location"), at(F.when(F.col("l_discount") > 0.05, 5).otherwise(-1)),
    )
    rows = line.select(F.col("l_orderkey").alias("k"), F.floor(n / 2).alias("g"), (n % 2).alias("i"), tags.alias("annotations"))
    return filters.reconciled(rows, ["k", "g"], ["i"]).select("k", "g", "i", F.col("reconcile_reason").alias("reason"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 AND l_quantity < 10 AND l_tax <= 0.05 THEN 'small_int_count_without_qualifiers' END AS reason, l_quantity < 10 AS small FROM lineitem")
def small_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    reason = filters.small_count_without_qualifier(F.col("l_quantity"), F.col("l_linenumber") < 3, F.when(F.col("l_tax") > 0.05, 1).otherwise(0))
    return line.select("l_orderkey", "l_linenumber", reason.alias("reason"), units.is_small_int(F.col("l_quantity")).alias("small"))


@query("WITH w AS (SELECT p_partkey, unnest([p_name, lower(p_type), p_name || 's', p_name || 'y', lower(p_type) || 'x', p_brand || 'sy', 'y', 's', 'x']) AS word FROM part) SELECT p_partkey, word, CASE right(word, 1) WHEN 's' THEN word WHEN 'y' THEN left(word, length(word) - 1) || 'ies' WHEN 'x' THEN word || 'es' ELSE word || 's' END AS many FROM w")
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types, and words made of them that end in s, y and x."""
    kind, end = F.lower("p_type"), lambda c, e: F.concat(c, F.lit(e))
    words = F.array(F.col("p_name"), kind, end(F.col("p_name"), "s"), end(F.col("p_name"), "y"), end(kind, "x"), end(F.col("p_brand"), "sy"), F.lit("y"), F.lit("s"), F.lit("x"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(words).alias("word"))
    return rows.select("p_partkey", "word", text.plural(F.col("word")).alias("many"))
