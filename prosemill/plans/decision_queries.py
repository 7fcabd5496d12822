"""Proposals, labelled items, metrics and vectors over the driver's tables.

The tables hold invented words, so the substitution rules are a fixed list of frequent forms;
scores are a hash of (id, candidate) that every engine can compute.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.plans.corpus_queries import PHRASES, fixed_phrase_table
from prosemill.plans.registry import SQL, query, table
from prosemill.operators import order
from prosemill.operators.scratch import written
from prosemill.plans.text_queries import RATES, W, case_table, docs, pieces_sql, rates, spread

# trigger, replacement, part of speech, block words, require words
RULES = [
    ("the", "thinre", "ADJ", ["erenst"], []),
    ("of the", "oferwhennt", "NOUN", [], []),
    ("of", "ofre", "VERB", ["ing"], []),
    ("and", "andonre", "ADJ", [], ["the"]),
    ("in", "inonly", "ADV", ["is it"], []),
    ("tion", "tionont", "NOUN", [], ["er", "of the"]),
    ("with", "whshing", "VERB", ["a"], []),
]
DEFERRED = ["andonre"]
_ALTERNATION = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted((r[0] for r in RULES), key=len, reverse=True))
SPANS = rf"""
raw_spans AS (SELECT doc_id, {pieces_sql('text', _ALTERNATION)} AS ps FROM documents),
spans AS (SELECT doc_id, i // 2 - 1 AS n, ps[i] AS surface, lower(ps[i]) AS trigger, list_sum(list_transform(ps[1:i - 1], lambda x: length(x))) AS start FROM (SELECT doc_id, ps, unnest(range(2, len(ps) + 1, 2)) AS i FROM raw_spans))"""
_list = lambda x: "[" + ", ".join(f"'{y}'" for y in x) + "]::VARCHAR[]"
RULES_SQL = "rules(trigger, replacement, pos, block, require) AS (VALUES " + ", ".join(f"('{t}', '{r}', '{p}', {_list(b)}, {_list(q)})" for t, r, p, b, q in RULES) + ")"


def rules(s) -> DataFrame:
    return s.createDataFrame(RULES, "trigger string, replacement string, pos string, block array<string>, require array<string>")


def pieces(c: Column, triggers: list[str]) -> Column:
    """A text cut at the whole-word matches of the triggers, the longest first, not overlapping: what is between them and they themselves in turn. One pass of one pattern; the triggers are a small list."""
    alternation = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(triggers, key=len, reverse=True))
    return F.split(F.regexp_replace(c, F.lit(X.whole_words(alternation)), F.lit("\u0001$1\u0001")), "\u0001")


def spans(df: DataFrame, triggers: list[str], key: str = "doc_id") -> DataFrame:
    """``key, n, start, surface, trigger`` of every match; offsets are running lengths inside a row's own pieces, without a shuffle."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, surface: string>>").alias("out"))
    found = F.aggregate(
        pieces(F.col("text"), triggers), empty,
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x.alias("surface")))).alias("out")),
        lambda acc: F.filter(acc["out"], lambda x, i: i % 2 == 1),
    )
    rows = spread(df.select(key, "text")).select(key, F.posexplode_outer(found).alias("n", "x")).filter("n is not null")
    return rows.select(key, "n", "x.start", "x.surface", F.lower("x.surface").alias("trigger"))


@query(f"WITH {SPANS} SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start, surface, trigger FROM spans")
def propose_spans(s, d):
    return spans(docs(s, d), [r[0] for r in RULES]).withColumns({c: F.col(c).cast("long") for c in ("n", "start")})


@query(f"WITH {RULES_SQL} SELECT trigger, replacement FROM rules WHERE replacement NOT IN ('{DEFERRED[0]}')")
def rule_anti_join(s, d):
    deferred = s.createDataFrame([(w,) for w in DEFERRED], "replacement string")
    return rules(s).join(F.broadcast(deferred), "replacement", "left_anti").select("trigger", "replacement")


def allowed(lowered: Column, own: Column, block: Column, require: Column) -> Column:
    """A rule's constraints in a sentence: ``lowered`` are its words between spaces, ``own`` its words without the trigger's."""
    present = lambda t: F.when(t.contains(" "), F.contains(lowered, F.concat(F.lit(" "), t, F.lit(" ")))).otherwise(F.array_contains(own, t))
    return ~F.exists(block, present) & ((F.size(require) == 0) | F.exists(require, present))


@query(
    f"""WITH {RULES_SQL}, turns AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{W}') AS w FROM conversations),
m AS (SELECT conv_id, turn, trigger, replacement, block, require, ' ' || array_to_string(w, ' ') || ' ' AS t, list_filter(w, lambda x: NOT list_contains(string_split(trigger, ' '), x)) AS own FROM turns, rules),
f AS (SELECT * FROM m WHERE contains(t, ' ' || trigger || ' '))
SELECT conv_id, turn, trigger, replacement, len(list_filter(block, lambda x: CASE WHEN contains(x, ' ') THEN contains(t, ' ' || x || ' ') ELSE list_contains(own, x) END)) = 0
  AND (len(require) = 0 OR len(list_filter(require, lambda x: CASE WHEN contains(x, ' ') THEN contains(t, ' ' || x || ' ') ELSE list_contains(own, x) END)) > 0) AS allowed FROM f"""
)
def sense_constraints(s, d):
    """Each rule whose trigger a turn holds, and whether its context allows it. The rules are an array literal beside each turn, not a cross join."""
    turns = table(s, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("w")).withColumn("t", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    table_ = F.array(*(F.struct(F.lit(t).alias("trigger"), F.lit(r).alias("replacement"), strings(b).alias("block"), strings(q).alias("require")) for t, r, _, b, q in RULES))
    m = turns.select("conv_id", "turn", "w", "t", F.explode_outer(table_).alias("r")).filter(F.contains("t", F.concat(F.lit(" "), F.col("r.trigger"), F.lit(" "))))
    own = F.array_except("w", F.split("r.trigger", " "))
    return m.select("conv_id", "turn", "r.trigger", "r.replacement", allowed(F.col("t"), own, F.col("r.block"), F.col("r.require")).alias("allowed"))


FIRSTS = [(t, t.split()[0]) for t, *_ in RULES]


@query(
    f"""WITH {PHRASES}, w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{W}') AS w FROM conversations), f(trigger, head) AS (VALUES {", ".join(f"('{t}', '{h}')" for t, h in FIRSTS)}),
p AS (SELECT conv_id, turn, trigger, w, list_position(w, head) AS i FROM w, f WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || trigger || ' '))
SELECT conv_id, turn, trigger, r.w1 IS NOT NULL OR l.w1 IS NOT NULL AS vetoed FROM p LEFT JOIN phrases r ON r.w1 = w[i] AND r.w2 = w[i + 1] LEFT JOIN phrases l ON i > 1 AND l.w1 = w[i - 1] AND l.w2 = w[i]"""
)
def phrase_veto(s, d):
    """Turns that hold a trigger, and whether the trigger's first word, at its first place, forms a fixed phrase with the word after or before it."""
    w = table(s, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("w"))
    heads = F.array(*(F.struct(F.lit(t).alias("trigger"), F.lit(h).alias("head")) for t, h in FIRSTS))
    m = w.select("conv_id", "turn", "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"), F.explode_outer(heads).alias("r"))
    m = m.filter(F.contains("t", F.concat(F.lit(" "), F.col("r.trigger"), F.lit(" ")))).withColumn("i", F.array_position("w", F.col("r.head")).cast("int") - 1)
    at = lambda j: F.get("w", F.col("i") + j)
    pairs = m.select("conv_id", "turn", "r.trigger", F.explode(F.array(F.struct(at(0).alias("w1"), at(1).alias("w2")), F.struct(F.when(F.col("i") > 0, at(-1)).alias("w1"), at(0).alias("w2")))).alias("p")).select("conv_id", "turn", "trigger", "p.*")
    known = pairs.join(fixed_phrase_table(docs(s, d)).select("w1", "w2", F.lit(True).alias("fixed")), ["w1", "w2"], "left")
    return known.groupBy("conv_id", "turn", "trigger").agg(F.coalesce(F.max("fixed"), F.lit(False)).alias("vetoed"))


@query(
    f"""WITH {RULES_SQL}, {RATES} SELECT trigger, replacement, round(a.per_million, 4) AS trigger_rate, round(b.per_million, 4) AS replacement_rate, round(log2(a.per_million / b.per_million), 6) AS gain
FROM rules JOIN r a ON a.form = trigger JOIN r b ON b.form = replacement WHERE trigger <> replacement AND a.per_million / b.per_million >= 2"""
)
def difficulty_floor(s, d):
    r = rates(docs(s, d)).select("form", "per_million")
    known = rules(s).join(r.select(F.col("form").alias("trigger"), F.col("per_million").alias("a")), "trigger").join(r.select(F.col("form").alias("replacement"), F.col("per_million").alias("b")), "replacement")
    return known.filter("trigger <> replacement AND a / b >= 2").select("trigger", "replacement", F.round("a", 4).alias("trigger_rate"), F.round("b", 4).alias("replacement_rate"), F.round(F.log2(F.col("a") / F.col("b")), 6).alias("gain"))


@query(
    rf"""WITH {RULES_SQL}, parts AS (SELECT doc_id, {pieces_sql('text', _ALTERNATION)} AS ps FROM documents),
one AS (SELECT doc_id, i, ps[i] AS x, lower(ps[i]) AS trigger FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
swapped AS (SELECT doc_id, i, CASE WHEN i % 2 = 1 THEN x WHEN x[1] <> lower(x[1]) THEN upper(replacement[1]) || replacement[2:] ELSE replacement END AS x FROM one LEFT JOIN rules ON i % 2 = 0 AND rules.trigger = one.trigger)
SELECT doc_id, string_agg(x, '' ORDER BY i) AS swapped FROM swapped GROUP BY doc_id"""
)
def apply_swaps(s, d):
    """Every span replaced, left to right, keeping a capital first letter. Pieces are put together inside the row, without a shuffle."""
    to = F.create_map(*(F.lit(x) for t, r, *_ in RULES for x in (t, r)))
    new = F.transform("ps", lambda x, i: F.when(i % 2 == 0, x).otherwise(X.match_case(x, F.element_at(to, F.lower(x)))))
    return docs(s, d).select("doc_id", pieces(F.col("text"), [r[0] for r in RULES]).alias("ps")).select("doc_id", F.array_join(new, "").alias("swapped"))


def _entry_sql(extra: str = "") -> str:
    return f"SELECT lower(trigger) AS trigger, string_agg(replacement || '/' || pos || '/' || array_to_string(block, ',') || '/' || array_to_string(require, ','), '|' ORDER BY ordinal) AS entries, count(*) AS n FROM {extra} GROUP BY 1"


def ordered_rules(s) -> DataFrame:
    """The rules with their place in the list."""
    return s.createDataFrame([(i, *r) for i, r in enumerate(ALL_RULES)], "ordinal int, trigger string, replacement string, pos string, block array<string>, require array<string>")


#: The rules and second choices for some of their triggers, one of them in capitals.
ALL_RULES = [*RULES, ("The", "erthe", "NOUN", [], ["of"]), ("with", "withal", "ADV", [], []), ("in", "in", "ADV", [], [])]
ALL_RULES_SQL = "ruled(ordinal, trigger, replacement, pos, block, require) AS (VALUES " + ", ".join(f"({i}, '{t}', '{r}', '{p}', {_list(b)}, {_list(q)})" for i, (t, r, p, b, q) in enumerate(ALL_RULES)) + ")"


def runtime_entries(rules_: DataFrame) -> DataFrame:
    """``trigger, entries, n``: the rules of a trigger, whatever its case, in the order of the list."""
    entry = F.struct("ordinal", F.concat_ws("/", "replacement", "pos", F.array_join("block", ","), F.array_join("require", ",")).alias("e"))
    grouped = rules_.groupBy(F.lower("trigger").alias("trigger")).agg(F.array_sort(F.collect_list(entry)).alias("es"))  # a rule list is short
    return grouped.select("trigger", F.array_join(F.transform("es", lambda x: x["e"]), "|").alias("entries"), F.size("es").cast("long").alias("n"))


@query(f"WITH {ALL_RULES_SQL} {_entry_sql('ruled')}")
def runtime_table(s, d):
    return runtime_entries(ordered_rules(s))


@query(
    f"""WITH {ALL_RULES_SQL}, {RATES}, easy AS (SELECT * FROM ruled LEFT JOIN (SELECT form, per_million AS a FROM r) x ON x.form = lower(trigger) LEFT JOIN (SELECT form, per_million AS b FROM r) y ON y.form = lower(replacement)),
kept AS (SELECT * FROM easy WHERE lower(trigger) <> lower(replacement) AND b > 0 AND a / b >= 2), e AS ({_entry_sql('kept')})
SELECT e.trigger, entries, n, (SELECT count(*) FROM kept) AS rules_kept, (SELECT count(*) FROM ruled) - (SELECT count(*) FROM kept) AS rules_dropped FROM e"""
)
def runtime_export(s, d):
    """The runtime table of the rules that make a text harder by a factor of two, and how many rules that leaves and drops."""
    r = rates(docs(s, d)).select("form", "per_million")
    side = lambda of, out: r.select(F.col("form").alias(f"{out}_form"), F.col("per_million").alias(out))
    every = ordered_rules(s)
    j = every.join(side("t", "a"), F.lower("trigger") == F.col("a_form"), "left").join(side("r", "b"), F.lower("replacement") == F.col("b_form"), "left")
    kept = j.filter((F.lower("trigger") != F.lower("replacement")) & (F.col("b") > 0) & (F.col("a") / F.col("b") >= 2)).select(every.columns)
    n = kept.agg(F.count("*").alias("rules_kept"), (F.lit(len(ALL_RULES)) - F.count("*")).alias("rules_dropped"))
    return runtime_entries(kept).join(F.broadcast(n))  # one row


# Scored candidates: five for each labelled document, of which 0 is the original.

SCORED = """cand AS (SELECT doc_id, quality, c, ('0x' || substr(md5(doc_id || ':' || c), 1, 8))::BIGINT % 1000000 / 1e6 AS score FROM labels, (SELECT unnest(range(0, 5)) AS c)),
graded AS (SELECT *, CASE WHEN quality = 1 THEN ('0x' || substr(md5('g' || doc_id || ':' || c), 1, 4))::BIGINT % 5 ELSE ('0x' || substr(md5('g' || doc_id || ':' || c), 1, 4))::BIGINT % 3 END AS grade FROM cand),
g AS (SELECT *, [0.05, 0.2, 0.5, 0.8, 0.95][grade + 1]::DOUBLE AS target FROM graded)"""


def scored(s, d) -> DataFrame:
    hashed = lambda p, n: F.conv(F.substring(F.md5(F.concat(F.lit(p), F.col("doc_id").cast("string"), F.lit(":"), F.col("c").cast("string")).cast("binary")), 1, n), 16, 10).cast("long")
    c = table(s, d, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("c"))
    c = c.withColumn("score", (hashed("", 8) % 1000000) / 1e6).withColumn("grade", F.when(F.col("quality") == 1, hashed("g", 4) % 5).otherwise(hashed("g", 4) % 3))
    return c.withColumn("target", F.element_at(F.array(*(F.lit(x) for x in (0.05, 0.2, 0.5, 0.8, 0.95))), (F.col("grade") + 1).cast("int")))


@query(f"WITH {SCORED} SELECT doc_id, round(1 - coalesce(max(target) FILTER (WHERE c > 0), 0), 3) AS identity_target FROM g GROUP BY doc_id")
def identity_target(s, d):
    return scored(s, d).groupBy("doc_id").agg(F.round(1 - F.coalesce(F.max(F.when(F.col("c") > 0, F.col("target"))), F.lit(0.0)), 3).alias("identity_target"))


DECISIVE = "SELECT score, target >= 0.8 AS good FROM g WHERE c > 0 AND (target >= 0.8 OR target <= 0.2)"


def decisive(s, d) -> DataFrame:
    return scored(s, d).filter("c > 0 AND (target >= 0.8 OR target <= 0.2)").withColumn("good", F.col("target") >= 0.8)


@query(
    f"""WITH {SCORED}, x AS ({DECISIVE}) SELECT count(*) AS n, round(count(*) FILTER (WHERE (score >= 0.5) = good) / count(*), 6) AS accuracy,
round(count(*) FILTER (WHERE score >= 0.5 AND good) / count(*) FILTER (WHERE score >= 0.5), 6) AS precision_, round(count(*) FILTER (WHERE score >= 0.5 AND good) / count(*) FILTER (WHERE good), 6) AS recall,
round((SELECT avg((score - target) ** 2) FROM g WHERE c > 0), 6) AS brier FROM x"""
)
def classification_metrics(s, d):
    x, hit = decisive(s, d), F.col("score") >= 0.5
    brier = scored(s, d).filter("c > 0").agg(F.round(F.avg(F.pow(F.col("score") - F.col("target"), 2)), 6).alias("brier"))
    return x.agg(
        F.count("*").alias("n"), F.round(F.count_if(hit == F.col("good")) / F.count("*"), 6).alias("accuracy"), F.round(F.count_if(hit & F.col("good")) / F.count_if(hit), 6).alias("precision_"), F.round(F.count_if(hit & F.col("good")) / F.count_if("good"), 6).alias("recall")
    ).join(F.broadcast(brier))


@query(f"WITH {SCORED}, x AS ({DECISIVE}), k AS (SELECT good, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x), n AS (SELECT count(*) FILTER (WHERE good) AS p, count(*) FILTER (WHERE NOT good) AS q FROM x) SELECT round((sum(r) FILTER (WHERE good) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)), 6) AS auc FROM k, n")
def auc(s, d):
    """Area by mean ranks. Scores are counted first, so that the running sum sees one row a distinct score."""
    by = decisive(s, d).groupBy("score").agg(F.count_if("good").alias("p"), F.count_if(~F.col("good")).alias("q"))
    # Sums below each score: within hash-free range bins, then over the bins.
    b = by.withColumn("bin", F.floor(F.col("score") * 1000))
    bins = b.groupBy("bin").agg(F.sum("q").alias("bq"))  # at most 1,001 rows
    start = bins.select("bin", F.coalesce(F.sum("bq").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = b.withColumn("below", below).join(F.broadcast(start), "bin")
    return x.agg(F.round(F.sum(F.col("p") * (F.col("start") + F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q")), 6).alias("auc"))


@query(
    f"""WITH {SCORED}, x AS ({DECISIVE}), f AS (SELECT unnest([0.01, 0.02, 0.03, 0.05]) AS fp), t AS (SELECT fp, (SELECT quantile_cont(score, [0.99, 0.98, 0.97, 0.95]) FROM x WHERE NOT good) AS qs FROM f),
c AS (SELECT CAST(fp AS DOUBLE) AS fp, qs[CASE fp WHEN 0.01 THEN 1 WHEN 0.02 THEN 2 WHEN 0.03 THEN 3 ELSE 4 END] AS cut FROM t)
SELECT fp, round(cut, 6) AS cut, round((SELECT count(*) FROM x WHERE good AND score >= cut) / (SELECT count(*) FROM x WHERE good), 6) AS recall FROM c"""
)
def recall_at_fp(s, d):
    x = decisive(s, d)
    bad = x.filter(~F.col("good")).withColumn("one", F.lit(1))
    known = None
    for fp in (0.01, 0.02, 0.03, 0.05):  # four rows
        row = order.quantile(bad, ["one"], "score", 1 - fp, "cut").select(F.lit(fp).alias("fp"), "cut")
        known = row if known is None else known.union(row)
    hits = x.filter("good").join(F.broadcast(known)).groupBy("fp", "cut").agg(F.round(F.count_if(F.col("score") >= F.col("cut")) / F.count("*"), 6).alias("recall"))
    return hits.select("fp", F.round("cut", 6).alias("cut"), "recall")


@query(f"WITH {SCORED} SELECT CASE WHEN c = 0 THEN 'original' WHEN c < 3 THEN 'inventory' ELSE 'negative' END AS origin, round(avg(score), 9) AS mean_score, count(*) AS n FROM g GROUP BY origin")
def mean_by_origin(s, d):
    origin = F.when(F.col("c") == 0, "original").when(F.col("c") < 3, "inventory").otherwise("negative")
    return scored(s, d).groupBy(origin.alias("origin")).agg(F.round(F.avg("score"), 9).alias("mean_score"), F.count("*").alias("n"))


BEST = f"{SCORED}, best AS (SELECT doc_id, max(score) FILTER (WHERE c = 0) AS original, arg_max(c, score) FILTER (WHERE c > 0) AS c, max(score) FILTER (WHERE c > 0) AS score, arg_max(target, score) FILTER (WHERE c > 0) AS target FROM g GROUP BY doc_id)"


def best(s, d) -> DataFrame:
    """The best candidate of each span, the lowest numbered of equals, beside the original's score."""
    pick = F.max_by(F.struct("c", "score", "target"), F.when(F.col("c") > 0, F.struct(F.col("score"), -F.col("c"))))
    return scored(s, d).groupBy("doc_id").agg(F.max(F.when(F.col("c") == 0, F.col("score"))).alias("original"), pick.alias("b")).select("doc_id", "original", "b.*")


@query(f"WITH {BEST} SELECT doc_id, CASE WHEN score >= 0.6 AND score > original THEN c ELSE -1 END AS choice, round(score, 6) AS score FROM best")
def decide(s, d):
    """The best candidate if it reaches the threshold and beats the original, else -1."""
    return best(s, d).select("doc_id", F.when((F.col("score") >= 0.6) & (F.col("score") > F.col("original")), F.col("c")).otherwise(F.lit(-1)).alias("choice"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {BEST}, th AS (SELECT unnest(range(6, 19)) / 20 AS threshold) SELECT threshold, round(count(*) FILTER (WHERE score >= threshold AND score > original) / count(*), 6) AS coverage,
round(count(*) FILTER (WHERE score >= threshold AND score > original AND target >= 0.8) / count(*) FILTER (WHERE score >= threshold AND score > original), 6) AS precision_,
round(100.0 * count(*) FILTER (WHERE score >= threshold AND score > original AND target < 0.5) / count(*), 4) AS errors FROM best, th GROUP BY threshold"""
)
def threshold_sweep(s, d):
    """All thresholds in one pass: each span adds to the counts of the thresholds that it meets."""
    b = best(s, d).withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(6), F.lit(18)), lambda i: i / 20)))
    taken = (F.col("score") >= F.col("threshold")) & (F.col("score") > F.col("original"))
    n = F.count("*")
    return b.groupBy("threshold").agg(F.round(F.count_if(taken) / n, 6).alias("coverage"), F.round(F.count_if(taken & (F.col("target") >= 0.8)) / F.count_if(taken), 6).alias("precision_"), F.round(100.0 * F.count_if(taken & (F.col("target") < 0.5)) / n, 4).alias("errors"))


@query(f"WITH t AS ({SQL['threshold_sweep']}) SELECT threshold, coverage, precision_, errors FROM t WHERE precision_ >= 0.3 ORDER BY coverage DESC, threshold LIMIT 1")
def threshold_pick(s, d):
    """The threshold of the largest coverage among those with enough precision, the lowest of equals. (Hashes as scores reach 0.3, not the 0.9 of a model.)"""
    return threshold_sweep(s, d).filter("precision_ >= 0.3").orderBy(F.desc("coverage"), "threshold").limit(1)


@query(
    f"""WITH {SCORED}, l AS (SELECT doc_id, target / sum(target) OVER (PARTITION BY doc_id) AS q, score - max(score) OVER (PARTITION BY doc_id) AS z FROM g),
m AS (SELECT doc_id, -sum(q * z) + ln(sum(exp(z))) AS loss FROM l GROUP BY doc_id) SELECT round(avg(loss), 6) AS loss, count(*) AS groups FROM m"""
)
def ranking_loss(s, d):
    """Soft cross-entropy of each group's targets against the log-softmax of its scores."""
    per = scored(s, d).groupBy("doc_id").agg((-F.sum(F.col("target") * F.col("score")) / F.sum("target") + F.log(F.sum(F.exp("score")))).alias("loss"))
    return per.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("groups"))


@query(f"WITH {SCORED} SELECT round(avg(greatest(score, 0) - score * target + ln(1 + exp(-abs(score)))), 6) AS loss FROM g WHERE c > 0")
def bce_loss(s, d):
    x = F.greatest("score", F.lit(0.0)) - F.col("score") * F.col("target") + F.log1p(F.exp(-F.abs("score")))
    return scored(s, d).filter("c > 0").agg(F.round(F.avg(x), 6).alias("loss"))


@query(f"WITH {SCORED}, v AS (SELECT doc_id, c, ('0x' || substr(md5('v' || doc_id || ':' || c), 1, 2))::BIGINT AS h FROM g) SELECT c, count(*) AS n, count(*) FILTER (WHERE h % 2 = 0 AND (h // 2) % 2 = 0 AND (h // 4) % 2 = 0) + count(*) FILTER (WHERE h % 2 = 1 AND (h // 2) % 2 = 1 AND (h // 4) % 2 = 1) AS unanimous FROM v GROUP BY c")
def gold_consensus(s, d):
    """Three votes a candidate; unanimous only if all three are there and equal."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(":"), F.col("c").cast("string")).cast("binary")), 1, 2), 16, 10).cast("long")
    votes = scored(s, d).select("doc_id", "c", F.explode(F.array(h % 2, F.floor(h / 2) % 2, F.floor(h / 4) % 2)).alias("vote"))
    per = votes.groupBy("doc_id", "c").agg(F.count("*").alias("n"), F.min("vote").alias("a"), F.max("vote").alias("b"))
    return per.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.expr("n = 3 AND a = b")).alias("unanimous"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('cap:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 4")
def per_key_cap(s, d):
    order = F.md5(F.concat(F.lit("cap:"), F.col("doc_id").cast("string")).cast("binary"))
    return docs(s, d).select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id")).alias("rn")).filter("rn <= 4").drop("rn")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('pick:' || doc_id), doc_id) AS rn FROM documents) ORDER BY rn, lang LIMIT 90")
def stratified_pick(s, d):
    order = F.md5(F.concat(F.lit("pick:"), F.col("doc_id").cast("string")).cast("binary"))
    nth = docs(s, d).select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")).alias("rn"))
    # No stratum gives more than all: the limit within each keeps only its first rows in any task.
    return nth.filter("rn <= 90").orderBy("rn", "lang").limit(90).drop("rn")


@query("SELECT doc_id, CASE WHEN substr(h, 1, 2) < '1a' THEN 'test' WHEN substr(h, 1, 2) < '33' THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, md5('split:' || source) AS h FROM documents)")
def word_disjoint_split(s, d):
    """All rows of a key go to one split."""
    h = F.substring(F.md5(F.concat(F.lit("split:"), "source").cast("binary")), 1, 2)
    return docs(s, d).select("doc_id", F.when(h < "1a", "test").when(h < "33", "dev").otherwise("train").alias("split"))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(s, d):
    e = table(s, d, "events").select("event_type", "value")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    both = order.quantile(e, ["event_type"], "value", 0.5, "median").join(order.quantile(e, ["event_type"], "value", 0.95, "p95"), "event_type")
    return n.join(both, "event_type", "left").select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


# Vectors. A stated query set is held against all rows in blocks; each row keeps only its best few.

VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"


def units(s, d) -> DataFrame:
    norm = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    # Bound step by step, so that the norm is not worked out once an element.
    unit = X.let(F.transform("embedding", lambda x: x.cast("double")), lambda e: X.let(F.struct(e.alias("e"), norm(e).alias("n")), lambda v: F.transform(v["e"], lambda x: x / v["n"])))
    return table(s, d, "embeddings").select("vec_id", "label", unit.alias("e"))


@query(f"WITH {VECTORS}, k AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbour, list_dot_product(a.e, b.e) AS cosine FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT vec_id, neighbour, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, neighbour) AS rn FROM k) WHERE rn <= 6")
def knn_neighbours(s, d):
    """Six nearest by cosine of every vector whose id is divisible by 20, against all vectors: exact, block by block."""
    u = units(s, d)
    out = None
    for ids, q, _, last in _blocks(u, "label"):
        part = u.select("vec_id", "e").mapInPandas(_nearest(ids, q), "vec_id long, neighbour long, cosine double")
        best_ = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")
        part = part.withColumn("rn", F.row_number().over(best_)).filter("rn <= 6").select("vec_id", "neighbour", F.round("cosine", 6).alias("cosine"))
        # Of several blocks each is done and written before the next is read.
        part = part if last and out is None else written(part)
        out = part if out is None else out.union(part)
    return out


#: Query vectors and rows of one product of matrices: 8 MB.
_TILE = 512, 2048


def _tiles(pdf, ids):
    """``at, rows``: the places of a product's queries in the block and of its rows in the batch."""
    for i in range(0, len(ids), _TILE[0]):
        for j in range(0, len(pdf), _TILE[1]):
            yield slice(i, i + _TILE[0]), slice(j, j + _TILE[1])


def _nearest(ids, q, most: int = 6):
    """For ``mapInPandas``: the ``most`` nearest of each query among the rows of a task, the least ids of equals. It holds these, a batch and one tile."""
    import numpy as np
    import pandas as pd

    def nearest(batches):
        near, cosine = np.zeros((len(ids), most), np.int64), np.full((len(ids), most), -np.inf)
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            e, known = np.stack(pdf["e"]), pdf["vec_id"].to_numpy()
            for at, rows in _tiles(pdf, ids):
                sim = q[at] @ e[rows].T
                sim[ids[at][:, None] == known[rows][None]] = -np.inf
                least = cosine[at][:, -1]
                if sim.shape[1] > most:
                    least = np.maximum(least, np.partition(sim, -most, axis=1)[:, -most])
                # Products are compared as rounded, so what is a rounding below the least may still be its equal.
                i, j = np.nonzero((sim >= least[:, None] - 2e-9) & (sim > -np.inf))
                if not len(i):
                    continue
                own = np.unique(i)
                i = np.concatenate([i, np.repeat(own, most)])
                of = np.concatenate([known[rows][j], near[at][own].ravel()])
                c = np.concatenate([np.round(sim[i[: len(j)], j], 9), cosine[at][own].ravel()])
                order = np.lexsort((of, -c, i))
                i, of, c = i[order], of[order], c[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                k = rank < most
                near[at][i[k], rank[k]], cosine[at][i[k], rank[k]] = of[k], c[k]
        found = cosine > -np.inf
        if found.any():
            yield pd.DataFrame({"vec_id": np.repeat(ids, found.sum(axis=1)), "neighbour": near[found], "cosine": cosine[found]})

    return nearest


BANKED = f"{VECTORS}, dots AS (SELECT a.vec_id AS vec_id, a.label AS own, b.label AS bank, round(max(list_dot_product(a.e, b.e)), 9) AS dot FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3), mine AS (SELECT vec_id, dot AS o FROM dots WHERE own = bank), pct AS (SELECT vec_id, any_value(own) AS own, CASE WHEN count(o) > 0 THEN round(count(*) FILTER (WHERE dot < o) / count(*), 6) END AS percentile FROM dots LEFT JOIN mine USING (vec_id) GROUP BY vec_id)"


def bank_dots(s, d) -> DataFrame:
    """``vec_id, own, bank, dot``: the largest product of each query vector (id divisible by 20) with any other vector of each bank (label)."""
    u = units(s, d)
    out = None
    for ids, q, own, last in _blocks(u, "label"):
        part = u.mapInPandas(_most(ids, q, own), "vec_id long, own long, bank long, dot double").groupBy("vec_id", "own", "bank").agg(F.max("dot").alias("dot"))
        part = part if last and out is None else written(part)
        out = part if out is None else out.union(part)
    return out


def _most(ids, q, own, cells: int = 1 << 20):
    """For ``mapInPandas``: the largest product of each query with the rows of each bank in a task. It holds at most about ``cells`` of these, a batch and one tile."""
    import numpy as np
    import pandas as pd

    def most(batches):
        best: dict = {}

        def found():
            for bank, dot in best.items():
                k = dot > -np.inf
                if k.any():
                    yield pd.DataFrame({"vec_id": ids[k], "own": own[k], "bank": np.full(k.sum(), bank), "dot": np.round(dot[k], 9)})
            best.clear()

        for whole in batches:
            if not len(whole) or not len(ids):
                continue
            whole = whole.sort_values("label")
            for lo in range(0, len(whole), _TILE[1]):
                pdf = whole.iloc[lo : lo + _TILE[1]]
                e, known = np.stack(pdf["e"]), pdf["vec_id"].to_numpy()
                banks, start = np.unique(pdf["label"].to_numpy(), return_index=True)
                banks = [None if pd.isna(x) else int(x) for x in banks]
                per = max(1, cells // len(ids))
                for b in range(0, len(banks), per):
                    if len(best) + per > 2 * per:
                        yield from found()
                    here, first = banks[b : b + per], start[b]
                    end = start[b + per] if b + per < len(banks) else len(pdf)
                    for x in here:
                        best.setdefault(x, np.full(len(ids), -np.inf))
                    for at, rows in _tiles(pdf.iloc[first:end], ids):
                        sim = q[at] @ e[first:end][rows].T
                        sim[ids[at][:, None] == known[first:end][rows][None]] = -np.inf
                        top = np.maximum.reduceat(sim, start[b : b + per] - first, axis=1)
                        for k, x in enumerate(here):
                            np.maximum(best[x][at], top[:, k], out=best[x][at])
        yield from found()

    return most


def _blocks(u: DataFrame, extra: str, size: int = 20_000):
    """The query vectors in blocks of about ``size``, and whether a block is the last; one at a time is held here."""
    import numpy as np

    queries = u.filter("vec_id % 20 = 0").select("vec_id", "e", extra)
    n = max(1, -(-queries.count() // size))
    for b in range(n):
        # Vectors come as bytes of Arrow's and not as lists of numbers.
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).toArrow()
        e = rows["e"].combine_chunks()
        yield rows["vec_id"].to_numpy(), e.flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.zeros((0, 0)), np.array(rows[extra].to_pylist()), b == n - 1


def percentiles(s, d) -> DataFrame:
    """``vec_id, own, percentile``: the share of all banks that are strictly less like the vector than its own; null where its own bank holds nothing else."""
    dots = bank_dots(s, d)
    own = F.max(F.when(F.col("own") == F.col("bank"), F.col("dot")))
    per = dots.groupBy("vec_id", "own").agg(own.alias("o"), F.collect_list("dot").alias("ds"))  # as many as there are banks
    return per.select("vec_id", "own", F.when(F.col("o").isNotNull(), F.round(F.size(F.filter("ds", lambda x: x < F.col("o"))) / F.size("ds"), 6)).alias("percentile"))


@query(f"WITH {BANKED} SELECT vec_id, percentile FROM pct")
def bank_percentile(s, d):
    return percentiles(s, d).select("vec_id", "percentile")


@query(f"WITH {BANKED} SELECT vec_id, own, coalesce(percentile >= 0.34, true) AS passes FROM pct")
def context_gate(s, d):
    """A vector passes if its own bank is liker to it than 34 % of all banks; one without a bank passes."""
    return percentiles(s, d).select("vec_id", F.col("own").cast("int").alias("own"), F.coalesce(F.col("percentile") >= 0.34, F.lit(True)).alias("passes"))


# Items: spans with candidates, negatives and vetoes.


NAMES = f"names AS (SELECT lower(w) AS form FROM (SELECT unnest(regexp_extract_all(text, '{W}')) AS w FROM documents) GROUP BY 1 HAVING count(*) FILTER (WHERE w ~ '^[A-Z].*') >= 20 AND count(*) FILTER (WHERE w ~ '^[A-Z].*') / count(*) >= 0.9)"


def name_forms(s, d) -> DataFrame:
    return case_table(docs(s, d)).filter("capitals >= 20 AND capitals / (capitals + lowers) >= 0.9").select("form")


@query(
    f"""WITH {NAMES}, l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations),
m AS (SELECT conv_id, turn, k, unnest(regexp_extract_all(line, '{W}')) AS w, generate_subscripts(regexp_extract_all(line, '{W}'), 1) AS i FROM l)
SELECT conv_id, turn, w, count(*) AS n FROM m WHERE i > 1 AND w ~ '^[A-Z].*' AND lower(w) IN (SELECT form FROM names) GROUP BY conv_id, turn, w"""
)
def proper_noun_veto(s, d):
    """Capitalised words of a turn, not the first of their line, that are names: nothing may stand for them."""
    lines = table(s, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    w = lines.select("conv_id", "turn", F.posexplode_outer(F.regexp_extract_all("line", F.lit(X.WORD), F.lit(0))).alias("i", "w")).filter(F.col("i").isNotNull() & (F.col("i") > 0) & F.col("w").rlike("^[A-Z]"))
    found = w.withColumn("form", F.lower("w")).join(name_forms(s, d), "form", "left_semi")
    return found.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))


@query(
    f"""WITH {RULES_SQL}, {SPANS}, first AS (SELECT * FROM spans JOIN rules USING (trigger)), capped AS (SELECT *, row_number() OVER (PARTITION BY replacement ORDER BY md5('item:' || doc_id || ':' || n), doc_id, n) AS rn FROM first),
neg AS (SELECT a.trigger AS trigger, arg_min(b.replacement, md5('easy:' || a.trigger || ':' || b.replacement)) AS easy FROM rules a, rules b WHERE a.pos <> b.pos GROUP BY a.trigger)
SELECT doc_id, CAST(n AS BIGINT) AS n, surface, substr(text, 1, CAST(start AS BIGINT)) || '____' || substr(text, CAST(start AS BIGINT) + length(surface) + 1) AS blanked, replacement, easy, 'inventory:' || replacement || '|easy_neg:' || easy || '|original:' || surface AS candidates
FROM capped JOIN neg USING (trigger) JOIN documents USING (doc_id) WHERE rn <= 25"""
)
def items(s, d):
    """Spans as items: blanked text, the rule's word, a negative of another part of speech, the original; at most 25 a word."""
    found = spans(docs(s, d), [r[0] for r in RULES]).join(F.broadcast(rules(s).select("trigger", "replacement", "pos")), "trigger")
    shuffled = F.md5(F.concat(F.lit("item:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("n").cast("string")).cast("binary"))
    capped = found.withColumn("rn", F.row_number().over(Window.partitionBy("replacement").orderBy(shuffled, "doc_id", "n"))).filter("rn <= 25")
    # The rules are a short list: each one's negative is worked out from the list itself.
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    easy = {t: min((md5(f"easy:{t}:{r}"), r) for _, r, q, *_ in RULES if q != p)[1] for t, _, p, *_ in RULES}
    negative = F.create_map(*(F.lit(x) for kv in easy.items() for x in kv))
    i = capped.withColumn("easy", F.element_at(negative, F.col("trigger"))).join(docs(s, d).select("doc_id", "text"), "doc_id")
    blanked = F.concat(F.substring("text", F.lit(1), F.col("start").cast("int")), F.lit("____"), F.substring("text", (F.col("start") + F.length("surface") + 1).cast("int"), F.length("text")))
    candidates = F.concat(F.lit("inventory:"), "replacement", F.lit("|easy_neg:"), "easy", F.lit("|original:"), "surface")
    return i.select("doc_id", F.col("n").cast("long").alias("n"), "surface", blanked.alias("blanked"), "replacement", "easy", candidates.alias("candidates"))


@query(
    f"""WITH {RULES_SQL}, {SPANS}, pos AS (SELECT doc_id, n, trigger, replacement, pos FROM spans JOIN rules USING (trigger)),
k AS (SELECT p.doc_id AS doc_id, p.n AS n, p.replacement AS replacement, arg_min(r.replacement, md5('wrong:' || p.doc_id || ':' || p.n || ':' || r.replacement)) AS wrong FROM pos p, rules r WHERE r.pos <> 'VERB' AND r.replacement <> p.replacement GROUP BY 1, 2, 3)
SELECT doc_id, CAST(n AS BIGINT) AS n, replacement, wrong FROM k"""
)
def wrong_sense_negatives(s, d):
    """For each positive another rule's word that is no verb, picked by a hash. The rules are an array beside the row."""
    p = spans(docs(s, d), [r[0] for r in RULES]).join(F.broadcast(rules(s).select("trigger", "replacement")), "trigger")
    others = F.filter(F.array(*(F.lit(r) for _, r, q, *_ in RULES if q != "VERB")), lambda r: r != F.col("replacement"))
    keyed = F.transform(others, lambda r: F.struct(F.md5(F.concat(F.lit("wrong:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("n").cast("string"), F.lit(":"), r).cast("binary")).alias("h"), r.alias("r")))
    return p.select("doc_id", F.col("n").cast("long").alias("n"), "replacement", F.array_min(keyed)["r"].alias("wrong"))


@query(
    f"""WITH {SCORED}, x AS (SELECT doc_id, c, CASE WHEN c = 0 THEN 1 - (SELECT max(y.target) FROM g y WHERE y.doc_id = g.doc_id AND y.c > 0) ELSE target END AS t, score FROM g),
b AS (SELECT doc_id, arg_max(t, score) AS picked, max(t) AS top, arg_max(c, score) AS c, arg_max(c, t) AS want FROM x GROUP BY doc_id)
SELECT count(*) AS groups, round(avg(CASE WHEN picked >= top - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(count(*) FILTER (WHERE c = 0) / count(*), 6) AS abstained FROM b"""
)
def top1_abstain(s, d):
    """Share of groups whose best scored option (the original counts as the identity) has the best target, ties credited; and of those that keep the original."""
    x = scored(s, d)
    identity = F.max(F.when(F.col("c") > 0, F.col("target")))
    per = x.groupBy("doc_id").agg(identity.alias("sub"), F.max_by(F.struct("c", "target"), "score").alias("b"))
    picked = F.when(F.col("b.c") == 0, 1 - F.col("sub")).otherwise(F.col("b.target"))
    top = F.greatest(F.col("sub"), 1 - F.col("sub"))
    return per.agg(F.count("*").alias("groups"), F.round(F.avg(F.when(picked >= top - 1e-9, 1.0).otherwise(0.0)), 6).alias("top1"), F.round(F.count_if(F.col("b.c") == 0) / F.count("*"), 6).alias("abstained"))


@query(
    f"""WITH {SCORED}, x AS ({DECISIVE}), t AS (SELECT quantile_cont(score, 0.98) AS threshold FROM x WHERE NOT good)
SELECT round(any_value(threshold), 6) AS threshold, round(count(*) FILTER (WHERE good AND score >= threshold) / count(*) FILTER (WHERE good), 6) AS recall, round(count(*) FILTER (WHERE NOT good AND score >= threshold) / count(*) FILTER (WHERE NOT good), 6) AS false_rate FROM x, t"""
)
def operating_threshold(s, d):
    x = decisive(s, d)
    t = order.quantile(x.filter(~F.col("good")).withColumn("one", F.lit(1)), ["one"], "score", 0.98, "threshold").select("threshold")  # one row
    hit = F.col("score") >= F.col("threshold")
    return x.join(F.broadcast(t)).agg(
        F.round(F.max("threshold"), 6).alias("threshold"), F.round(F.count_if(hit & F.col("good")) / F.count_if("good"), 6).alias("recall"), F.round(F.count_if(hit & ~F.col("good")) / F.count_if(~F.col("good")), 6).alias("false_rate")
    )


@query(
    f"""WITH {SPANS}, {RULES_SQL}, w AS (SELECT sum(len(regexp_extract_all(lower(text), '{W}'))) AS words FROM documents),
a AS (SELECT replacement, ('0x' || substr(md5(doc_id || ':' || n), 1, 8))::BIGINT % 1000 >= 600 AS taken FROM spans JOIN rules USING (trigger))
SELECT CAST(any_value(words) AS BIGINT) AS words, count(*) AS spans, count(*) FILTER (WHERE taken) AS swaps, round(1000.0 * count(*) FILTER (WHERE taken) / any_value(words), 6) AS per_1k, count(DISTINCT replacement) FILTER (WHERE taken) AS distinct_swaps FROM a, w"""
)
def delivery_rate(s, d):
    """Spans and accepted swaps a thousand words."""
    w = docs(s, d).agg(F.sum(F.size(X.words(F.col("text")))).cast("long").alias("words"))  # one row
    h = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("n").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    a = spans(docs(s, d), [r[0] for r in RULES]).join(F.broadcast(rules(s).select("trigger", "replacement")), "trigger").withColumn("taken", h % 1000 >= 600)
    c = a.agg(F.count("*").alias("spans"), F.count_if("taken").alias("swaps"), F.count_distinct(F.when(F.col("taken"), F.col("replacement"))).alias("distinct_swaps"))
    return c.join(F.broadcast(w)).select("words", "spans", "swaps", F.round(1000.0 * F.col("swaps") / F.col("words"), 6).alias("per_1k"), "distinct_swaps")


@query(
    f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) > 2)) AS w FROM documents), i AS (SELECT doc_id, unnest(w) AS form FROM t),
b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) > 2))) AS form FROM benchmark),
df AS (SELECT form, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM i GROUP BY form), n AS (SELECT doc_id, sqrt(sum(idf * idf)) AS norm FROM i JOIN df USING (form) GROUP BY doc_id),
m AS (SELECT item_id, sqrt(sum(idf * idf)) AS norm FROM b JOIN df USING (form) GROUP BY item_id)
SELECT item_id, round(max(s), 6) AS best FROM (SELECT item_id, doc_id, sum(idf) / (any_value(n.norm) * any_value(m.norm)) AS s FROM b JOIN df USING (form) JOIN i USING (form) JOIN n USING (doc_id) JOIN m USING (item_id) WHERE idf > 1 GROUP BY item_id, doc_id) GROUP BY item_id"""
)
def context_overlap(s, d):
    """Best idf-weighted overlap of each test item with any document, over words that at most a third of the documents hold."""
    content = lambda t, i: t.select(i, F.explode(F.array_distinct(F.filter(X.words(F.col("text")), lambda x: F.length(x) > 2))).alias("form"))
    i, b = content(docs(s, d), "doc_id"), content(table(s, d, "benchmark"), "item_id")
    every = docs(s, d).agg(F.count("*").alias("every"))  # one row
    df = i.groupBy("form").agg(F.count("*").alias("n")).join(F.broadcast(every)).select("form", F.log(F.col("every") / F.col("n")).alias("idf"))
    norm = lambda x, k, name: x.join(df, "form").groupBy(k).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias(name))
    shared = b.join(df.filter("idf > 1"), "form").join(i, "form").groupBy("item_id", "doc_id").agg(F.sum("idf").alias("dot"))
    scored_ = shared.join(norm(i, "doc_id", "dn"), "doc_id").join(norm(b, "item_id", "bn"), "item_id")
    return scored_.groupBy("item_id").agg(F.round(F.max(F.col("dot") / (F.col("dn") * F.col("bn"))), 6).alias("best"))


@query(f"WITH {SCORED}, th AS (SELECT unnest(range(1, 60)) / 60 AS cut) SELECT round(cut, 6) AS cut, round(count(*) FILTER (WHERE target >= 0.8 AND score >= cut) / count(*) FILTER (WHERE target >= 0.8), 6) AS kept, round(count(*) FILTER (WHERE target <= 0.2 AND score < cut) / count(*) FILTER (WHERE target <= 0.2), 6) AS blocked FROM g, th WHERE c > 0 GROUP BY cut")
def gate_sweep(s, d):
    """Keep and block rates of a context gate at 59 cutoffs, in one pass."""
    x = scored(s, d).filter("c > 0").withColumn("cut", F.explode(F.transform(F.sequence(F.lit(1), F.lit(59)), lambda i: i / 60)))
    good, bad, over = F.col("target") >= 0.8, F.col("target") <= 0.2, F.col("score") >= F.col("cut")
    return x.groupBy("cut").agg(F.round(F.count_if(good & over) / F.count_if(good), 6).alias("kept"), F.round(F.count_if(bad & ~over) / F.count_if(bad), 6).alias("blocked")).withColumn("cut", F.round("cut", 6))


@query(
    """WITH a AS (SELECT conv_id, turn, role, ('0x' || substr(md5('tag:' || conv_id || ':' || turn), 1, 1))::BIGINT % 4 AS guess, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS truth FROM conversations)
SELECT truth, guess, count(*) AS n FROM a GROUP BY truth, guess"""
)
def tagger_agreement(s, d):
    """The confusion table of two taggings."""
    guess = F.conv(F.substring(F.md5(F.concat(F.lit("tag:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).cast("binary")), 1, 1), 16, 10).cast("long") % 4
    truth = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return table(s, d, "conversations").groupBy(truth.alias("truth"), guess.alias("guess")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {RATES}, x AS (SELECT count(*) AS docs, sum(length(text)) AS chars FROM documents), y AS (SELECT any_value(total) AS total, count(*) AS forms FROM r)
SELECT docs, CAST(chars AS BIGINT) AS chars, total, forms, round(chars / total, 6) AS chars_a_word, round(forms * sqrt(1e9 / total), 4) AS forms_at_1b, round(1e9 / 500000 / 3600, 6) AS core_hours FROM x, y"""
)
def projection(s, d):
    """What a billion words would hold: vocabulary by the square root of the scale, core hours at the accepted floor."""
    x = docs(s, d).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    y = rates(docs(s, d)).agg(F.max("total").alias("total"), F.count("*").alias("forms"))
    return x.join(F.broadcast(y)).select("docs", "chars", "total", "forms", F.round(F.col("chars") / F.col("total"), 6).alias("chars_a_word"), F.round(F.col("forms") * F.sqrt(F.lit(1e9) / F.col("total")), 4).alias("forms_at_1b"), F.round(F.lit(1e9) / 500000 / 3600, 6).alias("core_hours"))
