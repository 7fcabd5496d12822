"""Sets for human judges and for training, context banks, splits, page jobs and model reports over the driver's tables.

A turn of a conversation stands for a sentence; tags and scores are hashes that every engine can compute.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import pages as P
from prosemill.functions import text as X
from prosemill.functions import udfs
from prosemill.operators.scratch import written
from prosemill.plans.corpus_queries import PHRASES, STOP, fixed_phrase_table
from prosemill.plans.decision_queries import _ALTERNATION, FIRSTS, NAMES, RULES, SCORED, name_forms, pieces, rules, scored, spans
from prosemill.plans.evaluation_queries import SWAPPED, hashed, swapped_turns
from prosemill.plans.page_queries import _BLOCKS
from prosemill.plans.registry import SQL, query, table
from prosemill.plans.text_queries import HIGH, LOW, RATES, REASON, SENTENCES, W, counts, docs, first_of_key, good_sentences, pieces_sql, rates, top_counts

_md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
_keyed = lambda prefix, *keys: F.md5(F.concat_ws(":", F.lit(prefix), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)).cast("binary"))
_hex = lambda key, n=4: f"('0x' || substr(md5({key}), 1, {n}))::BIGINT"

# Proposals: the first span of each turn, its swap, and what speaks against it.

TAGS = ["ADJ", "NOUN", "VERB"]
PROPOSALS = f"""{SWAPPED}, {PHRASES}, {NAMES}, f(trigger, head) AS (VALUES {", ".join(f"('{t}', '{h}')" for t, h in FIRSTS)}),
ps AS (SELECT conv_id, turn, t, {pieces_sql('t', _ALTERNATION)} AS ps FROM tx),
sp AS (SELECT conv_id, turn, t, ps[2] AS surface, lower(ps[2]) AS trigger, length(ps[1]) AS start, regexp_extract_all(lower(t), '{W}') AS w FROM ps WHERE len(ps) > 1),
att AS (SELECT sp.*, pos, replacement, coalesce(list_position(w, head), 0) AS i, {_hex("'pos:' || conv_id || ':' || turn")} % 6 AS h FROM sp JOIN rules USING (trigger) JOIN f USING (trigger)),
vt AS (SELECT att.*, CASE WHEN i > 0 AND (EXISTS (FROM phrases WHERE w1 = w[i] AND w2 = w[i + 1]) OR i > 1 AND EXISTS (FROM phrases WHERE w1 = w[i - 1] AND w2 = w[i])) THEN 'phrase'
  WHEN surface ~ '^[A-Z].*' AND start > 0 AND trigger IN (SELECT form FROM names) THEN 'name' WHEN h < 3 AND {TAGS}[h + 1] <> pos THEN 'tag' END AS veto FROM att),
proposals AS (SELECT vt.conv_id AS conv_id, vt.turn AS turn, vt.trigger AS trigger, vt.replacement AS replacement, pos, surface, CAST(start AS BIGINT) AS start, veto, swapped FROM vt JOIN swapped s ON s.conv_id = vt.conv_id AND s.turn = vt.turn AND s.trigger = vt.trigger)"""


def pos_gate(tag: Column, pos: Column) -> Column:
    """A span passes unless its tag is known and differs from its rule's."""
    return tag.isNull() | (pos == "") | (tag == pos)


def proposals(s, d) -> DataFrame:
    """``conv_id, turn, trigger, replacement, pos, surface, start, veto, swapped``: a fixed phrase with a neighbour, a name, or another part of speech is a veto."""
    t = swapped_turns(s, d)
    text = t.groupBy("conv_id", "turn").agg(F.first("original").alias("text"), F.map_from_entries(F.collect_list(F.struct("trigger", "swapped"))).alias("by"))  # at most one entry a rule
    key = F.struct("conv_id", "turn")
    first = spans(text.select(key.alias("key"), "text"), [r[0] for r in RULES], "key").filter("n = 0").select("key.*", "surface", "trigger", "start")
    m = text.join(first, ["conv_id", "turn"]).join(F.broadcast(rules(s).select("trigger", "replacement", "pos")), "trigger").withColumn("swapped", F.element_at("by", F.col("trigger"))).filter("swapped is not null")
    head = F.create_map(*(F.lit(x) for kv in FIRSTS for x in kv))
    m = m.withColumn("w", X.words(F.col("text"))).withColumn("i", F.array_position("w", F.element_at(head, F.col("trigger"))).cast("int") - 1)
    at = lambda j: F.when(F.col("i") + j >= 0, F.get("w", F.col("i") + j))
    pairs = m.filter("i >= 0").select("conv_id", "turn", F.explode(F.array(F.struct(at(0).alias("w1"), at(1).alias("w2")), F.struct(at(-1).alias("w1"), at(0).alias("w2")))).alias("p")).select("conv_id", "turn", "p.*")
    fixed = pairs.join(fixed_phrase_table(docs(s, d)).select("w1", "w2"), ["w1", "w2"], "left_semi").select("conv_id", "turn").distinct().withColumn("fixed", F.lit(True))
    names = name_forms(s, d).select(F.col("form").alias("trigger"), F.lit(True).alias("name"))
    h = hashed("pos:", "conv_id", "turn", digits=4) % 6
    tag = F.when(h < 3, F.element_at(F.array(*map(F.lit, TAGS)), (h + 1).cast("int")))
    j = m.join(fixed, ["conv_id", "turn"], "left").join(names, "trigger", "left")
    veto = F.when(F.col("fixed"), "phrase").when(F.col("surface").rlike("^[A-Z]") & (F.col("start") > 0) & F.col("name"), "name").when(~pos_gate(tag, F.col("pos")), "tag")
    return j.select("conv_id", "turn", "trigger", "replacement", "pos", "surface", F.col("start").cast("long").alias("start"), veto.alias("veto"), "swapped")


@query(f"WITH {PROPOSALS} SELECT conv_id, turn, trigger, surface, start, veto FROM proposals")
def proposal_vetoes(s, d):
    return proposals(s, d).select("conv_id", "turn", "trigger", "surface", "start", "veto")


@query(f"WITH {PROPOSALS} SELECT coalesce(veto, 'none') AS veto, count(*) AS n FROM proposals GROUP BY 1")
def veto_counters(s, d):
    return proposals(s, d).groupBy(F.coalesce("veto", F.lit("none")).alias("veto")).agg(F.count("*").alias("n"))


N_POSITIVE, N_NEGATIVE, PER_WORD = 12, 8, 4
_OTHERS = [(r, p) for _, r, p, *_ in RULES if p != "VERB"]


@query(
    f"""WITH {PROPOSALS}, po AS (SELECT *, md5('pick:' || conv_id || ':' || turn) AS h FROM (SELECT *, row_number() OVER (PARTITION BY replacement ORDER BY conv_id, turn) AS rn FROM proposals WHERE veto IS NULL) WHERE rn <= {PER_WORD}),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, conv_id, turn) AS k FROM po),
wrong AS (SELECT conv_id, turn, surface, arg_min(o.replacement, md5('wrong:' || conv_id || ':' || turn || ':' || o.replacement)) AS replacement FROM ranked p, rules o WHERE k <= {N_NEGATIVE} AND o.pos <> 'VERB' AND o.replacement <> p.replacement GROUP BY conv_id, turn, surface),
neg AS (SELECT conv_id, turn, CASE veto WHEN 'phrase' THEN 'collocation break' ELSE 'proper noun' END AS kind, surface, replacement FROM proposals WHERE veto IN ('phrase', 'name') UNION ALL SELECT conv_id, turn, 'wrong sense', surface, replacement FROM wrong),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('neg:' || conv_id || ':' || turn), conv_id, turn) AS rn FROM neg) ORDER BY rn, kind LIMIT {N_NEGATIVE}),
every AS (SELECT conv_id, turn, 'proposal' AS kind, surface, replacement FROM ranked WHERE k <= {N_POSITIVE} UNION ALL SELECT conv_id, turn, kind, surface, replacement FROM chosen)
SELECT row_number() OVER (ORDER BY md5('mix:' || conv_id || ':' || turn || ':' || kind), conv_id, turn, kind) AS id, * FROM every"""
)
def judging_set(s, d):
    """Proposals and negatives of three kinds for a blind judge: a stated number of each side, the negatives taken in turn from their kinds."""
    every = proposals(s, d)
    good = every.filter("veto is null").withColumn("rn", F.row_number().over(Window.partitionBy("replacement").orderBy("conv_id", "turn"))).filter(F.col("rn") <= PER_WORD)
    # As many rows as the set has at most go on from here.
    best = good.withColumn("h", _keyed("pick", "conv_id", "turn")).orderBy("h", "conv_id", "turn").limit(max(N_POSITIVE, N_NEGATIVE)).withColumn("k", F.row_number().over(Window.orderBy("h", "conv_id", "turn")))
    others = F.filter(F.array(*(F.lit(r) for r, _ in _OTHERS)), lambda r: r != F.col("replacement"))
    picked = F.array_min(F.transform(others, lambda r: F.struct(_keyed("wrong", "conv_id", "turn", r).alias("h"), r.alias("r"))))["r"]
    wrong = best.filter(F.col("k") <= N_NEGATIVE).select("conv_id", "turn", F.lit("wrong sense").alias("kind"), "surface", picked.alias("replacement"))
    vetoed = every.filter("veto in ('phrase', 'name')").select("conv_id", "turn", F.when(F.col("veto") == "phrase", "collocation break").otherwise("proper noun").alias("kind"), "surface", "replacement")
    nth = vetoed.unionByName(wrong).withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(_keyed("neg", "conv_id", "turn"), "conv_id", "turn")))
    chosen = nth.filter(F.col("rn") <= N_NEGATIVE).orderBy("rn", "kind").limit(N_NEGATIVE).drop("rn")
    mixed = best.filter(F.col("k") <= N_POSITIVE).select("conv_id", "turn", F.lit("proposal").alias("kind"), "surface", "replacement").unionByName(chosen)
    return mixed.withColumn("id", F.row_number().over(Window.orderBy(_keyed("mix", "conv_id", "turn", "kind"), "conv_id", "turn", "kind")).cast("long"))


def _negative(kind: str, fits) -> dict[str, str]:
    return {r: min((_md5(f"{kind}:{r}:{o}"), o) for _, o, q, *_ in RULES if o != r and fits(p, q))[1] for _, r, p, *_ in RULES if any(o != r and fits(p, q) for _, o, q, *_ in RULES)}


EASY, HARD = _negative("easy", lambda p, q: p != q), _negative("hard", lambda p, q: p == q)
_table = lambda x: ", ".join(f"('{k}', '{v}')" for k, v in x.items())


@query(
    f"""WITH {PROPOSALS}, easy(replacement, easy) AS (VALUES {_table(EASY)}), hard(replacement, hard) AS (VALUES {_table(HARD)}),
k AS (SELECT *, CASE WHEN veto IS NULL THEN 'substitution' ELSE 'abstention' END AS kind FROM proposals),
cp AS (SELECT *, row_number() OVER (PARTITION BY replacement, kind ORDER BY conv_id, turn) AS rn FROM k),
o AS (SELECT conv_id, turn, kind, coalesce(veto, '') AS veto, replacement, unnest([CASE WHEN veto IS NULL THEN 'inventory:' ELSE 'vetoed_sense:' END || replacement, 'easy_neg:' || easy, 'hard_neg:' || hard, 'original:' || surface]) AS x FROM cp LEFT JOIN easy USING (replacement) LEFT JOIN hard USING (replacement) WHERE rn <= 25)
SELECT conv_id, turn, kind, veto, replacement, string_agg(x, '|' ORDER BY md5('shuffle:' || conv_id || ':' || turn || ':' || x)) AS candidates FROM o WHERE x IS NOT NULL GROUP BY ALL"""
)
def item_kinds(s, d):
    """Substitutions and abstentions, at most 25 of a kind a word: the rule's word (or, vetoed, the wrong sense), an easy and a hard negative, the original; candidates shuffled by a hash."""
    k = proposals(s, d).withColumn("kind", F.when(F.col("veto").isNull(), "substitution").otherwise("abstention"))
    c = k.withColumn("rn", F.row_number().over(Window.partitionBy("replacement", "kind").orderBy("conv_id", "turn"))).filter("rn <= 25")
    of = lambda x: F.element_at(F.create_map(*(F.lit(y) for kv in x.items() for y in kv)), F.col("replacement"))
    origin = F.when(F.col("veto").isNull(), "inventory:").otherwise("vetoed_sense:")
    every = F.array(F.concat(origin, "replacement"), F.concat(F.lit("easy_neg:"), of(EASY)), F.concat(F.lit("hard_neg:"), of(HARD)), F.concat(F.lit("original:"), "surface"))
    shuffled = F.array_sort(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.struct(_keyed("shuffle", "conv_id", "turn", x).alias("h"), x.alias("x"))))
    return c.select("conv_id", "turn", "kind", F.coalesce("veto", F.lit("")).alias("veto"), "replacement", F.array_join(F.transform(shuffled, lambda x: x["x"]), "|").alias("candidates"))


@query(f"WITH t AS ({SQL['item_kinds']}) SELECT kind, conv_id, turn, replacement FROM t WHERE kind = 'substitution' UNION ALL SELECT kind, conv_id, turn, replacement FROM t WHERE kind = 'abstention'")
def item_union(s, d):
    """Substitutions and abstentions as one set."""
    t = item_kinds(s, d).select("kind", "conv_id", "turn", "replacement")
    return t.filter("kind = 'substitution'").unionByName(t.filter("kind = 'abstention'"))


# Context banks

HELD, LEAST_REST, BANK = 2, 3, 60
_CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower(sentence), '{W}'), lambda x: length(x) > 2 AND x NOT IN ({STOP})))"


@query(
    f"""WITH {SENTENCES}, {REASON}, {RATES}, tw AS (SELECT form FROM r WHERE per_million BETWEEN {LOW} AND {HIGH}), cw AS (SELECT pos, {_CONTENT} AS ws FROM kept),
hit AS (SELECT pos, form, ws FROM (SELECT pos, ws, unnest(ws) AS form FROM cw) SEMI JOIN tw USING (form)),
bank AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY pos) AS rn, count(*) OVER (PARTITION BY form) AS n FROM hit QUALIFY rn <= {BANK}),
kw AS (SELECT form, pos, rn, x, coalesce(ln(r.total / r.n), 12) AS idf FROM (SELECT form, pos, rn, n AS m, unnest(ws) AS x FROM bank) b LEFT JOIN (SELECT form AS x, n, total FROM r) r USING (x) WHERE x <> form AND m >= {HELD + LEAST_REST}),
norm AS (SELECT form, rn, sqrt(sum(idf * idf)) AS norm FROM kw GROUP BY form, rn),
dot AS (SELECT a.form AS form, a.rn AS ra, b.rn AS rb, sum(a.idf) AS dot FROM kw a JOIN kw b ON a.form = b.form AND a.x = b.x WHERE a.rn <= {HELD} AND b.rn > {HELD} GROUP BY 1, 2, 3),
sim AS (SELECT dot.form AS form, ra, max(dot / (x.norm * y.norm)) AS score FROM dot JOIN norm x ON x.form = dot.form AND x.rn = ra JOIN norm y ON y.form = dot.form AND y.rn = rb GROUP BY 1, 2)
SELECT bank.form AS form, CAST(bank.rn AS INT) AS nth, round(coalesce(score, 0), 6) AS score FROM bank LEFT JOIN sim ON sim.form = bank.form AND ra = bank.rn WHERE n >= {HELD + LEAST_REST} AND bank.rn <= {HELD}"""
)
def gate_scores(s, d):
    """For each rare word with enough contexts, its first two held against the rest of its bank of at most 60: the largest idf-weighted overlap of their content words, 0 without any."""
    r = rates(docs(s, d)).select("form", "n", "total", "per_million")
    content = F.array_except(F.array_distinct(F.filter(X.words(F.col("sentence")), lambda x: F.length(x) > 2)), F.array(*map(F.lit, X.STOPWORDS)))
    kept = first_of_key(good_sentences(docs(s, d))).select("doc_id", "sent_no", content.alias("ws"))
    hit = kept.select("doc_id", "sent_no", "ws", F.explode("ws").alias("form")).join(r.filter(F.col("per_million").between(LOW, HIGH)).select("form"), "form", "left_semi")
    w = Window.partitionBy("form")
    bank = written(hit.withColumns({"rn": F.row_number().over(w.orderBy("doc_id", "sent_no")), "n": F.count("*").over(w)}).filter((F.col("rn") <= BANK) & (F.col("n") >= HELD + LEAST_REST)))
    idf = r.select(F.col("form").alias("x"), F.log(F.col("total") / F.col("n")).alias("idf"))
    kw = bank.select("form", "rn", F.explode("ws").alias("x")).filter("x <> form").join(idf, "x", "left").withColumn("idf", F.coalesce("idf", F.lit(12.0)))
    per = kw.groupBy("form", "rn").agg(F.collect_list(F.struct("x", "idf")).alias("k"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))  # a sentence's words
    own = lambda x: F.transform(x, lambda y: y["x"])
    rest = per.filter(F.col("rn") > HELD).select("form", own(F.col("k")).alias("xs"), F.col("norm").alias("rest_norm"))
    both = per.filter(F.col("rn") <= HELD).join(rest, "form")
    dot = F.aggregate(F.filter("k", lambda y: F.array_contains("xs", y["x"])), F.lit(0.0), lambda a, y: a + y["idf"])
    best = both.groupBy("form", "rn").agg(F.max(dot / (F.col("norm") * F.col("rest_norm"))).alias("score"))
    return bank.filter(F.col("rn") <= HELD).select("form", "rn").join(best, ["form", "rn"], "left").select("form", F.col("rn").cast("int").alias("nth"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query(f"WITH t AS ({SQL['gate_sweep']}) SELECT cut, kept, blocked FROM t ORDER BY kept + blocked DESC, cut LIMIT 1")
def gate_best(s, d):
    """The cutoff that keeps and blocks most together, the lowest of equals."""
    from prosemill.plans.decision_queries import gate_sweep

    return gate_sweep(s, d).orderBy(F.desc(F.col("kept") + F.col("blocked")), "cut").limit(1)


@query(f"WITH {SCORED} SELECT count(*) AS pairs, round(count(*) FILTER (WHERE a.score > b.score) / count(*), 6) AS hit_rate FROM g a JOIN g b ON a.doc_id = b.doc_id WHERE a.c > 0 AND b.c > 0 AND a.target >= 0.8 AND b.target <= 0.2")
def gate_hit_rate(s, d):
    """How often a good candidate outscores a bad one of the same span."""
    x = scored(s, d).filter("c > 0")
    per = x.groupBy("doc_id").agg(F.collect_list(F.when(F.col("target") >= 0.8, F.col("score"))).alias("good"), F.collect_list(F.when(F.col("target") <= 0.2, F.col("score"))).alias("bad"))  # four candidates a span
    won = F.aggregate("good", F.lit(0), lambda a, g: a + F.size(F.filter("bad", lambda b: g > b)))
    return per.agg(F.sum(F.size("good") * F.size("bad")).cast("long").alias("pairs"), F.round(F.sum(won) / F.sum(F.size("good") * F.size("bad")), 6).alias("hit_rate"))


# Grades, gold values and splits

VALUES = [0.05, 0.2, 0.5, 0.8, 0.95]


@query(
    f"""WITH {SCORED}, v AS (SELECT doc_id, c, k, {_hex("'grade:' || doc_id || ':' || c || ':' || k", 2)} AS h FROM g, (SELECT unnest(range(0, 3)) AS k) WHERE c > 0), w AS (SELECT doc_id, c, k, CASE WHEN h % 8 = 0 THEN h // 8 % 5 ELSE {_hex("'one:' || doc_id || ':' || c", 2)} % 5 END AS grade FROM v WHERE h >= 16),
p AS (SELECT doc_id, c, count(*) AS n, count(DISTINCT grade) AS u, min(grade) AS grade, string_agg(grade, ',' ORDER BY grade) AS grades FROM w GROUP BY doc_id, c)
SELECT doc_id, string_agg(c || '=' || ({VALUES}::DOUBLE[])[grade + 1], ' ' ORDER BY c) FILTER (WHERE n = 3 AND u = 1) AS gold, string_agg(c || '=' || grades, ' ' ORDER BY c) FILTER (WHERE NOT (n = 3 AND u = 1)) AS unstable,
  round(1 - coalesce(max(({VALUES}::DOUBLE[])[grade + 1]) FILTER (WHERE n = 3 AND u = 1), 0), 3)::DOUBLE AS gold_identity_target FROM p GROUP BY doc_id"""
)
def gold_items(s, d):
    """Each span's candidates with three equal grades and their value, the others with the grades they got, and the identity's target."""
    h = hashed("grade:", "doc_id", "c", "k", digits=2)
    v = scored(s, d).filter("c > 0").select("doc_id", "c", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("h", h).filter("h >= 16")
    w = v.withColumn("grade", F.when(F.col("h") % 8 == 0, F.floor(F.col("h") / 8) % 5).otherwise(hashed("one:", "doc_id", "c", digits=2) % 5))
    p = w.groupBy("doc_id", "c").agg(F.count("*").alias("n"), F.min("grade").alias("a"), F.max("grade").alias("b"), F.array_sort(F.collect_list("grade")).alias("grades"))
    sure = F.expr("n = 3 AND a = b")
    value = F.element_at(F.array(*map(F.lit, VALUES)), (F.col("a") + 1).cast("int"))
    text = lambda of, x: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("c", x.alias("x"))))), lambda y: F.concat(y["c"], F.lit("="), y["x"])), " "), F.lit(""))
    return p.groupBy("doc_id").agg(
        text(sure, value.cast("string")).alias("gold"), text(~sure, F.array_join(F.col("grades").cast("array<string>"), ",")).alias("unstable"), F.round(1 - F.coalesce(F.max(F.when(sure, value)), F.lit(0.0)), 3).alias("gold_identity_target")
    )


@query(f"WITH {SCORED}, known AS (SELECT doc_id, c FROM g WHERE {_hex("'known:' || doc_id || ':' || c", 2)} % 3 = 0) SELECT doc_id, count(*) AS candidates FROM g SEMI JOIN known ON g.doc_id = known.doc_id AND g.c = known.c WHERE g.c > 0 GROUP BY doc_id")
def graded_candidates(s, d):
    """Candidates that have a grade; spans left with none drop out."""
    known = scored(s, d).filter(hashed("known:", "doc_id", "c", digits=2) % 3 == 0).select("doc_id", "c")
    return scored(s, d).filter("c > 0").join(known, ["doc_id", "c"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("candidates"))


SPLITS = f"""bw AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS form FROM benchmark) GROUP BY form), att AS ({SQL['attested_words']}),
ev AS (SELECT form, CASE WHEN k <= 20 THEN 'test' ELSE 'dev' END AS split FROM (SELECT form, row_number() OVER (ORDER BY md5('split:' || form), form) AS k FROM att) WHERE k <= 40), sw AS (SELECT bw.form AS form, n, coalesce(split, 'train') AS split FROM bw LEFT JOIN ev ON ev.form = bw.form)"""


def attested_splits(s, d) -> DataFrame:
    from prosemill.plans.evaluation_queries import attested_words

    words = table(s, d, "benchmark").select(F.explode_outer(X.words(F.col("text"))).alias("form")).filter("form is not null").groupBy("form").agg(F.count("*").alias("n"))
    picked = attested_words(s, d).select("form", F.md5(F.concat(F.lit("split:"), "form").cast("binary")).alias("h")).orderBy("h", "form").limit(40)  # forty rows
    held = picked.withColumn("k", F.row_number().over(Window.orderBy("h", "form"))).select("form", F.when(F.col("k") <= 20, "test").otherwise("dev").alias("split"))
    return words.join(F.broadcast(held), "form", "left").select("form", "n", F.coalesce("split", F.lit("train")).alias("split"))


@query(f"WITH {SPLITS} SELECT form, n, split FROM sw")
def attested_split(s, d):
    """Twenty test and twenty dev words of the better attested half; all other words train."""
    return attested_splits(s, d)


@query(f"WITH {SPLITS} SELECT split, count(*) AS words, CAST(sum(n) AS BIGINT) AS items, (SELECT count(*) FROM (SELECT form FROM sw GROUP BY form HAVING count(DISTINCT split) > 1)) AS overlap FROM sw GROUP BY split")
def split_report(s, d):
    """Words and items of each part, and how many words stand in more than one: none."""
    t = attested_splits(s, d)
    overlap = t.groupBy("form").agg(F.count_distinct("split").alias("m")).agg(F.count_if(F.col("m") > 1).alias("overlap"))
    return t.groupBy("split").agg(F.count("*").alias("words"), F.sum("n").alias("items")).join(F.broadcast(overlap))


# Jobs of a page pass

JOBS = f"""bl AS (SELECT page_id, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS nth FROM (SELECT page_id, {_BLOCKS} AS bs FROM pages)),
jp AS (SELECT page_id, nth, {pieces_sql('block', _ALTERNATION)} AS ps FROM bl WHERE len(regexp_extract_all(block, '[^\\s\\v]+')) >= 5),
jb AS (SELECT page_id, nth, i // 2 - 1 AS i, ps[i] AS surface, array_to_string(ps[1:i - 1], '') || '<t> ' || ps[i] || ' </t>' || array_to_string(ps[i + 1:], '') AS marked FROM (SELECT page_id, nth, ps, unnest(range(2, len(ps) + 1, 2)) AS i FROM jp)),
js AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY nth, i) - 1) // 12 AS batch, {_hex("'job:' || page_id || ':' || nth || ':' || i")} AS h, {_hex("'same:' || page_id || ':' || nth || ':' || i")} % 1000 AS same FROM jb)"""


def page_job_rows(s, d) -> DataFrame:
    """``page_id, nth, i, surface, marked, batch, h, same``: a job for each span of a block of five words or more, in batches of twelve a page."""
    b = table(s, d, "pages").select("page_id", F.posexplode_outer(P.blocks(F.col("html"))).alias("nth", "block")).filter(F.col("nth").isNotNull() & (F.regexp_count("block", F.lit(r"\S+")) >= 5))
    ps = b.select("page_id", F.col("nth").cast("long").alias("nth"), pieces(F.col("block"), [r[0] for r in RULES]).alias("ps"))
    side = lambda a, n: F.array_join(F.slice("ps", a, n), "")
    job = lambda x, i: F.struct(F.floor(i / 2).alias("i"), x.alias("surface"), F.concat(side(F.lit(1), i), F.lit("<t> "), x, F.lit(" </t>"), side(i + 2, F.size("ps"))).alias("marked"))
    odd = F.filter(F.transform("ps", lambda x, i: F.when(i % 2 == 1, job(x, i))), lambda x: x.isNotNull())
    j = ps.select("page_id", "nth", F.explode(odd).alias("j")).select("page_id", "nth", F.col("j.i").cast("long").alias("i"), "j.surface", "j.marked")
    batch = F.floor((F.row_number().over(Window.partitionBy("page_id").orderBy("nth", "i")) - 1) / 12)
    return j.withColumns({"batch": batch, "h": hashed("job:", "page_id", "nth", "i", digits=4), "same": hashed("same:", "page_id", "nth", "i", digits=4) % 1000})


@query(f"WITH {JOBS} SELECT page_id, nth, CAST(i AS BIGINT) AS i, surface, marked, batch FROM js")
def page_jobs(s, d):
    return page_job_rows(s, d).drop("h", "same")


@query(
    f"""WITH {JOBS}, rs AS (SELECT page_id, nth, i, h % 1000 / 1000 AS score, same / 1000 AS same FROM js WHERE h % 50 > 0), dec AS (SELECT js.page_id AS page_id, js.nth AS nth, js.i AS i, score, score >= 0.6 AND score > rs.same AS yes FROM js LEFT JOIN rs ON js.page_id = rs.page_id AND js.nth = rs.nth AND js.i = rs.i)
SELECT page_id, count(*) AS jobs, count(*) FILTER (WHERE score IS NULL) AS failed, count(*) FILTER (WHERE yes) AS accepted, CASE WHEN page_id % 7 = 0 THEN 0 ELSE count(*) FILTER (WHERE yes) END AS applied FROM dec GROUP BY page_id"""
)
def page_results(s, d):
    """Results joined to their jobs: a failed one (1 in 50) holds up no other; a span is accepted if its score reaches 0.6 and beats leaving it; a page that was switched off meanwhile (1 in 7) takes none."""
    j = page_job_rows(s, d)
    results = j.filter(F.col("h") % 50 > 0).select("page_id", "nth", "i", (F.col("h") % 1000 / 1000).alias("score"), (F.col("same") / 1000).alias("stay"))
    all_ = j.select("page_id", "nth", "i").join(results, ["page_id", "nth", "i"], "left")
    yes = (F.col("score") >= 0.6) & (F.col("score") > F.col("stay"))
    per = all_.groupBy("page_id").agg(F.count("*").alias("jobs"), F.count_if(F.col("score").isNull()).alias("failed"), F.count_if(yes).alias("accepted"))
    return per.withColumn("applied", F.when(F.col("page_id") % 7 == 0, F.lit(0)).otherwise(F.col("accepted")).cast("long"))


# Tokens of the scorer


@query(r"""SELECT conv_id, turn, len(ts) AS n, array_to_string(ts, ' ') AS tokens FROM (SELECT conv_id, turn, regexp_extract_all(regexp_replace(strip_accents(lower(regexp_replace(text, '[\p{Cc}\p{Cf}]', ' ', 'g'))), '\p{Mn}', '', 'g'), '[\p{P}$+<=>^`|~]|[^\s\v\p{Z}\p{P}$+<=>^`|~]+') AS ts FROM conversations)""")
def basic_tokens(s, d):
    """Turns as lower-cased tokens without accents, marks by themselves."""

    @F.pandas_udf("array<string>")
    def tokens(text):
        return text.map(lambda t: udfs.basic_tokens(t or ""))

    t = table(s, d, "conversations").select("conv_id", "turn", tokens("text").alias("ts"))
    return t.select("conv_id", "turn", F.size("ts").cast("long").alias("n"), F.array_join("ts", " ").alias("tokens"))


def piece_vocabulary(s, d, words: int = 2000) -> dict[str, int]:
    """Marks, letters and the corpus' most frequent forms: a vocabulary of bounded size."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    forms = [r["form"] for r in top_counts(counts(docs(s, d)), words).collect()]
    every = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "<t>", "</t>", *letters, *(f"##{x}" for x in letters), *".,;:!?'\"()-", *forms]
    return {w: i for i, w in enumerate(dict.fromkeys(every))}


@query()
def scorer_inputs(s, d):
    """Turns with their first span marked, beside the rule's word, as padded ids, types and mask of 64 places; held against a plain tokenizer in the tests."""
    most = 64
    t = table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    first = spans(t, [r[0] for r in RULES], "key").filter("n = 0").join(F.broadcast(rules(s).select("trigger", "replacement")), "trigger")
    j = t.join(first, "key")
    marked = F.concat(F.substring("text", F.lit(1), F.col("start")), F.lit("<t> "), "surface", F.lit(" </t>"), F.substring("text", F.col("start") + F.length("surface") + 1, F.length("text")))
    encode = udfs.pair_encoder(piece_vocabulary(s, d), most)
    e = j.select("key.*", "replacement", encode(marked, F.col("replacement")).alias("e"))
    return e.select("conv_id", "turn", "replacement", F.col("e.types").alias("types"), udfs.padded(F.col("e.ids"), F.lit(most)).alias("p")).select("conv_id", "turn", "replacement", "p.ids", "p.mask", "types")


@query()
def token_alignment(s, d):
    """Places at which words and the scorer's basic tokens of a turn are the same; held against a plain loop in the tests."""

    @F.pandas_udf("array<string>")
    def tokens(text):
        return text.map(lambda t: udfs.basic_tokens(t or ""))

    t = table(s, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("a"), tokens("text").alias("b"))
    return t.select("conv_id", "turn", F.size("a").alias("words"), F.size("b").alias("tokens"), F.size(udfs.align(F.col("a"), F.col("b"))).alias("aligned"))


# Reports


@query("SELECT event_type, round(avg(value), 6) AS ms FROM events GROUP BY event_type HAVING avg(value) <= (SELECT avg(value) FROM events)")
def latency_budget(s, d):
    """Kinds whose mean stays within the budget, here the mean of all."""
    e = table(s, d, "events")
    budget = e.agg(F.avg("value").alias("budget"))  # one row
    return e.groupBy("event_type").agg(F.avg("value").alias("mean")).join(F.broadcast(budget)).filter("mean <= budget").select("event_type", F.round("mean", 6).alias("ms"))


@query("SELECT lang, count(DISTINCT source) AS sources, list_has_all((SELECT list(DISTINCT source) FROM documents WHERE lang = 'en'), list(DISTINCT source)) AS within_en FROM documents GROUP BY lang")
def source_subset(s, d):
    """Whether all sources of a language are sources of English texts, too."""
    pairs = docs(s, d).select("lang", "source").distinct()
    en = pairs.filter("lang = 'en'").select("source", F.lit(True).alias("in_en"))
    return pairs.join(en, "source", "left").groupBy("lang").agg(F.count("*").alias("sources"), F.min(F.coalesce("in_en", F.lit(False))).alias("within_en"))


@query(
    f"""WITH a AS (SELECT role, {_hex("'tag:' || conv_id || ':' || turn", 1)} % 4 AS guess, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS truth, len(regexp_extract_all(text, '[^\\s\\v]+')) AS w FROM conversations)
SELECT count(*) AS n, round(avg(CASE WHEN guess = truth THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(count(*) FILTER (WHERE guess = truth AND truth < 2) / count(*) FILTER (WHERE truth < 2), 6) AS lexical, round(count(*) FILTER (WHERE guess = 0 AND truth <> 0) / count(*) FILTER (WHERE guess = 0), 6) AS false_match,
round(count(*) FILTER (WHERE guess <> 0 AND truth = 0) / count(*) FILTER (WHERE truth = 0), 6) AS missed, round(sum(CASE WHEN guess = truth THEN w ELSE 0 END) / sum(w), 6) AS weighted FROM a"""
)
def tagger_report(s, d):
    """Agreement of two taggings: over all, over the open classes, wrong and missed matches of one class, and weighted by words."""
    guess = hashed("tag:", "conv_id", "turn", digits=1) % 4
    a = table(s, d, "conversations").select(guess.alias("guess"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("truth"), F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    same, g, t = F.col("guess") == F.col("truth"), F.col("guess"), F.col("truth")
    share = lambda x, of: F.round(F.count_if(x & of) / F.count_if(of), 6)
    return a.agg(F.count("*").alias("n"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 6).alias("agreement"), share(same, t < 2).alias("lexical"), share(t != 0, g == 0).alias("false_match"), share(g != 0, t == 0).alias("missed"), F.round(F.sum(F.when(same, F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("weighted"))


@query(
    f"""WITH {RATES}, w AS (SELECT source, CAST(sum(len(regexp_extract_all(lower(text), '{W}'))) AS BIGINT) AS words, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY source), x AS (SELECT any_value(total) AS total, count(*) AS forms FROM r)
SELECT source, words, round(words / total, 6) AS share, round(bytes / words, 6) AS bytes_a_word, round(words / total * 1e9 * (bytes / words) / 1e9, 6) AS gb_at_1b, round(forms * sqrt(1e9 / total) * 0.15, 4) AS forms_low, round(forms * sqrt(1e9 / total) * 0.35, 4) AS forms_high FROM w, x"""
)
def source_projection(s, d):
    """Words and bytes of each source, what a billion words would take of it, and the bracket of the vocabulary kept."""
    w = docs(s, d).groupBy("source").agg(F.sum(F.size(X.words(F.col("text")))).cast("long").alias("words"), F.sum(F.octet_length("text")).alias("bytes"))
    x = counts(docs(s, d)).agg(F.sum("n").alias("total"), F.count("*").alias("forms"))  # one row
    grown = F.col("forms") * F.sqrt(F.lit(1e9) / F.col("total"))
    share, per = F.col("words") / F.col("total"), F.col("bytes") / F.col("words")
    return w.join(F.broadcast(x)).select("source", "words", F.round(share, 6).alias("share"), F.round(per, 6).alias("bytes_a_word"), F.round(share * 1e9 * per / 1e9, 6).alias("gb_at_1b"), F.round(grown * 0.15, 4).alias("forms_low"), F.round(grown * 0.35, 4).alias("forms_high"))


@query(f"SELECT w1, w2, n, llr FROM ({SQL['fixed_phrases']}) ORDER BY llr DESC, w1, w2 LIMIT 20")
def phrase_top(s, d):
    """The twenty phrases of the strongest association: the report's limit."""
    t = fixed_phrase_table(docs(s, d)).select("w1", "w2", "n", F.round("llr", 4).alias("llr"))
    return t.orderBy(F.desc("llr"), "w1", "w2").limit(20)


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Reports of one row each as one row."""
    out = rows[0]
    for row in rows[1:]:
        out = out.join(F.broadcast(row))
    return out


@query(f"SELECT * FROM ({SQL['classification_metrics']}), ({SQL['auc']}), ({SQL['top1_abstain']}), ({SQL['substitution_recall']}), ({SQL['operating_threshold'].replace(' AS recall', ' AS recall_at_threshold')})")
def model_report(s, d):
    """A scorer's figures in one row: accuracy, area, best option, proposed candidates, and the operating threshold."""
    from prosemill.plans import decision_queries as D
    from prosemill.plans import evaluation_queries as E

    return _side_by_side(D.classification_metrics(s, d), D.auc(s, d), D.top1_abstain(s, d), E.substitution_recall(s, d), D.operating_threshold(s, d).withColumnRenamed("recall", "recall_at_threshold"))


@query(f"SELECT a.words AS words, spans, a.swaps AS swaps, per_1k, distinct_swaps, median_gain, no_gain FROM ({SQL['delivery_rate']}) a, ({SQL['delivery_gain']}) b")
def delivery_report(s, d):
    """What a pass delivers, and what it gains, in one row."""
    from prosemill.plans import decision_queries as D
    from prosemill.plans import evaluation_queries as E

    return _side_by_side(D.delivery_rate(s, d), E.delivery_gain(s, d).drop("swaps"))


@query(f"SELECT *, (SELECT count(*) FROM ({SQL['collocations']})) AS collocations, (SELECT count(*) FROM ({SQL['fixed_phrases']})) AS phrases, (SELECT count(*) FROM ({SQL['names']})) AS names FROM ({SQL['coverage_report']})")
def finish_report(s, d):
    """Coverage of the rare words beside the sizes of the finished tables."""
    from prosemill.plans import corpus_queries as C
    from prosemill.plans import text_queries as T

    size = lambda df, name: df.agg(F.count("*").alias(name))
    uni, big = written(counts(docs(s, d))), C.frequent_pairs(docs(s, d))
    # Collocations are the frequent pairs up to the report's limit.
    collocations = size(big.limit(C.MOST_COLLOCATIONS), "collocations")
    return _side_by_side(C.coverage_row(s, d, uni), collocations, size(fixed_phrase_table(docs(s, d), big, uni), "phrases"), size(T.names(s, d), "names"))
