"""Book and thread texts, first swaps, page passes, votes, order statistics and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import pages as P
from prosemill.functions import text as X
from prosemill.operators import dedup, order, retention
from prosemill.plans.corpus_queries import CHOSEN, GREEDY, HITS, positioned, shingled
from prosemill.plans.decision_queries import _ALTERNATION, RULES, RULES_SQL, SCORED, SPANS, pieces, rules, scored, spans
from prosemill.plans.decision_queries import items as item_rows
from prosemill.plans.page_queries import _BLOCKS
from prosemill.plans.registry import SQL, query, table
from prosemill.plans.text_queries import ABBREV, CAP, HIGH, LOW, NOT_SPACE, RATES, REASON, SENTENCES, SPACE, W, _TO_FIX, articles_sql, articles_to_fix, band, bordered_sql, docs, pieces_sql, rates, spread, unbordered_sql


def hashed(prefix: str, *keys, digits: int = 8) -> Column:
    """A number from the first hexadecimal digits of a hash that every engine can compute."""
    parts = [F.lit(prefix)]
    for i, k in enumerate(keys):
        parts += [F.lit(":")] * (i > 0) + [(F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, digits), 16, 10).cast("long")


# Books and encyclopaedia texts

BOOK_START, BOOK_END = r"x\n*** START OF THE PROJECT GUTENBERG EBOOK N ***\nProduced by A\nB\n\n".replace("\\n", "\n"), "\n*** END OF THE PROJECT GUTENBERG EBOOK N ***\nlicence"
_nl = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"


@query(
    rf"""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_nl(BOOK_START)} || text || {_nl(BOOK_END)} ELSE text END AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?is)\A(?:.*?\n)??\s*\*\*\*\s*START OF (?:THIS |THE )?PROJECT GUTENBERG EBOOK[^\n]*?\*\*\*[ \t]*(\n|\z)', '\1') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(?ims)^\s*\*\*\*\s*END OF (?:THIS |THE )?PROJECT GUTENBERG EBOOK.*\z', '') AS t FROM b)
SELECT doc_id, regexp_replace(t, '(?ims)^\s*(?:Transcriber''?s? Note|Produced by|E-text prepared by)\b.*?(\n\s*\n)', '\1', 'g') AS body FROM c"""
)
def book_body(s, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(BOOK_START), "text", F.lit(BOOK_END))).otherwise(F.col("text"))
    return docs(s, d).select("doc_id", X.drop_frontmatter(X.strip_book_marks(t)).alias("body"))


@query(
    r"""SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '== See also ==' || chr(10) || 'more' ELSE text END,
'(?is)\n=*[ \t]*(?:References|External links|See also|Further reading|Notes|Footnotes|Bibliography|Sources|Citations)[ \t]*=*[ \t]*\n.*$', '') AS body FROM documents"""
)
def tail_sections(s, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n== See also ==\nmore"))).otherwise(F.col("text"))
    return docs(s, d).select("doc_id", X.drop_tail_sections(t).alias("body"))


# Sentences with offsets, as a page pass needs them


@query(
    rf"""
WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?][''")\]]?{SPACE}+)(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM documents),
p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k, len(ps) AS most FROM m),
h AS (SELECT *, regexp_replace(p, '[.!?][''")\]]?{SPACE}+$', '') AS head FROM p), l AS (SELECT *, regexp_replace(regexp_extract(head, '([A-Za-z][A-Za-z.]*)$', 1), '\.+$', '') AS prev FROM h),
g AS (SELECT *, coalesce(sum(CASE WHEN NOT ends_with(head, '..') AND (prev IN ({ABBREV}) OR regexp_matches(prev, '^[A-Z]$') OR contains(prev, '.')) THEN 0 ELSE 1 END) OVER b, 0) AS nth, coalesce(sum(length(p)) OVER b, 0) AS pos
  FROM l WINDOW b AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT doc_id, nth, min(pos) AS start, max(k) = any_value(most) AS final, string_agg(p, '' ORDER BY k) AS raw FROM g GROUP BY doc_id, nth)
SELECT doc_id, regexp_replace(raw, '^{SPACE}+|{SPACE}+$', '', 'g') AS sentence, CAST(start AS BIGINT) AS start, CAST(start + length(CASE WHEN final THEN raw ELSE regexp_replace(raw, '{SPACE}+$', '') END) AS BIGINT) AS stop
FROM r WHERE len(regexp_extract_all(raw, '{NOT_SPACE}+')) >= 5"""
)
def offset_sentences(s, d):
    """Sentences of five tokens or more with their offsets in the running text."""
    found = order.sentences_with_offsets(spread(docs(s, d).select("doc_id", "text"))).filter(X.token_count(F.col("sentence")) >= 5)
    return found.select("doc_id", "sentence", "start", F.col("end").alias("stop"))


# Pasted threads

def _mended(x: str) -> str:
    for damaged, mark in P.MOJIBAKE:
        x = f"replace({x}, '{damaged}', '{mark.replace(chr(39), chr(39) * 2)}')"
    return x


THREADS = rf"""
th AS (SELECT conv_id, string_agg('u/' || role || chr(10) || text || chr(10) || '3 more replies', chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
ln AS (SELECT conv_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM (SELECT conv_id, regexp_split_to_array(t, '\r\n|\n|\r') AS ls FROM th)),
tr AS (SELECT conv_id, k, regexp_replace(raw, '^{SPACE}+|{SPACE}+$', '', 'g') AS x FROM ln),
fl AS (SELECT *, x = '' OR lower(x) IN ({", ".join("'" + c + "'" for c in P.CHROME)}) OR regexp_matches(x, '{P.LINE}') OR regexp_matches(lower(x), '{P.LOWERED}')
  OR (regexp_matches(x, '{P.USER}') AND NOT contains(x, ' ') AND length(x) < 21) AS page FROM tr),
isl AS (SELECT *, sum(CASE WHEN page THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS island FROM fl),
cm AS (SELECT conv_id, island, regexp_replace({_mended("string_agg(x, ' ' ORDER BY k)")}, '^{SPACE}+|{SPACE}+$', '', 'g') AS comment FROM isl WHERE NOT page GROUP BY conv_id, island),
comments AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1 AS nth, comment, len(regexp_extract_all(comment, '[^\s\v]+')) AS words FROM cm WHERE len(regexp_extract_all(comment, '[^\s\v]+')) >= 2)"""


def thread_rows(s, d) -> DataFrame:
    """Comments of the conversations pasted as threads: ``conv_id, nth, comment, words``."""
    turn = F.concat(F.lit("u/"), "role", F.lit("\n"), "text", F.lit("\n3 more replies"))
    threads = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    c = threads.select("conv_id", F.posexplode_outer(P.comments(F.col("t"))).alias("nth", "comment")).filter("nth is not null")
    return c.select("conv_id", F.col("nth").cast("long").alias("nth"), "comment", F.regexp_count("comment", F.lit(r"\S+")).cast("long").alias("words"))


@query(f"WITH {THREADS} SELECT conv_id, nth, comment FROM comments")
def thread_comments(s, d):
    return thread_rows(s, d).drop("words")


@query(
    f"""WITH {THREADS}, r AS (SELECT conv_id % 10 AS part, words, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY words) - 1 AS i, count(*) OVER (PARTITION BY conv_id % 10) AS n FROM comments)
SELECT part, count(*) AS comments, CAST(sum(words) AS BIGINT) AS words, max(words) FILTER (WHERE i = n // 2) AS median_words FROM r GROUP BY part"""
)
def thread_stats(s, d):
    """Comments, words and the upper median of a comment's words."""
    c = thread_rows(s, d).withColumn("part", F.col("conv_id") % 10)
    median = order.at_index(c, ["part"], "words", lambda n: F.floor(n / 2), F.floor(F.col("words") / 64), "median_words")
    return c.groupBy("part").agg(F.count("*").alias("comments"), F.sum("words").alias("words")).join(median, "part")


# Rates of phrases, tags


@query(
    f"""WITH {RATES}, w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS form FROM benchmark)
SELECT item_id, round(coalesce(min(coalesce(r.n, 0)) FILTER (WHERE w.form IS NOT NULL), 0) / (SELECT any_value(total) FROM r) * 1e6, 6) AS per_million FROM benchmark LEFT JOIN w USING (item_id) LEFT JOIN r ON r.form = w.form GROUP BY item_id"""
)
def phrase_rate(s, d):
    """The rate of a phrase is its rarest word's; 0 for an unseen word or none at all."""
    c = rates(docs(s, d)).select("form", "n", "total")
    total = docs(s, d).agg(F.coalesce(F.sum(F.size(X.words(F.col("text")))), F.lit(0)).alias("total"))  # one row
    w = table(s, d, "benchmark").select("item_id", F.explode_outer(F.array_distinct(X.words(F.col("text")))).alias("form"))
    least = w.join(c.select("form", "n"), "form", "left").groupBy("item_id").agg(F.min(F.when(F.col("form").isNotNull(), F.coalesce("n", F.lit(0)))).alias("n"))
    return least.join(F.broadcast(total)).select("item_id", F.round(F.coalesce("n", F.lit(0)) / F.col("total") * 1e6, 6).alias("per_million"))


TAGS = ["Verb", "Noun", "PastTense", "Adjective", "ProperNoun", "Copula", "Pronoun", "Value"]
_UNIVERSAL = " ".join(f"WHEN list_contains(tags, '{t}') THEN '{u}'" for t, u in X.UNIVERSAL)


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_filter({TAGS}, lambda x: ('0x' || substr(md5('tag:' || conv_id || ':' || turn || ':' || x), 1, 2))::BIGINT % 6 = 0) AS tags FROM conversations)
SELECT conv_id, turn, CASE {_UNIVERSAL} ELSE 'X' END AS pos FROM t"""
)
def universal_tags(s, d):
    tags = F.filter(F.array(*map(F.lit, TAGS)), lambda x: hashed("tag:", "conv_id", "turn", x, digits=2) % 6 == 0)
    return table(s, d, "conversations").select("conv_id", "turn", tags.alias("tags")).select("conv_id", "turn", X.universal_pos(F.col("tags")).alias("pos"))


# First swaps and the review sheet

GLOSSES = {"oferwhennt": "of a place", "ofre": "made from", "inonly": "within"}
SWAPPED = rf"""{RULES_SQL}, tx AS (SELECT conv_id, turn, {_TO_FIX} AS t FROM conversations),
bt AS (SELECT conv_id, turn, t, {bordered_sql('t')} AS b FROM tx), mt AS (SELECT conv_id, turn, t, b, trigger, replacement AS r, chr(2) || '(?i:' || replace(trigger, ' ', chr(3) || ' ' || chr(2)) || ')' || chr(3) AS pattern FROM bt, rules),
fd AS (SELECT *, {unbordered_sql("regexp_extract(b, pattern)")} AS found FROM mt WHERE regexp_matches(b, pattern)),
sw AS (SELECT *, {unbordered_sql("regexp_replace(b, pattern, CASE WHEN found[1] <> lower(found[1]) THEN upper(r[1]) || lower(r[2:]) ELSE r END)")} AS x FROM fd),
swapped AS (SELECT conv_id, turn, trigger, r AS replacement, t AS original, {articles_sql(bordered_sql('x'))} AS swapped FROM sw)"""


def swapped_turns(s, d) -> DataFrame:
    """Each rule that fits a turn, with the turn before and after. All rules are tried inside the row, so that a turn's text is made once and each rule keeps its own pattern."""

    def tried(x: Column) -> Column:
        swap = lambda a, b: F.when(F.contains(x["low"], F.lit(a)), X.swap_first(x["t"], F.lit(a), F.lit(b)))
        every = F.array(*(F.struct(x["t"].alias("original"), F.lit(a).alias("trigger"), F.lit(b).alias("replacement"), swap(a, b).alias("swapped")) for a, b, *_ in RULES))
        return F.filter(every, lambda r: r["swapped"].isNotNull())

    found = X.let(articles_to_fix(F.col("text")), lambda t: X.let(F.struct(t.alias("t"), F.lower(t).alias("low")), tried))
    return table(s, d, "conversations").select("conv_id", "turn", F.explode_outer(found).alias("r")).filter("r is not null").select("conv_id", "turn", "r.*")


@query(f"WITH {SWAPPED} SELECT conv_id, turn, trigger, replacement, swapped FROM swapped")
def first_swap(s, d):
    return swapped_turns(s, d).drop("original")


@query(
    f"""WITH {SWAPPED}, gl(replacement, gloss) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in GLOSSES.items())})
SELECT conv_id, turn, trigger, conv_id || '.' || turn || chr(9) || replacement || ' (' || coalesce(gloss, 'no gloss') || ')' || chr(10) || 'was: ' || original || chr(10) || 'now: ' || swapped AS sheet FROM swapped LEFT JOIN gl USING (replacement)"""
)
def review_sheet(s, d):
    """What a human judge reads: the gloss, if there is one, and the turn before and after."""
    glosses = s.createDataFrame(list(GLOSSES.items()), "replacement string, gloss string")
    j = swapped_turns(s, d).join(F.broadcast(glosses), "replacement", "left")
    sheet = F.concat("conv_id", F.lit("."), "turn", F.lit("\t"), "replacement", F.lit(" ("), F.coalesce("gloss", F.lit("no gloss")), F.lit(")\nwas: "), "original", F.lit("\nnow: "), "swapped")
    return j.select("conv_id", "turn", "trigger", sheet.alias("sheet"))


@query(
    f"""WITH i AS ({SQL["items"]}), p AS (SELECT doc_id, n, concat_ws(chr(10), 'item: ' || doc_id || '.' || n, 'text with a gap: ' || blanked, 'in the gap: ' || surface, 'meaning there: ' || replacement, 'word taught: ' || replacement || ' - ?', 'options: ' || replacement || '; ' || easy || '; ' || surface) AS prompt FROM i)
SELECT doc_id, n, prompt, round(length(prompt) / 4 / 1e6 * 5 / 2 + 100 / 1e6 * 25 / 2, 9) AS cost FROM p"""
)
def grading_prompts(s, d):
    """Items as a grader reads them, and what a batch of them costs at four characters a token."""
    i = item_rows(s, d)
    p = i.select("doc_id", "n", X.prompt(F.concat_ws(".", F.col("doc_id").cast("string"), F.col("n").cast("string")), F.col("blanked"), F.col("surface"), F.col("replacement"), F.col("replacement"), F.lit("?"), F.array("replacement", "easy", "surface")).alias("prompt"))
    return p.withColumn("cost", F.round(X.batch_cost(F.length("prompt") / 4, F.lit(100), 5, 25), 9))


# The page pass: blocks, spans, scores, decisions, swaps, and the way back

PARTS = rf"""bl AS (SELECT page_id, unnest(bs) AS block, generate_subscripts(bs, 1) - 1 AS nth FROM (SELECT page_id, {_BLOCKS} AS bs FROM pages)),
pt AS (SELECT page_id, nth, block, {pieces_sql('block', _ALTERNATION)} AS ps FROM bl),
pc AS (SELECT page_id, nth, block, i, ps[i] AS x, i % 2 = 0 AND ('0x' || substr(md5('page:' || page_id || ':' || nth || ':' || (i - 1)), 1, 8))::BIGINT % 1000 >= 600 AS taken FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM pt)),
sp AS (SELECT page_id, nth, pc.block AS block, i, taken, x AS original, CASE WHEN NOT taken THEN x WHEN x[1] <> lower(x[1]) THEN upper(replacement[1]) || replacement[2:] ELSE replacement END AS shown FROM pc LEFT JOIN rules ON taken AND trigger = lower(x))"""


def page_pieces(s, d) -> DataFrame:
    """Blocks of pages as arrays of ``original, shown, taken``: what stood there, what stands there now, and whether it is a swap. All inside the row."""
    b = table(s, d, "pages").select("page_id", F.posexplode_outer(P.blocks(F.col("html"))).alias("nth", "block")).filter("nth is not null")
    to = F.create_map(*(F.lit(x) for t, r, *_ in RULES for x in (t, r)))
    ps = b.select("page_id", F.col("nth").cast("long").alias("nth"), "block", pieces(F.col("block"), [r[0] for r in RULES]).alias("ps"))
    scored_ = F.transform("ps", lambda x, i: F.struct(x.alias("original"), ((i % 2 == 1) & (hashed("page:", "page_id", "nth", i) % 1000 >= 600)).alias("taken")))
    shown = lambda x: F.struct(x["original"].alias("original"), x["taken"].alias("taken"), F.when(x["taken"], X.match_case(x["original"], F.element_at(to, F.lower(x["original"])))).otherwise(x["original"]).alias("shown"))
    return ps.select("page_id", "nth", "block", scored_.alias("ps")).select("page_id", "nth", "block", F.transform("ps", shown).alias("ps"))


@query(f"WITH {RULES_SQL}, {PARTS} SELECT page_id, nth, string_agg(shown, '' ORDER BY i) AS shown, count(*) FILTER (WHERE taken) AS swaps FROM sp GROUP BY page_id, nth")
def page_pass(s, d):
    """Every block with its accepted swaps, and how many they are."""
    return page_pieces(s, d).select("page_id", "nth", F.array_join(F.transform("ps", lambda x: x["shown"]), "").alias("shown"), F.size(F.filter("ps", lambda x: x["taken"])).cast("long").alias("swaps"))


@query(f"WITH {RULES_SQL}, {PARTS} SELECT page_id, nth, any_value(block) AS reverted, count(*) FILTER (WHERE taken) AS undone FROM sp GROUP BY page_id, nth")
def page_revert(s, d):
    """Every swap back to what it stored: the block as it was."""
    return page_pieces(s, d).select("page_id", "nth", F.array_join(F.transform("ps", lambda x: x["original"]), "").alias("reverted"), F.size(F.filter("ps", lambda x: x["taken"])).cast("long").alias("undone"))


# Votes, teachers and order statistics


@query(f"WITH {SCORED} SELECT count(*) FILTER (WHERE target >= 0.8) AS good, count(*) FILTER (WHERE target <= 0.2) AS bad, round(count(*) FILTER (WHERE target >= 0.8 AND score >= 0.5) / count(*) FILTER (WHERE target >= 0.8), 6) AS sub_recall, round(count(*) FILTER (WHERE target <= 0.2 AND score >= 0.5) / count(*) FILTER (WHERE target <= 0.2), 6) AS sub_fp FROM g WHERE c > 0")
def substitution_recall(s, d):
    """Recall and false positives over proposed candidates only."""
    x, hit, good, bad = scored(s, d).filter("c > 0"), F.col("score") >= 0.5, F.col("target") >= 0.8, F.col("target") <= 0.2
    rate = lambda of: F.round(F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), 6)
    return x.agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"), rate(good).alias("sub_recall"), rate(bad).alias("sub_fp"))


_VOTES = "v AS (SELECT doc_id, c, k, ('0x' || substr(md5('vote:' || doc_id || ':' || c || ':' || k), 1, 2))::BIGINT AS h FROM g, (SELECT unnest(range(0, 3)) AS k)), kept AS (SELECT doc_id, c, h % 3 AS grade FROM v WHERE h >= 16)"


@query(f"WITH {SCORED}, {_VOTES}, p AS (SELECT doc_id, c, CASE WHEN count(*) < 3 THEN 0 ELSE count(DISTINCT grade) END AS distinct_grades FROM kept GROUP BY doc_id, c) SELECT distinct_grades, count(*) AS n FROM p GROUP BY distinct_grades")
def vote_histogram(s, d):
    """Candidates by their number of distinct grades among three votes; 0 stands for fewer votes, which are unstable."""
    v = scored(s, d).select("doc_id", "c", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("h", hashed("vote:", "doc_id", "c", "k", digits=2)).filter("h >= 16")
    per = v.groupBy("doc_id", "c").agg(F.count("*").alias("n"), F.size(F.collect_set(F.col("h") % 3)).cast("long").alias("u"))
    return per.groupBy(F.when(F.col("n") < 3, F.lit(0).cast("long")).otherwise(F.col("u")).alias("distinct_grades")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SCORED}, te AS (SELECT doc_id, c, ('0x' || substr(md5('teach:' || doc_id || ':' || c), 1, 4))::BIGINT AS h FROM g), known AS (SELECT doc_id, c, h % 1000 / 1000 AS p FROM te WHERE h % 4 > 0)
SELECT g.doc_id AS doc_id, g.c AS c, CAST(coalesce(p, 0) AS DOUBLE) AS teacher FROM g LEFT JOIN known ON g.doc_id = known.doc_id AND g.c = known.c"""
)
def teacher_targets(s, d):
    """Every candidate, the identity option (0) among them, with the teacher's probability, 0 where it has none."""
    h = hashed("teach:", "doc_id", "c", digits=4)
    known = scored(s, d).filter(h % 4 > 0).select("doc_id", "c", (h % 1000 / 1000).alias("p"))
    return scored(s, d).select("doc_id", "c").join(known, ["doc_id", "c"], "left").select("doc_id", "c", F.coalesce("p", F.lit(0.0)).alias("teacher"))


@query(
    f"""WITH {SCORED}, x AS (SELECT score >= 0.5 AS hit, target, [0.05, 0.2, 0.5, 0.8, 0.95][('0x' || substr(md5('gold:' || doc_id || ':' || c), 1, 4))::BIGINT % 5 + 1]::DOUBLE AS gold FROM g WHERE c > 0),
y AS (SELECT count(*) FILTER (WHERE target >= 0.8 AND hit OR target <= 0.2 AND NOT hit) / count(*) FILTER (WHERE target >= 0.8 OR target <= 0.2) AS a, count(*) FILTER (WHERE gold >= 0.8 AND hit OR gold <= 0.2 AND NOT hit) / count(*) FILTER (WHERE gold >= 0.8 OR gold <= 0.2) AS b,
count(*) FILTER (WHERE gold = target) / count(*) AS agreement FROM x) SELECT round(a, 6) AS teacher_accuracy, round(b, 6) AS gold_accuracy, round(b - a, 6) AS delta, round(agreement, 6) AS agreement FROM y"""
)
def gold_delta(s, d):
    """Accuracy against the teacher's labels and against gold ones, and how often the two agree."""
    grades = F.array(*(F.lit(x) for x in (0.05, 0.2, 0.5, 0.8, 0.95)))
    x = scored(s, d).filter("c > 0").withColumn("gold", F.element_at(grades, (hashed("gold:", "doc_id", "c", digits=4) % 5 + 1).cast("int")))
    right = lambda t: F.count_if(((F.col(t) >= 0.8) & (F.col("score") >= 0.5)) | ((F.col(t) <= 0.2) & (F.col("score") < 0.5))) / F.count_if((F.col(t) >= 0.8) | (F.col(t) <= 0.2))
    y = x.agg(right("target").alias("a"), right("gold").alias("b"), (F.count_if(F.col("gold") == F.col("target")) / F.count("*")).alias("agreement"))
    return y.select(F.round("a", 6).alias("teacher_accuracy"), F.round("b", 6).alias("gold_accuracy"), F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.round("agreement", 6).alias("agreement"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE i = n // 2) AS median, max(value) FILTER (WHERE i = n * 95 // 100) AS p95 FROM r GROUP BY event_type"""
)
def latency_ranks(s, d):
    """The values at places n / 2 and 0.95 n of the sorted ones, without interpolation."""
    e, whole = table(s, d, "events"), order.log_bin(F.col("value"))
    median = order.at_index(e, ["event_type"], "value", lambda n: F.floor(n / 2), whole, "median")
    return median.join(order.at_index(e, ["event_type"], "value", lambda n: F.floor(n * 95 / 100), whole, "p95"), "event_type")


@query(
    f"""WITH c AS (SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS form FROM benchmark) GROUP BY form),
m AS (SELECT n AS median FROM (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS i, count(*) OVER () AS k FROM c) WHERE i = k // 2) SELECT form, n FROM c, m WHERE n >= median"""
)
def attested_words(s, d):
    """Words in the better attested half: with at least as many rows as the word in the middle of the descending list."""
    c = table(s, d, "benchmark").select(F.explode_outer(X.words(F.col("text"))).alias("form")).filter("form is not null").groupBy("form").agg(F.count("*").alias("n"))
    median = order.at_index(c.withColumn("one", F.lit(1)), ["one"], "n", lambda k: k - 1 - F.floor(k / 2), F.floor(F.log2("n")), "median").select("median")  # one row
    return c.join(F.broadcast(median)).filter("n >= median").select("form", "n")


# Delivery


DELIVERED = f"""{SPANS}, {RULES_SQL}, {RATES}, dl AS (SELECT trigger, replacement, count(*) AS n FROM spans JOIN rules USING (trigger) WHERE ('0x' || substr(md5(doc_id || ':' || n), 1, 8))::BIGINT % 1000 >= 600 GROUP BY trigger, replacement),
gains AS (SELECT trigger, replacement, dl.n AS n, log2(a.per_million / b.per_million) AS gain FROM dl LEFT JOIN r a ON a.form = trigger LEFT JOIN r b ON b.form = replacement)"""


def delivered(s, d) -> DataFrame:
    """Accepted swaps by rule, with the gain in rarity where both sides have a rate."""
    taken = spans(docs(s, d), [r[0] for r in RULES]).filter(hashed("", "doc_id", "n") % 1000 >= 600).groupBy("trigger").agg(F.count("*").alias("n"))
    r = rates(docs(s, d)).select("form", "per_million")
    named = taken.join(F.broadcast(rules(s).select("trigger", "replacement")), "trigger")
    j = named.join(r.select(F.col("form").alias("trigger"), F.col("per_million").alias("a")), "trigger", "left").join(r.select(F.col("form").alias("replacement"), F.col("per_million").alias("b")), "replacement", "left")
    return j.select("trigger", "replacement", "n", F.log2(F.col("a") / F.col("b")).alias("gain"))


@query(f"WITH {DELIVERED} SELECT trigger, replacement, n, round(gain, 6) AS gain FROM gains ORDER BY n DESC, trigger LIMIT 15")
def delivered_swaps(s, d):
    """The fifteen most frequent swaps: the report's limit."""
    return delivered(s, d).withColumn("gain", F.round("gain", 6)).orderBy(F.desc("n"), "trigger").limit(15)


@query(
    f"""WITH {DELIVERED}, e AS (SELECT gain, sum(n) OVER (ORDER BY gain, trigger) AS upto, n, sum(n) OVER () AS k FROM gains WHERE gain IS NOT NULL)
SELECT CAST(any_value(k) AS BIGINT) AS swaps, round(max(gain) FILTER (WHERE upto > k // 2 AND upto - n <= k // 2), 6) AS median_gain, round(sum(CASE WHEN gain < 1 THEN n ELSE 0 END) / any_value(k), 6) AS no_gain FROM e"""
)
def delivery_gain(s, d):
    """Upper median of the swaps' gains and the share that gains less than a factor of two, from one row a rule."""
    g = delivered(s, d).filter("gain is not null")  # as many rows as rules
    every = g.groupBy("gain").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("gain", "n"))).alias("l"), F.sum("n").alias("swaps"), F.sum(F.when(F.col("gain") < 1, F.col("n")).otherwise(0)).alias("few"))
    upto = F.transform("l", lambda x, i: F.struct(x["gain"].alias("gain"), F.aggregate(F.slice("l", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
    return every.select("swaps", F.round(F.filter(upto, lambda x: x["upto"] > F.floor(F.col("swaps") / 2))[0]["gain"], 6).alias("median_gain"), F.round(F.col("few") / F.col("swaps"), 6).alias("no_gain"))


# Bands with priority words

PRIORITY = f"priority AS (SELECT DISTINCT form FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS form FROM benchmark) WHERE length(form) > 6)"


def priority(s, d) -> DataFrame:
    return table(s, d, "benchmark").select(F.explode_outer(X.words(F.col("text"))).alias("form")).filter("length(form) > 6").distinct()


@query(f"WITH {RATES}, {PRIORITY} SELECT coalesce(b.form, p.form) AS form, b.form IS NULL AS forced FROM (SELECT form FROM r WHERE per_million BETWEEN {LOW} AND {HIGH}) b FULL JOIN priority p ON b.form = p.form")
def target_words(s, d):
    """The band and the priority words; those outside the band are forced."""
    both = band(docs(s, d)).select("form", F.lit(True).alias("in_band")).unionByName(priority(s, d).select("form", F.lit(False).alias("in_band")))
    return both.groupBy("form").agg((~F.max("in_band")).alias("forced"))


@query(
    f"""WITH {SENTENCES}, {REASON}, {RATES}, {PRIORITY}, band AS (SELECT form FROM r WHERE per_million BETWEEN {LOW} AND {HIGH} UNION SELECT form FROM priority), {HITS}, {CHOSEN}, per AS (SELECT form, count(*) AS n FROM hits SEMI JOIN chosen USING (pos) GROUP BY form)
SELECT form, coalesce(n, 0) AS contexts, coalesce(n, 0) >= 2 AS shippable, coalesce(n, 0) >= {CAP} AS at_cap FROM priority LEFT JOIN per USING (form)"""
)
def priority_report(s, d):
    """Contexts kept for each priority word, the uncovered ones included."""
    words = dedup.written(target_words(s, d).select("form"))
    per = retention.coverage_hits(positioned(s, d), words, CAP).groupBy("form").agg(F.count("*").alias("contexts"))
    known = priority(s, d).join(per, "form", "left").select("form", F.coalesce("contexts", F.lit(0)).alias("contexts"))
    return known.select("form", "contexts", (F.col("contexts") >= 2).alias("shippable"), (F.col("contexts") >= CAP).alias("at_cap"))


@query(f"WITH RECURSIVE {GREEDY} SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS near_duplicates, round(count(*) / (SELECT count(*) FROM documents), 6) AS rate FROM dropped")
def near_duplicate_rate(s, d):
    """Share of documents that first-wins near-deduplication at 0.8 drops."""
    near = dedup.near_first_wins(shingled(s, d))
    return near.agg(F.count("*").alias("docs"), F.count_if(~F.col("kept")).alias("near_duplicates")).withColumn("rate", F.round(F.col("near_duplicates") / F.col("docs"), 6))
