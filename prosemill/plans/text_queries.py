"""Text functions, gates, segmentation and frequencies over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.functions import udfs
from prosemill.operators.scratch import written
from prosemill.plans.registry import query, table

W = "[A-Za-z]+(?:[''-][A-Za-z]+)*"  # in SQL quotes
TOKENS = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS form FROM documents"
SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = "[^" + SPACE[1:]


def docs(s, d):
    return table(s, d, "documents")


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{W}')) AS n_words, array_to_string(regexp_extract_all(lower(text), '{W}'), ' ') AS joined FROM documents")
def text_words(s, d):
    w = X.words(F.col("text"))
    return docs(s, d).select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("joined"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{NOT_SPACE}+')) AS n_tokens FROM documents")
def text_token_count(s, d):
    return docs(s, d).select("doc_id", X.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(rf"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\p{{L}}]|{SPACE}', '', 'g')) / length(text) ELSE 1 END, 9) AS ratio FROM documents")
def nonalpha_ratio(s, d):
    return docs(s, d).select("doc_id", F.round(X.nonalpha_ratio(F.col("text")), 9).alias("ratio"))


def normalized_sql(text: str) -> str:
    """The steps of ``udfs.normalized``. The canonical form stands for the compatibility form: the marks in which both differ in these tables are folded anyway."""
    t = f"translate(nfc_normalize({text}), '‘’‚‛“”„‟–‒' || chr(160), repeat(chr(39), 4) || repeat(chr(34), 4) || '-- ')"
    for mark, to in (("—", "--"), ("―", "--"), ("…", "..."), ("\u200b", "")):
        t = f"replace({t}, '{mark}', '{to}')"
    w = X.LETTER
    for pattern, to in (
        (r"https?://[^\s\v]+|www\.[^\s\v]+", " "),
        (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", " "),
        (r"\b(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", " "),
        (rf"(^|[^{w[1:-1]}])(?:[@/][ur]/{w}+|@{w}{{2,}})", r"\1 "),
        (rf"({w})--+({w})", r"\1 -- \2"),
        (rf"({w})--+({w})", r"\1 -- \2"),  # a single letter between two dashes
        (r"[ \t]+", " "),
        (rf"{SPACE}+([,.;:!?%)\]}}])", r"\1"),
        (rf"([(\[{{]){SPACE}+", r"\1"),
        (r" *\n *", "\n"),
        (rf"^{SPACE}+|{SPACE}+$", ""),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


@query(f"SELECT doc_id, {normalized_sql('text')} AS clean FROM documents")
def normalize_text(s, d):
    return docs(s, d).select("doc_id", udfs.normalized(F.col("text")).alias("clean"))


@query(f"SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({normalized_sql('text')}), '{W}')) AS form FROM documents) GROUP BY form")
def corpus_word_frequency(s, d):
    """Counts over whole normalised documents of all languages."""
    return counts(spread(docs(s, d)).withColumn("text", udfs.normalized(F.col("text"))))


@query(rf"SELECT doc_id, regexp_replace(replace(text, ' of ', '-' || chr(10) || ' '), '({X.LETTER})-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g') AS joined FROM documents")
def rejoin_hyphen(s, d):
    return docs(s, d).select("doc_id", X.rejoin_hyphenation(F.replace("text", F.lit(" of "), F.lit("-\n "))).alias("joined"))


@query(r"SELECT doc_id, regexp_replace(replace(text, ' the ', ' _the_ '), '_([^_\n]{1,80})_', '\1', 'g') AS plain FROM documents")
def strip_emphasis(s, d):
    return docs(s, d).select("doc_id", X.strip_emphasis(F.replace("text", F.lit(" the "), F.lit(" _the_ "))).alias("plain"))


@query(
    r"""
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS t FROM documents),
b AS (SELECT doc_id, t, len(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '\S'))) / len(string_split(t, chr(10))) AS blank FROM a)
SELECT doc_id, CASE WHEN blank < 0.35 THEN t ELSE replace(regexp_replace(regexp_replace(t, '\n\s*\n\s*\n+', chr(1), 'g'), '\n\s*\n', chr(10), 'g'), chr(1), chr(10) || chr(10)) END AS tight FROM b"""
)
def collapse_spacing(s, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    return docs(s, d).withColumn("t", t).select("doc_id", X.collapse_double_spacing(F.col("t")).alias("tight"))


@query(
    r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS k FROM documents),
l AS (SELECT doc_id, k, list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM p),
j AS (SELECT doc_id, k, array_to_string(list_transform(ls, lambda x, i: x || CASE WHEN i = len(ls) THEN '' WHEN length(x) < 45 AND regexp_matches(x, '[.!?:][''")\]]?$') THEN chr(10) ELSE ' ' END), '') AS t FROM l WHERE len(ls) > 0)
SELECT d.doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k), '') AS unwrapped FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id"""
)
def unwrap_paragraphs(s, d):
    return docs(s, d).select("doc_id", X.unwrap_paragraphs(F.col("text")).alias("unwrapped"))


@query(
    r"""
SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:pre|code)\b.*?</(?:pre|code)>', ' ', 'g'), '(?is)<blockquote\b.*?</blockquote>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS body FROM pages"""
)
def strip_html(s, d):
    return table(s, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


@query(
    r"""
WITH a AS (SELECT o_orderkey, 'Release Date: ' || strftime(o_orderdate, '%Y-%m-%d') AS h, 'in ' || strftime(o_orderdate, '%Y') || ' or 1650' AS g FROM orders)
SELECT o_orderkey, CAST(regexp_extract(h, '(?:Release Date|Posting Date)[^\n]*?(\d{4})', 1) AS INT) AS release_year, list_min(list_transform(regexp_extract_all(g, '\b(1[6-9]\d{2}|20[0-2]\d)\b', 1), lambda x: CAST(x AS INT))) AS least_year,
  CAST(list_last(regexp_extract_all(g, '1[0-9]{3}|20[0-2][0-9]')) AS INT) AS author_year FROM a"""
)
def year_extract(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("Release Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("h"), F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit(" or 1650")).alias("g"))
    return o.select("o_orderkey", X.guess_year(F.col("h")).alias("release_year"), X.guess_year(F.col("g")).alias("least_year"), X.author_year(F.col("g")).alias("author_year"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')) AS key FROM documents")
def exact_key(s, d):
    return docs(s, d).select("doc_id", X.exact_key(F.col("text")).alias("key"))


PLAIN = "[a-z0-9'']+"  # in SQL quotes
SHINGLES = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '{PLAIN}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0))"""


@query(f"WITH {SHINGLES} SELECT w.doc_id, count(x) AS n_shingles, min(md5(x)) AS least FROM w LEFT JOIN sh ON w.doc_id = sh.doc_id GROUP BY w.doc_id")
def shingles(s, d):
    # The words are a column of their own: an expression inside a lambda runs once for each element.
    sh = docs(s, d).select("doc_id", X.plain_tokens(F.col("text")).alias("w")).select("doc_id", X.shingles(F.col("w")).alias("sh"))
    return sh.select("doc_id", F.size("sh").cast("long").alias("n_shingles"), F.array_min(F.transform("sh", lambda x: F.md5(x.cast("binary")))).alias("least"))


# Whole words in SQL, which has no lookaround: words stand between marks (2 and 3), phrases found between others (1).


def bordered_sql(text: str) -> str:
    return rf"regexp_replace({text}, '({X.LETTER}+)', chr(2) || '\1' || chr(3), 'g')"


def unbordered_sql(text: str) -> str:
    return rf"regexp_replace({text}, '[\x02\x03]', '', 'g')"


def phrase_sql(alternation: str) -> str:
    """The pattern of a phrase (or of several, with bars between them) in a text with marks."""
    return rf"\x02((?i:{alternation.replace(' ', chr(92) + 'x03 ' + chr(92) + 'x02')}))\x03"


def pieces_sql(text: str, alternation: str) -> str:
    """A text cut at the whole phrases of ``alternation``: what is between them and they themselves in turn."""
    return "string_split(" + unbordered_sql(rf"regexp_replace({bordered_sql(text)}, '{phrase_sql(alternation)}', chr(1) || '\1' || chr(1), 'g')") + ", chr(1))"


def articles_sql(bordered: str, an_before=X.AN_BEFORE, a_before=X.A_BEFORE) -> str:
    """``text.fix_articles`` of a text with marks, the marks gone."""
    for before, article in ((f"(?i:{'|'.join(an_before)})", "n"), (f"(?i:{'|'.join(a_before)})", ""), ("[AEIOUaeiou]", "n"), ("[A-Za-z]", "")):
        bordered = rf"regexp_replace({bordered}, '\x02([Aa])n?\x03 \x02({before})', chr(2) || '\1' || chr(1) || '{article}' || chr(3) || ' ' || chr(2) || '\2', 'g')"
    return f"replace({unbordered_sql(bordered)}, chr(1), '')"


#: A text in which every article is gone and every "the" has become one to settle.
_TO_FIX = rf"replace({unbordered_sql(rf"regexp_replace({bordered_sql('text')}, '{phrase_sql('an?')}', 'it', 'g')")}, ' the ', ' a ')"


def articles_to_fix(c):
    return F.replace(F.regexp_replace(c, F.lit(X.whole_words("an?")), F.lit("it")), F.lit(" the "), F.lit(" a "))


@query(f"SELECT doc_id, {articles_sql(bordered_sql(_TO_FIX))} AS fixed FROM documents")
def article_fix(s, d):
    return docs(s, d).select("doc_id", X.fix_articles(articles_to_fix(F.col("text"))).alias("fixed"))


@query(f"SELECT doc_id, {articles_sql(bordered_sql(_TO_FIX), X.AN_BEFORE_AT_RUNTIME, X.A_BEFORE_AT_RUNTIME)} AS fixed FROM documents")
def article_fix_runtime(s, d):
    """The same with the longer lists that the page pass has."""
    return docs(s, d).select("doc_id", X.fix_articles(articles_to_fix(F.col("text")), X.AN_BEFORE_AT_RUNTIME, X.A_BEFORE_AT_RUNTIME).alias("fixed"))


@query("SELECT p_partkey, CASE WHEN upper(p_brand[1]) = p_brand[1] AND lower(p_brand[1]) <> p_brand[1] THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS cased FROM part")
def match_case(s, d):
    return table(s, d, "part").select("p_partkey", X.match_case(F.col("p_brand"), F.col("p_name")).alias("cased"))


# Gates

GATE = rf"length(text) >= 200 AND length(regexp_replace(text, '[\p{{L}}]|{SPACE}', '', 'g')) / length(text) <= 0.2"


def doc_gate_column(c="text"):
    return (F.length(c) >= 200) & (X.nonalpha_ratio(F.col(c)) <= 0.20)


@query(f"SELECT doc_id, {GATE} AS accepted FROM documents")
def doc_gate(s, d):
    return docs(s, d).select("doc_id", doc_gate_column().alias("accepted"))


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def lang_filter(s, d):
    return docs(s, d).filter("lang = 'en'").select("doc_id", "source")


ABBREV = ", ".join(f"'{a}'" for a in X.ABBREVIATIONS)
#: Documents that pass the gate on their raw text and are English, normalised.
CLEAN = f"clean AS (SELECT doc_id, source, lang, {normalized_sql('text')} AS text FROM documents WHERE {GATE} AND lang = 'en')"


def cleaned(df: DataFrame) -> DataFrame:
    """Documents that pass the gate and the language test, with their texts normalised."""
    return df.filter(doc_gate_column() & (F.col("lang") == "en")).withColumn("text", udfs.normalized(F.col("text")))


_SENTENCES = rf"""
paragraphs AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pn FROM documents),
marked AS (SELECT doc_id, source, lang, pn, string_split(regexp_replace(regexp_replace(p, '^{SPACE}+|{SPACE}+$', '', 'g'), '([.!?][''")\]]?{SPACE}+)(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM paragraphs),
pieces AS (SELECT doc_id, source, lang, pn, unnest(ps) AS x, generate_subscripts(ps, 1) AS k FROM marked),
heads AS (SELECT *, regexp_replace(x, '[.!?][''")\]]?{SPACE}+$', '') AS head FROM pieces),
vetoes AS (SELECT *, regexp_extract(head, '([A-Za-z][A-Za-z.]*)$', 1) AS prev FROM heads),
grouped AS (SELECT *, coalesce(sum(CASE WHEN NOT ends_with(head, '..') AND (prev IN ({ABBREV}) OR regexp_matches(prev, '^[A-Z]$') OR contains(prev, '.')) THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc_id, pn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM vetoes),
raw AS (SELECT doc_id, source, lang, pn, g, regexp_replace(string_agg(x, '' ORDER BY k), '^{SPACE}+|{SPACE}+$', '', 'g') AS sentence FROM grouped GROUP BY doc_id, source, lang, pn, g),
sentences AS (SELECT doc_id, source, lang, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pn, g) - 1 AS sent_no FROM raw WHERE sentence <> '')"""
#: Sentences of the documents as they stand, and of the cleaned ones.
RAW_SENTENCES, SENTENCES = _SENTENCES, f"{CLEAN}, {_SENTENCES.replace('FROM documents)', 'FROM clean)', 1)}"
REASON = rf"""
tokenised AS (SELECT *, regexp_extract_all(sentence, '{NOT_SPACE}+') AS t FROM sentences),
counted AS (SELECT *, len(t) AS n, list_filter(t, lambda x: regexp_matches(x, '\p{{L}}')) AS alpha FROM tokenised),
reasons AS (SELECT *, CASE WHEN n < 6 OR n > 40 THEN 'length' WHEN NOT regexp_matches(sentence, '[.!?][''")\]]?$') THEN 'terminator'
  WHEN regexp_matches(sentence, '^\d{{1,3}}:\d{{1,3}}\b') OR regexp_matches(sentence, '^\d{{1,4}}\.\s') THEN 'reference'
  WHEN length(regexp_replace(sentence, '[^,;]', '', 'g')) / n > 0.25 THEN 'separators' WHEN regexp_matches(sentence, '\[[a-z]{{2,6}}\d?\]') THEN 'tag'
  WHEN len(list_distinct(list_transform(t, lambda x: lower(x)))) / n < 0.5 THEN 'unique' WHEN len(alpha) < 6 THEN 'alpha'
  WHEN len(list_filter(alpha, lambda x: length(x) > 1 AND regexp_matches(x, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(x, '\p{{Ll}}'))) / len(alpha) > 0.5 THEN 'caps'
  WHEN len(list_filter(t, lambda x: regexp_matches(x, '\p{{Nd}}'))) / n > 0.3 THEN 'digits'
  WHEN len(alpha) > 1 AND len(list_filter(alpha[2:], lambda x: regexp_matches(x, '^\p{{Lu}}'))) / (len(alpha) - 1) > 0.5 THEN 'names' END AS reason FROM counted),
good AS (SELECT doc_id, source, lang, sent_no, sentence, n AS n_tok, md5(array_to_string(regexp_extract_all(lower(sentence), '[a-z0-9'']+'), ' ')) AS key FROM reasons WHERE reason IS NULL),
kept AS (SELECT *, row_number() OVER (ORDER BY doc_id, sent_no) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, sent_no) AS rn FROM good) WHERE rn = 1)"""


def spread(df: DataFrame) -> DataFrame:
    """Dealt out to all cores if the scan has fewer parts than that, as a single small file has; a large table is left as it is scanned."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def all_sentences(df: DataFrame, backend: str = "rules") -> DataFrame:
    """``doc_id, source, lang, sent_no, sentence`` of every sentence, cut by one of ``text.SPLITTERS``."""
    return spread(df.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", F.posexplode_outer(X.splitter(backend)(F.col("text"))).alias("sent_no", "sentence")).filter("sent_no is not null")


def good_sentences(df: DataFrame) -> DataFrame:
    """Sentences of the cleaned documents that pass every rule, with their token count and key."""
    return all_sentences(cleaned(df)).filter(X.reject_reason(F.col("sentence")).isNull()).withColumns({"n_tok": X.token_count(F.col("sentence")), "key": X.exact_key(F.col("sentence"))})


def first_of_key(df: DataFrame, key: str = "key", order=("doc_id", "sent_no")) -> DataFrame:
    """One row of each key, the first in ``order``: a partial aggregate before the shuffle, no window over a frequent key."""
    rest = [c for c in df.columns if c not in (*order, key)]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(key, "r.*").select(*df.columns)


@query(f"WITH {RAW_SENTENCES} SELECT doc_id, sent_no, sentence FROM sentences")
def sentences(s, d):
    return all_sentences(docs(s, d)).select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "sentence")


@query(f"WITH {RAW_SENTENCES}, {REASON} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM reasons GROUP BY reason")
def sentence_gate_reasons(s, d):
    return all_sentences(docs(s, d)).groupBy(F.coalesce(X.reject_reason(F.col("sentence")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {RAW_SENTENCES} SELECT len(regexp_extract_all(sentence, '{NOT_SPACE}+')) AS n_tok, count(*) AS n FROM sentences GROUP BY n_tok")
def sentence_length_hist(s, d):
    return all_sentences(docs(s, d)).groupBy(X.token_count(F.col("sentence")).cast("long").alias("n_tok")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SENTENCES}, {REASON} SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM documents WHERE NOT ({GATE})) AS dropped_quality, (SELECT count(*) FROM documents WHERE {GATE} AND lang <> 'en') AS dropped_lang,
  (SELECT CAST(sum(len(regexp_extract_all(lower(text), '{W}'))) AS BIGINT) FROM clean) AS words, count(*) AS sentences, count(*) FILTER (WHERE reason IS NOT NULL) AS filtered, (SELECT count(*) FROM good) - (SELECT count(*) FROM kept) AS dupes,
  (SELECT count(*) FROM kept WHERE substr(md5('base:' || key), 1, 2) < '08') AS baseline, (SELECT count(*) FROM kept) AS retained FROM reasons"""
)
def pipeline_counters(s, d):
    """What each step of the sentence pipeline takes in and leaves, from one pass over the documents and one over their sentences."""
    every, gate = docs(s, d), doc_gate_column()
    n = every.agg(F.count("*").alias("docs"), F.count_if(~gate).alias("dropped_quality"), F.count_if(gate & (F.col("lang") != "en")).alias("dropped_lang"))
    # A text's words are counted beside its first sentence, so that it is cleaned once.
    clean = spread(cleaned(every).select("text")).select(F.size(X.words(F.col("text"))).alias("words"), F.posexplode_outer(X.splitter()(F.col("text"))).alias("sent_no", "sentence"))
    sent = clean.select("sent_no", F.when(F.coalesce("sent_no", F.lit(0)) == 0, F.col("words")).alias("words"), F.when(X.reject_reason(F.col("sentence")).isNull(), X.exact_key(F.col("sentence"))).alias("key"))
    # One row a key first, so that no count of distinct keys is made in one task.
    per = sent.groupBy("key").agg(F.count("sent_no").alias("n"), F.sum("words").alias("words"))
    base = F.substring(F.md5(F.concat(F.lit("base:"), "key").cast("binary")), 1, 2) < "08"
    some = F.col("key").isNotNull()
    m = per.agg(F.sum("words").cast("long").alias("words"), F.sum("n").alias("sentences"), F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("filtered"), F.sum(F.when(some, F.col("n") - 1).otherwise(0)).alias("dupes"), F.count_if(some & base).alias("baseline"), F.count_if(some).alias("retained"))
    return n.join(F.broadcast(m))  # two single rows


@query(
    """
WITH l AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS n_turns, string_agg(text, ' ' ORDER BY turn) AS joined FROM l WHERE role <> 'user' GROUP BY conv_id, island"""
)
def line_islands(s, d):
    """Runs of turns that are not the user's, each as one text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").withColumn("island", F.sum((F.col("role") == "user").cast("long")).over(w)).filter("role <> 'user'")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id", "island").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("joined"))


# Frequencies


def tokens(df: DataFrame) -> DataFrame:
    return spread(df.select("doc_id", "source", "text")).select("doc_id", "source", F.explode_outer(X.words(F.col("text"))).alias("form")).filter("form is not null")


def counts(df: DataFrame) -> DataFrame:
    return tokens(df).groupBy("form").agg(F.count("*").alias("n"))


@query(f"SELECT form, count(*) AS n FROM ({TOKENS}) GROUP BY form")
def doc_word_frequency(s, d):
    return counts(docs(s, d))


@query(f"WITH {SENTENCES}, {REASON} SELECT form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(sentence), '{W}')) AS form FROM kept) GROUP BY form")
def word_frequency(s, d):
    kept = first_of_key(good_sentences(docs(s, d)))
    return kept.select(F.explode(X.words(F.col("sentence"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query(f"SELECT source, form, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '{W}')) AS form FROM documents) GROUP BY GROUPING SETS ((source, form), (form))")
def freq_grouping_sets(s, d):
    per = tokens(docs(s, d)).groupBy("source", "form").agg(F.count("*").alias("n"))  # the pooled counts reuse the counts by source
    return per.unionByName(per.groupBy("form").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("source"), "form", "n"))


def rates(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Counts and rates per million; the total is one row, joined by broadcast. The counts are written, so that the texts are read once; ``known`` are those of ``counts``, written, if they are there."""
    c = written(counts(df)) if known is None else known
    return c.join(F.broadcast(c.agg(F.sum("n").alias("total")))).withColumn("per_million", F.col("n") / F.col("total") * 1e6)


RATES = f"c AS (SELECT form, count(*) AS n FROM ({TOKENS}) GROUP BY form), r AS (SELECT form, n, CAST(sum(n) OVER () AS BIGINT) AS total, n / sum(n) OVER () * 1e6 AS per_million FROM c)"


@query(f"WITH {RATES} SELECT form, n, total, round(per_million, 6) AS per_million FROM r")
def rate_per_million(s, d):
    return rates(docs(s, d)).select("form", "n", "total", F.round("per_million", 6).alias("per_million"))


LOW, HIGH, CAP = 5.0, 100.0, 3


def band(df: DataFrame, low: float = LOW, high: float = HIGH, known: DataFrame | None = None) -> DataFrame:
    return rates(df, known).filter(F.col("per_million").between(low, high)).select("form", "n")


@query(f"WITH {RATES} SELECT form, n FROM r WHERE per_million BETWEEN {LOW} AND {HIGH}")
def rarity_band(s, d):
    return band(docs(s, d))


@query(
    f"WITH {RATES} SELECT any_value(total) AS total, count(*) AS forms, count(*) FILTER (WHERE per_million BETWEEN {LOW} AND {HIGH}) AS in_band, count(*) FILTER (WHERE n = 1) AS hapaxes, round(1e6 / any_value(total), 6) AS resolution FROM r"
)
def calibration_summary(s, d):
    r = rates(docs(s, d))
    return r.agg(
        F.max("total").alias("total"), F.count("*").alias("forms"), F.count_if(F.col("per_million").between(LOW, HIGH)).alias("in_band"), F.count_if(F.col("n") == 1).alias("hapaxes"), F.round(1e6 / F.max("total"), 6).alias("resolution")
    )


@query(f"SELECT form, count(*) AS n FROM ({TOKENS}) GROUP BY form ORDER BY n DESC, form LIMIT 1000")
def top_forms(s, d):
    return top_counts(counts(docs(s, d)), 1000)


def top_counts(c: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent forms, in the order of the alphabet among equals."""
    return c.orderBy(F.desc("n"), "form").limit(n)


@query(f"WITH c AS MATERIALIZED (SELECT form, count(*) AS n FROM ({TOKENS}) GROUP BY form), k AS MATERIALIZED (SELECT coalesce(max(n), 0) AS cut FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM c) WHERE i = 1001) SELECT form, n FROM c, k WHERE n > cut")
def prune_counts(s, d):
    c = written(counts(docs(s, d)))
    cut = c.select("n").orderBy(F.desc("n")).limit(1001).agg(F.when(F.count("*") > 1000, F.min("n")).otherwise(F.lit(0)).alias("cut"))
    return c.join(F.broadcast(cut)).filter("n > cut").select("form", "n")


CASED = f"SELECT unnest(regexp_extract_all(text, '{W}')) AS w FROM documents"


def case_table(df: DataFrame) -> DataFrame:
    w = spread(df.select("text")).select(F.explode_outer(F.regexp_extract_all("text", F.lit(X.WORD), F.lit(0))).alias("w")).filter("w is not null")
    capital = F.col("w").rlike("^[A-Z]")
    return w.groupBy(F.lower("w").alias("form")).agg(F.count_if(capital).alias("capitals"), F.count_if(~capital).alias("lowers"))


@query(f"SELECT lower(w) AS form, count(*) FILTER (WHERE w ~ '^[A-Z].*') AS capitals, count(*) FILTER (WHERE NOT w ~ '^[A-Z].*') AS lowers FROM ({CASED}) GROUP BY 1")
def case_counts(s, d):
    return case_table(docs(s, d))


@query(f"SELECT lower(w) AS form, count(*) FILTER (WHERE w ~ '^[A-Z].*') AS capitals FROM ({CASED}) GROUP BY 1 HAVING count(*) FILTER (WHERE w ~ '^[A-Z].*') >= 20 AND count(*) FILTER (WHERE w ~ '^[A-Z].*') / count(*) >= 0.9")
def names(s, d):
    return case_table(docs(s, d)).filter("capitals >= 20 AND capitals / (capitals + lowers) >= 0.9").select("form", "capitals")


@query(f"WITH c AS (SELECT form, count(*) AS n FROM ({TOKENS}) GROUP BY form) SELECT form, round(ln(sum(n) OVER () / n), 6) AS idf FROM c")
def idf(s, d):
    return rates(docs(s, d)).select("form", F.round(F.log(F.col("total") / F.col("n")), 6).alias("idf"))


def within(lo: float, hi: float):
    return lambda x: x.between(lo, hi)


GRID = [(lo, hi) for lo in (1.0, 2.5, 5.0, 10.0) for hi in (5.0, 20.0, 50.0, 100.0, 200.0) if lo < hi]


@query(
    f"""WITH {SENTENCES}, {REASON}, {RATES}, grid(lo, hi) AS (VALUES {", ".join(f"({lo}::DOUBLE, {hi}::DOUBLE)" for lo, hi in GRID)}),
p AS (SELECT pos, list(DISTINCT per_million) AS rs FROM (SELECT pos, unnest(regexp_extract_all(lower(sentence), '{W}')) AS form FROM kept) JOIN r USING (form) WHERE per_million <= 200 GROUP BY pos)
SELECT lo, hi, count(pos) AS hits, round(count(pos) / (SELECT count(*) FROM kept), 6) AS share, round(count(pos) / (SELECT count(*) FROM kept) * 0.98 + 0.02, 6) AS combined
FROM grid LEFT JOIN p ON len(list_filter(rs, lambda x: x BETWEEN lo AND hi)) > 0 GROUP BY lo, hi"""
)
def band_sweep(s, d):
    """Share of sentences that each band would keep: all bands are counted in one pass over the sentences' rare words."""
    # Written, since it is read twice with other columns.
    kept = written(first_of_key(good_sentences(docs(s, d))).select("key", "sentence"))
    rare = rates(docs(s, d)).filter("per_million <= 200").select("form", "per_million")
    profile = kept.select("key", F.explode(F.array_distinct(X.words(F.col("sentence")))).alias("form")).join(rare, "form").groupBy("key").agg(F.collect_set("per_million").alias("rs"))
    hits = profile.agg(*(F.count_if(F.exists("rs", within(lo, hi))).alias(f"h{i}") for i, (lo, hi) in enumerate(GRID)))
    every = hits.join(F.broadcast(kept.agg(F.count("*").alias("every")))).select("every", F.explode(F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"h{i}").alias("hits")) for i, (lo, hi) in enumerate(GRID)))).alias("g"))
    share = F.col("g.hits") / F.col("every")
    return every.select("g.lo", "g.hi", "g.hits", F.round(share, 6).alias("share"), F.round(share * 0.98 + 0.02, 6).alias("combined"))
