"""Text functions on golden strings, loops against their set-based forms, sources, sinks, and all queries against their SQL."""

from __future__ import annotations

import json
import os
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from prosemill import queries as Q  # noqa: E402
from prosemill.functions import text as X  # noqa: E402
from prosemill.functions import udfs  # noqa: E402
from prosemill.operators import dedup, retention  # noqa: E402
from prosemill.plans import decision_queries as D  # noqa: E402
from prosemill.sources import readers, sinks  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("core")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def of(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_book_text_has_three_sentences(spark):
    raw = (
        "A heading\n*** START OF THE PROJECT GUTENBERG EBOOK A BOOK ***\nProduced by a volunteer\nand friends\n\nThe road went down to the river, where Mr. Hale had\nleft his boat. Nobody had"
        " seen it since.\n\nThe second para-\ngraph is only one sentence long and ends here.\n*** END OF THE PROJECT GUTENBERG EBOOK A BOOK ***\nLicence"
    )
    clean = lambda c: X.unwrap_paragraphs(X.strip_emphasis(X.rejoin_hyphenation(X.drop_frontmatter(X.strip_book_marks(c)))))
    (got,) = of(spark, lambda c: X.document_sentences(clean(c)), raw)
    assert got == ["The road went down to the river, where Mr. Hale had left his boat.", "Nobody had seen it since.", "The second paragraph is only one sentence long and ends here."]


def test_small_text_functions(spark):
    assert of(spark, X.rejoin_hyphenation, "won-\nder", "Anglo-\nSaxon", "été-\n fin") == ["wonder", "Anglo-\nSaxon", "étéfin"]
    assert of(spark, X.strip_emphasis, "a _very_ odd __ case") == ["a very odd __ case"]
    assert of(spark, X.collapse_double_spacing, "a\n\nb\n\n\nc\n\nd", "a\nb\n\nc d\ne") == ["a\nb\n\nc\nd", "a\nb\n\nc d\ne"]
    assert of(spark, X.unwrap_paragraphs, "Short line.\nNext line.\nlast", "\n\n", "a long line that is wrapped somewhere near here\nand goes on") == ["Short line.\nNext line.\nlast", "", "a long line that is wrapped somewhere near here and goes on"]
    assert of(spark, X.words, "Don't stop-and -go it's 3rd naïve") == [["don't", "stop-and", "go", "it's", "rd", "na", "ve"]]
    assert of(spark, X.nonalpha_ratio, "", "ab c", "a1") == [1.0, 0.0, 0.5]
    assert of(spark, X.drop_tail_sections, "text\n== See also ==\nlink\n", "text\nSee also this") == ["text", "text\nSee also this"]
    assert of(spark, X.strip_html, "<p>Use <code>x &lt; y</code> and <em>this</em> &amp; that</p><blockquote>old</blockquote>") == [" Use   and  this  & that  "]
    assert of(spark, udfs.unescape, "&eacute;&#8217;", None) == ["é’", None]
    assert of(spark, udfs.nfkc, "ﬁn", None) == ["fin", None]
    assert of(spark, X.normalize, "“It’s”—so… a@b.co , see www.x.yz (  here )", "pitch--seemed  x \n y") == ["\"It's\"--so..., see (here)", "pitch -- seemed x\ny"]
    assert of(spark, X.guess_year, "Release Date: May 1, 2004 1888", "born 1811, died 1870", "none 99") == [2004, 1811, None]
    assert of(spark, X.author_year, "Someone, 1811-1870", "x") == [1870, None]
    assert of(spark, X.fix_articles, "a hour, an one, A apple, an pear, a Heir") == ["an hour, a one, An apple, a pear, an Heir"]
    assert of(spark, lambda c: X.match_case(c, F.lit("swift")), "Quick", "quick", "1") == ["Swift", "swift", "swift"]
    assert of(spark, lambda c: F.size(X.shingles(X.words(c))), "", "one two", "a b c d e f") == [0, 1, 2]


def test_splitter_keeps_abbreviations_together(spark):
    got = of(spark, X.split_sentences, 'He met Dr. Grey at 5 p.m. Tuesday. "Why?" She left.', "J. Smith came... Then he went! (So it was.) Yes", "", "no end")
    assert got == [["He met Dr. Grey at 5 p.m. Tuesday.", '"Why?"', "She left."], ["J. Smith came...", "Then he went!", "(So it was.)", "Yes"], [], ["no end"]]


@pytest.mark.parametrize(
    "sentence, reason",
    [
        ("Too short a line.", "length"),
        ("word " * 41 + "end.", "length"),
        ("This sentence has no terminator at its very end", "terminator"),
        ("12:3 And the people went down to the sea.", "reference"),
        ("937. And the people went down to the sea.", "reference"),
        ("red, green, blue, white, black, grey, and so on.", "separators"),
        ("A word from the old thesaurus [obs3] is listed here.", "tag"),
        ("the the the the the the the sea sea.", "unique"),
        ("1 2 3 4 5 6 only four words.", "alpha"),
        ("THIS WHOLE SENTENCE IS SHOUTED AT YOU.", "caps"),
        ("there were 11 and 12 and 13 and 14 or 15 16 of them.", "digits"),
        ("then Anna Bella Clara Dora Emma and Fay came.", "names"),
        ("The train left at 10:30 and nobody was late for it.", None),
    ],
)
def test_sentence_gate(spark, sentence, reason):
    assert of(spark, X.reject_reason, sentence) == [reason]


def test_constraints(spark):
    def blocked(sentence, trigger, block, require):
        w = [x for x in sentence.lower().replace(".", "").split()]
        arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        return not spark.range(1).select(D.allowed(F.lit(f" {' '.join(w)} "), arr([x for x in w if x not in trigger.split()]), arr(block), arr(require))).first()[0]

    assert blocked("he told a lie again", "lie", ["told"], [])
    assert not blocked("he will lie down", "lie", ["lie"], [])
    assert blocked("they lie ahead of us", "lie", ["lie ahead"], [])
    assert blocked("a plain day", "plain", [], ["view"]) and not blocked("a plain view", "plain", [], ["view"])


def test_word_pieces():
    v = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "<t>", "</t>", "un", "##able", "cafe", "!", "the"])}
    assert udfs.basic_tokens("Café!​ The") == ["cafe", "!", "the"]
    assert udfs.word_pieces("unable", v) == ["un", "##able"] and udfs.word_pieces("unx", v) == ["[UNK]"] and udfs.word_pieces("a" * 101, v) == ["[UNK]"]
    ids, types = udfs.encode_pair("the <t> café </t> !", "unable", v, most=8)
    assert ids == [1, 9, 3, 7, 2, 5, 6, 2] and types == [0] * 5 + [1] * 3


def random_sentences(r, n=200):
    return [(i // 5, i % 5, " ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(6))) for i in range(n)]


def test_coverage_equals_the_scan(spark):
    r = random.Random(0)
    for cap in (1, 3):
        rows, wanted = random_sentences(r), {"aa", "b", "jj", "c"}
        have, kept = dict.fromkeys(wanted, 0), []
        for i, k, t in rows:
            own = wanted & set(t.split())
            if any(have[w] < cap for w in own):
                kept.append((i, k))
                for w in own:
                    have[w] += 1
        df = spark.createDataFrame(rows, "doc_id long, sent_no int, sentence string")
        words = spark.createDataFrame([(w,) for w in wanted], "form string")
        assert sorted(tuple(x) for x in retention.coverage_capped(df, words, cap).select("doc_id", "sent_no").collect()) == kept


def test_first_wins_equals_the_scan(spark):
    r = random.Random(1)
    for _ in range(4):
        n = 40
        pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.06}
        kept = []
        for b in range(n):
            if not any((a, b) in pairs for a in kept):
                kept.append(b)
        nodes = spark.createDataFrame([(i,) for i in range(n)], "doc_id long")
        got = dedup.first_wins(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"))
        assert sorted(x[0] for x in got.collect()) == kept


def test_first_wins_on_a_long_chain(spark):
    n = 203
    kept = dedup.first_wins(spark.range(n).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long"))
    assert sorted(r[0] for r in kept.collect()) == list(range(0, n, 2))


def test_near_dedup_reads_all_languages(spark, tmp_path):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a, "en"), (2, a, "fr"), (3, b, None), (4, b, "de"), (5, "", "es")]
    spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r[0] for r in Q.QUERIES["near_dedup_greedy"](spark, str(tmp_path)).collect()) == [1, 3, 5]


def test_texts_that_differ_in_numbers_are_not_copies(spark, tmp_path):
    rows = [(i, f"row {i} of {i} and {i} more {i} items {i} here", "en", "s", 0) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert Q.QUERIES["near_dedup_greedy"](spark, str(tmp_path)).count() == 3


def test_jaccard_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    sets = [sorted({r.randrange(14) for _ in range(10)}) for _ in range(60)]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "doc_id long, sh array<string>")
    rep = {i: min(j for j in range(60) if sets[j] == sets[i]) for i in range(60)}
    assert dict(map(tuple, dedup.set_classes(df).collect())) == rep
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8}
    assert {(x["a"], x["b"]) for x in dedup.jaccard_pairs(df, 0.8).collect()} == want and want
    kept = []
    for b in range(60):
        if not any(len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8 for a in kept):
            kept.append(b)
    assert sorted(x["doc_id"] for x in dedup.near_first_wins(df).filter("kept").collect()) == kept


def test_jaccard_classes_hold_every_document(spark, tmp_path):
    import duckdb

    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, a), (2, a + " "), (3, f"{a} more"), (4, "other words"), (5, ""), (6, None), (7, " \n "), (8, ""), (9, None)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path))
    got = sorted(map(tuple, Q.QUERIES["jaccard_classes"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 1), *((i, i, 0) for i in range(4, 10))]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{path}/*.parquet'")
    assert got == sorted(c.sql(Q.SQL["jaccard_classes"]).fetchall())
    for name in ("near_dedup_greedy", "near_duplicate_rate", "minhash_signature", "shingles"):
        want = c.sql(Q.SQL[name])
        assert sorted(map(repr, map(tuple, Q.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_minhash_bands_find_the_similar(spark):
    r = random.Random(4)
    sets = []
    for _ in range(60):
        base = [r.getrandbits(62) for _ in range(60)]
        sets += [base, base[:57] + [r.getrandbits(62) for _ in range(3)]]  # 57 of 63
    df = spark.createDataFrame(list(enumerate(sets)) + [(900, [])], "doc_id long, sh array<long>")
    sig = df.select("doc_id", dedup.minhash(F.col("sh")).alias("sig"))
    assert set(sig.filter("doc_id = 900").first()["sig"]) == {-1}
    got = {(x["a"], x["b"]) for x in dedup.lsh_pairs(sig.filter("doc_id < 900")).collect()}
    assert got <= {(i, i + 1) for i in range(0, 120, 2)} and len(got) >= 54


def test_minhash_loses_no_link_of_equal_signatures(spark, tmp_path):
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    changed = [[*base[:k], "other", *base[k + 1 :]] for k in (1000, 2000, 3000)]
    texts = [" ".join(w) for w in (base, *changed, base)] + ["", None, "no words like those above"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = {(x["a"], x["b"]) for x in Q.QUERIES["lsh_pairs"](spark, str(tmp_path)).collect()}
    rows = {x["doc_id"]: (x["rep"], x["links"]) for x in Q.QUERIES["lsh_classes"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(8)) and all(rows[i] == (i, 0) for i in (5, 6, 7))
    rep = [rows[i][0] for i in range(5)]
    assert len(set(rep)) < 4  # different texts of an equal signature
    assert all(rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in pairs for a in range(5) for b in range(a))
    assert all(rows[i][1] == sum(rep[i] in p for p in pairs) for i in range(5))


def test_quantiles_interpolate(spark):
    from prosemill.operators import order

    r = random.Random(8)
    rows = [(k, r.choice([None, r.uniform(-50, 1e6), float(r.randrange(4))])) for k in "aab" for _ in range(40)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.0, 0.3, 0.98, 1.0):
        want = dict(df.groupBy("k").agg(F.percentile("v", F.lit(share))).collect())
        assert dict(order.quantile(df, ["k"], "v", share, "q").collect()) == pytest.approx(want)


def write_documents(spark, path, n=60, files=5):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    text = lambda: "\n".join(" ".join(r.choices(words, k=r.randint(6, 12))).capitalize() + "." for _ in range(6))
    rows = [(i, text(), "en", "s", 0) for i in range(n)]
    rows = [*rows, (n, rows[0][1], "en", "s", 0), (n + 1, "", "en", "s", 0), (n + 2, None, "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(files, "doc_id").write.parquet(str(path))
    return df


def test_streams_over_several_batches(spark, tmp_path):
    from prosemill.plans.text_queries import band, counts
    from prosemill.streaming import streams

    df = write_documents(spark, tmp_path / "documents.parquet")
    stream = lambda: streams.documents(spark, str(tmp_path), files_per_trigger=1)
    marks = streams.progress(stream()).collect()
    assert len(marks) > 2 and sum(r["rows"] for r in marks) == 63
    assert sorted(map(tuple, streams.collected(streams.word_counts(stream()), "complete").collect())) == sorted(map(tuple, counts(df).collect()))
    keys = streams.collected(streams.distinct_texts(stream()), "append").collect()
    assert len(keys) == len({r["text"] for r in df.collect()})
    words = band(df, 0, 1e6).select("form")
    kept = streams.coverage(spark, stream(), words, 2)
    # Each word has as many contexts as it can, or the cap at least, in whatever order the files came.
    have, every = retention.hits(kept, words).groupBy("form").count(), retention.hits(Q.QUERIES and __import__("prosemill.plans.corpus_queries", fromlist=["x"]).positioned(spark, str(tmp_path)), words).groupBy("form").count()
    n, most = dict(map(tuple, have.collect())), dict(map(tuple, every.collect()))
    assert n and all(n.get(w, 0) >= min(2, k) for w, k in most.items())
    streams.stored(stream(), str(tmp_path / "store"), 10)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 63


def test_streams_without_rows(spark, tmp_path):
    from prosemill.streaming import streams

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    empty = lambda: streams.documents(spark, str(tmp_path))
    assert streams.collected(streams.distinct_texts(empty()), "append").count() == 0
    assert streams.coverage(spark, empty(), spark.createDataFrame([("a",)], "form string"), 2).count() == 0


def test_scratch_deletes_its_tables(spark, tmp_path):
    from prosemill.operators import scratch

    with scratch.scratch(spark):
        df = scratch.written(spark.range(3))
        files = df.inputFiles()
        assert df.count() == 3
    assert not os.path.exists(files[0].removeprefix("file://"))


def test_scorer_inputs_against_a_plain_tokenizer(spark):
    from prosemill.plans import judging_queries as J

    v = J.piece_vocabulary(spark, SF)
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    rows = J.scorer_inputs(spark, SF).collect()
    assert rows
    for r in rows[:40]:
        import re

        text = texts[r["conv_id"], r["turn"]]
        m = re.search(X.whole_words(D._ALTERNATION).replace(r"[\p{L}\p{M}\p{N}_]", r"\w"), text)
        marked = f"{text[: m.start()]}<t> {m.group(1)} </t>{text[m.end() :]}"
        ids, types = udfs.encode_pair(marked, r["replacement"], v, 64)
        assert (r["ids"], r["mask"], r["types"]) == (ids + [0] * (64 - len(ids)), [1] * len(ids) + [0] * (64 - len(ids)), types)


def test_splitters_by_name(spark, monkeypatch):
    from prosemill.plans.text_queries import all_sentences

    monkeypatch.setitem(X.SPLITTERS, "lines", udfs.model(lambda ts: [t.split("|") for t in ts], "array<string>"))
    df = spark.createDataFrame([(1, "s", "en", "a. B|c")], "doc_id long, source string, lang string, text string")
    assert [r["sentence"] for r in all_sentences(df, "lines").orderBy("sent_no").collect()] == ["a. B", "c"]
    assert [r["sentence"] for r in all_sentences(df).orderBy("sent_no").collect()] == ["a.", "B|c"]
    with pytest.raises(KeyError):
        all_sentences(df, "none")


def test_a_tagger_of_its_own_process(spark):
    script = "import json, sys; print(json.dumps([None if t is None else t[::-1] for t in json.load(sys.stdin)]))"
    tag = udfs.piped([sys.executable, "-c", script], "string")
    assert of(spark, tag, "abc", None, "") == ["cba", None, ""]


def test_models_plug_in(spark):
    assert of(spark, udfs.model(lambda ts: ["en" if t and " the " in t else "xx" for t in ts], "string"), "on the road", "x", None) == ["en", "xx", "xx"]


def test_budget_and_interleave(spark):
    rows = [(i, "ab"[i % 3 == 0], 1 + i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    want = []
    for s in "ab":
        total = 0
        for i, k, n in rows:
            if k == s and total < 30:
                want.append(i)
                total += n
    assert sorted(x["doc_id"] for x in retention.within_budget(df, "source", "doc_id", "n", 30).collect()) == sorted(want)
    queues, order = {s: [i for i, k, _ in rows if k == s] for s in "ab"}, []
    while any(queues.values()):
        for s in "ab":
            order += queues[s][:25]
            queues[s] = queues[s][25:]
    assert [x["doc_id"] for x in retention.interleave(df, "source", "doc_id").orderBy("pos").collect()] == order


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "books/old").mkdir(parents=True)
    body = "*** START OF THE PROJECT GUTENBERG EBOOK X ***\n" + "A line of the book that is long enough.\n" * 80
    for name in ("10.txt", "11-8.txt", "old/12.txt"):
        (tmp_path / "books" / name).write_text("Release Date: 1999\n" + body)
    (tmp_path / "books/13.txt").write_text("short")
    books = readers.books(spark, str(tmp_path / "books")).collect()
    assert [(b["doc_id"], b["pub_year"]) for b in books] == [("pg:10", 1999)] and books[0]["text"].startswith("A line")
    (tmp_path / "se/cooking").mkdir(parents=True)
    (tmp_path / "se/cooking/Posts.xml").write_text('<posts>\n<row Id="1" CreationDate="2012-01-01" Body="&lt;p&gt;Salt &amp;amp; caf&amp;eacute;&lt;/p&gt;" />\n<row Id="2" CreationDate="x" Body="" />\n</posts>')
    (post,) = readers.questions(spark, str(tmp_path / "se")).collect()
    assert (post["doc_id"], post["pub_year"], post["text"].strip()) == ("se:cooking:1", 2012, "Salt & café")
    (tmp_path / "se2/x").mkdir(parents=True)
    (tmp_path / "se2/x/Posts.xml").write_text('<posts>\n<row Id="1" CreationDate="2012-01-01" Body="x &amp;amp;lt; y &amp;eacute;" />\n</posts>')
    assert readers.questions(spark, str(tmp_path / "se2")).first()["text"] == "x &lt; y é"
    assert readers.word_list(spark, str(tmp_path / "none.txt")).count() == readers.deferred_words(spark, str(tmp_path / "none.tsv")).count() == 0
    (tmp_path / "w.txt").write_text("B \n\na\nc\n")
    assert sorted(r[0] for r in readers.word_list(spark, str(tmp_path / "w.txt"), 3).collect()) == ["a", "b"]
    (tmp_path / "n.jsonl").write_text("".join(json.dumps({"url": f"u{i}", "timestamp": f"20{i:02d}-01-01", "text": "one two"}) + "\n" for i in range(5)))
    assert [(r["doc_id"], r["pub_year"]) for r in readers.news(spark, str(tmp_path / "n.jsonl"), 3).orderBy("doc_id").collect()] == [("c4:0", 2000), ("c4:1", 2001), ("c4:2", 2002)]
    assert readers.documents(spark, {"c4news": str(tmp_path / "n.jsonl")}, budget=5).count() == 3
    spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "form string, n long").write.parquet(str(tmp_path / "freq"))
    band = readers.stored_band(spark, str(tmp_path / "freq"), 1e4, 1e5, readers.word_list(spark, str(tmp_path / "w.txt")))
    assert sorted(map(tuple, band.collect())) == [("a", True), ("b", False), ("c", False)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.jsonl").write_text(json.dumps({"doc_id": "1", "text": "x"}) + "\n")
    assert tuple(readers.documents(spark, {"mine": str(tmp_path / "d")}).first()) == ("1", "mine", "x", None, None)
    (tmp_path / "r.tsv").write_text("# note\n" + "\t".join(x.split()[0] for x in readers.RULE.split(", ")) + "\nbig\tvast\tvast\tADJ\ts\tApple | city hall|\t\tn\n\tx\tx\tADJ\t\t\t\t\nred\trosy\trosy\tADJ\t\t\t\t\n")
    (tmp_path / "def.tsv").write_text("word\treason\tdominant_untaught_sense\ttaught_gloss\nrosy\tr\td\tg\n")
    rules = readers.rule_table(spark, str(tmp_path / "r.tsv"), readers.deferred_words(spark, str(tmp_path / "def.tsv")))
    assert [(x["trigger"], x["block_context"], x["require_context"]) for x in rules.collect()] == [("big", ["apple", "city hall"], [])]
    assert json.loads(sinks.runtime_rules(rules).first()["entries"]) == [{"r": "vast", "w": "vast", "p": "ADJ", "b": ["apple", "city hall"], "q": []}]
    store = spark.createDataFrame([("s", "t")] * 7, "source string, text string")
    held = sinks.sentence_store(store.coalesce(1), str(tmp_path / "store"), 3)
    assert held["rows"] == 7 and held["bytes"] > 0
    sinks.report(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "report"))
    with pytest.raises(ValueError):
        sinks.report(store, str(tmp_path / "report2"))
    sinks.names(spark.createDataFrame([("b",), ("a",)], "form string"), str(tmp_path / "names"))
    assert [p.read_text() for p in (tmp_path / "names").glob("part-*")] == ["a\nb\n"]
    assert json.loads(sinks.gloss_map(spark.createDataFrame([("x", "2"), ("x", "1"), ("a", "3")], "word string, gloss string")).first()[0]) == {"a": "3", "x": "1"}
    assert len(list((tmp_path / "store/source=s").glob("*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "store")).count() == 7


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = Q.QUERIES[name](spark, SF)
    want = c.sql(Q.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(r) for r in want.select(*(f'"{x}"' for x in columns)).fetchall())


def test_comments_of_a_thread(spark):
    from prosemill.functions import pages as P

    text = "Some_User\n2h ago\nThis is the first\ncomment here.\nReply\n12\nu/other-one\nhttps://x.y\nok\nA second body of text\n\n3 more replies\nlast words stand alone"
    assert of(spark, P.comments, text, "") == [["This is the first comment here.", "ok A second body of text", "last words stand alone"], []]


def test_blocks_of_a_page(spark):
    from prosemill.functions import pages as P

    html = "<html><head><title>T</title></head><body><p>A paragraph of <b>running</b> text stands here.</p><pre>code that is long enough to count</pre><div>short</div><li>An <a href='x'>unwanted link</a> item of the list goes on</li></body>"
    assert of(spark, P.blocks, html) == [["A paragraph of running text stands here.", "An item of the list goes on"]]


def test_alignment_of_two_tokenisations(spark):
    assert udfs.aligned(["a", "the", "sea", "xx", "end"], ["The", "sea", "yy", "End"]) == [(1, 0), (2, 1), (4, 3)]
    assert udfs.aligned(["Do", "n't", "go"], ["don't", "go"]) == [(2, 1)]
    df = spark.createDataFrame([(["a", "b"], ["A", "c", "b"]), (None, ["x"])], "l array<string>, r array<string>")
    assert [[tuple(p) for p in r[0]] for r in df.select(udfs.align(F.col("l"), F.col("r"))).collect()] == [[(0, 0), (1, 2)], []]


def test_swaps_prompts_and_tags(spark):
    swap = lambda c: X.swap_first(c, F.lit("big"), F.lit("Unusual"))
    assert of(spark, swap, "A big dog, a big cat", "The bigger one", "Big news", "", None) == ["An Unusual dog, a big cat", None, "Unusual news", None, None]
    got = spark.createDataFrame([(["Noun", "Verb"],), (["ProperNoun", "Noun"],), (["Copula", "Verb"],), ([],), (None,)], "t array<string>").select(X.universal_pos(F.col("t"))).collect()
    assert [r[0] for r in got] == ["VERB", "PROPN", "AUX", "X", "X"]
    one = X.prompt(F.lit("7"), F.lit("a ____ b"), F.lit("x"), F.lit("s"), F.lit("w"), F.lit("g"), F.array(F.lit("p"), F.lit("q")))
    assert spark.range(1).select(one).first()[0] == "item: 7\ntext with a gap: a ____ b\nin the gap: x\nmeaning there: s\nword taught: w - g\noptions: p; q"


def test_sentences_with_offsets(spark):
    from prosemill.operators import order

    text = "  Dr. Wu left.  Then he\ncame back... Yes! J. B. stayed "
    rows = order.sentences_with_offsets(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  ")], "doc_id long, text string")).orderBy("doc_id", "start").collect()
    assert [r["sentence"] for r in rows] == ["Dr. Wu left.", "Then he\ncame back...", "Yes!", "J. B. stayed"]
    assert all(text[r["start"] : r["end"]].strip() == r["sentence"] for r in rows) and rows[-1]["end"] == len(text)


def test_value_at_an_index_equals_sorting(spark):
    from prosemill.operators import order

    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(-9, 60)])) for k in "aab" for _ in range(rng.randint(1, 90))]
    df = spark.createDataFrame([*rows, ("none", None)], "k string, v long")
    for share in (0.0, 0.5, 0.95):
        got = dict(order.at_index(df, ["k"], "v", lambda n: F.floor(n * share), F.floor(F.col("v") / 7), "x").collect())
        sets = {k: sorted(v for q, v in rows if q == k and v is not None) for k in "ab"}
        assert got == {k: v[int(len(v) * share)] for k, v in sets.items() if v}


def test_rules_with_comment_lines(spark, tmp_path):
    columns = [x.split()[0] for x in readers.RULE.split(", ")]
    table = spark.createDataFrame([("big", "vast", "vast", "ADJ", "s", "apple", None, "n")], ", ".join(f"{c} string" for c in columns))
    sinks.rules(table, str(tmp_path / "rules"), ("made by hand", "second line"))
    (part,) = (tmp_path / "rules").glob("part-*")
    assert part.read_text().split("\n")[:3] == ["# made by hand", "# second line", "\t".join(columns)]
    (row,) = readers.rule_table(spark, str(tmp_path / "rules")).collect()
    assert (row["trigger"], row["block_context"], row["require_context"]) == ("big", ["apple"], [])


def test_vectors_are_compared_in_tiles(spark, tmp_path, monkeypatch):
    import duckdb
    import numpy as np

    r = random.Random(7)
    points = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, r.choice(points), r.choice([0, 1, 2, None])) for i in range(400)]  # many equal vectors
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(D, "_TILE", (3, 50))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("knn_neighbours", "bank_percentile", "context_gate"):
        want = c.sql(Q.SQL[name])
        assert sorted(map(repr, map(tuple, Q.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    ids = np.arange(2000)
    rows = __import__("pandas").DataFrame({"vec_id": np.arange(5000), "label": np.arange(5000) % 300, "e": list(np.random.default_rng(0).normal(size=(5000, 8)))})
    import tracemalloc

    for f in (D._nearest(ids, np.stack(rows["e"][:2000])), D._most(ids, np.stack(rows["e"][:2000]), ids % 300)):
        tracemalloc.start()
        for part in f(iter([rows])):
            del part
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 40e6  # all products at once are 80 MB


ODD = [None, "", " .. ", "one", "a b c d", "É A b c d e", "x" * 400 + " y z", "a b " * 9, "\n", "w" * 50 + " q q q q 1", "K İ don't 'tis 3rd_4th naïve-x end"]


def test_shingles_in_bytes_equal_those_of_columns(spark):
    from prosemill.functions import shingling

    r = random.Random(9)
    texts = [*ODD, *(" ".join("".join(r.choices("abcXYZ0'É ", k=r.choice([1, 3, 9, 30, 60]))) for _ in range(r.randrange(40))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sh = df.select("doc_id", "text", X.plain_tokens(F.col("text")).alias("w")).select("doc_id", "text", X.shingles(F.col("w")).alias("sh"))
    want = sh.select("doc_id", F.sort_array(F.transform("sh", lambda x: F.xxhash64(x))), dedup.minhash_md5(F.col("sh"), 8)).collect()
    got = df.select("doc_id", shingling.hashed(F.col("text")), shingling.minhash_md5(F.col("text"), 8)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_signatures_are_worked_out_once_in_batches(spark):
    plan = Q.QUERIES["minhash_signature"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan


def test_only_sets_that_may_be_in_a_pair_are_compared(spark):
    r = random.Random(10)
    sets = [sorted(r.sample(range(10**6), 300)) for _ in range(30)]
    near = [[*sets[0][:-9], *range(2 * 10**6, 2 * 10**6 + 9)], [*sets[1][:30], *range(3 * 10**6, 3 * 10**6 + 270)]]  # the second shares a tenth
    every = [*sets, *near, sets[2], sets[2]]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(every)], "doc_id long, sh array<string>")
    assert {x["doc_id"] for x in dedup.pairable(dedup.briefed(df), 0.8).collect()} == {0, 30}
    assert [(x["a"], x["b"]) for x in dedup.jaccard_pairs(df, 0.8).collect()] == [(0, 30)]


def test_dedup_counters_count_wordless_texts_as_sql(spark, tmp_path):
    import duckdb

    a = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, a), (2, a.upper()), (3, f"{a} more"), (4, "other words"), (5, ""), (6, None), (7, " \n "), (8, "other, words"), (9, None)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(Q.SQL["dedup_counters"])
    assert list(map(tuple, Q.QUERIES["dedup_counters"](spark, str(tmp_path)).select(*want.columns).collect())) == want.fetchall()


def test_pairs_counted_as_hashes_equal_those_of_columns(spark):
    from prosemill.functions import shingling
    from prosemill.plans.corpus_queries import bigram_counts

    texts = [*ODD, "don't -stop- it's a-b-c a--b 'x' o' 'n", "A b\na B", "x-y 'z-", "-", "'", "a", "a-"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = shingling.word_pairs(df).collect()
    want = bigram_counts(df).select(F.xxhash64("w1"), F.xxhash64("w2"), "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_texts_are_normalised_as_by_all_patterns(spark):
    def plainly(c):
        c = F.translate(c, X.FOLD_FROM, X.FOLD_TO)
        for mark, to in X.FOLD_LONG.items():
            c = F.replace(c, F.lit(mark), F.lit(to))
        for pattern, to in (
            (r"(?U)https?://\S+|www\.\S+", " "),
            (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.]+\b", " "),
            (r"(?U)\b(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", " "),
            (rf"(?<!{X.LETTER})(?:[@/][ur]/{X.LETTER}+|@{X.LETTER}{{2,}})", " "),
            (rf"(?<={X.LETTER})--+(?={X.LETTER})", " -- "),
            (r"[ \t]+", " "),
            (r"(?U)\s+([,.;:!?%)\]}])", "$1"),
            (r"(?U)([(\[{])\s+", "$1"),
            (r" *\n *", "\n"),
            (r"(?U)^\s+|\s+\z", ""),
        ):
            c = X.sub(c, pattern, to)
        return c

    r = random.Random(11)
    parts = [" ", "  ", "\t", "\n", " \n", " ", "a", "Bc", "é", "-", "--", "—", "…", "“", "’", "(", " )", ",", " .", "@", "/u/", "/r/", "@user", "www.", "http://", "x@y.z", "555", "1234", "555-123-4567", "(555) 123 4567", "5551234"]
    texts = [None, "", *("".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(600))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert not [x for x in df.select("t", X.normalize(F.col("t")), plainly(F.col("t"))).collect() if x[1] != x[2]]


def test_articles_before_words_of_any_letters(spark):
    assert of(spark, X.fix_articles, "éa hour, a hour", "xa apple a apple _a egg", "A one.a egg", "ba an a n apple") == ["éa hour, an hour", "xa apple an apple _a egg", "A one.an egg", "ba an a n apple"]


def test_reports_read_the_texts_as_often_as_they_must(spark):
    plan = lambda name: Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("pipeline_counters").count("documents.parquet") == 2  # once for the gates, once for the sentences
    assert "documents.parquet" not in plan("band_sweep") + plan("coverage_report")  # all is counted over written sentences and hits
    assert plan("finish_report").count("documents.parquet") == 1  # the names
