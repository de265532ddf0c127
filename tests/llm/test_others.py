import base64
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, defects, endings, leakage, markup, mixing, pieces, truncation
from corpusloom.runtime import Scratch

# Encoding


def reference(path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


PATH = f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}"


def test_encoding_equals_the_library(spark):
    rng = random.Random(3)
    texts = ["", "Hello world", "don't we'll", "日本語 текст é​ \n\n  x", "<|endoftext|>", "a" * 5000, "=-" * 700, "x" * bpe.LONG_WORD, "ab" * bpe.LONG_WORD]
    texts += ["".join(rng.choice("ab cé日\n0'.") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    own, lib = {}, reference(PATH)
    for r in bpe.encode_column(df).collect():
        own[r["doc_id"]] = r["ids"]
    assert own[900] == [] and own[0] == []
    for i, t in enumerate(texts):
        assert own[i] == lib.encode_ordinary(t), t[:30]
    assert bpe.encode_column(df.limit(0)).count() == 0
    counted = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.select("doc_id", "text")).collect()}
    assert counted[900] == 0 and counted[1] == len(own[1])
    with pytest.raises(ValueError):
        bpe.count_tokens(df.withColumn("n_tokens", F.lit(1)))


def test_both_merges_agree():
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("aabcé日tion ") for _ in range(rng.randrange(1, 60))).encode()
        assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)


# Mixing


def test_plan():
    sizes = {"a": 1000, "b": 100, "none": 0}
    targets = {"a": (0.5, 1), "b": (0.4, 2), "none": (0.1, 3)}
    exact = mixing.plan_amounts(sizes, targets)
    assert exact == pytest.approx({"a": 250, "b": 200})
    more = mixing.plan_amounts(sizes, targets, 900)
    assert more == pytest.approx({"a": 700, "b": 200})
    assert mixing.plan_amounts(sizes, targets, 10**9) == pytest.approx({"a": 1000, "b": 200})
    assert mixing.plan_amounts({}, targets) == {}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, "ab"[i % 2] if i < 1500 else "c", rng.randrange(1, 60)) for i in range(1600)]
    docs += [(5000, "a", 0), (5001, "other", 9), (5002, None, 5), (5003, "a", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("whole", F.lit(1))
    goal = [("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 4), ("empty", 0.1, 1), (None, 0.3, 1), ("a", None, 2)]
    targets = spark.createDataFrame(goal, "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, targets, Scratch(spark, "t"))
    rows = mix.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 1602
    limit = {"a": 1, "b": 2, "c": 4}
    assert all(0 <= r["copies"] <= limit[r["source"]] for r in rows)
    report = {r["source"]: r for r in mixing.share_report(mix, targets).collect()}
    for s, share in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        got = report[s]["mix_tokens"]
        whole = sum(r["mix_tokens"] for r in report.values())
        assert abs(got - share * whole) < 120, (s, got, share * whole)
    assert report["empty"]["documents"] == 0 and report["empty"]["mix_share"] == 0
    assert mixing.mix_sources(df.limit(0), targets, Scratch(spark, "t")).count() == 0
    assert mixing.mix_sources(df, targets.limit(0), Scratch(spark, "t")).count() == 0


# Pieces


def check_pieces(text, limit, overlap):
    parts = pieces.split_text(text, limit, overlap)
    words = text.split()
    rebuilt = []
    for k, (piece, n, shared) in enumerate(parts):
        own = piece.split()
        assert len(own) == n <= limit
        assert shared == (overlap if k else 0)
        if k:
            assert rebuilt[-overlap:] == own[:overlap] or not overlap
        rebuilt += own[shared:]
    assert rebuilt == words
    return parts


def test_pieces_cover_and_overlap():
    rng = random.Random(2)
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 30)):
            kind = rng.randrange(6)
            body = " ".join(rng.choice(["word", "end.", "a,", "x;"]) for _ in range(rng.randrange(1, 90)))
            lines.append({0: "## Head", 1: "", 2: "- " + body, 3: "```\ncode a\ncode b\n```", 4: body, 5: "== H =="}[kind])
        text = "\n".join(lines)
        if len(text.split()) > 60:
            check_pieces(text, 60, 10)
            check_pieces(text, 33, 0)


def test_pieces_cut_at_headings_and_sentences():
    block = " ".join(["one two three four five six seven eight nine ten."] * 30)
    text = f"# A\n{block}\n\n# B\n{block}"
    parts = check_pieces(text, 450, 64)
    assert len(parts) == 2 and " ".join(parts[1][0].split()[64:]).startswith("# B")
    long = check_pieces("w " * 5000, 450, 64)
    assert all(n <= 450 for _, n, _ in long)
    sentences = check_pieces(block * 3, 450, 64)
    assert all(p.endswith("ten.") or "ten." in p.split()[-1] for p, _, _ in sentences)


def test_pieces_keep_the_borders_of_split_nodes():
    section = lambda name, sizes: f"# {name}\n" + "\n\n".join(" ".join([name.lower() + "."] * n) for n in sizes)
    text = "\n\n".join([section("A", [68]), section("B", [123, 124, 124, 124]), section("C", [58]), section("D", [100])])
    parts = check_pieces(text, 450, 64)
    own = [p.split()[shared:] for p, _, shared in parts]
    assert [{w.strip(".").upper() for w in x} - {"#"} for x in own] == [{"A"}, {"B"}, {"B"}, {"C", "D"}]
    short = check_pieces("\n\n".join([section("A", [50]), section("B", [300, 300])]), 450, 64)
    assert len(short) == 2 and short[0][0].startswith("# A") and short[0][1] == 354


def test_split_table(spark):
    rows = [("a", "s", "w " * 451), ("a", "s", "w " * 451), ("b", None, "w " * 450), ("c", "s", None), ("d", "", " "), (None, "s", "w\n" * 900)]
    df = spark.createDataFrame(rows, "chunk_id string, section string, text string").withColumn("piece", F.lit(1))
    got = [tuple(r)[:5] for r in pieces.split_oversized(df, Scratch(spark, "t")).orderBy("chunk_id", "piece_no").collect()]
    assert [g for g in got if g[0] == "a"] == [("a", "s", 1, 2, 386), ("a", "s", 2, 2, 129)]
    assert {g[0] for g in got} == {"a", None}
    assert pieces.split_oversized(df.limit(0), Scratch(spark, "t")).count() == 0


# Leakage


def test_leaks(spark):
    q = "What does the small model change in the big table of results today"
    items = spark.createDataFrame([(1, q), (2, "Only four words here"), (3, None), (4, "?!"), (5, q.upper())], "item_id int, question string")
    w = q.split()
    rows = [
        (10, "x " + " ".join(w[2:10]) + " y", None), (11, " ".join(w[2:9]) + " no", ""), (12, "", "so: only FOUR, words-here!"), (13, None, None),
        (14, "only four words", "here"), (10, "x", "y"), (None, q, q), (15, "only four words", "only four\nwords here"),
    ]
    df = spark.createDataFrame(rows, "qa_id long, input string, output string").withColumn("item_id", F.lit("clash"))
    got = {tuple(r) for r in leakage.leaked_items(df, items).collect()}
    assert got == {(10, 1), (10, 5), (12, 2), (15, 2)}
    assert leakage.leaked_items(df.limit(0), items).count() == 0 and leakage.leaked_items(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("edits, repetitions", [(1, 16), (2, 16), (3, 32)])
def test_leaks_with_edits_reach_recall(spark, edits, repetitions):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(3000)]
    items, rows = [], []
    for i in range(80):
        q = [rng.choice(names) for _ in range(12)]
        items.append((i, " ".join(q)))
        edited = list(q)
        for at in rng.sample(range(12), edits):
            edited[at] = "changed"
        rows.append((i, "pad " + " ".join(edited) + " pad", ""))
    df = spark.createDataFrame(rows, "qa_id long, input string, output string")
    found = leakage.leaked_items(df, spark.createDataFrame(items, "item_id long, question string"), width=12, max_edits=edits, repetitions=repetitions, sampled=6)
    got = {tuple(r) for r in found.collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.9 * 80


# Markup


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("plain words, 2 * 3 * k, a_b_c, $5 to $9, x < 3 and y > 2, [45, 70], {a, b}", []),
        ("R&D and P(y|x), C:\\runs and D:\\x, x<y but y>z, C# and #5", []),
        ("a <b>bold</b> word", ["html"]), ("caf&eacute; &#9;", ["html"]), ("x <!-- note --> y", ["html"]), ("<em\n id=x>t</em>", ["html"]),
        ("# Head\ntext", ["markdown"]), ("Title\n=====\n", ["markdown"]), ("some *word* here", ["markdown"]), ("some __word__ here", ["markdown"]),
        ("a [link](http://x)", ["markdown"]), ("fact[^3] here", ["markdown"]), ("use `code` now", ["markdown"]), ("- [ ] task", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("> quoted", ["markdown"]), ("see [[Page|it]]", ["wiki"]), ("{{term|x}}", ["wiki"]),
        ("'''bold''' words", ["wiki"]), ("== Head ==\nx", ["wiki"]), ("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"]),
        ("an \\emph{idea}", ["latex"]), ("81\\% of", ["latex"]), ("$n = 3$ layers", ["latex"]), ("\\[ x \\]", ["latex"]), ("{\\it x}", ["latex"]),
        ("```\n<b>[[x]] $y$ # no\n```", ["markdown"]), ("<pre><code>**x** [[y]]</code></pre>", ["html"]), (None, []), ("", []),
    ],
)
def test_kinds(text, kinds):
    assert markup.markup_kinds(text) == kinds


def test_long_formulas_are_latex():
    formula = "$" + " + ".join(f"x_{i} [[y]]" for i in range(200)) + "$"
    assert markup.markup_kinds(f"the sum {formula} here") == ["latex"]
    assert markup.clean_text(f"the sum {formula} here") == (f"the sum {formula} here", ["latex"])


def test_clean_keeps_structure():
    text = "<h2>Head</h2>\n<ul><li>one</li><li>two</li></ul>\n```python\nif a < b:\n    *x*\n```\nAn <i>idea</i> of $x_1$ and [it](http://u) &amp; more."
    clean, kinds = markup.clean_text(text)
    assert kinds == ["html", "markdown", "latex"]
    assert "## Head" in clean and "- one" in clean and "- two" in clean
    assert "```\nif a < b:\n    *x*\n```" in clean and "An idea of $x_1$ and it & more." in clean
    assert markup.clean_text("as it is") == ("as it is", []) and markup.clean_text(None) == (None, [])
    assert markup.clean_text("\\section{One}\n\\begin{itemize}\n\\item a\n\\end{itemize}")[0].split() == ["#", "One", "-", "a"]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("**bold** \x0299\x03 end", "bold \x0299\x03 end"), ("**b** `a` \x020\x03 \x03", "b a \x020\x03 \x03"),
        ("\\textbf{\\emph{\\textit{\\textsc{\\texttt{deep}}}}} x", "deep x"), ("\\emph{" * 3000 + "deep" + "}" * 3000, "deep"),
        ("\\section{The \\emph{x} way}\nword~\\cite{a{b}c} on\\footnote{see \\textbf{b}}.", "# The x way\n\nword on (see b)."),
        ("see {{a|{{b|c}}|d}}[[z|y]] {{term|{{x}}w}}", "see y w"), ("{{a|" * 2000 + "}}" * 2000 + "[[b]]", "b"), ("[[a]] {{open", "a {{open"),
        ("\\emph{never closed, {a} and C:\\dir{b}", "\\emph{never closed, {a} and C:\\dir{b}"),
        ("$$x `y` $$ and `a $b$ c`", "$$x y$$ and a $b$ c"), ("\\begin{itemize}[x] \\item one \\item two \\end{itemize}", "- one\n- two"),
    ],
)
def test_clean_text_has_no_depth_it_stops_at(text, clean):
    assert markup.clean_text(text)[0].strip() == clean


def test_record_kinds(spark):
    df = spark.createDataFrame([("a", "<b>x</b>"), ("a", "<b>x</b>"), ("b", None), ("c", "x" * 300_000), (None, "# x")], "id string, text string").withColumn("kinds", F.lit(1))
    got = [tuple(r) for r in markup.record_kinds([("t", df, "id", "text")]).collect()]
    assert got == [("t", "a", "html")]
    cleaned = {r["id"]: r["clean"] for r in markup.strip_markup(df.limit(3), "id", "text").collect()}
    assert cleaned == {"a": "x", "b": None}


# Endings


@pytest.mark.parametrize(
    "text, broken",
    [
        ("A whole sentence.", False), ("A sentence. And then the", True), ("It said: one. The gap betw…", True), ("One. The score ...", True),
        ("One is done. A prompt templat�", True), ("One. Dratsk&#82", True), ("He put it: \"the list is coarse\"", False), ("Done.\n- one\n- two", False),
        ("Done.\n[3] A. Bulo, sparse heads, 2016, pp. 89-100", False), ("Done.\nMore at https://a.example/notes/1", False), ("Done.\n\nKeywords: a b, c d", False),
        ("Done.\n\ns(q, d) = 34.5 r + 58", False), ("Done.\n\nR. Marpai", False), ("A\t1\t2\nB\t3\t4", False), ("x = 1\nreturn foo(x)", False),
        ("On the table parser of quantised outliers", False), ("Distilled users", False), ("我们比较了两者。", False), ("我们比较了两者。我们比", True), ("", False), ("  \n", False),
        ("Is it worth it?", False), ("Labels, then unstable sentences", False),
    ],
)
def test_breaks_off(text, broken):
    assert bool(endings.breaks_off(text)) == broken


def test_truncated(spark):
    long = "The first sentence of this text has quite a few words in it so that it is long. The second one goes on and ends here."
    rows = [(1, "s", long), (2, "s", long[:97]), (3, "s", long[:79]), (4, "t", long), (5, None, long[:97] + " ..."), (6, "s", None), (7, "s", ""), (2, "s", long[:97]), (None, "s", "x. The y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("how", F.lit(1))
    got = {r["doc_id"]: r["how"] for r in truncation.truncated(df, Scratch(spark, "t")).collect()}
    assert set(got) == {2, 5} and got[2] == "prefix"
    assert truncation.truncated(df.limit(0), Scratch(spark, "t")).count() == 0
    rates = {r["source"]: (r["documents"], r["truncated"]) for r in truncation.truncation_rates(df, truncation.truncated(df, Scratch(spark, "t"))).collect()}
    assert rates[None] == (1, 1) and rates["t"] == (1, 0)


def test_longer_copies_equal_brute_force(spark):
    rng = random.Random(9)
    head = "shared start of many texts " * 4
    texts = sorted({head + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"] for r in truncation.longer_copies(df, Scratch(spark, "t")).collect()}
    assert got == {i for i, a in enumerate(texts) if any(b != a and b.startswith(a) for b in texts)}


def test_prefixes_break_off_wherever_the_copy_goes_on(spark):
    start = "The first sentence of this text has quite a few words in it so that it is long.\n"
    item = start + "- the second line is an item that Marpai checks [twice] over three runs\n- the last one ends it"
    chinese = "我们比较了两种模型。" * 8 + "\n- 结果很好。"
    texts = {
        1: item, 2: item[: item.index(" that")], 3: item[: item.index("Marpai")], 4: item[: item.index("- the last")], 5: item[: item.index(" runs")] + " [truncated]",
        6: item[: item.index(" over")] + " (cut)", 7: start + "Keywords: caches, tables, runs", 8: start + "Keywords: caches, tab", 9: start + "Keywords: caches", 10: start,
        11: "Keywords: recall", 12: "Keywords: rec", 13: "Biased tables", 14: "Biased tables pass through the cache and the runs that follow it.",
        15: chinese, 16: chinese[:-3], 17: item[: item.index(" checks")] + "&am", 18: item[: item.index(" item")] + ".", 19: "...",
    }
    df = spark.createDataFrame([(k, "s", t) for k, t in texts.items()], "doc_id long, source string, text string").repartition(5)
    got = {r["doc_id"] for r in truncation.truncated(df, Scratch(spark, "t")).collect()}
    assert got == {2, 3, 5, 6, 8, 9, 12, 16, 17}
    copies = {r["doc_id"] for r in truncation.longer_copies(df, Scratch(spark, "t")).collect()}
    assert copies == {2, 3, 4, 5, 6, 8, 9, 10, 12, 13, 16, 17, 18}


def test_a_copy_that_goes_on_counts_before_one_that_ends_there(spark):
    line = "- an item of a list that has more than sixty-four characters until here"
    df = spark.createDataFrame([(1, "s", line), (2, "s", line + "\n- b"), (3, "s", line + ". B."), (4, "s", line + " and there.")], "doc_id long, source string, text string")
    assert [r["doc_id"] for r in truncation.truncated(df, Scratch(spark, "t")).collect()] == [1]


# Defects

PROMPT = "Context from 'X' (y):\nsome passage.\n\nQuestion: What does the model change in the table of results for the second run?"


@pytest.fixture(scope="module")
def tagger():
    answers = [
        "The model lowers the error by 3.2 points because the cache is small.", "In most runs the ranking list moves by two points. The rest stays.",
        "The authors do not report recall, but they do give 0.8 for the second set.", "It doubles the score on the first split, while the others stay.",
    ]
    refusals = ["I cannot answer this from the passages.", "Sorry, I can't help with that one.", "The passages are silent on this point.", "I don't know."]
    return defects.fit_tagger([("grounded", PROMPT, a) for a in answers * 60] + [("refusal", PROMPT, r) for r in refusals * 30])


@pytest.mark.parametrize(
    "kind, output, defect",
    [
        ("grounded", None, "empty"), ("grounded", " \n", "empty"), ("grounded", "N/A", "empty"), ("refusal", "...", "empty"), ("grounded", "​", "empty"),
        ("grounded", "<think></think>", "empty"), ("grounded", "No.", None), ("grounded", "28.9%", None), ("grounded", "The model lowers the error by 3.2 points.", None),
        ("grounded", "The model lowers the error by 3.2 points. In most runs the rank", "truncated"), ("grounded", "The model lowers the error. Code:\n```\nx = 1\n", "truncated"),
        ("grounded", "The model lowers the error.\n- first rows\n- second rows", None), ("grounded", "I cannot answer this from the passages.", "refusal"),
        ("refusal", "I cannot answer this from the passages.", None), (None, "I cannot answer this from the passages.", None),
        ("grounded", "What does the model change in the table of results for the second run?", "copy"),
        ("refusal", "Question: WHAT DOES THE MODEL CHANGE IN THE TABLE OF RESULTS FOR THE SECOND RUN", "copy"),
        ("grounded", "What does the model change in the table of results for the second run? It lowers the error by 3.2 points because the cache is small.", None),
        ("grounded", "Das Modell verringert die Fehlerquote auf dem zweiten Datensatz um drei Punkte, weil der Speicher klein ist.", "language"),
        ("grounded", "模型在第二个数据集上降低了错误率。", "language"),
    ],
)
def test_defects(tagger, kind, output, defect):
    assert defects.pair_defect(kind, PROMPT, output, tagger) == defect


LONG = "After going through every passage that came with the question and after looking for the second run in each of the tables that stand there"


@pytest.mark.parametrize(
    "output, defect",
    [
        (LONG + " I cannot answer this from the passages and sorry I can't help with that one as the passages are silent on this point.", "refusal"),
        ("```\n" + LONG + "\nI cannot answer this from the passages\nSorry, I can't help with that one\n```", "refusal"),
        (LONG + " the model lowers the error by 3.2 points because the cache is small and the ranking list moves by two points.", None),
    ],
)
def test_long_clauses_are_tagged_to_their_end(tagger, output, defect):
    assert defects.pair_defect("grounded", PROMPT, output, tagger) == defect


def test_every_word_and_pair_of_a_clause_is_a_feature():
    words = [f"w{i}" for i in range(100)]
    found, parts, facts = defects.clause_features(" ".join(words) + ".", "What is it?")
    assert len(found) == 1 and sum(x["words"] for x in facts) == 100 and all(len(f) + len(w) <= defects.WIDTH for f, w in parts)
    seen = {w for _, own in parts for w in own}
    tongue = f"{defects.language(' '.join(words))}0 "
    assert {tongue + w for w in words} <= seen
    assert {f"{tongue}{a} {b}" for a, b in zip(words, words[1:])} <= seen


def test_words_never_learned_make_no_refusal(tagger):
    """Plain answers in languages the sample lacks, whatever their words."""
    rng = random.Random(8)
    for _ in range(50):
        text = " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(9)).capitalize() + "."
        assert defects.pair_defect("grounded", PROMPT, text, tagger) is None


def test_a_tagger_is_stored(tagger, tmp_path):
    tagger.save(str(tmp_path / "t"))
    again = defects.Tagger.load(str(tmp_path / "t"))
    parts = defects.clause_features("I cannot answer this from the passages. It stays.", "What is it?")[1]
    assert again.decode(parts) == tagger.decode(parts) and defects.REFUSAL in again.decode(parts)


def test_foreign_pair_is_sound(tagger):
    prompt = "Question: Wie verändert das Modell die Fehlerquote, wenn die Texte lang sind und der Speicher klein ist?"
    assert defects.pair_defect("grounded", prompt, "Das Modell verringert die Laufzeit um drei Punkte, weil der Speicher nicht reicht.", tagger) is None


def test_broken_pairs(spark):
    rows = [(1, " Grounded ", PROMPT, None), (2, "refusal", PROMPT, "I don't know."), (3, None, None, "Fine words that answer it."), (1, "grounded", PROMPT, None), (None, "grounded", PROMPT, "")]
    df = spark.createDataFrame(rows, "qa_id long, type string, input string, output string").withColumn("defect", F.lit(1)).withColumn("kind", F.lit(2))
    assert [tuple(r) for r in defects.broken_pairs(df).collect()] == [(1, "empty")]
    assert defects.broken_pairs(df.limit(0)).count() == 0
    fitted = defects.fit_tagger([("refusal", PROMPT, "I don't know.")] * 9)
    assert [tuple(r) for r in defects.broken_pairs(df, tagger=fitted).collect()] == [(1, "empty")]
