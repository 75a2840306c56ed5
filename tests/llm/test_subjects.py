import random
from collections import defaultdict

import pytest

from cladeflow.llm import latex, queries, subjects


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (r"One two. Three % four" + "\nfive.", "one two | three five |"),
        (r"a \% b 5\% c", "a b c"),
        (r"\newcommand{\x}{big cats\xspace}\providecommand\x{no}\def\y{red~dogs} \x{} and \y.", "big cats and red dogs |"),
        (r"\newcommand{\a}{\b s}\newcommand{\b}{bird}see \a.", "see bird s |"),
        (r"pre \begin{document}In\-side \emph{soft words} here.\end{document} after", "| inside soft words here |"),
        (r"a \begin{comment} b. c \end{comment} d \iffalse e \fi f", "a d f"),
        (r"a \begin{thebibliography}{1} \bibitem{x} b. \end{thebibliography} c", "a c"),
        (r"a \begin{verbatim} 95% b \end{verbatim} c", "a c"),
        (r"a $x_{y}$ b \[ z \] c \begin{align*} q \end{align*} d $$k$$ e", "a b c d e"),
        (r"\section{Head \emph{x}}\label{q} a \cite[see][p.~1]{b} c\footnote{no \emph{n}.} d \ref{e}", "| a c d"),
        ("a\n\nb \\item c \\begin{itemize} d", "a | b | c | d"),
        (r"a \begin{comment} never closed. b", "a"),
        (r"A\textbf{bc} d~e f\\g; h, i", "abc d e f g h i"),
        ("ﬁsh café zero​width", "fish café zerowidth"),
        (r"\newcommand{\x}[1]{big #1 cats}see \x{red} and \x z.", "see big red cats and big z cats |"),
        (r"\newcommand{\draft}[1]{}a \draft{never {printed}. no} b", "a b"),
        (r"\newcommand\y[2][old]{#1 #2}\y{dog} \y[new]{dog}", "old dog new dog"),
        (r"\def\z#1#2{#2 #1}\z{a}{b} \def\q#1;{#1}\q c; d", "b a c d"),
        (r"\newcommand{\a}[1]{\b{#1} e}\newcommand{\b}[1]{<#1>}\a{\b{in}}", "in e"),
        (r"\newcommand{\r}{x \r y}\r", " ".join("x" * 8 + "y" * 8)),
        (r"\newcommand{\x}[2]{#1 #2}\x{a", "a"),
        ("".join(rf"\newcommand{{\m{c}}}{{\m{d} {c}}}" for c, d in zip("abcdefghijkl", "bcdefghijklm")) + r"\newcommand{\mm}{deep}\ma", "deep l k j i h g f e d c b a"),
        ("", ""), ("   ", ""), (r"\input{x} \include{y}", ""), ("\\", ""), ("{", ""), ("$", ""), (r"\def\z{\z}\z a", "a"),
    ],
)
def test_words(text, expected):
    assert " ".join("|" if w == latex.END else w for w in latex.words(text)) == expected


def test_macros_that_grow_without_end_stop():
    bomb = "".join(rf"\newcommand{{\m{c}}}{{\m{d}\m{d}}}" for c, d in zip("abcdefghijklmnopqrstuvwxy", "bcdefghijklmnopqrstuvwxyz")) + r"\newcommand{\mz}{word }\ma end"
    assert latex.words(bomb)[-1] == "end"
    chain = "".join(rf"\newcommand{{\{'a' * i}}}{{\{'a' * (i + 1)}}}" for i in range(1, 400)) + r"\a end"
    assert latex.words(chain) == ["end"]


def corpus(seed, n):
    """Documents of sentences with two phrases of a subject or none, some with two subjects, stray phrases and drafts."""
    r = random.Random(seed)
    phrases = {s: [f"{s}a{i} {s}b{i}" for i in range(12)] for s in ("red", "green", "blue", "grey")}
    frames = ["The role of {} becomes visible once {} are known.", "Models of {} rarely include {}.", "We compare {} with {}.", "Little is known about {} near {}."]
    fill = ["No funding was received.", "The proof is left out.", "All tables were checked twice.", "The code is available."]
    for i in range(n):
        own = r.sample(sorted(phrases), r.choice([1, 1, 2]))
        other = r.choice([s for s in phrases if s not in own])
        lines, n_of = [], defaultdict(int)
        for _ in range(r.randint(8, 30)):
            if r.random() < 0.3:
                lines.append(r.choice(fill))
                continue
            s = r.choice(own)
            n_of[s] += 1
            a, b = r.sample(phrases[s], 2)
            lines.append(r.choice(frames).format(a, b))
        lines.append("% " + r.choice(frames).format(*r.sample(phrases[other], 2)))
        lines.append(r"\begin{comment}" + " ".join(r.choice(frames).format(*r.sample(phrases[other], 2)) for _ in range(9)) + r"\end{comment}")
        total = sum(n_of.values())
        yield i, "\n".join(lines), {s for s, k in n_of.items() if k >= 0.25 * total}, own


def test_held_out_accuracy(spark):
    train, test = list(corpus(1, 300)), list(corpus(2, 300))
    r = random.Random(9)
    labels = [(i, r.choice(own) if r.random() < 0.95 else "red", "x") for i, _, _, own in train if r.random() < 0.7]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in train], "doc_id long, text string")
    names = spark.createDataFrame([(s,) for s in ("red", "green", "blue", "grey", None)], "subject string")
    models = subjects.train(spark.createDataFrame([*labels, (None, "red", "x"), (1, None, "x"), (2, "unknown", "x")], "doc_id long, subject string, rater string"), docs, names)
    held = spark.createDataFrame([(i, t, 1) for i, t, _, _ in test] + [(None, None, 1), (1000, "", 1), (1001, " \n", 1), (1002, "No funding was received.", 1)], "doc_id long, text string, subject int")
    got = defaultdict(set)
    for x in subjects.document_subjects(held, models).collect():
        got[x["doc_id"]].add(x["subject"])
    hits = sum(len(got[i] & truth) for i, _, truth, _ in test)
    assert hits / sum(len(v) for v in got.values()) > 0.97 and hits / sum(len(t) for _, _, t, _ in test) > 0.97
    assert not got[None] and not got[1000] and not got[1001] and not got[1002]


def test_repeated_rows_and_empty_tables(spark):
    models = subjects.fit([latex.words(t) for _, t, _, _ in corpus(3, 120)], [own for *_, own in corpus(3, 120)], ["blue", "green", "grey", "red"])
    text = next(corpus(4, 1))[1]
    df = spark.createDataFrame([(5, text), (5, text), (6, text * 300)], "doc_id long, text string")
    got = sorted(tuple(r) for r in subjects.document_subjects(df, models).collect())
    one = [s for i, s in got if i == 6]
    assert one and [s for i, s in got if i == 5] == sorted(one * 2)
    assert subjects.document_subjects(df.limit(0), models).collect() == []
    none = subjects.train(spark.createDataFrame([], "doc_id long, subject string"), df, spark.createDataFrame([("a",)], "subject string"))
    assert subjects.document_subjects(df, none).collect() == []


def test_fit_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, "a") for i in range(3000)] + [(i, "b") for i in range(5)], "doc_id long, subject string")
    docs = spark.createDataFrame([(i, f"text {i}.") for i in range(3000)], "doc_id long, text string")
    found = subjects.fit_sample(labels, docs, 64)
    assert 64 <= found.num_rows <= 64 + 64 + 5 and sum("b" in x for x in found.column("subjects").to_pylist()) == 5


def test_fit_sample_is_bounded_in_words(spark, monkeypatch):
    monkeypatch.setattr(subjects, "FIT_WORDS", 700)
    labels = spark.createDataFrame([(i, "a") for i in range(300)], "doc_id long, subject string")
    docs = spark.createDataFrame([(i, "some words here " * 10) for i in range(300)], "doc_id long, text string")
    found = subjects.fit_sample(labels, docs, 400)
    assert found.num_rows == 23 and sum(len(x) for x in found.column("words").to_pylist()) <= 700  # of 30 words each


def test_thresholds_are_of_held_out_documents_and_of_each_subject():
    docs, labels = [latex.words(t) for _, t, _, _ in corpus(6, 200)], [own for *_, own in corpus(6, 200)]
    models = subjects.fit(docs, labels, ["blue", "green", "grey", "red"])
    assert models.thresholds.shape == (4,) and set(models.thresholds) <= set(subjects.THRESHOLDS)
    # a subject without labels has the threshold of all together
    more = subjects.fit(docs, labels, ["blue", "green", "grey", "none", "red"]).thresholds
    assert more.shape == (5,) and more[3] in subjects.THRESHOLDS


def test_queries_run(spark):
    for name in queries.QUERIES:
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
