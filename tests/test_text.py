import pytest
from pyspark.sql import functions as F

from paperloom.functions import citations, html, text as T, vector as V
from paperloom.operators import chunking


def _one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


def _kind(spark, text, title=None):
    df = spark.createDataFrame([(1, text, title)], "doc_id int, text string, given string")
    row = chunking.analyze(df, given_title="given").first()
    return row.struct_type, row.title


WORDS = " ".join(["word"] * 160)


@pytest.mark.parametrize("text, kind", [
    (" ".join(["w"] * 149), "short"),
    (" ".join(["w"] * 150), "prose"),
    ("```\nx\n```\n" + WORDS, "code"),
    ("\n".join(["x = f(1)"] * 3 + ["plain line"] * 6 + [WORDS]), "code"),
    ("\n".join(["x = f(1)"] * 2 + ["plain line"] * 6 + [WORDS]), "prose"),
    ("\n".join(["- item"] * 4 + ["plain"] * 5 + [WORDS]), "list"),
    ("\n".join(["1. item"] * 3 + ["plain"] * 5 + [WORDS]), "prose"),
    ("# a\ntext\n## b\n" + WORDS, "structured"),
    ("# a\ntext\n" + WORDS, "prose"),
])
def test_struct_type(spark, text, kind):
    assert _kind(spark, text)[0] == kind


@pytest.mark.parametrize("first, title", [
    ("## Big Plan", "Big Plan"),
    ("A" * 59, "A" * 59),
    ("Overview of things:", "Overview of things"),
    ("One two three. four", "One two three"),
])
def test_titles(spark, first, title):
    assert _kind(spark, first + "\n\n" + WORDS)[1].startswith(title)


def test_title_limits(spark):
    long_caps = "A" * 60
    assert _kind(spark, long_caps + "\n" + WORDS)[1].split() == [long_caps] + ["word"] * 11
    colon = "x" * 79 + ":"
    assert _kind(spark, colon + "\n" + WORDS)[1].startswith(colon)
    assert _kind(spark, "short text")[1] is None
    assert _kind(spark, "short text", "Given")[1] == "Given"
    assert _kind(spark, ". " + WORDS)[1] is None


def test_words_and_tokens(spark):
    assert _one(spark, T.word_count(F.col("t")), t="a b\xa0c\n d\x1ce") == 5
    assert [_one(spark, T.estimate_tokens(F.lit(n)), t="") for n in (0, 1, 4, 5)] == [1, 1, 3, 4]


@pytest.mark.parametrize("text, slug", [
    ("  Hello,  World__x! ", "hello-world-x"), ("É--ü", "é-ü"), ("!!!", ""), ("a" * 59 + " b", "a" * 59),
])
def test_slug(spark, text, slug):
    assert _one(spark, T.slugify(F.col("t")), t=text) == slug


def test_paths(spark):
    path = T.doc_path(F.lit("docs"), F.col("g"), F.col("k"), F.col("s"), F.col("d"), F.col("e"))
    assert _one(spark, path, g="g", k="", s=None, d="A.MD", e="") == "docs/g/reference/unknown-source/A.MD"
    assert _one(spark, path, g="g", k="design", s="jira", d="a", e=None) == "docs/g/design/jira/a.md"
    assert _one(spark, path, g="g", k="design", s="jira", d="a", e="kept.md") == "kept.md"


def test_group_names(spark):
    name = T.new_group_name(F.col("a"), F.col("p"), F.col("t"), F.col("d"))
    assert _one(spark, name, a=None, p="  ", t="My Title", d="x") == "my-title"
    assert _one(spark, name, a="Agent Pick", p="p", t="t", d="x") == "agent-pick"
    assert _one(spark, name, a=None, p=None, t="", d="DOC 1") == "doc-1"
    assert _one(spark, name, a=None, p=None, t=None, d=None) == "new-group"


def test_assigned_group_name(spark):
    df = spark.createDataFrame(
        [("g1", [("g0", "zero"), ("g1", "one")]), ("g2", [("g2", None)]), ("", []), ("g9", None)],
        "t string, c array<struct<id: string, name: string>>",
    )
    names = [r.x for r in df.select(T.assigned_group_name(F.col("t"), F.col("c")).alias("x")).collect()]
    assert names == ["one", "g2", None, "g9"]


def _chunks(spark, text, chunker, title=None):
    df = spark.createDataFrame([(1, text, title)], "doc_id int, text string, given string")
    rows = chunker(chunking.analyze(df, given_title="given").drop("given")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.total_chunks == len(rows) for r in rows)
    return [r.chunk_text for r in rows]


def test_windows_cover_the_text(spark):
    words = [f"w{i}" for i in range(1300)]
    chunks = _chunks(spark, " ".join(words), chunking.window_chunks, title="")
    parts = [c.split() for c in chunks]
    assert [len(p) for p in parts] == [512, 512, 404]
    assert parts[0] + parts[1][64:] + parts[2][64:] == words
    assert len(_chunks(spark, " ".join(words[:512]), chunking.window_chunks, title="")) == 1
    assert len(_chunks(spark, " ".join(words[:513]), chunking.window_chunks, title="")) == 2


@pytest.mark.parametrize("chunker", [chunking.window_chunks, chunking.recursive_chunks])
def test_short_document_is_one_chunk(spark, chunker):
    assert _chunks(spark, "a  b\nc", chunker, title="T") == ["T\n\na  b\nc"]
    assert _chunks(spark, "a  b\nc", chunker) == ["a  b\nc"]


def test_recursive_chunks_keep_all_words_in_order(spark):
    text = "\n\n".join(f"Paragraph {i}. " + " ".join(f"p{i}w{j}" for j in range(90)) + "." for i in range(20))
    chunks = _chunks(spark, text, chunking.recursive_chunks, title="")
    assert len(chunks) > 2
    seen, position = [], 0
    for chunk in chunks:
        assert len(chunk.split()) * 0.75 <= 512 + 1
        at = text.find(chunk)
        assert 0 <= at <= position + 2
        seen.append(text[position:at + len(chunk)] if at < position else text[position:at] + chunk)
        position = max(position, at + len(chunk))
    assert position == len(text)


@pytest.mark.parametrize("fence", ["```", "~~~", "````"])
def test_fenced_code_is_never_cut(spark, fence):
    code = f"{fence}python\n" + "\n".join(f"call_{i}(a, b)" for i in range(900)) + f"\n{fence}\n"
    text = WORDS + "\n\n" + code + "\n" + WORDS
    chunks = _chunks(spark, text, chunking.recursive_chunks, title="")
    assert sum(code.strip() in c for c in chunks) >= 1
    assert not any("call_3(" in c and "call_800(" not in c for c in chunks)


def test_unclosed_fence_is_plain_text(spark):
    text = "```\n" + "\n".join("line of words here" for _ in range(600))
    assert len(_chunks(spark, text, chunking.recursive_chunks, title="")) > 1


def test_citations(spark):
    df = spark.createDataFrame(
        [("See [2][2], [9] and [05].\n```py\narr[0]\n```\nthen [1]", [1, 2, 5]), ("none", [1]), ("[3]", [])],
        "a string, k array<int>",
    )
    kept = citations.kept_sources(citations.cited_numbers(F.col("a")), F.col("k"))
    rows = df.select(kept.alias("kept"), citations.rewrite(F.col("a"), kept).alias("a")).collect()
    assert rows[0].kept == [1, 2, 5]
    assert rows[0].a == "See [2][2], 9 and [3].\n```py\narr[0]\n```\nthen [1]"
    assert (rows[1].kept, rows[1].a) == ([], "none")
    assert (rows[2].kept, rows[2].a) == ([], "3")


def test_html(spark):
    page = (
        '<h1>T</h1><style>x</style><ul><li>a</li><li>b &amp;lt; c</li></ul>'
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language"> Java </ac:parameter>'
        "<ac:plain-text-body><![CDATA[\nif (a < b) { <x> }\n]]></ac:plain-text-body></ac:structured-macro>"
        '<p><b>x</b><br/><a href="/u">y</a></p>'
    )
    text = _one(spark, html.html_to_text(F.col("h")), h=page)
    assert text.startswith("# T\n\n- a\n- b &lt; c")
    assert "```java\nif (a < b) { <x> }\n```" in text
    assert text.endswith("**x**\n[y](/u)")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([0.0, 0.0], [1.0])], "a array<double>, b array<double>")
    row, zero = df.select(
        V.l2_normalize(F.col("a")).alias("n"), V.dot(F.col("a"), F.col("b")).alias("d"),
        V.cosine(F.col("a"), F.col("a")).alias("c"), V.parse_vector(F.lit("[3.0,4.0]")).alias("p"),
    ).collect()
    assert (row.n, row.d, row.c, row.p) == ([0.6, 0.8], 3.0, 1.0, [3.0, 4.0])
    assert (zero.n, zero.c) == (None, None)


@pytest.mark.parametrize("markup, text", [
    ("<p><a class=x href='/a?b=1'>one</a> <a href=\"/c\">two</a></p>", "[one](/a?b=1) [two](/c)"),
    ("<ol><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li><li>c</li></ol><ul><li>d</li></ul>",
     "1. a\n\n1. x\n2. y\n\n2. b\n3. c\n\n- d"),
    ("<OL><li>a</li></OL> and <ol><li>b</li></ol></ol>", "1. a\n\n and\n\n1. b"),
    ("<b>k</b><pre><code>if <b>a</b> &lt; 1:\n  <i>x</i></code></pre><p><b>z <i>y</i></b></p>", "**k**\n\n```\nif a < 1:\n  x\n```\n\n**z _y_**"),
    ("<b>a <b>b</b></b><br>c", "**a **b****\nc"),
    ("<pre>never closed <b>x</b>", "never closed **x**"),
])
def test_markup_by_hand(spark, markup, text):
    assert _one(spark, html.html_to_text(F.col("h")), h=markup) == text
