from paperloom.operators import sections as S


def rows(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "k long, html string")
    return [tuple(r) for r in S.sections(df, "k").orderBy("k", "n").collect()]


def test_tree_of_headings(spark):
    html = "Intro <b>b</b>old<h1>A</h1><p>one</p><h3 class='x'>A.1</h3>two<h2>A.2</h2>three<h4>A.2.1</h4><h2>A.3</h2>four<H1>B</H1>"
    assert rows(spark, html) == [
        (0, 0, 0, None, None, 0, "Intro bold"), (0, 1, 1, "A", 0, 5, "one"), (0, 2, 3, "A.1", 1, 2, "two"), (0, 3, 2, "A.2", 1, 4, "three"),
        (0, 4, 4, "A.2.1", 3, 4, ""), (0, 5, 2, "A.3", 1, 5, "four"), (0, 6, 1, "B", 0, 6, ""),
    ]


def test_references_and_unread_parts_are_left_out(spark):
    html = "<head><title>t</title></head><script>'<h1>no</h1>'</script><!-- <h1>no</h1> --><nav>n</nav><h2> References: </h2>r<h2>Reference lists</h2>x &amp;lt; &lt;y&gt;<footer>f</footer>"
    assert rows(spark, html) == [(0, 2, 2, "Reference lists", 0, 2, "x &lt; <y>")]


def test_open_headings_nulls_and_empty_pages(spark):
    assert rows(spark, None, "", "<h2>Left open<p>text</p>", "<h2>To the end", "\x01plain", "<header>h</header>") == [
        (2, 1, 2, "Left open", 0, 1, "text"), (3, 1, 2, "To the end", 0, 1, ""), (4, 0, 0, None, None, 0, "plain"), (5, 0, 0, None, None, 0, "h"),
    ]


def test_an_empty_table_and_other_columns(spark):
    assert S.sections(spark.createDataFrame([], "k long, html string"), "k").count() == 0
    df = spark.createDataFrame([(1, "<h1>a</h1>b", "clash", 5)], "k long, html string, text string, n int")
    assert [tuple(r) for r in S.sections(df, "k").collect()] == [(1, 1, 1, "a", 0, 1, "b")]
