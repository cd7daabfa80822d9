from pyspark.sql import functions as F

from lodestar.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_tokens_fold_marks_and_keep_dots(spark):
    t = F.col("text")
    assert one(spark, "Inferência do NIM 2.1.0 a b", T.tokens(t, ("do",))) == ["inferencia", "nim", "2.1.0"]
    assert one(spark, None, T.tokens(t)) is None


def test_sentences(spark):
    assert one(spark, "One. Two!  Three\n\nfour", T.sentences(F.col("text"))) == ["One.", "Two!", "Three", "four"]


def test_boundaries(spark):
    t = F.col("text")
    assert one(spark, "consultorias", T.starts_word(t, "consultoria")) and not one(spark, "xconsultoria", T.starts_word(t, "consultoria"))
    assert not one(spark, "consultorias", T.whole_word(t, "consultoria"))


def test_veto_needs_all_sentences(spark):
    veto = T.vetoed_by_third_party(F.col("text"), "crypto", ["client"])
    assert one(spark, "Our client does crypto. We don't.", veto)
    assert not one(spark, "Our client does crypto. We do crypto.", veto)
    assert not one(spark, "nothing", veto)


def test_cleaning(spark):
    t = F.col("text")
    assert one(spark, "Menu\nA line of words\n\n\n\nDone.", T.clean_lines(t)) == "A line of words\nDone."
    assert one(spark, "keep\n\n\n\n * star\n=========\nsee Cookies here\n<center>x\nlast", T.drop_boilerplate(t, ["cookies"])) == "keep\n\nlast"
    assert one(spark, "Log out here\nok", T.drop_boilerplate(t)) == "ok"
    assert one(spark, "<h2> T </h2>[a](b) ![i](j)\n|\n - \n \n---\n| - |\n<!-- x -->z", T.clean_markdown(t)) == "## T\na\n---\n| - |\nz"
    assert one(spark, "x\n  ## Head #\ny", T.title_of(t, "markdown", F.lit("d"))) == "Head #" and one(spark, "none", T.title_of(t, "markdown", F.lit("d"))) == "d"
    assert one(spark, "<title> T </title>", T.title_of(t, "html", F.lit("d"))) == "T"
    assert one(spark, "a.\n.\n \nTags:\n’.", T.orphan_lines(t)) == [".", "Tags:", "’."]
    assert one(spark, "<nav>x</nav>a<script>if(1<2){}</script>b<!-- c -->", T.strip_noise_tags(t)) == "ab"


def test_windows_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    got = one(spark, text, T.fixed_windows(F.col("text")))
    assert got[0] == text[:800] and got[1] == text[680:1480] and got[-1].endswith(text[-1]) and len(got) == 3
    assert one(spark, "", T.fixed_windows(F.col("text"))) == []


def test_shorten(spark):
    t = F.col("text")
    assert one(spark, "one two three", T.shorten(t, 9)) == "one two…" and one(spark, "short", T.shorten(t, 9)) == "short" and one(spark, "abc", T.shorten(t, 1)) == "a"


def test_slug_and_newlines(spark):
    assert one(spark, " ACME é Nº 1!", T.slug(F.col("text"))) == "acme-e-n-1"
    assert one(spark, "a\r\nb\rc", T.normalise_newlines(F.col("text"))) == "a\nb\nc"


def test_longest_block(spark):
    t = F.col("text")
    page = "<body><main>teaser</main><article><p>CEO of <a>Acme</a>.</p><p>More  words here</p></article><nav>menu that is much longer than all of the text here</nav></body>"
    assert one(spark, page, T.longest_block(t)) == "teaser\nCEO of Acme.\nMore  words here"
    assert one(spark, "<main>a</main><article>b</article>", T.longest_block(t)) == "a\nb" and one(spark, "", T.longest_block(t)) == ""
    assert one(spark, "<html><body>x</body><article>much longer <b>than</b> it</article></html>", T.longest_block(t)) == "much longer than it"
