from clientlens.llm.html_extract import extract


def pages(spark, host, bodies):
    rows = [(i, f"https://{host}/{i}", f"<html><body><nav>menu</nav><article><h1>T{i}</h1>{b}</article></body></html>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_lines_of_the_template_inside_articles_are_taken_out(spark):
    bodies = [f"<p>Own words of page {i}.</p><p>Copies for your readers can be ordered here.</p>" for i in range(6)]
    found = {r.page_id: r.text for r in extract(pages(spark, "a.example", bodies)).collect()}
    assert found == {i: f"T{i}\nOwn words of page {i}." for i in range(6)}


def test_text_that_not_every_page_has_and_articles_of_nothing_else_stay(spark):
    bodies = [f"<p>Own words of page {i}.</p><p>A line.</p>" for i in range(5)] + ["<p>Own words of page 5.</p>"]
    found = {r.page_id: r.text for r in extract(pages(spark, "b.example", bodies)).collect()}
    assert found[0] == "T0\nOwn words of page 0.\nA line." and found[5] == "T5\nOwn words of page 5."
    same = spark.createDataFrame([(i, f"https://c.example/{i}", "<article><p>All pages say this.</p></article>") for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in extract(same).collect()} == {"All pages say this."}
