"""Pages on which scripts, styles, asides or reader comments could get into the text, and the sample that weights are fitted on."""

import pytest
from pyspark.sql import functions as F

from stavework.llm import html_text

WORDS = "The quick brown fox runs over hills and far away again. " * 8
ARTICLE = f"<body><article><h1>Title here</h1><p>{WORDS}</p>%s</article></body>"
SECRETS = [
    "<script src=/static/>var secret = 1; track(secret);</script>", "<script src='a.js'/>var secret = 2;</script>", "<style media=screen/>.secret{}</style>", "<aside data-u=/a/>secret</aside>",
    "<div class='comment-list'><p>secret words of a reader</p></div>", "<div id='user-comments-area'><p>secret</p></div>", f"<div class=comments><p>{'secret talk of readers. ' * 200}</p></div>",
    "<section id=comments><article class='comment-body'><p>secret</p></article></section>", "<div class='disqus-thread'>secret</div>", "<ol class='replies nested'><li>secret</li></ol>",
]
WRAPPED = ["<div class='has-comments layout'>%s</div>", "<div id='post-comments-open'>%s</div>"]


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("part", SECRETS)
def test_left_out(weights, part):
    text = html_text.extract(ARTICLE % part, weights)
    assert text == html_text.extract(ARTICLE % "", weights) and "quick brown" in text


@pytest.mark.parametrize("wrapper", WRAPPED)
def test_a_wrapper_of_the_content_stays(weights, wrapper):
    inner = ARTICLE % ""
    assert html_text.extract(wrapper % inner, weights) == html_text.extract(inner, weights)
    plain = f"<h1>Title here</h1><p>{WORDS}</p>"
    assert "quick brown" in html_text.extract(f"<body>{wrapper % plain}</body>", weights)


def test_elements_that_html_does_not_close_by_a_slash(weights):
    assert html_text.extract(f"<body><article><p>{WORDS}<svg/>{WORDS}<br/>{WORDS}</p></article></body>", weights).count("quick brown") == 24
    assert "secret" not in html_text.extract(f"<body><nav/>secret menu</nav><article><p>{WORDS}</p></article></body>", weights)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def seen(monkeypatch, pages, sample):
    """Pages that fit counts, and what it learns from them."""
    found = []
    monkeypatch.setattr(html_text, "Weights", lambda counts: found.append(counts) or counts)
    html_text.fit(pages, sample=sample)
    return sum(n for (kind, what, _, _), n in found[0].items() if (kind, what) == ("tag", "/body")), found[0]


def test_null_and_hot_keys_do_not_move_the_sample(monkeypatch, pages):
    n, known = seen(monkeypatch, pages.withColumn("page_id", F.lit(None).cast("long")), 2000)
    every, same = seen(monkeypatch, pages, 2000)
    assert n == every > 20 and known == same
    hot = pages.withColumn("page_id", F.when(F.col("page_id") % 6 != 0, 1).otherwise(F.col("page_id")))
    assert 0 < seen(monkeypatch, hot, 20)[0] <= 20
    copies = pages.unionByName(pages).unionByName(pages)
    assert seen(monkeypatch, copies, 2000)[1] == known


def test_empty_tables_and_clashing_columns(spark, pages):
    clashing = pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x")).withColumn("k", F.lit(0)).withColumn("u", F.lit(0)).withColumn("t", F.lit(0))
    assert html_text.main_texts(clashing.limit(0)).count() == 0
    assert html_text.main_texts(clashing).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(html_text.main_texts(clashing).collect()) == sorted(html_text.main_texts(pages).collect())
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "just words")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.main_texts(odd).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "just words", 10)]
