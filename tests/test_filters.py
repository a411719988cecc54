import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import normalised_title, query_terms
from newsloom.operators import filters as L

ROWS = "_ord long, title string, description string, text string, category string, keywords array<string>, url string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            (0, "COVID-19 hits Delhi", "numbers rise", None, "health", ["virus"], "https://www.cnn.com/a"),
            (1, "Covid 19 again", "C++ tooling", "body of $AAPL news", None, None, "https://edition.cnn.com/b"),
            (2, "某景区发生事故", None, None, None, None, "https://notcnn.com/c"),
            (3, None, None, None, None, None, ""),
            (4, "covid19 variant", "covid-1999", None, "sports", ["climate"], "https://cnn.com:8080/d"),
        ],
        ROWS,
    )


def ids(df):
    return sorted(r["_ord"] for r in df.select("_ord").collect())


@pytest.mark.parametrize(
    ("query", "mode", "want"),
    [
        ("covid-19", "any", [0, 1, 3]),  # a dash also stands for a blank; an empty row passes
        ("C++", "any", [1, 3]),
        ("景区", "any", [2, 3]),
        ("delhi numbers", "all", [0, 3]),
        ("delhi again", "any", [0, 1, 3]),
        ('"numbers rise"', "exact_phrase", [0, 3]),
        ("   ", "any", [0, 1, 2, 3, 4]),
    ],
)
def test_query(rows, query, mode, want):
    assert ids(L.filter_articles(rows, query=query, query_mode=mode)) == want


def test_body_and_exclusion(rows):
    assert ids(L.filter_articles(rows, query="$AAPL", search_in=["body"])) == [0, 1, 2, 3, 4]
    assert ids(L.filter_articles(rows.where("text IS NOT NULL"), query="AAPL", search_in=["body"])) == [1]
    assert ids(L.filter_articles(rows, exclude_terms=["delhi", '"C++"'])) == [2, 3, 4]


def test_topic_uses_category_and_keywords(rows):
    assert ids(L.filter_articles(rows, topic="climate,virus")) == [0, 3, 4]
    assert ids(L.filter_articles(rows, topic=["health", "virus"], topic_mode="all")) == [0, 3]


def test_domains(rows):
    assert ids(L.filter_by_domain(rows, whitelist=["https://cnn.com/"], blacklist=["cnn.com"])) == [0, 1]
    assert ids(L.filter_by_domain(rows, blacklist=["cnn.com"])) == [2, 3, 4]  # the port is part of the host
    many = [f"x{i}.org" for i in range(300)] + ["cnn.com"]
    assert ids(L.filter_by_domain(rows, whitelist=many)) == [0, 1]


def test_language(spark):
    df = spark.createDataFrame([(0, "the cat is on the mat and it was not here", "en-GB"), (1, "le chat est dans la maison avec les enfants", "fr"), (2, "xyz", None), (3, "नमस्ते", "ne")], "_ord long, title string, lang string")
    assert ids(L.filter_by_language(df, "en")) == [0, 2, 3]
    assert ids(L.filter_by_language(df, "hi", detected="lang")) == [2, 3]
    assert ids(L.filter_by_language(df, None)) == [0, 1, 2, 3]


def test_terms_and_titles(spark):
    assert query_terms('"big bank" rates, (fed)') == ["big bank", "rates", "fed"]
    df = spark.createDataFrame([("  Hello—World!  it's \t fine ",), (None,)], "t string")
    assert [r[0] for r in df.select(normalised_title(F.col("t"))).collect()] == ["helloworld its fine", ""]


def test_languages_by_script_and_words(spark):
    texts = {
        "en": "the minister said that it was not in the plan", "fr": "le ministre a dit que ce n'est pas dans le plan", "sv": "ministern sade att det inte är något som vi har", "pl": "minister powiedział że nie jest to dla nas i tak",
        "ru": "министр сказал что это не так как было и в плане", "uk": "міністр сказав що це не так як було і в плані", "ar": "قال الوزير إن هذا لا يكون في الخطة من بعد", "fa": "وزیر گفت که این در برنامه است و به آن", "hi": "मंत्री ने कहा कि यह योजना में है और से", "ja": "大臣はこれが計画にないと述べました", "zh": "部长表示这不在今年的计划之中并且没有", "ko": "장관은 그것이 계획에 없다고 말했다", "el": "ο υπουργός είπε ότι δεν είναι", "th": "รัฐมนตรีกล่าวว่าไม่ได้อยู่ในแผน",
    }
    df = spark.createDataFrame([(i, c, t, None) for i, (c, t) in enumerate(texts.items())], "_ord long, code string, title string, description string")
    got = {r["code"]: r["found"] for r in df.select("code", L.detect_language(F.col("title")).alias("found")).collect()}
    assert got == {c: c for c in texts}
    for code in ("hi", "ja", "ru", "sv"):  # a language asked for leaves the others out
        assert [r["code"] for r in L.filter_by_language(df, code).collect()] == [code]
    assert L.filter_by_language(df, "xx").count() == len(texts)
